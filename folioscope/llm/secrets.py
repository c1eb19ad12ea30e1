"""Operator 2: secret scans by a trigram inverted index, with DataFrame functions only.

Each rule's regular expression is parsed into a Boolean query over lower-case trigrams: an OR of ANDs that every match
must satisfy. The index maps each trigram that some query names to the documents that hold it (others could never be looked
up); postings are intersected per document by OR-ing one bit a trigram, and only documents that satisfy a
query are verified with its rule. Rules without mandatory trigrams scan every document. Postings hold at most the rules'
trigrams for each document, and grouping is by document, so common trigrams make no hot task.

Spans are code points, end exclusive. Null and empty texts have none. Rows that repeat a doc_id share candidates
and are verified each for itself; rows with a null doc_id, which no posting can name, are verified with every rule. Columns of other names are not read.
Work within a row grows with its text and spans, not with their square.
"""

from __future__ import annotations

import itertools
from dataclasses import dataclass
from re import _constants as C
from re import _parser as parser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import arrays
from .arrays import let

#: Alternatives that a query's derivation keeps apart; beyond it the rest of a rule counts as anything, which only widens the query.
ALTERNATIVES = 64
GAP = None
MASK = "[SECRET]"


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    #: the group whose length must be at least `least`
    group: int = 0
    least: int = 0
    #: what a text must match before its spans are looked for, if that's cheaper than the pattern
    guard: str = ""


#: The first three are fixed by contract; the others are well-known key formats.
BASE = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 18),
    Rule("hex", r"[0-9a-f]+", 0, 16, r"[0-9a-f]{16}"),
)
EXTRA = (
    Rule("github", r"gh[opsu]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("stripe", r"[rs]k_live_[A-Za-z0-9]{16,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+"),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
)
RULES = BASE + EXTRA


def _alternatives(tree) -> list[tuple]:
    """Strings that the parsed expression may stand for, each as literals with GAP for anything."""
    out: list[tuple] = [()]
    for op, value in tree:
        if op is C.LITERAL:
            these = [(chr(value).lower(),)]
        elif op is C.IN and len(value) <= 8 and all(o is C.LITERAL for o, _ in value):
            these = [(chr(x).lower(),) for _, x in value]
        elif op is C.SUBPATTERN:
            these = _alternatives(value[-1])
        elif op is C.BRANCH:
            these = [a for branch in value[1] for a in _alternatives(branch)]
        elif op in (C.MAX_REPEAT, C.MIN_REPEAT, C.POSSESSIVE_REPEAT):
            low, high, inner = value
            one = _alternatives(inner)
            if (low, high) == (0, 1):
                these = [(), *one]
            elif low:
                these = [sum(x, ()) + (() if low == high <= 3 else (GAP,)) for x in itertools.product(one, repeat=min(low, 3))] if len(one) ** min(low, 3) <= ALTERNATIVES else [(GAP,)]
            else:
                these = [(GAP,)]
        elif op is C.AT or op in (C.ASSERT, C.ASSERT_NOT):
            these = [()]
        else:
            these = [(GAP,)]
        these = list(dict.fromkeys(these))
        if len(these) * len(out) > ALTERNATIVES:
            these = [(GAP,)]
        out = list(dict.fromkeys(a + b for a in out for b in these))
    return out


def trigram_query(pattern: str) -> list[frozenset[str]] | None:
    """OR of ANDs of lower-case trigrams that a match's text must hold; None if the expression demands none."""
    conjunctions = set()
    for alternative in _alternatives(parser.parse(pattern)):
        grams: set[str] = set()
        for literal, run in itertools.groupby(alternative, lambda x: x is not GAP):
            s = "".join(run) if literal else ""
            grams |= {s[i : i + 3] for i in range(len(s) - 2)}
        if not grams:
            return None
        conjunctions.add(frozenset(sorted(grams)[:62]))
    return sorted((c for c in conjunctions if not any(d < c for d in conjunctions)), key=sorted)


def _trie(grams: list[str]) -> str:
    """One expression for all trigrams, branching by character."""
    quote = lambda c: c if c.isalnum() else f"\\x{{{ord(c):x}}}"
    first = [(quote(a), [g[1:] for g in same]) for a, same in ((a, list(s)) for a, s in itertools.groupby(sorted(grams), lambda g: g[0]))]
    second = lambda rest: "|".join(f"{quote(b)}[{''.join(quote(g[1]) for g in same)}]" for b, same in itertools.groupby(rest, lambda g: g[0]))
    return "|".join(f"{a}(?:{second(rest)})" for a, rest in first)


def index(docs: DataFrame, grams: list[str], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Postings (doc_id, trigram), distinct for each row, of the trigrams asked for."""
    held = F.array_distinct(F.regexp_extract_all(F.lower(F.col(text_col)), F.lit(f"(?=({_trie(grams)}))"), F.lit(1)))
    return docs.select(F.col(id_col).alias("doc_id"), F.explode(held).alias("trigram"))


def candidates(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame | None:
    """(doc_id, rules: array of kinds) of documents that satisfy the queries; None if no rule has one."""
    terms, grams = [], set()
    for rule in rules:
        for n, all_of in enumerate(trigram_query(rule.pattern) or []):
            grams |= all_of
            terms += [(rule.kind, n, g, bit, len(all_of)) for bit, g in enumerate(sorted(all_of))]
    if not terms:
        return None
    rows = F.array(*(F.struct(*(F.lit(x).alias(n) for n, x in zip(("kind", "branch", "trigram", "bit", "need"), t, strict=True))) for t in terms))
    queries = docs.sparkSession.range(1).select(F.inline(rows))  # as many rows as the rules have trigrams
    hits = index(docs, sorted(grams), id_col, text_col).join(F.broadcast(queries), "trigram")
    both = hits.groupBy("doc_id", "kind", "branch", "need").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("bits")).where(F.bit_count("bits") == F.col("need"))
    return both.groupBy("doc_id").agg(F.collect_set("kind").alias("rules"))


def rule_spans(text: Column, rule: Rule, order: int) -> Column:
    """Array of (start, order, end, kind): leftmost non-overlapping matches that are long enough."""
    pattern = F.lit(rule.pattern)
    gaps, hits = F.split(text, rule.pattern, -1), F.regexp_extract_all(text, pattern, F.lit(0))
    sized = F.transform(F.regexp_extract_all(text, pattern, F.lit(rule.group)), F.length) if rule.group else F.transform(hits, F.length)
    parts = F.arrays_zip(F.transform(gaps, F.length).alias("gap"), F.transform(hits, F.length).alias("hit"), sized.alias("sized"))
    empty = F.array().cast("array<struct<start: int, order: int, end: int, kind: string>>")

    def placed(z: Column) -> Column:
        before = arrays.scan(F.transform(z, lambda x: (x["gap"] + x["hit"]).cast("long")), lambda a, b: a + b)

        def span(x: Column, at: Column) -> Column:
            start = (at + x["gap"]).cast("int")
            return F.when(x["sized"] >= rule.least, F.struct(start.alias("start"), F.lit(order).alias("order"), (start + x["hit"]).alias("end"), F.lit(rule.kind).alias("kind")))

        return let(before, lambda at: F.array_compact(F.transform(z, lambda x, k: span(x, F.get(at, k)))))

    # the last gap has no match after it
    found = let(F.filter(parts, lambda x: x["hit"].isNotNull()), placed)
    return F.when(text.rlike(rule.guard or rule.pattern), found).otherwise(empty)


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """(row: struct of the columns `keep` of docs, or id_col, _text, spans: sorted array of (start, order, end, kind))."""
    keep = keep or [id_col]
    found = candidates(docs, rules, id_col, text_col)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.struct(*(F.col(c) for c in keep)).alias("row"), F.col(id_col).alias("_id"), text.alias("_text"))
    if found is not None:
        named = rows.where(F.col("_id").isNotNull()).join(found.select(F.col("doc_id").alias("_doc"), F.col("rules").alias("_rules")), F.col("_id") == F.col("_doc"), "left").select("row", "_text", "_rules")
        every = F.array(*(F.lit(r.kind) for r in rules))
        rows = named.union(rows.where(F.col("_id").isNull()).select("row", "_text", every.alias("_rules")))
    empty = F.array().cast("array<struct<start: int, order: int, end: int, kind: string>>")
    parts = []
    for order, rule in enumerate(rules):
        spans = rule_spans(F.col("_text"), rule, order)
        parts.append(spans if trigram_query(rule.pattern) is None else F.when(F.array_contains("_rules", rule.kind), spans).otherwise(empty))
    return rows.select("row", "_text", F.array_sort(F.concat(*parts)).alias("spans"))


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def report(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans)."""
    found = scan(docs, rules, id_col, text_col)
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda s: s["order"] < len(BASE))
    return found.select(F.col("row")[id_col].alias("doc_id"), *(count(r.kind) for r in BASE), F.sha2(_listed(base).cast("binary"), 256).alias("base_sha256"), _listed(F.col("spans")).alias("spans"))


def redact(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text", mask: str = MASK) -> DataFrame:
    """docs with every span of text_col replaced by `mask`; overlapping spans become one. Null texts stay null."""
    names = docs.columns
    found = scan(docs, rules, id_col, text_col, names)
    text = F.col("_text")

    def covered(x: Column) -> Column:
        # what lies before a span that begins at or after the end of all before it, and the mask
        piece = lambda s, k: F.when(s["start"] >= F.get(x["ends"], k), F.concat(arrays.cut(x["parts"], F.get(x["ends"], k), s["start"]), F.lit(mask))).otherwise("")
        last = F.array_max(F.transform("spans", lambda s: s["end"]))
        return F.concat(F.array_join(F.transform("spans", piece), ""), arrays.cut(x["parts"], last, F.length(text)))

    ends = arrays.scan(F.transform("spans", lambda s: s["end"].cast("long")), lambda a, b: F.greatest(a, b))
    clean = let(F.struct(ends.alias("ends"), arrays.segments(text).alias("parts")), covered)
    own = F.col("row")
    return found.select(*(F.when(own[c].isNotNull(), F.when(F.size("spans") > 0, clean).otherwise(text)).alias(c) if c == text_col else own[c].alias(c) for c in names))


def oracle() -> str:
    """report() over documents, for DuckDB."""
    parts = []
    for order, r in enumerate(RULES):
        p = r.pattern.replace("'", "''")
        parts.append(
            f"select rid, {order} as ord, '{r.kind}' as kind, unnest(list_transform(range(1, len(hits) + 1), lambda i: list_sum(list_transform(gaps[1:i], lambda g: length(g))) + coalesce(list_sum(list_transform(hits[1:i-1], lambda h: length(h))), 0)))::bigint as s,"
            f" unnest(list_transform(hits, lambda h: length(h))) as n, unnest(list_transform(sized, lambda h: length(h))) as size, {r.least} as least"
            f" from (select rid, regexp_extract_all(t, '{p}') as hits, regexp_extract_all(t, '{p}', {r.group}) as sized, string_split_regex(t, '{p}') as gaps from d)"
        )
    return (
        "with d as (select row_number() over () as rid, doc_id, coalesce(text, '') as t from documents), f as ("
        + " union all ".join(parts)
        + "), g as (select rid, ord, kind, s, kind || ':' || s || ':' || (s + n) as span from f where size >= least),"
        " a as (select rid, count(*) filter (kind = 'assign') as n_assign, count(*) filter (kind = 'access') as n_access, count(*) filter (kind = 'hex') as n_hex,"
        " string_agg(span, ',' order by s, ord) filter (ord < 3) as base, string_agg(span, ',' order by s, ord) as spans from g group by rid)"
        " select doc_id, coalesce(n_assign, 0) as n_assign, coalesce(n_access, 0) as n_access, coalesce(n_hex, 0) as n_hex, sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans from d left join a using (rid)"
    )
