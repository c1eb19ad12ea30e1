"""Operator 12: documents linked by the Jaccard similarity of their word n-grams, by a grouped prefix join.

A document is the set of its distinct 4-word shingles. Documents with equal sets are one node. Shingles have a total order, rare ones first as far as
a table of counts by bucket tells; a set of n needs only its first n - need + 1 shingles, its prefix, to meet every set that it can link to. Nodes of equal
prefix and size are one group, so postings hold each prefix once. Two groups are a candidate pair if their sizes allow a link and their
prefixes share enough: more than `need` less what can follow the shorter reach. Pairs of groups are expanded to pairs of nodes and verified on whole sets.

Only components are asked for, so links are sought in two steps, and no group of near copies gives all its pairs. First each posting's groups are paired with the
posting's group that shares most with others (of copies with edits of their own that is the one with fewest), and a group's nodes with its smallest; what verifies is linked. Then postings that hold more than one component give every pair of groups of
different components, whatever was tried before, by the exact bound; a group that shares too little with all others together is left out of them. A pair that is never tried lies within one component, so no component is lost.

Shingles are 64-bit hashes: two different ones of one pair of documents are taken as equal about once in 10**13 pairs of a thousand shingles. A node is named by a hash
of its set. The table of counts and the marks of verified nodes have fixed sizes (4 MB, 1 MB), whatever the input; they only order and pre-select, so results don't depend on them.

A null or empty text, or one without words, has no shingles and is linked with nothing. Repeated rows repeat in the result. A null doc_id counts as no doc_id in component_id. An
empty table gives an empty table. Other columns don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common, words

SHINGLE, PERCENT = 4, 85
#: Buckets of the table of counts, and the rows it travels in.
BUCKETS, CHUNKS = 1 << 20, 16
MARKS = 1 << 23
#: Text bytes that one NumPy step works on; it holds about fifty times as many.
STEP = 1 << 20
_MIX = np.uint64(0x9FB21C651E98DF25)


def sets(texts: list[bytes], n: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(shingles, owners): the distinct shingles of each text in ascending order, owners ascending; fewer than n words are one shingle."""
    h, owner, _, _ = words.word_hashes(texts, words.BETWEEN_SPACES)
    size = np.bincount(owner, minlength=len(texts))
    found, owners = [], []
    for k in range(1, n + 1):
        grams, at = words.grams(h, owner, k)
        if k < n:
            few = size[owner[at]] == k
            grams, at = grams[few], at[few]
        found.append(grams)
        owners.append(owner[at])
    grams, owners = np.concatenate(found), np.concatenate(owners)
    by = np.lexsort((grams, owners))
    grams, owners = grams[by], owners[by]
    new = np.ones(len(grams), bool)
    new[1:] = (grams[1:] != grams[:-1]) | (owners[1:] != owners[:-1])
    return grams[new], owners[new]


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _MIX
    return h ^ (h >> np.uint64(29))


def names(grams: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """A hash of each set; sets stand one after the other, as many shingles each as sizes say. Empty ones give 0."""
    upto = np.append(np.uint64(0), np.cumsum(_mixed(grams), dtype=np.uint64))
    ends = np.cumsum(sizes)
    return _mixed(upto[ends] - upto[ends - sizes] + sizes.astype(np.uint64)).view(np.int64) * (sizes > 0)


def need(n: int | np.ndarray, percent: int = PERCENT):
    """Fewest shingles that a set of n shares with any set it links to."""
    return (percent * n + 99) // 100


def documents(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, text, text_hash): what the steps below read."""
    text = F.col(text_col).cast("string")
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("text_hash"))


def _bucket(grams: np.ndarray) -> np.ndarray:
    return (grams >> np.uint64(44)).astype(np.int64)


def measured(rows: DataFrame, n: int = SHINGLE) -> tuple[DataFrame, np.ndarray]:
    """(doc_id, text_hash, size, node) of every row, and how many shingles of all rows are in each bucket."""
    assert BUCKETS == 1 << 20

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names_ = ["doc_id", "text_hash", "size", "node", "chunk", "counts"]
        counts = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for part in common.slices(batch, 1, STEP):
                grams, owners = sets(common.texts_of(part.column(1)), n)
                counts += np.bincount(_bucket(grams), minlength=BUCKETS)
                size = np.bincount(owners, minlength=part.num_rows)
                none = pa.nulls(part.num_rows, pa.int32()), pa.nulls(part.num_rows, pa.binary())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(size), pa.array(names(grams, size)), *none], names_)
        chunks = counts.reshape(CHUNKS, -1)
        held = [k for k in range(CHUNKS) if chunks[k].any()]
        none = pa.nulls(len(held), pa.int64())
        yield pa.RecordBatch.from_arrays([none, none, none, none, pa.array(held, pa.int32()), pa.array([chunks[k].tobytes() for k in held], pa.binary())], names_)

    found = common.materialize(rows.mapInArrow(run, "doc_id long, text_hash long, size long, node long, chunk int, counts binary"), "ngrams")

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for chunk, counts in zip(batch.column(0).to_pylist(), batch.column(1)):
                counts = np.frombuffer(counts.as_buffer(), np.int64)
                total[chunk] = total[chunk] + counts if chunk in total else counts
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([x.tobytes() for x in total.values()], pa.binary())], ["chunk", "counts"])

    counts = np.zeros((CHUNKS, BUCKETS // CHUNKS), np.int64)
    for r in found.where("chunk is not null").select("chunk", "counts").repartition("chunk").mapInArrow(add, "chunk int, counts binary").collect():  # CHUNKS rows
        counts[r.chunk] = np.frombuffer(r.counts, np.int64)
    return found.where("chunk is null").select("doc_id", "text_hash", "size", "node"), counts.ravel()


def prefixes(rows: DataFrame, counts: np.ndarray, n: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """(node, size, grp, prefix: array<bigint>) of each node that can link to another: with k shingles alike of at least k + 1."""
    least = next(k for k in range(1, 10_000) if 100 * k >= percent * (k + 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank = np.minimum(counts, np.iinfo(np.int32).max).astype(np.int32)
        for batch in batches:
            for part in common.slices(batch, 1, STEP):
                grams, owners = sets(common.texts_of(part.column(1)), n)
                size = np.bincount(owners, minlength=part.num_rows)
                node = names(grams, size)
                by = np.lexsort((grams, rank[_bucket(grams)], owners))
                grams = grams[by]
                keep = size >= least
                length = np.where(keep, size - need(size, percent) + 1, 0)
                place = np.arange(len(grams)) - np.repeat(np.cumsum(size) - size, size)
                prefix = grams[place < np.repeat(length, size)]
                group = names(prefix, length)
                lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(length[keep])), pa.int32()), pa.array(prefix.view(np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array(node[keep]), pa.array(size[keep]), pa.array(group[keep]), lists], ["node", "size", "grp", "prefix"])

    found = rows.mapInArrow(run, "node long, size long, grp long, prefix array<bigint>").dropDuplicates(["node"])
    return found.withColumn("grp", F.xxhash64("grp", "size"))


def _length(size: Column, percent: int) -> Column:
    return size - F.floor((size * percent + 99) / 100) + 1


def _enough(a: Column, b: Column, shared: Column, percent: int) -> Column:
    """Can two sets of sizes a and b link that share so many shingles of their prefixes? Shared ones lie within both prefixes, or after the end of the one that ends first."""
    overlap = F.floor(((a + b) * percent + (99 + percent)) / (100 + percent))
    rest = F.greatest(a - _length(a, percent), b - _length(b, percent))
    return (F.least(a, b) * 100 >= F.greatest(a, b) * percent) & (F.least(shared + rest, a, b) >= overlap)


def postings(groups: DataFrame) -> DataFrame:
    """(gram, grp, size, held, weight, bits0..3, loose) of the shingles that are in more than one group's prefix.

    held: how many of those the group has; weight: in how many prefixes they are, added up; bits: those 256 slots that they fall in; loose: how many fell in a slot that was taken.
    """
    every = groups.select(F.explode("prefix").alias("gram"), "grp", "size")
    shared = every.groupBy("gram").agg(F.count("*").alias("n")).where("n > 1").withColumn("uses", F.col("n"))
    shared, seen = common.observed(shared, "ngrams-shared", total=F.sum("n"), most=F.max("n"))
    post = common.materialize(common.lookup(every, shared, ["gram"], seen["total"] or 0, most=seen["most"] or 0), "ngrams-postings")
    slot = F.col("gram").bitwiseAND(255)
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), slot.bitwiseAND(63).cast("int"))
    bits = [F.coalesce(F.bit_or(F.when(F.shiftright(slot, 6) == k, bit)), F.lit(0)).alias(f"bits{k}") for k in range(4)]
    of = post.groupBy("grp").agg(F.count("*").alias("held"), F.sum("uses").alias("weight"), *bits)
    of = of.withColumn("loose", F.col("held") - sum((F.bit_count(f"bits{k}") for k in range(4)), F.lit(0)))
    return common.materialize(post.drop("uses").join(of, "grp"), "ngrams-weighed")


def verified(rows: DataFrame, pairs: DataFrame, n: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """Those of pairs (a, b) of nodes that are linked; sets are made anew from the texts, of the nodes in pairs only."""
    pairs = common.materialize(pairs, "ngrams-pairs")
    nodes = pairs.select(F.explode(F.array("a", "b")).alias("node"))
    slot = F.shiftrightunsigned("node", 41)
    bits = nodes.groupBy(F.shiftright(slot, 6).alias("at")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), slot.bitwiseAND(63).cast("int"))).alias("bits"))
    marks = np.zeros(MARKS // 64, np.int64)
    for r in bits.collect():  # MARKS / 64 rows at most
        marks[r["at"]] = r["bits"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for part in common.slices(batch, 1, STEP):
                grams, owners = sets(common.texts_of(part.column(1)), n)
                size = np.bincount(owners, minlength=part.num_rows)
                node = names(grams, size)
                at = node.view(np.uint64) >> np.uint64(41)
                asked = (marks[(at >> np.uint64(6)).astype(np.int64)].view(np.uint64) >> (at & np.uint64(63))) & np.uint64(1) == 1
                first = np.zeros(len(node), bool)
                first[np.unique(node, return_index=True)[1]] = True
                asked &= first & np.array([x not in seen for x in node.tolist()], bool)
                if len(seen) < 100_000:
                    seen.update(node[asked].tolist())
                lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(size[asked])), pa.int32()), pa.array(grams[np.repeat(asked, size)].view(np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array(node[asked]), lists], ["node", "grams"])

    made = rows.mapInArrow(run, "node long, grams array<bigint>").dropDuplicates(["node"])
    of = common.materialize(made.join(nodes.distinct(), "node", "left_semi"), "ngrams-sets")
    both = pairs.join(of.select(F.col("node").alias("a"), F.col("grams").alias("ga")), "a").join(of.select(F.col("node").alias("b"), F.col("grams").alias("gb")), "b")
    common_ = F.size(F.array_intersect("ga", "gb"))
    both = both.select("a", "b", common_.alias("i"), (F.size("ga") + F.size("gb")).alias("s"))
    return both.where(F.col("i") * 100 >= (F.col("s") - F.col("i")) * percent).select("a", "b")


def links(rows: DataFrame, counts: np.ndarray, n: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """(a, b): pairs of nodes that connect just the nodes that links connect."""
    nodes = common.materialize(prefixes(rows, counts, n, percent), "ngrams-nodes")
    groups = nodes.groupBy("grp").agg(F.min("node").alias("lead"), F.first("size").alias("size"), F.first("prefix").alias("prefix"))
    post = postings(groups)
    # first: each group against the one of its posting that shares most, and a group's nodes against its smallest
    heads = post.groupBy("gram").agg(F.max(F.struct("weight", "grp", "size")).alias("h"), F.count("*").alias("n")).select("gram", F.col("h.grp").alias("head"), F.col("h.size").alias("hs"), "n")
    heads, seen = common.observed(heads, "ngrams-heads", total=F.sum("n"), most=F.max("n"))
    total = seen["total"] or 0
    met = common.lookup(post, heads, ["gram"], total, most=seen["most"] or 0).where("grp <> head").groupBy("head", "grp").agg(F.count("*").alias("shared"), F.first("size").alias("size"), F.first("hs").alias("hs"))
    met = met.where(_enough(F.col("size"), F.col("hs"), F.col("shared") * 2, percent)).select("head", "grp")
    lead = common.materialize(groups.select("grp", "lead"), "ngrams-leads")
    pairs = met.join(lead, "grp").select("head", F.col("lead").alias("b")).join(lead.select(F.col("grp").alias("head"), F.col("lead").alias("a")), "head").select("a", "b")
    inner = nodes.join(lead, "grp").where("node <> lead").select(F.col("lead").alias("a"), F.col("node").alias("b"))
    first = common.materialize(verified(rows, pairs.union(inner), n, percent), "ngrams-links")
    # then: all pairs of groups that share enough and aren't known to be in one component
    found = common.connected_components(first)
    placed = common.materialize(nodes.select("node", "size", "grp").join(found, "node", "left").select("node", "size", "grp", F.coalesce("root", "node").alias("root")), "ngrams-placed")
    of = placed.groupBy("grp").agg(F.min("root").alias("low"), F.max("root").alias("high"))
    # a group in several components gets a name of its own
    of = common.materialize(of.select("grp", F.when(F.col("low") == F.col("high"), F.col("low")).otherwise(F.xxhash64("grp")).alias("place"), (F.col("low") != F.col("high")).alias("split")), "ngrams-places")
    post = post.join(of, "grp")
    mixed = post.groupBy("gram").agg(F.min("place").alias("p"), F.max("place").alias("q"), F.max(F.struct("weight", "grp", "place")).alias("h"), F.count("*").alias("n")).where("p <> q").select("gram", F.col("h.place").alias("main"), "n")
    mixed, seen = common.observed(mixed, "ngrams-mixed", most=F.max("n"))
    post = common.materialize(common.lookup(post, mixed, ["gram"], total, most=seen["most"] or 0), "ngrams-mixed-postings")
    left = post.where("place <> main").select("gram", F.col("grp").alias("x"), F.col("size").alias("sx"), F.col("held").alias("hx"), F.col("place").alias("px"), F.col("loose").alias("ox"), *(F.col(f"bits{k}").alias(f"x{k}") for k in range(4)))
    right = post.select("gram", F.col("grp").alias("y"), F.col("size").alias("sy"), F.col("held").alias("hy"), F.col("place").alias("py"), F.col("loose").alias("oy"), *(F.col(f"bits{k}").alias(f"y{k}") for k in range(4)), "main")
    one = (F.col("py") == F.col("main")) | (F.col("x") < F.col("y"))
    # two groups share no more than either shares with anyone, nor than the slots that both fill and what fell in taken ones
    slots = sum((F.bit_count(F.col(f"x{k}").bitwiseAND(F.col(f"y{k}"))) for k in range(4)), F.lit(0))
    fits = _enough(F.col("sx"), F.col("sy"), F.least(F.col("hx"), F.col("hy"), slots + F.least("ox", "oy")), percent)
    met = left.hint("merge").join(right.hint("merge"), "gram").where((F.col("px") != F.col("py")) & one & fits)
    met = met.groupBy(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).agg(F.count("*").alias("shared"), F.first(F.struct("sx", "sy")).alias("s"))
    met = met.where(_enough(F.col("s.sx"), F.col("s.sy"), F.col("shared"), percent)).select("x", "y")
    member = placed.select("grp", "node", "root")
    pairs = met.join(member.select(F.col("grp").alias("x"), F.col("node").alias("a"), F.col("root").alias("ra")), "x").join(member.select(F.col("grp").alias("y"), F.col("node").alias("b"), F.col("root").alias("rb")), "y")
    pairs = pairs.where("ra <> rb").select("a", "b")
    # nodes of one group that its smallest isn't linked with
    split = placed.join(of.where("split").select("grp"), "grp", "left_semi")
    again = split.select("grp", F.col("node").alias("a"), F.col("root").alias("ra")).join(split.select("grp", F.col("node").alias("b"), F.col("root").alias("rb")), "grp").where("ra <> rb and a < b").select("a", "b")
    # what is known comes as stars, on which components settle at once
    known = found.where("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b"))
    return known.union(verified(rows, pairs.union(again).distinct(), n, percent))


def link_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row; component_id is the smallest doc_id that links reach."""
    rows = documents(docs, id_col, text_col)
    every, counts = measured(rows, n)
    found = common.connected_components(links(rows, counts, n, percent))
    least = common.materialize(every.where("size > 0").groupBy("node").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")), "ngrams-least")
    tied = least.join(found, "node").select("node", "least", "root")
    tops, seen = common.observed(tied.groupBy("root").agg(F.min("least").alias("top"), F.count("*").alias("n")), "ngrams-tops", total=F.sum("n"), most=F.max("n"))
    tied = common.lookup(tied, tops, ["root"], seen["total"] or 0, most=seen["most"] or 0).select("node", "top")
    of = common.materialize(least.join(tied, "node", "left").select("node", "n", F.when(F.col("top").isNull(), F.col("least")).otherwise(F.col("top")).alias("component_id")), "ngrams-of")
    linked = common.lookup(every.where("size > 0"), of, ["node"], every.count()).select("doc_id", F.col("size").alias("n_shingles"), "component_id")
    return linked.unionByName(every.where("size = 0").select("doc_id", F.col("size").alias("n_shingles"), F.col("doc_id").alias("component_id")))


def oracle(n: int = SHINGLE, percent: int = PERCENT) -> str:
    """DuckDB SQL for link_documents(): all pairs that share a shingle, then the smallest number that links reach."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return f"""
    with recursive w as (select row_number() over () as rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{lower}'), '[^\\x20\\x09-\\x0D]+') as w from documents),
    s as materialized (select rid, doc_id, case when len(w) = 0 then [] when len(w) < {n} then [array_to_string(w, ' ')] else list_distinct([array_to_string(w[i:i + {n - 1}], ' ') for i in range(1, len(w) - {n - 2})]) end as s from w),
    c as materialized (select min(doc_id) as c, s, count(*) as copies from (select doc_id, list_sort(s) as s from s where len(s) > 0) group by s),
    t as materialized (select c, len(s) as n, unnest(s) as t from c),
    p as (select a.c as a, b.c as b, any_value(a.n) as na, any_value(b.n) as nb, count(*) as i from t a join t b on a.t = b.t and a.c < b.c and least(a.n, b.n) * 100 >= greatest(a.n, b.n) * {percent} group by a.c, b.c),
    l as materialized (select a, b from p where i * 100 >= (na + nb - i) * {percent}),
    e as materialized (select a, b from l union all select b, a from l),
    r(node, root) as (select c, c from c union select e.b, r.root from r join e on e.a = r.node where r.root < e.b),
    m as (select node, min(root) as root from r group by node)
    select s.doc_id, len(s.s)::bigint as n_shingles, coalesce(m.root, s.doc_id) as component_id from s left join c on list_sort(s.s) = c.s left join m on m.node = c.c"""
