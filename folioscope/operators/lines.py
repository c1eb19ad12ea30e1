"""Repetition filters over the lines of a text, each within its row: no shuffle, so they also run in streams."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from folioscope.functions.text import filled_lines, fold, has, let, normal_form, rare_space, split_lines, strip

NUMBERED = r"^No\.?\s*\d+\s*$"


def normal_form_of(line: Column) -> Column:
    """The normal form that lines are compared in."""
    return normal_form(line)


def _join(lines: Column) -> Column:
    return F.array_join(lines, "\n")


def drop_runs(text: Column, most: int = 2) -> Column:
    """Of a run of equal lines (stripped, not empty) the first one and `most` more stay."""

    def of(x: Column) -> Column:
        def stays(line: Column, i: Column) -> Column:
            s = F.get(x["key"], i)
            same = F.lit(True)
            for back in range(1, most + 2):
                same = same & F.coalesce(F.get(x["key"], i - back) == s, F.lit(False))
            return ~(same & (F.length(s) > 0))

        return _join(F.filter(x["line"], stays))

    lines = split_lines(text)
    return let(lines, lambda v: let(F.struct(v.alias("line"), F.transform(v, strip).alias("key")), of))


def drop_near_duplicates(text: Column, most: int = 3) -> Column:
    """Of the lines that are equal in normal form the first `most` of the whole text stay; empty ones stay."""

    def of(x: Column) -> Column:
        def early(s: Column, k: Column) -> Column:
            return (F.length(s["key"]) == 0) | F.coalesce(F.get(x["sorted"], k - most)["key"] != s["key"], F.lit(True))

        kept = F.sort_array(F.transform(F.filter(x["sorted"], early), lambda s: s["at"]))
        return _join(F.transform(kept, lambda i: F.get(x["line"], i)))

    def keyed(v: Column) -> Column:
        return let(F.transform(v, normal_form_of), lambda keys: F.when(F.size(keys) - F.size(F.array_distinct(keys)) >= most, let(ordered(v, keys), of)).otherwise(text))

    def ordered(v: Column, keys: Column) -> Column:
        return F.struct(v.alias("line"), F.sort_array(F.transform(keys, lambda key, i: F.struct(key.alias("key"), i.alias("at")))).alias("sorted"))

    return let(split_lines(text), keyed)


def drop_prefix_loops(text: Column, prefix: int = 15, least: int = 8) -> Column:
    """Runs of at least `least` lines that are all numbers ("No. 7"), or that share the normal form of their first `prefix` characters, go.

    Shorter or empty lines break runs of the second kind. Where both kinds overlap, either removes its lines.
    """

    def in_run(keys: Column, i: Column, n: Column) -> Column:
        def starts(s: Column) -> Column:
            return (s + least <= n) & F.forall(F.sequence(s + 1, s + least - 1), lambda j: F.coalesce(F.get(keys, j) == F.get(keys, s), F.lit(False)))

        return F.get(keys, i).isNotNull() & F.exists(F.sequence(F.greatest(i - least + 1, F.lit(0)), i), starts)

    def of(x: Column) -> Column:
        n = F.size(x["line"])
        # a run leaves so many fewer distinct values
        few = lambda keys: F.size(keys) - F.size(F.array_distinct(keys)) >= least - 1
        return F.when(few(x["number"]) & (F.size(F.array_compact(x["number"])) >= least) | few(x["prefix"]), _join(F.filter(x["line"], lambda line, i: ~(in_run(x["number"], i, n) | in_run(x["prefix"], i, n))))).otherwise(text)

    def keyed(v: Column) -> Column:
        number = F.transform(v, lambda line: F.when(has(strip(line), NUMBERED, "i"), 1))
        head = F.transform(v, lambda line: let(strip(line), lambda s: F.when(F.length(s) >= prefix, normal_form(F.substring(s, 1, prefix)))))
        return F.struct(v.alias("line"), number.alias("number"), head.alias("prefix"))

    return F.when(F.size(split_lines(text)) < least, text).otherwise(let(split_lines(text), lambda v: let(keyed(v), of)))


def may_repeat(text: Column) -> Column:
    """A cheap test without which none of the three filters, as they stand by default, changes a text: lines of one normal form are equal without white space too."""
    n = F.size(split_lines(text))

    def of(keys: Column) -> Column:
        equal = F.size(keys) - F.size(F.array_distinct(keys)) >= 3
        numbers = lambda: F.size(F.filter(keys, lambda k: F.startswith(k, F.lit("no")))) >= 8
        heads = lambda: F.size(F.filter(split_lines(text), lambda x: F.length(x) >= 15)) >= 8
        return equal | (F.size(keys) >= 8) & (numbers() | heads())

    return (n >= 4) & (rare_space(text) | let(split_lines(F.replace(fold(text), F.lit(" "), F.lit(""))), of))


def most_common_line(text: Column) -> Column:
    """Struct (line, n) of the most frequent stripped line that isn't empty, the first of equally frequent ones; null without lines."""
    return let(filled_lines(text), most_common)


def most_common(lines: Column) -> Column:
    """most_common_line() of lines that are stripped and not empty; bind them before."""

    def runs(rows: Column) -> Column:
        """Longest run of the sorted lines, as (n, -first place, line)."""
        start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("first"), F.lit("").alias("line"))

        def better(a: Column, b: Column) -> Column:
            return F.when((a["n"] > b["n"]) | (a["n"] == b["n"]) & (a["first"] <= b["first"]), a).otherwise(b)

        def step(acc: Column, s: Column) -> Column:
            now = F.when((acc["now"]["n"] > 0) & (acc["now"]["line"] == s["line"]), F.struct((acc["now"]["n"] + 1).alias("n"), acc["now"]["first"].alias("first"), s["line"].alias("line"))).otherwise(F.struct(F.lit(1).alias("n"), s["at"].alias("first"), s["line"].alias("line")))
            return let(now, lambda m: F.struct(m.alias("now"), better(acc["best"], m).alias("best")))

        return F.aggregate(rows, F.struct(start.alias("now"), start.alias("best")), step, lambda acc: acc["best"])

    rows = F.sort_array(F.transform(lines, lambda x, i: F.struct(x.alias("line"), i.alias("at"))))
    return F.when(F.size(lines) > 0, let(runs(rows), lambda b: F.struct(b["line"].alias("line"), b["n"].alias("n"))))
