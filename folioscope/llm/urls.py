"""Operator 7: URL filters by character language models.

Rules decide what they cover. All other URLs are judged by two smoothed variable-order Markov models over characters, one of
accepted and one of rejected URLs: the probability of a character after its ORDER predecessors backs off to that after one fewer, in
proportion to how little the longer context has been seen, down to a uniform one. The score is the log-likelihood of the
rejected model less that of the accepted one, divided by the URL's length.

The models learn from whole URLs that rules decide, and from nothing else. Rows whose page_id's crc32 is divisible by 5 are held out;
the threshold is the one that tells held-out accepted and rejected URLs apart best (largest difference of their rates above it, the most
lenient of equals). `calibrate` also gives the held-out rates and the area under the curve. If either class has nothing to learn from or to
calibrate with, all URLs without a rule are allowed.

Counts are exact: each window of ORDER + 1 characters is counted once for the whole table, and counts of shorter contexts are sums of those. So
the model is a table that grows with the input, and nothing of it is broadcast or gathered; the windows of URLs are joined to it, those
that many URLs hold (fewer than `common.HOT` by nature) by a broadcast of just these.

A null or empty url has empty host and path, matches no rule and is allowed, with score 0. A url without :// has empty host and path too
and is judged by its text. Rows are judged one by one: repeated rows repeat, a null page_id is kept. Rules are expressions, so there may be MOST_RULES.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

ORDER, PRIOR, SYMBOLS = 5, 2.0, 256
MOST_RULES = 500
BINS, WIDEST = 800, 4.0
LOWER, UPPER = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Stands before a URL's first character.
EDGE = "\x01"


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


RULES = (Rule("block", "net", "/"), Rule("allow", "example.net", "/en/"), Rule("block", "example.com", "/de/"), Rule("allow", "org", "/fr/"))


def parts(url: Column) -> tuple[Column, Column]:
    """Host and path; both empty for null or without ://."""
    at = F.instr(url, "://")
    rest = F.substring(url, at + 3, F.length(url))
    has = F.coalesce(at > 0, F.lit(False))
    host = F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), UPPER, LOWER)
    return F.when(has, host).otherwise(""), F.when(has, F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)).otherwise("")


def decided(pages: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(page_id, host, path, rule, verdict, url): the longest rule's name and verdict, null where none fits."""
    if len(rules) > MOST_RULES:
        raise ValueError(f"{len(rules)} rules; at most {MOST_RULES}")
    url = F.col(url_col).cast("string")
    host, path = parts(url)
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), host.alias("host"), path.alias("path"), F.coalesce(url, F.lit("")).alias("url"))
    chosen = F.lit(None).cast("struct<rule: string, verdict: string>")
    # shorter ones first, so the longest comes to stand outermost
    for r in sorted(rules, key=lambda r: len(r.name)):
        fits = ((F.col("host") == r.host) | F.col("host").endswith("." + r.host)) & F.col("path").startswith(r.path)
        chosen = F.when(fits, F.struct(F.lit(r.name).alias("rule"), F.lit(r.verdict).alias("verdict"))).otherwise(chosen)
    return rows.select("page_id", "host", "path", chosen.alias("_r"), "url").select("page_id", "host", "path", "_r.rule", "_r.verdict", "url")


def windows(url: Column, order: int = ORDER) -> Column:
    """Array of each character with the `order` ones before it."""
    return F.regexp_extract_all(F.concat(F.lit(EDGE * order), url), F.lit(f"(?s)(?=(.{{{order + 1}}}))"), F.lit(1))


def held_out(page_id: Column) -> Column:
    return F.coalesce(F.crc32(page_id.cast("string").cast("binary")), F.lit(1)) % 5 == 0


def log_ratios(counts: DataFrame, order: int = ORDER) -> DataFrame:
    """(w, ratio) of window counts (w, accepted, rejected): log-likelihood of its last character by the rejected model less that by the accepted one."""
    sums = [F.sum(c).alias(c) for c in ("accepted", "rejected")]
    levels = [counts.select(F.col("w").alias("g"), "accepted", "rejected")]
    for _ in range(order):
        levels.append(levels[-1].groupBy(F.expr("substring(g, 2)").alias("g")).agg(*sums))
    known = None
    for level in reversed(levels):  # from single characters on
        context = Window.partitionBy(F.expr("substring(g, 1, length(g) - 1)"))
        rows = level.select("g", F.expr("substring(g, 2)").alias("short"), *(x.alias(f"{c}_{k}") for c in ("accepted", "rejected") for k, x in (("n", F.col(c)), ("all", F.sum(c).over(context)))))
        base = lambda c, known=known: F.lit(1 / SYMBOLS) if known is None else F.col(f"p_{c}")
        if known is not None:
            rows = rows.join(known.withColumnRenamed("g", "short"), "short")
        known = rows.select("g", *(((F.col(f"{c}_n") + PRIOR * base(c)) / (F.col(f"{c}_all") + PRIOR)).alias(f"p_{c}") for c in ("accepted", "rejected")))
    return known.select(F.col("g").alias("w"), F.log(F.col("p_rejected") / F.col("p_accepted")).alias("ratio"))


@dataclass(frozen=True)
class Calibration:
    threshold: float
    #: of the held-out URLs that rules block and allow, the shares that score above the threshold
    caught: float = 0.0
    lost: float = 0.0
    auc: float = 0.5


def calibrate(scored: DataFrame, trained: bool = True) -> Calibration:
    """The threshold from held-out rows of `scores`, over a histogram of fixed size."""
    width = 2 * WIDEST / BINS
    place = F.least(F.greatest(F.floor((F.col("score") + WIDEST) / width), F.lit(0)), F.lit(BINS - 1)).cast("int")
    got = scored.where(F.col("held") & F.col("verdict").isNotNull()).groupBy(place.alias("bin"), (F.col("verdict") == "block").alias("bad")).count().collect()
    hist = np.zeros((2, BINS))
    for b, bad, n in got:
        hist[int(bad), b] += n
    if not trained or not hist.sum(axis=1).all():
        return Calibration(float("inf"))
    share = hist / hist.sum(axis=1, keepdims=True)
    above = share[:, ::-1].cumsum(axis=1)[:, ::-1]
    gap = above[1] - above[0]
    best = int(np.nonzero(gap >= gap.max() - 1e-9)[0][-1])
    auc = float((share[1] * (share[0].cumsum() - share[0] / 2)).sum())
    return Calibration(best * width - WIDEST, float(above[1, best]), float(above[0, best]), auc)


def scores(pages: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "page_id", url_col: str = "url") -> tuple[DataFrame, bool]:
    """((page_id, host, path, rule, verdict, held, has_text, score) of every page, are there URLs of both classes to learn from)."""
    rows = common.materialize(decided(pages, rules, id_col, url_col).withColumns({"held": held_out(F.col("page_id")), "uid": F.monotonically_increasing_id()}), "urls")
    learns = lambda verdict: F.col("verdict").eqNullSafe(F.lit(verdict)) & ~F.col("held")
    places = common.materialize(rows.select("uid", learns("allow").cast("long").alias("accepted"), learns("block").cast("long").alias("rejected"), F.explode(windows(F.col("url"))).alias("w")), "url-windows")
    counts = common.materialize(places.groupBy("w").agg(F.sum("accepted").alias("accepted"), F.sum("rejected").alias("rejected"), F.count("*").alias("n")), "url-counts")
    total, accepted, rejected = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("accepted"), F.lit(0)), F.coalesce(F.sum("rejected"), F.lit(0))).first()
    ratios = log_ratios(counts).join(counts.select("w", "n"), "w")
    found = common.lookup(places.select("uid", "w"), common.materialize(ratios, "url-ratios"), ["w"], total).groupBy("uid").agg(F.avg("ratio").alias("score"))
    out = rows.withColumn("has_text", F.length("url") > 0).drop("url").join(found, "uid", "left").drop("uid").withColumn("score", F.coalesce("score", F.lit(0.0)))
    return common.materialize(out, "url-scores"), bool(accepted and rejected)


def judge(pages: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(page_id, host, path, rule, verdict, score) for every page."""
    found, trained = scores(pages, rules, id_col, url_col)
    threshold = calibrate(found, trained).threshold
    own = F.when((F.col("score") > threshold) & F.col("has_text"), "block").otherwise("allow")
    return found.select("page_id", "host", "path", "rule", F.coalesce("verdict", own).alias("verdict"), "score")
