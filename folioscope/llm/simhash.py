"""Operator 6: SimHash near-duplicates by segment popcounts.

Each half of a 64-bit fingerprint in turn is embedded as the counts of set bits of its 32 segments of one bit, and the other half as the
count of its one segment of 32. The Manhattan distance of two such vectors never exceeds the Hamming distance of the fingerprints; for up to 3
differing bits it is at most 1 along one half's 32 axes, so these are a grid: a fingerprint is put in its own cell and looked up in its cell and the
32 one step away. Cells are as fine as 32 bits allow: of N fingerprints spread evenly one meets about N / 2**26 others by chance. What
meets in a cell is held against the bound (both halves' distances together), then verified on the fingerprints. Equal fingerprints count once.

Cells with more than `dense` fingerprints emit no pairs: their members are searched in blocks, breadth first, and
only a spanning forest of the links comes out, so a group of thousands of near copies costs no quadratic output
and loses no component. Blocks bound what one task holds, however large a cell is.

Nulls and texts without words have fingerprint zero and are linked like any other. Repeated rows repeat in the
result. A null doc_id is kept and counts as no doc_id in component_id (null where a component has none).
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common, ngramjoin

BITS = 3
SHINGLE = 3
SEED = 42
DENSE = 32
BLOCK = 8192
_BYTE_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)
_LANES = np.arange(8, dtype=np.int64) * 256


def fingerprint(text: bytes, n: int = SHINGLE) -> int:
    """SimHash of UTF-8 text as an unsigned integer."""
    words = text.lower().split()  # of bytes: A-Z only, and ASCII white space only
    if not words:
        return 0
    joined = b" ".join(words)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    k = min(n, len(words))
    starts, ends = (ends - sizes)[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist()
    digest = partial(xxhash.xxh64_intdigest, seed=SEED)
    h = np.fromiter((digest(joined[a:b]) for a, b in zip(starts, ends, strict=True)), np.uint64, len(starts))
    lanes = h.view(np.uint8).reshape(-1, 8) + _LANES
    counts = np.bincount(lanes.ravel(), minlength=2048).reshape(8, 256) @ _BYTE_BITS
    return int.from_bytes(np.packbits(counts.ravel() * 2 > len(h), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = SHINGLE) -> DataFrame:
    """(doc_id, text_hash: long, fp: long), one row for each row of docs."""

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = np.array([fingerprint(t, n) for t in common.texts_of(batch.column(1))], np.uint64).view(np.int64)
            return pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(found)], ["doc_id", "text_hash", "fp"])

        return step

    text = F.col(text_col).cast("string")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), _text_hash(text).alias("text_hash"))
    return common.map_slices(rows, "doc_id long, text_hash long, fp long", make)


def _text_hash(text: Column) -> Column:
    return F.xxhash64(text)


def _cells(fp: Column) -> Column:
    """The two cells of a fingerprint: one half, and which half it is in the lowest bit."""
    halves = (fp.bitwiseAND(0xFFFFFFFF), F.shiftrightunsigned(fp, 32))
    return F.array(*(F.shiftleft(h, 1).bitwiseOR(F.lit(k).cast("long")) for k, h in enumerate(halves)))


def _near(cell: Column) -> Column:
    """The cell and those one step away along one axis."""
    return F.concat(F.array(cell), F.transform(F.sequence(F.lit(1), F.lit(32)), lambda i: cell.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), i))))


def _bound(a: Column, b: Column) -> Column:
    """Manhattan distance of the vectors of two fingerprints that share a grid (the lower half's): never over the Hamming distance."""
    return F.bit_count(a.bitwiseXOR(b).bitwiseAND(0xFFFFFFFF)) + F.abs(F.bit_count(F.shiftrightunsigned(a, 32)) - F.bit_count(F.shiftrightunsigned(b, 32)))


def _forest(fps: np.ndarray, bits: int) -> list[tuple[int, int]]:
    """Links of a spanning forest of the graph of fingerprints within `bits`."""
    left, out = np.unique(fps).view(np.uint64), []
    while len(left):
        front, left = [left[0]], left[1:]
        while front and len(left):
            x = front.pop()
            hit = np.bitwise_count(left ^ x) <= bits
            if hit.any():
                new = left[hit]
                out += [(x, y) for y in new]
                front += list(new)
                left = left[~hit]
    return out


def links(fps: DataFrame, bits: int = BITS, dense: int = DENSE, block: int = BLOCK) -> DataFrame:
    """(a, b): links between distinct fingerprints of `fps` (fp) that connect all within `bits` (3 at most)."""
    if not 0 <= bits <= 3:
        raise ValueError("the grid's one step along one half covers up to 3 bits")
    # a plan takes exploded rows for as many as they came from, so without the hint it may broadcast them
    own = fps.select("fp", F.explode(_cells(F.col("fp"))).alias("cell")).hint("merge")
    look = own.select("fp", F.explode(_near(F.col("cell"))).alias("cell")).hint("merge")
    sizes = own.groupBy("cell").agg(F.count("*").alias("n"))
    base = own.join(sizes, "cell")
    close = (_bound(F.col("fp"), F.col("other")) <= bits) & (F.bit_count(F.col("fp").bitwiseXOR(F.col("other"))) <= bits)
    sparse = base.where(F.col("n") <= dense).select("cell", F.col("fp").alias("other")).join(look, "cell").where((F.col("other") < F.col("fp")) & close).select(F.col("other").alias("a"), F.col("fp").alias("b"))
    hot = sizes.where(F.col("n") > dense).select("cell", F.ceil(F.col("n") / block).cast("int").alias("kb"))
    near = look.join(hot, "cell").select("cell", "fp", "kb")
    looked = near.groupBy("cell", "kb").agg(F.count("*").alias("n")).select("cell", "kb", F.ceil(F.col("n") / block).cast("int").alias("kp"))
    part = lambda k: F.pmod(F.xxhash64("fp"), F.col(k)).cast("int")
    every = lambda k: F.explode(F.sequence(F.lit(0), F.col(k) - 1))
    rows = own.join(looked, "cell").select("cell", part("kb").alias("i"), every("kp").alias("j"), "fp").union(near.join(looked.select("cell", "kp"), "cell").select("cell", every("kb").alias("i"), part("kp").alias("j"), "fp"))

    def search(pdf: pd.DataFrame) -> pd.DataFrame:
        found = np.array(_forest(pdf["fp"].to_numpy(), bits), np.uint64).reshape(-1, 2).view(np.int64)
        return pd.DataFrame({"a": found[:, 0], "b": found[:, 1]})

    thick = rows.groupBy("cell", "i", "j").applyInPandas(search, "a long, b long")
    return sparse.union(thick)


def similar(docs: DataFrame, rows: DataFrame, id_col: str, text_col: str, n: int, percent: int) -> DataFrame:
    """(a, b): links between fingerprints of texts whose sets of n-word shingles are alike to `percent`; a set is named by its smallest fingerprint."""
    texts = ngramjoin.documents(docs, id_col, text_col)
    every, counts = ngramjoin.measured(texts, n)
    named = rows.select("text_hash", "fp").distinct().join(every.where("size > 0").select("text_hash", "node").distinct(), "text_hash").select("fp", "node").distinct()
    named = common.materialize(named, "simhash-sets")
    name = common.materialize(named.groupBy("node").agg(F.min("fp").alias("name")), "simhash-names")
    of = lambda c: name.select(F.col("node").alias(c), F.col("name").alias(f"name_{c}"))
    linked = ngramjoin.links(texts, counts, n, percent).join(of("a"), "a").join(of("b"), "b").select(F.col("name_a").alias("a"), F.col("name_b").alias("b"))
    return linked.union(named.join(name, "node").where("fp <> name").select(F.col("fp").alias("a"), F.col("name").alias("b")))


def components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: int = BITS, n: int = SHINGLE, percent: int | None = None) -> DataFrame:
    """(doc_id, text_hash, fp, root: the component's number, component_id) for every row.

    Fingerprints of n-word shingles link at `bits`, which short texts hardly reach. With `percent` texts also link, exactly, whose sets of shingles are alike to that.
    """
    rows, seen = common.observed(fingerprints(docs, id_col, text_col, n), "simhash", n=F.count("*"))
    least = common.materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")), "simhash-least")
    every = links(least.select("fp"), bits)
    if percent is not None:
        every = every.union(similar(docs, rows, id_col, text_col, n, percent))
    found = common.connected_components(every)
    # only linked fingerprints are looked up; the others stand for themselves
    tied = least.join(found, least.fp == found.node).select("fp", "least", "root")
    tops, held = common.observed(tied.groupBy("root").agg(F.min("least").alias("top"), F.count("*").alias("n")), "simhash-tops", total=F.sum("n"), most=F.max("n"))
    tied = common.lookup(tied, tops, ["root"], held["total"] or 0, most=held["most"] or 0).select("fp", "root", "top")
    of = least.join(tied, "fp", "left").select("fp", "n", F.coalesce("root", "fp").alias("root"), F.when(F.col("root").isNull(), F.col("least")).otherwise(F.col("top")).alias("component_id"))
    of, held = common.observed(of, "simhash-of", most=F.max("n"))
    return common.lookup(rows, of, ["fp"], seen["n"], most=held["most"] or 0)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: int = BITS) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row; component_id is the smallest doc_id that links reach."""
    found = components(docs, id_col, text_col, bits)
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: int = BITS, n: int = SHINGLE, percent: int | None = None) -> DataFrame:
    """One row of each component: of the rows with its smallest doc_id that of least text hash.

    Components are of texts, so rows of one doc_id whose texts aren't near each other all stay. A row with a null doc_id stays.
    """
    of = F.struct("doc_id", "text_hash")
    kept = components(docs, id_col, text_col, bits, n, percent).where("doc_id is not null").groupBy("root").agg(F.min(of).alias("k"))
    kept = kept.select(F.col("k.doc_id").alias("_kept_id"), F.col("k.text_hash").alias("_kept_hash"))
    names, row = docs.columns, F.struct(*(F.col(c) for c in docs.columns)).alias("row")
    rows = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("_kept_id"), _text_hash(F.col(text_col).cast("string")).alias("_kept_hash"), row)
    rows = rows.join(kept, ["_kept_id", "_kept_hash"], "left_semi").dropDuplicates(["_kept_id", "_kept_hash"])
    return rows.select(*(F.col("row")[c].alias(c) for c in names)).unionByName(docs.where(F.col(id_col).isNull()))
