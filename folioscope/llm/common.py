"""What the operators of this subpackage share: shared storage, tables, Arrow slices, connected components."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioscope.sources.storage import materialize, new_path, observed, shared_dir, spread  # noqa: F401

#: Words of every operator here: runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Text bytes that one NumPy step of an Arrow stage works on; what a task holds follows this and its longest text.
SLICE_BYTES = 4 << 20

#: A key is hot if over one in HOT rows has it, so there are fewer than HOT hot keys, whatever the input.
HOT = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def lookup(rows: DataFrame, table: DataFrame, keys: list[str], total: int, n: str = "n", most: int | None = None) -> DataFrame:
    """Inner join of rows with `table`, whose keys are unique and whose column `n` says how many of the `total` rows hold them.

    Rows of hot keys meet their (fewer than HOT) table rows by broadcast and aren't shuffled, so no task gets more than one in HOT rows of a key.
    With `most`, the largest `n`, it's a plain join where no key is hot.
    """
    if most is not None and most <= total / HOT:
        return rows.join(table.drop(n), keys)
    hot = F.col(n) > total / HOT
    few = table.where(hot).drop(n)
    often = rows.join(F.broadcast(few), keys)
    rest = rows.join(F.broadcast(few.select(*keys)), keys, "left_anti").join(table.where(~hot).drop(n), keys)
    return often.unionByName(rest)


def slices(batch: pa.RecordBatch, column: int, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that the text bytes of one part stay near `most`; one longer text makes a part of its own."""
    data = batch.column(column)
    if not len(data):
        return
    sizes = pc.fill_null(pc.binary_length(data), 0).to_pylist()
    start = held = 0
    for i, n in enumerate(sizes):
        if i > start and held + n > most:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += n
    yield batch.slice(start)


def texts_of(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each text; null is empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def map_slices(df: DataFrame, schema: str, make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch]], text_at: int = 1) -> DataFrame:
    """mapInArrow with `make()` called once a task; what it returns gets slices of bounded text size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = make()
        for batch in batches:
            for part in slices(batch, text_at):
                yield step(part)

    return df.mapInArrow(run, schema)


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of `edges` (a, b: long); root is the smallest node it reaches.

    Alternating large-star and small-star rounds; each round's tables are written, so lineage and plans stay short: the driver holds the plan of every query
    it ran. The graph has settled when each node is a smallest one or has no neighbour but its smallest, which is observed while neighbours are counted, so
    no round or job only finds that out. No node's neighbours are ever gathered in one row: minima are pre-aggregated, and edges of nodes with very many meet them by `lookup`.
    """
    e = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    e = materialize(e, "cc")
    for _ in range(max_rounds):
        both = e.select(F.col("a").alias("u"), F.col("b").alias("v")).union(e.select(F.col("b"), F.col("a")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("n"))
        low, seen = observed(low, "cc-low", open=F.count_if(F.expr("m < u and n > 1")), total=F.sum("n"), most=F.max("n"))
        if not seen["open"]:
            return low.select(F.col("u").alias("node"), F.col("m").alias("root"))
        large = lookup(both, low, ["u"], seen["total"], most=seen["most"]).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # every u has its neighbours' minima here, which are as few as its neighbours; a hub's are nearly all one value
        large = large.withColumn("m", F.min("v").over(Window.partitionBy("u")))
        e = large.select(F.inline(F.array(F.struct(F.col("u").alias("a"), F.col("m").alias("b")), F.struct(F.col("v").alias("a"), F.col("m").alias("b")))))
        e = materialize(e.where("a <> b").distinct(), "cc")
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
