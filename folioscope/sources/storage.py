"""Tables written between steps, in a folder that all executors see."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession

_folders: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """A folder of this application below spark.checkpoint.dir, which all executors see.

    Only where that setting is absent and the master is local (tests, a single machine) a temporary folder takes its place; a
    cluster's executors wouldn't see it, so there the setting is asked for (ValueError).
    """
    app = spark.sparkContext.applicationId
    if app not in _folders:
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base:
            if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
                raise ValueError("spark.checkpoint.dir has to name a folder that all executors see")
            base = "file://" + tempfile.mkdtemp(prefix="folioscope-")
            spark.sparkContext.setCheckpointDir(base)
        _folders[app] = f"{base.rstrip('/')}/folioscope-{uuid.uuid4().hex}"
        atexit.register(_drop, spark, _folders[app])
    return _folders[app]


def _drop(spark: SparkSession, folder: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    except Exception:  # the session has ended; the folder then goes with the cluster's clean-up of the checkpoint folder
        pass


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: lineage ends here and survives lost executors."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def observed(df: DataFrame, name: str, **figures: Column) -> tuple[DataFrame, dict]:
    """materialize(), and aggregates of its rows that are observed while they are written, so they cost no job of their own."""
    seen = Observation()
    return materialize(df.observe(seen, *(c.alias(k) for k, c in figures.items())), name), seen.get


#: Inputs under so many bytes may be dealt out anew; larger ones have enough partitions of their own.
SMALL_BYTES = 64 << 20


def spread(df: DataFrame) -> DataFrame:
    """A small table that was stored in fewer parts than there are cores (one row group, say), over all cores; any other as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(2 * cores) if size < SMALL_BYTES and df._jdf.rdd().getNumPartitions() <= cores else df


#: Bytes of stored input, and rows, for each part of a table that is dealt by key.
PART_BYTES = 4 << 20
PART_ROWS = 2500


def dealt(df: DataFrame, key: str, *columns: str) -> DataFrame:
    """Columns of a stored table, dealt by key over parts of about PART_BYTES and PART_ROWS at most, for long work on each row.

    Stored bytes alone don't tell the work: repeated texts are stored once in a row group. Rows are counted from the files' footers. A file is read by row groups, and one may hold a million rows, so the parts as stored can be few and grow with the table. Parts here grow in number
    instead, and so does nothing that a task holds. Rows of one key come together; keys should be many.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.select(*columns).repartition(max(2 * cores, -(-size // PART_BYTES), -(-df.count() // PART_ROWS)), key)
