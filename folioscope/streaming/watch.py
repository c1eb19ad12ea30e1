"""The row-local operators over a stream of texts (an extension: folders are watched, nothing else changes)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from folioscope.operators import clean, classify, grade


def read_texts(spark: SparkSession, folder: str, files_a_trigger: int = 1000) -> DataFrame:
    """(file_name, text) of text files as they arrive."""
    rows = spark.readStream.option("maxFilesPerTrigger", files_a_trigger).text(folder, wholetext=True)
    return rows.select(F.regexp_extract(F.input_file_name(), r"([^/]*)$", 1).alias("file_name"), F.col("value").alias("text"))


def processed(texts: DataFrame) -> DataFrame:
    """texts with clean_text, validation and classification; works alike on tables and streams."""
    rows = texts.withColumn("clean_text", clean.clean(F.coalesce("text", F.lit(""))))
    rows = rows.withColumn("validation", grade.validation(F.col("clean_text")))
    return classify.classify(rows, "clean_text")


def write(rows: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append to Parquet, exactly once, until what is there has been read."""
    return rows.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
