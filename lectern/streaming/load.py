"""Structured Streaming forms: documents that arrive in a folder, and the load of calls by sliding window.

An extension: the batch operators are the same functions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.operators.blocks import blocks


def arriving(spark: SparkSession, folder: str, schema: str, files: int = 100) -> DataFrame:
    """A stream of the rows of Parquet files as they appear, ``files`` at a time."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(folder)


def arriving_blocks(spark: SparkSession, folder: str, separator: str = r"\n") -> DataFrame:
    """Blocks of arriving documents; stateless, so any trigger will do."""
    return blocks(arriving(spark, folder, "doc_id long, text string"), separator)


def call_load(calls: DataFrame, by: str, late: str = "2 minutes", slide: str = "10 seconds") -> DataFrame:
    """(window, by, n_calls, tokens) over 60 seconds; calls later than ``late`` are left out."""
    return calls.withWatermark("at", late).groupBy(F.window("at", "60 seconds", slide), by).agg(F.count("*").alias("n_calls"), F.sum("tokens").alias("tokens"))


def fresh_uploads(uploads: DataFrame, late: str = "1 hour", keys: tuple[str, ...] = ("name", "size")) -> DataFrame:
    """The stream of uploads (with ``at``, their time) without those that repeat within ``late``, in whatever batch they come; of each the first that is read stays. The state holds a key no longer than that."""
    return uploads.withWatermark("at", late).dropDuplicatesWithinWatermark(list(keys))
