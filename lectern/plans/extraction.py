"""Extraction with a ledger: what a content gave under a version of the extractor is kept, and never extracted again.

The ledger is a table of Parquet files, keyed by the content's digest and the
version. A run extracts only what an anti join with it leaves, each content once,
and appends it under a name that follows from the keys; so a run that is repeated
after a failure finds what it had written, and adds nothing twice.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def content_key(content: str = "content"):
    """The lowercase hex sha256 of the content, text or bytes."""
    return F.sha2(F.col(content).cast("binary"), 256)


def ledger(spark: SparkSession, path: str, fields: T.StructType) -> DataFrame:
    """(key, version, the extractor's columns) of the ledger; empty where there is none yet. Of entries that two runs wrote side by side one counts."""
    schema = T.StructType([T.StructField("key", T.StringType()), *fields.fields, T.StructField("version", T.StringType())])
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(path).dropDuplicates(["key", "version"])


def extracted(files: DataFrame, path: str, version: str, extract: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, int]:
    """(all rows of ``files`` with the extractor's columns, the number of contents that this run extracted).

    ``files`` has a column ``content``; ``extract`` maps rows of (key, content) to one
    row of (key, ..) for each. A null content isn't extracted: its columns are null.
    Files of equal content share an entry. Columns of ``files`` that have a name of
    the extractor's go.
    """
    spark = files.sparkSession
    asked = files.select(content_key().alias("key"), "content").filter("content is not null")
    fields = T.StructType([f for f in extract(asked.limit(0)).schema.fields if f.name != "key"])
    done = ledger(spark, path, fields).filter(F.col("version") == version)
    fresh = asked.join(done.select("key"), "key", "left_anti").groupBy("key").agg(F.any_value("content").alias("content"))
    named = fresh.agg(F.count("*"), F.sum(F.conv(F.substring("key", 1, 15), 16, 10).cast("decimal(38,0)"))).first()
    if named[0]:
        rows = extract(fresh).select("key", *fields.names, F.lit(version).alias("version"))
        rows.write.mode("overwrite").parquet(f"{path}/{version}-{named[0]}-{named[1]}")
    known = ledger(spark, path, fields).filter(F.col("version") == version).drop("version").withColumnRenamed("key", "_key")
    kept = [c for c in files.columns if c not in fields.names]
    return files.select(*kept).join(known, content_key() == F.col("_key"), "left").drop("_key"), named[0]
