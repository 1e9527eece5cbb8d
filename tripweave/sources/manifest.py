"""What a source holds, and what changed since last time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tripweave.functions.text import include_exclude
from tripweave.operators.compare import tagged_union


def file_manifest(spark: SparkSession, path: str, include=(), exclude=()) -> DataFrame:
    """``path, size, etag`` of the files under a folder; contents are not read.

    The etag stands for size and modification time. Patterns are matched against the path below the folder, so names of
    parent folders play no part.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    etag = F.md5(F.concat_ws("|", F.col("length"), F.unix_micros("modificationTime")))
    listed = files.select("path", F.col("length").alias("size"), etag.alias("etag"))
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    root = folder.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(folder).toString().rstrip("/") + "/"
    below = F.when(F.startswith("path", F.lit(root)), F.substr("path", F.lit(len(root) + 1))).otherwise(F.substring_index("path", "/", -1))
    return listed.where(include_exclude(below, include, exclude))


def manifest_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """``new``, ``changed``, ``unchanged`` or ``removed`` per path, by etag."""
    both = tagged_union(old, new, ["path", "etag"])
    sides = both.groupBy("path").agg(
        F.max(F.when(~F.col("_is_new"), F.col("etag"))).alias("etag_old"),
        F.max(F.when(F.col("_is_new"), F.col("etag"))).alias("etag_new"),
    )
    status = (
        F.when(F.col("etag_old").isNull(), "new")
        .when(F.col("etag_new").isNull(), "removed")
        .when(F.col("etag_old") == F.col("etag_new"), "unchanged")
        .otherwise("changed")
    )
    return sides.withColumn("status", status)


def to_import(old: DataFrame, new: DataFrame) -> DataFrame:
    """Paths that have to be read again."""
    return manifest_diff(old, new).where(F.col("status").isin("new", "changed")).select("path")
