"""Snapshots stored in buckets of their key, so that comparing and joining two of them moves no rows.

A snapshot is a catalog table, bucketed and sorted by its key columns. Two with the same number of buckets meet bucket by bucket: a join, and an
aggregate by the key on either side, find their rows where they are. A bucket is read by one task, so their number follows from the size of the
larger snapshot; it is chosen once, for all snapshots that are to be compared.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tripweave.operators.compare import count_by_key, snapshot_diff
from tripweave.schema import TIME_KEY

#: What a bucket should hold, about.
BUCKET_BYTES = 256 << 20


def held_bytes(rows: int, schema: T.StructType) -> int:
    """What so many rows take up in the tasks that sort and join them, about: 8 bytes a value, 16 more for a text."""
    return rows * sum(24 if isinstance(f.dataType, T.StringType) else 8 for f in schema.fields)


def bucket_count(table_bytes: int, cores: int, bucket_bytes: int = BUCKET_BYTES) -> int:
    """Buckets of about ``bucket_bytes`` for a table, at least one per core; a power of two, so that numbers of different tables divide each other."""
    return 1 << max(0, max(-(-table_bytes // bucket_bytes), cores) - 1).bit_length()


def write_snapshot(df: DataFrame, table: str, buckets: int, keys: Sequence[str] = tuple(TIME_KEY), path: str | None = None) -> None:
    """Store a snapshot in ``buckets`` sorted files by ``keys``: rows are dealt to tasks as to buckets, so each bucket is one file."""
    writer = df.repartition(buckets, *keys).write.bucketBy(buckets, *keys).sortBy(*keys).format("parquet")
    (writer.option("path", path) if path else writer).saveAsTable(table)


def read_snapshot(spark: SparkSession, table: str) -> DataFrame:
    return spark.read.table(table)


def _null_key(keys: Sequence[str]):
    some = F.lit(False)
    for k in keys:
        some = some | F.col(k).isNull()
    return some


def stored_counts(old: DataFrame, new: DataFrame, keys: Sequence[str] = tuple(TIME_KEY)) -> DataFrame:
    """``compare.count_by_key`` of two snapshots, joined where they lie.

    Each side is counted per key first, so repeated keys do not multiply. Nulls match each other in no join: keys with one are
    counted over both sides together.
    """
    null = _null_key(keys)
    sides = [s.where(~null).groupBy(*keys).agg(F.count("*").alias(n)) for s, n in ((old, "n_old"), (new, "n_new"))]
    joined = sides[0].hint("merge").join(sides[1], list(keys), "full")
    known = joined.select(*keys, *[F.coalesce(n, F.lit(0)).cast("long").alias(n) for n in ("n_old", "n_new")])
    return known.unionByName(count_by_key(old.where(null), new.where(null), keys))


def stored_status(old: DataFrame, new: DataFrame, keys: Sequence[str] = tuple(TIME_KEY)) -> DataFrame:
    """``compare.key_status`` of two snapshots, joined where they lie."""
    n_old, n_new = F.col("n_old"), F.col("n_new")
    return stored_counts(old, new, keys).withColumn("status", F.when(n_old == 0, "added").when(n_new == 0, "lost").otherwise("both"))


def stored_statistics(old: DataFrame, new: DataFrame, keys: Sequence[str] = tuple(TIME_KEY)) -> DataFrame:
    """``compare.set_statistics`` of two snapshots: only one row of partial sums per task is moved."""
    status = F.col("status")
    return stored_status(old, new, keys).agg(
        F.coalesce(F.sum("n_old"), F.lit(0)).cast("long").alias("n_old"),
        F.coalesce(F.sum("n_new"), F.lit(0)).cast("long").alias("n_new"),
        F.count_if(status == "added").alias("adds"),
        F.count_if(status == "lost").alias("dels"),
        F.count_if(status == "both").alias("both"),
    )


def stored_diff(old: DataFrame, new: DataFrame, attributes: Sequence[str], keys: Sequence[str] = tuple(TIME_KEY)) -> DataFrame:
    """``compare.snapshot_diff`` of two snapshots, joined where they lie.

    Only a key that a side has once has a value there, so each side is counted per key and joined with its own rows of such keys: no text
    is aggregated, and repeated keys do not multiply.
    """
    null = _null_key(keys)

    def side(df: DataFrame, tag: str) -> DataFrame:
        rows = df.where(~null)
        counts = rows.groupBy(*keys).agg(F.count("*").alias(f"n_{tag}")).alias("c")
        same = F.col(f"c.n_{tag}") == 1
        for k in keys:
            same = same & (F.col(f"c.{k}") == F.col(f"r.{k}"))
        values = [F.col(f"r.{a}").alias(f"{a}_{tag}") for a in attributes]
        return counts.hint("merge").join(rows.alias("r"), same, "left").select(*[F.col(f"c.{k}") for k in keys], f"n_{tag}", *values)

    joined = side(old, "old").hint("merge").join(side(new, "new"), list(keys), "full")
    counts = [F.coalesce(n, F.lit(0)).cast("long").alias(n) for n in ("n_old", "n_new")]
    known = joined.select(*keys, *counts, *[f"{a}_{tag}" for a in attributes for tag in ("old", "new")])
    n_old, n_new = F.col("n_old"), F.col("n_new")
    known = known.withColumn("status", F.when(n_old == 0, "added").when(n_new == 0, "lost").otherwise("both"))
    return known.unionByName(snapshot_diff(old.where(null), new.where(null), keys, attributes))


def keys_with_status(old: DataFrame, new: DataFrame, status: str, keys: Sequence[str] = tuple(TIME_KEY)) -> DataFrame:
    return stored_status(old, new, keys).where(F.col("status") == status).select(*keys)
