"""Two snapshots side by side, without joining them.

Every comparison is one aggregate over the tagged union of both sides: rows are pre-aggregated before the
only shuffle, a key that holds a third of a side costs one partial row per task, and repeated keys never
multiply as they would in an outer join.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_SIDE = "_is_new"


def tagged_union(old: DataFrame, new: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Both sides stacked, narrowed to ``columns`` and marked with their side."""
    before = old.select(*columns, F.lit(False).alias(_SIDE))
    after = new.select(*columns, F.lit(True).alias(_SIDE))
    return before.unionByName(after)


def _on(side: bool, value: Column) -> Column:
    return F.when(F.col(_SIDE) == F.lit(side), value)


def _rows(side: bool) -> Column:
    return F.sum(F.when(F.col(_SIDE) == F.lit(side), 1).otherwise(0)).cast("long")


def count_by_key(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows per key on either side, 0 where the key is absent; null keys are keys too."""
    both = tagged_union(old, new, keys)
    return both.groupBy(*keys).agg(_rows(False).alias("n_old"), _rows(True).alias("n_new"))


def _status(n_old: Column, n_new: Column) -> Column:
    return F.when(n_old == 0, "added").when(n_new == 0, "lost").otherwise("both")


def key_status(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``count_by_key`` with ``added``, ``lost`` or ``both`` per key."""
    return count_by_key(old, new, keys).withColumn("status", _status(F.col("n_old"), F.col("n_new")))


def added_keys(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    return key_status(old, new, keys).where(F.col("status") == "added").select(*keys)


def lost_keys(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    return key_status(old, new, keys).where(F.col("status") == "lost").select(*keys)


def common_keys(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    return key_status(old, new, keys).where(F.col("status") == "both").select(*keys)


def set_statistics(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row: distinct keys added, deleted and kept, with both sides' row counts."""
    status = key_status(old, new, keys)
    return status.agg(
        F.coalesce(F.sum("n_old"), F.lit(0)).cast("long").alias("n_old"),
        F.coalesce(F.sum("n_new"), F.lit(0)).cast("long").alias("n_new"),
        F.count_if(F.col("status") == "added").alias("adds"),
        F.count_if(F.col("status") == "lost").alias("dels"),
        F.count_if(F.col("status") == "both").alias("both"),
    )


def snapshot_diff(old: DataFrame, new: DataFrame, keys: Sequence[str], attributes: Sequence[str]) -> DataFrame:
    """Per key: row counts, status and both sides' attributes as ``<a>_old`` and ``<a>_new``.

    A side that repeats a key has no one value: its attributes are null there, and its row count says why.
    """
    both = tagged_union(old, new, [*keys, *attributes])
    measures = []
    for a in attributes:
        for side, tag in ((False, "old"), (True, "new")):
            measures.append(F.when(_rows(side) == 1, F.max(_on(side, F.col(a)))).alias(f"{a}_{tag}"))
    counted = both.groupBy(*keys).agg(_rows(False).alias("n_old"), _rows(True).alias("n_new"), *measures)
    return counted.withColumn("status", _status(F.col("n_old"), F.col("n_new")))


def mismatches(old: DataFrame, new: DataFrame, keys: Sequence[str], measures: Sequence[str]) -> DataFrame:
    """Keys present on both sides whose measures differ (a null differs from a value), or that a side repeats."""
    diff = snapshot_diff(old, new, keys, measures).where(F.col("status") == "both")
    differs = (F.col("n_old") > 1) | (F.col("n_new") > 1)
    for m in measures:
        differs = differs | ~F.col(f"{m}_old").eqNullSafe(F.col(f"{m}_new"))
    return diff.where(differs).drop("status")


def profile_side_by_side(old: DataFrame, new: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Value counts of ``columns`` on both sides, 0 where a value is absent."""
    return count_by_key(old, new, columns)
