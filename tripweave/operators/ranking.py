"""Positions in a sorted column, without sorting in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def dense_index(df: DataFrame, key: str, name: str = "idx", ranges: int = 64) -> DataFrame:
    """0-based position of every distinct non-null ``key`` in ascending order.

    The distinct keys are cut into ``ranges`` intervals at sampled keys (those with the smallest hashes, a
    uniform sample that is the same on every run). Each interval is ranked on its own and shifted by the number
    of keys below it. What meets in one task is a list of ``ranges`` keys and one count per interval.
    """
    keys = df.select(key).where(F.col(key).isNotNull()).distinct()
    sample = keys.orderBy(F.xxhash64(key), key).limit(ranges - 1)
    cuts = sample.agg(F.sort_array(F.collect_list(key)).alias("cuts"))
    cut_keys = keys.withColumn("_cuts", cuts.scalar())
    below_or_at = F.size(F.filter("_cuts", lambda cut: cut <= F.col(key)))
    # Never null, or the join would push a null test of the subquery down to the scan behind ``df``.
    placed = cut_keys.select(key, F.coalesce(below_or_at, F.lit(0)).alias("_range"))
    sizes = placed.groupBy("_range").agg(F.count("*").alias("_n"))
    below = F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sizes.select("_range", F.coalesce(below, F.lit(0)).alias("_below"))
    rank = F.row_number().over(Window.partitionBy("_range").orderBy(key))
    # The offsets are at most ``ranges`` rows.
    ranked = placed.withColumn("_rank", rank).join(F.broadcast(offsets), "_range")
    return ranked.select((F.col("_below") + F.col("_rank") - 1).cast("int").alias(name), key)


def first_per_group(df: DataFrame, group: str, by: str, ties: list[str]) -> DataFrame:
    """The row with the largest ``by`` of each group; equal ones go to the smallest ``ties``.

    A grouped minimum rather than a ranked window: partial results are one row per group and task.
    """
    others = [c for c in df.columns if c not in {group, by, *ties}]
    best = F.min(F.struct((-F.col(by)).alias("_neg"), *ties, *others)).alias("_best")
    return df.groupBy(group).agg(best).select(
        group, *[F.col(f"_best.{c}") for c in [*ties, *others]], (-F.col("_best._neg")).alias(by)
    ).select(*df.columns)
