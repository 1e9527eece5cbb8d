"""Two snapshots compared by checksums first, row by row only where these differ.

The keys of each side are dealt into ranges of a hash within each part (a month, say). Per range both sides add up their rows and two halves of a hash of
each row: sums combine before the shuffle, and do not depend on the order. Ranges with equal sums hold equal rows; of the others the rows are compared.
What is shuffled beyond the sums is the rows of the differing ranges.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripweave.operators.compare import mismatches, snapshot_diff

_RANGE = "_range"
_SUMS = ["_n", "_low", "_high"]


def _dealt(df: DataFrame, part: Sequence[str], keys: Sequence[str], measures: Sequence[str], ranges: int) -> DataFrame:
    columns = list(dict.fromkeys([*part, *keys, *measures]))
    return df.select(*columns, F.pmod(F.xxhash64(*keys), F.lit(ranges)).cast("int").alias(_RANGE))


def range_sums(df: DataFrame, part: Sequence[str], keys: Sequence[str], measures: Sequence[str], ranges: int = 256) -> DataFrame:
    """Per part and hash range of the keys: rows, and the sums of both halves of a hash of keys and measures. Sums of parts of a table add up."""
    # A null changes no Spark hash by itself, so which columns are null is hashed as well.
    nulls = [F.col(c).isNull() for c in (*keys, *measures)]
    h = F.xxhash64(*keys, *measures, *nulls)
    hashed = _dealt(df, part, keys, measures, ranges).withColumn("_h", h)
    sums = [F.count(F.lit(1)).alias("_n"), F.sum(F.col("_h").bitwiseAND(0xFFFFFFFF)).alias("_low"), F.sum(F.shiftrightunsigned("_h", 32)).alias("_high")]
    return hashed.groupBy(*part, _RANGE).agg(*sums)


def differing_ranges(old_sums: DataFrame, new_sums: DataFrame, part: Sequence[str]) -> DataFrame:
    """Parts and ranges whose sums differ, also those that one side lacks."""
    sides = [s.select(*part, _RANGE, F.struct(*_SUMS).alias("_sums"), F.lit(i).alias("_side")) for i, s in enumerate((old_sums, new_sums))]
    both = sides[0].unionByName(sides[1]).groupBy(*part, _RANGE)
    on = [F.max(F.when(F.col("_side") == i, F.col("_sums"))) for i in (0, 1)]
    return both.agg(*[c.alias(f"_s{i}") for i, c in enumerate(on)]).where(~F.col("_s0").eqNullSafe(F.col("_s1"))).select(*part, _RANGE)


def _of_ranges(df: DataFrame, wanted: DataFrame, part: Sequence[str], keys: Sequence[str], measures: Sequence[str], ranges: int) -> DataFrame:
    dealt = _dealt(df, part, keys, measures, ranges)
    renamed = wanted.select(*[F.col(c).alias(f"_w_{c}") for c in (*part, _RANGE)])
    same = F.lit(True)
    for c in (*part, _RANGE):
        same = same & dealt[c].eqNullSafe(renamed[f"_w_{c}"])
    return dealt.join(renamed, same, "left_semi").drop(_RANGE)


def changed_rows(
    old: DataFrame, new: DataFrame, part: Sequence[str], keys: Sequence[str], measures: Sequence[str], ranges: int = 256, sums: tuple[DataFrame, DataFrame] | None = None
) -> tuple[DataFrame, DataFrame]:
    """The rows of both sides, narrowed to keys and measures, that lie in a differing range: few, where little has changed.

    ``sums`` has the ``range_sums`` of both sides if they are stored. Being small files, they make the differing ranges a table that Spark
    sees is small enough to broadcast, so that rows of equal ranges are not even shuffled.
    """
    old_sums, new_sums = sums or (range_sums(old, part, keys, measures, ranges), range_sums(new, part, keys, measures, ranges))
    wanted = differing_ranges(old_sums, new_sums, part)
    return tuple(_of_ranges(side, wanted, part, keys, measures, ranges) for side in (old, new))


def mismatches_by_checksum(old: DataFrame, new: DataFrame, part: Sequence[str], keys: Sequence[str], measures: Sequence[str], ranges: int = 256, sums: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """As ``compare.mismatches``, with whole rows compared only in ranges that differ; a key that both sides repeat alike is no mismatch.

    ``part`` has columns that follow from the keys, such as the month of a start; rows of one key share a part on each side, or they are told apart. Rows that
    differ are overlooked if their hashes add up alike, one in 2^64 ranges by chance.
    """
    old_rows, new_rows = changed_rows(old, new, part, keys, measures, ranges, sums)
    return mismatches(old_rows, new_rows, keys, measures)


def diff_by_checksum(old: DataFrame, new: DataFrame, part: Sequence[str], keys: Sequence[str], attributes: Sequence[str], ranges: int = 256, sums: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """The keys that were added, lost or changed, as ``compare.snapshot_diff`` tells them."""
    diff = snapshot_diff(*changed_rows(old, new, part, keys, attributes, ranges, sums), keys, attributes)
    differs = (F.col("status") != "both") | (F.col("n_old") > 1) | (F.col("n_new") > 1)
    for a in attributes:
        differs = differs | ~F.col(f"{a}_old").eqNullSafe(F.col(f"{a}_new"))
    return diff.where(differs)
