"""Duplicates, key checks and profiles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tripweave.functions import regions
from tripweave.operators.compare import tagged_union
from tripweave.schema import RIDE_COLUMNS, TIME_KEY


#: Up to so many hashes are sent to all tasks; a table with more of them is joined by a shuffle.
BROADCAST_HASHES = 1_000_000

#: Words of 64 bits that tell rows of a key of their own from others; a power of two. 25 million keys fill half of the bits.
FILTER_WORDS = 1 << 19

_HASH = "_row_hash"


def _hashed(df: DataFrame) -> DataFrame:
    """Provenance is left out, so that rows that differ in nothing else have one hash as well."""
    return df.withColumn(_HASH, F.xxhash64(*[F.col(f"`{c}`") for c in RIDE_COLUMNS]))


def repeated_hashes(rides: DataFrame) -> DataFrame:
    """Hashes of the ride columns that more than one row has: equal rows have the same, and some others may by chance.

    Only hashes are counted and shuffled, not rows. Store the result, so that its size is known, and hand it to ``rows_apart``.
    """
    return _hashed(rides).groupBy(_HASH).agg(F.count("*").alias("_n")).where(F.col("_n") > 1).select(_HASH)


def rows_apart(rides: DataFrame, repeated: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows that equal no other row for sure, and those that may have copies; ``repeated`` holds the ``repeated_hashes`` of all rows."""
    hashed = _hashed(rides)
    return tuple(hashed.join(repeated, _HASH, how).select(*rides.columns) for how in ("left_anti", "left_semi"))


def sent_if_few(stored: DataFrame, most: int = BROADCAST_HASHES) -> DataFrame:
    """Action: a stored table, broadcast in joins if it has few rows; of a stored table only the footers are read for that."""
    return F.broadcast(stored) if stored.count() <= most else stored


def drop_duplicate_rows(df: DataFrame, provenance: Sequence[str] = (), repeated: DataFrame | None = None) -> DataFrame:
    """Distinct rows, nulls being equal; rows that differ in ``provenance`` only are one row with the smallest.

    With ``repeated``, the ``repeated_hashes`` of a ride table, only the rows that may have copies are compared; the others are neither shuffled
    nor held in a task's memory.
    """
    if repeated is not None:
        alone, others = rows_apart(df, repeated)
        return alone.unionByName(drop_duplicate_rows(others, provenance))
    if not provenance:
        return df.dropDuplicates()
    kept = [c for c in df.columns if c not in provenance]
    smallest = F.min(provenance[0]).alias(provenance[0]) if len(provenance) == 1 else F.min(F.struct(*provenance)).alias("_provenance")
    grouped = df.groupBy(*kept).agg(smallest)
    return grouped.select(*df.columns) if len(provenance) == 1 else grouped.select(*kept, "_provenance.*").select(*df.columns)


def ride_key(df: DataFrame) -> list[Column]:
    """Start, stop and the ride id, or the bike id where no ride id was published."""
    identity = [F.col(c).cast("string") for c in ("ride_id", "bike_id") if c in df.columns]
    return [*[F.col(c) for c in TIME_KEY], F.coalesce(*identity).alias("ride_key")]


def key_violations(df: DataFrame, keys: Sequence[Column | str] | None = None) -> DataFrame:
    """Keys that occur more than once, with their row count; the ride key unless ``keys`` is given."""
    counted = df.groupBy(*(keys if keys is not None else ride_key(df))).agg(F.count("*").alias("n_rows"))
    return counted.where(F.col("n_rows") > 1)


def repeated_keys(df: DataFrame, keys: Sequence[str], at_least: int = 2) -> DataFrame:
    """Groups with ``at_least`` rows."""
    return df.groupBy(*keys).agg(F.count("*").alias("dupes")).where(F.col("dupes") >= at_least)


def assert_unique(df: DataFrame, keys: Sequence[Column | str] | None = None, what: str = "rows") -> None:
    """Action: fail with the histogram of group sizes if any key repeats; the message names the 20 smallest sizes and says if there are more."""
    sizes = key_violations(df, keys).groupBy("n_rows").count().orderBy("n_rows").limit(21).collect()
    if sizes:
        text = ", ".join(f"{r['count']} keys with {r['n_rows']} rows" for r in sizes[:20]) + (", and more rows" if len(sizes) > 20 else "")
        raise AssertionError(f"{what}: repeated keys: {text}")


def region_violations(df: DataFrame, id_columns: Sequence[str] = ("start_station_id", "end_station_id")) -> DataFrame:
    """Station ids claimed by no region or by several, with the number of rides ends that use them."""
    ends = df.select(F.explode(F.array(*[F.col(c) for c in id_columns])).alias("station_id"))
    counted = ends.groupBy("station_id").agg(F.count("*").alias("uses"))
    return counted.withColumn("n_regions", regions.region_matches(F.col("station_id"))).where(F.col("n_regions") != 1)


def value_counts(df: DataFrame, *columns: str) -> DataFrame:
    return df.groupBy(*columns).agg(F.count("*").alias("n"))


def frequency_of_frequencies(df: DataFrame, *columns: str) -> DataFrame:
    """How many values of ``columns`` occur once, twice, ..."""
    return value_counts(df, *columns).groupBy("n").agg(F.count("*").alias("n_values"))


def rows_without_copy(df: DataFrame, repeated: DataFrame | None = None) -> DataFrame:
    """Rows that occur exactly once; every copy of the others is left out. ``repeated`` as in ``drop_duplicate_rows``."""
    if repeated is not None:
        alone, others = rows_apart(df, repeated)
        return alone.unionByName(rows_without_copy(others))
    return df.groupBy(*df.columns).agg(F.count("*").alias("_n")).where(F.col("_n") == 1).drop("_n")


def unique_across(old: DataFrame, new: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows of either input that occur once in both together."""
    return rows_without_copy(tagged_union(old, new, columns).select(*columns))


def _place(keys: Sequence[str]) -> tuple[Column, Column]:
    """Word and bit in it that a key sets in a filter."""
    hashed = F.xxhash64(*keys)
    return hashed.bitwiseAND(F.lit(FILTER_WORDS - 1)), F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(hashed, 58).cast("int"))


def rows_by_filter(df: DataFrame, repeated: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """The rows whose key is not in ``repeated`` for sure, without shuffling any, and all others; rows with a null in the key are among the former.

    ``repeated`` has the keys of several rows. However many they are, what is broadcast is at most ``FILTER_WORDS`` words of 64 bits, of which a key sets one;
    a row of another key whose bit is set is among the others too.
    """
    word, bit = _place(keys)
    words = repeated.select(word.alias("_word"), bit.alias("_bit")).groupBy("_word").agg(F.bit_or("_bit").alias("_bits"))
    known = F.lit(True)
    for k in keys:
        known = known & F.col(k).isNotNull()
    found = df.withColumns({"_word": word, "_bit": bit}).join(F.broadcast(words), "_word", "left")
    hit = known & F.coalesce(F.col("_bits").bitwiseAND(F.col("_bit")) != 0, F.lit(False))
    return found.where(~hit).select(*df.columns), found.where(hit).select(*df.columns)


def rows_with_copies(df: DataFrame, keys: Sequence[str], repeated: DataFrame | None = None) -> DataFrame:
    """All rows whose key occurs more than once.

    The repeated keys are found by a two-phase count; the semi join keeps whole rows and lets the adaptive
    skew join split a hot key. ``repeated`` has these keys if they are stored: if they are few (``sent_if_few``), no row is shuffled.
    """
    found = repeated_keys(df, keys) if repeated is None else repeated
    repeated = found.select(*[F.col(k).alias(f"_r_{k}") for k in keys])
    condition = F.lit(True)
    for k in keys:
        condition = condition & df[k].eqNullSafe(F.col(f"_r_{k}"))
    return df.join(repeated, condition, "left_semi")


def missing_flags(df: DataFrame) -> dict[str, Column]:
    """Per column, what counts as missing: null, but 0 or ``U`` for gender and ``unknown`` for the bike type."""
    flags = {c: F.col(c).isNull() for c in df.columns}
    if "gender" in flags:
        flags["gender"] = F.col("gender").cast("string").isin("0", "U")
    if "rideable_type" in flags:
        flags["rideable_type"] = F.col("rideable_type") == "unknown"
    return flags


def null_profile(df: DataFrame, length_row: str = "Length") -> DataFrame:
    """Missing values per column as ``column, n_missing``, and the row count under ``length_row``.

    One pass and one row of partial sums per task; the unpivot works on the single result row.
    """
    sums = [F.count_if(flag).alias(c) for c, flag in missing_flags(df).items()]
    totals = df.agg(*sums, F.count("*").alias(length_row))
    return totals.unpivot([], totals.columns, "column", "n_missing")


def null_profile_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """Profiles of two snapshots by column, without the columns that are complete on both sides.

    A column that one side lacks is missing in all of that side's rows.
    """
    columns = list(dict.fromkeys([*old.columns, *new.columns]))

    def widened(df: DataFrame) -> DataFrame:
        absent = {"gender": F.lit("U"), "rideable_type": F.lit("unknown")}
        return df.select(*[F.col(c) if c in df.columns else absent.get(c, F.lit(None)).alias(c) for c in columns])

    tagged = null_profile(widened(old)).withColumn("side", F.lit("old")).unionByName(
        null_profile(widened(new)).withColumn("side", F.lit("new"))
    )
    both = tagged.groupBy("column").agg(
        F.sum(F.when(F.col("side") == "old", F.col("n_missing"))).alias("missing_old"),
        F.sum(F.when(F.col("side") == "new", F.col("n_missing"))).alias("missing_new"),
    )
    return both.where((F.col("missing_old") != 0) | (F.col("missing_new") != 0))
