"""Several publications of the same months -> one table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tripweave.functions import codes
from tripweave.operators.quality import assert_unique, drop_duplicate_rows, repeated_keys, rows_by_filter
from tripweave.schema import BACKFILL_COLUMNS, RIDE_COLUMNS, SLICE_COLUMNS, TIME_KEY

# Fixed value: a slice whose one row repeats a ride of the next month with a misspelt station name.
KNOWN_BAD_SLICES = [(201306, 201307, 201307)]
# End months whose attributes an older snapshot still has.
BACKFILL_MONTHS = (202001, 202101)


def exclude_slices(df: DataFrame, bad: Sequence[tuple] = tuple(KNOWN_BAD_SLICES), columns: Sequence[str] = tuple(SLICE_COLUMNS)) -> DataFrame:
    """Drop known-bad slices.

    The list is a handful of partition keys, so it becomes a filter on partition columns and prunes files.
    """
    keep = F.lit(True)
    for values in bad:
        hit = F.lit(True)
        for c, v in zip(columns, values, strict=True):
            hit = hit & F.col(c).eqNullSafe(F.lit(v))
        keep = keep & ~hit
    return df.where(keep)


def _has_info(value, columns: Sequence[str]) -> Column:
    """Does any backfill column say something; gender 0 says nothing."""
    info = F.lit(False)
    for c in columns:
        known = value(c).isNotNull()
        if c == "gender":
            known = known & (value(c) != 0)
        info = info | known
    return info


def merge_duplicates(
    df: DataFrame,
    order: str = "file",
    columns: Sequence[str] = tuple(BACKFILL_COLUMNS),
    keys: Sequence[str] = tuple(TIME_KEY),
    strict: bool = False,
    hot: int = 100_000,
    repeated: DataFrame | None = None,
) -> DataFrame:
    """Pairs of rows with one key become the row of the last file, with the backfill columns of the last row that has any.

    All ``columns`` come from one row. Keys with more than two rows are no pair: ``strict`` fails the query on them, otherwise
    their rows stay, exact copies in several files once; ``merge_violations`` lists them. A row without a key stays as it is.

    The keys are counted first, and only rows whose key may occur again (``rows_by_filter``) are moved. They meet by key in one shuffle, in which each is
    compared with its neighbours. ``repeated`` has the counts (``repeated_keys``) if they are stored. Keys with more than ``hot`` rows, told by a count of the
    keys alone, stay out of it, as no task should get them: they are no pairs, so their copies are combined before a shuffle of their own. There are
    at most rows / ``hot`` such keys, which are broadcast. Rows without a key, which may be many alike, are not shuffled either.
    """
    has_key = F.lit(True)
    for k in keys:
        has_key = has_key & F.col(k).isNotNull()
    rest = [c for c in df.columns if c not in keys and c != order]
    keyed, many = df.where(has_key), F.raise_error(F.lit("more than two rides share start and stop"))
    found = repeated_keys(keyed, keys) if repeated is None else repeated
    heavy = F.broadcast(found.where(F.col("dupes") > hot).select(*keys))
    apart, others = rows_by_filter(df, found, keys)
    crowded = keyed.join(heavy, list(keys), "left_semi")
    if strict:
        crowded = crowded.where(many)
    copies = crowded.groupBy(*[c for c in df.columns if c != order]).agg(F.array_max(F.collect_set(order)).alias(order))
    group = Window.partitionBy(*keys)
    # Copies lie next to each other, that of the last file first.
    sorted_group = group.orderBy(*[F.desc(c) for c in rest], F.desc(order))
    every = group.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    n, content = F.col("_n"), F.struct(*rest)
    donor = F.when(_has_info(F.col, columns), F.struct(order, *columns))
    marked = others.join(heavy, list(keys), "left_anti").withColumns(
        {
            "_n": F.count("*").over(every),
            "_copy": F.coalesce(F.lag(content).over(sorted_group).eqNullSafe(content), F.lit(False)) & (F.row_number().over(sorted_group) > 1),
            "_last": F.max(F.struct(order, *rest)).over(every),
            "_donor": F.max(donor).over(every),
        }
    )
    if strict:
        marked = marked.where(F.when(n > 2, many).otherwise(F.lit(True)))
    is_last = F.struct(order, *rest).eqNullSafe(F.col("_last"))
    kept = marked.where((n == 1) | (~F.col("_copy") & ((n > 2) | is_last)))
    uses_donor = (n == 2) & ~_has_info(F.col, columns) & F.col("_donor").isNotNull()
    merged = [F.when(uses_donor, F.col(f"_donor.{c}")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in df.columns]
    return kept.select(*merged).unionByName(copies.select(*df.columns)).unionByName(apart)


def merge_violations(df: DataFrame, keys: Sequence[str] = tuple(TIME_KEY)) -> DataFrame:
    """Keys with more rows than a pair."""
    return df.groupBy(*keys).agg(F.count("*").alias("n_rows")).where(F.col("n_rows") > 2)


def duplicate_provenance(df: DataFrame, order: str = "file", keys: Sequence[str] = tuple(TIME_KEY)) -> DataFrame:
    """Which files duplicates come from: ``fileA:1 fileB:1`` and the number of keys with that origin.

    The collected list holds one entry per file of a key, not per row.
    """
    stem = F.regexp_replace(F.col(order), r"\.[^.]*$", "")
    per_file = df.groupBy(*keys, stem.alias("_file")).agg(F.count("*").alias("_n"))
    entry = F.struct("_file", F.concat_ws(":", "_file", F.col("_n").cast("string")).alias("text"))
    per_key = per_file.groupBy(*keys).agg(F.sum("_n").alias("_rows"), F.sort_array(F.collect_list(entry)).alias("_entries"))
    text = F.array_join(F.transform("_entries", lambda e: e["text"]), " ")
    return per_key.where(F.col("_rows") > 1).groupBy(text.alias("files")).agg(F.count("*").alias("n_keys"))


def _old_values(old: DataFrame, columns: Sequence[str], keys: Sequence[str], strict: bool) -> DataFrame:
    """The older snapshot with one row per key and comparable types."""
    types = dict(old.dtypes)
    typed = {}
    for c in columns:
        value = F.col(c)
        if c == "gender" and types[c] == "string":
            value = codes.gender_code(value)
        elif c == "bike_id" and types[c] in ("string", "double", "float"):
            value = codes.whole_number(value)
        typed[c] = value.cast("int")
    narrow = old.select(*keys, *[v.alias(c) for c, v in typed.items()])
    unique = narrow.groupBy(*keys).agg(*[F.max(c).alias(f"_old_{c}") for c in columns], F.count("*").alias("_n"))
    if strict:
        unique = unique.where(F.when(F.col("_n") > 1, F.raise_error(F.lit("the older snapshot repeats a start and stop"))).otherwise(F.lit(True)))
    return unique.drop("_n")


def backfill(
    new: DataFrame,
    old: DataFrame,
    columns: Sequence[str] = tuple(BACKFILL_COLUMNS),
    keys: Sequence[str] = tuple(TIME_KEY),
    keep_before: bool = False,
    strict: bool = True,
) -> DataFrame:
    """Fill attributes that ``new`` lost from the ride of ``old`` with the same start and stop.

    A null takes the old value; gender 0 counts as null and stays 0 without a match. The old side has one row per key
    (``strict`` fails if it repeats one, otherwise the largest values count), so no row multiplies.
    """
    joined = new.join(_old_values(old, columns, keys, strict), list(keys), "left")
    filled = {}
    for c in columns:
        before, value = F.col(c), F.col(f"_old_{c}")
        if c == "gender":
            filled[c] = F.when(F.coalesce(before, F.lit(0)) == 0, F.coalesce(value, F.lit(0))).otherwise(before)
        else:
            filled[c] = F.coalesce(before, value)
    extra = [F.col(c).alias(f"{c}_before") for c in columns] if keep_before else []
    return joined.select(*[filled[c].alias(c) if c in filled else F.col(c) for c in new.columns], *extra)


def backfill_statistics(filled: DataFrame, columns: Sequence[str] = tuple(BACKFILL_COLUMNS)) -> DataFrame:
    """Per column: missing before and after, filled, and the filled share; input has ``<column>_before``."""

    def missing(name: str, c: str) -> Column:
        value = F.col(name)
        return F.coalesce(value, F.lit(0)) == 0 if c == "gender" else value.isNull()

    sums = []
    for c in columns:
        sums += [F.count_if(missing(f"{c}_before", c)).alias(f"b_{c}"), F.count_if(missing(c, c)).alias(f"a_{c}")]
    one = filled.agg(*sums)
    counts = [(F.col(f"b_{c}").alias("missing_before"), F.col(f"a_{c}").alias("missing_after")) for c in columns]
    rows = [F.struct(F.lit(c).alias("column"), before, after) for c, (before, after) in zip(columns, counts, strict=True)]
    flat = one.select(F.inline(F.array(*rows)))
    n_filled = F.col("missing_before") - F.col("missing_after")
    ratio = F.when(F.col("missing_before") > 0, n_filled / F.col("missing_before")).otherwise(F.lit(0.0))
    return flat.withColumns({"filled": n_filled, "ratio": ratio})


def consolidate(
    slices: DataFrame,
    older: DataFrame | None = None,
    file: str = "file",
    months: tuple[int, int] = BACKFILL_MONTHS,
    strict: bool = False,
    check_unique: bool = False,
) -> DataFrame:
    """Normalised slices of all source months -> one table of rides, partitionable by end month.

    Months in ``months`` are merged per start and stop and backfilled from ``older``; all others, and rides without an
    end month, only lose exact copies. Provenance does not take part in the dedupe, so copies published in two files are one ride.
    ``strict`` fails on more than two rides with one start and stop, else they all stay. ``check_unique`` fails, by an action of
    its own, if a ride key (start, stop, ride or bike id) repeats in the result.
    """
    wanted = [*RIDE_COLUMNS, "start_ym", "end_ym"]
    rows = exclude_slices(slices) if "src_ym" in slices.columns else slices
    if older is None:
        out = drop_duplicate_rows(rows.select(*wanted))
    else:
        in_range = F.coalesce(F.col("end_ym").between(*months), F.lit(False))
        merged = merge_duplicates(rows.where(in_range).select(*wanted, file), order=file, strict=strict)
        old_rows = older.where(in_range) if "end_ym" in older.columns else older
        # The months of the two parts differ, so each loses its copies on its own.
        repaired = drop_duplicate_rows(backfill(merged, old_rows).select(*wanted))
        out = drop_duplicate_rows(rows.where(~in_range).select(*wanted)).unionByName(repaired)
    if check_unique:
        assert_unique(out, what="consolidated rides")
    return out
