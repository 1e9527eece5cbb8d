"""Month selection and availability."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# First month of each publisher.
PUBLISHER_START = {"NYC": 201306, "JC": 201509}


def in_month_ranges(ym: Column, ranges: Sequence[tuple[int | None, int | None]]) -> Column:
    """Does ``yyyymm`` fall in any of the half-open ranges; None leaves a side open.

    A plain predicate: on a partition column it prunes files.
    """
    tests = []
    for start, end in ranges:
        test = F.lit(True)
        if start is not None:
            test = test & (ym >= start)
        if end is not None:
            test = test & (ym < end)
        tests.append(test)
    return reduce(lambda a, b: a | b, tests)


def month_calendar(df: DataFrame, time: str = "start_time", by: Sequence[str] = ()) -> DataFrame:
    """Every month from the first to the last one of ``df`` (per ``by``) with its rows, 0 for a gap."""
    month = F.trunc(F.col(time).cast("date"), "month")
    counts = df.groupBy(*by, month.alias("month")).agg(F.count("*").alias("n"))
    span = counts.groupBy(*by).agg(F.min("month").alias("lo"), F.max("month").alias("hi"))
    months = span.select(*by, F.explode(F.expr("sequence(lo, hi, interval 1 month)")).alias("month"))
    zero = months.withColumn("n", F.lit(0).cast("long"))
    # Stacking the calendar under the counts fills gaps without a join.
    filled = counts.unionByName(zero).groupBy(*by, "month").agg(F.sum("n").alias("n"))
    return filled.withColumn("ym", (F.year("month") * 100 + F.month("month")).cast("int")).drop("month")


def expected_publishers(ym: Column, starts: Mapping[str, int] = PUBLISHER_START) -> Column:
    """Publishers that should have a file for a month."""
    return F.array_compact(F.array(*[F.when(ym >= since, F.lit(name)) for name, since in starts.items()]))


def publisher_months(months: DataFrame, starts: Mapping[str, int] = PUBLISHER_START) -> DataFrame:
    """One row per month and publisher that exists by then."""
    return months.select("ym", F.explode(expected_publishers(F.col("ym"), starts)).alias("publisher"))


def _month_number(ym: str) -> Column:
    """Months since year 0 of a ``yyyymm`` column."""
    return F.floor(F.col(ym) / 100) * 12 + F.col(ym) % 100


def latest_complete_month(manifest: DataFrame, starts: Mapping[str, int] = PUBLISHER_START, strict: bool = False) -> DataFrame:
    """Newest month with a file of every expected publisher, and how many newer months are incomplete.

    ``manifest`` has ``ym`` and ``publisher``. One incomplete trailing month is normal; ``strict`` fails the
    query on more.
    """
    found = manifest.groupBy("ym").agg(F.collect_set("publisher").alias("found"))
    missing = F.size(F.array_except(expected_publishers(F.col("ym"), starts), "found"))
    checked = found.select("ym", (missing == 0).alias("complete"))
    summary = checked.agg(
        F.max(F.when(F.col("complete"), F.col("ym"))).alias("latest_ym"),
        F.max("ym").alias("newest_ym"),
    )
    trailing = (_month_number("newest_ym") - _month_number("latest_ym")).cast("int")
    out = summary.withColumn("n_trailing", trailing)
    if strict:
        out = out.where(F.when(F.col("n_trailing") > 1, F.raise_error(F.lit("more than one month lacks a publisher"))).otherwise(F.lit(True)))
    return out
