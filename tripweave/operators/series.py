"""Monthly series: filter, pivot, share, smooth, clamp and growth.

A series has one row per month; windows over it are as long as the calendar, whatever the number of rides.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tripweave.functions import codes, temporal

# No genders are published from this month on, and no unknown bike types.
GENDER_CUTOFFS = {g: "2021-02" for g in ("Unknown", "Women", "Men")}
RIDEABLE_CUTOFFS = {"Unknown": "2021-02"}

# Fixed value: the first month there is.
FIRST_MONTH = "2013-06"


def dashboard_rows(display_cube: DataFrame) -> DataFrame:
    """Display cube with a ``YYYY-MM`` month, minutes instead of seconds, and text labels."""
    return display_cube.select(
        temporal.month_label("year", "month").alias("m"),
        "region",
        "user_type",
        codes.lookup(F.col("gender"), codes.GENDER_DISPLAY).alias("gender"),
        codes.lookup(F.col("rideable_type"), codes.RIDEABLE_DISPLAY).alias("rideable_type"),
        F.col("count").alias("rides"),
        (F.col("duration") / 60).alias("ride_minutes"),
    )


def facet_filter(df: DataFrame, facets: Mapping[str, Sequence]) -> DataFrame:
    """Rows whose every facet column has one of the chosen values."""
    keep = F.lit(True)
    for c, values in facets.items():
        keep = keep & F.coalesce(F.col(c).isin(list(values)), F.lit(False))
    return df.where(keep)


def monthly_sum(df: DataFrame, value: str, stack: str | None = None) -> DataFrame:
    """Sum of ``value`` per month, and per stack value if given."""
    keys = ["m"] if stack is None else ["m", stack]
    return df.groupBy(*keys).agg(F.sum(value).alias(value))


def monthly_pivot(df: DataFrame, value: str, stack: str, values: Sequence[str] | None = None) -> DataFrame:
    """One row per month, one column per stack value in chart order; null where a month has none.

    The value list is part of the plan, so no extra job looks for it.
    """
    return df.groupBy("m").pivot(stack, list(values or codes.STACK_ORDER[stack])).agg(F.sum(value))


def row_shares(wide: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Each column as a share of its row's total."""
    total = sum((F.coalesce(F.col(c), F.lit(0)) for c in columns), F.lit(0))
    return wide.withColumns({c: F.col(c) / total for c in columns})


def share_of_total(df: DataFrame, group: str, value: str, name: str = "share") -> DataFrame:
    """``value`` as a share of its group's total, one row per input row; the input is an aggregate."""
    return df.withColumn(name, F.col(value) / F.sum(value).over(Window.partitionBy(group)))


def rolling_mean(
    wide: DataFrame,
    columns: Sequence[str],
    n: int = 12,
    mode: str = "lagged",
    month: str = "m",
    partition: Sequence[str] = (),
) -> DataFrame:
    """Mean over the last ``n`` rows, per column.

    ``lagged`` (the dashboard's): the sum of the known values among the last n rows over n, given from row
    n + 1 on and only where the row that just left the window is known. ``full`` (the published chart's):
    given from row n on, where all n values are known.
    """
    if mode not in ("lagged", "full"):
        raise ValueError(f"mode must be 'lagged' or 'full', not {mode!r}")
    order = Window.partitionBy(*partition).orderBy(month)
    frame = order.rowsBetween(1 - n, Window.currentRow)

    def mean(c: str) -> Column:
        defined = F.lag(c, n).over(order).isNotNull() if mode == "lagged" else F.count(c).over(frame) == n
        return F.when(defined, F.coalesce(F.sum(c).over(frame), F.lit(0)) / n)

    return wide.select(*partition, month, *[mean(c).alias(c) for c in columns])


def clamp_months(df: DataFrame, start=None, end=None, month: str = "m") -> DataFrame:
    """Months from ``start`` (included) to ``end`` (excluded); give either, both or none.

    Bounds may be text or columns. Applied after a rolling mean it leaves the look-back rows to the window.
    """
    for bound, keep in ((start, lambda c, b: c >= b), (end, lambda c, b: c < b)):
        if bound is not None:
            df = df.where(keep(F.col(month), bound))
    return df


def date_bounds(df: DataFrame, years: int | None = None, month: str = "m") -> tuple[Column, Column]:
    """Half-open month bounds: everything, or the last ``years`` years up to the last month of ``df``.

    The last month is a scalar subquery of the series.
    """
    after = df.agg(F.max(F.add_months(F.to_date(F.concat(F.col(month), F.lit("-01"))), 1)).alias("after")).scalar()
    end = F.date_format(after, "yyyy-MM")
    start = F.lit(FIRST_MONTH) if years is None else F.date_format(F.add_months(after, -12 * years), "yyyy-MM")
    return start, end


def last_years(df: DataFrame, years: int | None, month: str = "m") -> DataFrame:
    """The last ``years`` years of a series; all of it for None."""
    if years is None:
        return df
    start, end = date_bounds(df, years, month)
    return clamp_months(df, start, end, month)


def unpivot_series(wide: DataFrame, columns: Sequence[str], value: str, month: str = "m") -> DataFrame:
    """Back to one row per month and series."""
    return wide.unpivot([month], list(columns), "series", value)


def series_cutoff(long: DataFrame, cutoffs: Mapping[str, str], series: str = "series", month: str = "m") -> DataFrame:
    """Drop a series' months from its cutoff on; series without a cutoff stay whole."""
    cutoff = codes.lookup(F.col(series), cutoffs)
    return long.where(cutoff.isNull() | (F.col(month) < cutoff))


def annualized_growth(df: DataFrame, value: str, month: str = "m", partition: Sequence[str] = ()) -> DataFrame:
    """Growth from 1, 2, ... years before the last month, and over the whole span, as a yearly percentage.

    Months without a value do not count. Positions are taken from the end of the series, so the last value
    comes from the same window and nothing is joined. A single point has no growth and gives no row.
    """
    known = df.where(F.col(value).isNotNull())
    back = Window.partitionBy(*partition).orderBy(F.desc(month))
    whole = Window.partitionBy(*partition)
    placed = known.select(
        *partition,
        F.col(month).alias("first_m"),
        F.col(value).alias("first_v"),
        (F.row_number().over(back) - 1).alias("num_mos"),
        F.first(month).over(back).alias("last_m"),
        F.first(value).over(back).alias("last_v"),
        F.count("*").over(whole).alias("_n"),
    )
    looked = placed.where((F.col("num_mos") > 0) & ((F.col("num_mos") % 12 == 0) | (F.col("num_mos") == F.col("_n") - 1)))
    years = F.col("num_mos") / 12
    ratio = F.try_divide("last_v", "first_v")
    return looked.select(
        *partition,
        "num_mos",
        years.alias("num_yrs"),
        "first_m",
        "first_v",
        "last_m",
        "last_v",
        ratio.alias("ratio"),
        ((F.pow(ratio, 1 / years) - 1) * 100).alias("percent"),
    )
