"""Keyed aggregates, cubes, histograms and counts over rides."""

from __future__ import annotations

from collections.abc import Callable, Collection, Sequence
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tripweave.functions import codes, temporal, text
from tripweave.schema import RIDE_KEYS, RIDE_MEASURES, measure_value, select_keys


def aggregate_rides(
    rides: DataFrame,
    keys: str,
    measures: str = "c",
    by: Sequence[str] = (),
    duration_mode: str = "component",
    known_only: bool = True,
) -> DataFrame:
    """Ride counts and seconds for any subset of the group-by letters.

    A ride with a null in any key is left out unless ``known_only`` is off. ``by`` adds plain columns, such as the storage month. Only the
    columns behind the letters are read, and both sums combine before the shuffle.
    """
    unknown = sorted(set(measures) - set(RIDE_MEASURES))
    if unknown or not measures:
        raise ValueError(f"measures must be letters of {sorted(RIDE_MEASURES)}, not {measures!r}")
    key_cols = [(n, make()) for k in select_keys(keys, RIDE_KEYS) for n, make in k.columns]
    names = [n for n, _ in key_cols]
    chosen = {m: n for m, n in RIDE_MEASURES.items() if m in measures}
    values = [measure_value(m, duration_mode).alias(n) for m, n in chosen.items()]
    narrow = rides.select(*by, *[c.alias(n) for n, c in key_cols], *values)
    if known_only:
        narrow = narrow.where(text.all_known(names))
    return narrow.groupBy(*by, *names).agg(*[F.sum(n).alias(n) for n in chosen.values()])


def reaggregate(aggregate: DataFrame, keys: Sequence[str], measures: Sequence[str] = ("count", "duration")) -> DataFrame:
    """Roll a stored aggregate up to fewer keys, or merge aggregates of several months."""
    sums = [F.sum(m).cast("long").alias(m) for m in measures if m in aggregate.columns]
    return aggregate.groupBy(*keys).agg(*sums)


def ride_cube(rides: DataFrame, by_storage_month: bool = False) -> DataFrame:
    """Counts and seconds by year, month, region, gender, user type and bike type.

    With ``by_storage_month`` a ride across a month end stays apart from its key's other rides, as in a cube
    stitched together from tables stored by end month; otherwise keys are unique.
    """
    by = ["end_ym"] if by_storage_month else []
    return aggregate_rides(rides, "ymrgtb", "cd", by=by)


def cube_display(cube: DataFrame) -> DataFrame:
    """Cube with display labels: an unknown user type fails the query."""
    return cube.select(
        F.col("start_year").alias("year"),
        F.col("start_month").alias("month"),
        codes.replace_values(F.col("region"), codes.REGION_DISPLAY).alias("region"),
        codes.strict_lookup(F.col("user_type"), codes.USER_TYPE_DISPLAY, "user type").alias("user_type"),
        "rideable_type",
        "gender",
        "count",
        "duration",
    )


def cube_order() -> list[Column]:
    """Sort order of a display cube, enum columns in domain order."""
    return [
        F.col("year"),
        F.col("month"),
        F.col("region"),
        codes.domain_rank(F.col("user_type"), [codes.USER_TYPE_DISPLAY[u] for u in codes.USER_TYPES]),
        codes.domain_rank(F.col("rideable_type"), codes.RIDEABLE_TYPES),
        F.col("gender"),
    ]


def cube_short(display: DataFrame) -> DataFrame:
    """Display cube with one-letter names, dictionary-coded enums and years since 2000."""
    coded = {}
    for c, values in codes.SHORT_CODES.items():
        coded[c] = codes.strict_lookup(F.col(c), {v: i for i, v in enumerate(values)}, c)
    coded["year"] = F.col("year") - 2000
    return display.select(*[coded.get(c, F.col(c)).alias(codes.SHORT_NAMES[c]) for c in display.columns])


def duration_histogram(rides: DataFrame, width: int, n: int | None = None, duration_mode: str = "component") -> DataFrame:
    """Rides per duration bucket of ``width`` seconds; the first ``n`` buckets if given."""
    seconds = temporal.duration_seconds("start_time", "stop_time", duration_mode)
    bucket = (F.floor(seconds / width) * width).cast("long")
    counted = rides.select(bucket.alias("bucket")).groupBy("bucket").agg(F.count("*").alias("n_rides"))
    return counted if n is None else counted.orderBy("bucket").limit(n)


def histogram_peak(histogram: DataFrame, bucket: str = "bucket", count: str = "n_rides") -> DataFrame:
    """The fullest bucket, the lowest one on a tie, as a one-row frame."""
    return histogram.orderBy(F.desc(count), bucket).limit(1)


def region_matrix(rides: DataFrame, regions: Sequence[str]) -> DataFrame:
    """Rides by start region (rows) and end region (columns)."""
    counts = rides.where(F.col("start_region").isNotNull() & F.col("end_region").isNotNull())
    return counts.groupBy("start_region").pivot("end_region", list(regions)).agg(F.count(F.lit(1)))


def category_percentages(rides: DataFrame, category: Column, values: Sequence[str], by_region: bool = False) -> DataFrame:
    """Per month, rides per category and the category's percentage of the month, to one decimal."""
    keys = {"year": F.year("start_time"), "month": F.month("start_time")}
    if by_region:
        keys["region"] = F.col("start_region")
    rows = rides.select(*[c.alias(n) for n, c in keys.items()], category.alias("_category")).where(text.all_known([*keys, "_category"]))
    wide = rows.groupBy(*keys).pivot("_category", list(values)).agg(F.count(F.lit(1)))
    total = sum((F.coalesce(F.col(v), F.lit(0)) for v in values), F.lit(0))
    return wide.withColumns({f"{v}_pct": F.round(F.col(v) / total * 100, 1) for v in values})


def dockings(rides: DataFrame) -> DataFrame:
    """Two rows per ride, one for each end: station, time parts and whether it is the start. One pass."""

    def side(prefix: str, time: str, is_start: bool) -> Column:
        return F.struct(
            F.col(f"{prefix}_station_id").alias("station_id"),
            F.col(f"{prefix}_station_name").alias("station_name"),
            F.col(f"{prefix}_lat").alias("lat"),
            F.col(f"{prefix}_lng").alias("lng"),
            F.col(time).alias("time"),
            F.lit(is_start).alias("is_start"),
        )

    both = rides.select(F.inline(F.array(side("start", "start_time", True), side("end", "stop_time", False))))
    t = F.col("time")
    return both.withColumns({"day": F.dayofmonth(t), "hour": F.hour(t), "weekday": F.weekday(t)})


def _weekday_set(weekdays: bool | Collection[int] | None) -> list[int]:
    """Monday-based numbers: all (None), weekdays (True), weekends (False) or an explicit set."""
    if weekdays is None:
        return list(range(7))
    if isinstance(weekdays, bool):
        return list(range(5)) if weekdays else [5, 6]
    return sorted(set(weekdays))


def weekday_filter(weekday: Column, weekdays: bool | Collection[int] | None) -> Column:
    """Weekdays (True), weekends (False), an explicit set of Monday-based numbers, or everything (None)."""
    return F.lit(True) if weekdays is None else weekday.isin(_weekday_set(weekdays))


def calendar_days(first: str, last: str, weekdays: bool | Collection[int] | None = None) -> int:
    """Dates from ``first`` to ``last`` (both included) that pass the weekday filter."""
    wanted = _weekday_set(weekdays)
    start, stop = date.fromisoformat(first), date.fromisoformat(last)
    return sum(1 for i in range((stop - start).days + 1) if (start.weekday() + i) % 7 in wanted)


def station_counts(
    rides: DataFrame,
    stations: DataFrame,
    first: str,
    last: str,
    keys: Sequence[str] = (),
    nj: bool | None = None,
    weekdays: bool | Collection[int] | None = None,
    daily_average: bool | None = None,
) -> DataFrame:
    """Dockings from ``first`` to ``last`` per station and ``keys`` with the station name and, unless grouped by date, a daily average.

    The average is over the dates of the period that pass the weekday filter. ``nj`` keeps (True)
    or drops (False) New Jersey stations. Counts are aggregated before the stations are joined.
    """
    dated = bool({"day", "weekday"} & set(keys))
    if daily_average is None:
        daily_average = not dated
    if daily_average and dated:
        raise ValueError("a daily average needs counts that are not grouped by day or weekday")
    until = (date.fromisoformat(last) + timedelta(days=1)).isoformat()
    in_period = (F.col("time") >= F.lit(first).cast("timestamp_ntz")) & (F.col("time") < F.lit(until).cast("timestamp_ntz"))
    events = dockings(rides).where(F.col("station_id").isNotNull() & in_period & weekday_filter(F.col("weekday"), weekdays))
    if nj is not None:
        events = events.where(text.starts_with_pattern(F.col("station_id"), negate=not nj))
    counts = events.groupBy("station_id", *keys).agg(F.count("*").alias("n"))
    named = counts.join(stations.select(F.col("id").alias("station_id"), F.col("name").alias("station_name")), "station_id")
    out = named.select("station_id", "station_name", *keys, "n")
    if daily_average:
        out = out.withColumn("avg", F.col("n") / F.lit(calendar_days(first, last, weekdays)))
    return out


def same_station_share(rides: DataFrame) -> DataFrame:
    """Per start month, the share of rides that end at the station they started from, by name."""
    same = F.col("start_station_name") == F.col("end_station_name")
    return rides.groupBy(temporal.month_label_of("start_time").alias("month")).agg(
        F.count_if(same).alias("same"), F.count("*").alias("total"), (F.count_if(same) / F.count("*")).alias("share")
    )


def station_coverage(rides: DataFrame, approximate: bool = False) -> DataFrame:
    """Distinct start and end stations, one row."""
    count = F.approx_count_distinct if approximate else F.count_distinct
    return rides.agg(count("start_station_id").alias("n_start"), count("end_station_id").alias("n_end"))


def coverage_sketches(rides: DataFrame, by: Sequence[str] = ("end_ym",), columns: Sequence[str] = ("start_station_id", "end_station_id"), lg_k: int = 14) -> DataFrame:
    """Per ``by``, a sketch of each column's distinct values: 2^``lg_k`` registers at most, however many rides there are.

    Sketches of any rows merge, so coverage over any months comes from stored ones. The standard error of an estimate is about
    1.04 / sqrt(2^``lg_k``), 0.8 % by default; up to some thousand values it is much smaller.
    """
    return rides.groupBy(*by).agg(*[F.hll_sketch_agg(c, lg_k).alias(c) for c in columns])


def coverage_of(sketches: DataFrame, by: Sequence[str] = (), columns: Sequence[str] = ("start_station_id", "end_station_id")) -> DataFrame:
    """Distinct values of the columns, estimated from the sketches of the given rows, per ``by`` or in all; a missing sketch is empty."""
    estimates = [F.coalesce(F.hll_sketch_estimate(F.hll_union_agg(c)), F.lit(0)).alias(c) for c in columns]
    return sketches.groupBy(*by).agg(*estimates) if by else sketches.agg(*estimates)


def top_k(df: DataFrame, by: str, k: int, ties: Sequence[str]) -> DataFrame:
    """The ``k`` largest rows; Spark keeps ``k`` per partition and merges those."""
    return df.orderBy(F.desc(by), *ties).limit(k)


def append_new_months(stored: DataFrame, rides: DataFrame, build: Callable[[DataFrame], DataFrame], through: int, measures: Sequence[str] = ("count", "duration")) -> DataFrame:
    """An aggregate of the end months up to ``through`` (and of rides without one), brought up to date with the later end months.

    Rides are stored by end month and aggregated by their start, so a ride across the end of month ``through`` falls into keys
    that the stored part has already: both parts are summed per key. Only later months are read.
    """
    newer = build(rides.where(F.col("end_ym") > through))
    return reaggregate(stored.unionByName(newer), [c for c in stored.columns if c not in measures], measures)
