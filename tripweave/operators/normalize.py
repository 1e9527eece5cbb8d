"""Raw trip files of any header era -> the 18-column ride table."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tripweave.functions import codes, regions, temporal
from tripweave.schema import RIDE_COLUMNS, RIDE_TYPES
from tripweave.sources.headers import harmonize_columns, unexpected_headers

# Fixed value: the other spelling of dates in the published files, month first.
MONTH_FIRST = r"^(\d{1,2})/(\d{1,2})/(\d{4}) "


def parse_time(c: Column, dtype: T.DataType) -> Column:
    """Zone-less timestamp from text of any published spelling, or from a timestamp column; null if it is neither.

    Month-first dates are turned round as text, so no spelling passes through the session time zone.
    """
    if not isinstance(dtype, T.StringType):
        return c.cast("timestamp_ntz")
    iso = F.when(c.contains("/"), F.regexp_replace(c, MONTH_FIRST, "$3-$1-$2 ")).otherwise(c)
    return iso.try_cast("timestamp_ntz")


def normalize(
    df: DataFrame,
    publisher: Column | str | None = None,
    keep: Iterable[str] = (),
    keep_incomplete: bool = False,
) -> DataFrame:
    """Harmonise names, codes and types, classify both stations and drop non-trips.

    Always emits all ride columns, null where the source has none. ``keep`` columns (provenance) ride along;
    a ``publisher`` column has to be one of them.
    One narrow projection and filter: no shuffle, and it fuses into the scan stage.

    ``keep_incomplete`` keeps rides without an end station and books them to their start region.
    """
    keep = list(keep)
    src = harmonize_columns(df, keep)
    types = {f.name: f.dataType for f in src.schema.fields}
    start_id, end_id = F.col("start_station_id"), F.col("end_station_id")
    if keep_incomplete:
        src = src.where(regions.is_trip(start_id, F.coalesce(end_id, start_id)))
    else:
        src = src.where(regions.is_trip(start_id, end_id))

    def present(name: str) -> Column:
        return F.col(name) if name in types else F.lit(None)

    values: dict[str, Column] = {}
    for name, dtype in RIDE_TYPES.items():
        values[name] = present(name).try_cast(dtype.simpleString())
    for name in ("start_time", "stop_time"):
        if name in types:
            values[name] = parse_time(F.col(name), types[name])
    for name in ("start_station_id", "end_station_id"):
        values[name] = codes.station_id(present(name).cast("string"))
    values["rideable_type"] = codes.rideable_type(F.col("rideable_type")) if "rideable_type" in types else F.lit("unknown")
    if "member_casual" in types:
        values["user_type"] = codes.member_casual(F.col("member_casual"))
    else:
        values["user_type"] = codes.closed_domain(values["user_type"], codes.USER_TYPES)
    if "gender" not in types:
        values["gender"] = F.lit(0)
    elif isinstance(types["gender"], T.StringType):
        values["gender"] = codes.gender_code(F.col("gender"))
    for name in ("birth_year", "bike_id"):
        if not isinstance(types.get(name), T.IntegralType):
            values[name] = codes.whole_number(present(name))
    named = src.select(*[v.alias(n) for n, v in values.items() if not n.endswith("_region")], *keep)

    start, end = regions.region_of(start_id, publisher), regions.region_of(end_id, publisher)
    if keep_incomplete:
        end = F.when(end_id.isNull(), start).otherwise(end)
    return named.withColumns({"start_region": start, "end_region": end}).select(*RIDE_COLUMNS, *keep)


def cast_failures(df: DataFrame, keep: Iterable[str] = ()) -> DataFrame:
    """Per ride column, how many source values are there but cannot be read as the column's type (one row each, one pass).

    ``normalize`` makes such values null; texts and codes of closed domains are not counted.
    """
    src = harmonize_columns(df, list(keep))
    types = {f.name: f.dataType for f in src.schema.fields}
    lost = []
    for name, dtype in RIDE_TYPES.items():
        if name not in types or not isinstance(types[name], T.StringType) or isinstance(dtype, T.StringType) or name == "gender":
            continue
        if name in ("start_time", "stop_time"):
            value = parse_time(F.col(name), types[name])
        else:
            value = codes.whole_number(F.col(name)) if name in ("birth_year", "bike_id") else F.col(name).try_cast(dtype.simpleString())
        lost.append(F.count_if(F.col(name).isNotNull() & value.isNull()).alias(name))
    if not lost:
        return df.sparkSession.createDataFrame([], "column string, n_failed long")
    one = src.agg(*lost)
    return one.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("n_failed")) for c in one.columns])))


def domain_failures(df: DataFrame, keep: Iterable[str] = ()) -> DataFrame:
    """Per code column and value outside its domain, how many rows have it: ``column, value, n``.

    ``normalize`` makes such user types and bike types null and keeps such a gender only if it is a number. One pass; what is shuffled is a row per
    odd value and task.
    """
    src = harmonize_columns(df, list(keep))
    known = {"rideable_type": codes.rideable_type, "member_casual": codes.member_casual, "user_type": lambda c: codes.closed_domain(c, codes.USER_TYPES)}
    odd = []
    for name in ("rideable_type", "member_casual", "user_type", "gender"):
        if name not in src.columns or (name == "user_type" and "member_casual" in src.columns):
            continue
        text = F.col(name).cast("string")
        inside = codes.gender_code(text).isin(sorted(codes.GENDER_LETTERS)) if name == "gender" else known[name](F.col(name)).isNotNull()
        odd.append(F.when(text.isNotNull() & ~F.coalesce(inside, F.lit(False)), F.struct(F.lit(name).alias("column"), text.alias("value"))))
    if not odd:
        return df.sparkSession.createDataFrame([], "column string, value string, n long")
    found = src.select(F.explode(F.array_compact(F.array(*odd))).alias("o")).select("o.*")
    return found.groupBy("column", "value").agg(F.count("*").alias("n"))


def unexpected_values(df: DataFrame, keep: Iterable[str] = ()) -> DataFrame:
    """Columns that no header era knows and ``normalize`` therefore leaves out, with the number of values they hold."""
    odd = unexpected_headers([c for c in df.columns if c not in set(keep)])
    if not odd:
        return df.sparkSession.createDataFrame([], "column string, n_values long")
    counts = df.agg(*[F.count(F.col(f"`{c}`")).alias(f"n{i}") for i, c in enumerate(odd)])
    return counts.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"n{i}").alias("n_values")) for i, c in enumerate(odd)])))


def add_slice_columns(rides: DataFrame) -> DataFrame:
    """Start and end month as ints, the partition columns of stored slices."""
    return rides.withColumns(
        {
            "start_ym": temporal.year_month_int("start_time"),
            "end_ym": temporal.year_month_int("stop_time"),
        }
    )


def tag_constant(df: DataFrame, name: str, value) -> DataFrame:
    """Provenance column with one value, such as the source month of a file set."""
    return df.withColumn(name, F.lit(value))
