"""Station profiles and station pairs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tripweave.functions.text import all_known
from tripweave.operators.aggregate import aggregate_rides
from tripweave.operators.ranking import dense_index
from tripweave.schema import Key, select_keys


def _of_station(**columns: str) -> tuple:
    return tuple((n, lambda f=f: F.col(f"_station.{f}")) for n, f in columns.items())


# Letters of a station histogram. Year and month are always those of the ride's start.
META_KEYS = [
    Key("y", "year", (("year", lambda: F.year("start_time")),)),
    Key("m", "month", (("month", lambda: F.month("start_time")),)),
    Key("i", "id", _of_station(id="id")),
    Key("n", "name", _of_station(name="name")),
    Key("l", "lat_lng", _of_station(lat="lat", lng="lng")),
]


def _both_ends(rides: DataFrame) -> DataFrame:
    """Each ride once per end, with the station of that end; a single pass over the rides."""

    def end(prefix: str) -> Column:
        return F.struct(
            F.col(f"{prefix}_station_id").alias("id"),
            F.col(f"{prefix}_station_name").alias("name"),
            F.col(f"{prefix}_lat").alias("lat"),
            F.col(f"{prefix}_lng").alias("lng"),
            F.lit(prefix == "end").alias("is_end"),
        )

    return rides.select("start_time", F.explode(F.array(end("start"), end("end"))).alias("_station"))


def station_meta_hist(rides: DataFrame, keys: str) -> DataFrame:
    """How often stations appear, at either end of a ride, by the given letters; null keys are left out."""
    chosen = [(n, make()) for k in select_keys(keys, META_KEYS) for n, make in k.columns]
    names = [n for n, _ in chosen]
    rows = _both_ends(rides).select(*[c.alias(n) for n, c in chosen]).where(all_known(names))
    return rows.groupBy(*names).agg(F.count("*").alias("count"))


def station_names(hist: DataFrame) -> DataFrame:
    """Most frequent name per station id; on a tie the first in alphabetical order."""
    best = F.min(F.struct((-F.col("count")).alias("neg"), "name"))
    return hist.groupBy("id").agg(best.alias("_best")).select("id", F.col("_best.name").alias("name"))


def station_positions(hist: DataFrame) -> DataFrame:
    """Count-weighted mean position per station id."""
    weight = F.sum("count")
    return hist.groupBy("id").agg(
        (F.sum(F.col("lat") * F.col("count")) / weight).alias("lat"),
        (F.sum(F.col("lng") * F.col("count")) / weight).alias("lng"),
    )


def join_station_profiles(names: DataFrame, positions: DataFrame, ends: DataFrame) -> DataFrame:
    """Names, positions and arrivals side by side; a station missing in one still shows, with 0 arrivals."""
    joined = names.join(positions, "id", "full_outer").join(ends, "id", "full_outer")
    return joined.select("id", "name", "lat", "lng", F.coalesce("ends", F.lit(0)).cast("long").alias("ends"))


def station_table(rides: DataFrame) -> DataFrame:
    """Canonical name, mean position and arrivals of every station, in one pass over the rides.

    Equal to joining ``station_names``, ``station_positions`` and the arrivals, but the rides are read once,
    collapse to one row per (id, name) before the first shuffle, and nothing is joined.
    """
    s = _both_ends(rides).select("_station.*").where(F.col("id").isNotNull())
    placed = F.col("lat").isNotNull() & F.col("lng").isNotNull()
    by_name = s.groupBy("id", "name").agg(
        F.count("*").alias("n"),
        F.count_if(placed).alias("n_placed"),
        F.sum(F.when(placed, F.col("lat"))).alias("lat"),
        F.sum(F.when(placed, F.col("lng"))).alias("lng"),
        F.count_if("is_end").alias("ends"),
    )
    best = F.min(F.when(F.col("name").isNotNull(), F.struct((-F.col("n")).alias("neg"), "name")))
    by_id = by_name.groupBy("id").agg(
        best.alias("_best"),
        F.sum("n_placed").alias("_n"),
        F.sum("lat").alias("_lat"),
        F.sum("lng").alias("_lng"),
        F.sum("ends").alias("ends"),
    )
    profiled = by_id.where(F.col("_best").isNotNull() | (F.col("_n") > 0) | (F.col("ends") > 0))
    return profiled.select(
        "id",
        F.col("_best.name").alias("name"),
        F.try_divide("_lat", "_n").alias("lat"),
        F.try_divide("_lng", "_n").alias("lng"),
        F.col("ends").cast("long").alias("ends"),
    )


def station_index(stations: DataFrame) -> DataFrame:
    """Stations numbered from 0 in id order."""
    return dense_index(stations, "id")


def station_pairs(rides: DataFrame) -> DataFrame:
    """Rides per start and end station."""
    pairs = aggregate_rides(rides, "se", "c")
    return pairs.select(F.col("start_station_id").alias("sid"), F.col("end_station_id").alias("eid"), "count")


def encode_pairs(pairs: DataFrame, index: DataFrame) -> DataFrame:
    """Pair counts with station numbers instead of ids; an id without a number gives null."""
    starts = index.select(F.col("id").alias("sid"), F.col("idx").alias("sidx"))
    ends = index.select(F.col("id").alias("eid"), F.col("idx").alias("eidx"))
    return pairs.join(starts, "sid", "left").join(ends, "eid", "left").select("sidx", "eidx", "count")


def decode_pairs(pairs: DataFrame, index: DataFrame) -> DataFrame:
    """Pair counts with ids instead of station numbers."""
    starts = index.select(F.col("id").alias("sid"), F.col("idx").alias("sidx"))
    ends = index.select(F.col("id").alias("eid"), F.col("idx").alias("eidx"))
    return pairs.join(starts, "sidx", "left").join(ends, "eidx", "left").select("sid", "eid", "count")


def pair_maps(pairs: DataFrame, start: str = "sidx", end: str = "eidx", count: str = "count") -> DataFrame:
    """One map ``end -> count`` per start, entries in end order.

    A map holds one entry per destination, so its size is that of the station table, not of the rides.
    """
    summed = pairs.where(F.col(start).isNotNull() & F.col(end).isNotNull()).groupBy(start, end).agg(F.sum(count).alias(count))
    entries = F.sort_array(F.collect_list(F.struct(F.col(end), F.col(count))))
    return summed.groupBy(start).agg(F.map_from_entries(entries).alias("destinations"))


def explode_pair_maps(maps: DataFrame, start: str = "sidx", end: str = "eidx", count: str = "count") -> DataFrame:
    """Inverse of ``pair_maps``."""
    return maps.select(start, F.explode("destinations").alias(end, count))


def recode_map_keys(maps: DataFrame, index: DataFrame) -> DataFrame:
    """Station numbers in maps and their starts replaced by ids."""
    return pair_maps(decode_pairs(explode_pair_maps(maps), index), "sid", "eid")


def station_destinations(pairs: DataFrame, stations: DataFrame, scale: float = 1.0, origin: str | None = None) -> DataFrame:
    """Destinations of one station (or of each) with both ends' place and a line weight.

    The weight is the count relative to the busiest destination, times the square root of the origin's
    arrivals over ``scale``, and at least 0.7. Stations without a place are skipped, but still count for
    the busiest destination.
    """
    if origin is not None:
        pairs = pairs.where(F.col("sid") == origin)
    busiest = F.max("count").over(Window.partitionBy("sid"))
    ranked = pairs.withColumn("max_count", busiest)
    src = stations.select(F.col("id").alias("sid"), *[F.col(c).alias(f"src_{c}") for c in ("name", "lat", "lng", "ends")])
    dst = stations.select(F.col("id").alias("eid"), *[F.col(c).alias(f"dst_{c}") for c in ("name", "lat", "lng")])
    weight = F.greatest(F.lit(0.7), F.col("count") / F.col("max_count") * F.sqrt("src_ends") / F.lit(float(scale)))
    return ranked.join(src, "sid").join(dst, "eid").withColumn("weight", weight)


def circle_radius(count: Column) -> Column:
    """Marker size of a station."""
    return F.sqrt(count)


def mode_sketch(df: DataFrame, group: str, values: Sequence[str], count: str = "count", threshold: float = 0.5) -> DataFrame:
    """How clearly one value dominates each group.

    Gives the most frequent value, its count, the runner-up's count, the sum of the rest, the total, the ratio
    of first to second, the share of the first and the number of values. ``counts`` is the descending list of
    counts as runs ``(count, times)``: exact, and at most about sqrt(2 * total) entries long however many
    values a group has; ``expand_runs`` spells it out.
    """
    hist = df.groupBy(group, *values).agg(F.sum(count).alias("_count"))
    smallest = F.min(F.struct(*values)).alias("_value")
    levels = hist.groupBy(group, "_count").agg(F.count("*").alias("_times"), smallest)
    runs = F.sort_array(F.collect_list(F.struct(F.col("_count").alias("count"), F.col("_times").alias("times"))), asc=False)
    per_group = levels.groupBy(group).agg(
        F.max_by("_value", "_count").alias("_mode"),
        F.max("_count").alias("mode_count"),
        F.sum(F.col("_count") * F.col("_times")).cast("long").alias("total"),
        F.sum("_times").cast("long").alias("num"),
        runs.alias("counts"),
    )
    tied = F.element_at("counts", 1)["times"] > 1
    second = F.when(tied, F.col("mode_count")).otherwise(F.try_element_at("counts", F.lit(2))["count"])
    sketched = per_group.withColumn("second", second)
    return sketched.select(
        group,
        *[F.col(f"_mode.{v}").alias(v) for v in values],
        "mode_count",
        "second",
        (F.col("total") - F.col("mode_count")).alias("restsum"),
        "total",
        (F.col("mode_count") / F.col("second")).alias("first_second"),
        (F.col("mode_count") / F.col("total")).alias("mode_pct"),
        "num",
        (F.col("mode_count") / F.col("total") < threshold).alias("below_threshold"),
        "counts",
    )


def expand_runs(counts: Column) -> Column:
    """Descending list of counts from the runs of ``mode_sketch``."""
    return F.flatten(F.transform(counts, lambda r: F.array_repeat(r["count"], r["times"].cast("int"))))


def mode_diagnostics(hist: DataFrame, group: str = "id", value: str = "name", count: str = "count") -> DataFrame:
    """Per value: its group's total and number of values, its share, and its ratio to the next smaller count.

    Values with equal counts follow each other in ``value`` order, so their ratio is 1 except for the last one.
    The window runs over the distinct counts of a group, which are few, and is joined back by count.
    """
    levels = hist.groupBy(group, count).agg(F.count("*").alias("_times"), F.max(value).alias("_last"))
    whole = Window.partitionBy(group)
    steps = levels.select(
        F.col(group).alias("_g"),
        F.col(count).alias("_c"),
        "_last",
        F.lead(count).over(whole.orderBy(F.desc(count))).alias("_next"),
        F.sum(F.col(count) * F.col("_times")).over(whole).cast("long").alias("total"),
        F.sum("_times").over(whole).cast("long").alias("n"),
    )
    joined = hist.join(steps, (hist[group] == F.col("_g")) & (hist[count] == F.col("_c")))
    ratio = F.when(F.col(value) == F.col("_last"), F.col(count) / F.col("_next")).otherwise(F.lit(1.0))
    return joined.select(group, value, count, "total", "n", (F.col(count) / F.col("total")).alias("frac"), ratio.alias("ratio"))
