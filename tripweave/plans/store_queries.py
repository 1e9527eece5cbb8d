"""Stored aggregates, sketches, documents and snapshots that later runs reuse."""

from __future__ import annotations

from pyspark.sql import functions as F

from tripweave.operators import aggregate as agg
from tripweave.operators import checksum
from tripweave.operators import stations as st
from tripweave.plans.prelude import HOUR, MONTH, RIDES_AND_SECONDS, WEEKDAY, YEAR, keyed, with_prelude
from tripweave.plans.registry import query
from tripweave.plans.station_queries import PAIR_TABLES, STATION_TABLES
from tripweave.session import scratch_path
from tripweave.sinks import documents, writers
from tripweave.sinks.aggregate_store import AggregateStore, touched_months
from tripweave.sources import tables
from tripweave.sources.archive_fixture import HEADERS, as_text

_YMRGT = {"region": "start_region", "start_year": YEAR, "start_month": MONTH, "gender": "gender", "user_type": "user_type"}


@query("aggregate_republished", with_prelude(keyed(_YMRGT, RIDES_AND_SECONDS)))
def _(w):
    """An aggregate of a first publication that lacks rides of old end months, then of the second one: only their months are summed again."""
    late = (F.second("start_time") < 20) & F.col("end_ym").between(199503, 199605)
    store = AggregateStore(w.spark, scratch_path(w.spark, "aggregates"))
    label = store.refresh(w.rides.where(~late), "ymrgt", "cd")
    store.refresh(w.rides, "ymrgt", "cd", touched_months(w.rides.where(late)))
    return store.read(label)


@query("aggregate_of_months", with_prelude(keyed({"region": "start_region", "start_hour": HOUR}).replace("WHERE", "WHERE end_ym IN (199601, 199602) AND")))
def _(w):
    """Rides that end in two months, from the stored parts of these months alone."""
    store = AggregateStore(w.spark, scratch_path(w.spark, "aggregates"))
    return store.read(store.refresh(w.rides, "yrh", "c"), "rh", months=[199601, 199602])


@query("aggregate_from_store", with_prelude(keyed({"start_year": YEAR, "start_weekday": WEEKDAY, "start_hour": HOUR}, RIDES_AND_SECONDS)))
def _(w):
    """A key set that is not stored, from the smallest of three stored ones."""
    store = AggregateStore(w.spark, scratch_path(w.spark, "aggregates"))
    for keys, measures in (("ymwhrgtb", "cd"), ("ywhg", "cd"), ("ywh", "c")):
        store.refresh(w.rides, keys, measures)
    return store.aggregate("ywh", "cd")


@query(
    "station_coverage_months",
    with_prelude(
        """SELECT end_year, CAST(count(DISTINCT start_station_id) AS BIGINT) AS start_station_id, CAST(count(DISTINCT end_station_id) AS BIGINT) AS end_station_id
        FROM (SELECT end_ym // 100 AS end_year, * FROM rides WHERE end_ym BETWEEN 199503 AND 199708) GROUP BY 1"""
    ),
)
def _(w):
    """Stations per year of a range of months, from sketches stored per month; the rides are not read again."""
    path = scratch_path(w.spark, "sketches")
    writers.write_table(agg.coverage_sketches(w.rides), path)
    months = tables.read_tables(w.spark, path).where(F.col("end_ym").between(199503, 199708))
    return agg.coverage_of(months.withColumn("end_year", F.floor(F.col("end_ym") / 100).cast("int")), by=["end_year"])


@query(
    "csv_document",
    with_prelude(
        """SELECT strftime(started_at, '%Y-%m-%d %H:%M:%S') AS started_at, strftime(ended_at, '%Y-%m-%d %H:%M:%S') AS ended_at, ride_id,
        start_station_id, start_station_name, end_station_id, end_station_name, rideable_type, member_casual FROM raw"""
    ),
)
def _(w):
    """One gzipped CSV file of all raw rows in time order, in parts that concatenate."""
    rows = as_text(w.raw, {c: c for c in HEADERS if c[-4:] not in ("_lat", "_lng")})
    path = scratch_path(w.spark, "csv-document")
    documents.write_csv_document(rows, path)
    return documents.read_csv_document(w.spark, path, rows.columns)


@query("station_document", with_prelude("SELECT id, name, round(lat, 6) AS lat, round(lng, 6) AS lng, ends FROM stations", **STATION_TABLES))
def _(w):
    """All stations as one JSON object."""
    path = scratch_path(w.spark, "station-document")
    documents.write_station_document(w.stations, path)
    return tables.read_station_json(w.spark, path).withColumns({c: F.round(c, 6) for c in ("lat", "lng")})


@query("pair_document", with_prelude("SELECT * FROM encoded", **PAIR_TABLES))
def _(w):
    """All pair counts as one JSON object."""
    path = scratch_path(w.spark, "pair-document")
    documents.write_pair_document(st.pair_maps(st.encode_pairs(w.pairs, w.index)), path, compression="gzip")
    return tables.read_pair_json(w.spark, path)


_CHANGED = "start_ym BETWEEN 199603 AND 199604 AND bike_id % 7 = 3"
_SIDES = {
    "one": "SELECT start_ym, ride_id, max(bike_id) AS bike_id, max(end_station_id) AS end_station_id FROM rides GROUP BY 1, 2",
    "a": "SELECT * FROM one WHERE ride_id NOT LIKE '%7-1'",
    "b": f"""SELECT * REPLACE (CASE WHEN {_CHANGED} THEN bike_id + 1 ELSE bike_id END AS bike_id,
        CASE WHEN {_CHANGED} AND bike_id % 2 = 0 THEN NULL ELSE end_station_id END AS end_station_id) FROM one WHERE ride_id NOT LIKE '%8-1'""",
}


def _sides(w):
    """Two publications that differ in some rides of two months, and in some rides that only one has; with their stored sums."""
    one, changed = w.rides.groupBy("start_ym", "ride_id").agg(F.max("bike_id").alias("bike_id"), F.max("end_station_id").alias("end_station_id")), F.expr(_CHANGED)
    values = {"bike_id": F.col("bike_id") + changed.cast("int"), "end_station_id": F.when(~(changed & (F.col("bike_id") % 2 == 0)), F.col("end_station_id"))}
    sides = []
    for side in (one.where("ride_id NOT LIKE '%7-1'"), one.where("ride_id NOT LIKE '%8-1'").withColumns(values)):
        path = scratch_path(w.spark, "publication")
        writers.write_table(side, path)
        sides.append(tables.read_tables(w.spark, path))
    sums = []
    for side in sides:
        path = scratch_path(w.spark, "sums")
        writers.write_table(checksum.range_sums(side, ["start_ym"], ["ride_id"], ["bike_id", "end_station_id"]), path)
        sums.append(tables.read_tables(w.spark, path))
    return *sides, tuple(sums)


@query(
    "reconcile_checksums",
    with_prelude(
        """SELECT ride_id, 1::BIGINT AS n_old, 1::BIGINT AS n_new, a.bike_id AS bike_id_old, b.bike_id AS bike_id_new,
        a.end_station_id AS end_station_id_old, b.end_station_id AS end_station_id_new FROM a JOIN b USING (ride_id)
        WHERE a.bike_id IS DISTINCT FROM b.bike_id OR a.end_station_id IS DISTINCT FROM b.end_station_id""",
        **_SIDES,
    ),
)
def _(w):
    """Rides that two publications tell differently; rows meet only in ranges whose stored sums differ."""
    old, new, sums = _sides(w)
    return checksum.mismatches_by_checksum(old, new, ["start_ym"], ["ride_id"], ["bike_id", "end_station_id"], sums=sums)


@query(
    "snapshot_changes",
    with_prelude(
        """SELECT ride_id, CASE WHEN a.ride_id IS NULL THEN 0 ELSE 1 END::BIGINT AS n_old, CASE WHEN b.ride_id IS NULL THEN 0 ELSE 1 END::BIGINT AS n_new,
        a.bike_id AS bike_id_old, b.bike_id AS bike_id_new, CASE WHEN a.ride_id IS NULL THEN 'added' WHEN b.ride_id IS NULL THEN 'lost' ELSE 'both' END AS status
        FROM a FULL JOIN b USING (ride_id) WHERE a.ride_id IS NULL OR b.ride_id IS NULL OR a.bike_id IS DISTINCT FROM b.bike_id""",
        **_SIDES,
    ),
)
def _(w):
    """Rides added, lost or changed."""
    old, new, _ = _sides(w)
    return checksum.diff_by_checksum(old, new, ["start_ym"], ["ride_id"], ["bike_id"])
