"""Station profiles, pairs and modes."""

from __future__ import annotations

from pyspark.sql import functions as F

from tripweave.functions import temporal
from tripweave.operators import aggregate as agg
from tripweave.operators import compare, ranking
from tripweave.operators import stations as st
from tripweave.plans.aggregate_queries import DOCKINGS_SQL, STATION_NAME_SQL
from tripweave.plans.prelude import keyed, with_prelude
from tripweave.plans.registry import query

ENDS_SQL = """SELECT year(start_time) AS year, month(start_time) AS month, start_station_id AS id, start_station_name AS name,
    start_lat AS lat, start_lng AS lng, false AS is_end FROM rides
  UNION ALL SELECT year(start_time), month(start_time), end_station_id, end_station_name, end_lat, end_lng, true FROM rides"""
HIST_IN_SQL = "SELECT id, name, CAST(count(*) AS BIGINT) AS count FROM ends WHERE id IS NOT NULL AND name IS NOT NULL GROUP BY 1, 2"
HIST_IL_SQL = "SELECT id, lat, lng, CAST(count(*) AS BIGINT) AS count FROM ends WHERE id IS NOT NULL AND lat IS NOT NULL AND lng IS NOT NULL GROUP BY 1, 2, 3"
POSITIONS_SQL = "SELECT id, sum(lat * count) / sum(count) AS lat, sum(lng * count) / sum(count) AS lng FROM il GROUP BY 1"
ARRIVALS_SQL = "SELECT end_station_id AS id, CAST(count(*) AS BIGINT) AS ends FROM rides WHERE end_station_id IS NOT NULL GROUP BY 1"
STATIONS_SQL = """SELECT id, name, lat, lng, CAST(coalesce(ends, 0) AS BIGINT) AS ends
  FROM names FULL JOIN positions USING (id) FULL JOIN arrivals USING (id)"""
STATION_TABLES = {
    "dockings": DOCKINGS_SQL,
    "names": STATION_NAME_SQL,
    "ends": ENDS_SQL,
    "il": HIST_IL_SQL,
    "positions": POSITIONS_SQL,
    "arrivals": ARRIVALS_SQL,
    "stations": STATIONS_SQL,
}
INDEX_SQL = "SELECT CAST(row_number() OVER (ORDER BY id) - 1 AS INT) AS idx, id FROM stations"
PAIRS_SQL = """SELECT start_station_id AS sid, end_station_id AS eid, CAST(count(*) AS BIGINT) AS count FROM rides
  WHERE start_station_id IS NOT NULL AND end_station_id IS NOT NULL GROUP BY 1, 2"""
ENCODED_SQL = """SELECT s.idx AS sidx, e.idx AS eidx, count FROM pairs LEFT JOIN index s ON sid = s.id LEFT JOIN index e ON eid = e.id"""
PAIR_TABLES = {**STATION_TABLES, "index": INDEX_SQL, "pairs": PAIRS_SQL, "encoded": ENCODED_SQL}


def _rounded(df, *columns):
    return df.withColumns({c: F.round(c, 6) for c in columns})


def _indexed(w):
    """Pairs and the station index they refer to."""
    return w.pairs, w.index


@query("station_meta_hist_in", with_prelude(HIST_IN_SQL, ends=ENDS_SQL))
def _(w):
    return st.station_meta_hist(w.rides, "in")


@query("station_meta_hist_il", with_prelude(HIST_IL_SQL, ends=ENDS_SQL))
def _(w):
    return st.station_meta_hist(w.rides, "il")


@query(
    "station_meta_hist_ymin",
    with_prelude(
        """SELECT CAST(year AS INT) AS year, CAST(month AS INT) AS month, id, name, CAST(count(*) AS BIGINT) AS count FROM ends
        WHERE id IS NOT NULL AND name IS NOT NULL GROUP BY ALL""",
        ends=ENDS_SQL,
    ),
)
def _(w):
    return st.station_meta_hist(w.rides, "ymin")


@query(
    "station_meta_hist_inl",
    with_prelude(
        """SELECT id, name, lat, lng, CAST(count(*) AS BIGINT) AS count FROM ends
        WHERE id IS NOT NULL AND name IS NOT NULL AND lat IS NOT NULL AND lng IS NOT NULL GROUP BY ALL""",
        ends=ENDS_SQL,
    ),
)
def _(w):
    return st.station_meta_hist(w.rides, "inl")


@query("station_mode_name", with_prelude("SELECT * FROM names", dockings=DOCKINGS_SQL, names=STATION_NAME_SQL))
def _(w):
    return st.station_names(st.station_meta_hist(w.rides, "in"))


@query(
    "station_mean_latlng",
    with_prelude("SELECT id, round(lat, 6) AS lat, round(lng, 6) AS lng FROM positions", ends=ENDS_SQL, il=HIST_IL_SQL, positions=POSITIONS_SQL),
)
def _(w):
    return _rounded(st.station_positions(st.station_meta_hist(w.rides, "il")), "lat", "lng")


@query("station_modes", with_prelude("SELECT id, name, round(lat, 6) AS lat, round(lng, 6) AS lng, ends FROM stations", **STATION_TABLES))
def _(w):
    return _rounded(st.station_table(w.rides), "lat", "lng")


@query("station_profiles_joined", with_prelude("SELECT id, name, round(lat, 6) AS lat, round(lng, 6) AS lng, ends FROM stations", **STATION_TABLES))
def _(w):
    arrivals = agg.aggregate_rides(w.rides, "e", "c").select(F.col("end_station_id").alias("id"), F.col("count").alias("ends"))
    names = st.station_names(st.station_meta_hist(w.rides, "in"))
    positions = st.station_positions(st.station_meta_hist(w.rides, "il"))
    return _rounded(st.join_station_profiles(names, positions, arrivals), "lat", "lng")


@query("station_pairs", with_prelude(PAIRS_SQL))
def _(w):
    return st.station_pairs(w.rides)


@query("station_index", with_prelude("SELECT * FROM index", **STATION_TABLES, index=INDEX_SQL))
def _(w):
    return st.station_index(w.stations)


@query("station_pairs_idx", with_prelude("SELECT * FROM encoded", **PAIR_TABLES))
def _(w):
    return st.encode_pairs(*_indexed(w))


@query(
    "station_pairs_map",
    with_prelude(
        """SELECT sidx, '{' || string_agg('"' || CAST(eidx AS VARCHAR) || '":' || CAST(count AS VARCHAR), ',' ORDER BY eidx) || '}' AS destinations
        FROM encoded GROUP BY 1""",
        **PAIR_TABLES,
    ),
)
def _(w):
    maps = st.pair_maps(st.encode_pairs(*_indexed(w)))
    return maps.select("sidx", F.to_json("destinations").alias("destinations"))


@query("station_pairs_decoded", with_prelude("SELECT * FROM pairs", pairs=PAIRS_SQL))
def _(w):
    pairs, index = _indexed(w)
    return st.decode_pairs(st.encode_pairs(pairs, index), index)


@query(
    "station_pairs_recoded_map",
    with_prelude(
        """SELECT sid, '{' || string_agg('"' || eid || '":' || CAST(count AS VARCHAR), ',' ORDER BY eid) || '}' AS destinations
        FROM pairs GROUP BY 1""",
        pairs=PAIRS_SQL,
    ),
)
def _(w):
    pairs, index = _indexed(w)
    maps = st.recode_map_keys(st.pair_maps(st.encode_pairs(pairs, index)), index)
    return maps.select("sid", F.to_json("destinations").alias("destinations"))


@query(
    "station_destinations",
    with_prelude(
        """SELECT sid, eid, count, max_count, s.name AS src_name, round(s.lat, 6) AS src_lat, round(s.lng, 6) AS src_lng, s.ends AS src_ends,
          d.name AS dst_name, round(d.lat, 6) AS dst_lat, round(d.lng, 6) AS dst_lng,
          round(greatest(CAST(0.7 AS DOUBLE), count / max_count * sqrt(s.ends) / 20), 6) AS weight
        FROM (SELECT *, max(count) OVER (PARTITION BY sid) AS max_count FROM pairs)
        JOIN stations s ON sid = s.id JOIN stations d ON eid = d.id""",
        **STATION_TABLES,
        pairs=PAIRS_SQL,
    ),
)
def _(w):
    found = st.station_destinations(w.pairs, w.stations, scale=20)
    return _rounded(found, "src_lat", "src_lng", "dst_lat", "dst_lng", "weight")


@query(
    "station_starts_enriched",
    with_prelude(
        """SELECT id, name, round(lat, 6) AS lat, round(lng, 6) AS lng, CAST(count(*) AS BIGINT) AS starts, round(sqrt(count(*)), 6) AS radius
        FROM rides JOIN stations ON start_station_id = id GROUP BY 1, 2, 3, 4""",
        **STATION_TABLES,
    ),
)
def _(w):
    starts = agg.aggregate_rides(w.rides, "s", "c").select(F.col("start_station_id").alias("id"), F.col("count").alias("starts"))
    joined = starts.join(w.stations.drop("ends"), "id")
    return _rounded(joined.withColumn("radius", st.circle_radius(F.col("starts"))), "lat", "lng", "radius").select("id", "name", "lat", "lng", "starts", "radius")


_SKETCH_SQL = """SELECT id, max(CASE WHEN rn = 1 THEN v END) AS v, CAST(max(count) AS BIGINT) AS mode_count, CAST(max(CASE WHEN rn = 2 THEN count END) AS BIGINT) AS second,
    CAST(sum(count) - max(count) AS BIGINT) AS restsum, CAST(sum(count) AS BIGINT) AS total,
    max(count) / max(CASE WHEN rn = 2 THEN count END) AS first_second, max(count) / sum(count) AS mode_pct, CAST(count(*) AS BIGINT) AS num,
    max(count) / sum(count) < 0.5 AS below_threshold, string_agg(CAST(count AS VARCHAR), ' ' ORDER BY rn) AS counts
  FROM (SELECT id, {value} AS v, count, row_number() OVER (PARTITION BY id ORDER BY count DESC, {order}) AS rn FROM hist) GROUP BY id"""


@query(
    "mode_sketch",
    with_prelude("SELECT * RENAME (v AS name) FROM sketch", ends=ENDS_SQL, hist=HIST_IN_SQL, sketch=_SKETCH_SQL.format(value="name", order="name")),
)
def _(w):
    sketch = st.mode_sketch(st.station_meta_hist(w.rides, "in"), "id", ["name"])
    return sketch.withColumn("counts", F.array_join(F.transform(st.expand_runs(F.col("counts")), lambda c: c.cast("string")), " "))


@query(
    "mode_sketch_positions",
    with_prelude(
        "SELECT * EXCLUDE (v), v.lat AS lat, v.lng AS lng FROM sketch",
        ends=ENDS_SQL,
        hist=HIST_IL_SQL,
        sketch=_SKETCH_SQL.format(value="struct_pack(lat := lat, lng := lng)", order="lat, lng"),
    ),
)
def _(w):
    sketch = st.mode_sketch(st.station_meta_hist(w.rides, "il"), "id", ["lat", "lng"])
    return sketch.withColumn("counts", F.array_join(F.transform(st.expand_runs(F.col("counts")), lambda c: c.cast("string")), " "))


@query(
    "mode_diagnostics",
    with_prelude(
        """SELECT id, name, count, CAST(sum(count) OVER p AS BIGINT) AS total, CAST(count(*) OVER p AS BIGINT) AS n,
        count / sum(count) OVER p AS frac, count / lead(count) OVER (PARTITION BY id ORDER BY count DESC, name) AS ratio
        FROM hist WINDOW p AS (PARTITION BY id)""",
        ends=ENDS_SQL,
        hist=HIST_IN_SQL,
    ),
)
def _(w):
    return st.mode_diagnostics(st.station_meta_hist(w.rides, "in"))


@query(
    "first_per_group",
    with_prelude(
        """SELECT sid, eid, count FROM (SELECT *, row_number() OVER (PARTITION BY sid ORDER BY count DESC, eid) AS rn FROM pairs) WHERE rn = 1""",
        pairs=PAIRS_SQL,
    ),
)
def _(w):
    return ranking.first_per_group(w.pairs, "sid", "count", ["eid"])


# Station lists of all months, next to those of the month before: old keys are moved one month ahead.
_NEW_IDS = "SELECT CAST(date_trunc('month', start_time) AS DATE) AS month, start_station_id AS id FROM rides WHERE start_station_id IS NOT NULL"
_OLD_IDS = "SELECT CAST(date_trunc('month', start_time) + INTERVAL 1 MONTH AS DATE) AS month, start_station_id AS id FROM rides WHERE start_station_id IS NOT NULL"


def _month_lists(w):
    month = F.trunc(F.col("start_time").cast("date"), "month")
    new = w.rides.where(F.col("start_station_id").isNotNull()).select(month.alias("month"), F.col("start_station_id").alias("id"))
    return new.withColumn("month", F.add_months("month", 1)), new


@query("station_added", with_prelude(f"{_NEW_IDS} EXCEPT {_OLD_IDS}"))
def _(w):
    return compare.added_keys(*_month_lists(w), ["month", "id"])


@query("station_lost", with_prelude(f"{_OLD_IDS} EXCEPT {_NEW_IDS}"))
def _(w):
    return compare.lost_keys(*_month_lists(w), ["month", "id"])


@query("station_kept", with_prelude(f"{_OLD_IDS} INTERSECT {_NEW_IDS}"))
def _(w):
    return compare.common_keys(*_month_lists(w), ["month", "id"])


@query(
    "pair_day_added",
    with_prelude(
        """SELECT start_station_id, end_station_id, day FROM k WHERE file = 'O' EXCEPT SELECT start_station_id, end_station_id, day FROM k WHERE file = 'F'""",
        k="SELECT start_station_id, end_station_id, strftime(start_time, '%Y-%m-%d') AS day, file FROM rides",
    ),
)
def _(w):
    k = w.rides.select("start_station_id", "end_station_id", F.col("start_time").cast("date").cast("string").alias("day"), "file")
    keys = ["start_station_id", "end_station_id", "day"]
    return compare.added_keys(k.where("file = 'F'"), k.where("file = 'O'"), keys)


@query(
    "reconcile_mismatch",
    with_prelude(
        """SELECT id, 1::BIGINT AS n_old, 1::BIGINT AS n_new, a.count AS count_old, b.count AS count_new
        FROM a JOIN b USING (id) WHERE a.count IS DISTINCT FROM b.count""",
        a=keyed({"id": "start_station_id"}),
        b=keyed({"id": "end_station_id"}),
    ),
)
def _(w):
    starts = agg.aggregate_rides(w.rides, "s", "c").withColumnRenamed("start_station_id", "id")
    ends = agg.aggregate_rides(w.rides, "e", "c").withColumnRenamed("end_station_id", "id")
    return compare.mismatches(starts, ends, ["id"], ["count"])


@query(
    "reconcile_aggregates",
    with_prelude(
        """SELECT id, 1::BIGINT AS n_old, 1::BIGINT AS n_new, a.count AS count_old, b.count AS count_new
        FROM a JOIN b USING (id) WHERE a.count IS DISTINCT FROM b.count""",
        a=keyed({"id": "start_station_id"}),
        b="SELECT start_station_id AS id, CAST(count(*) AS BIGINT) AS count FROM rides WHERE start_station_id IS NOT NULL AND start_region IS NOT NULL AND end_ym <> 199801 GROUP BY 1",
    ),
)
def _(w):
    """Aggregates by two ways, one of which has lost a month: the stations where that shows."""
    plain = agg.aggregate_rides(w.rides, "s", "c").withColumnRenamed("start_station_id", "id")
    most = w.rides.where(F.col("end_ym") != 199801)
    by_region = agg.reaggregate(agg.aggregate_rides(most, "rs", "c"), ["start_station_id"]).withColumnRenamed("start_station_id", "id")
    return compare.mismatches(plain, by_region, ["id"], ["count"])


@query(
    "station_first_month",
    with_prelude("SELECT start_station_id AS id, min(strftime(start_time, '%Y-%m')) AS first_month FROM rides WHERE start_station_id IS NOT NULL GROUP BY 1"),
)
def _(w):
    months = w.rides.select(F.col("start_station_id").alias("id"), temporal.month_label_of("start_time").alias("m")).dropna()
    return months.groupBy("id").agg(F.min("m").alias("first_month"))
