"""Duplicates, profiles, snapshot comparison and backfill."""

from __future__ import annotations

from pyspark.sql import functions as F

from tripweave.operators import aggregate as agg
from tripweave.operators import compare, quality, reconcile
from tripweave.operators.normalize import add_slice_columns
from tripweave.plans.aggregate_queries import CUBE_SQL
from tripweave.plans.prelude import with_prelude
from tripweave.plans.registry import query
from tripweave.schema import BACKFILL_COLUMNS, RIDE_COLUMNS, TIME_KEY
from tripweave.sinks import snapshots

_RIDE = ", ".join(RIDE_COLUMNS)

REPEATED_SQL = """SELECT * FROM rides
    UNION ALL SELECT * REPLACE (ride_id || '-b' AS ride_id) FROM rides WHERE second(start_time) = 7
    UNION ALL SELECT * REPLACE (ride_id || '-c' AS ride_id) FROM rides WHERE second(start_time) = 7"""


def _file(w, name):
    return w.rides.where(F.col("file") == name)


@query("dedupe_rows", with_prelude(f"SELECT {_RIDE}, min(file) AS file FROM normalized GROUP BY ALL"))
def _(w):
    return quality.drop_duplicate_rows(w.normalized, provenance=["file"], repeated=w.repeated)


@query(
    "key_violations",
    with_prelude(
        """SELECT start_time, stop_time, coalesce(ride_id, CAST(bike_id AS VARCHAR)) AS ride_key, CAST(count(*) AS BIGINT) AS n_rows
        FROM rides GROUP BY 1, 2, 3 HAVING count(*) > 1"""
    ),
)
def _(w):
    return w.counted("key-violations", quality.key_violations(w.rides))


@query(
    "key_violation_sizes",
    with_prelude(
        "SELECT n AS n_rows, CAST(count(*) AS BIGINT) AS n_keys FROM k GROUP BY 1",
        repeated=REPEATED_SQL,
        k="SELECT start_time, stop_time, bike_id, CAST(count(*) AS BIGINT) AS n FROM repeated GROUP BY 1, 2, 3 HAVING count(*) > 1",
    ),
)
def _(w):
    repeated = w.counted("bike-violations", quality.key_violations(_repeated(w), ["start_time", "stop_time", "bike_id"]))
    return repeated.groupBy("n_rows").agg(F.count("*").alias("n_keys"))


# The newer file has lost the attributes of casual rides; some rides have no readable stop time.
_LOST = "file = 'O' AND user_type = 'Customer'"
REPUBLISHED_SQL = f"""SELECT * REPLACE (
    CASE WHEN second(start_time) = 11 THEN NULL ELSE stop_time END AS stop_time,
    CASE WHEN second(start_time) = 11 THEN NULL ELSE end_ym END AS end_ym,
    CASE WHEN {_LOST} THEN NULL ELSE birth_year END AS birth_year,
    CASE WHEN {_LOST} THEN 0 ELSE gender END AS gender,
    CASE WHEN {_LOST} THEN NULL ELSE bike_id END AS bike_id) FROM repeated"""
_REST = [c for c in RIDE_COLUMNS if c not in TIME_KEY] + ["start_ym", "end_ym"]
_ORDER = ", ".join(["file DESC"] + [f"{c} DESC NULLS LAST" for c in _REST])
_DONOR_ORDER = ", ".join(["file DESC"] + [f"{c} DESC NULLS LAST" for c in BACKFILL_COLUMNS])
_INFO = "({0}birth_year IS NOT NULL OR coalesce({0}gender, 0) <> 0 OR {0}bike_id IS NOT NULL)"
_FIRST = """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY start_time, stop_time ORDER BY {order}) AS rn
    FROM keyed WHERE n = 2 AND {where}) WHERE rn = 1"""
_ALL = ", ".join([*TIME_KEY, *_REST])
_KEPT = ",\n".join(
    f"CASE WHEN {_INFO.format('l.')} OR d.start_time IS NULL THEN l.{c} ELSE d.{c} END AS {c}" for c in BACKFILL_COLUMNS
)
# A pair becomes one ride; a ride alone, without a key or in a larger group stays, exact copies in a larger group once.
MERGED_TABLES = {
    "repeated": REPEATED_SQL,
    "republished": REPUBLISHED_SQL,
    "keyed": """SELECT *, CASE WHEN start_time IS NULL OR stop_time IS NULL THEN 1 ELSE count(*) OVER (PARTITION BY start_time, stop_time) END AS n
        FROM republished""",
    "last_row": _FIRST.format(order=_ORDER, where="true"),
    "donor": _FIRST.format(order=_DONOR_ORDER, where=_INFO.format("")),
    "merged": f"""SELECT l.* EXCLUDE (rn, n) REPLACE ({_KEPT})
        FROM last_row l LEFT JOIN donor d ON l.start_time = d.start_time AND l.stop_time = d.stop_time
        UNION ALL BY NAME SELECT * EXCLUDE (n) FROM keyed WHERE n = 1
        UNION ALL BY NAME SELECT {_ALL}, max(file) AS file FROM keyed WHERE n > 2 GROUP BY ALL""",
}


def _repeated(w):
    """The rides, those of some seconds three times under different ids."""
    one, three = (F.array(*map(F.lit, s)) for s in (("",), ("", "-b", "-c")))
    copies = F.explode(F.when(F.second("start_time") == 7, three).otherwise(one))
    return w.rides.withColumn("_suffix", copies).withColumn("ride_id", F.concat("ride_id", "_suffix")).drop("_suffix")


def _republished(w):
    lost = (F.col("file") == "O") & (F.col("user_type") == "Customer")
    blank = {"birth_year": F.lit(None), "gender": F.lit(0), "bike_id": F.lit(None)}
    columns = [*RIDE_COLUMNS, "start_ym", "end_ym", "file"]
    lost = F.coalesce(lost, F.lit(False))
    unread = F.coalesce(F.second("start_time") == 11, F.lit(False))
    values = {c: F.when(lost, v).otherwise(F.col(c)).cast("int") for c, v in blank.items()}
    values |= {c: F.when(~unread, F.col(c)) for c in ("stop_time", "end_ym")}
    return _repeated(w).withColumns(values).select(*columns)


@query("merge_dupes", with_prelude("SELECT * FROM merged", **MERGED_TABLES))
def _(w):
    rides = _republished(w)
    return reconcile.merge_duplicates(rides, repeated=w.counted("republished-times", quality.repeated_keys(rides.dropna(subset=TIME_KEY), TIME_KEY)))


@query(
    "merge_violations",
    with_prelude("SELECT start_time, stop_time, CAST(count(*) AS BIGINT) AS n_rows FROM repeated GROUP BY 1, 2 HAVING count(*) > 2", repeated=REPEATED_SQL),
)
def _(w):
    return w.counted("merge-violations", reconcile.merge_violations(_repeated(w)))


@query(
    "dup_provenance",
    with_prelude(
        """SELECT files, CAST(count(*) AS BIGINT) AS n_keys FROM (
          SELECT start_time, stop_time, string_agg(file || ':' || CAST(n AS VARCHAR), ' ' ORDER BY file) AS files, sum(n) AS total
          FROM (SELECT start_time, stop_time, file, count(*) AS n FROM rides GROUP BY 1, 2, 3) GROUP BY 1, 2)
        WHERE total > 1 GROUP BY 1"""
    ),
)
def _(w):
    return reconcile.duplicate_provenance(w.rides)


def _missing(c: str) -> str:
    if c == "gender":
        return "gender = 0"
    return "rideable_type = 'unknown'" if c == "rideable_type" else f"{c} IS NULL"


def profile_sql(where: str = "true") -> str:
    rows = [f"SELECT '{c}' AS \"column\", CAST(count(*) FILTER ({_missing(c)}) AS BIGINT) AS n_missing FROM rides WHERE {where}" for c in RIDE_COLUMNS]
    rows.append(f"SELECT 'Length', CAST(count(*) AS BIGINT) FROM rides WHERE {where}")
    return " UNION ALL ".join(rows)


@query("null_profile", with_prelude(profile_sql()))
def _(w):
    return quality.null_profile(w.rides.select(*RIDE_COLUMNS))


@query(
    "null_profile_diff",
    with_prelude(
        """SELECT "column", a.n_missing AS missing_old, b.n_missing AS missing_new FROM a JOIN b USING ("column")
        WHERE a.n_missing <> 0 OR b.n_missing <> 0""",
        a=profile_sql("file = 'F'"),
        b=profile_sql("file = 'O'"),
    ),
)
def _(w):
    return quality.null_profile_diff(_file(w, "F").select(*RIDE_COLUMNS), _file(w, "O").select(*RIDE_COLUMNS))


_TIMES = {f: f"SELECT start_time, stop_time FROM rides WHERE file = '{f}'" for f in "FO"}


@query(
    "snapshot_adds_dels_both",
    with_prelude(
        """SELECT (SELECT CAST(count(*) AS BIGINT) FROM f) AS n_old, (SELECT CAST(count(*) AS BIGINT) FROM o) AS n_new,
        (SELECT CAST(count(*) AS BIGINT) FROM (SELECT * FROM o EXCEPT SELECT * FROM f)) AS adds,
        (SELECT CAST(count(*) AS BIGINT) FROM (SELECT * FROM f EXCEPT SELECT * FROM o)) AS dels,
        (SELECT CAST(count(*) AS BIGINT) FROM (SELECT * FROM f INTERSECT SELECT * FROM o)) AS both""",
        f=_TIMES["F"],
        o=_TIMES["O"],
    ),
)
def _(w):
    return snapshots.stored_statistics(*stored_files(w))


@query("snapshot_only_old", with_prelude("SELECT * FROM f EXCEPT SELECT * FROM o", f=_TIMES["F"], o=_TIMES["O"]))
def _(w):
    return snapshots.keys_with_status(*stored_files(w), "lost")


@query("snapshot_in_both", with_prelude("SELECT * FROM f INTERSECT SELECT * FROM o", f=_TIMES["F"], o=_TIMES["O"]))
def _(w):
    return compare.common_keys(_file(w, "F"), _file(w, "O"), TIME_KEY)


def stored_files(w):
    """The rides of each file as a snapshot of its own."""
    return tuple(w.snapshot(f"file_{f}", lambda f=f: _file(w, f).select(*TIME_KEY, "bike_id", "start_station_id")) for f in "FO")


@query(
    "snapshot_diff",
    with_prelude(
        """SELECT start_time, stop_time, CAST(count(*) FILTER (file = 'F') AS BIGINT) AS n_old, CAST(count(*) FILTER (file = 'O') AS BIGINT) AS n_new,
        CASE WHEN count(*) FILTER (file = 'F') = 1 THEN any_value(bike_id) FILTER (file = 'F') END AS bike_id_old,
        CASE WHEN count(*) FILTER (file = 'O') = 1 THEN any_value(bike_id) FILTER (file = 'O') END AS bike_id_new,
        CASE WHEN count(*) FILTER (file = 'F') = 1 THEN any_value(start_station_id) FILTER (file = 'F') END AS start_station_id_old,
        CASE WHEN count(*) FILTER (file = 'O') = 1 THEN any_value(start_station_id) FILTER (file = 'O') END AS start_station_id_new,
        CASE WHEN count(*) FILTER (file = 'F') = 0 THEN 'added' WHEN count(*) FILTER (file = 'O') = 0 THEN 'lost' ELSE 'both' END AS status
        FROM rides GROUP BY 1, 2"""
    ),
)
def _(w):
    return snapshots.stored_diff(*stored_files(w), ["bike_id", "start_station_id"])


@query(
    "side_by_side_profile",
    with_prelude(
        """SELECT start_region, end_region, gender, CAST(count(*) FILTER (file = 'F') AS BIGINT) AS n_old,
        CAST(count(*) FILTER (file = 'O') AS BIGINT) AS n_new FROM rides GROUP BY 1, 2, 3"""
    ),
)
def _(w):
    return compare.profile_side_by_side(_file(w, "F"), _file(w, "O"), ["start_region", "end_region", "gender"])


_CUBES = {f.lower(): CUBE_SQL.replace("FROM rides WHERE", f"FROM rides WHERE file = '{f}' AND") for f in "FO"}
_CUBE_COLUMNS = ["region", "start_year", "start_month", "gender", "user_type", "rideable_type", "count"]


@query(
    "unique_across_inputs",
    with_prelude(
        f"""SELECT {", ".join(_CUBE_COLUMNS)} FROM (SELECT {", ".join(_CUBE_COLUMNS)} FROM f UNION ALL SELECT {", ".join(_CUBE_COLUMNS)} FROM o)
        GROUP BY ALL HAVING count(*) = 1""",
        **_CUBES,
    ),
)
def _(w):
    return quality.unique_across(agg.ride_cube(_file(w, "F")), agg.ride_cube(_file(w, "O")), _CUBE_COLUMNS)


@query(
    "duplicated_rows",
    with_prelude("SELECT * EXCLUDE (n) FROM (SELECT *, count(*) OVER (PARTITION BY start_time, stop_time) AS n FROM rides) WHERE n > 1"),
)
def _(w):
    return quality.rows_with_copies(w.rides, TIME_KEY, w.repeated_times)


@query("rows_without_copy", with_prelude(f"SELECT {_RIDE}, file FROM normalized GROUP BY ALL HAVING count(*) = 1"))
def _(w):
    return quality.rows_without_copy(w.normalized, repeated=w.repeated)


@query("distinct_keys", with_prelude("SELECT DISTINCT start_station_id, end_station_id, rideable_type FROM rides"))
def _(w):
    return w.rides.select("start_station_id", "end_station_id", "rideable_type").distinct()


# One row per (start, stop), as both publications have; the newer one lost casual riders' attributes, the older
# one has no electric bikes and writes gender as a letter and the bike as a float.
UNIQUE_SQL = """SELECT start_time, stop_time, max(gender) AS gender, max(birth_year) AS birth_year, max(bike_id) AS bike_id,
    max(user_type) AS user_type, max(rideable_type) AS rideable_type FROM rides GROUP BY 1, 2"""
NEW_SQL = """SELECT start_time, stop_time, user_type, CASE WHEN user_type = 'Customer' THEN NULL ELSE birth_year END AS birth_year,
    CASE WHEN user_type = 'Customer' THEN 0 ELSE gender END AS gender, CASE WHEN user_type = 'Customer' THEN NULL ELSE bike_id END AS bike_id FROM uniq"""
OLD_SQL = "SELECT * FROM uniq WHERE rideable_type IS DISTINCT FROM 'electric_bike'"
FILLED_SQL = """SELECT n.start_time, n.stop_time, n.user_type, coalesce(n.birth_year, o.birth_year) AS birth_year,
    CASE WHEN n.gender = 0 THEN coalesce(o.gender, 0) ELSE n.gender END AS gender, coalesce(n.bike_id, o.bike_id) AS bike_id,
    n.birth_year AS birth_year_before, n.gender AS gender_before, n.bike_id AS bike_id_before
  FROM newer n LEFT JOIN older o ON n.start_time = o.start_time AND n.stop_time = o.stop_time"""
FILL_TABLES = {"uniq": UNIQUE_SQL, "newer": NEW_SQL, "older": OLD_SQL, "filled": FILLED_SQL}


def _publications(w):
    attributes = ["gender", "birth_year", "bike_id", "user_type", "rideable_type"]
    unique = w.rides.groupBy(*TIME_KEY).agg(*[F.max(c).alias(c) for c in attributes])
    casual = F.col("user_type") == "Customer"
    new = unique.select(
        *TIME_KEY,
        "user_type",
        F.when(~casual, F.col("birth_year")).alias("birth_year"),
        F.when(casual, 0).otherwise(F.col("gender")).alias("gender"),
        F.when(~casual, F.col("bike_id")).alias("bike_id"),
    )
    old = unique.where(~F.col("rideable_type").eqNullSafe(F.lit("electric_bike"))).select(
        *TIME_KEY,
        F.element_at(F.array(F.lit("U"), F.lit("M"), F.lit("F")), F.col("gender") + 1).alias("gender"),
        "birth_year",
        F.col("bike_id").cast("double").alias("bike_id"),
    )
    return new, old


def stored_publications(w):
    return tuple(w.snapshot(f"publication_{n}", lambda i=i: _publications(w)[i]) for i, n in enumerate(("new", "old")))


@query("snapshot_backfill", with_prelude("SELECT start_time, stop_time, user_type, birth_year, gender, bike_id FROM filled", **FILL_TABLES))
def _(w):
    return reconcile.backfill(*stored_publications(w))


def _stats_sql(c: str) -> str:
    missing = {"gender": "{} = 0"}.get(c, "{} IS NULL")
    before, after = missing.format(f"{c}_before"), missing.format(c)
    return f"""SELECT '{c}' AS "column", CAST(count(*) FILTER ({before}) AS BIGINT) AS missing_before, CAST(count(*) FILTER ({after}) AS BIGINT) AS missing_after FROM filled"""


@query(
    "backfill_stats",
    with_prelude(
        """SELECT *, missing_before - missing_after AS filled, CASE WHEN missing_before > 0 THEN (missing_before - missing_after) / missing_before ELSE 0 END AS ratio
        FROM stats""",
        **FILL_TABLES,
        stats=" UNION ALL ".join(_stats_sql(c) for c in BACKFILL_COLUMNS),
    ),
)
def _(w):
    return reconcile.backfill_statistics(reconcile.backfill(*stored_publications(w), keep_before=True))


_REPAIRED = {
    "birth_year": "coalesce(m.birth_year, o.birth_year) AS birth_year",
    "gender": "CASE WHEN coalesce(m.gender, 0) = 0 THEN coalesce(o.gender, 0) ELSE m.gender END AS gender",
    "bike_id": "coalesce(m.bike_id, o.bike_id) AS bike_id",
}


@query(
    "consolidate_rides",
    with_prelude(
        f"""SELECT DISTINCT * FROM (
          SELECT {_RIDE}, start_ym, end_ym FROM republished WHERE end_ym IS NULL OR end_ym < 199701 OR end_ym > 199912
          UNION ALL
          SELECT {", ".join(_REPAIRED.get(c, "m." + c) for c in RIDE_COLUMNS)}, m.start_ym, m.end_ym
          FROM merged m LEFT JOIN uniq o ON m.start_time = o.start_time AND m.stop_time = o.stop_time
          WHERE m.end_ym BETWEEN 199701 AND 199912)""",
        **MERGED_TABLES,
        uniq=UNIQUE_SQL,
    ),
)
def _(w):
    older = w.rides.groupBy(*TIME_KEY).agg(*[F.max(c).alias(c) for c in BACKFILL_COLUMNS])
    return reconcile.consolidate(_republished(w), add_slice_columns(older).drop("start_ym"), months=(199701, 199912))
