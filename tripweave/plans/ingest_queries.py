"""Reading, normalising, slicing and bookkeeping; writers are checked by reading back what they wrote."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tripweave.functions import codes, regions, temporal, text
from tripweave.operators import aggregate as agg
from tripweave.operators import quality, reconcile
from tripweave.operators import stations as st
from tripweave.operators.normalize import add_slice_columns, cast_failures, domain_failures, normalize, unexpected_values
from tripweave.plans.aggregate_queries import CUBE_SQL, DISPLAY_SQL
from tripweave.plans.prelude import keyed, region_sql, with_prelude
from tripweave.plans.registry import query
from tripweave.plans.station_queries import INDEX_SQL, PAIR_TABLES, PAIRS_SQL, STATION_TABLES
from tripweave.schema import RIDE_COLUMNS
from tripweave.session import jit_sized_codegen, scratch_path
from tripweave.sinks import writers
from tripweave.sources import archive_source, archives, manifest, months, tables
from tripweave.sources import csv as trip_csv
from tripweave.sources.archive_fixture import HEADERS, as_text, write_monthly_archives, write_yearly_archives

_RIDE = ", ".join(RIDE_COLUMNS)


@query("normalize_rides", with_prelude("SELECT * FROM rides"))
def _(w):
    return add_slice_columns(quality.drop_duplicate_rows(normalize(w.raw, keep=["file"]), repeated=w.repeated))


PUBLISHER = "CASE WHEN file = 'O' THEN 'JC' ELSE 'NYC' END"


@query(
    "normalize_publisher",
    with_prelude(
        f"""SELECT {PUBLISHER} AS publisher, CASE WHEN start_region = 'NYC' AND file = 'O' THEN 'JC' ELSE start_region END AS start_region,
        CASE WHEN end_region = 'NYC' AND file = 'O' THEN 'JC' ELSE end_region END AS end_region, CAST(count(*) AS BIGINT) AS n
        FROM normalized GROUP BY 1, 2, 3"""
    ),
)
def _(w):
    raw = w.raw.withColumn("publisher", F.expr(PUBLISHER))
    rides = normalize(raw, publisher=F.col("publisher"), keep=["publisher"])
    return rides.groupBy("publisher", "start_region", "end_region").agg(F.count("*").alias("n"))


@query(
    "region_classify",
    with_prelude(f"SELECT start_station_id, {region_sql('start_station_id')} AS region, CAST(count(*) AS BIGINT) AS n FROM raw GROUP BY 1, 2"),
)
def _(w):
    counts = w.raw.groupBy("start_station_id").agg(F.count("*").alias("n"))
    return counts.select("start_station_id", regions.region_of(F.col("start_station_id")).alias("region"), "n")


@query(
    "region_violations",
    with_prelude(
        """SELECT station_id, CAST(count(*) AS BIGINT) AS uses, 0 AS n_regions FROM
        (SELECT start_station_id AS station_id FROM raw UNION ALL SELECT end_station_id FROM raw)
        WHERE station_id = 'ZZ-unmapped' GROUP BY 1"""
    ),
)
def _(w):
    return quality.region_violations(w.raw)


@query(
    "id_cleanup",
    with_prelude("SELECT CAST(bikeid AS VARCHAR) AS id, CAST(count(*) AS BIGINT) AS n FROM raw GROUP BY 1"),
)
def _(w):
    floats = w.raw.select(codes.station_id(F.concat(F.col("bikeid").cast("string"), F.lit(".0"))).alias("id"))
    return floats.groupBy("id").agg(F.count("*").alias("n"))


@query(
    "system_rides_dropped",
    with_prelude(
        """SELECT coalesce(start_region, '') NOT IN ('None', 'SYS') AND coalesce(end_region, '') NOT IN ('None', 'SYS') AS is_trip,
        CAST(count(*) AS BIGINT) AS n FROM coded GROUP BY 1"""
    ),
)
def _(w):
    kept = regions.is_trip(F.col("start_station_id"), F.col("end_station_id"))
    return w.raw.groupBy(kept.alias("is_trip")).agg(F.count("*").alias("n"))


@query(
    "keep_incomplete_rides",
    with_prelude(
        """SELECT start_region, CASE WHEN end_station_id IS NULL THEN start_region ELSE end_region END AS end_region, CAST(count(*) AS BIGINT) AS n
        FROM coded WHERE coalesce(start_region, '') NOT IN ('None', 'SYS') AND coalesce(end_region, '') <> 'SYS' GROUP BY 1, 2"""
    ),
)
def _(w):
    return normalize(w.raw, keep_incomplete=True).groupBy("start_region", "end_region").agg(F.count("*").alias("n"))


@query(
    "slice_by_start_end_month",
    with_prelude("SELECT strftime(start_time, '%Y%m') || '_' || strftime(stop_time, '%Y%m') AS slice, CAST(count(*) AS BIGINT) AS n FROM rides GROUP BY 1"),
)
def _(w):
    return w.rides.groupBy(temporal.slice_label("start_time", "stop_time").alias("slice")).agg(F.count("*").alias("n"))


SLICES = {"slices": "SELECT *, CASE WHEN file = 'F' THEN start_ym ELSE end_ym END AS src_ym FROM rides"}


def _sliced(w):
    """Rides with a source month: one file lists rides by start, the other by end."""
    return w.rides.withColumn("src_ym", F.when(F.col("file") == "F", F.col("start_ym")).otherwise(F.col("end_ym")))


@query(
    "end_month_slices",
    with_prelude(
        """SELECT end_ym, CAST(src_ym AS VARCHAR) || '/' || CAST(start_ym AS VARCHAR) || '_' || CAST(end_ym AS VARCHAR) AS file,
        CAST(count(*) AS BIGINT) AS n FROM slices GROUP BY 1, 2""",
        **SLICES,
    ),
)
def _(w):
    return tables.tag_slice(_sliced(w)).groupBy("end_ym", "file").agg(F.count("*").alias("n"))


@query(
    "known_bad_slices",
    with_prelude(
        """SELECT src_ym, start_ym, end_ym, CAST(count(*) AS BIGINT) AS n FROM slices
        WHERE NOT (src_ym = 199508 AND start_ym = 199508 AND end_ym = 199508) AND NOT (src_ym = 199610 AND start_ym = 199609 AND end_ym = 199610)
        GROUP BY 1, 2, 3""",
        **SLICES,
    ),
)
def _(w):
    kept = reconcile.exclude_slices(_sliced(w), [(199508, 199508, 199508), (199610, 199609, 199610)])
    return kept.groupBy("src_ym", "start_ym", "end_ym").agg(F.count("*").alias("n"))


@query(
    "month_ranges",
    with_prelude(
        """SELECT end_ym, CAST(count(*) AS BIGINT) AS n FROM rides
        WHERE end_ym < 199604 OR (end_ym >= 199806 AND end_ym < 199901) OR end_ym >= 200103 GROUP BY 1"""
    ),
)
def _(w):
    chosen = w.rides.where(months.in_month_ranges(F.col("end_ym"), [(None, 199604), (199806, 199901), (200103, None)]))
    return chosen.groupBy("end_ym").agg(F.count("*").alias("n"))


@query(
    "month_calendar",
    with_prelude(
        """SELECT b.start_station_id, CAST(year(m) * 100 + month(m) AS INT) AS ym, CAST(count(r.start_time) AS BIGINT) AS n
        FROM (SELECT start_station_id, unnest(generate_series(date_trunc('month', min(start_time)), date_trunc('month', max(start_time)), INTERVAL 1 MONTH)) AS m
              FROM rides GROUP BY 1) b
        LEFT JOIN rides r ON b.start_station_id IS NOT DISTINCT FROM r.start_station_id AND date_trunc('month', r.start_time) = b.m GROUP BY 1, 2"""
    ),
)
def _(w):
    return months.month_calendar(w.rides, by=["start_station_id"])


@query(
    "publisher_months",
    with_prelude(
        """SELECT DISTINCT start_ym AS ym, 'NYC' AS publisher FROM rides WHERE start_ym >= 199506
        UNION ALL SELECT DISTINCT start_ym, 'JC' FROM rides WHERE start_ym >= 199709"""
    ),
)
def _(w):
    known = w.rides.select(F.col("start_ym").alias("ym")).distinct()
    return months.publisher_months(known, {"NYC": 199506, "JC": 199709})


MANIFEST_SQL = "SELECT DISTINCT start_ym AS ym, start_region AS publisher FROM rides WHERE start_region IN ('NYC', 'JC')"


@query(
    "latest_complete_month",
    with_prelude(
        """SELECT max(ym) FILTER (complete) AS latest_ym, max(ym) AS newest_ym,
        CAST((max(ym) // 100 * 12 + max(ym) % 100) - (max(ym) FILTER (complete) // 100 * 12 + max(ym) FILTER (complete) % 100) AS INT) AS n_trailing
        FROM (SELECT ym, bool_or(publisher = 'NYC') AND (ym < 199709 OR bool_or(publisher = 'JC')) AS complete FROM m GROUP BY 1)""",
        m=MANIFEST_SQL,
    ),
)
def _(w):
    known = w.rides.where(F.col("start_region").isin("NYC", "JC")).select(F.col("start_ym").alias("ym"), F.col("start_region").alias("publisher"))
    return months.latest_complete_month(known, {"NYC": 199501, "JC": 199709})


# A file per month and region; its size stands for the contents. The newer listing counts both snapshots.
_FILES_SQL = """SELECT CAST(start_ym AS VARCHAR) || '-' || start_region AS path, CAST(count(*) AS VARCHAR) AS etag FROM rides
    WHERE start_region IS NOT NULL AND {where} GROUP BY 1"""
_FILES = {
    "old_files": _FILES_SQL.format(where="file = 'F' AND start_ym < 200107"),
    "new_files": _FILES_SQL.format(where="start_ym > 199501"),
}


def _listing(rides):
    path = F.concat_ws("-", F.col("start_ym").cast("string"), "start_region")
    return rides.where(F.col("start_region").isNotNull()).groupBy(path.alias("path")).agg(F.count("*").cast("string").alias("etag"))


def _listings(w):
    old = _listing(w.rides.where((F.col("file") == "F") & (F.col("start_ym") < 200107)))
    return old, _listing(w.rides.where(F.col("start_ym") > 199501))


@query(
    "manifest_diff",
    with_prelude(
        """SELECT path, o.etag AS etag_old, n.etag AS etag_new, CASE WHEN o.etag IS NULL THEN 'new' WHEN n.etag IS NULL THEN 'removed'
        WHEN o.etag = n.etag THEN 'unchanged' ELSE 'changed' END AS status FROM old_files o FULL JOIN new_files n USING (path)""",
        **_FILES,
    ),
)
def _(w):
    return manifest.manifest_diff(*_listings(w))


@query(
    "manifest_to_import",
    with_prelude("SELECT path FROM old_files o RIGHT JOIN new_files n USING (path) WHERE o.etag IS DISTINCT FROM n.etag", **_FILES),
)
def _(w):
    return manifest.to_import(*_listings(w))


@query(
    "include_exclude_paths",
    with_prelude(
        """SELECT path, regexp_extract(path, '^(\\d{4})(\\d{2})', 1) AS y, regexp_extract(path, '^(\\d{4})(\\d{2})', 2) AS m FROM new_files
        WHERE regexp_matches(path, 'JC|^1998') AND path IN (SELECT path FROM new_files WHERE NOT regexp_matches(path, '12-'))""",
        **_FILES,
    ),
)
def _(w):
    path = F.col("path")
    listed = _listings(w)[1].where(text.include_exclude(path, include=["JC", "^1998"])).where(text.include_exclude(path, exclude=["12-"]))
    return listed.select("path", text.path_month(path, "y").alias("y"), text.path_month(path, "m").alias("m"))


# Writers and readers, one through the other.


def _text_csv(w, raw, columns: dict[str, str], name: str) -> str:
    """Raw rows written as CSV text under the given headers."""
    path = scratch_path(w.spark, name)
    with jit_sized_codegen(w.spark):
        as_text(raw, columns).write.option("header", True).option("nullValue", trip_csv.NULL_MARKER).csv(path)
    return path


@query("csv_scan", with_prelude("SELECT * RENAME (file AS snapshot) FROM normalized"))
def _(w):
    """One header era out as CSV and back in: text, null markers, header check, typing."""
    path = _text_csv(w, w.raw, {c: "snapshot" if c == "file" else c for c in w.raw.columns}, "csv")
    return normalize(trip_csv.read_trip_csv(w.spark, path), keep=["snapshot"])


# Headers of the first two eras, by raw column.
FIRST_ERA = {
    "started_at": "starttime",
    "ended_at": "stoptime",
    "start_station_id": "start station id",
    "start_station_name": "start station name",
    "start_lat": "start station latitude",
    "start_lng": "start station longitude",
    "end_station_id": "end station id",
    "end_station_name": "end station name",
    "end_lat": "end station latitude",
    "end_lng": "end station longitude",
    "bikeid": "bikeid",
    "user_type": "usertype",
    "birth year": "birth year",
    "gender": "gender",
}
SECOND_ERA = {
    "started_at": "Start Time",
    "ended_at": "Stop Time",
    "start_station_id": "Start Station ID",
    "start_station_name": "Start Station Name",
    "start_lat": "Start Station Latitude",
    "start_lng": "Start Station Longitude",
    "end_station_id": "End Station ID",
    "end_station_name": "End Station Name",
    "end_lat": "End Station Latitude",
    "end_lng": "End Station Longitude",
    "bikeid": "Bike ID",
    "user_type": "User Type",
    "birth year": "Birth Year",
    "gender": "Gender",
}


@query(
    "csv_eras",
    with_prelude(
        f"""SELECT {_RIDE} FROM (SELECT * REPLACE (
          CASE WHEN year(start_time) >= 2000 THEN ride_id END AS ride_id,
          CASE WHEN year(start_time) >= 2000 THEN rideable_type ELSE 'unknown' END AS rideable_type,
          CASE WHEN year(start_time) >= 2000 THEN 0 ELSE gender END AS gender,
          CASE WHEN year(start_time) < 2000 THEN birth_year END AS birth_year,
          CASE WHEN year(start_time) < 2000 THEN bike_id END AS bike_id) FROM normalized)"""
    ),
)
def _(w):
    """Three header eras, each in its own files, read into one ride table."""
    year = F.year("started_at")
    raw = w.raw.withColumn("user_type", codes.member_casual(F.col("member_casual")))
    eras = [(year < 1998, FIRST_ERA, "era1"), ((year >= 1998) & (year < 2000), SECOND_ERA, "era2"), (year >= 2000, HEADERS, "era3")]
    return trip_csv.read_trip_eras(w.spark, [_text_csv(w, raw.where(chosen), headers, name) for chosen, headers, name in eras])


@query(
    "csv_sorted_rewrite",
    with_prelude(
        """SELECT strftime(started_at, '%Y-%m-%d %H:%M:%S') AS started_at, strftime(ended_at, '%Y-%m-%d %H:%M:%S') AS ended_at, ride_id,
        start_station_id, start_station_name, end_station_id, end_station_name, rideable_type, member_casual,
        start_lat, start_lng, end_lat, end_lng FROM raw"""
    ),
)
def _(w):
    """All columns; the writer compares the number of rows that can be read back."""
    rows = as_text(w.raw, {c: c for c in HEADERS})
    path = scratch_path(w.spark, "sorted")
    with jit_sized_codegen(w.spark):
        writers.write_sorted_csv(rows, path)
    places = [F.col(c).cast("double").alias(c) for c in ("start_lat", "start_lng", "end_lat", "end_lng")]
    return trip_csv.read_trip_csv(w.spark, path).select(*[c for c in HEADERS if c[-4:] not in ("_lat", "_lng")], *places)


_ARCHIVED = f"""SELECT {_RIDE}, CAST(year(start_time) * 100 + month(start_time) AS INT) AS src_ym
        FROM (SELECT * REPLACE (0 AS gender, NULL::INT AS birth_year, NULL::INT AS bike_id) FROM normalized)"""


def _archives(w) -> str:
    """Monthly zip archives, plain and nested."""
    folder = scratch_path(w.spark, "archives")
    with jit_sized_codegen(w.spark):
        write_monthly_archives(w.raw, folder).write.format("noop").mode("overwrite").save()
    return folder


@query("archive_scan", with_prelude(_ARCHIVED))
def _(w):
    """All members of monthly archives through the data source, a partition each."""
    rows = archive_source.scan_archives(w.spark, _archives(w), chunk_bytes=1 << 16)
    return normalize(rows, publisher=F.col("publisher"), keep=["src_ym", "publisher"]).drop("publisher")


@query("archive_scan_months", with_prelude(f"SELECT * FROM ({_ARCHIVED}) WHERE src_ym BETWEEN 199601 AND 199603"))
def _(w):
    """Three months of the archives: the filter reaches the listing, no other member is opened."""
    rows = archive_source.scan_archives(w.spark, _archives(w)).where(F.col("src_ym").between(199601, 199603))
    return normalize(rows, publisher=F.col("publisher"), keep=["src_ym", "publisher"]).drop("publisher")


@query("archive_scan_years", with_prelude(_ARCHIVED))
def _(w):
    """Whole-year archives that hold every month in two layouts, of which one is read."""
    folder = scratch_path(w.spark, "archives")
    with jit_sized_codegen(w.spark):
        write_yearly_archives(w.raw, folder).write.format("noop").mode("overwrite").save()
    rows = archive_source.scan_archives(w.spark, folder, name_type=2)
    return normalize(rows, publisher=F.col("publisher"), keep=["src_ym", "publisher"]).drop("publisher")


@query("archive_scan_shared", with_prelude(_ARCHIVED))
def _(w):
    """Members cut into chunks that all tasks parse."""
    rows = archives.read_trip_archives(w.spark, _archives(w), chunk_bytes=1 << 16)
    return normalize(rows, publisher=F.col("publisher"), keep=["src_ym", "publisher"]).drop("publisher")


@query("parquet_month_table", with_prelude("SELECT * FROM rides"))
def _(w):
    path = scratch_path(w.spark, "months")
    writers.write_month_table(w.rides, path)
    return tables.read_tables(w.spark, path).select(*w.rides.columns)


@query(
    "source_month_refresh",
    with_prelude("SELECT src_ym, start_ym, end_ym, CAST(count(*) AS BIGINT) AS n FROM slices WHERE start_ym = end_ym GROUP BY 1, 2, 3", **SLICES),
)
def _(w):
    """All slices, then a rerun without rides across a month end, whose slices have to go."""
    base = scratch_path(w.spark, "slices")
    writers.replace_source_months(_sliced(w), base, clustered=not w.lazy)
    writers.replace_source_months(_sliced(w).where(F.col("start_ym") == F.col("end_ym")), base, clustered=not w.lazy)
    return tables.read_slices(w.spark, base).groupBy("src_ym", "start_ym", "end_ym").agg(F.count("*").alias("n"))


@query(
    "end_month_read",
    with_prelude(
        f"""SELECT {_RIDE}, src_ym, CAST(src_ym AS VARCHAR) || '/' || CAST(start_ym AS VARCHAR) || '_' || CAST(end_ym AS VARCHAR) AS slice
        FROM slices WHERE end_ym = 199801""",
        **SLICES,
    ),
)
def _(w):
    """The slices of all source months that end in one month, read from the stored folder."""
    base = scratch_path(w.spark, "slices")
    writers.replace_source_months(_sliced(w), base, clustered=not w.lazy)
    return tables.read_end_month(w.spark, base, 199801).withColumnRenamed("file", "slice").select(*RIDE_COLUMNS, "src_ym", "slice")


@query("sql_table", with_prelude("SELECT sid, eid, count FROM pairs", pairs=PAIRS_SQL))
def _(w):
    """Pair counts as a table of the catalog, written and read by name."""
    name = f"tripweave_pairs_{uuid.uuid4().hex[:8]}"
    writers.write_sql_table(w.pairs, name, path=scratch_path(w.spark, name))
    return tables.read_sql_table(w.spark, name)


@query(
    "unexpected_fields",
    with_prelude(
        """SELECT * FROM (VALUES ('speed', (SELECT CAST(count(*) FILTER (gender = 1) AS BIGINT) FROM raw)), ('notes', (SELECT CAST(count(*) AS BIGINT) FROM raw)))
        t("column", n_values)"""
    ),
)
def _(w):
    """Raw rows with two columns that no era has."""
    more = w.raw.withColumns({"speed": F.when(F.col("gender") == 1, 1), "notes": F.lit("-")})
    return unexpected_values(more, keep=["file"])


@query("file_manifest", with_prelude("SELECT DISTINCT 'end_ym=' || CAST(end_ym AS VARCHAR) AS folder FROM rides WHERE end_ym BETWEEN 199801 AND 199809"))
def _(w):
    """Files of some months of the stored table; the patterns look at what lies below the table's folder."""
    path = scratch_path(w.spark, "end_ym=1998-listing")
    writers.write_month_table(w.rides, path)
    listed = manifest.file_manifest(w.spark, path, include=["^end_ym=19980"])
    return listed.select(F.element_at(F.split("path", "/"), -2).alias("folder")).distinct()


@query(
    "cast_failures",
    with_prelude(
        """SELECT * FROM (VALUES ('start_time', 0::BIGINT), ('stop_time', (SELECT CAST(count(*) FILTER (ks % 5 = 0) AS BIGINT) FROM src)),
        ('start_lat', 0), ('start_lng', 0), ('end_lat', (SELECT CAST(count(*) FILTER (ks % 7 = 0) AS BIGINT) FROM src)), ('end_lng', 0)) t("column", n_failed)"""
    ),
)
def _(w):
    """Text columns with some stop times and latitudes that cannot be read."""
    rows = as_text(w.raw, {c: c for c in HEADERS})
    number = F.regexp_extract("start_station_name", r"^Station (\d+)", 1).cast("int")
    broken = {"ended_at": F.when(number % 5 == 0, "soon").otherwise(F.col("ended_at")), "end_lat": F.when(number % 7 == 0, "north").otherwise(F.col("end_lat"))}
    return cast_failures(rows.withColumns(broken))


@query(
    "domain_failures",
    with_prelude(
        """SELECT * FROM (SELECT 'rideable_type' AS "column", rideable_type AS value, CAST(count(*) AS BIGINT) AS n FROM raw WHERE rideable_type = 'motivate_dockless_bike' GROUP BY 2
        UNION ALL SELECT 'member_casual', 'weird', CAST(count(*) AS BIGINT) FROM raw WHERE gender = 2
        UNION ALL SELECT 'gender', CASE gender WHEN 0 THEN 'Z' ELSE '7' END, CAST(count(*) AS BIGINT) FROM raw WHERE gender < 2 GROUP BY 2)"""
    ),
)
def _(w):
    """Codes that no domain has, in three columns."""
    gender = F.element_at(F.array(F.lit("Z"), F.lit("7"), F.lit("M")), F.col("gender") + 1)
    odd = {"member_casual": F.when(F.col("gender") == 2, "weird").otherwise(F.col("member_casual")), "gender": gender}
    return domain_failures(w.raw.withColumns(odd), keep=["file"])


@query("json_records", with_prelude(DISPLAY_SQL, cube=CUBE_SQL))
def _(w):
    path = scratch_path(w.spark, "records")
    cube = agg.cube_display(w.cube)
    writers.write_json_records(cube, path, order=agg.cube_order())
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in cube.schema.fields)
    return tables.read_json_lines(w.spark, path, schema)


@query("station_json", with_prelude("SELECT id, name, round(lat, 6) AS lat, round(lng, 6) AS lng, ends FROM stations", **STATION_TABLES))
def _(w):
    path = scratch_path(w.spark, "stations")
    writers.write_keyed_json(w.stations, path)
    return tables.read_station_json(w.spark, path).withColumns({c: F.round(c, 6) for c in ("lat", "lng")})


@query("pair_json", with_prelude("SELECT * FROM encoded", **PAIR_TABLES))
def _(w):
    path = scratch_path(w.spark, "pairs")
    pairs = st.encode_pairs(w.pairs, w.index)
    writers.write_pair_json(st.pair_maps(pairs), path)
    return tables.read_pair_json(w.spark, path)


@query("sql_decode_join", with_prelude("SELECT sid AS start_id, eid AS end_id, count FROM pairs", pairs=PAIRS_SQL))
def _(w):
    """Encoded pairs and the index as SQL views, decoded by two nested left joins."""
    index = w.index
    st.encode_pairs(w.pairs, index).createOrReplaceTempView("tripweave_pairs")
    index.createOrReplaceTempView("tripweave_index")
    return w.spark.sql(
        """SELECT t.start_id, i.id AS end_id, t.count
           FROM (SELECT i.id AS start_id, p.eidx, p.count FROM tripweave_pairs p LEFT JOIN tripweave_index i ON p.sidx = i.idx) t
           LEFT JOIN tripweave_index i ON t.eidx = i.idx"""
    )


@query("union_all_months", with_prelude(keyed({"end_ym": "end_ym", "start_station_id": "start_station_id"})))
def _(w):
    """Aggregates of each file, merged; whatever files there are."""
    return agg.reaggregate(agg.aggregate_rides(w.rides, "s", "c", by=["end_ym", "file"]), ["end_ym", "start_station_id"])


@query("station_index_of_pairs", with_prelude(INDEX_SQL, **STATION_TABLES))
def _(w):
    """The index as the pairs see it: both ends of every pair, without the profiles."""
    ids = st.station_meta_hist(w.rides, "i")
    return st.station_index(ids)
