"""Raw trip rows derived from the TPC-H-like tables, with every oddity real trip files have."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _station_id(k: str) -> str:
    two = f"lpad(CAST({k} AS STRING), 2, '0')"
    return f"""CASE WHEN {k} = 39 THEN 'SYS001' WHEN {k} = 38 THEN NULL WHEN {k} = 37 THEN 'ZZ-unmapped'
      WHEN {k} % 10 = 0 THEN 'HB1' || {two} WHEN {k} % 10 < 3 THEN 'JC0' || {two}
      ELSE CAST(4000 + {k} AS STRING) || '.' || {two} END"""


# Column expressions valid in Spark and in DuckDB alike; headers are those of the published files.
RAW_COLUMNS = {
    "ride_id": "CAST(l_orderkey AS STRING) || '-' || CAST(l_linenumber AS STRING)",
    "started_at": "t0",
    "ended_at": """t0 + INTERVAL '1' SECOND * CAST(60 + (l_partkey*37 + l_linenumber*611) % 5400
      + (CASE WHEN l_partkey % 97 = 0 THEN 86400 ELSE 0 END) AS INT)""",
    "start_station_id": _station_id("ks"),
    "start_station_name": "'Station ' || CAST(ks AS STRING) || CASE WHEN l_linenumber = 7 THEN ' (alt)' ELSE '' END",
    "start_lat": "CAST(40.7 + ks*0.001 + (l_partkey % 3)*0.0001 AS DOUBLE)",
    "start_lng": "CAST(-74.0 - ks*0.001 AS DOUBLE)",
    "end_station_id": _station_id("ke"),
    "end_station_name": "'Station ' || CAST(ke AS STRING)",
    "end_lat": "CAST(40.7 + ke*0.001 AS DOUBLE)",
    "end_lng": "CAST(-74.0 - ke*0.001 - (l_partkey % 2)*0.0001 AS DOUBLE)",
    "rideable_type": """CASE WHEN l_linenumber = 6 AND l_partkey % 11 = 0 THEN 'motivate_dockless_bike'
      WHEN l_returnflag = 'A' THEN 'classic_bike' WHEN l_returnflag = 'N' THEN 'docked_bike' ELSE 'electric_bike' END""",
    "member_casual": "CASE WHEN o_orderstatus = 'O' THEN 'casual' ELSE 'member' END",
    "gender": "CAST(l_linenumber % 3 AS INT)",
    "birth year": "CASE WHEN l_linenumber % 4 = 0 THEN NULL ELSE CAST(1950 + l_partkey % 50 AS INT) END",
    "bikeid": "CAST(l_suppkey AS INT)",
    "file": "l_linestatus",
}
#: The start of a ride, spread over the day of its order.
BEGIN = "o_orderdate + INTERVAL '1' SECOND * CAST(o_orderkey*7919 % 86400 AS INT)"


def raw_trips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw rows: lineitem joined to its order.

    Both sides are narrowed and then shuffled by order, which spreads the wide expressions over all cores even
    if a table is a single file. The order side is unique on its key, so a hot order only skews the lineitem
    side, and the adaptive skew join splits that.
    """
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_returnflag", "l_linestatus", (F.col("l_suppkey") % 40).alias("ke")
    )
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select(
        "o_orderkey", "o_orderstatus", (F.col("o_custkey") % 40).alias("ks"), F.expr(BEGIN).alias("t0")
    )
    joined = items.join(orders.hint("merge"), F.col("l_orderkey") == F.col("o_orderkey"))
    return joined.select(*[F.expr(e).alias(n) for n, e in RAW_COLUMNS.items()])
