"""Stored tables: parquet, slices by month, JSON and SQL tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_tables(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """Parquet tables stacked; one path or several with the same columns."""
    return spark.read.parquet(*([paths] if isinstance(paths, str) else paths))


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    """Rows of all frames by column name; a column that a frame lacks is null there."""
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame, allowMissingColumns=True)
    return out


def run_folder(base: str, run: str) -> str:
    """Where one run's slices are stored."""
    return f"{base}/runs/run={run}"


def index_versions(spark: SparkSession, base: str) -> dict[int, bool]:
    """Numbers of the indexes of a slice table, and whether each was committed; one that a run left half written was not."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    folder = path(f"{base}/index")
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(folder):
        return {}
    names = [s.getPath().getName() for s in fs.listStatus(folder)]
    return {int(n): fs.exists(path(f"{base}/index/{n}/_SUCCESS")) for n in names if n.isdigit()}


def index_folder(base: str, version: int) -> str:
    return f"{base}/index/{version:012d}"


def newest_index(spark: SparkSession, base: str) -> tuple[int, DataFrame | None]:
    """Number and rows (``src_ym, run``) of the newest committed index of a slice table; (0, None) if there is none."""
    version = max((v for v, committed in index_versions(spark, base).items() if committed), default=0)
    if not version:
        return 0, None
    return version, spark.read.schema("src_ym int, run string").parquet(index_folder(base, version))


def read_slices(spark: SparkSession, base: str) -> DataFrame:
    """The current slices of all source months, with ``src_ym``, ``start_ym`` and ``end_ym``."""
    _, index = newest_index(spark, base)
    paths = [f"{run_folder(base, r.run)}/src_ym={r.src_ym}" for r in index.collect()] if index is not None else []  # one per source month
    if not paths:
        raise FileNotFoundError(f"{base} has no committed slices")
    return spark.read.option("basePath", f"{base}/runs").parquet(*paths).drop("run")


def read_end_month(spark: SparkSession, base: str, end_ym: int) -> DataFrame:
    """All slices, of whatever source month, whose rides end in ``end_ym``, tagged with their slice.

    The month is a partition column, so other months' files are not opened.
    """
    return tag_slice(read_slices(spark, base).where(F.col("end_ym") == end_ym))


def tag_slice(rows: DataFrame, name: str = "file") -> DataFrame:
    """``src_ym/start_ym_end_ym`` of each row, the name of the slice it is stored in."""
    label = F.concat_ws("/", F.col("src_ym").cast("string"), F.concat_ws("_", F.col("start_ym").cast("string"), F.col("end_ym").cast("string")))
    return rows.withColumn(name, label)


def tag_file(rows: DataFrame, name: str = "file") -> DataFrame:
    """Path of the file each row was read from."""
    return rows.withColumn(name, F.col("_metadata.file_path"))


def _json_objects(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Objects keyed by id: a month's object in one line, lines of one entry each, or the lines of a document with an entry each."""
    # A line of a document begins with the comma or the brace before its entry; what follows an object is not read.
    line = F.concat(F.lit("{"), F.regexp_replace("value", r"^\s*[{,]", ""), F.lit("}"))
    return spark.read.text(path).select(F.from_json(line, schema).alias("m"))


def read_station_json(spark: SparkSession, path: str) -> DataFrame:
    """Stations from ``{id: {name, lat, lng, ends}}``."""
    objects = _json_objects(spark, path, "map<string, struct<name: string, lat: double, lng: double, ends: long>>")
    return objects.select(F.explode("m").alias("id", "s")).select("id", "s.*")


def read_pair_json(spark: SparkSession, path: str) -> DataFrame:
    """Pair counts from ``{start: {end: count}}``."""
    objects = _json_objects(spark, path, "map<string, map<string, long>>")
    starts = objects.select(F.explode("m").alias("sidx", "d"))
    return starts.select(F.col("sidx").cast("int").alias("sidx"), F.explode("d").alias("eidx", "count")).withColumn("eidx", F.col("eidx").cast("int"))


def read_json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON records, one per line."""
    return spark.read.schema(schema).json(path)


def read_sql_table(
    spark: SparkSession,
    table: str,
    jdbc_url: str | None = None,
    partition_column: str | None = None,
    bounds: tuple[int, int] | None = None,
    partitions: int = 16,
) -> DataFrame:
    """A catalog table, or a database table over JDBC, read in parallel ranges if a partition column is given."""
    if jdbc_url is None:
        return spark.read.table(table)
    reader = spark.read.format("jdbc").option("url", jdbc_url).option("dbtable", table)
    if partition_column and bounds:
        reader = (
            reader.option("partitionColumn", partition_column)
            .option("lowerBound", str(bounds[0]))
            .option("upperBound", str(bounds[1]))
            .option("numPartitions", str(partitions))
        )
    return reader.load()
