"""One document over many files: ordered parts, each written by its own task, that put one after another are a valid whole.

A gzip file may have several members, so compressed parts concatenate as plain ones do. What stands only once, the header line of a CSV file or the
braces of a JSON object, belongs to the first and the last row and is written with them; no part needs to know its place, and no
task sees more than its range of the rows. ``cat`` of ``document_parts`` is the file.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tripweave.sources.csv import NULL_MARKER
from tripweave.sources.headers import sort_columns

_MODES = {True: "overwrite", False: "ignore", None: "errorifexists"}


def document_parts(spark: SparkSession, path: str) -> list[str]:
    """The files of a document in order; a file that holds nothing is left out."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = folder.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(folder)
    return sorted(f.getPath().toString() for f in found if f.getLen() and f.getPath().getName().startswith("part-"))


def write_csv_document(rows: DataFrame, path: str, overwrite: bool | None = None) -> None:
    """A gzipped CSV file with one header line, in start, stop and id order, blank rows dropped, equal keys in their old order.

    The rows that go in are counted while they are written and compared with the lines that can be read back.
    """
    spark, counted, options = rows.sparkSession, Observation(), {"nullValue": NULL_MARKER}
    columns = [F.col(f"`{c}`") for c in rows.columns]
    keys = sort_columns(rows.columns)
    order = [F.col(f"`{c}`").alias(f"_k{i}") for i, c in enumerate(keys)]
    data = rows.where(F.coalesce(*columns).isNotNull()).select(F.lit(1).alias("_part"), *order, F.monotonically_increasing_id().alias("_at"), F.to_csv(F.struct(*columns), options).alias("value"))
    names = F.to_csv(F.struct(*[F.lit(c).alias(f"c{i}") for i, c in enumerate(rows.columns)]), options)
    none = [F.lit(None).cast(rows.schema[c].dataType).alias(f"_k{i}") for i, c in enumerate(keys)]
    header = spark.range(1).select(F.lit(0).alias("_part"), *none, F.lit(0).cast("long").alias("_at"), names.alias("value"))
    lines = data.unionByName(header).orderBy("_part", *[f"_k{i}" for i in range(len(keys))], "_at").observe(counted, F.count(F.lit(1)).alias("n"))
    lines.select("value").write.mode(_MODES[overwrite]).option("compression", "gzip").text(path)
    if overwrite is not False and (back := spark.read.text(path).count()) != counted.get["n"]:
        raise OSError(f"{path}: {back} lines can be read back of {counted.get['n']} written")


def read_csv_document(spark: SparkSession, path: str, columns: Sequence[str]) -> DataFrame:
    """Text columns of a CSV document, from all its parts at once."""
    rows = spark.read.option("nullValue", NULL_MARKER).schema(", ".join(f"`{c}` string" for c in columns)).csv(path)
    is_header = F.lit(True)
    for c in columns:
        is_header = is_header & F.col(f"`{c}`").eqNullSafe(F.lit(c))
    return rows.where(~is_header)


def write_json_document(df: DataFrame, path: str, key: str, value: Column | None = None, compression: str = "none", overwrite: bool | None = None) -> None:
    """The object ``{key: value, ...}`` in key order, a line per entry; the value is all other columns unless given.

    Keys must be known and different; else the query fails. Without rows it is an empty object.
    """
    spark = df.sparkSession
    body = value if value is not None else F.struct(*[F.col(f"`{c}`") for c in df.columns if c != key])
    entry = F.to_json(F.create_map(F.col(key).cast("string"), body))
    ends = df.agg(F.struct(F.min(key).alias("first"), F.max(key).alias("last"), F.count(F.lit(1)).alias("n"), F.count_distinct(key).alias("different"))).scalar()
    lines = df.select(F.col(key).alias("_key"), entry.alias("_entry"), ends.alias("_ends"))
    inner = F.expr("substring(_entry, 2, length(_entry) - 2)")
    begin = F.when(F.col("_key") == F.col("_ends.first"), "{").otherwise(",")
    end = F.when(F.col("_key") == F.col("_ends.last"), "}").otherwise("")
    whole = F.when(F.col("_ends.n") != F.col("_ends.different"), F.raise_error(F.lit("keys of the document repeat"))).otherwise(F.concat(begin, inner, end))
    empty = spark.range(1).select(F.lit(None).cast(df.schema[key].dataType).alias("_key"), F.lit("{}").alias("value")).where(ends["n"] == 0)
    lines.select("_key", whole.alias("value")).unionByName(empty).orderBy("_key").select("value").write.mode(_MODES[overwrite]).option("compression", compression).text(path)


def write_station_document(stations: DataFrame, path: str, key: str = "id", **options) -> None:
    """``{id: {name, lat, lng, ends}, ...}``."""
    write_json_document(stations, path, key, **options)


def write_pair_document(maps: DataFrame, path: str, **options) -> None:
    """``{start: {end: count, ...}, ...}`` in the order of the starts."""
    write_json_document(maps, path, maps.columns[0], F.col("destinations"), **options)
