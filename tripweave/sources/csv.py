"""CSV trip files: everything is read as text, typed later by ``normalize``."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tripweave.operators.normalize import normalize
from tripweave.sources.headers import sort_columns

# Texts that stand for a missing value.
NULL_MARKER = r"\N"
NULL_TEXTS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]


def null_texts_to_null(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Null for every text that means missing; other columns stay as they are."""
    texts = [*NULL_TEXTS, NULL_MARKER]
    chosen = set(columns if columns is not None else [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)])
    return df.select(*[F.when(~F.col(f"`{c}`").isin(texts), F.col(f"`{c}`")).alias(c) if c in chosen else F.col(f"`{c}`") for c in df.columns])


def read_trip_csv(spark: SparkSession, paths: str | Sequence[str], header: Sequence[str] | None = None) -> DataFrame:
    """Text columns of CSV files that share one header, plus the ``file`` they come from.

    With ``header`` every file's header line is compared with it and a different one fails the query.
    Without it the header of the first file is taken, and the other files are compared with that.
    """
    paths = [paths] if isinstance(paths, str) else list(paths)
    reader = spark.read.option("header", True).option("nullValue", NULL_MARKER).option("enforceSchema", False)
    columns = list(header) if header is not None else reader.csv(paths[:1]).columns
    schema = T.StructType([T.StructField(c, T.StringType(), True) for c in columns])
    rows = reader.schema(schema).csv(paths)
    return null_texts_to_null(rows).withColumn("file", F.col("_metadata.file_name"))


def read_trip_eras(spark: SparkSession, eras: Sequence[str | Sequence[str]], publisher: str | None = None) -> DataFrame:
    """Ride table from files of several header eras, one entry per era.

    Each era is normalised on its own, as a column that an era lacks has a default there.
    """
    frames = [normalize(read_trip_csv(spark, paths), publisher=publisher) for paths in eras]
    return reduce(DataFrame.unionByName, frames)


def sort_rows(rows: DataFrame) -> DataFrame:
    """Raw rows of one header era in start, stop and id order, equal keys in their old order."""
    keys = [F.col(f"`{c}`") for c in sort_columns(rows.columns)]
    return rows.withColumn("_position", F.monotonically_increasing_id()).orderBy(*keys, "_position").drop("_position")


def read_sorted_csv(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """Rows of one header era in sorted order, without blank lines."""
    return sort_rows(read_trip_csv(spark, paths).drop("file"))
