"""What the corpus operators share: reading tables, storing intermediate results, splits and Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tripweave.session import scratch_path

#: Bits of a row number that count rows within an input partition.
ROW_BITS = 33


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a frame to the shared folder and read it back.

    Cuts lineage: a lost executor costs a re-read of files that every executor reaches, not a recomputation.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def hashed_sample(df: DataFrame, key: str, rows: int, total: int) -> DataFrame:
    """At most ``rows`` of a frame of ``total`` rows, chosen by hashes of ``key``; the same rows for the same table.

    A hash threshold thins a large frame before the few left are put in order, so no task sorts more than about the sample.
    """
    if total > 2 * rows:
        df = df.filter(F.pmod(F.xxhash64(key, F.lit(7)), F.lit(1 << 40)) < int(1.2 * rows / total * (1 << 40)))
    return df.orderBy(F.xxhash64(key), key).limit(rows)


def broadcast_if_small(df: DataFrame, rows: int = 500_000) -> DataFrame:
    """A narrow, stored frame marked for broadcast if it has at most ``rows`` rows; a larger one is left to a shuffled join."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def fold(id_col: str, folds: int) -> Column:
    """Remainder of the CRC-32 of the id's text; null for a null id."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % folds


#: Rows that a Python worker gets at once; with whole texts Spark's own default of 10,000 is too many for small executors.
BATCH_ROWS = 2_000


def map_texts(df: DataFrame, run, schema) -> DataFrame:
    """``mapInArrow`` in batches of at most ``BATCH_ROWS`` rows; the session keeps this setting."""
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(name)) <= BATCH_ROWS:
        conf.set(name, str(BATCH_ROWS))
    return df.mapInArrow(run, schema)


def text_batches(batches: Iterator[pa.RecordBatch], max_chars: int = 1_000_000) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Record batches cut so that the texts (last column, null: empty) of one stay under ``max_chars`` or are one row."""
    for batch in batches:
        texts = [t or "" for t in batch.column(batch.num_columns - 1).to_pylist()]
        begin, chars = 0, 0
        for i, t in enumerate(texts):
            if chars and chars + len(t) > max_chars:
                yield batch.slice(begin, i - begin), texts[begin:i]
                begin, chars = i, 0
            chars += len(t)
        if begin < len(texts):
            yield batch.slice(begin), texts[begin:]
    pa.default_memory_pool().release_unused()


def arrow_schema(df_schema) -> pa.Schema:
    """Arrow schema of a Spark schema, as ``mapInArrow`` functions have to return it."""
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(df_schema)


def with_row_number(partition: int, begin: int, count: int) -> pa.Array:
    """Numbers that are unique over all input partitions."""
    import numpy as np

    return pa.array(np.arange(begin, begin + count, dtype=np.int64) + (partition << ROW_BITS))
