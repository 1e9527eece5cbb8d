"""Continuous forms of the monthly poll: new files in, end months refreshed, copies and late rides handled."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tripweave.operators.quality import drop_duplicate_rows
from tripweave.schema import RIDE_COLUMNS, TIME_KEY
from tripweave.sinks.writers import write_end_months


def read_ride_stream(spark: SparkSession, path: str, schema, max_files: int = 100) -> DataFrame:
    """Normalised rides from a folder that grows, ``max_files`` files per batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(path)


def refresh_end_months(stream: DataFrame, table: str, checkpoint: str) -> StreamingQuery:
    """Merge arriving rides into the ride table, end month by end month, until the source is drained.

    A batch rewrites only the months it touches. They are read back with what is stored, deduplicated, written
    to a staging folder and then swapped in, so that a replayed batch gives the same table.
    """

    def merge(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        months = [r["end_ym"] for r in batch.select("end_ym").distinct().orderBy("end_ym").collect()]
        if not months:
            return
        rows = batch
        if _exists(spark, table):
            rows = spark.read.schema(batch.schema).parquet(table).where(F.col("end_ym").isin(months)).unionByName(batch)
        staged = f"{checkpoint}/staged/{batch_id}"
        write = drop_duplicate_rows(rows).hint("rebalance", "end_ym").write.mode("overwrite")
        write.partitionBy("end_ym").parquet(staged)
        write_end_months(spark.read.schema(batch.schema).parquet(staged), table)

    writer = stream.writeStream.foreachBatch(merge).option("checkpointLocation", f"{checkpoint}/stream")
    return writer.trigger(availableNow=True).start()


def _exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def first_publication(stream: DataFrame, late_by: str = "40 days") -> DataFrame:
    """Each ride once, though later files repeat it; state older than ``late_by`` is dropped."""
    timed = stream.withColumn("event_time", F.col("stop_time").cast("timestamp"))
    columns = [c for c in RIDE_COLUMNS if c in stream.columns]
    return timed.withWatermark("event_time", late_by).dropDuplicatesWithinWatermark([*columns, *[c for c in TIME_KEY if c not in columns]])


def daily_counts(stream: DataFrame, late_by: str = "40 days") -> DataFrame:
    """Rides per start day and region, final once the watermark passes the day.

    The day itself is the event time, so it is the ride's own calendar day in any session time zone.
    """
    day = F.date_trunc("day", F.col("start_time").cast("timestamp"))
    timed = stream.withColumn("event_day", day).withWatermark("event_day", late_by)
    days = timed.groupBy("event_day", "start_region").agg(F.count("*").alias("n"))
    return days.select(F.col("event_day").cast("date").alias("day"), F.col("start_region").alias("region"), "n")
