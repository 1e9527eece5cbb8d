"""Two publications of a ride merged across batches, with keyed state.

The rows of a ride may arrive in any batch. State keeps what the batch merge needs of a key's rows: both rows of a pair, or the different contents of
more. Every batch gives the merged ride as it stands, with a version; a reader takes the newest of each key. A timer drops a key's state when the watermark has
passed its stop time by the lateness that publications may have.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from tripweave.schema import BACKFILL_COLUMNS, TIME_KEY

#: Where Spark keeps state that has timers.
STATE_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")

_WHOLE = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
_FRACTION = (T.FloatType, T.DoubleType)


class MergeRides(StatefulProcessor):
    """Rows come and go as lists of texts, one for each column; ``kinds`` says how they compare."""

    def __init__(self, columns: Sequence[str], kinds: Sequence[str], order: str, attributes: Sequence[str], keys: Sequence[str], late_ms: int):
        self.names, self.kinds, self.late_ms = list(columns), list(kinds), late_ms
        self.order = self.names.index(order)
        self.attributes = [self.names.index(c) for c in attributes]
        self.rest = [i for i, c in enumerate(self.names) if i != self.order and c not in keys]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", "value string")

    def _rank(self, row: list, at: Sequence[int]) -> list[tuple]:
        """Sort key of some columns; a null is smaller than any value."""
        cast = {"whole": int, "fraction": float, "text": str}
        return [(row[i] is not None, cast[self.kinds[i]](row[i]) if row[i] is not None else 0) for i in at]

    def _informed(self, row: list) -> bool:
        return any(row[i] is not None and not (self.names[i] == "gender" and row[i] == "0") for i in self.attributes)

    def _add(self, n: int, rows: list[list], row: list) -> list[list]:
        """The rows to keep when ``row`` is the (n + 1)th: a pair whole, of more each content once, in the last file."""
        rows = [*rows, row]
        if n + 1 <= 2:
            return rows
        newest: dict[str, list] = {}
        for r in rows:
            content = json.dumps([r[i] for i in self.rest])
            if content not in newest or self._rank(r, [self.order]) > self._rank(newest[content], [self.order]):
                newest[content] = r
        return list(newest.values())

    def _merged(self, n: int, rows: list[list]) -> list[list]:
        if n != 2:
            return rows
        last = max(rows, key=lambda r: self._rank(r, [self.order, *self.rest]))
        informed = [r for r in rows if self._informed(r)]
        if informed and not self._informed(last):
            donor = max(informed, key=lambda r: self._rank(r, [self.order, *self.attributes]))
            last = [donor[i] if i in self.attributes else v for i, v in enumerate(last)]
        return [last]

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        n, held = json.loads(self.held.get()[0]) if self.held.exists() else (0, [])
        last_ms = 0
        for frame in rows:
            for row, ms in zip(frame["row"], frame["event_ms"], strict=True):
                held = self._add(n, held, list(row))
                n, last_ms = n + 1, max(last_ms, int(ms))
        self.held.update((json.dumps([n, held]),))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(last_ms + self.late_ms)
        yield pd.DataFrame({"version": n, "row": self._merged(n, held)})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.held.clear()
        yield from ()


def _kind(data_type: T.DataType) -> str:
    return "whole" if isinstance(data_type, _WHOLE) else "fraction" if isinstance(data_type, _FRACTION) else "text"


def merge_stream(stream: DataFrame, order: str = "file", columns: Sequence[str] = tuple(BACKFILL_COLUMNS), keys: Sequence[str] = tuple(TIME_KEY), late_by: str = "40 days") -> DataFrame:
    """Rides as ``reconcile.merge_duplicates`` would leave them so far, with ``version``: the number of rows of the key that it is made of.

    A key whose ride changes is given again with a higher version and replaces the lower ones; rows without a key are given once, with version 0.
    Rows that come later than ``late_by`` after the newest stop time are not merged any more.
    """
    stream.sparkSession.conf.set(*STATE_STORE)
    has_key = F.lit(True)
    for k in keys:
        has_key = has_key & F.col(k).isNotNull()
    # Texts that read back as the same values, for any type of column and in any time zone.
    texts = F.array(*[F.col(c).cast("string") for c in stream.columns])
    event = F.col(keys[-1]).cast("timestamp")
    keyed = stream.where(has_key).select(F.concat_ws("|", *[F.col(k).cast("string") for k in keys]).alias("key"), event.alias("event_time"), F.unix_millis(event).alias("event_ms"), texts.alias("row"))
    late_ms = int(pd.Timedelta(late_by) / pd.Timedelta("1ms"))
    kinds = [_kind(f.dataType) for f in stream.schema]
    merge = MergeRides(stream.columns, kinds, order, columns, keys, late_ms)
    updates = (
        keyed.withWatermark("event_time", late_by)
        .groupBy("key")
        .transformWithStateInPandas(merge, "version long, row array<string>", outputMode="Update", timeMode="EventTime")
        .select(*[F.col("row")[i].cast(f.dataType).alias(f.name) for i, f in enumerate(stream.schema)], "version")
    )
    return updates.unionByName(stream.where(~has_key).withColumn("version", F.lit(0).cast("long")))


def store_merged(stream: DataFrame, table: str, checkpoint: str, **options) -> StreamingQuery:
    """Merge arriving rides into a table of versions until the source is drained; a batch that is run again replaces its own folder."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{table}/batch={batch_id}")

    writer = merge_stream(stream, **options).writeStream.outputMode("update").foreachBatch(write)
    return writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_merged(spark: SparkSession, table: str, keys: Sequence[str] = tuple(TIME_KEY)) -> DataFrame:
    """The rides of the newest version of each key, and all rows without a key."""
    rows = spark.read.parquet(table).drop("batch")
    newest = rows.where(F.col("version") > 0).groupBy(*keys).agg(F.max("version").alias("version"))
    return rows.join(newest, [*keys, "version"], "left_semi").unionByName(rows.where(F.col("version") == 0)).drop("version")
