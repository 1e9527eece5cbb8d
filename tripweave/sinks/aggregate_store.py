"""Stored aggregates: partial sums per end month that can be replaced, and answers from the smallest one that holds what is asked.

An aggregate lies in a folder named by its label, such as ``ymrgtb_cd``, partitioned by the END month of its rides, the column that
ride tables are stored by. A month that is published again, however old, is summed again from its rides alone and overwrites its own partition;
keys are started in months of their own, so a reader sums over the end months. Null keys are kept as keys: whether a ride with a null counts
depends on the keys that are asked for, so a smaller aggregate can be taken from a larger one without losing rides.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tripweave.functions import text
from tripweave.operators.aggregate import aggregate_rides, reaggregate
from tripweave.schema import RIDE_MEASURES, RIDE_SCHEMA, aggregate_label, key_columns

#: What stored aggregates are partitioned by.
MONTH = "end_ym"

#: Fixed value: the folder name of a null partition.
_NO_MONTH = "__HIVE_DEFAULT_PARTITION__"


def split_label(label: str) -> tuple[str, str]:
    """Key letters and measure letters of a label."""
    keys, _, measures = label.partition("_")
    return keys, measures


def choose_aggregate(stored: dict[str, int], keys: str, measures: str) -> str | None:
    """The label of the smallest of ``stored`` (sizes by label) that has all wanted keys and measures, None if none has.

    All measures are sums, so any superset of the keys adds up. Equal sizes go to fewer keys, then to the first label.
    """
    fits = [(size, len(label), label) for label, size in stored.items() if set(keys) <= set(split_label(label)[0]) and set(measures) <= set(split_label(label)[1])]
    return min(fits)[2] if fits else None


def touched_months(*slices: DataFrame) -> list[int | None]:
    """End months that a publication touches: those of its slices before and after. One row per month comes to the driver."""
    months = [s.select(MONTH) for s in slices]
    both = months[0]
    for m in months[1:]:
        both = both.unionByName(m)
    return sorted((r[0] for r in both.distinct().collect()), key=lambda m: (m is not None, m or 0))


class AggregateStore:
    """The aggregates in one folder."""

    def __init__(self, spark: SparkSession, base: str):
        self.spark, self.base = spark, base.rstrip("/")

    def _fs(self):
        path = self.spark._jvm.org.apache.hadoop.fs.Path
        return path, path(self.base).getFileSystem(self.spark._jsc.hadoopConfiguration())

    def sizes(self) -> dict[str, int]:
        """Bytes of each stored aggregate that was written whole."""
        path, fs = self._fs()
        if not fs.exists(path(self.base)):
            return {}
        names = [s.getPath().getName() for s in fs.listStatus(path(self.base)) if s.isDirectory()]
        return {n: fs.getContentSummary(path(f"{self.base}/{n}")).getLength() for n in names if fs.exists(path(f"{self.base}/{n}/_SUCCESS"))}

    def refresh(self, rides: DataFrame, keys: str, measures: str = "cd", months: Iterable[int | None] | None = None) -> str:
        """Write an aggregate, all of it or only the end ``months`` named, from all rides that end in them; gives its label.

        Rides without an end month are a part of their own (None). A named month without any ride loses its part. A run that dies can leave
        some of the months old; the same call again replaces all of them.
        """
        label = aggregate_label(keys, measures)
        target, some = f"{self.base}/{label}", None if months is None else set(months)
        if some is not None:
            wanted = F.col(MONTH).isin(sorted(some - {None}))
            rides = rides.where(F.coalesce(wanted, F.lit(None in some)))
        found = Observation()
        partial = aggregate_rides(rides, keys, measures, by=[MONTH], known_only=False)
        partial = partial.hint("rebalance", MONTH).observe(found, F.collect_set(MONTH).alias("months"), F.count_if(F.col(MONTH).isNull()).alias("none"))
        mode = "static" if some is None else "dynamic"
        partial.write.mode("overwrite").option("partitionOverwriteMode", mode).partitionBy(MONTH).parquet(target)
        path, fs = self._fs()
        for m in (some or set()) - set(found.get["months"]) - ({None} if found.get["none"] else set()):
            fs.delete(path(f"{target}/{MONTH}={_NO_MONTH if m is None else m}"), True)
        return label

    def _read(self, label: str) -> DataFrame:
        keys, measures = split_label(label)
        none = self.spark.createDataFrame([], T.StructType([*RIDE_SCHEMA.fields, T.StructField(MONTH, T.IntegerType())]))
        return self.spark.read.schema(aggregate_rides(none, keys, measures, by=[MONTH]).schema).parquet(f"{self.base}/{label}")

    def read(self, label: str, keys: str | None = None, measures: str | None = None, months: Sequence[int] | None = None) -> DataFrame:
        """One row per key, summed over the end months (all, or those given); fewer keys and measures if asked for."""
        own_keys, own_measures = split_label(label)
        keys, measures = own_keys if keys is None else keys, own_measures if measures is None else measures
        parts = self._read(label)
        if months is not None:
            parts = parts.where(F.col(MONTH).isin(list(months)))
        names = key_columns(keys)
        return reaggregate(parts.where(text.all_known(names)), names, [n for m, n in RIDE_MEASURES.items() if m in measures])

    def aggregate(self, keys: str, measures: str = "c", rides: DataFrame | None = None) -> DataFrame:
        """An aggregate for any keys: from the smallest stored one that has them, else from ``rides``."""
        label = choose_aggregate(self.sizes(), keys, measures)
        if label is not None:
            return self.read(label, keys, measures)
        if rides is None:
            raise LookupError(f"no stored aggregate has the keys {keys!r} and measures {measures!r}")
        return aggregate_rides(rides, keys, measures)
