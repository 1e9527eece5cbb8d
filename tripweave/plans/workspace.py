"""The tables that registered queries read."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

from tripweave.operators.aggregate import ride_cube
from tripweave.operators.normalize import add_slice_columns, normalize
from tripweave.operators.quality import drop_duplicate_rows, repeated_hashes, repeated_keys, sent_if_few
from tripweave.operators.stations import station_index, station_pairs, station_table
from tripweave.schema import TIME_KEY
from tripweave.session import jit_sized_codegen, scratch_path, tasks_to_count
from tripweave.sinks.snapshots import bucket_count, held_bytes, read_snapshot, write_snapshot
from tripweave.sinks.writers import write_month_table, write_table
from tripweave.sources.fixture import raw_trips

PROVENANCE = ["file"]


class Workspace:
    """Raw trips, the ride table and its stored aggregates for one data folder in one session.

    The pipeline stores what later stages share, each table once, in the shared folder, so a lost executor
    costs a re-read and not a recomputation:

    - ``repeated``: hashes that several normalised rows have. Only the rows that have them are compared with each other in
      the full-row dedupe that normalising ends in.
    - ``rides``: the distinct rows. The table is partitioned by end month, which is the one wide shuffle, and queries prune
      columns and months.
    - ``cube``, ``stations``, ``index``, ``pairs``: the aggregates that dashboards and station pages work on. Series and
      pair queries read these instead of aggregating the rides again.

    The setting ``spark.tripweave.lazyTables=true`` keeps them lazy plans instead, on any master.
    """

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")
        self._snapshots: dict[str, DataFrame] = {}

    @property
    def lazy(self) -> bool:
        return self.spark.conf.get("spark.tripweave.lazyTables", "false") == "true"

    def _stored(self, name: str, table: DataFrame, write: Callable[[DataFrame, str], None]) -> DataFrame:
        if self.lazy:
            return table
        path = scratch_path(self.spark, name)
        with jit_sized_codegen(self.spark):
            write(table, path)
        return self.spark.read.schema(table.schema).parquet(path)

    def snapshot(self, name: str, build: Callable[[], DataFrame]) -> DataFrame:
        """A frame as a table of the catalog, in buckets of its rides' start and stop; stored by the first query that needs it."""
        if name not in self._snapshots:
            frame = build()
            if not self.lazy:
                table, cores = f"tripweave_{name}_{uuid.uuid4().hex[:8]}", self.spark.sparkContext.defaultParallelism
                # No snapshot has more rows than there are rides; all get one number of buckets a row width, so that two of them meet.
                buckets = bucket_count(held_bytes(self.rides.count(), frame.schema), cores)
                write_snapshot(frame, table, buckets, path=scratch_path(self.spark, name))
                frame = read_snapshot(self.spark, table)
            self._snapshots[name] = frame
        return self._snapshots[name]

    def counted(self, name: str, keys: DataFrame) -> DataFrame:
        """The few of very many keys that a count is to find, counted in tasks of bounded size and stored."""
        if self.lazy:
            return keys
        with tasks_to_count(self.spark):
            return self._stored(name, keys, write_table)

    @cached_property
    def raw(self) -> DataFrame:
        return raw_trips(self.spark, self.sf_dir)

    @cached_property
    def normalized(self) -> DataFrame:
        """Normalised rows with their copies."""
        return normalize(self.raw, keep=PROVENANCE)

    @cached_property
    def repeated(self) -> DataFrame:
        """Hashes that several normalised rows have."""
        found = self.counted("repeated", repeated_hashes(self.normalized))
        return found if self.lazy else sent_if_few(found)

    @cached_property
    def rides(self) -> DataFrame:
        distinct = drop_duplicate_rows(self.normalized, repeated=self.repeated)
        return self._stored("rides", add_slice_columns(distinct), write_month_table)

    @cached_property
    def repeated_times(self) -> DataFrame:
        """Starts and stops that several rides share."""
        found = self.counted("repeated-times", repeated_keys(self.rides, TIME_KEY).select(*TIME_KEY))
        return found if self.lazy else sent_if_few(found)

    @cached_property
    def cube(self) -> DataFrame:
        return self._stored("cube", ride_cube(self.rides), write_table)

    @cached_property
    def stations(self) -> DataFrame:
        return self._stored("stations", station_table(self.rides), write_table)

    @cached_property
    def index(self) -> DataFrame:
        """Dense position of every station."""
        return self._stored("index", station_index(self.stations), write_table)

    @cached_property
    def pairs(self) -> DataFrame:
        return self._stored("pairs", station_pairs(self.rides), write_table)


def _version(spark: SparkSession, sf_dir: str) -> tuple:
    """Size and modification time of the base tables, so that changed tables get a workspace of their own."""
    found = []
    for table in ("lineitem", "orders"):
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/{table}.parquet")
        status = path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path)
        found.append((status.getLen(), status.getModificationTime()))
    return tuple(found)


_OPEN: dict[tuple, Workspace] = {}


def workspace(spark: SparkSession, sf_dir: str) -> Workspace:
    """The workspace of a folder, shared by all queries of the application."""
    folder = sf_dir.rstrip("/")
    key = (spark.sparkContext.applicationId, folder, _version(spark, folder))
    if key not in _OPEN:
        _OPEN[key] = Workspace(spark, folder)
    return _OPEN[key]
