"""Zip archives of trip files as a data source: ``spark.read.format("trip_archives")``.

Archives are listed once, when the scan is planned; every member that is wanted becomes a partition. Filters on the source month and the publisher are
taken over from the query: archives of other publishers are not opened, nor are members of other months. A partition is decompressed and parsed
as a stream by one task, so the largest member sets the time of a scan; ``archives.read_trip_archives`` shares the parsing of such members
among all tasks.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import datasource as ds
from pyspark.sql import types as T

from tripweave.sources import archives

#: Columns that are the same for a whole member, which filters can prune by.
PRUNED = ("src_ym", "publisher")

_COMPARE = {
    ds.EqualTo: lambda v, x: v == x,
    ds.EqualNullSafe: lambda v, x: v == x,
    ds.GreaterThan: lambda v, x: v > x,
    ds.GreaterThanOrEqual: lambda v, x: v >= x,
    ds.LessThan: lambda v, x: v < x,
    ds.LessThanOrEqual: lambda v, x: v <= x,
    ds.In: lambda v, x: v in x,
    ds.IsNotNull: lambda v, x: True,
    ds.IsNull: lambda v, x: False,
}


def find_archives(path: str) -> list[str]:
    """Addresses of the zip files in a folder and its subfolders, or of the one file, in order; on any store Arrow knows."""
    store, name = archives.locate(path)
    found = store.get_file_info(name)
    if found.type == pafs.FileType.File:
        return [path]
    base = path.rstrip("/")
    files = store.get_file_info(pafs.FileSelector(name, recursive=True))
    inside = [f.path[len(name.rstrip("/")) :] for f in files if f.type == pafs.FileType.File and f.path.endswith(".zip")]
    return sorted(base + p for p in inside)


@dataclass
class Member(ds.InputPartition):
    """A CSV file in an archive."""

    archive: str
    member: str
    layout: int
    src_ym: int
    publisher: str
    header: str
    size: int


class TripArchives(ds.DataSource):
    """Options: ``path``, ``nameType`` (as ``name_type`` of ``choose_layout``, default 1) and ``chunkBytes``."""

    @classmethod
    def name(cls) -> str:
        return "trip_archives"

    def schema(self) -> T.StructType:
        return archives.ROW_SCHEMA

    def reader(self, schema: T.StructType) -> TripArchiveReader:
        return TripArchiveReader(self.options)


class TripArchiveReader(ds.DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.name_type = int(options.get("nameType", 1))
        self.chunk_bytes = int(options.get("chunkBytes", archives.CHUNK_BYTES))
        self.conditions: list[tuple[type, str, object]] = []
        if self.name_type not in (1, 2, 11, 22):
            raise ValueError(f"nameType must be 1, 2, 11 or 22, not {self.name_type}")

    def pushFilters(self, filters: list[ds.Filter]) -> Iterable[ds.Filter]:
        """Take over comparisons of the month and the publisher with a value; others are left to Spark."""
        for f in filters:
            column = ".".join(getattr(f, "attribute", ()))
            value = getattr(f, "value", None)
            if column in PRUNED and type(f) in _COMPARE and (value is not None or type(f) in (ds.IsNull, ds.IsNotNull)):
                self.conditions.append((type(f), column, value))
            else:
                yield f

    def _passes(self, column: str, value: object) -> bool:
        return all(_COMPARE[kind](value, x) for kind, c, x in self.conditions if c == column)

    def _listed(self, archive: str) -> list[Member]:
        publisher, opened = archives.publisher_of(archive), archives._Opened()
        if not self._passes("publisher", publisher):
            return []
        try:
            found = archives._members(archive, opened, lambda ym: self._passes("src_ym", ym))
            return [Member(archive, member, layout, ym, publisher, header, size) for member, layout, ym, size, header in found]
        finally:
            opened.close()

    def partitions(self) -> list[Member]:
        """The wanted members, largest first; of a month in two layouts the chosen one. Headers that differ within an archive's month raise."""
        with ThreadPoolExecutor(16) as pool:
            members = [m for found in pool.map(self._listed, find_archives(self.path)) for m in found]
        months: dict[tuple[str, int], list[Member]] = {}
        for m in members:
            months.setdefault((m.archive, m.src_ym), []).append(m)
        chosen, wanted = [], self.name_type % 10
        for (archive, ym), own in months.items():
            has_wanted = any(m.layout == wanted for m in own)
            if self.name_type > 2 and not has_wanted and any(m.layout for m in own):
                raise ValueError(f"no type {wanted} member for month {ym} in {archive}")
            kept = [m for m in own if m.layout in (0, wanted) or not has_wanted]
            if len({m.header for m in kept}) > 1:
                raise ValueError(f"headers differ within month {ym} of {archive}")
            chosen += kept
        return sorted(chosen, key=lambda m: (-m.size, m.archive, m.member))

    def read(self, partition: Member | None) -> Iterator[pa.RecordBatch]:
        if partition is None:
            return
        opened, provenance = archives._Opened(), {c: getattr(partition, c) for c in archives.PROVENANCE_FIELDS}
        with opened.member(partition.archive, partition.member) as stream:
            for chunk in archives.line_chunks(stream, self.chunk_bytes):
                yield from archives.raw_rows(chunk, partition.header, provenance)
        opened.close()


def scan_archives(spark: SparkSession, path: str, name_type: int = 1, chunk_bytes: int = archives.CHUNK_BYTES) -> DataFrame:
    """Raw trip rows of all zip archives under ``path``; filter it by ``src_ym`` and ``publisher`` to read these members only.

    As ``read_trip_archives`` it goes to ``normalize`` with the ``publisher`` column. The session keeps the setting that lets Spark hand filters
    to data sources in Python.
    """
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(TripArchives)
    rows = spark.read.format("trip_archives").option("nameType", str(name_type)).option("chunkBytes", str(chunk_bytes)).load(path)
    return archives.fold_raw_columns(rows)
