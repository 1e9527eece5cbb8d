"""Zip archives of raw trips, written by Spark tasks, for checking the archive reader."""

from __future__ import annotations

import calendar
import uuid
import zipfile
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyarrow import compute as pc
from pyarrow import csv as pacsv
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HEADERS = {
    "ride_id": "ride_id",
    "rideable_type": "rideable_type",
    "started_at": "started_at",
    "ended_at": "ended_at",
    "start_station_name": "start_station_name",
    "start_station_id": "start_station_id",
    "end_station_name": "end_station_name",
    "end_station_id": "end_station_id",
    "start_lat": "start_lat",
    "start_lng": "start_lng",
    "end_lat": "end_lat",
    "end_lng": "end_lng",
    "member_casual": "member_casual",
}


def as_text(raw: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Raw columns as the text a published file would hold, under its headers."""
    return raw.select(*[F.col(f"`{c}`").cast("string").alias(h) for c, h in columns.items()])


def _placed(raw: DataFrame, length: int) -> DataFrame:
    """Raw rows as text with the first ``length`` digits of their start month, dealt out by these: a month or year of many rows to several tasks."""
    names = list(HEADERS)
    text = as_text(raw.select(*[f"`{c}`" for c in names]), HEADERS)
    digits = F.substring(F.regexp_replace("started_at", "-", ""), 1, length)
    return text.select(F.coalesce(digits, F.lit("None")).alias("_period"), *names).hint("rebalance", "_period")


def _runs(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, pa.RecordBatch]]:
    """Stretches of rows with equal values in the first ``keys`` columns: the values, and the other columns of these rows."""
    for batch in batches:
        bounds = {0, batch.num_rows}
        for i in range(keys):
            column = batch.column(i)
            bounds.update((pc.indices_nonzero(pc.not_equal(column.slice(1), column.slice(0, max(0, len(column) - 1)))).to_numpy() + 1).tolist())
        names, cuts = batch.schema.names[keys:], sorted(bounds)
        for start, stop in zip(cuts, cuts[1:]):
            yield tuple(batch.column(i)[start].as_py() for i in range(keys)), batch.slice(start, stop - start).select(names)


def write_monthly_archives(raw: DataFrame, folder: str) -> DataFrame:
    """One archive per start month and task; gives the paths as it writes.

    Months are dealt out by their size, so that the number of tasks, and not their size, grows with the rows. Rows stream into the archive batch by
    batch, and a repeated task writes the same file. Every other archive holds its CSV inside an archive of its own.
    """
    sorted_rows = _placed(raw, 6).sortWithinPartitions("_period", *HEADERS)
    store, root = pafs.FileSystem.from_uri(folder if "://" in folder else f"file://{folder}")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store.create_dir(root, recursive=True)
        number = TaskContext.get().partitionId()
        for i, ((ym,), group) in enumerate(groupby(_runs(batches, 1), key=lambda r: r[0])):
            name, rows = f"{ym}-trips_{number}.csv", (r[1] for r in group)
            partial = f"{root}/.{ym}-{number}-{uuid.uuid4().hex}"
            with store.open_output_stream(partial) as out, zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
                if (number + i) % 2:
                    with z.open(f"{name}.zip", "w") as inner, zipfile.ZipFile(inner, "w", zipfile.ZIP_DEFLATED) as y:
                        _write_csv(y, name, rows)
                else:
                    _write_csv(z, name, rows)
            store.move(partial, f"{root}/{ym}-trips-{number}.zip")
            yield pa.RecordBatch.from_pydict({"path": [f"{folder}/{ym}-trips-{number}.zip"]})

    return sorted_rows.mapInArrow(write, "path string")


def write_yearly_archives(raw: DataFrame, folder: str, parts: int = 2) -> DataFrame:
    """One archive per start year and task, with every month of its rows twice: in numbered parts in a folder of its own, and as one file; gives the paths as it writes."""
    part = F.pmod(F.xxhash64("ride_id"), F.lit(parts)).cast("int") + 1
    twice = _placed(raw, 4).withColumn("_part", F.explode(F.array(F.lit(0), part)))
    placed = twice.select("_period", F.substring("started_at", 6, 2).alias("_m"), "_part", *HEADERS)
    sorted_rows = placed.sortWithinPartitions("_period", "_m", "_part", *HEADERS)
    store, root = pafs.FileSystem.from_uri(folder if "://" in folder else f"file://{folder}")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store.create_dir(root, recursive=True)
        number = TaskContext.get().partitionId()
        for year, months in groupby(_runs(batches, 3), key=lambda r: r[0][0]):
            partial = f"{root}/.{year}-{number}-{uuid.uuid4().hex}"
            with store.open_output_stream(partial) as out, zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
                for (_, month, layout), group in groupby(months, key=lambda r: r[0]):
                    name = f"{year}{month}-trips"
                    path = f"{int(month)}_{calendar.month_name[int(month)]}/{name}_{layout}.csv" if layout else f"{name}.csv"
                    _write_csv(z, f"{year}-trips/{path}", (r[1] for r in group))
            store.move(partial, f"{root}/{year}-trips-{number}.zip")
            yield pa.RecordBatch.from_pydict({"path": [f"{folder}/{year}-trips-{number}.zip"]})

    return sorted_rows.mapInArrow(write, "path string")


def _write_csv(files: zipfile.ZipFile, name: str, batches: Iterator[pa.RecordBatch]) -> None:
    with files.open(name, "w") as member:
        member.write((",".join(HEADERS) + "\n").encode())
        for rows in batches:
            lines = pa.BufferOutputStream()
            pacsv.write_csv(rows, lines, pacsv.WriteOptions(include_header=False))
            member.write(lines.getvalue())
