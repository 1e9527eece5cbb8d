"""Zip archives of trip files, listed and read on the executors, from any store that Arrow can open.

Listing and reading are maps over ordinary DataFrames. The listing opens archives in parallel and emits one row per CSV
member. A member can only be decompressed from its start, so one task streams it, once, and cuts it into chunks of whole
lines; the chunks are dealt out evenly and parsed by all tasks, so a member that holds a third of all bytes keeps one task
busy with decompression only. No task holds a member in memory, and nothing passes through the driver.
"""

from __future__ import annotations

import calendar
import csv
import io
import re
import shutil
import zipfile
from collections.abc import Callable, Iterator
from contextlib import ExitStack

import pandas as pd
import pyarrow as pa
from pyarrow import csv as pacsv
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tripweave.functions import codes
from tripweave.schema import RIDE_COLUMNS
from tripweave.sources.csv import NULL_MARKER, NULL_TEXTS
from tripweave.sources.headers import canonical_name, unexpected_headers

#: Bytes of a chunk, before decompression ends; what one read task streams, and what one parse task gets, about.
CHUNK_BYTES = 8 << 20
READ_BYTES, PARSE_BYTES = 1 << 30, 128 << 20

#: A nested archive up to this size is unpacked in memory; a larger one is read through the outer one, from its start for each step back.
NESTED_BYTES = 256 << 20

# A nested archive is addressed as ``outer member!inner member``.
NESTED = "!"

#: What a raw row can hold, all as text: the ride columns a file can have and the member/casual variant.
RAW_FIELDS = [c for c in RIDE_COLUMNS if not c.endswith("_region")] + ["member_casual"]
PROVENANCE_FIELDS = ["archive", "member", "src_ym", "publisher"]

# What an absent column means.
DEFAULTS = {"gender": "0", "rideable_type": "unknown"}

MEMBER_SCHEMA = T.StructType(
    [
        T.StructField("archive", T.StringType()),
        T.StructField("member", T.StringType()),
        T.StructField("layout", T.IntegerType()),
        T.StructField("src_ym", T.IntegerType()),
        T.StructField("publisher", T.StringType()),
        T.StructField("header", T.StringType()),
        T.StructField("unexpected", T.ArrayType(T.StringType())),
        T.StructField("size", T.LongType()),
    ]
)
ROW_SCHEMA = T.StructType(
    [T.StructField(c, T.StringType()) for c in RAW_FIELDS]
    + [
        T.StructField("archive", T.StringType()),
        T.StructField("member", T.StringType()),
        T.StructField("src_ym", T.IntegerType()),
        T.StructField("publisher", T.StringType()),
    ]
)


def locate(path: str) -> tuple[pafs.FileSystem, str]:
    """The store of an address and the name there: plain paths and file:, s3: (also s3a:), gs:, hdfs: and abfs: addresses."""
    if not re.match(r"^[a-z][a-z0-9+.-]*:/", path):
        return pafs.LocalFileSystem(), path
    return pafs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", re.sub(r"^s3[an]:", "s3:", path)))


def open_file(path: str) -> pa.NativeFile:
    """A seekable file of any store Arrow knows."""
    store, name = locate(path)
    return store.open_input_file(name)


def split_header(line: str) -> list[str]:
    """Fields of a header line."""
    return next(csv.reader([line]))


class _Opened:
    """The archive, and the archive inside it, that a task reads from; both stay open while their members follow one another."""

    def __init__(self):
        self._stack, self._names, self._zip = ExitStack(), (None, None), None

    def _enter(self, archive: str, nested: str | None) -> zipfile.ZipFile:
        if self._names != (archive, nested):
            self.close()
            found = self._stack.enter_context(zipfile.ZipFile(self._stack.enter_context(open_file(archive))))
            if nested is not None:
                inner = self._stack.enter_context(found.open(nested))
                if found.getinfo(nested).file_size <= NESTED_BYTES:
                    copy = io.BytesIO()
                    shutil.copyfileobj(inner, copy, 1 << 20)
                    copy.seek(0)
                    inner = copy
                found = self._stack.enter_context(zipfile.ZipFile(inner))
            self._names, self._zip = (archive, nested), found
        return self._zip

    def archive(self, path: str, nested: str | None = None) -> zipfile.ZipFile:
        return self._enter(path, nested)

    def member(self, archive: str, member: str) -> io.BufferedIOBase:
        """Stream of a member, from its start."""
        nested, mark, name = member.partition(NESTED)
        return self._enter(archive, nested if mark else None).open(name if mark else member)

    def close(self) -> None:
        self._stack.close()
        self._stack, self._names, self._zip = ExitStack(), (None, None), None


def member_layout(member: str) -> int:
    """1 for a member in a month directory or with a part number, 2 for one file per month, 0 for others.

    Only members of whole-year archives come in two layouts that repeat each other.
    """
    months = "|".join(f"{i}_{calendar.month_name[i]}" for i in range(1, 13))
    if re.search(rf"/(?:{months})/[^/]*_\d+\.csv$", member):
        return 1
    return 2 if re.fullmatch(r"[^/]+/\d{6}[^/]*\.csv", member) else 0


def _archive_year(archive: str) -> int | None:
    """Year of a whole-year archive, None for a monthly one."""
    found = re.search(r"(?:^|/)(\d{4})(?!\d)[^/]*$", archive)
    return int(found[1]) if found else None


def _member_month(*names: str) -> int:
    """``yyyymm`` from the first of the names that has one, else 0."""
    found = [re.search(r"(?:^|/)(?:JC-)?(\d{4})(0[1-9]|1[0-2])(?!\d)", n) for n in names]
    return next((int(m[1] + m[2]) for m in found if m), 0)


def publisher_of(archive: str) -> str:
    """Who published an archive, by its name."""
    return "JC" if archive.rsplit("/", 1)[-1].startswith("JC-") else "NYC"


def _members(archive: str, opened: _Opened, wanted: Callable[[int], bool] = lambda ym: True) -> Iterator[tuple[str, int, int, int, str]]:
    """(member, layout, month, size, header) of the CSVs of an archive, of wanted months only; no other member is opened.

    Whole-year archives hold plain CSVs in one of two layouts up to 2019 and one archive per month after.
    Monthly archives hold plain CSVs or, if there are none, archives of CSVs. Members whose path starts with an
    underscore are resource forks.
    """
    year = _archive_year(archive)

    def header(files: zipfile.ZipFile, name: str) -> str:
        with files.open(name) as stream:
            return stream.readline().decode("utf-8-sig").strip()

    outer = opened.archive(archive)
    infos = [i for i in outer.infolist() if not i.filename.startswith("_")]
    plain = [i for i in infos if i.filename.endswith(".csv")]
    nested = [i.filename for i in infos if i.filename.endswith(".zip") and not i.filename.rsplit("/", 1)[-1].startswith("_")]
    if year is not None:
        plain = [] if year >= 2020 else [i for i in plain if member_layout(i.filename)]
    for info in plain:
        layout, ym = member_layout(info.filename) if year is not None else 0, _member_month(info.filename, archive)
        if wanted(ym):
            yield info.filename, layout, ym, info.file_size, header(outer, info.filename)
    if plain:
        return
    for name in nested:
        inner = opened.archive(archive, name)
        for part in inner.infolist():
            if part.filename.endswith(".csv") and not part.filename.startswith("_") and wanted(ym := _member_month(part.filename, name, archive)):
                yield f"{name}{NESTED}{part.filename}", 0, ym, part.file_size, header(inner, part.filename)


def list_members(archives: DataFrame) -> DataFrame:
    """The CSV members of ``archives`` (a frame with a ``path`` column): month, publisher (from the file name), header line, layout and size."""

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        opened = _Opened()
        for batch in batches:
            for path in batch["path"]:
                publisher = publisher_of(path)
                rows = [(path, member, layout, ym, publisher, header, unexpected_headers(split_header(header)), size) for member, layout, ym, size, header in _members(path, opened)]
                yield pd.DataFrame(rows, columns=MEMBER_SCHEMA.fieldNames())
        opened.close()

    return archives.select("path").mapInPandas(scan, MEMBER_SCHEMA)


def check_months(members: DataFrame, months: tuple[int, int], publisher: str | None = None) -> None:
    """Action: fail if no archive holds a source month of the half-open range; ``publisher`` looks at that one's archives only."""
    rows = members if publisher is None else members.where(F.col("publisher") == publisher)
    found = {r.src_ym for r in rows.select("src_ym").distinct().collect()}
    wanted = [y * 100 + m for y in range(months[0] // 100, months[1] // 100 + 1) for m in range(1, 13) if months[0] <= y * 100 + m < months[1]]
    if missing := [ym for ym in wanted if ym not in found]:
        raise FileNotFoundError(f"no archive has a member for {', '.join(map(str, missing))}")


def _archive_month() -> WindowSpec:
    """A window over the listing keeps it to one pass; it holds the byte ranges of one month of one archive."""
    return Window.partitionBy("archive", "src_ym")


def choose_layout(members: DataFrame, name_type: int = 1) -> DataFrame:
    """Of a month that an archive holds in two layouts, keep one.

    1 prefers numbered parts in month directories, 2 prefers one file per month; 11 and 22 require theirs and
    fail the query for a month that has only the other.
    """
    if name_type not in (1, 2, 11, 22):
        raise ValueError(f"name_type must be 1, 2, 11 or 22, not {name_type}")
    wanted = name_type % 10
    has_wanted = F.max(F.col("layout") == wanted).over(_archive_month())
    tagged = members.withColumn("_has", has_wanted)
    if name_type > 2:
        message = F.concat_ws(" ", F.lit(f"no type {wanted} member for month"), F.col("src_ym").cast("string"), F.lit("in"), "archive")
        missing = (F.col("layout") > 0) & ~F.col("_has")
        tagged = tagged.where(F.when(missing, F.raise_error(message)).otherwise(F.lit(True)))
    return tagged.where(F.col("layout").isin(0, wanted) | ~F.col("_has")).select(members.columns)


def header_mismatches(members: DataFrame) -> DataFrame:
    """Archive months whose members do not share one header."""
    return members.groupBy("archive", "src_ym").agg(F.count_distinct("header").alias("n_headers")).where(F.col("n_headers") > 1)


def check_headers(members: DataFrame) -> DataFrame:
    """The same members; the query fails if an archive month has more than one header."""
    differ = F.min("header").over(_archive_month()) != F.max("header").over(_archive_month())
    message = F.concat_ws(" ", F.lit("headers differ within month"), F.col("src_ym").cast("string"), F.lit("of"), "archive")
    tagged = members.withColumn("_differ", differ)
    return tagged.where(F.when(F.col("_differ"), F.raise_error(message)).otherwise(F.lit(True))).select(members.columns)


def line_chunks(stream: io.BufferedIOBase, size: int) -> Iterator[bytes]:
    """The lines of a stream after its first, in pieces of at least ``size`` bytes (the last may be shorter) that end with a line."""
    stream.readline()
    while block := stream.read(size):
        if not block.endswith(b"\n"):
            block += stream.readline()
        yield block


def _parse(chunk: bytes, header: str) -> Iterator[pa.RecordBatch]:
    names = split_header(header)
    convert = pacsv.ConvertOptions(
        column_types={n: pa.string() for n in names},
        null_values=[*NULL_TEXTS, NULL_MARKER],
        strings_can_be_null=True,
        quoted_strings_can_be_null=True,
    )
    if chunk.strip():
        yield from pacsv.open_csv(pa.BufferReader(chunk), read_options=pacsv.ReadOptions(column_names=names), convert_options=convert)


def raw_rows(chunk: bytes, header: str, provenance: dict) -> Iterator[pa.RecordBatch]:
    """The lines of a chunk as rows of ``ROW_SCHEMA``."""
    schema = pa.schema([(f.name, pa.int32() if f.name == "src_ym" else pa.string()) for f in ROW_SCHEMA.fields])
    for rows in _parse(chunk, header):
        found = {canonical_name(n): rows.column(i) for i, n in enumerate(rows.schema.names) if canonical_name(n)}
        # Eras without these columns mean the default, eras with them may still have nulls.
        constant = provenance | {c: v for c, v in DEFAULTS.items() if c not in found}
        columns = []
        for field in schema:
            if field.name in constant:
                columns.append(pa.repeat(pa.scalar(constant[field.name], field.type), rows.num_rows))
            else:
                columns.append(found[field.name] if field.name in found else pa.nulls(rows.num_rows, field.type))
        yield pa.RecordBatch.from_arrays(columns, schema=schema)


def read_members(members: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Rows of the listed members as text columns with canonical names, plus provenance.

    Every member is decompressed once, members of one nested archive by the same task. The numbers of read and parse tasks follow
    from the listed bytes, for which the listing is run once more.
    """
    total, count = members.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("*")).first()
    readers = max(1, min(count, -(-total // READ_BYTES) + members.sparkSession.sparkContext.defaultParallelism))
    parsers = max(1, -(-total // PARSE_BYTES))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened = _Opened()
        for batch in batches:
            for m in batch.to_pylist():
                with opened.member(m["archive"], m["member"]) as stream:
                    for chunk in line_chunks(stream, chunk_bytes):
                        yield pa.RecordBatch.from_pydict({**{c: [m[c]] for c in batch.schema.names}, "chunk": [chunk]}, schema=batch.schema.append(pa.field("chunk", pa.binary())))
        opened.close()

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for m in batch.to_pylist():
                yield from raw_rows(m["chunk"], m["header"], {c: m[c] for c in PROVENANCE_FIELDS})

    listed = members.select("archive", "member", "src_ym", "publisher", "header")
    together = listed.repartition(readers, "archive", F.substring_index("member", NESTED, 1)).sortWithinPartitions("archive", "member")
    chunks = together.mapInArrow(cut, T.StructType([*listed.schema.fields, T.StructField("chunk", T.BinaryType())]))
    return chunks.repartition(parsers).mapInArrow(parse, ROW_SCHEMA)


def read_trip_archives(
    spark: SparkSession,
    path: str,
    name_type: int = 1,
    months: tuple[int, int] | None = None,
    chunk_bytes: int = CHUNK_BYTES,
    require: bool = False,
) -> DataFrame:
    """Raw trip rows of all zip archives under ``path`` (a folder or glob).

    ``months`` is a half-open range of source months; ``require`` fails if one of them is in no archive. Feed the result to ``normalize``
    with the ``publisher`` column and ``keep=["src_ym", ...]``. Member/casual and user type are both present as columns here, so
    they are folded into one.
    """
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").option("recursiveFileLookup", True).load(path)
    members = choose_layout(list_members(found.select("path")), name_type)
    if months:
        members = members.where((F.col("src_ym") >= months[0]) & (F.col("src_ym") < months[1]))
        if require:
            check_months(members, months)
    rows = read_members(check_headers(members), chunk_bytes)
    return fold_raw_columns(rows)


def fold_raw_columns(rows: DataFrame) -> DataFrame:
    """Archive rows of all eras in the form ``normalize`` takes, with one user type."""
    user = F.coalesce(codes.member_casual(F.col("member_casual")), F.col("user_type"))
    return rows.withColumn("user_type", user).drop("member_casual")
