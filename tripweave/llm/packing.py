"""Packing documents into training sequences with a bounded number of open windows.

Every input partition packs what it reads, without a shuffle: a document's full windows stand alone, its rest goes into
the open window that it fills best; if it fits none, the fullest window is emitted and a new one is opened. What is open
at a partition's end is merged with the leftovers of other partitions.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tripweave.llm.common import arrow_schema, map_texts, stored, text_batches
from tripweave.llm.tokens import encoder

#: Pieces of a leftover window are merged in runs of at least so many tokens, which bounds the runs of a window.
RUN_TOKENS = 256

#: Leftovers of so many partitions meet in one task.
FAN_IN = 256


class Windows:
    """The open windows of one partition. Pieces are ``(row, start, length)``."""

    def __init__(self, size: int, open_windows: int):
        self.size, self.limit = size, open_windows
        self.made = 0
        self.free: list[tuple[int, int]] = []  # (free tokens, window), ascending
        self.held: dict[int, list[tuple]] = {}

    def _open(self) -> int:
        self.made += 1
        return self.made - 1

    def place(self, piece: tuple, length: int) -> Iterator[tuple[int, list[tuple]]]:
        """Put a piece of at most ``size`` tokens into a window; yields the windows that this closes."""
        if length == self.size:
            yield self._open(), [piece]
            return
        at = bisect.bisect_left(self.free, (length, -1))
        if at < len(self.free):
            free, window = self.free.pop(at)
        else:
            if len(self.free) >= self.limit:
                _, fullest = self.free.pop(0)
                yield fullest, self.held.pop(fullest)
            free, window = self.size, self._open()
            self.held[window] = []
        self.held[window].append(piece)
        if free == length:
            yield window, self.held.pop(window)
        else:
            bisect.insort(self.free, (free - length, window))

    def rest(self) -> Iterator[tuple[int, list[tuple]]]:
        yield from self.held.items()


def _runs(lengths: list[int]) -> list[tuple[int, int]]:
    """For each piece of a leftover window its run and its offset there."""
    out, run, offset = [], 0, 0
    for n in lengths:
        if offset >= RUN_TOKENS:
            run, offset = run + 1, 0
        out.append((run, offset))
        offset += n
    return out


def _pack_partition(path: str, size: int, open_windows: int, end_id: int, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, windows, end = TaskContext.get().partitionId(), Windows(size, open_windows), np.uint32(end_id).tobytes()
        ready: list[tuple] = []

        def add(window: int, pieces: list[tuple], closed: bool) -> None:
            lengths = [len(p[2]) // 4 for p in pieces]
            offsets = [(0, o) for o in np.concatenate([[0], np.cumsum(lengths)[:-1]]).tolist()] if closed else _runs(lengths)
            ready.extend((key, start, n, total, ids, part, window, item, offset, closed) for (key, start, ids, total), n, (item, offset) in zip(pieces, lengths, offsets, strict=True))

        def flush() -> pa.RecordBatch:
            rows, columns = len(ready), list(zip(*ready, strict=True)) or [()] * len(schema)
            out = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)
            assert out.num_rows == rows
            ready.clear()
            return out

        for batch, texts in text_batches(batches):
            for key, ids in zip(batch.column(0).to_pylist(), encoder(path).encode(texts), strict=True):
                ids += end
                total = len(ids) // 4
                for start in range(0, total, size):
                    piece = ids[start * 4 : (start + size) * 4]
                    for window, pieces in windows.place((key, start, piece, total), len(piece) // 4):
                        add(window, pieces, True)
                if len(ready) > 20_000:
                    yield flush()
            if ready:
                yield flush()
        for window, pieces in windows.rest():
            add(window, pieces, False)
        if ready:
            yield flush()

    return run


def _merge(size: int):
    """Best fit of leftover runs, longest first, into new windows."""

    def run(key: tuple, runs: pd.DataFrame) -> pd.DataFrame:
        runs = runs.sort_values(["tokens", "part", "window", "item"], ascending=[False, True, True, True], ignore_index=True)
        free: list[tuple[int, int]] = []
        made, number, base = 0, [], []
        for n in runs["tokens"].tolist():
            at = bisect.bisect_left(free, (n, -1))
            left, window = free.pop(at) if at < len(free) else (size, made)
            made = max(made, window + 1)
            number.append(window)
            base.append(size - left)
            if left > n:
                bisect.insort(free, (left - n, window))
        # After the last partition that has a piece in it, so no sequence comes before the place of its documents.
        last = runs["part"].groupby(np.array(number)).transform("max").to_numpy(np.int64)
        ids = (last << 32) + (1 << 31) + 2 * np.array(number, dtype=np.int64) + 1
        return pd.DataFrame({"part": runs["part"], "window": runs["window"], "item": runs["item"], "sequence_id": ids, "base": np.array(base, dtype=np.int64)})

    return run


def in_stored_order(docs: DataFrame) -> DataFrame:
    """The rows of an ordered table that was written to Parquet, again in that order over partitions and within them.

    Spark deals files to tasks by size. Their names have the number of the task that wrote them and, with a limit of rows a file,
    a count of its files; with the row's position in the file these restore the order. A frame that is not read from Parquet files
    raises, for its order would be lost in silence.
    """
    try:
        placed = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_doc"), F.col("_metadata.file_name").alias("_file"), F.col("_metadata.row_index").alias("_at"))
    except AnalysisException as e:
        raise ValueError("the order of rows is known for tables read from Parquet files only") from e
    number = [F.regexp_extract("_file", pattern, 1).try_cast("long") for pattern in (r"^part-(\d+)", r"-c(\d+)\.")]
    return placed.orderBy(*number, "_file", "_at").select("_doc.*")


def pack(docs: DataFrame, tokenizer: str, size: int = 4096, open_windows: int = 64, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Sequences of at most ``size`` tokens that hold every token of every document exactly once.

    One row per piece: the id column, ``start`` (tokens of its document before it), ``length``, ``doc_tokens``, ``ids``
    (little-endian unsigned 32-bit token ids), ``sequence_id`` and ``offset``. Each row of ``docs`` is a document of its
    own, repeated rows and null ids too; a null or empty text is the end id alone. Other columns are ignored. An empty
    table gives no pieces. Documents of up to ``size`` tokens stay whole, longer ones are cut at multiples of it.
    """
    schema = T.StructType(
        [T.StructField(id_col, docs.schema[id_col].dataType)]
        + [T.StructField(n, T.LongType()) for n in ("start", "length", "doc_tokens")]
        + [T.StructField("ids", T.BinaryType())]
        + [T.StructField(n, T.LongType()) for n in ("part", "window", "item", "offset")]
        + [T.StructField("closed", T.BooleanType())]
    )
    run = _pack_partition(tokenizer, size, open_windows, end_id, arrow_schema(schema))
    pieces = stored(map_texts(docs.select(id_col, text_col), run, schema), "pieces")
    own = [id_col, "start", "length", "doc_tokens", "ids"]
    closed = pieces.filter("closed").select(*own, (F.shiftleft("part", 32) + 2 * F.col("window")).alias("sequence_id"), "offset")
    left = pieces.filter("not closed")
    merged = (
        left.groupBy("part", "window", "item")
        .agg(F.sum("length").alias("tokens"))
        .groupBy(F.floor(F.col("part") / FAN_IN).alias("group"))
        .applyInPandas(_merge(size), "part long, window long, item long, sequence_id long, base long")
    )
    rest = left.join(merged, ["part", "window", "item"]).select(*own, "sequence_id", (F.col("base") + F.col("offset")).alias("offset"))
    return closed.unionByName(rest)
