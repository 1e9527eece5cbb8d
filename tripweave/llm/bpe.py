"""Byte-level BPE by merge ranks: whole texts to token ids and back to bytes.

A text is cut into pre-tokens by a pattern and every pre-token is merged on its own. Merging keeps its tokens in a linked list and
the pairs that could merge in a bucket per rank, which holds positions of that list. A bitmap of three levels marks the
buckets in use, so the smallest rank is found by the first set bit of three words, whatever the length of the
pre-token. Entries that a neighbour's merge made stale stay in their bucket and are skipped when it is read.
"""

from __future__ import annotations

import array
import base64
import re
from collections.abc import Callable, Iterator, Sequence
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tripweave.llm.common import arrow_schema, map_texts, text_batches

#: Pre-tokens of more bytes keep their positions in arrays of four bytes each.
LONG = 4096

#: Matches of a pattern that are held at once.
MATCHES = 200_000


def read_ranks(path: str) -> dict[bytes, int]:
    """Rank of each token from lines of a base64 token and its rank."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


class RankQueue:
    """Buckets of positions by rank and a bitmap of three levels over them; a word has 64 bits."""

    def __init__(self, ranks: int):
        self.leaf = [0] * ((ranks >> 6) + 1)
        self.middle = [0] * ((ranks >> 12) + 1)
        self.top = 0
        self.buckets: dict[int, list[int] | array.array] = {}

    def push(self, rank: int, bucket: list[int] | array.array) -> None:
        """Open the bucket of a rank that has none."""
        self.buckets[rank] = bucket
        j = rank >> 6
        word = self.leaf[j]
        self.leaf[j] = word | 1 << (rank & 63)
        if not word:
            self.middle[j >> 6] |= 1 << (j & 63)
            self.top |= 1 << (j >> 6)

    def pop(self) -> int:
        """The smallest rank that has a bucket, no longer marked; -1 if none has. Its bucket is the caller's to take."""
        top = self.top
        if not top:
            return -1
        i = (top & -top).bit_length() - 1
        word = self.middle[i]
        j = (i << 6) + (word & -word).bit_length() - 1
        word = self.leaf[j]
        rest = word & (word - 1)
        self.leaf[j] = rest
        if not rest:
            rest = self.middle[i]
            rest = self.middle[i] = rest & (rest - 1)
            if not rest:
                self.top = top & (top - 1)
        return (j << 6) + (word & -word).bit_length() - 1


class _Recent(dict):
    """What a function gives for a key, kept for the latest keys: a full memory becomes the old one, whose keys move over when they are asked for."""

    def __init__(self, make: Callable[[str], bytes], most: int):
        super().__init__()
        self.make, self.most, self.old = make, most, {}

    def __missing__(self, key: str) -> bytes:
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value


#: What the pattern of the public rank files means for characters below U+0250, where classes are settled ranges.
_BELOW = re.compile("[\0-\u024f]*")
_LETTER, _NUMBER, _SPACE = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u024f", "0-9\xb2\xb3\xb9\xbc-\xbe", "\t-\r \x85\xa0"
_PLAIN_PATTERNS = {
    r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+""": re.compile(
        f"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LETTER}]+| ?[{_NUMBER}]+| ?[^{_SPACE}{_LETTER}{_NUMBER}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+"
    )
}


class Codec:
    """Encoding and decoding by a table of ranks, with a bounded memory of pre-tokens."""

    def __init__(self, path: str, pattern: str, memory: int = 600_000):
        self.ranks = read_ranks(path)
        self.tokens: list[bytes | None] = [None] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            self.tokens[rank] = token
        self.queue = RankQueue(len(self.tokens))
        self.pattern, self.plain = regex.compile(pattern), _PLAIN_PATTERNS.get(pattern)
        self.known = _Recent(lambda p: array.array("i", self.merge(p.encode())).tobytes(), memory)

    def merge(self, piece: bytes) -> Sequence[int]:
        """Ids of one pre-token: the pair of the smallest rank merges first, the leftmost of equal ones."""
        ranks, n = self.ranks, len(piece)
        whole = ranks.get(piece)
        if whole is not None:
            return (whole,)
        make = list if n <= LONG else lambda x: array.array("i", x)
        # Token i begins at byte i and ends where the next one begins; rank_at is that of the pair it begins.
        after, before, rank_at = make(range(1, n + 1)), make(range(-1, n - 1)), make([-1]) * n
        queue, get = self.queue, ranks.get
        buckets, push, pop = queue.buckets, queue.push, queue.pop
        for i in range(n - 1):
            r = get(piece[i : i + 2])
            if r is not None:
                rank_at[i] = r
                if r in buckets:
                    buckets[r].append(i)
                else:
                    push(r, make((i,)))
        while (rank := pop()) >= 0:
            entries = buckets.pop(rank)
            if len(entries) > 1:
                entries = sorted(entries)
            for at, i in enumerate(entries, 1):
                if rank_at[i] != rank:
                    continue
                # The pair becomes one token; the pairs that it begins and ends change.
                j = after[i]
                end = after[i] = after[j]
                rank_at[i] = rank_at[j] = -1
                lower = False
                if end < n:
                    before[end] = i
                    r = get(piece[i : after[end]])
                    if r is not None:
                        rank_at[i] = r
                        lower = r < rank
                        if r in buckets:
                            buckets[r].append(i)
                        else:
                            push(r, make((i,)))
                h = before[i]
                if h >= 0:
                    r = get(piece[h:end])
                    rank_at[h] = -1 if r is None else r
                    if r is not None:
                        lower = lower or r < rank
                        if r in buckets:
                            buckets[r].append(h)
                        else:
                            push(r, make((h,)))
                if lower and at < len(entries):
                    # A smaller rank came up: what is left of this one waits. None of this rank came up, being longer.
                    push(rank, make(entries[at:]))
                    break
        out, i = make(()), 0
        while i < n:
            out.append(ranks[piece[i : after[i]]])
            i = after[i]
        return out

    def encode(self, text: str) -> bytes:
        """Ids of a whole text as 32-bit numbers of this machine's byte order."""
        # Text without characters from U+0250 on is cut by the faster module, with ranges for classes.
        cut = self.plain if self.plain and (text.isascii() or _BELOW.fullmatch(text)) else self.pattern
        if len(text) <= 4 * MATCHES:
            return b"".join(map(self.known.__getitem__, cut.findall(text)))
        found, out = (m[0] for m in cut.finditer(text)), []
        while some := list(islice(found, MATCHES)):
            out.append(b"".join(map(self.known.__getitem__, some)))
        return b"".join(out)

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


@lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> Codec:
    """The codec of a file, one per Python worker."""
    return Codec(path, pattern)


def encode_texts(docs: DataFrame, ranks: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id column and ``ids``: the token ids of every whole text, without special tokens, whose strings are ordinary text.

    Every match of ``pattern`` is merged by itself; what no match covers is left out, as in the library that the rank files are for.
    A null or empty text has no ids; repeated rows and null ids are documents of their own; other columns are ignored;
    an empty table gives no rows. ``ranks`` is a path that every executor can read, of a file with all single bytes.
    """
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("ids", T.ArrayType(T.IntegerType()))])
    arrow = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = codec(ranks, pattern).encode
        for batch, texts in text_batches(batches):
            found = list(map(encode, texts))
            ends = np.cumsum([0, *(len(x) // 4 for x in found)]).astype(np.int32)
            ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(found), np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(arrow[0].type), ids.cast(arrow[1].type)], schema=arrow)

    return map_texts(docs.select(id_col, text_col), run, schema)


def decode_ids(encoded: DataFrame, ranks: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """The id column, the ids and ``bytes``: what the ids stand for. Null ids have null bytes; no ids have none; unknown ids fail."""
    fields = [encoded.schema[id_col], encoded.schema[ids_col], T.StructField("bytes", T.BinaryType())]
    schema = T.StructType(fields)
    arrow = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decode = codec(ranks, pattern).decode
        for batch in batches:
            ids = batch.column(1)
            ends, flat, null = ids.offsets.to_numpy(), ids.values.to_numpy(), ids.is_null().to_pylist()
            found = [None if null[i] else decode(flat[a:b].tolist()) for i, (a, b) in enumerate(zip(ends[:-1], ends[1:], strict=True))]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(arrow[0].type), batch.column(1).cast(arrow[1].type), pa.array(found, arrow[2].type)], schema=arrow)

    return map_texts(encoded.select(id_col, ids_col), run, schema)
