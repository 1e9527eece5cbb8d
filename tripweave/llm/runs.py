"""Periodic runs of words: stretches that repeat with a period and that no neighbouring word extends.

The first phase of a grouping suffix sorter puts the suffixes of a text into groups of one Lyndon prefix each, handling groups from the largest
to the smallest: every suffix tells the nearest earlier one of a smaller group that its prefix ends in the handled one. What it leaves
is the Lyndon array, here under the order of the words and under its reverse; a sort of the suffixes is not needed. Every
run has a Lyndon root under one of both orders. Two neighbouring roots are equal if their groups are, and a longest
common extension to both sides makes a run of them.

Before that, words that no long enough repeat covers are set aside. In a run of length L >= max(m, e * q) and period q all words
of its first L - q >= m * (1 - 1 / e) recur q words on, so each word of it lies in a sequence of that many words that
occurs twice. Stretches without such words between them hold all runs, and their neighbours extend none.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tripweave.llm.common import arrow_schema, map_texts, text_batches


def lyndon_groups(s: list[int]) -> tuple[list[int], list[int]]:
    """For each position the group of its longest Lyndon prefix (equal if the prefixes are, larger for larger ones) and that prefix's length."""
    n = len(s)
    order = sorted(range(n), key=s.__getitem__)
    place, group, size, length, previous = [0] * n, [0] * n, [0] * n, [1] * n, [-1] * n
    begin = 0
    for at, i in enumerate(order):
        place[i] = at
        if at and s[i] != s[order[at - 1]]:
            begin = at
        group[i] = begin
        size[begin] += 1

    def move(some: list[int], h: int, more: int) -> None:
        """Suffixes of group ``h`` become the group after the rest of it, with a longer prefix."""
        count, k = size[h], len(some)
        if k == count:
            length[h] += more
            return
        at = h + count
        new = at - k
        for i in some:
            at -= 1
            other, p = order[at], place[i]
            order[p], place[other] = other, p
            order[at], place[i] = i, at
            group[i] = new
        size[h], size[new], length[new] = count - k, k, length[h] + more

    end = n
    while end:
        g = group[order[end - 1]]
        if end - g == 1:
            i = order[g]
            j = i - 1
            while j >= 0 and group[j] >= g:
                j = previous[j]
            previous[i] = j
            if j >= 0:
                move([j], group[j], length[g])
        else:
            told: dict[int, int] = {}
            for i in sorted(order[g:end]):
                j = i - 1
                while j >= 0 and group[j] >= g:
                    j = previous[j]
                previous[i] = j
                if j >= 0:
                    told[j] = told.get(j, 0) + 1
            by_times: dict[int, dict[int, list[int]]] = {}
            for j, times in told.items():
                by_times.setdefault(times, {}).setdefault(group[j], []).append(j)
            for times in sorted(by_times, reverse=True):
                for h, some in by_times[times].items():
                    move(some, h, times * length[g])
        end = g
    return group, [length[g] for g in group]


def _extension(s: np.ndarray, i: int, j: int) -> int:
    """How many elements from ``i`` on equal those from ``j`` on, i < j."""
    k, step, n = 0, 64, len(s)
    while j + k < n:
        differ = s[i + k : i + k + min(step, n - j - k)] != s[j + k : j + k + step]
        if differ.any():
            return k + int(differ.argmax())
        k, step = k + len(differ), 2 * step
    return n - j


def runs_of(s: np.ndarray, least: int, exponent: int) -> set[tuple[int, int, int]]:
    """``(start, length, period)`` of the runs of at least ``least`` elements and ``exponent`` periods."""
    n, found, back = len(s), set(), s[::-1]
    for t in (s, s.max() - s):
        groups, lengths = map(np.array, lyndon_groups(t.tolist()))
        at = np.flatnonzero(np.arange(n) + lengths < n)
        p = lengths[at]
        if exponent >= 3:
            # Two whole roots follow one another; of a row of them the first is enough.
            same = groups[at] == groups[at + p]
            at, p = at[same], p[same]
            first = (at < p) | (groups[np.maximum(at - p, 0)] != groups[at])
            at, p = at[first], p[first]
        for i, q in zip(at.tolist(), p.tolist(), strict=True):
            left = _extension(back, n - i - q, n - i)
            length = left + q + _extension(s, i, i + q)
            if length >= max(least, exponent * q):
                found.add((i - left, length, q))
    return found


def stretches(s: np.ndarray, least: int, exponent: int) -> list[tuple[int, int]]:
    """Begin and end of the stretches whose elements all lie in a long enough sequence that occurs twice."""
    need, k, h = math.ceil(least * (1 - Fraction(1, exponent))), 1, s.astype(np.uint64)
    while 2 * k <= need and len(h) > k:
        # Sequences of twice as many elements; equal ones have equal numbers.
        h = h[:-k] * np.uint64(0x9E3779B97F4A7C15) + (h[k:] ^ np.uint64(0xD6E8FEB86659FD93))
        h ^= h >> np.uint64(29)
        k *= 2
    if k > need:
        return []
    order = np.argsort(h, kind="stable")
    equal = h[order[1:]] == h[order[:-1]]
    twice = np.zeros(len(h), bool)
    twice[order[1:][equal]] = twice[order[:-1][equal]] = True
    change = np.zeros(len(s) + 1, np.int64)
    change[:-k] += twice
    change[k:] -= twice
    covered = np.concatenate([[0], (np.cumsum(change[:-1]) > 0).astype(np.int8), [0]])
    edges = np.flatnonzero(np.diff(covered))
    return [(b, e) for b, e in edges.reshape(-1, 2).tolist() if e - b >= least]


def find_runs(words: list[bytes], least: int, exponent: int) -> list[tuple[int, int, int]]:
    """The runs of a sequence of words, by start and period."""
    if len(words) < least:
        return []
    number: dict[bytes, int] = {}
    s = np.array([number.setdefault(w, len(number)) for w in words], np.int64)
    found = [(b + start, length, p) for b, e in stretches(s, least, exponent) for start, length, p in runs_of(s[b:e], least, exponent)]
    return sorted(found, key=lambda r: (r[0], r[2]))


def collapse(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words without those that a run repeats after its first period."""
    if not runs:
        return words
    change = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        change[start + period] += 1
        change[start + length] -= 1
    return [w for w, drop in zip(words, np.cumsum(change[:-1]).tolist(), strict=True) if not drop]


def periodic_runs(docs: DataFrame, least: int = 24, exponent: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: the id, ``n_words``, ``runs`` (start, length, period, by start and period) and ``collapsed``.

    Words are what blanks and the characters 9 to 13 separate, numbered from 0. A run is a stretch of at least ``least`` words and ``exponent`` (2 or more)
    times its smallest period that no neighbouring word extends with that period. ``collapsed`` is the text without the words that a run contains after
    its first period, joined by one blank. Null and empty texts have no words, no runs and an empty ``collapsed``; repeated rows and null ids are documents
    of their own; other columns are ignored; an empty table gives no rows. Every document is handled whole by one task, in time
    about proportional to its words.
    """
    if exponent < 2 or least < 2:
        raise ValueError("a run has at least two words and two periods")
    run_type = T.StructType([T.StructField(n, T.LongType()) for n in ("start", "length", "period")])
    schema = T.StructType(
        [T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("n_words", T.LongType()), T.StructField("runs", T.ArrayType(run_type)), T.StructField("collapsed", T.StringType())]
    )
    arrow = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_batches(batches):
            # Of bytes, split() knows just these six characters as white space.
            split = [t.encode().split() for t in texts]
            found = [find_runs(w, least, exponent) for w in split]
            rest = [b" ".join(collapse(w, r)).decode() for w, r in zip(split, found, strict=True)]
            runs = [[{"start": a, "length": n, "period": p} for a, n, p in r] for r in found]
            columns = [batch.column(0).cast(arrow[0].type), pa.array(map(len, split), arrow[1].type), pa.array(runs, arrow[2].type), pa.array(rest, arrow[3].type)]
            yield pa.RecordBatch.from_arrays(columns, schema=arrow)

    return map_texts(docs.select(id_col, text_col), run, schema)
