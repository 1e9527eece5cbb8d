"""Language-model scores by context-tree weighting over bytes.

A text is its token sequence: words with A-Z lower-cased, a blank between them and a newline as the end. Every byte is coded by
eight binary decisions; each decision has a context tree over the bytes before it. A node predicts by its
Krichevsky-Trofimov estimate, and the weighting mixes the estimates of all depths by how well the nodes code the training
texts.

The tree's counts grow with the corpus and are never in one place. Input partitions count grams (context and byte) and words in
blocks of documents; the counts of a unit, which is a sixteenth of the contexts with the same last byte, meet in one task;
the levels above are bounded by the alphabet. Each block then asks the units for the log-probabilities of just its own grams.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tripweave.llm.common import arrow_schema, fold, map_texts, stored, text_batches

#: Bytes of context. A gram is these, nearest first, and the byte itself; the first is the unit's, the rest the key there.
DEPTH = 5

#: Units of a last byte, by the byte before.
UNIT_BITS = 4

#: Characters of a block; it bounds what the task that scores a block holds.
BLOCK_CHARS = 32_000_000

#: Words are counted in so many parts, which follow the units in numbering.
WORD_PARTS, WORD_UNIT = 256, 1 << 16

#: Counts of so many blocks meet at once.
FAN_IN = 2048

_ZSTD = "zstd"

KEY_BITS, KEY_MASK = np.uint64(8 * DEPTH), np.uint64((1 << 8 * DEPTH) - 1)


def _packed(data: bytes) -> bytes:
    return len(data).to_bytes(8, "little") + pa.compress(data, _ZSTD, asbytes=True)


def _unpacked(data: bytes) -> bytes:
    return pa.decompress(data[8:], int.from_bytes(data[:8], "little"), _ZSTD, asbytes=True)


def _array(data: bytes, kind: str) -> np.ndarray:
    return np.frombuffer(_unpacked(data), kind)


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").lower().split()


def grams_of(sequences: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The gram of every byte of the sequences, and where each sequence begins among them."""
    pad = b"\n" * DEPTH
    data = np.frombuffer(b"".join([x for s in sequences for x in (pad, s)]), np.uint8)
    n = np.fromiter(map(len, sequences), np.int64, len(sequences))
    begins = np.concatenate([[0], np.cumsum(n)[:-1]])
    wide = data.astype(np.uint64)
    grams = wide[DEPTH:].copy()
    for d in range(1, DEPTH + 1):
        grams |= wide[DEPTH - d : len(wide) - d] << np.uint64(8 * (DEPTH + 1 - d))
    # Without what belongs to the padding of the next sequence.
    own = np.ones(len(grams), bool)
    at = (begins + n + DEPTH * np.arange(len(n)))[:-1]
    for d in range(DEPTH):
        own[at + d] = False
    return grams[own], begins


# ---------------------------------------------------------------- the tree


def _log_gamma(x: np.ndarray) -> np.ndarray:
    """Stirling's series after shifting small arguments up."""
    shift, z = np.zeros_like(x), x.copy()
    for _ in range(8):
        small = z < 8
        if not small.any():
            break
        shift[small] += np.log(z[small])
        z[small] += 1
    return (z - 0.5) * np.log(z) - z + 0.5 * math.log(2 * math.pi) + 1 / (12 * z) - 1 / (360 * z**3) + 1 / (1260 * z**5) - shift


def log_estimate(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    """Log of the Krichevsky-Trofimov probability of a sequence with these counts."""
    return _log_gamma(n0 + 0.5) + _log_gamma(n1 + 0.5) - _log_gamma(n0 + n1 + 1.0) - math.log(math.pi)


class Subtree:
    """The binary trees of all contexts of two bytes or more of one unit, from its grams' keys (sorted, distinct) and training counts."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray):
        self.keys, deep = keys, DEPTH - 2
        symbol, context = self.keys & np.uint64(255), self.keys >> np.uint64(8)
        self.symbol, self.levels = symbol.astype(np.int64), []
        for d in range(deep, -1, -1):
            at = (context >> np.uint64(8 * (deep - d))) << np.uint64(8) | symbol
            rows, of = np.unique(at, return_inverse=True)
            n = np.bincount(of, weights=counts, minlength=len(rows))
            bits = []
            for b in range(8):
                node = rows >> np.uint64(8 - b)
                new = np.concatenate([[True], node[1:] != node[:-1]])
                first, number = np.flatnonzero(new), np.cumsum(new) - 1
                one = ((rows >> np.uint64(7 - b)) & np.uint64(1)).astype(bool)
                n1 = np.add.reduceat(np.where(one, n, 0.0), first)
                n0 = np.add.reduceat(n, first) - n1
                bits.append((number[of], one[of], n0, n1, log_estimate(n0, n1)))
            self.levels.append(bits)
        # Weighted probabilities from the deepest contexts up; the log-ratio of stopping at a node against going on.
        self.ratio: list[list[np.ndarray]] = []
        self.weighted: list[np.ndarray] = []
        for b in range(8):
            ratios, below, child = [], None, None
            for bits in self.levels:
                node, _, _, _, own = bits[b]
                if below is None:
                    weighted = own
                else:
                    # A gram of each child names the child's parent.
                    some = np.zeros(len(below), np.int64)
                    some[child] = np.arange(len(child))
                    split = np.bincount(node[some], weights=below, minlength=len(own))
                    ratios.append(own - split)
                    weighted = np.logaddexp(own, split) - math.log(2)
                below, child = weighted, node
            self.ratio.append(ratios)
            self.weighted.append(below)

    def summary(self) -> np.ndarray:
        """Over the unit's contexts of two bytes, for each of 256 node numbers the sums of zeros, ones and log weighted probabilities."""
        out = np.zeros((3, 256))
        for b in range(8):
            node, _, n0, n1, _ = self.levels[-1][b]
            number = np.zeros(len(n0), np.int64)
            number[node] = (1 << b) | (self.symbol >> (8 - b))
            for row, x in zip(out, (n0, n1, self.weighted[b]), strict=True):
                row += np.bincount(number, weights=x, minlength=256)
        return out

    def log10(self, above: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> np.ndarray:
        """Log10-probability of each gram's byte in its context. ``above``: zeros, ones and log-ratio by node number of the contexts of one byte and of none.

        Contexts that training never reached say nothing: the mix is over the others, and the longest of them starts it.
        """
        total = np.zeros(len(self.keys))
        for b in range(8):
            mix, seen = np.full(len(self.keys), 0.5), np.zeros(len(self.keys), bool)
            one = self.levels[0][b][1]
            steps = [(n0[node], n1[node], None if d == 0 else self.ratio[b][d - 1][node]) for d, (node, _, n0, n1, _) in enumerate(bits[b] for bits in self.levels)]
            number = (1 << b) | (self.symbol >> (8 - b))
            steps += [(n0[number], n1[number], r[number]) for n0, n1, r in above]
            for n0, n1, ratio in steps:
                n = n0 + n1
                here = (np.where(one, n1, n0) + 0.5) / (n + 1)
                if ratio is not None:
                    deeper = 1 / (1 + np.exp(np.clip(ratio, -60, 60)))
                    here = np.where(seen, (1 - deeper) * here + deeper * mix, here)
                mix = np.where(n > 0, here, mix)
                seen |= n > 0
            total += np.log10(mix)
        return total


def upper(summaries: dict[int, np.ndarray]) -> dict[int, list[tuple[np.ndarray, np.ndarray, np.ndarray]]]:
    """By last byte, the ``above`` of its units, from the sums of the units' summaries by last byte: at most 256."""
    root = np.zeros((3, 256))
    ones = {}
    for c, s in summaries.items():
        own = log_estimate(s[0], s[1])
        ones[c] = (s[0], s[1], own - s[2])
        root += np.stack([s[0], s[1], np.logaddexp(own, s[2]) - math.log(2)])
    top = (root[0], root[1], log_estimate(root[0], root[1]) - root[2])
    return {c: [x, top] for c, x in ones.items()}


# ---------------------------------------------------------------- the jobs


class _Block:
    """Counts of one block of documents."""

    def __init__(self, number: int):
        self.number, self.chars = number, 0
        self.grams, self.counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.words: Counter[bytes] = Counter()
        self.seen: set[bytes] = set()

    def add(self, sequences: list[bytes], words: list[list[bytes]], learn: list[bool]) -> None:
        for teach in (True, False):
            some = [s for s, x in zip(sequences, learn, strict=True) if x == teach]
            if some:
                g, n = np.unique(grams_of(some)[0], return_counts=True)
                both, at = np.unique(np.concatenate([self.grams, g]), return_inverse=True)
                self.counts = np.bincount(at, weights=np.concatenate([self.counts, n if teach else np.zeros_like(n)]), minlength=len(both)).astype(np.int64)
                self.grams = both
        for w, teach in zip(words, learn, strict=True):
            (self.words if teach else self.seen).update(w)
        self.chars += sum(map(len, sequences))

    def rows(self) -> Iterator[tuple]:
        """(unit, keys, counts) for the grams of each unit and the words of each part."""
        unit = (self.grams >> KEY_BITS << np.uint64(UNIT_BITS) | self.grams >> (KEY_BITS - np.uint64(8)) & np.uint64((1 << UNIT_BITS) - 1)).astype(np.int64)
        order = np.argsort(unit, kind="stable")
        unit, keys, counts = unit[order], (self.grams & KEY_MASK)[order], self.counts[order]
        edges = [*np.flatnonzero(np.diff(unit, prepend=-1)).tolist(), len(unit)]
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            yield int(unit[a]), _packed(keys[a:b].astype("<u8").tobytes()), _packed(counts[a:b].astype("<u4").tobytes())
        parts: list[list[bytes]] = [[] for _ in range(WORD_PARTS)]
        for w in self.words.keys() | self.seen:
            parts[zlib.crc32(w) % WORD_PARTS].append(w)
        for p, found in enumerate(parts):
            if found:
                found.sort()
                yield WORD_UNIT + p, _packed(b"\n".join(found)), _packed(np.array([self.words.get(w, 0) for w in found], "<u4").tobytes())


def _count(schema: pa.Schema):
    """Rows of chunks of documents (``unit`` null) and rows of counts, by block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, made = TaskContext.get().partitionId(), 0
        block = _Block(part << 24)

        def counts() -> Iterator[pa.RecordBatch]:
            rows = list(block.rows())
            for at in range(0, len(rows), 256):
                unit, keys, n = zip(*rows[at : at + 256], strict=True)
                k = len(unit)
                yield pa.RecordBatch.from_arrays([pa.array([block.number] * k, pa.int64()), pa.array(unit, pa.int64()), pa.array(keys, pa.binary()), pa.array(n, pa.binary()), pa.nulls(k, schema.field("docs").type), pa.nulls(k, pa.binary())], schema=schema)

        for batch, texts in text_batches(batches):
            words = [words_of(t) for t in texts]
            sequences = [b" ".join(w) + b"\n" for w in words]
            block.add(sequences, words, [not h for h in batch.column(1).to_pylist()])
            docs = pa.array([pa.StructArray.from_arrays([batch.column(0), batch.column(1)], fields=list(schema.field("docs").type.value_type)).to_pylist()], schema.field("docs").type)
            yield pa.RecordBatch.from_arrays([pa.array([block.number]), pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), pa.nulls(1, pa.binary()), docs, pa.array([_packed(b"".join(sequences))])], schema=schema)
            if block.chars >= BLOCK_CHARS:
                yield from counts()
                made += 1
                block = _Block((part << 24) + made)
        yield from counts()

    return run


def _sum(unit: int, keys: list[bytes], counts: list[bytes]) -> tuple[bytes, bytes, np.ndarray | list[bytes], np.ndarray]:
    """The counts of a unit over several blocks: packed, and as arrays."""
    if unit >= WORD_UNIT:
        total: Counter[bytes] = Counter()
        for k, c in zip(keys, counts, strict=True):
            for w, n in zip(_unpacked(k).split(b"\n"), _array(c, "<u4").tolist(), strict=True):
                total[w] += n
        found = sorted(total)
        n = np.array([total[w] for w in found], "<u8")
        return _packed(b"\n".join(found)), _packed(n.tobytes()), found, n
    k = np.concatenate([_array(x, "<u8") for x in keys])
    both, at = np.unique(k, return_inverse=True)
    n = np.bincount(at, weights=np.concatenate([_array(x, "<u4") for x in counts]), minlength=len(both)).astype("<u8")
    return _packed(both.astype("<u8").tobytes()), _packed(n.tobytes()), both, n


def _merge(group: pa.Table) -> pa.Table:
    """Counts of the blocks of one unit; still packed as blocks are."""
    unit = group.column("unit")[0].as_py()
    keys, _, _, n = _sum(unit, group.column("keys").to_pylist(), group.column("counts").to_pylist())
    if len(n) and n.max() >= 1 << 32:
        raise OverflowError("a count is over 32 bits")
    return pa.table({"unit": pa.array([unit], pa.int64()), "keys": pa.array([keys], pa.binary()), "counts": pa.array([_packed(n.astype("<u4").tobytes())], pa.binary())})


def _finish(group: pa.Table) -> pa.Table:
    """The whole counts of one unit, with the summary of its tree, or with the tokens and distinct words of its part."""
    unit = group.column("unit")[0].as_py()
    keys, counts, k, n = _sum(unit, group.column("keys").to_pylist(), group.column("counts").to_pylist())
    words = unit >= WORD_UNIT
    summary = None if words else Subtree(k, n.astype(float)).summary().tobytes()
    return pa.table(
        {
            "unit": pa.array([unit], pa.int64()),
            "keys": pa.array([keys], pa.binary()),
            "counts": pa.array([counts], pa.binary()),
            "summary": pa.array([summary], pa.binary()),
            "tokens": pa.array([int(n.sum()) if words else 0], pa.int64()),
            "types": pa.array([int((n > 0).sum()) if words else 0], pa.int64()),
        }
    )


def _add_up(group: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(s, float).reshape(3, 256) for s in group.column("summary").to_pylist())
    return pa.table({"last": pa.array([group.column("last")[0].as_py()], pa.int64()), "summary": pa.array([total.tobytes()], pa.binary())})


def _values(top: dict[int, list]):
    """Log-probabilities of a unit's grams (float32), or the counts of its words (uint64)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for unit, keys, counts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if unit < WORD_UNIT:
                    tree = Subtree(_array(keys, "<u8"), _array(counts, "<u8").astype(float))
                    counts = _packed(tree.log10(top[unit >> UNIT_BITS]).astype("<f4").tobytes())
                out.append(counts)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.binary())], names=["unit", "keys", "vals"])

    return run


def _answer(asked: pa.Table, known: pa.Table) -> pa.Table:
    """For each block its keys of a unit with their values."""
    blocks, out, keys = asked.column("block").to_pylist(), [], asked.column("keys").to_pylist()
    unit = asked.column("unit")[0].as_py() if blocks else 0
    if blocks and unit >= WORD_UNIT:
        value = dict(zip(_unpacked(known.column("keys")[0].as_py()).split(b"\n"), _array(known.column("vals")[0].as_py(), "<u8").tolist(), strict=True))
        out = [_packed(np.array([value[w] for w in _unpacked(k).split(b"\n")], "<u8").tobytes()) for k in keys]
    elif blocks:
        all_keys, value = _array(known.column("keys")[0].as_py(), "<u8"), _array(known.column("vals")[0].as_py(), "<f4")
        out = [_packed(value[np.searchsorted(all_keys, _array(k, "<u8"))].tobytes()) for k in keys]
    return pa.table({"block": pa.array(blocks, pa.int64()), "unit": pa.array([unit] * len(blocks), pa.int64()), "keys": pa.array(keys, pa.binary()), "vals": pa.array(out, pa.binary())})


class _Lookup:
    """Values of distinct 48-bit keys, found through a table over their leading bits."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        size = max(4, int(np.ceil(np.log2(2 * max(1, len(keys))))))
        self.shift, self.mask = np.uint64(64 - size), (1 << size) - 1
        self.keys, self.values = np.full(1 << size, np.uint64(1 << 63)), np.zeros(1 << size, values.dtype)
        left, at = np.arange(len(keys)), self._slot(keys)
        while len(left):
            free = self.keys[at] == np.uint64(1 << 63)
            self.keys[at[free]] = keys[left[free]]
            won = self.keys[at] == keys[left]
            self.values[at[won]] = values[left[won]]
            left, at = left[~won], (at[~won] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        at = self._slot(keys)
        out, miss = self.values[at], np.flatnonzero(self.keys[at] != keys)
        at = at[miss]
        while len(miss):
            at = (at + 1) & self.mask
            out[miss] = self.values[at]
            wrong = self.keys[at] != keys[miss]
            miss, at = miss[wrong], at[wrong]
        return out


def _score(tokens: int, types: int, ends: int, schema: pa.Schema):
    """The documents of a block with their scores."""
    unknown = math.log10(tokens + types + 1)

    def run(key: tuple, chunks: pa.Table, answers: pa.Table) -> pa.Table:
        counts: dict[bytes, int] = {}
        keys, values = [np.zeros(0, np.uint64)], [np.zeros(0, "<f4")]
        for unit, k, v in zip(*(answers.column(c).to_pylist() for c in ("unit", "keys", "vals")), strict=True):
            if unit >= WORD_UNIT:
                counts.update(zip(_unpacked(k).split(b"\n"), _array(v, "<u8").tolist(), strict=True))
            else:
                keys.append(_array(k, "<u8") | np.uint64(unit >> UNIT_BITS) << KEY_BITS)
                values.append(_array(v, "<f4"))
        value = _Lookup(np.concatenate(keys), np.concatenate(values))
        out = []
        for docs, packed in zip(chunks.column("docs").to_pylist(), chunks.column("texts").to_pylist(), strict=True):
            sequences = _unpacked(packed).split(b"\n")[:-1]
            for at in range(0, len(docs), 4096):
                some = [s + b"\n" for s in sequences[at : at + 4096]]
                grams, begins = grams_of(some)
                score = np.add.reduceat(value(grams).astype(float), begins)
                for doc, s, q in zip(docs[at : at + 4096], some, score.tolist(), strict=True):
                    n = np.array([counts[w] for w in s[:-1].split(b" ")] if len(s) > 1 else [], float)
                    base = float(np.log10(n + 1).sum()) + math.log10(ends + 1) - (len(n) + 1) * unknown
                    out.append((doc["id"], doc["held_out"], len(n) + 1, int((n > 0).sum()) + (ends > 0), tokens, base, q, -q / math.log10(2) / len(s)))
        columns = list(zip(*out, strict=True)) or [()] * len(schema)
        return pa.table([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    return run


def score_texts(docs: DataFrame, held_out: Column | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: the id, ``held_out``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score``, ``score``, ``bits_per_byte``.

    ``score`` is the model's log10-probability of the whole token sequence and ``bits_per_byte`` its code length; ``base_score`` that of
    single words with add-one counts. The model learns from the rows that are not ``held_out`` (by default the remainder 2 of the id's
    CRC-32 by 7; a null counts as false). A null or empty text is the end alone; repeated rows are documents of their own;
    other columns are ignored; without training rows every byte has probability 1/256; an empty table gives no rows.
    """
    held = F.coalesce(held_out if held_out is not None else fold(id_col, 7) == 2, F.lit(False))
    id_type = docs.schema[id_col].dataType
    doc = T.StructType([T.StructField("id", id_type), T.StructField("held_out", T.BooleanType())])
    counted = T.StructType(
        [T.StructField(n, T.LongType()) for n in ("block", "unit")] + [T.StructField(n, T.BinaryType()) for n in ("keys", "counts")] + [T.StructField("docs", T.ArrayType(doc)), T.StructField("texts", T.BinaryType())]
    )
    texts = docs.select(F.col(id_col).alias("id"), held.alias("held_out"), F.col(text_col).alias("text"))
    rows = stored(map_texts(texts, _count(arrow_schema(counted)), counted), "counted")
    asked = rows.filter("unit is not null").select("block", "unit", "keys", "counts")
    ends = rows.filter("unit is null").select(F.coalesce(F.sum(F.size(F.filter("docs", lambda d: ~d["held_out"]))), F.lit(0))).first()[0]

    # The counts of a unit meet in rounds, each over a bounded number of blocks.
    salts = -(-rows.select("block").distinct().count() // FAN_IN)
    merged, level = asked, salts
    salt = F.pmod(F.xxhash64("block"), F.lit(max(1, salts)))
    if salts > 1:
        merged = merged.withColumn("salt", salt)
    while level > 1:
        step = merged.groupBy("unit", "salt").applyInArrow(lambda k, t: _merge(t).append_column("salt", pa.array([k[1].as_py()], pa.int64())), "unit long, keys binary, counts binary, salt long")
        level = -(-level // FAN_IN)
        merged = stored(step.withColumn("salt", F.pmod("salt", F.lit(level))), "merged")
    whole = stored(merged.select("unit", "keys", "counts").groupBy("unit").applyInArrow(_finish, "unit long, keys binary, counts binary, summary binary, tokens long, types long"), "units")
    tokens, types = whole.agg(F.coalesce(F.sum("tokens"), F.lit(0)), F.coalesce(F.sum("types"), F.lit(0))).first()
    tokens, types = tokens + ends, types + (ends > 0)

    # One row for each last byte, 256 at most.
    by_last = whole.filter("summary is not null").select(F.shiftright("unit", UNIT_BITS).alias("last"), "summary").groupBy("last").applyInArrow(_add_up, "last long, summary binary")
    top = upper({r.last: np.frombuffer(r.summary, float).reshape(3, 256) for r in by_last.collect()})

    known = whole.select("unit", "keys", "counts").mapInArrow(_values(top), "unit long, keys binary, vals binary")
    known = known.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(max(1, salts) - 1).cast("long"))))
    answers = asked.select("block", "unit", "keys", salt.alias("salt")).groupBy("unit", "salt").cogroup(known.groupBy("unit", "salt")).applyInArrow(_answer, "block long, unit long, keys binary, vals binary")

    out = T.StructType(
        [T.StructField(id_col, id_type), T.StructField("held_out", T.BooleanType())]
        + [T.StructField(n, T.LongType()) for n in ("n_tokens", "n_known", "train_tokens")]
        + [T.StructField(n, T.DoubleType()) for n in ("base_score", "score", "bits_per_byte")]
    )
    chunks = rows.filter("unit is null").select("block", "docs", "texts")
    return chunks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_score(tokens, types, ends, arrow_schema(out)), out)
