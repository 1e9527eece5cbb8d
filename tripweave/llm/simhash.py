"""Near-duplicate documents by SimHash fingerprints, linked through vantage-point trees.

Distinct fingerprints are the points of a metric space under Hamming distance. The upper levels of a tree, fitted on a
bounded sample, cut the space into shards; a fingerprint belongs to one shard and asks every later shard that its
ball of the link radius reaches. Inside a shard the tree goes on in arrays: the triangle inequality drops whole branches,
and the pairs that remain are compared exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tripweave.llm.common import arrow_schema, broadcast_if_small, hashed_sample, map_texts, stored, text_batches
from tripweave.llm.components import Forest, components

#: Fingerprints compared at once, and those of a branch that is compared without further cuts.
BLOCK, BRANCH = 1 << 20, 256


def _bit_votes(hashes: np.ndarray) -> np.ndarray:
    """How many of the hashes have each bit, the highest bit first."""
    return np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)


def bits_of_most(hashes: np.ndarray, block: int = 1 << 16) -> int:
    """The number with the bits that more than half of the hashes have; 0 without any."""
    votes = np.zeros(64, np.int64)
    for at in range(0, len(hashes), block):
        votes += _bit_votes(hashes[at : at + block])
    return int.from_bytes(np.packbits(votes * 2 > len(hashes)).tobytes(), "big")


def shingle_spans(text: str, words: int) -> tuple[bytes, list[int], list[int]]:
    """The words of a text with single blanks, and where each of its shingles begins and ends there."""
    found = text.encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return b"", [], []
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
    n = max(1, len(found) - words + 1)
    return b" ".join(found), np.concatenate([[0], ends[: n - 1] + 1]).tolist(), ends[min(words, len(found)) - 1 :].tolist()


def fingerprint(text: str, words: int = 4, seed: int = 42, block: int = 1 << 16) -> int:
    """SimHash of the word shingles of a text: unsigned, 0 for a text without words.

    A-Z are lower-cased; words end at ASCII white space; shingles count as often as they occur; a text with fewer words
    is one shingle; a bit is set if more than half of the shingles' hashes have it.
    """
    whole, begins, stops = shingle_spans(text, words)
    n = len(begins)
    if not n:
        return 0
    digest = xxhash.xxh64_intdigest
    votes = np.zeros(64, np.int64)
    for at in range(0, n, block):
        votes += _bit_votes(np.array([digest(whole[b:e], seed) for b, e in zip(begins[at : at + block], stops[at : at + block], strict=True)], np.uint64))
    return int.from_bytes(np.packbits(votes * 2 > n).tobytes(), "big")


def fingerprints(docs: DataFrame, words: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id, ``text_hash`` (of the whole text) and ``fp`` (the fingerprint's bits as a signed long) of every row."""
    schema = T.StructType([docs.schema[id_col], T.StructField("text_hash", T.LongType()), T.StructField("fp", T.LongType())])
    arrow = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_batches(batches):
            fp = np.array([fingerprint(t, words) for t in texts], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(arrow[0].type), batch.column(1), pa.array(fp)], schema=arrow)

    return map_texts(docs.select(id_col, F.xxhash64(text_col), text_col), run, schema)


class Cuts:
    """The upper levels of a vantage-point tree: nodes in heap order, each a point and the distance up to which the left branch reaches."""

    def __init__(self, points: np.ndarray, radii: np.ndarray, levels: int):
        self.points, self.radii, self.levels = points, radii, levels

    @classmethod
    def fit(cls, sample: np.ndarray, levels: int) -> Cuts:
        points, radii = np.zeros(2**levels, np.uint64), np.zeros(2**levels, np.int64)
        parts = {1: sample}
        for node in range(1, 2**levels):
            part = parts.pop(node)
            if len(part):
                # Of a few points the one whose distances spread most.
                seen = [np.bitwise_count(part ^ p).astype(np.int64) for p in part[:8]]
                best = int(np.argmax([d.var() for d in seen]))
                points[node], radii[node] = part[best], int(np.median(seen[best]))
                left = seen[best] <= radii[node]
                parts[2 * node], parts[2 * node + 1] = part[left], part[~left]
            else:
                parts[2 * node] = parts[2 * node + 1] = part
        return cls(points, radii, levels)

    def deal(self, fps: np.ndarray, radius: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For each shard the positions that belong there, and those that ask there: its own and those of earlier shards in reach."""
        stack = [(1, np.arange(len(fps)), np.ones(len(fps), bool))]
        while stack:
            node, at, own = stack.pop()
            if not len(at):
                continue
            if node >= 2**self.levels:
                yield node - 2**self.levels, at[own], at
                continue
            d = np.bitwise_count(fps[at] ^ self.points[node]).astype(np.int64)
            left = d <= self.radii[node]
            # Who lives in the left branch may ask in the right one; pairs meet once, so not the other way round.
            inside = np.where(own, left, d - radius <= self.radii[node])
            outside = np.where(own, ~left | (d + radius > self.radii[node]), d + radius > self.radii[node])
            stack.append((2 * node, at[inside], own[inside]))
            stack.append((2 * node + 1, at[outside], own[outside] & ~left[outside]))


def _linked(data: np.ndarray, asks: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct points of both sets and a spanning forest of the links between them: (points, (position, root) pairs as two arrays)."""
    points = np.unique(np.concatenate([data, asks]))
    forest, order = Forest(len(points)), np.random.default_rng(0)
    stack = [(np.searchsorted(points, np.unique(data)), np.searchsorted(points, np.unique(asks)))]
    while stack:
        d, q = stack.pop()
        if not len(d) or not len(q):
            continue
        if len(d) > BRANCH:
            pivot = points[d[order.integers(len(d))]]
            dd, dq = np.bitwise_count(points[d] ^ pivot).astype(np.int64), np.bitwise_count(points[q] ^ pivot).astype(np.int64)
            cut = int(np.median(dd))
            left = dd <= cut
            if not left.all():
                stack += [(d[left], q[dq - radius <= cut]), (d[~left], q[dq + radius > cut])]
                continue
        step = max(1, BLOCK // len(d))
        for at in range(0, len(q), step):
            a = q[at : at + step]
            i, j = np.nonzero(np.bitwise_count(points[a][:, None] ^ points[d][None, :]) <= radius)
            if len(i):
                forest.join(a[i], d[j])
    node, root = forest.edges()
    return points[node], points[root]


def links(distinct: DataFrame, radius: int = 4, shard: int = 16_384, questions: int = 4_000_000, sample: int = 32_768, most_levels: int = 14) -> DataFrame:
    """Edges (a, b) that connect what links of at most ``radius`` differing bits connect, among the distinct ``fp``.

    A spanning forest per shard: no link between different fingerprints is lost for reachability, and a large group costs
    an edge per member instead of all its pairs. ``sample`` fingerprints at most, chosen by hash, place the cuts, of which there are
    2 ** ``most_levels`` at most. A shard with more than twice ``shard`` fingerprints is split into parts that all get its questions, and more than
    ``questions`` of these are split into parts that all get its fingerprints.
    """
    n = distinct.count()
    levels = min(most_levels, max(0, int(np.ceil(np.log2(max(1, n) / shard)))))
    picked = hashed_sample(distinct.select("fp"), "fp", sample, n).toArrow().column("fp").to_numpy() if levels else np.zeros(0, np.int64)
    cuts = Cuts.fit(picked.astype(np.int64).view(np.uint64), levels)

    def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(s, len(own), len(asks)) for s, own, asks in cuts.deal(batch.column(0).to_numpy().view(np.uint64), radius)]
            yield pa.RecordBatch.from_arrays([pa.array([x[c] for x in found], pa.int64()) for c in range(3)], names=["shard", "own", "asks"])

    fps = distinct.select("fp")
    counted = fps.mapInArrow(sizes, "shard long, own long, asks long").groupBy("shard").agg(F.sum("own").alias("own"), F.sum("asks").alias("asks"))
    # The numbers of those shards that need splitting, of at most 2 ** most_levels.
    parts = {r.shard: (max(1, -(-r.own // shard)), -(-r.asks // questions)) for r in counted.filter((F.col("own") > 2 * shard) | (F.col("asks") > questions)).collect()}

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column(0).to_numpy().view(np.uint64)
            rows = []
            for s, own, asks in cuts.deal(fp, radius):
                k, q = parts.get(s, (1, 1))
                data = [fp[own][fp[own] % np.uint64(k) == p].tobytes() for p in range(k)]
                asked = [fp[asks][fp[asks] % np.uint64(q) == p].tobytes() for p in range(q)]
                rows += [(s, p * q + a, x, y) for p, x in enumerate(data) for a, y in enumerate(asked)]
            shards, part, data, asked = zip(*rows, strict=True) if rows else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(shards, pa.int64()), pa.array(part, pa.int64()), pa.array(data, pa.binary()), pa.array(asked, pa.binary())], names=["shard", "part", "data", "asks"])

    def match(group: pa.Table) -> pa.Table:
        data, asks = (np.frombuffer(b"".join(group.column(c).to_pylist()), np.uint64) for c in ("data", "asks"))
        node, root = _linked(data, asks, radius)
        return pa.table({"a": node.view(np.int64), "b": root.view(np.int64)})

    return fps.mapInArrow(deal, "shard long, part long, data binary, asks binary").groupBy("shard", "part").applyInArrow(match, "a long, b long")


def groups(prints: DataFrame, radius: int = 4, id_col: str = "doc_id") -> DataFrame:
    """``fp``, ``component_id``: the smallest id over all documents that links reach from a fingerprint. ``prints`` should be stored."""
    distinct = stored(prints.groupBy("fp").agg(F.min(id_col).alias("least")), "fingerprints")
    reach = stored(components(links(distinct, radius)), "reach").withColumnRenamed("node", "fp")
    tied = distinct.join(reach, "fp")
    least = tied.groupBy("root").agg(F.min("least").alias("component_id"))
    alone = distinct.join(reach, "fp", "left_anti").select("fp", F.col("least").alias("component_id"))
    return alone.unionAll(reach.join(least, "root").select("fp", "component_id"))


def near_duplicates(docs: DataFrame, words: int = 4, radius: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: its id, ``fingerprint`` (16 hex digits) and ``component_id``.

    A null or empty text has fingerprint zero and links like any other; repeated rows are documents of their own; a null
    id is never the smallest unless all ids of a component are null; other columns are ignored; an empty table gives no rows.
    """
    prints = stored(fingerprints(docs, words, id_col, text_col), "prints")
    found = prints.join(groups(prints, radius, id_col), "fp")
    return found.select(id_col, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def drop_near_duplicates(docs: DataFrame, words: int = 4, radius: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents without near copies: of each component the one with the smallest id stays; a repeated row stays once.

    All columns are kept. A null id comes after the others; of equal ids with different texts the smaller text hash stays, of
    rows that differ in neither the smallest by all columns. Texts are read again and not stored: only the (id, text hash) of
    what goes is joined, broadcast if it is small.
    """
    prints = stored(fingerprints(docs, words, id_col, text_col).select(F.col(id_col).alias("i"), F.col("text_hash").alias("h"), "fp"), "prints")
    reach = components(links(stored(prints.select("fp").distinct(), "fingerprints"), radius))
    return keep_first(docs, prints, "fp", reach, id_col, text_col)


def keep_first(docs: DataFrame, prints: DataFrame, key: str, reach: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The documents that stay: of those whose ``key`` is equal or in one component of ``reach`` (node, root) the first.

    ``prints`` has (i, h, key) of every row: id, text hash and what is linked.
    """
    first = F.min(F.struct(F.col("i").isNull().alias("z"), "i", "h")).alias("first")
    distinct = stored(prints.groupBy(F.col(key).alias("node")).agg(first), "firsts")
    reach = stored(reach, "reach")
    # What has no links keeps its first document, a component the first of its members' first documents.
    alone = distinct.join(reach, "node", "left_anti").select("first.i", "first.h")
    together = distinct.join(reach, "node").groupBy("root").agg(F.min("first").alias("first")).select("first.i", "first.h")
    kept = alone.unionAll(together).withColumn("kept", F.lit(True))
    told = prints.groupBy("i", "h").agg(F.count("*").alias("n")).alias("p").join(kept.alias("k"), F.expr("p.i <=> k.i and p.h = k.h"), "left")
    # Everything but the documents that stay as they are.
    told = stored(told.select("p.i", "p.h", "n", F.coalesce("kept", F.lit(False)).alias("kept")).filter("not kept or n > 1"), "told")

    named = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("d"), F.col(id_col).alias("i"), F.xxhash64(text_col).alias("h"))

    def same(other: DataFrame, how: str) -> DataFrame:
        return named.alias("a").join(broadcast_if_small(other).alias("b"), F.expr("a.i <=> b.i and a.h = b.h"), how)

    out = same(told, "left_anti").select("d.*")
    repeated = told.filter("kept")
    if repeated.isEmpty():
        return out
    return out.unionByName(same(repeated, "left_semi").groupBy("i", "h").agg(F.min("d").alias("d")).select("d.*"))
