"""Nearest neighbours by largest inner product through robust-pruned directed graphs, one per shard.

A shard's graph grows in batches: a greedy search from the entry point proposes neighbours, and of these an edge is kept only if no kept
neighbour is nearer to its end by the factor alpha, which leaves few but diverse edges. Queries run a beam search in every shard; what it
returns is ranked by the exact measure. Inner products become distances by one more coordinate that gives all vectors of a shard one norm.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tripweave.llm.common import stored
from tripweave.llm.vectors import matrix, takes_part


def beam_search(x: np.ndarray, graph: np.ndarray, queries: np.ndarray, entry: int, beam: int) -> np.ndarray:
    """For each query the ``beam`` nearest points that a best-first walk meets, nearest first; -1 where there are fewer."""
    b, n = len(queries), len(x)
    norm = (x * x).sum(axis=1)
    ids, dist = np.full((b, beam), -1, np.int64), np.full((b, beam), np.inf)
    open_, met = np.zeros((b, beam), bool), np.zeros((b, n + 1), bool)
    ids[:, 0], open_[:, 0], met[:, entry], met[:, n] = entry, True, True, True
    dist[:, 0] = norm[entry] - 2 * (queries @ x[entry])
    active = np.arange(b)
    while len(active):
        at = np.where(open_[active], dist[active], np.inf).argmin(axis=1)
        going = open_[active, at]
        active, at = active[going], at[going]
        if not len(active):
            break
        open_[active, at] = False
        near = graph[ids[active, at]]
        near = np.where(near < 0, n, near)
        new = ~met[active[:, None], near]
        met[active[:, None], near] = True
        near = np.where(new, near, 0)
        d = norm[near] - 2 * np.matmul(x[near], queries[active][:, :, None])[:, :, 0]
        d = np.where(new, d, np.inf)
        all_d = np.hstack([dist[active], d])
        order = np.argpartition(all_d, beam - 1, axis=1)[:, :beam]
        take = lambda a, c, o=order: np.take_along_axis(np.hstack([a[active], c]), o, axis=1)
        ids[active], open_[active] = take(ids, near), take(open_, new)
        dist[active] = np.take_along_axis(all_d, order, axis=1)
    order = np.argsort(dist, axis=1, kind="stable")
    return np.where(np.take_along_axis(dist, order, axis=1) < np.inf, np.take_along_axis(ids, order, axis=1), -1)


def robust_prune(x: np.ndarray, points: np.ndarray, candidates: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """Of each point's candidates (-1: none; no repeats) at most ``degree`` diverse neighbours, -1 where there are fewer."""
    out = np.full((len(points), degree), -1, np.int64)
    c = np.where(candidates < 0, 0, candidates)
    v = x[c]
    to_point = ((v - x[points][:, None, :]) ** 2).sum(axis=2)
    norm = (v * v).sum(axis=2)
    between = norm[:, :, None] + norm[:, None, :] - 2 * np.matmul(v, v.transpose(0, 2, 1))
    left = (candidates >= 0) & (candidates != points[:, None])
    rows = np.arange(len(points))
    for k in range(degree):
        d = np.where(left, to_point, np.inf)
        best = d.argmin(axis=1)
        some = left[rows, best]
        if not some.any():
            break
        out[some, k] = c[rows, best][some]
        left &= ~((alpha * alpha * between[rows, best] <= to_point) & some[:, None])
        left[rows, best] = False
    return out


def build_graph(x: np.ndarray, degree: int = 32, beam: int = 64, alpha: float = 1.2, batch: int = 512, seed: int = 0) -> tuple[np.ndarray, int]:
    """Neighbours of each of the distinct points, -1 where there are fewer than ``degree``, and the entry point."""
    n, rng = len(x), np.random.default_rng(seed)
    entry = int(((x - x.mean(axis=0)) ** 2).sum(axis=1).argmin())
    graph = np.full((n, degree), -1, np.int64)
    order = rng.permutation(n)
    order = np.concatenate([[entry], order[order != entry]])
    done = 1
    while done < n:
        points = order[done : done + min(done, batch)]
        found = beam_search(x, graph, x[points], entry, beam)
        # The points of a batch do not meet in the graph yet; the nearest of them are proposed too.
        norm = (x[points] ** 2).sum(axis=1)
        inside = norm[None, :] - 2 * (x[points] @ x[points].T)
        np.fill_diagonal(inside, np.inf)
        few = min(16, len(points) - 1)
        peers = points[np.argpartition(inside, few - 1, axis=1)[:, :few]] if few > 0 else np.zeros((len(points), 0), np.int64)
        graph[points] = robust_prune(x, points, np.hstack([found, peers]), degree, alpha)
        source, target = np.repeat(points, degree), graph[points].ravel()
        source, target = source[target >= 0], target[target >= 0]
        at = np.argsort(target, kind="stable")
        source, target = source[at], target[at]
        ends, first, counts = np.unique(target, return_index=True, return_counts=True)
        # Back edges; points with as many new ones are handled together.
        wide = 1 << np.ceil(np.log2(counts)).astype(int)
        for w in np.unique(wide).tolist():
            for part in np.array_split(np.flatnonzero(wide == w), max(1, int((wide == w).sum()) * (degree + w) ** 2 // 4_000_000)):
                if not len(part):
                    continue
                new = np.full((len(part), w), -1, np.int64)
                for k in range(w):
                    has = counts[part] > k
                    new[has, k] = source[first[part[has]] + k]
                old = graph[ends[part]]
                new = np.where((new[:, :, None] == old[:, None, :]).any(axis=2), -1, new)
                both = np.hstack([old, new])
                full = (both >= 0).sum(axis=1) > degree
                if full.any():
                    graph[ends[part[full]]] = robust_prune(x, ends[part[full]], both[full], degree, alpha)
                if (~full).any():
                    some = both[~full]
                    some = np.take_along_axis(some, np.argsort(some < 0, axis=1, kind="stable"), axis=1)
                    graph[ends[part[~full]]] = some[:, :degree]
        done += len(points)
    return graph, entry


def _blob(a: np.ndarray, kind: str) -> bytes:
    return np.ascontiguousarray(a, kind).tobytes()


def _index(degree: int, beam: int, alpha: float, keep: int):
    """Distinct vectors of a shard with their smallest ids, and their graph: one row."""

    def run(key: tuple, group: pa.Table) -> pa.Table:
        ids: dict[bytes, list[int]] = {}
        for v, some in zip(group.column("vector").to_pylist(), group.column("ids").to_pylist(), strict=True):
            ids.setdefault(v, []).extend(some)
        vectors = np.frombuffer(b"".join(ids), "<f8").reshape(len(ids), -1)
        own = [sorted(i)[:keep] for i in ids.values()]
        graph, entry = build_graph(_lifted(vectors), degree, beam, alpha)
        return pa.table(
            {
                "dim": pa.array([key[0].as_py()], pa.int32()),
                "shard": pa.array([key[1].as_py()], pa.int64()),
                "vectors": pa.array([_blob(vectors, "<f8")], pa.binary()),
                "ids": pa.array([own], pa.list_(pa.list_(pa.int64()))),
                "graph": pa.array([_blob(graph, "<i4")], pa.binary()),
                "entry": pa.array([entry], pa.int64()),
            }
        )

    return run


def _lifted(vectors: np.ndarray) -> np.ndarray:
    """All of a shard with norm 1, inner products to lifted queries in the order of those to queries.

    The shard's own longest vector is the measure, so that a very long one squeezes no other shard.
    """
    x = vectors / np.abs(vectors).max()
    x /= np.sqrt((x * x).sum(axis=1).max()) * (1 + 1e-9)
    return np.hstack([x, np.sqrt(np.maximum(0, 1 - (x * x).sum(axis=1, keepdims=True)))])


def _fitting_beam(x: np.ndarray, graph: np.ndarray, queries: np.ndarray, entry: int, beam: int, k: int, recall: float) -> int:
    """The beam, doubled until it finds the share ``recall`` of the ``k`` nearest of some queries, which a whole scan tells."""
    width, k = min(beam, len(x)), min(k, len(x))
    scores = queries @ x.T
    least = np.partition(scores, len(x) - k, axis=1)[:, len(x) - k, None]
    while width < len(x):
        found = beam_search(x, graph, queries, entry, width)
        near = np.take_along_axis(scores, np.maximum(found, 0), axis=1)
        if ((near >= least) & (found >= 0)).sum(axis=1).clip(max=k).mean() >= recall * k:
            break
        width = min(2 * width, len(x))
    return width


def _ask(k: int, degree: int, beam: int, recall: float, probes: int = 48):
    """The ``k`` nearest of a shard for each query, by the exact measure; ties to the smaller id."""

    def run(index: pa.Table, asked: pa.Table) -> pa.Table:
        out: list[tuple[int, int, float]] = []
        if index.num_rows and asked.num_rows:
            dim = index.column("dim")[0].as_py()
            vectors = np.frombuffer(index.column("vectors")[0].as_py(), "<f8").reshape(-1, dim)
            graph = np.frombuffer(index.column("graph")[0].as_py(), "<i4").reshape(-1, degree).astype(np.int64)
            ids, entry, x = index.column("ids")[0].as_py(), index.column("entry")[0].as_py(), _lifted(vectors)
            queries = np.frombuffer(b"".join(asked.column("vector").to_pylist()), "<f8").reshape(-1, dim)
            names = asked.column("query_id").to_pylist()
            scaled = queries / np.maximum(np.abs(queries).max(axis=1, keepdims=True), 1e-300)
            scaled = np.hstack([scaled, np.zeros((len(scaled), 1))])
            width = _fitting_beam(x, graph, scaled[:: -(-len(scaled) // probes)], entry, beam, k + 1, recall)
            step = max(1, min(256, 32_000_000 // max(len(x), 4 * width)))
            for at in range(0, len(queries), step):
                some = queries[at : at + step]
                found = beam_search(x, graph, scaled[at : at + step], entry, width)
                for name, q, near in zip(names[at : at + step], some, found, strict=True):
                    near = near[near >= 0]
                    scores = (vectors[near] * q).sum(axis=1).tolist()
                    best = sorted((-s, i) for s, c in zip(scores, near.tolist(), strict=True) for i in ids[c] if i != name)[:k]
                    out += [(name, i, -s) for s, i in best]
        names, found, scores = zip(*out, strict=True) if out else ((), (), ())
        return pa.table({"query_id": pa.array(names, pa.int64()), "vec_id": pa.array(found, pa.int64()), "score": pa.array(scores, pa.float64())})

    return run


def nearest(
    vectors: DataFrame, queries: DataFrame, k: int = 20, shard: int = 8192, most: int = 65_536, degree: int = 32, build_beam: int = 64, search_beam: int = 160, recall: float = 0.98, alpha: float = 1.2, part: int = 16_384, id_col: str = "vec_id", vector_col: str = "embedding"
) -> DataFrame:
    """``query_id``, ``rank`` (from 1), the id and ``score``: for each query the ``k`` nearest other vectors found, all if there are fewer.

    Nearness is the largest inner product in double precision; ties go to the smaller id. ``queries`` has the same columns; a vector with a query's id is the
    query's own. Vectors that are null, zero or hold a null or non-finite component take no part, nor do rows with a null id; only vectors of one
    length are compared. Equal vectors are one point of a graph; it keeps their ``k + 1`` smallest ids, and no other of them can be among
    the nearest. Repeated rows of a query are one query. Other columns are ignored; an empty table gives no rows.

    Every vector is indexed: shards are dealt by the vectors' hashes, one task builds one of about ``shard``; tables of more than 64 shards get larger
    ones, up to ``most``. Every query searches every shard, in parts of ``part`` queries. The beam starts at ``search_beam`` and is doubled per shard and part
    until 48 of the queries find the share ``recall`` of their nearest in the shard: vectors of very uneven length need a wider one.
    """

    def rows(df: DataFrame) -> DataFrame:
        return df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v")).filter(F.col("id").isNotNull() & takes_part("v"))

    points = rows(vectors)
    n = points.count()
    asked_n = rows(queries).count()
    shards, parts = max(1, -(-n // max(shard, min(most, n // 64)))), max(1, -(-asked_n // part))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids: dict[bytes, list[int]] = {}
            for i, v in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                # Adding zero makes -0.0 and 0.0 the same bytes.
                ids.setdefault((v.values.to_numpy() + 0.0).astype("<f8").tobytes(), []).append(i)
            own = [sorted(x)[: k + 1] for x in ids.values()]
            yield pa.RecordBatch.from_arrays(
                [pa.array([len(v) // 8 for v in ids], pa.int32()), pa.array([zlib.crc32(v) % shards for v in ids], pa.int64()), pa.array(list(ids), pa.binary()), pa.array(own, pa.list_(pa.int64()))], names=["dim", "shard", "vector", "ids"]
            )

    dealt = points.mapInArrow(deal, "dim int, shard long, vector binary, ids array<long>")
    index = stored(dealt.groupBy("dim", "shard").applyInArrow(_index(degree, build_beam, alpha, k + 1), "dim int, shard long, vectors binary, ids array<array<long>>, graph binary, entry long"), "index")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packed = [(matrix(batch.column(1).slice(i, 1))[0]).astype("<f8").tobytes() for i in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(v) // 8 for v in packed], pa.int32()), pa.array(packed, pa.binary())], names=["query_id", "dim", "vector"])

    asked = rows(queries).dropDuplicates(["id"]).mapInArrow(pack, "query_id long, dim int, vector binary")
    asked = asked.withColumn("part", F.pmod(F.xxhash64("query_id"), F.lit(parts))).withColumn("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))))
    spread = index.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))))
    found = spread.groupBy("dim", "shard", "part").cogroup(asked.groupBy("dim", "shard", "part")).applyInArrow(_ask(k, degree, search_beam, recall), "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    best = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return best.select("query_id", "rank", F.col("vec_id").alias(id_col), "score")
