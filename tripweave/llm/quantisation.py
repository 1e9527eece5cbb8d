"""Near-duplicate vectors by iterative quantisation and multi-index Hamming tables.

Rotations learned on a bounded sample turn vectors into balanced binary codes. The code is cut into substrings, each a table of
its own: vectors that share a substring meet in a bucket and are compared there by their original vectors. Equal vectors are
one point with a number of copies. A pair counts only in the first table in which it meets, so links can be counted
without listing pairs; buckets that are too large for a task are cut into blocks, and all pairs of blocks are compared.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripweave.llm.common import hashed_sample, stored
from tripweave.llm.components import Forest, components
from tripweave.llm.vectors import matrix, takes_part


#: Bits of a substring at most; and roughly, for planning, what it takes to move a vector to a bucket and to multiply and add once there.
MAX_BITS, MOVE_SECONDS, MULTIPLY_SECONDS = 32, 1e-5, 1e-10


def _unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def rotations(sample: np.ndarray, bits: int, rounds: int = 30, seed: int = 0, centre: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Mean (zero unless ``centre``) and projection (dim x bits) of normalised vectors: as many rotations as the bits need, each learned from its own start.

    A rotation alternates between the nearest binary codes and the orthogonal matrix that best maps the centred principal
    components to them. Without a sample of more vectors than dimensions the rotations stay random.
    """
    dim = sample.shape[1]
    mean = sample.mean(axis=0) if centre and len(sample) else np.zeros(dim)
    centred, rng, out = sample - mean, np.random.default_rng(seed), []
    axes = np.linalg.svd(centred.T @ centred)[0] if len(sample) else np.eye(dim)
    v = centred @ axes
    for _ in range(-(-bits // dim)):
        r = np.linalg.qr(rng.standard_normal((dim, dim)))[0]
        for _ in range(rounds if len(sample) > dim else 0):
            left, _, right = np.linalg.svd(np.where(v @ r >= 0, 1.0, -1.0).T @ v)
            r = (left @ right).T
        out.append(axes @ r)
    return mean, np.hstack(out)[:, :bits]


def flip_shares(sample: np.ndarray, mean: np.ndarray, projection: np.ndarray, cosine: float, pairs: int = 2000, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Shares of bits that differ, for pairs at the threshold and for random pairs of the sample, in the space that is coded.

    The first are vectors of the sample and copies turned to a cosine of exactly the threshold: half towards any direction, half
    towards other vectors of the sample.
    """
    rng, (n, dim) = np.random.default_rng(seed), sample.shape
    x = sample[rng.integers(0, n, pairs)]
    to = np.where(np.arange(pairs)[:, None] % 2 == 0, rng.standard_normal((pairs, dim)), sample[rng.integers(0, n, pairs)] - x + 1e-9 * rng.standard_normal((pairs, dim)))
    to -= (to * x).sum(axis=1, keepdims=True) * x
    length = np.sqrt((to * to).sum(axis=1, keepdims=True))
    y = cosine * x + math.sqrt(max(0.0, 1 - cosine * cosine)) * to / np.maximum(length, 1e-300)
    bits = [(v - mean) @ projection >= 0 for v in (x, y, x[rng.permutation(pairs)])]
    return (bits[0] != bits[1]).mean(axis=1), (bits[0] != bits[2]).mean(axis=1)


def tables_needed(flips: np.ndarray, width: int, miss: float = 0.001, most: int = 4096) -> int:
    """Tables of ``width`` bits, so that pairs with these shares of flipped bits miss all with probability ``miss`` on the average."""
    apart = np.log1p(-np.minimum((1 - flips) ** width, 1 - 1e-12))
    low, high = 1, most
    if np.exp(most * apart).mean() > miss:
        raise ValueError(f"{width} bits need more than {most} tables")
    while low < high:
        tables = (low + high) // 2
        low, high = (low, tables) if np.exp(tables * apart).mean() <= miss else (tables + 1, high)
    return low


def plan_tables(n: int, flips: np.ndarray, random_flips: np.ndarray, dim: int = 64, miss: float = 0.001) -> tuple[float, int, int]:
    """Cost, bits of a substring and number of tables of the cheapest plan that misses at most ``miss`` of the pairs at the threshold.

    A table costs a move of every vector and a comparison of all pairs that share a substring, whose number follows from random pairs.
    Wider substrings make smaller buckets and need more tables, so the width grows with the vectors. Without any plan the cost is infinite.
    """
    best = (math.inf, 0, 0)
    for width in range(8, MAX_BITS + 1):
        try:
            tables = tables_needed(flips, width, miss)
        except ValueError:
            break
        meets = ((1 - random_flips) ** width).mean()
        # Moved vectors take the codes of the tables before along.
        best = min(best, (tables * (n * MOVE_SECONDS * (1 + tables / 64) + n * n / 2 * meets * dim * MULTIPLY_SECONDS), width, tables))
    return best


def learn(sample: np.ndarray, n: int, cosine: float) -> tuple[np.ndarray, np.ndarray, int]:
    """Mean, projection and bits of a substring for ``n`` vectors like those of the sample.

    Codes are cut around the mean or around zero. The mean balances the bits, but turns a small angle between vectors near it into a large one,
    which takes more tables; around zero, a pair at the threshold differs in the share angle / pi of the bits, whatever the vectors are.
    """
    plans = []
    for centre in (True, False):
        # Flips are measured over so many bits; as many as they show to be needed are learned then, the same ones first.
        measured = rotations(sample, max(1024, sample.shape[1]), centre=centre)
        plans.append((*plan_tables(n, *flip_shares(sample, *measured, cosine), sample.shape[1]), centre))
    _, width, tables, centre = min(plans)
    return (*rotations(sample, width * tables, centre=centre), width)


def _codes(x: np.ndarray, mean: np.ndarray, projection: np.ndarray, width: int) -> np.ndarray:
    """One number per table."""
    bits = ((x - mean) @ projection >= 0).reshape(len(x), -1, width)
    return (bits @ (1 << np.arange(width, dtype=np.int64))).astype(np.uint32)


def _compare(cosine: float, block: int = 1024):
    """Links of a bucket, or between two blocks of one: per node the copies linked, and a spanning star."""

    def run(key: tuple, group: pa.Table) -> pa.Table:
        table, i, j = key[1].as_py(), key[3].as_py(), key[4].as_py()
        sub = group.column("sub").to_numpy()
        order = np.argsort(sub, kind="stable")
        node, copies = group.column("node").to_numpy()[order], group.column("copies").to_numpy()[order]
        # The codes of the tables before this one.
        codes = np.frombuffer(b"".join(group.column("code").to_pylist()), "<u4").reshape(len(node), table)[order]
        x = _unit(matrix(group.column("vector"))[order])
        linked, forest = np.zeros(len(node), np.int64), Forest(len(node))
        begin = int((sub == i).sum()) if i != j else 0
        for a in range(0, begin or len(node), block):
            rows = slice(a, min(a + block, begin or len(node)))
            for b in range(begin or a, len(node), block):
                p, q = np.nonzero(x[rows] @ x[b : b + block].T >= cosine)
                p, q = p + a, q + b
                keep = p < q
                p, q = p[keep], q[keep]
                if len(p):
                    forest.join(p, q)
                    first = ~(codes[p] == codes[q]).any(axis=1)
                    p, q = p[first], q[first]
                    linked += np.bincount(p, weights=copies[q], minlength=len(node)).astype(np.int64)
                    linked += np.bincount(q, weights=copies[p], minlength=len(node)).astype(np.int64)
        root = forest.roots(np.arange(len(node)))
        found = np.flatnonzero((linked > 0) | (root != np.arange(len(node))))
        return pa.table({"node": pa.array(node[found], pa.int64()), "links": pa.array(linked[found]), "root": pa.array(node[root[found]], pa.int64())})

    return run


def near_duplicate_vectors(vectors: DataFrame, cosine: float = 0.95, id_col: str = "vec_id", vector_col: str = "embedding", sample: int = 10_000, block: int = 2048) -> DataFrame:
    """One row per vector: its id, ``n_links`` (other vectors linked directly), ``component_id`` (smallest id reachable) and ``kept``.

    Links are pairs met in a table whose cosine in double precision reaches the threshold; the tables are planned to miss at most
    one in a thousand of the pairs at the threshold, fewer of nearer ones, by shares of flipped bits measured where the codes are cut,
    after the mean is taken off. Rotations are fitted per dimension on at most ``sample`` different vectors, chosen
    by hash; every vector is indexed. Vectors that are null, zero or hold a null or non-finite component link with nothing and
    are their own component; so do vectors of different length with each other. Repeated rows link like any others; a null id is
    the smallest of no component with another id. Other columns are ignored; an empty table gives no rows.
    """
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).alias("vector"))
    rows = rows.withColumn("valid", takes_part("vector"))
    points = stored(
        rows.filter("valid").groupBy("vector").agg(F.min("id").alias("least"), F.count("*").alias("copies")).withColumn("node", F.monotonically_increasing_id()).withColumn("dim", F.size("vector")),
        "points",
    )
    sizes = {r.dim: r.n for r in points.groupBy("dim").agg(F.count("*").alias("n")).collect()}
    models = {}
    for dim, n in sizes.items():
        some = hashed_sample(points.filter(F.col("dim") == dim).select("vector"), "vector", sample, n).toArrow()
        models[dim] = learn(_unit(matrix(some.column("vector"))), n, cosine)

    def encode(batches):
        for batch in batches:
            dims, at = batch.column(3).to_numpy(), batch.schema.names
            for dim in np.unique(dims).tolist():
                some = batch.filter(pa.array(dims == dim))
                mean, projection, width = models[dim]
                codes = _codes(_unit(matrix(some.column(0))), mean, projection, width)
                yield pa.RecordBatch.from_arrays([*(some.column(at.index(c)) for c in ("node", "copies", "dim")), some.column(0), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(codes.tolist(), pa.list_(pa.int64()))], names=["node", "copies", "dim", "vector", "code", "parts"])

    coded = points.select("vector", "node", "copies", "dim").mapInArrow(encode, f"node long, copies long, dim int, vector {vectors.schema[vector_col].dataType.simpleString()}, code binary, parts array<bigint>")
    coded = stored(coded, "codes")
    # How many blocks a bucket needs, where it needs more than one.
    large = coded.select("dim", F.posexplode("parts").alias("table", "part")).groupBy("dim", "table", "part").agg(F.count("*").alias("n")).filter(F.col("n") > block)
    large = large.select("dim", "table", "part", F.ceil(F.col("n") / block).cast("int").alias("blocks"))
    entries = coded.select("dim", F.posexplode("parts").alias("table", "part"), "node", "copies", "vector", "code").withColumn("code", F.expr("substring(code, 1, 4 * table)")).join(large, ["dim", "table", "part"], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    entries = entries.withColumn("sub", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    entries = entries.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("i", F.least("sub", "other")).withColumn("j", F.greatest("sub", "other"))
    found = stored(entries.select("dim", "table", "part", "i", "j", "sub", "node", "copies", "vector", "code").groupBy("dim", "table", "part", "i", "j").applyInArrow(_compare(cosine), "node long, links long, root long"), "links")

    reach = components(found.filter("node != root").select(F.col("node").alias("a"), F.col("root").alias("b")))
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    told = stored(points.select("node", "vector", "least", "copies").join(links, "node", "left").join(reach, "node", "left"), "told")
    least = told.filter("root is not null").groupBy("root").agg(F.min("least").alias("component"))
    together = told.filter("root is not null").join(least, "root").select("vector", "copies", "links", "component")
    alone = told.filter("root is null").select("vector", "copies", "links", F.col("least").alias("component"))
    classes = together.unionByName(alone).withColumn("n_links", F.coalesce("links", F.lit(0)) + F.col("copies") - 1)
    valid = rows.filter("valid").join(classes, "vector").select("id", "n_links", F.col("component").alias("component_id"))
    out = valid.unionByName(rows.filter("not valid").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id")))
    return out.select(F.col("id").alias(id_col), "n_links", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))
