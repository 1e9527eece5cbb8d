import re

import numpy as np
import pytest
import xxhash

from tests.llm.conftest import EDGES
from tripweave.llm import simhash as sh
from tripweave.llm.queries import op7_simhash

SF = "/root/testdata/sf0.001"


def plain_fingerprint(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    s = [" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))] if w else []
    h = [xxhash.xxh64(x.encode(), 42).intdigest() for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(prints):
    """Smallest id reachable over 4 bits or fewer, for (id, fingerprint) pairs; a null id is larger than any."""
    n = len(prints)
    group = list(range(n))
    for a in range(n):
        for b in range(a):
            if (prints[a][1] ^ prints[b][1]).bit_count() <= 4 and group[a] != group[b]:
                old, new = group[a], group[b]
                group = [new if g == old else g for g in group]
    ids = {g: min((p[0] for p, x in zip(prints, group, strict=True) if x == g and p[0] is not None), default=None) for g in set(group)}
    return [ids[g] for g in group]


def compare(found, rows):
    prints = [(i, plain_fingerprint(t)) for i, t in rows]
    wanted = sorted((str(i), f"{fp:016x}", str(c)) for (i, fp), c in zip(prints, plain_components(prints), strict=True))
    assert sorted((str(r.doc_id), r.fingerprint, str(r.component_id)) for r in found) == wanted


def test_query_against_all_pairs(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    compare(op7_simhash(spark, SF).collect(), rows)


def test_edges(docs_of):
    docs = docs_of(EDGES, clashes=True)
    compare(sh.near_duplicates(docs).collect(), [r[:2] for r in EDGES])
    assert sh.near_duplicates(docs.limit(0)).count() == 0


def test_planted_copies_and_one_of_each_stays(docs_of):
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in range(5000)]
    texts = [" ".join(rng.choice(words, 300)) for _ in range(40)]
    rows = [(i, t) for i, t in enumerate(texts)]
    rows += [(100 + i, t.upper()) for i, t in enumerate(texts[:10])]
    rows += [(200 + i, t.replace(t.split()[7], "other")) for i, t in enumerate(texts[:20])]
    rows += [(300, None), (301, ""), (301, ""), (None, "only here"), (None, "only here"), (3, texts[30])]
    docs = docs_of(rows, clashes=True)
    compare(sh.near_duplicates(docs).collect(), rows)
    prints = [(i, plain_fingerprint(t)) for i, t in rows]
    reach = plain_components(prints)
    kept = sh.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    found = kept.collect()
    # Two different texts have the id 3.
    assert sorted(str(r.doc_id) for r in found) == sorted([*{str(c) for c in reach}, "3"])
    assert all((r.text or "") == dict(rows)[r.doc_id] for r in found if r.doc_id not in (3, 300))


def test_shards_lose_no_link(spark):
    """Small shards, and one group that is far larger than a shard."""
    rng = np.random.default_rng(5)
    fps = rng.integers(0, 2**64, 1500, dtype=np.uint64)
    near = [fps[i] ^ np.uint64(1 << int(b)) ^ np.uint64(1 << int(c)) for i in range(150) for b, c in rng.integers(0, 64, (2, 2))]
    centre = np.uint64(0xF0F0F0F0F0F0F0F0)
    hot = [centre ^ np.uint64(1 << a) ^ np.uint64(1 << b) for a in range(64) for b in range(a)]
    points = np.unique(np.concatenate([fps, np.array(near, np.uint64), np.array(hot, np.uint64)]))
    frame = spark.createDataFrame([(int(x),) for x in points.view(np.int64)], "fp long").repartition(5)
    edges = sh.links(frame, 4, shard=150, sample=400).collect()
    assert len(edges) < 3 * len(points) * 8
    forest, whole = sh.Forest(len(points)), sh.Forest(len(points))
    at = {int(x): i for i, x in enumerate(points.view(np.int64))}
    forest.join(np.array([at[r.a] for r in edges]), np.array([at[r.b] for r in edges]))
    for i in range(0, len(points), 256):
        a, b = np.nonzero(np.bitwise_count(points[i : i + 256, None] ^ points[None, :]) <= 4)
        whole.join(a + i, b)
    everything = np.arange(len(points))
    assert np.array_equal(forest.roots(everything.copy()), whole.roots(everything.copy()))


@pytest.mark.parametrize("text", ["", "one", "one two three", "A b C d", "A b C d e", "x " * 1000, "é ß\x85z \x1c q"])
def test_fingerprint(text):
    assert sh.fingerprint(text, block=7) == plain_fingerprint(text)
