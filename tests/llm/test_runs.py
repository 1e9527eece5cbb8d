import hashlib
import random
import time
import zlib

import numpy as np
import pytest

from __spark_entry__ import oracle_sql
from tests.llm.conftest import EDGES
from tests.oracle_check import connect, differences
from tripweave.llm.queries import op12_runs
from tripweave.llm.runs import collapse, find_runs, lyndon_groups, periodic_runs, stretches


def plain_runs(s, least, exponent):
    """Every period, every stretch of equal words at that distance; the smallest period of each."""
    found = {}
    for q in range(1, len(s)):
        i = 0
        while i + q < len(s):
            begin = i
            while i + q < len(s) and s[i] == s[i + q]:
                i += 1
            if i > begin and i - begin + q >= max(least, exponent * q):
                found.setdefault((begin, i - begin + q), q)
            i += 1
    return sorted(((b, n, q) for (b, n), q in found.items()), key=lambda r: (r[0], r[2]))


def samples(count, seed):
    rng = random.Random(seed)
    for _ in range(count):
        letters = rng.choice([1, 2, 3, 5])
        s = [rng.randrange(letters) for _ in range(rng.randrange(1, 50))]
        if rng.random() < 0.6 and len(s) > 6:
            at, n = rng.randrange(4), rng.randrange(1, 7)
            s = s[:at] + s[at : at + n] * rng.randrange(2, 12) + s[at + rng.randrange(n) :]
        yield s


def test_groups_are_lyndon_prefixes_in_order():
    for s in samples(400, 1):
        groups, lengths = lyndon_groups(s)
        prefix = []
        for i in range(len(s)):
            j = i + 1
            while j < len(s) and s[j:] > s[i:]:
                j += 1
            prefix.append(tuple(s[i:j]))
        assert lengths == list(map(len, prefix))
        by_group, by_prefix = np.array(groups), {p: k for k, p in enumerate(sorted(set(prefix)))}
        rank = np.array([by_prefix[p] for p in prefix])
        assert ((by_group[:, None] < by_group) == (rank[:, None] < rank)).all()


@pytest.mark.parametrize(("least", "exponent"), [(2, 2), (5, 2), (6, 3), (24, 3), (9, 4)])
def test_runs_like_all_periods(least, exponent):
    for s in samples(500, least):
        words = [b"w%d" % x for x in s]
        runs = find_runs(words, least, exponent)
        assert runs == plain_runs(s, least, exponent)
        dropped = {i for b, n, q in runs for i in range(b + q, b + n)}
        assert collapse(words, runs) == [w for i, w in enumerate(words) if i not in dropped]


def test_what_is_set_aside_holds_no_run():
    rng = random.Random(5)
    for _ in range(50):
        s = [rng.randrange(400) for _ in range(300)]
        at, q = rng.randrange(200), rng.randrange(1, 12)
        s[at : at + 60] = (s[at : at + q] * 60)[: rng.randrange(24, 60)]
        kept = stretches(np.array(s), 24, 3)
        assert all(any(b <= r[0] and r[0] + r[1] <= e for b, e in kept) for r in plain_runs(s, 24, 3))
        assert sum(e - b for b, e in kept) < 100


def test_time_grows_with_the_words():
    unit = [b"u%d" % i for i in range(7000)]
    begin = time.perf_counter()
    assert find_runs(unit * 40, 24, 3) == [(0, 280_000, 7000)]
    assert find_runs([b"a", b"b"] * 150_000, 24, 3) == [(0, 300_000, 2)]
    assert find_runs([b"n%d" % i for i in range(300_000)], 24, 3) == []
    assert time.perf_counter() - begin < 20


def test_query_like_its_sql(spark):
    for sf in ("0.001", "0.01"):
        sf_dir = f"/root/testdata/sf{sf}"
        found = op12_runs(spark, sf_dir)
        assert differences(found, connect(sf_dir), oracle_sql()["op12_runs"]) == []
        assert found.filter("n_runs > 0").count() > 5


def test_query_by_the_words_of_the_contract(spark):
    sf_dir = "/root/testdata/sf0.001"
    found = {r.doc_id: r for r in op12_runs(spark, sf_dir).collect()}
    for i, t in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect():
        w = (t or "").encode().split()
        n, h = len(w), zlib.crc32(str(i).encode())
        if h % 10 == 0 and n:
            a = (h // 10) % n
            p = 1 + (n - a) // (3 + h // 10 % 8)
            w = [w[a + (k - a) % p] if k >= a else w[k] for k in range(n)]
        runs, r = plain_runs(w, 24, 3), found[i]
        best = max(runs, key=lambda x: (x[1] / x[2], -x[0], -x[2]), default=(None, None, None))
        assert (r.n_runs, r.start, r.length, r.period) == (len(runs), *best)
        assert r.exponent_milli == (1000 * best[1] // best[2] if runs else None)
        assert r.runs_sha256 == hashlib.sha256("".join(f"{b},{m},{q}\n" for b, m, q in runs).encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(b" ".join(collapse(w, runs))).hexdigest()


def test_edges(docs_of):
    docs = docs_of([*EDGES, (8, "a b " * 30 + "c"), (9, " ".join([" x"] * 24)), (10, "x " * 23)], clashes=True)
    found = periodic_runs(docs)
    assert found.columns == ["doc_id", "n_words", "runs", "collapsed"]
    rows = {r.doc_id: (r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in found.collect()}
    assert found.count() == len(EDGES) + 3
    assert rows[1] == rows[2] == (0, [], "")
    assert rows[5][2] == "the same row twice over and over"
    assert rows[6] == (40_001, [(0, 40_000, 1)], "long end")
    assert rows[8] == (61, [(0, 60, 2)], "a b c")
    assert rows[9] == (24, [(0, 24, 1)], " x")
    assert rows[10][1] == []
    assert periodic_runs(docs.limit(0)).count() == 0
