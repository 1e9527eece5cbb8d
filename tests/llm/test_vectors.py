import math

import duckdb
import numpy as np
import pytest

from tests.oracle_check import differences

from tripweave.llm import graph_search as gs
from tripweave.llm import quantisation as qn
from tripweave.llm.components import Forest
from tripweave.llm.queries import SQL, op8_neighbours, op9_vectors

SF = "/root/testdata/sf0.1"
NAN, INF = float("nan"), float("inf")
BAD = [(900, None), (901, [0.0] * 8), (902, [1.0, None] + [0.0] * 6), (903, [NAN] + [1.0] * 7), (904, [INF] + [1.0] * 7), (905, []), (None, None)]


def frame(spark, rows, clashes=False):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    return df.selectExpr("*", "1 as label", "2 as node", "3 as vector", "4 as id", "5 as v", "6 as shard", "7 as valid") if clashes else df


def random_rows(seed, n, dim=8):
    rng = np.random.default_rng(seed)
    return [(i, [float(x) for x in v]) for i, v in enumerate(rng.standard_normal((n, dim)).astype(np.float32))]


def brute_nearest(rows, k):
    out = {}
    good = [(i, np.array(v, np.float64)) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all() and any(v)]
    for i, q in good:
        if i % 20 == 0:
            out[i] = sorted((-float((q * v).sum()), j) for j, v in good if j != i and len(v) == len(q))[:k]
    return out


def compare_nearest(found, rows, k=20, recall=1.0):
    wanted = brute_nearest(rows, k)
    got = {}
    for r in sorted(found, key=lambda r: (r.query_id, r["rank"])):
        got.setdefault(r.query_id, []).append((-r.score, r.vec_id, r["rank"]))
    vectors = {i: np.array(v, np.float64) for i, v in rows if v and i is not None}
    hit = total = 0
    for i, w in wanted.items():
        g = got.get(i, [])
        assert [x[2] for x in g] == list(range(1, len(w) + 1))
        assert [x[:2] for x in g] == sorted(x[:2] for x in g)
        assert all(math.isclose(-s, float((vectors[i] * vectors[j]).sum()), rel_tol=1e-12, abs_tol=1e-12) for s, j, _ in g)
        hit, total = hit + len({j for _, j in w} & {j for _, j, _ in g}), total + len(w)
    assert set(got) == {i for i, w in wanted.items() if w}
    assert total and hit / total >= recall


def test_neighbours_small(spark):
    rows = random_rows(0, 300) + BAD + [(1000 + i, random_rows(0, 1)[0][1]) for i in range(40)] + [(2000 + 20 * i, [1.0, float(i)]) for i in range(3)]
    vectors = frame(spark, rows, clashes=True).repartition(4)
    found = gs.nearest(vectors, vectors.filter("vec_id % 20 = 0"), k=20, shard=120, part=7)
    assert found.columns == ["query_id", "rank", "vec_id", "score"] and dict(found.dtypes)["rank"] == "int"
    compare_nearest(found.collect(), rows, recall=0.98)


def test_ties_and_few_candidates(spark):
    rows = [(i, [1.0, 0.0]) for i in range(50)] + [(60, [3.0, 0.0])]
    found = [(r.query_id, r.vec_id) for r in gs.nearest(frame(spark, rows), frame(spark, rows[:1]), k=5).orderBy("rank").collect()]
    assert found == [(0, 60), (0, 1), (0, 2), (0, 3), (0, 4)]
    two = frame(spark, rows[:2])
    assert [(r.query_id, r.vec_id) for r in gs.nearest(two, two, k=5).orderBy("query_id").collect()] == [(0, 1), (1, 0)]
    assert gs.nearest(two.limit(0), two.limit(0)).count() == 0
    assert gs.nearest(frame(spark, BAD), frame(spark, BAD)).count() == 0


def test_neighbours_query(spark):
    rows = [(r.vec_id, list(r.embedding)) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    compare_nearest(op8_neighbours(spark, SF).collect(), rows, recall=0.97)


def test_graph_edges_are_diverse():
    x = np.random.default_rng(0).standard_normal((600, 6)).astype(np.float32)
    graph, entry = gs.build_graph(x, degree=12, beam=40)
    for i, row in enumerate(graph):
        own = row[row >= 0]
        assert len(set(own)) == len(own) and i not in own and len(own)
    found = gs.beam_search(x, graph, x[:50], entry, 30)
    assert (found[:, 0] == np.arange(50)).mean() > 0.98


def brute_links(rows, cosine):
    good = [k for k, (_, v) in enumerate(rows) if v and None not in v and np.isfinite(v).all() and any(v)]
    forest, links = Forest(len(rows)), np.zeros(len(rows), int)
    unit = {k: np.array(rows[k][1], np.float64) / np.linalg.norm(np.array(rows[k][1], np.float64)) for k in good}
    for a in good:
        for b in good:
            if a < b and len(unit[a]) == len(unit[b]) and float((unit[a] * unit[b]).sum()) >= cosine:
                links[a] += 1
                links[b] += 1
                forest.join(np.array([a]), np.array([b]))
    roots = forest.roots(np.arange(len(rows)))
    least = {r: min((rows[k][0] for k in np.flatnonzero(roots == r) if rows[k][0] is not None), default=None) for r in set(roots.tolist())}
    return sorted((str(i), int(n), str(least[r]), i == least[r]) for (i, _), n, r in zip(rows, links, roots.tolist(), strict=True))


@pytest.mark.parametrize("block", [2048, 16])
def test_links_against_all_pairs(spark, block):
    rng = np.random.default_rng(4)
    rows = random_rows(3, 150, 16)
    centre = np.array(rows[0][1])
    rows += [(200 + i, [float(x) for x in (centre + 0.2 * rng.standard_normal(16)).astype(np.float32)]) for i in range(60)]
    rows += [(300 + i, rows[5][1]) for i in range(30)] + [(400, [float(2 * np.float32(x)) for x in rows[6][1]]), (400, rows[6][1]), (None, rows[7][1])]
    rows += BAD + [(500, [1.0, 0.0]), (501, [1.0, 0.01])]
    found = qn.near_duplicate_vectors(frame(spark, rows, clashes=True).repartition(3), 0.95, block=block).collect()
    got, wanted = sorted((str(r.vec_id), r.n_links, str(r.component_id), r.kept) for r in found), brute_links(rows, 0.95)
    assert len(got) == len(wanted)
    over = sum(g[1] > w[1] for g, w in zip(got, wanted, strict=True))
    assert over == 0 and sum(g[1] for g in got) >= 0.99 * sum(w[1] for w in wanted)
    if sum(g[1] for g in got) == sum(w[1] for w in wanted):
        assert got == wanted


def test_links_edges(spark):
    assert qn.near_duplicate_vectors(frame(spark, [])).count() == 0
    only_bad = qn.near_duplicate_vectors(frame(spark, BAD)).collect()
    assert [(r.n_links, r.component_id, r.kept) for r in sorted(only_bad, key=lambda r: str(r.vec_id))] == [(0, i, True) for i in (900, 901, 902, 903, 904, 905, None)]


def test_links_query(spark):
    found = op9_vectors(spark, SF).collect()
    rows = [(r.vec_id, list(r.embedding)) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    x = np.array([v for _, v in rows], np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    assert len(found) == len(rows) and sum(r.n_links for r in found) == int((x @ x.T >= 0.95).sum()) - len(rows)


def test_links_and_their_sql(spark, tmp_path):
    """A table with near copies, through the registered query and its SQL."""
    rng = np.random.default_rng(9)
    rows = random_rows(8, 300, 32)
    rows += [(1000 + i, [float(x) for x in (np.array(rows[i % 20][1]) + 0.05 * rng.standard_normal(32)).astype(np.float32)]) for i in range(100)]
    frame(spark, [*rows, *[b for b in BAD if b[0] is not None]]).coalesce(1).write.parquet(str(tmp_path / "all"))
    (part,) = (tmp_path / "all").glob("*.parquet")
    part.rename(tmp_path / "embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{tmp_path}/embeddings.parquet')")
    found = op9_vectors(spark, str(tmp_path))
    assert differences(found, con, SQL["op9_vectors"]) == []
    assert found.filter("n_links > 0").count() >= 100


def at_cosine(rng, x, cosine):
    """For each unit vector one at a cosine to it, towards any direction."""
    noise = rng.standard_normal(x.shape)
    noise -= (noise * x).sum(axis=1, keepdims=True) * x
    return cosine * x + math.sqrt(1 - cosine**2) * noise / np.linalg.norm(noise, axis=1, keepdims=True)


def unit(x):
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def common_direction(rng, n, cosine, dim=64):
    """Unit vectors with a mean cosine to each other of about ``cosine``."""
    side = np.zeros(dim)
    side[0] = math.sqrt(cosine / (1 - cosine)) * math.sqrt(dim)
    return unit(rng.standard_normal((n, dim)) + side)


def tight_cluster(rng, n, dim=64):
    """Four fifths lie close to one direction."""
    side = np.zeros(dim)
    side[0] = math.sqrt(dim)
    return unit(np.where(np.arange(n)[:, None] % 5 > 0, side + 0.5 * rng.standard_normal((n, dim)), rng.standard_normal((n, dim))))


TABLES = {"centred": lambda rng, n: unit(rng.standard_normal((n, 64))), "mean 0.63": lambda rng, n: common_direction(rng, n, 0.63), "mean 0.8": lambda rng, n: common_direction(rng, n, 0.8), "cluster": tight_cluster}


@pytest.mark.parametrize("kind", TABLES)
@pytest.mark.parametrize("width", [8, 11, 16])
def test_pairs_near_the_threshold_meet(kind, width):
    rng = np.random.default_rng(width)
    x = TABLES[kind](rng, 6000)
    mean, projection = qn.rotations(x, 1024, rounds=8)
    tables = qn.tables_needed(qn.flip_shares(x, mean, projection, 0.95)[0], width)
    mean, projection = qn.rotations(x, tables * width, rounds=8)
    y = at_cosine(rng, x, 0.955)
    met = np.zeros(len(x), bool)
    for at in range(0, tables * width, width):
        some = projection[:, at : at + width]
        met |= qn._codes(x, mean, some, width)[:, 0] == qn._codes(y, mean, some, width)[:, 0]
    assert met.mean() >= 0.998


def test_wider_substrings_for_more_vectors():
    x = TABLES["centred"](np.random.default_rng(0), 4000)
    flips = qn.flip_shares(x, *qn.rotations(x, 1024, rounds=5), 0.95)
    plans = [qn.plan_tables(n, *flips) for n in (10**3, 10**6, 10**9, 10**11)]
    widths = [w for _, w, _ in plans]
    assert widths == sorted(widths) and 8 <= widths[0] and 16 < widths[-1] <= 32
    assert all(qn.tables_needed(flips[0], w) == t for _, w, t in plans)


def test_vectors_around_their_mean_are_cut_around_zero():
    """Two vectors with the mean between them: around it, all their bits differ."""
    mean, projection, width = qn.learn(unit(np.array([[1.0, 0.0], [1.0, 0.01]])), 2, 0.95)
    assert not mean.any() and projection.shape[1] % width == 0
    x = TABLES["centred"](np.random.default_rng(3), 3000) + 0.05
    assert qn.learn(unit(x), 10**8, 0.95)[0].any()


def test_links_of_vectors_with_a_common_direction(spark):
    rng = np.random.default_rng(1)
    x = common_direction(rng, 1500, 0.8)
    x = np.vstack([x, at_cosine(rng, x[:500], 0.955)]).astype(np.float32)
    found = qn.near_duplicate_vectors(frame(spark, [(i, [float(v) for v in r]) for i, r in enumerate(x)]), 0.95).collect()
    y = unit(x.astype(np.float64))
    assert sum(r.n_links for r in found) >= 0.998 * (int((y @ y.T >= 0.95).sum()) - len(y))


@pytest.mark.parametrize("kind", ["one long row", "uneven", "uneven and one long row"])
def test_neighbours_of_vectors_of_uneven_length(spark, kind):
    rng = np.random.default_rng(2)
    x = rng.standard_normal((2400, 32)) * (1 if kind == "one long row" else rng.lognormal(0, 0.7, (2400, 1)))
    if kind != "uneven":
        x[7] *= 10_000
    rows = [(i, [float(v) for v in r.astype(np.float32)]) for i, r in enumerate(x)]
    vectors = frame(spark, rows)
    found = gs.nearest(vectors, vectors.filter("vec_id % 20 = 0"), k=20, shard=1200)
    compare_nearest(found.collect(), rows, recall=0.95)
