import numpy as np
import pytest

from tests.llm.conftest import EDGES
from tripweave.llm import toxicity as tx
from tripweave.llm.queries import op5_toxicity

SF = "/root/testdata/sf0.1"
CATEGORIES = {"toxic": "toxic = 1", "junk": "toxic = 1 and quality = 0"}


def planted(seed=0, n=600):
    rng = np.random.default_rng(seed)
    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(300)]
    rows, labels = [], []
    for i in range(n):
        toxic, junk = int(rng.random() < 0.3), int(rng.random() < 0.4)
        text = list(rng.choice(words, 40))
        if toxic:
            text[int(rng.integers(0, 40))] = str(rng.choice(["idiot", "Scum!", "morons"]))
        if junk:
            text.append("zzzz")
        rows.append((i, " ".join(text)))
        labels.append((i, 1 - junk, toxic))
    return rows, labels


def test_planted_words(spark, docs_of):
    rows, labels = planted()
    found = tx.score_toxicity(docs_of(rows, clashes=True), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), CATEGORIES, threshold=0.5).toPandas().set_index("doc_id")
    truth = {i: (t, t and not q) for i, q, t in labels}
    held = found[found.held_out]
    assert len(held) > 80
    assert np.mean([truth[i][0] == p for i, p in held.predicted.items()]) > 0.95
    assert np.mean([truth[i][1] == (p > 0.5) for i, p in held.p_junk.items()]) > 0.9


def test_later_categories_use_earlier_ones():
    rng = np.random.default_rng(1)
    y = (rng.random(400) < 0.5).astype(int)
    rows = np.flatnonzero(y)
    chain = tx.Chain.fit(rows, np.zeros(len(rows), int), np.stack([y, y], axis=1), ["a", "b"], {"bad": 0})
    assert len(chain.weights[0]) == 2 and len(chain.weights[1]) == 3
    assert chain.weights[1][1] > 0
    p = chain.probabilities(["bad", "good"])
    assert p[0].min() > 0.8 and p[1].max() < 0.2


def test_edges(spark, docs_of):
    docs = docs_of(EDGES, clashes=True)
    schema = "doc_id long, quality int, toxic int"
    none = tx.score_toxicity(docs, spark.createDataFrame([], schema), CATEGORIES).collect()
    assert len(none) == len(EDGES) and {(r.p_toxic, r.p_junk) for r in none} == {(0.5, 0.5)}
    clean = tx.score_toxicity(docs, spark.createDataFrame([(1, 1, 0), (2, None, None), (None, 1, 1), (3, 1, 0), (3, 1, 0), (6, 1, 0)], schema), CATEGORIES)
    assert clean.columns == ["doc_id", "held_out", "p_toxic", "p_junk", "predicted"]
    assert {r.predicted for r in clean.collect()} == {0}
    assert tx.score_toxicity(docs.limit(0), spark.createDataFrame([(1, 1, 0)], schema), CATEGORIES).count() == 0


def test_near_copies_teach_once(spark, docs_of):
    """Rare words of one much-copied toxic text do not condemn a clean text that shares one."""
    rows, labels = planted(2)
    source = "quux frobnicate " + " ".join(f"rare{chr(97 + i)}" for i in range(20)) + " idiot"
    rows += [(1000 + i, source) for i in range(200)] + [(5000, "a clean text about quux and frobnicate and nothing else")]
    labels += [(1000 + i, 1, 1) for i in range(200)]
    found = tx.score_toxicity(docs_of(rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), CATEGORIES)
    assert found.filter("doc_id = 5000").first().predicted == 0
    assert found.filter("doc_id >= 1000 and doc_id < 1200 and predicted = 1").count() == 200


def test_held_out_accuracy(spark):
    found = op5_toxicity(spark, SF)
    both = found.join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").filter("held_out").toPandas()
    assert found.count() == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert (both.predicted == both.toxic).mean() > 0.96


@pytest.mark.parametrize("text, words", [("", set()), ("It's IDIOT-like, naïve2x", {"it", "s", "idiot", "like", "naïve", "x", "^idio", "^naïv"}), ("abcd", {"abcd"})])
def test_words(text, words):
    assert tx.word_set(text) == words


def test_query_like_the_chain_by_hand(spark, monkeypatch):
    """Every document's words and their weights, category after category."""
    import re
    import zlib

    from tripweave.llm.queries import CATEGORIES as OWN

    chains, fit = [], tx.Chain.fit
    monkeypatch.setattr(tx.Chain, "fit", classmethod(lambda cls, *a, **k: chains.append(fit(*a, **k)) or chains[-1]))
    sf = "/root/testdata/sf0.01"
    found = {r.doc_id: r for r in op5_toxicity(spark, sf).collect()}
    (chain,) = chains
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    assert set(found) == {i for i, _ in docs} and len(chain.words) > 50
    for i, text in docs:
        runs = set(re.findall(r"[^\W\d_]+", " ".join((text or "").lower().split())))
        words = runs | {"^" + w[:4] for w in runs if len(w) > 4}
        earlier = []
        for category, w in zip(OWN, chain.weights, strict=True):
            z = w[-1] + sum(w[k] for x, k in chain.words.items() if x in words) + sum(p * v for p, v in zip(earlier, w[len(chain.words) : -1], strict=True))
            earlier.append(1 / (1 + np.exp(-z)))
            assert found[i][f"p_{category}"] == pytest.approx(earlier[-1], rel=1e-6, abs=1e-9)
        assert found[i].predicted == (earlier[0] >= 0.3) and found[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0)
