import numpy as np
import pytest

from tests.llm.conftest import EDGES
from tripweave.llm import quality as q
from tripweave.llm.queries import op10_quality

SF = "/root/testdata/sf0.01"


def labels_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def plain_statistics(text):
    import re

    text = text or ""
    w, n = [x for x in re.split(r"[\x20\x09-\x0D]+", text) if x], len(text)
    k = [x for x in text.split("\n") if x]
    share = lambda s: sum(c in s for c in text) / n if n else 0.0
    over = lambda a, b: a / b if b else 0.0
    return {
        "chars": n, "words": len(w), "word_length": over(n, len(w)), "distinct_words": over(len(set(w)), len(w)),
        "repeated_words": over(sum(a == b for a, b in zip(w, w[1:], strict=False)), len(w)), "symbols": share("#$%&*@^~=+<>{}[]_\\"), "bars": share("|"),
        "marks": share("!?"), "capitals": share("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), "digits": share("0123456789"), "commas": share(","), "stops": share("."),
        "lines": len(k), "distinct_lines": over(len(set(k)), len(k)), "line_length": over(n, len(k)),
    }


def test_statistics(docs_of):
    rows = [*EDGES, (20, "A | b!! 12,5\n\nA A a. A | b\nx\tx", "en", "s", 1), (21, " \n ", "en", "s", 1)]
    found = q.statistics(docs_of(rows, clashes=True), keep=("doc_id", "text")).collect()
    assert len(found) == len(rows)
    for r in found:
        assert {s: pytest.approx(v) for s, v in plain_statistics(r.doc.text).items()} == {s: r[s] for s in q.STATISTICS}


def test_compiled_rules_score_like_the_model(spark, docs_of):
    rng = np.random.default_rng(0)
    x = rng.random((1500, len(q.STATISTICS)))
    y = ((x[:, 5] < 0.7) & (x[:, 3] > 0.2)).astype(float)
    model = q.RuleEnsemble.fit(x, y)
    assert 0 < len(model.rules) and ((model.scores(x) >= 0.5) == y).mean() > 0.98
    frame = spark.createDataFrame([[float(v) for v in r] for r in x[:100]], list(q.STATISTICS)).select("*", model.column().alias("score"))
    assert np.allclose([r.score for r in frame.collect()], model.scores(x[:100]), rtol=1e-9)
    plan = frame._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_one_label_or_none(spark, docs_of):
    docs = docs_of(EDGES, clashes=True)
    none = q.score_quality(docs, labels_of(spark, [])).collect()
    assert len(none) == len(EDGES) and {r.score for r in none} == {0.5} and not any(r.held_out for r in none if r.doc.doc_id is None)
    ones = q.score_quality(docs, labels_of(spark, [(i, 1, 0) for i in range(10)])).collect()
    assert len({r.score for r in ones}) == 1 and ones[0].score > 0.9
    assert q.score_quality(docs.limit(0), labels_of(spark, [(1, None, 0), (None, 1, 0), (1, 1, 1)])).count() == 0


def test_held_out_accuracy(spark):
    found = op10_quality(spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").toPandas()
    assert op10_quality(spark, SF).count() == spark.read.parquet(f"{SF}/documents.parquet").count()
    held = found[found.held_out]
    assert len(held) > 40 and (held.predicted == held.quality).mean() > 0.95
    good = held[held.quality == 1]
    assert (good.predicted == 1).mean() > 0.97


def test_only_texts_matter(spark, docs_of):
    labels = labels_of(spark, [(i, int(i % 3 > 0), 0) for i in range(60)])
    texts = [(i, ("fine words and more of them, all different " + str(i)) if i % 3 else "bad!! " * 20, "en", f"s{i}", i) for i in range(60)]
    a = {r.doc.doc_id: r.score for r in q.score_quality(docs_of(texts), labels).collect()}
    other = [(i, t, "xx", "elsewhere", 0) for i, t, *_ in texts]
    b = {r.doc.doc_id: r.score for r in q.score_quality(docs_of(other, clashes=True), labels).collect()}
    assert a == b and a[0] < 0.3 < a[1]


def test_query_like_the_rules_by_hand(spark, monkeypatch):
    """Every document's statistics, the rules that hold for them and their weights, one by one."""
    import zlib

    models, fit = [], q.RuleEnsemble.fit
    monkeypatch.setattr(q.RuleEnsemble, "fit", classmethod(lambda cls, *a, **k: models.append(fit(*a, **k)) or models[-1]))
    found = {r.doc_id: r for r in op10_quality(spark, SF).collect()}
    (model,) = models
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    assert set(found) == {i for i, _ in docs} and model.rules
    for i, text in docs:
        own, total = plain_statistics(text), model.intercept
        for rule, weight in model.rules:
            # A share can differ in its last digit from Spark's, so one on a cut may fall to either side.
            if any(own[s] == pytest.approx(cut, rel=1e-12) and own[s] != cut for s, _, cut in rule):
                break
            total += weight * all(own[s] <= cut if low else own[s] > cut for s, low, cut in rule)
        else:
            r = found[i]
            assert r.score == pytest.approx(1 / (1 + np.exp(-total)), rel=1e-9)
            assert r.predicted == (r.score >= 0.3) and r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0)
