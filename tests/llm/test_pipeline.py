import re

import numpy as np
import pytest
from tokenizers import Tokenizer

from pyspark.sql import functions as F

import corpus_pipeline as cp
from __spark_entry__ import oracle_sql, queries
from tests.llm.conftest import EDGES
from tests.llm.test_mixing import mix
from tests.llm.test_secrets import plain as plain_secrets
from tripweave.llm.quality import score_quality
from tripweave.llm.queries import QUERIES, TOKENIZER

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """What every stage kept, written and read again as the next one's input."""
    docs, found = spark.read.parquet(f"{SF}/documents.parquet"), []
    for k, (_, stage) in enumerate(cp.STAGES):
        path = str(tmp_path_factory.mktemp("stage") / str(k))
        stage(spark, docs, SF).write.parquet(path)
        found.append((docs, docs := spark.read.parquet(path)))
    return found


def test_registered():
    assert len(cp.STAGES) == 5 and cp.ORACLE_SQL is None and "pipeline" not in oracle_sql()
    assert set(QUERIES) | {"pipeline"} <= set(queries())
    assert [n for n in QUERIES if n.startswith("op")] == [f"op{i}_{n.split('_', 1)[1]}" for i, n in enumerate(QUERIES, 1)]


def test_quality_keeps_what_the_rules_accept(spark, stages):
    before, after = stages[0]
    accepted = score_quality(before, spark.read.parquet(f"{SF}/labels.parquet")).filter("predicted = 1")
    assert after.columns == COLUMNS
    assert sorted(r.doc_id for r in after.collect()) == sorted(r.doc_id for r in accepted.select("doc.doc_id").collect())


def five_words(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_one_of_each_group_of_copies(stages):
    """The smallest id of every group that pairs of a Jaccard similarity of 0.8 or more connect, over all pairs."""
    before, after = stages[1]
    rows = [(r.doc_id, five_words(r.text)) for r in before.collect()]
    group = {i: i for i, _ in rows}
    for i, a in rows:
        for j, b in rows:
            if i < j and group[i] != group[j] and (a == b or len(a & b) >= 0.8 * len(a | b)):
                low, high = sorted((group[i], group[j]))
                group = {k: low if g == high else g for k, g in group.items()}
    assert after.columns == COLUMNS
    assert sorted(r.doc_id for r in after.collect()) == sorted(set(group.values()))
    assert len(set(group.values())) < len(rows)


def test_no_secret_is_left(stages):
    before, after = stages[2]
    texts = {r.doc_id: r.text for r in before.collect()}
    assert after.columns == COLUMNS and after.count() == len(texts)
    for r in after.collect():
        assert plain_secrets(r.text) == [] and r.n_chars == len(r.text)
        assert r.text == texts[r.doc_id] or plain_secrets(texts[r.doc_id])


def test_mixed_in_order(stages):
    before, after = stages[3]
    assert after.columns == COLUMNS
    assert sorted(map(str, after.collect())) == sorted(map(str, before.collect()))
    wanted = mix(before, alpha=0.7).orderBy("slot", "place").select("doc_id").collect()
    assert [r.doc_id for r in after.select("doc_id").collect()] == [r.doc_id for r in wanted]


def test_packed_whole(stages):
    before, after = stages[4]
    model = Tokenizer.from_file(TOKENIZER)
    pieces = after.toPandas()
    for r in before.collect():
        p = pieces[pieces.doc_id == r.doc_id].sort_values("start")
        ids = np.array([*model.encode(r.text, add_special_tokens=False).ids, 2], "<u4")
        assert b"".join(p.ids) == ids.tobytes()
    assert set(pieces.doc_id) == {r.doc_id for r in before.collect()}


def test_run_is_all_stages(spark, stages):
    got = cp.run(spark, SF)
    assert got.select("doc_id", "start", "length", "doc_tokens").orderBy("doc_id", "start").collect() == stages[4][1].select("doc_id", "start", "length", "doc_tokens").orderBy("doc_id", "start").collect()


def test_edges_through_all_stages(spark, docs_of, tmp_path):
    """Nulls, empty and long texts, repeated rows and clashing columns; then no rows at all."""
    clashes = [F.lit(None).cast("string").alias(c) for c in ("secrets", "slot", "weight", "kept", "score", "h", "first", "start", "found", "doc", "n")]
    rows = [*EDGES, (8, "token=Zx81Kq0Pm4Tt7Yw2Bn6 and more text", "en", "a", None)]
    for name, docs in (("edges", docs_of(rows).select("*", *clashes)), ("none", docs_of(rows).select("*", *clashes).limit(0))):
        columns = docs.columns
        for k, (_, stage) in enumerate(cp.STAGES):
            path = str(tmp_path / f"{name}-{k}")
            stage(spark, docs, SF).write.parquet(path)
            docs = spark.read.parquet(path)
            if k < 4:
                assert docs.columns == columns
        pieces = docs.groupBy("doc_id").count().collect()
        # Both empty texts share a fingerprint; the repeated row stays once.
        assert {r.doc_id for r in pieces} == ({1, 3, None, 5, 6, 7, 8} if name == "edges" else set())
