import math
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.conftest import EDGES
from tripweave.llm import context_tree as ct
from tripweave.llm.queries import op3_scoring

SF = "/root/testdata/sf0.001"


def sequence(text):
    return b" ".join((text or "").encode().lower().split()) + b"\n"


class Brute:
    """Context-tree weighting with dictionaries, one byte at a time."""

    def __init__(self, texts):
        self.n = defaultdict(lambda: [0, 0])
        self.children = defaultdict(set)
        for t in texts:
            for context, byte in self.steps(sequence(t)):
                for d in range(ct.DEPTH + 1):
                    for node, bit in self.bits(byte):
                        self.n[(context[:d], node)][bit] += 1
                        if d < ct.DEPTH:
                            self.children[(context[:d], node)].add((context[: d + 1], node))
        self.memo = {}

    @staticmethod
    def steps(s):
        padded = b"\n" * ct.DEPTH + s
        for i in range(len(s)):
            yield padded[i : i + ct.DEPTH][::-1], s[i]

    @staticmethod
    def bits(byte):
        return [((1 << b) | (byte >> (8 - b)), byte >> (7 - b) & 1) for b in range(8)]

    def estimate(self, key):
        a, b = self.n[key]
        return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)

    def split(self, key):
        return sum(self.weighted(k) for k in self.children[key])

    def weighted(self, key):
        if key not in self.memo:
            e = self.estimate(key)
            self.memo[key] = e if len(key[0]) == ct.DEPTH else np.logaddexp(e, self.split(key)) - math.log(2)
        return self.memo[key]

    def score(self, text):
        total = 0.0
        for context, byte in self.steps(sequence(text)):
            for node, bit in self.bits(byte):
                mix = None
                for d in range(ct.DEPTH, -1, -1):
                    key = (context[:d], node)
                    if key not in self.n or sum(self.n[key]) == 0:
                        continue
                    here = (self.n[key][bit] + 0.5) / (sum(self.n[key]) + 1)
                    if mix is not None:
                        stop = 1 / (1 + math.exp(max(-60, min(60, self.split(key) - self.estimate(key)))))
                        here = stop * here + (1 - stop) * mix
                    mix = here
                total += math.log10(0.5 if mix is None else mix)
        return total


def base(texts, learn):
    words = [[*sequence(t)[:-1].split(b" ")] if len(sequence(t)) > 1 else [] for t in texts]
    c = Counter()
    for w, x in zip(words, learn, strict=True):
        if x:
            c.update([*w, b"\n"])
    n, v = sum(c.values()), len(c)
    return [(len(w) + 1, sum(c[x] > 0 for x in [*w, b"\n"]), n, sum(math.log10((c[x] + 1) / (n + v + 1)) for x in [*w, b"\n"])) for w in words]


def compare(found, rows, learn):
    brute = Brute([t for (_, t), x in zip(rows, learn, strict=True) if x])
    wanted = sorted((str(i), len(sequence(t)), *b, brute.score(t)) for (i, t), b in zip(rows, base([t for _, t in rows], learn), strict=True))
    got = sorted((str(r.doc_id), len(sequence(t)), r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r, t in found)
    assert len(got) == len(wanted)
    for g, w in zip(got, wanted, strict=True):
        assert g[:5] == w[:5]
        assert g[5] == pytest.approx(w[5], rel=1e-9) and g[6] == pytest.approx(w[6], rel=1e-5)


def test_against_dictionaries(docs_of):
    rng = np.random.default_rng(1)
    vocabulary = ["the", "cat", "sat", "Ünder", "mat", "a", "ab", "abab", "12", "x中"]
    rows = [(i, " ".join(rng.choice(vocabulary, int(rng.integers(0, 30))))) for i in range(60)] + [(None, "The cat\tsat"), (70, None), (71, "never seen words"), (72, "qqqq the")]
    learn = [i is None or i % 4 != 3 for i, _ in rows]
    docs = docs_of(rows, clashes=True).repartition(5)
    found = ct.score_texts(docs, held_out=F.col("doc_id") % 4 == 3).collect()
    texts = dict(rows)
    compare([(r, texts[r.doc_id]) for r in found], rows, learn)
    assert {r.held_out for r in found if r.doc_id is None} == {False}


def test_merging_in_rounds_changes_nothing(docs_of, monkeypatch):
    rows = [(i, f"some words about number {i} and the like {i % 7}") for i in range(60)]
    whole = {r.doc_id: r.score for r in ct.score_texts(docs_of(rows)).collect()}
    monkeypatch.setattr(ct, "FAN_IN", 2)
    parts = {r.doc_id: r.score for r in ct.score_texts(docs_of(rows).repartition(9)).collect()}
    assert parts == pytest.approx(whole, rel=1e-6)


def test_edges(docs_of):
    found = ct.score_texts(docs_of(EDGES)).collect()
    assert len(found) == len(EDGES)
    assert all(math.isfinite(r.score) and r.score < 0 and r.bits_per_byte > 0 for r in found)
    assert {r.n_tokens for r in found if r.doc_id in (1, 2)} == {1}
    assert len({r.score for r in found if r.doc_id == 5}) == 1
    assert ct.score_texts(docs_of(EDGES).limit(0)).count() == 0
    untaught = ct.score_texts(docs_of([(1, "ab")]), held_out=F.lit(True)).first()
    assert (untaught.train_tokens, untaught.n_known, untaught.base_score) == (0, 0, 0.0)
    assert untaught.score == pytest.approx(24 * math.log10(0.5))


def test_held_out_texts_cost_less_than_bytes(spark):
    found = op3_scoring(spark, SF).toPandas()
    assert len(found) == 200 and found.doc_id.is_unique
    assert found[found.held_out].bits_per_byte.mean() < 3
