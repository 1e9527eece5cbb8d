"""Toxicity categories by a chain of linear classifiers.

The first category is predicted from words alone; every later one also sees the probabilities of the categories before it.
In training these come from models that did not see the row (out of fold), so that later links learn how far they can be
trusted; in scoring they come from the models fitted on all training rows.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tripweave.llm.common import arrow_schema, fold, hashed_sample, map_texts, stored, text_batches

_LETTERS = re.compile(r"[^\W\d_]+")


def word_set(text: str) -> set[str]:
    """The runs of letters of the lower-cased text, and the first four letters of longer ones (``^``), which inflected forms share."""
    out: set[str] = set()
    for w in set(text.lower().split()):
        if w.isalpha():
            out.add(w)
        else:
            out.update(_LETTERS.findall(w))
    out.update(["^" + w[:4] for w in out if len(w) > 4])
    return out


def _near_copy_key(text: str) -> int:
    """Equal for most near copies: the smallest hash over runs of five words."""
    w = text.lower().split()
    return min((zlib.crc32(" ".join(w[i : i + 5]).encode("utf-8", "surrogatepass")) for i in range(max(1, len(w) - 4))), default=0)


def _fit(rows: np.ndarray, words: np.ndarray, dense: np.ndarray, y: np.ndarray, width: int, penalty: float, steps: int = 400) -> np.ndarray:
    """Logistic regression over word indicators, dense columns and an intercept (last), with an L2 penalty, by accelerated gradient steps."""
    n, k = dense.shape
    share = np.bincount(words, minlength=width) / max(1, n)
    # Each weight moves at the speed its column allows.
    rate = 1.0 / (0.25 * np.concatenate([share * 8 + 0.02, (dense**2).mean(axis=0) * 8 + 0.02, [2.0]]) + penalty)
    w = u = np.zeros(width + k + 1)
    t = 1.0
    for _ in range(steps):
        z = np.bincount(rows, weights=u[words], minlength=n) + dense @ u[width:-1] + u[-1]
        e = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) / max(1, n)
        g = np.concatenate([np.bincount(words, weights=e[rows], minlength=width), dense.T @ e, [e.sum()]]) + penalty * np.concatenate([u[:-1], [0.0]])
        new = u - rate * g
        if g @ (new - w) > 0:
            t = 1.0
        t, s = (1 + np.sqrt(1 + 4 * t * t)) / 2, t
        w, u = new, new + (s - 1) / t * (new - w)
    return w


@dataclass
class Chain:
    """Words and, per category in order, their weights, the weights of earlier categories and the intercept."""

    categories: list[str]
    words: dict[str, int]
    weights: list[np.ndarray]

    def probabilities(self, texts: list[str]) -> np.ndarray:
        rows, found = self.indicators([word_set(t) for t in texts], self.words)
        out = np.zeros((len(texts), len(self.categories)))
        for c, w in enumerate(self.weights):
            k = len(self.words)
            z = np.bincount(rows, weights=w[found], minlength=len(texts)) + out[:, :c] @ w[k:-1] + w[-1]
            out[:, c] = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        return out

    @staticmethod
    def indicators(sets: list[set[str]], words: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
        pairs = [(i, words[w]) for i, s in enumerate(sets) for w in s if w in words]
        both = np.array(pairs, np.int64).reshape(-1, 2)
        return both[:, 0], both[:, 1]

    @classmethod
    def fit(cls, rows: np.ndarray, found: np.ndarray, labels: np.ndarray, categories: list[str], words: dict[str, int], folds: int = 4, penalty: float = 2e-4, seed: int = 0) -> Chain:
        """``rows`` and ``found`` pair a text with a word in it, by number; ``labels`` has a 0/1 column per category.

        A category with one label only is predicted by its constant share; no texts at all predict 0.5.
        """
        labels = labels.astype(float).reshape(len(labels), len(categories))
        n = len(labels)
        part = np.random.default_rng(seed).permutation(n) % folds
        earlier, weights = np.zeros((n, 0)), []
        for c in range(len(categories)):
            y = labels[:, c]
            if n == 0 or y.min() == y.max():
                p = min(max(float(y.mean()), 1e-3), 1 - 1e-3) if n else 0.5
                w = np.zeros(len(words) + c + 1)
                w[-1] = np.log(p / (1 - p))
                out = np.full(n, p)
            else:
                out = np.zeros(n)
                for f in range(folds):
                    learn, use = part != f, part[rows] != f
                    position = np.cumsum(learn) - 1
                    m = _fit(position[rows[use]], found[use], earlier[learn], y[learn], len(words), penalty)
                    z = np.bincount(rows, weights=m[found], minlength=n) + earlier @ m[len(words) : -1] + m[-1]
                    out[~learn] = 1 / (1 + np.exp(-np.clip(z[~learn], -30, 30)))
                w = _fit(rows, found, earlier, y, len(words), penalty)
            weights.append(w)
            earlier = np.hstack([earlier, out[:, None]])
        return cls(categories, words, weights)


def _word_rows(count: int):
    """The near-copy key and the words of each text, before its ``count`` other columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_batches(batches):
            keys, sets = [_near_copy_key(t) for t in texts], [sorted(word_set(t)) for t in texts]
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(sets, pa.list_(pa.string())), *batch.columns[:count]], names=["key", "words", *batch.schema.names[:count]])

    return run


def train(docs: DataFrame, labels: DataFrame, categories: dict[str, str], sample: int = 20_000, features: int = 800, least: float = 0.0005, id_col: str = "doc_id", text_col: str = "text") -> Chain:
    """Fit on at most ``sample`` labelled documents, chosen by hashes of their ids.

    ``categories`` names each category and the SQL condition on ``labels`` that marks it, in chain order; a null condition is no. Only
    documents with an id and a label take part; of several labels of an id any that marks it counts. Of near copies in the sample one
    teaches, so that a copied text's rare words do not pass for evidence. The ``features`` words that tell a category best are chosen
    among those in a share of ``least`` of the texts (5 at least); only their numbers and the labels come to the driver. The chosen ids,
    a bounded number, are broadcast.
    """
    names = list(categories)
    marks = [F.max(F.coalesce(F.expr(e), F.lit(False)).cast("int")).alias(f"y{c}") for c, e in enumerate(categories.values())]
    known = labels.filter(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(*marks)
    ids = docs.select(F.col(id_col).alias("id")).distinct()
    there = stored(known.join(ids, "id", "left_semi"), "labelled")
    chosen = hashed_sample(there, "id", sample, there.count())
    y = [f"y{c}" for c in range(len(names))]
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("_text")).join(F.broadcast(chosen), "id").select("id", *y, "_text")
    id_type = docs.schema[id_col].dataType.simpleString()
    shape = f"key long, words array<string>, id {id_type}, " + ", ".join(f"{c} int" for c in y)
    taught = map_texts(texts, _word_rows(1 + len(y)), shape)
    first = taught.groupBy("key").agg(F.min_by(F.struct("words", *y), F.struct("id", "words")).alias("row"))
    rows = stored(first.select("key", "row.*"), "taught")

    n, *shares = rows.agg(F.count("*"), *(F.avg(c) for c in y)).first()
    counted = rows.select(F.explode("words").alias("word"), *y).groupBy("word").agg(F.count("*").alias("n"), *(F.sum(c).alias(c) for c in y)).filter(F.col("n") >= max(5, least * n))
    # How far a word's share of a category is from chance, over its spread.
    tells = [(F.col(c) - F.col("n") * p) ** 2 / (F.col("n") * p * (1 - p)) if p and 0 < p < 1 else F.lit(0.0) for c, p in zip(y, shares, strict=True)]
    best = counted.select("word", F.greatest(*tells, F.lit(0.0)).alias("score")).orderBy(F.desc("score"), "word").limit(features).collect()
    words = {r.word: i for i, r in enumerate(sorted(best, key=lambda r: r.word))}

    def numbers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [[words[w] for w in some if w in words] for some in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(own, pa.list_(pa.int32())), *batch.columns[1:]], names=["own", *y, "key"])

    found = rows.select("words", *y, "key").mapInArrow(numbers, "own array<int>, " + ", ".join(f"{c} int" for c in y) + ", key long").orderBy("key").toArrow()
    own = found.column("own").to_pylist()
    pairs = np.array([(i, w) for i, some in enumerate(own) for w in some], np.int64).reshape(-1, 2)
    table = np.stack([found.column(c).to_numpy() for c in y], axis=1) if own else np.zeros((0, len(y)))
    return Chain.fit(pairs[:, 0], pairs[:, 1], table, names, words)


def score_toxicity(docs: DataFrame, labels: DataFrame, categories: dict[str, str], folds: int = 5, held_out: int = 0, threshold: float = 0.3, sample: int = 20_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: the id, ``held_out``, ``p_<category>`` for each category and ``predicted``: 1 if the first reaches ``threshold``.

    Labels teach from ids whose remainder is not ``held_out``. Null and empty texts have the probability of a text without words; null ids are never learned
    from and not held out; repeated rows are scored alike; other columns are ignored; an empty table gives no rows.
    """
    chain = train(docs, labels.filter(fold(id_col, folds) != held_out), categories, sample, id_col=id_col, text_col=text_col)
    names = [f"p_{c}" for c in categories]
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("held_out", T.BooleanType()), *(T.StructField(c, T.DoubleType()) for c in names)])
    arrow = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_batches(batches):
            p = chain.probabilities(texts)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(p[:, c]) for c in range(p.shape[1]))], schema=arrow)

    held = F.coalesce(fold(id_col, folds) == held_out, F.lit(False)).alias("held_out")
    return map_texts(docs.select(id_col, held, F.col(text_col).alias("_text")), run, schema).withColumn("predicted", (F.col(names[0]) >= threshold).cast("int"))
