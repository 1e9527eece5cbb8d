"""Text quality by a sparse ensemble of rules over document statistics.

Shallow trees, boosted on subsamples, propose conjunctions of conditions; an L1-penalised logistic regression keeps few of
them; what is left is compiled into one Spark column expression.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tripweave.llm.common import fold, hashed_sample, stored

STATISTICS = (
    "chars", "words", "word_length", "distinct_words", "repeated_words", "symbols", "bars", "marks", "capitals", "digits",
    "commas", "stops", "lines", "distinct_lines", "line_length",
)

#: Characters that each statistic counts.
_SETS = {"symbols": "#$%&*@^~=+<>{}[]_\\", "bars": "|", "marks": "!?", "digits": "0123456789", "commas": ",", "stops": "."}


def statistics(docs: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The ``keep`` columns as ``doc`` (a struct) and the statistics of each whole text, as doubles; all 0 for a null or empty text.

    Characters are counted in what is left when letters and white space are gone, which is short and made in one pass.
    """
    text, words, lines, rest = F.col("_t"), F.col("_w"), F.col("_l"), F.col("_r")
    cut = docs.select(F.struct(*(F.col(f"`{c}`") for c in keep)).alias("doc"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("_t")).select(
        "doc",
        "_t",
        F.array_remove(F.split("_t", r"[\x20\x09-\x0D]+"), "").alias("_w"),
        F.array_remove(F.split("_t", "\n"), "").alias("_l"),
        F.regexp_replace("_t", r"[\p{L}\s]+", "").alias("_r"),
    )
    n, k, chars = F.size(words), F.size(lines), F.length(text)
    repeats = F.size(F.filter(F.zip_with(words, F.slice(words, 2, F.greatest(n, F.lit(1))), lambda a, b: a == b), lambda same: same))
    made = {
        "chars": chars,
        "words": n,
        "word_length": F.try_divide(chars, n),
        "distinct_words": F.try_divide(F.size(F.array_distinct(words)), n),
        "repeated_words": F.try_divide(repeats, n),
        "capitals": F.try_divide(F.length(F.regexp_replace(text, "[^A-Z]+", "")), chars),
        "lines": k,
        "distinct_lines": F.try_divide(F.size(F.array_distinct(lines)), k),
        "line_length": F.try_divide(chars, k),
        **{s: F.try_divide(F.length(rest) - F.length(F.translate(rest, c, "")), chars) for s, c in _SETS.items()},
    }
    return cut.select("doc", *(F.coalesce(made[s].cast("double"), F.lit(0.0)).alias(s) for s in STATISTICS))


Rule = tuple[tuple[str, bool, float], ...]  # (statistic, at most instead of above, threshold)


def _grow(x: np.ndarray, cuts: list[np.ndarray], target: np.ndarray, rows: np.ndarray, depth: int, least: int, path: tuple, out: list[tuple], pred: np.ndarray) -> None:
    """Split rows on the cut that explains the target best; every node below the root adds its path to ``out``."""
    pred[rows] = target[rows].mean()
    if path:
        out.append(path)
    if depth == 0 or len(rows) < 2 * least:
        return
    y = target[rows]
    total, best = y.sum(), (1e-9, -1, -1)
    for f, c in enumerate(cuts):
        if not len(c):
            continue
        code = x[rows, f]
        n = np.cumsum(np.bincount(code, minlength=len(c) + 1))[:-1]
        s = np.cumsum(np.bincount(code, weights=y, minlength=len(c) + 1))[:-1]
        m = len(rows) - n
        ok = (n >= least) & (m >= least)
        if ok.any():
            gain = np.where(ok, s**2 / np.maximum(n, 1) + (total - s) ** 2 / np.maximum(m, 1) - total**2 / len(rows), 0)
            if gain.max() > best[0]:
                best = (float(gain.max()), f, int(gain.argmax()))
    if best[1] < 0:
        return
    _, f, at = best
    left = x[rows, f] <= at
    for side, low in ((rows[left], True), (rows[~left], False)):
        _grow(x, cuts, target, side, depth - 1, least, (*path, (f, low, at)), out, pred)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _lasso(z: np.ndarray, y: np.ndarray, penalty: float, steps: int) -> tuple[float, np.ndarray]:
    """Logistic regression with an L1 penalty, by accelerated proximal gradient steps; the intercept is free."""
    n, k = z.shape
    zi = np.hstack([np.ones((n, 1), np.float32), z.astype(np.float32)])
    v = np.ones(k + 1, np.float32)
    for _ in range(20):
        v = zi.T @ (zi @ v)
        v /= np.linalg.norm(v)
    rate = n / (0.25 * float(v @ (zi.T @ (zi @ v))) + 1e-12)
    w = u = np.zeros(k + 1, np.float32)
    y = y.astype(np.float32)
    t, rate = 1.0, np.float32(rate)
    for _ in range(steps):
        new = u - rate * (zi.T @ (_sigmoid(zi @ u) - y)) / n
        new[1:] = np.sign(new[1:]) * np.maximum(np.abs(new[1:]) - rate * penalty, 0)
        t, s = (1 + np.sqrt(1 + 4 * t * t)) / 2, t
        w, u = new, new + np.float32((s - 1) / t) * (new - w)
    return float(w[0]), w[1:]


@dataclass
class RuleEnsemble:
    """An intercept and weighted rules."""

    intercept: float
    rules: list[tuple[Rule, float]]

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, trees: int = 40, depth: int = 3, rate: float = 0.3, cuts: int = 32, penalties: tuple[float, ...] = (0.01, 0.003, 0.001), steps: int = 200, seed: int = 0) -> RuleEnsemble:
        """``x`` has a column for each of ``STATISTICS``. Without both labels the score is the constant share of ones (0.5 without rows)."""
        if len(y) == 0 or y.min() == y.max():
            p = min(max(float(y.mean()), 1e-3), 1 - 1e-3) if len(y) else 0.5
            return cls(float(np.log(p / (1 - p))), [])
        rng, y = np.random.default_rng(seed), y.astype(float)
        edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, cuts + 1)[1:-1], method="lower")) for f in range(x.shape[1])]
        # A few values beyond the bulk are worth a cut of their own: rare kinds of bad texts.
        edges = [e[e < x[:, f].max()] for f, e in enumerate(edges)]
        codes = np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)], axis=1)
        least, score, paths = max(5, len(y) // 500), np.zeros(len(y)), []
        for _ in range(trees):
            rows, pred = np.sort(rng.permutation(len(y))[: max(10, len(y) // 2)]), np.zeros(len(y))
            grown: list[tuple] = []
            residual = y - _sigmoid(score)
            _grow(codes, edges, residual, rows, depth, least, (), grown, pred)
            paths += grown
            leaves = [p for p in grown if not any(len(q) > len(p) and q[: len(p)] == p for q in grown)]
            for p in leaves:
                hit = cls._holds(codes, p)
                r, q = residual[hit], _sigmoid(score[hit])
                score[hit] += rate * np.clip(r.sum() / (np.sum(q * (1 - q)) + 1), -4, 4)
        kept, columns, seen = [], [], set()
        for p in paths:
            hit = cls._holds(codes, p)
            key = np.packbits(hit).tobytes()
            if key not in seen and least <= hit.sum() <= len(y) - least:
                seen.add(key)
                kept.append(p)
                columns.append(hit)
        z = np.stack(columns, axis=1).astype(float) if columns else np.zeros((len(y), 0))
        tune = rng.random(len(y)) < 0.8
        losses = []
        for c in penalties:
            b, w = _lasso(z[tune], y[tune], c, steps)
            q = np.clip(_sigmoid(b + z[~tune] @ w), 1e-6, 1 - 1e-6)
            losses.append(-np.mean(y[~tune] * np.log(q) + (1 - y[~tune]) * np.log(1 - q)) if (~tune).any() else 0)
        b, w = _lasso(z, y, penalties[int(np.argmin(losses))], steps)
        named = [tuple((STATISTICS[f], low, float(edges[f][at])) for f, low, at in p) for p in kept]
        return cls(b, [(r, float(v)) for r, v in zip(named, w, strict=True) if abs(v) > 1e-3])

    @staticmethod
    def _holds(codes: np.ndarray, path: tuple) -> np.ndarray:
        hit = np.ones(len(codes), bool)
        for f, low, at in path:
            hit &= (codes[:, f] <= at) == low
        return hit

    def column(self) -> Column:
        """The probability of label 1, from the statistics' columns."""
        total = F.lit(self.intercept)
        for rule, weight in self.rules:
            holds = F.lit(True)
            for name, low, cut in rule:
                holds = holds & (F.col(name) <= cut if low else F.col(name) > cut)
            total = total + F.when(holds, F.lit(weight)).otherwise(F.lit(0.0))
        return 1 / (1 + F.exp(-total))

    def scores(self, x: np.ndarray) -> np.ndarray:
        """The same for rows of statistics."""
        total = np.full(len(x), self.intercept)
        for rule, weight in self.rules:
            hit = np.ones(len(x), bool)
            for name, low, cut in rule:
                hit &= (x[:, STATISTICS.index(name)] <= cut) == low
            total += weight * hit
        return 1 / (1 + np.exp(-total))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = 10_000) -> RuleEnsemble:
    """Fit on at most ``sample`` labelled documents, chosen by hashes of their ids; the rest of the corpus is only scored.

    Null ids and null labels are left out; of several labels of an id the largest counts. The chosen ids, a bounded number, are broadcast.
    """
    known = labels.filter(f"{id_col} is not null and {label_col} is not null").groupBy(F.col(id_col).alias("_i")).agg(F.max(label_col).cast("double").alias("_y"))
    there = stored(known.join(docs.select(F.col(id_col).alias("_i")).distinct(), "_i", "left_semi"), "labelled")
    chosen = hashed_sample(there, "_i", sample, there.count())
    texts = docs.select(F.col(id_col).alias("_i"), F.col(text_col).alias("_text")).join(F.broadcast(chosen), "_i")
    rows = statistics(texts, "_text", ("_i", "_y")).select(*STATISTICS, F.col("doc._y").alias("_y"), F.xxhash64("doc._i").alias("_h"))
    found = rows.orderBy("_h", *STATISTICS).limit(sample).toArrow()
    return RuleEnsemble.fit(np.stack([found.column(s).to_numpy() for s in STATISTICS], axis=1), found.column("_y").to_numpy())


def score_quality(
    docs: DataFrame, labels: DataFrame, folds: int = 5, held_out: int = 0, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", keep: tuple[str, ...] = ("doc_id",), sample: int = 10_000
) -> DataFrame:
    """``doc`` (the ``keep`` columns), ``held_out``, ``score`` (0 to 1, higher: label 1 likelier) and ``predicted`` (1 from ``threshold``).

    Labels are learned only from rows whose id's remainder is not ``held_out``; a null id has no remainder, is not held out and never learned from.
    A null or empty text is scored by statistics of 0. Repeated rows are scored alike, each on its own; only statistics of the text
    are inputs. An empty table gives no rows.
    """
    model = train(docs, labels.filter(fold(id_col, folds) != held_out), id_col, text_col, label_col, sample)
    measured = statistics(docs, text_col, keep)
    remainder = F.crc32(F.col(f"doc.`{id_col}`").cast("string").cast("binary")) % folds
    return measured.select("doc", F.coalesce(remainder == held_out, F.lit(False)).alias("held_out"), model.column().alias("score")).withColumn("predicted", (F.col("score") >= threshold).cast("int"))
