"""Licence families of paragraphs.

Blank lines separate paragraphs; the lines of one are read as one text. A multinomial logistic regression over word n-grams, kept
sparse by an L1 penalty, is trained on the templates, on varied and cut copies of them, and on an unknown class of other sentences and
of paragraphs of the corpus. Its probabilities are calibrated by a temperature on held-out rows; below a threshold a paragraph is unknown.
A family is confirmed if the paragraph shares enough three-word runs with one of its templates. Scoring is made of built-in
functions and joins alone.

The n-grams of the model hold a key: a word of a template that is no common word of the corpus, as a sample of its paragraphs
tells. A paragraph without any key has the probabilities of an empty one, so leaving it out decides nothing that the model would not.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tripweave.llm.common import stored
from tripweave.llm.licence_texts import NEGATIVES, TEMPLATES

UNKNOWN = "unknown"

#: What words about licences contain; a paragraph with one of them is reported even if its family is unknown.
STEMS = ("licens", "licenc", "copyright", "redistribut", "warrant", "merchantab", "noninfring", "spdx", "gpl", "unencumbered", "proprietary")

#: Lines without a letter or digit separate paragraphs.
BLANK = r"\n[^\p{L}\p{N}\n]*(?=\n)"

#: A template word in a larger share of the corpus's paragraphs is no key, unless it has a stem.
COMMON = 0.005


def words_of(text: str) -> list[str]:
    """Runs of letters and runs of digits in lower case; the v of a version that follows a name is a word of its own."""
    return re.findall(r"[a-z]+|[0-9]+", re.sub(r"([a-z])v(?=[0-9])", r"\1 v ", text.lower()))


def has_stem(text: str) -> bool:
    return any(s in text for s in STEMS)


def choose_keys(paragraphs: list[list[str]], common: float = COMMON) -> set[str]:
    """The words of templates, of two letters or more, that are rare in the given paragraphs or have a stem; up to five of them count as rare."""
    seen: dict[str, int] = {}
    for words in paragraphs:
        for w in set(words):
            seen[w] = seen.get(w, 0) + 1
    own = {w for texts in TEMPLATES.values() for t in texts for w in words_of(t) if len(w) > 1 and w.isalpha()}
    return {w for w in own if seen.get(w, 0) <= max(5, common * len(paragraphs)) or has_stem(w)}


def ngrams(words: list[str], keys: set[str], longest: int = 3) -> set[str]:
    """Runs of up to three words with a key among them."""
    at = [i for i, w in enumerate(words) if w in keys]
    return {" ".join(words[b : b + n]) for i in at for n in range(1, longest + 1) for b in range(max(0, i - n + 1), min(i, len(words) - n) + 1)}


def shingles(words: list[str]) -> set[str]:
    """Runs of three words; a shorter text is one run."""
    return {" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))}


def like_a_template(words: list[str]) -> bool:
    """Has half of a template's runs, or half of its own in common with one, or a common run with a stem."""
    own = shingles(words)
    for t in (shingles(words_of(t)) for texts in TEMPLATES.values() for t in texts):
        both = t & own
        if len(both) >= 0.5 * min(len(t), len(own)) or any(has_stem(r) for r in both):
            return True
    return False


@dataclass
class LicenceModel:
    classes: list[str]
    keys: set[str]
    features: dict[str, np.ndarray]
    bias: np.ndarray
    temperature: float

    @classmethod
    def fit(cls, others: list[list[str]], keys: set[str], copies: int = 30, least: int = 2, penalty: float = 2e-4, steps: int = 250, seed: int = 0) -> LicenceModel:
        """``others`` are the words of paragraphs of the corpus for the unknown class; none of them is like a template."""
        rng, classes = np.random.default_rng(seed), [*TEMPLATES, UNKNOWN]
        filler = sorted({w for words in others for w in words} - keys)
        filler = [filler[i] for i in rng.integers(0, len(filler), 4096)] if filler else ["text"]
        rows: list[set[str]] = []
        labels: list[int] = []

        def add(words: list[str], label: int) -> None:
            rows.append(ngrams(words, keys))
            labels.append(label)

        def varied(words: list[str], cut: bool) -> list[str]:
            if cut and len(words) > 12:
                n = int(rng.integers(8, len(words) + 1))
                at = int(rng.integers(0, len(words) - n + 1))
                words = words[at : at + n]
            words = [w for w in words if rng.random() > (0.05 if len(words) > 6 else 0)]
            if rng.random() < 0.3:
                words = ["v" if w == "version" else w for w in words]
            around = [filler[i] for i in rng.integers(0, len(filler), int(rng.integers(0, 8)))]
            return words + around if rng.random() < 0.5 else around + words

        for c, own in enumerate(TEMPLATES.values()):
            for t in own:
                w = words_of(t)
                add(w, c)
                for _ in range(copies):
                    add(varied(w, True), c)
        for t in NEGATIVES:
            for _ in range(copies):
                add(varied(words_of(t), False), len(classes) - 1)
        for w in others:
            add(w, len(classes) - 1)
        seen: dict[str, int] = {}
        for r in rows:
            for g in r:
                seen[g] = seen.get(g, 0) + 1
        grams = sorted(g for g, n in seen.items() if n >= least)
        number = {g: i for i, g in enumerate(grams)}
        x = np.zeros((len(rows), len(grams) + 1), np.float32)
        x[:, -1] = 1
        for i, r in enumerate(rows):
            for g in r:
                if g in number:
                    x[i, number[g]] = 1
        y = np.array(labels)
        tune = rng.random(len(y)) < 0.8
        w = cls._descend(x[tune], y[tune], len(classes), penalty, steps)
        z, t = x[~tune] @ w, y[~tune]
        temperatures = np.geomspace(0.3, 3, 25)
        losses = [-np.mean(cls._log_softmax(z / k)[np.arange(len(t)), t]) for k in temperatures]
        features = {g: w[i].astype(float) for g, i in number.items() if np.abs(w[i]).max() > 1e-3}
        return cls(classes, keys, features, w[-1].astype(float), float(temperatures[int(np.argmin(losses))]))

    @staticmethod
    def _log_softmax(z: np.ndarray) -> np.ndarray:
        z = z - z.max(axis=1, keepdims=True)
        return z - np.log(np.exp(z).sum(axis=1, keepdims=True))

    @classmethod
    def _descend(cls, x: np.ndarray, y: np.ndarray, classes: int, penalty: float, steps: int) -> np.ndarray:
        n = len(y)
        target = np.eye(classes, dtype=np.float32)[y]
        v = np.ones(x.shape[1], np.float32)
        for _ in range(15):
            v = x.T @ (x @ v)
            v /= np.linalg.norm(v)
        rate = np.float32(n / (0.5 * float(v @ (x.T @ (x @ v)))))
        w = u = np.zeros((x.shape[1], classes), np.float32)
        t = 1.0
        for _ in range(steps):
            g = x.T @ (np.exp(cls._log_softmax(x @ u)) - target) / n
            new = u - rate * g
            new[:-1] = np.sign(new[:-1]) * np.maximum(np.abs(new[:-1]) - rate * np.float32(penalty), 0)
            t, s = (1 + np.sqrt(1 + 4 * t * t)) / 2, t
            w, u = new, new + np.float32((s - 1) / t) * (new - w)
        return w

    def probabilities(self, text: str) -> np.ndarray:
        """The same as the query's, for one paragraph."""
        z = self.bias + sum((self.features[g] for g in ngrams(words_of(text), self.keys) if g in self.features), np.zeros(len(self.classes)))
        return np.exp(self._log_softmax(z[None, :] / self.temperature))[0]


def _has_stem(text: Column) -> Column:
    found = F.lit(False)
    for s in STEMS:
        found = found | F.contains(text, F.lit(s))
    return found


def _runs(words: Column, n: int) -> Column:
    """Runs of ``n`` words; none for fewer words."""
    at = F.when(F.size(words) >= n, F.sequence(F.lit(0), F.size(words) - n)).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: F.concat_ws(" ", *(F.get(words, i + k) for k in range(n))))


def paragraphs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``row``, the id, ``paragraph`` (its number among the parts that blank lines separate, from 0), ``text`` and ``words`` of all with a word."""
    found = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.posexplode(F.split(text_col, BLANK)).alias("paragraph", "text"))
    apart = F.regexp_replace(F.lower("text"), "([a-z])v(?=[0-9])", "$1 v ")
    return found.withColumn("words", F.regexp_extract_all(apart, F.lit("[a-z]+|[0-9]+"), F.lit(0))).filter(F.size("words") > 0)


def _distinct_sample(df: DataFrame, key: str, rows: int, total: int) -> DataFrame:
    """At most ``rows`` different values of ``key`` of a frame of ``total`` rows, chosen by hash; copies of a value count once."""
    if total > 2 * rows:
        df = df.filter(F.pmod(F.xxhash64(key, F.lit(7)), F.lit(1 << 40)) < int(1.2 * rows / total * (1 << 40)))
    return df.select(key).distinct().orderBy(F.xxhash64(key), key).limit(rows)


def scan_licences(docs: DataFrame, threshold: float = 0.5, confirm: float = 0.6, others: int = 2000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per paragraph of a licence family or with a stem of licence words: the id, ``paragraph``, ``text``, ``family``, ``probability``, ``similarity``, ``confirmed``.

    A paragraph is what blank lines separate, all its lines together. ``family`` is the likeliest if its calibrated probability reaches
    ``threshold``, else unknown. ``similarity`` is the largest share of three-word runs (of the shorter side) in common with a template of the family; from
    ``confirm`` the family is confirmed. Null and empty texts have no paragraphs; repeated rows are documents of their own;
    other columns are ignored; an empty table gives no rows.

    The unknown class learns from at most ``others`` whole, different paragraphs chosen by hash, half of them from at most ``others / 2`` documents
    and half from the paragraphs with a key; those like a template teach nothing. The former also tell which words are common. The tables of weights and templates, whose
    size the templates and ``others`` bound, are broadcast; n-grams are counted per paragraph, in any number of tasks.
    """
    spark, half = docs.sparkSession, others // 2
    some = stored(paragraphs(_distinct_sample(docs.select(F.col(text_col).alias("t")), "t", half, docs.count()), "t", "t"), "sample")
    general = [r.words for r in _distinct_sample(some, "words", half, some.count()).collect() if not like_a_template(r.words)]
    keys = choose_keys(general)
    lines = paragraphs(docs, id_col, text_col).filter(F.arrays_overlap("words", F.array(*map(F.lit, sorted(keys)))) | _has_stem(F.lower("text")))
    lines = stored(lines, "paragraphs")  # few, and used twice
    with_key = [r.words for r in _distinct_sample(lines, "words", half, lines.count()).collect() if not like_a_template(r.words)]
    model = LicenceModel.fit(general + with_key, keys)

    known = len(model.classes) - 1
    weights = F.broadcast(spark.createDataFrame([(g, w.tolist()) for g, w in model.features.items()], "gram string, w array<double>"))
    grams = F.array_distinct(F.concat(F.col("words"), _runs(F.col("words"), 2), _runs(F.col("words"), 3)))
    scored = lines.select("row", "paragraph", F.explode(grams).alias("gram")).join(weights, "gram").groupBy("row", "paragraph").agg(*(F.sum(F.col("w")[c]).alias(f"w{c}") for c in range(known + 1)))
    whole = lines.join(scored, ["row", "paragraph"], "left")
    logits = F.array(*((F.coalesce(F.col(f"w{c}"), F.lit(0.0)) + F.lit(float(b))) / F.lit(model.temperature) for c, b in enumerate(model.bias)))
    whole = whole.select("id", "paragraph", "text", "words", logits.alias("z")).withColumn("e", F.transform("z", lambda z: F.exp(z - F.array_max("z"))))
    whole = whole.withColumn("p", F.transform("e", lambda e: e / F.aggregate("e", F.lit(0.0), lambda a, b: a + b)))
    whole = whole.withColumn("best", F.array_max(F.slice("p", 1, known))).withColumn("at", F.array_position(F.slice("p", 1, known), F.col("best")).cast("int"))
    sure = (F.col("best") >= threshold) & (F.col("best") >= F.get("p", F.lit(known)))
    named = whole.withColumn("family", F.when(sure, F.get(F.array(*map(F.lit, model.classes)), F.col("at") - 1)).otherwise(F.lit(UNKNOWN))).withColumn("probability", F.when(sure, F.col("best")).otherwise(F.get("p", F.lit(known))))
    templates = F.broadcast(spark.createDataFrame([(f, [sorted(shingles(words_of(t))) for t in own]) for f, own in TEMPLATES.items()], "family string, runs array<array<string>>"))
    own = F.when(F.size("words") >= 3, F.array_distinct(_runs(F.col("words"), 3))).otherwise(F.array(F.array_join("words", " ")))
    compared = named.withColumn("own", own).join(templates, "family", "left")
    shares = F.transform("runs", lambda t: F.size(F.array_intersect(t, F.col("own"))) / F.least(F.size(t), F.size("own")))
    similar = compared.withColumn("similarity", F.coalesce(F.array_max(shares), F.lit(0.0))).filter((F.col("family") != UNKNOWN) | _has_stem(F.lower("text")))
    return similar.select(F.col("id").alias(id_col), "paragraph", "text", "family", "probability", "similarity", ((F.col("family") != UNKNOWN) & (F.col("similarity") >= confirm)).alias("confirmed"))
