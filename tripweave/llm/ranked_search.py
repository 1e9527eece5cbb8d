"""Ranked lexical search: the best documents for each of a set of queries, term at a time with a limited number of accumulators.

One pass over the documents counts their terms and keeps, per block of documents, lists of postings of the queries' terms. A second
pass reads the blocks. For each query it takes the terms from the rarest on and adds their exact integer weights to an accumulator per document. As soon
as all remaining terms together cannot lift a new document to the k-th best partial score, no accumulator is created any more; those that
exist are still updated exactly. The k-th best score that a task has found in earlier blocks is a limit from the start.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tripweave.llm.common import arrow_schema, map_texts, stored, text_batches

#: Characters of a block of documents.
BLOCK_CHARS = 8_000_000

#: ASCII letters in lower case and digits stay, other ASCII bytes separate; bytes of other characters stay.
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def terms_of(text: str) -> list[bytes]:
    return text.encode().translate(_TABLE).split()


def term_weight(documents: int, holding: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * holding + 1)))


def length_factor(length: int, documents: int, total: int) -> int:
    return 100 - 75 + (75 * length * documents) // total


def impacts(weight: np.ndarray, tf: np.ndarray, factor: np.ndarray) -> np.ndarray:
    """What ``tf`` occurrences of a term add to the score of a document."""
    return weight * ((1_000_000_000 * tf) // (1000 * tf + 8 * factor))


@dataclass
class Postings:
    """The documents of a block by number, ascending, for each term that one of them holds, and what the term adds to their score."""

    lists: dict[int, tuple[np.ndarray, np.ndarray]]
    documents: int

    def __post_init__(self):
        self.most = {t: int(added.max()) for t, (_, added) in self.lists.items()}


def best_of_block(block: Postings, query: list[tuple[int, int]], k: int, limit: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Numbers and scores of at least the ``k`` best documents with a score above 0, ties of the last included.

    ``query`` has (term, times) from the rarest term on. Documents with a score below ``limit`` can be missing.
    """
    terms = [(t, times) for t, times in query if t in block.lists]
    bounds = [times * block.most[t] for t, times in terms]
    rest, score, at, least = sum(bounds), np.zeros(block.documents, np.int64), 0, limit
    for (t, times), bound in zip(terms, bounds, strict=True):
        # A new document reaches ``rest`` at most; one that ties with the k-th may still come before it.
        if rest < least:
            break
        docs, added = block.lists[t]
        score[docs] += times * added
        rest -= bound
        at += 1
        if block.documents >= k:
            least = max(limit, int(np.partition(score, block.documents - k)[block.documents - k]))
    held = np.flatnonzero(score)
    for t, times in terms[at:]:
        docs, added = block.lists[t]
        found = np.minimum(np.searchsorted(docs, held), len(docs) - 1)
        score[held] += np.where(docs[found] == held, times * added[found], 0)
    scores = score[held]
    if len(held) > k:
        best = scores >= np.partition(scores, len(scores) - k)[len(scores) - k]
        held, scores = held[best], scores[best]
    return held, scores


def _collect_postings(number: dict[bytes, int], schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = number.get
        for batch, texts in text_batches(batches, BLOCK_CHARS):
            lengths, hits, whose = [], [], []
            for i, t in enumerate(texts):
                words = terms_of(t)
                known = [n for n in map(get, words) if n is not None]
                lengths.append(len(words))
                hits += known
                whose += [i] * len(known)
            key, tf = np.unique(np.array(hits, np.int64) * len(texts) + np.array(whose, np.int64), return_counts=True)
            term, doc = np.divmod(key, len(texts))
            # Documents without a term of any query count, but need not be kept.
            kept, doc = np.unique(doc, return_inverse=True)
            terms, begins, df = np.unique(term, return_index=True, return_counts=True)
            row = {
                "documents": sum(n > 0 for n in lengths),
                "total": sum(lengths),
                "terms": terms.tolist(),
                "df": df.tolist(),
                "ids": batch.column(0).take(pa.array(kept)).to_pylist(),
                "lengths": np.array(lengths, np.int64)[kept].tolist(),
                "begins": begins.astype("<i4").tobytes(),
                "docs": doc.astype("<i4").tobytes(),
                "tf": tf.astype("<i4").tobytes(),
            }
            yield pa.RecordBatch.from_pylist([row], schema=schema)

    return run


def _search_blocks(queries: list[list[tuple[int, int]]], weights: dict[int, int], documents: int, total: int, k: int, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[list[tuple]] = [[] for _ in queries]
        for batch in batches:
            for row in range(batch.num_rows):
                terms, ids, lengths, begins, docs, tf = (batch.column(i)[row].as_py() for i in range(6))
                begins, docs, tf = (np.frombuffer(x, "<i4").astype(np.int64) for x in (begins, docs, tf))
                factor = np.array([length_factor(n, documents, total) for n in lengths], np.int64)
                ends = [*begins[1:].tolist(), len(docs)]
                weight = np.repeat(np.array([weights[t] for t in terms], np.int64), np.diff([*begins.tolist(), len(docs)]))
                added = impacts(weight, tf, factor[docs]) if len(docs) else docs
                block = Postings({t: (docs[b:e], added[b:e]) for t, b, e in zip(terms, begins.tolist(), ends, strict=False)}, len(ids))
                for q, query in enumerate(queries):
                    limit = -best[q][-1][0] if len(best[q]) == k else 0
                    held, scores = best_of_block(block, query, k, limit)
                    if len(held):
                        new = [(-s, ids[d] is None, ids[d]) for d, s in zip(held.tolist(), scores.tolist(), strict=True) if s >= limit]
                        best[q] = sorted([*best[q], *new], key=lambda x: x[:2] if x[1] else x)[:k]
        rows = [{"query": q, "doc": x[2], "score": -x[0]} for q, found in enumerate(best) for x in found]
        yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return run


def _search(blocks_of: DataFrame, items: list[tuple], k: int, id_col: str, text_col: str, item_col: str, item_type: T.DataType) -> DataFrame:
    spark, id_type = blocks_of.sparkSession, blocks_of.schema[id_col].dataType
    texts = [terms_of(t or "") for _, t in items]
    number = {w: i for i, w in enumerate(sorted({w for t in texts for w in t}))}
    long, many = T.LongType(), T.ArrayType(T.LongType())
    block = T.StructType(
        [T.StructField(n, long) for n in ("documents", "total")]
        + [T.StructField("terms", many), T.StructField("df", many), T.StructField("ids", T.ArrayType(id_type)), T.StructField("lengths", many)]
        + [T.StructField(n, T.BinaryType()) for n in ("begins", "docs", "tf")]
    )
    blocks = stored(map_texts(blocks_of.select(id_col, text_col), _collect_postings(number, arrow_schema(block)), block), "postings")
    documents, total = blocks.agg(F.coalesce(F.sum("documents"), F.lit(0)), F.coalesce(F.sum("total"), F.lit(0))).first()
    # One row per term of the queries.
    pairs = F.explode(F.arrays_zip("terms", "df")).alias("t")
    df = {r.term: r.n for r in blocks.select(pairs).groupBy(F.col("t.terms").alias("term")).agg(F.sum("t.df").alias("n")).collect()}
    weights = {t: term_weight(documents, n) for t, n in df.items()}
    queries = []
    for own in texts:
        times: dict[int, int] = {}
        for w in own:
            times[number[w]] = times.get(number[w], 0) + 1
        queries.append(sorted(((t, n) for t, n in times.items() if t in df), key=lambda x: (df[x[0]], x[0])))
    found_type = T.StructType([T.StructField("query", long), T.StructField("doc", id_type), T.StructField("score", long)])
    search = _search_blocks(queries, weights, documents, total, k, arrow_schema(found_type))
    found = blocks.select("terms", "ids", "lengths", "begins", "docs", "tf").mapInArrow(search, found_type)
    order = Window.partitionBy("query").orderBy(F.desc("score"), F.col("doc").asc_nulls_last())
    best = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    names = spark.createDataFrame([(q, i) for q, (i, _) in enumerate(items)], T.StructType([T.StructField("query", long), T.StructField("item", item_type)]))
    return best.join(F.broadcast(names), "query").select(F.col("item").alias(item_col), "rank", F.col("doc").alias(id_col), "score")


def search(docs: DataFrame, items: DataFrame, k: int = 10, batch: int = 2000, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id") -> DataFrame:
    """The item's id, ``rank`` (from 1), the document's id and ``score``: the ``k`` best documents with a score above 0 for each item.

    Terms are runs of ASCII letters (in lower case), ASCII digits and characters outside ASCII; a null text has none. Ties go to the smaller document id,
    null last. A score sums, over an item's terms with repeats, the term's weight times its integer share (``term_weight``, ``length_factor``, ``impacts``); counts are
    over all documents that have a term. Repeated documents are documents of their own. Equal rows of ``items`` are one item; rows that share an id but not
    the text are ranked apart. Other columns are ignored; without items, documents or terms there are no rows.

    Items are handled in batches of about ``batch``, by hash, each with a pass over the documents; their texts and a number per term of theirs come to the
    driver. A task keeps the ``k`` best of each item of the batch over all its blocks, so that what is shuffled does not grow with the documents' length.
    """
    rows = items.select(item_col, text_col).distinct()
    parts = max(1, -(-rows.count() // batch))
    item_type = items.schema[item_col].dataType
    out = None
    for p in range(parts):
        some = [tuple(r) for r in rows.filter(F.pmod(F.xxhash64(item_col, text_col), F.lit(parts)) == p).collect()]
        found = _search(docs, some, k, id_col, text_col, item_col, item_type)
        out = found if out is None else out.unionByName(found)
    return out
