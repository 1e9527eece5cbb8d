"""Near-duplicate documents by the exact Jaccard similarity of their word shingles.

Two ways propose groups of documents. SimHash fingerprints of the shingles are linked through vantage-point trees, within a few bits. That finds close copies
only: at Jaccard 0.8 fingerprints differ by about nine bits, up to 16, and balls of that radius reach all shards of a tree. So MinHash bands propose the others:
documents that agree in a band meet, and the bands are planned from the similarity that must not be missed. What either way brings together is then
compared exactly, so that no document goes because of a fingerprint or a band alone.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tripweave.llm.common import arrow_schema, broadcast_if_small, map_texts, stored, text_batches
from tripweave.llm.components import Forest, components
from tripweave.llm.simhash import bits_of_most, keep_first, links, shingle_spans

#: Least hashes that have to agree in a band; more of them propose fewer pairs below the similarity.
ROWS = 7


def shingle_hashes(text: str, words: int = 5, seed: int = 42) -> np.ndarray:
    """Hashes of the word shingles, repeats included, words as in ``simhash.fingerprint``; none for a text without words."""
    whole, begins, stops = shingle_spans(text, words)
    digest = xxhash.xxh64_intdigest
    return np.array([digest(whole[b:e], seed) for b, e in zip(begins, stops, strict=True)], np.uint64)


def shingle_set(text: str, words: int = 5) -> np.ndarray:
    """Ascending hashes of the distinct word shingles."""
    return np.unique(shingle_hashes(text, words))


def plan_bands(similarity: float, miss: float = 0.001, rows: int = ROWS) -> int:
    """Bands of ``rows`` hashes, so that a pair at the similarity agrees in none with probability ``miss``; nearer pairs miss less often."""
    return max(1, math.ceil(math.log(miss) / math.log(1 - similarity**rows))) if similarity < 1 else 1


def band_keys(shingles: np.ndarray, bands: int, rows: int = ROWS, block: int = 2048) -> np.ndarray:
    """One number per band, different in different bands."""
    rng = np.random.default_rng(11)
    times = rng.integers(0, 1 << 63, (bands * rows, 1), np.uint64) * np.uint64(2) + np.uint64(1)
    plus = rng.integers(0, 1 << 63, (bands * rows, 1), np.uint64)
    least = np.full(bands * rows, np.iinfo(np.uint64).max)
    for at in range(0, len(shingles), block):
        least = np.minimum(least, (times * shingles[at : at + block] + plus).min(axis=1))
    return np.array([xxhash.xxh64_intdigest(b.tobytes(), k) for k, b in enumerate(least.reshape(bands, rows))], np.uint64).view(np.int64)


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Of two ascending sets; two empty ones are alike."""
    if not len(a) and not len(b):
        return 1.0
    both = np.concatenate([a, b])
    both.sort(kind="stable")
    common = int((both[1:] == both[:-1]).sum())
    return common / (len(both) - common)


def _shingle_sets(docs: DataFrame, wanted: DataFrame, words: int, text_col: str) -> DataFrame:
    """``h`` and ``shingles`` (packed, ascending) of the wanted text hashes."""
    schema = T.StructType([T.StructField("h", T.LongType()), T.StructField("shingles", T.BinaryType())])
    arrow = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, found in text_batches(batches):
            sets = [shingle_set(t, words).astype("<u8").tobytes() for t in found]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], schema=arrow)

    # One text of each hash, combined before the shuffle.
    whole = docs.select(F.xxhash64(text_col).alias("h"), F.col(text_col).alias("t")).join(broadcast_if_small(wanted), "h", "left_semi")
    return map_texts(whole.groupBy("h").agg(F.first("t").alias("t")), run, schema)


def _unpacked(column: pa.Array | pa.ChunkedArray) -> list[np.ndarray]:
    """Packed sets as arrays over the column's own memory."""
    return [np.frombuffer(x.as_buffer(), "<u8") for x in column]


def _alike(a: np.ndarray, b: np.ndarray, similarity: float) -> bool:
    """At least so similar; the sizes alone often tell that they are not."""
    return min(len(a), len(b)) >= similarity * max(len(a), len(b)) and jaccard(a, b) >= similarity


def _linked_pairs(pairs: DataFrame, sets: DataFrame, similarity: float, block: int) -> DataFrame:
    """Of the pairs (h, m) those of at least the similarity, as edges (a, b).

    A text that many others are compared with is copied once per ``block`` of them, and the others are dealt to the copies.
    """
    asked = pairs.groupBy("m").agg(F.ceil(F.count("*") / block).cast("int").alias("copies"))
    dealt = pairs.join(asked, "m").withColumn("salt", F.pmod(F.xxhash64("h"), F.col("copies")).cast("int")).join(sets, "h")
    centres = asked.join(sets.select(F.col("h").alias("m"), F.col("shingles").alias("centre")), "m")
    centres = centres.select("m", "centre", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("salt"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sides = [_unpacked(batch.column(i)) for i in (2, 3)]
            keep = pa.array([_alike(x, y, similarity) for x, y in zip(*sides, strict=True)], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(i).filter(keep) for i in (0, 1)], names=["a", "b"])

    return map_texts(dealt.join(centres, ["m", "salt"]).select("h", "m", "shingles", "centre"), run, "a long, b long")


def _compare(similarity: float):
    """Spanning links between a block of the texts of a band and a block of those outside its main component."""

    def run(key: tuple, group: pa.Table) -> pa.Table:
        node, root, other = (group.column(c).to_numpy(zero_copy_only=False) for c in ("h", "root", "other"))
        order = np.lexsort([node, other])
        node, root, other = node[order], root[order], other[order]
        packed = _unpacked(group.column("shingles"))
        sets = [packed[k] for k in order.tolist()]
        size, forest = np.array([len(x) for x in sets]), Forest(len(node))
        # What is linked already stays together.
        _, first, whose = np.unique(root, return_index=True, return_inverse=True)
        forest.join(np.arange(len(node)), first[whose])
        own = int((~other).sum())
        for a in range(own, len(node)):
            b = np.arange(own)
            b = b[(np.minimum(size[a], size[b]) >= similarity * np.maximum(size[a], size[b])) & (node[b] != node[a])]
            b = b[forest.roots(b) != forest.roots(np.array([a]))]
            while len(b):
                at = next((k for k, c in enumerate(b.tolist()) if jaccard(sets[a], sets[c]) >= similarity), None)
                if at is None:
                    break
                forest.join(np.array([a]), b[at : at + 1])
                b = b[at + 1 :]
                b = b[forest.roots(b) != forest.roots(np.array([a]))]
        ends, roots = forest.edges()
        return pa.table({"a": pa.array(node[ends], pa.int64()), "b": pa.array(node[roots], pa.int64())})

    return run


def similar_links(docs: DataFrame, prints: DataFrame, words: int, similarity: float, text_col: str, radius: int = 4, block: int = 512, near: int = 3, stars: int = 4) -> DataFrame:
    """Edges (a, b) that connect the text hashes which links of at least the similarity connect.

    ``prints`` has ``h`` (text hash), ``fp`` (fingerprint) and ``bands`` of every row; fingerprints that trees connect are one more band. Only the hashes of shingles
    of documents that met another are stored. Every text is first compared with the smallest texts of its bands, of ``near`` at most, the largest bands first: as
    many rows as texts, which links a group of copies whole. Bands that are one component then are done. Of the others, bands of two are compared, and in
    bands of more than ``block`` every text with another of its bands' texts, up to ``stars`` times. What is left outside of a band's largest component is compared with
    all of the band, in blocks of ``block`` texts of both.
    """
    texts = stored(prints.groupBy("h").agg(F.first("fp").alias("fp"), F.first("bands").alias("bands")), "texts")
    close = components(links(stored(texts.select("fp").distinct(), "fingerprints"), radius)).select(F.col("node").alias("fp"), "root")
    group = F.xxhash64(F.lit("fingerprint"), F.coalesce("root", "fp"))
    texts = stored(texts.join(close, "fp", "left").select("h", F.array_append("bands", group).alias("bands")), "texts")
    met = texts.select("h", F.explode("bands").alias("band"))
    least = met.groupBy("band").agg(F.min("h").alias("m"), F.count("*").alias("n"))
    held = F.sort_array(F.collect_set(F.struct("n", "m")), asc=False)
    first = met.join(least, "band").groupBy("h").agg(F.max("n").alias("n"), held.alias("held")).filter("n > 1")
    others = F.filter(F.array_distinct(F.transform("held", lambda x: x["m"])), lambda m: m != F.col("h"))
    first = stored(first.select("h", F.slice(others, 1, near).alias("m")), "first")
    texts = stored(texts.join(first.select("h"), "h", "left_semi"), "met")
    sets = stored(_shingle_sets(docs, first.select("h"), words, text_col), "shingles")
    found = [stored(_linked_pairs(first.select("h", F.explode("m").alias("m")), sets, similarity, block), "links")]

    def open_bands(k: int) -> tuple[DataFrame, DataFrame]:
        """The members (band, h, root) of all bands, and the bands that are not one component, with a text of theirs, another one for each ``k``."""
        edges = found[0]
        for f in found[1:]:
            edges = edges.unionByName(f)
        reach = components(edges).select(F.col("node").alias("h"), F.col("root").alias("r"))
        members = stored(texts.join(reach, "h", "left").select("h", F.coalesce("r", "h").alias("root"), "bands"), "reach").select("h", "root", F.explode("bands").alias("band"))
        centre = F.min(F.struct(F.xxhash64("h", F.lit(k)), F.col("h").alias("m"), F.col("root").alias("main"))).alias("c")
        bands = members.groupBy("band").agg(centre, F.count("*").alias("n"), F.min("root").alias("low"), F.max("root").alias("high")).filter("low != high")
        return members, stored(bands.select("band", "n", "c.m", "c.main"), "open")

    members, bands = open_bands(1)
    for k in range(1, stars):
        apart = members.join(bands.filter(F.col("n") > block), "band").filter("root != main")
        pairs = apart.groupBy("h").agg(F.max(F.struct("n", F.xxhash64("m", F.lit(k)), "m")).alias("c")).select("h", "c.m")
        if k == 1:
            pairs = pairs.unionByName(members.join(bands.filter("n = 2"), "band").filter("root != main").select("h", "m")).distinct()
        pairs = stored(pairs, "pairs")
        if pairs.isEmpty():
            break
        found.append(stored(_linked_pairs(pairs, sets, similarity, block), "links"))
        members, bands = open_bands(k + 1)

    # Bands of two have been compared.
    left = members.join(bands.filter("n > 2").select("band", "n"), "band")
    sizes = left.groupBy("band", "root").agg(F.count("*").alias("size"))
    mains = sizes.groupBy("band").agg(F.max_by("root", F.struct("size", "root")).alias("main"))
    left = left.join(mains, "band").withColumn("far", F.col("root") != F.col("main"))
    blocks = left.groupBy("band").agg(*[F.ceil(F.count_if(c) / block).cast("int").alias(n) for c, n in ((F.lit(True), "i"), (F.col("far"), "j"))])
    left = left.join(blocks, "band")

    def dealt(rows: DataFrame, own: str, other: str) -> DataFrame:
        """Rows in one of their own blocks, for each of the other side's."""
        numbers = {own: F.pmod(F.xxhash64("h"), F.col(own)).cast("int"), other: F.explode(F.sequence(F.lit(0), F.col(other) - 1))}
        return rows.select("band", "h", "root", F.lit(own == "j").alias("other"), numbers[own].alias(f"_{own}"), numbers[other].alias(f"_{other}"))

    entries = dealt(left, "i", "j").unionByName(dealt(left.filter("far"), "j", "i")).join(sets, "h")
    entries = entries.select("band", "_i", "_j", "h", "root", "other", "shingles").groupBy("band", "_i", "_j")
    rest = stored(entries.applyInArrow(_compare(similarity), "a long, b long"), "rest")
    for f in found:
        rest = rest.unionByName(f)
    return rest


def drop_similar(docs: DataFrame, words: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text", radius: int = 4, block: int = 512) -> DataFrame:
    """The documents without near copies: of each group that links of at least ``similarity`` connect, the one with the smallest id.

    Links are proposed by fingerprints within ``radius`` bits and by bands that miss one pair in a thousand at the similarity.

    Ties, nulls and repeated rows as in ``simhash.drop_near_duplicates``.
    """
    bands = plan_bands(similarity)
    schema = T.StructType([T.StructField("i", docs.schema[id_col].dataType), T.StructField("h", T.LongType()), T.StructField("fp", T.LongType()), T.StructField("bands", T.ArrayType(T.LongType()))])
    arrow = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_batches(batches):
            keys, fps = [], []
            for t in texts:
                hashes = shingle_hashes(t, words)
                fps.append(bits_of_most(hashes))
                keys.append(band_keys(np.unique(hashes), bands))
            fp = pa.array(np.array(fps, np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(arrow[0].type), batch.column(1), fp, pa.array(keys, arrow[3].type)], schema=arrow)

    prints = stored(map_texts(docs.select(id_col, F.xxhash64(text_col), text_col), run, schema), "prints")
    reach = components(similar_links(docs, prints, words, similarity, text_col, radius, block))
    return keep_first(docs, prints.drop("bands", "fp"), "h", reach, id_col, text_col)
