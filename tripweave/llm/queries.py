"""The registered queries of the corpus operators: whole tables, production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tripweave.llm.bpe import decode_ids, encode_texts
from tripweave.llm.common import table
from tripweave.llm.context_tree import score_texts
from tripweave.llm.graph_search import nearest
from tripweave.llm.licences import scan_licences
from tripweave.llm.mixing import mix
from tripweave.llm.packing import pack
from tripweave.llm.quality import score_quality
from tripweave.llm.quantisation import near_duplicate_vectors
from tripweave.llm.ranked_search import search
from tripweave.llm.runs import periodic_runs
from tripweave.llm.secrets import BASE, find_secrets, joined
from tripweave.llm.simhash import near_duplicates
from tripweave.llm.toxicity import score_toxicity

#: The tokenizer file of the packing query; a parameter of the operator.
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")

#: The rank file and the pattern of the encoding query; parameters of the operator.
RANKS, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of 4096 tokens; the digest of a piece is taken from its ids."""
    pieces = pack(table(spark, sf_dir, "documents"), TOKENIZER)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op2_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence families of all paragraphs with a cue."""
    return scan_licences(table(spark, sf_dir, "documents")).drop("text")


def op3_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log-probabilities of every document under context-tree weighting, learned from six of seven documents."""
    return score_texts(table(spark, sf_dir, "documents"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The place of every document in a mix whose targets are the sources' sizes to the power 0.7."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    return mix(docs, alpha=0.7)


#: The chain's categories: toxic at all, in prose of good quality, in text of bad quality.
CATEGORIES = {"toxic": "toxic = 1", "toxic_prose": "toxic = 1 and quality = 1", "toxic_junk": "toxic = 1 and quality = 0"}


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Category probabilities of every document, learned from the labels of four fifths of the ids."""
    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), CATEGORIES)


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document; a source is an owner, a document a repository of its own."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    found = find_secrets(docs, owner_col="source", repo_col="doc_id", keep=["doc_id", "source"])
    base = F.filter("secrets", lambda x: x["kind"].isin(*BASE))

    def of(kind: str) -> Column:
        return F.size(F.filter("secrets", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")

    live = F.size(F.filter("secrets", lambda x: x["live"])).cast("long").alias("n_live")
    return found.select("doc.doc_id", *map(of, BASE), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("secrets")).alias("spans"), live)


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document: four words, four bits."""
    return near_duplicates(table(spark, sf_dir, "documents"))


def op8_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest of every vector whose id is divisible by 20, among all others."""
    vectors = table(spark, sf_dir, "embeddings")
    return nearest(vectors, vectors.filter(F.col("vec_id") % 20 == 0), k=20)


def op9_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links, component and representative of every vector, cosine 0.95."""
    return near_duplicate_vectors(table(spark, sf_dir, "embeddings"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document, learned from the labels of four fifths of the ids."""
    scored = score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scored.select("doc.doc_id", "held_out", "score", "predicted")


def op11_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every document, decoded again; the digests are taken from the ids and the bytes."""
    encoded = encode_texts(table(spark, sf_dir, "documents"), RANKS, PATTERN)
    decoded = decode_ids(encoded, RANKS, PATTERN)
    ids = F.sha2(F.array_join(F.col("ids").cast("array<string>"), " ").cast("binary"), 256)
    return decoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), ids.alias("ids_sha256"), F.sha2("bytes", 256).alias("decoded_sha256"))


def _planted(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``text``; the words of every tenth document repeat from a place on, as its hash says."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    some = docs.select("doc_id", "text", F.floor(h / 10).alias("g"), F.when(h % 10 == 0, words).alias("w")).withColumn("n", F.size("w").cast("long"))
    a = F.col("g") % F.col("n")
    p = 1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8))
    some = some.withColumn("a", F.when(F.col("n") > 0, a)).withColumn("p", p)
    rest = (F.col("n") - F.col("a")).cast("int")
    again = F.flatten(F.array_repeat(F.slice("w", (F.col("a") + 1).cast("int"), F.col("p").cast("int")), F.ceil(rest / F.col("p")).cast("int")))
    planted = F.concat(F.slice("w", F.lit(1), F.col("a").cast("int")), F.slice(again, F.lit(1), rest))
    return some.select("doc_id", F.when(F.col("n") > 0, F.array_join(planted, " ")).otherwise(F.col("text")).alias("text"))


def op12_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periodic runs of every document's words, the greatest of them and the words that are left without repeats."""
    found = periodic_runs(_planted(table(spark, sf_dir, "documents")))
    greater = lambda best, r: F.when(best.isNull() | (r["length"] * best["period"] > best["length"] * r["period"]), r).otherwise(best)
    best = F.aggregate("runs", F.lit(None).cast("struct<start: bigint, length: bigint, period: bigint>"), greater)
    listed = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", *(r[n].cast("string") for n in ("start", "length", "period"))), F.lit("\n"))), "")
    told = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), F.sha2(listed, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    exponent = F.floor(1000 * F.col("best.length") / F.col("best.period")).alias("exponent_milli")
    return told.select("doc_id", "n_runs", "best.start", "best.length", "best.period", exponent, "runs_sha256", "collapsed_sha256")


def op13_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best of all documents for each benchmark item."""
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_packing, op2_licences, op3_scoring, op4_mixing, op5_toxicity, op6_secrets, op7_simhash, op8_neighbours, op9_vectors, op10_quality, op11_bpe, op12_runs, op13_search)}

#: The polynomial of CRC-32, and its remainder of a text of digits and signs.
_CRC32 = """xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ord(c) AS BIGINT))),
      lambda crc, b: list_reduce([xor(crc, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, z: xor(x >> 1, 3988292384 * (x & 1)))))"""

#: Equal words at a distance q, stretches of neighbouring ones, and the smallest q of each.
RUNS_SQL = f"""WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, {_CRC32} AS h,
      regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
  g AS (SELECT r, doc_id, w, len(w) AS n, h % 10 = 0 AND len(w) > 0 AS planted, h // 10 AS g FROM d),
  a AS (SELECT *, CASE WHEN planted THEN g % n END AS a, CASE WHEN planted THEN 1 + (n - g % n) // (3 + g % 8) END AS p FROM g),
  u AS (SELECT r, n, w, a, p, planted, unnest(range(n)) AS i FROM a),
  v AS MATERIALIZED (SELECT r, n, i, w[CASE WHEN planted AND i >= a THEN a + (i - a) % p ELSE i END + 1] AS word FROM u),
  e AS (SELECT x.r, y.i - x.i AS q, x.i FROM v x JOIN v y ON x.r = y.r AND x.word = y.word AND x.i < y.i AND (y.i - x.i) * 3 <= x.n),
  s AS (SELECT r, q, i, i - row_number() OVER (PARTITION BY r, q ORDER BY i) AS island FROM e),
  t AS (SELECT r, q, min(i) AS start, count(*) + q AS length FROM s GROUP BY r, q, island HAVING count(*) + q >= greatest(24, 3 * q)),
  runs AS MATERIALIZED (SELECT r, start, length, min(q) AS period FROM t GROUP BY r, start, length),
  listed AS (SELECT r, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS told FROM runs GROUP BY r),
  best AS (SELECT DISTINCT ON (a.r) a.* FROM runs a WHERE NOT EXISTS (SELECT 1 FROM runs b WHERE b.r = a.r AND b.length * a.period > a.length * b.period) ORDER BY a.r, start, period),
  kept AS (SELECT v.r, string_agg(word, ' ' ORDER BY i) AS words FROM v
    WHERE NOT EXISTS (SELECT 1 FROM runs x WHERE x.r = v.r AND v.i >= x.start + x.period AND v.i < x.start + x.length) GROUP BY v.r)
  SELECT doc_id, coalesce(n_runs, 0) AS n_runs, start, length, period, (1000 * length) // period AS exponent_milli, sha256(coalesce(told, '')) AS runs_sha256, sha256(coalesce(words, '')) AS collapsed_sha256
  FROM d LEFT JOIN listed USING (r) LEFT JOIN best USING (r) LEFT JOIN kept USING (r)"""

#: Every term of every document.
SEARCH_SQL = """WITH terms AS MATERIALIZED (SELECT r, doc_id, unnest(w) AS term, len(w) AS n FROM (SELECT row_number() OVER () AS r, doc_id,
      regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS w FROM documents)),
  total AS (SELECT count(DISTINCT r) AS docs, count(*) AS words FROM terms),
  held AS (SELECT r, doc_id, term, n, count(*) AS tf FROM terms GROUP BY ALL),
  weights AS (SELECT term, CAST(floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM held, total GROUP BY term, docs),
  asked AS (SELECT q, item_id, term, count(*) AS times FROM (SELECT row_number() OVER () AS q, item_id,
      unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term
      FROM (SELECT DISTINCT item_id, text FROM benchmark)) GROUP BY ALL),
  scored AS (SELECT q, item_id, r, doc_id, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + (75 * n * docs) // words)))) AS BIGINT) AS score
    FROM asked JOIN held USING (term) JOIN weights USING (term), total GROUP BY ALL),
  ranked AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM scored WHERE score > 0)
  SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM ranked WHERE rank <= 10"""

#: All pairs, and what they reach. The other operators have no SQL form: trained models, token ids, hashes and graphs.
SQL: dict[str, str] = {
    "op9_vectors": """WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
  good AS MATERIALIZED (SELECT * FROM v WHERE len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
  linked AS (SELECT a.vec_id AS i, b.vec_id AS j FROM good a JOIN good b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
    WHERE list_cosine_similarity(a.e, b.e) >= 0.95),
  reach AS (SELECT vec_id AS i, vec_id AS j FROM v UNION SELECT r.i, l.j FROM reach r JOIN linked l ON r.j = l.i),
  least AS (SELECT i, min(j) AS component_id FROM reach GROUP BY i),
  counted AS (SELECT i, CAST(count(*) AS BIGINT) AS n FROM linked GROUP BY i)
  SELECT v.vec_id, coalesce(c.n, 0::BIGINT) AS n_links, component_id, v.vec_id = component_id AS kept
  FROM v JOIN least ON v.vec_id = least.i LEFT JOIN counted c ON v.vec_id = c.i""",
    "op12_runs": RUNS_SQL,
    "op13_search": SEARCH_SQL,
}
