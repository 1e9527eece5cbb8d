"""Five stages from raw documents to packed training sequences.

Every stage works on all that the stage before kept; its result is written as Parquet and read again. The folder is
the one the cluster names in spark.checkpoint.dir.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tripweave.llm.common import stored, table
from tripweave.llm.mixing import in_mixed_order
from tripweave.llm.packing import in_stored_order, pack
from tripweave.llm.quality import score_quality
from tripweave.llm.queries import TOKENIZER
from tripweave.llm.secrets import mask_secrets
from tripweave.llm.similar import drop_similar


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rule ensemble does not reject; labels teach it from the ids that are not held out."""
    scored = score_quality(docs, table(spark, sf_dir, "labels"), keep=tuple(docs.columns), text_col="text")
    return scored.filter("predicted = 1").select("doc.*")


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group linked by a similarity of 0.8 or more on five-word shingles."""
    return drop_similar(docs)


def mask(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with placeholders for secrets."""
    return mask_secrets(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents in the order of a mix whose targets are the sources' sizes to the power 0.7."""
    return in_mixed_order(docs, alpha=0.7)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of sequences of 4096 tokens, with their token ids; sequences are numbered in the order of the mix."""
    return pack(in_stored_order(docs.select("doc_id", "text")), TOKENIZER)


STAGES = [
    ("quality classifier", keep_quality),
    ("SimHash near-dedup", drop_copies),
    ("secret scans", mask),
    ("mixing sources to target weights", mix_sources),
    ("packing", pack_sequences),
]

#: Models, fingerprints and tokens have no SQL form; the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; every stage but the last is stored."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source", "n_chars")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir).select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "ids")
