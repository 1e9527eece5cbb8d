import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tests.llm.conftest import EDGES
from tripweave.llm.packing import in_stored_order, pack
from tripweave.llm.queries import TOKENIZER, op1_packing
from tripweave.llm.tokens import Encoder

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def model():
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    return t


def check(pieces, docs, model, size=4096):
    """Round trip: sequences are gapless, and the pieces of all documents hold every id once."""
    for _, s in pieces.sort_values(["sequence_id", "offset"]).groupby("sequence_id"):
        assert s.offset.tolist() == [0, *np.cumsum(s.length)[:-1]]
        assert s.length.sum() <= size
    wanted = sorted((str(i), np.array([*model.encode(t or "", add_special_tokens=False).ids, 2], "<u4").tobytes()) for i, t in docs)
    whole, open_ = [], {}
    for r in pieces.sort_values(["doc_id", "doc_tokens", "start"]).itertuples():
        open_.setdefault((str(r.doc_id), r.doc_tokens, r.start), []).append(r.ids)
        assert len(r.ids) == 4 * r.length
    for i, ids in wanted:
        at, n = 0, len(ids) // 4
        while at < n:
            found = open_[(i, n, at)]
            piece = next(p for p in found if p == ids[4 * at : 4 * at + len(p)])
            found.remove(piece)
            at += len(piece) // 4
        whole.append(i)
    assert not any(open_.values())


def test_order_needs_files(docs_of):
    with pytest.raises(ValueError):
        in_stored_order(docs_of(EDGES))


def test_edges(docs_of, model):
    docs = docs_of([*EDGES, (8, "<|endoftext|>test")], clashes=True)
    pieces = pack(docs, TOKENIZER)
    assert pieces.columns == ["doc_id", "start", "length", "doc_tokens", "ids", "sequence_id", "offset"]
    found = pieces.withColumn("doc_id", F.coalesce(F.col("doc_id").cast("string"), F.lit("None"))).toPandas()
    check(found, [(r[0], r[1]) for r in EDGES] + [(8, "<|endoftext|>test")], model)
    assert pack(docs.limit(0), TOKENIZER).count() == 0


def test_small_windows_and_many_partitions(spark, docs_of, model):
    rng = np.random.default_rng(0)
    docs = [(i, " ".join(["word"] * int(rng.integers(0, 90)))) for i in range(400)]
    found = pack(docs_of(docs).repartition(7), TOKENIZER, size=64, open_windows=3).toPandas()
    found["doc_id"] = found["doc_id"].astype(str)
    check(found, docs, model, 64)
    used = found.groupby("sequence_id").length.sum()
    assert used.sum() / (64 * len(used)) > 0.95


def test_query(spark, model):
    found = op1_packing(spark, SF).toPandas()
    texts = dict(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect())
    assert set(found.doc_id) == set(texts)
    for i, p in found.groupby("doc_id"):
        ids = np.array([*model.encode(texts[i], add_special_tokens=False).ids, 2], "<u4")
        p = p.sort_values("start")
        assert p.start.tolist() == [0, *np.cumsum(p.length)[:-1]] and p.length.sum() == len(ids) == p.doc_tokens.iloc[0]
        assert [zlib.crc32(ids[a : a + n].tobytes()) for a, n in zip(p.start, p.length, strict=True)] == p.ids_crc32.tolist()


def test_words_by_memory_are_the_tokenizer_s(model):
    encoder = Encoder(TOKENIZER, memory=50, segment=20)
    texts = ["It's the end, isn't it?", "ßtraße ÀÉÎİ Σας ΣΑΣ", "á combined", "x" * 100, "<|endoftext|> 12½ ²", "<|endoftext|>test", "a <|STARTOFTEXT|> b<|endoftext|>", "<|endoftext", "tab\tand\x1fodd space", "", " ", "中文!!", "don''t 're'"]
    for _ in range(2):
        assert [np.frombuffer(b, "<u4").tolist() for b in encoder.encode(texts)] == [model.encode(t, add_special_tokens=False).ids for t in texts]
