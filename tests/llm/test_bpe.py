import array
import base64
import hashlib
import random

import pytest
import tiktoken

from tests.llm.conftest import EDGES
from tripweave.llm.bpe import Codec, RankQueue, decode_ids, encode_texts, read_ranks
from tripweave.llm.queries import PATTERN, RANKS, op11_bpe

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def plain():
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=read_ranks(RANKS), special_tokens={})


@pytest.fixture(scope="module")
def codec():
    return Codec(RANKS, PATTERN)


def ids_of(codec, text):
    return array.array("i", codec.encode(text)).tolist()


def by_search(ranks, piece):
    """The smallest rank of all neighbours merges, again and again."""
    if piece in ranks:
        return [ranks[piece]]
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while True:
        pairs = [(ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ranks]
        if not pairs:
            return [ranks[p] for p in parts]
        i = min(pairs)[1]
        parts[i : i + 2] = [parts[i] + parts[i + 1]]


def test_queue_finds_the_least_rank_at_every_level():
    rng, queue = random.Random(0), RankQueue(300_000)
    ranks = rng.sample(range(300_001), 500) + [0, 63, 64, 4095, 4096, 262_144, 300_000]
    for r in set(ranks):
        queue.push(r, [r])
    assert [queue.buckets.pop(queue.pop())[0] for _ in set(ranks)] == sorted(set(ranks))
    assert queue.pop() == -1 and not queue.top and not any(queue.leaf) and not any(queue.middle)


def test_any_order_of_ranks(tmp_path):
    """Vocabularies in which a merge brings up smaller ranks than its own."""
    rng = random.Random(1)
    for _ in range(100):
        tokens = {b"a", b"b", b"c"} | {bytes(rng.choices(b"abc", k=rng.randrange(2, 6))) for _ in range(25)}
        ranks = dict(zip(sorted(tokens), rng.sample(range(5000), len(tokens)), strict=True))
        path = tmp_path / "ranks"
        path.write_text("".join(f"{base64.b64encode(t).decode()} {r}\n" for t, r in ranks.items()))
        codec = Codec(str(path), ".+")
        for _ in range(30):
            piece = bytes(rng.choices(b"abc", k=rng.randrange(1, 40)))
            assert list(codec.merge(piece)) == by_search(ranks, piece)


def test_like_the_library(codec, plain):
    rng = random.Random(2)
    for _ in range(1500):
        kinds = ["abcdeinrstt", "aA ", "  \n\t　", "ü中é🙂", "0123²½ ", "'s're.,!?", "<|endoftext|>"]
        text = "".join(rng.choice(rng.choice(kinds)) for _ in range(rng.randrange(80)))
        assert ids_of(codec, text) == plain.encode_ordinary(text)
        assert codec.decode(ids_of(codec, text)) == text.encode()


def test_the_faster_pattern_cuts_alike(codec):
    rng, letters = random.Random(4), [chr(i) for i in range(0x250)]
    assert codec.plain is not None
    for _ in range(3000):
        text = "".join(rng.choice(rng.choice((letters, " 's\n\t a1.é"))) for _ in range(20))
        assert codec.plain.findall(text) == codec.pattern.findall(text)


@pytest.mark.parametrize("unit", ["a", "ab", "=-", "é", "the", " "])
def test_very_long_pre_tokens(codec, plain, unit):
    text = unit * (30_000 // len(unit))
    assert ids_of(codec, text) == plain.encode_ordinary(text)
    letters = "".join(random.Random(3).choices("abcdefghijklmnopqrstuvwxyz", k=200_000))
    assert list(codec.merge(letters.encode())) == plain._core_bpe.encode_single_piece(letters.encode())


def test_a_long_text_and_a_full_memory(plain):
    small = Codec(RANKS, PATTERN, memory=100)
    text = " ".join(f"word{i} {i}" for i in range(150_000))
    assert ids_of(small, text) == plain.encode_ordinary(text)


def test_query(spark, plain):
    texts = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    found = {r.doc_id: r for r in op11_bpe(spark, SF).collect()}
    assert set(found) == {i for i, _ in texts}
    for i, t in texts:
        ids = plain.encode_ordinary(t or "")
        assert found[i].n_tokens == len(ids)
        assert found[i].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert found[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()


def test_edges(docs_of, plain):
    docs = docs_of(EDGES, clashes=True)
    found = decode_ids(encode_texts(docs, RANKS, PATTERN), RANKS, PATTERN)
    assert found.columns == ["doc_id", "ids", "bytes"]
    wanted = [(r[0], plain.encode_ordinary(r[1] or ""), (r[1] or "").encode()) for r in EDGES]
    assert sorted(map(str, wanted)) == sorted(str((r.doc_id, r.ids, bytes(r.bytes))) for r in found.collect())
    assert encode_texts(docs.limit(0), RANKS, PATTERN).count() == 0
    nulls = docs.sparkSession.createDataFrame([(1, None), (2, [])], "doc_id long, ids array<int>")
    assert {r.doc_id: r.bytes for r in decode_ids(nulls, RANKS, PATTERN).collect()} == {1: None, 2: b""}
