import numpy as np

import corpus_pipeline as cp
from tests.llm.conftest import EDGES
from tripweave.llm import similar
from tripweave.llm.simhash import fingerprint
from tripweave.llm.similar import drop_similar


def shingles(text):
    w = text.lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def planted(rng, similarity_over, sizes):
    """Pairs (id, id + 10000) of random texts and copies with random words replaced, of at least a similarity."""
    words, rows, like = [f"w{i}" for i in range(5000)], [], {}
    for k, (size, replaced) in enumerate(sizes):
        while True:
            text = rng.choice(words, size)
            copy = text.copy()
            copy[rng.choice(size, replaced, replace=False)] = "other"
            a, b = shingles(" ".join(text)), shingles(" ".join(copy))
            if (j := len(a & b) / len(a | b)) >= similarity_over:
                break
        like[k] = j
        rows += [(k, " ".join(text)), (10_000 + k, " ".join(copy))]
    return rows, like


def test_stage_drops_copies_of_similarity_08_and_keeps_the_others(spark, docs_of):
    rng = np.random.default_rng(5)
    rows, like = planted(rng, 0.8, [(100, 1), (100, 2), (200, 2), (200, 4), (500, 3), (500, 10)] * 25)
    below, unlike = planted(rng, 0.0, [(100, 3), (200, 8)] * 25)
    clean = {k for k, j in unlike.items() if j < 0.8}
    rows += [(i + 50_000, t) for i, t in below]
    kept = {r.doc_id for r in cp.drop_copies(spark, docs_of(rows), "").collect()}
    assert {k for k in like} <= kept
    assert sum(10_000 + k in kept for k in like) <= 1
    assert all(60_000 + k in kept for k in clean) and all((60_000 + k in kept) == (k in clean) for k in unlike)


def test_large_group_in_blocks(spark, docs_of):
    rng = np.random.default_rng(6)
    text = rng.choice([f"w{i}" for i in range(5000)], 300)
    rows = []
    for i in range(1200):
        copy = text.copy()
        copy[rng.integers(300)] = f"x{i}"
        rows.append((i, " ".join(copy)))
    assert [r.doc_id for r in drop_similar(docs_of(rows)).collect()] == [0]


def test_edges(docs_of):
    docs = docs_of(EDGES, clashes=True)
    kept = drop_similar(docs)
    assert kept.columns == docs.columns and kept.count() == 6
    assert drop_similar(docs.limit(0)).count() == 0


def brute_smallest(rows):
    """The smallest id of each group that pairs of at least 0.8 connect."""
    sets, group = [(i, shingles(t)) for i, t in rows], {i: i for i, _ in rows}
    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if group[i] != group[j] and len(a & b) >= 0.8 * len(a | b):
                low, high = sorted((group[i], group[j]))
                group = {x: low if g == high else g for x, g in group.items()}
    return sorted(set(group.values()))


def test_chains_and_near_misses_against_all_pairs(docs_of):
    """Texts that drift away from a common one: similar to some of their band and not to others, in bands larger than a block."""
    rng = np.random.default_rng(7)
    words, rows = [f"w{i}" for i in range(3000)], []
    for g in range(6):
        text = rng.choice(words, 120)
        for k in range(40):
            text = text.copy()
            text[rng.choice(120, int(rng.integers(1, 4)), replace=False)] = f"x{g}-{k}"
            rows.append((1000 * g + k, " ".join(text)))
    rows = [rows[i] for i in rng.permutation(len(rows))]
    docs = docs_of(rows)
    kept = sorted(r.doc_id for r in similar.drop_similar(docs, block=8).collect())
    wanted = brute_smallest(rows)
    # Bands miss one pair in a thousand at the threshold.
    assert 10 < len(wanted) < 200 and len(set(kept) ^ set(wanted)) <= 1


def test_fingerprints_alone_propose_close_copies(docs_of, monkeypatch):
    """Without any band the trees still find copies within four bits, and what they bring together is compared exactly."""
    monkeypatch.setattr(similar, "band_keys", lambda shingles, bands: np.zeros(0, np.int64))
    rng, rows = np.random.default_rng(9), []
    for g in range(60):
        text = rng.choice([f"w{i}" for i in range(5000)], 400)
        copy = text.copy()
        copy[rng.integers(400)] = "other"
        rows += [(g, " ".join(text)), (1000 + g, " ".join(copy))]
    # Short texts without a common word can have near fingerprints and are no copies.
    rows += [(5000 + i, f"a{i}") for i in range(300)]
    near = [(similar.bits_of_most(similar.shingle_hashes(a)) ^ similar.bits_of_most(similar.shingle_hashes(b))).bit_count() <= 4 for (_, a), (_, b) in zip(rows[:120:2], rows[1:120:2])]
    kept = {r.doc_id for r in similar.drop_similar(docs_of(rows)).collect()}
    assert sum(near) > 20 and all((1000 + g in kept) != found for g, found in enumerate(near))
    assert {5000 + i for i in range(300)} <= kept


def test_fingerprints_are_those_of_the_operator():
    for t in ("", "one", "a b c d", "a b c d e", "the same words over and over the same words over and over"):
        assert similar.bits_of_most(similar.shingle_hashes(t, 5)) == fingerprint(t, 5)


def test_a_group_of_copies_costs_rows_in_proportion(docs_of, monkeypatch):
    rng, compared = np.random.default_rng(8), []
    linked = similar._linked_pairs
    monkeypatch.setattr(similar, "_linked_pairs", lambda pairs, *a: compared.append(pairs.count()) or linked(pairs, *a))
    text = rng.choice([f"w{i}" for i in range(5000)], 60)
    rows = []
    for i in range(1500):
        copy = text.copy()
        copy[rng.integers(60)] = f"x{i}"
        rows.append((i, " ".join(copy)))
    assert [r.doc_id for r in similar.drop_similar(docs_of(rows), block=100).collect()] == [0]
    # Three texts of its bands for each at first, then one more in each of three rounds at most.
    assert sum(compared) <= 6 * len(rows)
