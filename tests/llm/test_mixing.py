from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tests.llm.conftest import EDGES
from tripweave.llm import mixing
from tripweave.llm.mixing import in_mixed_order, mix, schedule, slots_of_blocks, slots_per_period
from tripweave.llm.queries import op4_mixing

SF = "/root/testdata/sf0.01"


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(1, 60), min_size=1, max_size=12))
def test_less_than_one_block_off_at_every_slot(shares):
    named = {f"s{i}": a for i, a in enumerate(shares)}
    order, period = schedule(named), sum(shares)
    for s, a in named.items():
        used = np.cumsum([x == s for x in order])
        assert used[-1] == a
        assert np.abs(used - np.arange(1, period + 1) * a / period).max() < 1


@settings(max_examples=40, deadline=None)
@given(st.lists(st.floats(1e-6, 1e6), min_size=1, max_size=30), st.integers(60, 2000))
def test_slots(weights, period):
    out = slots_per_period({f"s{i}": w for i, w in enumerate(weights)}, period)
    assert sum(out.values()) == period and min(out.values()) >= 1


def test_every_row_once_and_in_proportion(spark):
    found = op4_mixing(spark, SF).toPandas()
    assert found.doc_id.is_unique and len(found) == spark.read.parquet(f"{SF}/documents.parquet").count()
    blocks = found.drop_duplicates(["source", "block"])
    assert blocks.slot.is_unique
    assert found.groupby(["source", "block"]).size().max() == 32
    for _, b in blocks.groupby("source"):
        slots = np.sort(b.slot)
        t = np.arange(slots[-1] + 2)
        assert np.abs(np.searchsorted(slots, t) - t * b.weight.iloc[0]).max() < 1
    for _, b in found.groupby(["source", "block"]):
        assert sorted(b.place) == list(range(len(b)))


def test_a_large_table_gets_larger_blocks(docs_of, monkeypatch):
    """The schedule stays as long; sources keep within a block of their targets."""
    monkeypatch.setattr(mixing, "MOST_BLOCKS", 50)
    docs = docs_of([(i, "t", "en", "hot" if i % 3 else f"s{i % 4}", 1) for i in range(4000)])
    found = mix(docs, alpha=0.7, block=8).toPandas()
    blocks = found.drop_duplicates(["source", "block"])
    assert len(found) == 4000 and 50 <= len(blocks) <= 55 and found.place.max() == 79
    for _, b in blocks.groupby("source"):
        slots = np.sort(b.slot)
        t = np.arange(slots[-1] + 2)
        assert np.abs(np.searchsorted(slots, t) - t * b.weight.iloc[0]).max() < 1


def test_target_weights_and_a_hot_source(docs_of):
    rows = [(i, "t", "en", "hot" if i % 3 else f"s{i % 4}", 1) for i in range(4000)]
    out = mix(docs_of(rows).repartition(6), weights={"hot": 2.0, "s0": 1.0, "s1": 1.0, "s2": 1.0, "s3": 1.0}, block=8, bucket=100, period=60)
    found = out.toPandas()
    assert len(found) == 4000 and found.doc_id.is_unique
    assert found.groupby("source").weight.first().to_dict() == {"hot": 20 / 60, **{f"s{i}": 10 / 60 for i in range(4)}}
    ordered = found.sort_values(["slot", "place"]).source.tolist()[:600]
    assert abs(ordered.count("hot") - 200) <= 8
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas", "NestedLoop", "Cartesian"))


def test_edges(docs_of):
    docs = docs_of(EDGES)
    found = mix(docs).collect()
    assert len(found) == len(EDGES) and sorted({str(r.source) for r in found}) == ["None", "a", "b", "c"]
    assert mix(docs.limit(0)).count() == 0
    assert mix(docs, weights={None: 1, "a": 1, "b": 1, "c": 1, "unused": 5}).count() == len(EDGES)
    for bad in ({"a": 1.0}, {None: 1, "a": -1, "b": 1, "c": 1}):
        with pytest.raises(ValueError):
            mix(docs, weights=bad)
    clash = docs.withColumn("slot", F.lit("x"))
    assert dict(mix(clash).dtypes)["slot"] == "bigint"
    assert {r.slot for r in in_mixed_order(clash).collect()} == {"x"}
    assert in_mixed_order(clash.limit(0)).columns == clash.columns


def test_order(docs_of):
    rows = [(i, "t", "en", f"s{i % 2}", 1) for i in range(200)]
    docs = docs_of(rows, clashes=True).repartition(3).drop("block_")
    out = in_mixed_order(docs, block=10)
    assert out.columns == docs.columns
    found = [r.source for r in out.collect()]
    assert sorted(found) == sorted(r[3] for r in rows)
    assert [found[i] for i in range(0, 200, 10)] in (["s0", "s1"] * 10, ["s1", "s0"] * 10)


@settings(max_examples=40, deadline=None)
@given(st.lists(st.tuples(st.floats(1e-6, 1e6), st.integers(1, 300)), min_size=1, max_size=12))
def test_blocks_meet_releases_and_deadlines_of_true_weights(sources):
    weights, blocks = ({f"s{i}": x[k] for i, x in enumerate(sources)} for k in (0, 1))
    total, found = sum(Fraction(w) for w in weights.values()), slots_of_blocks(weights, blocks)
    every = sorted(x for slots in found.values() for x in slots)
    assert len(set(every)) == len(every) == sum(blocks.values())
    for s, slots in found.items():
        w = Fraction(weights[s]) / total
        assert len(slots) == blocks[s] and all(i // w <= x < -(-(i + 1) // w) for i, x in enumerate(slots))


def test_error_does_not_add_up_over_many_periods(docs_of):
    """Three equal sources and one far below a slot of 1,000, over 24 times 1,000 slots."""
    weights = {"a": 1.0, "b": 1.0, "c": 1.0, "rare": 0.000381}
    docs = docs_of([(0, "t")]).sparkSession.range(24_003).selectExpr("id AS doc_id", "string(id) AS text", "if(id >= 24000, 'rare', substring('abc', int(id % 3) + 1, 1)) AS source")
    found = mix(docs, weights=weights, block=1).toPandas()
    assert len(found) == found.slot.nunique() == 24_003
    for s, g in found.groupby("source"):
        target = weights[s] / sum(weights.values())
        assert abs(g.weight.iloc[0] - target) < 1e-12
        t = np.arange(g.slot.max() + 2)
        assert np.abs(np.searchsorted(np.sort(g.slot), t) - t * target).max() < 1
