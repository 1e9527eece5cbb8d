import itertools
import random

import pytest

from tests.conftest import rows
from tripweave.operators.aggregate import aggregate_rides
from tripweave.operators.normalize import add_slice_columns
from tripweave.schema import aggregate_label
from tripweave.sinks.aggregate_store import AggregateStore, choose_aggregate, split_label, touched_months


def months_of(path) -> list[str]:
    return sorted(p.name for p in path.iterdir() if p.is_dir())


def some_rides(rides_of):
    """Rides of three end months, across a month end, without a stop time, with nulls in keys."""
    return add_slice_columns(
        rides_of(
            {},
            {"stop_time": "2020-01-31 23:59:00"},
            {"gender": None},
            {"gender": None, "stop_time": "2020-01-31 23:58:00", "start_region": "JC"},
            {"user_type": None},
            {"start_time": "2020-03-01 00:00:00", "stop_time": "2020-03-01 01:00:00"},
            {"stop_time": None, "gender": 2},
        )
    )


def test_late_rides_of_an_old_month_are_counted(spark, rides_of, tmp_path):
    rides, store = some_rides(rides_of), AggregateStore(spark, str(tmp_path))
    assert store.sizes() == {}
    first = rides.where("coalesce(end_ym, 0) <> 202002")
    label = store.refresh(first, "ymrgt", "cd")
    assert label == "ymrgt_cd" and rows(store.read(label)) == rows(aggregate_rides(first, "ymrgt", "cd"))
    months = touched_months(rides.where("end_ym = 202002"), first.where("end_ym = 202001"))
    assert months == [202001, 202002]
    before = {p: p.stat().st_mtime_ns for p in (tmp_path / label / "end_ym=202003").iterdir()}
    store.refresh(rides, "ymrgt", "cd", months)
    assert rows(store.read(label)) == rows(aggregate_rides(rides, "ymrgt", "cd"))
    assert {p: p.stat().st_mtime_ns for p in (tmp_path / label / "end_ym=202003").iterdir()} == before
    some = rides.where("end_ym in (202002, 202003)")
    assert rows(store.read(label, "r", "c", [202003, 202002])) == rows(aggregate_rides(some, "r", "c"))


def test_months_that_lose_all_rides(spark, rides_of, tmp_path):
    rides, store = some_rides(rides_of), AggregateStore(spark, str(tmp_path))
    label = store.refresh(rides, "yg", "c")
    assert months_of(tmp_path / label) == ["end_ym=202001", "end_ym=202002", "end_ym=202003", "end_ym=__HIVE_DEFAULT_PARTITION__"]
    left = rides.where("end_ym <> 202001")
    store.refresh(left, "yg", "c", [None, 202001, 202002])
    assert months_of(tmp_path / label) == ["end_ym=202002", "end_ym=202003"]
    assert rows(store.read(label)) == rows(aggregate_rides(left, "yg", "c"))
    store.refresh(rides, "yg", "c", [None, 202001])
    assert rows(store.read(label)) == rows(aggregate_rides(rides, "yg", "c"))


def test_a_smaller_aggregate_keeps_rides_with_nulls_in_other_keys(spark, rides_of, tmp_path):
    rides, store = some_rides(rides_of), AggregateStore(spark, str(tmp_path))
    for keys in ("ymrgtb", "ymdwhg"):
        store.refresh(rides, keys)
    for keys, measures in (("y", "c"), ("r", "cd"), ("gt", "d"), ("wh", "cd"), ("ymrgtb", "cd"), ("", "c")):
        found = store.aggregate(keys, measures)
        assert rows(found) == rows(aggregate_rides(rides, keys, measures)), keys
        plan = found._jdf.queryExecution().optimizedPlan().toString()
        assert "start_time" not in plan and "stop_time" not in plan
    with pytest.raises(LookupError):
        store.aggregate("s")
    assert rows(store.aggregate("s", "c", rides)) == rows(aggregate_rides(rides, "s", "c"))


def test_scans_no_rides(spark, rides_of, tmp_path):
    path = str(tmp_path / "rides")
    some_rides(rides_of).write.partitionBy("end_ym").parquet(path)
    rides, store = spark.read.parquet(path), AggregateStore(spark, str(tmp_path / "store"))
    store.refresh(rides, "ywhg")
    files = store.aggregate("wh", "c", rides).inputFiles()
    assert files and all("/store/ywhg_cd/" in f for f in files)


def test_an_unfinished_aggregate_is_none(spark, rides_of, tmp_path):
    store = AggregateStore(spark, str(tmp_path))
    store.refresh(some_rides(rides_of), "yg")
    (tmp_path / "yg_cd" / "_SUCCESS").unlink()
    assert store.sizes() == {}


def test_every_key_set_gets_the_smallest_that_holds_it():
    """All 2,048 sets of eleven letters against a search by hand."""
    letters, rng = "ymdwhrgtbse", random.Random(0)
    for _ in range(3):
        stored = {}
        while len(stored) < 25:
            keys = "".join(c for c in letters if rng.random() < 0.6)
            stored[aggregate_label(keys, rng.choice(("c", "d", "cd")))] = rng.randrange(1, 6) * 100
        for n in range(len(letters) + 1):
            for wanted in itertools.combinations(letters, n):
                for measures in ("c", "cd"):
                    fits = [s for s in stored if not set(wanted) - set(split_label(s)[0]) and not set(measures) - set(split_label(s)[1])]
                    chosen = choose_aggregate(stored, "".join(wanted), measures)
                    assert (chosen in fits and stored[chosen] == min(stored[s] for s in fits)) if fits else chosen is None
