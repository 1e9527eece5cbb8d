import uuid

import pytest
from pyspark.sql import functions as F

from tests.conftest import rows
from tests.test_skew import shuffled
from tripweave.operators import checksum, compare, reconcile
from tripweave.plans import workspace
from tripweave.schema import TIME_KEY
from tripweave.sinks import snapshots


@pytest.fixture
def no_broadcast(spark):
    name = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(name)
    spark.conf.set(name, "-1")
    yield
    spark.conf.set(name, before)


def stored(spark, df, tmp_path, buckets=4):
    name = f"snapshot_{uuid.uuid4().hex[:8]}"
    snapshots.write_snapshot(df, name, buckets, path=str(tmp_path / name))
    return snapshots.read_snapshot(spark, name)


def plan_of(df) -> str:
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


def sides(spark):
    """Keys on one side or both, repeated ones, ones with nulls on one side or both."""
    start = F.expr("TIMESTAMP_NTZ '2020-01-01 00:00:00'") + F.make_dt_interval(secs=(F.col("id") % 500).cast("decimal(18,6)"))
    rides = spark.range(600).select(start.alias("start_time"), F.when(F.col("id") % 9 > 0, start).alias("stop_time"), (F.col("id") % 70).cast("int").alias("birth_year"), (F.col("id") % 3).cast("int").alias("gender"), F.col("id").cast("int").alias("bike_id"))
    return rides.where("bike_id % 4 > 0 AND bike_id < 560"), rides.where("bike_id % 5 > 0")


def test_set_operations_move_no_rows(spark, tmp_path, no_broadcast):
    old, new = sides(spark)
    tables = stored(spark, old, tmp_path), stored(spark, new, tmp_path)
    known = [t.where("start_time IS NOT NULL AND stop_time IS NOT NULL") for t in tables]
    assert rows(snapshots.stored_counts(*tables)) == rows(compare.count_by_key(old, new, TIME_KEY))
    assert rows(snapshots.stored_statistics(*tables)) == rows(compare.set_statistics(old, new, TIME_KEY))
    for status, plain in (("added", compare.added_keys), ("lost", compare.lost_keys), ("both", compare.common_keys)):
        assert rows(snapshots.keys_with_status(*tables, status)) == rows(plain(old, new, TIME_KEY))
    # Keys with a null are few and are the only ones that are moved; without them nothing is.
    plan = plan_of(snapshots.stored_status(*known))
    assert "SortMergeJoin" in plan and "Exchange" not in plan
    assert plan_of(snapshots.stored_statistics(*known)).count("Exchange hashpartitioning") == 0


def test_diff_moves_no_rows(spark, tmp_path, no_broadcast):
    old, new = sides(spark)
    old, new = (s.withColumn("name", F.concat(F.lit("n"), F.col("birth_year").cast("string"))) for s in (old, new))
    tables = stored(spark, old, tmp_path), stored(spark, new, tmp_path)
    wanted = compare.snapshot_diff(old, new, TIME_KEY, ["name", "gender"])
    assert rows(snapshots.stored_diff(*tables, ["name", "gender"]).select(*wanted.columns)) == rows(wanted)
    # The aggregate after the joins is that of keys with a null.
    plan = plan_of(snapshots.stored_diff(*tables, ["name", "gender"])).split("SortAggregate")[0]
    assert plan.count("SortMergeJoin") == 3 and "Exchange" not in plan


def test_backfill_moves_no_rows(spark, tmp_path, no_broadcast):
    older, newer = sides(spark)
    newer = newer.withColumn("birth_year", F.when(F.col("bike_id") % 2 == 0, F.col("birth_year"))).withColumn("gender", F.lit(0))
    tables = stored(spark, newer, tmp_path), stored(spark, older, tmp_path)
    filled = reconcile.backfill(*tables, strict=False)
    assert rows(filled) == rows(reconcile.backfill(newer, older, strict=False))
    plan = plan_of(filled)
    assert "SortMergeJoin" in plan and "Exchange" not in plan
    assert len(list((tmp_path / tables[0].inputFiles()[0].split("/")[-2]).glob("part-*"))) == 4


def test_bucket_count():
    assert [snapshots.bucket_count(n, 8) for n in (0, 1 << 31, 1 << 40, 100 << 40)] == [8, 8, 4096, 524288]


def publications(spark, n=40_000):
    month = (F.col("id") % 12 + 202001).cast("int")
    old = spark.range(n).select(month.alias("ym"), F.concat(F.lit("r"), F.col("id").cast("string")).alias("k"), F.when(F.col("id") % 5 > 0, F.col("id") % 100).alias("v"), F.lit("x").alias("w"))
    changed = (F.col("ym") == 202003) & (F.col("k").like("r1%6"))
    new = old.withColumn("v", F.when(changed, F.lit(None)).otherwise(F.col("v"))).withColumn("w", F.when(changed & F.col("v").isNotNull(), F.lit("y")).otherwise(F.col("w")))
    return old, new


def test_buckets_follow_the_rides(spark, monkeypatch):
    schema = spark.createDataFrame([], "start_time timestamp_ntz, stop_time timestamp_ntz, bike_id int, start_station_id string").schema
    assert snapshots.held_bytes(1000, schema) == 48_000
    assert [snapshots.bucket_count(snapshots.held_bytes(n, schema), 12) for n in (1000, 36_000_000, 216_000_000)] == [16, 16, 64]
    seen, w = [], workspace.Workspace(spark, "/root/testdata/sf0.001")
    monkeypatch.setattr(workspace, "bucket_count", lambda size, cores: seen.append(size) or 8)
    w.snapshot("times", lambda: w.rides.select(*TIME_KEY))
    assert seen == [16 * w.rides.count()] and seen[0] > 0


def test_checksums_find_all_mismatches(spark):
    old, new = publications(spark)
    wanted = rows(compare.mismatches(old, new, ["k"], ["v", "w"]))
    assert wanted and rows(checksum.mismatches_by_checksum(old, new, ["ym"], ["k"], ["v", "w"])) == wanted
    assert rows(checksum.mismatches_by_checksum(old, new, ["ym"], ["k"], ["v", "w"], ranges=1)) == wanted
    assert rows(checksum.mismatches_by_checksum(old, old.unionByName(old.limit(1)), ["ym"], ["k"], ["v"])) == rows(compare.mismatches(old, old.unionByName(old.limit(1)), ["k"], ["v"]))
    assert checksum.mismatches_by_checksum(old, old, ["ym"], ["k"], ["v", "w"]).count() == 0
    added = new.where("k <> 'r5'").unionByName(new.limit(1).withColumn("k", F.lit("new")))
    diff = compare.snapshot_diff(old, added, ["k"], ["v"])
    changed = diff.where("status <> 'both' OR NOT v_old <=> v_new")
    assert rows(checksum.diff_by_checksum(old, added, ["ym"], ["k"], ["v"]).select(*changed.columns)) == rows(changed)


def test_which_of_two_is_null_changes_the_sums(spark):
    a = spark.createDataFrame([(1, 5, None), (2, None, None)], "k int, a int, b int")
    b = spark.createDataFrame([(1, None, 5), (2, None, None)], "k int, a int, b int")
    assert [r.k for r in checksum.mismatches_by_checksum(a, b, [], ["k"], ["a", "b"], ranges=8).collect()] == [1]


def test_sums_of_parts_add_up(spark):
    old, _ = publications(spark, 3000)
    parts = [checksum.range_sums(old.where(c), ["ym"], ["k"], ["v"], 4) for c in ("v < 50", "v >= 50 OR v IS NULL")]
    both = parts[0].unionByName(parts[1]).groupBy("ym", "_range").agg(*[F.sum(c).alias(c) for c in ("_n", "_low", "_high")])
    assert rows(both) == rows(checksum.range_sums(old, ["ym"], ["k"], ["v"], 4))


def test_what_is_shuffled_follows_the_differences(spark, tmp_path):
    """With stored sums, rows of equal ranges are not shuffled."""
    old, new = publications(spark)
    paths = [str(tmp_path / n) for n in ("old", "new", "old_sums", "new_sums")]
    for df, path in ((old, paths[0]), (new, paths[1])):
        df.write.parquet(path)
    sides = [spark.read.parquet(p) for p in paths[:2]]
    moved = []
    for newer in (sides[0], sides[1]):
        sums = []
        for k, df in enumerate((sides[0], newer)):
            path = f"{paths[2 + k]}-{len(moved)}"
            checksum.range_sums(df, ["ym"], ["k"], ["v", "w"]).write.parquet(path)
            sums.append(spark.read.parquet(path))
        found = checksum.mismatches_by_checksum(sides[0], newer, ["ym"], ["k"], ["v", "w"], sums=tuple(sums))
        assert found._jdf.queryExecution().executedPlan().toString().count("BroadcastHashJoin") == 2
        moved.append(sum(map(sum, shuffled(found))))
    plain = sum(map(sum, shuffled(compare.mismatches(*sides, ["k"], ["v", "w"]))))
    assert moved[0] < moved[1] < plain / 4, (moved, plain)
