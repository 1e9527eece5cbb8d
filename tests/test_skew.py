"""A third of all rows share one key: no shuffle partition may get more than its share of bytes."""

import pytest
from pyspark.sql import functions as F

from tripweave.operators import aggregate as agg
from tripweave.operators import compare, quality, ranking, reconcile
from tripweave.operators import stations as st
from tripweave.schema import RIDE_COLUMNS, RIDE_TYPES, TIME_KEY

N = 60_000
PARTITIONS = 8


@pytest.fixture(scope="module")
def skewed(spark):
    """Rides of which a third are copies of one ride, differing in file only; the others are all distinct."""
    i = F.col("id")
    hot = i % 3 == 0
    # A hot ride is the same everywhere; another one takes its number.
    n = F.when(hot, F.lit(0)).otherwise(i)
    start = F.expr("TIMESTAMP_NTZ '2020-01-01 00:00:00'")
    seconds = F.make_dt_interval(secs=n.cast("decimal(18,6)"))
    values = {
        "ride_id": F.concat(F.lit("r"), n.cast("string")),
        "start_time": start + seconds,
        "stop_time": start + seconds + F.expr("INTERVAL '600' SECOND"),
        "start_station_id": F.when(hot, "JC001").otherwise(F.concat(F.lit("4"), F.lpad((i % 997).cast("string"), 3, "0"), F.lit(".01"))),
        "start_station_name": F.concat(F.lit("name "), n.cast("string")),
        "start_lat": 40 + n / 1e6,
        "start_lng": -74 - n / 1e6,
        "end_station_id": F.when(hot, "HB101").otherwise(F.concat(F.lit("5"), F.lpad((i % 991).cast("string"), 3, "0"), F.lit(".01"))),
        "end_station_name": F.concat(F.lit("name "), n.cast("string")),
        "gender": (n % 3).cast("int"),
        "birth_year": F.lit(1980),
        "bike_id": (n % 5000).cast("int"),
    }
    columns = [values.get(c, F.lit(None)).cast(RIDE_TYPES[c].simpleString()).alias(c) for c in RIDE_COLUMNS]
    file = F.concat(F.lit("f"), (i % 2).cast("string"))
    rides = spark.range(0, N, 1, 8).select(*columns, file.alias("file"))
    assert rides.where("ride_id = 'r0'").count() == N // 3
    return rides


def shuffled(df) -> list[list[int]]:
    """Bytes per partition of every shuffle that ran for ``df``."""
    found = []

    def walk(node):
        name = node.getClass().getSimpleName()
        if name == "ShuffleQueryStageExec" and node.mapStats().isDefined():
            found.append(list(node.mapStats().get().bytesByPartitionId()))
        if name == "AdaptiveSparkPlanExec":
            return walk(node.executedPlan())
        if name.endswith("QueryStageExec"):
            walk(node.plan())
        children = node.children()
        for k in range(children.size()):
            walk(children.apply(k))

    df._jdf.queryExecution().executedPlan()
    df.collect()
    walk(df._jdf.queryExecution().executedPlan())
    return found


OPERATORS = {
    "distinct rows": lambda d: quality.drop_duplicate_rows(d),
    "distinct rows without file": lambda d: quality.drop_duplicate_rows(d, provenance=["file"]),
    "merged rows": lambda d: reconcile.merge_duplicates(d, hot=1000),
    "merged rows, contents differ": lambda d: reconcile.merge_duplicates(d.withColumn("ride_id", F.concat(F.lit("r"), F.xxhash64("ride_id", F.monotonically_increasing_id()).cast("string"))), hot=1000),
    "origin of duplicates": lambda d: reconcile.duplicate_provenance(d),
    "repeated keys": lambda d: quality.key_violations(d),
    "rows without copy": lambda d: quality.rows_without_copy(d),
    "key status": lambda d: compare.key_status(d, d.where("gender = 0"), TIME_KEY),
    "pairs": lambda d: agg.aggregate_rides(d, "se", "cd"),
    "pairs by hour": lambda d: agg.aggregate_rides(d, "seh", "cd"),
    "station table": lambda d: st.station_table(d),
    "station index": lambda d: st.station_index(st.station_table(d)),
    "busiest destination": lambda d: ranking.first_per_group(st.station_pairs(d), "sid", "count", ["eid"]),
}


@pytest.mark.parametrize("name", list(OPERATORS))
def test_hot_group_is_combined_before_the_shuffle(spark, skewed, name):
    spark.conf.set("spark.sql.shuffle.partitions", str(PARTITIONS))
    try:
        stages = shuffled(OPERATORS[name](skewed))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert stages
    for sizes in stages:
        if len(sizes) == PARTITIONS and sum(sizes) > 100_000:
            assert max(sizes) < 1.7 * sum(sizes) / len(sizes), sizes


def test_distinct_rows_are_not_shuffled(spark, skewed, tmp_path):
    """Of rows with a hash of their own only the hash is; what remains of a hot row is one row a task."""
    quality.repeated_hashes(skewed).write.parquet(str(tmp_path / "r"))
    repeated = quality.sent_if_few(spark.read.parquet(str(tmp_path / "r")))
    for run in (quality.drop_duplicate_rows, quality.rows_without_copy):
        moved = [sum(map(sum, shuffled(run(skewed, **k)))) for k in ({}, {"repeated": repeated})]
        assert moved[1] < moved[0] / 100, moved
    assert quality.drop_duplicate_rows(skewed, ["file"], repeated).count() == 2 * N // 3 + 1


def test_rows_with_few_stored_keys_are_not_shuffled(spark, skewed, tmp_path):
    quality.repeated_keys(skewed, TIME_KEY).select(*TIME_KEY).write.parquet(str(tmp_path / "k"))
    few = quality.sent_if_few(spark.read.parquet(str(tmp_path / "k")))
    many = quality.sent_if_few(spark.read.parquet(str(tmp_path / "k")), most=0)
    assert shuffled(quality.rows_with_copies(skewed, TIME_KEY, few)) == []
    assert quality.rows_with_copies(skewed, TIME_KEY, few).count() == quality.rows_with_copies(skewed, TIME_KEY, many).count() == N // 3


def test_rides_that_share_no_times_are_not_moved_to_be_merged(spark, skewed):
    """Of these only the keys are counted; the rows, let alone what the windows compare, stay where they are."""
    distinct = skewed.where("ride_id <> 'r0'")
    twice = distinct.where("bike_id < 50")
    stages = shuffled(reconcile.merge_duplicates(distinct.unionByName(twice.withColumn("file", F.lit("f9")))))
    assert sum(map(sum, stages)) < 40 * distinct.count(), stages
    merged = reconcile.merge_duplicates(distinct.unionByName(twice.withColumn("file", F.lit("f9"))))
    assert merged.count() == distinct.count()
    assert merged.where("file = 'f9'").count() == twice.count()


def test_results_stay_whole(skewed):
    assert quality.drop_duplicate_rows(skewed.drop("file")).count() == 2 * N // 3 + 1
    # The hot group is larger than a pair: its rows differ in nothing but the file and are one ride.
    assert reconcile.merge_duplicates(skewed).count() == reconcile.merge_duplicates(skewed, hot=1000).count() == 2 * N // 3 + 1
    told_apart = skewed.withColumn("ride_id", F.concat("ride_id", F.monotonically_increasing_id().cast("string")))
    assert reconcile.merge_duplicates(told_apart, hot=1000).count() == N
    assert agg.aggregate_rides(skewed, "se", "c").agg(F.sum("count")).first()[0] == N
    hot = quality.key_violations(skewed).orderBy(F.desc("n_rows")).first()
    assert hot.n_rows == N // 3


def test_counts_of_a_hot_station_stay_compact(skewed):
    """Every ride of a station has its own position; the sketch holds their counts as one run."""
    hist = st.station_meta_hist(skewed.withColumn("start_station_id", F.lit("JC001")), "il")
    sketch = {r.id: r for r in st.mode_sketch(hist, "id", ["lat", "lng"]).collect()}["JC001"]
    assert sketch.num == 2 * N // 3 + 1
    assert [(r["count"], r.times) for r in sketch.counts] == [(N // 3, 1), (1, 2 * N // 3)]
    assert (sketch.mode_count, sketch.second, sketch.total) == (N // 3, 1, N)


def test_the_measure_sees_a_hot_partition(spark, skewed):
    """The check above would fail for a plain shuffle by key."""
    distinct = skewed.withColumn("noise", F.rand(1))
    spark.conf.set("spark.sql.shuffle.partitions", str(PARTITIONS))
    try:
        stages = shuffled(distinct.select("start_time", "noise").repartition("start_time").groupBy("start_time").agg(F.max("noise")))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert any(max(sizes) > 2 * sum(sizes) / len(sizes) for sizes in stages)
