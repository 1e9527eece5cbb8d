import numpy as np

import corpus_pipeline as cp
from pyspark.sql import functions as F
from tripweave.llm.mixing import mix


def test_sequences_follow_the_slots_over_files_of_unequal_size(spark, docs_of, tmp_path):
    """Small files first, large ones last: a reader that takes the largest first turns the order around."""
    rng = np.random.default_rng(2)
    rows = [(i, " ".join(rng.choice(["alpha", "beta", "gamma", "delta"], int(rng.integers(200, 900)))), "en", "hot" if i % 3 else f"s{i % 4}", 1) for i in range(3000)]
    docs = docs_of(rows)
    placed = mix(docs, alpha=0.7).select("doc_id", "slot", "place").collect()
    place = {r.doc_id: k for k, r in enumerate(sorted(placed, key=lambda r: (r.slot, r.place)))}
    path = str(tmp_path / "mixed")
    ordered = cp.mix_sources(spark, docs, "").collect()
    assert [r.doc_id for r in ordered] == sorted(place, key=place.get)
    # Files as a range-partitioned write leaves them, of 100, 300, 600, 800 and 1,200 rows.
    text_of = spark.createDataFrame(ordered, docs.schema).withColumn("p", F.udf(place.get, "long")("doc_id"))
    ends = [100, 400, 1000, 1800, 3000]
    part = F.coalesce(*(F.when(F.col("p") < e, F.lit(k)) for k, e in enumerate(ends)))
    dealt = text_of.withColumn("k", part).rdd.map(lambda r: (r.k, r)).partitionBy(len(ends), lambda k: k).map(lambda x: x[1])
    spark.createDataFrame(dealt, text_of.withColumn("k", part).schema).sortWithinPartitions("p").drop("p", "k").write.parquet(path)
    conf = {"spark.sql.files.maxPartitionBytes": "128k", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        pieces = cp.pack_sequences(spark, spark.read.parquet(path), "").select("doc_id", "sequence_id").collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert {r.doc_id for r in pieces} == set(place)
    held: dict[int, list[int]] = {}
    for r in pieces:
        held.setdefault(r.sequence_id, []).append(place[r.doc_id])
    closed = [min(held[k]) for k in sorted(held) if not k & 1]
    assert len({k >> 32 for k in held}) > 1 and len(closed) > 5
    assert closed == sorted(closed)
    # Sequences merged from windows left open come after all their documents' own partitions, before the next one's.
    for k in held:
        assert all(max(held[k]) < min(held[m]) for m in held if not m & 1 and m >> 32 > k >> 32)
