import csv
import gzip
import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tests.conftest import rows
from tripweave.operators import aggregate as agg
from tripweave.operators import stations as st
from tripweave.sinks import documents
from tripweave.sources import tables


@pytest.fixture
def many_parts(spark):
    """Small ranges stay partitions of their own."""
    name = "spark.sql.adaptive.coalescePartitions.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "false")
    yield
    spark.conf.set(name, before)


def whole(spark, path) -> tuple[bytes, int]:
    """What ``cat`` of the parts gives, and how many there are."""
    parts = documents.document_parts(spark, str(path))
    return b"".join(Path(p.removeprefix("file:")).read_bytes() for p in parts), len(parts)


def test_csv_file_in_order(spark, tmp_path, many_parts):
    """Rows over many partitions, equal keys, nulls, quotes, a blank row; one header, in several gzip members."""
    data = [(f"R{i % 700:04d}", f"2020-01-{1 + i % 28:02d}", None if i % 50 == 0 else f"x{i}, \"q\"") for i in range(2000)]
    df = spark.createDataFrame(data + [(None, None, None)], "ride_id string, started_at string, note string").withColumn("ended_at", F.when(F.col("ride_id").isNotNull(), "z"))
    df = df.select("ride_id", "started_at", "ended_at", "note").repartition(6)
    documents.write_csv_document(df, str(tmp_path / "c"))
    text, parts = whole(spark, tmp_path / "c")
    assert parts > 1
    lines = list(csv.reader(gzip.decompress(text).decode().splitlines(), escapechar="\\", doublequote=False))
    assert lines[0] == ["ride_id", "started_at", "ended_at", "note"] and len(lines) == 2001
    assert [(r[1], r[2], r[0]) for r in lines[1:]] == sorted((d, "z", i) for i, d, _ in data)
    assert sorted(r[3] for r in lines[1:]) == sorted("N" if n is None else n for _, _, n in data)
    back = documents.read_csv_document(spark, str(tmp_path / "c"), df.columns)
    assert rows(back) == rows(df.dropna(how="all"))
    with pytest.raises(Exception, match="(?i)already exists"):
        documents.write_csv_document(df, str(tmp_path / "c"))
    documents.write_csv_document(df.limit(0), str(tmp_path / "none"))
    assert gzip.decompress(whole(spark, tmp_path / "none")[0]) == b"ride_id,started_at,ended_at,note\n"


@pytest.mark.parametrize("compression", ["none", "gzip"])
def test_json_of_many_parts(spark, tmp_path, many_parts, compression):
    data = {f"id {i} \"é": {"n": i, "name": None if i % 7 == 0 else f"a}}{{,{i}"} for i in range(3000)}
    df = spark.createDataFrame([(k, v["n"], v["name"]) for k, v in data.items()], "id string, n long, name string").repartition(5)
    documents.write_json_document(df, str(tmp_path / "j"), "id", compression=compression)
    text, parts = whole(spark, tmp_path / "j")
    text = gzip.decompress(text) if compression == "gzip" else text
    assert parts > 1
    found = json.loads(text)
    assert {k: {"name": None, **v} for k, v in found.items()} == data
    assert list(found) == sorted(found, key=lambda k: k.encode())


def test_small_documents(spark, tmp_path):
    one = spark.createDataFrame([("a", 1)], "id string, n long")
    for name, df, wanted in (("one", one, {"a": {"n": 1}}), ("none", one.limit(0), {})):
        documents.write_json_document(df, str(tmp_path / name), "id")
        assert json.loads(whole(spark, tmp_path / name)[0]) == wanted
    for bad in (one.unionByName(one), spark.createDataFrame([(None, 1)], "id string, n long")):
        with pytest.raises(Exception, match="(?i)repeat|null"):
            documents.write_json_document(bad, str(tmp_path / "bad"), "id", overwrite=True)


def test_station_and_pair_documents(spark, rides_of, tmp_path):
    rides = rides_of({}, {}, {"end_station_id": "HB101"}, {"start_station_id": "4002.01"})
    stations = st.station_table(rides)
    documents.write_station_document(stations, str(tmp_path / "s"))
    assert set(json.loads(whole(spark, tmp_path / "s")[0])) == {r.id for r in stations.collect()}
    assert rows(tables.read_station_json(spark, str(tmp_path / "s"))) == rows(stations)
    pairs = st.encode_pairs(st.station_pairs(rides), st.station_index(stations))
    documents.write_pair_document(st.pair_maps(pairs), str(tmp_path / "p"))
    wanted = {}
    for r in pairs.collect():
        wanted.setdefault(str(r.sidx), {})[str(r.eidx)] = r["count"]
    assert json.loads(whole(spark, tmp_path / "p")[0]) == wanted
    assert rows(tables.read_pair_json(spark, str(tmp_path / "p"))) == rows(pairs)


def test_coverage_from_stored_sketches(spark, tmp_path):
    """Estimates over any months lie within four standard errors of the distinct count, and read the sketches only."""
    stations = spark.range(200_000).select((F.col("id") % 12 + 202001).cast("int").alias("end_ym"), F.when(F.col("id") % 10 > 0, F.xxhash64(F.col("id") % 40_000).cast("string")).alias("start_station_id"), (F.col("id") % 90).cast("string").alias("end_station_id"))
    agg.coverage_sketches(stations).write.parquet(str(tmp_path / "k"))
    stored = spark.read.parquet(str(tmp_path / "k"))
    for months in ([202003], [202001, 202002], list(range(202001, 202013))):
        got = agg.coverage_of(stored.where(F.col("end_ym").isin(months))).first()
        want = agg.station_coverage(stations.where(F.col("end_ym").isin(months))).first()
        assert abs(got.start_station_id - want.n_start) <= 4 * 1.04 / 128 * want.n_start
        assert got.end_station_id == want.n_end
    assert stored.count() == 12 and all("/k/" in f for f in agg.coverage_of(stored).inputFiles())
    assert tuple(agg.coverage_of(stored.limit(0)).first()) == (0, 0)
