"""Archives as the fixture writes them: their number grows with the rows, and nothing is lost in a split."""

import zipfile
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tripweave.sources import archives
from tripweave.sources.archive_fixture import HEADERS, write_monthly_archives, write_yearly_archives


@pytest.fixture(scope="module")
def raw(spark):
    """40,000 rows of one month."""
    texts = {c: F.concat(F.lit(f'{c}, "'), F.xxhash64("id", F.lit(c)).cast("string")) for c in HEADERS}
    start = F.expr("TIMESTAMP_NTZ '2019-03-01 00:00:00'") + F.make_dt_interval(secs=F.col("id").cast("decimal(18,6)"))
    texts |= {"ride_id": F.col("id").cast("string"), "started_at": start, "ended_at": start, "end_lat": F.when(F.col("id") % 2 == 0, "40.7")}
    return spark.range(0, 40_000, 1, 8).select(*[v.alias(c) for c, v in texts.items()])


@pytest.mark.parametrize("write, layout", [(write_monthly_archives, 1), (write_yearly_archives, 1), (write_yearly_archives, 2)])
def test_a_large_month_is_written_by_several_tasks(spark, raw, tmp_path, write, layout):
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "256k")
    try:
        paths = [r.path for r in write(raw, str(tmp_path / "a")).collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    assert len(set(paths)) == len(paths) > 4
    assert sorted(map(str, Path(tmp_path / "a").glob("*.zip"))) == sorted(paths)
    assert all(zipfile.ZipFile(p).testzip() is None for p in paths)
    back = archives.read_trip_archives(spark, str(tmp_path / "a"), name_type=layout)
    kept = ["ride_id", "start_station_name", "end_lat"]
    want = raw.select(*kept)
    assert back.count() == 40_000
    assert back.select(*kept).exceptAll(want).isEmpty() and want.exceptAll(back.select(*kept)).isEmpty()
    assert {r.src_ym for r in back.select("src_ym").distinct().collect()} == {201903}
