import math

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as hs

from tests.conftest import rows
from tripweave.operators import series as ts

# Published monthly rides from 2013-06 on, and the published 12-month averages from 2014-05 on.
BARS = [
    559643, 843417, 1001958, 1034359, 1037712, 675774, 443966, 300400, 224736, 439117, 670780, 866117,
    936880, 968842, 963489, 953887, 828711, 529188, 399069, 285552, 196930, 341826, 652390, 961986,
]
AVERAGES = [674831, 706268, 716720, 713514, 706808, 689391, 677176, 673434, 672197, 669880, 661772, 660240, 668229]


def months(n, start=(2013, 6)):
    y, m = start
    return [f"{y + (m - 1 + i) // 12}-{(m - 1 + i) % 12 + 1:02d}" for i in range(n)]


def frame(spark, values, name="v"):
    return spark.createDataFrame(list(zip(months(len(values)), values, strict=True)), f"m string, {name} double")


def lagged(values, n):
    """Mean as the dashboard draws it, by definition: row by row."""
    out = []
    for i in range(len(values)):
        window = [v for v in values[max(0, i - n + 1) : i + 1] if v is not None]
        out.append(sum(window) / n if i >= n and values[i - n] is not None else None)
    return out


def test_published_averages(spark):
    series = frame(spark, [float(b) for b in BARS])
    full = [r.v for r in ts.rolling_mean(series, ["v"], 12, mode="full").orderBy("m").collect()]
    assert full[:11] == [None] * 11
    assert [math.floor(v) for v in full[11:]] == AVERAGES
    dashboard = [r.v for r in ts.rolling_mean(series, ["v"], 12).orderBy("m").collect()]
    assert dashboard == [None] * 12 + full[12:]


@settings(max_examples=10, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(values=hs.lists(hs.one_of(hs.none(), hs.integers(0, 50).map(float)), min_size=1, max_size=20), n=hs.integers(1, 5))
def test_lagged_mean_with_gaps(spark, values, n):
    out = ts.rolling_mean(frame(spark, values), ["v"], n)
    assert [r.v for r in out.orderBy("m").collect()] == pytest.approx(lagged(values, n), nan_ok=True)


def test_rolling_mean_per_partition(spark):
    data = [(s, m, v) for s, k in (("a", 1.0), ("b", 10.0)) for m, v in zip(months(3), [k, 2 * k, 3 * k], strict=True)]
    df = spark.createDataFrame(data, "s string, m string, v double")
    out = ts.rolling_mean(df, ["v"], 2, partition=["s"])
    assert rows(out.where("v is not null")) == [("a", "2013-08", 2.5), ("b", "2013-08", 25.0)]
    with pytest.raises(ValueError):
        ts.rolling_mean(df, ["v"], mode="centred")


def test_shares_add_to_one(spark):
    wide = spark.createDataFrame([("2022-12", 6003, 1860264, 355770), ("2022-11", None, 3, 1)], "m string, Docked long, Classic long, Electric long")
    out = ts.row_shares(wide, ["Docked", "Classic", "Electric"]).orderBy("m").collect()
    assert tuple(out[0])[1:] == (None, 0.75, 0.25)
    assert sum(tuple(out[1])[1:]) == pytest.approx(1)
    assert [round(v, 4) for v in tuple(out[1])[1:]] == [0.0027, 0.8372, 0.1601]
    long = spark.createDataFrame([("a", 1), ("a", 3), ("b", 2)], "m string, v long")
    assert rows(ts.share_of_total(long, "m", "v")) == [("a", 1, 0.25), ("a", 3, 0.75), ("b", 2, 1.0)]


def test_pivot_keeps_chart_order(spark):
    df = spark.createDataFrame([("a", "NYC", 1), ("a", "JC", 2), ("b", "JC", 3), ("b", "JC", 4)], "m string, region string, rides long")
    wide = ts.monthly_pivot(df, "rides", "region")
    assert wide.columns == ["m", "JC", "HOB", "NYC"]
    assert rows(wide) == [("a", 2, None, 1), ("b", 7, None, None)]
    assert rows(ts.unpivot_series(wide, ["JC", "NYC"], "rides").where("rides is not null")) == [("a", "JC", 2), ("a", "NYC", 1), ("b", "JC", 7)]


def test_clamp_is_half_open_and_after_rolling(spark):
    rolled = ts.rolling_mean(frame(spark, [1.0, 2.0, 3.0, 4.0, 5.0]), ["v"], 2)
    assert rows(ts.clamp_months(rolled, "2013-09", "2013-10")) == [("2013-09", 3.5)]
    assert ts.clamp_months(rolled, end="2013-08").count() == 2
    assert ts.clamp_months(rolled).count() == 5


def test_last_years(spark):
    df = frame(spark, [float(i) for i in range(30)])
    kept = [r.m for r in ts.last_years(df, 1).orderBy("m").collect()]
    assert kept == months(30)[-12:]
    assert ts.last_years(df, None).count() == 30


def test_cutoffs(spark):
    df = spark.createDataFrame([("2021-01", "Men", 1), ("2021-02", "Men", 2), ("2021-02", "Electric", 3)], "m string, series string, v long")
    assert rows(ts.series_cutoff(df, {**ts.GENDER_CUTOFFS, **ts.RIDEABLE_CUTOFFS})) == [("2021-01", "Men", 1), ("2021-02", "Electric", 3)]


def test_growth(spark):
    values = [None, None] + [100.0 * 1.01**i for i in range(27)]
    out = ts.annualized_growth(frame(spark, values), "v").orderBy("num_mos").collect()
    assert [r.num_mos for r in out] == [12, 24, 26]
    assert [r.last_m for r in out] == [months(29)[-1]] * 3
    assert [r.percent for r in out] == pytest.approx([(1.01**12 - 1) * 100] * 3)
    assert [r.ratio for r in out] == pytest.approx([1.01**12, 1.01**24, 1.01**26])
    short = ts.annualized_growth(frame(spark, [1.0, 2.0, 4.0]), "v").collect()
    assert [(r.num_mos, r.ratio) for r in short] == [(2, 4.0)]
    assert ts.annualized_growth(frame(spark, [1.0, None]), "v").count() == 0


def test_facets(spark):
    df = spark.createDataFrame([("JC", "Men"), ("NYC", "Men"), ("JC", None)], "region string, gender string")
    assert rows(ts.facet_filter(df, {"region": ["JC"], "gender": ["Men", "Women"]})) == [("JC", "Men")]
    assert ts.facet_filter(df, {}).count() == 3
    assert ts.facet_filter(df, {"region": []}).count() == 0
