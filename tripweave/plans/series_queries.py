"""Dashboard series: from the cube to filtered, stacked, smoothed and clamped months."""

from __future__ import annotations

from pyspark.sql import functions as F

from tripweave.functions import codes
from tripweave.operators import aggregate as agg
from tripweave.operators import series as ts
from tripweave.plans.aggregate_queries import CUBE_SQL, DISPLAY_SQL
from tripweave.plans.prelude import with_prelude
from tripweave.plans.registry import query

DASH_SQL = """SELECT printf('%d-%02d', year, month) AS m, region, user_type,
    CASE gender WHEN 0 THEN 'Unknown' WHEN 1 THEN 'Men' WHEN 2 THEN 'Women' END AS gender,
    CASE rideable_type WHEN 'classic_bike' THEN 'Classic' WHEN 'electric_bike' THEN 'Electric' WHEN 'unknown' THEN 'Unknown' END AS rideable_type,
    count AS rides, duration / 60 AS ride_minutes FROM display"""
TABLES = {"cube": CUBE_SQL, "display": DISPLAY_SQL, "dash": DASH_SQL}
TOTAL_SQL = "SELECT m, CAST(sum(rides) AS BIGINT) AS rides FROM dash GROUP BY 1"
REGIONS = codes.STACK_ORDER["region"]
TYPES = codes.STACK_ORDER["rideable_type"]


def pivot_sql(stack: str, values: list[str], value: str = "rides", cast: str = "BIGINT") -> str:
    columns = ", ".join(f"CAST(sum({value}) FILTER ({stack} = '{v}') AS {cast}) AS \"{v}\"" for v in values)
    return f"SELECT m, {columns} FROM dash GROUP BY 1"


def rolled_sql(columns: list[str], n: int, mode: str, source: str, digits: int | None = 6) -> str:
    def mean(c: str) -> str:
        frame = f"OVER (ORDER BY m ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
        defined = f'lag("{c}", {n}) OVER (ORDER BY m) IS NOT NULL' if mode == "lagged" else f'count("{c}") {frame} = {n}'
        value = f'coalesce(sum("{c}") {frame}, 0) / {n}'
        return f'CASE WHEN {defined} THEN {value if digits is None else f"round({value}, {digits})"} END AS "{c}"'

    return f"SELECT m, {', '.join(mean(c) for c in columns)} FROM {source}"


def _dash(w):
    return ts.dashboard_rows(agg.cube_display(w.cube))


def _total(w):
    return ts.monthly_sum(_dash(w), "rides")


def _rounded(df, *columns):
    return df.withColumns({c: F.round(c, 6) for c in columns})


@query("dashboard_rows", with_prelude("SELECT * FROM dash", **TABLES))
def _(w):
    return _dash(w)


@query("monthly_totals", with_prelude(TOTAL_SQL, **TABLES))
def _(w):
    return _total(w)


@query("monthly_minutes", with_prelude("SELECT m, user_type, round(sum(ride_minutes), 4) AS ride_minutes FROM dash GROUP BY 1, 2", **TABLES))
def _(w):
    summed = ts.monthly_sum(_dash(w), "ride_minutes", "user_type")
    return summed.withColumn("ride_minutes", F.round("ride_minutes", 4))


@query("monthly_by_gender", with_prelude("SELECT m, gender, CAST(sum(rides) AS BIGINT) AS rides FROM dash GROUP BY 1, 2", **TABLES))
def _(w):
    return ts.monthly_sum(_dash(w), "rides", "gender")


@query("monthly_pivot", with_prelude(pivot_sql("region", REGIONS), **TABLES))
def _(w):
    return ts.monthly_pivot(_dash(w), "rides", "region")


@query("monthly_pivot_types", with_prelude(pivot_sql("rideable_type", TYPES), **TABLES))
def _(w):
    return ts.monthly_pivot(_dash(w), "rides", "rideable_type")


def _share_sql(values: list[str]) -> str:
    total = " + ".join(f'coalesce("{v}", 0)' for v in values)
    return "SELECT m, " + ", ".join(f'"{v}" / ({total}) AS "{v}"' for v in values) + " FROM wide"


@query("monthly_share", with_prelude(_share_sql(REGIONS), **TABLES, wide=pivot_sql("region", REGIONS)))
def _(w):
    return ts.row_shares(ts.monthly_pivot(_dash(w), "rides", "region"), REGIONS)


@query(
    "monthly_share_long",
    with_prelude(
        "SELECT m, user_type, rides, rides / sum(rides) OVER (PARTITION BY m) AS share FROM long",
        **TABLES,
        long="SELECT m, user_type, CAST(sum(rides) AS BIGINT) AS rides FROM dash GROUP BY 1, 2",
    ),
)
def _(w):
    return ts.share_of_total(ts.monthly_sum(_dash(w), "rides", "user_type"), "m", "rides")


@query("rolling_mean_lagged", with_prelude(rolled_sql(["rides"], 12, "lagged", "total"), **TABLES, total=TOTAL_SQL))
def _(w):
    return _rounded(ts.rolling_mean(_total(w), ["rides"], 12), "rides")


@query("rolling_mean_full", with_prelude(rolled_sql(["rides"], 12, "full", "total"), **TABLES, total=TOTAL_SQL))
def _(w):
    return _rounded(ts.rolling_mean(_total(w), ["rides"], 12, mode="full"), "rides")


@query("rolling_mean_stacked", with_prelude(rolled_sql(REGIONS, 6, "lagged", "wide"), **TABLES, wide=pivot_sql("region", REGIONS)))
def _(w):
    wide = ts.monthly_pivot(_dash(w), "rides", "region")
    return _rounded(ts.rolling_mean(wide, REGIONS, 6), *REGIONS)


_GROWTH_SQL = """SELECT n - rn AS num_mos, (n - rn) / 12 AS num_yrs, m AS first_m, round(v, 6) AS first_v, last_m, round(last_v, 6) AS last_v,
    round(last_v / v, 6) AS ratio, round((pow(last_v / v, 12 / (n - rn)) - 1) * 100, 6) AS percent
  FROM (SELECT m, {value} AS v, row_number() OVER (ORDER BY m) AS rn, count(*) OVER () AS n,
      last_value({value}) OVER (ORDER BY m ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS last_v,
      max(m) OVER () AS last_m FROM {source} WHERE {value} IS NOT NULL)
  WHERE rn < n AND ((n - rn) % 12 = 0 OR rn = 1)"""


def _growth(df):
    out = ts.annualized_growth(df, "rides").withColumn("num_mos", F.col("num_mos").cast("long"))
    return _rounded(out, "first_v", "last_v", "ratio", "percent")


@query(
    "annualized_growth",
    with_prelude(
        _GROWTH_SQL.format(value="rides", source="rolled"),
        **TABLES,
        total=TOTAL_SQL,
        rolled=rolled_sql(["rides"], 12, "lagged", "total", digits=None),
    ),
)
def _(w):
    return _growth(ts.rolling_mean(_total(w), ["rides"], 12))


@query(
    "growth_from_zero",
    with_prelude(
        _GROWTH_SQL.format(value="rides", source="opened").replace("last_v / v", "last_v / nullif(v, 0)"),
        **TABLES,
        total=TOTAL_SQL,
        opened="SELECT m, CASE WHEN m = (SELECT min(m) FROM total) THEN 0 ELSE rides END AS rides FROM total",
    ),
)
def _(w):
    """A series that starts at 0 has no growth since then; the others stand."""
    total = _total(w)
    first = total.agg(F.min("m").alias("m")).scalar()
    return _growth(total.withColumn("rides", F.when(F.col("m") == first, F.lit(0)).otherwise(F.col("rides"))))


FACETS_SQL = """SELECT * FROM dash WHERE region IN ('JC', 'HOB') AND user_type IN ('Annual', 'Daily')
    AND gender IN ('Men', 'Women') AND rideable_type IN ('Classic', 'Unknown')"""


@query("facet_filter", with_prelude(FACETS_SQL, **TABLES))
def _(w):
    facets = {"region": ["JC", "HOB"], "user_type": ["Annual", "Daily"], "gender": ["Men", "Women"], "rideable_type": ["Classic", "Unknown"]}
    return ts.facet_filter(_dash(w), facets)


@query(
    "clamp_after_rolling",
    with_prelude(
        "SELECT * FROM rolled WHERE m >= '1997-03' AND m < '2000-06'",
        **TABLES,
        total=TOTAL_SQL,
        rolled=rolled_sql(["rides"], 12, "lagged", "total"),
    ),
)
def _(w):
    rolled = ts.rolling_mean(_total(w), ["rides"], 12)
    return _rounded(ts.clamp_months(rolled, "1997-03", "2000-06"), "rides")


@query(
    "last_n_years",
    with_prelude(
        """SELECT * FROM rolled, (SELECT max(CAST(m || '-01' AS DATE)) + INTERVAL 1 MONTH AS after FROM total)
        WHERE m >= strftime(after - INTERVAL 2 YEAR, '%Y-%m') AND m < strftime(after, '%Y-%m')""".replace("SELECT *", "SELECT m, rides", 1),
        **TABLES,
        total=TOTAL_SQL,
        rolled=rolled_sql(["rides"], 12, "lagged", "total"),
    ),
)
def _(w):
    return _rounded(ts.last_years(ts.rolling_mean(_total(w), ["rides"], 12), 2), "rides")


_LONG_SQL = " UNION ALL ".join(f"SELECT m, '{v}' AS series, \"{v}\" AS rides FROM rolled" for v in ["Unknown", "Women", "Men"])


@query(
    "series_cutoff",
    with_prelude(
        """SELECT * FROM long WHERE CASE series WHEN 'Unknown' THEN m < '1999-02' WHEN 'Men' THEN m < '2000-02' ELSE true END""",
        **TABLES,
        wide=pivot_sql("gender", ["Unknown", "Women", "Men"]),
        rolled=rolled_sql(["Unknown", "Women", "Men"], 12, "lagged", "wide"),
        long=_LONG_SQL,
    ),
)
def _(w):
    genders = codes.STACK_ORDER["gender"]
    rolled = ts.rolling_mean(ts.monthly_pivot(_dash(w), "rides", "gender"), genders, 12)
    long = ts.unpivot_series(_rounded(rolled, *genders), genders, "rides")
    return ts.series_cutoff(long, {"Unknown": "1999-02", "Men": "2000-02"})


@query(
    "dashboard_chart",
    with_prelude(
        """SELECT * FROM rolled, (SELECT max(CAST(m || '-01' AS DATE)) + INTERVAL 1 MONTH AS after FROM dash)
        WHERE m >= strftime(after - INTERVAL 3 YEAR, '%Y-%m') AND m < strftime(after, '%Y-%m')""".replace("SELECT *", 'SELECT m, "Electric", "Classic", "Unknown"', 1),
        **TABLES,
        facet="SELECT * FROM dash WHERE region IN ('JC', 'HOB', 'NYC') AND user_type = 'Annual'",
        wide=pivot_sql("rideable_type", TYPES).replace("FROM dash", "FROM facet"),
        rolled=rolled_sql(TYPES, 12, "lagged", "wide"),
    ),
)
def _(w):
    """The whole chart path: facets, stack, rolling mean, then the last three years of all data."""
    dash = _dash(w)
    chosen = ts.facet_filter(dash, {"region": REGIONS, "user_type": ["Annual"]})
    rolled = ts.rolling_mean(ts.monthly_pivot(chosen, "rides", "rideable_type"), TYPES, 12)
    start, end = ts.date_bounds(dash, 3)
    return _rounded(ts.clamp_months(rolled, start, end), *TYPES)
