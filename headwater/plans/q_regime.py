"""Queries: flow regime, low flow and duration curves over the regions' and nations' daily series."""

from __future__ import annotations

from pyspark.sql import functions as F

from headwater.functions import calendar as cal
from headwater.operators import regime as R
from headwater.plans.common import rounded, sql
from headwater.plans.tables import daily, daily_with_zeros

MIN_DAYS, AREA = 300, 120.0


def _q(f, level="region"):
    return lambda spark, d: rounded(f(daily(spark, d, level)))


QUERIES = {
    "b1_year_labels": lambda s, d: daily(s, d).select("site", "date", *(cal.year_label(F.col("date"), k).cast("long").alias(f"{k}_year") for k in ("water", "climatic", "calendar"))),
    "b2_day_of_water_year": lambda s, d: daily(s, d).select("site", "date", cal.day_of_water_year(F.col("date")).cast("long").alias("dowy")),
    "b3_season": lambda s, d: daily(s, d).groupBy("site", cal.season(F.col("date"), R.SEASONS).alias("season")).agg(F.sum("flow").alias("flow"), F.count(F.lit(1)).alias("n")),
    "b4_daily_with_year": lambda s, d: rounded(R.with_year(daily(s, d, "nation"), "climatic")),
    "b7_local_day_hours": lambda s, d: s.sql("SELECT explode(sequence(DATE'2024-01-01', DATE'2024-12-31', INTERVAL 1 DAY)) AS day").select("day", cal.local_day_hours(F.col("day"), "America/Los_Angeles").alias("hours")),
    "d1_flashiness": _q(lambda x: R.flashiness(x, min_days=MIN_DAYS)),
    "d2_tqmean": _q(lambda x: R.tqmean(x, min_days=MIN_DAYS)),
    "d3_completeness": _q(lambda x: R.completeness(x, "climatic"), "nation"),
    "d4_baseflow_index": _q(lambda x: R.baseflow_index(x, min_days=MIN_DAYS)),
    "d5_monthly_summary": _q(R.monthly_summary, "nation"),
    "d6_seasonal_summary": _q(R.seasonal_summary, "nation"),
    "d7_regime_summary": _q(lambda x: R.regime_summary(x, min_days=MIN_DAYS)),
    "d8_duration_percentiles": _q(R.duration_percentiles),
    "e2_local_minimum": _q(lambda x: R.local_minimum(x, AREA)),
    "e2_sliding_interval": _q(lambda x: R.sliding_interval(x, AREA), "nation"),
    "e3_fixed_interval": _q(lambda x: R.fixed_interval(x, AREA), "nation"),
    "e4_smoothed_minima": _q(R.smoothed_minima),
    "e5_recursive_filter": _q(R.recursive_filter),
    "e6_separate_baseflow": lambda s, d: rounded(R.separate_baseflow(daily_with_zeros(s, d), "smoothed_minima").groupBy("site").agg(F.sum("baseflow").alias("baseflow"), F.count("baseflow").alias("n"))),
}


def _turning(turn: str) -> str:
    """Interpolation between turning points; turn: site, day, turning."""
    return f"""{turn}
--
e AS (SELECT site, date, flow, d.day, last_value(turning IGNORE NULLS) OVER b AS v0, last_value(CASE WHEN turning IS NOT NULL THEN d.day END IGNORE NULLS) OVER b AS d0,
  first_value(turning IGNORE NULLS) OVER f AS v1, first_value(CASE WHEN turning IS NOT NULL THEN d.day END IGNORE NULLS) OVER f AS d1, count(turning) OVER (PARTITION BY site) AS nt
  FROM DENSE d LEFT JOIN turn USING (site, day)
  WINDOW b AS (PARTITION BY site ORDER BY d.day ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), f AS (PARTITION BY site ORDER BY d.day ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
--
bf AS (SELECT site, date, flow, CASE WHEN nt >= 2 AND v0 IS NOT NULL AND v1 IS NOT NULL AND flow IS NOT NULL THEN least(CASE WHEN d0 = d1 THEN v0 ELSE v0 + (v1 - v0) * (day - d0) / (d1 - d0) END, flow) END AS baseflow FROM e)
--
"""


def _ukih(dense: str = "dense") -> str:
    return _turning(f"""
bl AS (SELECT site, day // 5 AS block, count(flow) AS n, CASE WHEN count(flow) = 5 THEN min(flow) END AS low, arg_min(day, (flow, day)) FILTER (flow IS NOT NULL) AS at_day FROM {dense} GROUP BY ALL)
--
nb AS (SELECT *, lag(low) OVER w AS lo, lead(low) OVER w AS hi FROM bl WINDOW w AS (PARTITION BY site ORDER BY block))
--
turn AS (SELECT site, at_day AS day, low AS turning FROM nb WHERE lo IS NOT NULL AND hi IS NOT NULL AND 0.9::DOUBLE * low <= least(lo, hi))""").replace("DENSE", dense)


_N = R.interval_days(AREA)
_CENTRE = f"cm AS (SELECT *, CASE WHEN count(flow) OVER w = {2 * _N + 1} THEN min(flow) OVER w END AS low FROM DENSE WINDOW w AS (PARTITION BY site ORDER BY day ROWS BETWEEN {_N} PRECEDING AND {_N} FOLLOWING))"
_RBI = "ch AS (SELECT *, abs(flow - lag(flow) OVER (PARTITION BY site, wy ORDER BY date)) AS change, avg(flow) OVER (PARTITION BY site, wy) AS mean FROM dense)\n--\n"

ORACLE = {
    "e5_recursive_filter": sql("""d1 AS (SELECT site, date, flow, day - row_number() OVER (PARTITION BY site ORDER BY day) AS run FROM dense WHERE flow IS NOT NULL),
d2 AS (SELECT *, site || '|' || run AS g, row_number() OVER (PARTITION BY site, run ORDER BY date) AS k, count(*) OVER (PARTITION BY site, run) AS n FROM d1),
f1 AS (WITH RECURSIVE r(g, k, x, q, b) AS (SELECT g, k, flow, 0.0::DOUBLE, flow FROM d2 WHERE k = 1 UNION ALL SELECT d2.g, d2.k, d2.flow, 0.925 * q + 0.9625 * (d2.flow - x), greatest(least(d2.flow - (0.925 * q + 0.9625 * (d2.flow - x)), d2.flow), 0.0) FROM r JOIN d2 ON d2.g = r.g AND d2.k = r.k + 1) SELECT g, k, b FROM r),
f2 AS (WITH RECURSIVE r(g, k, x, q, b) AS (SELECT f1.g, f1.k, f1.b, 0.0::DOUBLE, f1.b FROM f1 JOIN d2 USING (g, k) WHERE k = n UNION ALL SELECT f1.g, f1.k, f1.b, 0.925 * q + 0.9625 * (f1.b - x), greatest(least(f1.b - (0.925 * q + 0.9625 * (f1.b - x)), f1.b), 0.0) FROM r JOIN f1 ON f1.g = r.g AND f1.k = r.k - 1) SELECT g, k, b FROM r),
f3 AS (WITH RECURSIVE r(g, k, x, q, b) AS (SELECT g, k, b, 0.0::DOUBLE, b FROM f2 WHERE k = 1 UNION ALL SELECT f2.g, f2.k, f2.b, 0.925 * q + 0.9625 * (f2.b - x), greatest(least(f2.b - (0.925 * q + 0.9625 * (f2.b - x)), f2.b), 0.0) FROM r JOIN f2 ON f2.g = r.g AND f2.k = r.k + 1) SELECT g, k, b FROM r)
--
SELECT site, date, flow, b AS baseflow FROM d2 JOIN f3 USING (g, k)""", "flow baseflow"),
    "b1_year_labels": sql("SELECT site, date, year(date) + (month(date) >= 10)::INT AS water_year, year(date) - (month(date) < 4)::INT AS climatic_year, year(date) AS calendar_year FROM daily", longs="water_year climatic_year calendar_year"),
    "b2_day_of_water_year": sql("SELECT site, date, date_diff('day', CASE WHEN month(date) >= 10 THEN DATE '1999-10-01' ELSE DATE '1999-10-01' END, make_date(CASE WHEN month(date) >= 10 THEN 1999 ELSE 2000 END, month(date), day(date))) + 1 AS dowy FROM daily"),
    "b3_season": sql("SELECT site, CASE WHEN month(date) IN (12, 1, 2) THEN 'DJF' WHEN month(date) <= 5 THEN 'MAM' WHEN month(date) <= 8 THEN 'JJA' ELSE 'SON' END AS season, sum(flow) AS flow, count(*) AS n FROM daily GROUP BY ALL"),
    "b4_daily_with_year": sql("SELECT site, date, flow, cy AS year FROM gdense", "flow", "year"),
    "b7_local_day_hours": "SELECT d::DATE AS day, CASE WHEN d::DATE = DATE '2024-03-10' THEN 23.0::DOUBLE WHEN d::DATE = DATE '2024-11-03' THEN 25.0::DOUBLE ELSE 24.0::DOUBLE END AS hours FROM generate_series(DATE '2024-01-01', DATE '2024-12-31', INTERVAL 1 DAY) AS t(d)",
    "d1_flashiness": sql(_RBI + f"SELECT site, wy AS year, CASE WHEN count(flow) >= {MIN_DAYS} AND sum(flow) > 0 THEN coalesce(sum(change), 0) / sum(flow) END AS flashiness, count(flow) AS n_days, count(flow) >= {MIN_DAYS} AS complete FROM ch GROUP BY ALL", "flashiness", "year"),
    "d2_tqmean": sql(_RBI + f"SELECT site, wy AS year, CASE WHEN count(flow) >= {MIN_DAYS} THEN avg((flow > mean)::INT) END AS tqmean, count(flow) AS n_days, count(flow) >= {MIN_DAYS} AS complete FROM ch GROUP BY ALL", "tqmean", "year"),
    "d3_completeness": sql("SELECT site, cy AS year, count(flow) AS n_days, count(flow) >= 350 AS complete FROM gdense GROUP BY ALL", longs="year"),
    "d4_baseflow_index": sql(_ukih() + f"SELECT site, year(date) + (month(date) >= 10)::INT AS year, CASE WHEN count(baseflow) >= {MIN_DAYS} AND sum(flow) FILTER (baseflow IS NOT NULL) > 0 THEN sum(baseflow) / sum(flow) FILTER (baseflow IS NOT NULL) END AS bfi, count(baseflow) AS n_days, count(baseflow) >= {MIN_DAYS} AS complete FROM bf GROUP BY ALL", "bfi", "year"),
    "d5_monthly_summary": sql("SELECT site, wy AS year, month(date) AS month, avg(flow) AS mean, min(flow) AS min, max(flow) AS max, median(flow) AS median, count(flow) AS n_days, max(day(last_day(date))) AS days_in_month, count(flow) >= 0.9 * max(day(last_day(date))) AS complete FROM gdense GROUP BY ALL", "mean min max median", "year month days_in_month"),
    "d6_seasonal_summary": sql("""
s AS (SELECT *, CASE WHEN month(date) IN (12, 1, 2) THEN 'DJF' WHEN month(date) <= 5 THEN 'MAM' WHEN month(date) <= 8 THEN 'JJA' ELSE 'SON' END AS season, year(date) + (month(date) = 12)::INT AS year FROM gdense)
--
g AS (SELECT site, year, season, avg(flow) AS mean, min(flow) AS min, max(flow) AS max, median(flow) AS median, count(flow) AS n_days,
  CASE season WHEN 'DJF' THEN make_date(year, 3, 1) - make_date(year - 1, 12, 1) WHEN 'MAM' THEN 92 WHEN 'JJA' THEN 92 ELSE 91 END AS days_in_season FROM s GROUP BY site, year, season)
--
SELECT *, n_days >= 0.9 * days_in_season AS complete FROM g""", "mean min max median", "year days_in_season"),
    "d7_regime_summary": sql(_RBI + _ukih() + f"""
y AS (SELECT site, wy, count(flow) AS n, sum(change) AS c, sum(flow) AS t, avg((flow > mean)::INT) AS tq FROM ch GROUP BY ALL HAVING count(flow) >= {MIN_DAYS})
--
p AS (SELECT site, sum(c) / sum(t) AS flashiness, avg(tq) AS tqmean, count(*) AS n_years FROM y GROUP BY site)
--
z AS (SELECT site, year(date) + (month(date) >= 10)::INT AS wy, sum(flow) AS f, sum(baseflow) AS b FROM bf WHERE baseflow IS NOT NULL AND flow IS NOT NULL GROUP BY ALL HAVING count(*) >= {MIN_DAYS})
--
SELECT site, flashiness, tqmean, n_years, bfi, n_years_bfi FROM p LEFT JOIN (SELECT site, sum(b) / sum(f) AS bfi, count(*) AS n_years_bfi FROM z GROUP BY site) USING (site)""", "flashiness tqmean bfi"),
    "d8_duration_percentiles": sql("SELECT site, e::DOUBLE AS exceedance_pct, quantile_cont(flow, 1 - e / 100.0) AS flow FROM daily, (VALUES (1), (5), (10), (20), (50), (80), (90), (95), (99)) AS v(e) GROUP BY site, e".replace("quantile_cont(flow, 1 - e / 100.0)", "CASE e " + " ".join(f"WHEN {e} THEN quantile_cont(flow, {1 - e / 100})" for e in (1, 5, 10, 20, 50, 80, 90, 95, 99)) + " END"), "exceedance_pct flow"),
    "e2_local_minimum": sql(_CENTRE.replace("DENSE", "dense") + "\n--\n" + _turning("turn AS (SELECT site, day, flow AS turning FROM cm WHERE flow = low)").replace("DENSE", "dense") + "SELECT * FROM bf", "flow baseflow"),
    "e2_sliding_interval": sql(_CENTRE.replace("DENSE", "gdense") + "\n--\nSELECT site, date, flow, low AS baseflow FROM cm", "flow baseflow"),
    "e3_fixed_interval": sql(f"SELECT site, date, flow, CASE WHEN count(flow) OVER w = count(*) OVER w THEN min(flow) OVER w END AS baseflow FROM gdense WINDOW w AS (PARTITION BY site, day // {2 * _N})", "flow baseflow"),
    "e4_smoothed_minima": sql(_ukih() + "SELECT * FROM bf", "flow baseflow"),
    "e6_separate_baseflow": sql(_ukih("zeros") + "SELECT site, sum(baseflow) AS baseflow, count(baseflow) AS n FROM bf GROUP BY site", "baseflow"),
}
