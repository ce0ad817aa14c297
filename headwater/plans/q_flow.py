"""Queries: low flow, duration curves, record extension and donors."""

from __future__ import annotations

from pyspark.sql import functions as F

from headwater.operators import duration as D
from headwater.operators import lowflow as L
from headwater.operators import records as X
from headwater.operators.regime import SEASONS
from headwater.plans.common import rounded, sql
from headwater.plans.tables import daily, daily_with_zeros, instantaneous, monthly_peaks, orders_daily


def _region(name):
    return lambda s, d: daily(s, d).filter(F.col("site") == name)


_ASIA, _OTHER = _region("ASIA"), lambda s, d: daily(s, d).filter("site <> 'ASIA'")


def _performance(s, d):
    y, x = daily(s, d).filter("site = 'ASIA'"), daily(s, d).filter("site <> 'ASIA'")
    return D.performance(x.select("site", "date", F.col("flow").alias("estimated")).join(y.select("date", F.col("flow").alias("observed")), "date"))


def _flow_stage(s, d):
    iv = instantaneous(s, d).withColumn("ts", F.date_trunc("hour", "ts"))
    side = lambda a: iv.filter(F.col("site") == a).groupBy(F.lit("x").alias("site"), "ts").agg(F.max("value").alias("value"), F.when(F.max("value") > 50, "A").otherwise("P").alias("code"))
    return X.join_flow_and_stage(side("view"), side("click"))


def _naturalize(s, d):
    months = F.when(F.col("site") == "ASIA", F.array(*(F.lit(m) for m in (6, 7, 8)))).otherwise(F.array(*(F.lit(m) for m in range(1, 13))))
    div = daily(s, d).filter("dayofmonth(date) <= 20").select("site", "date", (F.col("flow") / 10).alias("rate"), months.alias("months"), F.lit(0.25).alias("returned"))
    return X.naturalize(daily(s, d), div)


QUERIES = {
    "e1_annual_minimum": lambda s, d: rounded(L.annual_minimum(daily(s, d, "nation"), 7, min_days=200)),
    "c10_annual_minimum_water_year": lambda s, d: rounded(L.annual_minimum(daily(s, d), 30, "water", 300)),
    "d24_low_flow_moments": lambda s, d: rounded(L.log_moments(L.annual_minimum(daily_with_zeros(s, d), 3).filter("complete"))),
    "d9_duration_curve": lambda s, d: rounded(D.duration_curve(daily_with_zeros(s, d).withColumn("flow", F.col("flow"))).groupBy("site", "flow").agg(F.min("exceedance").alias("lo"), F.max("exceedance").alias("hi"))),
    "d10_seasonal_curves": lambda s, d: rounded(D.seasonal_curves(daily(s, d), SEASONS).groupBy("site", "season").agg(F.sum(F.col("flow") * 0 + F.col("exceedance")).alias("total"), F.count(F.lit(1)).alias("n"))),
    "d11_center_of_timing": lambda s, d: rounded(D.center_of_timing(daily(s, d), 300)),
    "d12_performance": lambda s, d: rounded(_performance(s, d)),
    "d13_summary_by_day": lambda s, d: rounded(D.summary_by_day(daily(s, d))),
    "d42_duration_statistics": lambda s, d: rounded(D.duration_statistics(daily(s, d), min_days=300)),
    "c1_fit_extension": lambda s, d: rounded(X.fit_extension(_ASIA(s, d), _OTHER(s, d))),
    "c2_extend_record": lambda s, d: rounded(X.extend(daily(s, d, "nation").filter("site IN ('NATION_0', 'NATION_1', 'CHINA', 'FRANCE')"), orders_daily(s, d).filter("site = 'O'").union(orders_daily(s, d).limit(0)))),
    "c3_flow_and_stage": lambda s, d: rounded(_flow_stage(s, d)),
    "c4_rank_donors": lambda s, d: rounded(X.rank_donors(_ASIA(s, d), _OTHER(s, d))),
    "c5_lag_profile": lambda s, d: rounded(X.lag_profile(_ASIA(s, d), daily(s, d).filter("site = 'EUROPE'"), 10)),
    "c5_best_lag": lambda s, d: rounded(X.best_lag(X.lag_profile(daily(s, d), daily(s, d), 45))),
    "c7_extension_statistics": lambda s, d: rounded(X.extension_statistics(monthly_peaks(s, d).filter("year > 30 AND year < 70"), monthly_peaks(s, d))),
    "c8_concurrent_relation": lambda s, d: rounded(X.concurrent_relation(monthly_peaks(s, d).filter("site = 'ASIA'"), monthly_peaks(s, d).filter("site <> 'ASIA'"))),
    "c9_naturalize": lambda s, d: rounded(_naturalize(s, d)),
}

_ROLL = "rl AS (SELECT *, CASE WHEN count(flow) OVER w = {n} THEN avg(flow) OVER w END AS mean FROM {t} WINDOW w AS (PARTITION BY site ORDER BY date ROWS BETWEEN {m} PRECEDING AND CURRENT ROW))"


def _minimum(n, t, y, days, extra=""):
    return _ROLL.format(n=n, m=n - 1, t=t) + f"\n--\nmn AS (SELECT site, {y} AS year, count(flow) AS n_days, count(flow) >= {days} AS complete, min(mean) AS min_flow, arg_min(date, (mean, date)) FILTER (mean IS NOT NULL) AS date FROM rl GROUP BY ALL)\n--\n" + (extra or "SELECT site, year, n_days, complete, min_flow, date FROM mn")


_PAIR = "pr AS (SELECT a.site, b.site AS donor, a.date, a.flow AS y, b.flow AS x FROM daily a JOIN daily b USING (date) WHERE a.site = 'ASIA' AND b.site <> 'ASIA')\n--\n"
_RANK = "rk AS (SELECT *, rank() OVER (PARTITION BY {k} ORDER BY y) + (count(*) OVER (PARTITION BY {k}, y) - 1) / 2 AS ry, rank() OVER (PARTITION BY {k} ORDER BY x) + (count(*) OVER (PARTITION BY {k}, x) - 1) / 2 AS rx FROM {t})\n--\n"

ORACLE = {
    "e1_annual_minimum": sql(_minimum(7, "gdense", "cy", 200), "min_flow", "year"),
    "c10_annual_minimum_water_year": sql(_minimum(30, "dense", "wy", 300), "min_flow", "year"),
    "d24_low_flow_moments": sql(_minimum(3, "zeros", "cy", 350, """
st AS (SELECT site, count(*) AS n, count(*) FILTER (min_flow = 0) AS n_zero, avg(log10(min_flow)) FILTER (min_flow > 0) AS mean_log, stddev_samp(log10(min_flow)) FILTER (min_flow > 0) AS std_log,
  skewness(log10(CASE WHEN min_flow > 0 THEN min_flow END)) AS sk FROM mn WHERE complete AND min_flow IS NOT NULL GROUP BY site)
--
SELECT site, n, n_zero, mean_log, std_log, CASE WHEN std_log > 1e-12 THEN greatest(-3.0, least(3.0, coalesce(sk, 0.0))) ELSE 0.0::DOUBLE END AS skew_log, n_zero / n AS p_zero FROM st"""), "mean_log std_log skew_log p_zero"),
    "d9_duration_curve": sql("f AS (SELECT site, flow, row_number() OVER (PARTITION BY site ORDER BY flow) AS k, count(*) OVER (PARTITION BY site) AS n FROM zeros)\n--\nSELECT site, flow, min((n - k + 1) / (n + 1)) AS lo, max((n - k + 1) / (n + 1)) AS hi FROM f WHERE flow > 0 GROUP BY ALL", "flow lo hi"),
    "d10_seasonal_curves": sql("""
f AS (SELECT site, CASE WHEN month(date) IN (12, 1, 2) THEN 'DJF' WHEN month(date) <= 5 THEN 'MAM' WHEN month(date) <= 8 THEN 'JJA' ELSE 'SON' END AS season, flow FROM daily)
--
g AS (SELECT site, season, row_number() OVER (PARTITION BY site, season ORDER BY flow) AS k, count(*) OVER (PARTITION BY site, season) AS n FROM f)
--
SELECT site, season, sum((n - k + 1) / (n + 1)) AS total, count(*) AS n FROM g GROUP BY ALL""", "total"),
    "d11_center_of_timing": sql("""
f AS (SELECT site, wy, sum(flow) OVER (PARTITION BY site, wy ORDER BY date) AS upto, sum(flow) OVER (PARTITION BY site, wy) AS total, row_number() OVER (PARTITION BY site, wy ORDER BY date) AS k FROM dense WHERE flow IS NOT NULL)
--
SELECT site, wy AS year, count(*) AS n_days, CASE WHEN count(*) >= 300 THEN min(k) FILTER (upto >= 0.5 * total)::DOUBLE END AS center_of_timing, count(*) >= 300 AS complete FROM f GROUP BY ALL""", "center_of_timing", "year"),
    "d12_performance": sql(_PAIR + """
q AS (SELECT donor AS site, y AS o, x AS e, quantile_cont(y, 0.1) OVER (PARTITION BY donor) AS cut, avg(y) OVER (PARTITION BY donor) AS m, log10(y) AS lo, log10(x) AS le, avg(log10(y)) OVER (PARTITION BY donor) AS lm FROM pr)
--
SELECT site, 1 - sum((o - e) ** 2) / sum((o - m) ** 2) AS nse, 1 - sum((lo - le) ** 2) / sum((lo - lm) ** 2) AS log_nse,
  1 - sqrt((corr(o, e) - 1) ** 2 + (stddev_pop(e) / stddev_pop(o) - 1) ** 2 + (avg(e) / avg(o) - 1) ** 2) AS kge, 100 * (sum(e) - sum(o)) / sum(o) AS pbias,
  100 * sum(e - o) FILTER (o <= cut) / sum(o) FILTER (o <= cut) AS pbias_dry, count(*) AS n FROM q GROUP BY site""", "nse log_nse kge pbias pbias_dry"),
    "d13_summary_by_day": sql("""
f AS (SELECT site, flow, date_diff('day', DATE '1999-10-01', make_date(CASE WHEN month(date) >= 10 THEN 1999 ELSE 2000 END, month(date), day(date))) + 1 AS dowy FROM daily)
--
SELECT site, dowy, avg(flow) AS mean, min(flow) AS min, max(flow) AS max, quantile_cont(flow, 0.1) AS p10, quantile_cont(flow, 0.25) AS p25, quantile_cont(flow, 0.5) AS p50, quantile_cont(flow, 0.75) AS p75, quantile_cont(flow, 0.9) AS p90 FROM f GROUP BY ALL""", "mean min max p10 p25 p50 p75 p90"),
    "d42_duration_statistics": sql("""
l AS (SELECT site, wy, list_sort(list(flow)) AS x FROM dense WHERE flow IS NOT NULL GROUP BY ALL HAVING count(*) >= 300)
--
h AS (SELECT site, wy, x, e AS exceedance, len(x) AS n, (len(x) + 1) * (1 - e / 100) AS h FROM l, (VALUES (10), (50), (90)) AS v(e))
--
q AS (SELECT *, greatest(1, least(n - 1, floor(h)::INT)) AS k FROM h)
--
v AS (SELECT site, exceedance, CASE WHEN h <= 1 THEN x[1] WHEN h >= n THEN x[n] ELSE x[k] + (h - k) * (x[k + 1] - x[k]) END AS flow FROM q)
--
SELECT site, exceedance, median(flow) AS median, stddev_samp(log10(flow)) AS log_sd, count(*) AS n_years FROM v WHERE flow > 0 GROUP BY ALL HAVING count(*) >= 3""", "median log_sd", "exceedance"),
    "c1_fit_extension": sql(_PAIR + "SELECT site, donor, avg(log10(y)) AS mean_short, stddev_samp(log10(y)) AS sd_short, avg(log10(x)) AS mean_index, stddev_samp(log10(x)) AS sd_index, corr(log10(y), log10(x)) AS correlation, count(*) AS n_concurrent, 0 AS n_excluded, CASE WHEN count(*) < 10 THEN 'too few pairs' WHEN NOT corr(log10(y), log10(x)) > 0 THEN 'no positive correlation' END AS reason FROM pr GROUP BY ALL", "mean_short sd_short mean_index sd_index correlation", "n_excluded"),
    "c2_extend_record": sql("""
sh AS (SELECT * FROM gappy WHERE site IN ('NATION_0', 'NATION_1', 'CHINA', 'FRANCE'))
--
ix AS (SELECT * FROM odaily WHERE site = 'O')
--
ft AS (SELECT s.site, avg(log10(s.flow)) AS my, stddev_samp(log10(s.flow)) AS sy, avg(log10(i.flow)) AS mx, stddev_samp(log10(i.flow)) AS sx, corr(log10(s.flow), log10(i.flow)) AS r FROM sh s JOIN ix i USING (date) WHERE s.flow > 0 AND i.flow > 0 GROUP BY s.site HAVING count(*) >= 10 AND r > 0)
--
es AS (SELECT ft.site, ix.date, CASE WHEN flow > 0 THEN 10 ** (my + sign(r) * sy / sx * (log10(flow) - mx)) END AS est FROM ft, ix)
--
ob AS (SELECT sh.* FROM sh JOIN ft USING (site))
--
SELECT coalesce(ob.site, es.site) AS site, coalesce(ob.date, es.date) AS date, coalesce(flow, est) AS flow, CASE WHEN flow IS NOT NULL THEN 'observed' WHEN est IS NOT NULL THEN 'move1' ELSE 'none' END AS source FROM ob FULL JOIN es ON ob.site = es.site AND ob.date = es.date""", "flow"),
    "c3_flow_and_stage": sql("""
h AS (SELECT site, date_trunc('hour', ts) AS ts, max(value) AS value, CASE WHEN max(value) > 50 THEN 'A' ELSE 'P' END AS code FROM iv GROUP BY ALL)
--
SELECT 'x' AS site, coalesce(a.ts, b.ts) AS ts, a.value AS flow, b.value AS stage, coalesce(a.code, b.code) AS code, a.code IS NOT NULL AND b.code IS NOT NULL AND a.code <> b.code AS conflict
FROM (SELECT * FROM h WHERE site = 'view') a FULL JOIN (SELECT * FROM h WHERE site = 'click') b ON a.ts = b.ts""", "flow stage"),
    "c4_rank_donors": sql(_PAIR + _RANK.format(k="donor", t="pr") + "SELECT site, donor, count(*) AS n_concurrent, corr(log10(y), log10(x)) AS pearson_log, corr(ry, rx) AS spearman, count(*) >= 365 AS sufficient FROM rk GROUP BY ALL", "pearson_log spearman"),
    "c5_best_lag": sql("lg AS (SELECT a.site || '|' || b.site AS pair, k AS lag_days, a.flow AS y, b.flow AS x FROM daily b, unnest(range(-45, 46)) AS r(k), daily a WHERE a.site <> b.site AND a.date = (b.date + k::INT)::DATE),\n" + "rk2 AS (SELECT *, rank() OVER (PARTITION BY pair, lag_days ORDER BY y) + (count(*) OVER (PARTITION BY pair, lag_days, y) - 1) / 2 AS ry, rank() OVER (PARTITION BY pair, lag_days ORDER BY x) + (count(*) OVER (PARTITION BY pair, lag_days, x) - 1) / 2 AS rx FROM lg),\nsp AS (SELECT pair, lag_days, corr(ry, rx) AS spearman, count(*) AS n_concurrent FROM rk2 GROUP BY ALL)\n--\nSELECT split_part(pair, '|', 1) AS site, split_part(pair, '|', 2) AS donor, lag_days, spearman, n_concurrent FROM sp QUALIFY row_number() OVER (PARTITION BY pair ORDER BY spearman DESC, abs(lag_days), lag_days DESC) = 1", "spearman", "lag_days"),
    "c5_lag_profile": sql("lg AS (SELECT a.site, b.site AS donor, k AS lag_days, a.flow AS y, b.flow AS x FROM daily b, unnest(range(-10, 11)) AS r(k), daily a WHERE a.site = 'ASIA' AND b.site = 'EUROPE' AND a.date = (b.date + k::INT)::DATE)\n--\n" + _RANK.format(k="lag_days", t="lg") + "SELECT site, donor, lag_days, corr(ry, rx) AS spearman, count(*) AS n_concurrent FROM rk GROUP BY ALL", "spearman"),
    "c7_extension_statistics": sql("""
yy AS (SELECT site, year, log10(flow) AS y FROM mpeaks WHERE year > 30 AND year < 70)
--
xx AS (SELECT site AS donor, year, log10(flow) AS x FROM mpeaks)
--
nr AS (SELECT site, donor, count(*) AS n1, avg(y) AS y1, avg(x) AS x1, var_samp(y) AS s2y, var_samp(x) AS s2x, corr(y, x) AS rho FROM yy JOIN xx USING (year) WHERE site <> donor GROUP BY ALL)
--
fr AS (SELECT nr.site, nr.donor, count(*) AS n2, avg(x) AS x2, var_samp(x) AS s2x2 FROM nr JOIN xx USING (donor) WHERE NOT EXISTS (SELECT 1 FROM yy WHERE yy.site = nr.site AND yy.year = xx.year) GROUP BY ALL)
--
bb AS (SELECT *, rho * sqrt(s2y / s2x) AS beta, x2 - x1 AS gain, n2 * (n1 - 4) * (n1 - 1) / ((n2 - 1) * (n1 - 3) * (n1 - 2)) AS a2 FROM nr JOIN fr USING (site, donor))
--
SELECT site, donor, n1, y1, x1, s2y, s2x, rho, n2, x2, s2x2, beta, y1 + n2 / (n1 + n2) * beta * gain AS mean_augmented,
  ((n1 - 1) * s2y + (n2 - 1) * beta ** 2 * s2x2 + (n2 - 1) * a2 * (1 - rho ** 2) * s2y + n1 * n2 / (n1 + n2) * beta ** 2 * gain ** 2) / (n1 + n2 - 1) AS variance_augmented,
  n1 / (1 - n2 / (n1 + n2) * (rho ** 2 - (1 - rho ** 2) / (n1 - 3))) AS effective_length_mean FROM bb""", "y1 x1 s2y s2x rho x2 s2x2 beta mean_augmented variance_augmented effective_length_mean"),
    "c8_concurrent_relation": sql("""
p AS (SELECT a.site, b.site AS donor, year, a.flow AS y, b.flow AS x, row_number() OVER (PARTITION BY b.site ORDER BY year) - 1 AS k, count(*) OVER (PARTITION BY b.site) AS n FROM mpeaks a JOIN mpeaks b USING (year) WHERE a.site = 'ASIA' AND b.site <> 'ASIA')
--
q AS (SELECT *, CASE WHEN k < n // 2 THEN 'first' ELSE 'second' END AS part, log10(y) - log10(x) AS r FROM p UNION ALL SELECT *, 'all', log10(y) - log10(x) FROM p)
--
SELECT site, donor, part, min(year) AS start, max(year) AS "end", count(*) AS n, 10 ** median(r) AS median_ratio, stddev_samp(r) AS ratio_log_sd, CASE WHEN count(*) >= 3 THEN corr(log10(x), log10(y)) END AS correlation FROM q GROUP BY site, donor, part""", "median_ratio ratio_log_sd correlation", 'start "end"'),
    "c9_naturalize": sql("SELECT site, date, flow AS gaged, CASE WHEN day(date) <= 20 AND (site <> 'ASIA' OR month(date) IN (6, 7, 8)) THEN flow / 10 * 0.75 ELSE 0.0 END AS diverted, flow + CASE WHEN day(date) <= 20 AND (site <> 'ASIA' OR month(date) IN (6, 7, 8)) THEN flow / 10 * 0.75 ELSE 0.0 END AS natural_flow FROM daily", "gaged diverted natural_flow"),
}
