"""Queries: sub-daily metrics over events, and trend statistics over monthly maxima."""

from __future__ import annotations

from pyspark.sql import functions as F

from headwater.operators import subdaily as S
from headwater.operators import trend as T
from headwater.plans.common import rounded, sql
from headwater.plans.tables import daily, instantaneous, monthly_peaks

ZONE = "America/Denver"


def _minutes(s, d):
    """One reading a minute: the greatest."""
    return instantaneous(s, d).groupBy("site", F.date_trunc("minute", "ts").alias("ts")).agg(F.max("value").alias("value"))


def _hours(s, d):
    return instantaneous(s, d).groupBy("site", F.date_trunc("hour", "ts").alias("ts")).agg(F.max("value").alias("value"))


def _p(s, d):
    return T.pettitt(monthly_peaks(s, d)).select("site", F.col("p_value").alias("p"))


QUERIES = {
    "b5_valid_values": lambda s, d: rounded(S.valid(instantaneous(s, d), "UTC").groupBy("site").agg(F.sum("value").alias("total"), F.count("value").alias("n"))),
    "b6_local_days": lambda s, d: S.valid(instantaneous(s, d), ZONE).groupBy("site", "date").agg(F.count(F.lit(1)).alias("n")),
    "b8_median_step": lambda s, d: rounded(S.median_step(instantaneous(s, d))),
    "d15_diel_variation": lambda s, d: rounded(S.diel_variation(_hours(s, d), ZONE)),
    "d16_diel_summary": lambda s, d: rounded(S.diel_summary(S.diel_variation(_hours(s, d), ZONE, 0.5))),
    "d17_circular_hours": lambda s, d: rounded(S.circular_hours(instantaneous(s, d).withColumn("hour", F.hour("ts") + F.minute("ts") / 60), "hour")),
    "d18_extreme_timing": lambda s, d: rounded(S.extreme_timing(_hours(s, d), ZONE)),
    "d19_timing_summary": lambda s, d: rounded(S.circular_hours(S.extreme_timing(_hours(s, d), ZONE, 0.5).filter("complete"), "hour_max")),
    "d20_ramping_rates": lambda s, d: rounded(S.ramping_rates(_minutes(s, d), ZONE), 5),
    "d21_window_changes": lambda s, d: rounded(S.window_changes(_hours(s, d), ZONE, 3)),
    "d22_ramping_summary": lambda s, d: rounded(S.ramping_summary(S.ramping_rates(_minutes(s, d), ZONE), 500, 500), 4),
    "d25_mann_kendall": lambda s, d: rounded(T.mann_kendall(monthly_peaks(s, d))),
    "d27_sens_slope": lambda s, d: rounded(T.sens_slope(monthly_peaks(s, d))),
    "d29_pettitt": lambda s, d: rounded(T.pettitt(monthly_peaks(s, d))),
    "d30_cusum": lambda s, d: rounded(T.cusum(monthly_peaks(s, d))),
    "d31_lombard": lambda s, d: rounded(T.lombard(monthly_peaks(s, d))),
    "d32_field_significance": lambda s, d: rounded(T.field_significance(_p(s, d), 0.5)),
    "d33_field_bootstrap": lambda s, d: rounded(T.field_bootstrap(monthly_peaks(s, d))),
    "d34_pot_counts": lambda s, d: rounded(T.pot_counts(daily(s, d, "nation"), 60.0, 7, 150)),
    "d34_pot_events": lambda s, d: rounded(T.pot_events(daily(s, d, "nation"), 60.0, 7, 150)),
    "d35_count_trend": lambda s, d: rounded(T.count_trend(T.pot_counts(daily(s, d, "nation"), 60.0, 7, 150))),
    "d34_pot_threshold": lambda s, d: rounded(T.pot_threshold(daily(s, d), 6.0, min_days=200, min_years=2)),
    "d36_mixed_population": lambda s, d: rounded(_mixed(s, d)),
    "d37_attribute_change": lambda s, d: rounded(_attribute(s, d)),
    "d26_d28_d30_d31_d39_screen": lambda s, d: rounded(T.screen(monthly_peaks(s, d), 199)),
}


def _mixed(s, d):
    return T.mixed_population(T.pot_events(daily(s, d, "nation"), 60.0, 7, 150).withColumnRenamed("peak_date", "date"))


def _attribute(s, d):
    p = T.pettitt(monthly_peaks(s, d)).select("site", F.col("year").alias("change_year"))
    events = monthly_peaks(s, d).filter("flow > 250").select("site", "year", F.lit("high month").alias("cause"))
    return T.attribute_change(p, events, 5)


_V = "lv AS (SELECT site, ts, value, timezone('America/Denver', timezone('UTC', ts)) AS local FROM {t})\n--\nld AS (SELECT *, local::DATE AS date FROM lv)\n--\n"
_HOURS = "hr AS (SELECT site, date_trunc('hour', ts) AS ts, max(value) AS value FROM iv GROUP BY ALL)\n--\n"
_MINUTES = "mi AS (SELECT site, date_trunc('minute', ts) AS ts, max(value) AS value FROM iv GROUP BY ALL)\n--\n"
_STEP = "st AS (SELECT site, median(s) AS step FROM (SELECT site, epoch_us(ts) / 60e6 - lag(epoch_us(ts)) OVER (PARTITION BY site ORDER BY ts) / 60e6 AS s FROM {t}) GROUP BY site)\n--\n"
_DIEL = _HOURS + _V.format(t="hr") + _STEP.format(t="hr") + "di AS (SELECT site, date, min(value) AS min, max(value) AS max, avg(value) AS mean, stddev_samp(value) AS std, count(value) AS n, max(value) - min(value) AS range, CASE WHEN avg(value) > 0 THEN stddev_samp(value) / avg(value) END AS cv, 24.0::DOUBLE * 60 / max(step) AS n_expected FROM ld JOIN st USING (site) GROUP BY ALL)\n--\n"
_TIMING = _HOURS + _V.format(t="hr") + _STEP.format(t="hr") + """
hl AS (SELECT *, max(value) OVER w AS hi, min(value) OVER w AS lo, (epoch_us(local) - epoch_us(date::TIMESTAMP)) / 3600e6 AS hour FROM ld WINDOW w AS (PARTITION BY site, date))
--
ti AS (SELECT site, date, CASE WHEN max(hi) <> max(lo) THEN arg_min(hour, (-value, ts)) END AS hour_max, CASE WHEN max(hi) <> max(lo) THEN arg_min(hour, (value, ts)) END AS hour_min,
  count(*) FILTER (value = hi) AS n_max, count(*) FILTER (value = lo) AS n_min, count(*) AS n, 24.0::DOUBLE * 60 / max(step) AS n_expected FROM hl JOIN st USING (site) GROUP BY ALL)
--
"""
_CIRC = """
cc AS (SELECT site, avg(cos(h * 2 * pi() / 24)) AS c, avg(sin(h * 2 * pi() / 24)) AS s, count(*)::DOUBLE AS n FROM hh WHERE h IS NOT NULL GROUP BY site)
--
cr AS (SELECT *, least(1.0, sqrt(c * c + s * s)) AS r FROM cc)
--
SELECT site, CASE WHEN atan2(s, c) < 0 THEN atan2(s, c) + 2 * pi() ELSE atan2(s, c) END * 24 / (2 * pi()) AS mean_hour, r AS concentration, sqrt(-2 * ln(r)) * 24 / (2 * pi()) AS std_hours,
  least(1.0, exp(sqrt(1 + 4 * n + 4 * (n * n - n * r * r * n)) - (1 + 2 * n))) AS rayleigh_p, n::BIGINT AS n FROM cr"""
_RAMP = _MINUTES + _V.format(t="mi") + _STEP.format(t="mi") + """
rr AS (SELECT site, ts, date, (epoch_us(ts) - lag(epoch_us(ts)) OVER w) / 3600e6 AS dt, value - lag(value) OVER w AS delta, lag(value) OVER w AS before FROM ld WINDOW w AS (PARTITION BY site ORDER BY ts))
--
rg AS (SELECT r.*, dt > step * 3 / 60 AS gapped, CASE WHEN NOT dt > step * 3 / 60 AND dt > 0 THEN delta / dt END AS rate FROM rr r JOIN st USING (site) WHERE dt IS NOT NULL)
--
rs AS (SELECT *, CASE WHEN before > 0 THEN 100 * rate / before END AS pct, rate IS NOT NULL AND rate <> 0 AND sign(rate) <> lag(sign(rate)) OVER (PARTITION BY site, date, rate IS NOT NULL AND rate <> 0 ORDER BY ts) AS turn FROM rg)
--
rd AS (SELECT site, date, max(CASE WHEN rate IS NOT NULL THEN greatest(rate, 0) END) AS max_up, min(CASE WHEN rate IS NOT NULL THEN least(rate, 0) END) AS max_down, avg(abs(rate)) AS mean_abs,
  max(CASE WHEN pct IS NOT NULL THEN greatest(pct, 0) END) AS max_up_pct, min(CASE WHEN pct IS NOT NULL THEN least(pct, 0) END) AS max_down_pct, avg(abs(pct)) AS mean_abs_pct,
  count(*) FILTER (turn) AS n_reversals, count(rate) AS n_intervals, count(*) FILTER (gapped) AS n_gapped FROM rs GROUP BY ALL)
--
"""
_ORD = "od AS (SELECT site, year, flow, row_number() OVER (PARTITION BY site ORDER BY year) AS i, count(*) OVER (PARTITION BY site) AS n FROM mpeaks)\n--\npa AS (SELECT a.site, a.i, b.i AS j, a.n, a.flow AS x, b.flow AS y, a.year AS t, b.year AS u FROM od a JOIN od b ON a.site = b.site AND a.i < b.i)\n--\n"
_PET = _ORD + """
uu AS (SELECT k.site, k.i AS k, k.n, sum(sign(x - y)) AS u FROM od k JOIN pa p ON p.site = k.site AND p.i <= k.i AND p.j > k.i WHERE k.i < k.n GROUP BY ALL)
--
pe AS (SELECT site, max(abs(u)) AS k, arg_min(k, (-abs(u), k)) AS idx, arg_min(u, (-abs(u), k)) AS u, max(n)::DOUBLE AS n FROM uu GROUP BY site)
--
pt AS (SELECT pe.site, idx AS index, year, k, least(1.0, 2 * exp(-6 * k ** 2 / (pe.n ** 3 + pe.n ** 2))) AS p_value, CASE WHEN u < 0 THEN 'up' ELSE 'down' END AS shift FROM pe JOIN od ON od.site = pe.site AND od.i = idx + 1)
--
"""
_POT = """
cw AS (SELECT site, date, flow, wy, count(*) OVER (PARTITION BY site, wy) AS nd FROM gdense WHERE flow IS NOT NULL)
--
ab AS (SELECT *, CASE WHEN date - lag(date) OVER w < 7 THEN 0 ELSE 1 END AS new FROM cw WHERE nd >= 150 AND flow > 60 WINDOW w AS (PARTITION BY site ORDER BY date))
--
ec AS (SELECT *, sum(new) OVER (PARTITION BY site ORDER BY date) AS event FROM ab)
--
ev AS (SELECT site, event, arg_min(date, (-flow, date)) AS peak_date, max(flow) AS peak FROM ec GROUP BY ALL)
--
"""
ORACLE = {
    "b5_valid_values": sql("SELECT site, sum(value) AS total, count(value) AS n FROM iv GROUP BY site", "total"),
    "b6_local_days": sql(_V.format(t="iv") + "SELECT site, date, count(*) AS n FROM ld GROUP BY ALL"),
    "b8_median_step": sql(_STEP.format(t="iv") + "SELECT site, step AS step_minutes FROM st", "step_minutes"),
    "d15_diel_variation": sql(_DIEL + "SELECT *, n >= 0.9::DOUBLE * n_expected AS complete FROM di", "min max mean std range cv n_expected"),
    "d16_diel_summary": sql(_DIEL + "SELECT site, avg(min) AS mean_min, avg(max) AS mean_max, avg(mean) AS mean_mean, avg(range) AS mean_range, avg(cv) AS mean_cv, count(*) AS n_days FROM di WHERE n >= 0.5 * n_expected GROUP BY site", "mean_min mean_max mean_mean mean_range mean_cv"),
    "d17_circular_hours": sql("hh AS (SELECT site, hour(ts) + minute(ts) / 60 AS h FROM iv)\n--\n" + _CIRC.lstrip(), "mean_hour concentration std_hours rayleigh_p"),
    "d18_extreme_timing": sql(_TIMING + "SELECT *, n >= 0.9::DOUBLE * n_expected AS complete FROM ti", "hour_max hour_min n_expected"),
    "d19_timing_summary": sql(_TIMING + "hh AS (SELECT site, hour_max AS h FROM ti WHERE n >= 0.5 * n_expected)\n--\n" + _CIRC.lstrip(), "mean_hour concentration std_hours rayleigh_p"),
    "d20_ramping_rates": sql(_RAMP + "SELECT * FROM rd").replace("SELECT *  FROM res", "SELECT * REPLACE (" + ", ".join(f"round({c}, 5) AS {c}" for c in "max_up max_down mean_abs max_up_pct max_down_pct mean_abs_pct".split()) + ") FROM res"),
    "d21_window_changes": sql(_HOURS + _V.format(t="hr") + "SELECT a.site, a.date, max(greatest(a.value - b.value, 0)) AS max_rise, min(least(a.value - b.value, 0)) AS max_fall, count(*) AS n_windows FROM ld a JOIN ld b ON a.site = b.site AND a.ts = b.ts + INTERVAL 3 HOURS GROUP BY ALL", "max_rise max_fall"),
    "d22_ramping_summary": sql(_RAMP + "SELECT site, avg(max_up) AS mean_max_up, max(max_up) AS max_up, avg(max_down) AS mean_max_down, min(max_down) AS max_down, avg(n_reversals) AS mean_reversals, count(*) FILTER (max_up > 500) AS n_over, avg((max_up > 500)::INT) AS share_over, count(*) FILTER (max_down < -500) AS n_under, avg((max_down < -500)::INT) AS share_under FROM rd GROUP BY site").replace("SELECT *  FROM res", "SELECT * REPLACE (" + ", ".join(f"round({c}, 4) AS {c}" for c in "mean_max_up max_up mean_max_down max_down mean_reversals share_over share_under".split()) + ") FROM res"),
    "d25_mann_kendall": sql(_ORD + """
ss AS (SELECT site, sum(sign(y - x))::DOUBLE AS s, max(n) AS n FROM pa GROUP BY site)
--
tt AS (SELECT site, sum(c * (c - 1) * (2 * c + 5)) AS ties FROM (SELECT site, flow, count(*) AS c FROM od GROUP BY ALL) GROUP BY site)
--
vv AS (SELECT *, (n * (n - 1) * (2 * n + 5) - ties) / 18 AS var_s FROM ss JOIN tt USING (site))
--
SELECT site, n, s, var_s::DOUBLE AS var_s, (CASE WHEN s > 0 THEN (s - 1) / sqrt(var_s) WHEN s < 0 THEN (s + 1) / sqrt(var_s) ELSE 0 END)::DOUBLE AS z, s / (n * (n - 1) / 2) AS tau FROM vv""", "s var_s z tau"),
    "d27_sens_slope": sql(_ORD + "sl AS (SELECT site, median((y - x) / (u - t)) AS slope FROM pa GROUP BY site)\n--\nSELECT site, slope, median(flow - slope * year) AS intercept FROM od JOIN sl USING (site) GROUP BY ALL", "slope intercept"),
    "d29_pettitt": sql(_PET + "SELECT site, index, year, k::DOUBLE AS k, p_value, shift FROM pt", "k p_value", "index year"),
    "d30_cusum": sql(_ORD + "dv AS (SELECT site, i, n, sum(flow) OVER (PARTITION BY site ORDER BY i) - i * avg(flow) OVER (PARTITION BY site) AS d FROM od)\n--\nSELECT site, max(abs(d)) AS max_abs, arg_min(i, (-round(abs(d), 9), i)) AS index FROM dv WHERE i < n GROUP BY site", "max_abs", "index"),
    "d31_lombard": sql(_ORD + """
rk AS (SELECT *, rank() OVER (PARTITION BY site ORDER BY flow) + (count(*) OVER (PARTITION BY site, flow) - 1) / 2 AS r FROM od)
--
ph AS (SELECT *, 2 * r / (n + 1) - 1 AS phi FROM rk)
--
zz AS (SELECT *, (phi - avg(phi) OVER (PARTITION BY site)) / stddev_pop(phi) OVER (PARTITION BY site) AS z FROM ph)
--
ll AS (SELECT *, sum(z) OVER (PARTITION BY site ORDER BY i) AS l FROM zz)
--
tt AS (SELECT *, sum(l) OVER (PARTITION BY site ORDER BY i) AS t FROM ll)
--
SELECT site, sum(l ** 2) / max(n) ** 2 AS abrupt, (max(n) * sum(t ** 2) - sum(t) ** 2) / max(n)::DOUBLE ** 5 AS smooth FROM tt GROUP BY site""", "abrupt smooth"),
    "d32_field_significance": sql(_PET + "pk AS (SELECT p_value AS p, row_number() OVER (ORDER BY p_value) AS k, count(*) OVER () AS m FROM pt)\n--\nSELECT max(m) AS n_sites, count(*) FILTER (p < 0.5) AS n_local, max(p) FILTER (p <= 0.5 * k / m) AS fdr_threshold, 1 - (1 - min(p)) ** max(m) AS walker_p FROM pk", "fdr_threshold walker_p"),
    "d34_pot_counts": sql(_POT + "yc AS (SELECT DISTINCT site, wy FROM cw WHERE nd >= 150)\n--\nSELECT yc.site, yc.wy AS year, count(event) AS n_events FROM yc LEFT JOIN ev ON ev.site = yc.site AND year(peak_date) + (month(peak_date) >= 10)::INT = yc.wy GROUP BY ALL", longs="year"),
    "d34_pot_events": sql(_POT + "SELECT site, event::BIGINT AS event, peak_date, peak FROM ev", "peak"),
    "d36_mixed_population": sql(_POT + "SELECT site, n, cool_share, (degrees(atan2(s, c)) + CASE WHEN atan2(s, c) < 0 THEN 360 ELSE 0 END) / 360 * 365.25 AS mean_day, sqrt(c * c + s * s) AS concentration, cool_share > 0.2 AND cool_share < 0.8 AS mixed FROM (SELECT site, count(*) AS n, avg((month(peak_date) IN (10, 11, 12, 1, 2, 3))::INT) AS cool_share, avg(cos(2 * pi() * dayofyear(peak_date) / dayofyear(make_date(year(peak_date), 12, 31)))) AS c, avg(sin(2 * pi() * dayofyear(peak_date) / dayofyear(make_date(year(peak_date), 12, 31)))) AS s FROM ev GROUP BY site)", "cool_share mean_day concentration"),
    "d37_attribute_change": sql(_PET + "SELECT pt.site, pt.year AS change_year, m.year, 'high month' AS cause, m.year - pt.year AS \"offset\" FROM pt JOIN mpeaks m ON m.site = pt.site AND m.flow > 250 AND abs(m.year - pt.year) <= 5", longs='change_year year "offset"'),
}
