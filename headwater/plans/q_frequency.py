"""Queries: frequency fits over monthly maxima taken as annual peaks."""

from __future__ import annotations

from pyspark.sql import functions as F

from headwater.operators import frequency as Q
from headwater.operators import lowflow as L
from headwater.operators import peaks as P
from headwater.plans.common import rounded, sql
from headwater.plans.q_transfer import coded, periods
from headwater.plans.tables import daily, monthly_peaks

QUERIES = {
    "g1_frequency_fit": lambda s, d: rounded(Q.fit_peaks(monthly_peaks(s, d)), 4),
    "g4_g5_censored_fit": lambda s, d: rounded(Q.fit_intervals(P.station_rows(coded(s, d), periods(s, d)), -0.2, 0.3), 4),
    "g16_g2_skew_tables": lambda s, d: rounded(Q.skew_tables(P.station_rows(coded(s, d), periods(s, d)), -0.2, 0.3, (0.1, 0.01)), 4),
    "g15_g12_analyse": lambda s, d: rounded(Q.analyse(coded(s, d), monthly_peaks(s, d).select("site").distinct().filter("site <> 'AFRICA'").withColumns({"skew": F.lit(-0.2), "mse": F.lit(0.3)}), periods(s, d), (0.1, 0.01)), 4),
    "g3_log_moments": lambda s, d: rounded(Q.log_moments(monthly_peaks(s, d))),
    "f1_d47_moment_quantiles": lambda s, d: rounded(Q.moment_quantiles(monthly_peaks(s, d)), 4),
    "g17_g30_compare": lambda s, d: rounded(Q.compare(Q.moment_quantiles(monthly_peaks(s, d)), Q.fit_peaks(monthly_peaks(s, d), screen=False)), 4),
    "d23_g18_low_flow_quantiles": lambda s, d: rounded(L.conditional_quantiles(L.log_moments(L.annual_minimum(daily(s, d), 7, min_days=300))), 4),
    "g19_bootstrap_limits": lambda s, d: rounded(Q.bootstrap_limits(L.annual_minimum(daily(s, d), 7, min_days=300)), 4),
}

ORACLE = {
    "g3_log_moments": sql("SELECT site, count(*) AS n, avg(log10(flow)) AS mean_log, stddev_samp(log10(flow)) AS std_log, skewness(log10(flow)) AS skew FROM mpeaks WHERE flow > 0 GROUP BY site", "mean_log std_log skew"),
}
