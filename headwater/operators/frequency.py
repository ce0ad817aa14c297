"""Flood-frequency fits of many sites at once: each site's short record is one group of a grouped kernel."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from headwater.functions import censored as C
from headwater.functions import special as S
from headwater.operators.lowflow import adjusted_skew

def by_site(rows: DataFrame):
    """Groups by site over as many tasks as a shuffle has: records are small and fits are not, so bytes don't count."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "site").groupBy("site")


AEPS = (0.99, 0.9, 0.5, 0.2, 0.1, 0.04, 0.02, 0.01, 0.005, 0.002)
RESULT = "site string, n long, mean_log double, std_log double, skew double, station_skew double, n_low long, threshold double, iterations long, aep double, flow double, lower double, upper double, variance_log double, error string"


def fit_intervals(rows: DataFrame, regional_skew: float | None = None, regional_mse: float | None = None, aeps: tuple[float, ...] = AEPS, screen: bool = True, option: str = "weighted") -> DataFrame:
    """Censored fit of each site: rows of site, ql and qu (flow intervals; equal for exact peaks).

    tl and tu, if there, are the perception thresholds of each year, as flows. Returns a row for each site and aep, with
    90 % limits. A record that can't be fitted gives one row with its error instead.
    """
    thresholds = {"tl", "tu"} <= set(rows.columns)

    def run(part: pd.DataFrame) -> pd.DataFrame:
        site = part["site"].iloc[0]
        columns = [c.split()[0] for c in RESULT.split(", ")]
        try:
            lo = np.log10(np.maximum(part["ql"].to_numpy(float), 1e-20))
            hi = np.log10(np.minimum(np.maximum(part["qu"].to_numpy(float), 1e-20), 1e20))
            if (lo == hi).sum() < 3:
                raise ValueError("fewer than 3 exact peaks")
            log = lambda c: np.log10(np.clip(part[c].to_numpy(float), 1e-20, 1e20))
            tl, tu = (log("tl"), log("tu")) if thresholds else (None, None)
            f = C.fit(np.where((lo != hi) & (lo <= -20), C.LEAST_LOG, lo), hi, regional_skew, regional_mse, screen, tl, tu, option)
            head = (site, f.n, f.mean, f.sd, f.skew, f.station_skew, f.n_low, None if f.threshold is None else 10**f.threshold, f.iterations)
            out = []
            for aep, (y, a, b, v) in zip(aeps, f.limits(aeps)):
                out.append((*head, aep, 10**y, 10**a, 10**b, v, None))
        except (ValueError, ArithmeticError, np.linalg.LinAlgError) as e:
            out = [(site, len(part), *[None] * 12, str(e))]
        return pd.DataFrame(out, columns=columns)

    return by_site(rows).applyInPandas(run, RESULT)


def fit_peaks(peaks: DataFrame, **options) -> DataFrame:
    """fit_intervals of plain exact peaks (site, flow)."""
    return fit_intervals(peaks.filter("flow > 0").select("site", F.col("flow").alias("ql"), F.col("flow").alias("qu")), **options)


def skew_tables(rows: DataFrame, regional_skew: float, regional_mse: float, aeps: tuple[float, ...] = AEPS) -> DataFrame:
    """Quantiles and limits of each site by station, weighted and regional skew, as rows of fit_intervals with the option."""
    out = None
    for option in ("station", "weighted", "regional"):
        one = fit_intervals(rows, regional_skew, regional_mse, aeps, option=option).withColumn("option", F.lit(option))
        out = one if out is None else out.unionAll(one)
    return out


def analyse(peaks: DataFrame, regional: DataFrame | None = None, thresholds: DataFrame | None = None, aeps: tuple[float, ...] = AEPS) -> DataFrame:
    """One call for many sites: coded peaks (site, year, flow, code), regional skews (site, skew, mse) and perception periods.

    Sites without a regional skew are fitted with their own. Where a record can't be fitted and is plain (no censored
    year), the method of moments stands in and says so in error.
    """
    from headwater.operators.peaks import station_rows

    rows = (
        station_rows(peaks, thresholds)
        if thresholds is not None
        else peaks.filter("flow > 0").select("site", "year", F.col("flow").alias("ql"), F.col("flow").alias("qu"), F.lit(0.0).alias("tl"), F.lit(1e20).alias("tu"), F.lit("exact").alias("kind"))
    )
    rows = rows.join(regional.select("site", "skew", "mse"), "site", "left") if regional is not None else rows.withColumns({"skew": F.lit(None).cast("double"), "mse": F.lit(None).cast("double")})

    def run(part: pd.DataFrame) -> pd.DataFrame:
        site, columns = part["site"].iloc[0], [c.split()[0] for c in RESULT.split(", ")]
        log = lambda c: np.log10(np.clip(part[c].to_numpy(float), 1e-20, 1e20))
        skew, mse = part["skew"].iloc[0], part["mse"].iloc[0]
        given = (float(skew), float(mse)) if pd.notna(skew) and pd.notna(mse) else (None, None)
        out = []
        try:
            lo, hi = log("ql"), log("qu")
            if (lo == hi).sum() < 3:
                raise ValueError("fewer than 3 exact peaks")
            f = C.fit(lo, hi, *given, tl=log("tl"), tu=log("tu"))
            head = (site, f.n, f.mean, f.sd, f.skew, f.station_skew, f.n_low, None if f.threshold is None else 10**f.threshold, f.iterations)
            out = [(*head, aep, 10**y, 10**a, 10**b, v, None) for aep, (y, a, b, v) in zip(aeps, f.limits(aeps))]
        except (ValueError, ArithmeticError, np.linalg.LinAlgError) as e:
            x = log("ql")
            if (part["kind"] == "exact").all() and len(x) >= 3 and x.std(ddof=1) > 0:
                mean, sd = x.mean(), x.std(ddof=1)
                g = float(len(x) * ((x - mean) ** 3).sum() / ((len(x) - 1) * (len(x) - 2) * sd**3))
                out = [(site, len(x), mean, sd, g, g, 0, None, 0, aep, 10 ** (mean + S.frequency_factor(g, aep) * sd), None, None, None, f"moments: {e}") for aep in aeps]
            else:
                out = [(site, len(x), *[None] * 12, str(e))]
        return pd.DataFrame(out, columns=columns)

    return by_site(rows).applyInPandas(run, RESULT)


def log_moments(peaks: DataFrame) -> DataFrame:
    """Mean, deviation and adjusted skew of the logs of positive peaks."""
    lg = F.log10("flow")
    return peaks.filter("flow > 0").groupBy("site").agg(F.count(F.lit(1)).alias("n"), F.avg(lg).alias("mean_log"), F.stddev_samp(lg).alias("std_log"), adjusted_skew(lg).alias("skew"))


def moment_quantiles(peaks: DataFrame, aeps: tuple[float, ...] = AEPS) -> DataFrame:
    """Plain method of moments: aggregates in the engine, frequency factors by a vectorised UDF."""
    rows = log_moments(peaks).withColumn("aep", F.explode(F.array(*(F.lit(float(a)) for a in aeps))))
    k = S.k_factor("skew", F.col("aep"))
    return rows.select("site", "aep", k.alias("k"), F.pow(F.lit(10.0), F.col("mean_log") + k * F.col("std_log")).alias("flow"))


def conditional_moment_quantiles(peaks: DataFrame, aeps: tuple[float, ...] = AEPS) -> DataFrame:
    """Method of moments without the peaks below the single low-outlier cut, at probabilities raised by their share.

    A probability that would reach 1 has no quantile (null); sites with fewer than 3 peaks above the cut have no row.
    """
    from headwater.operators.peaks import low_outlier_cut

    cut = low_outlier_cut(peaks).select("site", F.col("n").alias("n_all"), "cut")
    above = peaks.filter("flow > 0").join(cut, "site").filter("flow >= cut")
    m = log_moments(above.select("site", "flow")).filter("n >= 3").join(cut, "site")
    rows = m.withColumn("aep", F.explode(F.array(*(F.lit(float(a)) for a in aeps)))).withColumn("conditional", F.col("aep") * F.col("n_all") / F.col("n"))
    k = S.k_factor("skew", F.when(F.col("conditional") < 1, F.col("conditional")))
    return rows.select("site", "aep", (F.col("n_all") - F.col("n")).alias("n_low"), "conditional", F.pow(F.lit(10.0), F.col("mean_log") + k * F.col("std_log")).alias("flow"))


def compare(a: DataFrame, b: DataFrame, tolerance_pct: float = 1.0) -> DataFrame:
    """Percent difference of two fits' flows by site and aep, and whether all are within the tolerance."""
    rows = a.select("site", "aep", F.col("flow").alias("a")).join(b.select("site", "aep", F.col("flow").alias("b")), ["site", "aep"])
    return rows.withColumn("pct", 100 * (F.col("b") - F.col("a")) / F.col("a")).withColumn("within", F.abs("pct") <= tolerance_pct)


def bootstrap_limits(values: DataFrame, non_exceedance: tuple[float, ...] = (0.1, 0.5), n_resamples: int = 2000, seed: int = 0, confidence: float = 0.9) -> DataFrame:
    """Parametric bootstrap limits of low-flow quantiles, with the share of zeros drawn too: values: site, min_flow.

    Logs are drawn from the fitted Pearson III distribution; each resample gets a skew (within 3) of its own.
    """

    def skewness(y: np.ndarray) -> float:
        n, sd = len(y), y.std(ddof=1)
        return float(np.clip(n * ((y - y.mean()) ** 3).sum() / ((n - 1) * (n - 2) * sd**3), -3, 3)) if sd > 1e-12 else 0.0

    def run(part: pd.DataFrame) -> pd.DataFrame:
        x = part["min_flow"].dropna().to_numpy(float)
        site, n, out = part["site"].iloc[0], len(x), []
        logs = np.log10(x[x > 0])
        if len(logs) < 3:
            return pd.DataFrame(columns=["site", "non_exceedance", "lower", "upper", "n_used"])
        rng = np.random.default_rng(seed)
        p0, mean, sd, skew = 1 - len(logs) / n, logs.mean(), logs.std(ddof=1), skewness(logs)
        alpha = 4 / skew**2 if abs(skew) >= 1e-4 else None  # a frequency factor is that of a scaled gamma variate
        draws = {p: [] for p in non_exceedance}
        for _ in range(n_resamples):
            m = n - rng.binomial(n, p0)
            if m < 3:
                continue
            y = mean + sd * (rng.standard_normal(m) if alpha is None else skew / 2 * (rng.gamma(alpha, size=m) - alpha))
            own = skewness(y)
            for p in non_exceedance:
                inner = (p - (1 - m / n)) / (m / n)
                draws[p].append(0.0 if inner <= 0 else 10 ** (y.mean() + S.frequency_factor(own, 1 - inner) * y.std(ddof=1)))
        for p, d in draws.items():
            if len(d) >= n_resamples / 2:
                out.append((site, p, *np.quantile(d, [(1 - confidence) / 2, (1 + confidence) / 2]).tolist(), len(d)))
        return pd.DataFrame(out, columns=["site", "non_exceedance", "lower", "upper", "n_used"])

    return by_site(values).applyInPandas(run, "site string, non_exceedance double, lower double, upper double, n_used long")
