"""Trend and change-point statistics of short (annual or monthly) series: site, year, flow.

Pairs are formed within a site's series of periods, some hundred rows at most, never of daily rows.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from headwater.functions import special as S


def placed(rows: DataFrame, bucket: Column, order: list[str]) -> DataFrame:
    """rows with k, their place among all by order (which must ascend with bucket), and m, their number.

    Places are counted within a bucket and added to what lies before it; only the buckets' sizes, of which there must be
    few, meet in one task.
    """
    keyed = rows.withColumn("__bucket", bucket)
    sizes = keyed.groupBy("__bucket").agg(F.count(F.lit(1)).alias("__n"))
    upto = F.sum("__n").over(Window.orderBy("__bucket").rowsBetween(Window.unboundedPreceding, 0))
    sizes = sizes.select("__bucket", (upto - F.col("__n")).alias("__before"), F.sum("__n").over(Window.partitionBy()).alias("m"))
    place = F.row_number().over(Window.partitionBy("__bucket").orderBy(*order))
    return keyed.join(sizes, "__bucket").withColumn("k", F.col("__before") + place).drop("__bucket", "__before")


def _order(series: DataFrame) -> DataFrame:
    by = Window.partitionBy("site")
    return series.filter("flow IS NOT NULL").select("site", "year", "flow", F.row_number().over(by.orderBy("year")).alias("i"), F.count(F.lit(1)).over(by).alias("n"))


def _pairs(series: DataFrame) -> DataFrame:
    s = _order(series)
    return s.alias("a").join(s.alias("b"), (F.col("a.site") == F.col("b.site")) & (F.col("a.i") < F.col("b.i"))).select(
        "a.site", F.col("a.i").alias("i"), F.col("b.i").alias("j"), F.col("a.n").alias("n"), F.col("a.flow").alias("x"), F.col("b.flow").alias("y"), F.col("a.year").alias("t"), F.col("b.year").alias("u")
    )


def mann_kendall(series: DataFrame) -> DataFrame:
    """S, its tie-corrected variance, the continuity-corrected Z and tau."""
    s = _pairs(series).groupBy("site").agg(F.sum(F.signum(F.col("y") - F.col("x"))).alias("s"), F.max("n").alias("n"))
    ties = series.filter("flow IS NOT NULL").groupBy("site", "flow").count().groupBy("site").agg(F.sum(F.col("count") * (F.col("count") - 1) * (2 * F.col("count") + 5)).alias("ties"))
    n = F.col("n").cast("double")
    rows = s.join(ties, "site").withColumn("var_s", (n * (n - 1) * (2 * n + 5) - F.col("ties")) / 18)
    z = F.when(F.col("s") > 0, (F.col("s") - 1) / F.sqrt("var_s")).when(F.col("s") < 0, (F.col("s") + 1) / F.sqrt("var_s")).otherwise(0.0)
    return rows.select("site", "n", "s", "var_s", z.alias("z"), (F.col("s") / (n * (n - 1) / 2)).alias("tau"))


def sens_slope(series: DataFrame) -> DataFrame:
    """Median of pairwise slopes by year, and the median intercept."""
    slope = _pairs(series).filter("u <> t").groupBy("site").agg(F.median((F.col("y") - F.col("x")) / (F.col("u") - F.col("t"))).alias("slope"))
    return series.filter("flow IS NOT NULL").join(slope, "site").groupBy("site").agg(F.first("slope").alias("slope"), F.median(F.col("flow") - F.col("slope") * F.col("year")).alias("intercept"))


def pettitt(series: DataFrame) -> DataFrame:
    """Greatest |U| over splits, the first split that has it, and the approximate p."""
    p = _pairs(series).withColumn("sign", F.signum(F.col("x") - F.col("y")))
    # U_t gains the signs of pairs (i, j) for i <= t < j: running sum of what begins at i less what ends at j
    begins = p.groupBy("site", F.col("i").alias("k")).agg(F.sum("sign").alias("d"))
    ends = p.groupBy("site", F.col("j").alias("k")).agg((-F.sum("sign")).alias("d"))
    steps = begins.unionByName(ends).groupBy("site", "k").agg(F.sum("d").alias("d"))
    u = steps.withColumn("u", F.sum("d").over(Window.partitionBy("site").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)))
    s = _order(series)
    u = u.join(s.select("site", F.col("i").alias("k"), "n"), ["site", "k"]).filter("k < n")
    best = u.groupBy("site").agg(F.max(F.abs("u")).alias("k_stat"), F.min_by("k", F.struct(-F.abs("u"), F.col("k"))).alias("at"), F.max("n").alias("n"), F.min_by("u", F.struct(-F.abs("u"), F.col("k"))).alias("u"))
    year = s.select("site", (F.col("i") - 1).alias("at"), F.col("year"))
    n = F.col("n").cast("double")
    prob = F.least(F.lit(1.0), 2 * F.exp(-6 * F.col("k_stat") ** 2 / (n**3 + n**2)))
    return best.join(year, ["site", "at"]).select("site", F.col("at").alias("index"), "year", F.col("k_stat").alias("k"), prob.alias("p_value"), F.when(F.col("u") < 0, "up").otherwise("down").alias("shift"))


def cusum(series: DataFrame) -> DataFrame:
    """Greatest |cumulative deviation from the mean| and where it first is."""
    by = Window.partitionBy("site")
    s = _order(series).withColumn("d", F.sum(F.col("flow")).over(by.orderBy("i").rowsBetween(Window.unboundedPreceding, 0)) - F.col("i") * F.avg("flow").over(by)).filter("i < n")
    s = s.withColumn("a", F.round(F.abs("d"), 9))
    return s.groupBy("site").agg(F.max(F.abs("d")).alias("max_abs"), F.min_by("i", F.struct(-F.col("a"), F.col("i"))).alias("index"))


def ranks(series: DataFrame) -> DataFrame:
    """Average ranks of a site's values."""
    by, ties = Window.partitionBy("site"), Window.partitionBy("site", "flow")
    return _order(series).withColumn("rank", F.rank().over(by.orderBy("flow")) + (F.count(F.lit(1)).over(ties) - 1) / 2)


def lombard(series: DataFrame, score: str = "wilcoxon") -> DataFrame:
    """Lombard's abrupt and smooth statistics of standardised rank scores."""
    by = Window.partitionBy("site")
    r = F.col("rank") / (F.col("n") + 1)
    phi = 2 * r - 1 if score == "wilcoxon" else (2 * r - 1) ** 2
    s = ranks(series).withColumn("phi", phi).withColumn("z", (F.col("phi") - F.avg("phi").over(by)) / F.stddev_pop("phi").over(by))
    run = by.orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    s = s.withColumn("l", F.sum("z").over(run))
    s = s.withColumn("t", F.sum("l").over(run))
    n = F.max("n").cast("double")
    return s.groupBy("site").agg((F.sum(F.col("l") ** 2) / n**2).alias("abrupt"), ((n * F.sum(F.col("t") ** 2) - F.sum("t") ** 2) / n**5).alias("smooth"))


def field_significance(p: DataFrame, alpha: float = 0.05) -> DataFrame:
    """False-discovery threshold and Walker's test over p-values (site, p); one row."""
    rows = placed(p.select("p"), F.least(F.floor(F.col("p") * 1024), F.lit(1023)), ["p"])
    f = rows.agg(F.max("m").alias("n_sites"), F.count(F.when(F.col("p") < alpha, 1)).alias("n_local"), F.max(F.when(F.col("p") <= alpha * F.col("k") / F.col("m"), F.col("p"))).alias("fdr_threshold"), F.min("p").alias("least"))
    return f.select("n_sites", "n_local", "fdr_threshold", (1 - F.pow(1 - F.col("least"), F.col("n_sites").cast("double"))).alias("walker_p"))


def pot_events(daily: DataFrame, threshold: float, min_separation: int = 7, min_days: int = 330) -> DataFrame:
    """Independent exceedances: a new event after a gap of min_separation days; its first greatest day is the peak.

    Incomplete water years go first.
    """
    from headwater.functions.calendar import year_label

    rows = daily.filter("flow IS NOT NULL").withColumn("year", year_label(F.col("date"), "water"))
    rows = rows.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("site", "year"))).filter((F.col("n") >= min_days) & (F.col("flow") > threshold))
    by = Window.partitionBy("site").orderBy("date")
    new = F.coalesce((F.date_diff("date", F.lag("date").over(by)) >= min_separation).cast("int"), F.lit(1))
    rows = rows.withColumn("new", new).withColumn("event", F.sum("new").over(by))
    return rows.groupBy("site", "event").agg(F.min_by("date", F.struct(-F.col("flow"), F.col("date"))).alias("peak_date"), F.max("flow").alias("peak"))


def pot_threshold(daily: DataFrame, events_per_year: float = 2.0, min_separation: int = 7, min_days: int = 330, min_years: int = 5) -> DataFrame:
    """The highest threshold at which a site averages so many events in its complete water years, and the share of days
    that don't exceed it. Scanned from the top over quantiles, since counts don't fall evenly, then halved between the last
    miss and the first hit. Null with fewer complete years. One site's days are one group."""
    from headwater.functions.calendar import year_label

    rows = daily.filter("flow IS NOT NULL").withColumn("year", year_label(F.col("date"), "water"))
    rows = rows.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("site", "year"))).filter(F.col("n") >= min_days)

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("date")
        x, day = part["flow"].to_numpy(float), pd.to_datetime(part["date"]).to_numpy().astype("datetime64[D]").astype(int)
        years = part["year"].nunique()
        if years < min_years:
            return pd.DataFrame({"site": [part["site"].iloc[0]], "threshold": [None], "quantile": [None], "n_years": [years]})

        def enough(level: float) -> bool:
            at = day[x > level]
            return len(at) > 0 and 1 + int((np.diff(at) >= min_separation).sum()) >= events_per_year * years

        steps = np.unique(np.quantile(x, np.linspace(0.5, 0.9995, 300)))[::-1]
        hit = next((k for k, level in enumerate(steps) if enough(level)), len(steps) - 1)
        lo = float(steps[hit])
        if hit:
            hi = float(steps[hit - 1])
            for _ in range(40):
                middle = (lo + hi) / 2
                lo, hi = (middle, hi) if enough(middle) else (lo, middle)
        return pd.DataFrame({"site": [part["site"].iloc[0]], "threshold": [lo], "quantile": [float((x <= lo).mean())], "n_years": [years]})

    return rows.groupBy("site").applyInPandas(run, "site string, threshold double, quantile double, n_years long")


def pot_counts(daily: DataFrame, threshold: float, min_separation: int = 7, min_days: int = 330) -> DataFrame:
    """Events in each complete water year, also where there are none."""
    from headwater.functions.calendar import year_label

    years = daily.filter("flow IS NOT NULL").groupBy("site", year_label(F.col("date"), "water").alias("year")).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_days).select("site", "year")
    events = pot_events(daily, threshold, min_separation, min_days).groupBy("site", year_label(F.col("peak_date"), "water").alias("year")).agg(F.count(F.lit(1)).alias("n_events"))
    return years.join(events, ["site", "year"], "left").withColumn("n_events", F.coalesce("n_events", F.lit(0)))


def mixed_population(peaks: DataFrame, cool: tuple[int, ...] = (10, 11, 12, 1, 2, 3), band: tuple[float, float] = (0.2, 0.8)) -> DataFrame:
    """Share of peaks in cool months, their circular mean day and how close they lie to it; mixed inside the band."""
    share = F.avg(F.month("date").isin(*cool).cast("double"))
    angle = 2 * math.pi * F.dayofyear("date") / F.dayofyear(F.make_date(F.year("date"), F.lit(12), F.lit(31)))
    rows = peaks.filter("date IS NOT NULL").groupBy("site").agg(F.count(F.lit(1)).alias("n"), share.alias("cool_share"), F.avg(F.cos(angle)).alias("c"), F.avg(F.sin(angle)).alias("s"))
    turn = F.pmod(F.degrees(F.atan2("s", "c")), F.lit(360.0))
    return rows.select("site", "n", "cool_share", (turn / 360 * 365.25).alias("mean_day"), F.sqrt(F.col("c") ** 2 + F.col("s") ** 2).alias("concentration"), ((F.col("cool_share") > band[0]) & (F.col("cool_share") < band[1])).alias("mixed"))


def attribute_change(changes: DataFrame, events: DataFrame, window: int = 5) -> DataFrame:
    """Events (site, year, cause) within so many years of a site's change (site, change_year)."""
    near = F.abs(F.col("year") - F.col("change_year")) <= window
    return changes.join(events, "site").filter(near).select("site", "change_year", "year", "cause", (F.col("year") - F.col("change_year")).alias("offset"))


RESULT = "site string, test string, statistic double, p_value double, index int"


def screen(series: DataFrame, n_permutations: int = 999, seed: int = 0) -> DataFrame:
    """The tests whose p-values need a kernel, for each site: Mann-Kendall (plain and Hamed-Rao), Spearman, CUSUM, Lombard."""

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.dropna(subset=["flow"]).sort_values("year")
        x, site = part["flow"].to_numpy(float), part["site"].iloc[0] if len(part) else None
        out = [(site, *row) for row in S.trend_tests(x, n_permutations, seed)] if len(x) >= 5 else []
        return pd.DataFrame(out, columns=["site", "test", "statistic", "p_value", "index"])

    return series.groupBy("site").applyInPandas(run, RESULT)


def field_bootstrap(values: DataFrame, n_bootstrap: int = 1000, seed: int = 0, alpha: float = 0.05, block_length: int = 1, min_years: int = 10) -> DataFrame:
    """Share of bootstrap replicates (blocks of whole years drawn across sites) with as many significant sites as observed.

    values: site, year, flow. The years-by-sites matrix of periods is one group; its size is that of the network.
    """

    def run(part: pd.DataFrame) -> pd.DataFrame:
        m = part.pivot_table(index="year", columns="site", values="flow").to_numpy(float)
        count = lambda a: sum(S.mann_kendall_p(c[~np.isnan(c)]) < alpha for c in a.T if (~np.isnan(c)).sum() >= min_years)
        m = m[:, (~np.isnan(m)).sum(axis=0) >= min_years]
        if not 1 <= block_length <= len(m):
            raise ValueError(f"block_length must be in [1, {len(m)}], got {block_length}")
        seen, rng, counts = count(m), np.random.default_rng(seed), []
        for _ in range(n_bootstrap):
            starts = rng.integers(0, len(m) - block_length + 1, -(-len(m) // block_length))
            counts.append(count(m[(starts[:, None] + np.arange(block_length)).ravel()[: len(m)]]))
        more = sum(c >= seen for c in counts)
        return pd.DataFrame({"n_significant": [seen], "p_value": [(1 + more) / (1 + n_bootstrap)], "n_sites": [m.shape[1]], "critical_count": [float(np.quantile(counts, 1 - alpha))]})

    return values.withColumn("network", F.lit(0)).groupBy("network").applyInPandas(run, "n_significant long, p_value double, n_sites long, critical_count double")


def count_trend(counts: DataFrame) -> DataFrame:
    """Poisson trend of yearly counts (site, year, n_events): slope, dispersion and likelihood-ratio p."""

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("year")
        b, dispersion, lr = S.poisson_trend(part["year"].to_numpy(float), part["n_events"].to_numpy(float))
        return pd.DataFrame({"site": [part["site"].iloc[0]], "slope": [b], "dispersion": [dispersion], "p_value": [math.erfc(math.sqrt(max(lr, 0) / 2))]})

    return counts.groupBy("site").applyInPandas(run, "site string, slope double, dispersion double, p_value double")
