"""Low flow by site: n-day minima of each year and the zero-adjusted moments of their logarithms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from headwater.operators.regime import completeness, with_year


def annual_minimum(daily: DataFrame, n_day: int = 7, kind: str = "climatic", min_days: int = 350) -> DataFrame:
    """Least mean of n days on end in each year, and the first such last day; years with data all appear."""
    rows = with_year(daily, kind)
    window = Window.partitionBy("site").orderBy("date").rowsBetween(-(n_day - 1), 0)
    rows = rows.withColumn("mean", F.when(F.count("flow").over(window) == n_day, F.avg("flow").over(window)))
    low = rows.filter("mean IS NOT NULL").groupBy("site", "year").agg(F.min("mean").alias("min_flow"), F.min_by("date", F.struct("mean", "date")).alias("date"))
    return completeness(daily, kind, min_days).join(low, ["site", "year"], "left")


def adjusted_skew(x: Column) -> Column:
    """Sample skewness from Spark's population one."""
    n = F.count(x)
    return F.when(n > 2, F.skewness(x) * F.sqrt(n * (n - 1)) / (n - 2))


def log_moments(values: DataFrame, column: str = "min_flow") -> DataFrame:
    """n, share of zeros, and mean, deviation and skew (within 3; 0 without variance) of log10 of positive values."""
    v = F.col(column)
    lg = F.when(v > 0, F.log10(v))
    stats = values.filter(v.isNotNull()).groupBy("site").agg(
        F.count(v).alias("n"), F.count(F.when(v == 0, 1)).alias("n_zero"), F.avg(lg).alias("mean_log"), F.stddev_samp(lg).alias("std_log"), adjusted_skew(lg).alias("skew")
    )
    skew = F.when(F.col("std_log") > 1e-12, F.greatest(F.lit(-3.0), F.least(F.lit(3.0), F.coalesce("skew", F.lit(0.0))))).otherwise(0.0)
    return stats.withColumn("skew_log", skew).withColumn("p_zero", F.col("n_zero") / F.col("n")).drop("skew")


def conditional_quantiles(moments: DataFrame, non_exceedance: dict[float, None] | tuple[float, ...] = (0.01, 0.02, 0.05, 0.1, 0.2, 0.5)) -> DataFrame:
    """Flow at non-exceedance p: 0 at or below the share of zeros, else the fit at (p - p0) / (1 - p0)."""
    from headwater.functions.special import k_factor

    p = F.explode(F.array(*(F.lit(float(x)) for x in non_exceedance))).alias("p")
    rows = moments.select("site", "mean_log", "std_log", "skew_log", "p_zero", p)
    inner = (F.col("p") - F.col("p_zero")) / (1 - F.col("p_zero"))
    k = k_factor("skew_log", 1 - F.when(inner > 0, inner))
    return rows.select("site", F.col("p").alias("non_exceedance"), F.when(inner <= 0, 0.0).otherwise(F.pow(F.lit(10.0), F.col("mean_log") + k * F.col("std_log"))).alias("flow"))
