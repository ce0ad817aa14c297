"""Flow-duration curves, timing, performance measures and day-of-year statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from headwater.functions.calendar import day_of_water_year, season, year_label


def duration_curve(daily: DataFrame, keys: tuple[str, ...] = ("site",)) -> DataFrame:
    """Positive flows and their share of exceedance (n - k + 1) / (n + 1); zeros take the lowest ranks only."""
    by = Window.partitionBy(*keys)
    rows = daily.filter("flow IS NOT NULL").withColumn("k", F.row_number().over(by.orderBy("flow"))).withColumn("n", F.count(F.lit(1)).over(by))
    return rows.filter("flow > 0").select(*keys, "flow", ((F.col("n") - F.col("k") + 1) / (F.col("n") + 1)).alias("exceedance"))


def seasonal_curves(daily: DataFrame, groups: dict[str, tuple[int, ...]]) -> DataFrame:
    """A curve for each season."""
    return duration_curve(daily.withColumn("season", season(F.col("date"), groups)), ("site", "season"))


def center_of_timing(daily: DataFrame, min_days: int = 350) -> DataFrame:
    """The first day (of those with data) by which half of a water year's volume has passed."""
    rows = daily.filter("flow IS NOT NULL").withColumn("year", year_label(F.col("date"), "water"))
    by = Window.partitionBy("site", "year")
    run = by.orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.select("site", "year", F.sum("flow").over(run).alias("upto"), F.sum("flow").over(by).alias("total"), F.row_number().over(by.orderBy("date")).alias("k"))
    years = rows.groupBy("site", "year").agg(F.count(F.lit(1)).alias("n_days"), F.max("total").alias("total"), F.min(F.when(F.col("upto") >= 0.5 * F.col("total"), F.col("k"))).alias("k"))
    ok = (F.col("n_days") >= min_days) & (F.col("total") > 0)
    return years.select("site", "year", "n_days", F.when(ok, F.col("k").cast("double")).alias("center_of_timing"), ok.alias("complete"))


def performance(pairs: DataFrame) -> DataFrame:
    """How well estimates follow observations: pairs of site, observed, estimated, both not null."""
    rows = pairs.filter("observed IS NOT NULL AND estimated IS NOT NULL")
    by = Window.partitionBy("site")
    rows = rows.withColumn("cut", F.percentile("observed", F.lit(0.1)).over(by)).withColumn("mean", F.avg("observed").over(by))
    both = (F.col("observed") > 0) & (F.col("estimated") > 0)
    lo, le = F.when(both, F.log10("observed")), F.when(both, F.log10("estimated"))
    rows = rows.withColumn("lo", lo).withColumn("le", le).withColumn("lmean", F.avg("lo").over(by))
    o, e, dry = F.col("observed"), F.col("estimated"), F.col("observed") <= F.col("cut")
    so, se, mo, me = F.stddev_pop(o), F.stddev_pop(e), F.avg(o), F.avg(e)
    ratio = lambda a, b: F.when(b != 0, a / b)
    kge = 1 - F.sqrt(F.pow(F.corr(o, e) - 1, F.lit(2)) + F.pow(se / so - 1, F.lit(2)) + F.pow(me / mo - 1, F.lit(2)))
    return rows.groupBy("site").agg(
        (1 - ratio(F.sum(F.pow(o - e, F.lit(2))), F.sum(F.pow(o - F.col("mean"), F.lit(2))))).alias("nse"),
        (1 - ratio(F.sum(F.pow(F.col("lo") - F.col("le"), F.lit(2))), F.sum(F.pow(F.col("lo") - F.col("lmean"), F.lit(2))))).alias("log_nse"),
        F.when((so != 0) & (mo != 0), kge).alias("kge"),
        (100 * ratio(F.sum(e) - F.sum(o), F.sum(o))).alias("pbias"),
        (100 * ratio(F.sum(F.when(dry, e - o)), F.sum(F.when(dry, o)))).alias("pbias_dry"),
        F.count(F.lit(1)).alias("n"),
    )


def summary_by_day(daily: DataFrame, percentiles: tuple[int, ...] = (10, 25, 50, 75, 90)) -> DataFrame:
    """Mean, extremes and percentiles for each day of the water year; negatives are not masked here."""
    rows = daily.withColumn("dowy", day_of_water_year(F.col("date")))
    return rows.groupBy("site", "dowy").agg(F.avg("flow").alias("mean"), F.min("flow").alias("min"), F.max("flow").alias("max"), *(F.percentile("flow", F.lit(p / 100)).alias(f"p{p}") for p in percentiles))


def weibull_quantile(values: Column, p: float) -> Column:
    """Of a sorted array: the value at place (n + 1) p, linear between places, held at the ends."""
    n = F.size(values)
    h = (n + 1) * p
    k = F.greatest(F.lit(1), F.least(n - 1, F.floor(h).cast("int")))
    inside = F.get(values, k - 1) + (h - k) * (F.get(values, k) - F.get(values, k - 1))
    return F.when(h <= 1, F.get(values, F.lit(0))).when(h >= n, F.get(values, n - 1)).otherwise(inside)


def yearly_quantiles(daily: DataFrame, exceedances: tuple[int, ...] = (10, 50, 90), min_days: int = 365) -> DataFrame:
    """Flow exceeded so many percent of each water year with enough days; a year's days are one short array."""
    years = daily.filter("flow IS NOT NULL").groupBy("site", year_label(F.col("date"), "water").alias("year")).agg(F.array_sort(F.collect_list("flow")).alias("x")).filter(F.size("x") >= min_days)
    rows = F.array(*(F.struct(F.lit(e).alias("exceedance"), weibull_quantile(F.col("x"), 1 - e / 100).alias("flow")) for e in exceedances))
    return years.select("site", "year", F.explode(rows).alias("r")).select("site", "year", "r.exceedance", "r.flow")


def duration_statistics(daily: DataFrame, exceedances: tuple[int, ...] = (10, 50, 90), min_days: int = 365, min_years: int = 3) -> DataFrame:
    """Median over years of the yearly quantiles, with the deviation of their logarithms."""
    q = yearly_quantiles(daily, exceedances, min_days).filter("flow > 0")
    return q.groupBy("site", "exceedance").agg(F.median("flow").alias("median"), F.stddev_samp(F.log10("flow")).alias("log_sd"), F.count(F.lit(1)).alias("n_years")).filter(F.col("n_years") >= min_years)
