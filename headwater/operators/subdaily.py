"""Sub-daily metrics by site and local day from readings at UTC instants: site, ts, value.

Negative readings are missing. Daily values are reported whether or not a day is complete.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from headwater.functions.calendar import local_day_hours, local_time

_US = lambda c: F.unix_micros(c)


def valid(iv: DataFrame, zone: str) -> DataFrame:
    """Readings with their local time and day; negatives are null."""
    rows = iv.select("site", "ts", F.when(F.col("value") >= 0, F.col("value")).alias("value"))
    return rows.withColumn("local", local_time(F.col("ts"), zone)).withColumn("date", F.to_date("local"))


def median_step(iv: DataFrame) -> DataFrame:
    """Median minutes between a site's instants."""
    step = (_US(F.col("ts")) - _US(F.lag("ts").over(Window.partitionBy("site").orderBy("ts")))) / 60e6
    return iv.withColumn("step", step).groupBy("site").agg(F.median("step").alias("step_minutes"))


def _expected(days: DataFrame, iv: DataFrame, zone: str) -> DataFrame:
    """Adds n_expected: the local day's hours over the site's median step."""
    return days.join(median_step(iv), "site").withColumn("n_expected", local_day_hours(F.col("date"), zone) * 60 / F.col("step_minutes")).drop("step_minutes")


def diel_variation(iv: DataFrame, zone: str, share: float = 0.9) -> DataFrame:
    """Extremes, mean, deviation, range and variation of each local day."""
    days = valid(iv, zone).groupBy("site", "date").agg(
        F.min("value").alias("min"), F.max("value").alias("max"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"), F.count("value").alias("n")
    )
    days = days.withColumn("range", F.col("max") - F.col("min")).withColumn("cv", F.when(F.col("mean") > 0, F.col("std") / F.col("mean")))
    return _expected(days, iv, zone).withColumn("complete", F.col("n") >= share * F.col("n_expected"))


def diel_summary(days: DataFrame) -> DataFrame:
    """Means over complete days."""
    return days.filter("complete").groupBy("site").agg(*(F.avg(c).alias(f"mean_{c}") for c in ("min", "max", "mean", "range", "cv")), F.count(F.lit(1)).alias("n_days"))


def circular_hours(rows: DataFrame, hour: str, keys: tuple[str, ...] = ("site",)) -> DataFrame:
    """Circular mean hour, concentration, circular deviation and the Rayleigh test's p of hours of the day."""
    angle = F.col(hour) * (2 * 3.141592653589793 / 24)
    s = rows.filter(F.col(hour).isNotNull()).groupBy(*keys).agg(F.avg(F.cos(angle)).alias("c"), F.avg(F.sin(angle)).alias("s"), F.count(F.lit(1)).alias("n"))
    r = F.least(F.lit(1.0), F.sqrt(F.col("c") * F.col("c") + F.col("s") * F.col("s")))
    s = s.withColumn("concentration", r)
    hours = F.pmod(F.atan2("s", "c"), F.lit(2 * 3.141592653589793)) * (24 / (2 * 3.141592653589793))
    z = F.col("n") * F.col("concentration") * F.col("concentration")
    n = F.col("n").cast("double")
    p = F.exp(F.sqrt(1 + 4 * n + 4 * (n * n - z * n)) - (1 + 2 * n))
    opposed = F.col("concentration") < 1e-12
    return s.select(
        *keys, F.when(~opposed, hours).alias("mean_hour"), "concentration",
        F.when(~opposed, F.sqrt(-2 * F.log(F.col("concentration"))) * (24 / (2 * 3.141592653589793))).otherwise(F.lit(float("inf"))).alias("std_hours"), F.least(F.lit(1.0), p).alias("rayleigh_p"), "n",
    )


def extreme_timing(iv: DataFrame, zone: str, share: float = 0.9) -> DataFrame:
    """Local hour of each day's first greatest and first least reading, and how often they recur; null on a flat day."""
    rows = valid(iv, zone).filter("value IS NOT NULL")
    by = Window.partitionBy("site", "date")
    hour = (_US(F.col("local")) - _US(F.col("date").cast("timestamp"))) / 3600e6
    rows = rows.withColumn("hi", F.max("value").over(by)).withColumn("lo", F.min("value").over(by)).withColumn("hour", hour)
    flat = F.max("hi") == F.max("lo")
    days = rows.groupBy("site", "date").agg(
        F.when(~flat, F.min_by("hour", F.struct(-F.col("value"), F.col("ts")))).alias("hour_max"),
        F.when(~flat, F.min_by("hour", F.struct("value", "ts"))).alias("hour_min"),
        F.count(F.when(F.col("value") == F.col("hi"), 1)).alias("n_max"),
        F.count(F.when(F.col("value") == F.col("lo"), 1)).alias("n_min"),
        F.count(F.lit(1)).alias("n"),
    )
    return _expected(days, iv, zone).withColumn("complete", F.col("n") >= share * F.col("n_expected"))


def intervals(iv: DataFrame, zone: str, max_gap_hours: float | None = None, label: str = "end") -> DataFrame:
    """Rates between valid readings that follow each other; gapped ones (over 3 median steps by default) have none."""
    rows = valid(iv, zone).filter("value IS NOT NULL")
    by = Window.partitionBy("site").orderBy("ts")
    hours = (_US(F.col("ts")) - _US(F.lag("ts").over(by))) / 3600e6
    day = F.col("date") if label == "end" else F.lag("date").over(by)
    rows = rows.select("site", "ts", day.alias("date"), hours.alias("dt_hours"), (F.col("value") - F.lag("value").over(by)).alias("delta"), F.lag("value").over(by).alias("before")).filter("dt_hours IS NOT NULL")
    if max_gap_hours is None:
        rows = rows.join(median_step(iv), "site").withColumn("limit", F.col("step_minutes") * 3 / 60).drop("step_minutes")
    else:
        rows = rows.withColumn("limit", F.lit(float(max_gap_hours)))
    rows = rows.withColumn("gapped", F.col("dt_hours") > F.col("limit")).drop("limit")
    return rows.withColumn("rate", F.when(~F.col("gapped") & (F.col("dt_hours") > 0), F.col("delta") / F.col("dt_hours")))


def ramping_rates(iv: DataFrame, zone: str, max_gap_hours: float | None = None, label: str = "end", relative: bool = True) -> DataFrame:
    """Greatest rise and fall per hour, mean rate, reversals and numbers of intervals for each local day."""
    rows = intervals(iv, zone, max_gap_hours, label)
    signed = Window.partitionBy("site", "date", F.col("rate").isNotNull() & (F.col("rate") != 0)).orderBy("ts")
    turn = (F.col("rate") != 0) & (F.signum("rate") != F.lag(F.signum("rate")).over(signed))
    rows = rows.withColumn("turn", F.coalesce(turn, F.lit(False))).withColumn("pct", F.when(F.col("before") > 0, 100 * F.col("rate") / F.col("before")))
    cols = [F.max(F.greatest("rate", F.when(F.col("rate").isNotNull(), 0.0))).alias("max_up"), F.min(F.least("rate", F.when(F.col("rate").isNotNull(), 0.0))).alias("max_down"), F.avg(F.abs("rate")).alias("mean_abs")]
    if relative:
        ok = F.when(F.col("pct").isNotNull(), 0.0)
        cols += [F.max(F.greatest("pct", ok)).alias("max_up_pct"), F.min(F.least("pct", ok)).alias("max_down_pct"), F.avg(F.abs("pct")).alias("mean_abs_pct")]
    cols += [F.count(F.when(F.col("turn"), 1)).alias("n_reversals"), F.count("rate").alias("n_intervals"), F.count(F.when(F.col("gapped"), 1)).alias("n_gapped")]
    return rows.groupBy("site", "date").agg(*cols)


def window_changes(iv: DataFrame, zone: str, hours: int) -> DataFrame:
    """Greatest rise and fall over exactly so many hours before each reading; no partner, no window."""
    rows = valid(iv, zone).filter("value IS NOT NULL")
    past = rows.select("site", (F.col("ts") + F.expr(f"INTERVAL {hours} HOURS")).alias("ts"), F.col("value").alias("before"))
    change = rows.join(past, ["site", "ts"]).withColumn("change", F.col("value") - F.col("before"))
    return change.groupBy("site", "date").agg(F.max(F.greatest("change", F.lit(0.0))).alias("max_rise"), F.min(F.least("change", F.lit(0.0))).alias("max_fall"), F.count(F.lit(1)).alias("n_windows"))


def ramping_summary(days: DataFrame, up_limit: float, down_limit: float) -> DataFrame:
    """Means, extremes, mean reversals and how many days pass the limits."""
    up, down = F.col("max_up") > up_limit, F.col("max_down") < -abs(down_limit)
    return days.groupBy("site").agg(
        F.avg("max_up").alias("mean_max_up"), F.max("max_up").alias("max_up"), F.avg("max_down").alias("mean_max_down"), F.min("max_down").alias("max_down"), F.avg("n_reversals").alias("mean_reversals"),
        F.count(F.when(up, 1)).alias("n_over"), F.avg(up.cast("double")).alias("share_over"), F.count(F.when(down, 1)).alias("n_under"), F.avg(down.cast("double")).alias("share_under"),
    )
