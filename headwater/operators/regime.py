"""Flow regime by site: flashiness, baseflow, monthly and seasonal summaries, flow-duration percentiles.

daily: site, date, flow. Negative flows are missing. Work is partitioned by site, and by site and year where no
value crosses a year.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from headwater.functions.calendar import complete_calendar, numbered, year_label

SEASONS = {"DJF": (12, 1, 2), "MAM": (3, 4, 5), "JJA": (6, 7, 8), "SON": (9, 10, 11)}


def with_year(daily: DataFrame, kind: str = "water") -> DataFrame:
    """The complete calendar with its year label."""
    return complete_calendar(daily).withColumn("year", year_label(F.col("date"), kind))


def completeness(daily: DataFrame, kind: str = "water", min_days: int = 350) -> DataFrame:
    """site, year, n_days (valid days) and complete."""
    return with_year(daily, kind).groupBy("site", "year").agg(F.count("flow").alias("n_days")).withColumn("complete", F.col("n_days") >= min_days)


def _if_complete(value: Column, min_days: int) -> Column:
    return F.when(F.count("flow") >= min_days, value)


def flashiness(daily: DataFrame, kind: str = "water", min_days: int = 350) -> DataFrame:
    """Sum of day-to-day changes over sum of flow for each year; changes don't cross the year's start."""
    before = F.lag("flow").over(Window.partitionBy("site", "year").orderBy("date"))
    rows = with_year(daily, kind).withColumn("change", F.abs(F.col("flow") - before))
    total = F.sum("flow")
    return rows.groupBy("site", "year").agg(
        _if_complete(F.when(total > 0, F.coalesce(F.sum("change"), F.lit(0.0)) / total), min_days).alias("flashiness"),
        F.count("flow").alias("n_days"),
        (F.count("flow") >= min_days).alias("complete"),
    )


def tqmean(daily: DataFrame, kind: str = "water", min_days: int = 350) -> DataFrame:
    """Share of a year's days above its mean."""
    rows = with_year(daily, kind).withColumn("mean", F.avg("flow").over(Window.partitionBy("site", "year")))
    above = F.avg(F.when(F.col("flow").isNotNull(), (F.col("flow") > F.col("mean")).cast("double")))
    return rows.groupBy("site", "year").agg(_if_complete(above, min_days).alias("tqmean"), F.count("flow").alias("n_days"), (F.count("flow") >= min_days).alias("complete"))


def monthly_summary(daily: DataFrame, kind: str = "water", share: float = 0.9) -> DataFrame:
    """Mean, least, greatest and median flow by year and month, with the month's true length."""
    rows = with_year(daily, kind).withColumn("month", F.month("date")).withColumn("length", F.dayofmonth(F.last_day("date")))
    return rows.groupBy("site", "year", "month").agg(
        F.avg("flow").alias("mean"), F.min("flow").alias("min"), F.max("flow").alias("max"), F.median("flow").alias("median"),
        F.count("flow").alias("n_days"), F.max("length").alias("days_in_month"), (F.count("flow") >= share * F.max("length")).alias("complete"),
    )


def seasonal_summary(daily: DataFrame, share: float = 0.9) -> DataFrame:
    """The same by season; December belongs to the next year's winter."""
    month = F.month("date")
    label = F.when(month.isin(12, 1, 2), "DJF").when(month <= 5, "MAM").when(month <= 8, "JJA").otherwise("SON")
    rows = complete_calendar(daily).withColumn("season", label).withColumn("year", (F.year("date") + F.when(month == 12, 1).otherwise(0)).cast("int"))
    starts = {"DJF": (-1, 12, 0, 3), "MAM": (0, 3, 0, 6), "JJA": (0, 6, 0, 9), "SON": (0, 9, 0, 12)}
    length = F.lit(None).cast("int")
    for s, (y0, m0, y1, m1) in starts.items():
        length = F.when(F.col("season") == s, F.date_diff(F.make_date(F.col("year") + y1, F.lit(m1), F.lit(1)), F.make_date(F.col("year") + y0, F.lit(m0), F.lit(1)))).otherwise(length)
    return rows.groupBy("site", "year", "season").agg(
        F.avg("flow").alias("mean"), F.min("flow").alias("min"), F.max("flow").alias("max"), F.median("flow").alias("median"), F.count("flow").alias("n_days")
    ).withColumn("days_in_season", length).withColumn("complete", F.col("n_days") >= share * F.col("days_in_season"))


def duration_percentiles(daily: DataFrame, exceedance: tuple[float, ...] = (1, 5, 10, 20, 50, 80, 90, 95, 99)) -> DataFrame:
    """Flow exceeded so many percent of the time, by linear interpolation."""
    valid = daily.filter("flow >= 0")
    ps = F.array(*(F.lit(1 - e / 100) for e in exceedance))
    values = valid.groupBy("site").agg(F.percentile("flow", ps).alias("q"))
    pairs = F.arrays_zip(F.array(*(F.lit(float(e)) for e in exceedance)).alias("exceedance_pct"), F.col("q").alias("flow"))
    return values.select("site", F.explode(pairs).alias("x")).select("site", F.col("x.exceedance_pct").alias("exceedance_pct"), F.col("x.flow").alias("flow"))


# ---- baseflow separation -------------------------------------------------------------------------------------


def _between_turning_points(days: DataFrame) -> DataFrame:
    """Baseflow from turning (value at turning points, else null): straight lines between them, never above the flow."""
    by = Window.partitionBy("site").orderBy("day")
    back = by.rowsBetween(Window.unboundedPreceding, 0)
    # the next value is the last one from behind: frames that begin at the current row cost a pass for each row
    on = Window.partitionBy("site").orderBy(F.desc("day")).rowsBetween(Window.unboundedPreceding, 0)
    at = F.when(F.col("turning").isNotNull(), F.col("day"))
    ends = days.select(
        "*", F.last("turning", True).over(back).alias("v0"), F.last(at, True).over(back).alias("d0"), F.last("turning", True).over(on).alias("v1"), F.last(at, True).over(on).alias("d1"),
        F.count("turning").over(Window.partitionBy("site")).alias("n_turning"),
    )
    line = F.when(F.col("d0") == F.col("d1"), F.col("v0")).otherwise(F.col("v0") + (F.col("v1") - F.col("v0")) * (F.col("day") - F.col("d0")) / (F.col("d1") - F.col("d0")))
    ok = (F.col("n_turning") >= 2) & F.col("v0").isNotNull() & F.col("v1").isNotNull() & F.col("flow").isNotNull()
    return ends.select("site", "date", "flow", F.when(ok, F.least(line, F.col("flow"))).alias("baseflow"))


def smoothed_minima(daily: DataFrame, block_days: int = 5, factor: float = 0.9) -> DataFrame:
    """Minima of blocks of days; those that are low against both neighbours are turning points."""
    days = numbered(complete_calendar(daily)).withColumn("block", F.floor(F.col("day") / block_days))
    blocks = days.groupBy("site", "block").agg(F.count("flow").alias("n"), F.min("flow").alias("low"), F.min_by("day", F.struct("flow", "day")).alias("at"))
    blocks = blocks.withColumn("low", F.when(F.col("n") == block_days, F.col("low")))
    by = Window.partitionBy("site").orderBy("block")
    sides = F.lag("low").over(by).isNotNull() & F.lead("low").over(by).isNotNull()
    turns = blocks.select("site", F.col("at").alias("day"), "low", F.least(F.lag("low").over(by), F.lead("low").over(by)).alias("limit"), sides.alias("sides"))
    turns = turns.filter(F.col("sides") & (factor * F.col("low") <= F.col("limit"))).select("site", "day", F.col("low").alias("turning"))
    return _between_turning_points(days.join(turns, ["site", "day"], "left"))


def interval_days(area_sqmi: float) -> int:
    """The odd number of days nearest to 2 A^0.2; ties go to the even neighbour before it is made odd."""
    if area_sqmi <= 0:
        raise ValueError("drainage area must be positive")
    return max(1, 2 * round((2 * area_sqmi**0.2 - 1) / 2) + 1)


def fixed_interval(daily: DataFrame, area_sqmi: float) -> DataFrame:
    """The least flow of each block of 2N days, also of a last shorter one; none where a day is missing."""
    width = 2 * interval_days(area_sqmi)
    days = numbered(complete_calendar(daily)).withColumn("block", F.floor(F.col("day") / width))
    by = Window.partitionBy("site", "block")
    whole = F.count("flow").over(by) == F.count(F.lit(1)).over(by)
    return days.select("site", "date", "flow", F.when(whole, F.min("flow").over(by)).alias("baseflow"))


def _centred_minimum(days: DataFrame, area_sqmi: float) -> DataFrame:
    n = interval_days(area_sqmi)
    by = Window.partitionBy("site").orderBy("day").rowsBetween(-n, n)
    return days.withColumn("low", F.when(F.count("flow").over(by) == 2 * n + 1, F.min("flow").over(by)))


def sliding_interval(daily: DataFrame, area_sqmi: float) -> DataFrame:
    """The least flow of the 2N + 1 days around each day."""
    days = _centred_minimum(numbered(complete_calendar(daily)), area_sqmi)
    return days.select("site", "date", "flow", F.col("low").alias("baseflow"))


def local_minimum(daily: DataFrame, area_sqmi: float) -> DataFrame:
    """Days that are the least of the 2N + 1 around them are turning points."""
    days = _centred_minimum(numbered(complete_calendar(daily)), area_sqmi)
    return _between_turning_points(days.withColumn("turning", F.when(F.col("flow") == F.col("low"), F.col("flow"))))


def recursive_filter(daily: DataFrame, alpha: float = 0.925, passes: int = 3) -> DataFrame:
    """Recursive digital filter over each run of days without a gap, forward and backward in turn.

    The recursion is sequential, so a run (part of one site's record) is one group. A pass keeps the unclamped
    quickflow as its state and clamps what it gives out to between 0 and its input.
    """
    days = numbered(complete_calendar(daily)).filter("flow IS NOT NULL")
    run = F.col("day") - F.row_number().over(Window.partitionBy("site").orderBy("day"))

    def filtered(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("date")
        values = part["flow"].tolist()
        for k in range(passes):
            series = values[::-1] if k % 2 else values
            quick, out = 0.0, series[:1]
            for last, now in zip(series, series[1:]):
                quick = alpha * quick + (1 + alpha) / 2 * (now - last)
                out.append(max(min(now - quick, now), 0.0))
            values = out[::-1] if k % 2 else out
        return part.assign(baseflow=values)[["site", "date", "flow", "baseflow"]]

    return days.withColumn("run", run).groupBy("site", "run").applyInPandas(filtered, "site string, date date, flow double, baseflow double")


def separate_baseflow(daily: DataFrame, method: str = "smoothed_minima", area_sqmi: float | None = None, **options) -> DataFrame:
    """site, date, flow, baseflow by one of five methods; the interval methods need a drainage area."""
    interval = {"fixed_interval": fixed_interval, "sliding_interval": sliding_interval, "local_minimum": local_minimum}
    if method in interval:
        if area_sqmi is None:
            raise ValueError(f"{method} needs a drainage area")
        return interval[method](daily, area_sqmi)
    plain = {"smoothed_minima": smoothed_minima, "recursive_filter": recursive_filter}
    if method not in plain:
        raise ValueError(f"unknown method: {method}")
    return plain[method](daily, **options)


def baseflow_index(daily: DataFrame, kind: str = "water", min_days: int = 350, method: str = "smoothed_minima", **options) -> DataFrame:
    """Baseflow over flow for each year, over the days that have both."""
    rows = separate_baseflow(daily, method, **options).withColumn("year", year_label(F.col("date"), kind))
    both = F.col("baseflow").isNotNull() & F.col("flow").isNotNull()
    flow, base = F.sum(F.when(both, F.col("flow"))), F.sum(F.when(both, F.col("baseflow")))
    n = F.count(F.when(both, F.lit(1)))
    return rows.groupBy("site", "year").agg(F.when((n >= min_days) & (flow > 0), base / flow).alias("bfi"), n.alias("n_days"), (n >= min_days).alias("complete"))


def regime_summary(daily: DataFrame, kind: str = "water", min_days: int = 350) -> DataFrame:
    """Over complete years: pooled flashiness and baseflow index (sums over sums) and the mean TQmean."""
    before = F.lag("flow").over(Window.partitionBy("site", "year").orderBy("date"))
    rows = with_year(daily, kind).withColumn("change", F.abs(F.col("flow") - before))
    mean = F.avg("flow").over(Window.partitionBy("site", "year"))
    rows = rows.withColumn("above", F.when(F.col("flow").isNotNull(), (F.col("flow") > mean).cast("double")))
    years = rows.groupBy("site", "year").agg(F.count("flow").alias("n"), F.sum("change").alias("change"), F.sum("flow").alias("total"), F.avg("above").alias("tq")).filter(F.col("n") >= min_days)
    pooled = years.groupBy("site").agg((F.sum("change") / F.sum("total")).alias("flashiness"), F.avg("tq").alias("tqmean"), F.count(F.lit(1)).alias("n_years"))
    base = separate_baseflow(daily).withColumn("year", year_label(F.col("date"), kind)).filter("baseflow IS NOT NULL AND flow IS NOT NULL")
    byear = base.groupBy("site", "year").agg(F.count(F.lit(1)).alias("n"), F.sum("flow").alias("f"), F.sum("baseflow").alias("b")).filter(F.col("n") >= min_days)
    bfi = byear.groupBy("site").agg((F.sum("b") / F.sum("f")).alias("bfi"), F.count(F.lit(1)).alias("n_years_bfi"))
    return pooled.join(bfi, "site", "left")
