"""Calendars of hydrologic records: year labels, seasons, and the complete calendar of a daily series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Days before each month on a leap calendar that begins on 1 October.
WATER_YEAR_OFFSETS = {10: 0, 11: 31, 12: 61, 1: 92, 2: 123, 3: 152, 4: 183, 5: 213, 6: 244, 7: 274, 8: 305, 9: 336}


def year_label(date: Column, kind: str = "water") -> Column:
    """Water year (October to September, named by its end), climatic year (April to March, by its start) or calendar year."""
    if kind == "water":
        return (F.year(date) + F.when(F.month(date) >= 10, 1).otherwise(0)).cast("int")
    if kind == "climatic":
        return (F.year(date) - F.when(F.month(date) < 4, 1).otherwise(0)).cast("int")
    if kind == "calendar":
        return F.year(date).cast("int")
    raise ValueError(f"unknown kind of year: {kind}")


def day_of_water_year(date: Column) -> Column:
    """1 on 1 October to 366 on 30 September, in every year as in a leap year."""
    offsets = F.create_map(*(F.lit(x) for kv in WATER_YEAR_OFFSETS.items() for x in kv))
    return (offsets[F.month(date)] + F.dayofmonth(date)).cast("int")


def season(date: Column, groups: dict[str, tuple[int, ...]]) -> Column:
    """The label whose months hold the date's; the groups must cover each month once."""
    months = sorted(m for g in groups.values() for m in g)
    if months != list(range(1, 13)):
        raise ValueError("seasons must cover each month exactly once")
    labels = F.create_map(*(F.lit(x) for label, g in groups.items() for m in g for x in (m, label)))
    return labels[F.month(date)]


def complete_calendar(daily: DataFrame) -> DataFrame:
    """site, date, flow for every day from a site's first to its last row; missing days and negative flows are null.

    Only the two end dates of a site are aggregated; its days are made next to them and joined by site and date.
    """
    span = daily.groupBy("site").agg(F.min("date").alias("a"), F.max("date").alias("b"))
    days = span.select("site", F.explode(F.sequence("a", "b", F.expr("interval 1 day"))).alias("date"))
    facts = daily.select("site", "date", F.when(F.col("flow") >= 0, F.col("flow")).alias("flow"))
    return days.join(facts, ["site", "date"], "left")


def numbered(days: DataFrame) -> DataFrame:
    """day: the place of each date in its site's calendar, from 0."""
    first = F.min("date").over(Window.partitionBy("site"))
    return days.withColumn("day", F.date_diff("date", first))


def local_time(ts: Column, zone: str) -> Column:
    """UTC instants as wall time of a named zone."""
    return F.from_utc_timestamp(ts, zone)


# Zones of standard-time abbreviations that observe daylight saving time, and offsets of those that don't.
DST_ZONES = {"EST": "America/New_York", "CST": "America/Chicago", "MST": "America/Denver", "PST": "America/Los_Angeles", "AKST": "America/Anchorage", "HST": "Pacific/Honolulu", "AST": "America/Puerto_Rico"}
STANDARD_HOURS = {"UTC": 0, "GMT": 0, "EST": -5, "CST": -6, "MST": -7, "PST": -8, "AKST": -9, "HST": -10, "AST": -4, "SST": -11, "ChST": 10}


def zone_of(abbreviation: Column, uses_dst: Column) -> Column:
    """Named zone, or offset, of a standard-time abbreviation and a flag (Y or N). Unknown ones raise: none is guessed."""
    name = F.create_map(*(F.lit(x) for kv in DST_ZONES.items() for x in kv))[F.trim(abbreviation)]
    offset = F.create_map(*(F.lit(x) for k, h in STANDARD_HOURS.items() for x in (k, f"{h:+03d}:00")))[F.trim(abbreviation)]
    found = F.when(F.upper(F.trim(uses_dst)) == "Y", name).when(F.upper(F.trim(uses_dst)) == "N", offset)
    return F.coalesce(found, F.raise_error(F.concat(F.lit("no zone for "), F.coalesce(abbreviation, F.lit("null")), F.lit(", "), F.coalesce(uses_dst, F.lit("null")))))


def local_day_hours(day: Column, zone: str) -> Column:
    """Hours of a local day: 23, 24 or 25."""
    at = lambda d: F.unix_timestamp(F.to_utc_timestamp(d.cast("timestamp"), zone))
    return ((at(F.date_add(day, 1)) - at(day)) / 3600).cast("double")
