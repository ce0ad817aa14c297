"""Hydrologic series bound to the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def daily(spark: SparkSession, sf_dir: str, level: str = "region") -> DataFrame:
    """site, date, flow: shipped quantity by day for each region or nation."""
    t = lambda n: table(spark, sf_dir, n)
    sites = t("supplier").join(t("nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    if level == "region":
        sites = sites.join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    name = "r_name" if level == "region" else "n_name"
    rows = t("lineitem").join(sites.select("s_suppkey", F.col(name).alias("site")), F.col("l_suppkey") == F.col("s_suppkey"))
    return rows.groupBy("site", F.to_date("l_shipdate").alias("date")).agg(F.sum("l_quantity").alias("flow"))


def daily_with_zeros(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nations' complete calendars with 0 on days without shipments."""
    from headwater.functions.calendar import complete_calendar

    return complete_calendar(daily(spark, sf_dir, "nation")).withColumn("flow", F.coalesce("flow", F.lit(0.0)))


def orders_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """site, date, flow: order totals in thousands by day, one site for each order status."""
    o = table(spark, sf_dir, "orders")
    return o.groupBy(F.col("o_orderstatus").alias("site"), F.to_date("o_orderdate").alias("date")).agg((F.round(F.sum("o_totalprice"), 2) / 1000).alias("flow"))


def instantaneous(spark: SparkSession, sf_dir: str) -> DataFrame:
    """site, ts, value: events by type."""
    return table(spark, sf_dir, "events").select(F.col("event_type").alias("site"), F.col("ts").cast("timestamp").alias("ts"), "value")


def monthly_peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """site, year, flow: the largest day of each calendar month; months are numbered from 1995 as if they were years."""
    d = daily(spark, sf_dir, "region")
    label = ((F.year("date") - 1995) * 12 + F.month("date")).cast("int").alias("year")
    return d.groupBy("site", label).agg(F.max("flow").alias("flow"))


#: The same series for DuckDB.
SQL = """
daily AS (SELECT r_name AS site, l_shipdate::DATE AS date, sum(l_quantity) AS flow FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL),
gappy AS (SELECT n_name AS site, l_shipdate::DATE AS date, sum(l_quantity) AS flow FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey GROUP BY ALL),
span AS (SELECT site, min(date) AS a, max(date) AS b FROM daily GROUP BY site),
days AS (SELECT site, a, (a + k::INT)::DATE AS date, k AS day FROM span, unnest(range(0, b - a + 1)) AS r(k)),
dense AS (SELECT site, date, day, flow, year(date) + (month(date) >= 10)::INT AS wy, year(date) - (month(date) < 4)::INT AS cy FROM days LEFT JOIN daily USING (site, date)),
gspan AS (SELECT site, min(date) AS a, max(date) AS b FROM gappy GROUP BY site),
gdays AS (SELECT site, (a + k::INT)::DATE AS date, k AS day FROM gspan, unnest(range(0, b - a + 1)) AS r(k)),
gdense AS (SELECT site, date, day, flow, year(date) + (month(date) >= 10)::INT AS wy, year(date) - (month(date) < 4)::INT AS cy FROM gdays LEFT JOIN gappy USING (site, date)),
zeros AS (SELECT site, date, day, coalesce(flow, 0.0) AS flow, wy, cy FROM gdense),
odaily AS (SELECT o_orderstatus AS site, o_orderdate::DATE AS date, round(sum(o_totalprice), 2) / 1000 AS flow FROM orders GROUP BY ALL),
iv AS (SELECT event_type AS site, ts, value FROM events),
mpeaks AS (SELECT site, (year(date) - 1995) * 12 + month(date) AS year, max(flow) AS flow FROM daily GROUP BY ALL)
"""
