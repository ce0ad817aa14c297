"""Queries: formats parsed from text made of the driver's tables, and compiled equations."""

from __future__ import annotations

from pyspark.sql import functions as F

from headwater.functions.expressions import compile_expression
from headwater.plans.common import rounded, sql
from headwater.plans.tables import instantaneous, monthly_peaks, table
from headwater.sources import readers as R


def _cards(s, d):
    p = monthly_peaks(s, d).withColumn("month", F.lpad((F.col("year") % 12 + 1).cast("string"), 2, " "))
    line = F.concat(F.lit("3"), F.rpad("site", 15, " "), F.lpad((F.col("year") + 1900).cast("string"), 4, " "), "month", F.lit("00"), F.lpad(F.col("flow").cast("long").cast("string"), 7, " "), F.rpad(F.lit("7"), 12, " "), F.lpad(F.lit("1.5"), 8, " "))
    return p.select(line.alias("value")).unionAll(s.sql("SELECT 'N header' AS value"))


def _rdb(s, d):
    cols = ["agency_cd", "site_no", "datetime", "tz_cd", "11_00060", "11_00060_cd"]
    e = instantaneous(s, d)
    line = F.concat_ws("\t", F.lit("U"), "site", F.date_format("ts", "yyyy-MM-dd HH:mm"), F.lit("MST"), F.round("value", 2).cast("string"), F.lit("A"))
    extra = s.createDataFrame([("# note",), ("\t".join(cols),), ("5s\t15s\t20d\t6s\t14n\t10s",)], "value string")
    return R.rdb_instantaneous(R.rdb(e.select(line.alias("value")).unionAll(extra), cols), "00060", {"MST": "-07:00"}).select("site", "ts", "value", "code")


def _geojson(s, d):
    """Pages of up to a thousand events; each event is a series of its own, as two of a type may share an instant."""
    e = table(s, d, "events").select("event_id", F.col("event_type").alias("site"), F.col("ts").cast("timestamp").alias("ts"), "value")
    props = F.struct(F.col("site").alias("monitoring_location_id"), F.lit("00060").alias("parameter_code"), F.col("event_id").cast("string").alias("time_series_id"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").alias("time"), F.col("value").cast("string").alias("value"), F.lit("Approved").alias("approval_status"), F.array(F.lit("ICE"), F.lit("ESTIMATED")).alias("qualifier"))
    docs = e.groupBy(F.floor(F.col("event_id") / 1000).alias("page")).agg(F.to_json(F.struct(F.collect_list(F.struct(F.lit("f").alias("id"), props.alias("properties"))).alias("features"))).alias("value"))
    return R.continuous(R.features(docs), "00060", each_series=True)


QUERIES = {
    "a3_peak_cards": lambda s, d: R.peak_cards(_cards(s, d)).select("site", F.col("year").cast("long").alias("year"), "date", "flow", "code", "stage"),
    "a6_rdb": lambda s, d: rounded(_rdb(s, d)),
    "a7_partial_date": lambda s, d: table(s, d, "part").select("p_partkey", R.partial_date(F.concat(F.lit("19"), F.lpad((F.col("p_size") + 20).cast("string"), 2, "0"), F.lit("-0"), (F.col("p_partkey") % 10).cast("string"), F.lit("-00"))).alias("date")),
    "a10_a12_features": lambda s, d: rounded(_geojson(s, d)),
    "a14_chunks": lambda s, d: R.chunks(s, "2019-03-01", "2024-02-10", 2, "America/Denver"),
    "a23_invalid_peaks": lambda s, d: rounded(R.invalid_peaks(monthly_peaks(s, d).withColumn("year", F.floor(F.col("year") / 12).cast("int")))),
    "f7_compiled_equation": lambda s, d: rounded(table(s, d, "part").select("p_partkey", compile_expression("10^0.5*p_size^0.75*(p_retailprice/100+1)^-1.2 + max(p_size - 10, 0) - logN(p_retailprice, 10)").alias("flow"))),
}

ORACLE = {
    "a3_peak_cards": sql("SELECT site, CASE WHEN year % 12 + 1 >= 10 THEN year + 1901 ELSE year + 1900 END AS year, make_date(year + 1900, year % 12 + 1, 1) AS date, floor(flow) AS flow, '7' AS code, 1.5::DOUBLE AS stage FROM mpeaks", longs="year"),
    "a6_rdb": "SELECT event_type AS site, date_trunc('minute', ts) + INTERVAL 7 HOURS AS ts, round(value, 6) AS value, 'A' AS code FROM events",
    "a7_partial_date": "SELECT p_partkey, make_date(1900 + p_size + 20, greatest(1, p_partkey % 10), 1) AS date FROM part",
    "a10_a12_features": "SELECT event_type AS site, ts, round(value, 6) AS value, 'A:ICE:e' AS code FROM events",
    "a14_chunks": "SELECT * FROM (VALUES (TIMESTAMP '2019-03-01 07:00:00', TIMESTAMP '2021-03-01 07:00:00'), (TIMESTAMP '2021-03-01 07:00:00', TIMESTAMP '2023-03-01 07:00:00'), (TIMESTAMP '2023-03-01 07:00:00', TIMESTAMP '2024-02-11 07:00:00')) AS t(lo, hi)",
    "a23_invalid_peaks": sql("SELECT site, year // 12 AS year, count(*) AS n FROM mpeaks GROUP BY site, year // 12 HAVING count(*) > 1", longs="year"),
    "f7_compiled_equation": "SELECT p_partkey, round(pow(10, 0.5) * pow(p_size, 0.75) * pow(p_retailprice / 100 + 1, -1.2) + greatest(p_size - 10, 0) - ln(p_retailprice) / ln(10), 6) AS flow FROM part",
}
