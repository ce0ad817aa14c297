"""Readers and writers of hydrologic formats. Text is split into columns by the engine, never on the driver."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from headwater.functions.calendar import year_label

DAILY = "site string, date date, flow double"
INSTANTANEOUS = "site string, ts timestamp, value double, code string"
PEAKS = "site string, year int, date date, flow double, code string"
#: Column places of the peak card file (first, length).
CARD = {"site": (2, 15), "year": (17, 4), "month": (21, 2), "day": (23, 2), "flow": (25, 7), "code": (32, 12), "stage": (44, 8)}


class AmbiguousColumn(ValueError):
    """More than one value column could be meant."""


def read_flow(spark: SparkSession, path: str, schema: str = DAILY) -> DataFrame:
    """A series by its suffix: Parquet, or CSV (also gzipped) with a header. The schema is given, never inferred."""
    if re.search(r"\.(parquet|pq)$", path):
        return spark.read.schema(schema).parquet(path)
    if re.search(r"\.csv(\.gz)?$", path):
        return spark.read.schema(schema).option("header", True).csv(path)
    raise ValueError(f"unknown kind of file: {path}")


def write_flow(df: DataFrame, path: str, compression: str = "zstd") -> None:
    """Writes by suffix; Parquet is compressed."""
    if re.search(r"\.(parquet|pq)$", path):
        df.write.option("compression", compression).parquet(path)
    elif re.search(r"\.csv(\.gz)?$", path):
        df.write.option("header", True).option("compression", "gzip" if path.endswith(".gz") else "none").csv(path)
    else:
        raise ValueError(f"unknown kind of file: {path}")


def partial_date(text: Column) -> Column:
    """yyyy-mm-dd whose day or month may be 00: those become the first; what isn't a date becomes null."""
    part = lambda k: F.regexp_extract(text, r"^(\d{4})-(\d{2})-(\d{2})", k)
    one = lambda x: F.when(x == "00", "01").otherwise(x)
    return F.try_to_timestamp(F.concat_ws("-", part(1), one(part(2)), one(part(3))), F.lit("yyyy-MM-dd")).cast("date")


def peak_cards(lines: DataFrame) -> DataFrame:
    """Fixed-width peak records (column value): lines that begin with 3, distinct. Without a month the year is the calendar's."""
    cut = lambda name: F.trim(F.substring("value", *CARD[name]))
    number = lambda name: F.when(cut(name) != "", cut(name))
    rows = lines.filter(F.substring("value", 1, 1) == "3").select(
        cut("site").alias("site"), number("year").cast("int").alias("y"), F.coalesce(number("month").cast("int"), F.lit(0)).alias("m"), F.coalesce(number("day").cast("int"), F.lit(0)).alias("d"),
        number("flow").cast("double").alias("flow"), cut("code").alias("code"), number("stage").cast("double").alias("stage"),
    )
    date = F.make_date("y", F.when(F.col("m") == 0, 1).otherwise(F.col("m")), F.when(F.col("d") == 0, 1).otherwise(F.col("d")))
    year = F.when(F.col("m") == 0, F.col("y")).otherwise(year_label(date, "water"))
    return rows.select("site", year.alias("year"), date.alias("date"), "flow", "code", "stage").distinct()


def read_peak_cards(spark: SparkSession, path: str) -> DataFrame:
    return peak_cards(spark.read.text(path))


def rdb_columns(header: str) -> list[str]:
    return header.rstrip("\r\n").split("\t")


def value_column(columns: Iterable[str], parameter: str, series: str | None = None) -> str:
    """The one column that holds a parameter's values (of a series, where several do)."""
    found = [c for c in columns if re.fullmatch(rf"(\d+_)?{parameter}(_\d{{5}})?", c) and (series is None or c.startswith(f"{series}_"))]
    if len(found) != 1:
        raise AmbiguousColumn(f"{len(found)} columns hold {parameter}: {found}")
    return found[0]


def rdb(lines: DataFrame, columns: list[str]) -> DataFrame:
    """Tab-separated lines (column value) with # comments, a header and a row of widths, as string columns.

    The header is the first line that isn't a comment; it is known beforehand, so that the scan is one pass.
    """
    widths = r"^\d+[sdn](\t\d+[sdn])*$"
    rows = lines.filter(~F.col("value").startswith("#") & (F.col("value") != "\t".join(columns)) & ~F.col("value").rlike(widths) & (F.trim("value") != ""))
    cells = F.split("value", "\t", -1)
    return rows.select(*(F.when(F.get(cells, F.lit(i)) != "", F.get(cells, F.lit(i))).alias(c) for i, c in enumerate(columns)))


def read_rdb(spark: SparkSession, path: str) -> DataFrame:
    lines = spark.read.text(path)
    header = lines.filter(~F.col("value").startswith("#")).first()
    return rdb(lines, rdb_columns(header["value"]))


def catalog_period(listing: DataFrame, data_type: str, parameter: str = "00060", statistic: str | None = None) -> DataFrame:
    """First and last date, as written, of each site's series of a type, parameter (and statistic) in a listing."""
    rows = listing.filter((F.trim("data_type_cd") == data_type) & (F.trim("parm_cd") == parameter))
    rows = rows if statistic is None else rows.filter(F.trim("stat_cd") == statistic)
    return rows.groupBy(F.col("site_no").alias("site")).agg(F.min("begin_date").alias("begin_date"), F.max("end_date").alias("end_date"))


def rdb_instantaneous(table: DataFrame, parameter: str, zones: dict[str, str]) -> DataFrame:
    """Readings of a parameter at UTC instants; zones: abbreviation to named zone or offset."""
    value = value_column([c for c in table.columns if not c.endswith("_cd")], parameter)
    zone = F.create_map(*(F.lit(x) for kv in zones.items() for x in kv))[F.col("tz_cd")]
    local = F.to_timestamp_ntz("datetime", F.lit("yyyy-MM-dd HH:mm"))
    rows = table.select(F.col("site_no").alias("site"), F.to_utc_timestamp(local.cast("timestamp"), zone).alias("ts"), F.col(value).try_cast("double").alias("value"), (F.col(f"{value}_cd") if f"{value}_cd" in table.columns else F.lit(None)).alias("code"), local.alias("local"), "tz_cd")
    return rows.filter("value IS NOT NULL")


def features(documents: DataFrame, schema: str = "features array<struct<id:string,properties:struct<monitoring_location_id:string,parameter_code:string,time_series_id:string,time:string,value:string,approval_status:string,qualifier:array<string>>>>") -> DataFrame:
    """One row per feature of GeoJSON documents (column value)."""
    return documents.select(F.explode(F.from_json("value", schema)["features"]).alias("f")).select("f.id", "f.properties.*")


def continuous(found: DataFrame, parameter: str, each_series: bool = False) -> DataFrame:
    """Readings at UTC instants from features of one parameter; another one, or two values of one instant, raise.

    each_series: a site's time series are told apart, so that each may have a reading of the instant.
    """
    keys = ["site", "series", "ts"] if each_series else ["site", "ts"]
    wrong = F.when(F.col("parameter_code") != parameter, F.raise_error(F.lit("another parameter than asked for"))).otherwise(F.col("value"))
    rows = found.select(F.col("monitoring_location_id").alias("site"), *([F.col("time_series_id").alias("series")] if each_series else []), F.to_timestamp("time").alias("ts"), wrong.cast("double").alias("value"), qualification(F.col("approval_status"), F.col("qualifier")).alias("code")).filter("value IS NOT NULL")
    each = rows.groupBy(*keys).agg(F.collect_set(F.struct("value", "code")).alias("x"))
    one = F.when(F.size("x") > 1, F.raise_error(F.lit("two readings of one instant"))).otherwise(F.get("x", F.lit(0)))
    return each.select("site", "ts", one.alias("x")).select("site", "ts", "x.value", "x.code")


def daily_values(found: DataFrame, parameter: str) -> DataFrame:
    """The same for daily means."""
    return continuous(found, parameter).select("site", F.to_date("ts").alias("date"), F.col("value").alias("flow"), "code")


# Words of the service and the codes that stand for them.
STATUS = {"Approved": "A", "Provisional": "P"}
QUALIFIERS = {"ESTIMATED": "e"}


def qualification(status: Column, qualifiers: Column) -> Column:
    """Status and qualifiers as one colon-joined code; unknown words stay as they are, empty ones go."""
    of = lambda d, x: F.coalesce(F.create_map(*(F.lit(v) for kv in d.items() for v in kv))[x], x)
    return F.array_join(F.concat(F.array_compact(F.array(of(STATUS, status))), F.transform(F.filter(F.coalesce(qualifiers, F.array().cast("array<string>")), lambda x: x != ""), lambda x: of(QUALIFIERS, x))), ":")


def conflicts(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Keys whose rows differ: the violations that a reader must refuse."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.size(F.collect_set(F.struct(*rest))).alias("n")).filter("n > 1")


def invalid_peaks(peaks: DataFrame) -> DataFrame:
    """Water years that a site has more than once."""
    return peaks.groupBy("site", "year").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def chunks(spark: SparkSession, start: str, end: str, years: int, zone: str) -> DataFrame:
    """Half-open UTC chunks of whole years that cover an inclusive range of local dates without a gap."""
    if not 1 <= years <= 3:
        raise ValueError("chunks span one to three years")
    rows = spark.range(1).select(F.explode(F.sequence(F.lit(start).cast("date"), F.lit(end).cast("date"), F.expr(f"INTERVAL {years} YEARS"))).alias("a"))
    stop = F.least(F.add_months("a", 12 * years), F.date_add(F.lit(end).cast("date"), 1))
    return rows.select(F.to_utc_timestamp(F.col("a").cast("timestamp"), zone).alias("lo"), F.to_utc_timestamp(stop.cast("timestamp"), zone).alias("hi"))


def select_series(series: DataFrame, lo: str, hi: str) -> DataFrame:
    """Series (id, begin, end) that overlap a range; an open end overlaps."""
    return series.filter(F.coalesce(F.col("begin") <= F.lit(hi).cast("timestamp"), F.lit(True)) & F.coalesce(F.col("end") >= F.lit(lo).cast("timestamp"), F.lit(True)))


def specification(text: str) -> dict[str, dict]:
    """Stations of a line-oriented specification: thresholds, intervals and options of each; ' begins a comment.

    A specification is one small file that says what to read; it is parsed where the plan is made.
    """
    stations: dict[str, dict] = {}
    now: dict | None = None
    for line in text.splitlines():
        words = line.split("'")[0].split()
        if not words:
            continue
        key = words[0].lower()
        if key == "station":
            if words[1] in stations:
                raise ValueError(f"station {words[1]} comes twice")
            now = stations[words[1]] = {"thresholds": [], "intervals": [], "options": {}}
        elif now is None:
            continue
        elif key == "pcpt_thresh":
            now["thresholds"].append((int(words[1]), int(words[2]), float(words[3]), float(words[4])))
        elif key == "interval":
            now["intervals"].append((int(words[1]), float(words[2]), float(words[3])))
        else:
            now["options"][words[0]] = " ".join(words[1:])
    return stations


def equation_library(spark: SparkSession, path: str, statuses: tuple[str, ...] = ("verified",)) -> DataFrame:
    """One row per equation of nested JSON libraries (one document a file). A library of another status raises."""
    schema = "state string, status string, equations array<struct<region:string,aep:double,intercept:double,terms:array<struct<code:string,transform:string,scale:double,offset:double,coef:double>>>>"
    rows = spark.read.schema(schema).option("multiLine", True).json(path)
    status = F.when(F.col("status").isin(*statuses), F.col("status")).otherwise(F.raise_error(F.concat(F.lit("not a usable library: "), "state", F.lit(" "), F.coalesce("status", F.lit("none")))))
    return rows.select("state", status.alias("status"), F.explode("equations").alias("e")).select("state", "status", "e.*")
