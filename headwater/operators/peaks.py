"""Annual peaks: qualification codes, intervals, thresholds by year, summaries and lookups of rule tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The least and greatest flow a censored peak may have, and the codes that are acted on.
LEAST, MOST = 1e-20, 1e20
REMOVED, REGULATED, URBAN = ("3", "O"), ("5", "6"), "C"
ACTED_ON = ("3", "4", "6", "7", "8", "C", "O")
AEP_TOLERANCE = 0.0075
#: Critical values of the single low-outlier test at the 10 % level, by record length.
OUTLIER_LEVELS = {10: 2.036, 15: 2.247, 20: 2.385, 25: 2.486, 30: 2.563, 40: 2.682, 50: 2.768, 60: 2.837, 70: 2.893, 80: 2.940, 90: 2.981, 100: 3.017}


def parse_codes(field: Column) -> Column:
    """Distinct codes of a field, sorted: commas split, 7.0 is 7, Bd and Bm are one code, case is kept."""
    plain = F.regexp_replace(F.coalesce(field, F.lit("")), r"\b(\d+)\.0\b", "$1")
    return F.array_sort(F.array_distinct(F.regexp_extract_all(F.regexp_replace(plain, ",", " "), F.lit(r"[Bb][DdMm]|\S"), F.lit(0))))


def peak_interval(flow: Column, codes: Column, keep_urban: bool = False) -> Column:
    """lower, upper, removed and historic of a peak; later rules win: 4, 8, 3 or O, 6 or C."""
    has = lambda *c: F.arrays_overlap(codes, F.array(*(F.lit(x) for x in c)))
    removed = has(*REMOVED) | (F.lit(False) if keep_urban else has("6", URBAN))
    return F.struct(
        F.when(removed, None).when(has("4"), F.lit(LEAST)).otherwise(flow).alias("lower"),
        F.when(removed, None).when(has("8"), F.lit(MOST)).otherwise(flow).alias("upper"),
        removed.alias("removed"),
        has("7").alias("historic"),
    )


def peak_intervals(peaks: DataFrame, keep_urban: bool = False) -> DataFrame:
    """site, year and the interval of each peak with a flow; a negative flow is refused by an error."""
    flow = F.when(F.col("flow") < 0, F.raise_error(F.lit("negative peak flow"))).otherwise(F.col("flow"))
    return peaks.filter("flow IS NOT NULL").select("site", "year", peak_interval(flow, parse_codes(F.col("code")), keep_urban).alias("x")).select("site", "year", "x.*")


def classify(peaks: DataFrame) -> DataFrame:
    """regulated with any 5 or 6, else altered with any C, else unregulated; and the share of peaks that say so."""
    codes = parse_codes(F.col("code"))
    six, urban = F.arrays_overlap(codes, F.array(F.lit("5"), F.lit("6"))), F.array_contains(codes, URBAN)
    rows = peaks.groupBy("site").agg(F.avg(six.cast("double")).alias("a"), F.avg(urban.cast("double")).alias("b"))
    return rows.select("site", F.when(F.col("a") > 0, "regulated").when(F.col("b") > 0, "altered").otherwise("unregulated").alias("class"), F.when(F.col("a") > 0, F.col("a")).otherwise(F.col("b")).alias("share"))


def count_codes(peaks: DataFrame) -> DataFrame:
    """How many peaks have each code that is acted on."""
    return peaks.select("site", F.explode(parse_codes(F.col("code"))).alias("code")).filter(F.col("code").isin(*ACTED_ON)).groupBy("site", "code").agg(F.count(F.lit(1)).alias("n"))


def one_per_year(peaks: DataFrame) -> DataFrame:
    """Distinct rows, then the greatest of each site and year."""
    by = Window.partitionBy("site", "year").orderBy(F.col("flow").desc(), "code")
    return peaks.dropDuplicates().withColumn("k", F.row_number().over(by)).filter("k = 1").drop("k")


def summarize(peaks: DataFrame) -> DataFrame:
    """First and last year, number, greatest peak and its year."""
    return peaks.filter("flow IS NOT NULL").groupBy("site").agg(
        F.min("year").alias("first_year"), F.max("year").alias("last_year"), F.count(F.lit(1)).alias("n"), F.max("flow").alias("max_flow"), F.min_by("year", F.struct(-F.col("flow"), F.col("year"))).alias("max_year")
    )


def catalog_rows(peaks: DataFrame, locations: DataFrame, min_years: int = 10) -> DataFrame:
    """Sites with enough distinct years, with their location, years and class."""
    years = peaks.filter("flow IS NOT NULL").groupBy("site").agg(F.countDistinct("year").alias("n_years"), F.min("year").alias("first_year"), F.max("year").alias("last_year")).filter(F.col("n_years") >= min_years)
    return years.join(locations, "site").join(classify(peaks).drop("share"), "site", "left")


def needing_location(peaks: DataFrame, locations: DataFrame, min_years: int = 10) -> DataFrame:
    """Sites with enough peaks and no location."""
    enough = peaks.filter("flow IS NOT NULL").groupBy("site").agg(F.countDistinct("year").alias("n_years")).filter(F.col("n_years") >= min_years)
    return enough.join(locations, "site", "left_anti")


def plotting_positions(peaks: DataFrame) -> DataFrame:
    """Weibull return periods (n + 1) / rank, greatest first."""
    by = Window.partitionBy("site")
    return peaks.filter("flow IS NOT NULL").select("site", "year", "flow", ((F.count(F.lit(1)).over(by) + 1) / F.row_number().over(by.orderBy(F.col("flow").desc(), "year"))).alias("return_period"))


def thresholds_by_year(periods: DataFrame) -> DataFrame:
    """site, year, lower and upper from periods (site, start, end, lower, upper, ord): the later line wins.

    Periods are short lists of years; exploded, the range join becomes an aggregation by year.
    """
    years = periods.select("site", F.explode(F.sequence("start", "end")).alias("year"), "ord", "lower", "upper")
    best = years.groupBy("site", "year").agg(F.max_by(F.struct("lower", "upper"), "ord").alias("t"))
    return best.select("site", "year", "t.lower", "t.upper")


def station_rows(peaks: DataFrame, periods: DataFrame) -> DataFrame:
    """One row for each year in a period or with a peak: the flow interval, the perception interval, and its kind.

    A year without a peak is censored below its threshold; one whose threshold is zero tells nothing and is dropped.
    """
    t = thresholds_by_year(periods)
    p = peak_intervals(peaks).filter("NOT removed").select("site", "year", "lower", "upper", "historic")
    rows = t.withColumnRenamed("lower", "tl").withColumnRenamed("upper", "tu").join(p, ["site", "year"], "full")
    tl, tu = F.coalesce("tl", F.lit(LEAST)), F.coalesce("tu", F.lit(MOST))
    out = rows.select(
        "site", "year", F.coalesce("lower", F.lit(LEAST)).alias("ql"), F.coalesce("upper", tl).alias("qu"), tl.alias("tl"), tu.alias("tu"), F.coalesce("historic", F.lit(False)).alias("historic"),
        F.when(F.col("lower").isNull(), "censored").when(F.col("lower") == F.col("upper"), "exact").otherwise("interval").alias("kind"),
    )
    return out.filter((F.col("kind") != "censored") | (F.col("qu") > LEAST))


def threshold_table(rows: DataFrame) -> DataFrame:
    """Runs of years on end with one perception interval."""
    by = Window.partitionBy("site", "tl", "tu").orderBy("year")
    runs = rows.withColumn("run", F.col("year") - F.row_number().over(by))
    return runs.groupBy("site", "tl", "tu", "run").agg(F.min("year").alias("start"), F.max("year").alias("end"), F.count(F.lit(1)).alias("n")).drop("run")


def outlier_level(n: Column) -> Column:
    """Critical value of the single low-outlier test: from the table, straight between its entries, by formula above 100."""
    lg = F.log10(n)
    out = -0.9043 + 3.345 * F.sqrt(lg) - 0.4046 * lg
    known = sorted(OUTLIER_LEVELS.items())
    for (a, x), (b, y) in reversed(list(zip(known, known[1:]))):
        out = F.when(n < b, F.lit(x) + (y - x) * (n - a) / (b - a)).otherwise(out)
    return F.when(n <= known[0][0], known[0][1]).otherwise(out)


def low_outlier_cut(peaks: DataFrame) -> DataFrame:
    """10 ^ (mean - K sd) of the logs, and how many peaks lie below."""
    lg = F.log10("flow")
    m = peaks.filter("flow > 0").groupBy("site").agg(F.count(F.lit(1)).alias("n"), F.avg(lg).alias("mean"), F.stddev_samp(lg).alias("sd"))
    m = m.withColumn("cut", F.pow(F.lit(10.0), F.col("mean") - outlier_level(F.col("n")) * F.col("sd")))
    return peaks.filter("flow > 0").join(m, "site").groupBy("site").agg(F.first("n").alias("n"), F.first("cut").alias("cut"), F.count(F.when(F.col("flow") < F.col("cut"), 1)).alias("n_low"))


def match_aep(wanted: DataFrame, table: DataFrame, keys: tuple[str, ...] = ("site",)) -> DataFrame:
    """Each wanted aep with the row of table whose aep is nearest within the relative tolerance; else nulls.

    table has a row for each of a few probabilities.
    """
    t = table.withColumnRenamed("aep", "t_aep")
    near = F.abs(F.col("aep") - F.col("t_aep")) <= AEP_TOLERANCE * F.greatest(F.abs("aep"), F.abs("t_aep"))
    cols = [c for c in t.columns if c not in keys]
    joined = wanted.join(t, [*keys], "left")
    best = joined.groupBy(*keys, "aep").agg(F.min_by(F.struct(*cols), F.when(near, F.struct(F.abs(F.col("aep") - F.col("t_aep")), F.col("t_aep")))).alias("m"))
    return best.select(*keys, "aep", *(F.col(f"m.{c}").alias("matched_aep" if c == "t_aep" else c) for c in cols))


def longest_prefix(sites: DataFrame, rules: DataFrame) -> DataFrame:
    """Each site's rule with the longest prefix of its code; sites: site, code; rules: prefix, value.

    Prefix lengths are few: the code is cut to each of them, which makes the lookup an equi-join. Two values for one
    prefix raise, and so does a code that is only the beginning of prefixes with other values than it has itself.
    """
    lengths = [r["n"] for r in rules.select(F.length("prefix").alias("n")).distinct().collect()]
    at = [r["n"] for r in sites.select(F.length("code").alias("n")).distinct().collect() if r["n"]]
    unlike = F.when(F.size("values") > 1, F.raise_error(F.concat(F.lit("several values for "), "prefix"))).otherwise(F.get("values", F.lit(0)))
    rules = rules.groupBy("prefix").agg(F.collect_set("value").alias("values")).select("prefix", unlike.alias("value"))
    # rules of units within a site's own, by the beginnings of their prefixes
    begin = F.explode(F.array(*(F.substring("prefix", 1, n) for n in at))).alias("code")
    finer = rules.select("prefix", "value", begin).filter("length(prefix) > length(code)").groupBy("code").agg(F.collect_set("value").alias("finer")) if at else None
    cut = F.explode(F.array(*(F.substring("code", 1, n) for n in lengths))).alias("prefix")
    found = sites.select("site", "code", cut).distinct().join(rules, "prefix")
    best = found.groupBy("site", "code").agg(F.max_by(F.struct("prefix", "value"), F.length("prefix")).alias("r"))
    out = sites.join(best.select("site", "code", "r.prefix", "r.value"), ["site", "code"], "left")
    if finer is None:
        return out
    other = F.size(F.array_except(F.coalesce("finer", F.array().cast("array<string>")), F.array(F.col("value").cast("string")))) > 0
    value = F.when(other, F.raise_error(F.concat(F.lit("units within "), "code", F.lit(" have other values")))).otherwise(F.col("value"))
    return out.join(finer, "code", "left").select(*sites.columns, "prefix", value.alias("value"))
