"""Queries: dimension tables, guards and keyed transfers over suppliers and parts; published records and their fits."""

from __future__ import annotations

from pyspark.sql import functions as F

from headwater.operators import dimensions as D
from headwater.operators import frequency as Q
from headwater.operators import transfer as T
from headwater.plans.common import rounded, sql
from headwater.plans.q_transfer import _basins, chars, equations, pairs, sites
from headwater.plans.tables import daily, monthly_peaks, table

# Annual peaks of two public gages, in cubic feet a second, and the published results of their fits.
PEAKS = {
    "06327450": "1770 157 473 840 206 332 630 177 904 788 1140 80 189 1080 1050 353 537 158 504 1310 1230 609 489 623 593 210 177 433 1330 36.6 20.2 209",
    "03606500": "9100 2060 7820 3220 5580 17000 6740 13800 4270 5940 1680 1200 10100 3780 5340 5630 12000 3980 6130 4740 9880 5230 4260 5000 3320 5480 11800 5150 3350 2400 1460 3770 7480 2740 3100 7180 1920 9060 3080 2800 4330 5080 12000 7640",
}
HISTORIC, CENSORED_YEARS, THRESHOLD = "25000 21000 18500", 37, 18000.0
REGIONAL = {"06327450": (-0.387, 0.41), "03606500": (-0.5, 0.3025)}
PUBLISHED = """('06327450', 0.1, 3.099203178, 2.989841588, 3.271443053, 0.005759644), ('06327450', 0.02, 3.296634485, 3.154564774, 3.636916973, 0.012276513),
('06327450', 0.01, 3.357282561, 3.198923555, 3.772146989, 0.015881462), ('06327450', 0.002, 3.466571974, 3.269771129, 4.033822244, 0.025646158),
('03606500', 0.1, 4.085284868, 4.007325301, 4.165730358, 0.002231455), ('03606500', 0.02, 4.290568026, 4.194517408, 4.416449903, 0.004188834),
('03606500', 0.01, 4.360960413, 4.252936788, 4.513093743, 0.005684547), ('03606500', 0.002, 4.500176669, 4.357706978, 4.719017131, 0.010787971)"""


def published_records(s):
    rows = [(site, float(x), float(x), 0.0, D.FLOW_MOST) for site, text in PEAKS.items() for x in text.split()]
    rows += [("03606500", float(x), float(x), THRESHOLD, D.FLOW_MOST) for x in HISTORIC.split()]
    rows += [("03606500", 0.0, THRESHOLD, THRESHOLD, D.FLOW_MOST)] * CENSORED_YEARS
    return s.createDataFrame(rows, "site string, ql double, qu double, tl double, tu double")


def _published(s, d):
    fits = None
    for site, (skew, mse) in REGIONAL.items():
        one = Q.fit_intervals(published_records(s).filter(F.col("site") == site), skew, mse, (0.1, 0.02, 0.01, 0.002))
        fits = one if fits is None else fits.unionAll(one)
    # to a thousandth of the log: limits are held to 1e-3 of the flow
    return fits.select("site", "aep", *(F.round(F.log10(c), 3).alias(f"log_{c}") for c in ("flow", "lower", "upper")), F.round("variance_log", 4).alias("variance_log"))


def _catalog(s, d):
    kinds = F.array(*(F.lit(x) for x in ("reference", "regulated", "urban", "unknown")))
    return sites(s, d).select("site", F.element_at(kinds, (F.col("area") % 4).cast("int") + 1).alias("class"), "code", "lat", "lon", "area")


def _rules(s):
    return s.sql("SELECT * FROM VALUES ('0', array('AA', 'BB'), 0.1D), ('00', array('AA'), 0.2D), ('00', array('BB'), 0.3D), ('7', array('CC'), 0.4D) AS t(prefix, states, value)")


def _regional(s):
    return s.sql("SELECT * FROM VALUES ('ASIA', 'r1', 'verified', 0.1D), ('EUROPE', 'r2', 'provisional', 0.2D), ('EUROPE', 'r3', 'pending', 0.3D), ('AFRICA', 'r4', 'verified', -0.4D) AS t(state, region, status, value)")


def _dams(s, d):
    k = F.col("p_partkey")
    return table(s, d, "part").select(F.when(k % 5 == 0, "").otherwise(F.concat(F.lit("D"), (k % 400).cast("string"))).alias("dam_id"), F.when(k % 11 > 0, -118.5 + (k % 90) / 10).alias("lon"), (40.5 + (k % 97) / 10).alias("lat"), F.col("p_size").cast("double").alias("storage"))


def _series(s, d):
    o = table(s, d, "orders")
    return o.select(F.col("o_orderpriority").alias("site"), F.when(F.col("o_orderkey") % 2 == 0, "00003").otherwise("00011").alias("statistic"), F.when((F.col("o_orderpriority") < "3") & (F.col("o_orderkey") % 3 == 0), "Primary").alias("primary"), F.col("o_orderdate").cast("timestamp").alias("begin"), (F.col("o_orderdate").cast("timestamp") + F.expr("INTERVAL 1 DAY")).alias("end"))


def _guards(s, d):
    rows = D.check_transfer(_catalog(s, d).select("site", F.col("class").alias("donor_class"), F.when(F.col("area") % 3 > 0, F.lit("reference")).alias("target_class"), "class"), allow=True)
    return D.require_unregulated(rows.withColumnRenamed("regulation_override", "mismatch"), allow=True)


def _fits(s, d):
    p = table(s, d, "part")
    q2, q100 = F.col("p_size") / 10, F.when(F.col("p_partkey") % 9 > 0, F.col("p_retailprice") * F.col("p_partkey") % 4000)
    region = F.concat(F.when(F.col("p_partkey") % 7 == 0, "Navajo").otherwise("R"), F.lit("-"), F.when(F.col("p_partkey") % 4 == 0, "AC").otherwise("1"))
    return p.select("p_partkey", D.degenerate(q2, q100).alias("degenerate"), D.excluded_reason(region).alias("excluded"), D.runoff_mm(F.col("p_retailprice"), F.col("p_size").cast("double")).alias("runoff"), D.flow_cell(F.col("p_retailprice") * F.col("p_size") / 100).alias("cell"))


def _characteristics(s, d):
    k = F.col("p_partkey")
    size = F.col("p_size").cast("double")
    chars = F.when(k % 3 == 0, F.create_map(F.lit("CONTDA"), size, F.lit("PRECIP"), size + 1)).when(k % 3 == 1, F.create_map(F.lit("DRNAREA"), size, F.lit("LC16FOREST"), size + 2)).otherwise(F.create_map(F.lit("LAT_OUT"), size, F.lit("PRECPRIS20"), size + 3))
    rows = D.characteristics(table(s, d, "part").select("p_partkey", chars.alias("chars"), F.lit(45.5).alias("lat"), F.lit(-110.25).alias("lon")))
    get = lambda c: F.element_at("chars", F.lit(c)).alias(c.lower())
    return rows.select("p_partkey", *(get(c) for c in ("CONTDA", "DRNAREA", "PRECIP", "PRECPRIS10", "FOREST", "LC11FOREST", "LAT_OUT", "LONG_OUT")), F.array_join("substitutions", ",").alias("substitutions"))


def _nested(s, d):
    k = F.col("p_partkey")
    return table(s, d, "part").select(k.alias("upstream"), (k + 1).alias("downstream"), F.when(k % 3 == 0, "nested").when(k % 3 == 1, "colocated").otherwise("none").alias("relation"), (k % 5 == 0).alias("conflict"))


def _codes(s, d):
    equations = s.sql("SELECT * FROM VALUES ('AA', 1, '1', 'Flood region 1 (GC1618)'), ('AA', 2, '2', 'Region 2; GC161, GC1618'), ('AA', 3, 'GC9', CAST(NULL AS STRING)), ('BB', 1, 'x', 'GC9 plains') AS t(state, ord, region, name)")
    k = F.col("p_partkey")
    codes = table(s, d, "part").select("p_partkey", F.when(k % 2 == 0, "AA").otherwise("BB").alias("state"), F.element_at(F.array(F.lit("GC1618"), F.lit("GC161"), F.lit("GC9"), F.lit("GC1")), (k % 4 + 1).cast("int")).alias("code"))
    return D.region_for_code(codes, equations)


def _duration_exponents(s):
    return s.sql("SELECT * FROM VALUES (10, 0.9D), (50, 1.0D), (90, 1.1D) AS t(exceedance, b)")


def _durations(s, d):
    from headwater.operators.duration import duration_statistics

    return duration_statistics(daily(s, d), min_days=300, min_years=2)


def _transposed(s, d):
    rows = _durations(s, d).select("site", "exceedance", F.col("median").alias("flow"), F.lit(100.0).alias("donor_area"), (F.lit(60.0) + F.length("site") * 10).alias("target_area"))
    return D.transpose_duration(rows, _duration_exponents(s))


def _low(s, d):
    m = monthly_peaks(s, d).groupBy("site").agg(F.percentile("flow", F.array(F.lit(0.1), F.lit(0.2), F.lit(0.5))).alias("q"))
    rows = m.select("site", F.explode(F.arrays_zip(F.array(F.lit(0.1), F.lit(0.2), F.lit(0.5)).alias("non_exceedance"), F.col("q").alias("flow"))).alias("x")).select("site", "x.*")
    rows = rows.withColumns({"p_zero": F.lit(0.0), "setting": F.lit("alluvium"), "donor_area": F.lit(100.0), "target_area": F.lit(80.0) + F.length("site") * 4})
    return D.transpose_low_flow(rows, s.sql("SELECT * FROM VALUES (0.1D, 1.2D), (0.2D, 1.1D), (0.5D, 1.0D) AS t(non_exceedance, b)"))


def _months(s, d):
    stats = T.monthly_statistics(daily(s, d), 1).withColumn("log_sd", F.lit(0.1))
    own = table(s, d, "region").select(F.col("r_name").alias("site"), (F.lit(100.0) + F.col("r_regionkey") * 25).alias("area"))
    chain = s.sql("SELECT * FROM VALUES ('AFRICA', 'AMERICA'), ('AMERICA', 'ASIA'), ('ASIA', 'EUROPE'), ('EUROPE', 'MIDDLE EAST') AS t(site, other)")
    return stats, D.keyed_pairs(stats, own, chain, "month")


def _words(s, d):
    k = F.col("p_partkey")
    words = F.array(F.when(k % 2 == 0, "estimated"), F.when(k % 3 == 0, " HISTORIC "), F.when(k % 5 == 0, "DAYUNKNOWN"), F.when(k % 7 == 0, "Estimated"), F.when(k % 11 == 0, "REGULATED"), F.lit("ICE"))
    text = F.when(k % 3 == 0, "forest, Precip, AND ELEV may be inaccurate.").when(k % 3 == 1, "A AND B MAY BE INACCURATE").otherwise("basin may contain karst")
    return table(s, d, "part").select("p_partkey", D.qualifier_codes(words).alias("codes"), F.array_join(D.inaccurate_codes(text), "|").alias("inaccurate"))


def _bounds(s, d):
    k = F.col("p_partkey")
    rows = table(s, d, "part").select(k.cast("string").alias("site"), F.lit(1990).alias("year"), F.col("p_size").cast("double").alias("lower"), F.when(k % 3 == 0, float("inf")).when(k % 3 == 1, F.col("p_size") + 5.5).otherwise(F.col("p_size") * 2.0).alias("upper"))
    open_ = D.perception_bounds(rows).withColumnRenamed("upper", "tu").select("site", F.col("lower").alias("tl"), "tu")
    return D.interval_peaks(rows).join(open_, "site")


def _blocks(s, d):
    k = F.col("p_partkey")
    text = F.when(k % 7 == 0, F.concat(F.lit("## Part "), k)).when(k % 7 == 3, "").when(k % 7 > 4, F.concat(F.lit("- item "), k)).otherwise(F.concat(F.lit("text "), k))
    return D.markdown_blocks(table(s, d, "part").select(F.col("p_brand").alias("report"), k.alias("ord"), text.alias("text"))).select("report", "kind", "level", F.array_join("lines", "|").alias("lines"))


def _captions(s, d):
    k = F.col("p_partkey")
    return D.captions(table(s, d, "part").select(F.col("p_brand").alias("report"), k.alias("ord"), F.when(k % 3 == 0, "table").when(k % 3 == 1, "figure").otherwise("text").alias("kind"), F.when(k % 4 > 0, F.concat(F.lit("c"), k)).alias("caption"))).select("report", "ord", "label")


def _elevations(s, d):
    e = F.col("p_retailprice") * 8
    low, high = D.elevation_shares(e, D.high_boundary_ft(F.lit(39.5)))
    return table(s, d, "part").select("p_partkey", low.alias("low"), high.alias("high"), D.equivalent_years(F.col("p_retailprice") / 500, F.col("p_size"), F.lit(2.0), F.lit(8.0)).alias("weighted"))


def _jurisdictions(s, d):
    from_regions = table(s, d, "region").select(F.substring("r_name", 1, 2).alias("code"), F.col("r_name").alias("name"), (F.col("r_regionkey") % 2).alias("wave"), F.col("r_regionkey").alias("ord"))
    return D.jurisdictions(from_regions.filter("name <> 'AMERICA'"), table(s, d, "region").filter("r_name <> 'AMERICA'").select(F.lower(F.substring("r_name", 1, 2)).alias("code")))


def _estimates(s, d):
    facts = equations(s, d).withColumns({"bias_correction": F.when(F.col("aep") < 0.05, 1.1), "sep_log": F.when(F.col("region") != "Brand#3", 0.2), "n_sites": F.when(F.col("region") == "Brand#1", 13)})
    limits = s.sql("SELECT * FROM VALUES ('Brand#1', 'DRNAREA', 5.0D, 40.0D) AS t(region, code, lo, hi)")
    return T.estimate(facts, chars(s, d), limits, extrapolate=True)


def _smooth(s, d):
    from headwater.operators import estimators as E

    return table(s, d, "part").select("p_partkey", E.smooth_exponent_at(F.col("p_size") / 20 - 1, [(-0.5, 0.8), (0.5, 0.7), (1.2, 0.72)]).alias("exponent"))


def literal(df, columns: list[str], kind: str = "decimal(2,1)"):
    """df with columns of the type that the SQL's literals have; a value that the type can't hold exactly is an error."""
    exact = lambda c: F.when(F.col(c).cast(kind) == F.col(c), F.col(c).cast(kind)).when(F.col(c).isNotNull(), F.raise_error(F.concat(F.lit(f"{c} isn't as in the SQL: "), F.col(c).cast("string"))).cast(kind))
    return df.withColumns({c: exact(c) for c in columns})


def _simple_limits(s, d):
    moments = Q.log_moments(monthly_peaks(s, d)).withColumn("skew", F.lit(0.0)).withColumn("n", F.lit(5)).withColumn("return_period", F.lit(2.0))
    return literal(rounded(D.simple_limits(moments)), ["return_period", "k"])


QUERIES = {
    "f9_estimate_intervals": lambda s, d: rounded(_estimates(s, d), 3),
    "f15_smooth_exponents": lambda s, d: rounded(_smooth(s, d)),
    "g3_conditional_moments": lambda s, d: rounded(Q.conditional_moment_quantiles(monthly_peaks(s, d), (0.9, 0.1, 0.01)), 4),
    "g8_g9_g10_published_fits": _published,
    "a21_a25_catalog": lambda s, d: rounded(D.attributes(D.catalog(_catalog(s, d)).select(F.col("code").alias("site"), "class"), sites(s, d).select(F.col("code").cast("long").cast("string").alias("site"), "lat"))),
    "a26_c15_rules": lambda s, d: rounded(D.rule_table(_rules(s)).select("prefix", F.array_join("states", "|").alias("states"), "value")),
    "c15_value_for_state": lambda s, d: rounded(D.value_for_state(table(s, d, "region").select(F.col("r_name").alias("state")), _regional(s), True)),
    "a30_dams": lambda s, d: rounded(D.dams(_dams(s, d))),
    "c18_storage_in_basins": lambda s, d: rounded(D.storage_in_basins(D.dams(_dams(s, d)), _basins(s), s.sql("SELECT * FROM VALUES ('tri', 1000.0D), ('none', 5.0D) AS t(basin, area_km2)"))),
    "a17_period_of_record": lambda s, d: D.period_of_record(_series(s, d), "00003", "America/Denver"),
    "a24_f29_words": _words,
    "b16_bounds": lambda s, d: rounded(_bounds(s, d)),
    "b18_guards": lambda s, d: _guards(s, d),
    "b19_b23_f32_fits": lambda s, d: rounded(_fits(s, d)),
    "b24_characteristics": lambda s, d: rounded(_characteristics(s, d)),
    "b25_connected": lambda s, d: D.connected(_nested(s, d), drop_conflicts=True, colocated=True),
    "b26_station": lambda s, d: rounded(D.station(monthly_peaks(s, d), "ASIA")),
    "c24_region_for_code": lambda s, d: _codes(s, d).select("p_partkey", "state", "code", "region"),
    "c23_monthly_pairs": lambda s, d: rounded(_months(s, d)[1]),
    "g28_monthly_blend": lambda s, d: rounded(D.keyed_blend(_months(s, d)[1], _months(s, d)[0], "month", (0.02, 0.05))),
    "e13_captions": _captions,
    "e15_jurisdictions": _jurisdictions,
    "f12_elevations": lambda s, d: rounded(_elevations(s, d)),
    "f17_transpose_duration": lambda s, d: rounded(_transposed(s, d)),
    "f18_transpose_low_flow": lambda s, d: rounded(_low(s, d)),
    "f33_markdown_blocks": _blocks,
    "f2_f4_simple_limits": _simple_limits,
    "g25_donor_correlation": lambda s, d: rounded(D.donor_correlation_of_pairs(pairs(s, d, 4), 0.001, (0.01, 0.02))),
}

_CAT = "si AS (SELECT s_name AS site, lpad((s_suppkey * 7919 % 100000)::VARCHAR, 8, '0') AS code, 40.0 + s_suppkey % 13 AS lat, 50.0 + s_suppkey % 97 AS area FROM supplier)"
_STATS = "m AS (SELECT site, year(date) AS y, month(date) AS month, avg(flow) AS mean FROM daily GROUP BY ALL HAVING count(flow) = max(day(last_day(date))) AND avg(flow) > 0), st AS (SELECT site, month, median(mean) AS median, 0.1 AS log_sd, count(*) AS n_years FROM m GROUP BY ALL)"
_KEYED = _STATS + """, ga AS (SELECT r_name AS site, 100.0 + r_regionkey * 25 AS area FROM region), c0(a, b) AS (VALUES ('AFRICA', 'AMERICA'), ('AMERICA', 'ASIA'), ('ASIA', 'EUROPE'), ('EUROPE', 'MIDDLE EAST')), co AS (SELECT a AS donor, b AS receiver FROM c0 UNION ALL SELECT b, a FROM c0),
ow AS (SELECT site, month, log10(median) AS l, pi() / 2 * log_sd ** 2 / n_years AS v, log10(area) AS la FROM st JOIN ga USING (site)),
pr AS (SELECT d.month, donor, receiver, d.l + r.la - d.la - r.l AS error, d.v + r.v AS known, abs(r.la - d.la) AS log_ar, r.l AS observed, r.v AS own FROM co JOIN ow d ON d.site = donor JOIN ow r ON r.site = receiver AND r.month = d.month)"""

ORACLE = {
    "f9_estimate_intervals": """WITH e(region, aep, i) AS (VALUES ('Brand#1', 0.1::DOUBLE, 1.5::DOUBLE), ('Brand#1', 0.01, 1.9), ('Brand#2', 0.1, 1.2), ('Brand#3', 0.1, 1.0)),
q AS (SELECT 'part' || p_partkey AS site, region || '-' || aep AS equation, region, aep, i + 0.75 * log10(p_size) + 1.1 * log10(p_retailprice * 0.01 + 1) AS l, CASE WHEN aep < 0.05 THEN 1.1 ELSE 1.0 END AS b, p_size FROM part JOIN e ON region = p_brand),
w AS (SELECT *, b * pow(10, l) AS f, CASE region WHEN 'Brand#1' THEN 1.8124611228107335 * 0.2 WHEN 'Brand#2' THEN 1.6448536269514722 * 0.2 END AS h FROM q)
SELECT site, equation, aep, round(l, 3) AS log_flow, round(f, 3) AS flow, round(f / pow(10, h), 3) AS lower, round(f * pow(10, h), 3) AS upper, CASE WHEN h IS NOT NULL THEN 0.04::DOUBLE END AS prediction_variance, CASE WHEN region = 'Brand#1' AND (p_size < 5 OR p_size > 40) THEN 'DRNAREA' ELSE '' END AS extrapolated FROM w""",
    "g8_g9_g10_published_fits": f"SELECT site, aep::DOUBLE AS aep, round(y::DOUBLE, 3) AS log_flow, round(lo::DOUBLE, 3) AS log_lower, round(hi::DOUBLE, 3) AS log_upper, round(v::DOUBLE, 4) AS variance_log FROM (VALUES {PUBLISHED}) AS t(site, aep, y, lo, hi, v)",
    "a21_a25_catalog": f"WITH {_CAT} SELECT a.code AS site, CASE a.area::BIGINT % 4 WHEN 0 THEN 'reference' WHEN 1 THEN 'regulated' WHEN 2 THEN 'urban' ELSE 'unknown' END AS class, b.lat::DOUBLE AS lat FROM si a LEFT JOIN si b ON a.code = b.code",
    "a26_c15_rules": "SELECT * FROM (VALUES ('0', 'AA|BB', 0.1::DOUBLE), ('00', 'AA', 0.2), ('00', 'BB', 0.3), ('7', 'CC', 0.4)) AS t(prefix, states, value)",
    "c15_value_for_state": "SELECT r_name AS state, CASE r_name WHEN 'ASIA' THEN 'r1' WHEN 'EUROPE' THEN 'r2' WHEN 'AFRICA' THEN 'r4' END AS region, CASE r_name WHEN 'ASIA' THEN 0.1::DOUBLE WHEN 'EUROPE' THEN 0.2 WHEN 'AFRICA' THEN -0.4 END AS value FROM region",
    "a30_dams": """WITH q AS (SELECT CASE WHEN p_partkey % 5 = 0 THEN '' ELSE 'D' || p_partkey % 400 END AS dam_id, -118.5 + (p_partkey % 90) / 10 AS lon, 40.5 + (p_partkey % 97) / 10 AS lat, p_size::DOUBLE AS storage FROM part WHERE p_partkey % 11 > 0)
SELECT dam_id, round(lon::DOUBLE, 6) AS lon, round(lat::DOUBLE, 6) AS lat, storage FROM q QUALIFY dam_id = '' OR row_number() OVER (PARTITION BY dam_id ORDER BY lon, lat, storage) = 1""",
    "a17_period_of_record": """WITH q AS (SELECT o_orderpriority AS site, o_orderpriority < '3' AND o_orderkey % 3 = 0 AS p, o_orderdate AS b, o_orderdate + INTERVAL 1 DAY AS e FROM orders WHERE o_orderkey % 2 = 0),
k AS (SELECT * FROM q QUALIFY p OR NOT bool_or(p) OVER (PARTITION BY site)) SELECT site, timezone('America/Denver', timezone('UTC', min(b)))::DATE AS first_date, timezone('America/Denver', timezone('UTC', max(e)))::DATE AS last_date FROM k GROUP BY site""",
    "a24_f29_words": """SELECT p_partkey, concat_ws(',', CASE WHEN p_partkey % 2 = 0 THEN '2' END, CASE WHEN p_partkey % 3 = 0 THEN '7' END, CASE WHEN p_partkey % 7 = 0 AND p_partkey % 2 > 0 THEN '2' END, CASE WHEN p_partkey % 11 = 0 THEN '6' END) AS codes,
  CASE p_partkey % 3 WHEN 0 THEN 'FOREST|PRECIP|ELEV' WHEN 1 THEN 'A|B' END AS inaccurate FROM part""",
    "b16_bounds": "SELECT p_partkey::VARCHAR AS site, 1990::BIGINT AS year, p_size::DOUBLE AS lower, CASE p_partkey % 3 WHEN 0 THEN 1e20::DOUBLE WHEN 1 THEN p_size + 5.5 ELSE p_size * 2.0 END AS upper, p_size::DOUBLE AS tl, CASE p_partkey % 3 WHEN 0 THEN 1e20::DOUBLE WHEN 1 THEN p_size + 5.5 ELSE p_size * 2.0 END AS tu FROM part",
    "b18_guards": f"WITH {_CAT}, k AS (SELECT site, CASE area::BIGINT % 4 WHEN 0 THEN 'reference' WHEN 1 THEN 'regulated' WHEN 2 THEN 'urban' ELSE 'unknown' END AS class, CASE WHEN area::BIGINT % 3 > 0 THEN 'reference' END AS target_class FROM si) SELECT site, class AS donor_class, target_class, class, target_class IS NOT NULL AS regulation_checked, target_class IS NOT NULL AND class = 'regulated' AS mismatch, class = 'regulated' AS regulation_override FROM k",
    "b25_connected": "SELECT p_partkey AS upstream, p_partkey + 1 AS downstream FROM part WHERE p_partkey % 3 < 2 AND p_partkey % 5 > 0",
    "b26_station": sql("SELECT site, year, flow FROM mpeaks WHERE site = 'ASIA'", "flow", "year"),
    "b19_b23_f32_fits": """WITH q AS (SELECT *, p_size / 10 AS q2, CASE WHEN p_partkey % 9 > 0 THEN p_retailprice * p_partkey % 4000 END AS q100, p_retailprice * p_size / 100 AS c FROM part)
SELECT p_partkey, q100 IS NULL OR q100 <= 0 OR q2 <= 0 OR q2 < 1 OR q100 / q2 > 1000 AS degenerate, CASE WHEN p_partkey % 7 = 0 THEN 'not a state equation' WHEN p_partkey % 4 = 0 THEN 'needs a measured width' END AS excluded,
  round(p_retailprice * 0.028316846592::DOUBLE * 86400 * 365 / (p_size * 1e6) * 1000, 6) AS runoff,
  CASE WHEN c >= 100 THEN format('{:,}', round_even(c, 0)::BIGINT) WHEN c >= 10 THEN regexp_replace(regexp_replace(printf('%.1f', round(c, 1)), '(\\.\\d*?)0+$', '\\1'), '\\.$', '') ELSE regexp_replace(regexp_replace(printf('%.2f', round(c, 2)), '(\\.\\d*?)0+$', '\\1'), '\\.$', '') END AS cell FROM q""",
    "b24_characteristics": """SELECT p_partkey, CASE WHEN k < 2 THEN s END AS contda, CASE WHEN k < 2 THEN s END AS drnarea, CASE k WHEN 0 THEN s + 1 WHEN 2 THEN s + 3 END AS precip, CASE k WHEN 0 THEN s + 1 WHEN 2 THEN s + 3 END AS precpris10, CASE WHEN k = 1 THEN s + 2 END AS forest, CASE WHEN k = 1 THEN s + 2 END AS lc11forest,
  CASE WHEN k = 2 THEN s ELSE 45.5 END AS lat_out, 110.25::DOUBLE AS long_out, CASE k WHEN 0 THEN 'DRNAREA=CONTDA,PRECPRIS10=PRECIP' WHEN 1 THEN 'CONTDA=DRNAREA,LC11FOREST=LC16FOREST,FOREST=LC16FOREST' ELSE 'PRECPRIS10=PRECPRIS20,PRECIP=PRECPRIS20' END AS substitutions FROM (SELECT *, p_partkey % 3 AS k, p_size::DOUBLE AS s FROM part)""",
    "c24_region_for_code": "WITH k AS (SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 'AA' ELSE 'BB' END AS state, CASE p_partkey % 4 WHEN 0 THEN 'GC1618' WHEN 1 THEN 'GC161' WHEN 2 THEN 'GC9' ELSE 'GC1' END AS code FROM part) SELECT *, CASE WHEN state = 'AA' THEN CASE code WHEN 'GC1618' THEN '1' WHEN 'GC161' THEN '2' WHEN 'GC9' THEN 'GC9' END WHEN code = 'GC9' THEN 'x' END AS region FROM k",
    "c23_monthly_pairs": sql(_KEYED + "\n--\nSELECT month, donor, receiver, error, known, log_ar FROM pr", "error known log_ar", "month"),
    "g28_monthly_blend": sql(_KEYED + "\n--\nSELECT receiver AS site, month, count(*) AS n_donors, pow(10, l) AS median, v AS variance, pow(10, l - 1.6448536269514722 * sqrt(v)) AS lower, pow(10, l + 1.6448536269514722 * sqrt(v)) AS upper FROM (SELECT receiver, month, sum(w * (error + observed)) OVER g / sum(w) OVER g AS l, 1 / sum(w) OVER g AS v FROM (SELECT *, 1 / (known - own + 0.02 + 0.05 * log_ar) AS w FROM pr) WINDOW g AS (PARTITION BY receiver, month)) GROUP BY receiver, month, l, v", "median variance lower upper", "month n_donors"),
    "e13_captions": "WITH q AS (SELECT p_brand AS report, p_partkey AS ord, CASE p_partkey % 3 WHEN 0 THEN 'Table' WHEN 1 THEN 'Figure' ELSE 'text' END AS kind, CASE WHEN p_partkey % 4 > 0 THEN 'c' || p_partkey END AS caption FROM part) SELECT report, ord, CASE WHEN kind <> 'text' AND caption IS NOT NULL THEN kind || ' ' || count(caption) OVER (PARTITION BY report, kind ORDER BY ord) || '. ' || caption END AS label FROM q",
    "e15_jurisdictions": "SELECT substr(r_name, 1, 2) AS code, r_name AS name, (r_regionkey % 2)::BIGINT AS wave, r_regionkey AS ord FROM region WHERE r_name <> 'AMERICA'",
    "f12_elevations": "SELECT p_partkey, round(x, 6) AS low, round(1 - x, 6) AS high, round((p_size * p_retailprice / 500 + 16.0) / (p_size + 8.0), 6) AS weighted FROM (SELECT *, greatest(0.0, least(1.0, (7500 - p_retailprice * 8) / 700)) AS x FROM part)",
    "f17_transpose_duration": sql("""yq AS (SELECT site, wy, list_sort(list(flow)) AS x FROM daily JOIN dense USING (site, date, flow) GROUP BY ALL HAVING count(flow) >= 300),
e(exceedance, b) AS (VALUES (10, 0.9::DOUBLE), (50, 1.0::DOUBLE), (90, 1.1::DOUBLE)), h AS (SELECT site, exceedance, b, x, len(x) AS n, (len(x) + 1) * (1 - exceedance / 100) AS h FROM yq, e),
v AS (SELECT site, exceedance, b, CASE WHEN h <= 1 THEN x[1] WHEN h >= n THEN x[n] ELSE x[greatest(1, least(n - 1, floor(h)))::INT] + (h - greatest(1, least(n - 1, floor(h)))) * (x[greatest(1, least(n - 1, floor(h)))::INT + 1] - x[greatest(1, least(n - 1, floor(h)))::INT]) END AS q FROM h),
st AS (SELECT site, exceedance, b, median(q) AS flow FROM v WHERE q > 0 GROUP BY ALL HAVING count(*) >= 2), sc AS (SELECT *, (60.0 + length(site) * 10) / 100 AS ratio, pow((60.0 + length(site) * 10) / 100, b) AS factor FROM st)
--
SELECT site, exceedance, flow AS donor_flow, b AS exponent, factor, flow * factor AS flow, ratio BETWEEN 0.5 AND 1.5 AS in_band, coalesce(flow * factor <= min(flow * factor) OVER (PARTITION BY site ORDER BY exceedance ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS monotonic FROM sc""", "donor_flow factor flow exponent", "exceedance"),
    "f18_transpose_low_flow": sql("""e(p, b) AS (VALUES (0.1::DOUBLE, 1.2::DOUBLE), (0.2::DOUBLE, 1.1::DOUBLE), (0.5::DOUBLE, 1.0::DOUBLE)), q AS (SELECT site, unnest([0.1::DOUBLE, 0.2::DOUBLE, 0.5::DOUBLE]) AS p, unnest(quantile_cont(flow, [0.1, 0.2, 0.5])) AS flow FROM mpeaks GROUP BY site), sc AS (SELECT site, p, b, (80.0 + length(site) * 4) / 100 AS ratio, flow * pow((80.0 + length(site) * 4) / 100, b) AS flow FROM q JOIN e USING (p))
--
SELECT site, p AS non_exceedance, 'alluvium' AS setting, b AS exponent, flow, ratio BETWEEN 0.5 AND 1.5 AS in_band, coalesce(flow >= max(flow) OVER (PARTITION BY site ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS monotonic FROM sc""", "flow exponent non_exceedance"),
    "f33_markdown_blocks": """WITH l AS (SELECT p_brand AS report, p_partkey AS ord, p_partkey % 7 AS k FROM part), t AS (SELECT *, CASE WHEN k = 0 THEN 'heading' WHEN k = 3 THEN 'blank' WHEN k > 4 THEN 'bullets' ELSE 'paragraph' END AS kind, CASE WHEN k = 0 THEN 'Part ' || ord WHEN k > 4 THEN 'item ' || ord ELSE 'text ' || ord END AS body FROM l),
n AS (SELECT *, CASE WHEN kind = 'heading' OR kind <> coalesce(lag(kind) OVER (PARTITION BY report ORDER BY ord), '') THEN 1 ELSE 0 END AS new FROM t), b AS (SELECT *, sum(new) OVER (PARTITION BY report ORDER BY ord) AS block FROM n)
SELECT report, kind, CASE WHEN kind = 'heading' THEN 2 END::INT AS level, string_agg(body, '|' ORDER BY ord) AS lines FROM b WHERE kind <> 'blank' GROUP BY report, block, kind""",
    "f2_f4_simple_limits": sql("m AS (SELECT site, avg(log10(flow)) AS mean, stddev_samp(log10(flow)) AS sd FROM mpeaks WHERE flow > 0 GROUP BY site)\n--\nSELECT site, 2.0 AS return_period, 0.0 AS k, pow(10, mean) AS flow, pow(10, mean - 2.776445105197793 * sd / sqrt(5)) AS lower, pow(10, mean + 2.776445105197793 * sd / sqrt(5)) AS upper FROM m", "return_period k flow lower upper"),
    "g25_donor_correlation": """WITH si AS (SELECT s_name AS site, substr(lpad((s_suppkey * 7919 % 100000)::VARCHAR, 8, '0'), 1, 4) AS p, log10(50.0 + s_suppkey % 97) AS la, log10(abs(s_acctbal) + 10) AS l FROM supplier),
pr AS (SELECT d.site AS donor, r.site AS receiver, d.l + 0.7 * (r.la - d.la) - r.l AS error, abs(r.la - d.la) AS log_ar FROM si d JOIN si r ON d.p = r.p AND d.site <> r.site),
t AS (SELECT a.error * b.error - 0.001 AS x, sqrt(0.01 + 0.02 * a.log_ar) * sqrt(0.01 + 0.02 * b.log_ar) AS y FROM pr a JOIN pr b ON a.receiver = b.receiver AND a.donor < b.donor)
SELECT CASE WHEN sum(y) > 0 THEN round(greatest(-1.0, least(1.0, sum(x) / sum(y))), 6) END AS correlation, count(*) AS n FROM t""",
}
