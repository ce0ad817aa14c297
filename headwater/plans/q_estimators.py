"""Queries: estimators over suppliers as gages, parts as candidates, and the regions' daily series."""

from __future__ import annotations

from pyspark.sql import functions as F

from headwater.operators import estimators as E
from headwater.operators.regime import SEASONS
from headwater.plans.common import rounded, sql
from headwater.plans.q_transfer import _basins, gages, pairs, sites
from headwater.plans.tables import daily, table


def _gages(s, d):
    return sites(s, d).select(F.substring("code", 8, 1).alias("region"), "site", F.col("log_flow").alias("y"), F.lit(0.01).alias("variance"), F.log10("area").alias("log_area"), "lat")


def _parts(s, d):
    p, k = table(s, d, "part"), F.col("p_partkey")
    return p.select(
        F.concat(F.lit("p"), k).alias("site"), F.when(k % 3 == 0, "reference").when(k % 3 == 1, "altered").alias("screen_class"), (F.col("p_size") * 5.0).alias("storage_days"), (k % 10).cast("double").alias("impervious_pct"),
        F.when(k % 7 == 0, 0.2).otherwise(0.0).alias("code_share"), (k % 11 == 0).alias("diversion"),
    )


def _dams(s, d):
    return table(s, d, "part").select(F.col("p_brand").alias("site"), (F.lit(1950) + F.col("p_size")).alias("year"), F.col("p_retailprice").alias("storage"))


def _choice(s, d):
    k = F.col("p_partkey")
    return table(s, d, "part").select(F.floor(k / 3).cast("string").alias("site"), F.col("p_brand").alias("region"), (F.lit(20.0) + F.col("p_size")).alias("percent"), (k % 2).alias("preference"), (k % 5 != 0).alias("gate_ok"))


def _relation(s, d):
    k = F.col("p_partkey")
    return table(s, d, "part").select(k.cast("string").alias("site"), F.lit("o").alias("other"), F.col("p_size").cast("double").alias("area"), F.lit(25.0).alias("other_area"), (k % 2 == 0).alias("in_other"), (k % 3 == 0).alias("holds_other"))


def _band(s, d):
    c = table(s, d, "part").select("p_partkey", (F.col("p_size") / 100).alias("regression_variance"), F.lit(0.05).alias("gage_variance"), F.lit(0.01).alias("nugget"), F.when(F.col("p_partkey") % 2 == 0, 0.3).otherwise(0.0).alias("exponent_variance"), F.lit(0.4).alias("slope"))
    return E.band(c)


def _offsets(s, d):
    o = s.sql("SELECT * FROM VALUES ('ASIA', 'EUROPE', 0.1D), ('AFRICA', 'AMERICA', -0.2D) AS t(a, b, offset)")
    r = table(s, d, "region")
    return E.pair_lookup(o, r.select(F.col("r_name").alias("a")).join(r.select(F.col("r_name").alias("b")), F.col("a") != F.col("b")))


def _checks(s, d):
    p = table(s, d, "part")
    z = F.col("p_size") / 20 - 1
    return p.select(
        "p_partkey", E.percent_error_to_log(F.col("p_size").cast("double")).alias("log_se"), E.discrepancy(F.col("p_retailprice") / 1000, F.lit(0.1), F.lit(1.0), F.lit(0.2)).alias("discrepancy"),
        E.exponent_at(z, [(-0.5, 0.8), (0.5, 0.7), (1.2, 0.55)]).alias("held"), E.exponent_at(z, [(-0.5, 0.8), (0.5, 0.7), (1.2, 0.55)], "linear").alias("continued"),
    )


def _left_out(s, d):
    own = gages(s, d).select(F.lit("all").alias("group"), "site", "log_flow", "variance", (F.lit(2.0) + F.col("area") / 200).alias("regression"), F.lit(0.05).alias("regression_variance"))
    return E.leave_one_out(pairs(s, d, 4).withColumn("group", F.lit("all")), own, 0.1)


QUERIES = {
    "f24_probability_transfer": lambda s, d: rounded(E.probability_transfer(daily(s, d), daily(s, d), E.best_donors(daily(s, d)))),
    "c6_transfer_scores": lambda s, d: rounded(E.transfer_scores(daily(s, d), SEASONS)),
    "g20_fit_gls": lambda s, d: rounded(E.fit_gls(_gages(s, d), ("log_area", "lat"), 0.2)),
    "g21_regional_skew": lambda s, d: rounded(E.regional_skew(sites(s, d).select(F.substring("code", 8, 1).alias("region"), "site", (F.col("log_flow") - 3).alias("skew"), (F.lit(20) + F.length("site")).alias("n"), F.log10("area").alias("log_area")), ("log_area",), 0.1)),
    "g23_fit_dissimilarity": lambda s, d: rounded(E.fit_dissimilarity(pairs(s, d).withColumn("group", F.lit("all")))),
    "g24_blend": lambda s, d: rounded(E.blend(pairs(s, d).select(F.col("receiver").alias("target"), F.col("error").alias("estimate"), F.col("known").alias("variance")), 0.1)),
    "g26_band": lambda s, d: rounded(_band(s, d)),
    "g27_leave_one_out": lambda s, d: rounded(_left_out(s, d)),
    "b17_classify_sites": lambda s, d: E.classify_sites(_parts(s, d)),
    "d38_storage_events": lambda s, d: rounded(E.storage_events(_dams(s, d))),
    "d45_share_inside": lambda s, d: rounded(E.share_inside(s.sql("SELECT 'tri' AS basin, lon / 10 AS lon, lat / 10 AS lat FROM (SELECT lon, explode(sequence(405, 505, 5)) AS lat FROM (SELECT explode(sequence(-1185, -1095, 5)) AS lon))"), _basins(s))),
    "d48_mean_flow": lambda s, d: rounded(E.mean_flow(daily(s, d), 300)),
    "e12_g31_region_choice": lambda s, d: rounded(E.region_choice(_choice(s, d))),
    "c25_pair_lookup": lambda s, d: rounded(_offsets(s, d)),
    "c19_relation": lambda s, d: E.relation(_relation(s, d)),
    "f14_f15_f30_checks": lambda s, d: rounded(_checks(s, d)),
}

ORACLE = {
    "g26_band": """WITH b AS (SELECT p_partkey, p_size / 100 AS rv, CASE WHEN p_partkey % 2 = 0 THEN 0.3::DOUBLE ELSE 0.0 END AS ev, p_size / 100 - 0.05::DOUBLE - 0.01::DOUBLE AS gap FROM part),
l AS (SELECT *, CASE WHEN gap <= 0 THEN 0.0 WHEN ev <= 0 THEN gap / 0.4 ELSE (-0.4 + sqrt(0.4 * 0.4 + 4 * ev * gap)) / (2 * ev) END AS lr FROM b)
SELECT p_partkey, round(rv, 6) AS regression_variance, 0.05::DOUBLE AS gage_variance, 0.01::DOUBLE AS nugget, round(ev, 6) AS exponent_variance, 0.4::DOUBLE AS slope, round(lr::DOUBLE, 6) AS log_ratio, round(pow(10, lr), 6) AS ratio FROM l""",
    "b17_classify_sites": """WITH p AS (SELECT 'p' || p_partkey AS site, CASE p_partkey % 3 WHEN 0 THEN 'reference' WHEN 1 THEN 'altered' END AS sc, p_size * 5.0 AS st, p_partkey % 10 AS im, p_partkey % 7 = 0 AS co, p_partkey % 11 = 0 AS di FROM part)
SELECT site, CASE WHEN co OR di THEN 'regulated' WHEN sc = 'reference' THEN 'reference' WHEN st > 127.8 THEN 'regulated' WHEN im > 5 THEN 'urban' ELSE coalesce(sc, 'unknown') END AS class,
  concat_ws(', ', CASE WHEN co THEN 'peak codes' END, CASE WHEN di THEN 'diversion' END, CASE WHEN st > 127.8 THEN 'storage' END, CASE WHEN im > 5 THEN 'impervious' END) AS basis FROM p""",
    "d38_storage_events": """WITH y AS (SELECT p_brand AS site, 1950 + p_size AS year, sum(p_retailprice) AS s FROM part GROUP BY ALL),
r AS (SELECT site, year, sum(s) OVER (PARTITION BY site ORDER BY year) / sum(s) OVER (PARTITION BY site) AS upto FROM y),
b AS (SELECT *, coalesce(lag(upto) OVER (PARTITION BY site ORDER BY year), 0.0) AS before FROM r)
SELECT site, year::BIGINT AS year, round(upto, 6) AS upto FROM b WHERE floor(round(upto / 0.1::DOUBLE, 9)) > floor(round(before / 0.1::DOUBLE, 9))""",
    "d48_mean_flow": sql("y AS (SELECT site, wy, sum(flow) AS t, count(flow) AS n FROM dense GROUP BY ALL HAVING count(flow) >= 300)\n--\nSELECT site, sum(t) / sum(n) AS mean_flow, count(*) AS n_years FROM y GROUP BY site", "mean_flow"),
    "e12_g31_region_choice": """WITH c AS (SELECT (p_partkey // 3)::VARCHAR AS site, p_brand AS region, 20.0::DOUBLE + p_size AS percent, p_partkey % 2 AS preference FROM part WHERE p_partkey % 5 <> 0),
k AS (SELECT *, sum(percent) OVER (PARTITION BY site) AS total, row_number() OVER (PARTITION BY site ORDER BY preference, percent DESC, region) AS k FROM c)
SELECT site, region, round(total, 6) AS total, CASE WHEN total > 100.5 THEN 'overlapping' WHEN total < 99.5 THEN 'partial' ELSE 'complete' END AS status FROM k WHERE k = 1""",
    "c25_pair_lookup": "WITH o(a, b, x) AS (VALUES ('ASIA', 'EUROPE', 0.1::DOUBLE), ('AFRICA', 'AMERICA', -0.2::DOUBLE), ('EUROPE', 'ASIA', -0.1), ('AMERICA', 'AFRICA', 0.2)) SELECT p.r_name AS a, q.r_name AS b, x AS \"offset\" FROM region p JOIN region q ON p.r_name <> q.r_name LEFT JOIN o ON o.a = p.r_name AND o.b = q.r_name",
    "c19_relation": """WITH r AS (SELECT p_partkey::VARCHAR AS site, 'o' AS other, p_size::DOUBLE AS a, p_partkey % 2 = 0 AS i, p_partkey % 3 = 0 AS h, abs(p_size - 25) <= 0.02 * greatest(p_size, 25) AS near FROM part)
SELECT site, other, CASE WHEN near AND (i OR h) THEN 'colocated' WHEN i AND a < 25 THEN 'upstream' WHEN h AND a > 25 THEN 'downstream' ELSE 'none' END AS relation, i AND h AND NOT near AS conflict FROM r""",
    "f14_f15_f30_checks": """WITH z AS (SELECT *, p_size / 20 - 1 AS z FROM part)
SELECT p_partkey, round(sqrt(ln(1 + (p_size / 100) ** 2)) / ln(10), 6) AS log_se, round(abs(p_retailprice / 1000 - 1) / (1.6448536269514722 * sqrt(0.01 + 0.04)), 6) AS discrepancy,
  round((CASE WHEN z < -0.5 THEN 0.8 WHEN z <= 0.5 THEN 0.8 - 0.1 * (z + 0.5) WHEN z <= 1.2 THEN 0.7 - 0.15 * (z - 0.5) / 0.7 ELSE 0.55 END)::DOUBLE, 6) AS held,
  round((CASE WHEN z <= 0.5 THEN 0.8 - 0.1 * (z + 0.5) ELSE 0.7 - 0.15 * (z - 0.5) / 0.7 END)::DOUBLE, 6) AS continued FROM z""",
}
