"""URL filters by hashed host-suffix and path-prefix expressions, by DataFrame functions only.

Each distinct host and path is expanded into the expressions that rules of the table's shapes could have (host labels
from the right, characters of the path from the left). Expressions join the rules on a short prefix of their digest;
the full digest confirms, and the longest rule decides.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The rules of the contract.
RULES = (
    ("com", "/en/", "block"),
    ("example.com", "/en/7", "allow"),
    ("net", "/de/", "allow"),
    ("example.net", "/de/8", "block"),
    ("org", "/es/", "block"),
)
PREFIX = 8  # hexadecimal digits
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def parts(url: Column) -> tuple[Column, Column]:
    """(host, path) of a URL: what stands between the first :// and /, ?, # or the end, lower-cased; then up to ? or #."""
    at = F.instr(url, "://")
    tail = F.when(at > 0, url.substr(at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.regexp_extract(tail, r"^[^/?#]*", 0)
    path = F.regexp_extract(tail.substr(F.length(host) + 1, F.length(tail)), r"^[^?#]*", 0)
    return F.coalesce(F.translate(host, UPPER, LOWER), F.lit("")), F.coalesce(path, F.lit(""))


def rule_table(spark, rules=RULES) -> DataFrame:
    quoted = ", ".join("('%s', '%s', '%s')" % tuple(x.replace("\\", "\\\\").replace("'", "\\'") for x in r) for r in rules)
    return spark.sql(f"SELECT * FROM VALUES {quoted} AS t(host, path, verdict)")


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """The verdict on each row's url.

    pages: page_id, url (more columns are ignored); rules: host, path, verdict (block or allow). A rule fits its host
    and all subdomains if the path starts with the rule's. The longest rule (host and path) wins; of equally long
    ones the one with the longer host, then block. Returns page_id, host, path, rule (host and path together, else
    null) and verdict, one row per row of pages. A null url, or one without ://, has empty host and path, which no
    rule fits. Rules with an empty host or a null are ignored. URLs are judged once for each distinct host and path,
    so hot ones join once. The table's shapes (labels of the host, length of the path) are collected; their number
    doesn't grow with the rules.
    """
    host, path = parts(F.col("url"))
    urls = pages.select("page_id", host.alias("host"), path.alias("path"))
    ours = rules.filter("host <> '' AND path IS NOT NULL AND verdict IS NOT NULL").select(F.col("host").alias("r_host"), F.col("path").alias("r_path"), F.col("verdict").alias("r_verdict"))
    shapes = ours.select(F.size(F.split("r_host", r"\.", -1)).alias("labels"), F.length("r_path").alias("chars")).distinct().collect()
    text = F.concat("r_host", "r_path")
    ours = ours.select("*", text.alias("r_rule"), F.sha2(text, 256).alias("r_digest")).withColumn("prefix", F.substring("r_digest", 1, PREFIX))
    if not shapes:
        return urls.select("*", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    distinct = urls.filter("host <> ''").select("host", "path").distinct()
    # the shapes are one literal, however many there are
    table = F.from_json(F.lit(json.dumps([[s["labels"], s["chars"]] for s in shapes])), "array<array<int>>")
    fits = F.filter(table, lambda s: (F.size(F.split("host", r"\.", -1)) >= s[0]) & (F.length("path") >= s[1]))
    expressions = F.transform(fits, lambda s: F.concat(F.call_function("substring_index", F.col("host"), F.lit("."), -s[0]), F.substring(F.col("path"), F.lit(1), s[1])))
    each = distinct.select("*", F.explode(expressions).alias("expression"))
    each = each.select("host", "path", F.sha2("expression", 256).alias("digest")).withColumn("prefix", F.substring("digest", 1, PREFIX))
    found = each.join(ours, "prefix").filter("digest = r_digest")
    order = F.struct(F.length("r_rule").alias("a"), F.length("r_host").alias("b"), (F.col("r_verdict") == "block").alias("c"), F.col("r_rule").alias("rule"), F.col("r_verdict").alias("verdict"))
    best = found.groupBy("host", "path").agg(F.max(order).alias("best"))
    return urls.join(best, ["host", "path"], "left").select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))


def query(spark, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet"), rule_table(spark))


SQL = r"""
WITH t AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
u AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') AS path FROM t),
r(h, p, v) AS (VALUES ('com', '/en/', 'block'), ('example.com', '/en/7', 'allow'), ('net', '/de/', 'allow'), ('example.net', '/de/8', 'block'), ('org', '/es/', 'block')),
m AS (SELECT page_id, host, path, arg_max(h || p, length(h || p)) AS rule, arg_max(v, length(h || p)) AS v FROM u JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY ALL)
SELECT u.page_id, u.host, u.path, rule, coalesce(v, 'allow') AS verdict FROM u LEFT JOIN m USING (page_id)
"""
