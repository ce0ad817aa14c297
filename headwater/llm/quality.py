"""Quality rules with thresholds that follow each language and source, by DataFrame functions only.

Each document's ratios fall into logarithmic bins (a relative width of BIN). Counts of bins by language and source
are a quantile sketch that merges by addition: partial sums before the shuffle, then sums of sketches. A language's
sketch is merged with PRIOR documents that lie as the whole corpus does, and a pair's with PRIOR that lie as its
language's do, so that small groups lean on larger ones and no size changes the way. Cut-offs lie FENCE interquartile
ranges above the upper quartile (or below the lower one), or, where quartiles fall together, a share SPREAD of the
median of all documents that have any of the measure.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from headwater.llm.common import materialize

WHITE = r"[\x20\x09-\x0D]+"
GRAM = 8
BIN, FENCE, SPREAD = 0.02, 3.0, 0.25
#: Documents of the larger group that each group's sketch is merged with.
PRIOR = 50
#: Symbols, and repeated lines, that a text of any length may have.
FREE = 2
#: Measure and side.
RULES = (("symbol_ratio", 1), ("dup_line_ratio", 1), ("mean_word", 1), ("mean_word", -1))


def measured(docs: DataFrame) -> DataFrame:
    """docs and the base measures as columns with two underscores in front."""
    text = F.coalesce("text", F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    one = docs.select("*", F.array_remove(F.split(text, WHITE), "").alias("__words"), lines.alias("__lines"), F.length(F.regexp_replace(text, r"[^#*$%&|<>]+", "")).cast("long").alias("__n_symbols"))
    n = F.size("__words")
    # word by word: slice would copy the whole text for each window
    window = lambda i: F.xxhash64(*(F.get("__words", i + j) for j in range(GRAM)))
    hashes = F.when(n >= GRAM, F.transform(F.sequence(F.lit(0), n - GRAM), window)).otherwise(F.array().cast("array<bigint>"))
    two = one.select(
        *(F.col(f"`{c}`") for c in docs.columns),
        "__n_symbols",
        n.cast("long").alias("__n_words"),
        F.length(F.array_join("__words", "")).cast("long").alias("__word_chars"),
        F.size("__lines").cast("long").alias("__n_lines"),
        (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long").alias("__n_dup_lines"),
        hashes.alias("__h"),
    )
    # where some gram comes twice: (hash, place) in order, then the places whose neighbours have the same hash
    pairs = F.array_sort(F.transform("__h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    none = F.array().cast("array<struct<h:bigint,i:int>>")
    three = two.withColumn("__s", F.when(F.size(F.array_distinct("__h")) < F.size("__h"), pairs).otherwise(none)).drop("__h")
    same = lambda j: F.get("__s", j)["h"]
    again = F.filter("__s", lambda x, j: F.coalesce(same(j + 1) == x["h"], F.lit(False)) | ((j > 0) & F.coalesce(same(F.greatest(j - 1, F.lit(0))) == x["h"], F.lit(False))))
    four = three.withColumn("__p", F.array_sort(F.transform(again, lambda x: x["i"]))).drop("__s")
    steps = F.transform("__p", lambda p, j: F.least(F.lit(GRAM), F.coalesce(F.get("__p", j + 1) - p, F.lit(GRAM))))
    return four.withColumn("__n_repeat_words", F.aggregate(steps, F.lit(0), lambda a, x: a + x).cast("long")).drop("__p")


def base_failed() -> Column:
    return (F.col("__n_words") < 20) | (100 * F.col("__n_repeat_words") > 30 * F.col("__n_words"))


def ratios() -> dict[str, Column]:
    n = F.greatest(F.col("__n_words"), F.lit(1))
    beyond = lambda c: F.greatest(F.col(c) - FREE, F.lit(0))
    return {
        "symbol_ratio": beyond("__n_symbols") / n,
        "dup_line_ratio": beyond("__n_dup_lines") / F.greatest(F.col("__n_lines"), F.lit(1)),
        "mean_word": F.col("__word_chars") / n,
    }


def cutoffs(rows: DataFrame) -> DataFrame:
    """Cut-offs by language and source from rows (lang, source and the measures): one row for each pair."""
    step, zero = math.log1p(BIN), -10_000
    bins = [F.struct(F.lit(m).alias("measure"), F.when(x > 0, F.ceil(F.log(x) / step)).otherwise(zero).cast("int").alias("bin")) for m, x in ratios().items()]
    sketch = rows.select("lang", "source", F.explode(F.array(*bins)).alias("b")).groupBy("lang", "source", "b.measure", "b.bin").agg(F.count(F.lit(1)).cast("decimal(38,0)").alias("n"))
    sketch = materialize(sketch, "sketch")  # some hundred rows for each pair
    whole = "decimal(38,0)"
    value = F.when(F.col("bin") == zero, 0.0).otherwise(F.exp(F.col("bin") * step))

    def quartiles(by: list[str], counts: DataFrame, shares: dict[str, float]) -> DataFrame:
        every = Window.partitionBy(*by)
        upto = every.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
        ranked = counts.select(*by, "bin", F.sum("n").over(upto).alias("upto"), F.sum("n").over(every).alias("total"))
        return ranked.groupBy(*by).agg(*(F.min(F.when(100 * F.col("upto") >= round(100 * share) * F.col("total"), value)).alias(name) for name, share in shares.items()))

    def merged(by: list[str], own: DataFrame, prior: DataFrame, on: list[str]) -> DataFrame:
        """own with PRIOR documents that lie as prior's do. Counts are whole numbers: all are multiplied by prior's total."""
        total = prior.groupBy(*on).agg(F.sum("n").cast(whole).alias("of"))
        groups = own.select(*by).distinct()
        theirs = prior.join(total, on).select(*on, "bin", "of", (F.col("n") * PRIOR).cast(whole).alias("lent"))
        both = groups.join(theirs, on).join(own, [*by, "bin"], "left")
        return both.select(*by, "bin", (F.coalesce("n", F.lit(0).cast(whole)) * F.col("of") + F.col("lent")).cast(whole).alias("n"))

    # null languages and sources are groups like any other; a key that is never null joins them
    key = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c)), F.lit(""))
    pairs = sketch.select(key("lang").alias("l"), key("source").alias("s"), "measure", "bin", "n")
    langs = pairs.groupBy("l", "measure", "bin").agg(F.sum("n").cast(whole).alias("n"))
    corpus = pairs.groupBy("measure", "bin").agg(F.sum("n").cast(whole).alias("n"))
    langs = merged(["l", "measure"], langs, corpus, ["measure"])
    pairs = merged(["l", "s", "measure"], pairs, langs, ["l", "measure"])
    cells = quartiles(["l", "s", "measure"], pairs, {"lo": 0.25, "hi": 0.75})
    middle = quartiles(["measure"], corpus.filter(F.col("bin") > zero), {"middle": 0.5})
    cells = cells.join(F.broadcast(middle), "measure", "left")  # a row for each measure
    cuts = []
    for k, (m, side) in enumerate(RULES):
        spread = F.greatest(FENCE * (F.col("hi") - F.col("lo")), SPREAD * F.coalesce("middle", F.lit(0.0)))
        cuts.append(F.max(F.when(F.col("measure") == m, F.col("hi") + spread if side > 0 else F.col("lo") - spread)).alias(f"__cut{k}"))
    return cells.groupBy("l", "s").agg(*cuts)


def judged(rows: DataFrame) -> DataFrame:
    """rows (from measured) joined with their group's cut-offs; adds __base_failed and __kept."""
    key = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c)), F.lit(""))
    cuts = materialize(cutoffs(rows), "cutoffs")  # a table of known size: the engine sends it whole if it is small
    cuts = cuts.select(F.col("l").alias("__l"), F.col("s").alias("__s"), *(f"__cut{k}" for k in range(len(RULES))))
    joined = rows.join(cuts, (key("lang") == F.col("__l")) & (key("source") == F.col("__s")), "left")
    measures, out = ratios(), F.lit(False)
    for k, (m, side) in enumerate(RULES):
        beyond = measures[m] > F.col(f"__cut{k}") if side > 0 else measures[m] < F.col(f"__cut{k}")
        out = out | F.coalesce(beyond, F.lit(False))
    return joined.withColumn("__base_failed", base_failed()).withColumn("__kept", ~F.col("__base_failed") & ~out)


def scores(docs: DataFrame) -> DataFrame:
    """Measures and verdict of each document: one row per row of docs.

    docs: doc_id, text, lang, source (more columns are ignored). Returns doc_id, n_words, word_chars, n_symbols,
    n_dup_lines, n_repeat_words, base_failed and kept. Words are runs of other characters than ASCII white space. A
    null or empty text has none, and fails. Null languages or sources form groups of their own. Repeated rows get
    equal rows and count in the sketches each. 8-word windows are compared by 64-bit hashes within one document.
    """
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    rows = measured(docs.select("doc_id", "text", "lang", "source")).drop("text")
    done = judged(materialize(rows, "measures"))
    return done.select("doc_id", *(F.col(f"__{n}").alias(n) for n in names), F.col("__base_failed").alias("base_failed"), F.col("__kept").alias("kept"))


def keep(docs: DataFrame) -> DataFrame:
    """The rows of docs, with all their columns (but for those named as `measured` names its own), that are kept."""
    own = [f"`{c}`" for c in docs.columns]
    return judged(materialize(measured(docs), "measures")).filter("__kept").select(*own)


def query(spark, sf_dir: str) -> DataFrame:
    return scores(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = r"""
WITH d AS (SELECT doc_id, lang, source, coalesce(text, '') AS t, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
  list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM documents),
win AS (SELECT doc_id, i, array_to_string(ws[i:i + 7], ' ') AS k FROM d, unnest(range(1, len(ws) - 6)) AS r(i)),
twice AS (SELECT doc_id, k FROM win GROUP BY ALL HAVING count(*) > 1),
rep AS (SELECT doc_id, count(DISTINCT i + j) AS n FROM win JOIN twice USING (doc_id, k), range(8) AS r(j) GROUP BY doc_id),
m AS (SELECT doc_id, lang, source, len(ws) AS n_words, length(array_to_string(ws, '')) AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS n_symbols,
  len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words, len(ls) AS n_lines FROM d LEFT JOIN rep USING (doc_id)),
r AS (SELECT *, greatest(n_symbols - 2, 0) / greatest(n_words, 1) AS symbol_ratio, greatest(n_dup_lines - 2, 0) / greatest(n_lines, 1) AS dup_line_ratio, word_chars / greatest(n_words, 1) AS mean_word FROM m),
b AS (SELECT lang, source, measure, CASE WHEN x > 0 THEN ceil(ln(x) / ln(1.02::DOUBLE)) ELSE -10000 END AS bin FROM (UNPIVOT (SELECT lang, source, symbol_ratio, dup_line_ratio, mean_word FROM r) ON symbol_ratio, dup_line_ratio, mean_word INTO NAME measure VALUE x)),
p AS (SELECT lang, source, measure, bin, count(*)::HUGEINT AS n FROM b GROUP BY ALL), l AS (SELECT lang, measure, bin, sum(n) AS n FROM p GROUP BY ALL), c AS (SELECT measure, bin, sum(n) AS n FROM p GROUP BY ALL),
l2 AS (SELECT lang, measure, c.bin, coalesce(l.n, 0) * t.n + 50 * c.n AS n FROM (SELECT DISTINCT lang, measure FROM l) JOIN c USING (measure) JOIN (SELECT measure, sum(n) AS n FROM c GROUP BY ALL) t USING (measure) LEFT JOIN l USING (lang, measure, bin)),
p2 AS (SELECT lang, source, measure, l2.bin, coalesce(p.n, 0) * t.n + 50 * l2.n AS n FROM (SELECT DISTINCT lang, source, measure FROM p) JOIN l2 USING (lang, measure) JOIN (SELECT lang, measure, sum(n) AS n FROM l2 GROUP BY ALL) t USING (lang, measure) LEFT JOIN p USING (lang, source, measure, bin)),
v AS (SELECT *, CASE WHEN bin = -10000 THEN 0 ELSE exp(bin * ln(1.02::DOUBLE)) END AS v, sum(n) OVER (PARTITION BY lang, source, measure ORDER BY bin) AS upto, sum(n) OVER (PARTITION BY lang, source, measure) AS total FROM p2),
w AS (SELECT measure, exp(bin * ln(1.02::DOUBLE)) AS v, sum(n) OVER (PARTITION BY measure ORDER BY bin) AS upto, sum(n) OVER (PARTITION BY measure) AS total FROM c WHERE bin > -10000),
q AS (SELECT lang, source, measure, min(CASE WHEN 100 * upto >= 25 * total THEN v END) AS lo, min(CASE WHEN 100 * upto >= 75 * total THEN v END) AS hi FROM v GROUP BY ALL),
f AS (SELECT *, greatest(3 * (hi - lo), 0.25 * coalesce(middle, 0)) AS spread FROM q LEFT JOIN (SELECT measure, min(v) AS middle FROM w WHERE 100 * upto >= 50 * total GROUP BY ALL) USING (measure)),
x AS (SELECT lang, source, max(CASE WHEN measure = 'symbol_ratio' THEN hi + spread END) AS c0, max(CASE WHEN measure = 'dup_line_ratio' THEN hi + spread END) AS c1, max(CASE WHEN measure = 'mean_word' THEN hi + spread END) AS c2, max(CASE WHEN measure = 'mean_word' THEN lo - spread END) AS c3 FROM f GROUP BY ALL)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
  NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND NOT (symbol_ratio > c0 OR dup_line_ratio > c1 OR mean_word > c2 OR mean_word < c3) AS kept
FROM r JOIN x USING (lang, source)
"""
