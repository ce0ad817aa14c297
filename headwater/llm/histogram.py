"""Exact token-length histogram: totals, quantiles and truncated totals for every context limit by suffix sums."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from headwater.llm.common import materialize
from headwater.llm.tokens import VOCABULARY, token_counts

#: Lengths of one bucket; sums run within buckets, and over the buckets' totals.
BUCKET = 256


def limits(counts: DataFrame) -> DataFrame:
    """A row for each length that occurs, from counts (n_tokens; null lengths count as 0).

    n_tokens; n_docs and sum_tokens of this length; docs_at_least and tokens_at_least of this length or more;
    docs_below and tokens_below; truncated_tokens, what is left if every document is cut at this length; and
    quantile, the share of documents of at most this length. Rows per length stay after one partial aggregation,
    so a length that a third of all documents have is one row. An empty table gives no rows.
    """
    hist = (
        counts.groupBy(F.coalesce("n_tokens", F.lit(0)).cast("long").alias("n_tokens"))
        .agg(F.count(F.lit(1)).alias("n_docs"))
        .withColumn("sum_tokens", F.col("n_tokens") * F.col("n_docs"))
        .withColumn("bucket", F.floor(F.col("n_tokens") / BUCKET))
    )
    hist = materialize(hist, "lengths")  # a row for each length; else each use would encode all texts again
    up = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    totals = hist.groupBy("bucket").agg(F.sum("n_docs").alias("d"), F.sum("sum_tokens").alias("t"))
    grand = totals.select(
        "bucket",
        F.coalesce(F.sum("d").over(up), F.lit(0)).alias("d0"),
        F.coalesce(F.sum("t").over(up), F.lit(0)).alias("t0"),
        F.sum("d").over(Window.partitionBy()).alias("all_d"),
        F.sum("t").over(Window.partitionBy()).alias("all_t"),
    )
    within = Window.partitionBy("bucket").orderBy("n_tokens").rowsBetween(Window.unboundedPreceding, -1)
    below = lambda c, base: (F.coalesce(F.sum(c).over(within), F.lit(0)) + F.col(base)).cast("long")
    rows = hist.join(grand, "bucket").select("*", below("n_docs", "d0").alias("docs_below"), below("sum_tokens", "t0").alias("tokens_below"))
    at_least = F.col("all_d") - F.col("docs_below")
    return rows.select(
        "n_tokens",
        "n_docs",
        "sum_tokens",
        at_least.cast("long").alias("docs_at_least"),
        (F.col("all_t") - F.col("tokens_below")).cast("long").alias("tokens_at_least"),
        "docs_below",
        "tokens_below",
        (F.col("tokens_below") + F.col("n_tokens") * at_least).cast("long").alias("truncated_tokens"),
        ((F.col("docs_below") + F.col("n_docs")) / F.col("all_d")).alias("quantile"),
    )


def histogram(docs: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """limits() of the encoded lengths of docs (doc_id, text); a null or empty text has 0 tokens."""
    return limits(token_counts(docs, path))


def query(spark, sf_dir: str) -> DataFrame:
    return histogram(spark.read.parquet(f"{sf_dir}/documents.parquet"))
