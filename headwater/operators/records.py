"""Pairs of records: maintenance of variance extension, donors, lags, flow and stage, naturalisation.

Records are site-keyed; pairs are formed by an equi-join on the date (or water year), never day by day.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def concurrent(short: DataFrame, index: DataFrame, on: str = "date", pairs: DataFrame | None = None) -> DataFrame:
    """Rows that both have: site and donor, y and x. With pairs (site, donor) only theirs, joined by donor and date; without,
    each site meets every other on a date, which is meant for few of them."""
    y = short.filter("flow IS NOT NULL").select("site", on, F.col("flow").alias("y"))
    x = index.filter("flow IS NOT NULL").select(F.col("site").alias("donor"), on, F.col("flow").alias("x"))
    return y.join(x, on) if pairs is None else y.join(pairs.select("site", "donor"), "site").join(x, ["donor", on])


def fit_extension(short: DataFrame, index: DataFrame, min_concurrent: int = 10) -> DataFrame:
    """Moments and correlation of the logs of concurrent positive pairs, for each site and donor; reason if unfit."""
    pairs = concurrent(short, index)
    ok = (F.col("y") > 0) & (F.col("x") > 0)
    ly, lx = F.when(ok, F.log10("y")), F.when(ok, F.log10("x"))
    fit = pairs.groupBy("site", "donor").agg(
        F.avg(ly).alias("mean_short"), F.stddev_samp(ly).alias("sd_short"), F.avg(lx).alias("mean_index"), F.stddev_samp(lx).alias("sd_index"),
        F.corr(ly, lx).alias("correlation"), F.count(F.when(ok, 1)).alias("n_concurrent"), F.count(F.when(~ok, 1)).alias("n_excluded"),
    )
    reason = F.when(F.col("n_concurrent") < min_concurrent, "too few pairs").when(~((F.col("sd_short") > 0) & (F.col("sd_index") > 0)), "no variation").when(~(F.col("correlation") > 0), "no positive correlation")
    return fit.withColumn("reason", reason)


def predict(x: Column) -> Column:
    """The extension's estimate from the fit's columns; null for a flow that isn't positive."""
    slope = F.signum("correlation") * F.col("sd_short") / F.col("sd_index")
    return F.when(x > 0, F.pow(F.lit(10.0), F.col("mean_short") + slope * (F.log10(x) - F.col("mean_index"))))


def extend(short: DataFrame, index: DataFrame, min_concurrent: int = 10) -> DataFrame:
    """Both records' dates: the observed flow where there is one, else the estimate, else none.

    index is one donor's record; each site of short is extended by it.
    """
    fit = fit_extension(short, index, min_concurrent).filter("reason IS NULL")
    every = fit.join(index.select(F.col("site").alias("donor"), "date", F.col("flow").alias("x")), "donor")
    estimated = every.select("site", "date", predict(F.col("x")).alias("estimate"))
    observed = short.filter("flow IS NOT NULL").join(fit.select("site"), "site", "left_semi").select("site", "date", "flow")
    rows = observed.join(estimated, ["site", "date"], "full")
    source = F.when(F.col("flow").isNotNull(), "observed").when(F.col("estimate").isNotNull(), "move1").otherwise("none")
    return rows.select("site", "date", F.coalesce("flow", "estimate").alias("flow"), source.alias("source"))


def _ranked(rows: DataFrame, keys: list[str], column: str, out: str) -> DataFrame:
    ties = Window.partitionBy(*keys, column)
    return rows.withColumn(out, F.rank().over(Window.partitionBy(*keys).orderBy(column)) + (F.count(F.lit(1)).over(ties) - 1) / 2)


def rank_donors(target: DataFrame, candidates: DataFrame, min_concurrent: int = 365, among: DataFrame | None = None) -> DataFrame:
    """Log Pearson and rank correlation with each donor (of the pairs in among, if given) over days positive at both."""
    pairs = concurrent(target, candidates, pairs=among).filter("y > 0 AND x > 0 AND site <> donor")
    keys = ["site", "donor"]
    pairs = _ranked(_ranked(pairs, keys, "y", "ry"), keys, "x", "rx")
    return pairs.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_concurrent"), F.corr(F.log10("y"), F.log10("x")).alias("pearson_log"), F.corr("ry", "rx").alias("spearman"), (F.count(F.lit(1)) >= min_concurrent).alias("sufficient")
    )


def lag_profile(target: DataFrame, donor: DataFrame, max_lag: int = 45) -> DataFrame:
    """Rank correlation with the donor moved by each number of days; the donor's rows are repeated once per lag."""
    moved = donor.filter("flow IS NOT NULL").select(F.col("site").alias("donor"), "date", F.col("flow").alias("x"), F.explode(F.sequence(F.lit(-max_lag), F.lit(max_lag))).alias("lag_days"))
    moved = moved.withColumn("date", F.date_add("date", F.col("lag_days")))
    pairs = target.filter("flow IS NOT NULL").select("site", "date", F.col("flow").alias("y")).join(moved, "date").filter("site <> donor")
    keys = ["site", "donor", "lag_days"]
    pairs = _ranked(_ranked(pairs, keys, "y", "ry"), keys, "x", "rx")
    return pairs.groupBy(*keys).agg(F.corr("ry", "rx").alias("spearman"), F.count(F.lit(1)).alias("n_concurrent"))


def best_lag(profile: DataFrame) -> DataFrame:
    """The lag with the highest rank correlation of each pair; of equal ones the shortest."""
    by = F.struct(F.coalesce("spearman", F.lit(-2.0)), -F.abs("lag_days"), "lag_days")
    return profile.groupBy("site", "donor").agg(F.max_by(F.struct("lag_days", "spearman", "n_concurrent"), by).alias("x")).select("site", "donor", "x.*")


def concurrent_relation(short: DataFrame, index: DataFrame, split_year: int | None = None) -> DataFrame:
    """Median ratio, log deviation and correlation over the first and second half of the concurrent years, and all; with a
    split year, before it and from it on."""
    pairs = concurrent(short, index, "year").filter("y > 0 AND x > 0")
    by = Window.partitionBy("site", "donor")
    pairs = pairs.withColumn("k", F.row_number().over(by.orderBy("year")) - 1).withColumn("n", F.count(F.lit(1)).over(by))
    early = F.col("k") < F.floor(F.col("n") / 2) if split_year is None else F.col("year") < split_year
    half = F.when(early, "first").otherwise("second")
    rows = pairs.withColumn("part", F.explode(F.array(half, F.lit("all")))).withColumn("ratio", F.log10("y") - F.log10("x"))
    return rows.groupBy("site", "donor", "part").agg(
        F.min("year").alias("start"), F.max("year").alias("end"), F.count(F.lit(1)).alias("n"), F.pow(F.lit(10.0), F.median("ratio")).alias("median_ratio"), F.stddev_samp("ratio").alias("ratio_log_sd"),
        F.when(F.count(F.lit(1)) >= 3, F.corr(F.log10("x"), F.log10("y"))).alias("correlation"),
    )


def extension_statistics(short: DataFrame, index: DataFrame) -> DataFrame:
    """Two-station comparison of short and index peaks: n1 concurrent and n2 additional years, augmented mean and
    variance, and the effective record lengths of both."""
    y, x = (d.filter("flow > 0").select("site", "year", F.log10("flow").alias("v")) for d in (short, index))
    x = x.select(F.col("site").alias("donor"), "year", F.col("v").alias("x"))
    both = y.withColumnRenamed("v", "y").join(x, "year").filter("site <> donor")
    near = both.groupBy("site", "donor").agg(F.count(F.lit(1)).alias("n1"), F.avg("y").alias("y1"), F.avg("x").alias("x1"), F.var_samp("y").alias("s2y"), F.var_samp("x").alias("s2x"), F.corr("y", "x").alias("rho"))
    rest = near.select("site", "donor").join(x, "donor").join(both.select("site", "donor", "year"), ["site", "donor", "year"], "left_anti")
    far = rest.groupBy("site", "donor").agg(F.count(F.lit(1)).alias("n2"), F.avg("x").alias("x2"), F.var_samp("x").alias("s2x2"))
    f = near.join(far, ["site", "donor"])
    n1, n2, rho = F.col("n1").cast("double"), F.col("n2").cast("double"), F.col("rho")
    beta = rho * F.sqrt(F.col("s2y") / F.col("s2x"))
    gain = F.col("x2") - F.col("x1")
    alpha2 = n2 * (n1 - 4) * (n1 - 1) / ((n2 - 1) * (n1 - 3) * (n1 - 2))
    f = f.withColumn("beta", beta).withColumn("mean_augmented", F.col("y1") + n2 / (n1 + n2) * beta * gain)
    variance = ((n1 - 1) * F.col("s2y") + (n2 - 1) * beta**2 * F.col("s2x2") + (n2 - 1) * alpha2 * (1 - rho**2) * F.col("s2y") + n1 * n2 / (n1 + n2) * beta**2 * gain**2) / (n1 + n2 - 1)
    length = n1 / (1 - n2 / (n1 + n2) * (rho**2 - (1 - rho**2) / (n1 - 3)))
    return f.withColumn("variance_augmented", variance).withColumn("effective_length_mean", length)


def join_flow_and_stage(flow: DataFrame, stage: DataFrame) -> DataFrame:
    """Both readings at each instant that either has; no interpolation. Code columns must agree where both have one."""
    rows = flow.select("site", "ts", F.col("value").alias("flow"), F.col("code").alias("c1")).join(stage.select("site", "ts", F.col("value").alias("stage"), F.col("code").alias("c2")), ["site", "ts"], "full")
    conflict = F.col("c1").isNotNull() & F.col("c2").isNotNull() & (F.col("c1") != F.col("c2"))
    return rows.select("site", "ts", "flow", "stage", F.coalesce("c1", "c2").alias("code"), conflict.alias("conflict"))


def naturalize(gaged: DataFrame, diversions: DataFrame) -> DataFrame:
    """Gaged flow and the net of its diversions (name, rate, months, returned share); a missing rate adds nothing."""
    net = F.when(F.array_contains("months", F.month("date")), F.col("rate") * (1 - F.col("returned")))
    each = gaged.join(diversions.select("site", "date", "rate", "months", "returned"), ["site", "date"], "left").withColumn("net", net)
    return each.groupBy("site", "date").agg(F.first("flow").alias("gaged"), F.coalesce(F.sum("net"), F.lit(0.0)).alias("diverted")).withColumn("natural_flow", F.col("gaged") + F.col("diverted"))
