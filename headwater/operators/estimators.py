"""Estimators that need a kernel for each network, target or pair: quantile transfer by probability, least squares with
model error, regional skew, dissimilarity of transfers, and their blends; and the rules that choose among sources.

A network's fit holds a row for each gage, never a matrix of gages by gages; daily rows only enter through keyed joins.
"""

from __future__ import annotations

from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from headwater.functions import special as S
from headwater.functions.calendar import season
from headwater.operators.duration import performance
from headwater.operators.records import rank_donors
from headwater.operators.transfer import TASKS, in_polygon

# ---- daily flow from a donor's exceedance probability --------------------------------------------------------


def probability_transfer(target: DataFrame, donor: DataFrame, pairs: DataFrame, groups: dict[str, tuple[int, ...]] | None = None) -> DataFrame:
    """The target's flow on each donor day: the donor's flow as a probability on its curve, read on the target's.

    pairs: site, donor, the pairs to be made, such as each site's best donor. Both records of a pair go to one group (and
    season, where seasons are given); curves are interpolated in normal deviates and logs and held at their ends.
    """

    def curve(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        x = np.sort(x[~np.isnan(x)])
        n, positive = len(x), x[x > 0]
        k = np.arange(n - len(positive) + 1, n + 1)
        return np.log10(positive), np.array([S.normal_quantile(p) for p in 1 - (n - k + 1) / (n + 1)])

    def run(t: pd.DataFrame, d: pd.DataFrame) -> pd.DataFrame:
        none = pd.DataFrame(columns=["site", "donor", "date", "flow"])
        if not len(t) or not len(d):
            return none
        lt, zt = curve(t["known"].to_numpy(float))
        ld, zd = curve(d["had"].to_numpy(float))
        if not len(lt) or not len(ld):
            return none
        x = d["had"].to_numpy(float)
        z = np.interp(np.log10(np.maximum(x, 1e-300)), ld, zd)
        return pd.DataFrame({"site": t["to"].iloc[0], "donor": d["of"].iloc[0], "date": d["day"], "flow": np.where(x > 0, 10 ** np.interp(z, zt, lt), 0.0)})

    part = F.lit("") if groups is None else season(F.col("date"), groups)
    key = F.concat_ws("|", "site", "donor", part).alias("pair")
    left = target.filter("flow IS NOT NULL").join(pairs.select("site", "donor"), "site").select(key, F.col("site").alias("to"), F.col("flow").alias("known"))
    right = donor.filter("flow IS NOT NULL").withColumnRenamed("site", "donor").join(pairs.select("site", "donor"), "donor").select(key, F.col("donor").alias("of"), F.col("date").alias("day"), F.col("flow").alias("had"))
    return left.groupBy("pair").cogroup(right.groupBy("pair")).applyInPandas(run, "site string, donor string, date date, flow double")


def best_donors(daily: DataFrame, min_concurrent: int = 365, among: DataFrame | None = None) -> DataFrame:
    """Each site's best other (of the pairs in among, if given): enough common days first, then rank correlation."""
    ranked = rank_donors(daily, daily, min_concurrent, among)
    best = F.max_by("donor", F.struct("sufficient", F.coalesce("spearman", F.lit(-2.0)), "donor"))
    return ranked.groupBy("site").agg(best.alias("donor"))


def transfer_scores(daily: DataFrame, groups: dict[str, tuple[int, ...]] | None = None, min_concurrent: int = 365) -> DataFrame:
    """Leave-one-out over sites: each as if ungaged, estimated from its best donor and scored against its record."""
    pairs = best_donors(daily, min_concurrent)
    made = probability_transfer(daily, daily, pairs, groups).select("site", "date", F.col("flow").alias("estimated"))
    both = made.join(daily.toDF(*daily.columns).select(F.col("site").alias("s"), F.col("date").alias("d"), F.col("flow").alias("observed")), (F.col("site") == F.col("s")) & (F.col("date") == F.col("d"))).select("site", "observed", "estimated")
    return pairs.join(performance(both), "site").filter("n >= 2")


# ---- least squares with model error --------------------------------------------------------------------------


def solve_gls(y: np.ndarray, x: np.ndarray, variance: np.ndarray, rho: float = 0.0) -> tuple[np.ndarray, float, np.ndarray]:
    """(coefficients, model-error variance, their covariance): the variance makes the weighted residuals equal n - p.

    Sampling errors have these variances and one correlation. Their matrix is a diagonal and a matrix of rank one, so its
    inverse is applied in closed form: time and memory are in proportion to the number of gages.
    """
    n, p = x.shape
    sd, rows = np.sqrt(variance), np.column_stack([x, y])

    def at(g2: float) -> tuple[np.ndarray, float, np.ndarray]:
        d = (1 - rho) * variance + g2
        u = sd / d
        both = rows.T @ (rows / d[:, None]) - rho / (1 + rho * float(u @ sd)) * np.outer(rows.T @ u, rows.T @ u)
        cov = np.linalg.inv(both[:p, :p])
        b = cov @ both[:p, p]
        e = y - x @ b
        return b, float(e @ (e / d) - rho / (1 + rho * float(u @ sd)) * (e @ u) ** 2), cov

    if not variance.any():
        b, rss, _ = at(1.0)
        g2 = rss / (n - p)
        return b, g2, np.linalg.inv(x.T @ x) * g2
    lo, hi = 0.0, 1.0
    if at(1e-12)[1] <= n - p:
        b, _, cov = at(1e-12)
        return b, 0.0, cov
    while at(hi)[1] > n - p:
        hi *= 2
    for _ in range(100):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if at(mid)[1] > n - p else (lo, mid)
    b, _, cov = at(hi)
    return b, hi, cov


def fit_gls(rows: DataFrame, predictors: tuple[str, ...], rho: float = 0.0) -> DataFrame:
    """A regression for each region: rows of region, site, y, variance (sampling) and predictors; sampling errors have
    correlation rho (0 to below 1). Returns a row for each term, with the model-error variance and standard error in percent."""

    if not 0 <= rho < 1:
        raise ValueError(f"rho must be from 0 to below 1, not {rho}")

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.dropna().sort_values("site")
        names = ["intercept", *predictors]
        if len(part) < len(names) + 2:
            return pd.DataFrame(columns=["region", "term", "coef", "se", "model_variance", "sep_pct", "n"])
        x = np.column_stack([np.ones(len(part)), *(part[c].to_numpy(float) for c in predictors)])
        b, g2, cov = solve_gls(part["y"].to_numpy(float), x, part["variance"].to_numpy(float), rho)
        avp = g2 + float(np.mean(np.einsum("ij,jk,ik->i", x, cov, x)))
        return pd.DataFrame({"region": part["region"].iloc[0], "term": names, "coef": b, "se": np.sqrt(np.diag(cov)), "model_variance": g2, "sep_pct": 100 * np.sqrt(np.exp(np.log(10) ** 2 * avp) - 1), "n": len(part)})

    return rows.groupBy("region").applyInPandas(run, "region string, term string, coef double, se double, model_variance double, sep_pct double, n long")


def skew_sampling_variance(n: np.ndarray, skew: np.ndarray) -> np.ndarray:
    """Variance of the unbiased sample skew of n years. The numbers are fixed values of the published approximation."""
    a = -17.75 / n**2 + 50.06 / n**3
    b = 3.92 / n**0.3 - 31.10 / n**0.6 + 34.86 / n**0.9
    c = -7.31 / n**0.59 + 45.90 / n**1.18 - 86.50 / n**1.77
    return (1 + 6 / n) ** 2 * (6 / n + a) * (1 + (1.5 + b) * skew**2 + (0.3125 + c) * skew**4)


def regional_skew(rows: DataFrame, predictors: tuple[str, ...] = (), correlation: float = 0.0, prior: float = 10.0) -> DataFrame:
    """Regional skew model of each region: rows of region, site, skew, n (record length) and predictors.

    Unbiased skews; their variances at the ordinary least-squares skew. Coefficients by weighted least squares at the
    posterior mean of the model-error variance (exponential prior, coefficients integrated out); the variance then by
    generalised least squares given them, with one correlation between sites (0 to below 1; the region's matrix is a
    diagonal and one of rank one, and is never built). One row for each term: its coefficient
    and standard error, the region's model variance, mean variance of prediction and effective record length.
    """
    if not 0 <= correlation < 1:
        raise ValueError(f"correlation must be from 0 to below 1, not {correlation}")
    names = ["constant", *predictors]

    def posterior(log: np.ndarray, grid: np.ndarray) -> float:
        w = np.exp(log - log.max()) * np.gradient(grid)
        return float((w * grid).sum() / w.sum())

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.dropna()
        n, skew = part["n"].to_numpy(float), part["skew"].to_numpy(float)
        x = np.column_stack([np.ones(len(part)), *(part[c].to_numpy(float) for c in predictors)])
        if len(part) < x.shape[1] + 2:
            return pd.DataFrame(columns=["region", "term", "coef", "se", "model_variance", "avp", "effective_years", "n_sites"])
        g = (1 + 6 / n) * skew
        v = skew_sampling_variance(n, x @ np.linalg.lstsq(x, g, rcond=None)[0])
        grid = np.concatenate([[0], np.geomspace(1e-4, 4, 600)])

        def weighted(s2: float) -> tuple[np.ndarray, np.ndarray, float]:
            w = 1 / (v + s2)
            info = x.T @ (w[:, None] * x)
            b = np.linalg.solve(info, x.T @ (w * g))
            return b, info, float(0.5 * np.log(w).sum() - 0.5 * np.linalg.slogdet(info)[1] - 0.5 * (w * (g - x @ b) ** 2).sum() - prior * s2)

        s2 = posterior(np.array([weighted(s)[2] for s in grid]), grid)
        b, info, _ = weighted(s2)
        hat = np.linalg.solve(info, (x / (v + s2)[:, None]).T)
        r, root = g - x @ b, np.sqrt(v)

        def given(s2: float) -> float:
            d = np.maximum((1 - correlation) * v + s2, 1e-300)  # the matrix is this diagonal and one of rank one
            more = 1 + correlation * float((v / d).sum())
            return -prior * s2 - 0.5 * (float(np.log(d).sum()) + np.log(more)) - 0.5 * (float((r * r / d).sum()) - correlation / more * float((root * r / d).sum()) ** 2)

        s2 = posterior(np.array([given(s) for s in grid]), grid)
        cov = (hat * ((1 - correlation) * v + s2)) @ hat.T + correlation * np.outer(hat @ root, hat @ root)
        avp = s2 + float(np.einsum("ij,jk,ik->i", x, cov, x).mean())
        years = np.geomspace(5, 5000, 4000)
        at = float(np.interp(-avp, -skew_sampling_variance(years, np.full(4000, float((x @ b).mean()))), years))
        return pd.DataFrame({"region": part["region"].iloc[0], "term": names, "coef": b, "se": np.sqrt(np.diag(cov)), "model_variance": s2, "avp": avp, "effective_years": at, "n_sites": len(part)})

    return rows.groupBy("region").applyInPandas(run, "region string, term string, coef double, se double, model_variance double, avp double, effective_years double, n_sites long")


# ---- dissimilarity of transfers ------------------------------------------------------------------------------


def dissimilarity(part: pd.DataFrame, power: float = 1.0) -> tuple[float, float]:
    """Nugget and slope of squared errors beyond the known variance, from pairs of error, known and log_ar."""
    known = part["known"].to_numpy(float)
    return class_dissimilarity(np.ones(len(part)), part["error"].to_numpy(float) ** 2 - known, known, part["log_ar"].to_numpy(float) ** power)


def class_dissimilarity(n: np.ndarray, excess: np.ndarray, known: np.ndarray, x: np.ndarray) -> tuple[float, float]:
    """Non-negative least squares, weighted by the fit before, of classes of n pairs: excess is their sum of squared errors
    less known. Two coefficients have a closed active set."""
    s = np.array([max(1e-6, float(excess.sum() / n.sum())), 0.0])
    for _ in range(50):
        w = 1 / np.maximum(known + s[0] + s[1] * x, 1e-9) ** 2
        nw, zw = n * w, excess * w
        nx = nw * x
        g, h = np.array([[nw.sum(), nx.sum()], [nx.sum(), nx @ x]]), np.array([zw.sum(), zw @ x])
        new, k = np.zeros(2), int(np.argmax(h))
        if h[k] > 1e-10:
            o = 1 - k
            new[k] = h[k] / g[k, k]
            det = g[0, 0] * g[1, 1] - g[0, 1] ** 2
            if h[o] - g[o, k] * new[k] > 1e-10 and det > 1e-12 * g[0, 0] * g[1, 1]:
                both = np.linalg.solve(g, h)
                new = both if both[k] > 0 else np.eye(2)[o] * h[o] / g[o, o]
        if np.abs(new - s).max() < 1e-10:
            break
        s = new
    return float(s[0]), float(s[1])


def fit_dissimilarity(pairs: DataFrame, power: float = 1.0) -> DataFrame:
    """How squared transfer errors grow with log_ar ^ power, beyond the known variance: non-negative weighted least squares.

    pairs: group, error, known, log_ar. Returns nugget and slope of each group. Pairs of equal known and log_ar have equal
    weights, so their sums stand for them; a group's kernel holds a row for each such class.
    """

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["known", "log_ar"])
        nugget, slope = class_dissimilarity(part["n"].to_numpy(float), part["excess"].to_numpy(float), part["known"].to_numpy(float), part["log_ar"].to_numpy(float) ** power)
        return pd.DataFrame({"group": [part["group"].iloc[0]], "nugget": [nugget], "slope": [slope], "n": [int(part["n"].sum())]})

    classes = pairs.groupBy("group", "known", "log_ar").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("error") ** 2 - F.col("known")).alias("excess"))
    return classes.groupBy("group").applyInPandas(run, "group string, nugget double, slope double, n long")


def blend(rows: DataFrame, correlation: float = 0.0) -> DataFrame:
    """Least-variance blend of several estimates (target, estimate, variance) whose errors have one correlation (0 to below 1).

    The inverse of such a matrix is closed, so that sums over a target's estimates suffice.
    """
    if not 0 <= correlation < 1:
        raise ValueError(f"correlation must be from 0 to below 1, not {correlation}")
    v, sd, x = F.col("variance"), F.sqrt("variance"), F.col("estimate")
    s = rows.groupBy("target").agg(F.sum(1 / v).alias("a"), F.sum(1 / sd).alias("u"), F.sum(x / v).alias("xa"), F.sum(x / sd).alias("xu"), F.count(F.lit(1)).alias("n"))
    shared = correlation * F.col("u") / (1 + (F.col("n") - 1) * correlation)
    weight = F.col("a") - shared * F.col("u")
    return s.select("target", ((F.col("xa") - shared * F.col("xu")) / weight).alias("estimate"), ((1 - correlation) / weight).alias("variance"), "n")


def band(rows: DataFrame) -> DataFrame:
    """log10 area ratio at which a transfer (gage_variance + nugget + L^2 exponent_variance + slope L) is as uncertain as
    the regression."""
    gap = F.col("regression_variance") - F.col("gage_variance") - F.col("nugget")
    a, b = F.col("exponent_variance"), F.col("slope")
    root = F.when(gap <= 0, 0.0).when((a <= 0) & (b <= 0), float("inf")).when(a <= 0, gap / b).otherwise((-b + F.sqrt(b * b + 4 * a * gap)) / (2 * a))
    return rows.withColumn("log_ratio", root).withColumn("ratio", F.pow(F.lit(10.0), "log_ratio"))


def exponent_at(z: Column, points: list[tuple[float, float]], outside: str = "clamp") -> Column:
    """Exponent at a normal deviate, straight between points (z, b); held, or continued, beyond them."""
    points = sorted(points)
    line = lambda p, q: F.lit(p[1]) + (z - p[0]) * ((q[1] - p[1]) / (q[0] - p[0]))
    out = F.lit(points[-1][1]) if outside == "clamp" else line(points[-2], points[-1])
    for p, q in reversed(list(zip(points, points[1:]))):
        out = F.when(z <= q[0], line(p, q)).otherwise(out)
    return F.when(z < points[0][0], points[0][1] if outside == "clamp" else line(points[0], points[1])).otherwise(out)


def smooth_exponent_at(z: Column, points: list[tuple[float, float]]) -> Column:
    """Exponent at a normal deviate by a cubic between points that keeps their order (no overshoot); held beyond them.

    The slope at a point is the weighted harmonic mean of its neighbours', 0 where they differ in sign; at the ends a
    one-sided three-point slope, held within three times the neighbour's.
    """
    points = sorted(points)
    if len(points) < 3:
        return exponent_at(z, points)
    h = [b[0] - a[0] for a, b in zip(points, points[1:])]
    d = [(b[1] - a[1]) / w for (a, b), w in zip(zip(points, points[1:]), h)]

    def end(h0: float, h1: float, d0: float, d1: float) -> float:
        m = ((2 * h0 + h1) * d0 - h0 * d1) / (h0 + h1)
        return 0.0 if m * d0 <= 0 else 3 * d0 if d0 * d1 < 0 and abs(m) > 3 * abs(d0) else m

    inner = [0.0 if a * b <= 0 else (3 * (x + y)) / ((2 * y + x) / a + (y + 2 * x) / b) for a, b, x, y in zip(d, d[1:], h, h[1:])]
    slopes = [end(h[0], h[1], d[0], d[1]), *inner, end(h[-1], h[-2], d[-1], d[-2])]
    out = F.lit(points[-1][1])
    for p, q, w, m0, m1 in reversed(list(zip(points, points[1:], h, slopes, slopes[1:]))):
        t = (z - p[0]) / w
        cubic = p[1] * (1 + 2 * t) * (1 - t) ** 2 + w * m0 * t * (1 - t) ** 2 + q[1] * t * t * (3 - 2 * t) + w * m1 * t * t * (t - 1)
        out = F.when(z <= q[0], cubic).otherwise(out)
    return F.when(z < points[0][0], points[0][1]).otherwise(out)


def leave_one_out(pairs: DataFrame, gages: DataFrame, correlation: float = 0.0, level: float = 0.9) -> DataFrame:
    """Each connected gage estimated from its neighbours and its regression as if it had no record, and scored.

    pairs: group, donor, receiver, error (of the transfer's log), known (both gages' variances), log_ar; gages: group,
    site, log_flow, variance, regression, regression_variance (null without one). The dissimilarity is fitted to the pairs
    that don't involve the gage. Covered: whether the observed log lies within the blend's limits at this level, its own
    variance included. A network is one group; its gages are dealt to tasks, each with the network's classes of pairs.
    """
    z = NormalDist().inv_cdf(0.5 + level / 2)
    columns = "group string, site string, n_donors long, observed double, blend double, blend_variance double, blend_error double, covered boolean, note string"
    if not 0 <= correlation < 1:
        raise ValueError(f"correlation must be from 0 to below 1, not {correlation}")
    # pairs of equal known and log_ar have equal weights and variances: their sums stand for them
    excess = F.col("error") ** 2 - F.col("known")
    of_all = pairs.groupBy("group", "known", "log_ar").agg(F.count(F.lit(1)).alias("n"), F.sum(excess).alias("excess"))
    ends = F.explode(F.array(F.struct(F.col("receiver").alias("site"), F.lit(1).alias("own")), F.struct(F.col("donor").alias("site"), F.lit(0).alias("own")))).alias("end")
    touching = pairs.select("group", "known", "log_ar", "error", ends).select("group", "known", "log_ar", "error", "end.*")
    touching = touching.groupBy("group", "site", "known", "log_ar").agg(F.count(F.lit(1)).alias("n"), F.sum(excess).alias("excess"), F.sum("own").alias("donors"), F.sum(F.col("own") * F.col("error")).alias("errors"))
    facts = gages.select("group", "site", "log_flow", "variance", "regression", "regression_variance")
    dealt = touching.join(facts, ["group", "site"]).withColumn("share", F.pmod(F.xxhash64("site"), F.lit(TASKS).cast("long")))
    copied = of_all.withColumn("share", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(TASKS - 1).cast("long"))))

    def run(mine: pd.DataFrame, every: pd.DataFrame) -> pd.DataFrame:
        out, names = [], [c.split()[0] for c in columns.split(", ")]
        every = every.sort_values(["known", "log_ar"])
        at = {k: i for i, k in enumerate(zip(every["known"], every["log_ar"]))}
        n, excess, known, x = (every[c].to_numpy(float) for c in ("n", "excess", "known", "log_ar"))
        for site, part in mine.groupby("site", sort=True):
            here = np.array([at[k] for k in zip(part["known"], part["log_ar"])])
            left, rest = n.copy(), excess.copy()
            left[here] -= part["n"].to_numpy(float)
            rest[here] -= part["excess"].to_numpy(float)
            gage, part = part.iloc[0], part[part["donors"] > 0]
            if not len(part):  # it receives from none
                continue
            head = (gage["group"], site, int(part["donors"].sum()), float(gage["log_flow"]))
            if left.sum() < 4:
                out.append((*head, None, None, None, None, "too few other pairs"))
                continue
            kept = left > 0
            nugget, slope = class_dissimilarity(left[kept], rest[kept], known[kept], x[kept])
            v = part["known"].to_numpy(float) - gage["variance"] + nugget + slope * part["log_ar"].to_numpy(float)
            k = part["donors"].to_numpy(float)
            estimates = part["errors"].to_numpy(float) + k * gage["log_flow"]
            shared = correlation * (k / np.sqrt(v)).sum() / (1 + (k.sum() - 1) * correlation)
            weight = ((k / v).sum() - shared * (k / np.sqrt(v)).sum()) / (1 - correlation)
            total = ((estimates / v).sum() - shared * (estimates / np.sqrt(v)).sum()) / (1 - correlation)
            if pd.notna(gage["regression"]):
                weight, total = weight + 1 / gage["regression_variance"], total + gage["regression"] / gage["regression_variance"]
            blend, variance = float(total / weight), float(1 / weight)
            error = blend - head[3]
            out.append((*head, blend, variance, error, bool(abs(error) <= z * np.sqrt(variance + gage["variance"])), ""))
        return pd.DataFrame(out, columns=names)

    copied = copied.select(*(F.col(c).alias(c + "_") for c in copied.columns)).toDF(*copied.columns)  # columns of their own
    return dealt.groupBy("group", "share").cogroup(copied.groupBy("group", "share")).applyInPandas(run, columns)


# ---- rules ---------------------------------------------------------------------------------------------------


def classify_sites(sites: DataFrame) -> DataFrame:
    """Regulation class by the first rule that applies, and the reasons that do.

    sites: site, screen_class, storage_days, impervious_pct, code_share, diversion (each but site may be null).
    """
    reasons = F.array_compact(F.array(
        F.when(F.col("code_share") > 0, "peak codes"), F.when(F.col("diversion"), "diversion"), F.when(F.col("storage_days") > 127.8, "storage"), F.when(F.col("impervious_pct") > 5, "impervious"),
    ))
    kind = F.when((F.col("code_share") > 0) | F.coalesce("diversion", F.lit(False)), "regulated").when(F.col("screen_class") == "reference", "reference")
    kind = kind.when(F.col("storage_days") > 127.8, "regulated").when(F.col("impervious_pct") > 5, "urban").otherwise(F.coalesce("screen_class", F.lit("unknown")))
    return sites.select("site", kind.alias("class"), F.array_join(reasons, ", ").alias("basis"))


def storage_events(dams: DataFrame, share: float = 0.1) -> DataFrame:
    """Years in which a basin's cumulative storage first passes another share of its total: dams: site, year, storage."""
    years = dams.groupBy("site", "year").agg(F.sum("storage").alias("storage"))
    by = Window.partitionBy("site")
    run = F.sum("storage").over(by.orderBy("year")) / F.sum("storage").over(by)
    rows = years.withColumn("upto", run).withColumn("before", F.coalesce(F.lag("upto").over(by.orderBy("year")), F.lit(0.0)))
    return rows.filter(F.floor(F.round(F.col("upto") / share, 9)) > F.floor(F.round(F.col("before") / share, 9))).select("site", "year", "upto")


def region_choice(candidates: DataFrame) -> DataFrame:
    """Of overlapping regions of a site (site, region, percent, preference, gate_ok), the preferred that passes its gate;
    status tells partial or overlapping coverage."""
    ok = candidates.filter("gate_ok")
    by = Window.partitionBy("site")
    ranked = ok.withColumn("total", F.sum("percent").over(by)).withColumn("k", F.row_number().over(by.orderBy("preference", F.col("percent").desc(), "region")))
    status = F.when(F.col("total") > 100.5, "overlapping").when(F.col("total") < 99.5, "partial").otherwise("complete")
    return ranked.filter("k = 1").select("site", "region", "total", status.alias("status"))


def pair_lookup(offsets: DataFrame, pairs: DataFrame) -> DataFrame:
    """Offsets of unordered pairs (a, b): either order finds them, the sign follows the order."""
    both = offsets.select("a", "b", "offset").unionByName(offsets.select(F.col("b").alias("a"), F.col("a").alias("b"), (-F.col("offset")).alias("offset")))
    return pairs.join(both, ["a", "b"], "left")


def relation(pairs: DataFrame, tolerance: float = 0.02) -> DataFrame:
    """upstream, downstream, colocated or none for pairs of basins: by containment of the outlets and by area.

    pairs: site, other, area, other_area, in_other (site's outlet lies in other's basin), holds_other.
    """
    near = F.abs(F.col("area") - F.col("other_area")) <= tolerance * F.greatest("area", "other_area")
    kind = F.when(near & (F.col("in_other") | F.col("holds_other")), "colocated").when(F.col("in_other") & (F.col("area") < F.col("other_area")), "upstream").when(F.col("holds_other") & (F.col("area") > F.col("other_area")), "downstream").otherwise("none")
    return pairs.select("site", "other", kind.alias("relation"), (F.col("in_other") & F.col("holds_other") & ~near).alias("conflict"))


def share_inside(points: DataFrame, basins: DataFrame) -> DataFrame:
    """Share of sample points (basin, lon, lat) that lie in their basin (basin, rings)."""
    return points.join(basins, "basin").groupBy("basin").agg(F.avg(in_polygon(F.col("lon"), F.col("lat"), F.col("rings")).cast("double")).alias("share"), F.count(F.lit(1)).alias("n"))


def percent_error_to_log(pct: Column) -> Column:
    """A standard error in percent as one of log10."""
    return F.sqrt(F.log(1 + (pct / 100) ** 2)) / F.log(F.lit(10.0))


def discrepancy(a: Column, sd_a: Column, b: Column, sd_b: Column, z: float = 1.6448536269514722) -> Column:
    """|a - b| over z times their joint deviation; above 1 it stands out."""
    return F.abs(a - b) / (z * F.sqrt(sd_a * sd_a + sd_b * sd_b))


def mean_flow(daily: DataFrame, min_days: int = 365) -> DataFrame:
    """Mean flow over complete water years."""
    from headwater.functions.calendar import year_label

    years = daily.filter("flow IS NOT NULL").groupBy("site", year_label(F.col("date"), "water").alias("year")).agg(F.sum("flow").alias("total"), F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_days)
    return years.groupBy("site").agg((F.sum("total") / F.sum("n")).alias("mean_flow"), F.count(F.lit(1)).alias("n_years"))
