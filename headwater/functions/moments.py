"""Sampling error of expected-moments fits: covariance of the moments, skew weights, limits of quantiles.

All of it works in the fit's own units: values less the mean, in deviations. Moments of a Pearson III value within a
region are sums over Gauss-Legendre panels of its density, whose logarithm is a smooth function for any skew; the
derivatives are central differences of those sums.
"""

from __future__ import annotations

import math

import numpy as np

from headwater.functions import special as S

_X, _W = np.polynomial.legendre.leggauss(16)
# Bounds of the skew in the moments' covariance and in the limits, the years that the empirical error is
# capped at, the skew from which the determinant ratio counts, the shape beyond which a gamma variate is replaced, the
# least degrees of freedom and denominator of the limits.
LEAST_SKEW, MOST_SKEW, LIMIT_SKEW = 0.06324555, 1.41, 1.5
MOST_YEARS, RATIO_SKEW, MOST_SHAPE = 150, 0.04, 160.0
LEAST_FREEDOM, LEAST_DENOMINATOR = 5.0, 0.5

#: A group of years that share what could be perceived: (years, lower and upper threshold).
Groups = tuple[tuple[float, float, float], ...]


def region(lo: float, hi: float, mean: float, sd: float, skew: float, powers: int) -> tuple[float, np.ndarray]:
    """P(lo < x < hi) and the mean of x ** 1, ..., x ** powers there, for a Pearson III value x."""
    a, b = (lo - mean) / sd, (hi - mean) / sd
    c = 2 / skew
    a, b = (max(a, -c, -14), min(b, 45)) if skew > 0 else (max(a, -45), min(b, -c, 14))
    if b <= a:
        return 0.0, np.zeros(powers)
    edges = np.linspace(a, b, max(2, math.ceil((b - a) / 0.75) + 1))
    half = np.diff(edges) / 2
    t = ((edges[:-1] + half)[:, None] + half[:, None] * _X).ravel()
    shape = c * c
    log = (shape - 1) * np.log(np.maximum(1 + t / c, 1e-300)) - c * t
    weight = (half[:, None] * _W).ravel() * np.exp(log + math.log(abs(c)) + (shape - 1) * math.log(shape) - shape - math.lgamma(shape))
    p = float(weight.sum())
    if p <= 0:
        return 0.0, np.zeros(powers)
    x = mean + sd * t
    return p, np.array([float((weight * x**k).sum()) / p for k in range(1, powers + 1)])


def central(raw: np.ndarray) -> tuple[float, float, float]:
    """Mean, variance and skew of raw moments."""
    m1, m2, m3 = raw
    var = m2 - m1 * m1
    return m1, var, (m3 - 3 * m1 * m2 + 2 * m1**3) / var**1.5


def raw(moments: np.ndarray) -> np.ndarray:
    """Raw moments, the last axis, of mean, variance and skew."""
    m, v, g = np.moveaxis(np.asarray(moments, float), -1, 0)
    return np.stack([m, v + m * m, g * np.sign(v) * np.abs(v) ** 1.5 + 3 * m * v + m**3], axis=-1)


def raw_covariance(groups: Groups, skew: float) -> np.ndarray:
    """Covariance of the estimated raw moments of a standardised value; thresholds in deviations.

    The estimate solves an equation: the mean over all years of what a year adds, its powers where it was perceived and
    their expectation where it wasn't, is the moments themselves. The covariance of what a year adds, carried through
    the equation's derivative.
    """
    g = math.copysign(min(max(abs(skew), LEAST_SKEW), MOST_SKEW), skew)
    years = sum(n for n, _, _ in groups)
    spread, pull = np.zeros((3, 3)), np.zeros((3, 3))
    for n, lo, hi in groups:
        parts = [region(-math.inf, lo, 0, 1, g, 3), region(lo, hi, 0, 1, g, 6), region(hi, math.inf, 0, 1, g, 3)]
        chance = np.array([p for p, _ in parts])
        means = np.array([m[:3] for _, m in parts])
        spread += n * (means.T @ (np.diag(chance) - np.outer(chance, chance)) @ means)
        p, m = parts[1]
        spread += n * p * np.array([[m[i + j + 1] - m[i] * m[j] for j in range(3)] for i in range(3)])
        for (p, _), (a, b) in zip(parts[::2], ((-math.inf, lo), (hi, math.inf))):
            if p > 1e-6:
                pull += n * p * _by_raw(a, b, g)
    back = np.linalg.inv(np.eye(3) - pull / years)
    return back @ spread @ back.T / years**2


def _by_raw(a: float, b: float, skew: float, h: float = 1e-4) -> np.ndarray:
    """Derivatives of a region's mean powers by the raw moments."""
    at = raw(np.array([0.0, 1.0, skew]))
    out = np.empty((3, 3))
    for j in range(3):
        ends = []
        for sign in (1, -1):
            m, v, g = central(at + sign * h * np.eye(3)[j])
            ends.append(region(a, b, m, math.sqrt(v), g, 3)[1])
        out[:, j] = (ends[0] - ends[1]) / (2 * h)
    return out


def nodes(moments: np.ndarray, factor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eight weights and points (mean, variance, skew) with covariance factor.T @ factor: two of a normal for the mean
    and the skew each, two of a gamma with the variance's own spread."""
    shape = moments[1] ** 2 / (factor.T @ factor)[1, 1]
    a = min(shape, MOST_SHAPE)
    x = a + 1 + np.array([-1.0, 1.0]) * math.sqrt(a + 1)
    chance = np.array([x[1] - a, a - x[0]]) / (x[1] - x[0])
    steps = ((-1.0, 1.0), (x - a) / math.sqrt(a), (-1.0, 1.0))
    z = np.array([(i, j, k) for i in steps[0] for j in steps[1] for k in steps[2]])
    w = np.array([p / 4 for _ in range(2) for p in chance for _ in range(2)])
    return w, np.asarray(moments) + z @ factor


def weighted_cov(w: np.ndarray, x: np.ndarray) -> np.ndarray:
    d = x - w @ x / w.sum()
    return (w[:, None] * d).T @ d / w.sum()


def factor_of(s: np.ndarray) -> np.ndarray:
    """V with V.T @ V = s: the variance's row first, then the mean's, then the skew's."""
    order = [1, 0, 2]
    low = np.linalg.cholesky(s[np.ix_(order, order)])
    v = np.zeros((3, 3))
    for k, row in enumerate(order):
        v[row, order] = low[:, k]
    return v


_FREE = ((0, 0), (1, 0), (0, 2), (1, 1), (1, 2), (2, 2))


def moment_covariance(groups: Groups, skew: float) -> np.ndarray:
    """Covariance of mean, variance and skew of a standardised value, such that the raw moments at its nodes have theirs.

    Newton's steps on the factor's six entries, from the linear solution.
    """
    g = math.copysign(min(max(abs(skew), 1e-12), LIMIT_SKEW), skew)
    want = raw_covariance(groups, g)
    at = np.array([0.0, 1.0, g])
    h = 1e-6
    slope = np.array([(raw(at + h * e) - raw(at - h * e)) / (2 * h) for e in np.eye(3)]).T
    back = np.linalg.inv(slope)
    first = factor_of(back @ want @ back.T)
    tri = np.triu_indices(3)

    def gap(x: np.ndarray) -> np.ndarray:
        v = np.zeros((3, 3))
        for (i, j), value in zip(_FREE, x):
            v[i, j] = value
        w, points = nodes(at, v)
        return (weighted_cov(w, raw(points)) - want)[tri], v

    x = np.array([first[i, j] for i, j in _FREE])
    now, v = gap(x)
    for _ in range(60):
        if np.abs(now).max() < 1e-13:
            break
        jac = np.array([(gap(x + 1e-7 * e)[0] - gap(x - 1e-7 * e)[0]) / 2e-7 for e in np.eye(6)]).T
        step = np.linalg.lstsq(jac, -now, rcond=None)[0]
        share = 1.0
        while share > 1e-4:
            new, v_new = gap(x + share * step)
            if np.abs(new).max() < np.abs(now).max():
                break
            share /= 2
        else:
            break
        x, now, v = x + share * step, new, v_new
    return v.T @ v


def standardised(groups: Groups, mean: float, sd: float) -> Groups:
    return tuple((n, (lo - mean) / sd, (hi - mean) / sd) for n, lo, hi in groups)


def empirical_skew_error(n: float, skew: float) -> float:
    """Mean square error of a complete record's skew."""
    g = abs(skew)
    a = -0.33 + 0.08 * g if g <= 0.9 else -0.52 + 0.30 * g
    b = 0.94 - 0.26 * g if g <= 1.5 else 0.55
    return 10 ** (a - b * math.log10(n / 10))


def _skew_variance(groups: Groups, skew: float) -> float:
    if abs(skew) > LEAST_SKEW:
        return float(moment_covariance(groups, skew)[2, 2])
    share = (skew - LEAST_SKEW) / (2 * LEAST_SKEW)
    return float(share * moment_covariance(groups, -LEAST_SKEW)[2, 2] + (1 - share) * moment_covariance(groups, LEAST_SKEW)[2, 2])


def skew_error(groups: Groups, skew: float, plain: bool = False) -> float:
    """Mean square error of a station skew; groups are standardised. plain: of the whole record, as if nothing were censored."""
    n = sum(k for k, _, _ in groups)
    if plain:
        return empirical_skew_error(n, skew)
    lost = _skew_variance(groups, skew) / _skew_variance(((n, -math.inf, math.inf),), skew)
    return lost * empirical_skew_error(min(n, MOST_YEARS), skew)


def determinant_ratio(groups: Groups, skew: float) -> float:
    """How much less a censored record's skew resists a regional one: of the expected iteration's derivative about the fit."""
    if abs(skew) < RATIO_SKEW:
        return 1.0
    years = sum(n for n, _, _ in groups)
    known = []
    for n, lo, hi in groups:
        p, m = region(lo, hi, 0, 1, skew, 3)
        tails = [(region(-math.inf, lo, 0, 1, skew, 3)[0], -math.inf, lo), (region(hi, math.inf, 0, 1, skew, 3)[0], hi, math.inf)]
        known.append((n / years, p, m, tails))

    def step(mean: float, var: float, g: float) -> np.ndarray:
        sd, total = math.sqrt(var), np.zeros(3)
        for share, p, m, tails in known:
            for q, mom in [(p, m), *((q, region(a, b, mean, sd, g, 3)[1]) for q, a, b in tails if q > 1e-10)]:
                total += share * q * np.array([mom[0], mom[1] - 2 * mean * mom[0] + mean**2, (mom[2] - 3 * mean * mom[1] + 3 * mean**2 * mom[0] - mean**3) / sd**3])
        return total

    at, h = np.array([0.0, 1.0, skew]), 1e-5
    left = np.eye(3) - np.array([(step(*(at + h * e)) - step(*(at - h * e))) / (2 * h) for e in np.eye(3)]).T
    return float(np.linalg.det(left) / np.linalg.det(left[:2, :2]))


def weighted_covariance(groups: Groups, mean: float, var: float, skew: float, regional_mse: float | None, plain: bool) -> np.ndarray:
    """Covariance of mean, variance and skew, the skew weighted with a regional one of this mean square error."""
    sd = math.sqrt(var)
    g = max(-LIMIT_SKEW, min(LIMIT_SKEW, skew))
    own = standardised(groups, mean, sd)
    units = np.array([sd, var, 1.0])
    s = moment_covariance(own, g) * np.outer(units, units)
    if regional_mse is not None and regional_mse < 1e10:
        w = regional_mse / (skew_error(own, g, plain) + regional_mse) if regional_mse > 0 else 0.0
        s[2, :2] *= w
        s[:2, 2] *= w
        s[2, 2] = w * w * s[2, 2] + (1 - w) ** 2 * abs(regional_mse)
    return s


def quantile_limits(groups: Groups, mean: float, var: float, skew: float, aeps: tuple[float, ...], confidence: float = 0.9, regional_mse: float | None = None, plain: bool = False) -> list[tuple[float, float, float, float]]:
    """(quantile, lower, upper, variance) for each aep. The quantile's own standard error varies with it over the nodes of
    the moments; a Student's t statistic of their regression gives limits that lie askew."""
    fit = np.array([mean, var, skew])
    w, outer = nodes(fit, factor_of(weighted_covariance(groups, mean, var, skew, regional_mse, plain)))
    outer[:, 1] = np.maximum(outer[:, 1], 1e-6 * var)
    inner = [nodes(p, factor_of(weighted_covariance(groups, *p, regional_mse, plain))) for p in outer]
    value = lambda p, aep: p[0] + S.frequency_factor(p[2], aep) * math.sqrt(max(p[1], 1e-12))
    out = []
    for aep in aeps:
        y = [value(p, aep) for p in outer]
        error = [math.sqrt(weighted_cov(v, np.array([[value(p, aep)] for p in points]))[0, 0]) for v, points in inner]
        (vy, cov), (_, ve) = weighted_cov(w, np.column_stack([y, error]))
        lean = cov / vy
        freedom = max(0.5 * vy / max(ve - cov * lean, 1e-300), LEAST_FREEDOM)
        t, centre, s = S.t_quantile((1 + confidence) / 2, freedom), value(fit, aep), math.sqrt(vy)
        out.append((centre, centre - s * t / max(LEAST_DENOMINATOR, 1 + lean * t), centre + s * t / max(LEAST_DENOMINATOR, 1 - lean * t), float(vy)))
    return out
