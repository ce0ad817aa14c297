"""Kernels of flood-frequency fits for one site: low-outlier test, expected moments of censored logs, limits."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np

from headwater.functions import moments as M
from headwater.functions import special as S

LEAST_LOG = -20.0


_GRID = np.linspace(-10, 10, 4001)
_AT = np.array([S.normal_cdf(x) for x in _GRID.tolist()])
_SLOPE = np.exp(-(_GRID**2) / 2) / math.sqrt(2 * math.pi) * (_GRID[1] - _GRID[0])


def _cdf(z: np.ndarray) -> np.ndarray:
    """Normal probabilities between table values, by their slopes (to some 1e-13)."""
    at = np.clip((z + 10) * 200, 0, 3999.999999)
    k = at.astype(np.int64)
    t = at - k
    a, b, da, db = _AT[k], _AT[k + 1], _SLOPE[k], _SLOPE[k + 1]
    return a + t * (da + t * (3 * (b - a) - 2 * da - db + t * (da + db - 2 * (b - a))))


def _order_statistic(n: int, rank: int, points: int = 121) -> tuple[np.ndarray, np.ndarray]:
    """Nodes and weights for the rank-th smallest of n normal values; the nodes lie where its density does."""

    def log_density(z: np.ndarray) -> np.ndarray:
        below, above = np.maximum(_cdf(z), 1e-18), np.maximum(_cdf(-z), 1e-18)
        return (rank - 1) * np.log(below) + (n - rank) * np.log(above) - z * z / 2

    wide = np.linspace(-9, 9, 721)
    d = log_density(wide)
    near = wide[d > d.max() - 30]
    nodes = np.linspace(near[0] - 0.025, near[-1] + 0.025, points)
    d = log_density(nodes)
    weights = np.exp(d - d.max())
    return nodes, weights / weights.sum()


def _above(z: np.ndarray) -> tuple[np.ndarray, ...]:
    """Mean and second to fourth central moments of a standard normal value above each z, by Simpson's rule."""
    share = np.linspace(0, 1, 401)
    x = z[:, None] + (np.maximum(z, 0) + 9 - z)[:, None] * share
    rule = np.where(np.arange(401) % 2, 4.0, 2.0)
    rule[[0, -1]] = 1
    weight = rule * np.exp((z[:, None] ** 2 - x * x) / 2)
    weight /= weight.sum(axis=1, keepdims=True)
    mean = (weight * x).sum(axis=1)
    away = x - mean[:, None]
    return (mean, *((weight * away**k).sum(axis=1) for k in (2, 3, 4)))


def outlier_p(n: int, rank: int, w: float) -> float:
    """P(W <= w) for the rank-th smallest of n normal values, W its distance from the mean of those above in their deviations.

    Given the value z, those above are a sample of a normal distribution cut off at z. Its deviation s is taken to be
    the root of a gamma variate with the right mean and variance, its mean to be normal about a line in s; W <= w is
    then mean + w s >= z. Summed over s, then over z.
    """
    m = n - rank
    if m < 2:
        return 1.0
    z, share = _order_statistic(n, rank)
    mean, second, third, fourth = _above(z)
    spread = (fourth - second**2 * (m - 3) / (m - 1)) / m  # variance of the sample variance
    shape = second**2 / spread
    # deviations: nodes over the chi-like density of s in units of its root mean square
    reach = 8 / np.sqrt(4 * shape)
    unit = 1 + reach[:, None] * np.linspace(-1, 1, 65)
    unit = np.maximum(unit, 1e-6)
    log_density = (2 * shape[:, None] - 1) * np.log(unit) - shape[:, None] * unit**2
    chance = np.exp(log_density - log_density.max(axis=1, keepdims=True))
    chance /= chance.sum(axis=1, keepdims=True)
    s = unit * np.sqrt(second)[:, None]
    mean_s = (chance * s).sum(axis=1)
    var_s = (chance * (s - mean_s[:, None]) ** 2).sum(axis=1)
    slope = third / (2 * m * mean_s * var_s)
    rest = np.sqrt(np.maximum(second / m - slope**2 * var_s, 1e-12))
    line = mean[:, None] + slope[:, None] * (s - mean_s[:, None])
    given = (chance * _cdf((line + w * s - z[:, None]) / rest[:, None])).sum(axis=1)
    return float(min(1.0, max(0.0, share @ given)))


def low_outliers(logs: np.ndarray) -> tuple[int, float | None]:
    """(number of low outliers, log of the smallest value that isn't one): outward from the median at 0.005, inward
    from the least at 0.1."""
    z = np.sort(logs)
    n = len(z)
    if n < 5:
        return 0, None
    p: dict[int, float] = {}
    half = n // 2

    def prob(i: int) -> float:
        if i not in p:
            upper = z[i:]
            sd = upper.std(ddof=1) if len(upper) > 1 else 0.0
            p[i] = outlier_p(n, i, (z[i - 1] - upper.mean()) / sd) if sd > 0 else 1.0
        return p[i]

    outward = next((i for i in range(half, 0, -1) if prob(i) < 0.005), 0)
    inward = next((i - 1 for i in range(1, half + 1) if prob(i) >= 0.1), half)
    k = max(outward, inward)
    return k, float(z[k]) if k else None


def interval_moments(lo: float, hi: float, mean: float, sd: float, skew: float, about: float) -> tuple[float, float, float]:
    """First raw moment and second and third moments about a point of a log-Pearson III value known to lie in (lo, hi)."""
    sd = max(sd, 1e-9)
    if abs(skew) < 0.01:
        a, b = (lo - mean) / sd, (hi - mean) / sd
        pdf = lambda x: math.exp(-x * x / 2) / math.sqrt(2 * math.pi) if math.isfinite(x) else 0.0
        mass = S.normal_cdf(b) - S.normal_cdf(a)
        if mass < 1e-14:
            x = min(max(mean, lo), hi)
            return x, (x - about) ** 2, (x - about) ** 3
        m = [1.0, (pdf(a) - pdf(b)) / mass]
        for k in (2, 3):
            edge = (a ** (k - 1) * pdf(a) if math.isfinite(a) else 0.0) - (b ** (k - 1) * pdf(b) if math.isfinite(b) else 0.0)
            m.append((k - 1) * m[k - 2] + edge / mass)
        shift = mean - about
        raw = mean + sd * m[1]
        return raw, shift**2 + 2 * shift * sd * m[1] + sd**2 * m[2], shift**3 + 3 * shift**2 * sd * m[1] + 3 * shift * sd**2 * m[2] + sd**3 * m[3]
    shape = 4 / skew**2
    scale = math.copysign(sd / math.sqrt(shape), skew)
    origin = mean - shape * scale
    a, b = sorted(((lo - origin) / scale, (hi - origin) / scale))
    a, b = max(a, 0.0), max(b, 0.0)
    parts = [S.gamma_p(shape + k, b) - S.gamma_p(shape + k, a) for k in range(4)]
    if parts[0] < 1e-14:
        x = min(max(mean, lo), hi)
        return x, (x - about) ** 2, (x - about) ** 3
    y = [1.0]
    for k in range(1, 4):
        y.append(math.prod(shape + i for i in range(k)) * parts[k] / parts[0])
    c = origin - about
    return origin + scale * y[1], c**2 + 2 * c * scale * y[1] + scale**2 * y[2], c**3 + 3 * c**2 * scale * y[1] + 3 * c * scale**2 * y[2] + scale**3 * y[3]


@dataclass
class Fit:
    n: int
    mean: float
    sd: float
    skew: float
    station_skew: float
    n_low: int
    threshold: float | None
    iterations: int
    groups: M.Groups = ()
    skew_mse: float | None = None
    regional_mse: float | None = None

    def limits(self, aeps: tuple[float, ...], confidence: float = 0.9) -> list[tuple[float, float, float, float]]:
        """(log flow, lower, upper, variance of the log) for each aep."""
        return M.quantile_limits(self.groups, self.mean, self.sd**2, self.skew, tuple(aeps), confidence, self.regional_mse, self.n_low > 0)


def expected_moments(lower: np.ndarray, upper: np.ndarray, regional: float = 0.0, weight: float = 0.0, limit: int = 20_000) -> tuple[float, float, float, int]:
    """(mean, deviation, skew, iterations) at the fixed point of the expected moments of all intervals.

    lower and upper are logs, equal for exact peaks, whose moments alone get the small-sample factors. The regional
    skew counts as `weight` further years.
    """
    exact = lower == upper
    x = lower[exact]
    kinds: dict[tuple[float, float], int] = {}
    for pair in zip(lower[~exact].tolist(), upper[~exact].tolist()):
        kinds[pair] = kinds.get(pair, 0) + 1
    n, ne = len(lower), len(x)
    c2 = ne / (ne - 1) if ne > 1 else 1.0
    c3 = ne**2 / ((ne - 1) * (ne - 2)) if ne > 2 else 1.0
    mean, var, skew, last = 0.0, 1.0, 0.0, math.inf
    for k in range(1, limit + 1):
        found = {pair: interval_moments(*pair, mean, math.sqrt(var), skew, 0.0)[0] for pair in kinds}
        m = (x.sum() + sum(c * found[p] for p, c in kinds.items())) / n
        second = third = 0.0
        for pair, c in kinds.items():
            _, s2, s3 = interval_moments(*pair, mean, math.sqrt(var), skew, m)
            second += c * s2
            third += c * s3
        v = (c2 * ((x - m) ** 2).sum() + second) / n
        s = math.sqrt(v)
        g = (c3 * ((x - m) ** 3).sum() + third + weight * regional * s**3) / ((n + weight) * s**3)
        g = max(-S.MAX_SKEW, min(S.MAX_SKEW, g))
        moved = (m - mean) ** 2 / v + (v - var) ** 2 / v**2 / 10 + (g - skew) ** 2 / 100
        mean, var, skew = m, v, g
        if moved <= 1e-10 and moved >= last or moved < 1e-24:
            return mean, math.sqrt(var), skew, k
        last = moved
    return mean, math.sqrt(var), skew, limit


def perceived(lower: np.ndarray, upper: np.ndarray, tl: np.ndarray | None, tu: np.ndarray | None, threshold: float | None) -> M.Groups:
    """Years by what could be perceived in them. Without thresholds, an interval that is open below has its upper end as one."""
    if tl is None or tu is None:
        tl, tu = np.where((lower != upper) & (lower <= LEAST_LOG), upper, LEAST_LOG), np.full(len(lower), math.inf)
    tl = np.maximum(tl, LEAST_LOG if threshold is None else threshold)
    count: dict[tuple[float, float], int] = {}
    for pair in zip(tl.tolist(), tu.tolist()):
        count[pair] = count.get(pair, 0) + 1
    return tuple((float(n), *pair) for pair, n in count.items())


def fit(lower: np.ndarray, upper: np.ndarray, regional: float | None = None, regional_mse: float | None = None, screen: bool = True, tl: np.ndarray | None = None, tu: np.ndarray | None = None, option: str = "weighted") -> Fit:
    """Expected-moments fit of flow intervals in logs, with low outliers recoded below their threshold.

    tl and tu: logs of the perception thresholds of each year. A regional skew with a mean square error counts as
    further years: as many as the record's, times the ratio of the errors and that of the determinants. option: weighted,
    station (the record's own skew) or regional (that skew alone).
    """
    lo, hi = lower.astype(float).copy(), upper.astype(float).copy()
    k, threshold = low_outliers(lo[lo == hi]) if screen else (0, None)
    groups = perceived(lo, hi, tl, tu, threshold)
    if threshold is not None:
        low = hi < threshold
        lo[low], hi[low] = LEAST_LOG, threshold
    mean, sd, station, n = expected_moments(lo, hi)
    own = M.standardised(groups, mean, sd)
    mse, skew = M.skew_error(own, station, k > 0), station
    weighted = option != "station" and regional is not None and regional_mse and 0 < regional_mse < 1e10
    if weighted:
        years = 1e12 if option == "regional" else len(lo) * M.determinant_ratio(own, station) * mse / regional_mse
        mean, sd, skew, more = expected_moments(lo, hi, regional, years)
        n += more
    return Fit(len(lo), mean, sd, skew, station, k, threshold, n, groups, mse, (-regional_mse if option == "regional" else regional_mse) if weighted else None)
