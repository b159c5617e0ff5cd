"""Statistics: rank tests with effect sizes, correlations, resampling, and tests of single time series.

Ranks and sums over all rows are DataFrame operations (see ranking); p-values come from the few sums that are left, on the driver.
Tests of a series run by key, on the rows of one key, which are as many as the history has days.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import ranking

# ---------------------------------------------------------------- distributions


def normal_sf(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2))


def _incomplete_beta(a: float, b: float, x: float) -> float:
    """The regularised incomplete beta function, by its continued fraction (Lentz)."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - _incomplete_beta(b, a, 1 - x)
    front = math.exp(a * math.log(x) + b * math.log1p(-x) + math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)) / a
    c, d = 1.0, 1 / (1 - (a + b) * x / (a + 1) or 1e-300)
    out = d
    for m in range(1, 500):
        for term in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / (1 + term * d or 1e-300)
            c = 1 + term / c or 1e-300
            out *= c * d
        if abs(c * d - 1) < 1e-14:
            break
    return front * out


def _incomplete_gamma(a: float, x: float) -> float:
    """The upper regularised incomplete gamma function: series below, continued fraction above."""
    if x <= 0:
        return 1.0
    front = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        for n in range(1, 1000):
            term *= x / (a + n)
            total += term
            if term < total * 1e-16:
                break
        return 1 - front * total
    b, c = x + 1 - a, 1e300
    d = out = 1 / b
    for n in range(1, 1000):
        b += 2
        d = 1 / (-n * (n - a) * d + b)
        c = b - n * (n - a) / c
        out *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return front * out


def chi2_sf(x: float, df: float) -> float:
    return _incomplete_gamma(df / 2, x / 2)


def f_sf(x: float, d1: float, d2: float) -> float:
    return _incomplete_beta(d2 / 2, d1 / 2, d2 / (d2 + d1 * x)) if x > 0 else 1.0


def t_cdf(t: float, df: float) -> float:
    tail = _incomplete_beta(df / 2, 0.5, df / (df + t * t)) / 2
    return 1 - tail if t > 0 else tail


def t_quantile(p: float, df: float) -> float:
    lo, hi = -1e6, 1e6
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if t_cdf(mid, df) < p else (lo, mid)
    return (lo + hi) / 2


def power(n: int, effect: float = 0.5, alpha: float = 0.05) -> float:
    """The approximate two-sided power of a t-test with n rows at the effect size."""
    if n < 3:
        return 0.0
    critical, se = t_quantile(1 - alpha / 2, n - 2), math.sqrt(2 / n)
    return 1 - t_cdf(critical - effect / se, n - 2) + t_cdf(-critical - effect / se, n - 2)


def tier_power(rows: DataFrame, tier: str, effect: float = 0.5) -> list[tuple]:
    """(tier, n, power) of each tier."""
    return [(r[0], r[1], power(r[1], effect)) for r in rows.groupBy(tier).count().orderBy(tier).collect()]


def bonferroni(p_values: list[float]) -> list[float]:
    return [min(1.0, p * len(p_values)) for p in p_values]


# ---------------------------------------------------------------- correlation


def ranked(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Rows without a null in the columns, with each one's mean ranks as r_column."""
    out = rows.where(reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in columns]))
    for c in dict.fromkeys(columns):
        out = ranking.average_ranks(out, c, f"r_{c}")
    return out


def spearman(rows: DataFrame, x: str, y: str) -> DataFrame:
    """(n, rho)."""
    return ranked(rows, [x, y]).agg(F.count(F.lit(1)).alias("n"), F.corr(f"r_{x}", f"r_{y}").alias("rho"))


def partial_spearman(rows: DataFrame, x: str, y: str, given: str) -> DataFrame:
    """(n, rho): of the residuals of both ranks after least squares on the third one's, which the three correlations give."""
    r = ranked(rows, [x, y, given])
    c = r.agg(F.count(F.lit(1)).alias("n"), F.corr(f"r_{x}", f"r_{y}").alias("xy"), F.corr(f"r_{x}", f"r_{given}").alias("xz"), F.corr(f"r_{y}", f"r_{given}").alias("yz"))
    return c.select("n", ((F.col("xy") - F.col("xz") * F.col("yz")) / F.nullif(F.sqrt((1 - F.col("xz") ** 2) * (1 - F.col("yz") ** 2)), F.lit(0.0))).alias("rho"))


def bootstrap_spearman(rows: DataFrame, x: str, y: str, key: str, resamples: int = 1000, level: float = 0.95) -> tuple[float, float, float]:
    """(rho, low, high): the correlation of the ranks over Poisson resamples of the rows. Each row's weight in a resample comes from its
    key; a task adds up the weighted moments of all resamples, so neither rows nor resamples are copied. Ranks are those of all rows."""
    names = [f"s{k}" for k in range(6)]
    r = ranked(rows, [x, y])
    half = r.agg(((F.count(F.lit(1)) + 1) / 2).alias("h")).first()[0] or 0.0

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((resamples, 6))
        for b in batches:
            for at in range(0, b.num_rows, 1000):
                part = b.slice(at, 1000)
                h, u, v = np.asarray(part.column("h")).view(np.uint64), np.asarray(part.column("u")) - half, np.asarray(part.column("v")) - half
                z = h[:, None] + np.arange(resamples, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
                z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
                z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
                uniform = ((z ^ (z >> np.uint64(31))) >> np.uint64(11)).astype(np.float64) / (1 << 53)
                w = np.searchsorted(_POISSON, uniform.ravel()).reshape(uniform.shape).astype(np.float64)
                total += w.T @ np.stack([np.ones_like(u), u, v, u * u, v * v, u * v], axis=1)
        yield pa.record_batch([pa.array(np.arange(resamples)), *(pa.array(total[:, k]) for k in range(6))], names=["b", *names])

    parts = r.select(F.xxhash64(key).alias("h"), F.col(f"r_{x}").cast("double").alias("u"), F.col(f"r_{y}").cast("double").alias("v")).mapInArrow(moments, "b long, " + ", ".join(f"{n} double" for n in names))
    sums = parts.groupBy("b").agg(*[F.sum(n).alias(n) for n in names]).orderBy("b").collect()  # one row a resample
    s = np.array([[q[n] for n in names] for q in sums])
    with np.errstate(invalid="ignore", divide="ignore"):
        n, u, v, uu, vv, uv = s.T
        rho = (uv - u * v / n) / np.sqrt((uu - u * u / n) * (vv - v * v / n))
    rho = rho[np.isfinite(rho)]
    if not len(rho):
        return math.nan, math.nan, math.nan
    tail = (1 - level) / 2
    return r.agg(F.corr(f"r_{x}", f"r_{y}")).first()[0], float(np.quantile(rho, tail)), float(np.quantile(rho, 1 - tail))


#: P(weight <= k) of a Poisson weight with mean 1.
_POISSON = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(20)])


def variance_inflation(rows: DataFrame, columns: list[str]) -> dict[str, float]:
    """Of each column 1 / (1 - R^2) against the others, over rows without a null: the diagonal of the inverse correlations."""
    whole = rows.where(reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in columns]))
    pairs = list(combinations(range(len(columns)), 2))
    found = whole.agg(*[F.corr(columns[i], columns[j]).alias(f"c{i}_{j}") for i, j in pairs]).first()
    m = np.eye(len(columns))
    for i, j in pairs:
        m[i, j] = m[j, i] = math.nan if found[f"c{i}_{j}"] is None else found[f"c{i}_{j}"]
    known = ~np.isnan(m).all(axis=1) & ~(np.isnan(m).sum(axis=1) >= len(columns) - 1) if len(columns) > 1 else np.ones(1, bool)  # a constant column has no correlation
    out = dict.fromkeys(columns, math.nan)
    if known.any():
        inverse = np.diag(np.linalg.pinv(m[np.ix_(known, known)]) if np.linalg.matrix_rank(m[np.ix_(known, known)]) < known.sum() else np.linalg.inv(m[np.ix_(known, known)]))
        out |= {c: float(v) for c, v in zip(np.array(columns)[known], inverse)}
    return out


def mutual_information(rows: DataFrame, x: str, y: str, bins: int = 10) -> DataFrame:
    """(mi): in nats, of the two columns cut into equally filled bins; equal values share a bin."""
    r = ranked(rows, [x, y])
    n = r.count()
    at = lambda c: F.floor((F.col(f"r_{c}") - 0.5) * bins / max(n, 1))
    cells = r.groupBy(at(x).alias("i"), at(y).alias("j")).agg(F.count(F.lit(1)).alias("n"))  # bins squared rows at most
    of_x, of_y = cells.groupBy("i").agg(F.sum("n").alias("nx")), cells.groupBy("j").agg(F.sum("n").alias("ny"))
    p = F.col("n") / n if n else F.lit(0.0)
    return cells.join(of_x, "i").join(of_y, "j").agg(F.coalesce(F.sum(p * F.log(F.col("n") * n / (F.col("nx") * F.col("ny")))), F.lit(0.0)).alias("mi"))


# ---------------------------------------------------------------- rank tests


def kruskal_wallis(rows: DataFrame, value: str, group: str) -> dict:
    """H corrected for ties, its p-value, and epsilon squared."""
    r = ranking.average_ranks(rows.where(F.col(group).isNotNull()), value, "r")
    sums = r.groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.sum("r").alias("s")).collect()  # one row a group
    n, k = sum(q["n"] for q in sums), len(sums)
    ties = r.groupBy(value).agg(F.count(F.lit(1)).cast("double").alias("t")).agg(F.sum(F.col("t") ** 3 - F.col("t"))).first()[0] or 0.0
    if n < 2 or k < 2:
        return {"h": math.nan, "p": math.nan, "epsilon_squared": math.nan, "n": n, "groups": k}
    h = 12 / (n * (n + 1)) * sum(q["s"] ** 2 / q["n"] for q in sums) - 3 * (n + 1)
    h = h / (1 - ties / (n**3 - n)) if ties < n**3 - n else 0.0
    return {"h": h, "p": chi2_sf(h, k - 1), "epsilon_squared": max((h - k + 1) / (n - k), 0.0) if n > k else math.nan, "n": n, "groups": k}


def mann_whitney(rows: DataFrame, value: str, first: str) -> dict:
    """U of the rows where the boolean column `first` is true, its two-sided p-value by the normal approximation with ties and
    continuity, and the rank-biserial correlation, positive if they are greater."""
    r = ranking.average_ranks(rows.where(F.col(first).isNotNull()), value, "r")
    n1, s1, n = r.agg(F.count(F.when(F.col(first), 1)), F.sum(F.when(F.col(first), F.col("r"))), F.count(F.lit(1))).first()
    n2 = n - n1
    if not n1 or not n2:
        return {"u": math.nan, "p": math.nan, "rank_biserial": math.nan, "n1": n1, "n2": n2}
    u = s1 - n1 * (n1 + 1) / 2
    ties = r.groupBy(value).agg(F.count(F.lit(1)).cast("double").alias("t")).agg(F.sum(F.col("t") ** 3 - F.col("t"))).first()[0]
    spread = math.sqrt(n1 * n2 / 12 * (n + 1 - ties / (n * (n - 1))))
    z = (abs(u - n1 * n2 / 2) - 0.5) / spread if spread else 0.0
    return {"u": u, "p": min(1.0, 2 * normal_sf(max(z, 0.0))), "rank_biserial": 2 * u / (n1 * n2) - 1, "n1": n1, "n2": n2}


def wilcoxon(rows: DataFrame, x: str, y: str) -> dict:
    """The signed-rank test of pairs: the smaller sum of ranks of the differences that aren't 0, and its p-value (normal approximation)."""
    d = rows.select((F.col(x) - F.col(y)).alias("d")).where("d <> 0")
    r = ranking.average_ranks(d.withColumn("a", F.abs("d")), "a", "r")
    n, plus, total, ties = r.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.when(F.col("d") > 0, F.col("r"))), F.lit(0.0)), F.sum("r"), F.lit(0)).first()
    if not n:
        return {"w": math.nan, "p": math.nan, "n": 0}
    ties = r.groupBy("a").agg(F.count(F.lit(1)).cast("double").alias("t")).agg(F.sum(F.col("t") ** 3 - F.col("t"))).first()[0]
    w = min(plus, total - plus)
    spread = math.sqrt(n * (n + 1) * (2 * n + 1) / 24 - ties / 48)
    return {"w": w, "p": min(1.0, 2 * normal_sf((n * (n + 1) / 4 - w) / spread)) if spread else 1.0, "n": n}


def levene(rows: DataFrame, value: str, group: str) -> dict:
    """Equality of the groups' spreads: the F statistic of the distances from the groups' medians."""
    known = rows.where(F.col(value).isNotNull() & F.col(group).isNotNull())
    medians = ranking.percentiles(known, value, {"__median": 0.5}, [group]).withColumnRenamed(group, "__g")
    d = known.join(F.broadcast(medians), F.col(group) == F.col("__g")).select(F.col(group).alias("g"), F.abs(F.col(value) - F.col("__median")).alias("d"))  # one row a group
    sums = d.groupBy("g").agg(F.count(F.lit(1)).alias("n"), F.avg("d").alias("m"), F.coalesce(F.var_pop("d"), F.lit(0.0)).alias("v")).collect()
    n, k = sum(q["n"] for q in sums), len(sums)
    within = sum(q["n"] * q["v"] for q in sums)
    if k < 2 or n <= k or not within:
        return {"w": math.nan, "p": math.nan, "n": n, "groups": k}
    mean = sum(q["n"] * q["m"] for q in sums) / n
    w = (n - k) / (k - 1) * sum(q["n"] * (q["m"] - mean) ** 2 for q in sums) / within
    return {"w": w, "p": f_sf(w, k - 1, n - k), "n": n, "groups": k}


#: Critical values of the normality test at these significance levels, in percent: fixed values.
ANDERSON_LEVELS, ANDERSON_CRITICAL = (15.0, 10.0, 5.0, 2.5, 1.0), (0.561, 0.631, 0.752, 0.873, 1.035)


def anderson(rows: DataFrame, value: str, key: str) -> dict:
    """The Anderson-Darling statistic against a normal distribution of the same mean and deviation, and the critical values for n."""
    known = rows.where(F.col(value).isNotNull()).select(F.col(value).cast("double").alias("v"), key)
    n, mean, sd = known.agg(F.count(F.lit(1)), F.avg("v"), F.stddev_samp("v")).first()
    if n < 3 or not sd:
        return {"a2": math.nan, "critical": {}, "n": n}

    def logs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            z = (np.asarray(b.column("v")) - mean) / sd / math.sqrt(2)
            low = np.array([math.log(max(0.5 * math.erfc(-x), 1e-300)) for x in z])
            high = np.array([math.log(max(0.5 * math.erfc(x), 1e-300)) for x in z])
            i = np.asarray(b.column("rn")).astype(np.float64)
            yield pa.record_batch([pa.array((2 * i - 1) * low + (2 * (n - i) + 1) * high)], names=["s"])

    total = ranking.numbered(known, "v", [key]).select("v", "rn").mapInArrow(logs, "s double").agg(F.sum("s")).first()[0]
    scale = 1 + 0.75 / n + 2.25 / n**2
    return {"a2": -n - total / n, "critical": {a: round(c / scale, 3) for a, c in zip(ANDERSON_LEVELS, ANDERSON_CRITICAL)}, "n": n}


# ---------------------------------------------------------------- time series


def _least_squares(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Coefficients, their standard errors, and the sum of squared residuals."""
    beta, *_ = np.linalg.lstsq(x, y, rcond=None)
    rest = float(((y - x @ beta) ** 2).sum())
    cov = np.linalg.pinv(x.T @ x) * rest / max(len(y) - x.shape[1], 1)
    return beta, np.sqrt(np.maximum(np.diag(cov), 0)), rest


#: Critical values at 1, 5 and 10 %: of the unit root test with a constant, of the residuals of two series, of level stationarity. Fixed values.
ADF_CRITICAL, COINTEGRATION_CRITICAL, KPSS_CRITICAL = (-3.43, -2.86, -2.57), (-3.90, -3.34, -3.04), (0.739, 0.463, 0.347)


def adf(y: np.ndarray, most_lags: int | None = None) -> tuple[float, int]:
    """The Dickey-Fuller statistic with a constant, and the number of lagged differences, of least AIC over the same rows."""
    y = np.asarray(y, float)
    n = len(y)
    most = min(int(12 * (n / 100) ** 0.25) if most_lags is None else most_lags, n // 2 - 3)
    if most < 0 or not np.ptp(y):
        return math.nan, 0
    d = np.diff(y)

    def fit(lags: int, skip: int) -> tuple[float, float]:
        rows = np.arange(max(lags, skip), len(d))
        x = np.column_stack([np.ones(len(rows)), y[rows], *(d[rows - k] for k in range(1, lags + 1))])
        beta, se, rest = _least_squares(x, d[rows])
        return len(rows) * math.log(max(rest, 1e-300) / len(rows)) + 2 * x.shape[1], beta[1] / se[1] if se[1] else math.nan

    best = min(range(most + 1), key=lambda k: fit(k, most)[0])
    return fit(best, best)[1], best


def kpss(y: np.ndarray) -> float:
    """The statistic of level stationarity with Bartlett's weights over 12 (n / 100)^(1/4) lags."""
    y = np.asarray(y, float)
    n, e = len(y), np.asarray(y, float) - np.mean(y)
    lags = min(n - 1, int(math.ceil(12 * (n / 100) ** 0.25)))
    long_run = (e @ e + 2 * sum((1 - k / (lags + 1)) * (e[k:] @ e[:-k]) for k in range(1, lags + 1))) / n
    return float((np.cumsum(e) ** 2).sum() / n**2 / long_run) if long_run > 0 else math.nan


def ljung_box(y: np.ndarray, lags: int = 10) -> tuple[float, float]:
    """(Q, p) of the first autocorrelations."""
    e = np.asarray(y, float) - np.mean(y)
    n, total = len(e), float(e @ e)
    lags = min(lags, n - 1)
    if not total or lags < 1:
        return math.nan, math.nan
    q = n * (n + 2) * sum((float(e[k:] @ e[:-k]) / total) ** 2 / (n - k) for k in range(1, lags + 1))
    return q, chi2_sf(q, lags)


def engle_granger(x: np.ndarray, y: np.ndarray) -> dict:
    """Least squares of y on x, the unit root statistic of the spread with its critical values, and the spread's half-life in rows."""
    x, y = np.asarray(x, float), np.asarray(y, float)
    beta, _, _ = _least_squares(np.column_stack([np.ones(len(x)), x]), y)
    spread = y - beta[0] - beta[1] * x
    stat, _ = adf(spread)
    step, _, _ = _least_squares(np.column_stack([np.ones(len(x) - 1), spread[:-1]]), np.diff(spread))
    return {"intercept": float(beta[0]), "slope": float(beta[1]), "statistic": stat, "critical": COINTEGRATION_CRITICAL, "half_life": -math.log(2) / step[1] if step[1] < 0 else math.inf}


def granger(cause: np.ndarray, effect: np.ndarray, lags: int) -> tuple[float, float]:
    """(F, p): whether the cause's lags help to predict the effect beside its own."""
    cause, effect = np.asarray(cause, float), np.asarray(effect, float)
    rows = np.arange(lags, len(effect))
    own = np.column_stack([np.ones(len(rows)), *(effect[rows - k] for k in range(1, lags + 1))])
    both = np.column_stack([own, *(cause[rows - k] for k in range(1, lags + 1))])
    free = len(rows) - both.shape[1]
    if free < 1:
        return math.nan, math.nan
    without, rest = _least_squares(own, effect[rows])[2], _least_squares(both, effect[rows])[2]
    f = (without - rest) / lags / (rest / free) if rest else math.inf
    return f, f_sf(f, lags, free)


def breaks(y: np.ndarray, penalty: float | None = None, least: int = 2) -> list[int]:
    """Binary segmentation by means: where a new level begins, as long as a cut saves more than the penalty (log n times the variance
    of the differences, if none is given)."""
    y = np.asarray(y, float)
    if len(y) < 2 * least or not np.ptp(y):
        return []
    penalty = math.log(len(y)) * max(float(np.var(np.diff(y))), 1e-12) if penalty is None else penalty
    s, q = np.concatenate([[0], np.cumsum(y)]), np.concatenate([[0], np.cumsum(y * y)])
    cost = lambda a, b: q[b] - q[a] - (s[b] - s[a]) ** 2 / (b - a)
    found, todo = [], [(0, len(y))]
    while todo:
        a, b = todo.pop()
        if b - a < 2 * least:
            continue
        gain, at = max((cost(a, b) - cost(a, m) - cost(m, b), -m) for m in range(a + least, b - least + 1))
        if gain > penalty:
            found.append(-at)
            todo += [(a, -at), (-at, b)]
    return sorted(found)


def seasonal(y: np.ndarray, period: int = 7) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(trend, season, rest): a centred moving mean over the period, nearest value at the ends; the season is the mean of what the trend
    leaves at each place of the period, with mean 0."""
    y = np.asarray(y, float)
    weights = np.ones(period) / period if period % 2 else np.r_[0.5, np.ones(period - 1), 0.5] / period
    side = len(weights) // 2
    trend = np.full(len(y), np.nan)
    if len(y) >= len(weights):
        trend[side : len(y) - side] = np.convolve(y, weights, "valid")
        trend[:side], trend[len(y) - side :] = trend[side], trend[len(y) - side - 1]
    else:
        trend[:] = y.mean() if len(y) else np.nan
    left = y - trend
    places = np.array([left[i::period].mean() if i < len(y) else 0.0 for i in range(period)])
    season = (places - places[: min(period, max(len(y), 1))].mean())[np.arange(len(y)) % period]
    return trend, season, y - trend - season


def by_key(rows: DataFrame, key: str, order: str, value: str, test: Callable[[np.ndarray], dict], schema: str, least: int = 20) -> DataFrame:
    """The test of each key's values in order, of keys with at least so many; nulls are left out. A key's rows meet in one task: as many
    as the history has days. test gives the columns of the schema that follow key and n_obs."""
    kind = dict(rows.dtypes)[key]

    def run(group: pd.DataFrame) -> pd.DataFrame:
        y = group.sort_values(order)[value].to_numpy(float)
        return pd.DataFrame([{key: group[key].iloc[0], "n_obs": len(y)} | test(y)] if len(y) >= least else [], columns=[key, "n_obs", *(c.split()[0] for c in schema.split(", "))])

    return rows.where(F.col(value).isNotNull()).select(key, order, value).groupBy(key).applyInPandas(run, f"{key} {kind}, n_obs long, {schema}")


def stationarity(rows: DataFrame, key: str = "uuid", order: str = "snapshot_date", value: str = "eur", least: int = 20) -> DataFrame:
    """(key, n_obs, adf, lags, kpss, ljung_box, ljung_box_p, has_unit_root, is_level) of each key."""

    def test(y: np.ndarray) -> dict:
        stat, lags = adf(y)
        level, (q, p) = kpss(y), ljung_box(y)
        return {"adf": stat, "lags": lags, "kpss": level, "ljung_box": q, "ljung_box_p": p, "has_unit_root": bool(not stat < ADF_CRITICAL[1]), "is_level": bool(level < KPSS_CRITICAL[1])}

    return by_key(rows, key, order, value, test, "adf double, lags int, kpss double, ljung_box double, ljung_box_p double, has_unit_root boolean, is_level boolean", least)


def structural_breaks(rows: DataFrame, key: str = "uuid", order: str = "snapshot_date", value: str = "eur", least: int = 20) -> DataFrame:
    """(key, n_obs, n_breaks, at) of each key; at: the places where a new level begins."""
    return by_key(rows, key, order, value, lambda y: {"n_breaks": len(found := breaks(y)), "at": found}, "n_breaks int, at array<long>", least)
