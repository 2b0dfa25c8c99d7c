"""Distribution functions for test statistics, in plain Python."""

from __future__ import annotations

import math


def gamma_q(a: float, x: float) -> float:
    """Regularised upper incomplete gamma function."""
    if x <= 0 or a <= 0:
        return 1.0
    if x < a + 1:
        term = total = 1 / a
        n = a
        for _ in range(10_000):
            n += 1
            term *= x / n
            total += term
            if term < total * 1e-16:
                break
        return max(0.0, 1 - total * math.exp(a * math.log(x) - x - math.lgamma(a)))
    tiny = 1e-300
    b = x + 1 - a
    c, d = 1 / tiny, 1 / b
    h = d
    for i in range(1, 10_000):
        k = -i * (i - a)
        b += 2
        d = 1 / (k * d + b or tiny)
        c = b + k / c or tiny
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return h * math.exp(a * math.log(x) - x - math.lgamma(a))


def chi2_sf(x: float | None, df: float | None) -> float | None:
    return None if x is None or df is None or df <= 0 else gamma_q(df / 2, x / 2)


def beta_inc(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function by its continued fraction."""
    if x <= 0:
        return 0.0
    if x >= 1:
        return 1.0
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_inc(b, a, 1 - x)
    tiny = 1e-300
    c, d = 1.0, 1 / (1 - (a + b) * x / (a + 1) or tiny)
    h = d
    for m in range(1, 10_000):
        k = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        d = 1 / (1 + k * d or tiny)
        c = 1 + k / c or tiny
        h *= d * c
        k = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1 / (1 + k * d or tiny)
        c = 1 + k / c or tiny
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return h * math.exp(a * math.log(x) + b * math.log1p(-x) + math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)) / a


def t_sf2(t: float | None, df: float | None) -> float | None:
    """Two-sided tail of Student's t."""
    return None if t is None or df is None or df <= 0 else beta_inc(df / 2, 0.5, df / (df + t * t))


#: Two-sample Kolmogorov-Smirnov tails are exact up to this size of the larger sample, asymptotic beyond.
EXACT_KS = 10_000


def ks_sf(d: float | None, n: int, m: int) -> float | None:
    """Asymptotic tail of the two-sample Kolmogorov-Smirnov statistic."""
    if d is None or not n or not m:
        return None
    x = d * math.sqrt(n * m / (n + m))
    if x < 0.2:
        return 1.0
    total = sum((-1) ** (k - 1) * math.exp(-2 * k * k * x * x) for k in range(1, 101))
    return min(1.0, max(0.0, 2 * total))


def ks_sf_exact(d: float | None, n: int, m: int) -> float | None:
    """Tail of the statistic for samples of up to EXACT_KS rows: the share of lattice paths from (0, 0) to (n, m) that reach a gap of d or more."""
    if d is None or not n or not m:
        return None
    if max(n, m) > EXACT_KS:
        return ks_sf(d, n, m)
    import numpy as np

    # probability of staying inside, row by row: step (i-1, j) -> (i, j) has probability (n-i+1) / (n-i+1 + m-j) given that the path is at (i-1, j)
    j = np.arange(m + 1)
    inside = lambda i: np.abs(i / n - j / m) < d - 1e-12
    gap = np.rint(d * n * m)
    ok = lambda i: np.abs(i * m - j * n) < gap
    ok = ok if abs(gap - d * n * m) < 1e-6 * n * m else inside
    p = np.zeros(m + 1)
    for i in range(n + 1):
        # arrive from the row before, then walk along the row: p[j] += p[j-1] * P(step in j)
        here = ok(i)
        arrive = p * ((n - i + 1) / np.maximum((n - i + 1) + (m - j), 1)) if i else np.where(j == 0, 1.0, 0.0)
        along = np.where(j < m, (m - j) / np.maximum((n - i) + (m - j), 1), 0.0)
        out, last = arrive.tolist(), 0.0
        for k, (good, step) in enumerate(zip(here.tolist(), [0.0, *along[:-1].tolist()])):
            last = (out[k] + last * step) if good else 0.0
            out[k] = last
        p = np.array(out)
    return min(1.0, max(0.0, 1.0 - float(p[m])))


def log_factorial(x):
    """log(x!) of an array, by Stirling's series beyond the first few."""
    import numpy as np

    x = np.asarray(x, float)
    table = np.concatenate([[0.0], np.cumsum(np.log(np.arange(1.0, 256)))])
    y = np.maximum(x, 1.0)
    series = (y + 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5)
    return np.where(x < 256, table[np.minimum(x, 255).astype(np.int64)], series)


def expected_mutual_info(a: list[int], b: list[int]) -> float:
    """Expected mutual information of two partitions with these class sizes, under random assignment.

    One term for each two distinct sizes, summed over the overlaps within 40 deviations of the mean (all others weigh nothing).
    """
    from collections import Counter

    import numpy as np

    n, total = sum(a), 0.0
    fact = lambda *v: log_factorial(np.array(v, float))
    for x, cx in Counter(a).items():
        for y, cy in Counter(b).items():
            mean = x * y / n
            reach = 40 * math.sqrt(mean * max(n - x, 1) * max(n - y, 1) / n / max(n - 1, 1)) + 40
            k = np.arange(max(1, x + y - n, math.floor(mean - reach)), min(x, y, math.ceil(mean + reach)) + 1, dtype=float)
            const = fact(x, y, n - x, n - y).sum() - fact(n)[0]
            p = np.exp(const - log_factorial(k) - log_factorial(x - k) - log_factorial(y - k) - log_factorial(n - x - y + k))
            total += cx * cy * float((k / n * np.log(n * k / (x * y)) * p).sum())
    return total
