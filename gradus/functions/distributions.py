"""Normal, Student t, chi-square and F probabilities, by continued fractions and bisection."""

from __future__ import annotations

import math
from statistics import NormalDist

NORMAL = NormalDist()


def gamma_p(a: float, x: float) -> float:
    """Regularised lower incomplete gamma."""
    if x <= 0:
        return 0.0
    log_front = a * math.log(x) - x - math.lgamma(a)
    if x < a + 1:
        term = total = 1 / a
        n = a
        while abs(term) > 1e-17 * abs(total):
            n += 1
            term *= x / n
            total += term
        return min(1.0, total * math.exp(log_front))
    b, c, d = x + 1 - a, 1e300, 1 / (x + 1 - a)
    h = d
    for i in range(1, 10_000):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b or 1e-300)
        c = b + an / c or 1e-300
        h *= d * c
        if abs(d * c - 1) < 1e-16:
            break
    return 1 - math.exp(log_front) * h


def beta_i(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_i(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    c, d = 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d or 1e-300)
    h = d
    for m in range(1, 10_000):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / (1 + num * d or 1e-300)
            c = 1 + num / c or 1e-300
            h *= c * d
        if abs(c * d - 1) < 1e-16:
            break
    return front * h


def chi2_sf(x: float, df: float) -> float:
    return 1 - gamma_p(df / 2, x / 2) if x > 0 else 1.0


def f_sf(x: float, df1: float, df2: float) -> float:
    return beta_i(df2 / 2, df1 / 2, df2 / (df2 + df1 * x)) if x > 0 else 1.0


def t_cdf(t: float, df: float) -> float:
    tail = beta_i(df / 2, 0.5, df / (df + t * t)) / 2
    return 1 - tail if t > 0 else tail


def t_ppf(p: float, df: float) -> float:
    low, high = -1e6, 1e6
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if t_cdf(mid, df) < p else (low, mid)
    return (low + high) / 2


def two_sided(z: float) -> float:
    """Normal p-value."""
    return 2 * (1 - NORMAL.cdf(abs(z))) if math.isfinite(z) else 1.0


def minimum_detectable(se: float, clusters: int, alpha: float = 0.05, power: float = 0.8) -> float:
    """F-28: the effect that a test with this standard error detects with the power."""
    df = max(clusters - 2, 1)
    return se * (t_ppf(1 - alpha / 2, df) + t_ppf(power, df))


def equivalence_bound(estimate: float, se: float, clusters: int, alpha: float = 0.05) -> float:
    """F-29: the least symmetric bound within which the estimate is equivalent to zero."""
    return abs(estimate) + se * t_ppf(1 - alpha, max(clusters - 2, 1))


def projected_se(se: float, clusters: int, new_clusters: int) -> float:
    """F-29."""
    return se * math.sqrt(clusters / new_clusters)


def required_clusters(se: float, clusters: int, effect: float, alpha: float = 0.05, power: float = 0.8, most: int = 5000) -> int | None:
    """F-29: the least number of clusters at which the effect is detectable; what is detectable falls with it, so halves are tried."""
    seen = lambda g: minimum_detectable(projected_se(se, clusters, g), g, alpha, power) <= effect
    low, high = 3, most
    if not seen(high):
        return None
    while low < high:
        mid = (low + high) // 2
        low, high = (low, mid) if seen(mid) else (mid + 1, high)
    return low


def direction_ok(direction: str, estimate: float, p: float, alpha: float = 0.05) -> bool:
    """F-27: significant, and on the expected side if one is expected."""
    if not math.isfinite(estimate) or p >= alpha:
        return False
    return estimate > 0 if direction == "positive" else estimate < 0 if direction == "negative" else True
