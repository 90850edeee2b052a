"""Statistics on sufficient statistics (T-).

One aggregation makes, for each cell and cluster, the number of rows and the
products of the design's columns and the outcome; everything after it works on
these few numbers per cluster: cluster-robust least squares, random intercept and
slope models; the bootstraps are in ``resampling``.  A
cell's clusters are the units of its design, so a cell is one group of a
grouped map.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import distributions as dist

NORMAL = dist.NORMAL


# ----- designs


@dataclass(frozen=True)
class Design:
    """A formula's outcome and terms; terms are products of columns, ``C(x)`` absorbs a factor."""

    outcome: str
    terms: tuple[str, ...]
    factor: str | None

    @property
    def names(self) -> list[str]:
        return (["Intercept"] if self.factor is None else []) + [t for t in self.terms]


def design(formula: str) -> Design:
    """``y ~ a * b``, ``a + b``, ``a:b``, ``1`` and one ``C(x)``."""
    left, right = (x.strip() for x in formula.split("~"))
    terms, factor = [], None
    for part in (p.strip() for p in right.split("+")):
        if part == "1":
            continue
        if m := re.fullmatch(r"C\((\w+)\)", part):
            factor = m[1]
        elif "*" in part:
            names = [n.strip() for n in part.split("*")]
            for mask in sorted(range(1, 2 ** len(names)), key=lambda k: (k.bit_count(), k)):
                terms.append(":".join(n for i, n in enumerate(names) if mask >> i & 1))
        else:
            terms.append(part)
    return Design(left, tuple(dict.fromkeys(terms)), factor)


def term_column(term: str) -> Column:
    out = F.lit(1.0)
    for name in term.split(":"):
        if name != "Intercept":
            out = out * F.col(name).cast("double")
    return out


def sufficient(df: DataFrame, d: Design, cell: Sequence[str], cluster: str) -> DataFrame:
    """For each cell and cluster: n, the sums of column products (row-major) and of columns with the outcome, and y'y.

    Rows with a null in a used column are left out.  A factor is absorbed by
    taking deviations from its levels' means.
    """
    names = d.names
    x = {n: term_column(n) for n in names} | {"__y": F.col(d.outcome).cast("double")}
    rows = df.select(*cell, F.col(cluster).cast("string").alias("cluster"), *([F.col(d.factor).alias("__f")] if d.factor else []), *[c.alias(f"x{i}") for i, c in enumerate(x.values())])
    cols = [f"x{i}" for i in range(len(x))]
    rows = rows.dropna(subset=["cluster", *cols]).filter(~F.isnan(cols[-1]))
    if d.factor:
        means = rows.groupBy(*cell, "__f").agg(*[F.avg(c).alias(f"m_{c}") for c in cols])
        rows = rows.join(means, [*cell, "__f"]).withColumns({c: F.col(c) - F.col(f"m_{c}") for c in cols})
    k = len(names)
    pairs = [F.sum(F.col(cols[i]) * F.col(cols[j])).alias(f"p{i}_{j}") for i in range(k + 1) for j in range(i, k + 1)]
    sums = rows.groupBy(*cell, "cluster").agg(F.count("*").alias("n"), *pairs, *([F.count_distinct("__f").alias("levels")] if d.factor else []))
    at = lambda i, j: F.col(f"p{min(i, j)}_{max(i, j)}")
    return sums.select(
        *cell,
        "cluster",
        "n",
        (F.col("levels") if d.factor else F.lit(0)).cast("bigint").alias("levels"),
        F.array(*[at(i, j) for i in range(k) for j in range(k)]).alias("xx"),
        F.array(*[at(i, k) for i in range(k)]).alias("xy"),
        at(k, k).alias("yy"),
    )


@dataclass
class Clusters:
    """The sums of one cell's clusters, in order of the clusters' names."""

    n: np.ndarray
    xx: np.ndarray
    xy: np.ndarray
    yy: np.ndarray
    absorbed: int
    names: list[str]

    @classmethod
    def of(cls, pdf: pd.DataFrame) -> Clusters:
        pdf = pdf.sort_values("cluster")
        k = len(pdf["xy"].iloc[0])
        return cls(pdf["n"].to_numpy(float), np.array(pdf["xx"].tolist(), float).reshape(-1, k, k), np.array(pdf["xy"].tolist(), float), pdf["yy"].to_numpy(float), int(pdf["levels"].sum()), pdf["cluster"].tolist())


@dataclass
class Designs:
    """The sums of one cell's clusters over those with the same products xx, of which there are g (see ``by_design``)."""

    g: np.ndarray
    n: np.ndarray
    xx: np.ndarray
    xy: np.ndarray
    zyzy: np.ndarray
    yy: np.ndarray

    @classmethod
    def of(cls, pdf: pd.DataFrame) -> Designs:
        pdf = pdf.sort_values("xx", key=lambda s: s.map(tuple))
        k = len(pdf["xy"].iloc[0])
        return cls(pdf["g"].to_numpy(float), pdf["n"].to_numpy(float), np.array(pdf["xx"].tolist(), float).reshape(-1, k, k), np.array(pdf["xy"].tolist(), float), np.array(pdf["zyzy"].tolist(), float).reshape(-1, 2, 2), pdf["yy"].to_numpy(float))


def _solve(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.linalg.pinv(a) @ b


# ----- T-02, T-16, T-18: least squares with cluster-robust errors


def ols(c: Clusters) -> tuple[np.ndarray, np.ndarray]:
    """Coefficients and their covariance; the factor G/(G-1) (n-1)/(n-k) as in common packages."""
    a = c.xx.sum(axis=0)
    inverse = np.linalg.pinv(a)
    beta = inverse @ c.xy.sum(axis=0)
    scores = c.xy - c.xx @ beta
    g, n, k = len(c.n), c.n.sum(), len(beta) + c.absorbed
    factor = g / max(g - 1, 1) * (n - 1) / max(n - k, 1)
    return beta, factor * inverse @ (scores.T @ scores) @ inverse


# ----- T-01, T-10, T-13, T-15: random intercepts


def _profile(c: Clusters, rho: float, reml: bool) -> tuple[float, np.ndarray, np.ndarray, float]:
    """Log likelihood at rho = var(cluster) / var(residual), with coefficients, (X'V^-1 X)^-1 times the residual variance, and it.

    The first column is the intercept, so its products are the clusters' sums.
    """
    shrink = rho / (1 + c.n * rho)
    sx, sy = c.xx[:, 0, :], c.xy[:, 0]
    a = c.xx.sum(axis=0) - np.einsum("g,gi,gj->ij", shrink, sx, sx)
    b = c.xy.sum(axis=0) - np.einsum("g,gi,g->i", shrink, sx, sy)
    inverse = np.linalg.pinv(a)
    beta = inverse @ b
    rss = max(c.yy.sum() - (shrink * sy * sy).sum() - b @ beta, 1e-300)
    n, k = c.n.sum(), len(beta)
    m = n - k if reml else n
    variance = rss / m
    log = -0.5 * (m * math.log(2 * math.pi * variance) + m + np.log1p(c.n * rho).sum())
    if reml:
        log -= 0.5 * np.linalg.slogdet(a)[1]
    return float(log), beta, variance * inverse, variance


def lmm(c: Clusters, reml: bool = False) -> dict:
    """Random-intercept model by one-dimensional search over the variance ratio."""
    grid = np.concatenate([[0.0], np.exp(np.linspace(-12, 8, 81))])
    values = [_profile(c, r, reml)[0] for r in grid]
    i = int(np.argmax(values))
    low, high = grid[max(i - 1, 0)], grid[min(i + 1, len(grid) - 1)]
    golden = (math.sqrt(5) - 1) / 2
    x, y = high - golden * (high - low), low + golden * (high - low)
    fx, fy = _profile(c, x, reml)[0], _profile(c, y, reml)[0]
    for _ in range(120):
        if fx >= fy:
            high, y, fy = y, x, fx
            x = high - golden * (high - low)
            fx = _profile(c, x, reml)[0]
        else:
            low, x, fx = x, y, fy
            y = low + golden * (high - low)
            fy = _profile(c, y, reml)[0]
    rho = max(((low + high) / 2, grid[i]), key=lambda r: _profile(c, r, reml)[0])
    log, beta, cov, variance = _profile(c, rho, reml)
    return {"beta": beta, "cov": cov, "log_likelihood": log, "var_cluster": rho * variance, "var_resid": variance, "converged": 0 < i < len(grid) - 1 or values[0] == max(values)}


# ----- T-09, T-19: random slopes


def random_slope(c: Designs, at: int, rounds: int = 400) -> dict:
    """Random intercept and slope of one term by EM on the sums of clusters that share their design."""
    z = [0, at]
    k = c.xy.shape[1]
    n, g = c.n.sum(), c.g
    xx, xy, yy = np.einsum("q,qij->ij", g, c.xx), c.xy.sum(axis=0), c.yy.sum()
    beta = _solve(xx, xy)
    s2 = max((yy - beta @ xy) / n, 1e-9)
    d = np.eye(2) * s2 * 0.2
    last, converged = -np.inf, False
    zz, zx, zy = c.xx[:, z][:, :, z], c.xx[:, z, :], c.xy[:, z]
    for _ in range(rounds):
        inner = np.linalg.inv(np.linalg.inv(d)[None] + zz / s2)
        gain = inner @ zx / s2
        a = xx / s2 - np.einsum("q,qia,qib->ab", g, zx, gain) / s2
        b = xy / s2 - np.einsum("qia,qi->a", gain, zy) / s2
        beta = _solve(a, b)
        # Sums over a design's clusters of r r' and u u', where r = zy - zx beta and u = inner r / s2.
        m = zx @ beta
        cross = np.einsum("qi,qj->qij", zy, m)
        rr = c.zyzy - cross - cross.transpose(0, 2, 1) + g[:, None, None] * np.einsum("qi,qj->qij", m, m)
        uu = inner @ rr @ inner / s2**2
        ru = np.einsum("qij,qij->", inner, rr) / s2
        rss = yy - 2 * beta @ xy + beta @ xx @ beta
        quad = rss / s2 - ru / s2
        log = -0.5 * (n * math.log(2 * math.pi * s2) + quad + g @ np.linalg.slogdet(np.eye(2) + d @ zz / s2)[1])
        cov = np.linalg.pinv(a)
        e = rss - 2 * ru + np.einsum("qij,qji->", uu, zz) + np.einsum("q,qij,qji->", g, zz, inner)
        d = (uu.sum(axis=0) + np.einsum("q,qij->ij", g, inner)) / g.sum() + 1e-12 * np.eye(2)
        s2 = max(e / n, 1e-12)
        if abs(log - last) < 1e-9 * (1 + abs(log)):
            converged = True
            break
        last = log
    return {"beta": float(beta[at]), "se": float(math.sqrt(max(cov[at, at], 0))), "slope_variance": float(d[1, 1]), "converged": converged, "k": k}


def qualified(primary_width: float | None, slope_width: float | None, slope_variance: float | None, ratio: float = 1.5, variance: float = 0.05) -> bool:
    """T-09: the slope interval is much wider, its variance matters, or neither could be had."""
    wide = slope_width / primary_width if primary_width and slope_width else None
    return (wide is not None and wide > ratio) or (slope_variance is not None and slope_variance > variance) or (wide is None and slope_variance is None)


# ----- cells


def by_cell(df: DataFrame, formula: str, cell: Sequence[str], cluster: str, fit: Callable[[Clusters, list[str]], dict], schema: str) -> DataFrame:
    """``fit`` on each cell's clusters; ``schema`` is that of its result."""
    d = design(formula)
    names = d.names
    keys = list(cell)
    sums = sufficient(df, d, keys, cluster)
    if not keys:
        sums, keys = sums.withColumn("__all", F.lit(0)), ["__all"]
    types = {f.name: f.dataType.simpleString() for f in sums.schema.fields}

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        row = fit(Clusters.of(pdf), names)
        return pd.DataFrame([{**{k: pdf[k].iloc[0] for k in keys}, **row}])

    out = sums.groupBy(*keys).applyInPandas(run, ", ".join([*[f"{k} {types[k]}" for k in keys], schema]))
    return out.drop("__all") if not cell else out


def ols_table(df: DataFrame, formula: str, term: str, cell: Sequence[str], cluster: str) -> DataFrame:
    """T-02, T-16, T-18."""

    def fit(c: Clusters, names: list[str]) -> dict:
        beta, cov = ols(c)
        at = names.index(term)
        b, s = float(beta[at]), float(math.sqrt(max(cov[at, at], 0)))
        return {"estimate": b, "se": s, "t": b / s if s > 0 else None, "p_value": dist.two_sided(b / s) if s > 0 else 1.0, "n_obs": int(c.n.sum()), "n_groups": len(c.n)}

    return by_cell(df, formula, cell, cluster, fit, "estimate double, se double, t double, p_value double, n_obs bigint, n_groups bigint")


def by_design(sums: DataFrame, cell: Sequence[str], k: int, at: int) -> DataFrame:
    """Clusters (see ``sufficient``) of a cell whose products of columns are equal, as one row: what random slopes of term ``at`` need of them.

    Codes have few values, so there are as many designs as numbers of rows at
    each code, however many clusters there are; clusters of a column without
    repeated values keep a row each.
    """
    of = lambda i: F.element_at("xy", F.lit(i + 1))
    return sums.groupBy(*cell, "xx").agg(
        F.count("*").alias("g"),
        F.sum("n").alias("n"),
        F.array(*[F.sum(of(i)) for i in range(k)]).alias("xy"),
        F.array(*[F.sum(of(i) * of(j)) for i in (0, at) for j in (0, at)]).alias("zyzy"),
        F.sum("yy").alias("yy"),
    )


def slope_table(df: DataFrame, formula: str, term: str, cell: Sequence[str], cluster: str) -> DataFrame:
    """T-09, T-19."""
    d = design(formula)
    k, at = len(d.names), d.names.index(term)
    keys = list(cell) or ["__all"]
    rows = by_design(sufficient(df, d, list(cell), cluster).withColumn("__all", F.lit(0)), keys, k, at)
    types = {f.name: f.dataType.simpleString() for f in rows.schema.fields}

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        m = random_slope(Designs.of(pdf), at)
        return pd.DataFrame([{**{x: pdf[x].iloc[0] for x in keys}, "estimate": m["beta"], "se": m["se"], "slope_variance": m["slope_variance"], "converged": m["converged"], "n_groups": int(pdf["g"].sum())}])

    out = rows.groupBy(*keys).applyInPandas(run, ", ".join([*[f"{x} {types[x]}" for x in keys], "estimate double, se double, slope_variance double, converged boolean, n_groups bigint"]))
    return out if cell else out.drop("__all")


def variance_components(df: DataFrame, cell: Sequence[str], group: str, value: str) -> DataFrame:
    """T-12: moments for unbalanced groups, in SQL; icc and the design effect (T-14) beside them."""
    g = df.filter(F.col(value).isNotNull()).groupBy(*cell, group).agg(F.count("*").alias("n"), F.avg(value).alias("m"), F.var_pop(value).alias("v"))
    s = g.groupBy(*cell).agg(
        F.sum("n").alias("n_total"), F.count("*").alias("k"), F.sum(F.col("n") * F.col("v")).alias("ssw"), F.sum(F.col("n") * F.col("m")).alias("s1"), F.sum(F.col("n") * F.col("m") * F.col("m")).alias("s2"), F.sum(F.col("n") * F.col("n")).alias("nn")
    )
    s = s.withColumn("ssb", F.col("s2") - F.col("s1") * F.col("s1") / F.col("n_total"))
    between, within = F.col("k") - 1, F.col("n_total") - F.col("k")
    msb, msw = F.when(between > 0, F.try_divide("ssb", between)).otherwise(0.0), F.when(within > 0, F.try_divide("ssw", within)).otherwise(0.0)
    n0 = F.when(between > 0, F.try_divide(F.col("n_total") - F.col("nn") / F.col("n_total"), between)).otherwise(F.col("n_total") / F.col("k"))
    s = s.withColumn("var_resid", F.greatest(msw, F.lit(1e-9))).withColumn("var_group", F.greatest(F.lit(0.0), F.try_divide(msb - msw, n0)))
    icc = F.col("var_group") / (F.col("var_group") + F.col("var_resid"))
    return s.select(*cell, "var_group", "var_resid", icc.alias("icc"), (1 + (F.col("n_total") / F.col("k") - 1) * icc).alias("design_effect"), F.col("k").alias("n_groups"), F.col("n_total").alias("n_obs"))


# ----- T-08, T-17: likelihoods on counts of distinct rows


def _newton(value: Callable[[np.ndarray], float], start: np.ndarray, rounds: int = 60) -> tuple[np.ndarray, np.ndarray, bool]:
    """Minimum by damped Newton steps on central differences; (x, inverse of the curvature, converged)."""
    x, k = start.copy(), len(start)
    for _ in range(rounds):
        h = 1e-4
        e = np.eye(k) * h
        f0 = value(x)
        grad = np.array([(value(x + e[i]) - value(x - e[i])) / (2 * h) for i in range(k)])
        curve = np.empty((k, k))
        for i in range(k):
            for j in range(i, k):
                curve[i, j] = curve[j, i] = (value(x + e[i] + e[j]) - value(x + e[i] - e[j]) - value(x - e[i] + e[j]) + value(x - e[i] - e[j])) / (4 * h * h)
        step = np.linalg.pinv(curve) @ grad
        scale = 1.0
        while scale > 1e-6 and not value(x - scale * step) < f0 + 1e-12:
            scale /= 2
        x = x - scale * step
        if np.abs(scale * step).max() < 1e-7:
            return x, np.linalg.pinv(curve), True
    return x, np.linalg.pinv(curve), False


def _on_counts(df: DataFrame, formula: str, cell: Sequence[str], fit: Callable[[np.ndarray, np.ndarray, np.ndarray, list[str]], dict], schema: str) -> DataFrame:
    """Distinct rows of the design with their counts, then a grouped map for each cell."""
    d = design(formula)
    names = d.names
    cols = [term_column(n).alias(f"x{i}") for i, n in enumerate(names)]
    keys = list(cell) or ["__all"]
    rows = df.withColumn("__all", F.lit(0)).select(*keys, *cols, F.col(d.outcome).cast("double").alias("y")).dropna()
    counts = rows.groupBy(*keys, *[f"x{i}" for i in range(len(names))], "y").agg(F.count("*").alias("n"))
    types = {f.name: f.dataType.simpleString() for f in counts.schema.fields}

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf[[f"x{i}" for i in range(len(names))]].to_numpy(float)
        return pd.DataFrame([{**{k: pdf[k].iloc[0] for k in keys}, **fit(x, pdf["y"].to_numpy(float), pdf["n"].to_numpy(float), names)}])

    out = counts.groupBy(*keys).applyInPandas(run, ", ".join([*[f"{k} {types[k]}" for k in keys], schema]))
    return out if cell else out.drop("__all")


def logistic_table(df: DataFrame, formula: str, term: str, cell: Sequence[str] = ()) -> DataFrame:
    """T-17."""

    def fit(x, y, n, names):
        b, ok = np.zeros(x.shape[1]), False
        for _ in range(50):  # reweighted least squares
            p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
            cov = np.linalg.pinv(x.T @ (x * (n * p * (1 - p))[:, None]))
            step = cov @ (x.T @ (n * (y - p)))
            b = b + step
            if np.abs(step).max() < 1e-10:
                ok = True
                break
        at = names.index(term)
        s = math.sqrt(max(cov[at, at], 0))
        return {"estimate": float(b[at]), "se": s, "p_value": dist.two_sided(b[at] / s) if s > 0 else 1.0, "converged": ok}

    return _on_counts(df, formula, cell, fit, "estimate double, se double, p_value double, converged boolean")


def ordinal_table(df: DataFrame, formula: str, term: str, cell: Sequence[str] = ()) -> DataFrame:
    """T-08: cumulative logits of the rounded outcome, without random effects."""

    def fit(x, y, n, names):
        x, names = x[:, 1:], names[1:]
        levels, code = np.unique(np.rint(y), return_inverse=True)
        k = len(levels) - 1

        def loss(w):
            cuts = np.cumsum(np.concatenate([w[:1], np.exp(np.clip(w[1:k], -30, 30))])) if k else np.zeros(0)
            edges = np.concatenate([[-np.inf], cuts, [np.inf]])
            eta = x @ w[k:]
            p = 1 / (1 + np.exp(-(edges[code + 1] - eta))) - 1 / (1 + np.exp(-(edges[code] - eta)))
            return float(-(n * np.log(np.maximum(p, 1e-300))).sum())

        with np.errstate(over="ignore"):
            b, cov, ok = _newton(loss, np.concatenate([[-1.0], np.zeros(max(k - 1, 0)), np.zeros(x.shape[1])]) if k else np.zeros(x.shape[1]))
        at = k + names.index(term)
        s = math.sqrt(max(cov[at, at], 0))
        return {"estimate": float(b[at]), "se": s, "p_value": dist.two_sided(b[at] / s) if s > 0 else 1.0, "converged": ok}

    return _on_counts(df, formula, cell, fit, "estimate double, se double, p_value double, converged boolean")


# ----- T-21: cumulative mixed model by sampling


def bayes_ordinal_table(df: DataFrame, formula: str, term: str, group: str, cell: Sequence[str] = (), draws: int = 2000, warmup: int = 1000, seed: int = 0, prior_sd: float = 2.5) -> DataFrame:
    """Posterior of a term of a cumulative-logit model with random intercepts.

    Metropolis within Gibbs on counts of distinct rows of each group: effects
    and cuts have normal priors, the intercepts' deviation a half-normal one;
    step sizes adapt during warm-up.  One chain for each cell.
    """
    d = design(formula)
    names = [n for n in d.names if n != "Intercept"]
    keys = list(cell) or ["__all"]
    cols = [term_column(n).alias(f"x{i}") for i, n in enumerate(names)]
    rows = df.withColumn("__all", F.lit(0)).select(*keys, F.col(group).cast("string").alias("g"), *cols, F.rint(F.col(d.outcome).cast("double")).alias("y")).dropna()
    counts = rows.groupBy(*keys, "g", *[f"x{i}" for i in range(len(names))], "y").agg(F.count("*").alias("n"))
    types = {f.name: f.dataType.simpleString() for f in counts.schema.fields}

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["g", "y"])
        x = pdf[[f"x{i}" for i in range(len(names))]].to_numpy(float)
        n = pdf["n"].to_numpy(float)
        _, code = np.unique(pdf["y"].to_numpy(), return_inverse=True)
        gs, g = np.unique(pdf["g"].to_numpy(), return_inverse=True)
        k = int(code.max())
        rng = np.random.default_rng(seed)

        def edges(w):
            return np.concatenate([[-np.inf], np.cumsum(np.concatenate([w[:1], np.exp(np.clip(w[1:k], -30, 30))])), [np.inf]])

        def rowwise(w, u):
            e, eta = edges(w), x @ w[k:] + u[g]
            with np.errstate(over="ignore"):
                p = 1 / (1 + np.exp(-(e[code + 1] - eta))) - 1 / (1 + np.exp(-(e[code] - eta)))
            return n * np.log(np.maximum(p, 1e-300))

        w, u, log_s = np.concatenate([[-1.0], np.full(max(k - 1, 0), -0.5), np.zeros(x.shape[1])]), np.zeros(len(gs)), math.log(0.5)
        steps, taken, kept, here = np.full(len(w), 0.2), np.zeros(len(w)), [], rowwise(w, u)
        for t in range(draws + warmup):
            for i in range(len(w)):
                new = w.copy()
                new[i] += rng.normal(0, steps[i])
                there = rowwise(new, u)
                if math.log(rng.random()) < there.sum() - here.sum() - (new[i] ** 2 - w[i] ** 2) / (2 * prior_sd**2):
                    w, here = new, there
                    taken[i] += 1
            move = u + rng.normal(0, 0.4, len(gs))
            there = rowwise(w, move)
            gain = np.bincount(g, there - here, minlength=len(gs)) - (move**2 - u**2) / (2 * math.exp(2 * log_s))
            u = np.where(np.log(rng.random(len(gs))) < gain, move, u)
            here = rowwise(w, u)
            new_s = log_s + rng.normal(0, 0.2)
            density = lambda z: -len(gs) * z - (u**2).sum() / (2 * math.exp(2 * z)) - math.exp(2 * z) / 2 + z
            if math.log(rng.random()) < density(new_s) - density(log_s):
                log_s = new_s
            if t < warmup and t % 50 == 49:
                steps *= np.where(taken / 50 > 0.4, 1.3, 0.77)
                taken[:] = 0
            if t >= warmup:
                kept.append((w[k + names.index(term)], math.exp(log_s)))
        b = np.array(kept)
        low, high = np.percentile(b[:, 0], [2.5, 97.5])
        return pd.DataFrame([{**{c: pdf[c].iloc[0] for c in keys}, "mean": float(b[:, 0].mean()), "low": float(low), "high": float(high), "p_positive": float((b[:, 0] > 0).mean()), "group_sd": float(b[:, 1].mean()), "n_obs": int(n.sum())}])

    out = counts.groupBy(*keys).applyInPandas(run, ", ".join([*[f"{c} {types[c]}" for c in keys], "mean double, low double, high double, p_positive double, group_sd double, n_obs bigint"]))
    return out if cell else out.drop("__all")
