"""Power by simulation (T-22, T-23): a grid of replicates, each with a seed of its own, spread over tasks."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import distributions as dist
from . import stats

def sha_seed(*parts: object) -> int:
    return int(hashlib.sha256("|".join(map(str, parts)).encode()).hexdigest(), 16) % 2**32


CONTRASTS = ("1a", "1b", "1c_typicality", "1c_evocativeness", "1d")


def fit_term(term: str, cluster: str) -> Callable[[stats.Clusters, list[str]], dict]:
    """T-01: the mixed model, or least squares if it doesn't converge or has no finite result; a cell is never dropped."""
    label = f"{cluster.removesuffix('_id')}RI"

    def fit(c: stats.Clusters, names: list[str]) -> dict:
        at = names.index(term)
        base = {"n_obs": int(c.n.sum()), "n_groups": len(c.n)}
        try:
            m = stats.lmm(c)
            b, s = float(m["beta"][at]), float(math.sqrt(max(m["cov"][at, at], 0)))
            if m["converged"] and math.isfinite(b) and s > 0:
                return base | {"estimate": b, "se": s, "p_value": dist.two_sided(b / s), "converged": True, "fallback_used": False, "method": f"lmm-{label}"}
        except np.linalg.LinAlgError:
            pass
        beta, cov = stats.ols(c)
        b, s = float(beta[at]), float(math.sqrt(max(cov[at, at], 0)))
        return base | {"estimate": b, "se": s, "p_value": dist.two_sided(b / s) if s > 0 else 1.0, "converged": False, "fallback_used": True, "method": f"ols-{label}"}

    return fit


def _clusters(x: np.ndarray, y: np.ndarray, code: np.ndarray) -> stats.Clusters:
    g = int(code.max()) + 1
    k = x.shape[1]
    xx, xy = np.zeros((g, k, k)), np.zeros((g, k))
    np.add.at(xx, code, x[:, :, None] * x[:, None, :])
    np.add.at(xy, code, x * y[:, None])
    return stats.Clusters(np.bincount(code).astype(float), xx, xy, np.bincount(code, y * y), 0, [])


def simulate(contrast: str, rng: np.random.Generator, items: int, n: int, mu: float, var_group: float, var_resid: float, effect: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(design, outcome, group codes, index of the tested term) of one replicate.

    1a: the sign gap is ``effect`` among moral families and 0 among others; 1b:
    slopes of a standard predictor differ by it between signs; 1c: the gap of a
    within-family factor is it for bad families and 0 for good; 1d: the mean is
    off by it.  Groups draw their effect before their rows.
    """
    a, b = math.sqrt(var_group), math.sqrt(var_resid)
    rows, y, code = [], [], []
    group = 0

    def put(design: list[np.ndarray], values: np.ndarray) -> None:
        rows.append(np.stack([np.ones(len(values)), *[np.broadcast_to(d, len(values)) for d in design]], axis=1))
        y.append(values)
        code.append(np.full(len(values), group))

    half = effect / 2
    if contrast == "1d":
        for u in rng.normal(0, a, size=items):
            put([], effect + u + rng.normal(0, b, size=n))
            group += 1
        return np.concatenate(rows), np.concatenate(y), np.concatenate(code), 0
    if contrast == "1a":
        for vt, sg, mean in ((0.5, 0.5, mu + half), (0.5, -0.5, mu - half), (-0.5, 0.5, mu), (-0.5, -0.5, mu)):
            for _ in range(items):
                u = rng.normal(0, a)
                put([vt, sg, vt * sg], mean + u + rng.normal(0, b, size=n))
                group += 1
    else:
        for sg in (0.5, -0.5):
            for _ in range(items):
                u = rng.normal(0, a)
                if contrast == "1b":
                    x = rng.normal(0, 1, size=n)
                    put([x, sg, x * sg], mu + u + (0.5 + 2 * sg * half) * x + rng.normal(0, b, size=n))
                else:
                    for level in (-0.5, 0.5):
                        put([sg, level, sg * level], mu + u + (2 * level * half if sg > 0 else 0) + rng.normal(0, b, size=n))
                group += 1
    return np.concatenate(rows), np.concatenate(y), np.concatenate(code), 3


def replicates(spark: SparkSession, contrasts: Sequence[str], item_counts: Sequence[int], ns: Sequence[int], sims: int, seed: int, mu: float = 5.0, var_group: float = 0.5, var_resid: float = 1.0, effect: float = 1.0, alpha: float = 0.05) -> DataFrame:
    """One row for each replicate: p-value, convergence, fallback, share of values off the scale."""
    base = spark.range(1)
    for name, values in (("contrast", contrasts), ("item_count", item_counts), ("n", ns)):
        base = base.withColumn(name, F.explode(F.array(*[F.lit(v) for v in values])))
    jobs = base.drop("id").withColumn("sim", F.explode(F.sequence(F.lit(0), F.lit(sims - 1)))).repartition(F.col("contrast"), F.col("item_count"), F.col("n"), F.col("sim"))

    def run(batches):
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                rng = np.random.default_rng(sha_seed(seed, r.item_count, r.n, r.contrast, r.sim))
                x, y, code, at = simulate(r.contrast, rng, r.item_count, r.n, mu, var_group, var_resid, effect)
                fit = fit_term("t", "family_id")(_clusters(x, y, code), ["t" if i == at else str(i) for i in range(x.shape[1])])
                raw = y if r.contrast != "1d" else y + mu
                out.append((r.contrast, r.item_count, r.n, r.sim, fit["p_value"], fit["converged"], fit["fallback_used"], float(np.mean((raw < 0) | (raw > 10)))))
            yield pd.DataFrame(out, columns=["contrast", "item_count", "n", "sim", "p_value", "converged", "fallback_used", "frac_clipped"])

    return jobs.mapInPandas(run, "contrast string, item_count int, n int, sim int, p_value double, converged boolean, fallback_used boolean, frac_clipped double")


def grid_points(done: DataFrame, alpha: float = 0.05) -> DataFrame:
    """T-23: counts and power of each grid point."""
    return done.groupBy("contrast", "item_count", "n").agg(
        F.count("*").alias("n_sims"), F.count_if(F.col("p_value") < alpha).alias("n_significant"), F.count_if("converged").alias("n_converged"), F.count_if("fallback_used").alias("n_fallback_used"), F.avg((F.col("p_value") < alpha).cast("double")).alias("power"), F.avg("frac_clipped").alias("frac_clipped")
    )
