"""Contrasts, probes and nulls of vectors by layer (T-24 to T-36).

Vectors are one row for each prompt and layer.  Means are taken element by
element in one map-side combined aggregation over exploded positions.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NORMS = "delta_norm double"


def exploded(df: DataFrame, keep: Sequence[str], vector: str = "vec") -> DataFrame:
    return df.select(*keep, F.posexplode(vector).alias("pos", "x")).withColumn("x", F.col("x").cast("double"))


def mean_difference(df: DataFrame, key: Sequence[str], side: Column, stratum: Sequence[str] = (), vector: str = "vec") -> DataFrame:
    """(key, pos, d): mean of rows where side is true less mean where it is false.

    With a stratum, the mean of the strata's differences (T-25, T-26); strata
    without both sides don't count.
    """
    rows = exploded(df.withColumn("__side", side), [*key, *stratum, "__side"], vector)
    at = lambda s: F.avg(F.when(F.col("__side") == s, F.col("x")))
    d = rows.groupBy(*key, *stratum, "pos").agg((at(True) - at(False)).alias("d")).filter("d is not null")
    return d.groupBy(*key, "pos").agg(F.avg("d").alias("d")) if stratum else d


def norms(differences: DataFrame, key: Sequence[str]) -> DataFrame:
    """T-24: the length of each difference vector."""
    return differences.groupBy(*key).agg(F.sqrt(F.sum(F.col("d") * F.col("d"))).alias("delta_norm"), F.count("*").alias("n_dims"))


def cosines(a: DataFrame, b: DataFrame, key: Sequence[str]) -> DataFrame:
    """T-24: cosine of two difference vectors; null if one has no length."""
    j = a.select(*key, "pos", F.col("d").alias("x")).join(b.select(*key, "pos", F.col("d").alias("y")), [*key, "pos"])
    s = j.groupBy(*key).agg(F.sum(F.col("x") * F.col("y")).alias("xy"), F.sum(F.col("x") * F.col("x")).alias("xx"), F.sum(F.col("y") * F.col("y")).alias("yy"))
    return s.select(*key, F.try_divide(F.col("xy"), F.sqrt(F.col("xx") * F.col("yy"))).alias("cosine"))


def mean_shift(df: DataFrame, baseline: DataFrame, key: Sequence[str], row: Sequence[str]) -> DataFrame:
    """T-36: mean over rows of the patched vector less the baseline's, by element."""
    a, b = exploded(df, [*key, *row]), exploded(baseline, [*key, *row]).withColumnRenamed("x", "y")
    return a.join(b, [*key, *row, "pos"]).groupBy(*key, "pos").agg(F.avg(F.col("x") - F.col("y")).alias("d"))


def normalised_gaps(gaps: DataFrame, group: Sequence[str], config: str, base: str, least: float = 0.25) -> DataFrame:
    """T-33, T-34: gaps by their group's baseline, and 1 less it; small baselines go."""
    from .joins import to_baseline

    out = to_baseline(gaps, [*group, "component"], config, base, "gap").filter(F.abs("baseline") >= least)
    return out.withColumn("normalised", F.col("gap") / F.col("baseline")).withColumn("suppression", 1 - F.col("normalised"))


# ----- grouped maps: one layer's matrix fits on one executor


def ridge(x: np.ndarray, y: np.ndarray, penalty: float = 1.0) -> tuple[np.ndarray, float, np.ndarray, np.ndarray]:
    """(coefficients on standardised features, intercept, means, deviations)."""
    mean, sd = x.mean(axis=0), x.std(axis=0)
    sd[sd == 0] = 1
    z = (x - mean) / sd
    if len(z) < z.shape[1]:
        w = z.T @ np.linalg.solve(z @ z.T + penalty * np.eye(len(z)), y - y.mean())
    else:
        w = np.linalg.solve(z.T @ z + penalty * np.eye(z.shape[1]), z.T @ (y - y.mean()))
    return w, float(y.mean()), mean, sd


def logistic(x: np.ndarray, y: np.ndarray, penalty: float = 1.0, rounds: int = 30) -> tuple[np.ndarray, float, np.ndarray, np.ndarray]:
    mean, sd = x.mean(axis=0), x.std(axis=0)
    sd[sd == 0] = 1
    z = np.column_stack([np.ones(len(x)), (x - mean) / sd])
    w, ridge_ = np.zeros(z.shape[1]), penalty * np.eye(z.shape[1])
    ridge_[0, 0] = 0
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve(z.T @ (z * (p * (1 - p))[:, None]) + ridge_ + 1e-9 * np.eye(len(w)), z.T @ (y - p) - ridge_ @ w)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return w[1:], float(w[0]), mean, sd


def residualised(x: np.ndarray, controls: np.ndarray, train: np.ndarray) -> np.ndarray:
    """T-28: x less what controls predict, learnt on training rows; missing controls take the training mean."""
    mean = np.nanmean(controls[train], axis=0)
    c = np.where(np.isnan(controls), mean, controls)
    a = np.column_stack([np.ones(len(c)), c])
    return x - a @ np.linalg.lstsq(a[train], x[train], rcond=None)[0]


def folds(groups: Sequence[str], k: int) -> np.ndarray:
    """T-29: whole groups, largest first, to the fold with the fewest rows."""
    names, code, sizes = np.unique(np.asarray(groups), return_inverse=True, return_counts=True)
    load, fold = np.zeros(k), np.zeros(len(names), int)
    for g in sorted(range(len(names)), key=lambda i: (-sizes[i], names[i])):
        fold[g] = int(load.argmin())
        load[fold[g]] += sizes[g]
    return fold[code]


def probe_table(df: DataFrame, key: Sequence[str], target: str, group: str, part: str, kind: str = "ridge", penalty: float = 1.0, boots: int = 200, seed: int = 0, vector: str = "vec") -> DataFrame:
    """T-27, T-29, T-30, T-31: for each key (construct, layer) the test score, its interval over test groups, and cross-validated score.

    The score is R^2 of a ridge probe, or accuracy of a logistic one.  Rows
    without a target are left out; a key is one grouped map.
    """
    rows = df.select(*key, F.col(target).cast("double").alias("y"), F.col(group).cast("string").alias("g"), F.col(part).alias("part"), F.col(vector).cast("array<double>").alias("vec")).filter("y is not null and vec is not null")
    types = {f.name: f.dataType.simpleString() for f in rows.schema.fields}

    def score(y, p):
        return float(((p >= 0.5) == (y >= 0.5)).mean()) if kind == "logistic" else float(1 - ((y - p) ** 2).sum() / max(((y - y.mean()) ** 2).sum(), 1e-300))

    def fitted(x, y, train, test):
        w, b, mean, sd = (logistic if kind == "logistic" else ridge)(x[train], y[train], penalty)
        z = (x[test] - mean) / sd @ w + b
        return 1 / (1 + np.exp(-np.clip(z, -30, 30))) if kind == "logistic" else z

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["g", "y"])
        x, y = np.array(pdf["vec"].tolist(), float), pdf["y"].to_numpy()
        test = (pdf["part"] == "test").to_numpy()
        out = {k: pdf[k].iloc[0] for k in key} | {"score": None, "low": None, "high": None, "cv_score": None, "n_train": int((~test).sum()), "n_test": int(test.sum())}
        if test.any() and (~test).sum() >= 2:
            p = fitted(x, y, ~test, test)
            out["score"] = score(y[test], p)
            g = pdf["g"].to_numpy()[test]
            names = np.unique(g)
            rng = np.random.default_rng(seed)
            draws = []
            for _ in range(boots):
                at = np.concatenate([np.flatnonzero(g == n) for n in rng.choice(names, size=len(names))])
                draws.append(score(y[test][at], p[at]))
            out["low"], out["high"] = map(float, np.percentile(draws, [2.5, 97.5]))
        f = folds(pdf["g"].tolist(), min(5, pdf["g"].nunique()))
        if f.max() > 0:
            p = np.zeros(len(y))
            for k in range(f.max() + 1):
                p[f == k] = fitted(x, y, f != k, f == k)
            out["cv_score"] = score(y, p)
        return pd.DataFrame([out])

    return rows.groupBy(*key).applyInPandas(run, ", ".join([*[f"{k} {types[k]}" for k in key], "score double, low double, high double, cv_score double, n_train bigint, n_test bigint"]))


def left_out_table(df: DataFrame, key: Sequence[str], target: str, domain: str, kind: str = "ridge", penalty: float = 1.0, vector: str = "vec") -> DataFrame:
    """T-29: for each key and domain, the score on that domain's rows of a probe fitted on all other domains.

    Null where no other domain has two rows.
    """
    rows = df.select(*key, F.col(target).cast("double").alias("y"), F.col(domain).cast("string").alias("domain"), F.col(vector).cast("array<double>").alias("vec")).dropna(subset=["y", "domain", "vec"])
    types = {f.name: f.dataType.simpleString() for f in rows.schema.fields}

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["domain", "y"])
        x, y, names = np.array(pdf["vec"].tolist(), float), pdf["y"].to_numpy(), pdf["domain"].to_numpy()
        out = []
        for name in np.unique(names):
            test, score = names == name, None
            if (~test).sum() >= 2:
                w, b, mean, sd = (logistic if kind == "logistic" else ridge)(x[~test], y[~test], penalty)
                z = (x[test] - mean) / sd @ w + b
                score = float(((z >= 0) == (y[test] >= 0.5)).mean()) if kind == "logistic" else float(1 - ((y[test] - z) ** 2).sum() / max(((y[test] - y[test].mean()) ** 2).sum(), 1e-300))
            out.append({**{k: pdf[k].iloc[0] for k in key}, "domain": name, "score": score, "n_test": int(test.sum())})
        return pd.DataFrame(out)

    return rows.groupBy(*key).applyInPandas(run, ", ".join([*[f"{k} {types[k]}" for k in key], "domain string, score double, n_test bigint"]))


def alignment_table(df: DataFrame, key: Sequence[str], label: str, direction: Sequence[float], permutations: int = 200, seed: int = 0, vector: str = "vec") -> DataFrame:
    """T-35: cosine of the labels' mean difference with a direction, against permuted labels, and a random vector's deviation."""
    rows = df.select(*key, F.col(label).cast("boolean").alias("s"), F.col(vector).cast("array<double>").alias("vec")).dropna()
    types = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    to = np.asarray(direction, float)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x, s = np.array(pdf["vec"].tolist(), float), pdf["s"].to_numpy(bool)

        def cosine(m):
            if m.all() or not m.any():
                return 0.0
            d = x[m].mean(axis=0) - x[~m].mean(axis=0)
            return float(d @ to / max(np.linalg.norm(d) * np.linalg.norm(to), 1e-300))

        rng = np.random.default_rng(seed)
        seen = cosine(s)
        null = np.array([cosine(rng.permutation(s)) for _ in range(permutations)])
        return pd.DataFrame([{**{k: pdf[k].iloc[0] for k in key}, "cosine": seen, "p_permuted": float((np.abs(null) >= abs(seen)).mean()), "random_sd": float(1 / np.sqrt(x.shape[1]))}])

    return rows.groupBy(*key).applyInPandas(run, ", ".join([*[f"{k} {types[k]}" for k in key], "cosine double, p_permuted double, random_sd double"]))


def principal_angles(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """T-32: angles between the spans of the columns."""
    qa, qb = np.linalg.qr(a)[0], np.linalg.qr(b)[0]
    return np.arccos(np.clip(np.linalg.svd(qa.T @ qb, compute_uv=False), -1, 1))
