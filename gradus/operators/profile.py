"""Random-intercept models by profile likelihood over a grid of variance ratios (T-01, T-10, T-13, T-15, T-33).

At a ratio rho = var(cluster) / var(residual) the likelihood needs sums over
clusters of products less shrink_g = rho / (1 + n_g rho) times products of the
clusters' own sums.  As shrink_g depends on n_g alone, one map-side combined
aggregation sums these products by cluster size; what follows reads a row for
each cell and size.  It carries the sums for all ratios of a grid, narrows it
twice between the neighbours of the best, takes the top of a parabola through
the last three points, and fits there.  No task holds a cell's clusters.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import distributions as dist
from ..session import written
from .resampling import _dot, _sums, _totals, _types, beside
from .stats import design, sufficient

#: Ratios of the first grid: none, and from e^-12 by quarters of an exponent to e^8; later ones have as many steps between two neighbours.
GRID = (0.0, *[math.exp(-12 + 0.25 * j) for j in range(81)])
STEPS = 80


def likelihood(a: np.ndarray, b: np.ndarray, c: np.ndarray, logs: np.ndarray, n: np.ndarray, reml: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of many fits at once: log likelihood, coefficients, their covariance, residual variance.

    ``logs`` is the sum of log(1 + n_g rho); directions that no row has don't count.
    """
    inverse = np.linalg.pinv(a, hermitian=True)
    beta = np.einsum("rij,rj->ri", inverse, b)
    rss = np.maximum(c - np.einsum("ri,ri->r", b, beta), 1e-300)
    m = n - np.linalg.matrix_rank(a, hermitian=True) if reml else n
    variance = rss / m
    log = -0.5 * (m * np.log(2 * np.pi * variance) + m + logs)
    if reml:
        log -= 0.5 * np.linalg.slogdet(a)[1]
    return log, beta, variance[:, None, None] * inverse, variance


def _stack(pdf: pd.DataFrame, k: int) -> tuple[np.ndarray, ...]:
    return np.stack(pdf["a"]).reshape(-1, k, k), np.stack(pdf["b"]), pdf["c"].to_numpy(float), pdf["logs"].to_numpy(float), pdf["n"].to_numpy(float)


def by_size(clusters: DataFrame, keys: Sequence[str], k: int) -> DataFrame:
    """Of clusters with n, xx, xy, yy, whose first column is the intercept: sums of what a ratio's sums need, by n."""
    of = lambda c, i: F.element_at(c, F.lit(i + 1))
    return clusters.groupBy(*keys, "n").agg(
        F.count("*").alias("g"),
        F.array(*[F.sum(of("xx", i)) for i in range(k * k)]).alias("xx"),
        F.array(*[F.sum(of("xx", i) * of("xx", j)) for i in range(k) for j in range(k)]).alias("ss"),
        F.array(*[F.sum(of("xy", i)) for i in range(k)]).alias("xy"),
        F.array(*[F.sum(of("xx", i) * of("xy", 0)) for i in range(k)]).alias("st"),
        F.sum("yy").alias("yy"),
        F.sum(of("xy", 0) * of("xy", 0)).alias("tt"),
    )


def _at(sizes: DataFrame, keys: Sequence[str], k: int, by: Sequence[str]) -> DataFrame:
    """Sums at each ratio ``rho`` of sizes."""
    of = lambda c, i: F.element_at(c, F.lit(i + 1))
    shrink = F.col("rho") / (1 + F.col("n") * F.col("rho"))
    return sizes.groupBy(*keys, *by).agg(
        F.array(*[F.sum(of("xx", i) - shrink * of("ss", i)) for i in range(k * k)]).alias("a"),
        F.array(*[F.sum(of("xy", i) - shrink * of("st", i)) for i in range(k)]).alias("b"),
        F.sum(F.col("yy") - shrink * F.col("tt")).alias("c"),
        F.sum(F.col("g") * F.log1p(F.col("n") * F.col("rho"))).alias("logs"),
        F.sum(F.col("g") * F.col("n")).cast("double").alias("n"),
        F.sum("g").alias("n_groups"),
    )


def narrowed(points: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Of points (keys, i, rho, log): low and high, the ratios beside the best, rho at a parabola's top, and whether the last is best.

    The best is the first of equal ones; at an end, which for the lowest is no
    variance between clusters, rho is that end.
    """
    seen = points.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("i", "rho", "log"))).alias("p"))

    def best(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            rows = []
            for p in pdf["p"]:
                rho, log = np.array([x["rho"] for x in p]), np.array([x["log"] for x in p])
                i = int(np.argmax(log))
                low, high, top = rho[max(i - 1, 0)], rho[min(i + 1, len(rho) - 1)], rho[i]
                if 0 < i < len(rho) - 1:
                    bend = log[i - 1] - 2 * log[i] + log[i + 1]
                    if bend < 0:
                        top += (high - low) / 4 * (log[i - 1] - log[i + 1]) / bend
                rows.append((low, high, top, i == len(rho) - 1))
            yield pdf[list(keys)].assign(**dict(zip(("low", "high", "rho", "last"), map(list, zip(*rows, strict=True)), strict=True)))

    return seen.mapInPandas(best, f"{_types(seen, keys)}, low double, high double, rho double, last boolean")


def searched(keys: Sequence[str], log_at: Callable[[DataFrame], DataFrame], cells: DataFrame) -> DataFrame:
    """(keys, rho, last) at the greatest likelihood; ``log_at`` gives (keys, i, rho, log) of ratios (keys, i, rho)."""
    spark = cells.sparkSession
    grid = F.posexplode(F.array(*[F.lit(r) for r in GRID])).alias("i", "rho")
    found = written(spark, narrowed(log_at(cells.select(*keys, grid)), keys), "found")
    end = found.select(*keys, F.col("last").alias("end"))
    for _ in range(2):
        steps = found.select(*keys, "low", "high", F.explode(F.sequence(F.lit(0), F.lit(STEPS))).alias("i"))
        ratios = steps.select(*keys, "i", (F.col("low") + (F.col("high") - F.col("low")) * F.col("i") / STEPS).alias("rho"))
        found = written(spark, narrowed(log_at(ratios), keys), "found")
    return beside(found.select(*keys, "rho"), end, keys)


def fitted(clusters: DataFrame, keys: list[str], k: int, reml: bool = False) -> DataFrame:
    """The fit of each cell: rho, log, beta, cov, var_resid, n, n_groups, converged."""
    sizes = written(clusters.sparkSession, by_size(clusters, keys, k), "sizes")

    def log_at(ratios: DataFrame) -> DataFrame:
        rows = _at(beside(sizes, ratios, keys), keys, k, ["i", "rho"])

        def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in parts:
                yield pdf[[*keys, "i", "rho"]].assign(log=likelihood(*_stack(pdf, k), reml)[0])

        return rows.mapInPandas(run, f"{_types(rows, [*keys, 'i', 'rho'])}, log double")

    cells = sizes.select(*keys).distinct()
    best = searched(keys, log_at, cells)
    rows = _at(beside(sizes, best, keys), keys, k, ["rho", "end"])

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            log, beta, cov, variance = likelihood(*_stack(pdf, k), reml)
            yield pdf[[*keys, "rho", "n", "n_groups"]].assign(log=log, beta=list(beta), cov=list(cov.reshape(len(pdf), -1)), var_resid=variance, converged=~pdf["end"].to_numpy(bool))

    return rows.mapInPandas(run, f"{_types(rows, keys)}, rho double, n double, n_groups bigint, log double, beta array<double>, cov array<double>, var_resid double, converged boolean")


def lmm_tables(fits: dict[str, tuple[DataFrame, str, str]], cell: Sequence[str], cluster: str) -> DataFrame:
    """T-01, T-10: the mixed models of (rows, formula, term) by name (column ``fit``), in each cell; see ``lmm_table``.

    Models are searched together: their clusters are rows of one table, so many
    fits take as many jobs as one.  Those with fewer terms than the longest have
    zeros in place of further ones, a direction that no row has.
    """
    designs = {name: design(formula) for name, (_, formula, _) in fits.items()}
    k = max(len(d.names) for d in designs.values())
    rows = []
    for name, (df, _, _) in fits.items():
        own = len(designs[name].names)
        at = lambda c, i, there: F.element_at(c, F.lit(i + 1)) if there else F.lit(0.0)
        xx = F.array(*[at("xx", i * own + j, max(i, j) < own) for i in range(k) for j in range(k)])
        xy = F.array(*[at("xy", i, i < own) for i in range(k)])
        sums = sufficient(df, designs[name], list(cell), cluster).select(F.lit(name).alias("fit"), "*")
        rows.append(sums.withColumns({"xx": xx, "xy": xy}) if own < k else sums)
    places = {name: (d.names.index(fits[name][2]), len(d.names)) for name, d in designs.items()}
    return _mixed(reduce(DataFrame.unionAll, rows), ["fit", *cell], k, places, cluster)


def lmm_table(df: DataFrame, formula: str, term: str, cell: Sequence[str], cluster: str) -> DataFrame:
    """T-01, T-10: the mixed model of each cell, or least squares with cluster-robust errors if it doesn't converge or has no finite result.

    A cell is never dropped; ``method`` and ``fallback_used`` say which path gave its row.
    """
    return lmm_tables({"": (df, formula, term)}, cell, cluster).drop("fit")


def _mixed(sums: DataFrame, keys: list[str], k: int, places: dict[str, tuple[int, int]], cluster: str) -> DataFrame:
    """places: the term's index and the number of terms by the key ``fit``."""
    clusters = written(sums.sparkSession, sums, "clusters")
    models = fitted(clusters, keys, k)
    totals = _totals(clusters, k, keys)

    def solve(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            at, terms = np.array([places[f] for f in pdf["fit"]], int).reshape(-1, 2).T
            inverse = np.linalg.pinv(np.stack(pdf["xx"]).reshape(-1, k, k))
            beta = np.einsum("rij,rj->ri", inverse, np.stack(pdf["xy"]))
            g, n = pdf["n_clusters"].to_numpy(float), pdf["n"].to_numpy()
            factor = g / np.maximum(g - 1, 1) * (n - 1) / np.maximum(n - terms, 1)
            yield pdf[keys].assign(ols=list(beta), row=list(inverse[np.arange(len(pdf)), at]), factor=factor)

    plain = totals.mapInPandas(solve, f"{_types(totals, keys)}, ols array<double>, row array<double>, factor double")
    plain = written(sums.sparkSession, plain, "plain")
    scores = beside(clusters, plain, keys, few=True)
    left = F.array(*[F.element_at("xy", F.lit(i + 1)) - _dot("xx", "ols", k, i) for i in range(k)])
    scores = scores.withColumn("left", left).withColumn("score", _dot("row", "left", k))
    robust = scores.groupBy(*keys).agg(F.sum(F.col("score") * F.col("score")).alias("meat"))
    rows = beside(beside(models, plain, keys, few=True), robust, keys, few=True)
    label = f"{cluster.removesuffix('_id')}RI"

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            out = []
            for r in pdf.itertuples():
                at = places[r.fit][0]
                b, s, name = r.beta[at], math.sqrt(max(r.cov[at * k + at], 0)), f"lmm-{label}"
                mixed = bool(r.converged) and math.isfinite(b) and s > 0
                if not mixed:
                    b, s, name = r.ols[at], math.sqrt(max(r.factor * r.meat, 0)), f"ols-{label}"
                out.append((float(b), s, dist.two_sided(b / s) if s > 0 else 1.0, int(r.n), int(r.n_groups), mixed, not mixed, name))
            yield pdf[keys].assign(**dict(zip(("estimate", "se", "p_value", "n_obs", "n_groups", "converged", "fallback_used", "method"), map(list, zip(*out, strict=True)), strict=True)))

    schema = "estimate double, se double, p_value double, n_obs bigint, n_groups bigint, converged boolean, fallback_used boolean, method string"
    return rows.mapInPandas(run, f"{_types(rows, keys)}, {schema}")


def _tested(rows: DataFrame, keys: list[str]) -> DataFrame:
    """chi2, df and p_value of rows (keys, full, reduced, df)."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            x = np.maximum(0.0, 2 * (pdf["full"] - pdf["reduced"])).to_numpy()
            yield pdf[keys].assign(chi2=x, df=pdf["df"], p_value=[dist.chi2_sf(v, d) if d > 0 else None for v, d in zip(x, pdf["df"], strict=True)])

    return rows.mapInPandas(run, f"{_types(rows, keys)}, chi2 double, df int, p_value double")


def lrt_table(df: DataFrame, full: str, reduced: str, cell: Sequence[str], cluster: str) -> DataFrame:
    """T-15: twice the difference of log likelihoods, and its chi-square probability."""
    clusters, names, keys = _sums(df, full, cell, cluster)
    kept = [names.index(n) for n in design(reduced).names]
    k = len(names)
    pick = lambda c, at: F.array(*[F.element_at(c, F.lit(i + 1)) for i in at])
    small = clusters.select(*keys, "n", pick("xx", [i * k + j for i in kept for j in kept]).alias("xx"), pick("xy", kept).alias("xy"), "yy")
    logs = [fitted(x, keys, m).select(*keys, F.col("log").alias(name)) for x, m, name in ((clusters, k, "full"), (small, len(kept), "reduced"))]
    rows = beside(*logs, keys).withColumn("df", F.lit(k - len(kept)))
    return _tested(rows, keys).drop(*([] if cell else ["__all"]))


def reml_table(df: DataFrame, cell: Sequence[str], group: str, value: str) -> DataFrame:
    """T-13, T-14: variance components of an intercept-only model by restricted likelihood, icc and design effect."""
    clusters, _, keys = _sums(df, f"{value} ~ 1", cell, group)
    m = fitted(clusters, keys, 1, reml=True)
    between, total = F.col("rho") * F.col("var_resid"), (1 + F.col("rho")) * F.col("var_resid")
    icc = F.when(total > 0, between / total).otherwise(0.0)
    return m.select(
        *cell,
        between.alias("var_group"),
        "var_resid",
        icc.alias("icc"),
        (1 + (F.col("n") / F.col("n_groups") - 1) * icc).alias("design_effect"),
        "n_groups",
        F.col("n").cast("bigint").alias("n_obs"),
        "converged",
    )


# ----- T-33: two factors and their interaction


def factorial_sums(df: DataFrame, outcome: str, a: str, b: str, cluster: str) -> DataFrame:
    """(cluster, a, b, n, sy, syy): rows with an outcome, both levels and a cluster."""
    y = F.col(outcome).cast("double")
    rows = df.select(F.col(cluster).cast("string").alias("cluster"), F.col(a).cast("string").alias("a"), F.col(b).cast("string").alias("b"), y.alias("y")).dropna().filter(~F.isnan("y"))
    return rows.groupBy("cluster", "a", "b").agg(F.count("*").alias("n"), F.sum("y").alias("sy"), F.sum(F.col("y") * F.col("y")).alias("syy"))


def interaction_test(df: DataFrame, outcome: str, a: str, b: str, cluster: str) -> DataFrame:
    """T-33: likelihood-ratio test of all interaction terms of two dummy-coded factors, clusters with random intercepts.

    One row: chi2, df, p_value, selective (p < 0.05), n_groups, n_obs, n_cells.
    Levels are those in the data.  With a mean for each pair of levels that
    occurs, X'X is diagonal, so a cluster gives the counts and sums of its pairs;
    the model without interaction is a linear map of these means, and both
    likelihoods come from the same sums.  Pairs that no row has have no
    mean, and df is the difference of the ranks.  Only the pairs of levels, which
    are the design, come to the driver.  No interaction to test (df 0) gives null
    p_value and selective; no rows give no row.
    """
    spark = df.sparkSession
    cells = written(spark, factorial_sums(df, outcome, a, b, cluster), "cells")
    pairs = [(r.a, r.b) for r in cells.select("a", "b").distinct().orderBy("a", "b").collect()]
    k = len(pairs)
    if not k:
        return spark.createDataFrame([], "chi2 double, df int, p_value double, selective boolean, n_groups bigint, n_obs bigint, n_cells int")
    first, second = sorted({x for x, _ in pairs}), sorted({y for _, y in pairs})
    additive = np.array([[1.0, *[x == v for v in first[1:]], *[y == v for v in second[1:]]] for x, y in pairs], float).reshape(k, -1)
    u, lengths, _ = np.linalg.svd(additive, full_matrices=False)
    basis = u[:, lengths > 1e-9 * lengths.max()]
    names = spark.createDataFrame([(x, y, i) for i, (x, y) in enumerate(pairs)], "a string, b string, j int")
    own = beside(cells, names, ["a", "b"]).select("cluster", "j", F.col("n").cast("double").alias("n"), "sy", "syy")
    whole = own.groupBy("cluster").agg(F.sum("n").alias("m"), F.sum("sy").alias("t"), F.sum("syy").alias("yy"))
    parts = beside(own.drop("syy"), whole, ["cluster"])
    other = own.select("cluster", F.col("j").alias("l"), F.col("n").alias("o"))
    # By the size m of clusters, on which alone a ratio's weights depend.
    products = beside(parts, other, ["cluster"]).groupBy("j", "l", "m").agg(F.sum(F.when(F.col("j") == F.col("l"), F.col("n")).otherwise(0.0)).alias("n"), F.sum(F.col("n") * F.col("o")).alias("no"))
    products = written(spark, products.withColumn("z", F.lit(0)), "products")
    sums = written(spark, parts.groupBy("j", "m").agg(F.sum("sy").alias("sy"), F.sum(F.col("n") * F.col("t")).alias("nt")).withColumn("z", F.lit(0)), "sums")
    totals = written(spark, whole.groupBy("m").agg(F.count("*").alias("g"), F.sum("yy").alias("yy"), F.sum(F.col("t") * F.col("t")).alias("tt")).withColumn("z", F.lit(0)), "totals")

    def at(ratios: DataFrame) -> DataFrame:
        """Entries of the sums at each ratio: those of X'V^-1X, of X'V^-1y, of y'V^-1y and of the determinant."""
        shrink = F.col("rho") / (1 + F.col("m") * F.col("rho"))
        ratios = ratios.withColumn("z", F.lit(0))
        by = ["one", "i", "rho"]
        one = beside(products, ratios, ["z"]).groupBy(*by, "j", "l").agg(F.sum(F.col("n") - shrink * F.col("no")).alias("v"))
        two = beside(sums, ratios, ["z"]).groupBy(*by, "j").agg(F.sum(F.col("sy") - shrink * F.col("nt")).alias("v"))
        three = beside(totals, ratios, ["z"]).groupBy(*by).agg(F.sum(F.col("yy") - shrink * F.col("tt")).alias("c"), F.sum(F.col("g") * F.log1p(F.col("m") * F.col("rho"))).alias("logs"), F.sum(F.col("g") * F.col("m")).alias("n"), F.sum("g").alias("n_groups"))
        entries = lambda x, *at_: x.groupBy(*by).agg(F.collect_list(F.struct(*at_, "v")).alias("__".join(at_)))
        return beside(beside(three, entries(one, "j", "l"), by), entries(two, "j"), by)

    def logs(pdf: pd.DataFrame, full: bool) -> np.ndarray:
        m, v = np.zeros((len(pdf), k, k)), np.zeros((len(pdf), k))
        for row, (mat, vec) in enumerate(zip(pdf["j__l"], pdf["j"], strict=True)):
            for e in mat:
                m[row, e["j"], e["l"]] = e["v"]
            for e in vec:
                v[row, e["j"]] = e["v"]
        if not full:
            m, v = np.einsum("ja,rjl,lb->rab", basis, m, basis), v @ basis
        return likelihood(m, v, pdf["c"].to_numpy(float), pdf["logs"].to_numpy(float), pdf["n"].to_numpy(float), False)[0]

    def log_at(ratios: DataFrame) -> DataFrame:
        """one: 0 for the model with the interaction, 1 without it."""

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                for full, part in pdf.groupby("one"):
                    yield part[["one", "i", "rho", "n", "n_groups"]].assign(log=logs(part, full == 0))

        return at(ratios).mapInPandas(run, "one int, i int, rho double, n double, n_groups bigint, log double")

    best = searched(["one"], log_at, spark.createDataFrame([(0,), (1,)], "one int"))
    top = log_at(best.select("one", F.lit(0).alias("i"), "rho"))
    log = lambda which: F.max(F.when(F.col("one") == which, F.col("log")))
    rows = top.groupBy("i").agg(log(0).alias("full"), log(1).alias("reduced"), F.max("n").alias("n"), F.max("n_groups").alias("n_groups")).withColumnRenamed("i", "one")
    rows = rows.withColumn("df", F.lit(k - basis.shape[1]))
    out = beside(_tested(rows, ["one"]), rows.select("one", "n", "n_groups"), ["one"])
    return out.select("chi2", "df", "p_value", (F.col("p_value") < 0.05).alias("selective"), "n_groups", F.col("n").cast("bigint").alias("n_obs"), F.lit(k).alias("n_cells"))
