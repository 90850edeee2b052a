"""Cluster bootstraps as joins and sums over rows (T-03 to T-07, T-20).

A replicate's signs and picks are hashes of (seed, replicate, cluster), so they
need no generator's state, are the same in any plan, and can be stated in SQL.
What a replicate needs of a cluster is a few numbers that are linear in its
sign or weight; these are summed by cell and replicate, map-side first.  No
task holds a cell's clusters or replicates together.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import distributions as dist
from ..session import written
from .stats import design, sufficient

#: Bits of a hash that are used at a time: 32 signs, or 60 bits for a pick (four picks a hash).
_SIGNS, _PICKS = 32, 4
#: Statistics that differ by less, relatively, are equal: signs that are all alike give the data's own, but for rounding.
TIE = 1e-9


def beside(a: DataFrame, b: DataFrame, keys: Sequence[str], few: bool = False) -> DataFrame:
    """a joined with b on keys, null with null; b's keys go.

    few: b has a row for each cell and is sent to a.  Without it Spark may send
    a table of all clusters instead, as its file is small for its rows.
    """
    b = b.select(*[F.col(k).alias(f"__{k}") for k in keys], *[c for c in b.columns if c not in keys])
    on = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]
    return a.join(F.broadcast(b) if few else b, on).drop(*[f"__{k}" for k in keys])


def _dot(a: str, b: str, k: int, row: int | None = None) -> Column:
    """The product of two arrays' first k elements; row: of a row of a in row-major order."""
    at = lambda c, i: F.element_at(c, F.lit(i + 1))
    return sum((at(a, (row or 0) * k + i) * at(b, i) for i in range(k)), F.lit(0.0))


def _sums(df: DataFrame, formula: str, cell: Sequence[str], cluster: str) -> tuple[DataFrame, list[str], list[str]]:
    d = design(formula)
    keys = list(cell)
    if not keys:
        df, keys = df.withColumn("__all", F.lit(0)), ["__all"]
    return written(df.sparkSession, sufficient(df, d, keys, cluster), "clusters"), d.names, keys


def _totals(sums: DataFrame, k: int, keys: list[str]) -> DataFrame:
    """A cell's rows, clusters and sums of products."""
    total = lambda c, n: F.array(*[F.sum(F.element_at(c, F.lit(i + 1))) for i in range(n)]).alias(c)
    return sums.groupBy(*keys).agg(F.sum("n").cast("double").alias("n"), F.count("*").alias("n_clusters"), F.sum("levels").alias("levels"), total("xx", k * k), total("xy", k))


def _types(df: DataFrame, names: Sequence[str]) -> str:
    found = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    return ", ".join(f"`{n}` {found[n]}" for n in names)


# ----- T-05, T-06: wild cluster bootstraps


def _null_fits(parts: Iterator[pd.DataFrame], k: int, at: list[int], keys: list[str]) -> Iterator[pd.DataFrame]:
    """Of each cell: X'X inverse, coefficients, those without the tested terms, the covariance's factor."""
    rest = [i for i in range(k) if i not in at]
    for pdf in parts:
        a, b = np.stack(pdf["xx"]).reshape(-1, k, k), np.stack(pdf["xy"])
        inverse = np.linalg.pinv(a)
        null = np.zeros((len(pdf), k))
        if rest:
            null[:, rest] = np.einsum("cij,cj->ci", np.linalg.pinv(a[:, rest][:, :, rest]), b[:, rest])
        g, n = pdf["n_clusters"].to_numpy(float), pdf["n"].to_numpy()
        factor = g / np.maximum(g - 1, 1) * (n - 1) / np.maximum(n - k - pdf["levels"].to_numpy(), 1)
        beta = np.einsum("cij,cj->ci", inverse, b)
        yield pdf[[*keys, "n_clusters"]].assign(inverse=list(inverse.reshape(len(pdf), -1)), beta=list(beta), null=list(null), factor=factor)


def _statistics(parts: Iterator[pd.DataFrame], k: int, at: list[int], keys: list[str]) -> Iterator[pd.DataFrame]:
    """A replicate's t, or Wald F of several terms, from its sums: see ``wild_table``."""
    m = len(at)
    for pdf in parts:
        inverse = np.stack(pdf["inverse"]).reshape(-1, k, k)
        delta = np.einsum("rij,rj->ri", inverse, np.stack(pdf["u"]))
        v = np.einsum("rabi,ri->rab", np.stack(pdf["v"]).reshape(-1, m, m, k), delta)
        q = np.einsum("rabij,ri,rj->rab", np.stack(pdf["qq"]).reshape(-1, m, m, k, k), delta, delta)
        cov = pdf["factor"].to_numpy()[:, None, None] * (np.stack(pdf["pp"]).reshape(-1, m, m) - v - v.transpose(0, 2, 1) + q)
        part = delta[:, at]
        if m == 1:
            found = part[:, 0] / np.sqrt(np.maximum(cov[:, 0, 0], 1e-300))
        else:
            found = np.einsum("ra,rab,rb->r", part, np.linalg.pinv(cov), part) / m
        yield pdf[[*keys, "seen"]].assign(drawn=found)


def wild_table(df: DataFrame, formula: str, terms: Sequence[str], cell: Sequence[str], cluster: str, seed: int, replicates: int = 1999) -> DataFrame:
    """T-05, T-06, T-37, T-38: wild cluster bootstrap-t of a term, or Wald F of several, with the null imposed.

    In a replicate y* = fitted + w_g residual.  With e_g = X_g'residual and
    A = X'X, the coefficients move by delta = A^-1 sum(w_g e_g), and a term's
    score is w_g p_g - q_g'delta, where p_g = (A^-1 e_g)_a and q_g = X_g'X_g
    (A^-1)_a; so the sums of w_g e_g and of w_g p_g q_g give its statistic.
    Signs w_g are bits of SHA-256 of ``seed|block|cluster``, 32 replicates a block.
    """
    sums, names, keys = _sums(df, formula, cell, cluster)
    k, at = len(names), [names.index(t) for t in terms]
    m = len(at)
    totals = _totals(sums, k, keys)
    schema = f"{_types(totals, keys)}, n_clusters bigint, inverse array<double>, beta array<double>, `null` array<double>, factor double"
    fits = totals.mapInPandas(lambda parts: _null_fits(parts, k, at, keys), schema)
    fits = written(df.sparkSession, fits, "fits")
    e = [F.element_at("xy", F.lit(i + 1)) - _dot("xx", "null", k, i) for i in range(k)]
    now = [F.element_at("xy", F.lit(i + 1)) - _dot("xx", "beta", k, i) for i in range(k)]
    rows = beside(sums, fits, keys, few=True).select(*keys, "cluster", "xx", "inverse", F.array(*e).alias("e"), F.array(*now).alias("now"))
    rows = rows.select(
        *keys,
        "cluster",
        "e",
        F.array(*[_dot("inverse", "e", k, a) for a in at]).alias("p"),
        F.array(*[_dot("inverse", "now", k, a) for a in at]).alias("s"),
        F.array(*[sum((F.element_at("xx", F.lit(i * k + j + 1)) * F.element_at("inverse", F.lit(a * k + j + 1)) for j in range(k)), F.lit(0.0)) for a in at for i in range(k)]).alias("q"),
    )
    of = lambda c, i: F.element_at(c, F.lit(i + 1))
    pairs = [(a, b) for a in range(m) for b in range(m)]
    fixed = rows.groupBy(*keys).agg(
        F.array(*[F.sum(of("p", a) * of("p", b)) for a, b in pairs]).alias("pp"),
        F.array(*[F.sum(of("s", a) * of("s", b)) for a, b in pairs]).alias("ss"),
        F.array(*[F.sum(of("q", a * k + i) * of("q", b * k + j)) for a, b in pairs for i in range(k) for j in range(k)]).alias("qq"),
    )
    fixed = written(df.sparkSession, beside(fits, fixed, keys, few=True), "fixed")

    # One row for each cluster and block, then for each replicate; sums are combined before they are shuffled.
    blocks = rows.select("*", F.explode(F.sequence(F.lit(0), F.lit((replicates - 1) // _SIGNS))).alias("block"))
    bits = F.conv(F.substring(F.sha2(F.concat_ws("|", F.lit(str(seed)), F.col("block").cast("string"), "cluster"), 256), 1, 8), 16, 10).cast("bigint")
    blocks = blocks.select("*", bits.alias("bits"), F.explode(F.sequence(F.lit(0), F.lit(_SIGNS - 1))).alias("bit"))
    drawn = blocks.withColumn("replicate", F.col("block") * _SIGNS + F.col("bit")).filter(F.col("replicate") < replicates)
    drawn = drawn.withColumn("w", (1 - 2 * F.expr("shiftright(bits, bit) & 1")).cast("double"))
    drawn = drawn.groupBy(*keys, "replicate").agg(
        F.array(*[F.sum(F.col("w") * of("e", i)) for i in range(k)]).alias("u"),
        F.array(*[F.sum(F.col("w") * of("p", a) * of("q", b * k + i)) for a, b in pairs for i in range(k)]).alias("v"),
    )
    place = lambda x: x.select(*keys, F.col("seen"), F.col("se"), F.col("estimate"), "n_clusters", "inverse", "factor", "pp", "qq")
    seen_schema = f"{_types(fixed, keys)}, n_clusters bigint, inverse array<double>, factor double, pp array<double>, qq array<double>, seen double, se double, estimate double"

    def observed(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            beta, cov = np.stack(pdf["beta"])[:, at], pdf["factor"].to_numpy()[:, None, None] * np.stack(pdf["ss"]).reshape(-1, m, m)
            se = np.sqrt(np.maximum(cov[:, 0, 0], 0))
            found = beta[:, 0] / np.maximum(se, 1e-150) if m == 1 else np.einsum("ra,rab,rb->r", beta, np.linalg.pinv(cov), beta) / m
            yield pdf[[*keys, "n_clusters", "inverse", "factor", "pp", "qq"]].assign(seen=found, se=se, estimate=beta[:, 0])

    seen = place(fixed.mapInPandas(observed, seen_schema))
    found = beside(drawn, seen, keys, few=True).mapInPandas(lambda parts: _statistics(parts, k, at, keys), f"{_types(seen, keys)}, seen double, drawn double")
    p = found.groupBy(*keys).agg(F.avg((F.abs("drawn") >= F.abs("seen") * (1 - TIE)).cast("double")).alias("p_wild"))

    def classical(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            yield pdf.assign(p_classical=[dist.f_sf(x, m, g - 1) if m > 1 else dist.two_sided(x) for x, g in zip(pdf["statistic"], pdf["n_clusters"], strict=True)])

    out = beside(seen, p, keys, few=True).select(*keys, F.col("estimate").alias("beta"), "se", F.col("seen").alias("statistic"), "p_wild", "n_clusters")
    out = out.mapInPandas(classical, f"{_types(out, out.columns)}, p_classical double")
    return out.select(*cell, "beta", "se", "statistic", "p_wild", "p_classical", "n_clusters")


# ----- T-03, T-07: percentile and BCa intervals


def weights(clusters: DataFrame, keys: Sequence[str], seed: int, replicates: int) -> DataFrame:
    """(keys, replicate, i, weight): how often each replicate picks cluster i of a cell's ``size``; clusters has keys, i, size.

    Draw i of a replicate picks the hash of ``seed|block|i`` modulo size (60
    bits, four replicates a block), so a replicate is a sample of size clusters
    with replacement, and its draws lie wherever the clusters do.
    """
    blocks = clusters.select(*keys, "i", "size", F.explode(F.sequence(F.lit(0), F.lit((replicates - 1) // _PICKS))).alias("block"))
    hashed = blocks.withColumn("h", F.sha2(F.concat_ws("|", F.lit(str(seed)), F.col("block").cast("string"), F.col("i").cast("string")), 256))
    picks = F.explode(F.array(*[F.struct((F.col("block") * _PICKS + j).alias("replicate"), (F.conv(F.substring("h", 15 * j + 1, 15), 16, 10).cast("bigint") % F.col("size")).alias("i")) for j in range(_PICKS)]))
    rows = hashed.select(*keys, picks.alias("x")).select(*keys, "x.replicate", "x.i").filter(F.col("replicate") < replicates)
    return rows.groupBy(*keys, "replicate", "i").agg(F.count("*").alias("weight"))


def indexed(sums: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Clusters numbered in order of their names, with their cell's number of them."""
    by = Window.partitionBy(*keys)
    return sums.withColumn("i", F.row_number().over(by.orderBy("cluster")) - 1).withColumn("size", F.count("*").over(by))


def _estimates(parts: Iterator[pd.DataFrame], k: int, at: int, keep: list[str]) -> Iterator[pd.DataFrame]:
    """The term's least-squares coefficient from a row's X'X and X'y; null where X'X is singular."""
    for pdf in parts:
        a, b = np.stack(pdf["xx"]).reshape(-1, k, k), np.stack(pdf["xy"])
        found = np.einsum("rj,rj->r", np.linalg.pinv(a)[:, at], b)
        found[np.linalg.matrix_rank(a) <= at] = np.nan
        yield pdf[keep].assign(estimate=[None if np.isnan(x) else x for x in found])


def bootstrap_table(df: DataFrame, formula: str, term: str, cell: Sequence[str], cluster: str, seed: int, replicates: int = 499, alpha: float = 0.05) -> DataFrame:
    """T-03, T-04, T-07: percentile and BCa intervals of a coefficient over resampled clusters.

    Columns: ci_low, ci_high, bca_low, bca_high, share_below (of draws under the
    estimate), acceleration (from the jackknife over clusters), n_used.
    """
    spark = df.sparkSession
    sums, names, keys = _sums(df, formula, cell, cluster)
    k, at = len(names), names.index(term)
    numbered = written(spark, indexed(sums, keys), "numbered")
    drawn = beside(weights(numbered.select(*keys, "i", "size"), keys, seed, replicates), numbered.select(*keys, "i", "xx", "xy"), [*keys, "i"])
    total = lambda c, n: F.array(*[F.sum(F.col("weight") * F.element_at(c, F.lit(j + 1))) for j in range(n)]).alias(c)
    drawn = drawn.groupBy(*keys, "replicate").agg(total("xx", k * k), total("xy", k))
    solve = lambda rows: rows.mapInPandas(lambda parts: _estimates(parts, k, at, keys), f"{_types(rows, keys)}, estimate double")
    estimates = written(spark, solve(drawn).dropna(subset=["estimate"]), "estimates")

    totals = _totals(sums, k, keys)
    point = written(spark, solve(totals).withColumnRenamed("estimate", "point"), "points")
    less = lambda c, n: F.array(*[F.element_at(f"all_{c}", F.lit(j + 1)) - F.element_at(c, F.lit(j + 1)) for j in range(n)]).alias(c)
    out_of = beside(sums.select(*keys, "xx", "xy"), totals.select(*keys, F.col("xx").alias("all_xx"), F.col("xy").alias("all_xy")), keys, few=True)
    left_out = solve(out_of.select(*keys, less("xx", k * k), less("xy", k)))
    s = [F.sum(F.pow("estimate", F.lit(float(j)))) for j in (1, 2, 3)]
    # Moments about the mean from deviations from the point, near which all of them lie.
    moved = beside(left_out, point, keys, few=True).withColumn("estimate", F.col("estimate") - F.col("point"))
    jack = moved.groupBy(*keys).agg(F.count("estimate").alias("n"), *[x.alias(f"s{j}") for j, x in enumerate(s, 1)])
    mean = F.col("s1") / F.col("n")
    square = F.col("s2") - F.col("n") * mean * mean
    cube = -(F.col("s3") - 3 * mean * F.col("s2") + 2 * F.col("n") * F.pow(mean, F.lit(3.0)))
    jack = jack.select(*keys, (cube / (6 * F.pow(F.greatest(square, F.lit(1e-300)), F.lit(1.5)))).alias("acceleration"))

    below = beside(estimates, point, keys, few=True).groupBy(*keys).agg(
        F.percentile("estimate", F.lit(alpha / 2)).alias("ci_low"),
        F.percentile("estimate", F.lit(1 - alpha / 2)).alias("ci_high"),
        F.avg((F.col("estimate") < F.col("point")).cast("double")).alias("share_below"),
        F.count("*").alias("n_used"),
    )
    both = beside(below, jack, keys)

    def levels(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            found: list[list[float]] = [[], []]
            for share, n, accel in zip(pdf["share_below"], pdf["n_used"], pdf["acceleration"], strict=True):
                z0 = dist.NORMAL.inv_cdf(min(max(share, 1 / (2 * n)), 1 - 1 / (2 * n)))
                for side, p in enumerate((alpha / 2, 1 - alpha / 2)):
                    z = z0 + dist.NORMAL.inv_cdf(p)
                    found[side].append(dist.NORMAL.cdf(z0 + z / (1 - accel * z)))
            yield pdf.assign(low_level=found[0], high_level=found[1])

    both = written(spark, both.mapInPandas(levels, f"{_types(both, both.columns)}, low_level double, high_level double"), "levels")
    return beside(both, _quantiles(estimates, both, keys), keys).select(*cell, "ci_low", "ci_high", "bca_low", "bca_high", "share_below", "acceleration", "n_used")


def _quantiles(estimates: DataFrame, levels: DataFrame, keys: list[str]) -> DataFrame:
    """Quantiles at levels that differ by cell, between the two nearest ranks; a cell's draws are ``replicates`` rows."""
    ranked = estimates.withColumn("r", F.row_number().over(Window.partitionBy(*keys).orderBy("estimate")) - 1)
    rows = beside(ranked, levels.select(*keys, "n_used", "low_level", "high_level"), keys)
    out = []
    for side in ("low", "high"):
        place = F.col(f"{side}_level") * (F.col("n_used") - 1)
        out.append(F.sum(F.col("estimate") * F.greatest(1 - F.abs(F.col("r") - place), F.lit(0.0))).alias(f"bca_{side}"))
    return rows.groupBy(*keys).agg(*out)


# ----- T-20: SIMEX


def uniforms(digest: Column) -> Column:
    """Four shares of one, from 60 bits each of a SHA-256 in hex."""
    return F.array(*[(F.conv(F.substring(digest, 15 * j + 1, 15), 16, 10).cast("double") + 0.5) / float(1 << 60) for j in range(4)])


def normals(u: str) -> list[Column]:
    """Four standard normal deviates of a column of ``uniforms``, by sines and cosines of pairs."""
    return [F.sqrt(-2 * F.log(F.col(u)[j])) * f(2 * np.pi * F.col(u)[j + 1]) for j in (0, 2) for f in (F.cos, F.sin)]


def simex_table(
    df: DataFrame,
    cell: Sequence[str],
    cluster: str,
    item: str,
    outcome: str,
    predictor: str,
    error_variance: str,
    sign: str,
    seed: int = 0,
    draws: int = 200,
    outer: int = 200,
    inner: int = 20,
    lambdas: tuple[float, float, float, float] = (0.5, 1.0, 1.5, 2.0),
) -> DataFrame:
    """T-20: slope-by-sign interaction within clusters, extrapolated to a predictor without error, with an interval over resampled clusters.

    Predictor, its error variance (missing: the cell's mean) and sign belong to
    an item.  Noise is drawn for each item, draw and lambda; the coefficient's
    mean over draws is extrapolated by a quadratic to lambda = -1.  The interval
    repeats this with ``inner`` fresh draws on each of ``outer`` samples of
    clusters.  Nested draws are rows over item sums, and a sample multiplies
    what its clusters' deviations add to the normal equations, so work is split
    by rows and no cell lies in one task.  Columns: naive, simex, low, high,
    p_boot, n, n_items, n_clusters.  Rows that lack any of the columns are left out.
    """
    spark = df.sparkSession
    keys = list(cell)
    if not keys:
        df, keys = df.withColumn("__all", F.lit(0)), ["__all"]
    rows = df.select(*keys, F.col(cluster).cast("string").alias("cluster"), F.col(item).cast("string").alias("item"), *[F.col(c).cast("double").alias(n) for c, n in ((outcome, "y"), (predictor, "x"), (error_variance, "v"), (sign, "s"))])
    rows = rows.dropna(subset=["cluster", "item", "y", "x", "s"])
    items = rows.groupBy(*keys, "cluster", "item", "x", "v", "s").agg(F.count("*").alias("n"), F.sum("y").alias("sy"))
    items = written(spark, items, "items")
    mean = items.groupBy(*keys).agg(F.coalesce(F.avg("v"), F.lit(0.0)).alias("mean_v"))
    items = beside(items, mean, keys).withColumn("v", F.greatest(F.coalesce("v", "mean_v"), F.lit(0.0))).drop("mean_v")
    clusters = written(spark, indexed(items.select(*keys, "cluster").distinct(), keys), "clusters")

    # A cluster's items meet once the samples that picked it, and what these draw is summed where it is made:
    # the join's shuffle by cluster serves all that follows, so draws are never shuffled or written.
    # Outer sample -1 is the data itself, with more inner draws.
    name = F.to_json(F.struct(*keys, "cluster")).alias("__cluster")
    picks = clusters.select(name, F.lit(-1).alias("outer"), F.lit(1).cast("bigint").alias("weight"))
    if outer:
        drawn = beside(weights(clusters.select(*keys, "i", "size"), keys, seed, outer), clusters.select(*keys, "i", "cluster"), [*keys, "i"])
        picks = picks.unionAll(drawn.select(name, F.col("replicate").alias("outer"), "weight"))
    # A fixed number of parts, which the adaptive planner does not coalesce: few bytes, much work.
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    picks = picks.repartition(parts, "__cluster").groupBy("__cluster").agg(F.collect_list(F.struct("outer", "weight")).alias("picks"))
    own = items.select("*", name).repartition(parts, "__cluster").hint("merge").join(picks, "__cluster")
    nested = own.select("*", F.explode("picks").alias("o")).select("*", "o.outer", "o.weight").drop("picks", "o")
    nested = nested.select("*", F.explode(F.sequence(F.lit(0), F.when(F.col("outer") < 0, draws - 1).otherwise(inner - 1))).alias("inner"))
    material = F.concat_ws("|", F.lit(str(seed)), F.col("outer").cast("string"), F.col("inner").cast("string"), "cluster", "item")
    # Column by column, so that each is computed once for its row.
    nested = nested.withColumn("__digest", F.sha2(material, 256)).withColumn("__u", uniforms(F.col("__digest"))).drop("__digest")
    noise = [F.struct(F.lit(t).alias("t"), (F.col("x") + F.sqrt(F.lit(t) * F.col("v")) * z).alias("p")) for t, z in zip(lambdas, normals("__u"), strict=True)]
    # Without noise once for each sample.
    plain = F.when(F.col("inner") == 0, F.struct(F.lit(0.0).alias("t"), F.col("x").alias("p")))
    noisy = nested.withColumn("e", F.explode(F.array(*noise, plain))).filter("e is not null").select("__cluster", *keys, "outer", "weight", "inner", F.col("e.t").alias("t"), F.col("e.p").alias("p"), "s", "n", "sy")
    n, p, s, y = (F.col(c) for c in ("n", "p", "s", "sy"))
    sums = {"n": n, "p": n * p, "q": n * p * s, "pp": n * p * p, "pq": n * p * p * s, "qq": n * p * p * s * s, "y": y, "py": p * y, "qy": p * s * y}
    inside = noisy.groupBy("__cluster", *keys, "outer", "weight", "inner", "t").agg(*[F.sum(e).alias(f"s_{c}") for c, e in sums.items()])
    less = lambda a, b: (F.col(f"s_{a + b}") - F.col(f"s_{a}") * F.col(f"s_{b}") / F.col("s_n")).alias(a + b)
    inside = inside.select(*keys, "outer", "weight", "inner", "t", less("p", "p"), less("p", "q"), less("q", "q"), less("p", "y"), less("q", "y"))
    total = inside.groupBy(*keys, "outer", "inner", "t").agg(*[F.sum(F.col("weight") * F.col(c)).alias(c) for c in ("pp", "pq", "qq", "py", "qy")])
    det = F.col("pp") * F.col("qq") - F.col("pq") * F.col("pq")
    slope = F.when(det > 1e-12 * F.col("pp") * F.col("qq"), (F.col("pp") * F.col("qy") - F.col("pq") * F.col("py")) / det)
    curve = total.groupBy(*keys, "outer", "t").agg(F.avg(slope).alias("b"))
    # A quadratic's value at -1 is a fixed combination of its five means.
    grid = np.array([0.0, *lambdas])
    share = np.linalg.pinv(np.vander(grid, 3)).T @ np.array([1.0, -1.0, 1.0])
    weight = F.coalesce(*[F.when(F.col("t") == float(t), F.lit(float(w))) for t, w in zip(grid, share, strict=True)])
    estimates = curve.groupBy(*keys, "outer").agg(F.sum(weight * F.col("b")).alias("simex"), F.max(F.when(F.col("t") == 0, F.col("b"))).alias("naive"), F.count("b").alias("k")).filter(F.col("k") == len(grid))
    estimates = written(spark, estimates, "estimates")
    boot = estimates.filter("outer >= 0").groupBy(*keys).agg(F.percentile("simex", F.lit(0.025)).alias("low"), F.percentile("simex", F.lit(0.975)).alias("high"), (2 * F.least(F.avg((F.col("simex") <= 0).cast("double")), F.avg((F.col("simex") >= 0).cast("double")))).alias("p_boot"))
    sizes = items.groupBy(*keys).agg(F.sum("n").alias("n"), F.count("*").alias("n_items"), F.count_distinct("cluster").alias("n_clusters"))
    out = beside(estimates.filter("outer < 0").select(*keys, "naive", "simex"), sizes, keys)
    boot = boot.select(*[F.col(k).alias(f"__{k}") for k in keys], "low", "high", "p_boot")
    return out.join(boot, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys], "left").select(*cell, "naive", "simex", "low", "high", "p_boot", "n", "n_items", "n_clusters")
