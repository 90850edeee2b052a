"""Linear probes from Gram matrices (T-27 to T-32, T-35).

A block is a fold, a part or a domain of a key's rows (a construct in a layer).
Its matrix of products of (1, x, y) is summed in the tasks where its rows lie
and then by entry, and a probe, its scores on any block, cross-validation and
the residualiser follow from such matrices.  Rows are read again only to score
groups that are resampled.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..session import written
from .resampling import _types, beside, indexed, weights

#: Entries that a task holds of matrices before it sends them on.
HELD = 4 << 20


def _summed(partial: DataFrame, by: Sequence[str]) -> DataFrame:
    """Rows (by, i, v) with one array each, added element by element."""
    entries = partial.select(*by, "i", F.posexplode("v").alias("j", "x")).groupBy(*by, "i", "j").agg(F.sum("x").alias("x"))
    return entries.groupBy(*by, "i").agg(F.transform(F.array_sort(F.collect_list(F.struct("j", "x"))), lambda e: e["x"]).alias("v"))


def block_sums(df: DataFrame, keys: Sequence[str], block: str, y: str, vector: str = "vec") -> DataFrame:
    """(keys, block, i, v): rows i of each block's matrix of products of (1, x, y).

    Rows without a target or vector, or with an element that is null or not a
    number, are left out; vectors of a key have one length.
    """
    bad = F.exists(vector, lambda e: e.isNull() | F.isnan(e.cast("double")))
    rows = df.select(*keys, F.col(block).alias("block"), F.col(y).cast("double").alias("y"), F.col(vector).cast("array<double>").alias("vec"))
    rows = rows.filter(F.col("y").isNotNull() & ~F.isnan("y") & F.col("vec").isNotNull() & ~F.coalesce(bad, F.lit(True)))
    by = [*keys, "block"]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple, np.ndarray] = {}

        def sent() -> Iterator[pd.DataFrame]:
            for at, m in held.items():
                yield pd.DataFrame({**{c: [v] * len(m) for c, v in zip(by, at, strict=True)}, "i": np.arange(len(m)), "v": list(m)}).astype({c: object for c in by})
            held.clear()

        for pdf in parts:
            for at, own in pdf.groupby(by, dropna=False, sort=False):
                at = tuple(None if pd.isna(v) else v for v in at)
                x = np.column_stack([np.ones(len(own)), np.stack(own["vec"]), own["y"].to_numpy()])
                held[at] = held[at] + x.T @ x if at in held else x.T @ x
            if sum(m.size for m in held.values()) > HELD:
                yield from sent()
        yield from sent()

    return _summed(rows.mapInPandas(run, f"{_types(rows, by)}, i int, v array<double>"), by)


def ridge(m: np.ndarray, penalty: float) -> tuple[float, np.ndarray]:
    """(intercept, coefficients) on the raw features of a ridge on standardised ones, from a matrix of products."""
    n, mean = m[0, 0], m[0, 1:-1] / m[0, 0]
    cov = m[1:-1, 1:-1] - n * np.outer(mean, mean)
    sd = np.sqrt(np.maximum(np.diag(cov) / n, 0))
    sd[sd <= 1e-12 * (1 + np.abs(mean))] = 1
    z = cov / np.outer(sd, sd)
    w = np.linalg.solve(z + penalty * np.eye(len(sd)), (m[1:-1, -1] - mean * m[0, -1]) / sd) if penalty else np.linalg.pinv(z) @ ((m[1:-1, -1] - mean * m[0, -1]) / sd)
    v = w / sd
    return float(m[0, -1] / n - v @ mean), v


def errors(m: np.ndarray, b: float, v: np.ndarray) -> float:
    """Sum of squared errors of b + v.x over the rows of a matrix of products."""
    c = np.concatenate([[b], v, [-1.0]])
    return float(c @ m @ c)


def spread(m: np.ndarray) -> float:
    return float(m[-1, -1] - m[0, -1] ** 2 / m[0, 0])


def _matrices(pdf: pd.DataFrame) -> dict[object, np.ndarray]:
    return {b: np.stack(own.sort_values("i")["v"]) for b, own in pdf.groupby("block", dropna=False)}


def fits(sums: DataFrame, keys: Sequence[str], penalty: float = 1.0) -> DataFrame:
    """T-27, T-30: the probe of each key from block 0, and its R^2 on block 1: (keys, intercept, weights, score, n_train, n_test).

    No test rows, or targets that don't vary there, give a null score; fewer
    than two rows to learn from give no row.  A key's matrices meet in one task.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        found = _matrices(pdf)
        train, test = found.get(0), found.get(1)
        if train is None or train[0, 0] < 2:
            return pd.DataFrame()
        b, v = ridge(train, penalty)
        score = None if test is None or spread(test) <= 0 else 1 - errors(test, b, v) / spread(test)
        return pd.DataFrame([{**{k: pdf[k].iloc[0] for k in keys}, "intercept": b, "weights": v, "score": score, "n_train": int(train[0, 0]), "n_test": 0 if test is None else int(test[0, 0])}])

    return sums.groupBy(*keys).applyInPandas(run, f"{_types(sums, keys)}, intercept double, weights array<double>, score double, n_train bigint, n_test bigint")


def left_out(sums: DataFrame, keys: Sequence[str], penalty: float = 1.0) -> DataFrame:
    """T-29: for each key and block, R^2 there of a probe of all other blocks, with its squared errors and spread; null without two other rows."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        found = _matrices(pdf)
        total = sum(found.values())
        out = []
        for block, m in found.items():
            rest, score, sse = total - m, None, None
            if rest[0, 0] >= 2:
                sse = errors(m, *ridge(rest, penalty))
                score = 1 - sse / spread(m) if spread(m) > 0 else None
            out.append({**{k: pdf[k].iloc[0] for k in keys}, "block": block, "score": score, "n": int(m[0, 0]), "sse": sse, "sy": m[0, -1], "syy": m[-1, -1]})
        return pd.DataFrame(out)

    return sums.groupBy(*keys).applyInPandas(run, f"{_types(sums, [*keys, 'block'])}, score double, n bigint, sse double, sy double, syy double")


def cross_validated(scores: DataFrame, keys: Sequence[str]) -> DataFrame:
    """T-29: R^2 of all held-out predictions together, from ``left_out`` by fold."""
    s = scores.groupBy(*keys).agg(F.sum("sse").alias("sse"), F.sum("n").alias("n"), F.sum("sy").alias("sy"), F.sum("syy").alias("syy"))
    return s.select(*keys, (1 - F.try_divide(F.col("sse"), F.col("syy") - F.col("sy") * F.col("sy") / F.col("n"))).alias("cv_score"), "n")


def group_folds(df: DataFrame, keys: Sequence[str], group: str, k: int) -> DataFrame:
    """T-29: (keys, group, fold): whole groups, largest first (then by name), each to the fold with the fewest rows so far.

    Only the groups' sizes are gathered for it.
    """
    sizes = df.groupBy(*keys, F.col(group).cast("string").alias(group)).agg(F.count("*").alias("n"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        load, folds = np.zeros(k), []
        pdf = pdf.sort_values(["n", group], ascending=[False, True])
        for n in pdf["n"]:
            folds.append(int(load.argmin()))
            load[folds[-1]] += n
        return pdf[[*keys, group]].assign(fold=folds)

    return sizes.groupBy(*keys).applyInPandas(run, f"{_types(sizes, [*keys, group])}, fold int")


# ----- T-28


def residualised(df: DataFrame, keys: Sequence[str], y: str, controls: Sequence[str], train: Column, name: str = "residual") -> DataFrame:
    """df with y less what controls predict, by least squares on training rows of the key; missing controls take its training mean.

    Means and products are taken over training rows with a target alone.  Null where y is.
    """
    value = lambda c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double"))
    rows = df.withColumn("__train", F.coalesce(train, F.lit(False)) & value(y).isNotNull())
    means = rows.filter("__train").groupBy(*keys).agg(*[F.coalesce(F.avg(value(c)), F.lit(0.0)).alias(f"__mean_{c}") for c in controls])
    filled = beside(rows, means, keys).withColumn("__controls", F.array(*[F.coalesce(value(c), F.col(f"__mean_{c}")) for c in controls]).cast("array<double>"))
    sums = block_sums(filled.filter("__train").withColumn("__block", F.lit(0)), keys, "__block", y, "__controls")
    line = fits(sums, keys, penalty=0.0).select(*keys, "intercept", F.col("weights").alias("__slopes"))
    said = F.col("intercept") + F.aggregate(F.zip_with("__slopes", "__controls", lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)
    out = beside(filled, line, keys).withColumn(name, F.col(y).cast("double") - said)
    return out.drop("__train", "__controls", "__slopes", "intercept", *[f"__mean_{c}" for c in controls])


# ----- T-31


def group_errors(df: DataFrame, probes: DataFrame, keys: Sequence[str], y: str, group: str, vector: str = "vec") -> DataFrame:
    """(keys, group, n, sy, syy, sse) of the rows of df under each key's probe."""
    p = F.col("intercept") + F.aggregate(F.zip_with(F.col("weights"), F.col(vector).cast("array<double>"), lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)
    rows = beside(df, probes.select(*keys, "intercept", "weights"), keys).select(*keys, F.col(group).cast("string").alias("group"), F.col(y).cast("double").alias("y"), p.alias("p")).dropna(subset=["y", "p"])
    return rows.groupBy(*keys, "group").agg(F.count("*").alias("n"), F.sum("y").alias("sy"), F.sum(F.col("y") * F.col("y")).alias("syy"), F.sum((F.col("y") - F.col("p")) ** 2).alias("sse"))


def drawn_scores(groups: DataFrame, keys: Sequence[str], seed: int, draws: int) -> DataFrame:
    """(keys, replicate, score): each draw resamples the groups of all keys together, so keys share it."""
    names = indexed(groups.select(F.lit(0).alias("__all"), F.col("group").alias("cluster")).distinct(), ["__all"])
    picked = weights(names.select("__all", "i", "size"), ["__all"], seed, draws)
    named = beside(picked, names.select("__all", "i", F.col("cluster").alias("group")), ["__all", "i"]).select("group", "replicate", "weight")
    total = lambda c: F.sum(F.col("weight") * F.col(c))
    s = beside(groups, named, ["group"]).groupBy(*keys, "replicate").agg(*[total(c).alias(c) for c in ("n", "sy", "syy", "sse")])
    around = F.col("syy") - F.col("sy") * F.col("sy") / F.col("n")
    return s.select(*keys, "replicate", F.when(around > 0, 1 - F.col("sse") / around).alias("score"))


def peak_differences(scores: DataFrame, drawn: DataFrame, construct: str, layer: str) -> DataFrame:
    """T-31: for each pair of constructs the difference of their best layers, its interval over draws, and the share of draws where they differ.

    ``scores`` has the observed score by construct and layer, ``drawn`` those of
    shared draws.  Missing scores don't compete; of equal ones the lowest layer
    is the peak.  A pair without a common draw has nulls.
    """
    best = lambda df, by: df.filter("score is not null").groupBy(*by).agg(F.max_by(layer, F.struct("score", -F.col(layer))).alias("peak"))
    seen, moved = best(scores, [construct]), best(drawn, [construct, "replicate"])
    named = lambda df, x: df.select(*[F.col(c).alias(c if c == "replicate" else f"{c}_{x}") for c in df.columns])
    a, b = f"{construct}_a", f"{construct}_b"
    pairs = named(moved, "a").join(named(moved, "b"), "replicate").filter(F.col(a) < F.col(b)).withColumn("d", F.col("peak_a") - F.col("peak_b"))
    spread_ = pairs.groupBy(a, b).agg(F.percentile("d", F.lit(0.025)).alias("diff_low"), F.percentile("d", F.lit(0.975)).alias("diff_high"), F.avg((F.col("d") != 0).cast("double")).alias("share_apart"), F.count("*").alias("n_draws"))
    observed = named(seen, "a").join(named(seen, "b"), F.col(a) < F.col(b)).withColumn("diff", F.col("peak_a") - F.col("peak_b"))
    return observed.join(spread_, [a, b], "left")


# ----- T-32


def subspace_angles(directions: DataFrame, construct: str, member: str, vector: str = "vec") -> DataFrame:
    """T-32: principal angles of the spans of constructs' direction vectors: for each pair the least and greatest angle, and the greatest and mean cosine.

    Inner products of all members come from one join by element; a pair's few
    products are whitened by Cholesky factors (dependent members count once) and
    the singular values of what is left are the cosines.
    """
    long = directions.select(F.col(construct).alias("c"), F.col(member).alias("m"), F.posexplode(F.col(vector).cast("array<double>")).alias("pos", "x"))
    other = long.select(F.col("c").alias("d"), F.col("m").alias("o"), "pos", F.col("x").alias("y"))
    products = long.join(other, "pos").groupBy("c", "m", "d", "o").agg(F.sum(F.col("x") * F.col("y")).alias("v"))
    products = written(directions.sparkSession, products, "products")
    lists = products.groupBy("c", "d").agg(F.array_sort(F.collect_list(F.struct("m", "o", "v"))).alias("g"))
    own = lists.filter("c = d").select(F.col("c").alias("own"), F.col("g").alias("h"))
    rows = lists.filter("c < d").join(own.select(F.col("own").alias("c"), F.col("h").alias("gc")), "c").join(own.select(F.col("own").alias("d"), F.col("h").alias("gd")), "d")

    def square(g: list, rows_: list, columns: list) -> np.ndarray:
        at = {(e["m"], e["o"]): e["v"] for e in g}
        return np.array([[at[r, c] for c in columns] for r in rows_])

    def whitener(g: np.ndarray) -> np.ndarray:
        """W with W g W' = I on the members that don't depend on earlier ones."""
        kept: list[int] = []
        for i in range(len(g)):
            try_ = [*kept, i]
            part = g[np.ix_(try_, try_)]
            if np.linalg.eigvalsh(part / np.sqrt(np.outer(np.diag(part), np.diag(part)) + 1e-300)).min() > 1e-10:
                kept.append(i)
        w = np.zeros((len(kept), len(g)))
        if kept:
            w[:, kept] = np.linalg.inv(np.linalg.cholesky(g[np.ix_(kept, kept)]))
        return w

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            out = []
            for c, d, g, gc, gd in zip(*(pdf[x] for x in ("c", "d", "g", "gc", "gd")), strict=True):
                ms, os = sorted({e["m"] for e in g}), sorted({e["o"] for e in g})
                cross = whitener(square(gc, ms, ms)) @ square(g, ms, os) @ whitener(square(gd, os, os)).T
                if not cross.size:
                    continue
                cos = np.clip(np.linalg.svd(cross, compute_uv=False), 0, 1)
                out.append((c, d, float(np.arccos(cos.max())), float(np.arccos(cos.min())), float(cos.max()), float(cos.mean())))
            yield pd.DataFrame(out, columns=["construct_a", "construct_b", "least_angle", "greatest_angle", "top_cosine", "mean_cosine"])

    kind = T.DataType.simpleString(directions.schema[construct].dataType)
    return rows.mapInPandas(run, f"construct_a {kind}, construct_b {kind}, least_angle double, greatest_angle double, top_cosine double, mean_cosine double")


# ----- T-35


def permuted_targets(rows: DataFrame, keys: Sequence[str], row: str, y: str, seed: int, permutations: int) -> DataFrame:
    """(keys, row, ys): what each permutation gives a row, in order of permutations.

    A permutation orders a key's rows by the hash of ``seed|permutation|row``;
    the r-th of them takes the target of the r-th row by name.
    """
    base = rows.select(*keys, F.col(row).cast("string").alias("row"), F.col(y).cast("double").alias("y"))
    given = base.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy("row"))).select(*keys, "rank", "y")
    each = base.select(*keys, "row", F.explode(F.sequence(F.lit(0), F.lit(permutations - 1))).alias("p"))
    hashed = each.withColumn("h", F.sha2(F.concat_ws("|", F.lit(str(seed)), F.col("p").cast("string"), "row"), 256))
    ranked = hashed.withColumn("rank", F.row_number().over(Window.partitionBy(*keys, "p").orderBy("h", "row")))
    back = beside(ranked.select(*keys, "row", "p", "rank"), given, [*keys, "rank"])
    return back.groupBy(*keys, "row").agg(F.transform(F.array_sort(F.collect_list(F.struct("p", "y"))), lambda e: e["y"]).alias("ys"))


def alignment_null(df: DataFrame, directions: DataFrame, keys: Sequence[str], row: str, y: str, permutations: int = 50, seed: int = 0, penalty: float = 1.0, vector: str = "vec") -> DataFrame:
    """T-35: cosine of each key's probe with a given direction (keys, direction), against probes of permuted targets.

    Columns: cosine, null_high (95th percentile of absolute cosines), null_median,
    random_sd (1 / sqrt of the dimensions), aligned (above null_high).  X'X is
    the same in every permutation, so one aggregation of X'y for all of them,
    summed where the rows lie, gives all probes.  Rows are told apart by ``row``.
    """
    spark = df.sparkSession
    rows = df.select(*keys, F.col(row).cast("string").alias("row"), F.col(y).cast("double").alias("y"), F.col(vector).cast("array<double>").alias("vec")).dropna(subset=["row", "y", "vec"])
    rows = written(spark, rows, "rows")
    sums = block_sums(rows.withColumn("block", F.lit(0)), keys, "block", "y")
    given = permuted_targets(rows, keys, "row", "y", seed, permutations)
    both = beside(rows.select(*keys, "row", "vec", "y"), given, [*keys, "row"]).select(*keys, "vec", F.concat(F.array("y"), "ys").alias("ys"))
    names = list(keys)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple, np.ndarray] = {}
        for pdf in parts:
            for at, own in pdf.groupby(names, dropna=False, sort=False):
                at = tuple(None if pd.isna(v) else v for v in at)
                m = np.stack(own["ys"]).T @ np.stack(own["vec"])
                held[at] = held[at] + m if at in held else m
        for at, m in held.items():
            yield pd.DataFrame({**{c: [v] * len(m) for c, v in zip(names, at, strict=True)}, "i": np.arange(len(m)), "v": list(m)}).astype({c: object for c in names})

    crossed = _summed(both.mapInPandas(run, f"{_types(both, names)}, i int, v array<double>"), names)
    matrix = sums.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("i", "v"))).alias("m"))
    found = crossed.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("i", "v"))).alias("xys"))
    joined = beside(beside(matrix, found, keys), directions.select(*keys, F.col("direction").cast("array<double>").alias("direction")), keys)

    def compare(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            out = []
            for m, xys, to in zip(pdf["m"], pdf["xys"], pdf["direction"], strict=True):
                m, to = np.stack([e["v"] for e in m]), np.asarray(to)
                cosines = []
                for e in xys:
                    own = m.copy()
                    own[1:-1, -1] = own[-1, 1:-1] = e["v"]
                    v = ridge(own, penalty)[1]
                    size = np.linalg.norm(v) * np.linalg.norm(to)
                    cosines.append(float(v @ to / size) if size > 1e-12 else 0.0)
                null = np.abs(cosines[1:])
                out.append((cosines[0], float(np.percentile(null, 95)), float(np.median(null)), 1 / np.sqrt(len(to)), bool(abs(cosines[0]) > np.percentile(null, 95))))
            yield pdf[names].assign(**dict(zip(("cosine", "null_high", "null_median", "random_sd", "aligned"), map(list, zip(*out, strict=True)), strict=True)))

    return joined.mapInPandas(compare, f"{_types(joined, names)}, cosine double, null_high double, null_median double, random_sd double, aligned boolean")
