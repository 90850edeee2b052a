"""Probes, angles, peaks and nulls from Gram matrices against plain matrices."""

import hashlib
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from gradus.operators import gram, vectors

D = 6


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(5)
    out = []
    for layer in range(3):
        for i in range(90):
            x = rng.normal(size=D)
            c = float(rng.normal()) if i % 8 else None
            y = float(x @ np.arange(D) / (3 - layer) + rng.normal() + 0.5 * (c or 0))
            out.append((layer, f"r{layer}-{i:03d}", f"g{i % 11}", int(i % 11 in (2, 5, 7)), c, y, [float(v) for v in x]))
    pdf = pd.DataFrame(out, columns=["layer", "id", "g", "part", "c", "y", "vec"])
    odd = [(0, "n1", "g1", 0, 1.0, None, [0.0] * D), (0, "n2", "g1", 0, 1.0, 1.0, None), (0, "n3", "g1", 0, 1.0, 1.0, [None, *[1.0] * (D - 1)]), (0, "n4", "g1", 0, 1.0, float("nan"), [0.0] * D), (1, "n5", "g1", 1, 1.0, 1.0, [float("nan")] * D)]
    df = spark.createDataFrame([*out, *odd], "layer int, id string, g string, part int, c double, y double, vec array<double>")
    return pdf, df.repartition(5)


def arrays(pdf, layer):
    own = pdf[pdf["layer"] == layer]
    return np.array(own["vec"].tolist()), own["y"].to_numpy(), own["part"].to_numpy() == 1, own["g"].to_numpy(), own


def fitted(x, y, train):
    w, b, mean, sd = vectors.ridge(x[train], y[train], 1.0)
    return (x - mean) / sd @ w + b


def r2(y, p):
    return 1 - ((y - p) ** 2).sum() / ((y - y.mean()) ** 2).sum()


def test_fits_match_plain_ridge(rows):
    pdf, df = rows
    got = {r.layer: r for r in gram.fits(gram.block_sums(df, ["layer"], "part", "y"), ["layer"]).collect()}
    for layer in range(3):
        x, y, test, _, _ = arrays(pdf, layer)
        p = fitted(x, y, ~test)
        assert math.isclose(got[layer].score, r2(y[test], p[test]), rel_tol=1e-9)
        assert np.allclose(x @ np.array(got[layer].weights) + got[layer].intercept, p)
        assert (got[layer].n_train, got[layer].n_test) == ((~test).sum(), test.sum())


def test_left_out_groups_and_folds(rows):
    pdf, df = rows
    got = {(r.layer, r.block): r.score for r in gram.left_out(gram.block_sums(df, ["layer"], "g", "y"), ["layer"]).collect()}
    folds = {(r.layer, r.g): r.fold for r in gram.group_folds(df.filter("id not like 'n%'"), ["layer"], "g", 4).collect()}
    joined = df.join(gram.group_folds(df.filter("id not like 'n%'"), ["layer"], "g", 4), ["layer", "g"])
    cv = {r.layer: r.cv_score for r in gram.cross_validated(gram.left_out(gram.block_sums(joined, ["layer"], "fold", "y"), ["layer"]), ["layer"]).collect()}
    for layer in range(3):
        x, y, _, g, _ = arrays(pdf, layer)
        for name in set(g):
            assert math.isclose(got[layer, name], r2(y[g == name], fitted(x, y, g != name)[g == name]), rel_tol=1e-8)
        want = vectors.folds(list(g), 4)
        sizes = lambda f: sorted(np.bincount(f, minlength=4))
        own = np.array([folds[layer, n] for n in g])
        assert sizes(own) == sizes(want)
        p = np.zeros(len(y))
        for k in range(4):
            p[own == k] = fitted(x, y, own != k)[own == k]
        assert math.isclose(cv[layer], r2(y, p), rel_tol=1e-9)


def test_residuals_learn_from_training_rows_alone(rows):
    pdf, df = rows
    df = df.filter("id not like 'n%' or y is null")
    got = {r.id: r.residual for r in gram.residualised(df, ["layer"], "y", ["c"], F.col("part") == 0).collect()}
    changed = df.withColumn("y", F.when(F.col("part") == 1, F.col("y") * 100).otherwise(F.col("y"))).withColumn("c", F.when(F.col("part") == 1, 7.0).otherwise(F.col("c")))
    again = {r.id: r.residual for r in gram.residualised(changed, ["layer"], "y", ["c"], F.col("part") == 0).filter("part = 0").collect()}
    for layer in range(3):
        _, y, test, _, own = arrays(pdf, layer)
        want = vectors.residualised(y[:, None], own[["c"]].to_numpy(float), ~test)[:, 0]
        assert np.allclose([got[i] for i in own["id"]], want)
        assert np.allclose([again[i] for i, t in zip(own["id"], test, strict=True) if not t], want[~test])


def test_peaks_of_shared_draws(rows):
    pdf, df = rows
    both = df.select("layer", "g", "part", "vec", F.explode(F.create_map(F.lit("a"), F.col("y"), F.lit("b"), F.col("vec")[0] * 2 + F.col("y") / (1 + 9 * F.col("layer")))).alias("k", "y"))
    f = gram.fits(gram.block_sums(both, ["k", "layer"], "part", "y"), ["k", "layer"])
    groups = gram.group_errors(both.filter("part = 1"), f, ["k", "layer"], "y", "g")
    drawn = gram.drawn_scores(groups, ["k", "layer"], 9, 40)
    got = gram.peak_differences(f, drawn, "k", "layer").first()
    names = sorted({"g2", "g5", "g7"})
    peaks = {"a": [], "b": []}
    for r in range(40):
        h = [hashlib.sha256(f"9|{r // 4}|{i}".encode()).hexdigest() for i in range(3)]
        picks = [names[int(x[15 * (r % 4) : 15 * (r % 4) + 15], 16) % 3] for x in h]
        for k in peaks:
            scores = []
            for layer in range(3):
                x, y, test, g, _ = arrays(pdf, layer)
                y = y if k == "a" else x[:, 0] * 2 + y / (1 + 9 * layer)
                p = fitted(x, y, ~test)
                at = np.concatenate([np.flatnonzero(test & (g == n)) for n in picks])
                scores.append(r2(y[at], p[at]))
            peaks[k].append(int(np.argmax(scores)))
    d = np.array(peaks["a"]) - np.array(peaks["b"])
    assert (got.diff_low, got.diff_high) == tuple(np.percentile(d, [2.5, 97.5])) and math.isclose(got.share_apart, (d != 0).mean()) and got.n_draws == 40


def test_angles_match_qr(spark):
    rng = np.random.default_rng(8)
    spans = {"a": rng.normal(size=(3, 7)), "b": rng.normal(size=(2, 7))}
    spans["c"] = np.vstack([spans["a"][0], spans["a"][0] * 2, spans["b"][1]])  # one member depends on another
    df = spark.createDataFrame([(k, i, [float(x) for x in v]) for k, m in spans.items() for i, v in enumerate(m)], "k string, i int, vec array<double>")
    got = {(r.construct_a, r.construct_b): r for r in gram.subspace_angles(df, "k", "i").collect()}
    spans["c"] = spans["c"][[0, 2]]
    for (a, b), r in got.items():
        want = vectors.principal_angles(spans[a].T, spans[b].T)
        assert math.isclose(r.least_angle, want.min(), abs_tol=1e-6) and math.isclose(r.greatest_angle, want.max(), rel_tol=1e-6) and math.isclose(r.mean_cosine, np.cos(want).mean(), rel_tol=1e-6)
    assert set(got) == {("a", "b"), ("a", "c"), ("b", "c")}


def test_permuted_targets_and_alignment(spark, rows):
    pdf, df = rows
    to = spark.createDataFrame([(layer, [1.0, *[0.5] * (D - 1)]) for layer in range(3)], "layer int, direction array<double>")
    got = {r.layer: r for r in gram.alignment_null(df.filter("id not like 'n%'"), to, ["layer"], "id", "y", 12, 4).collect()}
    for layer in range(3):
        x, y, _, _, own = arrays(pdf, layer)
        d = np.array([1.0, *[0.5] * (D - 1)])

        def cosine(t):
            w, _, _, sd = vectors.ridge(x, t, 1.0)
            return float(w / sd @ d / np.linalg.norm(w / sd) / np.linalg.norm(d))

        ids = own["id"].tolist()
        null = []
        for p in range(12):
            order = sorted(range(len(ids)), key=lambda i: hashlib.sha256(f"4|{p}|{ids[i]}".encode()).hexdigest())
            t = np.empty(len(y))
            t[order] = y[np.argsort(ids)]
            null.append(abs(cosine(t)))
        assert math.isclose(got[layer].cosine, cosine(y), rel_tol=1e-8)
        assert math.isclose(got[layer].null_high, np.percentile(null, 95), rel_tol=1e-8) and math.isclose(got[layer].null_median, np.median(null), rel_tol=1e-8)
