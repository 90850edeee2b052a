import hashlib
import math
import statistics

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from gradus.operators import power, profile, resampling, stats, vectors
from gradus.plans import analysis


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(7)
    rows = []
    for g in range(24):
        u = rng.normal(0, 1)
        for _ in range(10):
            x, z = rng.normal(), float(rng.integers(0, 2)) - 0.5
            rows.append((f"g{g:02d}", x, z, 2 + 0.7 * x + 0.4 * z + u + rng.normal()))
    return pd.DataFrame(rows, columns=["g", "x", "z", "y"])


def dense(data, terms):
    X = np.column_stack([np.ones(len(data)), *[np.prod([data[c] for c in t.split(":")], axis=0) for t in terms]])
    return X, data["y"].to_numpy(), data["g"].to_numpy()


def cluster_cov(X, y, g):
    inverse = np.linalg.inv(X.T @ X)
    e = y - X @ (inverse @ X.T @ y)
    names = np.unique(g)
    m = sum(np.outer(X[g == n].T @ e[g == n], X[g == n].T @ e[g == n]) for n in names)
    k = len(names) / (len(names) - 1) * (len(y) - 1) / (len(y) - X.shape[1])
    return inverse @ X.T @ y, k * inverse @ m @ inverse


def test_formulas():
    d = stats.design("y ~ a * b + C(f)")
    assert d.names == ["a", "b", "a:b"] and d.factor == "f"
    assert stats.design("y ~ 1").names == ["Intercept"]


def test_ols_matches_rows(spark, data):
    got = stats.ols_table(spark.createDataFrame(data), "y ~ x * z", "x:z", [], "g").first()
    X, y, g = dense(data, ["x", "z", "x:z"])
    beta, cov = cluster_cov(X, y, g)
    assert math.isclose(got.estimate, beta[3], rel_tol=1e-9) and math.isclose(got.se, math.sqrt(cov[3, 3]), rel_tol=1e-9)


def test_absorbed_factor_matches_dummies(spark, data):
    got = stats.ols_table(spark.createDataFrame(data), "y ~ x + C(g)", "x", [], "g").first()
    D = pd.get_dummies(data["g"]).to_numpy(float)
    X = np.column_stack([data["x"], D])
    beta, cov = cluster_cov(X, data["y"].to_numpy(), data["g"].to_numpy())
    assert math.isclose(got.estimate, beta[0], rel_tol=1e-8) and math.isclose(got.se, math.sqrt(cov[0, 0]), rel_tol=1e-6)


def hashed_signs(seed, replicate, names):
    digest = lambda n: hashlib.sha256(f"{seed}|{replicate // 32}|{n}".encode()).hexdigest()
    return np.array([1.0 - 2 * (int(digest(n)[:8], 16) >> replicate % 32 & 1) for n in names])


@pytest.mark.parametrize("terms", [["z"], ["x", "z"]])
def test_wild_bootstrap_matches_refits(spark, data, terms):
    got = resampling.wild_table(spark.createDataFrame(data), "y ~ x + z", terms, [], "g", 3, 99).first()
    X, y, g = dense(data, ["x", "z"])
    at = [["x", "z"].index(t) + 1 for t in terms]

    def statistic(v):
        beta, cov = cluster_cov(X, v, g)
        if len(at) == 1:
            return beta[at[0]] / math.sqrt(cov[at[0], at[0]])
        return beta[at] @ np.linalg.inv(cov[np.ix_(at, at)]) @ beta[at] / len(at)

    t = statistic(y)
    R = X[:, [i for i in range(3) if i not in at]]
    fit = R @ np.linalg.lstsq(R, y, rcond=None)[0]
    names, code = np.unique(g, return_inverse=True)
    ts = [statistic(fit + hashed_signs(3, r, names)[code] * (y - fit)) for r in range(99)]
    assert math.isclose(got.statistic, t, rel_tol=1e-9) and got.n_clusters == 24
    assert math.isclose(got.p_wild, float(np.mean(np.abs(ts) >= abs(t))), abs_tol=1e-12)


def test_bootstrap_matches_resampled_rows(spark, data):
    got = resampling.bootstrap_table(spark.createDataFrame(data), "y ~ x", "x", [], "g", 5, 80).first()
    X, y, g = dense(data, ["x"])
    names = np.unique(g)
    slope = lambda rows: np.linalg.lstsq(X[rows], y[rows], rcond=None)[0][1]
    draws = []
    for r in range(80):
        h = [hashlib.sha256(f"5|{r // 4}|{i}".encode()).hexdigest() for i in range(24)]
        picks = [int(x[15 * (r % 4) : 15 * (r % 4) + 15], 16) % 24 for x in h]
        draws.append(slope(np.concatenate([np.flatnonzero(g == names[p]) for p in picks])))
    draws, point = np.array(draws), slope(np.arange(len(y)))
    jack = np.array([slope(np.flatnonzero(g != n)) for n in names])
    dev = jack.mean() - jack
    accel = (dev**3).sum() / (6 * (dev**2).sum() ** 1.5)
    share = (draws < point).mean()
    normal = statistics.NormalDist()
    z0 = normal.inv_cdf(share)
    levels = [normal.cdf(z0 + (z0 + q) / (1 - accel * (z0 + q))) for q in (normal.inv_cdf(0.025), normal.inv_cdf(0.975))]
    want = [*np.percentile(draws, [2.5, 97.5]), *np.quantile(draws, levels), share, accel]
    assert np.allclose([got.ci_low, got.ci_high, got.bca_low, got.bca_high, got.share_below, got.acceleration], want, rtol=1e-8, atol=1e-10)
    assert got.n_used == 80


def test_bootstraps_do_not_depend_on_partitions(spark, data):
    seen = set()
    for n in ("1", "9"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        df = spark.createDataFrame(data).repartition(int(n)).withColumn("cell", F.when(F.col("x") > 0, "a"))
        rows = resampling.wild_table(df, "y ~ x", ["x"], ["cell"], "g", 1, 64).union(resampling.bootstrap_table(df, "y ~ x", "x", ["cell"], "g", 1, 64).select("cell", "ci_low", "ci_high", "bca_low", "bca_high", "acceleration", "n_used")).collect()
        assert {r.cell for r in rows} == {"a", None}
        seen.add(tuple(sorted(str([None if v is None else round(v, 9) if isinstance(v, float) else v for v in r]) for r in rows)))
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert len(seen) == 1


def test_mixed_model_is_the_maximum(spark, data):
    c = stats.Clusters.of(stats.sufficient(spark.createDataFrame(data), stats.design("y ~ x"), [], "g").toPandas())
    m = stats.lmm(c)
    X, y, g = dense(data, ["x"])

    def log_likelihood(beta, vg, vr):
        total = 0.0
        for n in np.unique(g):
            r = (y - X @ beta)[g == n]
            v = vr * np.eye(len(r)) + vg
            total -= 0.5 * (len(r) * math.log(2 * math.pi) + np.linalg.slogdet(v)[1] + r @ np.linalg.solve(v, r))
        return total

    top = log_likelihood(m["beta"], m["var_cluster"], m["var_resid"])
    assert math.isclose(top, m["log_likelihood"], rel_tol=1e-10)
    for a in (0.97, 1.03):
        assert log_likelihood(m["beta"], m["var_cluster"] * a, m["var_resid"]) <= top
        assert log_likelihood(m["beta"], m["var_cluster"], m["var_resid"] * a) <= top
    assert abs(m["beta"][1] - 0.7) < 0.2 and 0.4 < m["var_cluster"] < 2.5


def test_profiles_match_a_search_in_one_place(spark, data):
    df = spark.createDataFrame(data)
    c = stats.Clusters.of(stats.sufficient(df, stats.design("y ~ x + z"), [], "g").toPandas())
    m = stats.lmm(c)
    got = profile.lmm_table(df, "y ~ x + z", "x", [], "g").first()
    assert math.isclose(got.estimate, m["beta"][1], rel_tol=1e-7) and math.isclose(got.se, math.sqrt(m["cov"][1, 1]), rel_tol=1e-7)
    assert got.converged and got.method == "lmm-gRI" and (got.n_obs, got.n_groups) == (240, 24)
    lrt = profile.lrt_table(df, "y ~ x + z", "y ~ z", [], "g").first()
    small = stats.Clusters.of(stats.sufficient(df, stats.design("y ~ z"), [], "g").toPandas())
    assert math.isclose(lrt.chi2, 2 * (m["log_likelihood"] - stats.lmm(small)["log_likelihood"]), rel_tol=1e-8) and lrt.df == 1 and lrt.p_value < 1e-6
    reml = profile.reml_table(df, [], "g", "y").first()
    one = stats.lmm(stats.Clusters.of(stats.sufficient(df, stats.design("y ~ 1"), [], "g").toPandas()), reml=True)
    assert math.isclose(reml.var_group, one["var_cluster"], rel_tol=1e-5) and math.isclose(reml.var_resid, one["var_resid"], rel_tol=1e-6)
    moments = stats.variance_components(df.withColumn("a", F.lit(1)), ["a"], "g", "y").first()
    assert abs(reml.var_group - moments.var_group) < 0.2 and abs(reml.icc - moments.icc) < 0.1
    slope = stats.slope_table(df, "y ~ x", "x", [], "g").first()
    assert abs(slope.estimate - 0.7) < 0.25 and slope.slope_variance < 0.3


def test_a_cell_of_one_cluster_falls_back(spark):
    df = spark.createDataFrame([("a", float(i), float(2 * i + i % 3)) for i in range(9)], "g string, x double, y double")
    got = profile.lmm_table(df, "y ~ x", "x", [], "g").first()
    assert got.n_groups == 1 and got.n_obs == 9 and got.fallback_used != got.converged


def test_interaction_of_factors_matches_dense_fits(spark):
    rng = np.random.default_rng(33)
    rows = []
    for g in range(30):
        u = rng.normal()
        for _ in range(rng.integers(3, 12)):
            a, b = rng.choice(["base", "half", "full"]), rng.choice(["p", "q", "r", "s"])
            if (a, b) != ("full", "r"):  # a pair that never occurs
                rows.append((f"g{g}", a, b, float(u + (a == "half") + 0.5 * (b == "q") + 0.9 * (a == "full") * (b == "s") + rng.normal())))
    pdf = pd.DataFrame(rows, columns=["g", "a", "b", "y"])
    df = spark.createDataFrame([*rows, (None, "base", "p", 1.0), ("g1", None, "p", 1.0), ("g1", "base", "p", None), ("g1", "base", "p", float("nan"))], "g string, a string, b string, y double")
    got = profile.interaction_test(df, "y", "a", "b", "g").first()

    def top(X):
        y, code = pdf["y"].to_numpy(), pd.factorize(pdf["g"])[0]
        n = np.bincount(code).astype(float)
        S, t = np.zeros((len(n), X.shape[1])), np.bincount(code, y)
        np.add.at(S, code, X)

        def log(rho):
            s = rho / (1 + n * rho)
            a, b = X.T @ X - (S * s[:, None]).T @ S, X.T @ y - S.T @ (s * t)
            rss = y @ y - (s * t * t).sum() - b @ np.linalg.pinv(a) @ b
            return -0.5 * (len(y) * (math.log(2 * math.pi * rss / len(y)) + 1) + np.log1p(n * rho).sum())

        grid = np.concatenate([[0], np.exp(np.linspace(-10, 6, 4001))])
        return max(map(log, grid)), np.linalg.matrix_rank(X)

    x, z = pd.get_dummies(pdf["a"]).to_numpy(float), pd.get_dummies(pdf["b"]).to_numpy(float)
    full, reduced = top(np.einsum("ni,nj->nij", x, z).reshape(len(pdf), -1)), top(np.column_stack([x, z]))
    assert math.isclose(got.chi2, 2 * (full[0] - reduced[0]), abs_tol=1e-4)
    assert (got.df, got.n_cells, got.n_obs, got.n_groups) == (full[1] - reduced[1], 11, len(pdf), 30) and got.df == 5


def test_interaction_of_nothing(spark):
    empty = spark.createDataFrame([], "g string, a string, b string, y double")
    assert profile.interaction_test(empty, "y", "a", "b", "g").count() == 0
    one = spark.createDataFrame([("g", "a", "b", 1.0), ("h", "a", "b", 2.0)], "g string, a string, b string, y double")
    assert profile.interaction_test(one, "y", "a", "b", "g").first().p_value is None


def test_likelihood_models(spark):
    rng = np.random.default_rng(2)
    x = rng.integers(0, 2, 2000) - 0.5
    y = (rng.random(2000) < 1 / (1 + np.exp(-(0.3 + 1.2 * x)))).astype(int)
    o = np.clip(np.rint(2 + x + rng.logistic(0, 1, 2000)), 0, 4)
    df = spark.createDataFrame(pd.DataFrame({"x": x, "y": y, "o": o}))
    a = stats.logistic_table(df, "y ~ x", "x").first()
    p1, p0 = y[x > 0].mean(), y[x < 0].mean()
    assert math.isclose(a.estimate, math.log(p1 / (1 - p1)) - math.log(p0 / (1 - p0)), abs_tol=1e-4)
    b = stats.ordinal_table(df, "o ~ x", "x").first()
    assert abs(b.estimate - 1) < 0.25 and b.converged


def test_sampled_ordinal_model(spark):
    rng = np.random.default_rng(8)
    rows = []
    for g in range(12):
        u = rng.normal(0, 0.7)
        for _ in range(60):
            x = float(rng.integers(0, 2)) - 0.5
            rows.append((f"g{g}", x, float(np.clip(np.rint(2 + 1.0 * x + u + rng.logistic(0, 1)), 0, 4))))
    got = stats.bayes_ordinal_table(spark.createDataFrame(rows, "g string, x double, y double"), "y ~ x", "x", "g", draws=600, warmup=400).first()
    assert abs(got.mean - 1) < 0.5 and got.low < got.mean < got.high and got.p_positive > 0.95 and 0.2 < got.group_sd < 1.6


def test_simex_undoes_attenuation(spark):
    rng = np.random.default_rng(4)
    rows, dense = [], []
    for g in range(40):
        for i in range(6):
            x, s = rng.normal(), (-1.0) ** i / 2
            w, y = x + 0.6 * rng.normal(), None
            for _ in range(3):
                y = 1.0 * x + 0.8 * x * s + 0.2 * g + rng.normal(0, 0.3)
                rows.append((f"g{g:02d}", f"{i}", w, 0.36 if i else None, s, y))
            dense.append((g, w, s))
    df = spark.createDataFrame([*rows, ("g00", "0", None, 0.3, 0.5, 1.0)], "g string, i string, w double, v double, s double, y double")
    got = resampling.simex_table(df, [], "g", "i", "y", "w", "v", "s", seed=1, draws=40, outer=24, inner=6).first()
    assert got.n == 720 and got.n_items == 240 and got.n_clusters == 40
    pdf = pd.DataFrame(rows, columns=["g", "i", "w", "v", "s", "y"])

    def slope(noise, weight):
        p = pdf["w"] + noise
        a = b = 0
        for g, own in pdf.groupby("g"):
            m = weight.get(g, 0)
            z = np.column_stack([p[own.index], p[own.index] * own["s"]])
            z = z - z.mean(axis=0)
            a, b = a + m * z.T @ z, b + m * z.T @ (own["y"] - own["y"].mean()).to_numpy()
        return np.linalg.solve(a, b)[1]

    ones = {g: 1 for g in pdf["g"].unique()}
    assert math.isclose(got.naive, slope(0.0, ones), rel_tol=1e-9)
    uniform = lambda h: [(int(h[15 * j : 15 * j + 15], 16) + 0.5) / 2**60 for j in range(4)]

    def extrapolated(outer, draws, weight):
        means = [slope(0.0, weight)]
        found = np.zeros((draws, 4))
        for d in range(draws):
            z = {}
            for g, i in {(r.g, r.i) for r in pdf.itertuples()}:
                u = uniform(hashlib.sha256(f"1|{outer}|{d}|{g}|{i}".encode()).hexdigest())
                z[g, i] = [math.sqrt(-2 * math.log(u[j])) * f(2 * math.pi * u[j + 1]) for j in (0, 2) for f in (math.cos, math.sin)]
            for k, t in enumerate((0.5, 1.0, 1.5, 2.0)):
                found[d, k] = slope(np.array([math.sqrt(t * 0.36) * z[r.g, r.i][k] for r in pdf.itertuples()]), weight)
        return np.polyval(np.polyfit([0, 0.5, 1, 1.5, 2], [means[0], *found.mean(axis=0)], 2), -1)

    few = resampling.simex_table(df, [], "g", "i", "y", "w", "v", "s", seed=1, draws=2, outer=3, inner=1).first()
    assert math.isclose(few.simex, extrapolated(-1, 2, ones), rel_tol=1e-8)
    names, draws = sorted(ones), []
    for r in range(3):
        picks = [int(hashlib.sha256(f"1|{r // 4}|{i}".encode()).hexdigest()[15 * (r % 4) : 15 * (r % 4) + 15], 16) % 40 for i in range(40)]
        draws.append(extrapolated(r, 1, {names[p]: picks.count(p) for p in picks}))
    assert np.allclose([few.low, few.high], np.percentile(draws, [2.5, 97.5]), rtol=1e-8)
    assert abs(got.simex - 0.8) < abs(got.naive - 0.8) and got.low < got.simex < got.high and got.p_boot < 0.2
    none = resampling.simex_table(df, [], "g", "i", "y", "w", "v", "s", seed=1, draws=2, outer=0).first()
    assert math.isclose(none.simex, few.simex, rel_tol=1e-9) and none.low is None


def test_power_rises_with_items(spark):
    got = power.grid_points(power.replicates(spark, ["1a", "1d"], [4, 24], [4], 24, 5, effect=1.2)).collect()
    by = {(r.contrast, r.item_count): r.power for r in got}
    assert by["1a", 24] > by["1a", 4] and by["1d", 24] >= by["1d", 4] and all(r.n_sims == 24 for r in got)


def test_planted_layer_has_the_longest_difference(spark):
    rng = np.random.default_rng(1)
    rows = [(layer, i % 2 == 0, i // 2, (rng.normal(size=8) + (3.0 if layer == 2 and i % 2 == 0 else 0)).tolist()) for layer in range(4) for i in range(40)]
    df = spark.createDataFrame(rows, "layer int, side boolean, pair int, vec array<double>")
    for stratum in ([], ["pair"]):
        n = {r.layer: r.delta_norm for r in vectors.norms(vectors.mean_difference(df, ["layer"], F.col("side"), stratum), ["layer"]).collect()}
        assert max(n, key=n.get) == 2
    x = df.withColumns({"y": F.col("side").cast("int"), "g": F.col("pair"), "part": F.when(F.col("pair") % 4 == 0, "test").otherwise("train")})
    scores = {r.layer: r.cv_score for r in vectors.probe_table(x, ["layer"], "y", "g", "part", "logistic", boots=20).collect()}
    assert scores[2] > 0.95 > scores[0]
    got = vectors.alignment_table(df, ["layer"], "side", [1.0] * 8, 100).collect()
    assert {r.layer: r.p_permuted for r in got}[2] < 0.05


def test_vector_helpers():
    assert vectors.principal_angles(np.eye(4)[:, :2], np.eye(4)[:, :2]).max() < 1e-7
    f = vectors.folds(["a"] * 5 + ["b"] * 3 + ["c"] * 2 + ["d"], 2)
    assert len({f[i] for i in range(5)}) == 1 and sorted(np.bincount(f).tolist()) == [5, 6]


def test_declared_contrasts_recover_planted_effects(spark):
    rng = np.random.default_rng(0)
    rows = []
    for v, (t, s) in {"MB": ("moral", "bad"), "MG": ("moral", "good"), "NMB": ("nonmoral", "bad"), "NMG": ("nonmoral", "good"), "NEU": ("neutral", "na")}.items():
        for f in range(8):
            u = rng.normal(0, 0.5)
            for typ in ("common", "uncommon"):
                for evoc in ("low", "high"):
                    for tune in ("finetuned", "pretrained"):
                        for q in ("intentionality", "blame", "praise"):
                            for _ in range(3):
                                e = 0.0
                                if tune == "finetuned":
                                    e += {"MB": 1.5, "MG": -1.5, "NMB": 0.5, "NMG": -0.5, "NEU": 1.5}[v]
                                    e += 2.0 * (s == "good" and typ == "uncommon") + 2.0 * (s == "bad" and evoc == "high")
                                rows.append((f"X-{v}-{f:02d}", f"X-{v}-{f:02d}-{typ[0]}{evoc[0]}", v, t, s, typ, evoc, tune, q, "raw", "m", float(np.clip(np.rint(5 + u + e + rng.normal(0, 0.8)), 0, 10))))
    df = spark.createDataFrame(rows, "family_id string, variant_id string, valence string, valence_type string, sign string, typicality string, evocativeness string, tuning_status string, question_type string, format string, model_family string, rating double")
    got = {r.contrast: r for r in analysis.contrast_table(df).collect()}
    assert len(got) == 9
    for name in ("rq1_base_sign_finetuned", "rq1_base_sign_x_tuning", "rq1a_sign_x_valence_type", "rq1c_typicality_x_sign", "rq1c_evocativeness_x_sign", "rq1d_neu_offset"):
        assert got[name].p_holm < 0.05 and got[name].confirmed, name
    assert all(r.p_holm >= r.p_value for r in got.values())
    with pytest.raises(ValueError, match="undeclared"):
        analysis.contrast_table(df, ["nope"])
