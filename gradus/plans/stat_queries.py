"""Statistical queries over the driver's tables, each with SQL that resamples, maximises or solves by the same rule."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import gram, profile, resampling, vectors
from .catalog import query, r6, table

# ----- resampling


def _phi(x: str) -> str:
    """The normal distribution function in SQL: its series about zero."""
    return f"(0.5 + exp(-({x}) * ({x}) / 2) / sqrt(2 * pi()) * list_sum(list_transform(range(90), lambda n: pow({x}, 2 * n + 1) * sqrt(pi()) / (pow(2.0, n + 1) * gamma(n + 1.5)))))"


def _signs(source: str, seed: int, replicates: int) -> str:
    """Rows of source, which has the cluster g, for each replicate with its sign w."""
    return f"(SELECT s.*, r, 1 - 2 * ((CAST('0x' || substr(sha256('{seed}|' || (r // 32) || '|' || g), 1, 8) AS BIGINT) >> (r % 32)) & 1) AS w FROM {source} s, range({replicates}) x(r))"


def _wild(clusters: str, seed: str, replicates: int) -> str:
    """CTEs up to z (f, drawn, seen), x and b: a slope's wild bootstrap in each f of clusters (f, g, n, sx, sxx, sy, sxy); seed is an expression of f."""
    signs = _signs("r", 0, replicates).replace("'0|' ||", f"CAST({seed} AS VARCHAR) || '|' ||")
    return f"""
c AS ({clusters}),
t AS (SELECT f, sum(n) AS n, count(*) AS k, sum(sx) AS sx, sum(sxx) AS sxx, sum(sy) AS sy, sum(sxy) AS sxy, sum(n) * sum(sxx) - sum(sx) * sum(sx) AS det FROM c GROUP BY 1),
b AS (SELECT *, (n * sxy - sx * sy) / det AS b1, (sxx * sy - sx * sxy) / det AS b0, sy / n AS m, k / (k - 1) * (n - 1) / (n - 2) AS factor FROM t),
r AS (
  SELECT c.f, g, c.sy - c.n * m AS e0, c.sxy - c.sx * m AS e1, (b.n * (c.sxy - c.sx * m) - b.sx * (c.sy - c.n * m)) / det AS p,
    (b.n * c.sx - b.sx * c.n) / det AS q0, (b.n * c.sxx - b.sx * c.sx) / det AS q1, (b.n * (c.sxy - c.sx * b0 - c.sxx * b1) - b.sx * (c.sy - c.n * b0 - c.sx * b1)) / det AS s
  FROM c JOIN b USING (f)),
x AS (SELECT f, sum(p * p) AS pp, sum(s * s) AS ss, sum(q0 * q0) AS q00, sum(q0 * q1) AS q01, sum(q1 * q1) AS q11 FROM r GROUP BY 1),
w AS (SELECT f, r, sum(w * e0) AS u0, sum(w * e1) AS u1, sum(w * p * q0) AS v0, sum(w * p * q1) AS v1 FROM {signs} GROUP BY 1, 2),
d AS (SELECT w.*, (sxx * u0 - sx * u1) / det AS d0, (n * u1 - sx * u0) / det AS d1 FROM w JOIN b USING (f)),
z AS (SELECT f, d1 / sqrt(factor * (pp - 2 * (d0 * v0 + d1 * v1) + d0 * d0 * q00 + 2 * d0 * d1 * q01 + d1 * d1 * q11)) AS drawn, b1 / sqrt(factor * ss) AS seen FROM d JOIN x USING (f) JOIN b USING (f))"""


_SLOPES = "SELECT l_returnflag AS f, CAST(l_suppkey AS VARCHAR) AS g, count(*) AS n, sum(l_discount) AS sx, sum(l_discount * l_discount) AS sxx, sum(l_quantity) AS sy, sum(l_discount * l_quantity) AS sxy FROM lineitem GROUP BY 1, 2"


@query(
    f"""WITH {_wild(_SLOPES, "3", 499)}
SELECT f AS l_returnflag, round(any_value(b1), 6) AS beta, round(any_value(sqrt(factor * ss)), 6) AS se, round(any_value(seen), 6) AS statistic,
  round(any_value(p), 6) AS p_wild, round(any_value(2 * (1 - {_phi("abs(seen)")})), 6) AS p_classical, any_value(k) AS n_clusters
FROM (SELECT f, seen, avg(CASE WHEN abs(drawn) >= abs(seen) * (1 - 1e-9) THEN 1.0 ELSE 0.0 END) AS p FROM z GROUP BY 1, 2) JOIN x USING (f) JOIN b USING (f) GROUP BY 1"""
)
def wild_bootstrap(spark: SparkSession, d: str) -> DataFrame:
    """T-05: a slope in each return flag's lines, suppliers as clusters."""
    return r6(resampling.wild_table(table(spark, d, "lineitem"), "l_quantity ~ l_discount", ["l_discount"], ["l_returnflag"], "l_suppkey", 3, 499))


_CENTRED = """
a AS (SELECT l_returnflag AS f, CAST(l_suppkey AS VARCHAR) AS g, l_discount - avg(l_discount) OVER (PARTITION BY l_returnflag) AS x, l_tax - avg(l_tax) OVER (PARTITION BY l_returnflag) AS z, l_quantity - avg(l_quantity) OVER (PARTITION BY l_returnflag) AS y FROM lineitem),
c AS (SELECT f, g, count(*) AS n, sum(x) AS sx, sum(z) AS sz, sum(x * x) AS xx, sum(x * z) AS xz, sum(z * z) AS zz, sum(y) AS e0, sum(x * y) AS e1, sum(z * y) AS e2 FROM a GROUP BY 1, 2),
t AS (SELECT f, sum(n) AS n, count(*) AS k, sum(zz) / (sum(xx) * sum(zz) - sum(xz) * sum(xz)) AS i11, -sum(xz) / (sum(xx) * sum(zz) - sum(xz) * sum(xz)) AS i12, sum(xx) / (sum(xx) * sum(zz) - sum(xz) * sum(xz)) AS i22, sum(e1) AS b1, sum(e2) AS b2 FROM c GROUP BY 1)"""


@query(
    f"""WITH {_CENTRED},
b AS (SELECT *, i11 * b1 + i12 * b2 AS beta1, i12 * b1 + i22 * b2 AS beta2, k / (k - 1) * (n - 1) / (n - 3) AS factor FROM t),
r AS (
  SELECT c.f, g, e0, e1, e2, i11 * e1 + i12 * e2 AS p1, i12 * e1 + i22 * e2 AS p2,
    sx * i11 + sz * i12 AS q10, xx * i11 + xz * i12 AS q11, xz * i11 + zz * i12 AS q12, sx * i12 + sz * i22 AS q20, xx * i12 + xz * i22 AS q21, xz * i12 + zz * i22 AS q22,
    i11 * (e1 - xx * beta1 - xz * beta2) + i12 * (e2 - xz * beta1 - zz * beta2) AS s1, i12 * (e1 - xx * beta1 - xz * beta2) + i22 * (e2 - xz * beta1 - zz * beta2) AS s2
  FROM c JOIN b USING (f)),
o AS (SELECT f, factor * sum(s1 * s1) AS o11, factor * sum(s1 * s2) AS o12, factor * sum(s2 * s2) AS o22, beta1, beta2, k FROM r JOIN b USING (f) GROUP BY f, factor, beta1, beta2, k),
seen AS (SELECT f, k, beta1, sqrt(o11) AS se, (beta1 * beta1 * o22 - 2 * beta1 * beta2 * o12 + beta2 * beta2 * o11) / (o11 * o22 - o12 * o12) / 2 AS seen FROM o),
w AS (SELECT f, r, sum(w * e0) AS u0, sum(w * e1) AS u1, sum(w * e2) AS u2 FROM {_signs("r", 3, 199)} GROUP BY 1, 2),
d AS (SELECT f, r, u0 / n AS d0, i11 * u1 + i12 * u2 AS d1, i12 * u1 + i22 * u2 AS d2, factor FROM w JOIN b USING (f)),
v AS (
  SELECT s.f, s.r, factor * sum(z1 * z1) AS v11, factor * sum(z1 * z2) AS v12, factor * sum(z2 * z2) AS v22, d1, d2
  FROM (SELECT s.f, s.r, w * p1 - q10 * d0 - q11 * d1 - q12 * d2 AS z1, w * p2 - q20 * d0 - q21 * d1 - q22 * d2 AS z2, d1, d2, factor FROM {_signs("r", 3, 199)} s JOIN d ON s.f = d.f AND s.r = d.r) s GROUP BY s.f, s.r, d1, d2, factor),
z AS (SELECT f, (d1 * d1 * v22 - 2 * d1 * d2 * v12 + d2 * d2 * v11) / (v11 * v22 - v12 * v12) / 2 AS drawn FROM v)
SELECT f AS l_returnflag, round(any_value(beta1), 6) AS beta, round(any_value(se), 6) AS se, round(any_value(seen), 6) AS statistic, round(avg(CASE WHEN drawn >= seen * (1 - 1e-9) THEN 1.0 ELSE 0.0 END), 6) AS p_wild, any_value(k) AS n_clusters
FROM z JOIN seen USING (f) GROUP BY 1"""
)
def joint_wild(spark: SparkSession, d: str) -> DataFrame:
    """T-06: two slopes at once, by a Wald F."""
    return r6(resampling.wild_table(table(spark, d, "lineitem"), "l_quantity ~ l_discount + l_tax", ["l_discount", "l_tax"], ["l_returnflag"], "l_suppkey", 3, 199).drop("p_classical"))


def _intervals(clusters: str, estimate: str, left_out: str, columns: list[str], seed: int, replicates: int) -> str:
    """SQL of percentile and BCa intervals; clusters has f, g and columns, estimate and left_out are expressions of their sums."""
    sums = ", ".join(f"sum({c}) AS {c}" for c in columns)
    picked = ", ".join(f"sum(m * {c}) AS {c}" for c in columns)
    return f"""WITH RECURSIVE c AS ({clusters}),
i AS (SELECT *, row_number() OVER (PARTITION BY f ORDER BY g) - 1 AS i, count(*) OVER (PARTITION BY f) AS size FROM c),
m AS (SELECT f, r, i, count(*) AS m FROM (SELECT f, r, CAST('0x' || substr(sha256('{seed}|' || (r // 4) || '|' || i), 15 * (r % 4) + 1, 15) AS BIGINT) % size AS i FROM i, range({replicates}) x(r)) GROUP BY 1, 2, 3),
e AS (SELECT f, r, {estimate} AS e FROM (SELECT f, r, {picked} FROM m JOIN i USING (f, i) GROUP BY 1, 2)),
t AS (SELECT f, {sums} FROM c GROUP BY 1),
p AS (SELECT f, {estimate} AS point FROM t),
j AS (SELECT f, sum(pow(m - x, 3)) / (6 * pow(sum(pow(m - x, 2)), 1.5)) AS acceleration FROM (SELECT f, x, avg(x) OVER (PARTITION BY f) AS m FROM (SELECT c.f, {left_out} AS x FROM c JOIN t USING (f))) GROUP BY 1),
s AS (SELECT f, avg(CASE WHEN e < point THEN 1.0 ELSE 0.0 END) AS share_below, count(*) AS n_used, quantile_cont(e, 0.025) AS ci_low, quantile_cont(e, 0.975) AS ci_high FROM e JOIN p USING (f) GROUP BY 1),
z AS (
  SELECT f, share_below AS p, CAST(-6 AS DOUBLE) AS a, CAST(6 AS DOUBLE) AS b, 0 AS step FROM s
  UNION ALL
  SELECT f, p, CASE WHEN {_phi("(a + b) / 2")} < p THEN (a + b) / 2 ELSE a END, CASE WHEN {_phi("(a + b) / 2")} < p THEN b ELSE (a + b) / 2 END, step + 1 FROM z WHERE step < 50),
l AS (SELECT f, side, {_phi("z0 + (z0 + q) / (1 - acceleration * (z0 + q))")} * (n_used - 1) AS place FROM (SELECT f, (a + b) / 2 AS z0 FROM z WHERE step = 50) JOIN j USING (f) JOIN s USING (f), (VALUES ('low', -1.959963984540054), ('high', 1.959963984540054)) v(side, q)),
q AS (SELECT f, side, sum(e * greatest(1 - abs(k - place), 0)) AS v FROM (SELECT f, e, row_number() OVER (PARTITION BY f ORDER BY e) - 1 AS k FROM e) JOIN l USING (f) GROUP BY 1, 2)
SELECT f AS l_returnflag, round(ci_low, 6) AS ci_low, round(ci_high, 6) AS ci_high, round(a.v, 6) AS bca_low, round(b.v, 6) AS bca_high, round(share_below, 6) AS share_below, round(acceleration, 6) AS acceleration, n_used
FROM s JOIN j USING (f) JOIN q a ON a.f = s.f AND a.side = 'low' JOIN q b ON b.f = s.f AND b.side = 'high'"""


@query(
    _intervals(
        "SELECT l_returnflag AS f, CAST(l_suppkey AS VARCHAR) AS g, count(*) AS n, sum(l_discount) AS x, sum(l_discount * l_discount) AS xx, sum(l_quantity) AS y, sum(l_discount * l_quantity) AS xy FROM lineitem GROUP BY 1, 2",
        "(n * xy - x * y) / (n * xx - x * x)",
        "((t.n - c.n) * (t.xy - c.xy) - (t.x - c.x) * (t.y - c.y)) / ((t.n - c.n) * (t.xx - c.xx) - (t.x - c.x) * (t.x - c.x))",
        ["n", "x", "xx", "y", "xy"],
        7,
        199,
    )
)
def cluster_bootstrap(spark: SparkSession, d: str) -> DataFrame:
    """T-03, T-07."""
    return r6(resampling.bootstrap_table(table(spark, d, "lineitem"), "l_quantity ~ l_discount", "l_discount", ["l_returnflag"], "l_suppkey", 7, 199))


@query(
    _intervals(
        "SELECT f, g, sum(x * x) AS xx, sum(x * y) AS xy FROM (SELECT l_returnflag AS f, CAST(l_suppkey AS VARCHAR) AS g, l_discount - avg(l_discount) OVER (PARTITION BY l_returnflag, l_suppkey) AS x, l_quantity - avg(l_quantity) OVER (PARTITION BY l_returnflag, l_suppkey) AS y FROM lineitem) GROUP BY 1, 2",
        "xy / xx",
        "(t.xy - c.xy) / (t.xx - c.xx)",
        ["xx", "xy"],
        11,
        199,
    )
)
def within_bootstrap(spark: SparkSession, d: str) -> DataFrame:
    """T-04: the same with suppliers' own intercepts, whose deviations from means are resampled."""
    return r6(resampling.bootstrap_table(table(spark, d, "lineitem"), "l_quantity ~ l_discount + C(l_suppkey)", "l_discount", ["l_returnflag"], "l_suppkey", 11, 199))


# ----- profile likelihood


_SUMS_AT = "sum(n) AS n, count(*) AS k, sum(n - s * n * n) AS a00, sum(sx - s * n * sx) AS a01, sum(sxx - s * sx * sx) AS a11, sum(sy - s * n * sy) AS b0, sum(sxy - s * sx * sy) AS b1, sum(yy - s * sy * sy) AS c, sum(ln(1 + n * rho)) AS logs"


def _searched(clusters: str, solved: dict[str, tuple[str, str]], reml: bool = False, before: str = "", sums_at: str = _SUMS_AT, solve: Callable[[str], str] = str) -> str:
    """CTEs, after those of ``before``, of the fits of models by name: each has its residual sum and determinant in terms of a00 ... c; fit_<name> has one row for each f.

    ``solve`` may add steps to the query that gives ``sums_at``, the sums at a ratio.
    """
    out = [f"c AS ({clusters})", "g0 AS (SELECT f, i, CASE WHEN i = 0 THEN 0 ELSE exp(-12 + 0.25 * (i - 1)) END AS rho FROM (SELECT DISTINCT f FROM c), range(82) x(i))"]
    sums = f"f, i, rho, {sums_at}"
    for name, (rss, det) in solved.items():
        m = "(n - 1)" if reml else "n"
        at = lambda r: f"SELECT *, {rss} AS rss, -0.5 * ({m} * ln(2 * pi() * ({rss}) / {m}) + {m} + logs){f' - 0.5 * ln({det})' if reml else ''} AS log FROM ({solve(f'SELECT {sums} FROM (SELECT c.*, i, rho, rho / (1 + n * rho) AS s FROM c JOIN {r} USING (f)) GROUP BY f, i, rho')})"  # noqa: B023, E731
        grid = "g0"
        for step in range(3):
            out.append(f"l{step}_{name} AS ({at(grid)})")
            out.append(
                f"""n{step}_{name} AS (
  SELECT f, lo, hi, i = last AS ends, CASE WHEN i > 0 AND i < last AND p - 2 * log + q < 0 THEN rho + (hi - lo) / 4 * (p - q) / (p - 2 * log + q) ELSE rho END AS rho
  FROM (SELECT *, lag(log) OVER w AS p, lead(log) OVER w AS q, coalesce(lag(rho) OVER w, rho) AS lo, coalesce(lead(rho) OVER w, rho) AS hi, max(i) OVER (PARTITION BY f) AS last, row_number() OVER (PARTITION BY f ORDER BY log DESC, i) AS rn FROM l{step}_{name} WINDOW w AS (PARTITION BY f ORDER BY i)) WHERE rn = 1)"""
            )
            if step < 2:
                out.append(f"g{step + 1}_{name} AS (SELECT f, i, lo + (hi - lo) * i / 80 AS rho FROM n{step}_{name}, range(81) x(i))")
                grid = f"g{step + 1}_{name}"
        out.append(f"fit_{name} AS (SELECT l.*, NOT e.ends AS converged FROM ({at(f'(SELECT f, 0 AS i, rho FROM n2_{name})')}) l JOIN n0_{name} e USING (f))")
    return "WITH " + before + ",\n".join(out)


_LINES = "SELECT l_returnflag AS f, CAST(l_suppkey AS VARCHAR) AS g, CAST(count(*) AS DOUBLE) AS n, sum(l_discount) AS sx, sum(l_discount * l_discount) AS sxx, sum(l_quantity) AS sy, sum(l_discount * l_quantity) AS sxy, sum(l_quantity * l_quantity) AS yy FROM lineitem GROUP BY 1, 2"
_TWO = ("c - (a11 * b0 * b0 - 2 * a01 * b0 * b1 + a00 * b1 * b1) / (a00 * a11 - a01 * a01)", "(a00 * a11 - a01 * a01)")
_ONE = ("c - b0 * b0 / a00", "a00")


@query(
    f"""{_searched(_LINES, {"two": _TWO})},
e AS (SELECT *, (a00 * b1 - a01 * b0) / (a00 * a11 - a01 * a01) AS estimate, sqrt(rss / n * a00 / (a00 * a11 - a01 * a01)) AS se FROM fit_two)
SELECT f AS l_returnflag, round(estimate, 6) AS estimate, round(se, 6) AS se, round(2 * (1 - {_phi("abs(estimate / se)")}), 6) AS p_value, CAST(n AS BIGINT) AS n_obs, k AS n_groups, converged, false AS fallback_used, 'lmm-l_suppkeyRI' AS method FROM e"""
)
def mixed_model(spark: SparkSession, d: str) -> DataFrame:
    """T-01: random intercepts of suppliers for each return flag."""
    return r6(profile.lmm_table(table(spark, d, "lineitem"), "l_quantity ~ l_discount", "l_discount", ["l_returnflag"], "l_suppkey"))


@query(
    f"""{_searched(_LINES, {"full": _TWO, "less": _ONE})}
SELECT f AS l_returnflag, round(x, 6) AS chi2, 1 AS df, round(2 * (1 - {_phi("sqrt(x)")}), 6) AS p_value FROM (SELECT f, greatest(0, 2 * (a.log - b.log)) AS x FROM fit_full a JOIN fit_less b USING (f))"""
)
def likelihood_ratio(spark: SparkSession, d: str) -> DataFrame:
    """T-15: a slope against an intercept alone, both with suppliers' random intercepts."""
    return r6(profile.lrt_table(table(spark, d, "lineitem"), "l_quantity ~ l_discount", "l_quantity ~ 1", ["l_returnflag"], "l_suppkey"))


@query(
    f"""{_searched(_LINES, {"one": _ONE}, reml=True)}
SELECT f AS l_returnflag, round(rho * rss / (n - 1), 3) AS var_group, round(rss / (n - 1), 6) AS var_resid, round(rho / (1 + rho), 4) AS icc, round(1 + (n / k - 1) * rho / (1 + rho), 3) AS design_effect, k AS n_groups, CAST(n AS BIGINT) AS n_obs, converged FROM fit_one"""
)
def reml_components(spark: SparkSession, d: str) -> DataFrame:
    """T-13, T-14: a likelihood is flat at its top, so the order of sums shows in the sixth place of a ratio of variances, if not in the fits there."""
    out = profile.reml_table(table(spark, d, "lineitem"), ["l_returnflag"], "l_suppkey", "l_quantity")
    return r6(out.withColumns({c: F.round(c, n) for c, n in (("var_group", 3), ("icc", 4), ("design_effect", 3))}))


def _suppression(spark: SparkSession, d: str) -> DataFrame:
    """Gaps of kinds of events in halves of a user's events, by that of clicks in the same half."""
    e = table(spark, d, "events").withColumn("component", F.when(F.pmod("event_id", F.lit(2)) == 0, "even").otherwise("odd"))
    gaps = e.groupBy("user_id", "event_type", "component").agg(F.avg("value").alias("gap"))
    return vectors.normalised_gaps(gaps, ["user_id"], "event_type", "click")


@query(
    "WITH g AS (SELECT user_id, event_type, CASE WHEN event_id % 2 = 0 THEN 'even' ELSE 'odd' END AS component, avg(value) AS gap FROM events GROUP BY 1, 2, 3), b AS (SELECT *, max(CASE WHEN event_type = 'click' THEN gap END) OVER (PARTITION BY user_id, component) AS base FROM g) "
    "SELECT CAST(user_id AS VARCHAR) AS cluster, event_type AS a, component AS b, count(*) AS n, round(sum(gap / base), 6) AS sy, round(sum((gap / base) * (gap / base)), 6) AS syy FROM b WHERE abs(base) >= 0.25 GROUP BY 1, 2, 3"
)
def suppression_sums(spark: SparkSession, d: str) -> DataFrame:
    """T-33: what the interaction's test knows of each cluster: rows and sums by pair of levels."""
    return r6(profile.factorial_sums(_suppression(spark, d), "normalised", "event_type", "component", "user_id"))


@query()
def suppression_lrt(spark: SparkSession, d: str) -> DataFrame:
    """T-33: whether kinds of events differ by the same proportion in both halves."""
    return r6(profile.interaction_test(_suppression(spark, d), "normalised", "event_type", "component", "user_id"))


# ----- probes

_HALVES = "(SELECT vec_id, label, list_avg(list_filter(e, lambda x, i: i % 2 = 1)) AS x1, list_avg(list_filter(e, lambda x, i: i % 2 = 0)) AS x2, e[1] AS first, list_max(e) AS peak, list_min(e) AS low FROM (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings))"


def _probed(spark: SparkSession, d: str) -> DataFrame:
    """Vectors of two features (means of odd and even places), targets from the whole vector, layers by id, labels as groups."""
    e = table(spark, d, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("e"))
    half = lambda k: F.aggregate(F.filter("e", lambda x, i: i % 2 == k), F.lit(0.0), lambda a, b: a + b) / F.size(F.filter("e", lambda x, i: i % 2 == k))
    return e.select("vec_id", "label", F.pmod("vec_id", F.lit(4)).alias("layer"), F.array(half(0), half(1)).alias("vec"), F.col("e")[0].alias("first"), F.array_max("e").alias("peak"), F.array_min("e").alias("low"), F.when(F.pmod("label", F.lit(3)) == 0, 1).otherwise(0).alias("part"))


def _products(source: str, by: str, y: str) -> str:
    return f"SELECT {by}, count(*) AS n, sum(x1) AS s1, sum(x2) AS s2, sum(x1 * x1) AS s11, sum(x1 * x2) AS s12, sum(x2 * x2) AS s22, sum({y}) AS sy, sum({y} * {y}) AS syy, sum(x1 * {y}) AS s1y, sum(x2 * {y}) AS s2y FROM {source} GROUP BY ALL"


def _line(source: str, keep: str) -> str:
    """b, v1 and v2 of a ridge with penalty 1 on standardised features, from rows of products."""
    return f"""SELECT {keep}, v1, v2, sy / n - v1 * s1 / n - v2 * s2 / n AS b FROM (
  SELECT *, (t1 * (n + 1) - r * n * t2) / ((n + 1) * (n + 1) - r * r * n * n) / d1 AS v1, (t2 * (n + 1) - r * n * t1) / ((n + 1) * (n + 1) - r * r * n * n) / d2 AS v2 FROM (
    SELECT *, (s12 / n - s1 / n * s2 / n) / d1 / d2 AS r, (s1y - s1 * sy / n) / d1 AS t1, (s2y - s2 * sy / n) / d2 AS t2 FROM (
      SELECT *, sqrt(s11 / n - s1 / n * s1 / n) AS d1, sqrt(s22 / n - s2 / n * s2 / n) AS d2 FROM {source})))"""


_SSE = "syy - 2 * b * sy - 2 * v1 * s1y - 2 * v2 * s2y + n * b * b + 2 * b * (v1 * s1 + v2 * s2) + v1 * v1 * s11 + 2 * v1 * v2 * s12 + v2 * v2 * s22"


@query(
    f"""WITH e AS (SELECT *, vec_id % 4 AS layer, CASE WHEN label % 3 = 0 THEN 1 ELSE 0 END AS part FROM {_HALVES}),
c AS (SELECT *, CASE WHEN vec_id % 10 <> 7 THEN peak END AS k FROM e), m AS (SELECT layer, avg(k) FILTER (part = 0) AS mk FROM c GROUP BY 1),
f AS (SELECT c.*, coalesce(k, mk) AS q FROM c JOIN m USING (layer)), g AS (SELECT layer, regr_slope(first, q) AS slope, regr_intercept(first, q) AS cut FROM f WHERE part = 0 GROUP BY 1),
r AS (SELECT f.*, first - cut - slope * q AS res FROM f JOIN g USING (layer)),
s AS ({_products("e", "'raw' AS target, layer, part", "first")} UNION ALL {_products("r", "'residual' AS target, layer, part", "res")}),
l AS ({_line("(SELECT * FROM s WHERE part = 0)", "target, layer, n AS n_train")})
SELECT target, layer, round(b, 6) AS intercept, round(v1, 6) AS weight_1, round(v2, 6) AS weight_2, round(1 - ({_SSE}) / (syy - sy * sy / n), 6) AS score, n_train, n AS n_test FROM s JOIN l USING (target, layer) WHERE part = 1"""
)
def probes(spark: SparkSession, d: str) -> DataFrame:
    """T-27, T-28, T-30: ridge probes of a target and of its residual on another, by layer; a tenth of the controls is missing."""
    e = _probed(spark, d).withColumn("control", F.when(F.pmod("vec_id", F.lit(10)) != 7, F.col("peak")))
    r = gram.residualised(e, ["layer"], "first", ["control"], F.col("part") == 0)
    both = r.select("layer", "part", "vec", F.explode(F.create_map(F.lit("raw"), F.col("first"), F.lit("residual"), F.col("residual"))).alias("target", "y"))
    f = gram.fits(gram.block_sums(both, ["target", "layer"], "part", "y"), ["target", "layer"])
    return r6(f.select("target", "layer", "intercept", F.col("weights")[0].alias("weight_1"), F.col("weights")[1].alias("weight_2"), "score", "n_train", "n_test"))


@query(
    f"""WITH RECURSIVE e AS (SELECT *, vec_id % 4 AS layer FROM {_HALVES}),
z AS (SELECT layer, label, n, row_number() OVER (PARTITION BY layer ORDER BY n DESC, CAST(label AS VARCHAR)) AS k FROM (SELECT layer, label, count(*) AS n FROM e GROUP BY 1, 2)),
w AS (
  SELECT DISTINCT layer, CAST(0 AS BIGINT) AS k, CAST([0, 0, 0, 0, 0] AS BIGINT[]) AS loads, CAST(NULL AS BIGINT) AS label, CAST(NULL AS BIGINT) AS fold FROM z
  UNION ALL
  SELECT w.layer, z.k, list_transform(loads, lambda x, i: x + CASE WHEN i = list_position(loads, list_min(loads)) THEN n ELSE 0 END), z.label, CAST(list_position(loads, list_min(loads)) - 1 AS BIGINT) FROM w JOIN z ON z.layer = w.layer AND z.k = w.k + 1),
s AS ({_products("(SELECT e.*, fold FROM e JOIN w ON w.layer = e.layer AND w.label = e.label)", "layer, fold", "first")}),
t AS (SELECT layer, sum(n) AS n, sum(s1) AS s1, sum(s2) AS s2, sum(s11) AS s11, sum(s12) AS s12, sum(s22) AS s22, sum(sy) AS sy, sum(syy) AS syy, sum(s1y) AS s1y, sum(s2y) AS s2y FROM s GROUP BY 1),
o AS (SELECT layer, fold, t.n - s.n AS n, t.s1 - s.s1 AS s1, t.s2 - s.s2 AS s2, t.s11 - s.s11 AS s11, t.s12 - s.s12 AS s12, t.s22 - s.s22 AS s22, t.sy - s.sy AS sy, t.s1y - s.s1y AS s1y, t.s2y - s.s2y AS s2y FROM s JOIN t USING (layer)),
l AS ({_line("o", "layer, fold")}),
x AS (SELECT layer, fold, {_SSE} AS sse FROM s JOIN l USING (layer, fold))
SELECT layer, round(1 - any_value(sse) / any_value(syy - sy * sy / n), 6) AS cv_score, CAST(any_value(n) AS BIGINT) AS n FROM (SELECT layer, sum(sse) AS sse FROM x GROUP BY 1) JOIN t USING (layer) GROUP BY 1"""
)
def probe_folds(spark: SparkSession, d: str) -> DataFrame:
    """T-29: five folds of whole labels, each scored by a probe of the other four."""
    e = _probed(spark, d)
    folds = gram.group_folds(e, ["layer"], "label", 5)
    rows = e.withColumn("label", F.col("label").cast("string")).join(folds, ["layer", "label"])
    return r6(gram.cross_validated(gram.left_out(gram.block_sums(rows, ["layer"], "fold", "first"), ["layer"]), ["layer"]))


@query(
    f"""WITH e AS (SELECT *, vec_id % 4 AS layer FROM {_HALVES}), s AS ({_products("e", "layer, label % 5 AS domain", "first")}),
t AS (SELECT layer, sum(n) AS n, sum(s1) AS s1, sum(s2) AS s2, sum(s11) AS s11, sum(s12) AS s12, sum(s22) AS s22, sum(sy) AS sy, sum(s1y) AS s1y, sum(s2y) AS s2y FROM s GROUP BY 1),
o AS (SELECT layer, domain, t.n - s.n AS n, t.s1 - s.s1 AS s1, t.s2 - s.s2 AS s2, t.s11 - s.s11 AS s11, t.s12 - s.s12 AS s12, t.s22 - s.s22 AS s22, t.sy - s.sy AS sy, t.s1y - s.s1y AS s1y, t.s2y - s.s2y AS s2y FROM s JOIN t USING (layer)),
l AS ({_line("o", "layer, domain")})
SELECT layer, domain, round(1 - ({_SSE}) / (syy - sy * sy / n), 6) AS score, n FROM s JOIN l USING (layer, domain)"""
)
def probe_domains(spark: SparkSession, d: str) -> DataFrame:
    """T-29: each domain scored by a probe of all others."""
    e = _probed(spark, d).withColumn("domain", F.pmod("label", F.lit(5)))
    return r6(gram.left_out(gram.block_sums(e, ["layer"], "domain", "first"), ["layer"]).select("layer", F.col("block").alias("domain"), "score", "n"))


@query(
    f"""WITH e AS (SELECT *, vec_id % 4 AS layer, CASE WHEN label % 3 = 0 THEN 1 ELSE 0 END AS part FROM {_HALVES}),
u AS (SELECT 'first' AS target, layer, part, label, x1, x2, first AS y FROM e UNION ALL SELECT 'low', layer, part, label, x1, x2, low FROM e UNION ALL SELECT 'peak', layer, part, label, x1, x2, peak FROM e),
s AS ({_products("u", "target, layer, part", "y")}), l AS ({_line("(SELECT * FROM s WHERE part = 0)", "target, layer")}),
g AS (SELECT target, layer, CAST(label AS VARCHAR) AS g, count(*) AS n, sum(y) AS sy, sum(y * y) AS syy, sum(pow(y - b - v1 * x1 - v2 * x2, 2)) AS sse FROM u JOIN l USING (target, layer) WHERE part = 1 GROUP BY ALL),
i AS (SELECT g, row_number() OVER (ORDER BY g) - 1 AS i, count(*) OVER () AS size FROM (SELECT DISTINCT g FROM g)),
m AS (SELECT r, i, count(*) AS m FROM (SELECT r, CAST('0x' || substr(sha256('31|' || (r // 4) || '|' || i), 15 * (r % 4) + 1, 15) AS BIGINT) % size AS i FROM i, range(200) x(r)) GROUP BY 1, 2),
d AS (SELECT target, layer, r, 1 - sum(m * sse) / (sum(m * syy) - sum(m * sy) * sum(m * sy) / sum(m * n)) AS score FROM g JOIN i USING (g) JOIN m USING (i) GROUP BY ALL),
p AS (SELECT target, r, layer AS peak FROM d QUALIFY row_number() OVER (PARTITION BY target, r ORDER BY score DESC, layer) = 1),
o AS (SELECT target, layer AS peak FROM (SELECT target, layer, 1 - sum(sse) / (sum(syy) - sum(sy) * sum(sy) / sum(n)) AS score FROM g GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY target ORDER BY score DESC, layer) = 1)
SELECT a.target AS target_a, b.target AS target_b, any_value(oa.peak) AS peak_a, any_value(ob.peak) AS peak_b, any_value(oa.peak - ob.peak) AS diff, round(quantile_cont(a.peak - b.peak, 0.025), 6) AS diff_low, round(quantile_cont(a.peak - b.peak, 0.975), 6) AS diff_high, round(avg(CASE WHEN a.peak <> b.peak THEN 1.0 ELSE 0.0 END), 6) AS share_apart, count(*) AS n_draws
FROM p a JOIN p b ON a.r = b.r AND a.target < b.target JOIN o oa ON oa.target = a.target JOIN o ob ON ob.target = b.target GROUP BY 1, 2"""
)
def peak_layers(spark: SparkSession, d: str) -> DataFrame:
    """T-31: where three targets are best told, and how far apart over draws of test labels that they share."""
    e = _probed(spark, d)
    u = e.select("layer", "part", "label", "vec", F.explode(F.create_map(*[x for c in ("first", "low", "peak") for x in (F.lit(c), F.col(c))])).alias("target", "y"))
    keys = ["target", "layer"]
    f = gram.fits(gram.block_sums(u, keys, "part", "y"), keys)
    groups = gram.group_errors(u.filter("part = 1"), f, keys, "y", "label")
    return r6(gram.peak_differences(f.select(*keys, "score"), gram.drawn_scores(groups, keys, 31, 200), "target", "layer"))


@query(
    """WITH e AS (SELECT label % 2 AS layer, vec_id % 3 AS s, vec_id % 5 < 2 AS side, generate_subscripts(embedding, 1) AS pos, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings),
v AS (SELECT 'c' || s AS c, layer AS m, pos, avg(CASE WHEN side THEN x END) - avg(CASE WHEN NOT side THEN x END) AS x FROM e GROUP BY ALL),
g AS (SELECT a.c AS a, a.m, b.c AS b, b.m AS o, sum(a.x * b.x) AS v FROM v a JOIN v b USING (pos) GROUP BY ALL),
w AS (SELECT a, b, max(v) FILTER (m = 0 AND o = 0) AS p, max(v) FILTER (m = 0 AND o = 1) AS q, max(v) FILTER (m = 1 AND o = 0) AS r, max(v) FILTER (m = 1 AND o = 1) AS s FROM g GROUP BY ALL),
t AS (
  SELECT x.a, x.b, (x.p * x.s - x.q * x.r) * (x.p * x.s - x.q * x.r) / ((y.p * y.s - y.q * y.r) * (z.p * z.s - z.q * z.r)) AS det,
    ((y.s * x.p - y.q * x.r) * (z.s * x.p - z.q * x.q) + (y.s * x.q - y.q * x.s) * (z.p * x.q - z.q * x.p) + (y.p * x.r - y.r * x.p) * (z.s * x.r - z.q * x.s) + (y.p * x.s - y.r * x.q) * (z.p * x.s - z.q * x.r)) / ((y.p * y.s - y.q * y.r) * (z.p * z.s - z.q * z.r)) AS tr
  FROM w x JOIN w y ON y.a = x.a AND y.b = x.a JOIN w z ON z.a = x.b AND z.b = x.b WHERE x.a < x.b),
u AS (SELECT a, b, sqrt((tr + sqrt(greatest(tr * tr - 4 * det, 0))) / 2) AS c1, sqrt(greatest((tr - sqrt(greatest(tr * tr - 4 * det, 0))) / 2, 0)) AS c2 FROM t)
SELECT a AS construct_a, b AS construct_b, round(acos(c1), 6) AS least_angle, round(acos(c2), 6) AS greatest_angle, round(c1, 6) AS top_cosine, round((c1 + c2) / 2, 6) AS mean_cosine FROM u"""
)
def probe_angles(spark: SparkSession, d: str) -> DataFrame:
    """T-32: planes that three constructs' difference vectors of two layers span."""
    e = table(spark, d, "embeddings").select((F.col("label") % 2).alias("layer"), F.concat(F.lit("c"), F.pmod("vec_id", F.lit(3)).cast("string")).alias("c"), (F.pmod("vec_id", F.lit(5)) < 2).alias("side"), F.col("embedding").alias("vec"))
    diff = vectors.mean_difference(e, ["c", "layer"], F.col("side"))
    v = diff.groupBy("c", "layer").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "d"))), lambda x: x["d"]).alias("vec"))
    return r6(gram.subspace_angles(v, "c", "layer"))


@query(
    f"""WITH e AS (SELECT *, vec_id % 4 AS layer FROM {_HALVES}),
y AS (SELECT layer, vec_id, first AS y, row_number() OVER (PARTITION BY layer ORDER BY CAST(vec_id AS VARCHAR)) AS k FROM e),
h AS (SELECT layer, vec_id, p, row_number() OVER (PARTITION BY layer, p ORDER BY sha256('35|' || p || '|' || vec_id)) AS k FROM e, range(40) x(p)),
u AS (SELECT e.layer, -1 AS p, x1, x2, first AS y FROM e UNION ALL SELECT h.layer, p, x1, x2, y FROM h JOIN y ON y.layer = h.layer AND y.k = h.k JOIN e ON e.vec_id = h.vec_id),
l AS ({_line(f"({_products('u', 'layer, p', 'y')})", "layer, p")}),
c AS (SELECT layer, p, (0.6 * v1 - 0.8 * v2) / sqrt(v1 * v1 + v2 * v2) AS c FROM l),
n AS (SELECT layer, quantile_cont(abs(c), 0.95) AS high, quantile_cont(abs(c), 0.5) AS mid FROM c WHERE p >= 0 GROUP BY 1)
SELECT layer, round(c, 6) AS cosine, round(high, 6) AS null_high, round(mid, 6) AS null_median, round(1 / sqrt(2), 6) AS random_sd, abs(c) > high AS aligned FROM c JOIN n USING (layer) WHERE p = -1"""
)
def permuted_alignment(spark: SparkSession, d: str) -> DataFrame:
    """T-35: probes of each layer against a direction, and those of forty permutations of the target."""
    e = _probed(spark, d)
    to = e.select("layer").distinct().withColumn("direction", F.array(F.lit(0.6), F.lit(-0.8)))
    return r6(gram.alignment_null(e, to, ["layer"], "vec_id", "first", 40, 35))


# ----- SIMEX

_NORMAL = [f"sqrt(-2 * ln((CAST('0x' || substr(h, {15 * j + 1}, 15) AS BIGINT) + 0.5) / 1152921504606846976.0)) * {f}(2 * pi() * ((CAST('0x' || substr(h, {15 * j + 16}, 15) AS BIGINT) + 0.5) / 1152921504606846976.0))" for j in (0, 2) for f in ("cos", "sin")]
_SHARE = [float(x) for x in np.linalg.pinv(np.vander(np.array([0.0, 0.5, 1.0, 1.5, 2.0]), 3)).T @ np.array([1.0, -1.0, 1.0])]


@query(
    f"""WITH x AS (SELECT l_returnflag AS f, CAST(l_suppkey AS VARCHAR) AS g, CAST(l_linenumber AS VARCHAR) AS i, avg(l_discount) * 100 AS x, var_samp(l_discount) * 10000 / count(*) AS v, CASE WHEN l_linenumber % 2 = 0 THEN 0.5 ELSE -0.5 END AS s, count(*) AS n, sum(l_quantity) AS sy FROM lineitem GROUP BY ALL),
a AS (SELECT x.* REPLACE (greatest(coalesce(v, avg(v) OVER (PARTITION BY f), 0), 0) AS v) FROM x),
k AS (SELECT f, g, row_number() OVER (PARTITION BY f ORDER BY g) - 1 AS i, count(*) OVER (PARTITION BY f) AS size FROM (SELECT DISTINCT f, g FROM a)),
o AS (SELECT -1 AS outer_, r AS inner_ FROM range(40) t(r) UNION ALL SELECT o, r FROM range(30) u(o), range(4) t(r)),
z AS (SELECT a.*, outer_, inner_, sha256('20|' || outer_ || '|' || inner_ || '|' || g || '|' || i) AS h FROM a, o),
e AS (
  SELECT f, g, s, n, sy, outer_, inner_, unnest([0.5, 1.0, 1.5, 2.0]) AS t, unnest([x + sqrt(0.5 * v) * {_NORMAL[0]}, x + sqrt(1.0 * v) * {_NORMAL[1]}, x + sqrt(1.5 * v) * {_NORMAL[2]}, x + sqrt(2.0 * v) * {_NORMAL[3]}]) AS p FROM z
  UNION ALL SELECT f, g, s, n, sy, outer_, 0, 0.0, x FROM a, (SELECT DISTINCT outer_ FROM o)),
d AS (
  SELECT f, g, outer_, inner_, t, sum(n * p * p) - sum(n * p) * sum(n * p) / sum(n) AS pp, sum(n * p * p * s) - sum(n * p) * sum(n * p * s) / sum(n) AS pq, sum(n * p * p * s * s) - sum(n * p * s) * sum(n * p * s) / sum(n) AS qq,
    sum(p * sy) - sum(n * p) * sum(sy) / sum(n) AS py, sum(p * s * sy) - sum(n * p * s) * sum(sy) / sum(n) AS qy FROM e GROUP BY ALL),
m AS (
  SELECT f, g, -1 AS outer_, 1 AS m FROM k
  UNION ALL SELECT c.f, k.g, o, count(*) FROM (SELECT f, o, CAST('0x' || substr(sha256('20|' || (o // 4) || '|' || i), 15 * (o % 4) + 1, 15) AS BIGINT) % size AS i FROM k, range(30) u(o)) c JOIN k ON k.f = c.f AND k.i = c.i GROUP BY ALL),
b AS (SELECT f, outer_, inner_, t, (sum(m * pp) * sum(m * qy) - sum(m * pq) * sum(m * py)) / (sum(m * pp) * sum(m * qq) - sum(m * pq) * sum(m * pq)) AS b FROM d JOIN m USING (f, g, outer_) GROUP BY ALL),
c AS (SELECT f, outer_, t, avg(b) AS b FROM b GROUP BY ALL),
w AS (SELECT f, outer_, sum(b * CASE t WHEN 0.0 THEN {_SHARE[0]!r} WHEN 0.5 THEN {_SHARE[1]!r} WHEN 1.0 THEN {_SHARE[2]!r} WHEN 1.5 THEN {_SHARE[3]!r} ELSE {_SHARE[4]!r} END) AS simex, max(b) FILTER (t = 0.0) AS naive FROM c GROUP BY ALL),
q AS (SELECT f, quantile_cont(simex, 0.025) AS low, quantile_cont(simex, 0.975) AS high, 2 * least(avg(CASE WHEN simex <= 0 THEN 1.0 ELSE 0.0 END), avg(CASE WHEN simex >= 0 THEN 1.0 ELSE 0.0 END)) AS p_boot FROM w WHERE outer_ >= 0 GROUP BY 1)
SELECT f AS l_returnflag, round(naive, 6) AS naive, round(simex, 6) AS simex, round(low, 6) AS low, round(high, 6) AS high, round(p_boot, 6) AS p_boot, CAST(sum(n) AS BIGINT) AS n, count(*) AS n_items, count(DISTINCT g) AS n_clusters
FROM a JOIN w USING (f) JOIN q USING (f) WHERE outer_ = -1 GROUP BY ALL"""
)
def simex_interval(spark: SparkSession, d: str) -> DataFrame:
    """T-20: items are a supplier's lines of one number; their mean discount is the predictor that has error."""
    x = table(spark, d, "lineitem")
    keys = ["l_returnflag", "l_suppkey", "l_linenumber"]
    means = x.groupBy(*keys).agg((F.avg("l_discount") * 100).alias("x"), (F.var_samp("l_discount") * 10000 / F.count("*")).alias("v"))
    rows = x.select(*keys, "l_quantity").join(means, keys).withColumn("s", F.when(F.col("l_linenumber") % 2 == 0, 0.5).otherwise(-0.5))
    return r6(resampling.simex_table(rows, ["l_returnflag"], "l_suppkey", "l_linenumber", "l_quantity", "x", "v", "s", 20, draws=40, outer=30, inner=4))
