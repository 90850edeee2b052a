"""The declared analysis over the study's results: contrasts, their sensitivities, robustness fits and planning, each with SQL."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import distributions as dist
from ..operators import stats
from ..session import written
from . import analysis, lifecycle, robustness
from .catalog import query, r6, table
from .stat_queries import _ONE, _TWO, _phi, _searched, _wild
from .study_queries import _RES, _families, _ingested, _place, _results, _variants

# ----- contrasts

_SUMS = "CAST(count(*) AS DOUBLE) AS n, sum(x) AS sx, sum(x * x) AS sxx, sum(y) AS sy, sum(x * y) AS sxy, sum(y * y) AS yy"
_NAMES = ["rq1_base_sign_finetuned", "rq1d_neu_offset", "rq1d_typicality_within_neu"]
_FRAME = f"""{_RES},
fine AS (SELECT family_id, split_part(family_id, '-', 1) AS domain, valence, sign, rating AS y, CASE WHEN right(variant_id, 1) IN ('A', 'B') THEN -0.5 ELSE 0.5 END AS typ_c FROM ing WHERE drop_reason IS NULL AND format = 'raw' AND tuning_status = 'finetuned' AND question_type = 'intentionality'),
rows_ AS (
  SELECT 'rq1_base_sign_finetuned' AS contrast, family_id, domain, CASE WHEN sign = 'bad' THEN 0.5 ELSE -0.5 END AS x, y FROM fine WHERE sign IN ('bad', 'good') AND y IS NOT NULL
  UNION ALL SELECT 'rq1d_neu_offset', family_id, domain, 0.0, y - 5 FROM fine WHERE valence = 'NEU' AND y IS NOT NULL
  UNION ALL SELECT 'rq1d_typicality_within_neu', family_id, domain, typ_c, y FROM fine WHERE valence = 'NEU' AND y IS NOT NULL),
"""
_FITS = """
e AS (
  SELECT f, (a00 * b1 - a01 * b0) / (a00 * a11 - a01 * a01) AS estimate, sqrt(rss / n * a00 / (a00 * a11 - a01 * a01)) AS se, n, k FROM fit_two WHERE NOT starts_with(f, 'rq1d_neu_offset')
  UNION ALL SELECT f, b0 / a00, sqrt(rss / n / a00), n, k FROM fit_one WHERE starts_with(f, 'rq1d_neu_offset'))"""


def _frame(spark: SparkSession, d: str) -> DataFrame:
    return written(spark, _ingested(spark, d).filter("drop_reason is null"), "frame")


def _from_file(spark: SparkSession) -> list[analysis.Contrast]:
    """The declared contrasts, written to a file and read from it."""
    at = _place(spark, "contrasts.jsonl")
    analysis.write_declarations(spark, analysis.CONTRASTS, at)
    return analysis.read_declarations(spark, at)


# Models of four terms: an intercept, x1, x2 and their product, whose coefficient is the contrast.
_CODES = {"sign_c": "sign = 'bad'", "tuning_c": "tuning_status = 'finetuned'", "vt_c": "valence_type = 'moral'", "typ_c": "right(variant_id, 1) IN ('C', 'D')", "evoc_c": "right(variant_id, 1) IN ('B', 'D')"}
_CROSSED = f"""
coded AS (
  SELECT *, {", ".join(f"CAST(CASE WHEN {bad} THEN 0.5 ELSE -0.5 END AS DOUBLE) AS {name}" for name, bad in _CODES.items())}
  FROM (SELECT family_id, variant_id, question_type, tuning_status, sign, rating AS y, CASE WHEN valence IN ('MB', 'MG') THEN 'moral' ELSE 'nonmoral' END AS valence_type FROM ing WHERE drop_reason IS NULL AND format = 'raw' AND sign IN ('bad', 'good') AND rating IS NOT NULL)),
asked AS (SELECT * FROM coded WHERE question_type = 'intentionality'),
channel AS (SELECT variant_id, valence_type, avg(y) AS p FROM coded WHERE tuning_status = 'finetuned' AND question_type = CASE WHEN sign = 'bad' THEN 'blame' ELSE 'praise' END GROUP BY 1, 2),
paired AS (SELECT family_id, valence_type, sign_c, p, y FROM asked JOIN channel USING (variant_id, valence_type) WHERE tuning_status = 'finetuned'),
spread AS (SELECT valence_type, avg(p) AS m, stddev_pop(p) AS s FROM paired GROUP BY 1),
crossed AS (
  SELECT 'rq1_base_sign_x_tuning' AS f, family_id, sign_c AS x1, tuning_c AS x2, y FROM asked
  UNION ALL SELECT 'rq1a_sign_x_valence_type', family_id, sign_c, vt_c, y FROM asked WHERE tuning_status = 'finetuned'
  UNION ALL SELECT 'rq1b_' || valence_type, family_id, CASE WHEN s > 0 THEN (p - m) / s ELSE 0 END, sign_c, y FROM paired JOIN spread USING (valence_type)
  UNION ALL SELECT 'rq1c_typicality_x_sign', family_id, typ_c, sign_c, y FROM asked WHERE tuning_status = 'finetuned'
  UNION ALL SELECT 'rq1c_evocativeness_x_sign', family_id, evoc_c, sign_c, y FROM asked WHERE tuning_status = 'finetuned'),
"""


def _four() -> str:
    """The CTE four, a row for each f of crossed: clusters are summed by size, as a ratio's weights depend on it alone, and the first three terms eliminated one by one."""
    x, upper = ["1.0", "x1", "x2", "x1 * x2"], [(i, j) for i in range(4) for j in range(i, 4)]
    clusters = ", ".join([*(f"sum({x[i]} * {x[j]}) AS x{i}{j}" for i, j in upper), *(f"sum({x[i]} * y) AS y{i}" for i in range(4))])
    sizes = ", ".join([*(f"sum(x{i}{j}) AS p{i}{j}, sum(x0{i} * x0{j}) AS o{i}{j}" for i, j in upper), *(f"sum(y{i}) AS q{i}, sum(x0{i} * y0) AS r{i}" for i in range(4))])
    by_size = f"SELECT f, n, count(*) AS k, {sizes}, sum(yy) AS yy, sum(y0 * y0) AS tt FROM (SELECT f, family_id, CAST(count(*) AS DOUBLE) AS n, {clusters}, sum(y * y) AS yy FROM crossed GROUP BY 1, 2) GROUP BY 1, 2"
    sums_at = ", ".join([*(f"sum(p{i}{j} - s * o{i}{j}) AS a{i}{j}" for i, j in upper), *(f"sum(q{i} - s * r{i}) AS b{i}" for i in range(4))])
    sums_at = f"sum(k * n) AS n, CAST(sum(k) AS BIGINT) AS k, {sums_at}, sum(yy - s * tt) AS c, sum(k * ln(1 + n * rho)) AS logs"

    def solve(sums: str) -> str:
        for m in range(3):
            left = [*(f"a{i}{j} - a{m}{i} * a{m}{j} / a{m}{m} AS a{i}{j}" for i, j in upper if i > m), *(f"b{i} - a{m}{i} * b{m} / a{m}{m} AS b{i}" for i in range(m + 1, 4))]
            sums = f"SELECT * REPLACE ({', '.join(left)}, c - b{m} * b{m} / a{m}{m} AS c) FROM ({sums})"
        return sums

    return f"four AS ({_searched(by_size, {'four': ('c - b3 * b3 / a33', 'a33')}, sums_at=sums_at, solve=solve)} SELECT * FROM fit_four),\n"


_CONTRASTS = f"""{_searched(f"SELECT contrast AS f, family_id AS g, {_SUMS} FROM rows_ GROUP BY 1, 2", {"two": _TWO, "one": _ONE}, before=_FRAME + _CROSSED.lstrip() + _four())},{_FITS[:-1]}
  UNION ALL SELECT f, b3 / a33, sqrt(rss / n / a33), n, k FROM four),
p AS (SELECT *, 2 * (1 - {_phi("abs(estimate / se)")}) AS p, split_part(f, '_', 1) AS rq FROM e),
h AS (SELECT *, (count(*) OVER (PARTITION BY rq) - row_number() OVER (PARTITION BY rq ORDER BY p, f) + 1) * p AS v FROM p),
o AS (SELECT *, least(1.0, max(v) OVER (PARTITION BY rq ORDER BY p, f ROWS UNBOUNDED PRECEDING)) AS p_holm FROM h)
SELECT f AS contrast, rq, 'm' AS model_family, round(estimate, 6) AS estimate, round(se, 6) AS se, round(p, 6) AS p_value, round(p_holm, 6) AS p_holm, CAST(n AS BIGINT) AS n_obs, k AS n_groups, p_holm < 0.05 AND (rq NOT IN ('rq1', 'rq1a', 'rq1b') OR estimate > 0) AS confirmed FROM o"""


@query(_CONTRASTS)
def contrasts(spark: SparkSession, d: str) -> DataFrame:
    """G-01, G-02, G-12, T-01, X-05: contrasts declared in a file, fitted in each model family and corrected by family of tests."""
    out = analysis.contrast_table(_frame(spark, d), contrasts=_from_file(spark))
    return r6(out.select("contrast", "rq", "model_family", "estimate", "se", "p_value", "p_holm", "n_obs", "n_groups", "confirmed"))


@query(
    f"WITH {_RES}, c AS ({_CONTRASTS}), w AS (SELECT count(*) AS n, count(*) FILTER (drop_reason IS NULL) AS kept FROM ing) "
    "SELECT 1 AS section, '' AS topic, 0 AS part, '' AS at, printf('Of %d result rows read, %d were included and %d excluded.', n, kept, n - kept) AS line FROM w "
    "UNION ALL SELECT 1, '', 1, drop_reason, '| ' || drop_reason || ' | ' || count(*) || ' |' FROM ing WHERE drop_reason IS NOT NULL GROUP BY drop_reason "
    "UNION ALL SELECT DISTINCT 2, rq, 0, '', '### ' || rq FROM c UNION ALL SELECT DISTINCT 2, rq, 1, '', '| contrast | model_family | estimate | p | p(Holm) | confirmed |' FROM c "
    "UNION ALL SELECT 2, rq, 2, contrast || '/' || model_family, printf('| %s | %s | %.3f | %.4f | %.4f | %s |', contrast, model_family, estimate, p_value, p_holm, CASE WHEN confirmed THEN 'true' ELSE 'false' END) FROM c"
)
def study_summary(spark: SparkSession, d: str) -> DataFrame:
    """G-11: the report of the declared analysis, line by line."""
    results = written(spark, _ingested(spark, d), "results")
    tests = analysis.contrast_table(results.filter("drop_reason is null"), contrasts=_from_file(spark))
    return lifecycle.summary_lines(results, r6(tests))


@query(
    f"""{_searched(f"SELECT contrast || '/family' AS f, family_id AS g, {_SUMS} FROM rows_ GROUP BY 1, 2 UNION ALL SELECT contrast || '/domain', domain, {_SUMS} FROM rows_ GROUP BY 1, 2", {"two": _TWO, "one": _ONE}, before=_FRAME)},{_FITS}
SELECT split_part(a.f, '/', 1) AS contrast, 'm' AS model_family, round(a.estimate, 6) AS estimate, round(a.se, 6) AS se, round(b.estimate, 6) AS domain_estimate, round(b.se, 6) AS domain_se, round(2 * (1 - {_phi("abs(b.estimate / b.se)")}), 6) AS domain_p_value, b.k AS domain_n_groups
FROM e a JOIN e b ON b.f = replace(a.f, '/family', '/domain') WHERE a.f LIKE '%/family'"""
)
def contrast_domains(spark: SparkSession, d: str) -> DataFrame:
    """T-10: the same contrasts with domains as clusters."""
    domains = [replace(c, sensitivities=("domain",)) for c in _from_file(spark)]
    out = analysis.sensitivity_table(_frame(spark, d), _NAMES, contrasts=domains)
    return r6(out.select("contrast", "model_family", "estimate", "se", "domain_estimate", "domain_se", "domain_p_value", "domain_n_groups"))


@query()
def contrast_slopes(spark: SparkSession, d: str) -> DataFrame:
    """T-09: random slopes of families and of domains, and whether a contrast is qualified by them."""
    out = analysis.sensitivity_table(_frame(spark, d), ["rq1_base_sign_finetuned", "rq1c_typicality_x_sign"])
    return r6(out.select("contrast", "model_family", "slope_estimate", "slope_se", "slope_variance", "domain_slope_estimate", "domain_slope_se", "domain_slope_variance", "width_ratio", "qualified"))


# ----- robustness

_SWAP = f"""{_RES},
base AS (SELECT v.family_id, v.sign, r.ev, CASE WHEN parse_ok THEN parsed_rating END AS parsed FROM res r JOIN var v ON r.variant_id = v.variant_id WHERE NOT malformed AND question_type = 'intentionality' AND valence IN ('MB', 'MG') AND model_key = 'm-pretrained'),
both_ AS (SELECT '34 pretrained, moral' AS f, family_id AS g, CASE WHEN sign = 'bad' THEN 0.5 ELSE -0.5 END AS x, ev AS y FROM base WHERE ev IS NOT NULL
  UNION ALL SELECT '35 pretrained, moral, parsed', family_id, CASE WHEN sign = 'bad' THEN 0.5 ELSE -0.5 END, parsed FROM base WHERE parsed IS NOT NULL)"""


@query(
    f"""WITH {_SWAP},{_wild("SELECT f, g, count(*) AS n, sum(x) AS sx, sum(x * x) AS sxx, sum(y) AS sy, sum(x * y) AS sxy FROM both_ GROUP BY 1, 2", "CASE WHEN starts_with(f, '34') THEN 23 ELSE 24 END", 199)},
k AS (SELECT f, count(*) AS n, count(DISTINCT g) AS n_groups FROM both_ GROUP BY 1)
SELECT f AS fit, 'm' AS family, k.n, k.n_groups, round(any_value(b1), 6) AS beta, round(any_value(sqrt(factor * ss)), 6) AS se, round(avg(CASE WHEN abs(drawn) >= abs(seen) * (1 - 1e-9) THEN 1.0 ELSE 0.0 END), 6) AS p_wild FROM z JOIN x USING (f) JOIN b USING (f) JOIN k USING (f) GROUP BY f, k.n, k.n_groups"""
)
def robust_fits(spark: SparkSession, d: str) -> DataFrame:
    """T-37, T-38: a declared fit, and the same with ratings that were parsed from answers in place of expected ones."""
    v = _variants(spark, d)
    k = v.select("variant_id", "family_id").join(_families(spark, d).select("family_id", "k"), "family_id")
    curated = k.select("variant_id", "family_id", F.pmod("k", F.lit(11)).cast("int").alias("severity"))
    frame = written(spark, robustness.load_frame(_results(spark, d), v, curated).filter("family = 'm'"), "fits")
    out = [robustness.run(frame, f, 199).select("fit", "family", "n", "n_groups", "beta", "se", "p_wild") for f in robustness.FITS if f.name[:2] in ("34", "35")]
    return r6(out[0].unionByName(out[1]))


# ----- planning


def _t_cdf(t: str, df: str) -> str:
    """Student's distribution function in SQL for even degrees of freedom, a finite sum."""
    return f"(0.5 + 0.5 * ({t}) / sqrt({df} + ({t}) * ({t})) * list_sum(list_transform(range(CAST({df} / 2 AS BIGINT)), lambda j: exp(lgamma(j + 0.5) - lgamma(j + 1)) / sqrt(pi()) * pow({df} / ({df} + ({t}) * ({t})), j))))"


@query(
    f"""WITH RECURSIVE
c AS (SELECT l_returnflag AS f, l_suppkey AS g, count(*) AS n, sum(l_discount) AS sx, sum(l_discount * l_discount) AS sxx, sum(l_quantity) AS sy, sum(l_discount * l_quantity) AS sxy FROM lineitem GROUP BY 1, 2),
t AS (SELECT f, sum(n) AS n, count(*) AS k, sum(sx) AS sx, sum(sxx) AS sxx, sum(sy) AS sy, sum(sxy) AS sxy, sum(n) * sum(sxx) - sum(sx) * sum(sx) AS det FROM c GROUP BY 1),
b AS (SELECT *, (n * sxy - sx * sy) / det AS b1, (sxx * sy - sx * sxy) / det AS b0, k / (k - 1) * (n - 1) / (n - 2) AS factor FROM t),
s AS (SELECT b.f, b.k, b1, sqrt(any_value(factor) * sum(pow((b.n * (c.sxy - c.sx * b0 - c.sxx * b1) - b.sx * (c.sy - c.n * b0 - c.sx * b1)) / det, 2))) AS se FROM c JOIN b USING (f) GROUP BY ALL),
a AS (SELECT s.*, arm, g, CASE WHEN g >= 3 THEN se * sqrt(k / g) END AS projected_se FROM s, (VALUES ('few', 2), ('same', 0), ('many', 400)) v(arm, g0), LATERAL (SELECT CASE WHEN g0 = 0 THEN k ELSE g0 END AS g)),
q AS (SELECT DISTINCT df, p FROM (SELECT greatest(g - 2, 1) AS df FROM a WHERE g >= 3 UNION SELECT k - 2 FROM s), (VALUES (0.975), (0.95), (0.8)) v(p)),
z AS (
  SELECT df, p, CAST(0 AS DOUBLE) AS lo, CAST(20 AS DOUBLE) AS hi, 0 AS i FROM q
  UNION ALL
  SELECT df, p, CASE WHEN {_t_cdf("(lo + hi) / 2", "df")} < p THEN (lo + hi) / 2 ELSE lo END, CASE WHEN {_t_cdf("(lo + hi) / 2", "df")} < p THEN hi ELSE (lo + hi) / 2 END, i + 1 FROM z WHERE i < 60),
u AS (SELECT df, max(CASE WHEN p = 0.975 THEN lo END) AS t975, max(CASE WHEN p = 0.95 THEN lo END) AS t95, max(CASE WHEN p = 0.8 THEN lo END) AS t80 FROM z WHERE i = 60 GROUP BY 1)
SELECT f AS l_returnflag, arm, round(b1, 6) AS beta, round(projected_se, 6) AS projected_se, round(projected_se * (w.t975 + w.t80), 6) AS projected_mde, coalesce(abs(b1) >= projected_se * (w.t975 + w.t80), false) AS detectable,
  round(abs(b1) + se * o.t95, 6) AS equivalence_bound, round(se * (o.t975 + o.t80), 6) AS mde, b1 < 0 AND 2 * (1 - {_phi("abs(b1 / se)")}) < 0.05 AS falls
FROM a LEFT JOIN u w ON w.df = greatest(g - 2, 1) AND g >= 3 JOIN u o ON o.df = k - 2"""
)
def planned(spark: SparkSession, d: str) -> DataFrame:
    """F-27, F-28, F-29, J-33, J-34: what slopes of each return flag could show with other numbers of clusters, and what they rule out."""
    fits = stats.ols_table(table(spark, d, "lineitem"), "l_quantity ~ l_discount", "l_discount", ["l_returnflag"], "l_suppkey")
    rows = fits.select("l_returnflag", F.col("estimate").alias("beta"), "se", "n_groups", F.col("p_value").alias("p_wild"), F.lit(1.0).alias("benchmark"))
    sizes = sorted({r.n_groups for r in fits.select("n_groups").distinct().collect()})
    bounds = robustness.equivalence(rows)
    verdict = F.udf(lambda b, p: dist.direction_ok("negative", b, p), "boolean")  # a row for each cell of the design
    out = robustness.projected(spark, bounds, [("few", 2), *[("same", g) for g in sizes], ("many", 400)]).filter("arm_name <> 'same' or projected_g = n_groups")
    return r6(out.select("l_returnflag", F.col("arm_name").alias("arm"), "beta", "projected_se", "projected_mde", "detectable", "equivalence_bound", "mde", verdict("beta", "p_wild").alias("falls")))


@query(
    "WITH m AS (SELECT 'flag' AS source, l_returnflag AS cell, CASE WHEN l_linestatus = 'O' THEN 'blame' ELSE 'praise' END AS question, avg(l_quantity) AS beta FROM lineitem GROUP BY ALL UNION ALL SELECT 'line', CAST(l_linenumber AS VARCHAR), CASE WHEN l_linestatus = 'O' THEN 'blame' ELSE 'praise' END, avg(l_discount) * 100 FROM lineitem GROUP BY ALL) "
    "SELECT a.source, a.cell, round(a.beta, 6) AS blame, round(b.beta, 6) AS praise, CASE WHEN abs(a.beta) > abs(b.beta) THEN 'blame' ELSE 'praise' END AS bigger FROM m a JOIN m b ON a.source = b.source AND a.cell = b.cell AND b.question = 'praise' WHERE a.question = 'blame'"
)
def swings(spark: SparkSession, d: str) -> DataFrame:
    """J-35, J-36: tables of two analyses as one, cells named by what each lacks, and both questions of a cell side by side."""
    x = table(spark, d, "lineitem").withColumn("question", F.when(F.col("l_linestatus") == "O", "blame").otherwise("praise"))
    a = x.groupBy(F.lit("flag").alias("source"), F.col("l_returnflag").alias("cell"), "question").agg(F.avg("l_quantity").alias("beta"))
    b = x.groupBy(F.lit("line").alias("source"), F.col("l_linenumber").cast("string").alias("cell"), "question").agg((F.avg("l_discount") * 100).alias("beta"))
    return r6(robustness.swing_by_family(a.unionByName(b), ["source", "cell"]))
