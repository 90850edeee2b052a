import hashlib
import json
import math
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from gradus.functions import fakes, seeds
from gradus.operators import joins, routing
from gradus.plans import analysis, lifecycle, robustness
from gradus.sources import schemas


@pytest.fixture(scope="module")
def study(spark):
    rows = []
    for v in schemas.VALENCES:
        for i in range(12):
            rows.append((f"ENV-{v}-{i:02d}", "ENV", v, ["prudential", "aesthetic"][i % 2] if v in schemas.NONMORAL else "", "The mayor", f"win {i}", "acted", "danced", "town", "low thing done", "high thing done there", "harm it", None, None, i % 3 != 0))
    families = spark.createDataFrame(rows, schemas.schema("family"))
    variants = routing.build_variants(families)
    prompts = routing.render_prompts(variants, formats=("raw",))
    jobs = joins.build_jobs(prompts, ["m-instruct", "m-pretrained"], 1, "v1")
    material = fakes.request("prompt_id", "seed")
    lp = fakes.logprobs(material)
    results = jobs.select("*", F.lit("").alias("raw_response"), fakes.rating(material).cast("double").alias("parsed_rating"), F.lit(True).alias("parse_ok"), F.lit("regex").alias("parse_method"), lp.alias("logprobs_0_10"), *[F.lit(None).cast(t).alias(n) for n, t in (("model_revision", "string"), ("runner_version", "string"), ("timestamp", "double"))])
    return families, variants.cache(), results.cache()


def test_fakes_are_the_hashes(spark):
    got = spark.range(1).select(fakes.rating(F.lit("abc")).alias("r"), fakes.logprobs(F.lit("abc")).alias("lp"), fakes.review(F.lit("abc"), 0.0).alias("t"), fakes.review(F.lit("abc"), 1.0).alias("u")).first()
    n = int.from_bytes(hashlib.sha256(b"abc").digest()[:8], "big")
    assert got.r == n % 11 and got.t == str(n % 11) and got.u == "unclear"
    assert math.isclose(sum(math.exp(x) for x in got.lp), 1.0)


def test_robustness_specs_run(spark, study):
    _, variants, results = study
    curated = variants.select("variant_id", "family_id", (seeds.unit("variant_id") * 10).cast("int").alias("severity"))
    frame = robustness.load_frame(results, variants, curated).cache()
    assert frame.count() == results.count()
    assert abs(frame.select("family_id", "severity_c").distinct().agg(F.avg("severity_c")).first()[0]) < 1e-9
    assert len({f.name for f in robustness.FITS}) == len(robustness.FITS) == 22
    for name in ("01 base sign x tuning", "02 neutral offset", "07 paired, family effects", "14 severity, set effects", "32 sign by subdomain"):
        fit = next(f for f in robustness.FITS if f.name == name)
        got = robustness.run(frame, fit, 49).collect()
        assert got and all(0 <= r.p_wild <= 1 for r in got if not r.untestable), name
        if fit.split == "nonmoral_subdomain":
            assert {r.nonmoral_subdomain for r in got} == {"prudential", "aesthetic"}
    small = robustness.run(frame, robustness.FITS[0], 9, least=10**6).collect()
    assert all(r.untestable and r.p_wild is None for r in small)


def test_planning(spark):
    bench = spark.createDataFrame([("a", 1.0, 0.3, 40), ("b", 0.2, 0.3, 40)], "name string, beta double, se double, n_groups int")
    got = {(r.name, r.arm_name): r for r in robustness.projected(spark, bench, [("few", 2), ("many", 60)]).collect()}
    assert not got["a", "few"].detectable and got["a", "few"].projected_mde is None and got["a", "many"].detectable and not got["b", "many"].detectable
    rows = spark.createDataFrame([(0.05, 0.1, 40, 0.4, 1.0), (0.9, 0.1, 40, 0.001, 1.0)], "beta double, se double, n_groups int, p_wild double, benchmark double")
    e = robustness.equivalence(rows).orderBy("beta").collect()
    assert e[0].bound_below_benchmark is True and e[1].bound_below_benchmark is None and e[0].clusters_for_benchmark < 40
    cost = robustness.study_cost(spark.createDataFrame([(30,)], "pairs int"), 10, 30, 12.0, 20.0, 5.0, 0.3).first()
    assert (cost.total_ratings, cost.n_participants, cost.minutes_each) == (300, 10, 15.0) and math.isclose(cost.total, 2.5 * 12 * 1.3)


def test_lifecycle(spark, study, tmp_path):
    families, variants, _ = study
    assert lifecycle.approved(families).count() == families.filter("human_approved").count()
    assert lifecycle.approved(families.drop("human_approved")).count() == 0
    done, unknown = lifecycle.approve(families, spark.createDataFrame([("ENV-MB-00",), ("zz",)], "family_id string"))
    assert done.filter("family_id = 'ENV-MB-00'").first().human_approved and unknown.count() == 1
    curated = variants.select("variant_id", F.lit(True).alias("accepted"), F.when(F.col("variant_id").endswith("A"), "x").alias("individual_flags"), F.lit(None).cast("string").alias("pair_flag"))
    manifest = lifecycle.release(variants, curated, f"{tmp_path}/r")
    assert manifest["counts"]["MB"] == (48, 12) and manifest["gates_passed"] == ["accepted"]
    with pytest.raises(FileExistsError):
        lifecycle.release(variants, curated, f"{tmp_path}/r")
    with pytest.raises(ValueError, match="without an accepted"):
        lifecycle.release(variants, lifecycle.reviewed(curated, "reject_flagged"), f"{tmp_path}/s")
    (tmp_path / "f.txt").write_text("abc")
    good = {"f.txt": hashlib.sha256(b"abc").hexdigest()}
    lifecycle.check_manifest(spark, [f"{tmp_path}/f.txt"], good)
    with pytest.raises(ValueError, match="f.txt"):
        lifecycle.check_manifest(spark, [f"{tmp_path}/f.txt"], {"f.txt": "0"})
    assert lifecycle.status(families, families, schemas.VALENCES).first().MB == 12
    raw = spark.createDataFrame([("ENV-MB-00-A", "severity", 3, True, "3", "r", 1.0), ("ENV-MB-00-A", "severity", 4, True, "4", "r", 2.0), ("ENV-MB-00-B", "severity", None, False, "?", "r", 1.0)], schemas.schema("curation_raw"))
    got = {r.variant_id: (r.severity, r.individual_flags) for r in lifecycle.assembled_curation(variants, raw, ["severity"]).collect()}
    assert got["ENV-MB-00-A"] == (4, "") and got["ENV-MB-00-B"] == (None, "unparseable: severity") and got["ENV-MB-00-C"] == (None, "missing: severity")
    text = lifecycle.summary_markdown(spark.createDataFrame([("a", 0.5), ("b", None)], "k string, x double"), "T", ["k", "x"], ["k"])
    assert text.startswith("# T") and "| a | 0.500 |" in text
    pairs = lifecycle.registry_pairs(spark.createDataFrame([("m", "finetuned", True), ("n", "finetuned", False), ("n", "pretrained", False)], "model_family string, tuning_status string, core boolean"))
    assert [tuple(r) for r in pairs.collect()] == [("m", "error")]


def test_declarations_from_a_file(spark, tmp_path):
    analysis.write_declarations(spark, analysis.CONTRASTS, f"{tmp_path}/d")
    assert analysis.read_declarations(spark, f"{tmp_path}/d") == analysis.CONTRASTS
    line = {"name": "a", "kind": "lmm", "formula": "y ~ x", "term": "x", "expected": "positive", "family": "rq1"}
    for name, change, match in (("twice", {}, "bad declaration: a"), ("kind", {"kind": "wls"}, "bad declaration: a"), ("sens", {"sensitivities": ["moon"]}, "bad declaration: a"), ("field", {"seed": 3}, "line 1: seed")):
        lines = [json.dumps(line | change)] * (2 if name == "twice" else 1)
        (tmp_path / name).write_text("\n".join([*lines, ""]))
        with pytest.raises(ValueError, match=match):
            analysis.read_declarations(spark, f"{tmp_path}/{name}")
    (tmp_path / "less").write_text(json.dumps({k: v for k, v in line.items() if k != "term"}))
    with pytest.raises(ValueError, match="line 1: term"):
        analysis.read_declarations(spark, f"{tmp_path}/less")
    with pytest.raises(ValueError, match="undeclared: z"):
        analysis.selected(analysis.declared(analysis.CONTRASTS), ["z"])


def test_sensitivities_qualify_a_contrast(spark):
    """Slopes that differ by family qualify the contrast; equal ones don't."""
    rng = np.random.default_rng(9)
    rows = []
    for g in range(24):
        own = rng.normal(0, 1.5)
        for i in range(30):
            bad = i % 2 == 0
            for kind, slope in (("m", 1 + own), ("n", 1.0)):
                rows.append((kind, f"D{g % 6}-MB-{g:02d}", f"D{g % 6}", "raw", "finetuned", "intentionality", "bad" if bad else "good", float(slope * (0.5 if bad else -0.5) + rng.normal(0, 0.5))))
    df = spark.createDataFrame(rows, "model_family string, family_id string, domain string, format string, tuning_status string, question_type string, sign string, rating double")
    got = {r.model_family: r for r in analysis.sensitivity_table(df, ["rq1_base_sign_finetuned"]).collect()}
    assert got["m"].qualified and got["m"].slope_variance > 1 and got["m"].width_ratio > 1.5
    assert not got["n"].qualified and got["n"].slope_variance < 0.05
    assert got["m"].domain_n_groups == 6 and got["m"].domain_slope_variance is not None
    none = analysis.sensitivity_table(df, ["rq1_base_sign_finetuned"], contrasts=[replace(c, sensitivities=()) for c in analysis.CONTRASTS]).first()
    assert none.qualified is None and none.domain_se is None and none.se > 0
