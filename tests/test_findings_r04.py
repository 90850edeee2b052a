"""Tests of what a review found: each would have failed before."""

import random

import pytest
from oracle import DATA
from pyspark.sql import functions as F

from gradus.operators import profile
from gradus.plans import analysis, catalog

DECLARED = {c.name for c in analysis.CONTRASTS}


def test_every_declared_contrast_is_fitted(spark):
    """all contrasts of the declaration, and p-values corrected in whole families of tests."""
    rows = catalog.queries()["contrasts"](spark, DATA).collect()
    assert {r.contrast for r in rows} == DECLARED and len(rows) == len(DECLARED)
    sizes = {c.family: sum(x.family == c.family for x in analysis.CONTRASTS) for c in analysis.CONTRASTS}
    for rq, m in sizes.items():
        least = min((r for r in rows if r.rq == rq), key=lambda r: r.p_value)
        assert least.p_holm == pytest.approx(min(1.0, m * least.p_value), abs=1e-5)


def test_items_are_paired_within_their_model_family(spark):
    """an item's mean on its channel, and the spread of means, are those of a family's own answers."""
    draw = random.Random(4)
    rows = []
    for g in range(12):
        sign = "bad" if g % 2 else "good"
        for letter in "ABCD":
            for model, weight in (("a", 0.5), ("b", -2.0)):
                worth = draw.uniform(0, 10)
                for _ in range(3):
                    rows.append((model, f"V{g}-{letter}", f"V{g}", "raw", "finetuned", "moral", sign, "blame" if g % 2 else "praise", worth + draw.gauss(0, 0.2)))
                    rows.append((model, f"V{g}-{letter}", f"V{g}", "raw", "finetuned", "moral", sign, "intentionality", 5 + weight * worth + draw.gauss(0, 0.2)))
    df = spark.createDataFrame(rows, "model_family string, variant_id string, family_id string, format string, tuning_status string, valence_type string, sign string, question_type string, rating double")
    fit = lambda d: {r.model_family: (round(r.estimate, 6), round(r.se, 6), r.n_obs) for r in analysis.contrast_table(d, ["rq1b_moral"]).collect()}
    assert fit(df) == {m: fit(df.filter(f"model_family = '{m}'"))[m] for m in "ab"}


def test_every_declared_contrast_is_reported(spark):
    """a line for each contrast of the declaration, a table for each family of tests."""
    lines = catalog.queries()["study_summary"](spark, DATA).filter("section = 2").collect()
    assert {r.at for r in lines if r.part == 2} == {f"{name}/m" for name in DECLARED}
    assert {r.line for r in lines if r.part == 0} == {f"### {c.family}" for c in analysis.CONTRASTS}


def test_models_of_all_sizes_are_searched_together(spark, monkeypatch):
    """models with fewer terms are padded, so nine contrasts take one search; each is what it is alone."""
    searches = []
    keep = profile.fitted
    monkeypatch.setattr(profile, "fitted", lambda *a, **k: searches.append(1) or keep(*a, **k))
    draw = random.Random(5)
    rows = [(g, (-0.5, 0.5)[i % 2], (-0.5, 0.5)[i // 2 % 2], 5 + g % 3 + draw.gauss(0, 1), 5 + g + draw.gauss(0, 1e-4)) for g in range(20) for i in range(5)]
    df = spark.createDataFrame(rows, "g int, x double, z double, y double, stiff double").withColumn("cell", F.lit("m"))
    fits = {"one": (df, "y ~ 1", "Intercept"), "two": (df, "stiff ~ x", "x"), "four": (df, "y ~ x * z", "x:z")}
    got = {r.fit: r for r in profile.lmm_tables(fits, ["cell"], "g").collect()}
    assert len(searches) == 1 and set(got) == set(fits)
    assert got["two"].fallback_used and not got["one"].fallback_used
    for name in ("one", "two"):
        alone = profile.lmm_table(*fits[name], ["cell"], "g").first()
        assert [got[name][c] for c in ("estimate", "se", "p_value")] == pytest.approx([alone.estimate, alone.se, alone.p_value], rel=1e-7)
        assert got[name].method == alone.method
