import hashlib
import json
import math
import re

import pytest
from pyspark.sql import functions as F

from gradus.functions import distributions as dist
from gradus.functions import scoring, seeds
from gradus.functions import text as tx


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def values(spark, given, column, kind="string"):
    df = spark.createDataFrame([(i, g) for i, g in enumerate(given)], f"i int, v {kind}")
    return [r.x for r in df.select("i", column(F.col("v")).alias("x")).orderBy("i").collect()]


def test_parse_rating(spark):
    given = ["7", " 7.", "10", "rating: 3 out of 10", "0", "The answer is 9.", "ten", "", "I cannot answer this.", "11", "7.5", "-3", "10/10", "100", None, "  4"]
    told = [7, 7, 10, 3, 0, 9, None, None, None, None, 7, 3, 10, None, None, 4]
    assert values(spark, given, tx.parse_rating) == told


def test_expected_rating(spark):
    cases = [[0.0] * 11, [-1e9] * 10 + [0.0], [math.log(1), math.log(3), *[-1e300] * 9], [-1e300] * 11]
    assert [round(x, 9) for x in values(spark, cases, scoring.ev_unchecked, "array<double>")] == [5.0, 10.0, 0.75, 5.0]
    bad = [[0.0] * 10, [float("-inf")] * 11, None, []]
    assert values(spark, bad, scoring.ev_safe, "array<double>") == [None] * 4
    with pytest.raises(Exception, match="11 values"):
        values(spark, [[0.0] * 10], scoring.ev_strict, "array<double>")


def test_sanitise_and_top_k(spark):
    x = values(spark, [[float("nan"), float("-inf"), float("inf"), 1.0]], scoring.sanitise, "array<double>")[0]
    assert x == [-1e300, -1e300, 1e300, 1.0]
    assert values(spark, [[1.0, 5.0, 3.0, 5.0]], lambda c: scoring.top_k(c, 2), "array<double>")[0] == [0.0, 5.0, 0.0, 5.0]


def test_seeds_are_those_pinned(spark):
    cases = [
        ("v1.0", "ENV-MB-01-A::intentionality::raw", "llama-3.1-8b-instruct", 0, 0.8997867744781961, 1176720157),
        ("v1.0", "ENV-MB-01-A::blame::raw", "llama-3.1-8b-instruct", 5, 0.9499723646571169, 1383822422),
        ("v0.9", "TST-MG-02-D::praise::chat", "mistral-7b-v0.1-pretrained", 17, 0.8857269852846547, 251004785),
    ]
    for release, prompt, model, i, temperature, seed in cases:
        got = one(spark, seeds.derive(F.lit(release), F.lit(prompt), F.lit(model), F.lit(i)))
        assert (got.temperature, got.seed) == (temperature, seed)


def test_hashes(spark):
    assert one(spark, seeds.u32(F.lit("a"), F.lit(3))) == int(hashlib.sha256(b"a|3").hexdigest(), 16) % 2**32
    doc = '{"b": "é", "a": [1, 2]}'
    assert values(spark, [doc, None], seeds.canonical_json_hash) == [hashlib.sha256(json.dumps(json.loads(doc), sort_keys=True, separators=(",", ":")).encode()).hexdigest(), None]


def test_text_functions(spark):
    assert values(spark, ["a::b::c", "a::b", None], tx.split_key) == [["a", "b", "c"], None, None]
    assert values(spark, ["ENV-MB-01", "plain"], lambda c: tx.strip_token(c, ["MB", "NEU"])) == ["ENV-01", "plain"]
    assert values(spark, ["ENV-MB-07", "ENV-MB-07r2", "x"], tx.trailing_number) == [7, 7, None]
    assert values(spark, ["The plant", "Maria", ""], tx.decapitalise) == ["the plant", "maria", ""]
    assert values(spark, ["TRUE", " 1 ", "no", None, "maybe"], tx.truthy) == [True, True, False, False, False]
    with pytest.raises(Exception, match="not a boolean"):
        values(spark, ["maybe"], tx.truthy_strict)
    assert values(spark, ["A kindergarten", "nothing", "Wrongly praised"], tx.banned_hits) == [["kind"], [], ["praise", "wrong"]]
    assert values(spark, ["One. Two! Three? Four"], tx.sentences) == [["One.", "Two!", "Three?", "Four"]]
    assert values(spark, ["Did the mayor intentionally harm it?", "Who?"], tx.agent_phrase) == ["the mayor", None]
    assert values(spark, ["", "____", "Scenario: x", "Let's see", "No, it is", "about 12 of", "well"], tx.failure_category) == ["A blank", "B fill-in blank", "C restates instruction", "D starts explaining", "E yes/no", "F digit, unparsed", "G other prose"]
    assert values(spark, [1.5, None, float("nan")], tx.fixed, "double") == ["1.500000", "", ""]
    assert values(spark, [2.5, 3.5, -2.5], tx.half_even, "double") == [2.0, 4.0, -2.0]


def test_banned_matches_pattern(spark):
    import random

    rng = random.Random(3)
    given = [" ".join(rng.choice([*tx.BANNED, "kindly", "house", "unkind", "the"]) + rng.choice(["", "s", ".", ",x"]) for _ in range(6)) for _ in range(40)]
    told = [sorted(w for w in tx.BANNED if re.search(rf"\b{w}\w*\b", g)) for g in given]
    assert values(spark, given, tx.banned_hits) == told


def test_rewrite(spark):
    s = "A acts. A did not care at all about B. A knew."
    df = spark.createDataFrame([(s, x) for x in ("indifferent", "omitted", "concerned")] + [("One. Two.", "omitted")], "s string, l string")
    got = [r[0] for r in df.select(tx.rewrite_level("s", "l", "did not care at all about", "cared a great deal about")).collect()]
    assert got == [s, "A acts. A knew.", "A acts. A cared a great deal about B. A knew.", None]


def test_distributions():
    assert abs(dist.t_ppf(0.975, 10) - 2.2281388519649385) < 1e-9
    assert abs(dist.chi2_sf(3.841458820694124, 1) - 0.05) < 1e-12
    assert abs(dist.f_sf(4.9646027437307145, 1, 10) - 0.05) < 1e-10
    assert abs(dist.t_cdf(1e9, 3) - 1) < 1e-12
    se = 0.4
    assert dist.minimum_detectable(se, 40) > dist.minimum_detectable(se, 400)
    g = dist.required_clusters(se, 40, 0.8)
    assert dist.minimum_detectable(dist.projected_se(se, 40, g), g) <= 0.8
    assert dist.direction_ok("positive", 1.0, 0.01) and not dist.direction_ok("positive", -1.0, 0.01) and dist.direction_ok("two-sided", -1.0, 0.01)
