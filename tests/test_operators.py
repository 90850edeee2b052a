import math
import random
import re

import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gradus.operators import aggregates as ag
from gradus.operators import joins, routing, vectors
from gradus.sources import files, schemas
from gradus.streaming import resume

FAMILY = dict(
    family_id="ENV-MB-01", domain="ENV", valence="MB", nonmoral_subdomain="", agent="The plant manager", goal="cut costs", common_action="switched filters", uncommon_action="opened valves",
    affected_entity="the river", low_evocative_outcome="fish in the river died", high_evocative_outcome="fish in the river choked and died", outcome_verb="harm the river", generator_model=None, ingest_date=None, human_approved=True,
)


def families(spark, *changes):
    return spark.createDataFrame([FAMILY | c for c in changes or [{}]], schemas.schema("family"))


def test_variants_and_prompts(spark):
    v = routing.build_variants(families(spark))
    good, bad = schemas.validate(v, schemas.vignette_rules())
    assert (good.count(), bad.count()) == (4, 0)
    row = v.filter("variant_id = 'ENV-MB-01-D'").first()
    assert row.scenario.startswith("The plant manager opened valves to cut costs. ") and row.scenario.endswith("choked and died.")
    assert row.q_blame == "How blameworthy is the plant manager for this, on a scale from 0 (not at all) to 10 (extremely)?"
    p = routing.render_prompts(v)
    assert p.count() == 4 * 3 * 2
    _, bad = schemas.validate(p, schemas.prompt_rules())
    assert bad.count() == 0
    with pytest.raises(ValueError):
        routing.render_prompts(v, formats=("cancel",))


def test_family_violations(spark):
    df = families(spark, {}, {"family_id": "b", "valence": "X"}, {"family_id": "c", "goal": "to win", "outcome_verb": "the harm"}, {"family_id": "d", "valence": "NMB"}, {"family_id": "e", "low_evocative_outcome": "a cruel thing in the river fish"})
    got = {(r.family_id, r.message) for r in routing.family_violations(df).collect()}
    assert got == {("b", "invalid valence"), ("c", "goal starts with to"), ("c", "outcome_verb starts with an article"), ("d", "subdomain is required"), ("e", "banned words in low_evocative_outcome: cruel")}


def results(spark):
    rows = []
    cases = {
        "bad": ("ENV-MB-01-A::blame", True, 5.0, None, "m-instruct"), "cancel": ("ENV-MB-01-A::blame::cancel", True, 5.0, None, "m-instruct"), "model": ("ENV-MB-01-A::blame::raw", True, 5.0, None, "zz"),
        "variant": ("NO::blame::raw", True, 5.0, None, "m-instruct"), "ok": ("ENV-MB-01-A::blame::raw", True, 5.0, None, "m-instruct"), "fail": ("ENV-MB-01-A::blame::raw", False, None, None, "m-instruct"),
        "lp": ("ENV-MB-01-B::blame::raw", False, None, None, "m-pretrained"), "ev": ("ENV-MB-01-B::blame::raw", False, None, [0.0] * 11, "m-pretrained"), "nul": ("ENV-MB-01-A::blame::raw", True, None, None, "m-instruct"),
        "flag": ("ENV-MB-01-C::blame::raw", True, 1.0, None, "m-instruct"), "acc": ("ENV-MB-01-D::blame::raw", True, 1.0, None, "m-instruct"),
    }
    for k, (p, ok, rating, lp, m) in cases.items():
        rows.append((k, p, m, 0, 1.0, 1, "", rating, ok, "regex", lp, None, None, None))
    return spark.createDataFrame(rows, schemas.schema("result"))


def test_ingest_routes_by_first_reason(spark):
    v = routing.build_variants(families(spark))
    registry = spark.createDataFrame([("m-instruct", "m", "finetuned"), ("m-pretrained", "m", "pretrained")], "model_key string, model_family string, tuning_status string")
    rated = v.select("variant_id", F.lit(3).alias("moral_relevance"), F.lit(3).alias("severity"), F.lit(3).alias("vividness"), F.lit(3).alias("typicality_perception"), F.when(F.col("variant_id").endswith("C"), "x").otherwise("").alias("individual_flags"), F.lit(None).cast("string").alias("pair_flag"), ~F.col("variant_id").endswith("D").alias("x")).withColumnRenamed("x", "accepted")
    rated = rated.withColumn("accepted", ~F.col("variant_id").endswith("D"))
    out = joins.ingest(results(spark), v, registry, rated, ["m-pretrained"], accepted_only=True, exclude_flagged=True)
    got = {r.job_id: (r.drop_reason, r.rating) for r in out.collect()}
    assert got == {
        "bad": ("malformed_prompt_id", None), "cancel": ("cancel_format_filtered", None), "model": ("unknown_model_key", None), "variant": ("unknown_variant", None), "ok": (None, 5.0), "fail": ("parse_failure", None),
        "lp": ("logprobs_missing", None), "ev": (None, 5.0), "nul": ("parse_failure", None), "flag": ("variant_flagged_excluded", None), "acc": ("variant_not_accepted", None),
    }
    told = routing.reconcile(out).first()
    assert told.n_included + told.n_excluded == told.n_read == 11
    ledger = {r.reason: (r["count"], r.examples) for r in routing.ledger(out, "job_id").collect()}
    assert ledger["parse_failure"] == (2, ["fail", "nul"])


def test_jobs_and_shards(spark):
    prompts = spark.createDataFrame([("a::b::raw",), ("c::d::raw",)], "prompt_id string")
    jobs = joins.build_jobs(prompts, ["m1", "m2"], 3, "v1")
    assert jobs.count() == 12 and jobs.select("job_id").distinct().count() == 12
    done = spark.createDataFrame([("a::b::raw::m1::0",), ("a::b::raw::m1::0",), ("unknown",)], "job_id string")
    assert joins.remaining(jobs, done, ["job_id"]).count() == 11
    df = schemas.numbered(spark.range(103).withColumnRenamed("id", "x"), ["x"])
    assert [r.ordinal for r in df.orderBy("x").collect()] == list(range(103))
    parts = [set(r.x for r in routing.shard(df, "ordinal", i, 4).collect()) for i in range(4)]
    assert sum(map(len, parts)) == 103 and set().union(*parts) == set(range(103))
    with pytest.raises(ValueError):
        routing.shard(df, "ordinal", 4, 4)


def test_ordinals_of_a_wide_table(spark):
    """Ranges that the adaptive planner would coalesce: every ordinal once, in order, and no row lost."""
    df = spark.range(200_000).select(F.xxhash64("id").alias("x"), F.concat(F.lit("wide "), F.sha2(F.col("id").cast("string"), 512)).alias("w")).repartition(7)
    got = schemas.numbered(df, ["x"])
    told = got.agg(F.count("*").alias("n"), F.count_distinct("ordinal").alias("d"), F.min("ordinal").alias("a"), F.max("ordinal").alias("b")).first()
    assert tuple(told) == (200_000, 200_000, 0, 199_999)
    w = Window.orderBy("ordinal")
    assert got.withColumn("up", F.col("x") > F.lag("x").over(w)).filter("not up").count() == 0


def test_holm_is_monotone_and_bounded(spark):
    rng = random.Random(5)
    rows = [(g, i, rng.random() ** 3) for g in range(5) for i in range(7)]
    got = ag.holm(spark.createDataFrame(rows, "g int, i int, p double"), ["g"], "p", "i").collect()
    for g in range(5):
        own = sorted((r.p, r.p_holm) for r in got if r.g == g)
        told, top = [], 0.0
        for k, (p, _) in enumerate(own):
            top = max(top, min(1.0, (len(own) - k) * p))
            told.append(top)
        assert all(math.isclose(a[1], b) for a, b in zip(own, told, strict=True))


def test_rarest(spark):
    for counts, told in (([2, 16, 24, 0], "d"), ([11, 5, 5, 5], "b"), ([10, 5, 5, 5], None), ([0, 0, 0, 0], None)):
        df = spark.createDataFrame([(n, c, i) for i, (n, c) in enumerate(zip("abcd", counts, strict=True))], "name string, n int, o int")
        assert ag.rarest(df, "name", "n", "o").first().rarest == told


def test_pairs_flags_and_gates(spark):
    rows = [("f", "common", "low", 5, 3, 0), ("f", "common", "high", 8, 4, 1), ("f", "common", "high", 6, 9, 2), ("g", "common", "low", 1, 1, 3)]
    df = spark.createDataFrame(rows, "family string, typ string, evoc string, severity int, vividness int, o int")
    pairs = ag.pair_flags(joins.matched_pairs(df, ["family", "typ"], "evoc", "low", "high", ["severity", "vividness"], "o"))
    assert [(r.family, r.severity_high, r.pair_flag) for r in pairs.collect()] == [("f", 6, "")]
    fam = spark.createDataFrame([("f", "common", 3.0), ("f", "uncommon", 4.0), ("g", "common", 5.0), ("g", "uncommon", 4.0), ("h", "common", 1.0)], "family string, typ string, v double")
    assert {r.family: r.flag for r in ag.failing_families(fam, "family", "typ", "v").collect()} == {"f": True, "g": False, "h": False}


def test_patch_carry_and_required(spark):
    t = spark.createDataFrame([("a", "x", "p", True), ("b", "y", "q", True)], "k string, f1 string, f2 string, human_approved boolean")
    patch = spark.createDataFrame([("a", "f1", "x", "z"), ("b", "f2", "WRONG", "w"), ("c", "f1", "x", "y")], "k string, field string, old_value string, new_value string")
    done, differs, unknown = routing.apply_patch(t, patch, "k", ["f1", "f2"])
    assert sorted(map(tuple, done.collect())) == [("a", "z", "p", False), ("b", "y", "w", False)]
    assert [r.k for r in differs.collect()] == ["b"] and [r.k for r in unknown.collect()] == ["c"]
    with pytest.raises(Exception, match="no match"):
        joins.join_required(t, t.filter("k = 'a'").select("k"), ["k"]).collect()


def test_split_is_stratified(spark):
    df = spark.createDataFrame([(d, f"{d}{i}") for d in "xyz" for i in range(6)], "d string, g string")
    got = ag.group_split(df, "d", "g", 0.3, "s").groupBy("d", "part").count().collect()
    assert {(r.d, r.part): r["count"] for r in got} == {(d, p): n for d in "xyz" for p, n in (("test", 2), ("train", 4))}


def test_files(spark, tmp_path):
    v = routing.build_variants(families(spark))
    files.write_csv(v.coalesce(1), f"{tmp_path}/v", v.columns)
    raw = next((tmp_path / "v").glob("part-*")).read_bytes()
    assert raw.endswith(b"\r\n") and b"\r\n" in raw
    (tmp_path / "in.csv").write_text(",".join(schemas.schema("vignette").names) + "\n" + raw.decode().replace("\r\n", "\n"))
    assert files.read_csv(spark, f"{tmp_path}/in.csv", "vignette", schemas.vignette_rules()).count() == 4
    (tmp_path / "bad.csv").write_text("nope\n1\n")
    with pytest.raises(ValueError, match="unknown columns"):
        files.read_csv(spark, f"{tmp_path}/bad.csv", "vignette")
    assert files.read_if_there(spark, f"{tmp_path}/none", "job").count() == 0
    (tmp_path / "t.jsonl").write_text('{"job_id": "a b"}\n\n{"job_id": "c"}\n{"job_id": "to')
    good, torn = files.read_torn(spark, f"{tmp_path}/t.jsonl", "job")
    assert [r.job_id for r in good.collect()] == ["a b", "c"] and torn.count() == 1
    assert files.repair_torn(spark, f"{tmp_path}/t.jsonl", "job") == 1 and files.repair_torn(spark, f"{tmp_path}/t.jsonl", "job") == 0
    assert [r.job_id for r in files.read_jsonl(spark, f"{tmp_path}/t.jsonl", "job").collect()] == ["a\u2028b", "c"]
    (tmp_path / "u.jsonl").write_text('{"job_id": "to\n{"job_id": "c"}\n')
    with pytest.raises(ValueError, match="not the last"):
        files.read_torn(spark, f"{tmp_path}/u.jsonl", "job")
    (tmp_path / "items.txt").write_text("1.\nA thing happened.\nDid A cause it?\n2.\nOther.\nDid B cause it?\n")
    assert [tuple(r) for r in files.numbered_items(spark, f"{tmp_path}/items.txt").orderBy("item").collect()] == [(1, "A thing happened.", "Did A cause it?"), (2, "Other.", "Did B cause it?")]
    df = spark.createDataFrame([("b", 0.5, True), ("a", None, None)], "k string, x double, f boolean")
    assert files.rendered(df, ["k", "x", "f"], ["k"]) == "k,x,f\na,,\nb,0.500000,True\n"


def test_tables_and_probes(spark, tmp_path):
    df = spark.createDataFrame([("c", "ridge", 1, [0.5]), ("c", "ridge", 2, [0.7]), ("d", "ridge", 1, [0.1])], "construct string, kind string, layer int, coef array<double>")
    files.write_probes(df, f"{tmp_path}/p", {"alpha": 1})
    got, about = files.read_probes(spark, f"{tmp_path}/p", "c", 2)
    assert [r.coef for r in got.collect()] == [[0.7]] and about == {"alpha": 1}
    files.write_parquet(df, f"{tmp_path}/q", ["construct"])
    assert files.read_parquet(spark, f"{tmp_path}/q", ["layer"]).columns == ["layer"]
    assert files.reshaped(df, {"kind": "k"}, ["k", "none", "layer"]).columns == ["k", "none", "layer"]
    assert [r.layer for r in files.ordered(df, ["layer"], ["construct"], True).collect()] == [2, 1, 1]


def test_probes_without_one_domain(spark):
    rng = random.Random(1)
    rows = [(0, d, y, [y + rng.gauss(0, 0.1), rng.gauss(0, 1)]) for d in "abc" for y in (0.0, 1.0) for _ in range(10)] + [(1, "a", 1.0, [1.0, 0.0])]
    df = spark.createDataFrame(rows, "layer int, d string, y double, vec array<double>")
    got = {(r.layer, r.domain): r for r in vectors.left_out_table(df, ["layer"], "y", "d", "logistic").collect()}
    assert set(got) == {(0, "a"), (0, "b"), (0, "c"), (1, "a")} and got[1, "a"].score is None
    assert all(got[0, d].score == 1.0 and got[0, d].n_test == 20 for d in "abc")


def test_rewrite_keeps_a_table(spark, tmp_path):
    path = f"{tmp_path}/t"
    spark.range(3).write.parquet(path)
    files.rewrite(spark.read.parquet(path).filter("id > 0"), path)
    assert spark.read.parquet(path).count() == 2


def test_stream_resumes(spark, tmp_path):
    src, out, at = f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/at"
    row = lambda k: results(spark).filter("job_id = 'ok'").withColumn("job_id", F.lit(k)).withColumn("timestamp", F.lit(1000.0))
    sink = lambda df, _: df.write.mode("append").parquet(out)
    row("a").write.mode("append").json(src)
    for _ in range(2):
        resume.run_available(resume.first_results(resume.results_stream(spark, src), "job_id", "timestamp"), sink, at).awaitTermination()
        row("b").write.mode("append").json(src)
    assert sorted(r.job_id for r in spark.read.parquet(out).collect()) == ["a", "b"]


def test_calls_are_repeated(spark, tmp_path):
    mark = str(tmp_path / "seen")

    def flaky(pdf):
        import os

        if not os.path.exists(mark):
            open(mark, "w").close()
            raise OSError
        return pdf

    assert resume.called(spark.range(4).coalesce(1), flaky, "id long", wait=0.01).count() == 4


@pytest.mark.parametrize("least", [0.0, 0.1, 0.5, 0.6, 0.8])
def test_similar_texts_lose_no_pair(spark, least):
    rng = random.Random(27)
    words = ["the"] * 30 + [f"w{'abcdefghij'[i % 10]}{'klmnop'[i // 10]}" for i in range(40)]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 9))) for _ in range(90)] + ["the", "the", "", "THE wak!"]
    sets = [set(re.findall("[a-z]+", t.lower())) for t in texts]
    sim = lambda a, b: len(a & b) / len(a | b) if a | b else 0.0
    df = spark.createDataFrame([(i, "xy"[i % 2], t) for i, t in enumerate(texts)] + [(None, None, None)], "i int, d string, t string")
    got = {(r.i_a, r.i_b): r.similarity for r in joins.token_pairs(df, "i", "t", least).collect()}
    want = {(a, b): sim(sets[a], sets[b]) for a in range(len(texts)) for b in range(a + 1, len(texts)) if sim(sets[a], sets[b]) > least}
    assert got == want
    like = sorted((r.d, r.new_goal, r.old_goal) for r in joins.similar_goals(df, df.filter("i >= 40"), "d", "t", least).collect())
    olds = {("xy"[i % 2], texts[i]) for i in range(40, len(texts))}
    assert like == sorted(("xy"[i % 2], t, o) for i, t in enumerate(texts) for d, o in olds if d == "xy"[i % 2] and sim(sets[i], set(re.findall("[a-z]+", o.lower()))) > least)


def test_pilot_jobs(spark):
    prompts = spark.createDataFrame([("b",), ("a",), ("a",)], "prompt_id string")
    done = spark.createDataFrame([("a::m2::0",), ("a::m2::1",), ("a::m2::1",), ("zz",), (None,)], "job_id string")
    got = sorted((r.turn, r.prompt_id, r.sample_idx, r.model_key) for r in joins.pilot_jobs(prompts, ["m2", "m1", "m2"], 2, done).collect())
    assert got == [(1, "a", 0, "m1"), (1, "a", 1, "m1"), (1, "b", 0, "m1"), (1, "b", 1, "m1"), (2, "b", 0, "m2"), (2, "b", 1, "m2")]
    assert joins.pilot_jobs(prompts.limit(0), ["m1"], 1, done).count() == 0
