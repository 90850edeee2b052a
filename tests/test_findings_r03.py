"""Tests of what a review found: each would have failed before."""

import os

import pytest
from oracle import DATA, TABLES, assert_same, connect

from gradus.plans import catalog


@pytest.fixture(scope="module")
def alike(tmp_path_factory):
    """The tables with parts of six and seven digits, of which two share the id of a family."""
    folder = tmp_path_factory.mktemp("alike")
    pairs = [(a, 10 * a + b) for a in range(100000, 100200) for b in range(10) if (9 * a + b) % 35 == 0]
    con = connect()
    n = con.execute("select count(*) from part").fetchone()[0]
    keys = [k for pair in pairs for k in pair][:n]
    con.execute("create table keys as select unnest(?) as key, unnest(range(?)) as place", [keys, len(keys)])
    for t in TABLES:
        if t == "part":
            sql = "select p.* replace (cast(key as bigint) as p_partkey) from part p join keys on place = p_partkey - (select min(p_partkey) from part)"
        elif t == "lineitem":
            sql = "select l.* replace (cast(key as bigint) as l_partkey) from lineitem l join keys on place = l_partkey % (select count(*) from keys)"
        else:
            os.symlink(f"{DATA}/{t}.parquet", folder / f"{t}.parquet")
            continue
        con.execute(f"copy ({sql}) to '{folder}/{t}.parquet' (format parquet)")
    return str(folder)


@pytest.mark.parametrize("name", ["study_codes", "study_patch", "study_patch_differs", "study_flags", "study_approve", "study_reviewed", "study_curation", "study_pilot", "study_subset", "study_ingest"])
def test_families_of_one_id_keep_their_own_rows(spark, alike, name):
    """F7, F15 to F23."""
    assert catalog.queries()[name](spark, alike).count() > 0
    assert_same(catalog.queries()[name](spark, alike), catalog.oracle_sql()[name], connect(alike))


@pytest.mark.parametrize("name", ["study_ingest", "study_pivot", "study_wide", "study_inner"])
def test_items_are_not_broadcast(spark, name):
    """Millions of items look small to Spark; nothing but the registry is broadcast."""
    plan = catalog.queries()[name](spark, DATA)._jdf.queryExecution().sparkPlan().toString()
    assert "SortMergeJoin" in plan
    assert plan.count("BroadcastHashJoin") <= plan.count("BroadcastHashJoin [model_key")


def test_simex_draws_are_not_shuffled(spark):
    """the join by cluster is the only shuffle that the draws' rows come through; only sums by cell leave their task."""
    from gradus.operators import resampling

    seen = []
    keep = resampling.written

    def written(session, df, name):
        if name == "estimates":
            seen.append(df._jdf.queryExecution().executedPlan().toString())
        return keep(session, df, name)

    resampling.written = written
    try:
        catalog.queries()["simex_interval"](spark, DATA)
    finally:
        resampling.written = keep
    shuffles = [x for x in seen[0].split("Exchange hashpartitioning(")[1:]]
    assert not any("inner" in x.split(")")[0] and "cluster" in x.split(")")[0] for x in shuffles)


def test_torn_lines_of_several_files(spark, tmp_path):
    """the torn line is found behind many files, not by one task that sorts them."""
    from gradus.sources import files

    for i in range(3):
        (tmp_path / f"part-{i}").write_text('{"job_id": "x%d"}\n' % i * (3 + i) + ('{"job_id": "to' if i == 2 else ""))
    good, bad = files.read_torn(spark, str(tmp_path), "job")
    assert good.count() == 12 and [r.value for r in bad.collect()] == ['{"job_id": "to']
    assert files.repair_torn(spark, str(tmp_path), "job") == 1
    assert [r.value for r in spark.read.text(str(tmp_path)).collect()].count('{"job_id": "to') == 0


def test_categories_of_odd_texts(spark, tmp_path):
    """nulls, vertical tabs, line separators and letters beyond ASCII are read as in the SQL."""
    texts = [None, "", "\x0b", "X\x0bX", "X ", "X\x85", "inſert", "yesé", "no_", " X\n", "**yes"]
    spark.createDataFrame([(i, 0, "user", t) for i, t in enumerate(texts)], "conv_id bigint, turn int, role string, text string").coalesce(1).write.parquet(str(tmp_path / "conversations.parquet"))
    con = connect()
    con.execute(f"create or replace view conversations as select * from '{tmp_path}/conversations.parquet/*.parquet'")
    assert_same(catalog.queries()["failure_category"](spark, str(tmp_path)), catalog.oracle_sql()["failure_category"], con)


def test_texts_of_families_are_made_by_many_tasks(spark, monkeypatch):
    """a part's row group is one task; the texts of its families are several tasks' work."""
    from gradus.plans import study_queries

    monkeypatch.setattr(study_queries, "_SPREAD", 50)
    v = study_queries._variants(spark, DATA)
    assert v.count() == 4 * study_queries._families(spark, DATA).count()
    assert v.rdd.getNumPartitions() == 4


def test_items_are_joined_before_levels(spark):
    """texts are shuffled once, not once for each level."""
    plan = catalog.queries()["study_levels"](spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate explode([indifferent") < plan.index("Join LeftOuter")


def test_prompts_of_a_shard_need_no_join(spark):
    """the prompts keep the family's key, so nothing but the first 25 leaves a task."""
    plan = catalog.queries()["study_shard"](spark, DATA)._jdf.queryExecution().sparkPlan().toString()
    assert "Join" not in plan


def test_headers_of_several_files(spark, tmp_path):
    """a loose header does not need one file, and each file has it."""
    from gradus.sources import files

    rows = spark.range(100).selectExpr("cast(id as string) as a", "concat('x\n', id) as b").repartition(3)
    files.write_csv(rows, f"{tmp_path}/t", ["a", "b"], header=[" A", 'B, "b"'])
    written = list((tmp_path / "t").glob("part-*"))
    assert len(written) == 3 and all(p.read_bytes().startswith(b' A,"B, ""b"""\r\n') for p in written)
    got = files.read_aliased(spark, f"{tmp_path}/t", {"a": ["a"], "b": ["b b"]})
    assert sorted(r.a for r in got.select("a").collect()) == sorted(str(i) for i in range(100))
    files.write_csv(rows.limit(0), f"{tmp_path}/none", ["a", "b"], header=["a", "b"])
    assert files.read_aliased(spark, f"{tmp_path}/none", {"a": ["a"], "b": ["b"]}).count() == 0


def test_rows_of_a_file_do_not_gather(spark, tmp_path):
    """rows get their places without a shuffle by file."""
    from gradus.sources import files

    spark.range(100).selectExpr("id", "id as b").write.option("header", True).csv(f"{tmp_path}/t")
    plan = files.placed_csv(spark, f"{tmp_path}/t")._jdf.queryExecution().sparkPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_texts_that_are_not_cast(spark):
    """texts that can't be of a type are told by their look; no text that can be is."""
    from pyspark.sql import functions as F

    from gradus.sources import files

    texts = "|1|-1|+1| 1 |\t7\n|1.|.5|.|1.5|1e3|1E-3|1e|NaN|nan|inf|-Infinity|+INF|0x1p3|0X1.8P-2D|1d|1f|1.5F| 2d |١|\x7f3|true|TRUE| true|t|1996-01-02|1996-1-2|O|-|+|1_0|1,0|1 0|\x85".split("|")
    df = spark.createDataFrame([(t,) for t in [*texts, None]], "x string")
    for t in ("bigint", "double"):
        lost = df.filter(F.col("x").try_cast(t).isNotNull() & ~F.col("x").rlike(files._INFERRED[t]))
        assert lost.collect() == []
    assert not df.filter(F.col("x").isin("O", "1996-01-02", "true") & (F.col("x").rlike(files._INFERRED["double"]) | F.col("x").rlike(files._INFERRED["bigint"]))).count()


def test_clusters_are_not_sent_to_the_driver(spark, monkeypatch):
    """a table of clusters looks small by its file; rows for each cell are broadcast in its place."""
    from gradus.operators import profile, stats

    joins = []
    keep = profile.beside

    def beside(a, b, keys, few=False):
        out = keep(a, b, keys, few)
        if "cluster" in a.columns:
            joins.append(out._jdf.queryExecution().sparkPlan().toString())
        return out

    monkeypatch.setattr(profile, "beside", beside)
    rows = spark.range(60_000).selectExpr("id % 20000 as g", "case when id % 4 < 2 then 0.5 else -0.5 end as x", "cast(id % 11 as double) as y", "'m' as cell")
    assert profile.lmm_table(rows, "y ~ x", "x", ["cell"], "g").count() == 1
    assert joins and all("BroadcastHashJoin" in p and "BuildRight" in p and "BuildLeft" not in p for p in joins)

    sums = stats.sufficient(rows, stats.design("y ~ x"), ["cell"], "g")
    designs = stats.by_design(sums, ["cell"], 2, 1)
    assert sums.count() == 20_000 and designs.count() < 20 and designs.selectExpr("sum(g)").first()[0] == 20_000


@pytest.mark.parametrize("name", ["study_failures", "study_first", "study_remaining", "study_pilot"])
def test_rows_of_items_are_sorted_and_merged(spark, name):
    """what is broadcast is the registry, or a row for each model."""
    plan = catalog.queries()[name](spark, DATA)._jdf.queryExecution().sparkPlan().toString()
    assert "SortMergeJoin" in plan
    assert plan.count("BroadcastHashJoin") == plan.count("BroadcastHashJoin [model_key")
