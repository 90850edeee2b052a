"""Streams that stop, calls in flight, releases with manifests, and the places of bad rows."""

import time

import pandas as pd
import pytest
from pyspark.sql import functions as F

from gradus.operators import routing
from gradus.plans import lifecycle
from gradus.sources import files, schemas
from gradus.streaming import resume


def test_a_batch_that_fails_is_written_once(spark, tmp_path):
    src, out, at = (f"{tmp_path}/{n}" for n in ("in", "out", "at"))
    events = lambda a, b: spark.range(a, b).select(F.col("id").alias("k"), F.timestamp_seconds(F.col("id") + 1000).alias("ts"))
    kept, failed = resume.table_sink(out), []

    def torn(batch, number):
        kept(batch, number)
        if number == 1 and not failed:
            failed.append(number)
            raise OSError("lost after its rows were written")

    def go():
        stream = resume.first_results(spark.readStream.schema("k bigint, ts timestamp").json(src), "k", "ts", "1 hour")
        resume.run_available(stream, torn, at).awaitTermination()

    events(0, 10).write.mode("append").json(src)
    go()
    events(5, 20).write.mode("append").json(src)
    with pytest.raises(Exception, match="lost after"):
        go()
    go()
    events(15, 30).write.mode("append").json(src)
    go()
    assert failed == [1]
    assert sorted(r.k for r in spark.read.parquet(out).collect()) == list(range(30))


def test_state_goes_with_the_watermark(spark, tmp_path):
    src, out, at = (f"{tmp_path}/{n}" for n in ("in", "out", "at"))
    rows = lambda *pairs: spark.createDataFrame(list(pairs), "k bigint, s bigint").select("k", F.timestamp_seconds("s").alias("ts"))
    for delivery in ([(1, 100), (2, 110)], [(3, 9_000)], [(1, 150), (4, 9_100), (3, 9_200)]):
        rows(*delivery).write.mode("append").json(src)
        resume.run_available(resume.first_results(spark.readStream.schema("k bigint, ts timestamp").json(src), "k", "ts", "10 minutes"), resume.table_sink(out), at).awaitTermination()
    # The late row of 1 is too old for the watermark, and 3 was seen: neither comes again.
    assert sorted(r.k for r in spark.read.parquet(out).collect()) == [1, 2, 3, 4]


def test_latest_rows_of_an_update(spark):
    t = spark.createDataFrame([("a", 1, 0), ("a", 5, 2), ("b", 2, 1), (None, 3, 0)], "k string, n long, batch long")
    assert {(r.k, r.n) for r in resume.latest(t, ["k"]).collect()} == {("a", 5), ("b", 2), (None, 3)}


def test_calls_in_flight_are_bounded(spark):
    flying: list[int] = []

    def call(part: pd.DataFrame) -> pd.DataFrame:
        flying.append(1)
        high = len(flying)
        time.sleep(0.02)
        flying.pop()
        return part.assign(high=high)

    start = time.monotonic()
    got = resume.called(spark.range(60).coalesce(1), call, "id long, high long", limit=5).toPandas()
    assert sorted(got["id"]) == list(range(60)) and got["high"].max() == 5
    assert time.monotonic() - start < 60 * 0.02 + 5
    assert resume.called(spark.range(7).coalesce(1), lambda p: p, "id long", limit=3, rows=4).count() == 7
    assert resume.called(spark.range(0), lambda p: p, "id long").count() == 0


def test_errors_that_do_not_pass_end_the_task(spark):
    def wrong(part):
        raise KeyError("no such thing")

    def busy(part):
        raise resume.Transient("busy")

    for call in (wrong, busy):
        with pytest.raises(Exception, match="no such thing|busy"):
            resume.called(spark.range(2).coalesce(1), call, "id long", attempts=2, wait=0.0).collect()


@pytest.fixture(scope="module")
def items(spark):
    rows = [(f"ENV-{v}-{i:02d}", "ENV", v, "prudential" if v in schemas.NONMORAL else "", "The mayor", f"win {i}", "acted", "danced", "town", "low thing", "high thing there", "harm it", None, None, i != 1) for v in schemas.VALENCES for i in range(3)]
    families = spark.createDataFrame(rows, schemas.schema("family"))
    return families, routing.build_variants(families).cache()


def test_release_is_whole_or_not_there(spark, items, tmp_path):
    families, variants = items
    curated = variants.select("variant_id", F.lit(True).alias("accepted"))
    at = f"{tmp_path}/v1"
    with pytest.raises(ValueError, match="5 families without approval"):
        lifecycle.release(variants, curated, at, families=families)
    assert list(tmp_path.iterdir()) == []
    about = lifecycle.release(variants, curated, at, families=families, force=True, name="v1", changelog="first", rows_per_file=7)
    assert about["gates_passed"] == ["accepted"] and about["rows"] == 60 and about["counts"]["MB"] == (12, 3)
    said, listed = lifecycle.manifest_of(spark, at)
    assert said["release"] == "v1" and said["changelog"] == "first"
    assert listed.agg(F.sum("rows")).first()[0] == 60 and listed.filter("rows > 7").count() == 0
    assert lifecycle.read_release(spark, at, "v1").count() == 60
    with pytest.raises(FileExistsError):
        lifecycle.release(variants, curated, at, families=families, force=True)
    assert [p.name for p in tmp_path.iterdir()] == ["v1"]
    with pytest.raises(ValueError, match="'v1', not 'v2'"):
        lifecycle.read_release(spark, at, "v2")
    with pytest.raises(ValueError, match="no manifest"):
        lifecycle.read_release(spark, f"{tmp_path}/none")


@pytest.mark.parametrize("harm", ["change", "remove"])
def test_release_that_was_touched_is_refused(spark, items, tmp_path, harm):
    _, variants = items
    lifecycle.release(variants, variants.select("variant_id", F.lit(True).alias("accepted")), f"{tmp_path}/r", rows_per_file=20)
    file = sorted((tmp_path / "r" / "items").glob("part-*"))[0]
    if harm == "change":
        file.write_bytes(file.read_bytes()[:-1] + b"\0")
        (file.parent / f".{file.name}.crc").unlink()  # else the store itself finds it
    else:
        file.unlink()
    with pytest.raises(ValueError, match=file.name):
        lifecycle.read_release(spark, f"{tmp_path}/r")


def _csv(tmp_path, name, items, change):
    names = schemas.schema("vignette").names
    rows = [[("" if v is None else str(v)) for v in r] for r in items[1].orderBy("variant_id").select(*names).collect()]
    change(names, rows)
    quote = lambda x: '"' + x.replace('"', '""') + '"' if any(c in x for c in ',"\n') else x
    (tmp_path / name).write_text("\n".join(",".join(map(quote, r)) for r in [names, *rows]) + "\n")
    return f"{tmp_path}/{name}"


def test_bad_rows_are_named(spark, items, tmp_path):
    def sign(names, rows):
        rows[3][names.index("scenario")] = 'two\nlines, "quoted"'
        rows[17][names.index("sign")] = "neither"
        rows[30][names.index("valence")] = "XX"

    path = _csv(tmp_path, "a.csv", items, sign)
    with pytest.raises(ValueError, match=r"row 19 of .*a\.csv: sign"):
        files.read_csv(spark, path, "vignette", schemas.vignette_rules())
    good = _csv(tmp_path, "b.csv", items, lambda names, rows: rows[3].__setitem__(names.index("scenario"), "two\nlines"))
    assert files.read_csv(spark, good, "vignette", schemas.vignette_rules()).count() == 60


def test_places_do_not_depend_on_splits(spark, tmp_path):
    (tmp_path / "n").mkdir()
    for k in range(2):
        (tmp_path / "n" / f"{k}.csv").write_text("x,y\n" + "".join(f"{k}-{i},{'v' * 40}\n" for i in range(4000)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16384")
    try:
        got = files.placed_csv(spark, f"{tmp_path}/n", multi_line=False)
        assert got.rdd.getNumPartitions() > 2
        assert got.filter(F.col("x") != F.concat(F.regexp_extract("file", r"(\d)\.csv$", 1), F.lit("-"), (F.col("row") - 2).cast("string"))).count() == 0
        assert got.count() == 8000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_values_that_do_not_fit_are_named(spark, tmp_path):
    kind = schemas.schema("curation_raw")
    names = kind.names
    rows = {f.name: {"int": "3", "bigint": "3", "double": "1.5", "boolean": "true"}.get(f.dataType.simpleString(), "x") for f in kind.fields}
    number = next(f.name for f in kind.fields if f.dataType.simpleString() in ("int", "double", "bigint"))
    lines = [",".join(rows[n] for n in names)] * 2 + [",".join("oops" if n == number else rows[n] for n in names)]
    (tmp_path / "c.csv").write_text("\n".join([",".join(names), *lines]) + "\n")
    with pytest.raises(ValueError, match=f"row 4 of .*: value of {number}"):
        files.read_csv(spark, f"{tmp_path}/c.csv", "curation_raw")


def test_types_come_from_all_values(spark, tmp_path):
    (tmp_path / "t.csv").write_text("a,b,c,d,e,f,g\n" + "1,1,true,2024-01-01,2024-01-01 10:00:00,,x\n" * 50 + "2,1.5,FALSE,2024-02-30,2024-01-01T10:00:00,,1\n")
    got = files.read_inferred(spark, f"{tmp_path}/t.csv")
    assert dict(got.dtypes) == {"a": "bigint", "b": "double", "c": "boolean", "d": "string", "e": "timestamp", "f": "string", "g": "string"}
    assert got.count() == 51 and got.agg(F.sum("b")).first()[0] == 51.5
    (tmp_path / "e.csv").write_text("")
    assert files.read_inferred(spark, f"{tmp_path}/e.csv").count() == 0


def test_prompts_of_next_sets(spark):
    row = "k int, family_id string, domain string, agent string, goal string, nonmoral_subdomain string, human_approved boolean"
    rows = [(1, "A-MB-02-r3", "A", "The cook", "sell", "", True), (2, "A-NMB-02", "A", "The boss", "buy", "aesthetic", True), (3, "A-MB-10", "A", None, "run", None, None), (4, "A-other", "A", "x", "y", "aesthetic", True)]
    rows += [(10 + i, f"B-MB-0{i}", "B", "b", "g", "procedural", True) for i in range(1, 6)]
    families, domains = spark.createDataFrame(rows, row), spark.createDataFrame([("A",), ("B",), ("C",)], "domain string")
    ask = lambda **more: {r.domain: r for r in lifecycle.next_prompts(families, domains, "{domain}{set_number}\n{tracking_log}", "k", "\n{target}: {tally}", **more).collect()}
    got = ask()
    steer = "\netiquette: aesthetic=2, etiquette=0, procedural=5, prudential=0"
    assert got["A"].prompt == 'A11\n  - Set 02: agent = "The cook"; goal = "sell" [subdomain: aesthetic]\n  - Set 10: agent = ""; goal = "run"' + steer
    assert got["B"].at_cap and got["B"].prompt is None and (got["C"].set_number, got["C"].prompt) == (1, "C01\n(none yet)" + steer)
    assert ask(allow_extra=True)["B"].prompt.startswith("B06\n  - Set 01") and ask(most=2)["A"].prompt is None
    assert ask(most=9)["B"].at_cap is False
    nobody = lifecycle.next_prompts(families.limit(0), domains, "{domain}", "k").collect()
    assert sorted(r.prompt for r in nobody) == ["A", "B", "C"]


def test_review_prompt_is_its_lines(spark):
    families = spark.createDataFrame([(2, "A-MB-01", "A", 'say "no", now', True), (1, "A-MG-01", "A", None, None), (3, "B-MB-07", "B", "two\nlines", False)], "k int, family_id string, domain string, goal string, human_approved boolean")
    lines = lifecycle.qa_prompt_lines(families, "{domain}: {n_sets}, {n_families}{matrix_csv}done", ["family_id", "goal", "human_approved"], "k")
    text = "\n".join(r.line for r in lines.filter("domain = 'A'").orderBy("part", "at").collect())
    assert text == 'A: 1, 2\nfamily_id,goal,human_approved\nA-MG-01,,\nA-MB-01,"say ""no"", now",True\ndone'
    assert [r.line for r in lines.filter("domain = 'B' and part = 2").collect()] == ['B-MB-07,"two\nlines",False']
    assert lifecycle.qa_prompt_lines(families.limit(0), "{matrix_csv}", ["goal"], "k").count() == 0


def test_dashboard(spark):
    row = "family_id string, domain string, valence string, agent string, nonmoral_subdomain string, human_approved boolean"
    rows = [("A-MB-01", "A", "MB", "The cook", None, True), ("A-NMB-01", "A", "NMB", "The cook", "aesthetic", True), ("A-MB-02-r2", "A", "MB", "The cook", "", None), ("odd", None, "??", "Ann", "etiquette", False), ("B-MB-01", "B", "MB", None, "", True)]
    got = {(r.section, r.domain, r.name): r.n for r in lifecycle.dashboard(spark.createDataFrame(rows, row)).collect()}
    assert got[("total", "", "families")] == 5 and got[("grid", "A", "MB")] == 2 and got[("grid", "?", "MB")] == 0
    assert [got[("sets", x, "sets")] for x in "AB?"] == [2, 1, 0]
    assert got[("approved", "", "aesthetic")] == 1 and got[("pending", "", "etiquette")] == 1 and got[("steer", "", "etiquette")] == 0
    assert {k[1:] for k in got if k[0] == "backlog"} == {("A", "A-MB-02-r2"), ("?", "odd")}
    assert got[("agents", "", "role")] == 2 and got[("agents", "", "name")] == 1
    assert {k[1:]: n for k, n in got.items() if k[0] == "repeated"} == {("A", "The cook"): 2}
    empty = lifecycle.dashboard(spark.createDataFrame([], row)).collect()
    assert {r.section for r in empty} == {"total", "approved", "pending"} and not any(r.n for r in empty)


def test_summary_lines(spark):
    results = spark.createDataFrame([(1, None), (2, "refused"), (3, "refused"), (4, "empty")], "k int, drop_reason string")
    tests = spark.createDataFrame([("b", "m", "rq2", 0.25, 0.5, 0.5, False), ("a", "m", "rq1", -1.5, 0.001, None, None)], "contrast string, model_family string, rq string, estimate double, p_value double, p_holm double, confirmed boolean")
    text = [r.line for r in lifecycle.summary_lines(results, tests).orderBy("section", "topic", "part", "at").collect()]
    head = "| contrast | model_family | estimate | p | p(Holm) | confirmed |"
    assert text == ["Of 4 result rows read, 1 were included and 3 excluded.", "| empty | 1 |", "| refused | 2 |", "### rq1", head, "| a | m | -1.500 | 0.0010 | - | - |", "### rq2", head, "| b | m | 0.250 | 0.5000 | 0.5000 | false |"]
    assert [r.line for r in lifecycle.summary_lines(results.limit(0), tests.limit(0)).orderBy("section").collect()] == ["Of 0 result rows read, 0 were included and 0 excluded.", "No contrast could be estimated."]
