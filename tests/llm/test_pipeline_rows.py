"""The pipeline's stages on repeated and null ids, nulls in any column, empty tables and clashing columns."""

import re
from collections import Counter

import numpy as np
import pytest
from gradus.llm import jaccard
from pyspark.sql import functions as F

import corpus_pipeline

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(rng, n):
    return [f"w{rng.integers(0, 10**6)}" for _ in range(n)]


def rows_of(df):
    return sorted(map(repr, (tuple(r) for r in df.collect())))


def test_one_row_of_each_class_stays(spark):
    rng = np.random.default_rng(1)
    a, b, c = (" ".join(words(rng, 60)) for _ in range(3))
    near = a.rsplit(" ", 1)[0] + " other"
    given = [(1, a), (2, a), (2, b), (3, c), (3, c), (None, a), (9, near), (5, None), (5, None), (6, ""), (None, "  "), (None, "  ")]
    df = spark.createDataFrame([(i, t, None, "s", None) for i, t in given], SCHEMA).repartition(3)
    got = Counter((r.doc_id, r.text) for r in corpus_pipeline.near_duplicates(spark, df, "").collect())
    assert got == Counter([(1, a), (2, b), (3, c), (5, None), (5, None), (6, ""), (None, "  "), (None, "  ")])


def test_null_ids_alone_are_one_class_too(spark):
    text = "one two three four five six seven"
    df = spark.createDataFrame([(None, text, "en", "s", 1), (None, text, "en", "t", 1), (None, text, "en", "t", 1)], SCHEMA)
    assert corpus_pipeline.near_duplicates(spark, df, "").count() == 1


def test_stage_against_all_pairs(spark):
    """No text without a duplicate goes, and no two kept texts are near each other."""
    rng = np.random.default_rng(4)
    texts = []
    for _ in range(15):
        base = words(rng, int(rng.integers(8, 90)))
        for _ in range(int(rng.integers(1, 6))):
            own = list(base)
            for _ in range(int(rng.integers(0, 3))):
                own[rng.integers(0, len(own))] = "x"
            texts.append(" ".join(own))
    ids = [int(rng.integers(0, 20)) if rng.random() < 0.8 else None for _ in texts]
    df = spark.createDataFrame([(i, t, None, None, k) for k, (i, t) in enumerate(zip(ids, texts, strict=True))], SCHEMA)
    kept = {r.n_chars for r in corpus_pipeline.near_duplicates(spark, df, "").collect()}
    sets = [(lambda w: frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))))(t.split()) for t in texts]
    near = lambda a, b: 100 * len(a & b) >= 80 * len(a | b)
    group = list(range(len(texts)))

    def find(x):
        while group[x] != x:
            x = group[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            if near(sets[i], sets[j]):
                group[find(i)] = find(j)
    found = Counter(find(i) for i in kept)
    assert set(found) == {find(i) for i in range(len(texts))} and set(found.values()) == {1}


def test_unrelated_sets_share_no_tile():
    rng = np.random.default_rng(0)
    for percent in (60, 80, 90):
        for n in (5, 20, 120, 400, 2000):
            sets = [np.sort(rng.integers(0, 2**64, n, dtype=np.uint64)) for _ in range(40)]
            keys = [set(jaccard._segments(s, percent).tolist()) for s in sets]
            assert sum(map(len, keys)) == len(set().union(*keys))


@pytest.mark.parametrize("percent", [60, 80, 90])
def test_linked_sets_share_a_tile(percent):
    rng = np.random.default_rng(percent)
    for n in (2, 3, 5, 8, 13, 40, 150, 700):
        for _ in range(60):
            a = np.sort(rng.integers(0, 2**64, n, dtype=np.uint64))
            out = int(rng.integers(0, n + 1))
            into = int(rng.integers(0, n + 1))
            b = np.sort(np.concatenate([rng.choice(a, n - out, replace=False), rng.integers(0, 2**64, into, dtype=np.uint64)]))
            if len(b) and len(a) != len(b) and 100 * (n - out) >= percent * (n + into):
                assert set(jaccard._segments(a, percent).tolist()) & set(jaccard._segments(b, percent).tolist())
            if len(b) == n and 0 < out and 100 * (n - out) >= percent * (n + out):
                assert set(jaccard._segments(a, percent).tolist()) & set(jaccard._segments(b, percent).tolist())


@pytest.mark.parametrize("stage", corpus_pipeline.STAGES, ids=[n for n, _ in corpus_pipeline.STAGES])
def test_odd_rows_in_every_stage(spark, stage, tmp_path):
    """Nulls, repeated ids, clashing and further columns; empty tables."""
    name, f = stage
    folder = str(tmp_path)
    spark.createDataFrame([(1, "one two three"), (None, None)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    long = " ".join(f"wort{i}" for i in range(30_000))
    rows = [(None, None, None, None, None), (1, "", "en", "s", 0), (1, "!!! 1 2", "en", None, 5), (2, long, "de", "s", 1), (2, "the people of this land speak of it", "en", "s", 1), (3, "die Leute in diesem Land sprechen davon", "de", "", 1), (None, "der Mann und die Frau in dem Haus", "de", "t", None)]
    plain = spark.createDataFrame(rows, SCHEMA)
    wide = plain.withColumns({"n_words": F.lit("x"), "SCORE": F.lit(1), "weight": F.lit(None).cast("string"), "component_id": F.lit(7), "items": F.lit("y")})
    got = f(spark, wide, folder)
    kept = got.columns if name == "source_mixing" else corpus_pipeline.COLUMNS
    assert got.columns[:5] == corpus_pipeline.COLUMNS and got.columns == kept
    assert {(r.doc_id, r.source) for r in got.collect()} <= {(r[0], r[3]) for r in rows}
    if name in ("ngram_jaccard_join", "benchmark_decontamination", "pii_surrogates"):
        assert got.count() == len(rows)
    if name == "language_id":
        assert {r.text for r in got.collect()} >= {r[1] for r in rows if r[1] and re.search("[a-z]{3}", r[1])}
    assert rows_of(f(spark, plain, folder)) == rows_of(got)
    assert f(spark, plain.limit(0), folder).count() == 0


def test_surrogates_hold_few_texts(spark, monkeypatch):
    """The pipeline's check of round 3: of a batch only some texts are Python strings at a time, and none is lost."""
    import pyarrow as pa
    from pyspark.sql import types as T

    from gradus.llm import common, pii

    docs = spark.range(0, 1000, 1, 1).selectExpr("id as doc_id", "concat('write to user', id, '@mail', id, '.com') as text")
    seen, keep = [], pii.map_rows
    monkeypatch.setattr(pii, "map_rows", lambda *a: seen.append(a[4]) or keep(*a))
    for most in (pii.MAX_REDRAWN, -1):  # broadcast, joined
        out = pii.replace(docs, "k", most=most).join(docs.withColumnRenamed("text", "said"), "doc_id")
        assert out.agg(F.count("*"), F.count_distinct("text"), F.sum("n_entities")).first()[:] == (1000, 1000, 1000)
        assert out.filter("text = said").isEmpty()
    assert seen == [pii.TEXTS, pii.TEXTS]
    rows = lambda at: common.map_rows(docs, ["text"], [("n", T.LongType())], lambda: lambda c: [pa.array([len(c)] * len(c), pa.int64())], at)
    assert rows(100).agg(F.max("n"), F.count("*")).first()[:] == (100, 1000) and rows(None).agg(F.max("n")).first()[0] > 100
