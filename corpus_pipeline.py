"""A corpus pipeline of five stages over ``documents``; each stage is written before the next reads it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gradus.llm import decontaminate, jaccard, langid, mixing, pii
from gradus.llm.common import Workspace
from gradus.session import on_workers

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Near duplicates share at least 80 % of their five-word shingles.
SHINGLE_WORDS, SIMILARITY_PERCENT = 5, 80
#: Tiles are made in so many scans: at half as many an executor of 3000 MB holds too many of them while they are shuffled.
TILE_TURNS = 4
SURROGATE_KEY = "corpus-pipeline"


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised; those without letters, and those far from every language, go."""
    on_workers(spark)
    model = langid.fit(docs)
    return langid.identify(docs, model).filter("accepted").select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates; ids may repeat or be null (see ``jaccard.one_of_each``)."""
    on_workers(spark)
    return jaccard.one_of_each(docs.select(*COLUMNS), SHINGLE_WORDS, SIMILARITY_PERCENT, turns=TILE_TURNS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that benchmark items don't contaminate."""
    on_workers(spark)
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontaminate.decontaminate(docs, benchmark).filter("not contaminated").select(*COLUMNS)


def surrogates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with surrogates for personal data, and n_chars of the new text."""
    on_workers(spark)
    return pii.replace(docs, SURROGATE_KEY).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixed corpus: a row for each copy, with its epoch and its position in it."""
    on_workers(spark)
    return mixing.realise(mixing.mix(docs)).select(*COLUMNS, "n_tokens", "weight", "copies", "epoch", "position")


STAGES = [
    ("language_id", language_id),
    ("ngram_jaccard_join", near_duplicates),
    ("benchmark_decontamination", decontamination),
    ("pii_surrogates", surrogates),
    ("source_mixing", source_mixing),
]

#: Language identification is learnt, which SQL can't express; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows over all of ``documents``; each stage is written to the shared folder and read again."""
    work = Workspace(spark, "pipeline")
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        docs = work.save(stage(spark, docs, sf_dir), name)
        if before:
            work.drop(before)
        before = name
    return docs
