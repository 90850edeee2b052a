"""Record schemas as DDL, their keys, and rules over them."""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..session import shared_folder

# Columns of the records in file order.
VIGNETTE = "variant_id string, family_id string, domain string, valence string, nonmoral_subdomain string, sign string, typicality string, evocativeness string, scenario string, q_intentionality string, q_blame string, q_praise string"
RATINGS = ["moral_relevance", "severity", "vividness", "typicality_perception"]
RECORDS = {
    "family": "family_id string, domain string, valence string, nonmoral_subdomain string, agent string, goal string, common_action string, uncommon_action string, affected_entity string, low_evocative_outcome string, high_evocative_outcome string, outcome_verb string, generator_model string, ingest_date string, human_approved boolean",
    "vignette": VIGNETTE,
    "curated": VIGNETTE + "".join(f", {r} int, {r}_raw string" for r in RATINGS) + ", individual_flags string, pair_flag string, reviewer_model string, curation_date string, accepted boolean",
    "curation_raw": "variant_id string, field string, value int, ok boolean, raw string, reviewer_model string, timestamp double",
    "curation_log": "n_items bigint, n_calls bigint, n_failed bigint, mock boolean, input_tokens bigint, output_tokens bigint, wall_time_sec double",
    "prompt": "prompt_id string, variant_id string, question_type string, format string, text string, messages array<struct<role: string, content: string>>, sha256 string",
    "job": "job_id string, prompt_id string, model_key string, sample_idx int, temperature double, seed bigint",
    "result": "job_id string, prompt_id string, model_key string, sample_idx int, temperature double, seed bigint, raw_response string, parsed_rating double, parse_ok boolean, parse_method string, logprobs_0_10 array<double>, model_revision string, runner_version string, timestamp double",
    "power_grid": "contrast string, item_count int, n int, sim_batch int, n_sims int, n_significant int, n_converged int, n_convergence_failures int, n_fallback_used int, power double, effect_size double, frac_clipped double, seed bigint, timestamp double",
    "vector": "prompt_id string, layer int, vec array<float>",
    "probe": "construct string, layer int, split struct<train: array<string>, test: array<string>>, train_score double, test_score double",
    "ledger": "n_read bigint, n_included bigint, n_excluded bigint, n_missing bigint, entries array<struct<reason: string, count: bigint, examples: array<string>>>",
    "manifest": "files map<string, struct<sha256: string, rows: bigint>>, counts map<string, bigint>, gates_passed array<string>",
}
RECORDS["patch"] = RECORDS["result"] + ", patch struct<donor: string, layers: array<int>, positions: string>, scoring string"

VALENCES = ["MB", "MG", "NMB", "NMG", "NEU"]
NONMORAL = ["NMB", "NMG"]
SUBDOMAINS = ["aesthetic", "etiquette", "procedural", "prudential"]
SIGNS = {"MB": "bad", "NMB": "bad", "MG": "good", "NMG": "good", "NEU": "na"}
LETTERS = {("common", "low"): "A", ("common", "high"): "B", ("uncommon", "low"): "C", ("uncommon", "high"): "D"}


def schema(record: str) -> T.StructType:
    return T.StructType.fromDDL(RECORDS[record])


@dataclass(frozen=True)
class Rule:
    """A row breaks the rule where ``ok`` is false or null."""

    name: str
    ok: Column


def mapped(values: dict, key: Column, otherwise: object = None) -> Column:
    items = list(values.items())
    chain = reduce(lambda acc, kv: acc.when(key == kv[0], F.lit(kv[1])), items[1:], F.when(key == items[0][0], F.lit(items[0][1])))
    return chain.otherwise(F.lit(otherwise)) if otherwise is not None else chain


def vignette_rules() -> list[Rule]:
    letter = reduce(lambda acc, kv: acc.when((F.col("typicality") == kv[0][0]) & (F.col("evocativeness") == kv[0][1]), kv[1]), list(LETTERS.items())[1:], F.when((F.col("typicality") == "common") & (F.col("evocativeness") == "low"), "A"))
    return [
        Rule("valence", F.col("valence").isin(VALENCES)),
        Rule("variant_id", F.col("variant_id") == F.concat_ws("-", "family_id", letter)),
        Rule("sign", F.col("sign") == mapped(SIGNS, F.col("valence"))),
        Rule("subdomain", (F.coalesce("nonmoral_subdomain", F.lit("")) != "") == F.col("valence").isin(NONMORAL)),
    ]


def prompt_rules() -> list[Rule]:
    return [
        Rule("prompt_id", F.col("prompt_id") == F.concat_ws("::", "variant_id", "question_type", "format")),
        Rule("messages", F.col("messages").isNotNull() == (F.col("format") == "chat")),
    ]


def result_rules() -> list[Rule]:
    return [
        Rule("rating", F.coalesce(F.col("parsed_rating").between(0, 10), F.lit(True))),
        Rule("logprobs", F.coalesce(F.size("logprobs_0_10") == 11, F.lit(True)) | F.col("logprobs_0_10").isNull()),
    ]


def validate(df: DataFrame, rules: Sequence[Rule]) -> tuple[DataFrame, DataFrame]:
    """(rows that keep all rules, rows that don't with the array ``broken`` of rule names)."""
    broken = F.array_compact(F.array(*[F.when(~F.coalesce(r.ok, F.lit(False)), F.lit(r.name)) for r in rules]))
    marked = df.withColumn("broken", broken)
    return marked.filter(F.size("broken") == 0).drop("broken"), marked.filter(F.size("broken") > 0)


def require(df: DataFrame, rules: Sequence[Rule], ordinal: str | None = None, file: str | None = None) -> DataFrame:
    """df, or an error that names the first row that breaks a rule, and its file."""
    _, bad = validate(df, rules)
    order = [c for c in (file, ordinal) if c]
    first = (bad.orderBy(*order) if order else bad).limit(1).collect()
    if first:
        where = (f" in row {first[0][ordinal]}" if ordinal else "") + (f" of {first[0][file]}" if file else "")
        raise ValueError(f"broken rules{where}: {', '.join(first[0]['broken'])}")
    return df


def require_columns(columns: Sequence[str], record: str) -> None:
    """Unknown columns are an error, and so are missing ones."""
    known = schema(record).names
    if unknown := [c for c in columns if c not in known]:
        raise ValueError(f"unknown columns: {', '.join(unknown)}")
    if missing := [c for c in known if c not in columns]:
        raise ValueError(f"missing columns: {', '.join(missing)}")


def numbered(df: DataFrame, order_by: Sequence[str], name: str = "ordinal") -> DataFrame:
    """Dense ordinals from 0 without gathering rows in one task: rows are sorted in ranges, and counted range by range.

    The ranged rows are written with the number of their range, so that the
    rows that are counted are those that are numbered.
    """
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    at = f"{shared_folder(spark)}/numbered-{uuid.uuid4().hex}"
    # A fixed number of ranges, which the adaptive planner does not coalesce.
    df.repartitionByRange(parts, *order_by).withColumn("__p", F.spark_partition_id()).write.parquet(at)
    ranged = spark.read.parquet(at)
    counts = {r["__p"]: r["n"] for r in ranged.groupBy("__p").agg(F.count("*").alias("n")).collect()}
    start, total = {}, 0
    for p in sorted(counts):
        start[p], total = total, total + counts[p]
    offsets = spark.createDataFrame(list(start.items()) or [(0, 0)], "__p int, __start bigint")
    w = Window.partitionBy("__p").orderBy(*order_by)
    return ranged.join(F.broadcast(offsets), "__p").withColumn(name, F.row_number().over(w) - 1 + F.col("__start")).drop("__p", "__start")
