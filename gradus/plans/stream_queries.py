"""Streams, calls, releases and validated files as queries: what is written, stopped, resumed and read back equals SQL."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import files, schemas
from ..streaming import resume
from . import lifecycle
from .catalog import query, r6, table
from .study_queries import _VAR, _families, _place, _variants

_EVENTS = "event_id bigint, ts timestamp, user_id bigint, event_type string, value double"


def _arrivals(spark: SparkSession, d: str) -> list[DataFrame]:
    """Events in order of time, in three deliveries; every third is delivered again with the next."""
    e = table(spark, d, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type", "value")
    first, last = e.agg(F.min(F.unix_micros("ts")), F.max(F.unix_micros("ts"))).first()
    part = lambda k: e.filter(F.floor((F.unix_micros("ts") - first) * 3 / (last - first + 1)) == k)
    again = lambda k: part(k).filter("event_id % 3 = 0")
    return [part(0), part(1).unionAll(again(0)), part(2).unionAll(again(1)), again(2)]


@query("SELECT event_id, user_id, event_type, round(value, 6) AS value FROM events")
def stream_first_results(spark: SparkSession, d: str) -> DataFrame:
    """R-01, R-02, R-03: a stream that keeps the first of repeated rows, stopped after each delivery and resumed from its checkpoint."""
    source, sink, checkpoint = (_place(spark, n) for n in ("in", "out", "at"))
    for delivery in _arrivals(spark, d):
        delivery.write.mode("append").json(source)
        stream = resume.first_results(spark.readStream.schema(_EVENTS).json(source), "event_id", "ts", "40 days")
        resume.run_available(stream, resume.table_sink(sink), checkpoint).awaitTermination()
    return r6(spark.read.schema(f"{_EVENTS}, batch bigint").parquet(sink).select("event_id", "user_id", "event_type", "value"))


@query("SELECT event_type, count(*) AS n, round(avg(CASE WHEN value > 50 THEN 1.0 ELSE 0.0 END), 6) AS rate FROM (SELECT * FROM events UNION ALL SELECT * FROM events WHERE event_id % 3 = 0) GROUP BY 1")
def stream_rates(spark: SparkSession, d: str) -> DataFrame:
    """R-04: counts and rates of all deliveries, kept up to date across stops."""
    source, sink, checkpoint = (_place(spark, n) for n in ("in", "out", "at"))
    for delivery in _arrivals(spark, d):
        delivery.withColumn("ok", F.col("value") > 50).write.mode("append").json(source)
        stream = resume.parse_rates(spark.readStream.schema(f"{_EVENTS}, ok boolean").json(source), ["event_type"], "ok")
        resume.run_available(stream, resume.table_sink(sink), checkpoint, "update").awaitTermination()
    return r6(resume.latest(spark.read.schema("event_type string, n bigint, rate double, batch bigint").parquet(sink), ["event_type"]))


def _answered(part: pd.DataFrame) -> pd.DataFrame:
    """Stands for a service: its first answer to a request whose key is a multiple of 50 is an error."""
    for key in part["o_orderkey"]:
        if key % 50 == 0 and key not in _ASKED:
            _ASKED.add(key)
            raise resume.Transient(key)
    return pd.DataFrame({"o_orderkey": part["o_orderkey"], "answer": part["o_orderpriority"].str.lower() + "/" + part["o_custkey"].astype(str)})


_ASKED: set[int] = set()


@query("SELECT o_orderkey, lower(o_orderpriority) || '/' || o_custkey AS answer FROM orders")
def calls_retried(spark: SparkSession, d: str) -> DataFrame:
    """R-05: a call for each 64 orders, eight in flight in a task, those that fail made again."""
    o = table(spark, d, "orders").select("o_orderkey", "o_orderpriority", "o_custkey")
    return resume.called(o, _answered, "o_orderkey bigint, answer string", attempts=64, wait=0.0, rows=64)


@query(f"WITH {_VAR} SELECT valence, count(*) AS n, count(DISTINCT family_id) AS n_families, count(*) AS n_said FROM var GROUP BY 1")
def release_guarded(spark: SparkSession, d: str) -> DataFrame:
    """G-03, G-05: items released with hashes of all files, read back after these were checked, beside the manifest's counts."""
    at = _place(spark, "release")
    v = _variants(spark, d)
    families = _families(spark, d).withColumn("human_approved", F.lit(True))
    lifecycle.release(v, v.select("variant_id", F.lit(True).alias("accepted")), at, families=families, name="r1")
    items, (about, listed) = lifecycle.read_release(spark, at, "r1"), lifecycle.manifest_of(spark, at)
    if about["gates_passed"] != ["approved", "accepted"] or listed.agg(F.sum("rows")).first()[0] != about["rows"]:
        raise ValueError("the manifest does not say what was released")
    said = spark.createDataFrame([(k, n) for k, (n, _) in about["counts"].items()] or [], "valence string, n_said bigint")
    return items.groupBy("valence").agg(F.count("*").alias("n"), F.count_distinct("family_id").alias("n_families")).join(said, "valence").select("valence", "n", "n_families", "n_said")


@query(f"WITH {_VAR} SELECT variant_id, family_id, sign, scenario, q_blame FROM var")
def files_validated(spark: SparkSession, d: str) -> DataFrame:
    """S-01: items as CSV files with headers, read by schema and rules with every row's place known."""
    at = _place(spark, "checked.csv")
    _variants(spark, d).select(*schemas.schema("vignette").names).write.option("header", True).option("escape", '"').csv(at)
    return files.read_csv(spark, at, "vignette", schemas.vignette_rules()).select("variant_id", "family_id", "sign", "scenario", "q_blame")


@query("SELECT file_rows, CAST(n AS BIGINT) AS n FROM (SELECT 'rows' AS file_rows, count(*) AS n FROM orders UNION ALL SELECT 'distinct places', count(*) FROM orders UNION ALL SELECT 'past the end', 0)")
def files_placed(spark: SparkSession, d: str) -> DataFrame:
    """S-01: the places of rows of several CSV files are distinct and run from 2 to the file's number of rows and 1."""
    at = _place(spark, "placed.csv")
    table(spark, d, "orders").select("o_orderkey", "o_orderpriority").repartition(3).write.option("header", True).csv(at)
    p = files.placed_csv(spark, at, multi_line=False)
    ends = p.groupBy("file").agg(F.min("row").alias("a"), F.max("row").alias("b"), F.count("*").alias("n"))
    s = p.agg(F.count("*").alias("x"), F.count_distinct("file", "row").alias("y")).join(ends.agg(F.sum((~((F.col("a") == 2) & (F.col("b") == F.col("n") + 1))).cast("bigint")).alias("z")))
    return s.select(F.explode(F.create_map(F.lit("rows"), F.col("x"), F.lit("distinct places"), F.col("y"), F.lit("past the end"), F.col("z"))).alias("file_rows", "n"))


@query("SELECT o_orderkey, o_orderstatus, o_totalprice, strftime(o_orderdate, '%Y-%m-%d') AS day, o_orderkey % 2 = 0 AS even FROM orders")
def files_inferred(spark: SparkSession, d: str) -> DataFrame:
    """S-14: a table through CSV, its types found again from all values."""
    at = _place(spark, "inferred.csv")
    o = table(spark, d, "orders")
    o.select("o_orderkey", "o_orderstatus", "o_totalprice", F.col("o_orderdate").cast("date").alias("day"), (F.col("o_orderkey") % 2 == 0).alias("even")).write.option("header", True).option("maxRecordsPerFile", 200_000).csv(at)  # a file is read by one task
    found = files.read_inferred(spark, at)
    if [t for _, t in found.dtypes] != ["bigint", "string", "double", "date", "boolean"]:
        raise ValueError(f"other types: {found.dtypes}")
    return found.withColumn("day", F.col("day").cast("string"))


@query("SELECT CAST(o_orderkey AS VARCHAR) AS job_id, CAST(o_custkey AS VARCHAR) AS model_key FROM orders")
def files_gzipped(spark: SparkSession, d: str) -> DataFrame:
    """S-13: JSON lines in gzip files."""
    at = _place(spark, "zipped")
    o = table(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("job_id"), F.col("o_custkey").cast("string").alias("model_key"))
    o.write.option("compression", "gzip").json(at)
    return files.read_jsonl(spark, at, "job").select("job_id", "model_key")


@query("SELECT c_custkey, n FROM (SELECT c_custkey, CAST(row_number() OVER (ORDER BY c_acctbal DESC, c_custkey) - 1 AS BIGINT) AS n FROM customer)")
def sorted_by_value(spark: SparkSession, d: str) -> DataFrame:
    """X-10: customers by balance, the greatest first, and their places in that order."""
    c = files.ordered(table(spark, d, "customer").select("c_custkey", (-F.col("c_acctbal")).alias("less")), ["less"], ["c_custkey"])
    return schemas.numbered(c, ["less", "c_custkey"], "n").select("c_custkey", "n")


@query("SELECT 'c' AS kind, c_custkey AS id FROM customer UNION ALL SELECT 's', s_suppkey FROM supplier UNION ALL SELECT 's', s_suppkey FROM supplier WHERE s_suppkey % 2 = 0")
def appended(spark: SparkSession, d: str) -> DataFrame:
    """X-18: rows added to a stored table, twice, and what it then holds."""
    at = _place(spark, "appended")
    c, s = table(spark, d, "customer"), table(spark, d, "supplier").select(F.lit("s").alias("kind"), F.col("s_suppkey").alias("id"))
    c.select(F.lit("c").alias("kind"), F.col("c_custkey").alias("id")).write.parquet(at)
    s.write.mode("append").parquet(at)
    s.filter("id % 2 = 0").write.mode("append").parquet(at)
    return spark.read.parquet(at)
