"""Readers and writers; ``S-`` numbers are those of the survey."""

from __future__ import annotations

import json
from collections.abc import Sequence
from itertools import chain
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions.text import fixed, normalise_header
from ..session import written
from . import schemas
from .storage import Store


def placed_csv(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Cells of CSV with a header as text, with ``file`` and ``row``: the header is row 1, each file is counted by itself.

    Rows are counted in the splits that tasks read and their offsets added, so
    files without line ends in their cells (``multi_line`` false) are read by
    many tasks.  What is counted is written first, so it is what is numbered.
    """
    raw = spark.read.option("header", True).option("multiLine", multi_line).option("escape", '"').option("inferSchema", False).csv(path)
    rows = raw.select("*", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("__start"), F.monotonically_increasing_id().alias("__at"))
    rows = written(spark, rows, "csv")
    splits = rows.groupBy("file", "__start").agg(F.min("__at").alias("__first"), F.count("*").alias("__n"))
    before = Window.partitionBy("file").orderBy("__start").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.select("file", "__start", (F.coalesce(F.sum("__n").over(before), F.lit(0)) - F.col("__first") + 2).alias("__shift"))
    # A row for each split; rows of a file don't gather in one task.
    return rows.join(F.broadcast(splits), ["file", "__start"]).withColumn("row", F.col("__at") + F.col("__shift")).select("file", "row", *raw.columns)


def read_csv(spark: SparkSession, path: str, record: str, rules: Sequence[schemas.Rule] = (), multi_line: bool = True) -> DataFrame:
    """S-01: strict CSV with a header; other columns, bad values and broken rules are errors, which name the first such row and its file."""
    kind = schemas.schema(record)
    placed = placed_csv(spark, path, multi_line)
    if len(placed.columns) == 2:
        return spark.createDataFrame([], kind)
    schemas.require_columns(placed.columns[2:], record)
    typed = placed.select("file", "row", *[F.col(f.name).try_cast(f.dataType).alias(f.name) for f in kind.fields], *[(F.col(f.name).isNotNull() & F.col(f.name).try_cast(f.dataType).isNull()).alias(f"__bad_{f.name}") for f in kind.fields])
    values = [schemas.Rule(f"value of {f.name}", ~F.col(f"__bad_{f.name}")) for f in kind.fields]
    schemas.require(typed, [*values, *rules], "row", "file")
    return typed.select(*kind.names)


#: Types that are tried, and what texts of them look like at least: a cast that fails inside is dear, so other texts aren't cast.
_EDGE = r"[\x00-\x20\x7f]*"
_INFERRED = {
    "bigint": rf"^{_EDGE}[-+]?[0-9]+{_EDGE}$",
    "double": rf"(?i)^{_EDGE}[-+]?(nan|inf|infinity|0x[0-9a-f.]+p[-+]?[0-9]+|[0-9.]+(e[-+]?[0-9]+)?)[fd]?{_EDGE}$",
    "boolean": "(?i)^(true|false)$",
    "date": r"^\d{4}-\d\d-\d\d$",
    "timestamp": r"^\d{4}-\d\d-\d\d[ T]\d\d:\d\d(:\d\d(\.\d+)?)?$",
}


def read_inferred(spark: SparkSession, path: str, kind: str = "csv") -> DataFrame:
    """S-14: CSV with a header, or JSON lines, each column of the first type that all its values have.

    Types are tried in one aggregation over all rows, a flag for each column and
    type, so none is guessed from a sample; what no type fits, and columns
    without values, stay text.  Dates and times are in ISO form.
    """
    if kind == "json":
        return spark.read.option("samplingRatio", 1.0).json(path)
    raw = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    if not raw.columns:
        return raw
    fits = lambda c, t: F.when(F.col(f"`{c}`").rlike(_INFERRED[t]), F.col(f"`{c}`").try_cast(t)).isNotNull()
    seen = raw.agg(*[F.every(F.col(f"`{c}`").isNull() | fits(c, t)).alias(f"{i}_{t}") for i, c in enumerate(raw.columns) for t in _INFERRED], *[F.count(F.col(f"`{c}`")).alias(f"{i}_n") for i, c in enumerate(raw.columns)]).first()
    types = [next((t for t in _INFERRED if seen[f"{i}_n"] and seen[f"{i}_{t}"]), "string") for i in range(len(raw.columns))]
    return raw.select(*[F.col(f"`{c}`").cast(t).alias(c) for c, t in zip(raw.columns, types, strict=True)])


def as_text(df: DataFrame) -> DataFrame:
    """Cells as written to CSV: null is blank, booleans are True and False."""
    cell = lambda c, t: F.when(F.col(c), "True").otherwise(F.when(F.col(c).isNotNull(), "False").otherwise("")) if isinstance(t, T.BooleanType) else F.coalesce(F.col(c).cast("string"), F.lit(""))
    return df.select(*[cell(f.name, f.dataType).alias(f.name) for f in df.schema.fields])


def write_csv(df: DataFrame, path: str, columns: Sequence[str], line_end: str = "\r\n", header: Sequence[str] | None = None) -> None:
    """S-02: pinned columns; ``line_end`` as csv modules write it, and ``header``, if given, as the first line of each file."""
    rows = as_text(df.select(*columns))
    quoted = [F.when(F.regexp_like(c, F.lit('[",\r\n]')), F.concat(F.lit('"'), F.replace(F.col(c), F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(F.col(c)) for c in columns]
    lines = rows.select(F.concat_ws(",", *quoted).alias("value"))
    if header is not None:
        quote = lambda x: '"' + x.replace('"', '""') + '"' if any(c in x for c in ',"\r\n') else x
        first = pa.array([",".join(quote(x) for x in header)])
        # A task writes a file.
        lines = lines.mapInArrow(lambda batches: (pa.RecordBatch.from_arrays([x], ["value"]) for x in chain([first], (b.column(0) for b in batches))), "value string")
    lines.write.mode("overwrite").option("lineSep", line_end).text(path)


def read_jsonl(spark: SparkSession, path: str | Sequence[str], record: str, rules: Sequence[schemas.Rule] = ()) -> DataFrame:
    """S-03, S-11, S-13: JSON lines, one or more paths, gzipped or not; blank lines are skipped, bad ones are errors."""
    paths = [path] if isinstance(path, str) else list(path)
    df = spark.read.schema(schemas.schema(record)).option("mode", "FAILFAST").option("lineSep", "\n").json(paths)
    return schemas.require(df, rules) if rules else df


def append_jsonl(df: DataFrame, path: str) -> None:
    """S-04."""
    df.write.mode("append").json(path)


def write_jsonl(df: DataFrame, path: str, ordinal: str) -> None:
    """S-05: in order of the ordinal over all files."""
    df.repartitionByRange(ordinal).sortWithinPartitions(ordinal).drop(ordinal).write.mode("overwrite").json(path)


def read_aliased(spark: SparkSession, path: str, aliases: dict[str, list[str]]) -> DataFrame:
    """S-06: CSV with loose headers; unknown columns go, cells are trimmed, blank rows go.  XLSX is read on the driver."""
    if path.endswith((".xlsx", ".xls")):
        import pandas as pd

        raw = spark.createDataFrame(pd.read_excel(path, dtype=str).astype(object).where(lambda x: x.notna(), None))
    else:
        raw = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    known = [(c, f) for c in raw.columns if (f := normalise_header(c, aliases))]
    df = raw.select(*[F.coalesce(F.trim(F.col(f"`{c}`")), F.lit("")).alias(f) for c, f in known])
    return df.filter(F.concat(*[F.col(f) for _, f in known]) != "") if known else df


def with_provenance(df: DataFrame, approved_if_missing: bool) -> DataFrame:
    """S-07, G-04: provenance columns that older tables lack; who has no approval column decides what it means."""
    for name in ("generator_model", "ingest_date"):
        if name not in df.columns:
            df = df.withColumn(name, F.lit(None).cast("string"))
    if "human_approved" not in df.columns:
        df = df.withColumn("human_approved", F.lit(approved_if_missing))
    return df


def rewrite(df: DataFrame, path: str) -> None:
    """S-08, S-22: overwrite what df itself may read: write beside it, then rename."""
    store = Store(df.sparkSession, path)
    df.write.mode("overwrite").parquet(path + ".next")
    store.replace(path + ".next", path)


def read_if_there(spark: SparkSession, path: str, record: str, kind: str = "json") -> DataFrame:
    """S-09: no rows if the path is missing or empty."""
    store = Store(spark, path)
    if not store.exists(path) or store.size(path) == 0:
        return spark.createDataFrame([], schemas.schema(record))
    return spark.read.schema(schemas.schema(record)).format(kind).load(path)


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """(value, at): lines of a file, or of a folder's files in order of their names; ``at`` sorts as they stand."""
    raw = spark.read.option("lineSep", "\n").text(path)
    return raw.select("value", F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("line")).alias("at"))


def read_torn(spark: SparkSession, path: str, record: str) -> tuple[DataFrame, DataFrame]:
    """S-10: JSON lines of a file, or of files in order of their names, whose last line may be torn.

    (good rows, the torn line if any); a bad line before the last is an error.
    Only a line feed ends a line.
    """
    kind = schemas.schema(record)
    full = T.StructType([*kind.fields, T.StructField("__bad", T.StringType())])
    lines = _lines(spark, path).filter(F.trim("value") != "")
    read = lines.withColumn("r", F.from_json("value", full, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "__bad"}))
    bad = read.filter(F.col("r.__bad").isNotNull())
    last = lines.agg(F.max("at")).first()[0]
    earlier = bad.filter(F.col("at") != _place(last)).select(F.substring("value", 1, 80)).limit(1).collect() if last is not None else []
    if earlier:
        raise ValueError(f"a bad line that is not the last: {earlier[0][0]}")
    good = read.filter(F.col("r.__bad").isNull()).select(*[F.col(f"r.{f.name}") for f in kind.fields])
    return good, bad.select("value")


def _place(at) -> Column:
    """A line's place as a literal."""
    return F.struct(F.lit(at["file"]).alias("file"), F.lit(at["start"]).cast("bigint").alias("start"), F.lit(at["line"]).cast("bigint").alias("line"))


def repair_torn(spark: SparkSession, path: str, record: str) -> int:
    """S-10: drop a torn last line from JSON lines and put the rest in the file's place; the number of lines dropped.

    Whole lines stay as they are written, in order; nothing is replaced if the
    last line is whole.
    """
    _, torn = read_torn(spark, path, record)
    n = torn.count()
    if n:
        lines = _lines(spark, path)
        last = lines.filter(F.trim("value") != "").agg(F.max("at")).first()[0]
        kept = lines.filter(F.col("at") < _place(last))
        kept.repartitionByRange("at").sortWithinPartitions("at").select("value").write.mode("overwrite").option("lineSep", "\n").text(path + ".next")
        Store(spark, path).replace(path + ".next", path)
    return n


def read_fields(spark: SparkSession, path: str, fields: str) -> DataFrame:
    """S-12, S-14: only the fields that are needed, by an explicit schema."""
    return spark.read.schema(T.StructType.fromDDL(fields)).json(path)


def write_vectors(df: DataFrame, path: str) -> None:
    """S-17: long vectors with their count beside them."""
    df.write.mode("overwrite").partitionBy("layer").parquet(path)
    df.sparkSession.range(1).select(F.lit(df.count()).alias("rows")).write.mode("overwrite").json(path.rstrip("/") + ".count")


def read_vectors(spark: SparkSession, path: str) -> DataFrame:
    """S-17: an error if rows are missing."""
    df = spark.read.schema(schemas.schema("vector")).parquet(path)
    told, there = spark.read.schema("rows bigint").json(path.rstrip("/") + ".count").first()[0], df.count()
    if told != there:
        raise ValueError(f"{there} vectors of {told}")
    return df


def rendered(df: DataFrame, columns: Sequence[str], order_by: Sequence[str], digits: int = 6) -> str:
    """S-20, S-21: a report table as CSV text: floats with fixed decimals, blanks for null and NaN, one order."""

    def cell(f: T.StructField) -> Column:
        if isinstance(f.dataType, T.DoubleType | T.FloatType):
            return fixed(f.name, digits)
        flag = F.when(F.col(f.name), "True").when(F.col(f.name).isNotNull(), "False")
        return F.coalesce(flag if isinstance(f.dataType, T.BooleanType) else F.col(f.name).cast("string"), F.lit(""))

    # Report tables hold a row for each cell of a design; they are made for people to read.
    rows = df.orderBy(*order_by).select(*[cell(df.schema[c]).alias(c) for c in columns]).collect()
    quote = lambda x: '"' + x.replace('"', '""') + '"' if any(c in x for c in ',"\r\n') else x
    return "".join(",".join(quote(x) for x in r) + "\n" for r in [list(columns), *rows])


def numbered_items(spark: SparkSession, path: str, question: str = "Did ") -> DataFrame:
    """S-24: items under lines like ``12.``; (item, scenario, question), cut where the question begins.

    A file is one document and is read whole.
    """
    whole = spark.read.text(path, wholetext=True)
    parts = F.regexp_extract_all("value", F.lit(r"(?ms)^(\d+)\.[ \t]*\r?\n(.*?)(?=^\d+\.[ \t]*\r?$|\z)"), F.lit(0))
    item = whole.select(F.explode(parts).alias("p")).select(
        F.regexp_extract("p", r"^(\d+)\.", 1).cast("int").alias("item"), F.trim(F.regexp_replace(F.regexp_replace("p", r"^\d+\.\s*", ""), r"\s+", " ")).alias("body")
    )
    at = F.expr(f"locate('{question}', body)")
    return item.select("item", F.trim(F.when(at > 0, F.substr("body", F.lit(1), at - 1)).otherwise(F.col("body"))).alias("scenario"), F.when(at > 0, F.trim(F.substr("body", at))).alias("question"))


def read_parquet(spark: SparkSession, path: str, columns: Sequence[str] | None = None) -> DataFrame:
    """S-15: only the columns that are asked for reach the scan."""
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def write_parquet(df: DataFrame, path: str, by: Sequence[str] = ()) -> None:
    """S-16: a table, in a folder for each value of ``by``, each written by few tasks."""
    (df.repartition(*by) if by else df).write.mode("overwrite").partitionBy(*by).parquet(path)


def write_probes(df: DataFrame, path: str, about: dict) -> None:
    """S-18: weights (construct, kind, layer, coef, intercept, mean, sd) with a JSON description beside them."""
    df.write.mode("overwrite").partitionBy("construct").parquet(path)
    df.sparkSession.createDataFrame([(json.dumps(about, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(path.rstrip("/") + ".about")


def read_probes(spark: SparkSession, path: str, construct: str, layer: int) -> tuple[DataFrame, dict]:
    """S-18: one layer of one construct; both are pushed to the scan."""
    about = json.loads(spark.read.text(path.rstrip("/") + ".about").first()[0])
    return spark.read.parquet(path).filter((F.col("construct") == construct) & (F.col("layer") == layer)), about


def write_xlsx(sheets: dict[str, DataFrame], path: str) -> None:
    """S-19: report tables as sheets of a workbook, where a writer for it is installed."""
    import pandas as pd

    with pd.ExcelWriter(path) as book:
        for name, df in sheets.items():
            df.toPandas().to_excel(book, sheet_name=name, index=False)


def reshaped(df: DataFrame, renamed: dict[str, str], order: Sequence[str]) -> DataFrame:
    """P-08: columns renamed, then those of ``order``, with nulls for those that are missing."""
    out = df.withColumnsRenamed(renamed)
    return out.select(*[F.col(c) if c in out.columns else F.lit(None).cast("string").alias(c) for c in order])


def ordered(df: DataFrame, by: Sequence[str], tie: Sequence[str] = (), descending: bool = False) -> DataFrame:
    """X-09, X-10: a total order, by code points for text, with a key that breaks ties."""
    first = [F.col(c).desc() if descending else F.col(c).asc() for c in by]
    return df.orderBy(*first, *tie)


def read_config(path: str) -> dict:
    """S-25: YAML where a reader is installed, JSON otherwise; on the driver."""
    text = Path(path).read_text()
    try:
        import yaml
    except ImportError:
        return json.loads(text)
    return yaml.safe_load(text)
