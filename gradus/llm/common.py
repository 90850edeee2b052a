"""What the operators of this folder share: storage, row maps, components."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator, Sequence
from itertools import batched, groupby

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

_FALLBACK: dict[str, str] = {}


def shared_root(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; unset, one of our own in local mode (tests), and an error on a cluster."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        key = spark.sparkContext.applicationId
        root = _FALLBACK.setdefault(key, "file://" + tempfile.mkdtemp(prefix="gradus-"))
    return root.rstrip("/")


_WRITERS = "spark.sql.maxConcurrentOutputFileWriters"


class Workspace:
    """Named tables in the shared folder.

    A table that is written cuts the lineage: a lost executor costs only the
    job that runs, and readers find all files.  ``drop`` frees tables that no
    result reads any more.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.base = f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"
        self.saved: set[str] = set()

    def path(self, name: str) -> str:
        return f"{self.base}/{name}"

    def save(self, df: DataFrame, name: str, by: str | None = None) -> DataFrame:
        """df as a table; with ``by``, a column of few values, in a folder for each, so that who asks for one reads no other."""
        writer = df.write.mode("overwrite")
        if by is None:
            writer.parquet(self.path(name))
        else:
            conf, before = self.spark.conf, self.spark.conf.get(_WRITERS)
            conf.set(_WRITERS, "16")  # a file for each value stays open, so that rows are not sorted by it
            try:
                writer.partitionBy(by).parquet(self.path(name))
            finally:
                conf.set(_WRITERS, before)
        self.saved.add(name)
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def release(self) -> None:
        """Let Spark remove the shuffle files of finished jobs, which it does when their plans are collected."""
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()

    def drop(self, *names: str) -> None:
        jvm = self.spark.sparkContext._jvm
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(self.path(name))
            path.getFileSystem(conf).delete(path, True)
            self.saved.discard(name)

    def finish(self, out: DataFrame) -> DataFrame:
        """out, after the tables that it does not read are dropped."""
        read = {f.rsplit("/", 1)[0].rsplit("/", 1)[-1] for f in out.inputFiles() if self.base.rsplit("/", 1)[-1] in f}
        self.drop(*(self.saved - read))
        return out


#: Keys by which a table is filtered before it is shuffled, at most; they are counted first.
BROADCAST_KEYS = 500_000


def with_keys(df: DataFrame, key: str, ids: DataFrame, work: Workspace, name: str) -> DataFrame:
    """Rows of df whose key is in ids (one column); unfiltered if there are too many to send to all tasks.

    It only spares later shuffles rows that they would drop.
    """
    known = work.save(ids.distinct().toDF("__id"), name)
    if known.count() > BROADCAST_KEYS:
        return df
    return df.join(F.broadcast(known), F.col(key) == F.col("__id"), "left_semi")


def without(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """df without columns that clash (in any letter case) with names."""
    lower = {n.lower() for n in names}
    clash = [c for c in df.columns if c.lower() in lower]
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c not in clash])


def pieces(batches: Iterable[pa.RecordBatch], rows: int | None) -> Iterator[pa.RecordBatch]:
    """The batches in slices of at most ``rows`` rows, which copy nothing; none asked for, whole."""
    for batch in batches:
        if rows is None:
            yield batch
        else:
            yield from (batch.slice(i, rows) for i in range(0, batch.num_rows, rows))


def map_rows(
    df: DataFrame,
    inputs: Sequence[str],
    fields: Sequence[tuple[str, T.DataType]],
    make: Callable[[], Callable[..., Sequence[pa.Array]]],
    rows: int | None = None,
) -> DataFrame:
    """Append columns computed from whole Arrow batches, or from ``rows`` rows of them at a time; rows stay as they are.

    ``make()`` runs once in a task and returns a function from the arrays of
    ``inputs`` to one array for each field.  Columns of df whose names clash
    with the new ones are replaced.
    """
    names = [n for n, _ in fields]
    kept = [c for c in df.columns if c.lower() not in {n.lower() for n in names}]
    held = [f"__in_{i}" for i in range(len(inputs))]
    plan = df.select(*[F.col(f"`{c}`") for c in kept], *[F.col(f"`{c}`").alias(h) for c, h in zip(inputs, held, strict=True)])
    schema = T.StructType([*[df.schema[c] for c in kept], *[T.StructField(n, t) for n, t in fields]])
    width = len(kept)

    def run(batches):
        step = make()
        for batch in pieces(batches, rows):
            made = step(*[batch.column(width + i) for i in range(len(held))])
            yield pa.RecordBatch.from_arrays([*batch.columns[:width], *made], names=[*kept, *names])

    return plan.mapInArrow(run, schema)


def components(edges: DataFrame, work: Workspace, prefix: str = "cc") -> DataFrame:
    """Connected components of edges ``(u, v)``: rows ``(node, root)``.

    root is the smallest node reachable; nodes without edges do not occur.
    Alternates large-star and small-star steps, each a map-side combined
    minimum and a join that the adaptive planner may split, so that a hub with
    any number of neighbours is never gathered in a task.  Every step is
    written to the shared folder.
    """
    both = edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    now = work.save(both.distinct(), f"{prefix}0")
    step, last = 0, None
    while True:
        undirected = now.unionAll(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = undirected.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        # Large star: neighbours above a node are tied to its smallest neighbour.
        large = undirected.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        least_down = now.groupBy("u").agg(F.min("v").alias("m"))
        large = work.save(large.filter("u <> v").distinct(), f"{prefix}{step}a")
        # Small star: a node's smaller neighbours and itself are tied to the smallest.
        least_down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least_down, "u").select(
            F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")
        ).select("e.u", "e.v").filter("u <> v").distinct()
        nxt = work.save(small, f"{prefix}{step + 1}")
        mark = nxt.agg(F.count("*"), F.sum(F.hash("u", "v").cast("decimal(38,0)"))).first()
        work.drop(f"{prefix}{step}a", f"{prefix}{step}")
        now, step = nxt, step + 1
        if mark == last:
            break
        last = mark
    # At the fixed point every edge is (node, root).
    leaves = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return leaves.unionAll(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def segmented(df: DataFrame, order: Sequence[str], work: Workspace, name: str) -> DataFrame:
    """df in the total order of ``order`` (nulls first), written with ``at``, which ascends in it; ``at >> 33`` is the segment.

    Segments come from a range partitioning, so a key with any number of rows
    spans as many as it needs; rows that are equal in all of ``order`` stay in
    one, so ``order`` should tell rows apart.
    """
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    return work.save(ranged.withColumn("at", F.monotonically_increasing_id()), name).withColumn("seg", F.shiftright("at", 33))


def stream(df: DataFrame, keys: Sequence[str], order: Sequence[str], step: Callable[[tuple, Iterator[tuple]], Iterable[tuple]], schema: str, size: int = 2048) -> DataFrame:
    """``step(key, rows)`` for each key, whose rows it reads one by one in ``order``; its tuples make the result.

    Columns of df come as they are, keys first.  Nothing is held but Arrow
    batches, so memory does not grow with a key's rows unless step holds them.
    """
    columns = [*keys, *[c for c in df.columns if c not in keys]]
    spread = df.select(*columns).repartition(*keys).sortWithinPartitions(*keys, *order)
    width, out = len(keys), to_arrow_schema(T.StructType.fromDDL(schema))

    def run(batches):
        rows = (row for b in batches for row in zip(*(c.to_pylist() for c in b.columns), strict=True))
        made = (x for key, own in groupby(rows, key=lambda r: r[:width]) for x in step(key, own))
        for part in batched(made, size):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*part, strict=True), out.types, strict=True)], schema=out)

    return spread.mapInArrow(run, schema)


#: crc32 of the column k of ``crc_keys``, whose characters are ASCII: a table from the polynomial's rule, then a fold over the bytes.
CRC32_SQL = r"""
crc_table AS (
  SELECT list(v ORDER BY i) AS t FROM (
    SELECT i, list_reduce(list_concat([i::UBIGINT], list_transform(range(8), lambda x: x::UBIGINT)),
      lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384::UBIGINT) ELSE a >> 1 END) AS v FROM range(256) r(i))),
crc AS (
  SELECT k, xor(list_reduce(list_concat([4294967295::UBIGINT], list_transform(string_split(k, ''), lambda c: ascii(c)::UBIGINT)),
    lambda a, b: xor(a >> 8, t[(xor(a, b) & 255)::BIGINT + 1])), 4294967295::UBIGINT) AS v FROM crc_keys, crc_table)"""
