"""Mixing sources: temperature weights from token shares, realised as block permutations."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import Workspace, without

#: Least entropy of the weights, as a share of that of equal weights; most epochs of a source.
TARGET_EVENNESS = 0.97
MAX_EPOCHS = 4.0
#: Shares of so many sources are bisected on the driver; those of more in one small aggregation for each step.
DRIVER_SOURCES = 100_000
#: Rows of a source whose running sum one task may take; larger parts are cut by further digits of their hash.
WINDOW_ROWS = 4096
STEPS = 60
DIGITS = 9


def tokens(text: Column) -> Column:
    """Words between white space."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def _name(source: Column) -> Column:
    return F.coalesce(source.cast("string"), F.lit(""))


def _hash(seed: str, *parts: Column) -> Column:
    return F.md5(F.concat_ws("|", F.lit(seed), *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]))


def _entropy(shares: list[float], exponent: float) -> tuple[float, float]:
    """Entropy of shares ** exponent, normalised, and the greatest weight for each share."""
    powers = [p**exponent for p in shares]
    z = math.fsum(powers)
    weights = [x / z for x in powers]
    return -math.fsum(w * math.log(w) for w in weights if w > 0), max(w / p for w, p in zip(weights, shares, strict=True))


def _bisect(meets) -> float:
    """The greatest exponent in [0, 1] at which meets() holds, if it holds below it and not above; 1 if always, 0 if never."""
    if meets(1.0):
        return 1.0
    low, high = 0.0, 1.0
    for _ in range(STEPS):
        mid = (low + high) / 2
        if meets(mid):
            low = mid
        else:
            high = mid
    return round(low, DIGITS)


def exponent(sources: DataFrame, evenness: float, max_epochs: float, budget_share: float) -> float:
    """The exponent for shares p (column ``share``).

    The greatest at which the entropy reaches ``evenness`` of its maximum; if
    some source would then be repeated more than ``max_epochs`` times, the
    least above it at which none is (1 leaves shares as they are).
    """
    rows = sources.select("share").filter("share > 0")
    n = rows.count()
    if n < 2:
        return 1.0
    if n <= DRIVER_SOURCES:
        shares = sorted(r.share for r in rows.collect())
        measure = lambda t: _entropy(shares, t)
    else:

        def measure(t: float) -> tuple[float, float]:
            x = F.pow("share", F.lit(t))
            r = rows.agg(F.sum(x).alias("z"), F.sum(x * F.log(x)).alias("e"), F.max(x / F.col("share")).alias("m")).first()
            return math.log(r.z) - r.e / r.z, r.m / r.z

    even = _bisect(lambda t: measure(t)[0] >= evenness * math.log(n))
    if measure(even)[1] * budget_share <= max_epochs:
        return even
    low, high = even, 1.0
    for _ in range(STEPS):
        mid = (low + high) / 2
        low, high = (low, mid) if measure(mid)[1] * budget_share <= max_epochs else (mid, high)
    return round(high, DIGITS)


def plan(docs: DataFrame, source: str = "source", text: str = "text", key: str = "doc_id", budget: int | None = None, evenness: float = TARGET_EVENNESS, max_epochs: float = MAX_EPOCHS, seed: str = "mix", work: Workspace | None = None) -> DataFrame:
    """One row for each source: weight, target, epochs, and where its part epoch ends.

    The part epoch takes blocks of the source in permuted order, and in the
    block that the target falls into documents in the order of their hashes, as
    long as they fit.  The place where it ends is found by sums over hash
    digits: 256 sums for each source and level, then a running sum over at most
    WINDOW_ROWS rows, so that no source's rows meet in one task.
    """
    work = work or Workspace(docs.sparkSession, "mixing")
    rows = work.save(
        docs.select(_name(F.col(source)).alias("s"), tokens(F.col(text)).alias("n"), _hash(seed, F.col(key)).alias("h"), F.coalesce(F.col(key).cast("string"), F.lit("")).alias("k"))
        .filter("n > 0")
        .withColumn("block", F.substring("h", 1, 2)),
        "tokens",
    )
    totals = work.save(rows.groupBy("s").agg(F.sum("n").alias("total")), "totals")
    whole = totals.agg(F.sum("total")).first()[0] or 0
    budget = int(whole) if budget is None else int(budget)
    shares = totals.withColumn("share", F.col("total") / F.lit(max(1, int(whole))).cast("double"))
    power = exponent(shares, evenness, max_epochs, budget / max(1, whole))
    z = shares.agg(F.sum(F.pow("share", F.lit(power)))).first()[0] or 1.0
    sources = shares.withColumn("weight", F.pow("share", F.lit(power)) / F.lit(z)).withColumn("target", F.floor(F.lit(float(budget)) * F.col("weight") + 1e-6).cast("long"))
    sources = sources.withColumn("epochs", F.expr("target div total")).withColumn("left", F.col("target") - F.col("epochs") * F.col("total"))
    sources = work.save(sources.withColumn("exponent", F.lit(power)), "sources")

    def cut(sums: DataFrame, order: Column, name: str) -> DataFrame:
        """For each source the first part whose running sum exceeds what is left, and what is left in it."""
        w = Window.partitionBy("s").orderBy(order, name)
        run = sums.join(sources_left, "s").withColumn("run", F.sum("n").over(w))
        over = run.filter("run > left").groupBy("s").agg(F.min_by(F.struct(F.col(name), (F.col("left") - F.col("run") + F.col("n")).alias("rest"), F.col("rows")), F.col("run")).alias("c"))
        return over.select("s", F.col(f"c.{name}").alias(name), F.col("c.rest").alias("rest"), F.col("c.rows").alias("rows"))

    sources_left = sources.select("s", "left")
    blocks = rows.groupBy("s", "block").agg(F.sum("n").alias("n"), F.count("*").alias("rows"))
    edge = work.save(cut(blocks, _hash(seed, F.col("s"), F.col("block")), "block").withColumnRenamed("block", "edge"), "edge")
    inner = rows.join(edge.select("s", F.col("edge").alias("block")), ["s", "block"])
    front, digits = edge.select("s", F.col("edge").alias("prefix"), F.col("rest").alias("left"), "rows"), 2
    level = 0
    while digits < 32 and (front.agg(F.max("rows")).first()[0] or 0) > WINDOW_ROWS:
        digits, level = digits + 2, level + 1
        sources_left = front.select("s", "left")
        sums = inner.withColumn("prefix", F.substring("h", 1, digits)).groupBy("s", "prefix").agg(F.sum("n").alias("n"), F.count("*").alias("rows"))
        front = work.save(cut(sums, F.col("prefix"), "prefix").select("s", "prefix", F.col("rest").alias("left"), "rows"), f"front{level}")
        inner = inner.join(front.select("s", "prefix"), "s").filter(F.col("h").startswith(F.col("prefix"))).drop("prefix")
    # Rows with the same hash and key are taken together or not at all.
    w = Window.partitionBy("s").orderBy("h", "k")
    last = inner.join(front.select("s", "left"), "s").withColumn("run", F.sum("n").over(w)).filter("run <= left").groupBy("s").agg(F.max(F.struct("h", "k")).alias("last"))
    ends = front.select("s", "prefix").join(last, "s", "left").select("s", F.coalesce(F.col("last.h"), F.col("prefix")).alias("end_h"), F.col("last.k").alias("end_k"))
    whole_edge = edge.select("s", "edge")
    return work.save(sources.join(whole_edge, "s", "left").join(ends, "s", "left"), "plan")


def mix(docs: DataFrame, source: str = "source", text: str = "text", key: str = "doc_id", budget: int | None = None, evenness: float = TARGET_EVENNESS, max_epochs: float = MAX_EPOCHS, seed: str = "mix") -> DataFrame:
    """docs with n_tokens, weight (of the source), copies, block and order_hash.

    Weights are token shares to the power that ``exponent`` finds, normalised;
    a source's target is its part of ``budget`` tokens (all tokens of docs, if
    None).  Every document has a copy for each full epoch of its source, and
    one more if it is in the part epoch, which stops before the first document
    that would exceed the target.  Rows without tokens have no copies; a null
    source is a source; rows that repeat key and text are counted one by one
    and share their fate.  The plan has one row for each source and is joined
    to docs by source, so texts are not shuffled while it is small.  Clashing
    columns are replaced.
    """
    work = Workspace(docs.sparkSession, "mixing")
    sources = plan(docs, source, text, key, budget, evenness, max_epochs, seed, work)
    named = sources.select("s", "weight", "epochs", "edge", "end_h", "end_k").toDF("__s", "__weight", "__epochs", "__edge", "__end_h", "__end_k")
    out = without(docs, ["n_tokens", "weight", "copies", "block", "order_hash"]).withColumn("__s", _name(F.col(source)))
    out = out.join(named, "__s", "left")
    h, block = _hash(seed, F.col(key)), F.substring(_hash(seed, F.col(key)), 1, 2)
    k = F.coalesce(F.col(key).cast("string"), F.lit(""))
    at, edge = F.struct(_hash(seed, F.col("__s"), block), block), F.struct(_hash(seed, F.col("__s"), F.col("__edge")), F.col("__edge"))
    in_part = F.when(F.col("__edge").isNull(), F.lit(False)).when(block == F.col("__edge"), (h < F.col("__end_h")) | ((h == F.col("__end_h")) & (k <= F.coalesce("__end_k", F.lit(""))) & F.col("__end_k").isNotNull())).otherwise(at < edge)
    out = out.withColumn("n_tokens", tokens(F.col(text)))
    copies = F.when(F.col("n_tokens") == 0, F.lit(0)).otherwise(F.coalesce("__epochs", F.lit(0)) + F.coalesce(in_part, F.lit(False)).cast("int"))
    out = out.withColumn("weight", F.coalesce("__weight", F.lit(0.0))).withColumn("copies", copies.cast("long")).withColumn("block", block).withColumn("order_hash", h)
    return work.finish(out.drop("__s", "__weight", "__epochs", "__edge", "__end_h", "__end_k"))


def realise(mixed: DataFrame, seed: str = "mix", source: str = "source") -> DataFrame:
    """One row for each copy, with epoch and position.

    Sorting by (epoch, position) gives every epoch its own permutation of
    blocks, and of documents in a block; a distributed sort is left to the
    writer.  Columns named epoch or position are replaced.
    """
    out = without(mixed, ["epoch", "position"]).filter("copies > 0").withColumn("epoch", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    place = F.concat(F.substring(_hash(seed, F.col("epoch"), _name(F.col(source)), F.col("block")), 1, 8), F.lit("-"), F.substring(_hash(seed, F.col("epoch"), F.col("order_hash")), 1, 16))
    return out.withColumn("position", place)


def op5(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    return mix(docs).select("doc_id", "source", "n_tokens", F.round("weight", 9).alias("weight"), "copies")


OP5_SQL = r"""
WITH RECURSIVE t AS (
  SELECT doc_id, source, coalesce(source, '') AS s, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS n, md5('mix|' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
u AS (SELECT s, CAST(sum(n) AS BIGINT) AS total FROM t WHERE n > 0 GROUP BY 1),
a AS (SELECT CAST(sum(total) AS DOUBLE) AS whole, list(total ORDER BY total) AS xs, count(*) AS k FROM u),
p AS (SELECT list_transform(xs, lambda x: x / whole) AS ps, k FROM a),
b AS (
  SELECT 0 AS i, CAST(0 AS DOUBLE) AS lo, CAST(1 AS DOUBLE) AS hi
  UNION ALL
  SELECT i + 1, CASE WHEN e >= 0.97 * ln(k) THEN (lo + hi) / 2 ELSE lo END, CASE WHEN e >= 0.97 * ln(k) THEN hi ELSE (lo + hi) / 2 END
  FROM (
    SELECT i, lo, hi, k, ln(list_sum(list_transform(ps, lambda x: pow(x, (lo + hi) / 2))))
      - (lo + hi) / 2 * list_sum(list_transform(ps, lambda x: pow(x, (lo + hi) / 2) * ln(x))) / list_sum(list_transform(ps, lambda x: pow(x, (lo + hi) / 2))) AS e
    FROM b, p WHERE i < 60)),
x AS (SELECT round(lo, 9) AS t FROM b WHERE i = 60),
w AS (
  SELECT u.s, u.total, pow(u.total / a.whole, x.t) / (SELECT sum(pow(v.total / a2.whole, x2.t)) FROM u v, a a2, x x2) AS weight, a.whole FROM u, a, x),
g AS (SELECT s, total, weight, CAST(floor(whole * weight + 1e-6) AS BIGINT) AS target FROM w),
f AS (SELECT s, weight, target // total AS epochs, target - (target // total) * total AS rest FROM g),
r AS (
  SELECT t.doc_id, t.s, sum(t.n) OVER (PARTITION BY t.s ORDER BY md5('mix|' || t.s || '|' || t.h[1:2]), t.h[1:2], t.h, CAST(t.doc_id AS VARCHAR)) AS run FROM t WHERE t.n > 0)
SELECT t.doc_id, t.source, CAST(t.n AS BIGINT) AS n_tokens, round(coalesce(f.weight, 0), 9) AS weight,
  CAST(CASE WHEN t.n = 0 THEN 0 ELSE f.epochs + CASE WHEN r.run <= f.rest THEN 1 ELSE 0 END END AS BIGINT) AS copies
FROM t LEFT JOIN f USING (s) LEFT JOIN r ON r.doc_id = t.doc_id
"""
