"""Near-duplicate vectors by an epsilon grid order join."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace, components

#: Leading principal dimensions of the grid order and of boxes; rows of a block; rows below which an interval isn't cut.
GRID_DIMENSIONS = 8
BLOCK_ROWS = 2048
LEAF_ROWS = 128
#: Blocks of one interval of the upper level.
INTERVAL_BLOCKS = 64
_SLACK = 1e-9


def _unit(values: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Flat doubles, offsets, and which rows are usable: not null, finite, without nulls, not zero."""
    values = values.combine_chunks() if isinstance(values, pa.ChunkedArray) else values
    lengths = pc.fill_null(pc.list_value_length(values), 0).to_numpy(zero_copy_only=False)
    offsets = np.concatenate([[0], np.cumsum(lengths.astype(np.int64))])
    flat = np.asarray(values.flatten().to_numpy(zero_copy_only=False), np.float64)
    ok = np.zeros(len(values), bool)
    for k in range(len(values)):
        x = flat[offsets[k] : offsets[k + 1]]
        ok[k] = len(x) > 0 and bool(np.isfinite(x).all()) and bool(x.any())
    return flat, offsets, ok


def _normal(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max()
    return x / np.sqrt((x * x).sum())


def _basis(rows: DataFrame, dimensions: int) -> np.ndarray:
    """Principal axes of all unit vectors that have the commonest length; each task sends one matrix of sums."""

    def sums(batches):
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            flat, offsets, ok = _unit(batch.column(0))
            for d in np.unique(np.diff(offsets)[ok]).tolist():
                own = np.flatnonzero(ok & (np.diff(offsets) == d))
                x = np.stack([np.append(_normal(flat[offsets[k] : offsets[k + 1]]), 1.0) for k in own])
                total[d] = total.get(d, 0) + x.T @ x
        for d, m in total.items():
            yield pa.RecordBatch.from_pydict({"d": pa.array([d], pa.int32()), "m": pa.array([m.ravel().tolist()], pa.list_(pa.float64()))})

    parts = rows.select("embedding").mapInArrow(sums, "d int, m array<double>")
    by = parts.select("d", F.posexplode("m").alias("i", "x")).groupBy("d", "i").agg(F.sum("x").alias("x"))
    count = by.filter(F.col("i") == (F.col("d") + 1) * (F.col("d") + 1) - 1).orderBy(F.desc("x"), "d").first()
    if count is None:
        return np.zeros((0, dimensions))
    d = count.d
    m = np.zeros((d + 1) ** 2)
    for r in by.filter(F.col("d") == d).collect():
        m[r.i] = r.x
    m = m.reshape(d + 1, d + 1)
    mean = m[:d, d] / m[d, d]
    _, axes = np.linalg.eigh(m[:d, :d] / m[d, d] - np.outer(mean, mean))
    out = np.zeros((d, dimensions))
    out[:, : min(d, dimensions)] = axes[:, ::-1][:, :dimensions]
    return out


def _joined(a: np.ndarray, pa_: np.ndarray, b: np.ndarray, pb: np.ndarray, same: bool, least: float, eps2: float):
    """Index pairs of linked rows of two sequences of unit vectors, found by halving intervals whose boxes are near."""
    found_i, found_j = [], []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        i, j, k, m = todo.pop()
        if same and k >= j and i < k:  # the mirror image of an interval pair that is taken
            continue
        gap = np.maximum(0, np.maximum(pa_[i:j].min(axis=0) - pb[k:m].max(axis=0), pb[k:m].min(axis=0) - pa_[i:j].max(axis=0)))
        if (gap * gap).sum() > eps2 + _SLACK:
            continue
        if max(j - i, m - k) <= LEAF_ROWS:
            x, y = np.nonzero(a[i:j] @ b[k:m].T >= least)
            x, y = x + i, y + k
            if same:
                keep = x > y
                x, y = x[keep], y[keep]
            found_i.append(x)
            found_j.append(y)
        elif j - i >= m - k:
            h = (i + j) // 2
            todo += [(i, h, k, m), (h, j, k, m)]
        else:
            h = (k + m) // 2
            todo += [(i, j, k, h), (i, j, h, m)]
    e = np.zeros(0, np.int64)
    return (np.concatenate(found_i), np.concatenate(found_j)) if found_i else (e, e)


def _roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Least index of each node's component."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[i], root[j])
        new = root.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        np.minimum.at(new, root[i], low)
        np.minimum.at(new, root[j], low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def near_duplicates(vectors: DataFrame, threshold: float = 0.98, key: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """(key, n_links, component_id, kept) of every vector.

    Vectors of equal, non-null label and equal length link when their cosine in
    double precision is at least ``threshold``.  On unit vectors this is a
    distance of at most eps, so rows are sorted by label and by the cells of
    width eps on leading principal dimensions; blocks of consecutive rows, and
    intervals of blocks, are paired only if their boxes are within eps, and a
    pair of blocks is joined by halving its intervals alike.  Nothing but sums
    of squares is gathered on the driver; links are counted in the pair's task
    and only one edge for each row leaves it.

    Vectors that are null, zero or hold null or non-finite components link with
    nothing and are their own component.  Rows that repeat a key are vectors of
    their own, whatever their labels: their links to rows of other keys are added,
    and lie in one component.  Rows with a null key are returned one by one
    with 0 links, a null component and kept false.  Other columns are not read.
    """
    spark = vectors.sparkSession
    work = Workspace(spark, "vectors")
    read = vectors.select(F.col(key).cast("long").alias("id"), F.col(label).cast("string").alias("label"), F.col(vector).cast("array<double>").alias("embedding"))
    rows = read.filter("id is not null")
    usable = rows.filter("label is not null and embedding is not null")
    basis = _basis(usable, GRID_DIMENSIONS)
    eps2 = max(0.0, 2 - 2 * threshold)
    eps = max(1e-6, float(np.sqrt(eps2)))
    shared = spark.sparkContext.broadcast(basis)

    def project(batches):
        axes = shared.value
        for batch in batches:
            flat, offsets, ok = _unit(batch.column(2))
            at = np.flatnonzero(ok)
            place = np.zeros((len(at), GRID_DIMENSIONS))
            units = []
            for n, k in enumerate(at):
                x = _normal(flat[offsets[k] : offsets[k + 1]])
                units.append(x)
                if len(x) == len(axes):
                    place[n] = x @ axes
            take = pa.array(at, pa.int64())
            cells = np.floor(place / eps).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(take),
                    pa.array([f"{len(u)}/{v}" for u, v in zip(units, batch.column(1).take(take).to_pylist(), strict=True)], pa.string()),
                    pa.array(list(cells), pa.list_(pa.int32())),
                    pa.array(list(place), pa.list_(pa.float64())),
                    pa.array(units, pa.list_(pa.float64())),
                ],
                names=["id", "label", "cell", "place", "unit"],
            )

    placed = usable.select("id", "label", "embedding").mapInArrow(project, "id long, label string, cell array<int>, place array<double>, unit array<double>")
    placed = work.save(placed, "placed")
    ordered = placed.repartitionByRange("label", "cell", "id").sortWithinPartitions("label", "cell", "id")

    def cut(batches):
        from pyspark import TaskContext

        task, block, held, last = TaskContext.get().partitionId(), -1, BLOCK_ROWS, None
        for batch in batches:
            number = []
            for name in batch.column(1).to_pylist():
                if name != last or held >= BLOCK_ROWS:
                    block, held, last = block + 1, 0, name
                held += 1
                number.append((task << 32) + block)
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in (0, 1, 3, 4)), pa.array(number, pa.int64())], names=["id", "label", "place", "unit", "block"])

    cut_rows = work.save(ordered.mapInArrow(cut, "id long, label string, place array<double>, unit array<double>, block long"), "blocks")
    dims = range(GRID_DIMENSIONS)
    box = [f(F.col("place")[i]).alias(f"{n}{i}") for n, f in (("lo", F.min), ("hi", F.max)) for i in dims]
    blocks = cut_rows.groupBy("label", "block").agg(*box)
    blocks = work.save(blocks.withColumn("interval", F.floor(F.col("block") / INTERVAL_BLOCKS)), "boxes")
    wider = blocks.groupBy("label", "interval").agg(*[f(f"{n}{i}").alias(f"{n}{i}") for n, f in (("lo", F.min), ("hi", F.max)) for i in dims])

    def near(left: DataFrame, right: DataFrame, name: str, on: list) -> DataFrame:
        a = left.select(*[F.col(c).alias(f"a_{c}") for c in left.columns])
        b = right.select(*[F.col(c).alias(f"b_{c}") for c in right.columns])
        apart = sum(F.pow(F.greatest(F.lit(0.0), F.col(f"a_lo{i}") - F.col(f"b_hi{i}"), F.col(f"b_lo{i}") - F.col(f"a_hi{i}")), 2) for i in dims)
        return a.join(b, on).filter((F.col(f"a_{name}") >= F.col(f"b_{name}")) & (apart <= eps2 + _SLACK))

    upper = near(wider, wider, "interval", [F.col("a_label") == F.col("b_label")]).select("a_label", "a_interval", "b_interval")
    first = upper.join(blocks.select(F.col("label").alias("a_label"), F.col("interval").alias("a_interval"), F.col("block").alias("a_block"), *[F.col(f"{n}{i}").alias(f"a_{n}{i}") for n in ("lo", "hi") for i in dims]), ["a_label", "a_interval"])
    second = blocks.select(F.col("label").alias("a_label"), F.col("interval").alias("b_interval"), F.col("block").alias("b_block"), *[F.col(f"{n}{i}").alias(f"b_{n}{i}") for n in ("lo", "hi") for i in dims])
    apart = sum(F.pow(F.greatest(F.lit(0.0), F.col(f"a_lo{i}") - F.col(f"b_hi{i}"), F.col(f"b_lo{i}") - F.col(f"a_hi{i}")), 2) for i in dims)
    pairs = first.join(second, ["a_label", "b_interval"]).filter((F.col("a_block") >= F.col("b_block")) & (apart <= eps2 + _SLACK))
    pairs = work.save(pairs.select(F.col("a_label").alias("label"), F.col("a_block").alias("a"), F.col("b_block").alias("b")).distinct(), "pairs")
    sides = pairs.select("label", "a", "b", F.explode(F.array_distinct(F.array("a", "b"))).alias("block"))
    dealt = cut_rows.join(sides, ["label", "block"]).select("label", "a", "b", "block", "id", "place", "unit").repartition("label", "a", "b").sortWithinPartitions("label", "a", "b", "block")

    def links(batches):
        at, held = None, []

        def flush():
            block = np.concatenate([h[0] for h in held])
            ids, place, unit = (np.concatenate([h[i] for h in held]) for i in (1, 2, 3))
            one = block == at[1]
            if at[1] == at[2]:
                i, j = _joined(unit, place, unit, place, True, threshold, eps2)
            else:
                i, j = _joined(unit[one], place[one], unit[~one], place[~one], False, threshold, eps2)
                i, j = np.flatnonzero(one)[i], np.flatnonzero(~one)[j]
            other = ids[i] != ids[j]
            i, j = i[other], j[other]
            if not len(i):
                return None
            count = np.bincount(i, minlength=len(ids)) + np.bincount(j, minlength=len(ids))
            root = _roots(len(ids), i, j)
            on = np.flatnonzero(count)
            return pa.RecordBatch.from_arrays([pa.array(ids[on]), pa.array(count[on], pa.int64()), pa.array(ids[root[on]])], names=["id", "n", "root"])

        for batch in batches:
            key3 = list(zip(*[batch.column(i).to_pylist() for i in range(3)], strict=True))
            block = batch.column(3).to_numpy()
            ids = batch.column(4).to_numpy()
            start = 0
            for end in range(1, len(key3) + 1):
                if end == len(key3) or key3[end] != key3[start]:
                    if key3[start] != at:
                        if held and (out := flush()) is not None:
                            yield out
                        at, held = key3[start], []
                    part = slice(start, end)
                    place = batch.column(5).slice(start, end - start).flatten().to_numpy().reshape(end - start, -1)
                    unit = batch.column(6).slice(start, end - start).flatten().to_numpy().reshape(end - start, -1)
                    held.append((block[part], ids[part], place, unit))
                    start = end
        if held and (out := flush()) is not None:
            yield out

    found = work.save(dealt.mapInArrow(links, "id long, n long, root long"), "links")
    counts = found.groupBy("id").agg(F.sum("n").alias("n"))
    roots = components(found.select(F.col("id").alias("u"), F.col("root").alias("v")), work)
    out = rows.select("id").distinct().join(counts, "id", "left").join(roots.withColumnRenamed("node", "id"), "id", "left")
    out = out.select("id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), F.coalesce("root", "id").alias("component_id"))
    out = out.withColumn("kept", F.col("id") == F.col("component_id"))
    none = read.filter("id is null").select("id", F.lit(0).cast("long").alias("n_links"), F.lit(None).cast("long").alias("component_id"), F.lit(False).alias("kept"))
    return work.finish(out.unionAll(none).withColumnRenamed("id", key))


def op7(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


OP7_SQL = r"""
WITH RECURSIVE v AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
u AS (
  SELECT vec_id, label, e, sqrt(list_dot_product(e, e)) AS n FROM v
  WHERE label IS NOT NULL AND e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_dot_product(e, e) > 0),
p AS (
  SELECT a.vec_id AS u, b.vec_id AS v FROM u a JOIN u b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_dot_product(a.e, b.e) / (a.n * b.n) >= 0.98),
r AS (SELECT vec_id AS node, vec_id AS root FROM embeddings UNION SELECT p.v, r.root FROM r JOIN p ON p.u = r.node),
c AS (SELECT node, min(root) AS root FROM r GROUP BY 1),
k AS (SELECT u, count(*) AS n FROM p GROUP BY 1)
SELECT c.node AS vec_id, CAST(coalesce(k.n, 0) AS BIGINT) AS n_links, c.root AS component_id, c.node = c.root AS kept
FROM c LEFT JOIN k ON k.u = c.node
"""
