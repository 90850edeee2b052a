"""Merkle manifests of datasets: postorder traversals of aligned blocks of leaves.

A block holds 16 ** 3 aligned leaves of one group (or 16 to another number of levels).  Its traversal returns the
digest of each subtree and appends its siblings to the leaves below while it
unwinds.  The roots of the blocks are the leaves of the next traversal; proofs
come back down as one path for each block, so no leaf carries a path through
storage.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import CRC32_SQL, Workspace, segmented, stream

#: Children of a node, and levels of a block.
FAN, LEVELS = 16, 3
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")

Side = tuple[str, str]


def leaf_digest(values: Sequence[Column]) -> Column:
    """SHA-256 over the values: ``-`` for null, else the number of UTF-8 bytes, ``:`` and the value."""
    parts = [F.coalesce(F.concat(F.octet_length(v.cast("string")).cast("string"), F.lit(":"), v.cast("string")), F.lit("-")) for v in values]
    return F.sha2(F.concat(*parts), 256)


def _hash(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def _height(total: int, levels: int) -> int:
    """Levels to climb in a block of a group of so many nodes."""
    height = 0
    while height < levels and FAN**height < total:
        height += 1
    return height


def _visit(nodes: list[str], low: int, high: int, height: int, paths: list[list[Side]] | None) -> str:
    """The digest over nodes[low:high], and for each of them what stands left and right of it, level by level."""
    if not height:
        return nodes[low]
    step = FAN ** (height - 1)
    starts = range(low, high, step)
    kids = [_visit(nodes, a, min(a + step, high), height - 1, paths) for a in starts]
    if paths is not None:
        for k, a in enumerate(starts):
            side = ("".join(kids[:k]), "".join(kids[k + 1 :]))
            for i in range(a, min(a + step, high)):
                paths[i].append(side)
    return _hash("".join(kids))


def _roots(levels: int, key: tuple, rows: Iterator[tuple]) -> Iterator[tuple]:
    nodes, total = [], 0
    for *_, node, total in rows:
        nodes.append(node)
    yield (*key, -(-total // FAN**levels), _visit(nodes, 0, len(nodes), _height(total, levels), None))


def _with_paths(levels: int, rows: Iterator[tuple]) -> Iterator[tuple[tuple, list[Side], tuple]]:
    """A block's rows with their paths to the root: the block's own, then that of the block, which the first row holds."""
    head = next(rows)
    above = list(zip(head[5], head[6], strict=True))
    own = list(rows)
    paths: list[list[Side]] = [[] for _ in own]
    _visit([r[3] for r in own], 0, len(own), _height(own[0][4], levels), paths)
    for r, path in zip(own, paths, strict=True):
        yield r, path + above, head[7:9]


def _paths(levels: int, key: tuple, rows: Iterator[tuple]) -> Iterator[tuple]:
    for r, path, roots in _with_paths(levels, rows):
        yield (key[0], r[2], [a for a, _ in path], [b for _, b in path], *roots)


def fold(leaf: str, path: Sequence[Side]) -> str:
    """The root that a leaf and what stands left and right of it at each level give."""
    for left, right in path:
        leaf = _hash(left + leaf + right)
    return leaf


def _proofs(levels: int, key: tuple, rows: Iterator[tuple]) -> Iterator[tuple]:
    for r, path, roots in _with_paths(levels, rows):
        doc_id, seen = r[9:]
        yield (doc_id, r[3], *roots, _hash("".join(a + b for a, b in path)), fold(r[3] if seen is None else seen, path))


def _numbered(df: DataFrame, order: Sequence[str], work: Workspace, name: str) -> DataFrame:
    """df with its place ``i`` in its group ``g`` and the group's number of rows ``total``.

    Places come from segments of one global order: rows of a group in a segment
    are counted, and a window over these counts (a row for each group and
    segment) gives where each begins, so no group has to lie in one task.
    """
    rows = segmented(df.withColumn("__row", F.monotonically_increasing_id()), ["g", *order, "__row"], work, name)
    by = Window.partitionBy("g")
    runs = rows.groupBy("g", "seg").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    runs = runs.select(F.col("g").alias("h"), F.col("seg").alias("s"), (F.sum("n").over(by.orderBy("seg")) - F.col("n") - F.col("first")).alias("shift"), F.sum("n").over(by).alias("total"))
    joined = rows.join(runs, F.col("g").eqNullSafe(F.col("h")) & (F.col("seg") == F.col("s")))
    return joined.withColumn("i", F.col("at") + F.col("shift")).drop("h", "s", "shift", "seg", "at", "__row")


def _blocks(df: DataFrame, levels: int) -> DataFrame:
    return df.withColumn("block", F.floor(F.col("i") / FAN**levels))


_NODE = "g string, i bigint, total bigint, node string"
_PATH = "g string, i bigint, lefts array<string>, rights array<string>, subroot string, root string"
_HEADS = ("array<string>", "array<string>", "string", "string")


def _climbed(leaves: DataFrame, most: int, levels: int, work: Workspace, name: str) -> list[DataFrame]:
    """The nodes of each traversal, the last with one node for each group."""
    tables, k = [leaves], 0
    while k == 0 or most > 1:
        nodes = _blocks(tables[-1], levels).select("g", "block", "i", "node", "total")
        tables.append(work.save(stream(nodes, ["g", "block"], ["i"], partial(_roots, levels), _NODE), f"{name}{k}"))
        most, k = -(-most // FAN**levels), k + 1
    return tables


def _headed(nodes: DataFrame, paths: DataFrame, levels: int, extra: Sequence[str] = ()) -> DataFrame:
    """Nodes by block, each block's path before them."""
    kinds = dict(nodes.dtypes)
    null = lambda kind, c: F.lit(None).cast(kind).alias(c)
    names = ("lefts", "rights", "subroot", "root")
    heads = paths.select("g", F.col("i").alias("block"), F.lit(-1).cast("bigint").alias("i"), null("string", "node"), null("bigint", "total"), *names, *[null(kinds[c], c) for c in extra])
    return heads.unionAll(_blocks(nodes, levels).select("g", "block", "i", "node", "total", *[null(k, c) for c, k in zip(names, _HEADS, strict=True)], *extra))


def _descended(tables: list[DataFrame], paths: DataFrame, down_to: int, levels: int, work: Workspace, name: str) -> DataFrame:
    """Paths of the nodes of ``tables[down_to]`` from those of the last."""
    for k in range(len(tables) - 2, down_to - 1, -1):
        paths = work.save(stream(_headed(tables[k], paths, levels), ["g", "block"], ["i"], partial(_paths, levels), _PATH), f"{name}{k}")
    return paths


def manifest(df: DataFrame, seen: Column | None = None, fields: Sequence[str] = FIELDS, doc_id: str = "doc_id", source: str = "source", levels: int = LEVELS) -> DataFrame:
    """A row for each row of df: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified.

    Leaves are digests of ``fields``.  Those of a source (null is a source)
    ascend by doc_id, nulls first, rows that repeat an id by digest; while there
    are several nodes, every 16 consecutive ones become the digest over them,
    which ends with the source's subroot.  Subroots by source, null first, give
    the root in the same way.  ``seen`` is the leaf that a reader sees instead
    (null: the same); ``folded_root`` is what it and the untampered siblings
    give, and ``verified`` whether that is the root.  Rows that are equal in all
    fields are leaves of their own.  No rows give no rows.  Columns of df that
    are not named are not read.

    Texts are read once, by built-in functions; from then on only digests move.
    Places within a source come from counts of segments, so a source with any
    share of the rows is spread over tasks.
    """
    work = Workspace(df.sparkSession, "manifest")
    kind = dict(df.select(F.col(doc_id).alias("d")).dtypes)["d"]
    leaf = leaf_digest([F.col(c) for c in fields])
    narrow = df.select(F.col(source).cast("string").alias("g"), F.col(doc_id).alias("doc_id"), leaf.alias("node"), (F.lit(None).cast("string") if seen is None else seen).alias("seen"))
    leaves = work.save(_numbered(work.save(narrow, "digests"), ["doc_id", "node"], work, "ordered"), "leaves")
    work.drop("digests", "ordered")
    most = leaves.agg(F.max("total")).first()[0] or 0
    tables = _climbed(leaves, most, levels, work, "roots")

    subroots = tables[-1].select(F.col("g").alias("source"), F.lit("all").alias("g"), "node")
    tops = work.save(_numbered(subroots, ["source"], work, "sources"), "tops")
    above = _climbed(tops, tops.agg(F.max("total")).first()[0] or 0, levels, work, "above")
    root = above[-1].select("g", "i", F.array().cast("array<string>").alias("lefts"), F.array().cast("array<string>").alias("rights"), F.lit(None).cast("string").alias("subroot"), F.col("node").alias("root"))
    found = _descended(above, root, 0, levels, work, "apaths").withColumnRenamed("i", "k").drop("g", "subroot")
    found = found.join(tops.select(F.col("i").alias("k"), "source", F.col("node").alias("subroot")), "k")
    found = work.save(found.select(F.col("source").alias("g"), F.lit(0).cast("bigint").alias("i"), "lefts", "rights", "subroot", "root"), "subpaths")
    paths = _descended(tables, found, 1, levels, work, "paths")
    schema = f"doc_id {kind}, leaf string, subroot string, root string, proof_sha256 string, folded_root string"
    out = stream(_headed(leaves, paths, levels, ("doc_id", "seen")), ["g", "block"], ["i"], partial(_proofs, levels), schema)
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The manifest of ``documents``; a reader sees texts in lower case where 5 divides the crc32 of doc_id."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    lowered = leaf_digest([F.translate(c, upper, upper.lower()) if c == "text" else F.col(c) for c in FIELDS])
    return manifest(docs, F.when(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, lowered))


OP12_SQL = (
    r"""
WITH RECURSIVE crc_keys AS (SELECT DISTINCT CAST(doc_id AS VARCHAR) AS k FROM documents WHERE doc_id IS NOT NULL),"""
    + CRC32_SQL
    + r""",
parts AS (
  SELECT doc_id, source, coalesce(v % 5 = 0, false) AS hit, text,
    coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || CAST(doc_id AS VARCHAR), '-') || coalesce(strlen(source) || ':' || source, '-')
    || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || CAST(n_chars AS VARCHAR), '-') AS p
  FROM documents LEFT JOIN crc ON k = CAST(doc_id AS VARCHAR)),
digests AS (
  SELECT doc_id, source, sha256(p || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
    CASE WHEN hit THEN sha256(p || coalesce(strlen(text) || ':' || translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '-')) END AS seen FROM parts),
groups AS (SELECT source, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS g FROM (SELECT DISTINCT source FROM documents)),
leaves AS (
  SELECT d.*, g, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, row_number() OVER () AS id
  FROM digests d JOIN groups s ON d.source IS NOT DISTINCT FROM s.source),
nodes AS (
  SELECT g, 0 AS level, i, leaf AS node, count(*) OVER (PARTITION BY g) AS total FROM leaves
  UNION ALL
  SELECT g, level + 1, i // 16, sha256(string_agg(node, '' ORDER BY i)), any_value((total + 15) // 16) FROM nodes WHERE total > 1 GROUP BY g, level, i // 16),
subroots AS (SELECT g, node FROM nodes WHERE total = 1),
tops AS (
  SELECT 0 AS level, g AS i, node, count(*) OVER () AS total FROM subroots
  UNION ALL
  SELECT level + 1, i // 16, sha256(string_agg(node, '' ORDER BY i)), any_value((total + 15) // 16) FROM tops WHERE total > 1 GROUP BY level, i // 16),
root AS (SELECT node AS root FROM tops WHERE total = 1),
sides AS (
  SELECT l.id, 0 AS part, n.level, coalesce(string_agg(n.node, '' ORDER BY n.i) FILTER (n.i < l.i // CAST(pow(16, n.level) AS BIGINT)), '') AS a,
    coalesce(string_agg(n.node, '' ORDER BY n.i) FILTER (n.i > l.i // CAST(pow(16, n.level) AS BIGINT)), '') AS b
  FROM leaves l JOIN nodes n ON n.g = l.g AND n.total > 1 AND n.i // 16 = l.i // CAST(pow(16, n.level + 1) AS BIGINT) GROUP BY l.id, n.level, l.i
  UNION ALL
  SELECT l.id, 1, n.level, coalesce(string_agg(n.node, '' ORDER BY n.i) FILTER (n.i < l.g // CAST(pow(16, n.level) AS BIGINT)), ''),
    coalesce(string_agg(n.node, '' ORDER BY n.i) FILTER (n.i > l.g // CAST(pow(16, n.level) AS BIGINT)), '')
  FROM leaves l JOIN tops n ON n.total > 1 AND n.i // 16 = l.g // CAST(pow(16, n.level + 1) AS BIGINT) GROUP BY l.id, n.level, l.g),
proofs AS (SELECT id, row_number() OVER (PARTITION BY id ORDER BY part, level) AS k, a, b FROM sides),
whole AS (SELECT id, string_agg(a || b, '' ORDER BY k) AS proof, count(*) AS n FROM proofs GROUP BY id),
folds AS (
  SELECT id, 0::BIGINT AS k, coalesce(seen, leaf) AS node FROM leaves
  UNION ALL
  SELECT f.id, p.k, sha256(p.a || f.node || p.b) FROM folds f JOIN proofs p ON p.id = f.id AND p.k = f.k + 1)
SELECT doc_id, leaf, s.node AS subroot, root, sha256(coalesce(proof, '')) AS proof_sha256, f.node AS folded_root, f.node = root AS verified
FROM leaves l JOIN subroots s USING (g) LEFT JOIN whole w USING (id) JOIN folds f ON f.id = l.id AND f.k = coalesce(w.n, 0), root
"""
)
