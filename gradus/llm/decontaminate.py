"""Benchmark decontamination with a broadcast set of hashed test n-grams."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textkit as tk
from .common import map_rows, without

WINDOW = 13
#: Bytes of benchmark text that one broadcast set may hold; more is taken in blocks of this size.  A byte of text takes about 50 of
#: memory in the set, so a block takes some 200 MB on the driver and in a worker.
BLOCK_BYTES = 4 << 20

_HITS = T.ArrayType(T.IntegerType(), False)
_ITEMS = T.ArrayType(T.StringType(), False)


class _Grams:
    """Sorted window hashes of one block of items, by window length, with the items' words to verify hits."""

    def __init__(self, rows: list[tuple[str, str | None]], size: int):
        self.ids = sorted({str(i) for i, _ in rows})
        number = {x: k for k, x in enumerate(self.ids)}
        column = pa.array([t for _, t in rows], pa.large_string())
        found: dict[int, list[tuple[int, int, bytes]]] = {}
        for c in tk.chunks(column):
            w = tk.words(c.data, c.offsets, tk.ALNUM)
            at = np.concatenate([[0], np.cumsum(w.count)])
            for k in range(c.last - c.first):
                a, b = int(at[k]), int(at[k + 1])
                if a == b:
                    continue
                n = min(size, b - a)
                h, first = tk.windows(w.hash[a:b], w.doc[a:b], n)
                item = number[str(rows[c.first + k][0])]
                for x, i in zip(h.tolist(), (first + a).tolist(), strict=True):
                    found.setdefault(n, []).append((x, item, _said(c.data, w, i, n)))
        self.by_length = {}
        for n, entries in sorted(found.items()):
            entries = sorted(set(entries))
            self.by_length[n] = (np.array([x for x, _, _ in entries], np.uint64), [i for _, i, _ in entries], [s for _, _, s in entries])


def _said(data: np.ndarray, w: tk.Words, i: int, n: int) -> bytes:
    """n words from the i-th, lower-cased, joined by one space."""
    return b" ".join(tk.LOWER[data[w.start[k] : w.end[k]]].tobytes() for k in range(i, i + n))


def _scan(column: pa.Array, hits: pa.Array | None, items: pa.Array | None, grams: _Grams):
    """Word counts, hit word positions and ids of items of every text, added to those of earlier blocks."""
    n_words, out_hits, out_items = [], [], []
    before_hits = hits.to_pylist() if hits is not None else None
    before_items = items.to_pylist() if items is not None else None
    for c in tk.chunks(column):
        w = tk.words(c.data, c.offsets, tk.ALNUM)
        n_words.append(w.count)
        at = np.concatenate([[0], np.cumsum(w.count)])
        marks = np.zeros(len(w.hash) + 1, np.int64)
        named: dict[int, set[str]] = {}
        for n, (known, owner, said) in grams.by_length.items():
            h, first = tk.windows(w.hash, w.doc, n)
            if not len(h):
                continue
            lo = np.searchsorted(known, h, "left")
            cand = np.flatnonzero(known[np.minimum(lo, len(known) - 1)] == h)
            for i in cand.tolist():
                text, k, hit = _said(c.data, w, int(first[i]), n), int(lo[i]), False
                while k < len(known) and known[k] == h[i]:
                    if said[k] == text:
                        hit = True
                        named.setdefault(int(w.doc[first[i]]), set()).add(grams.ids[owner[k]])
                    k += 1
                if hit:
                    marks[first[i]] += 1
                    marks[first[i] + n] -= 1
        covered = np.cumsum(marks[:-1]) > 0
        for k in range(c.last - c.first):
            own = set(np.flatnonzero(covered[at[k] : at[k + 1]]).tolist())
            names = named.get(k, set())
            if before_hits is not None:
                own |= set(before_hits[c.first + k])
                names = names | set(before_items[c.first + k])
            out_hits.append(sorted(own))
            out_items.append(sorted(names))
    counts = np.concatenate(n_words) if n_words else np.zeros(0, np.int64)
    return pa.array(counts, pa.int64()), pa.array(out_hits, pa.list_(pa.int32())), pa.array(out_items, pa.list_(pa.string()))


def decontaminate(
    docs: DataFrame,
    benchmark: DataFrame,
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    window: int = WINDOW,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """docs with n_words, n_hit, n_items, items, hit_words, items_sha256 and contaminated.

    The benchmark's windows (``window`` words; the whole of a shorter item) are
    held as a broadcast hash set.  Its size is measured first: texts beyond
    ``block_bytes`` are taken in blocks, one pass over the rows for each, each
    adding to what the row carries, so no shuffle happens and nothing grows
    beyond a block.  Equal hashes are verified word by word.  No row of docs is
    moved, dropped or added, so repeated rows and null ids are kept as they
    are.  A null or empty text has no words and is clean; null or empty items
    and items without id have no windows; rows that repeat an item_id add to
    that item.  Columns of docs that clash with the new ones are replaced.
    """
    spark = docs.sparkSession
    known = benchmark.select(F.col(item_id).cast("string").alias("i"), F.col(item_text).cast("string").alias("t")).filter("i is not null and t is not null")
    total = known.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    blocks = max(1, -(-int(total) // block_bytes))
    fields = [("n_words", T.LongType()), ("hit_words", _HITS), ("items", _ITEMS)]
    out = without(docs, ["n_hit", "n_items", "items_sha256", "contaminated", "n_words", "hit_words", "items"])
    for b in range(blocks):
        part = known if blocks == 1 else known.filter(F.pmod(F.xxhash64("i", "t"), F.lit(blocks)) == b)
        shared = spark.sparkContext.broadcast(_Grams([(r.i, r.t) for r in part.collect()], window))
        inputs = [text] if b == 0 else [text, "hit_words", "items"]

        def make(shared=shared):
            def step(column, hits=None, items=None):
                return _scan(column, hits, items, shared.value)

            return step

        out = map_rows(out, inputs, fields, make)
    return (
        out.withColumn("n_hit", F.size("hit_words").cast("long"))
        .withColumn("n_items", F.size("items").cast("long"))
        .withColumn("items_sha256", F.sha2(F.array_join(F.array_sort("items"), ","), 256))
        .withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))
    )


def remove_spans(judged: DataFrame, text: str = "text") -> DataFrame:
    """Rows of ``decontaminate`` with the hit words cut from the text.

    A run of hit words goes with the separators inside it; the rest of the text
    stays byte for byte.  Null texts stay null.
    """

    def make():
        def step(column, hits):
            out = []
            values, positions = column.to_pylist(), hits.to_pylist()
            for c in tk.chunks(column):
                w = tk.words(c.data, c.offsets, tk.ALNUM)
                at = np.concatenate([[0], np.cumsum(w.count)])
                for k in range(c.last - c.first):
                    row, own = c.first + k, positions[c.first + k]
                    if values[row] is None or not own:
                        out.append(values[row])
                        continue
                    own = np.asarray(own)
                    cut = np.flatnonzero(np.diff(own) > 1)
                    first, last = own[np.r_[0, cut + 1]], own[np.r_[cut, len(own) - 1]]
                    pieces, done = [], c.offsets[k]
                    for a, b in zip(first, last, strict=True):
                        pieces.append(c.data[done : w.start[at[k] + a]].tobytes())
                        done = w.end[at[k] + b]
                    pieces.append(c.data[done : c.offsets[k + 1]].tobytes())
                    out.append(b"".join(pieces).decode("utf-8", "replace"))
            return [pa.array(out, pa.string())]

        return step

    return map_rows(judged, [text, "hit_words"], [(text, T.StringType())], make)


def op4(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontaminate(docs, bench).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


OP4_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (
  SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (
  SELECT DISTINCT item, least(13, len(w)) AS n, array_to_string(list_slice(w, i, i + least(13, len(w)) - 1), ' ') AS g
  FROM (SELECT item, w, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
lens AS (SELECT DISTINCT n FROM bw),
dw AS (
  SELECT doc_id, n, i, array_to_string(list_slice(w, i, i + n - 1), ' ') AS g
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, lens WHERE len(w) >= n)),
m AS (SELECT doc_id, dw.n, i, item FROM dw JOIN bw ON dw.n = bw.n AND dw.g = bw.g),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM m) GROUP BY 1),
t AS (SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS names FROM m GROUP BY 1)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(names, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(d.w) AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)
"""
