"""Toxicity by multiple-instance learning: noisy-or of sentence scores, trained from document labels."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textkit as tk
from .common import map_rows
from .langid import held_out

#: Rows of each label that the model is fitted on (a hash of the id chooses them), and weight buckets.
FIT_ROWS = {1: 2500, 0: 4000}
BUCKET_BITS = 20
#: Prefixes of words, in bytes, that are features beside the whole words; a feature's least number of documents.
PREFIXES = (4, 5, 6, 7, 8)
LEAST_DOCUMENTS = 4
ROUNDS = 400

_WORD = tk.byte_class([(0x00, 0x40), (0x5B, 0x60), (0x7B, 0x7F)])
_STOP = np.zeros(256, bool)
_STOP[[ord(x) for x in ".!?\n"]] = True


class Bags:
    """Features of the sentences of a chunk: feature, sentence of each; document, first and last byte of each sentence."""

    def __init__(self, c: tk.Chunk):
        w = tk.words(c.data, c.offsets, _WORD)
        ends = np.cumsum(_STOP[c.data]) if len(c.data) else np.zeros(0, np.int64)
        # A sentence goes from one stop, or the start of its text, to the next.
        mark = ends[w.start] * 1 + w.doc if len(w.start) else np.zeros(0, np.int64)
        new = np.ones(len(mark), bool)
        new[1:] = (mark[1:] != mark[:-1]) | (w.doc[1:] != w.doc[:-1])
        of = np.cumsum(new) - 1
        at = np.flatnonzero(new)
        self.doc = w.doc[at]
        self.count = len(at)
        self.begin = w.start[at]
        self.end = w.end[np.append(at[1:], len(mark)) - 1] if len(at) else at
        hashes, sentences = [w.hash], [of]
        if len(c.data):
            up, down = tk.powers(len(c.data) + 1)
            total = np.zeros(len(c.data) + 1, np.uint64)
            np.cumsum(tk._BYTE_HASH[c.data] * up[: len(c.data)], out=total[1:])
            for size in PREFIXES:
                long = w.end - w.start > size
                start = w.start[long]
                hashes.append(tk.mix((total[start + size] - total[start]) * down[start] + np.uint64(size * 0x51ED27)))
                sentences.append(of[long])
        self.feature = (np.concatenate(hashes) >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)
        self.sentence = np.concatenate(sentences)


class Model:
    """weights by bucket and the sentences' intercept; rate: the score where nothing could be learnt."""

    def __init__(self, weights: np.ndarray, bias: float):
        self.weights, self.bias = weights.astype(np.float32), bias

    def sentences(self, c: tk.Chunk) -> tuple[Bags, np.ndarray]:
        bags = Bags(c)
        return bags, self.bias + np.bincount(bags.sentence, self.weights[bags.feature], minlength=bags.count)

    def documents(self, c: tk.Chunk) -> tuple[np.ndarray, Bags, np.ndarray]:
        bags, z = self.sentences(c)
        clean = np.bincount(bags.doc, np.logaddexp(0, z), minlength=c.last - c.first)
        return 1 - np.exp(-clean), bags, z


def _train(texts: list[str], labels: np.ndarray, weight: np.ndarray) -> Model:
    """Adam on the noisy-or likelihood over screened features, with a soft threshold towards no weight."""
    column, size = pa.array(texts, pa.large_string()), 1 << BUCKET_BITS
    yes, no = np.zeros(size, np.int32), np.zeros(size, np.int32)
    rows = len(texts)
    for c in tk.chunks(column):  # documents with each feature
        bags = Bags(c)
        pairs = np.unique(bags.doc[bags.sentence] * size + bags.feature)
        own = labels[c.first + pairs // size] == 1
        yes += np.bincount(pairs[own] % size, minlength=size).astype(np.int32)
        no += np.bincount(pairs[~own] % size, minlength=size).astype(np.int32)
    n_yes, n_no = max(1, int((labels == 1).sum())), max(1, int((labels == 0).sum()))
    odds = np.log((yes + 0.5) / (n_yes + 1)) - np.log((no + 0.5) / (n_no + 1))
    kept = np.flatnonzero((yes + no >= LEAST_DOCUMENTS) & (np.abs(odds) > 1))
    index = np.full(size, -1, np.int32)
    index[kept] = np.arange(len(kept))
    f, s, doc, sentences = [], [], [], 0
    for c in tk.chunks(column):
        bags = Bags(c)
        use = index[bags.feature] >= 0
        f.append(index[bags.feature[use]])
        s.append((bags.sentence[use] + sentences).astype(np.int32))
        doc.append((bags.doc + c.first).astype(np.int32))
        sentences += bags.count
    f, s, doc = np.concatenate(f), np.concatenate(s), np.concatenate(doc)
    w = np.append(np.zeros(len(kept)), -5.0)
    m, v = np.zeros_like(w), np.zeros_like(w)
    y, share = labels, weight / weight.sum()
    for step in range(1, ROUNDS + 1):
        z = w[-1] + np.bincount(s, w[f], minlength=sentences)
        p = 1 / (1 + np.exp(-np.maximum(z, -500)))
        toxic = np.clip(1 - np.exp(-np.bincount(doc, np.logaddexp(0, z), minlength=rows)), 1e-9, 1)
        pull = np.where(y == 1, -(1 - toxic) / toxic, 1.0) * share
        g = pull[doc] * p
        grad = np.append(np.bincount(f, g[s], minlength=len(kept)) + 1e-5 * w[:-1], g.sum())
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad * grad
        w -= 0.15 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)
        w[:-1] = np.sign(w[:-1]) * np.maximum(np.abs(w[:-1]) - 0.0003, 0)
    weights = np.zeros(size)
    weights[kept] = w[:-1]
    return Model(weights, float(w[-1]))


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", label: str = "toxic", fit_rows: dict[int, int] | None = None) -> Model:
    """Learn from labelled rows.

    At most ``fit_rows`` rows of each label, those with the least hashes of
    their ids, are fitted, so that the labels can be broadcast to the texts and
    the texts held by the driver at every size; weights give both labels their
    shares among all labelled rows (negatives count at most ten times).  Null
    labels, ids and texts are left out; an id with several labels counts as
    toxic if any is, and of texts that repeat an id the least counts.  With rows of one label only, every score is near it.
    """
    fit_rows = fit_rows or FIT_ROWS
    known = labels.select(F.col(key).alias("k"), F.col(label).cast("int").alias("y")).filter("k is not null and y in (0, 1)")
    totals = {r.y: r.n for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if not totals:
        return Model(np.zeros(1 << BUCKET_BITS), -20.0)
    chosen = None
    for y, most in fit_rows.items():
        part = known.filter(F.col("y") == y).withColumn("r", F.xxhash64(F.col("k").cast("string"))).orderBy("r", "k").limit(most)
        chosen = part if chosen is None else chosen.unionAll(part)
    chosen = chosen.groupBy("k").agg(F.max("y").alias("y"))
    found = docs.select(F.col(key).alias("k"), F.col(text).alias("t")).filter("t is not null").join(F.broadcast(chosen), "k").groupBy("k").agg(F.min("t").alias("t"), F.max("y").alias("y")).collect()
    if not found:
        return Model(np.zeros(1 << BUCKET_BITS), -20.0)
    y = np.array([r.y for r in found])
    share = {v: totals.get(v, 0) / max(1, int((y == v).sum())) for v in (0, 1)}
    relative = min(10.0, share[0] / share[1]) if share[1] > 0 and share[0] > 0 else 1.0
    return _train([r.t for r in found], y, np.where(y == 1, 1.0, relative))


_OFFENDING = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("score", T.DoubleType()), T.StructField("sentence", T.StringType())]))


def score(docs: DataFrame, model: Model, text: str = "text", locate: float | None = 0.5) -> DataFrame:
    """docs with score, predicted and, unless ``locate`` is None, offending.

    score is the noisy-or of the sentences' scores; offending lists sentences
    of at least ``locate`` in text order, with UTF-8 byte offsets.  Null and
    empty texts score 0.  Rows are neither moved nor dropped; clashing columns
    are replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    fields = [("score", T.DoubleType()), ("predicted", T.IntegerType())] + ([("offending", _OFFENDING)] if locate is not None else [])

    def make():
        def step(column):
            scores, spans = [], []
            for c in tk.chunks(column):
                p, bags, z = shared.value.documents(c)
                scores.append(p)
                if locate is not None:
                    own = [[] for _ in range(c.last - c.first)]
                    chance = 1 / (1 + np.exp(-np.maximum(z, -500)))
                    for i in np.flatnonzero(chance >= locate).tolist():
                        a, b, d = int(bags.begin[i]), int(bags.end[i]), int(bags.doc[i])
                        own[d].append({"start": a - int(c.offsets[d]), "end": b - int(c.offsets[d]), "score": float(chance[i]), "sentence": c.data[a:b].tobytes().decode("utf-8", "replace")})
                    spans += own
            p = np.clip(np.concatenate(scores), 0, 1) if scores else np.zeros(0)
            out = [pa.array(p, pa.float64()), pa.array((p >= 0.5).astype(np.int32), pa.int32())]
            return [*out, pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64()), ("sentence", pa.string())])))] if locate is not None else out

        return step

    return map_rows(docs, [text], fields, make)


def op9(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    model = fit(docs.filter(~held_out(5, 0)), labels.filter(~held_out(5, 0)))
    marked = docs.select("doc_id", held_out(5, 0).alias("held_out"), "text")
    return score(marked, model).select("doc_id", "held_out", "score", "predicted", F.size("offending").alias("n_offending"))
