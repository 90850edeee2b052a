"""Language identification by the nearest of several TF-IDF centroids per language."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textkit as tk
from .common import map_rows

#: Hash buckets of character n-grams; n-gram lengths in bytes; centroids for each language.
DIMENSIONS = 1 << 13
ORDERS = (2, 3, 4)
CENTROIDS = 3
#: Rows for each language from which centroids are clustered (document frequencies use all rows).
FIT_ROWS = 400
#: Sizes that have a floor of their own, as powers of two of the different n-grams in a text; repeated lines don't make a text larger.
SIZES = range(3, 14)
#: Bytes of the pieces that floors are learnt from, as powers of two; pieces of each, fewer of long ones; where the floor lies
#: between what shuffled letters reach and the middle of true pieces.
LENGTHS = range(3, 18)
PIECES = 48
MARGIN = 0.1
#: More values than this in the label column are not languages, and the centroids are broadcast.
MAX_LANGUAGES = 1000
UNKNOWN = "und"

#: Bytes to gram alphabet: ASCII letters lower-cased, other ASCII a space, non-ASCII kept.
_GRAM = tk.LOWER.copy()
_GRAM[[b for b in range(128) if not (97 <= int(tk.LOWER[b]) <= 122)]] = 32


def _spoken(text: str) -> bool:
    """Whether the text has a letter of any script; digits and numbers in any form are none."""
    return any(map(str.isalpha, text))


def _counts(c: tk.Chunk) -> np.ndarray:
    """Rows x DIMENSIONS counts of the byte n-grams of a chunk; Latin-1 capitals count as small."""
    rows, n = c.last - c.first, len(c.data)
    if not n:
        return np.zeros((rows, DIMENSIONS), np.float32)
    x = _GRAM[c.data]
    after = np.zeros(n, bool)
    after[1:] = c.data[:-1] == 0xC3
    x = np.where(after & (x >= 0x80) & (x <= 0x9E) & (x != 0x97), x + 32, x).astype(np.uint8)
    keep = np.ones(n, bool)
    keep[1:] = (x[1:] != 32) | (x[:-1] != 32)
    heads = c.offsets[:-1][c.offsets[:-1] < n]
    keep[heads] = True
    doc = np.repeat(np.arange(rows), np.diff(c.offsets))[keep]
    x = x[keep].astype(np.uint64)
    out = np.zeros(rows * DIMENSIONS, np.int64)
    base = doc * DIMENSIONS
    for size in ORDERS:
        if len(x) < size:
            break
        code = np.full(len(x) - size + 1, size, np.uint64)
        for i in range(size):
            code = code * np.uint64(257) + x[i : len(x) - size + 1 + i]
        code = (code * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - 13)
        same = doc[size - 1 :] == doc[: len(x) - size + 1]
        out += np.bincount((base[: len(code)] + code.astype(np.int64))[same], minlength=rows * DIMENSIONS)
    return out.reshape(rows, DIMENSIONS).astype(np.float32)


def _vectors(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = np.log1p(counts) * idf
    norm = np.sqrt((x * x).sum(axis=1, keepdims=True))
    return np.divide(x, norm, out=np.zeros_like(x), where=norm > 0)


def _chunks(column: pa.Array):
    return tk.chunks(column, 1 << 19, rows=64)


def _size(counts: np.ndarray) -> np.ndarray:
    """Index into SIZES of rows of counts."""
    different = np.maximum((counts > 0).sum(axis=1), 1)
    return np.clip(np.log2(different).astype(int) - SIZES[0], 0, len(SIZES) - 1)


class Model:
    """centroids: rows of unit length; owner: index into languages; floor: least cosine that is accepted, by language and size."""

    def __init__(self, languages: list[str], idf: np.ndarray, centroids: np.ndarray, owner: np.ndarray, floor: np.ndarray):
        self.languages, self.idf, self.centroids, self.owner, self.floor = languages, idf, centroids, owner, floor

    def predict(self, column: pa.Array) -> tuple[list[str], list[float], list[bool]]:
        names, scores, accepted = [], [], []
        values = column.to_pylist()
        for c in _chunks(column):
            counts = _counts(c)
            size = _size(counts)
            like = _vectors(counts, self.idf) @ self.centroids.T
            best = like.argmax(axis=1)
            for k in range(c.last - c.first):
                value = values[c.first + k]
                if value is None or not _spoken(value):
                    names.append(UNKNOWN)
                    scores.append(0.0)
                    accepted.append(False)
                    continue
                own = int(self.owner[best[k]])
                cosine = float(min(1.0, max(0.0, like[k, best[k]])))
                names.append(self.languages[own])
                scores.append(cosine)
                accepted.append(bool(cosine >= self.floor[own, size[k]]) and self.languages[own] != UNKNOWN)
        return names, scores, accepted


def _cluster(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Spherical k-means from farthest-first seeds, without randomness."""
    centre = x.mean(axis=0)
    seeds = [int((x @ centre).argmax())]
    like = x @ x[seeds[0]]
    while len(seeds) < min(k, len(x)):
        seeds.append(int(like.argmin()))
        like = np.maximum(like, x @ x[seeds[-1]])
    centres = x[seeds].copy()
    for _ in range(rounds):
        own = (x @ centres.T).argmax(axis=1)
        for j in range(len(centres)):
            if (own == j).any():
                v = x[own == j].mean(axis=0)
                centres[j] = v / max(np.linalg.norm(v), 1e-12)
    return centres


def _pieces(texts: list[str], power: int) -> np.ndarray:
    """Pieces of 2 ** power bytes, a row each, at even distances in the texts one after the other, which repeat if they are too short."""
    line = np.frombuffer(" ".join(texts).encode(), np.uint8)
    starts = np.linspace(0, max(0, len(line) - (1 << power)), max(8, PIECES >> max(0, power - 11))).astype(int)
    return line[(starts[:, None] + np.arange(1 << power)) % len(line)]


def _likeness(pieces: np.ndarray, idf: np.ndarray, centres: np.ndarray) -> list[tuple[int, float]]:
    """Size of each piece and its cosine to the nearest centroid."""
    out = []
    for piece in pieces:
        counts = _counts(tk.Chunk(0, 1, piece, np.array([0, len(piece)])))
        out.append((int(_size(counts)[0]), float((_vectors(counts, idf) @ centres.T).max())))
    return out


def _by_size(found: list[tuple[int, float]], share: float) -> np.ndarray:
    """The quantile of the cosines at each of SIZES; sizes that no piece has take it from those beside them."""
    at = sorted({k for k, _ in found})
    return np.interp(np.arange(len(SIZES)), at, [np.quantile([x for k, x in found if k == i], share) for i in at])


def _floors(texts: list[str], idf: np.ndarray, centres: np.ndarray) -> list[float]:
    """Distance-based rejection, a floor for each of SIZES.

    True pieces are compared with the same pieces with their bytes shuffled.
    The floor lies above nearly all shuffled ones by MARGIN of the way to the
    middle of the true ones; where that would reject more than the lowest few
    true ones, as in texts too short to tell, it is far below all true ones.
    """
    true, noise, chance = [], [], np.random.default_rng(7)
    for power in LENGTHS:
        pieces = _pieces(texts, power)
        true += _likeness(pieces, idf, centres)
        noise += _likeness(chance.permuted(pieces, axis=1), idf, centres)
    middle, low, least = (_by_size(true, q) for q in (0.5, 0.02, 0.0))
    above = _by_size(noise, 0.98)
    floor = above + MARGIN * (middle - above)
    return np.where(floor <= low, floor, np.minimum(floor, 0.5 * least)).tolist()


def fit(train: DataFrame, text: str = "text", label: str = "lang", key: str = "doc_id", centroids: int = CENTROIDS, fit_rows: int = FIT_ROWS) -> Model:
    """Learn from rows with a label and a text that is neither null nor without letters.

    Document frequencies and language counts cover every row: each task sends
    one array.  Centroids come from ``fit_rows`` rows for each language, chosen
    by a hash of key and text, and so alike at every size.  No such row gives a
    model that knows no language and answers ``und``.
    """
    rows = train.select(F.col(label).cast("string").alias("lang"), F.col(text).alias("t"), F.col(key).cast("string").alias("k")).filter("lang is not null and t is not null")

    def count(batches):
        seen, total, df = {}, 0, np.zeros(DIMENSIONS, np.int64)
        for batch in batches:
            for x in batch.column(0).to_pylist():
                seen[x] = seen.get(x, 0) + 1
            for c in _chunks(batch.column(1)):
                df += (_counts(c) > 0).sum(axis=0)
            total += batch.num_rows
        if total:
            yield pa.RecordBatch.from_pydict({"lang": [*seen, None], "n": [*seen.values(), total], "df": [*[None] * len(seen), df.tolist()]}, schema=pa.schema([("lang", pa.string()), ("n", pa.int64()), ("df", pa.list_(pa.int64()))]))

    parts = rows.select("lang", "t").mapInArrow(count, "lang string, n long, df array<long>")
    # One pass: labels as they are, and the frequency array split by position, each summed map-side.
    whole = parts.select("lang", "n", F.when(F.col("lang").isNull(), F.col("df")).otherwise(F.array(F.lit(None).cast("long"))).alias("df")).select("lang", "n", F.posexplode("df").alias("i", "d"))
    sums = whole.groupBy("lang", "i").agg(F.sum("n").alias("n"), F.sum("d").alias("d")).limit(DIMENSIONS + MAX_LANGUAGES + 1).collect()
    counts = {r.lang: r.n for r in sums if r.lang is not None}
    if len(counts) > MAX_LANGUAGES:
        raise ValueError(f"{label} has more than {MAX_LANGUAGES} values")
    frequency, total = np.zeros(DIMENSIONS), 0
    for r in sums:
        if r.lang is None:
            frequency[r.i], total = r.d, r.n
    idf = (np.log((1 + total) / (1 + frequency)) + 0.1).astype(np.float32)
    languages = sorted(counts)
    if not languages:
        return _Nothing(idf)
    share = F.create_map(*[F.lit(y) for x in languages for y in (x, max(1e-15, fit_rows / counts[x]))])
    rank = (F.xxhash64("k", "t").cast("double") / F.lit(2.0**64) + 0.5) / share[F.col("lang")]
    sample = rows.withColumn("r", rank).filter("r < 1.5").orderBy("r").limit(fit_rows * len(languages)).select("lang", "t").collect()
    centres, owner, floor = [], [], []
    for own, language in enumerate(languages):
        column = pa.array([r.t for r in sample if r.lang == language and _spoken(r.t)], pa.large_string())
        blocks = [_vectors(_counts(c), idf) for c in _chunks(column)]
        x = np.concatenate(blocks) if blocks else np.zeros((0, DIMENSIONS), np.float32)
        if not len(x):
            floor.append([0.0] * len(SIZES))
            continue
        found = _cluster(x, centroids)
        centres.append(found)
        owner += [own] * len(found)
        # Half of the rows give the floors by their distance to the centroids of the other half.
        floor.append(_floors(column[1::2].to_pylist() or column.to_pylist(), idf, _cluster(x[::2], centroids)))
    if not centres:
        return _Nothing(idf)
    return Model(languages, idf, np.concatenate(centres), np.array(owner), np.array(floor))


class _Nothing(Model):
    """What is learnt from no rows."""

    def __init__(self, idf: np.ndarray):
        super().__init__([UNKNOWN], idf, np.zeros((1, DIMENSIONS), np.float32), np.zeros(1, int), np.full((1, len(SIZES)), 2.0))


def identify(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """docs with lang_pred, score (cosine to the nearest centroid) and accepted.

    Null texts and texts without a letter are ``und`` with score 0 and are not
    accepted; a text whose best cosine is below the floor of its language and
    size keeps the nearest language and is not accepted.  Ties go to the
    first language by name.  Rows are neither moved nor dropped; clashing columns are replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        def step(column):
            names, scores, accepted = shared.value.predict(column)
            return [pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(accepted, pa.bool_())]

        return step

    return map_rows(docs, [text], [("lang_pred", T.StringType()), ("score", T.DoubleType()), ("accepted", T.BooleanType())], make)


def held_out(folds: int, fold: int, key: str = "doc_id"):
    """crc32 of the key as text modulo folds is fold; false for a null key."""
    return F.coalesce(F.crc32(F.col(key).cast("string")) % folds == fold, F.lit(False))


def op6(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    model = fit(docs.filter(~held_out(3, 1)))
    marked = docs.select("doc_id", held_out(3, 1).alias("held_out"), "text")
    return identify(marked, model).select("doc_id", "held_out", "lang_pred", "score", "accepted")
