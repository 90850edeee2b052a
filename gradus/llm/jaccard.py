"""N-gram Jaccard join: size-banded tiles, hashed bitmap signatures, exact intersections.

The distinct n-gram hashes of a text are a set.  Texts with the same set are
one class; links are sought between classes.

Tiles.  Classes whose sizes may link share a size band.  In a band, sets that
reach the threshold differ in at most D elements, so if the hash range is cut
into D + 1 + R equal segments, R + 1 of them at least hold the same elements in
both.  A tile is a band, a segment and the sum of the hashed elements in it;
only classes that meet in a tile are compared.  Segments without elements have
no tile, so texts without a common n-gram never meet; nothing is missed, as
sets with more than R such segments have further tiles (see ``_segments``).

Comparison.  A signature's bit tells whether an odd number of elements falls on
it, so the bits in which two signatures differ are at most the elements in
which the sets differ, which bounds the overlap from above; pairs that pass are
verified by intersecting sorted arrays.

Groups of any size.  In two rounds every tile names a hub, and each class is
compared with one hub alone, which is linear and links most copies; the classes
of tiles that then still hold unlinked ones are compared in full, cut into
blocks of rows that are paired by block, so no task holds more than two blocks
of a tile.  Of a block's pairs that signatures leave open first only a spanning
set is verified; then all that are still unlinked.
"""

from __future__ import annotations

from fractions import Fraction
from functools import lru_cache
from math import exp

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textkit as tk
from .common import Workspace, components, with_keys

#: Upper ends of bands grow by this; rows of a tile that are compared with each other at once; groups, in
#: 16ths, that a hub's pairs are dealt to; bits of a signature; tile rows sent at once; rounds of comparing with hubs alone.
BAND_GROWTH = 1.25
BLOCK = 512
MEMBERS = 64
MAX_BITS = 1 << 15
TILE_ROWS = 1 << 17
HUB_ROUNDS = 2


@lru_cache(maxsize=64)
def _bands(percent: int, most: int) -> tuple[list[tuple[int, int, int, int]], np.ndarray]:
    """(least, greatest, segments, reserve) of bands of the smaller set's size up to ``most``; their greatest sizes."""
    t = Fraction(percent, 100)
    low, out = 1, []
    while low <= most:
        high = max(low, int(low * BAND_GROWTH))
        # The greatest difference of two linked sets of which the smaller has ``high`` elements.
        other = int(high / t)
        differ = int((1 - t) / (1 + t) * (high + other))
        # As many in reserve as the band's least sets have empty ones, give or take two deviations.
        reserve = 0
        while differ and reserve < (e := (differ + 1 + reserve) * exp(-low / (differ + 1 + reserve))) + 2 * e**0.5 and reserve <= differ:
            reserve += 1
        out.append((low, high, differ + 1 + reserve, reserve))
        low = high + 1
    return out, np.array([b[1] for b in out])


def shingles(w: tk.Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and rows of all n-grams; a row of fewer words has its whole sequence as one."""
    h, at = tk.windows(w.hash, w.doc, size)
    doc = w.doc[at]
    for short in range(1, size):
        rows = np.flatnonzero(w.count == short)
        if len(rows):
            keep = np.isin(w.doc, rows)
            hs, a = tk.windows(w.hash[keep], w.doc[keep], short)
            h, doc = np.concatenate([h, hs]), np.concatenate([doc, w.doc[keep][a]])
    return h, doc


def _sets(column: pa.Array, size: int):
    """Sorted distinct n-gram hashes of every text, row by row."""
    for c in tk.chunks(column):
        w = tk.words(c.data, c.offsets, tk.SPACED)
        h, doc = shingles(w, size)
        order = np.argsort(doc, kind="stable")
        h = h[order]
        at = np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=c.last - c.first))])
        for k in range(c.last - c.first):
            own = h[at[k] : at[k + 1]]
            if len(own) > 1:
                own = np.sort(own)
                own = own[np.concatenate([[True], own[1:] != own[:-1]])]
            yield own


def _class(own: np.ndarray) -> int:
    """A 64-bit hash of the set, which names the class; at 10**9 different sets two share one with a chance of 3 %."""
    return int(tk.mix(tk.mix(own + np.uint64(0x1234567)).sum(keepdims=True, dtype=np.uint64)).view(np.int64)[0]) if len(own) else 0


def _bitmap(own: np.ndarray, finer: int) -> bytes:
    """One to two bits for each element, times 2 ** finer, 64 at least: whether an odd number of elements falls on the bit."""
    bits = min(MAX_BITS, 1 << max(6, int(len(own) - 1).bit_length() + finer))
    at = (tk.mix(own) >> np.uint64(64 - bits.bit_length() + 1)).astype(np.int64)
    return np.packbits((np.bincount(at, minlength=bits) & 1).astype(np.uint8)).tobytes()


def _fold(x: np.ndarray, width: int) -> np.ndarray:
    """A bitmap as if made with fewer bits: leading bits of a hash choose the bit, so neighbours merge."""
    return np.packbits(np.unpackbits(x).reshape(width * 8, -1).sum(axis=1).astype(np.uint8) & 1) if len(x) > width else x


def _may_link(a: np.ndarray, b: np.ndarray, n_a: int, n_b: int, percent: int) -> bool:
    """Each bit that differs takes an element that one set lacks, so few common elements are left."""
    width = min(len(a), len(b))
    differ = int(np.bitwise_count(_fold(a, width) ^ _fold(b, width)).sum())
    overlap = min((n_a + n_b - differ) // 2, n_a, n_b)
    return 100 * overlap >= percent * (n_a + n_b - overlap)


def _linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Sorted distinct arrays: exact size of the intersection."""
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    if not len(small):
        return False
    at = np.searchsorted(large, small)
    overlap = int((large[np.minimum(at, len(large) - 1)] == small).sum())
    return 100 * overlap >= percent * (len(a) + len(b) - overlap)


def _segments(own: np.ndarray, percent: int) -> list[int]:
    """Tile keys of a set: those of its own band, and of bands in which it may be the larger set.

    Of a band's R + 1 + D segments two linked sets disagree in at most D.  If
    one of them has no more than R empty segments, one that agrees has
    elements.  Where both have more, they meet by single elements: linked sets
    share one of their n - percent * n + 1 least, so such sets have a key for
    each of these too.
    """
    n = len(own)
    bands, ends = _bands(percent, max(16, 1 << int(n).bit_length()))
    first = int(np.searchsorted(ends, -(-n * percent // 100)))
    last = int(np.searchsorted(ends, n))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(tk.mix(own + np.uint64(0x77777)), dtype=np.uint64)])
    keys = []
    for band in range(first, last + 1):
        _, _, count, reserve = bands[band]
        edges = np.append((np.arange(count, dtype=np.float64) * (2.0**64 / count)).astype(np.uint64), np.uint64(2**64 - 1))
        at = np.searchsorted(own, edges)
        at[-1] = n
        key = sums[at[1:]] - sums[at[:-1]]
        full = at[1:] > at[:-1]
        keys.append(tk.mix(key + tk.mix(np.arange(count, dtype=np.uint64) + np.uint64((band << 32) + 1)))[full])
        if count - full.sum() > reserve:
            keys.append(tk.mix(own[: n - -(-n * percent // 100) + 1] + tk.mix(np.array([(band << 32) + (1 << 31)], np.uint64))))
    return np.concatenate(keys)


def classes(docs: DataFrame, size: int, text: str, key: str) -> DataFrame:
    """(key, n_shingles, cls, bitmap) of every row; one scan."""
    kind = docs.schema[key].dataType
    schema = T.StructType([T.StructField(key, kind), T.StructField("n_shingles", T.LongType()), T.StructField("cls", T.LongType())])

    def run(batches):
        for batch in batches:
            n, c = [], []
            for own in _sets(batch.column(1), size):
                n.append(len(own))
                c.append(_class(own))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(c, pa.int64())], names=[key, "n_shingles", "cls"])

    return docs.select(F.col(key), F.col(text).cast("string")).mapInArrow(run, schema)


def _tiles(docs: DataFrame, size: int, percent: int, text: str, turn: int = 0, turns: int = 1) -> DataFrame:
    """(tile, cls, n) of every class that can link, of tiles of one turn; classes that a batch repeats are written once."""

    def run(batches):
        for batch in batches:
            seen, tiles, cls, ns, held = set(), [], [], [], 0

            def flush():
                return pa.RecordBatch.from_arrays([pa.array(np.concatenate(tiles).view(np.int64)), pa.array(np.concatenate(cls)), pa.array(np.concatenate(ns))], names=["tile", "cls", "n"])

            for own in _sets(batch.column(0), size):
                n = len(own)
                if not n or _alone(n, percent):
                    continue
                c = _class(own)
                if c in seen:
                    continue
                seen.add(c)
                keys = _segments(own, percent)
                if turns > 1:
                    keys = keys[keys % np.uint64(turns) == turn]
                tiles.append(keys)
                cls.append(np.full(len(keys), c, np.int64))
                ns.append(np.full(len(keys), n, np.int32))
                held += len(keys)
                if held >= TILE_ROWS:
                    yield flush()
                    tiles, cls, ns, held = [], [], [], 0
            if tiles:
                yield flush()

    return docs.select(F.col(text).cast("string")).mapInArrow(run, "tile long, cls long, n int")


def _alone(n: int, percent: int) -> bool:
    """Whether a set of n elements links with equal sets only: n of n + 1 is the most that it can share."""
    return 100 * n < percent * (n + 1)


def _bitmaps(docs: DataFrame, size: int, text: str) -> DataFrame:
    """(cls, n, coarse, bits): signatures that sort out most pairs of a tile, and finer ones for what is left."""

    def run(batches):
        for batch in batches:
            seen, c, n, coarse, bits = set(), [], [], [], []
            for own in _sets(batch.column(0), size):
                x = _class(own)
                if len(own) and x not in seen:
                    seen.add(x)
                    c.append(x)
                    n.append(len(own))
                    coarse.append(_bitmap(own, 0))
                    bits.append(_bitmap(own, 2))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()), pa.array(n, pa.int32()), pa.array(coarse, pa.binary()), pa.array(bits, pa.binary())], names=["cls", "n", "coarse", "bits"])

    return docs.select(F.col(text).cast("string")).mapInArrow(run, "cls long, n int, coarse binary, bits binary")


def _verified(pairs: DataFrame, owners: DataFrame, docs: DataFrame, size: int, percent: int, text: str, key: str, work: Workspace, name: str) -> DataFrame:
    """Pairs (u, v) of classes whose sets link.

    A pair goes to its second class; the texts of the classes that occur are
    sent to the hubs they are compared with, at most MEMBERS to a task's group,
    and n-grams are made anew there, as texts are smaller than their arrays.
    """
    spread = pairs.select(F.col("u"), F.col("v"), F.pmod(F.xxhash64("u", "v"), F.lit(MEMBERS * 16)).cast("int").alias("part"))
    wanted = spread.select(F.col("u").alias("cls"), F.col("v").alias("hub"), "part", F.lit(1).alias("role")).unionAll(
        spread.select("v", "part").distinct().select(F.col("v").alias("cls"), F.col("v").alias("hub"), "part", F.lit(0).alias("role"))
    )
    holders = wanted.join(owners, "cls").select("rep", "cls", "hub", "part", "role")
    rows = with_keys(docs.select(F.col(key).alias("rep"), F.col(text).cast("string").alias("t")), "rep", holders.select("rep"), work, name)
    texts = rows.join(holders, "rep").select("hub", "part", "role", "cls", "t")
    dealt = texts.repartition("hub", "part").sortWithinPartitions("hub", "part", "role")

    def run(batches):
        hub, held = None, None
        for batch in batches:
            u, v = [], []
            hubs, parts, roles, cls = (batch.column(i).to_pylist() for i in range(4))
            for i, own in enumerate(_sets(batch.column(4), size)):
                if _class(own) != cls[i]:  # another text of a repeated key
                    continue
                if roles[i] == 0:
                    hub, held = (hubs[i], parts[i]), own
                elif hub == (hubs[i], parts[i]) and _linked(own, held, percent):
                    u.append(cls[i])
                    v.append(hubs[i])
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

    return dealt.mapInArrow(run, "u long, v long")


def _screened(pairs: DataFrame, bitmaps: DataFrame, percent: int) -> DataFrame:
    """Pairs that bitmap signatures don't rule out."""
    a = bitmaps.select(F.col("cls").alias("u"), F.col("n").alias("n_u"), F.col("bits").alias("b_u"))
    b = bitmaps.select(F.col("cls").alias("v"), F.col("n").alias("n_v"), F.col("bits").alias("b_v"))
    both = pairs.join(a, "u").join(b, "v").select("u", "v", "n_u", "n_v", "b_u", "b_v")

    def run(batches):
        for batch in batches:
            u, v, n, m, x, y = (batch.column(i).to_pylist() for i in range(6))
            keep = [_may_link(np.frombuffer(x[i], np.uint8), np.frombuffer(y[i], np.uint8), n[i], m[i], percent) for i in range(len(u))]
            yield pa.RecordBatch.from_arrays([pa.array([p for p, k in zip(q, keep, strict=True) if k], pa.int64()) for q in (u, v)], names=["u", "v"])

    return both.mapInArrow(run, "u long, v long")


def _blocks(entries: DataFrame, bitmaps: DataFrame, percent: int, work: Workspace, what: str) -> DataFrame:
    """Unlinked classes of a tile that bitmaps don't rule out, over pairs of blocks of its rows.

    ``met``: (tile, cls) of classes that coarse bitmaps leave a partner;
    ``spanning``: as many pairs (u, v) as would link a block's classes if all
    were verified, the likeliest first; ``all``: all pairs (u, v).
    """
    sizes = entries.groupBy("tile").agg(F.count("*").alias("g")).withColumn("parts", F.ceil(F.col("g") / BLOCK).cast("int"))
    sizes = work.save(sizes, f"sizes_{what}")
    own = F.pmod(F.xxhash64("cls"), F.col("parts")).cast("int")
    rows = entries.join(sizes, "tile").withColumn("own", own).withColumn("other", F.explode(F.expr("sequence(0, parts - 1)")))
    rows = rows.select("tile", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "cls", "root")
    rows = rows.join(bitmaps.select("cls", "n", F.col("coarse" if what == "met" else "bits").alias("bits")), "cls").select("tile", "i", "j", "own", "cls", "root", "n", "bits")
    dealt = rows.repartition("tile", "i", "j").sortWithinPartitions("tile", "i", "j")

    def pairs(group):
        """Vectorised over the rows of a block: a row's signature against those of all rows after it."""
        width = min(len(r[7]) for r in group)
        bits = np.ascontiguousarray(np.stack([_fold(r[7], width) for r in group])).view(np.uint64)
        own, cls, root, n = (np.array([r[i] for r in group]) for i in (3, 4, 5, 6))
        within = group[0][1] == group[0][2]
        first, second, spare = [], [], []
        for k in range(len(group) - 1):
            rest = slice(k + 1, None)
            near = (root[rest] != root[k]) & (100 * np.minimum(n[rest], n[k]) >= percent * np.maximum(n[rest], n[k]))
            if not within:  # a pair of one block is compared where that block meets itself
                near &= own[rest] != own[k]
            at = np.flatnonzero(near) + k + 1
            if not len(at):
                continue
            differ = np.bitwise_count(bits[at] ^ bits[k]).sum(axis=1, dtype=np.int64)
            overlap = np.minimum((n[at] + n[k] - differ) // 2, np.minimum(n[at], n[k]))
            over = 100 * overlap - percent * (n[at] + n[k] - overlap)
            ok = over >= 0
            first.append(np.full(int(ok.sum()), k))
            second.append(at[ok])
            spare.append(over[ok])
        if not first:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        i, j = np.concatenate(first), np.concatenate(second)
        if what == "met":
            hit = np.unique(np.concatenate([i, j]))
            return np.full(len(hit), group[0][0], np.int64), cls[hit]
        if what == "spanning":
            names, code = np.unique(root, return_inverse=True)
            parent = list(range(len(names)))

            def find(x):
                while parent[x] != x:
                    parent[x] = parent[parent[x]]
                    x = parent[x]
                return x

            keep, left = [], len(names) - 1
            for e in np.argsort(-np.concatenate(spare), kind="stable").tolist():
                x, y = find(code[i[e]]), find(code[j[e]])
                if x != y:
                    parent[x] = y
                    keep.append(e)
                    left -= 1
                    if not left:
                        break
            i, j = i[keep], j[keep]
        return np.maximum(cls[i], cls[j]), np.minimum(cls[i], cls[j])

    def run(batches):
        at, group = None, []

        def flush():
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in pairs(group)], names=["u", "v"])

        for batch in batches:
            columns = [batch.column(i).to_pylist() for i in range(8)]
            for row in zip(*columns, strict=True):
                if row[:3] != at:
                    if len(group) > 1:
                        yield flush()
                    at, group = row[:3], []
                group.append((*row[:7], np.frombuffer(row[7], np.uint8)))
        if len(group) > 1:
            yield flush()

    found = dealt.mapInArrow(run, "u long, v long").distinct()
    return found.toDF("tile", "cls") if what == "met" else found


def join_components(docs: DataFrame, size: int = 3, percent: int = 90, text: str = "text", key: str = "doc_id", turns: int | None = None) -> DataFrame:
    """(key, n_shingles, component_id) of every row of docs.

    Words are maximal runs without ASCII white space, with A-Z lower-cased; a
    set has the distinct n-grams of ``size`` words, or the whole sequence of a
    shorter text.  Rows link when 100 * intersection >= percent * union;
    component_id is the least key reachable by links, the row's own included.
    Null texts and texts without words have n_shingles 0 and link with nothing.
    Rows that repeat a key are rows of their own.  A row with a null key has
    the component of the rows with its set; a set that only such rows have
    links with nothing.  Other columns of docs are not read.  No rows give no
    rows.

    Lower thresholds need more segments.  So that shuffle files stay a fraction
    of the input, tiles are then made in ``turns`` (a scan for each), of which
    each leaves only the tiles in which classes meet.
    """
    turns = turns or max(1, -(-(100 - percent) // 8) - 1)
    spark = docs.sparkSession
    work = Workspace(spark, "jaccard")
    rows = work.save(classes(docs, size, text, key), "classes")
    # The text of one row stands for a class.
    owners = rows.filter(F.col("n_shingles") > 0).groupBy("cls").agg(F.min(key).alias("rep"))
    entries = None
    for turn in range(turns):
        tiles = _tiles(docs, size, percent, text, turn, turns)
        # Written, so that both sides of the join are plain shuffles, which the planner may split where a tile has many rows.
        met = work.save(tiles.groupBy("tile").agg(F.min("cls").alias("a"), F.max("cls").alias("b")).filter("a <> b").select("tile"), f"met{turn}")
        part = work.save(tiles.join(met, "tile").select("tile", "cls", "n").distinct(), f"entries{turn}")
        entries = part if entries is None else entries.unionAll(part)
        if turns > 1:
            work.release()
    # Tiles with the same classes ask for the same comparisons: one of them stays, with their number.
    sets = entries.groupBy("tile").agg(F.count("*").alias("c"), F.sum(F.xxhash64("cls").cast("decimal(38,0)")).alias("s"), F.min("cls").alias("a"), F.max("cls").alias("b"))
    kept = sets.groupBy("c", "s", "a", "b").agg(F.min("tile").alias("tile"), F.count("*").alias("weight")).select("tile", "weight")
    entries = work.save(entries.join(kept, "tile").select("tile", "cls", "n", "weight"), "tiles")
    work.drop(*[f"{name}{turn}" for turn in range(turns) for name in ("entries", "met")])
    bitmaps = None
    links = None
    left = entries.withColumn("root", F.col("cls"))
    tested = None
    for step in range(HUB_ROUNDS + 2):
        if left.isEmpty():
            break
        if bitmaps is None:
            bitmaps = work.save(_bitmaps(docs, size, text).join(entries.select("cls").distinct(), "cls", "left_semi").groupBy("cls").agg(F.first("n").alias("n"), F.first("coarse").alias("coarse"), F.first("bits").alias("bits")), "bitmaps")
        if step < HUB_ROUNDS:
            # The class that shares the most tiles is what others are copies of.  Each class takes the hub that it meets most.
            degree = left.groupBy("cls").agg(F.sum("weight").alias("degree"))
            known = left.join(degree, "cls")
            hubs = known.groupBy("tile").agg(F.max_by(F.struct("cls", "n", "root"), F.struct("degree", F.xxhash64(F.lit(step), "cls"))).alias("h")).select("tile", "h.*").toDF("tile", "hub", "n_hub", "hub_root")
            hubs = work.save(hubs, f"hubs{step}")
            near = (F.col("root") != F.col("hub_root")) & (100 * F.least("n", "n_hub") >= percent * F.greatest("n", "n_hub"))
            met_by = left.join(hubs, "tile").filter(near).groupBy("cls", "hub").agg(F.sum("weight").alias("shared"))
            if tested is not None:
                met_by = met_by.withColumns({"u": F.greatest("cls", "hub"), "v": F.least("cls", "hub")}).join(tested, ["u", "v"], "left_anti")
            pairs = met_by.groupBy("cls").agg(F.max_by("hub", F.struct("shared", "hub")).alias("v")).select(F.col("cls").alias("u"), "v")
            pairs = work.save(_screened(pairs, bitmaps, percent), f"pairs{step}")
        else:
            # First what would link the rest, then, of what is still unlinked, all that was not tested.
            if step == HUB_ROUNDS:
                left = work.save(left.join(work.save(_blocks(left, bitmaps, percent, work, "met"), "met"), ["tile", "cls"], "left_semi"), "open")
            met_by = _blocks(left, bitmaps, percent, work, "spanning" if step == HUB_ROUNDS else "all")
            pairs = work.save(met_by if tested is None else met_by.join(tested, ["u", "v"], "left_anti"), f"pairs{step}")
        here = pairs.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        tested = here if tested is None else tested.unionAll(here)
        found = work.save(_verified(pairs, owners, docs, size, percent, text, key, work, f"ids{step}"), f"links{step}")
        links = found if links is None else links.unionAll(found)
        roots = components(links, work, f"cc{step}_")
        if step == HUB_ROUNDS + 1:
            break
        # A tile stays open as long as its classes are not all linked.
        rest = left.drop("root").join(roots.withColumnRenamed("node", "cls"), "cls", "left").withColumn("root", F.coalesce("root", "cls"))
        rest = work.save(rest, f"rest{step}")
        open_ = rest.groupBy("tile").agg(F.min("root").alias("a"), F.max("root").alias("b")).filter("a <> b").select("tile")
        open_ = work.save(open_, f"open{step}")
        left = work.save(rest.join(open_, "tile").select("tile", "cls", "n", "weight", "root"), f"left{step}")
    if links is None:
        named = rows.groupBy("cls", "n_shingles").agg(F.min(key).alias("component_id"))
    else:
        grouped = owners.join(roots.withColumnRenamed("node", "cls"), "cls", "left").withColumn("root", F.coalesce("root", "cls"))
        least = grouped.groupBy("root").agg(F.min("rep").alias("component_id"))
        named = grouped.join(least, "root").select("cls", "component_id")
    if links is None:
        named = named.filter("n_shingles > 0").select("cls", "component_id")
    out = rows.join(named, "cls", "left")
    return work.finish(out.select(F.col(key), "n_shingles", F.when(F.col("n_shingles") == 0, F.col(key)).otherwise(F.col("component_id")).alias("component_id")))


def one_of_each(docs: DataFrame, size: int = 5, percent: int = 80, text: str = "text", key: str = "doc_id", turns: int | None = None) -> DataFrame:
    """docs with one row of each group of linked rows (see ``join_components``).

    Rows are told apart by a hash of all their columns, so repeated and null
    keys do no harm.  Of a group the row with the least key stays, null keys
    after all others, then the one with the least hash; of equal rows with
    words one stays.  Rows without words link with nothing and all stay.
    """
    spark = docs.sparkSession
    work = Workspace(spark, "one-of-each")
    names = docs.columns
    row = F.xxhash64(*[F.col(f"`{c}`") for c in names])
    keyed = docs.select(row.alias("__row"), F.col(f"`{key}`").alias("__key"), F.col(f"`{text}`").alias("__text"))
    found = join_components(keyed, size, percent, "__text", "__row", turns)
    rows = work.save(found.filter("n_shingles > 0").groupBy("__row", "component_id").agg(F.count("*").alias("n")), "rows")
    groups = rows.groupBy("component_id").agg(F.sum("n").alias("rows")).filter("rows > 1")
    shared = work.save(rows.join(groups, "component_id").select("__row", "component_id", "n"), "shared")
    ids = with_keys(keyed.select("__row", "__key"), "__row", shared.select("__row"), work, "ids").distinct()
    order = F.struct(F.col("__key").isNull().alias("none"), "__key", "__row")
    first = shared.join(ids, "__row").groupBy("component_id").agg(F.min(order).alias("first")).select("component_id", F.col("first.__row").alias("kept"))
    # Rows that go, and rows that stay once though they occur several times.
    marked = shared.join(first, "component_id").select("__row", (F.col("__row") != F.col("kept")).alias("gone"), "n")
    marked = work.save(marked.filter("gone or n > 1").select("__row", "gone"), "marked")
    every = docs.withColumn("__row", row).join(marked, "__row", "left")
    out = every.filter("gone is null")
    if not marked.filter("not gone").isEmpty():
        out = out.unionAll(every.filter("not gone").dropDuplicates(["__row"]))
    return work.finish(out.select(*[F.col(f"`{c}`") for c in names]))


def op1(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return join_components(docs)


OP1_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + least(3, len(w)) - 1), ' ') || '/' || least(3, len(w)) AS g
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - least(3, len(w)) + 2)) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
x AS (SELECT s.doc_id, s.g, n.n FROM s JOIN n USING (doc_id)),
p AS (
  SELECT a.doc_id AS u, b.doc_id AS v FROM x a JOIN x b ON a.g = b.g AND a.doc_id < b.doc_id AND 100 * least(a.n, b.n) >= 90 * greatest(a.n, b.n)
  GROUP BY 1, 2, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))),
e AS (SELECT u, v FROM p UNION ALL SELECT v, u FROM p),
r AS (SELECT doc_id AS node, doc_id AS root FROM documents UNION SELECT e.v, r.root FROM r JOIN e ON e.u = r.node)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, min(r.root) AS component_id
FROM documents d LEFT JOIN n USING (doc_id) JOIN r ON r.node = d.doc_id GROUP BY 1, 2
"""
