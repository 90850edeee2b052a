"""Passages that repeat across documents: seeds, collinear chains, aligned ends.

Seeds are minimizers of 5-mers of words: of any five in a row the least hash,
so nine equal words share one for sure and scattered edits leave several in a
passage.  Documents that share two seeds or more with a hub of these seeds are
compared with it: the k-mers that both texts share are chained in order, with
gap costs, by a Fenwick tree of best chain ends, and chains are extended word
by word.  A seed's hubs are its first and its last document.  What no passage
covers then is tried again by keys of several seeds in a row, whose first and
last documents share more of it.  A seed in any number of documents therefore
makes rows in proportion to them.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from . import textkit as tk
from .common import Workspace, with_keys

SEED_WORDS = 5
#: Of so many k-mers in a row one is a seed; words of the k-mers that chains are made of.
WINDOW = 5
CHAIN_WORDS = 4
#: Least words of a passage; least share of its words that match in order; words that a chain may skip; cost of a skipped word.
LEAST_WORDS = 50
LEAST_SIMILARITY = 0.8
MOST_GAP = 16
GAP_COST = 0.25
#: A hub's documents are dealt to so many tasks' groups; seeds are shuffled in so many slices, one after the other;
#: documents of a seed all of whose pairs the first round compares; seeds of longer keys, of some 16, 28 and 40 words; k-mers with
#: more pairs in two texts are paired in order.
PARTS = 256
SLICES = 4
USED_UP = 3
KEY_SEEDS = (4, 8, 12)
MOST_PAIRS = 16


def _minimizers(w: tk.Words) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and first words of the seeds of each row: the least of WINDOW k-mers, of fewer if a row has no more."""
    h, at = tk.windows(w.hash, w.doc, SEED_WORDS)
    if not len(h):
        return h, at
    doc = w.doc[at]
    best = np.arange(len(h))
    for step in range(1, WINDOW):  # the least of a k-mer and the step ones after it in its row
        n = len(h) - step
        if n <= 0:
            break
        better = (doc[step:] == doc[:n]) & (h[step:] < h[best[:n]])
        best[:n][better] = np.arange(step, len(h))[better]
    last = np.append(doc[1:] != doc[:-1], True)
    room = np.zeros(len(h), bool)  # windows cut off by the row's end repeat what the row's last whole one has
    room[: max(0, len(h) - WINDOW + 1)] = doc[WINDOW - 1 :] == doc[: max(0, len(h) - WINDOW + 1)]
    first = np.concatenate([[True], last[:-1]])
    use = np.unique(best[room | first])
    return h[use], at[use]


def _seeds(docs: DataFrame, text: str, key: str) -> DataFrame:
    """(seed, doc, pos): the seeds of each text."""
    kind = docs.schema[key].dataType

    def run(batches):
        for batch in batches:
            for c in tk.chunks(batch.column(1)):
                w = tk.words(c.data, c.offsets, tk.ALNUM)
                ends = np.concatenate([[0], np.cumsum(w.count)])
                h, at = _minimizers(w)
                own = w.doc[at]
                use = np.flatnonzero(w.count[own] >= LEAST_WORDS)
                h, at, own = h[use], at[use], own[use]
                if len(h):
                    yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), batch.column(0).take(pa.array(c.first + own)), pa.array((at - ends[own]).astype(np.int32))], names=["seed", "doc", "pos"])

    schema = T.StructType([T.StructField("seed", T.LongType()), T.StructField("doc", kind), T.StructField("pos", T.IntegerType())])
    return docs.select(F.col(key), F.col(text).cast("string")).filter(F.col(key).isNotNull()).mapInArrow(run, schema)


class _Fenwick:
    """Greatest value over prefixes, with its owner."""

    def __init__(self, n: int):
        self.n, self.value, self.owner = n, [-1e18] * (n + 1), [-1] * (n + 1)

    def put(self, i: int, value: float, owner: int) -> None:
        i += 1
        while i <= self.n:
            if value > self.value[i]:
                self.value[i], self.owner[i] = value, owner
            i += i & -i

    def best(self, i: int) -> tuple[float, int]:
        value, owner = -1e18, -1
        while i > 0:
            if self.value[i] > value:
                value, owner = self.value[i], self.owner[i]
            i -= i & -i
        return value, owner


def _ranked(h: np.ndarray) -> np.ndarray:
    """h with its occurrence number mixed in: the r-th of one text meets the r-th of the other."""
    order = np.argsort(h, kind="stable")
    s = h[order]
    new = np.concatenate([[True], s[1:] != s[:-1]])
    start = np.maximum.accumulate(np.where(new, np.arange(len(s)), 0))
    out = np.empty_like(h)
    out[order] = tk.mix(s + (np.arange(len(s)) - start).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return out


class _Text:
    """Word hashes of a text and its k-mers in order of their hashes; a hub's are made once for all its documents."""

    def __init__(self, words: np.ndarray):
        self.words = words
        self.kmers, _ = tk.windows(words, np.zeros(len(words), np.int64), CHAIN_WORDS)
        self.order = np.argsort(self.kmers, kind="stable")
        s = self.kmers[self.order]
        self.first = np.flatnonzero(np.append(True, s[1:] != s[:-1])[: len(s)])
        self.distinct, self.count = s[self.first], np.diff(self.first, append=len(s))


def _common(a: _Text, b: _Text) -> tuple[np.ndarray, np.ndarray]:
    """Positions of equal k-mers: all pairs of a k-mer with at most MOST_PAIRS of them, else its r-th with its r-th."""
    at = np.minimum(np.searchsorted(b.distinct, a.distinct), len(b.distinct) - 1)
    x = np.flatnonzero(b.distinct[at] == a.distinct)
    y = at[x]
    few = a.count[x] * b.count[y] <= MOST_PAIRS
    x1, y1 = x[few], y[few]
    reps = a.count[x1] * b.count[y1]
    at = np.arange(reps.sum()) - np.repeat(np.cumsum(reps) - reps, reps)
    width = np.repeat(b.count[y1], reps)
    i, j = a.order[np.repeat(a.first[x1], reps) + at // width], b.order[np.repeat(b.first[y1], reps) + at % width]
    if few.all():
        return i, j
    many_a, many_b = (np.sort(t.order[np.isin(t.kmers[t.order], t.distinct[z[~few]])]) for t, z in ((a, x), (b, y)))
    _, k, m = np.intersect1d(_ranked(a.kmers[many_a]), _ranked(b.kmers[many_b]), assume_unique=True, return_indices=True)
    return np.concatenate([i, many_a[k]]), np.concatenate([j, many_b[m]])


def chains(a: np.ndarray, b: np.ndarray | _Text) -> list[tuple[int, int, int, int, int]]:
    """(start_a, end_a, start_b, end_b, matched words) of passages of two texts, given as word hashes (b also as a text made before).

    Shared k-mers are merged to runs on one diagonal; a run's best chain is the
    best of those that end before it in both texts, less the gap cost.
    """
    one, other = _Text(a), b if isinstance(b, _Text) else _Text(b)
    b = other.words
    if not len(one.kmers) or not len(other.kmers):
        return []
    i, j = _common(one, other)
    if not len(i):
        return []
    order = np.lexsort((i, j - i))
    i, j = i[order], j[order]
    new = np.concatenate([[True], (j[1:] - i[1:] != j[:-1] - i[:-1]) | (i[1:] - i[:-1] > 2 * CHAIN_WORDS)])
    at = np.flatnonzero(new)
    last = np.append(at[1:], len(i)) - 1
    size = i[last] - i[at] + CHAIN_WORDS
    if size.sum() < LEAST_WORDS // 3:
        return []
    runs = sorted(zip(i[at].tolist(), j[at].tolist(), size.tolist(), strict=True))
    # Ends are put into the tree in the order of their place in a; value + cost * (end_a + end_b) makes gaps additive.
    ends_b = sorted({y + n for _, y, n in runs})
    place = {e: k for k, e in enumerate(ends_b)}
    tree, score, back = _Fenwick(len(ends_b)), [0.0] * len(runs), [-1] * len(runs)
    waiting = sorted(range(len(runs)), key=lambda r: runs[r][0] + runs[r][2])
    done = 0
    bounds = np.array(ends_b)
    slots = np.searchsorted(bounds, [y for _, y, _ in runs], "right").tolist()
    for r, (x, y, n) in enumerate(runs):
        while done < len(waiting) and runs[waiting[done]][0] + runs[waiting[done]][2] <= x:
            q = waiting[done]
            e, f = runs[q][0] + runs[q][2], runs[q][1] + runs[q][2]
            tree.put(place[f], score[q] + GAP_COST * (e + f), q)
            done += 1
        value, owner = tree.best(slots[r])
        linked = value - GAP_COST * (x + y)
        score[r] = n + max(0.0, linked)
        back[r] = owner if linked > 0 else -1
    out, used = [], set()
    for r in sorted(range(len(runs)), key=lambda q: -score[q]):
        if r in used:
            continue
        chain = []
        while r != -1 and r not in used:
            used.add(r)
            chain.append(runs[r])
            r = back[r]
        chain.reverse()
        start = 0
        for k in range(1, len(chain) + 1):  # cut where more is skipped than a passage may
            if k == len(chain) or max(chain[k][0] - chain[k - 1][0] - chain[k - 1][2], chain[k][1] - chain[k - 1][1] - chain[k - 1][2]) > MOST_GAP:
                out += _passages(a, b, chain[start:k])
                start = k
    return sorted(set(out))


def _common_words(x: list, y: list) -> int:
    """Length of the longest common subsequence of two short lists."""
    row = [0] * (len(y) + 1)
    for v in x:
        before = 0
        for k, w in enumerate(y):
            here = row[k + 1]
            row[k + 1] = before + 1 if v == w else max(here, row[k])
            before = here
    return row[-1]


def _passages(a: np.ndarray, b: np.ndarray, chain: list[tuple[int, int, int]]) -> list[tuple[int, int, int, int, int]]:
    """Passages of a chain: runs at its ends go as long as too few words match; what goes is looked at by itself."""
    own = [int((a[x : x + n] == b[y : y + n]).sum()) for x, y, n in chain]
    gaps = [0]
    for (p, q, m), (x, y, _) in zip(chain, chain[1:]):
        ga, gb = a[p + m : x], b[q + m : y]
        gaps.append(_common_words(ga.tolist(), gb.tolist()) if len(ga) and len(gb) else 0)
    out, todo = [], [(0, len(chain))]
    while todo:
        first, end = todo.pop()
        low, high = first, end
        total = sum(own[low:high]) + sum(gaps[low + 1 : high])
        share = lambda u, v, m: m / max(chain[v][0] + chain[v][2] - chain[u][0], chain[v][1] + chain[v][2] - chain[u][1])
        while high - low > 1 and share(low, high - 1, total) < LEAST_SIMILARITY:
            left, right = total - own[low] - gaps[low + 1], total - own[high - 1] - gaps[high - 1]
            if share(low + 1, high - 1, left) >= share(low, high - 2, right):
                low, total = low + 1, left
            else:
                high, total = high - 1, right
        found = _extended(a, b, chain[low], chain[high - 1], total)
        if found is not None:
            out.append(found)
        if (low, high) != (first, end):
            todo += [(u, v) for u, v in ((first, low), (high, end)) if u < v]
    return out


def _equal(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the common prefix."""
    n = min(len(a), len(b))
    differ = np.flatnonzero(a[:n] != b[:n])
    return int(differ[0]) if len(differ) else n


#: Words that an end may skip in either text to go on.
SKIPS = [(1, 1), (1, 0), (0, 1), (2, 2), (2, 1), (1, 2), (2, 0), (0, 2)]


def _reach(a: np.ndarray, b: np.ndarray, matched: int, span_a: int, span_b: int, least: int) -> tuple[int, int, int]:
    """Words of either text by which an end may go on, and those of them that match, while enough match in all; ``least`` equal words stand behind what is skipped."""
    go_a = go_b = more = 0
    while True:
        n = _equal(a[go_a:], b[go_b:])
        go_a, go_b, more = go_a + n, go_b + n, more + n
        for u, v in SKIPS:
            n = _equal(a[go_a + u :], b[go_b + v :])
            if n >= least + (max(u, v) > 1) and matched + more + n >= LEAST_SIMILARITY * max(span_a + go_a + u + n, span_b + go_b + v + n):
                go_a, go_b, more = go_a + u + n, go_b + v + n, more + n
                break
        else:
            return go_a, go_b, more


def _extended(a: np.ndarray, b: np.ndarray, first: tuple[int, int, int], last: tuple[int, int, int], matched: int) -> tuple[int, int, int, int, int] | None:
    """The passage from one run to another with its ends extended, if it is long and similar enough."""
    for least in (2, 1):  # single words count only if the passage is too short without
        x, y, ea, eb, total = first[0], first[1], last[0] + last[2], last[1] + last[2], matched
        u, v, n = _reach(a[:x][::-1], b[:y][::-1], total, ea - x, eb - y, least)
        x, y, total = x - u, y - v, total + n
        u, v, n = _reach(a[ea:], b[eb:], total, ea - x, eb - y, least)
        ea, eb, total = ea + u, eb + v, total + n
        if min(ea - x, eb - y) >= LEAST_WORDS and total >= LEAST_SIMILARITY * max(ea - x, eb - y):
            return x, ea, y, eb, total
    return None


def _compared(pairs: DataFrame, docs: DataFrame, text: str, key: str, work: Workspace, name: str) -> DataFrame:
    """Passages of pairs (doc, hub), with the hub's words held while its documents pass."""
    kind = docs.schema[key].dataType
    dealt = pairs.select("doc", "hub", F.pmod(F.xxhash64("doc"), F.lit(PARTS)).cast("int").alias("part"))
    roles = dealt.select("doc", "hub", "part", F.lit(1).alias("role")).unionAll(dealt.select(F.col("hub").alias("doc"), "hub", "part").distinct().withColumn("role", F.lit(0)))
    whole = with_keys(docs.select(F.col(key).alias("doc"), F.col(text).cast("string").alias("t")), "doc", roles.select("doc"), work, name)
    texts = whole.join(roles, "doc").select("hub", "part", "role", "doc", "t")
    rows = texts.repartition("hub", "part").sortWithinPartitions("hub", "part", "role")
    names = ["doc_id", "start", "end", "match_doc_id", "match_start", "match_end", "n_matched"]
    schema = T.StructType([T.StructField(n, kind if n.endswith("doc_id") else T.IntegerType()) for n in names])

    def run(batches):
        at, held = None, None
        for batch in batches:
            hubs, parts, roles, owners = (batch.column(i).to_pylist() for i in range(4))
            out = []
            for c in tk.chunks(batch.column(4)):
                w = tk.words(c.data, c.offsets, tk.ALNUM)
                ends = np.concatenate([[0], np.cumsum(w.count)])
                for k in range(c.last - c.first):
                    i = c.first + k
                    own = w.hash[ends[k] : ends[k + 1]]
                    if roles[i] == 0:
                        if at != (hubs[i], parts[i]):
                            at, held = (hubs[i], parts[i]), _Text(own.copy())
                    elif at == (hubs[i], parts[i]):
                        if len(own) == len(held.words) and (own == held.words).all():
                            found = [(0, len(own), 0, len(own), len(own))] if len(own) >= LEAST_WORDS else []
                        else:
                            found = chains(own, held)
                        out += [(owners[i], x, e, hubs[i], y, f, n) for x, e, y, f, n in found]
            columns = list(zip(*out, strict=True)) if out else [[]] * 7
            yield pa.RecordBatch.from_arrays([pa.array(list(columns[i]), batch.column(0).type if names[i].endswith("doc_id") else pa.int32()) for i in range(7)], names=names)

    return rows.mapInArrow(run, schema)


def _found(pairs: DataFrame, docs: DataFrame, text: str, key: str, work: Workspace, name: str) -> DataFrame:
    """Passages of all pairs; texts are shuffled for the pairs of some hubs, then of others."""
    parts = []
    for part in range(SLICES):
        own = pairs.filter(F.pmod(F.xxhash64("hub"), F.lit(SLICES)) == part)
        parts.append(work.save(_compared(own, docs, text, key, work, f"ids_{name}_{part}"), f"{name}_{part}"))
        work.drop(f"ids_{name}_{part}")
        work.release()
    return reduce(DataFrame.unionAll, parts)


def _pairs(met: DataFrame) -> DataFrame:
    """(doc, other) as (doc, hub), the lesser of the two as hub."""
    return met.filter("doc <> other").select(F.greatest("doc", "other").alias("doc"), F.least("doc", "other").alias("hub"), *[c for c in met.columns if c not in ("doc", "other")])


def _keys(rest: DataFrame, length: int) -> DataFrame:
    """(seed, doc): so many seeds in a row, with equal distances, as one key."""
    w = Window.partitionBy("doc").orderBy("pos")
    parts = [x for k in range(length) for x in (F.lead("seed", k).over(w).alias(f"s{k}"), (F.lead("pos", k).over(w) - F.col("pos")).alias(f"d{k}"))]
    keyed = rest.select("doc", *parts).filter(F.col(f"d{length - 1}") <= length * (WINDOW + SEED_WORDS))
    return keyed.select(F.xxhash64(F.lit(length), *keyed.columns[1:]).alias("seed"), "doc")


def _uncovered(pool: DataFrame, found: DataFrame) -> DataFrame:
    """Rows of the pool outside of all found passages; a document's passages are merged first."""
    ends = found.select(F.col("doc_id").alias("doc"), F.col("start").alias("x"), F.col("end").alias("y")).unionAll(found.select("match_doc_id", "match_start", "match_end"))
    ends = ends.groupBy("doc", "x").agg(F.max("y").alias("y"))
    w = Window.partitionBy("doc").orderBy("x")
    before = F.max("y").over(w.rowsBetween(Window.unboundedPreceding, -1))
    islands = ends.withColumn("new", F.when(F.col("x") <= before, 0).otherwise(1)).withColumn("island", F.sum("new").over(w))
    spans = islands.groupBy("doc", "island").agg(F.min("x").alias("x"), F.max("y").alias("y")).select("doc", "x", "y")
    spans = spans.withColumnRenamed("doc", "own")
    return pool.join(spans, (F.col("doc") == F.col("own")) & (F.col("pos") >= F.col("x")) & (F.col("pos") + SEED_WORDS <= F.col("y")), "left_anti")


def repeated_passages(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(doc_id, start, end, match_doc_id, match_start, match_end, n_matched): passages that two texts share.

    Positions count words (maximal runs of ASCII letters and digits and of
    non-ASCII characters, A-Z lower-cased), from 0, end exclusive.  A passage
    has at least LEAST_WORDS words in either text, of which LEAST_SIMILARITY
    match in order; doc_id is the greater of the two keys.  Documents are
    compared with hubs of their seeds, not each with each, so rows are in
    proportion to documents.  Null keys and texts, and texts with fewer words,
    give no rows.  Rows that repeat a key are read as one of them.  Other
    columns are not read.
    """
    work = Workspace(docs.sparkSession, "passages")
    docs = docs.select(F.col(key), F.col(text).cast("string").alias(text))
    pools, parts = [], []
    every = work.save(_seeds(docs, text, key).withColumn("slice", F.pmod(F.xxhash64("seed"), F.lit(SLICES)).cast("int")), "seeds", "slice")
    for part in range(SLICES):  # a slice's shuffle is gone before the next one's
        seeds = every.filter(F.col("slice") == part).drop("slice")
        # Written, so that both sides of the join are plain shuffles, which the planner may split where a seed has many documents.
        ends = work.save(seeds.groupBy("seed").agg(F.min("doc").alias("a"), F.max("doc").alias("b"), (F.count("*") > USED_UP).alias("many")).filter("a <> b"), f"ends{part}")
        work.release()
        pool = work.save(seeds.join(ends, "seed").select("seed", "doc", "pos", "a", "b", "many"), f"pool{part}")
        work.drop(f"ends{part}")
        work.release()
        met = _pairs(pool.select("doc", F.explode(F.array("a", "b")).alias("other"), "seed"))
        parts.append(work.save(met.groupBy("doc", "hub").agg(F.min("seed").alias("s"), F.max("seed").alias("t")), f"met{part}"))
        # Of a seed with few documents all pairs meet.
        pools.append(work.save(pool.filter("many").select("seed", "doc", "pos"), f"many{part}"))
        work.drop(f"pool{part}")
        work.release()
    work.drop("seeds")
    pairs = reduce(DataFrame.unionAll, parts).groupBy("doc", "hub").agg(F.min("s").alias("s"), F.max("t").alias("t")).filter("s <> t").select("doc", "hub")
    tested = work.save(pairs, "pairs0")
    work.drop(*[f"met{part}" for part in range(SLICES)])
    found = _found(tested, docs, text, key, work, "found0")
    left = work.save(_uncovered(reduce(DataFrame.unionAll, pools), found), "left")
    work.drop(*[f"many{part}" for part in range(SLICES)])
    work.release()
    met = None
    for length in KEY_SEEDS:
        entries = work.save(_keys(left, length).distinct(), f"keys{length}")
        ends = work.save(entries.groupBy("seed").agg(F.min("doc").alias("a"), F.max("doc").alias("b")).filter("a <> b"), f"ends{length}")
        here = _pairs(entries.join(ends, "seed").select("doc", F.explode(F.array("a", "b")).alias("other"))).distinct()
        met = here if met is None else met.unionAll(here)
    pairs = work.save(met.distinct().join(tested, ["doc", "hub"], "left_anti"), "pairs1")
    return work.finish(found.unionAll(_found(pairs, docs, text, key, work, "found1")).distinct())


def op8(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return repeated_passages(docs)
