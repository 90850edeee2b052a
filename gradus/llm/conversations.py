"""Conversation structure repair: a min-plus matrix scan over (cost, audit) elements.

A conversation is well formed if its roles' initials are ``(s?(ua)+)?``.  The
automaton of that pattern has four states, so what a turn may become (kept,
given another role, deleted), after any number of inserted turns, is a 4x4
matrix of (cost, audit); products of matrices are associative.  Rows lie in
segments of a global order; each segment makes one matrix by a balanced tree of
products, and conversations that span segments are reduced in a tree over them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import CRC32_SQL, Workspace, segmented, stream

RENAMED, DELETED, INSERTED, CUT_SHORT = 1, 2, 5, 5
#: States: nothing yet, after system, after user, after assistant.  The first and the last may end.
_STATES = range(4)
_NEXT = {("s", 0): 1, **{("u", i): 2 for i in (0, 1, 3)}, ("a", 2): 3}
_SPACES = " \t\n\x0b\x0c\r"
#: Segments, or nodes above them, that one node of the tree over segments joins: 2 ** 3.
_FAN_BITS = 3

Element = tuple[int, str] | None
Matrix = tuple[Element, ...]


def _times(a: Matrix, b: Matrix) -> Matrix:
    """The min-plus product; of equal costs the ASCII-least audit.

    Two paths through the same rows with equal costs are never one the prefix of
    the other (what is more would be inserts, which cost), so the least stays
    least whatever follows.
    """
    out: list[Element] = []
    for i in (0, 4, 8, 12):
        row = a[i : i + 4]
        for j in _STATES:
            best = None
            for m in _STATES:
                x, y = row[m], b[4 * m + j]
                if x is not None and y is not None and (best is None or x[0] + y[0] <= best[0]):
                    found = (x[0] + y[0], x[1] + y[1])
                    if best is None or found < best:
                        best = found
            out.append(best)
    return tuple(out)


def _least(a: Matrix, b: Matrix) -> Matrix:
    return tuple(min((e for e in pair if e is not None), default=None) for pair in zip(a, b, strict=True))


def _arcs(letter: str, cost: int, roles: Iterable[str]) -> Matrix:
    reach = {(i, j) for (r, i), j in _NEXT.items() if r in roles}
    return tuple((cost, letter) if (i, j) in reach else None for i in _STATES for j in _STATES)


_ONE: Matrix = tuple((0, "") if i == j else None for i in _STATES for j in _STATES)
_CLOSURE = _ONE
for _ in _STATES:
    _CLOSURE = _least(_ONE, _times(_CLOSURE, _arcs("I", INSERTED, "ua")))


def turn_matrix(initial: str, removed: bool, cut_short: bool) -> Matrix:
    """Inserted turns, then one row: kept, given another role or deleted; ``removed`` rows are deleted."""
    row: Matrix = tuple((DELETED, "D") if i == j else None for i in _STATES for j in _STATES)
    if not removed:
        more = CUT_SHORT if cut_short else 0
        row = _least(row, _least(_arcs("K", more, initial), _arcs("R", RENAMED + more, "ua")))
    return _times(_CLOSURE, row)


_TURNS = {(c, r, t): turn_matrix(c, r, t) for c in ("s", "u", "a", "?") for r in (False, True) for t in (False, True)}


def _product(leaves: Iterable[Matrix]) -> Matrix:
    """The product of many matrices as a balanced tree, so that audits are copied a logarithmic number of times."""
    stack: list[tuple[int, Matrix]] = []
    for m in leaves:
        rank = 0
        while stack and stack[-1][0] == rank:
            m, rank = _times(stack.pop()[1], m), rank + 1
        stack.append((rank, m))
    out = _ONE
    while stack:
        out = _times(stack.pop()[1], out)
    return out


# ----- segments and the tree over them

_COUNTS = ("blank", "duplicate", "truncated", "illegal", "turns")
_PART = "low bigint, high bigint, head string, tail string, " + ", ".join(f"`{c}` bigint" for c in _COUNTS) + ", costs array<bigint>, audits array<string>"
_LEGAL = {"su", "ua", "au"}


def _segment(key: tuple, rows: Iterator[tuple]) -> Iterator[tuple]:
    """Of one conversation's rows in one segment: least and greatest turn, first and last initial, counts, the matrix."""
    low = high = head = None
    tail, counts, before = "", dict.fromkeys(_COUNTS, 0), object()

    def leaves() -> Iterator[Matrix]:
        nonlocal low, high, head, tail, before
        for *_, turn, initial, blank, first, cut, times in rows:
            if turn is not None:
                low, high = turn if low is None else low, turn
                counts["turns"] += turn != before
                before = turn
            counts["illegal"] += (head is not None and tail + initial not in _LEGAL) + (times - 1)
            head, tail = initial if head is None else head, initial
            keeps = first and not blank
            counts["blank"] += times if blank else 0
            counts["duplicate"] += 0 if blank else times - keeps
            counts["truncated"] += bool(keeps and cut)
            kind = initial if initial in ("s", "u", "a") else "?"
            for k in range(times):
                yield _TURNS[kind, k > 0 or not keeps, bool(cut)]

    m = _product(leaves())
    yield (*key, low, high, head, tail, *counts.values(), [e and e[0] for e in m], [e and e[1] for e in m])


def _matrix(costs: list, audits: list) -> Matrix:
    return tuple(None if c is None else (c, a) for c, a in zip(costs, audits, strict=True))


def _join(key: tuple, rows: Iterator[tuple]) -> Iterator[tuple]:
    """One part of several in order."""
    parts = [r[len(key) + 1 :] for r in rows]
    low = high = None
    counts = [0] * len(_COUNTS)
    last = tail = None
    for lo, hi, head, end, *rest in parts:
        counts = [a + b for a, b in zip(counts, rest[: len(_COUNTS)], strict=True)]
        counts[3] += tail is not None and tail + head not in _LEGAL
        counts[4] -= last is not None and lo == last
        low, high = lo if low is None else low, hi if hi is not None else high
        last, tail = hi if hi is not None else last, end
    m = _product(_matrix(*p[-2:]) for p in parts)
    yield (*key, low, high, parts[0][2], tail, *counts, [e and e[0] for e in m], [e and e[1] for e in m])


def _whole(key: tuple, rows: Iterator[tuple]) -> Iterator[tuple]:
    """The cheapest way from the start to an end: its cost and audit, the state before the turns inserted at the end, and these."""
    for r in rows:
        m = _matrix(*r[-2:])
        cost, audit, state, after = min((m[i][0] + _CLOSURE[4 * i + j][0], m[i][1] + _CLOSURE[4 * i + j][1], i, _CLOSURE[4 * i + j][1]) for i in _STATES for j in (0, 3) if m[i] and _CLOSURE[4 * i + j])
        yield (*r[:-2], cost, audit, state, after)


def _ways(key: tuple, rows: Iterator[tuple]) -> Iterator[tuple]:
    """From the states between which a node lies, those between which each of its children does."""
    _, _, _, start, stop, after, *_ = next(rows)
    children = [(r[2], _matrix(*r[-2:])) for r in rows]
    best = {start: (0, "", [start])}
    for _, m in children:
        step: dict[int, tuple] = {}
        for i, (cost, audit, path) in best.items():
            for j in _STATES:
                if e := m[4 * i + j]:
                    found = (cost + e[0], audit + e[1], [*path, j])
                    step[j] = min(step.get(j, found), found)
        best = step
    path = best[stop][2]
    for k, (node, _) in enumerate(children):
        yield (key[0], node, path[k], path[k + 1], after if k == len(children) - 1 else "")


def _same(a: str, b: str):
    return F.col(a).eqNullSafe(F.col(b))


def _edited(key: tuple, rows: Iterator[tuple]) -> Iterator[tuple]:
    """A segment's rows after its edits; the first row is the segment's state and audit."""
    state, letters, position = 0, iter(()), 0

    def placed(initial: str) -> str:
        nonlocal state
        state = _NEXT[initial, state]
        return {"u": "user", "a": "assistant"}.get(initial, "")

    for _, _, at, role, text, times, entry, audit in rows:
        if audit is not None:
            state, letters = entry, iter(audit)
            continue
        for _ in range(times):
            for letter in letters:
                if letter == "I":
                    yield (key[0], at, (position := position + 1), "I", placed("a" if state == 2 else "u"), "")
                    continue
                if letter == "K":
                    placed(role[:1])
                    yield (key[0], at, (position := position + 1), "K", role, text)
                elif letter == "R":
                    yield (key[0], at, (position := position + 1), "R", placed("a" if state == 2 else "u"), text)
                break
    for _ in letters:
        yield (key[0], at, (position := position + 1), "I", placed("a" if state == 2 else "u"), "")


def repair(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(a row for each conversation, its repaired turns): the cheapest edits after which the roles are ``(s?(ua)+)?``.

    Keeping a row costs 0, another role 1, deleting 2, inserting an empty turn 5;
    blank rows and those whose role and text came earlier must be deleted; one
    that does not end in ``.!?`` costs 5 more unless deleted.  Audits name the
    edits by K, R, D and I; of equally cheap ones the ASCII-least is taken.

    Rows of a conversation are ordered by turn (nulls first), then role, then the
    SHA-256 of the text.  Null roles and texts are one space.  Null ids are one
    conversation.  Equal rows are counted before they are ordered, and rows with
    an earlier equal text are found by a map-side combined minimum and a join, so
    no conversation, however long, has to lie in one task.  No rows give no rows.

    First table: conv, gaps, blank, duplicate, truncated, illegal, cost, audit.
    Second: conv, at and position (which order them), edit, role, text.  Other
    columns of df are not read.
    """
    work = Workspace(df.sparkSession, "conversations")
    said = F.coalesce(F.col(text), F.lit(" "))
    rows = df.select(F.col(conv).alias("conv"), F.col(turn).cast("bigint").alias("turn"), F.coalesce(F.col(role), F.lit(" ")).alias("role"), said.alias("text"))
    rows = rows.withColumn("hash", F.sha2("text", 256))
    counted = rows.groupBy("conv", "turn", "role", "hash", "text").agg(F.count("*").alias("times"))
    earliest = rows.groupBy("conv", "role", "hash").agg(F.min(F.struct(F.col("turn").isNotNull().alias("set"), "turn")).alias("earliest"))
    earliest = work.save(earliest.toDF("c", "r", "h", "earliest"), "earliest")
    marked = counted.join(earliest, _same("conv", "c") & (F.col("role") == F.col("r")) & (F.col("hash") == F.col("h")))
    ended = F.rtrim("text", F.lit(_SPACES))
    marked = marked.select(
        "conv", "turn", "role", "hash", "text", "times",
        (ended == "").alias("blank"),
        _same("turn", "earliest.turn").alias("first"),
        (~F.right(ended, F.lit(1)).isin(".", "!", "?")).alias("cut"),
    )
    ordered = segmented(marked, ["conv", "turn", "role", "hash"], work, "ordered")
    work.drop("earliest")
    kind = dict(df.select(F.col(conv).alias("conv")).dtypes)["conv"]
    light = ordered.select("conv", "seg", "at", "turn", F.substring("role", 1, 1).alias("initial"), "blank", "first", "cut", "times")
    parts = work.save(stream(light, ["conv", "seg"], ["at"], _segment, f"conv {kind}, seg bigint, {_PART}"), "parts")

    # A conversation in several segments has a boundary of theirs inside, so there are fewer of them than segments.
    spans = ordered.groupBy("conv").agg(F.min("seg").alias("a"), F.max("seg").alias("b")).filter("a < b").select(F.col("conv").alias("c"))
    spans = F.broadcast(work.save(spans, "spans"))
    inside = parts.join(spans, _same("conv", "c"), "left_anti")
    levels = [work.save(parts.join(spans, _same("conv", "c"), "left_semi").withColumnRenamed("seg", "node"), "level0")]
    names = [f.strip().split(" ")[0].strip("`") for f in _PART.split(", ")]
    while (most := levels[-1].groupBy("conv").count().agg(F.max("count")).first()[0]) and most > 1:
        up = levels[-1].select("conv", F.shiftright("node", _FAN_BITS).alias("up"), "node", *names)
        joined = stream(up, ["conv", "up"], ["node"], _join, f"conv {kind}, up bigint, {_PART}")
        levels.append(work.save(joined.withColumnRenamed("up", "node"), f"level{len(levels)}"))
    whole = inside.select("conv", F.col("seg").alias("node"), *names).unionAll(levels[-1].select("conv", "node", *names))
    total = f"conv {kind}, node bigint, {_PART.rsplit(', ', 2)[0]}, cost bigint, audit string, state bigint, after string"
    whole = work.save(stream(whole, ["conv"], ["node"], _whole, total), "whole")

    ways = f"conv {kind}, node bigint, start bigint, stop bigint, after string"
    spanning = whole.join(spans, _same("conv", "c"), "left_semi")
    down = spanning.select("conv", "node", F.lit(0).cast("bigint").alias("start"), F.col("state").alias("stop"), "after")
    nothing = [F.lit(None).cast(t).alias(n) for n, t in (("costs", "array<bigint>"), ("audits", "array<string>"))]
    for k in range(len(levels) - 2, -1, -1):
        heads = down.select("conv", F.col("node").alias("up"), F.lit(-1).cast("bigint").alias("node"), "start", "stop", "after", *nothing)
        below = levels[k].select("conv", F.shiftright("node", _FAN_BITS).alias("up"), "node", *[F.lit(None).cast(t).alias(n) for n, t in (("start", "bigint"), ("stop", "bigint"), ("after", "string"))], "costs", "audits")
        down = work.save(stream(heads.unionAll(below), ["conv", "up"], ["node"], _ways, ways), f"down{k}")
    own = down.alias("w").join(levels[0].alias("p"), F.col("w.conv").eqNullSafe(F.col("p.conv")) & (F.col("w.node") == F.col("p.node")))
    slices = own.select("w.conv", F.col("w.node").alias("seg"), F.col("w.start").alias("entry"), F.concat(F.element_at("p.audits", (4 * F.col("w.start") + F.col("w.stop") + 1).cast("int")), "w.after").alias("slice"))
    alone = whole.join(spans, _same("conv", "c"), "left_anti").select("conv", F.col("node").alias("seg"), F.lit(0).cast("bigint").alias("entry"), F.col("audit").alias("slice"))
    heads = alone.unionAll(slices).select("conv", "seg", F.lit(-1).cast("bigint").alias("at"), F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("text"), F.lit(0).cast("bigint").alias("times"), "entry", "slice")
    body = ordered.select("conv", "seg", "at", "role", "text", "times", F.lit(None).cast("bigint").alias("entry"), F.lit(None).cast("string").alias("slice"))
    turns = stream(heads.unionAll(body), ["conv", "seg"], ["at"], _edited, f"conv {kind}, at bigint, position bigint, edit string, role string, text string", size=256)
    gaps = F.coalesce(F.col("high") - F.col("low") + 1 - F.col("turns"), F.lit(0)).alias("gaps")
    return whole.select("conv", gaps, "blank", "duplicate", "truncated", "illegal", "cost", "audit"), turns


def damage(df: DataFrame) -> DataFrame:
    """Rows of ``conversations`` with the faults that the repair is tried on, by crc32 of ``conv_id:turn`` modulo 20.

    0 drops the row, 1 empties its text, 2 removes its sentence ends, 3 repeats
    it, 4 makes its role user.  Nulls in the key, roles and texts are one space.
    """
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    by = F.crc32(F.concat(said("conv_id"), F.lit(":"), said("turn"))) % 20
    text = F.when(by == 1, F.lit("")).when(by == 2, F.translate(said("text"), ".!?", "")).otherwise(said("text"))
    rows = df.select("conv_id", "turn", F.when(by == 4, F.lit("user")).otherwise(said("role")).alias("role"), text.alias("text"), by.alias("by")).filter("by <> 0")
    return rows.withColumn("by", F.explode(F.when(F.col("by") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).drop("by")


def _hashed(key: tuple, rows: Iterator[tuple]) -> Iterator[tuple]:
    digest, between = hashlib.sha256(), b""
    for *_, role, text in rows:
        digest.update(between + f"{role}:{text}".encode("utf-8", "surrogatepass"))
        between = b"\n"
    yield (*key, digest.hexdigest())


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation after ``damage``: its faults, the cheapest edits and a digest of the repaired turns.

    SHA-256 runs from a conversation's first turn to its last, so these are read
    in order by one task, a row at a time; all else is done in segments.
    """
    conversations = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    found, turns = repair(damage(conversations))
    kind = dict(turns.dtypes)["conv"]
    digests = stream(turns.select("conv", "at", "position", "role", "text"), ["conv"], ["at", "position"], _hashed, f"conv {kind}, repaired_sha256 string")
    ids = conversations.select("conv_id").distinct()
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("bigint").alias(c)
    out = ids.join(found, _same("conv_id", "conv"), "left").join(digests.withColumnRenamed("conv", "c"), _same("conv_id", "c"), "left")
    return out.select("conv_id", *[zero(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")], F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


OP13_SQL = (
    r"""
WITH RECURSIVE raw AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k FROM conversations),
crc_keys AS (SELECT DISTINCT k FROM raw),"""
    + CRC32_SQL
    + r""",
hurt AS (
  SELECT conv_id, turn, CASE WHEN v % 20 = 4 THEN 'user' ELSE role END AS role,
    CASE WHEN v % 20 = 1 THEN '' WHEN v % 20 = 2 THEN translate(text, '.!?', '') ELSE text END AS text,
    unnest(CASE WHEN v % 20 = 3 THEN [0, 1] ELSE [0] END) AS copy
  FROM raw JOIN crc USING (k) WHERE v % 20 <> 0),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text)) AS rn,
    rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS e, left(role, 1) AS c FROM hurt),
judged AS (
  SELECT *, e = '' AS blank, e <> '' AND row_number() OVER (PARTITION BY conv_id, role, text ORDER BY rn) > 1 AS dup,
    CASE WHEN lag(rn) OVER w IS NOT NULL AND lag(c) OVER w || c NOT IN ('su', 'ua', 'au') THEN 1 ELSE 0 END AS bad
  FROM placed WINDOW w AS (PARTITION BY conv_id ORDER BY rn)),
faults AS (SELECT *, NOT blank AND NOT dup AND right(e, 1) NOT IN ('.', '!', '?') AS cut FROM judged),
ids AS (SELECT conv_id, row_number() OVER () AS g FROM (SELECT DISTINCT conv_id FROM conversations)),
steps AS (
  SELECT g, rn, c, role, text, blank OR dup AS gone, CASE WHEN cut THEN 5 ELSE 0 END AS more, max(rn) OVER (PARTITION BY g) AS n
  FROM faults f JOIN ids i ON f.conv_id IS NOT DISTINCT FROM i.conv_id),
-- Each state: [cost, audit, repaired turns]; w0 to w3 are the states after turns inserted before the next row.
walk AS (
  SELECT g, 0::BIGINT AS rn, {'k': 0, 'a': '', 't': ''} AS s0, {'k': 1000000000, 'a': '', 't': ''} AS s1, {'k': 1000000000, 'a': '', 't': ''} AS s2, {'k': 1000000000, 'a': '', 't': ''} AS s3 FROM ids
  UNION ALL
  SELECT g, rn,
    least({'k': w0.k + 2, 'a': w0.a || 'D', 't': w0.t}),
    least({'k': w1.k + 2, 'a': w1.a || 'D', 't': w1.t},
      {'k': w0.k + more + CASE WHEN gone OR c <> 's' THEN 1000000000 ELSE 0 END, 'a': w0.a || 'K', 't': w0.t || chr(10) || role || ':' || text}),
    least({'k': w2.k + 2, 'a': w2.a || 'D', 't': w2.t},
      {'k': f.k + more + CASE WHEN gone OR c <> 'u' THEN 1000000000 ELSE 0 END, 'a': f.a || 'K', 't': f.t || chr(10) || role || ':' || text},
      {'k': f.k + 1 + more + CASE WHEN gone THEN 1000000000 ELSE 0 END, 'a': f.a || 'R', 't': f.t || chr(10) || 'user:' || text}),
    least({'k': w3.k + 2, 'a': w3.a || 'D', 't': w3.t},
      {'k': w2.k + more + CASE WHEN gone OR c <> 'a' THEN 1000000000 ELSE 0 END, 'a': w2.a || 'K', 't': w2.t || chr(10) || role || ':' || text},
      {'k': w2.k + 1 + more + CASE WHEN gone THEN 1000000000 ELSE 0 END, 'a': w2.a || 'R', 't': w2.t || chr(10) || 'assistant:' || text})
  FROM (
    SELECT *, least(w0, w1, w3) AS f FROM (
      SELECT s.*, x.s0 AS w0, x.s1 AS w1,
        least(x.s2, {'k': least(x.s0, x.s1, x.s3).k + 5, 'a': least(x.s0, x.s1, x.s3).a || 'I', 't': least(x.s0, x.s1, x.s3).t || chr(10) || 'user:'}) AS w2,
        least(x.s3, {'k': x.s2.k + 5, 'a': x.s2.a || 'I', 't': x.s2.t || chr(10) || 'assistant:'},
          {'k': least(x.s0, x.s1).k + 10, 'a': least(x.s0, x.s1).a || 'II', 't': least(x.s0, x.s1).t || chr(10) || 'user:' || chr(10) || 'assistant:'}) AS w3
      FROM walk x JOIN steps s ON s.g = x.g AND s.rn = x.rn + 1))),
ends AS (
  SELECT g, least(s0, s3, {'k': s2.k + 5, 'a': s2.a || 'I', 't': s2.t || chr(10) || 'assistant:'},
    {'k': s1.k + 10, 'a': s1.a || 'II', 't': s1.t || chr(10) || 'user:' || chr(10) || 'assistant:'}) AS z
  FROM walk JOIN (SELECT g, coalesce(max(n), 0) AS n FROM ids LEFT JOIN steps USING (g) GROUP BY g) USING (g) WHERE rn = n),
sums AS (
  SELECT i.g, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, coalesce(sum(CASE WHEN blank THEN 1 ELSE 0 END), 0) AS blank,
    coalesce(sum(CASE WHEN dup THEN 1 ELSE 0 END), 0) AS duplicate, coalesce(sum(CASE WHEN cut THEN 1 ELSE 0 END), 0) AS truncated, coalesce(sum(bad), 0) AS illegal
  FROM ids i LEFT JOIN faults f ON f.conv_id IS NOT DISTINCT FROM i.conv_id GROUP BY i.g)
SELECT conv_id, CAST(gaps AS BIGINT) AS gaps, CAST(blank AS BIGINT) AS blank, CAST(duplicate AS BIGINT) AS duplicate, CAST(truncated AS BIGINT) AS truncated,
  CAST(illegal AS BIGINT) AS illegal, CAST(z.k AS BIGINT) AS cost, z.a AS audit, sha256(substr(z.t, 2)) AS repaired_sha256
FROM ids JOIN sums USING (g) JOIN ends USING (g)
"""
)
