"""WARC archives, Merkle manifests and conversation repair against plain versions."""

import hashlib
import itertools
import random
import re
import zlib

import pytest
from oracle import DATA, assert_same, connect
from pyspark.sql import Row
from pyspark.sql import functions as F

from gradus.llm import conversations, manifest, registry, warc
from gradus.llm.common import Workspace


@pytest.mark.parametrize("name", ["op11_warc_revisits", "op12_merkle_manifest", "op13_conversation_repair"])
def test_queries_match_sql(spark, name):
    assert_same(registry.queries()[name](spark, DATA), registry.oracle_sql()[name], connect())


# ----- WARC


def _pages(spark, rows):
    return spark.createDataFrame([Row(page_id=i, url=u, html=h, value="x", TYPE=1) for i, u, h in rows], "page_id long, url string, html string, value string, TYPE int")


@pytest.mark.parametrize("compression", ["gzip", "none"])
def test_archive_round_trip_with_odd_payloads(spark, tmp_path, compression):
    inner = "WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 4\r\n\r\nabcd\r\n\r\nWARC/1.1\r\n" + "ß" * 50
    long = "word \r\n\r\n" * 300_000
    rows = [(1, "http://a/", inner), (2, None, inner), (3, "x\r\nContent-Length: 9", None), (None, "http://b/", long), (5, "http://b/", long), (5, "http://b/", long), (6, "u", ""), (7, "u", "short"), (8, "v", "short"), (9, "w", "WARC/1.1\r\n"), (10, "w", "\r\n\r\n")]
    warc.write(warc.responses(_pages(spark, rows).repartition(3)), str(tmp_path / "a"), compression)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        back = warc.read(spark, str(tmp_path / "a"))
        got = sorted(((r.page_id, r.payload) for r in back.collect()), key=repr)
        assert got == sorted(((i, h or "") for i, _, h in rows), key=repr)
        assert back.filter("not whole").count() == 0
        work = Workspace(spark, "test-warc")
        warc.write(warc.deduplicated(back, work), str(tmp_path / "b"), compression)
        kept = warc.read(spark, str(tmp_path / "b"))
        found = {(r.page_id, r.type, r.refers_to, r.payload_bytes) for r in kept.collect()}
        n, m = len(inner.encode()), len(long.encode())
        assert found == {(1, "response", None, n), (2, "revisit", 1, n), (3, "response", None, 0), (None, "revisit", 5, m), (5, "response", None, m), (5, "revisit", 5, m), (6, "response", None, 0), (7, "response", None, 5), (8, "response", None, 5), (9, "response", None, 10), (10, "response", None, 4)}
        whole = sorted(((r.page_id, r.payload) for r in warc.restored(kept).collect()), key=repr)
        assert whole == got
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_archive_files_are_plain_warc(spark, tmp_path):
    warc.write(warc.responses(_pages(spark, [(1, "http://a/", "héllo"), (2, "http://b/", "x" * 200)]).coalesce(1)), str(tmp_path / "a"), "none")
    (file,) = (tmp_path / "a").glob("part-*")
    data, seen = file.read_bytes(), []
    while data:
        head, _, rest = data.partition(b"\r\n\r\n")
        lines = head.split(b"\r\n")
        assert lines[0] == b"WARC/1.1"
        fields = dict(x.split(b": ", 1) for x in lines[1:])
        n = int(fields[b"Content-Length"])
        payload = rest[:n].partition(b"\r\n\r\n")[2]
        assert fields[b"WARC-Payload-Digest"] == b"sha256:" + hashlib.sha256(payload).hexdigest().encode()
        assert rest[n : n + 4] == b"\r\n\r\n"
        seen.append((fields[b"WARC-Target-URI"], payload))
        data = rest[n + 4 :]
    assert seen == [(b"http://a/", "héllo".encode()), (b"http://b/", b"x" * 200)]


def test_torn_archive(spark, tmp_path):
    warc.write(warc.responses(_pages(spark, [(1, "a", "x" * 300), (2, "b", "y" * 300)]).coalesce(1)), str(tmp_path / "a"), "none")
    (file,) = (tmp_path / "a").glob("part-*")
    (tmp_path / "c").mkdir()
    (tmp_path / "c" / "torn.warc").write_bytes(file.read_bytes()[:-40])
    got = {(r.page_id, r.whole) for r in warc.read(spark, str(tmp_path / "c")).collect()}
    assert got == {(1, True), (2, False)}


def test_archives_of_nothing(spark, tmp_path):
    warc.write(warc.responses(_pages(spark, [])), str(tmp_path / "a"))
    assert warc.deduplicated(warc.read(spark, str(tmp_path / "a")), Workspace(spark, "none")).count() == 0


# ----- Merkle manifest


def _plain_manifest(rows, seen=lambda r: r):
    """The rule as it is stated, with whole lists."""
    h = lambda s: hashlib.sha256(s.encode()).hexdigest()
    leaf = lambda r: h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in r))

    def tree(nodes):
        paths, owners = [[] for _ in nodes], [[i] for i in range(len(nodes))]
        while len(nodes) > 1:
            up, over = [], []
            for a in range(0, len(nodes), 16):
                run = nodes[a : a + 16]
                for k, below in enumerate(owners[a : a + 16]):
                    for i in below:
                        paths[i].append(("".join(run[:k]), "".join(run[k + 1 :])))
                up.append(h("".join(run)))
                over.append([i for o in owners[a : a + 16] for i in o])
            nodes, owners = up, over
        return nodes[0], paths

    sources = sorted({r[1] for r in rows}, key=lambda s: (s is not None, (s or "").encode()))
    found, subs = [], []
    for s in sources:
        own = sorted((r for r in rows if r[1] == s), key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        sub, paths = tree([leaf(r) for r in own])
        subs.append(sub)
        found.append((own, paths))
    if not rows:
        return []
    root, tops = tree(subs)
    out = []
    for (own, paths), top, sub in zip(found, tops, subs, strict=True):
        for r, p in zip(own, paths, strict=True):
            d = leaf(seen(r))
            for a, b in [*p, *top]:
                d = h(a + d + b)
            out.append((r[0], leaf(r), sub, root, h("".join(a + b for a, b in [*p, *top])), d, d == root))
    return sorted(out, key=repr)


@pytest.mark.parametrize("levels", [1, 2, 3])
def test_manifest_of_any_block_size(spark, levels):
    random.seed(levels)
    rows = [(i, random.choice(["a", "a", "a", "a", "", "é", "z", None]), None, len(str(i)), f"Text {i} ÄÖ") for i in range(900)]
    rows += [(None, "a", "x", None, None), (3, "a", None, 1, "again"), (7, "b", None, None, ""), (7, "b", None, None, ""), (8, "lone", "en", 1, "w " * 50_000)]
    rows += [(k, f"s{k}", None, None, None) for k in range(300)]
    df = spark.createDataFrame([(*r, "clash", 5) for r in rows], "doc_id long, source string, lang string, n_chars long, text string, g string, i int")
    tampered = lambda r: (*r[:4], r[4] and r[4].lower().replace("ä", "Ä").replace("ö", "Ö")) if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 else r
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    seen = F.when(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, manifest.leaf_digest([F.translate(c, upper, upper.lower()) if c == "text" else F.col(c) for c in manifest.FIELDS]))
    got = sorted((tuple(r) for r in manifest.manifest(df, seen, levels=levels).collect()), key=repr)
    assert got == _plain_manifest(rows, tampered)


def test_manifest_of_little(spark):
    schema = "doc_id long, source string, lang string, n_chars long, text string"
    assert manifest.manifest(spark.createDataFrame([], schema)).count() == 0
    one = [(1, None, None, None, None)]
    got = [tuple(r) for r in manifest.manifest(spark.createDataFrame(one, schema)).collect()]
    assert got == _plain_manifest(one) and got[0][1] == got[0][3]


def test_manifest_does_not_depend_on_partitions(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    roots = {manifest.manifest(docs.repartition(n)).select("root").distinct().first()[0] for n in (1, 7)}
    assert len(roots) == 1


# ----- conversations


def _judged(rows):
    """Rows in order with their faults: removed, cut short, and the counts."""
    rows = sorted(((t, r if r is not None else " ", x if x is not None else " ") for t, r, x in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).hexdigest()))
    seen, out, counts = set(), [], {"blank": 0, "duplicate": 0, "truncated": 0}
    for _, role, text in rows:
        fault = None
        if not re.search(r"[^\x20\x09-\x0D]", text):
            fault = "blank"
        elif (role, text) in seen:
            fault = "duplicate"
        elif re.findall(r"[^\x20\x09-\x0D]", text)[-1] not in ".!?":
            fault = "truncated"
        seen.add((role, text))
        if fault:
            counts[fault] += 1
        out.append((role, text, fault))
    turns = [t for t, _, _ in rows if t is not None]
    counts["gaps"] = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    counts["illegal"] = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(out))
    return out, counts


def _tried(rows):
    """The least (cost, audit, turns) of all ways with up to two inserted turns at each place."""
    out, best = rows, None
    choices = [[("D", 2)] if f in ("blank", "duplicate") else [("K", 5 * (f == "truncated")), ("R", 1 + 5 * (f == "truncated")), ("D", 2)] for _, _, f in out]
    for inserts in itertools.product(range(3), repeat=len(out) + 1):
        for way in itertools.product(*choices):
            cost = sum(c for _, c in way) + 5 * sum(inserts)
            if best and cost > best[0]:
                continue
            audit, made, ok = "", [], True

            def add(made=made):
                made.append("assistant:" if made and made[-1][:1] == "u" else "user:")

            for k in range(len(out) + 1):
                for _ in range(inserts[k]):
                    audit += "I"
                    add()
                if k < len(out):
                    letter, (role, text, _) = way[k][0], out[k]
                    audit += letter
                    if letter == "K":
                        made.append(f"{role}:{text}")
                    elif letter == "R":
                        add()
                        made[-1] += text
            ok = re.fullmatch(r"(s?(ua)+)?", "".join(m[:1] if not m.startswith(":") else "?" for m in made))
            if ok and (best is None or (cost, audit) < best[:2]):
                best = (cost, audit, "\n".join(made))
    return best


def _conversations(spark, rows):
    return spark.createDataFrame([(*r, 1, "x") for r in rows], "conv_id long, turn long, role string, text string, seg int, AT string")


def _both(spark, rows):
    found, turns = conversations.repair(_conversations(spark, rows))
    said = {}
    for r in sorted(turns.collect(), key=lambda r: (r.at, r.position)):
        said.setdefault(r.conv, []).append(f"{r.role}:{r.text}")
    return {r.conv: (r.asDict(), "\n".join(said.get(r.conv, []))) for r in found.collect()}


def test_repair_against_all_ways(spark):
    random.seed(13)
    texts = ["a.", "b!", "c", " \n", "", None, "d?  ", "e"]
    rows = [(c if c else None, random.choice([None, 1, 2, 3, 5]), random.choice(["system", "user", "assistant", "user", "assistant", "tool", None, ""]), random.choice(texts)) for c in range(120) for _ in range(random.randint(1, 3))]
    rows += [(500, t, r, x) for t, r, x in ((1, "user", "a."), (1, "user", "a."), (2, "assistant", "b."), (9, "user", "a."))]
    got = _both(spark, rows)
    assert set(got) == {r[0] for r in rows}
    for conv, (found, said) in got.items():
        out, counts = _judged([r[1:] for r in rows if r[0] == conv])
        cost, audit, made = _tried(out)
        assert (found["cost"], found["audit"], said) == (cost, audit, made), (conv, out)
        assert {k: found[k] for k in counts} == counts


def test_long_conversations_span_segments(spark):
    """One conversation over many segments gives what it gives in one."""
    random.seed(31)
    roles = ["user", "assistant", "user", "assistant", "system"]
    rows = [(1, t, random.choice(roles), f"{random.randint(0, 3000)}" + random.choice([".", ".", "", "!"])) for t in range(6000)] + [(2, 1, "user", "x.")]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    seen = []
    try:
        for n in ("1", "23"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
            seen.append(_both(spark, rows))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert seen[0] == seen[1]
    letters = seen[0][1][0]["audit"].replace("I", "")
    assert len(letters) == 6000
    assert re.fullmatch(r"(s?(ua)+)?", "".join(x[0] for x in re.findall(r"^(?:system|user|assistant):", seen[0][1][1], re.M)))


def test_repair_of_nothing(spark):
    found, turns = conversations.repair(_conversations(spark, []))
    assert found.count() == turns.count() == 0
