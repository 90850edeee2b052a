import duckdb
import html
import json
import math
import re

import numpy as np
import pytest

import corpus_pipeline
from gradus.llm import common, vectors
from gradus.llm import wrappers as wr


def brute(rows, least):
    units = {}
    for i, label, v in rows:
        if i is None or label is None or v is None or not v or any(x is None or not math.isfinite(x) for x in v) or not any(v):
            continue
        x = np.array(v, float)
        units[i] = (label, x / np.abs(x).max() / np.linalg.norm(x / np.abs(x).max()))
    root, links = {i: i for i, _, _ in rows if i is not None}, {i: 0 for i, _, _ in rows if i is not None}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in units:
        for b in units:
            if a < b and units[a][0] == units[b][0] and len(units[a][1]) == len(units[b][1]) and units[a][1] @ units[b][1] >= least:
                links[a] += 1
                links[b] += 1
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (links[i], find(i)) for i in root}


@pytest.mark.parametrize("block", [2048, 16])
def test_vectors_against_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(vectors, "BLOCK_ROWS", block)
    monkeypatch.setattr(vectors, "LEAF_ROWS", 8)
    rng = np.random.default_rng(1)
    rows = []
    for g in range(30):
        base = rng.normal(size=12)
        for _ in range(int(rng.integers(1, 12))):
            rows.append((len(rows), g % 3, (base + rng.normal(0, 0.06, 12) * rng.integers(0, 3)).tolist()))
    rows += [(1000, 1, None), (1001, 1, [0.0] * 12), (1002, 1, [float("nan")] * 12), (1003, None, rows[0][2]), (1004, 0, [1.0, None]), (1005, 0, [1e38] * 12), (1006, 0, [1e-38] * 12), (1007, 0, [1.0, 2.0]), (1008, 0, [2.0, 4.0]), (1009, 2, [])]
    df = spark.createDataFrame([(*r, "x") for r in rows] + [(None, 1, rows[0][2], "x")], "vec_id long, label int, embedding array<float>, n_links string").repartition(3)
    got = vectors.near_duplicates(df).collect()
    assert len(got) == len(rows) + 1
    assert {r.vec_id: (r.n_links, r.component_id) for r in got if r.vec_id is not None} == brute(rows, 0.98)
    assert all(r.kept == (r.vec_id == r.component_id) for r in got if r.vec_id is not None)
    assert vectors.near_duplicates(df.limit(0)).count() == 0


def test_repeated_vector_ids_lose_no_link(spark):
    """Rows of one id under several labels and vectors each link; a null label hides nothing."""
    v, w = [1.0, 0.0, 0.0], [0.0, 1.0, 0.0]
    rows = [(1, v, "5"), (1, v, None), (2, v, "5"), (3, v, "5"), (3, w, "5"), (4, w, "5"), (5, w, "6"), (5, w, "6"), (6, v, None), (7, None, "5")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in vectors.near_duplicates(df).collect()}
    assert got == {1: (2, 1, True), 2: (2, 1, False), 3: (3, 1, False), 4: (1, 1, False), 5: (0, 5, True), 6: (0, 6, True), 7: (0, 7, True)}
    con = duckdb.connect()
    embeddings = df.toPandas()  # noqa: F841  read by name
    want = {r[0]: tuple(r[1:]) for r in con.execute(vectors.OP7_SQL.replace("SELECT c.node AS vec_id", "SELECT DISTINCT c.node AS vec_id")).fetchall()}
    assert got == want


def test_components(spark):
    rng = np.random.default_rng(2)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (220, 2))] + [(1000 + i, 1001 + i) for i in range(60)] + [(5000, 5000 + i) for i in range(1, 80)]
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    df = spark.createDataFrame(edges, "u long, v long")
    got = {r.node: r.root for r in common.components(df, common.Workspace(spark, "t")).collect()}
    alone = {x for a, b in edges if a == b for x in (a,)} - {x for a, b in edges if a != b for x in (a, b)}
    assert got == {x: find(x) for x in root if x not in alone}


def plain_text(page):
    body = page[page.index("<article>") : page.index("</article>")]
    parts = [" ".join(html.unescape(re.sub(r"<[^>]*>", " ", x)).split()) for x in re.split(r"<p>|</p>|<h1>|</h1>", body)]
    return "\n".join(x for x in parts if x)


def test_pages_against_their_articles(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    source = {r.page_id: r.html for r in pages.collect()}
    got = wr.extract(pages).collect()
    assert len(got) == len(source) and all(r.text == plain_text(source[r.page_id]) and r.n_chars == len(r.text) for r in got)


PAGES = {
    "aside": ("<body><header>Top</header><nav>m</nav><main><h1>T &eacute;</h1><p>a  b<br>c<p>d<aside>side</aside><ul><li>one<li>two</ul></main><footer>f</footer>", "T é\na b c\nd\none\ntwo"),
    "named": ('<div id="wrap"><div class="site-header">h</div><div class="content"><p>x &lt;y&gt;</p><div class="ad">buy</div><div class="share-buttons">s</div></div><div class="comments"><p>nice</p></div></div>', "x <y>"),
    "scripts": ("<article><script>var a='</p>';</script><p>keep<style>p{}</style> it</p><form>q<input></form><!-- <p>no</p> --></article>", "keep it"),
    "cells": ("<article><table><tr><td>a<td>b<tr><td>c</table><blockquote>q</blockquote><pre>x\n  y</pre></article>", "a\nb\nc\nq\nx y"),
    "plain": ("<div><div class=top><a href=x>menu</a> <a href=y>more links</a></div><div class=body><p>The longest text of the page stands here, without any name.</p><p>And more.</p></div></div>", "The longest text of the page stands here, without any name.\nAnd more."),
    "cookie": ('<article><h1>t</h1><div class="cookie-notice">accept</div><p>body</p><section class="comments"><p>c</p></section></article><div class="notice">n</div>', "t\nbody"),
    "references": ("<article><p>&amp &#233; &#x4e2d; &nbsp; &unknown; &am</p></article>", "& é 中 &unknown; &am"),
}


@pytest.mark.parametrize("name", PAGES)
def test_kinds_of_pages(name):
    page, told = PAGES[name]
    root = wr.parse(page)
    assert wr.text_of(root, wr.roles(wr._wrap(root))[0]) == told


NAMED = {
    "body": '<body class="single no-sidebar right-sidebar"><div class="has-sidebar"><article><p>all of it</p></article></div></body>',
    "headings": '<article><h2 id="search">all</h2><h3 id="login">of</h3><h2 id="comments">it</h2></article>',
    "parts": '<article><section id="related-work"><p>all</p></section><div class="share-price">of</div><p>it</p><div class="share-buttons">s</div><div class="cookie-bar">c</div></article>',
    "hosts": '<body class="sidebar"><p>all of it</p></body>',
}


@pytest.mark.parametrize("name", NAMED)
def test_names_drop_whole_blocks_only(name):
    root = wr.parse(NAMED[name])
    assert wr.text_of(root, wr.roles(wr._wrap(root))[0]).split() == ["all", "of", "it"]


def test_wrappers_find_optional_and_repeated_parts():
    pages = ["<body><nav>m</nav><article><h1>a</h1><p>x<p>y</article>", "<body><nav>m</nav><div class=promo>buy</div><article><h1>b</h1><p>z</article>"]
    whole = None
    for p in pages:
        one = wr._wrap(wr.parse(p))
        whole = one if whole is None else wr._merged(whole, one)
    assert wr.expression(whole) == "<html> <body> <nav> =  <div.promo> = ? <article> <h1> #  <p> # +   "
    assert wr.roles(whole)[0] == ["html/body/article"]


def extracted(pages):
    whole = None
    for p in pages:
        one = wr._wrap(wr.parse(p))
        whole = one if whole is None else wr._merged(whole, one)
    paths, fixed = wr.roles(json.loads(json.dumps(whole)))
    return [wr.text_of(wr.parse(p), paths, set(fixed)) for p in pages]


def test_slots_decide_without_names():
    """Neutral classes: the same first and last paragraph on all pages, a notice on some, and a menu that varies a little."""
    said = [[f"Story {i} number {k} tells of {i * 7 + k} things that happened." for k in range(1 + i % 4)] for i in range(20)]
    pages = [
        f"<body><div class=x1><a href=a>one</a> <a href=b>two {i % 3}</a></div><div class=x2><p>Read us every day.</p>" + "".join(f"<p>{t}</p>" for t in ts) + ("<div class=x9>Today only: half price.</div>" if i % 3 == 0 else "") + "<p>All of it is ours.</p></div><div class=x3>Made by us</div></body>"
        for i, ts in enumerate(said)
    ]
    assert extracted(pages) == ["\n".join(ts) for ts in said]


def test_pages_that_are_all_alike_keep_their_text():
    assert extracted(["<body><div><p>one text</p><p>and more of it</p></div></body>"] * 8) == ["one text\nand more of it"] * 8


def test_deep_and_wide_pages(spark):
    deep = "<div>" * 5000 + "<p>inner text</p>" + "</div>" * 5000
    wide = "<article>" + "".join(f"<dt>t{i}<dd>d{i}" for i in range(10_000)) + "</article>"
    odd = "<article>" + "".join(f"<{['p', 'ul', 'pre', 'h2'][i * i % 7 % 4]}>s{i}</{['p', 'ul', 'pre', 'h2'][i * i % 7 % 4]}>" for i in range(20_000)) + "</article>"
    rows = [(1, "https://a.example/1", deep), (2, "https://a.example/2", wide), (3, "https://a.example/3", odd), (4, "https://a.example/4", odd.replace("<p>s1<", "<pre>s1<"))]
    got = {r.page_id: r.text for r in wr.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[1] == "inner text" and got[2] == "\n".join(f"{x}{i}" for i in range(10_000) for x in "td") and got[3] == "\n".join(f"s{i}" for i in range(20_000))


def test_odd_pages(spark):
    rows = [(1, "https://A.example/x", None), (2, None, "<p>hi"), (3, "nonsense", ""), (4, "https://a.example", "<article>" + "<p>word </p>" * 5000), (5, "https://a.example", "no markup at all"), (5, "https://a.example", "no markup at all"), (6, "https://a.example", "<article>"), (7, "https://a.example", "<<<>>> < b <p")]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, text string")
    got = wr.extract(df).collect()
    assert len(got) == len(rows)
    by = {r.page_id: r for r in got}
    assert (by[1].text, by[2].text, by[3].text, by[6].text) == ("", "hi", "", "") and by[5].text == "no markup at all" and by[4].n_chars == 5000 * 5 - 1
    assert wr.extract(df.limit(0)).count() == 0


def test_pipeline_stages(spark):
    """Each stage on its own input, against a plain version of what it decides."""
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, d).cache()
        before = {r.doc_id: r for r in docs.collect()}
        after = out.collect()
        assert {r.doc_id for r in after} <= set(before)
        if name != "source_mixing":
            assert out.columns == columns
        if name == "language_id":
            gone = set(before) - {r.doc_id for r in after}
            assert all(len(before[i].text) < 40 or not re.search(r"[^\W\d_]", before[i].text) for i in gone)
        if name == "ngram_jaccard_join":
            sets = {i: (lambda w: frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))))(re.findall(r"[^\x20\x09-\x0D]+", r.text.lower())) for i, r in before.items()}
            kept = sorted(r.doc_id for r in after)
            near = lambda a, b: 100 * len(a & b) >= 80 * len(a | b)
            assert not any(near(sets[a], sets[b]) for k, a in enumerate(kept) for b in kept[:k])
            assert all(any(near(sets[i], sets[j]) for j in before if j != i) for i in set(before) - set(kept))
        if name == "benchmark_decontamination":
            assert len(after) >= len(before) - 40
        if name == "pii_surrogates":
            assert len(after) == len(before) and all(r.n_chars == len(r.text) for r in after)
            changed = {r.doc_id for r in after if r.text != before[r.doc_id].text}
            assert {i for i, r in before.items() if re.search(r"\S+@mail\d\.example\.com", r.text)} <= changed
        if name == "source_mixing":
            assert sum(r.n_tokens for r in after) <= sum(len(re.findall(r"[^\x20\x09-\x0D]+", r.text)) for r in before.values())
        out.write.mode("overwrite").parquet(f"{common.shared_root(spark)}/test-{name}")
        docs = spark.read.parquet(f"{common.shared_root(spark)}/test-{name}")
