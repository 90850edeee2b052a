import hashlib
import re

import numpy as np
import pyarrow as pa
import pytest
from oracle import DATA, assert_same, connect

from gradus.llm import decontaminate as dc
from gradus.llm import jaccard, langid, licences, mixing, passages, pii, registry, toxicity
from gradus.llm import textkit as tk


@pytest.fixture(scope="module")
def con():
    return connect()


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_against_sql(spark, con, name):
    assert_same(registry.queries()[name](spark, DATA), registry.oracle_sql()[name], con)


def spoken(text, pattern=r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(pattern, low)


def test_words_are_those_of_the_patterns():
    rng = np.random.default_rng(0)
    alphabet = list("abZ09 .\n\té中🙂\x0b\x7f{")
    texts = ["".join(rng.choice(alphabet, size=rng.integers(0, 40))) for _ in range(300)] + ["", None, "a", " "]
    for letters, pattern in ((tk.ALNUM, r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"), (tk.SPACED, r"[^\x20\x09-\x0D]+")):
        for limit in (1 << 21, 64):
            got, hashes = [], {}
            for c in tk.chunks(pa.array(texts, pa.string()), limit):
                w = tk.words(c.data, c.offsets, letters)
                ends = np.concatenate([[0], np.cumsum(w.count)])
                for k in range(c.last - c.first):
                    own = [tk.LOWER[c.data[w.start[i] : w.end[i]]].tobytes().decode() for i in range(ends[k], ends[k + 1])]
                    got.append(own)
                    for x, h in zip(own, w.hash[ends[k] : ends[k + 1]].tolist(), strict=True):
                        assert hashes.setdefault(x, h) == h
            assert got == [spoken(t, pattern) for t in texts]
            assert len(set(hashes.values())) == len(hashes)


def test_windows_stay_in_their_row():
    h, doc = np.arange(10, dtype=np.uint64), np.array([0] * 4 + [1] * 2 + [2] * 4)
    w, at = tk.windows(h, doc, 3)
    assert at.tolist() == [0, 1, 6, 7] and len(set(w.tolist())) == 4


# ----- op 4


def test_decontamination_of_odd_rows(spark, odd):
    bench = spark.createDataFrame([(1, "one two three four"), (1, "one two three four"), (2, None), (3, ""), (None, "four"), (10, "中文"), (11, "two three")], "item_id long, text string")
    for block in (1 << 20, 8):
        rows = dc.decontaminate(odd, bench, block_bytes=block).collect()
        assert len(rows) == odd.count()
        by = {r.doc_id: r for r in rows}
        assert (by[1].n_words, by[1].n_hit, by[1].items, by[1].contaminated) == (4, 4, ["1", "11"], True)
        assert by[1].items_sha256 == hashlib.sha256(b"1,11").hexdigest()
        assert (by[2].n_words, by[2].n_hit, by[2].contaminated) == (0, 0, False)
        assert by[9].items == ["10"] and by[5].n_hit == 0 and by[None].n_hit == 4
    cut = {r.doc_id: r.text for r in dc.remove_spans(dc.decontaminate(odd, bench)).collect()}
    assert cut[1] == "" and cut[2] is None and cut[9] == "Ünïcödé ß  🙂"
    assert dc.decontaminate(odd.limit(0), bench).count() == 0
    assert dc.decontaminate(odd, bench.limit(0)).filter("contaminated").count() == 0


# ----- op 1


def brute_components(texts, size, percent):
    sets = {}
    for k, t in texts.items():
        w = spoken(t, r"[^\x20\x09-\x0D]+")
        n = min(size, len(w))
        sets[k] = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if w else set()
    root = {k: k for k in texts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    keys = sorted(texts)
    for i, a in enumerate(keys):
        for b in keys[:i]:
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                ra, rb = find(a), find(b)
                root[max(ra, rb)] = min(ra, rb)
    return {k: (len(sets[k]), find(k)) for k in texts}


@pytest.mark.parametrize(("size", "percent"), [(3, 90), (5, 80), (1, 60)])
def test_jaccard_against_all_pairs(spark, size, percent):
    rng = np.random.default_rng(size)
    texts = {}
    for g in range(12):
        base = [f"w{rng.integers(0, 3000)}" for _ in range(int(rng.integers(3, 120)))]
        for _ in range(int(rng.integers(1, 9))):
            own = list(base)
            for _ in range(int(rng.integers(0, 4))):
                own[rng.integers(0, len(own))] = f"x{rng.integers(0, 9)}"
            texts[len(texts)] = " ".join(own)
    for n in range(1, 16):
        texts[len(texts)] = " ".join(f"s{i}" for i in range(n))
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.join_components(df, size, percent).collect()}
    assert got == brute_components(texts, size, percent)


def test_jaccard_without_hub_rounds(spark, monkeypatch):
    """What hubs don't link, the full comparison of tiles does, in blocks too."""
    monkeypatch.setattr(jaccard, "HUB_ROUNDS", 0)
    monkeypatch.setattr(jaccard, "BLOCK", 3)
    rng = np.random.default_rng(9)
    base = [f"w{i}" for i in range(60)]
    texts = {}
    for k in range(25):
        own = list(base)
        for _ in range(int(rng.integers(0, 4))):
            own[rng.integers(0, 60)] = f"x{rng.integers(0, 50)}"
        texts[k] = " ".join(own)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.join_components(df).collect()}
    assert got == brute_components(texts, 3, 90)


def test_jaccard_of_odd_rows(spark, odd):
    rows = jaccard.join_components(odd).collect()
    assert len(rows) == odd.count()
    by = {r.doc_id: (r.n_shingles, r.component_id) for r in rows if r.doc_id is not None}
    assert by[1] == (2, 1) and by[7] == (2, 1) and by[2] == (0, 2) and by[3] == (0, 3) and by[4] == (0, 4) and by[6] == (29998, 5)
    assert [(r.n_shingles, r.component_id) for r in rows if r.doc_id is None] == [(2, 1)]
    assert jaccard.join_components(odd.limit(0)).count() == 0


# ----- op 6


def test_languages_held_out(spark):
    import duckdb

    got = registry.queries()["op6_language_id"](spark, "/root/testdata/sf0.01").toPandas()
    truth = duckdb.sql("select doc_id, lang from '/root/testdata/sf0.01/documents.parquet'").df()
    both = got.merge(truth, on="doc_id")
    assert len(both) == 1000 and both["score"].between(0, 1).all()
    assert (both[both.held_out].lang_pred == both[both.held_out].lang).mean() > 0.98


def test_languages_of_odd_rows(spark, odd, documents):
    model = langid.fit(documents)
    rows = langid.identify(odd, model).collect()
    by = {r.doc_id: (r.lang_pred, r.score) for r in rows}
    assert len(rows) == odd.count() and all(by[i] == ("und", 0.0) for i in (2, 3, 4, 8)) and by[9][0] in {"en", "de", "fr", "es"}
    assert not any(r.accepted for r in rows if r.lang_pred == "und")
    none = langid.identify(spark.createDataFrame([(1, "\u00b2 \u00bd 12 _!"), (2, "\u4e2d")], "doc_id long, text string"), model).collect()
    assert [r.lang_pred == "und" for r in none] == [True, False]
    far = spark.createDataFrame([(1, "qxzj vkqw xzzq jjvx " * 3 + " ".join(f"{a}{b}qz{b}{a}xk" for a in "qxzjkvwyp" for b in "xqjzkwvpy")), (2, "This."), (3, "the and of this is that with for from have")], "doc_id long, text string")
    assert {r.doc_id: r.accepted for r in langid.identify(far, model).collect()} == {1: False, 2: True, 3: True}
    rng = np.random.default_rng(5)
    alphabets = ["abcdefghijklmnopqrstuvwxyz", "".join(map(chr, range(0x4E00, 0x6E00))), "".join(map(chr, range(0x430, 0x450)))]
    junk = [(n, " ".join("".join(rng.choice(list(letters), 6)) for _ in range(n))) for letters in alphabets for n in (20, 400, 2000, 20000)]
    assert not any(r.accepted for r in langid.identify(spark.createDataFrame(junk, "n int, text string"), model).collect())
    line = documents.filter("length(text) > 300").first().text[:300]
    kept = langid.identify(spark.createDataFrame([(1, line), (2, (line + "\n") * 200)], "doc_id long, text string"), model).collect()
    assert all(r.accepted for r in kept)
    nothing = langid.identify(odd, langid.fit(odd)).collect()
    assert {r.lang_pred for r in nothing} == {"und"} and not any(r.accepted for r in nothing)


# ----- op 9


def test_toxicity_held_out(spark):
    import duckdb

    got = registry.queries()["op9_toxicity"](spark, "/root/testdata/sf0.1").toPandas()
    truth = duckdb.sql("select doc_id, toxic from '/root/testdata/sf0.1/labels.parquet'").df()
    both = got.merge(truth, on="doc_id")
    out = both[both.held_out]
    assert (out.predicted == out.toxic).mean() > 0.96 and got["score"].between(0, 1).all()


def test_toxicity_locates_sentences(spark, odd):
    texts = [(i, f"Fine words here. You are a {'wretch' if i % 3 == 0 else 'friend'} today. More fine words {i}.", int(i % 3 == 0)) for i in range(120)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in texts], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in texts] + [(None, 1), (5, None)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    rows = toxicity.score(docs, model).collect()
    assert all(r.predicted == int(r.doc_id % 3 == 0) for r in rows)
    assert all([s.sentence for s in r.offending] == (["You are a wretch today"] if r.doc_id % 3 == 0 else []) for r in rows)
    plain = {r.doc_id: r.score for r in toxicity.score(odd, model).collect()}
    assert plain[2] == plain[3] == 0.0 and len(plain) == odd.select("doc_id").distinct().count()
    assert toxicity.score(docs, toxicity.fit(docs, labels.limit(0))).filter("predicted = 1").count() == 0
    repeated = toxicity.fit(docs.unionAll(docs).unionAll(docs), labels)
    assert (repeated.weights == model.weights).all() and toxicity.score(docs.limit(0), model).count() == 0


# ----- op 3


def test_licences(spark, odd, documents):
    model = licences.fit(spark)
    told = [(f, t) for f, ts in licences.TEMPLATES.items() for t in ts]
    df = spark.createDataFrame([(i, "Some text first.\n" + t + "\nMore text.") for i, (_, t) in enumerate(told)] + [(1000 + i, t) for i, t in enumerate(licences.OTHER)], "doc_id long, text string")
    got = {r.doc_id: r.families for r in licences.scan(df, model).collect()}
    assert sum(got[i] == [f] for i, (f, _) in enumerate(told)) >= len(told) - 1
    assert all(not got[1000 + i] for i in range(len(licences.OTHER)))
    rows = licences.scan(odd, model)
    assert rows.count() == odd.count() and rows.filter("n_paragraphs = 0").count() == 3
    lines = {"Released under the MIT License.": "mit", "Licensed under the Apache License, Version 2.0.": "apache", "Licensed under CC BY-NC 4.0.": "cc-by-nc", "All rights reserved.": "proprietary", "This work is licensed under the GNU General Public License, version 3.": "gpl"}
    brute = {d.doc_id: sorted({f for s, f in lines.items() if s in d.text.split("\n")}) for d in documents.collect()}
    assert {r.doc_id: r.families for r in licences.scan(documents, model).collect()} == brute


def test_every_paragraph_is_judged(spark):
    """What is left out before the sum changes no result, and no word has to be in a paragraph."""
    model = licences.fit(spark)
    said = ["Dual MIT / Apache-2.0", "Distributed under the MIT terms", licences.TEMPLATES["proprietary"][3], "The road was long.", "x", "Alle Rechte vorbehalten"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(said + licences.OTHER)], "doc_id long, text string")
    quick = {r.doc_id: r.licences for r in licences.scan(df, model).collect()}
    model.bounded = lambda: False
    assert quick == {r.doc_id: r.licences for r in licences.scan(df, model).collect()}
    assert [[x.family for x in quick[i]] for i in range(5)] == [["apache"], ["mit"], ["proprietary"], [], []]


def test_licence_plan_has_no_python(spark, documents):
    plan = licences.scan(documents)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


# ----- op 2


def test_surrogates(spark, odd):
    said = "Dr. John Smith met Anna Jones. Smith wrote to john.s@mail7.example.com, JOHN.S@mail7.example.com, +1 (017) 555-7713, 4785 3805 9239 1139, 078-05-1120, GB82 WEST 1234 5698 7654 32, 10.1.2.3, token = \"24be64439e3e49cf46b2d7c90f3602a3d0b907ff\"."
    df = spark.createDataFrame([(1, said), (2, "Call +1 (017) 555-7713 or 4785380592391139; not 4785380592391138."), (3, None), (4, "")], "doc_id long, text string")
    rows = {r.doc_id: r for r in pii.replace(df, "k").collect()}
    new = rows[1].text
    assert rows[1].n_entities == 13 and rows[3].text is None and rows[4].text == ""
    for private in ("john.s@", "555-7713", "4785 3805", "078-05-1120", "WEST 1234", "10.1.2.3", "24be6443", "Anna", "Jones", "John", "Smith"):
        assert private.lower() not in new.lower()
    mails = re.findall(r"\S+@\S+\.com", new)
    assert mails[0].lower() == mails[1].lower() and mails[1].split("@")[0].isupper()
    card = re.search(r"\d{4} \d{4} \d{4} \d{4}", new)[0].replace(" ", "")
    assert pii._luhn(card) and card in rows[2].text and "4785380592391138" in rows[2].text
    phone = re.search(r"\+1 \(\d{3}\) \d{3}-\d{4}", new)[0]
    assert phone in rows[2].text
    names = re.search(r"Dr\. (\w+) (\w+) met (\w+) \w+\. (\w+|\w+ \w+)", new)
    assert names[1] in pii.GIVEN["latin", "m"] and names[3] in pii.GIVEN["latin", "f"]
    assert pii.replace(df, "k").filter("doc_id = 1").first().text == new
    assert pii.replace(df, "other").filter("doc_id = 1").first().text != new
    assert pii.replace(odd).count() == odd.count() and pii.replace(odd.limit(0)).count() == 0


def test_surrogates_are_distinct():
    keyed = pii.Keyed("k")
    for kind, entities in {"card": [c for i in range(500) for d in range(10) if pii._luhn(c := f"4{i:013d}{d}")], "ipv4": [f"1.2.{i // 250}.{i % 250}" for i in range(500)], "phone": [f"+1{i:010d}" for i in range(500)], "email": [f"ab{i:03d}@x.org" for i in range(500)], "ssn": [f"{i + 100:03d}450001" for i in range(500)]}.items():
        got = [keyed.surrogate(kind, e) for e in entities]
        if kind != "ssn":
            assert len(set(got)) == len(entities)
        assert all(a != b for a, b in zip(got, entities, strict=True))
    for names in pii.GIVEN.values():
        assert len({keyed.surrogate("given_m_latin" if n in pii.GIVEN["latin", "m"] else f"given_{pii._GENDER[n][1]}_{pii._GENDER[n][0]}", n) for n in names}) == len(names)


def test_collisions_are_drawn_again(spark):
    names = [f"N{a}{b}" for a in "aeiou" for b in ("bb", "cc", "dd", "ff")]
    one_syllable = pii.Keyed("k", width=1)
    assert len({one_syllable.surrogate("family_latin", n) for n in names}) < len(names)
    df = spark.createDataFrame([(i, f"Mr {n} spoke.") for i, n in enumerate(names)], "doc_id long, text string")
    changes, keyed = pii.redrawn(df, one_syllable, pii.Workspace(spark, "t"))
    again = {(r.kind, r.entity): r.attempt for r in changes.collect()}
    got = [keyed.surrogate("family_latin", n, again.get(("family_latin", n), 0)) for n in names]
    assert len(set(got)) == len(names) and again


def test_more_redraws_than_are_broadcast_give_the_same(spark, odd):
    """All of a format's 26 addresses are drawn again; no limit changes what they become, and names keep their length."""
    letters = "abcdefghijklmnopqrstuvwxyz"
    rows = [(i, f"Mr Nabb and {c}@x.org wrote to {letters[(i + 1) % 26]}@x.org. Call +1 202 555 01{i:02d}.") for i, c in enumerate(letters)]
    df = spark.createDataFrame([*rows, (99, None), (98, "")], "doc_id long, text string")
    for docs in (df, odd):
        few, many = (sorted(map(repr, pii.replace(docs, "k", most=most).collect())) for most in (pii.MAX_REDRAWN, -1))
        assert few == many
    texts = [r.text for r in pii.replace(df, "k", most=-1).filter("doc_id < 26").orderBy("doc_id").collect()]
    mails = [re.findall(r"\S+@[a-z.]+[a-z]", t) for t in texts]
    assert len({m[0] for m in mails}) == 26 and all(mails[i][1] == mails[(i + 1) % 26][0] for i in range(26))


def test_what_is_left_alone_trades_places(spark):
    keyed = pii.Keyed("k")
    frame = lambda *pairs: spark.createDataFrame(list(pairs), "kind string, entity string")
    known = frame(("email", "a@x.org"), ("email", "b@x.org"), ("email", "cc@y.org"))
    got = {r.entity: r.surrogate for r in pii._rotated(frame(("email", "a@x.org")), known, keyed).collect()}
    assert got == {"a@x.org": "b@x.org", "b@x.org": "a@x.org"}
    alone = pii._rotated(frame(("email", "cc@y.org")), known, keyed).collect()
    assert len(alone) == 1 and re.fullmatch(r"\[email-[0-9a-f]{8}\]", alone[0].surrogate)


@pytest.mark.parametrize("said", ["\u201cJohn Smith\u201d left.", "[John Smith] left.", "**John Smith**", "Author:John Smith", "<b>John Smith</b>", "John Smith came. Later John left, and Smith too."])
def test_names_after_any_sign(said):
    found = pii.find(said)
    left = said
    for a, b, _, _ in reversed(found):
        left = left[:a] + left[b:]
    assert found and "John" not in left and "Smith" not in left


def test_a_full_format_stays_distinct(spark):
    """Of ten secrets of one format nine occur, so redrawing never ends well."""
    df = spark.createDataFrame([(i, f'token="####{i}#"') for i in range(9)], "doc_id long, text string")
    assert df.count() == sum(r.n_entities for r in pii.replace(df, "k").collect())
    got = [r.text for r in pii.replace(df, "k").orderBy("doc_id").collect()]
    assert len(set(got)) == 9 and all(g != f'token="####{i}#"' for i, g in enumerate(got))


# ----- op 5


def test_mixing(spark, odd):
    rows = [(i, "abc"[min(2, i // 60)], "w " * (1 + i % 7)) for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    total = sum(1 + i % 7 for i in range(200))
    for budget in (None, 100, 2000):
        got = mixing.mix(df, budget=budget).collect()
        per = {}
        for r in got:
            per.setdefault(r.source, []).append(r)
        for rs in per.values():
            target = rs[0].weight * (budget or total)
            made = sum(r.n_tokens * r.copies for r in rs)
            assert target - 7 <= made <= target + 1e-6
            assert max(r.copies for r in rs) - min(r.copies for r in rs) <= 1
        w = [rs[0].weight for rs in per.values()]
        assert -sum(x * np.log(x) for x in w) >= 0.97 * np.log(3) - 1e-6
    real = mixing.realise(mixing.mix(df, budget=2000))
    assert real.count() == sum(r.copies for r in mixing.mix(df, budget=2000).collect())
    assert len({r.doc_id for r in mixing.mix(odd).filter("copies > 0").collect()} & {2, 3, 4}) == 0
    assert mixing.mix(odd).count() == odd.count() and mixing.mix(odd.limit(0)).count() == 0


def test_mixing_radix_levels(spark, monkeypatch):
    """Small windows cut by more hash digits end in the same place."""
    df = spark.createDataFrame([(i, "s" if i % 3 else None, "w " * (1 + i % 5)) for i in range(900)], "doc_id long, source string, text string")
    a = sorted((r.doc_id, r.copies) for r in mixing.mix(df, budget=1200).collect())
    monkeypatch.setattr(mixing, "WINDOW_ROWS", 1)
    assert sorted((r.doc_id, r.copies) for r in mixing.mix(df, budget=1200).collect()) == a


def test_exponent(spark):
    shares = spark.createDataFrame([(0.9,), (0.05,), (0.05,)], "share double")
    x = mixing.exponent(shares, 0.97, 100.0, 1.0)
    h, _ = mixing._entropy([0.9, 0.05, 0.05], x)
    assert abs(h - 0.97 * np.log(3)) < 1e-6
    y = mixing.exponent(shares, 0.97, 2.0, 1.0)
    assert y > x and mixing._entropy([0.9, 0.05, 0.05], y)[1] <= 2 + 1e-6


# ----- op 8


def random_words(rng, n):
    return [f"w{rng.integers(0, 10**6)}" for _ in range(n)]


def test_passages_are_found(spark, odd):
    rng = np.random.default_rng(3)
    texts, planted = {}, set()
    for k in range(12):
        texts[k] = random_words(rng, 200)
    for a, b, n in ((0, 1, 51), (2, 3, 80), (4, 5, 60)):
        texts[b] = texts[b][:40] + texts[a][70 : 70 + n] + texts[b][40:]
        planted |= {a, b}
    fuzzy = list(texts[6][50:130])
    for i in (20, 45):
        fuzzy[i] = "changed"
    texts[7] = texts[7][:30] + fuzzy + texts[7][30:]
    texts[9] = texts[9][:10] + texts[8][20:60] + texts[9][10:]  # 40 words are no passage
    planted |= {6, 7}
    df = spark.createDataFrame([(k, " ".join(w)) for k, w in texts.items()], "doc_id long, text string")
    rows = passages.repeated_passages(df).collect()
    assert {r.doc_id for r in rows} | {r.match_doc_id for r in rows} == planted
    got = {(r.match_doc_id, r.doc_id): r for r in rows}
    assert (got[0, 1].start, got[0, 1].end, got[0, 1].match_start, got[0, 1].n_matched) == (40, 91, 70, 51)
    assert (got[6, 7].start, got[6, 7].end, got[6, 7].n_matched) == (30, 110, 78)
    same = {(r.doc_id, r.match_doc_id) for r in passages.repeated_passages(odd).collect()}
    assert same == {(6, 5)}
    assert passages.repeated_passages(odd.limit(0)).count() == 0


def test_passage_behind_a_partial_hub(spark):
    """The least document has half of a passage that two later ones share."""
    rng = np.random.default_rng(5)
    p = random_words(rng, 70)
    texts = [random_words(rng, 60) + p[:35], random_words(rng, 60), random_words(rng, 50) + p + random_words(rng, 50), random_words(rng, 20) + p + random_words(rng, 60)]
    df = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(texts)], "doc_id long, text string")
    assert [(r.doc_id, r.match_doc_id) for r in passages.repeated_passages(df).collect()] == [(3, 2)]


def test_one_passage_in_many_documents(spark):
    rng = np.random.default_rng(6)
    p = random_words(rng, 60)
    df = spark.createDataFrame([(k, " ".join(random_words(rng, 60) + p)) for k in range(60)], "doc_id long, text string")
    rows = passages.repeated_passages(df).collect()
    assert {r.doc_id for r in rows} | {r.match_doc_id for r in rows} == set(range(60)) and len(rows) <= 2 * 60


def edited(rng, passage, rate):
    """The passage with a share of its words replaced, left out or followed by another, at random places."""
    out = []
    at = set(rng.choice(len(passage), round(len(passage) * rate), replace=False).tolist())
    for i, w in enumerate(passage):
        out += [w] if i not in at else [[f"x{rng.integers(0, 10**6)}"], [], [w, f"x{rng.integers(0, 10**6)}"]][rng.integers(0, 3)]
    return out


def test_fuzzy_passages_by_rate_of_edits(spark):
    """Of 300 texts with passages of 60 words, those with 0 to 18 % of their words edited are found in 0.9 of all pairs or more; what is found is planted."""
    rng = np.random.default_rng(8)
    texts, rates = [], [0.0, 0.03, 0.06, 0.1, 0.15, 0.18]
    for k in range(150):
        p = random_words(rng, 60)
        q = edited(rng, p, rates[k % 6])
        texts += [random_words(rng, 100) + p + random_words(rng, 100), random_words(rng, 100) + q + random_words(rng, 100)]
    df = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(texts)], "doc_id long, text string")
    found = {(r.doc_id, r.match_doc_id) for r in passages.repeated_passages(df).collect()}
    truth = {(2 * k + 1, 2 * k): rates[k % 6] for k in range(150)}
    assert found <= set(truth)
    for rate in rates:
        assert sum(x in found for x, r in truth.items() if r == rate) >= 0.9 * 25, rate


def test_chains_against_common_subsequences():
    """What chains accept really matches, and what matches in 80 % is accepted."""
    rng = np.random.default_rng(2)
    for rate in (0.0, 0.1, 0.18, 0.4):
        for _ in range(20):
            p = random_words(rng, 70)
            a, b = random_words(rng, 30) + p + random_words(rng, 30), random_words(rng, 40) + edited(rng, p, rate) + random_words(rng, 20)
            code = {w: i for i, w in enumerate(dict.fromkeys(a + b))}
            hashed = [passages.tk.mix(np.array([code[w] + 1 for w in t], np.uint64)) for t in (a, b)]
            got = passages.chains(*hashed)
            assert bool(got) == (rate < 0.3)
            for x, e, y, f, n in got:
                assert n <= passages._common_words(a[x:e], b[y:f]) and n >= 0.8 * max(e - x, f - y) and min(e - x, f - y) >= 50


def test_partial_hubs_at_both_ends(spark):
    """The first and the last document of all seeds hold half of a passage that ten between them hold."""
    rng = np.random.default_rng(11)
    p = random_words(rng, 64)
    texts = [random_words(rng, 60) + p[:32], random_words(rng, 60) + p[32:]] + [random_words(rng, 40) + p + random_words(rng, 20) for _ in range(10)] + [p[:32] + random_words(rng, 60), p[32:] + random_words(rng, 60)]
    df = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(texts)], "doc_id long, text string")
    rows = passages.repeated_passages(df).collect()
    assert {r.doc_id for r in rows} | {r.match_doc_id for r in rows} == set(range(2, 12))


def test_passages_against_all_exact_runs(spark):
    """Every document that shares 50 words in a row with another one occurs, and what occurs really matches."""
    folder = "/root/testdata/sf0.01"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    said = {i: spoken(t) for i, t in texts.items()}
    holders = {}
    for i, w in said.items():
        for k in range(len(w) - 49):
            holders.setdefault(tuple(w[k : k + 50]), set()).add(i)
    truth = set().union(*(v for v in holders.values() if len(v) > 1))
    rows = registry.queries()["op8_substring_dedup"](spark, folder).collect()
    assert truth <= {r.doc_id for r in rows} | {r.match_doc_id for r in rows}
    for r in rows:
        a, b = said[r.doc_id][r.start : r.end], said[r.match_doc_id][r.match_start : r.match_end]
        assert len(a) >= 50 and len(b) >= 50 and r.n_matched >= 0.8 * max(len(a), len(b))
        common = [[0] * (len(b) + 1) for _ in range(2)]
        for x in a if len(a) * len(b) < 10**5 else ():
            common = [common[1], [0] * (len(b) + 1)]
            for j, y in enumerate(b):
                common[1][j + 1] = common[0][j] + 1 if x == y else max(common[0][j + 1], common[1][j])
        assert len(a) * len(b) >= 10**5 or r.n_matched <= common[1][len(b)]


def test_surrogates_leave_nothing_private(spark, documents):
    found = {r.doc_id: (r.text, r.n_entities) for r in registry.queries()["op2_pii_surrogates"](spark, DATA).collect()}
    patterns = [r"[\w.]+@mail\d\.example\.com", r"\+1 \(\d{3}\) 555-\d{4}", r"\b\d{1,3}(?:\.\d{1,3}){3}\b", r"\b[0-9a-f]{40}\b", r"\b4\d{15}\b"]
    seen = 0
    for d in documents.collect():
        for p in patterns:
            for private in re.findall(p, d.text):
                if p.startswith(r"\b4") and not pii._luhn(private):
                    continue
                seen += 1
                assert private not in found[d.doc_id][0]
        if not any(re.search(p, d.text) for p in patterns) and not found[d.doc_id][1]:
            assert found[d.doc_id][0] == d.text
    assert seen > 5


def test_a_slice_of_a_saved_table_reads_no_other(spark):
    """op8's check in round 3: seeds were read whole for each of their slices, twice."""
    from gradus.llm.common import _WRITERS, Workspace

    work, before = Workspace(spark, "slices"), spark.conf.get(_WRITERS)
    rows = spark.range(1000).selectExpr("id", "cast(id % 4 as int) as slice")
    saved = work.save(rows, "t", "slice")
    assert spark.conf.get(_WRITERS) == before
    assert sorted(r.id for r in saved.filter("slice = 3").collect()) == list(range(3, 1000, 4))
    plan = saved.filter("slice = 3").drop("slice")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(slice" in plan and saved.dtypes == rows.dtypes


def test_pipeline_makes_tiles_in_more_turns(spark, monkeypatch):
    """The pipeline's executors held too many tiles in two turns."""
    import corpus_pipeline
    from gradus.llm import jaccard

    def joined(docs, size, percent, text, key, turns=None):
        raise InterruptedError(turns)

    monkeypatch.setattr(jaccard, "join_components", joined)
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    with pytest.raises(InterruptedError, match="4"):
        corpus_pipeline.near_duplicates(spark, docs, "")
