"""Quality rules, language ID, URL filters, license scans and packing against brute force."""

import re
from collections import Counter

import numpy as np
import pytest
from lodestrata.llm import langid, license_scan, packing, quality, url_rules

EDGE_TEXTS = [None, "", " \n ", "a", "a b c d e a b c d e", "x y\nx y\n\n \nx y", "### $$ |a|", "A\x85b c", "é" * 50, "w " * 30_000, "one two three four five six\nseven one two three four five six"]


def brute_counts(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    at = {}
    for i in range(len(w) - 4):
        at.setdefault(tuple(w[i : i + 5]), []).append(i)
    covered = {j for v in at.values() if len(v) > 1 for i in v for j in range(i, i + 5)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    failed = len(w) < 10 or 100 * len(covered) > 20 * len(w)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), sum(x in lines[:i] for i, x in enumerate(lines)), len(covered), failed


def test_quality_counts(docs, texts):
    some = EDGE_TEXTS + texts[:60]
    df = docs([(i, t, "en") for i, t in enumerate(some)])
    for r in quality.assess(df, quality.references(df)).collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute_counts(some[r.doc_id])
        assert not (r.base_failed and r.kept)
    assert quality.assess(docs([]), quality.references(docs([]))).count() == 0


def test_quality_keeps_prose_and_rejects_symbol_noise(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    refs = quality.references(df)
    rows = {r.doc_id: r for r in quality.assess(df, refs).collect()}
    text = {r.doc_id: r.text for r in df.collect()}
    prose = [i for i, t in text.items() if not re.search(r"[#*$%&|<>]", t) and not rows[i].base_failed]
    assert sum(rows[i].kept for i in prose) >= 0.995 * len(prose)
    noise = "".join(chr(33 + i % 15) for i in range(400))
    assert not quality._judge(" ".join(noise[i : i + 3] for i in range(0, 390, 3)), "en", refs, quality._Counter())[-1]


def test_quality_rejects_word_lists_and_keeps_mislabelled_prose(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    refs, c = quality.references(df), quality._Counter()
    known = {w for x in quality.COMMON for w in (x, x.capitalize())}
    prose = [(r.text, r.lang) for r in df.collect() if r.text and not re.search(r"[#*$%&|<>]", r.text) and not quality._judge(r.text, r.lang, refs, c)[-2] and len(r.text.split()) >= 150]
    rejected = kept = 0
    for t, lang in prose:
        words = [w for w in t.split() if w not in known][:300]
        rejected += len(words) < 120 or not quality._judge(" ".join(words), lang, refs, c)[-1]
        kept += quality._judge(t, "de" if lang != "de" else "en", refs, c)[-1]
    assert len(prose) > 100 and rejected >= 0.9 * len(prose) and kept >= 0.99 * len(prose)


def test_js_distance():
    assert quality.js_distance(np.array([1, 0]), np.array([0, 1])) == pytest.approx(1)
    assert quality.js_distance(np.array([2, 2]), np.array([1, 1])) == 0 == quality.js_distance(np.array([0, 0]), np.array([1, 1]))


def test_language_id_held_out(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = langid.train(df.where(~langid.held_out()))
    rows = langid.identify(df, model).join(df.select("doc_id", "lang", langid.held_out().alias("h")), "doc_id").where("h").collect()
    assert sum(r.lang_pred == r.lang for r in rows) / len(rows) > 0.97
    assert all(0 <= r.score <= 1 for r in rows)


def test_language_id_edges(docs):
    assert langid.identify(docs([]), langid.train(docs([]))).count() == 0
    got = langid.identify(docs([(1, "hello"), (2, None)]), langid.train(docs([(1, "hello"), (2, None, "en")]))).collect()
    assert {(r.lang_pred, r.score) for r in got} == {("und", 0.0)}
    train = docs([(i, f"the house and the tree {i}", "en") for i in range(9)] + [(20 + i, f"das Haus und der Baum {i}", "de") for i in range(9)] + [(50, None, "fr"), (51, "x", None)])
    model = langid.train(train)
    assert model.langs == ["de", "en"]
    got = langid.identify(docs([(1, "the tree"), (None, "der Baum"), (3, None), (4, "123 ###"), (5, ""), (6, "und das " * 50_000), (6, "und das " * 50_000)]), model).collect()
    assert sorted((str(r.doc_id), r.lang_pred) for r in got) == sorted([("1", "en"), ("None", "de"), ("3", "und"), ("4", "und"), ("5", "und"), ("6", "de"), ("6", "de")])
    many = langid.codewords(9)
    assert min((many[i] != many[j]).sum() for i in range(9) for j in range(i)) >= 8


def brute_url(url):
    host, path = "", ""
    if url and "://" in url:
        m = re.match(r"([^/?#]*)([^?#]*)", url.split("://", 1)[1])
        host, path = re.sub("[A-Z]", lambda c: c[0].lower(), m[1]), m[2]
    fits = [(len(h + p), h + p, v) for v, h, p in url_rules.SITE_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, max(fits)[1] if fits else None, max(fits)[2] if fits else None


def test_url_rules(spark, docs):
    urls = [None, "", "x", "http://", "http://net", "http://net/", "HTTP://A.NET/x", "https://m.example.net/en/25#top", "https://example.net/fr/", "http://notexample.com/de/", "http://u:p@www.example.com/de/1?q=/fr/", "http://a.org/fr/x", "http://a.org/en/?x=/fr/", "http://é.org/fr/", "http://h.com/a.net/", "http://x.net?/", "a://b://c.net/", "http://spam-farm.org/en/", "http://h.com/" + "a" * 20_000]
    got = url_rules.judge(docs([(i, u) for i, u in enumerate(urls)]), "doc_id", "text").collect()
    for r in got:
        host, path, rule, verdict = brute_url(urls[r.doc_id])
        assert (r.host, r.path, r.rule) == (host, path, rule)
        assert r.verdict == (verdict or ("block" if r.category else "allow"))
    assert got[17].verdict == "block" and got[17].category == "spam" and url_rules.judge(docs([]), "doc_id", "text").count() == 0


def test_canonical_urls(spark, docs, tmp_path):
    of = lambda u: url_rules.canonical(*url_rules.parts(u))
    assert of("http://u:p@Ads.X.com.:8080/a/./b//../%43asino/?q") == "ads.x.com/a/casino"
    assert of("http://h.com/%2541/%c3%a9/../../../../z/") == "h.com/z" and of("http://h.com/%2541") == "h.com/%41" and of("x") == ""
    (tmp_path / "rules.txt").write_text("# own list\n\nadult  *rude*\nads h?.net*\n")
    rules = url_rules.read_globs(spark, str(tmp_path / "rules.txt"))
    assert rules == (("adult", "*rude*"), ("ads", "h?.net*"))
    urls = ["http://a.com/R%75DE", "http://h1.net", "http://h12.net", None, "http://a.com/R%75DE"]
    got = url_rules.judge(docs([(None, u) for u in urls]), "doc_id", "text", (("allow", "a.com", "/"), ("block", "a.com", "/")), rules).collect()
    assert [(r.rule, r.verdict, r.category) for r in got] == [("a.com/", "allow", "adult"), (None, "block", "ads"), (None, "allow", None), (None, "allow", None), ("a.com/", "allow", "adult")]


def test_globs_against_fnmatch():
    import fnmatch
    import random

    rng = random.Random(3)
    globs = ["".join(rng.choice("ab*?") for _ in range(rng.randint(0, 9))) for _ in range(60)]
    words = ["".join(rng.choice("abc") for _ in range(rng.randint(0, 12))) for _ in range(300)]
    g = url_rules.Globs([[c if c in "*?" else ord(c) for c in x] for x in globs])
    got = g.match([np.array([ord(c) for c in w], np.int64) for w in words])
    assert [[fnmatch.fnmatchcase(w, x) for x in globs] for w in words] == got.tolist()


def test_words_of_a_license_out_of_order_are_none(docs):
    text = "she released the boat under the pier while mit students watched; a fishing license hung there"
    df = docs([(1, text), (2, "It is released under the MIT license, as we said.")])
    rows = {r.doc_id: r for r in license_scan.scan(df, license_scan.document_frequency(df)).collect()}
    assert not rows[1].blocks and [(b.label, b.containment) for b in rows[2].blocks] == [("mit", 1.0)]


def test_essex_is_no_adult_site(docs):
    urls = ["https://essex-chat.ac.uk/a", "http://x.org/specialist/", "http://the.sex-chat.example/", "http://a.org/best-sex-chat", "http://porn.example"]
    got = {r.doc_id: r.category for r in url_rules.judge(docs(list(enumerate(urls))), "doc_id", "text", ()).collect()}
    assert got == {0: None, 1: None, 2: "adult", 3: "adult", 4: "adult"}


def test_license_scan(docs):
    body = lambda part: max((t for t, x in license_scan.TEMPLATES if x == part), key=len)
    long = "filler " * 3000 + "permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files" + " x" * 50
    texts = [None, "", "Released under the MIT License.", "GNU General Public License GNU general public-license", "cc by cc by", "Licensed under CC BY-NC 4.0.", "mit licenses", long, "released by mit under license the"]
    texts += ["intro " * 90 + body("bsd").replace(" ", "\n", 40) + " end" * 300, body("apache")[:400] + " and nothing else", body("gpl").replace("program", "library"), long, None]
    texts += [" ".join(w for i, w in enumerate(body("mit").split()) if i % k) for k in (3, 9, 30)]
    df = docs([*enumerate(texts), (None, "mit license")])
    rows = {r.doc_id: r for r in license_scan.scan(df, license_scan.document_frequency(df)).collect()}
    for i, t in enumerate(texts):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        want = sorted((j, label) for p, label in license_scan.PHRASES for j in range(len(w)) if w[j : j + len(p.split())] == p.split())
        assert rows[i].n_words == len(w) and [(p.word, p.label) for p in rows[i].places] == want
        found = set()
        for text, label in license_scan.TEMPLATES:
            size, t = license_scan.block_of(text), text.split()
            held = set(zip(t, t[1:], strict=False))
            for s in range(0, max(1, len(w) - size // 2), size // 2):
                part = w[s : s + size]
                if len(set(zip(part, part[1:], strict=False)) & held) >= 0.9 * len(held) - 1e-9:
                    found.add((s, min(size, len(w) - s), label))
        assert {(b.word, b.words, b.label) for b in rows[i].blocks} == found
    assert "cc-by-nc" in {b.label for b in rows[5].blocks} and {b.label for b in rows[7].blocks} == {"mit"}
    assert {"bsd"} <= {b.label for b in rows[9].blocks if b.words == 512} and not [b for b in rows[10].blocks if b.words > 64] and rows[None].places[0].label == "mit"
    assert license_scan.scan(docs([]), license_scan.document_frequency(docs([]))).count() == 0


def test_packing_is_whole_and_fits(docs, texts):
    some = [*texts, "w " * 9000, None, ""]
    rows = [(i, t) for i, t in enumerate(some)] + [(None, "null id here"), (0, "x"), (0, "x")]
    got = packing.best_fit(docs(rows), group=15).collect()
    want = Counter()
    for k, t in rows:
        want[k] += len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    have, bins = Counter(), {}
    for r in got:
        have[r.doc_id] += r.piece_len
        if r.bin_id:
            bins.setdefault(r.bin_id, []).append(r)
        else:
            assert r.piece_len == 0
    assert have == want
    for rs in bins.values():
        total = sum(r.piece_len for r in rs)
        assert {r.bin_len for r in rs} == {total} and sorted(r.bin_pos for r in rs) == list(range(len(rs)))
        assert {r.bin_capacity for r in rs} == {min(c for c in packing.CAPACITIES if c >= total)}
    assert packing.best_fit(docs([])).count() == 0


def test_packing_fills_bins():
    rng = np.random.default_rng(0)
    n = np.clip(rng.lognormal(5.5, 1, 20_000).astype(np.int64), 1, 2048)
    at, cap = packing.pack(n)
    used = np.bincount(at, weights=n)
    assert (used <= cap).all() and used.sum() / cap.sum() > 0.97


def test_packing_is_cheapest_of_all_subsets_and_rules(monkeypatch):
    from itertools import combinations

    tried, fill = [], packing._fill
    monkeypatch.setattr(packing, "_fill", lambda n, c, opens: tried.append([opens(x) for x in (1, 600, 1500)]) or fill(n, c, opens))
    rng, top = np.random.default_rng(3), packing.CAPACITIES[-1]
    for n in (rng.integers(1, 700, 50), rng.integers(400, 2049, 50)):
        tried.clear()
        at, cap = packing.pack(n)
        total, want = sum(map(packing.cost, cap.tolist())), []
        for k in range(len(packing.CAPACITIES)):
            for sizes in combinations(packing.CAPACITIES[:-1], k):
                for rule in (lambda c: c, lambda c: packing.cost(c) / c):
                    opens = lambda x, s=(*sizes, top), r=rule: min((c for c in s if c >= x), key=r)
                    assert [opens(x) for x in (1, 600, 1500)] in tried
                    _, used = fill(np.sort(n)[::-1], packing.CAPACITIES, opens)
                    want.append(sum(packing.cost(min(c for c in packing.CAPACITIES if c >= u)) for u in used))
        assert total == min(want)
