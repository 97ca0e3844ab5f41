"""Decontamination, importance resampling and collocations against brute force, at small block, slice and batch sizes."""

import math
import random
import re
import zlib
from collections import Counter
from hashlib import sha256

import pytest
from lodestrata.llm import collocations, common, decontaminate, resample
from pyspark.sql import functions as F

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


# Decontamination

ITEMS = [("a", "One two three four five six seven eight nine ten eleven"), ("b", "É, short item"), (None, "no id here"), ("c", None), ("d", "..."), ("b", "other text of b"), ("e", "one TWO three four five six seven eight nine ten"), ("f", "x")]


def brute_hits(text, items):
    ws, hit, found = words(text), set(), set()
    for item, body in items:
        b = words(body)
        n = min(10, len(b))
        gone = {tuple(b[i : i + n]) for i in range(len(b) - n + 1)} if b else set()
        for i in range(len(ws) - n + 1):
            if tuple(ws[i : i + n]) in gone:
                hit.update(range(i, i + n))
                found |= {item} - {None}
    return len(ws), hit, sorted(found)


@pytest.mark.parametrize("limit", [4_000_000, 200])
def test_decontamination(spark, docs, monkeypatch, limit):
    monkeypatch.setattr(decontaminate, "AUTOMATON_BYTES", limit)
    rng = random.Random(2)
    texts = [None, "", "x", "...", "no hit", "ids: no-id here; É short\nitem!", "zero one two three four five six seven eight nine ten eleven twelve"]
    texts += [" ".join(rng.choice(["one two three four five six seven eight nine ten", "é short", "item", "other text", "of b", "x", "É Short Item", "no", "id here"]) for _ in range(rng.randint(1, 30))) for _ in range(40)]
    texts += ["far " * 30_000 + ITEMS[0][1] + " end" * 30_000]
    rows = [(i if i % 9 else None, t) for i, t in enumerate(texts)] + [(1, texts[6])] * 30
    items = spark.createDataFrame([(i, t, 1, "clash") for i, t in ITEMS], "item_id string, text string, doc_id int, _text string")
    got = decontaminate.scan(docs(rows), items).collect()
    assert len(got) == len(rows)
    want = Counter()
    for key, text in rows:
        n, hit, found = brute_hits(text, ITEMS)
        want[key, n, tuple(sorted(hit)), tuple(found)] += 1
    assert Counter((r.doc_id, r.n_words, tuple(w for s in r.spans for w in range(s.word, s.word_end)), tuple(r["items"])) for r in got) == want
    texts_of = {(r[0], len(words(r[1]))): r[1] for r in rows if r[0] is not None}
    for r in got:
        for s in r.spans if r.doc_id is not None else ():
            text = texts_of[r.doc_id, r.n_words]
            assert words(text)[s.word : s.word_end] == words(text[s.start : s.end])
        assert all(a.word_end < b.word for a, b in zip(r.spans, r.spans[1:], strict=False))


def test_decontamination_offsets_and_empty_tables(spark, docs):
    items = spark.createDataFrame([(7, "É, short item")], "item_id long, text string")
    text = "Ünï - (É  SHORT\n\nitem)."
    (r,) = decontaminate.scan(docs([(1, text)]), items).collect()
    assert r["items"] == ["7"] and [text[s.start : s.end] for s in r.spans] == ["É  SHORT\n\nitem"]
    assert decontaminate.scan(docs([]), items).count() == 0
    (r,) = decontaminate.scan(docs([(1, text)]), items.limit(0)).collect()
    assert (r.n_words, r.spans, r["items"]) == (4, [], [])


# Importance resampling


def grams(text):
    ws = words(text)
    return len(ws), [zlib.crc32(" ".join(ws[i : i + n]).encode()) % 10_000 for n in (1, 2, 3) for i in range(len(ws) - n + 1)]


def brute_resample(rows, target):
    s, t = Counter(), Counter()
    for _, text in rows:
        s.update(grams(text)[1])
    for text in target:
        t.update(grams(text)[1])
    n_s, n_t = sum(s.values()) + 10_000.0, sum(t.values()) + 10_000.0
    out = []
    for key, text in rows:
        n, found = grams(text)
        weight = sum(math.floor(1000 * math.log((t[b] + 1.0) * n_s / ((s[b] + 1.0) * n_t))) for b in found)
        h = int(sha256(f"42:{'' if key is None else key}".encode()).hexdigest()[:8], 16)
        out.append([key, n, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    able = sorted((r for r in out if r[1] >= 20), key=lambda r: (-r[4], r[0] is None, r[0]))
    for i, r in enumerate(able[: 5 * len(able) // 100]):
        r[5] = i + 1
    return sorted(map(tuple, out), key=str)


@pytest.mark.parametrize("parts", [1, 3])
def test_resampling(spark, docs, texts, monkeypatch, parts):
    monkeypatch.setattr(resample, "SLICE", 3_000)
    monkeypatch.setattr(common, "RANGE_ROWS", 50)
    rng = random.Random(3)
    pool = [*texts, "É" * 300 + " b", "a" * 64 + " " + "b" * 65 + " " + "c" * 70_000, "no-break\x85line tab\tend"]
    rows = list(enumerate(pool)) + [(None, "w " * 25), (1_000, None)] + [(2_000 + i, " ".join(rng.choice("abcdefgh") for _ in range(rng.randint(15, 40)))) for i in range(200)]
    rows += [(5, "same row " * 20)] * 60  # ties: one id, one text
    target = ["a b c d", "e f g é", None, "", "same row"]
    goal = spark.createDataFrame([(t, 1) for t in target], "text string, n_words int")
    got = resample.resample(docs(rows).repartition(parts), goal)
    assert got.columns == ["doc_id", "n_words", "n_features", "weight", "score", "rank"]
    assert rows_of(got) == brute_resample(rows, target)


def test_resampling_of_empty_tables(spark, docs):
    goal = spark.createDataFrame([("a b",)], "text string")
    assert resample.resample(docs([]), goal).count() == 0
    rows = [(i, f"w{i} " * 30) for i in range(40)]
    assert rows_of(resample.resample(docs(rows), goal.limit(0))) == brute_resample(rows, [])


# Collocations


def brute_collocations(rows, least, top):
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", (text or "").translate(LOWER)):
            ws = tuple(w for w in re.split("[ \t]+", piece) if w)
            n[lang] += len(ws)
            f.update((lang, ws[i : i + z]) for z in (1, 2, 3, 4) for i in range(len(ws) - z + 1))
    f = {k: v for k, v in f.items() if v >= least}
    out = []
    for (lang, g), a in f.items():
        if len(g) < 2 or any(x == lang and len(h) > len(g) and 100 * b >= 80 * a and any(h[i : i + len(g)] == g for i in range(len(h))) for (x, h), b in f.items()):
            continue
        cuts = [(2_000_000 * a // (f[lang, g[:k]] + f[lang, g[k:]]), k) for k in range(1, len(g))]
        score, k = min(cuts)
        out.append((lang, " ".join(g), a, f[lang, g[:k]], f[lang, g[k:]], n[lang], score))
    out.sort(key=lambda r: (r[0], -r[6], -r[2], r[1].encode()))
    seen = Counter()
    ranked = []
    for r in out:
        seen[r[0]] += 1
        if seen[r[0]] <= top:
            ranked.append((r[0], seen[r[0]], *r[1:]))
    return sorted(ranked, key=str)


def corpus(rng):
    vocab = ["the", "of", "a", "ab", "a\x01b", "É", "中文", "new", "york", "city", "x" * 50, "\x00", "don't", "ÀB", "\x1c", "\xa0"]
    weights = [30, 20, 5, 4, 3, 3, 3, 5, 5, 4, 2, 1, 2, 2, 2, 2]
    rows = []
    for i in range(150):
        text = ""
        for _ in range(rng.randint(0, 40)):
            text += rng.choice(["New York City", "of the", *rng.choices(vocab, weights, k=3)]) + rng.choice([" ", " ", "  ", "\t", ", ", "\n", "!", "? ", ""])
        rows.append((["en", "de", None, "und", "pt br", "z%\n1", ""][i % 7], text))
    return rows + [("en", None), (None, ""), ("en", "the of the of the of the of"), ("en", " \t.")] + [("en", "a copied text of the new york city, again")] * 60


@pytest.mark.parametrize("hot,slice_,top", [(1 / 1000, 4_000_000, 2000), (0.05, 500, 5), (2.0, 900, 2000)])
def test_collocations(spark, docs, monkeypatch, hot, slice_, top):
    monkeypatch.setattr(collocations, "HOT_SHARE", hot)
    monkeypatch.setattr(collocations, "SLICE", slice_)
    monkeypatch.setattr(collocations, "SAMPLE", 60)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 37)
    try:
        rows = corpus(random.Random(4))
        df = docs([(i, t, lang) for i, (lang, t) in enumerate(rows)]).repartition(3)
        got = collocations.mine(df, least=3, top=top)
        assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
        assert {t for c, t in got.dtypes if c not in ("lang", "phrase")} == {"bigint"}
        assert rows_of(got) == brute_collocations(rows, 3, top)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_collocations_of_large_counts_and_empty_tables(spark, docs):
    assert collocations.mine(docs([])).count() == 0
    assert collocations.mine(docs([(1, None, "en"), (2, "one two", "en")])).count() == 0
    rows = [("en", "one two " * 400)] * 3
    assert rows_of(collocations.mine(docs([(i, t, lang) for i, (lang, t) in enumerate(rows)]))) == brute_collocations(rows, 30, 2000)
    big = spark.range(1).select(F.lit(9_000_000_000_000_000).alias("a")).selectExpr("cast(a as decimal(20, 0)) * 2000000 div (a + a) as s").first()
    assert big.s == 1_000_000


def test_stack_carries_prefixes_over_batches():
    import numpy as np
    import pyarrow as pa

    keys = sorted(["en\nthe ", "en\nthe of ", "en\nthe of a ", "en\nthen ", "en\nof the ", "de\nof ", "de\n" + "x" * 40 + " y ", "de\n" + "x" * 40 + " "], reverse=True)
    whole = Counter()
    for size in (1, 2, 3, 8):
        stack, got = collocations.PrefixStack(4, 1), Counter()
        for i in range(0, len(keys), size):
            part = keys[i : i + size]
            for names, n in stack.push(pa.array(part), np.full(len(part), 2), np.zeros(len(part), int)):
                got.update(dict(zip(names, n, strict=True)))
        got.update(dict(zip(*stack.close(), strict=True)))
        whole = whole or got
        assert got == whole
    assert whole["en\nthe "] == 6 and whole["en\n"] == 10 and whole["de\n" + "x" * 40 + " "] == 4
