"""Operators that SQL cannot express, against brute force."""

import random

import pytest
from lodestrata.functions import dates, text
from lodestrata.operators import centrality, chunking, graph, retrieval
from lodestrata.operators import relational as rel
from pyspark.sql import functions as F


def test_chunking_keeps_every_word_and_budget():
    rng = random.Random(0)
    words = [f"w{i}" for i in range(50)]
    for _ in range(60):
        t = "\n".join(" ".join(rng.choice(words) + rng.choice(["", "", "."]) for _ in range(rng.randint(0, 120))) for _ in range(rng.randint(0, 9)))
        for policy in ("boundary", "idea", "hard"):
            got = chunking.chunk_text(t, "\n", 40, policy)
            assert " ".join(got).split() == t.split()
            assert all(chunking.count_tokens(c) <= 60 for c in got)
    assert chunking.chunk_text("", "\n") == [] and chunking.hard_split("x" * 500, 3) == ["x" * 500]
    assert chunking.pack(["a b", "c d", "e f"], 4, 6, " ", overlap=2) == ["a b c d", "c d e f"]


def test_bridges_and_communities(spark):
    rng = random.Random(1)
    e = {tuple(sorted(rng.sample(range(30), 2))) for _ in range(34)}
    df = spark.createDataFrame([(a, b, 1) for a, b in e], "u long, v long, w long")

    def parts(edges):
        root = list(range(30))

        def find(i):
            while root[i] != i:
                i = root[i]
            return i

        for a, b in edges:
            root[max(find(a), find(b))] = min(find(a), find(b))
        return [find(i) for i in range(30)]

    base = parts(e)
    comp = graph.components(df)
    assert all(base[r.node] == r.component for r in comp.collect())
    want = {x for x in e if len(set(parts(e - {x}))) > len(set(base))}
    assert {(r.u, r.v) for r in centrality.bridges(df).collect()} == want
    labels = {r.node: r.community for r in graph.label_propagation(df, 4).collect()}
    assert labels == {r.node: r.community for r in graph.label_propagation(df, 4).collect()} and all(base[n] == base[c] for n, c in labels.items())


def test_mmr_and_packing(spark):
    pool = spark.createDataFrame([(1, i, f"d{i // 2}", 1 - i / 10, ["a", "b"] if i < 2 else [f"t{i}"]) for i in range(6)], "q long, item long, doc string, score double, tokens array<string>")
    seats = {r.seat: r.item for r in retrieval.mmr(pool, "q", "item", "doc", "score", "tokens", 3).collect()}
    assert seats[1] == 0 and seats[2] != 1 and len(seats) == 3
    pool = spark.createDataFrame([(1, 1, 1, 90, 10), (1, 2, 2, 50, 5), (1, 3, 3, 6, 6), (1, 4, 4, 1, 1)], "q long, item long, rank long, full long, summary long")
    got = [(r.item, r.form, r.used) for r in retrieval.pack_budget(pool, "q", "item", "rank", "full", "summary", 100).orderBy("used").collect()]
    assert got == [(1, "full", 90), (2, "summary", 95), (4, "full", 96)]


@pytest.mark.parametrize(("raw", "want"), [("2020-02-30", None), ("2020-02-28T10:00", ("2020-02-28", "day")), ("3 March 1999", ("1999-03-03", "day")), ("March 3, 1999", ("1999-03-03", "day")), ("March 1999", ("1999-03", "month")), ("1999-13", None), ("1999-12", ("1999-12", "month")), ("1999", ("1999", "year")), ("99", None), ("", None)])
def test_dates(spark, raw, want):
    r = spark.createDataFrame([(raw,)], "t string").select(dates.parse_date("t").alias("d")).first().d
    assert (tuple(r) if r else None) == want


def test_text_functions(spark):
    one = lambda c, **k: spark.createDataFrame([tuple(k.values())], ", ".join(f"{n} string" for n in k)).select(c).first()[0]
    assert one(text.is_separator_only("t"), t="| --- | :-: |") and one(text.is_separator_only("t"), t=None) and not one(text.is_separator_only("t"), t="| a |")
    assert one(F.array_join(text.shingles(text.content_words("t"), 2), ","), t="Alpha beta the gamma 'delta' alpha beta") == "alpha beta,beta gamma,gamma delta,delta alpha"
    assert one(text.heading_kind(F.array("t")), t="References to nature") == "body" and one(text.heading_kind(F.array("t")), t="  REFERENCES ") == "bibliography" and one(text.heading_kind(F.array("t")), t="About the authors") == "front_matter"
    assert one(F.array_join(text.ngram_terms(text.words("t")), "|"), t="graph of the ranked trees") == "ranked trees|graph|ranked|trees"
    assert one(text.fnv1a31("t"), t="a") == 0xE40C292C & 0x7FFFFFFF and one(text.fnv1a31("t"), t="") == 0x811C9DC5 & 0x7FFFFFFF
    assert one(text.inject_headers("t"), t="1. Start here\n1.2 Then\n3.5 percent\nx") == "# 1. Start here\n## 1.2 Then\n3.5 percent\nx"
    assert one(text.name_in_text(F.lit("Data Base"), F.col("t")), t="the data-base, now") and not one(text.name_in_text(F.lit("art"), F.col("t")), t="start")
    assert one(text.is_noisy("t"), t=None) is False and one(text.is_noisy("t"), t="toc") and one(text.skips_extraction("t"), t="code") and one(text.needs_summary("t"), t=None)
    assert one(text.is_report_name("t"), t="a/b/X_RECEIPT_1.md") and not one(text.is_report_name("t"), t="novel.md")


def test_dip_boundaries(spark):
    rng = random.Random(4)
    rows = [(k, i, rng.choice([1.0, 5.0, 5.0, 6.0])) for k in range(3) for i in range(40)]
    want = []
    for k in range(3):
        v = [s for q, _, s in rows if q == k]
        m = sum(v) / len(v)
        t, last = m - (sum((x - m) ** 2 for x in v) / len(v)) ** 0.5, 0
        for i, x in enumerate(v):
            if x < t and i - last >= 3:
                want.append((k, i))
                last = i
    got = rel.dip_boundaries(spark.createDataFrame(rows, "k long, i long, s double"), "k", "i", "s")
    assert sorted((r.k, r.i) for r in got.collect()) == want


def test_sufficiency_repair(spark):
    pool = spark.createDataFrame([(1, 1, 0.9, ["a"], 1), (1, 2, 0.8, ["a"], 2), (1, 3, 0.5, ["b", "c"], None), (1, 4, 0.7, ["b"], None), (2, 5, 0.9, ["x"], 1)], "q long, item long, score double, atoms array<string>, seat long")
    need = spark.createDataFrame([(1, ["a", "b", "c"])], "q long, needed array<string>")
    got = sorted(tuple(r) for r in retrieval.sufficiency_repair(pool, need, "q", "item", "score", "atoms", "seat").collect())
    assert got == [(1, 1, 1, 1.0), (1, 3, 2, 1.0), (2, 5, 1, 1.0)]
