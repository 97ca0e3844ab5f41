"""Selection, packets, routes, chunks and services that SQL does not express, against plain versions or stated results."""

import random

import pytest
from lodestrata.operators import chunking as ch
from lodestrata.operators import facets as fc
from lodestrata.operators import insight as ins
from lodestrata.operators import knowledge_rows as kr
from lodestrata.operators import lexicon as lx
from lodestrata.operators import ranking as rk
from lodestrata.operators import retrieval as ret
from lodestrata.operators import services as sv
from lodestrata.operators import walks as wk
from pyspark.sql import functions as F


def jac(a, b):
    return len(a & b) / len(a | b) if a and b else 0.0


def plain_mmr(rows, k, tier, need, corpora):
    """The objective of the policy table, candidate by candidate."""
    p = rk.mmr_policy(tier, need, k, corpora)
    rows = sorted(rows, key=lambda r: (-r["score"], r["item"]))
    top, hi, n = rows[0]["score"], max(r["score"] for r in rows), len(rows)
    for i, r in enumerate(rows):
        r["rel"] = 0.9 * r["score"] / hi + 0.1 * (1 - i / max(n - 1, 1))
    seats = []

    def ok_floor(i, r):
        floor = p["floor"]
        if r["grounded"] and ((r["graph"] and r["predicates"]) or r["anchor"]):
            floor = min(floor, 0.4)
        return i == 0 or r["score"] / top >= floor

    def value(i, r, relaxed):
        docs = [s["doc"] for s in seats]
        same_doc, same_parent, enough = docs.count(r["doc"]), sum(s["parent"] == r["parent"] for s in seats), len(seats) >= min(k, 3)
        if not ok_floor(i, r) and not (relaxed and tier != "vector" and not enough and r["score"] / top >= 0.25 and (r["grounded"] or not (r["graph"] or r["anchor"]))):
            return None
        weak = tier != "vector" and not r["graph"] and r["score"] < max(0.1, top / 4)
        over = same_doc >= p["hard"] or same_parent >= 2
        preds = sum(sum(q in s["predicates"] for s in seats) for q in r["predicates"]) if tier == "graph" else 0
        if relaxed and enough and (weak or over):
            return None
        if not relaxed and (weak or over or any(jac(r["tokens"], s["tokens"]) >= 0.88 for s in seats) or (tier == "graph" and preds >= 3)):
            return None
        sim = 0.0
        for s in seats:
            w = {"hybrid": (0.68, 0), "graph": (0.62, 0.58)}.get(tier, (0, 0))
            sim = max(sim, 0.92 * (s["parent"] == r["parent"]), 0.24 * (s["doc"] == r["doc"]), jac(r["tokens"], s["tokens"]), w[0] * jac(r["atoms"], s["atoms"]), w[1] * jac(r["predicates"], s["predicates"]))
        seen = set().union(*(s["atoms"] for s in seats))
        v = p["lam"] * r["rel"] - (1 - p["lam"]) * sim + min(0.14, 0.035 * len(r["atoms"] - seen)) + min(0.08, 0.025 * (len(r["retrievers"]) - 1)) + 0.32 * r["anchor"]
        v += (0.10 if len(set(docs)) < p["target_docs"] else 0.04) * (same_doc == 0)
        v += (0.08 + 0.03 * bool(r["predicates"])) * (tier == "graph" and r["graph"])
        return v - 0.08 * (same_doc > 0 and len(set(docs)) < p["min_docs"]) - 0.14 * max(0, same_doc - p["soft"] + 1) - 0.1 * same_parent - 0.04 * preds

    while len(seats) < min(k, n):
        for relaxed in (False, True):
            scored = [(v, -i) for i, r in enumerate(rows) if r not in seats and (v := value(i, r, relaxed)) is not None]
            if scored:
                break
        if not scored:
            break
        seats.append(rows[-max(scored)[1]])
    if need == "specific" and tier != "vector":
        seats = [r for r in seats if r["score"] >= max(0.1, top / 2) or ok_floor(rows.index(r), r)]
    return [r["item"] for r in seats]


@pytest.mark.parametrize(("tier", "need"), [("vector", "balanced"), ("hybrid", "specific"), ("hybrid", "broad"), ("graph", "broad"), ("graph", "balanced")])
def test_diversity_is_the_policy(spark, tier, need):
    rng, pools, rows = random.Random(hash((tier, need)) % 1000), {}, []
    for q in range(12):
        pools[q] = []
        for i in range(rng.randint(1, 16)):
            r = {"item": i, "score": round(rng.random(), 3), "doc": f"d{rng.randint(0, 4)}", "parent": rng.randint(0, 7), "tokens": {rng.choice("abcdefgh") for _ in range(rng.randint(1, 6))}, "atoms": {rng.choice("xyz") for _ in range(2)}, "predicates": {"uses"} if rng.random() < 0.4 else set(), "retrievers": set("pqr"[: rng.randint(1, 3)]), "graph": rng.random() < 0.3, "anchor": rng.random() < 0.15, "grounded": rng.random() < 0.5}
            pools[q].append(r)
            rows.append((q, *[sorted(v) if isinstance(v, set) else v for v in r.values()]))
    schema = "q int, item int, score double, doc string, parent int, tokens array<string>, atoms array<string>, predicates array<string>, retrievers array<string>, graph boolean, anchor boolean, grounded boolean"
    got = {}
    for r in rk.diversify(spark.createDataFrame(rows, schema), "q", "item", "score", 6, tier, need).orderBy("seat").collect():
        got.setdefault(r.q, []).append(r.item)
    want = {q: plain_mmr(p, 6, tier, need, 1) for q, p in pools.items()}
    assert got == {q: v for q, v in want.items() if v}


def test_reserved_lanes_and_cliff(spark):
    x = spark.createDataFrame([(1, i, s, lanes) for i, (s, lanes) in enumerate([(0.9, ["a"]), (0.8, []), (0.7, ["a"]), (0.6, ["b"]), (0.5, ["c"]), (0.1, ["d"])])], "q int, item int, score double, lanes array<string>")
    first = spark.createDataFrame([(1, 0, 1), (1, 1, 2), (1, 2, 3)], "q int, item int, seat long")
    run = lambda need, k: {r.seat: r.item for r in rk.reserve_lanes(x, first, "q", "item", "score", "lanes", need, k).collect()}
    assert run(["a", "b"], 4) == {1: 0, 2: 1, 3: 2, 4: 3}
    assert run(["b", "c"], 3) == {1: 0, 2: 4, 3: 3} and run(["d"], 3) == {1: 0, 2: 1, 3: 2}
    y = spark.createDataFrame([(1, i, s, c) for i, (s, c) in enumerate([(0.9, 5), (0.88, 9), (0.87, 4), (0.5, 1), (0.1, 1)])], "q int, item int, score double, cost int")
    assert [r.item for r in rk.first_cliff(y, "q", "score", "item", "cost", 0.2, 0.6, 0.2, 10).orderBy("item").collect()] == [0, 2]


def test_packet_ladder(spark):
    rows = [(1, 1, 1, "anchor", 50, 10, None, 0.9), (1, 2, 2, "anchor", 40, 10, None, 0.1), (1, 3, 3, "parent", 30, 8, None, 0.5), (1, 4, 4, "parent", 60, 12, None, 0.4), (1, 5, 5, "orphan", 5, None, 3, 0.3), (1, 6, 6, "orphan", 6, None, 99, 0.2), (1, 7, 7, "entity", 3, None, None, 0.1), (1, 8, 8, "note", 500, None, None, 0.1)]
    got = rk.pack_packet(spark.createDataFrame(rows, "q int, item int, rank int, kind string, full int, summary int, up int, score double"), "q", "item", "rank", "kind", "full", "summary", "up", "score", 100, spill=0.3).collect()
    assert [(r.item, r.form) for r in got] == [(1, "full"), (3, "full"), (4, "summary"), (6, "full")] and {r.used for r in got} == {98}


def test_structured_and_page_blocks(spark):
    items = "Intro\n" + "\n".join(f"- item {i} " + "w " * 10 for i in range(8))
    lines = "\n".join(f"speaker {i} says something" for i in range(30))
    df = spark.createDataFrame([(1, f"{items}\n\nshort one.\n\n{lines}"), (2, None), (3, "")], "id int, text string")
    got = ch.structured_pieces(df, "id", "text", 30, 40).orderBy("id", "i").collect()
    kinds = [r.kind for r in got]
    assert set(kinds) == {"list", "lines", "prose"} and {r.id for r in got} == {1} and [r.i for r in got] == list(range(len(got)))
    assert all(r.piece.startswith(("- item", "Intro")) for r in got if r.kind == "list") and all(r.n_tokens <= 40 for r in got)
    assert sum(r.n_tokens for r in got) == len(f"{items} short one. {lines}".split())
    pages = spark.createDataFrame([(1, p, "w " * n) for p, n in enumerate([10, 15, 0, 20, 100, 5], 1)], "d int, p long, t string")
    got = [(r.label, r.n_tokens) for r in ch.page_blocks(pages, "d", "p", "t", 30, 10, 50).orderBy("block").collect()]
    assert got[:2] == [("pages_1-2", 25), ("page_4", 20)] and got[-1] == ("page_6", 5) and sum(n for _, n in got) == 150


def test_services(spark, tmp_path):
    now = [0.0]
    c = sv.ResultCache(2, 10, lambda: now[0])
    made = []
    get = lambda k: c.get(k, lambda: made.append(k) or k)
    for k in ("a", "b", "a", "c", "a", "b"):
        get(k)
    assert made == ["a", "b", "c", "b"]
    now[0] = 11
    get("a")
    assert made[-1] == "a"
    old = spark.createDataFrame([("x", "1", 3), ("y", "1", 5), ("gone", "1", 1)], "k string, signature string, epoch long")
    got = sv.epochs(spark.createDataFrame([("x", "1"), ("y", "2"), ("new", "9")], "k string, signature string"), old, "k")
    assert {r.k: r.epoch for r in got.collect()} == {"x": 3, "y": 6, "new": 1}
    sv.split_by_corpus(spark.range(40).select("id", (F.col("id") % 3).alias("corpus")), "corpus", str(tmp_path / "p"))
    assert spark.read.parquet(str(tmp_path / "p/corpus=1")).count() == 13 and spark.read.parquet(str(tmp_path / "p")).count() == 40


def test_facts_lanes_and_models(spark):
    text = "Press is deprecated. Mill is a heavy tool. If the belt slips, Mill must stop at once. Nobody must run.\nTags: metal, old ."
    df = spark.createDataFrame([(1, text, ["Press", "Mill"]), (2, None, ["Mill"]), (3, "It is a tool", None)], "id int, text string, names array<string>")
    got = {(r.subject, r.kind, r.value, r.condition) for r in kr.qualitative_facts(df, "id", "text", "names").collect()}
    assert got == {("Press", "status", "deprecated", ""), ("Mill", "category", "heavy tool", ""), ("Mill", "rule_action", "stop at once", "the belt slips"), ("Mill", "rule_condition", "the belt slips", ""), ("Press", "tag", "metal", ""), ("Press", "tag", "old", "")}
    e = fc.embed(spark.createDataFrame([(1, "a b"), (2, "a b"), (3, None), (4, "")], "id int, text string"), "text").collect()
    v = {r.id: r.embedding for r in e}
    assert v[1] == v[2] and len(v[1]) == 64 and v[3] is None and set(v[4]) == {0.0}


def test_small_graphs(spark):
    edges = spark.createDataFrame([(1, 2, 1), (2, 3, 1), (3, 4, 1)], "u long, v long, w long")
    brand = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b"), (4, "b")], "node long, c string")
    mid = spark.createDataFrame([(1, 0.0), (2, 2.0), (3, 2.0), (4, 0.0)], "node long, value double")
    assert [(r.node, r.clusters, r.degree) for r in ins.theme_bridges(edges, mid, brand, 5).collect()] == [(2, "a,b", 2), (3, "a,b", 2)]
    got = ins.fragile_bridges(edges.select("u", "v"), brand.withColumnRenamed("c", "domain"), "node").collect()
    assert [(r.u, r.v) for r in got] == [(2, 3)]
    m = spark.createDataFrame([(10, 1, 0.5), (10, 2, None), (11, 3, 0.4), (12, 9, 1.0)], "chunk long, entity long, conf double")
    rel = spark.createDataFrame([(1, 3, "uses", 0.8, "strong", "", 10), (2, 3, "related_to", 0.6, None, "", 10), (2, 3, "related_to", 0.6, None, "said", 10), (3, 3, "uses", 1.0, "strong", "", 11)], "subject long, object long, predicate string, confidence double, strength string, evidence string, chunk long")
    out = wk.relation_walk(m, wk.usable(rel), spark.createDataFrame([(10,)], "chunk long"), 5).collect()
    assert [(r.chunk, r.score, r.via) for r in out] == [(11, round(0.4 * (0.5 * 0.8 + 0.5 * 0.3), 6), 1)]


def test_lexicon_keeps_separated_names_apart(spark):
    names = spark.createDataFrame([("Machine Learning", 5, 0.9), ("ML", 3, 0.5), ("machine-learning", 2, 0.7), ("Deep Learning", 4, 0.8), ("solar panel one two page 12", 1, 0.5), ("solar panel one two page", 6, 0.5)], "name string, support int, confidence double")
    links = spark.createDataFrame([("machine learning", "ml", "ML"), ("machine learning", "deep learning", "x"), ("deep learning", "machine learning", "x")], "source string, target string, surface string")
    none, definitions = spark.createDataFrame([], "a string, b string"), spark.createDataFrame([("ml", "learns", 1.0)], "name string, text string, score double")
    got = {r.canonical: (r.aliases, r.support, r.definitions) for r in lx.materialize(names, links, none, definitions).collect()}
    assert got == {"Machine Learning": ("ML|machine-learning", 10, 1), "Deep Learning": ("", 4, 0), "solar panel one two page": ("solar panel one two page 12", 7, 0)}
    apart = lx.materialize(names, links, spark.createDataFrame([("ml", "machine learning")], "a string, b string"), definitions)
    assert {r.canonical for r in apart.collect()} >= {"ML", "Machine Learning"}


def test_blocks_of_queries_give_what_one_gives(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"w{i % 7} w{i % 5} x") for i in range(60)] + [(99, None)], "d int, t string")
    asks = spark.createDataFrame([(i, f"w{i % 7} x") for i in range(20)], "q int, t string")
    run = lambda: sorted(map(tuple, ret.tfidf_search(docs, asks, "d", "q", F.split("t", " "), F.split("t", " "), 4).collect()))
    vec = spark.createDataFrame([(i, [float(i % 5), 1.0, float(i % 3)]) for i in range(40)] + [(77, None), (78, [1.0])], "v int, e array<double>")
    near = lambda: sorted(map(tuple, ret.knn(vec, vec.select(F.col("v").alias("q"), F.col("e").alias("a")), "v", "q", "e", "a", 3).collect()))
    whole = run(), near()
    monkeypatch.setattr(ret, "MOST_BROADCAST", 9)
    monkeypatch.setattr(ret, "SCORES", 16)
    assert (run(), near()) == whole and len(whole[1]) == 120


def test_short_passages_and_duplicate_rows(spark, tmp_path):
    from lodestrata.operators import audit
    from lodestrata.plans import registry

    spark.createDataFrame([(1, "cat"), (2, "two words"), (3, "one two three"), (4, ""), (5, None)], "item_id int, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame([(1, "a concatenation"), (2, "say two  words now"), (3, "x one two threes"), (4, None)], "doc_id int, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {(r.item_id, r.doc_id) for r in registry.QUERIES["contamination"](spark, str(tmp_path)).collect()}
    assert got == {(1, 1), (2, 2), (3, 3)}
    sig = lambda rows: audit.change_signature(spark.createDataFrame(rows, "g int, k int, v int"), "k", "v", ["g"], 1).first().signature
    assert len({sig([(1, 1, 1), (1, 1, 1)]), sig([(1, 2, 9), (1, 2, 9)]), sig([(1, 1, 1)]), sig([(1, 1, None), (1, 1, 1)])}) == 4
