"""Louvain, betweenness, bridges and co-occurrence blocks against brute force."""

import random
from itertools import combinations, product

import pytest
from lodestrata.operators import centrality, communities, graph, insight
from lodestrata.operators import relational as rel
from lodestrata.plans import registry
from pyspark.sql import functions as F


def frame(spark, edges):
    return spark.createDataFrame([(*e, 1)[:3] for e in edges], "u long, v long, w long")


def plain_modularity(edges, label, resolution=1.0):
    m = sum(w for *_, w in edges)
    k, inside = {}, 0
    for u, v, w in edges:
        for x in (u, v):
            k[label[x]] = k.get(label[x], 0) + w
        inside += w * (label[u] == label[v])
    return inside / m - resolution * sum((t / (2 * m)) ** 2 for t in k.values())


def best_partition(edges, resolution):
    nodes = sorted({x for u, v, _ in edges for x in (u, v)})
    best = -1.0
    for deal in product(range(len(nodes)), repeat=len(nodes) - 1):
        label = [0, *deal]
        if all(label[i] <= max(label[:i]) + 1 for i in range(1, len(label))):
            best = max(best, plain_modularity(edges, dict(zip(nodes, label, strict=True)), resolution))
    return best


@pytest.mark.parametrize("seed,resolution", [(1, 1.0), (3, 0.5), (4, 1.7)])
def test_louvain_is_near_the_best_partition_of_small_graphs(spark, seed, resolution):
    rng = random.Random(seed)
    pairs = rng.sample(list(combinations(range(10, 17), 2)), 10)
    edges = [(u, v, rng.randint(1, 4)) for u, v in pairs]
    got, trace = communities.louvain(frame(spark, edges), resolution)
    label = {r.node: r.community for r in got.collect()}
    assert set(label) == {x for u, v, _ in edges for x in (u, v)} and all(label[c] == c and c <= n for n, c in label.items())
    q = plain_modularity(edges, label, resolution)
    assert trace == sorted(trace) and trace[-1] == pytest.approx(q)
    assert q >= best_partition(edges, resolution) - 0.02
    for n in label:  # no node alone can raise it
        assert all(plain_modularity(edges, label | {n: c}, resolution) <= q + 1e-6 for c in set(label.values()))


def test_louvain_finds_planted_groups_and_ranks_them(spark):
    rng = random.Random(6)
    edges = [(g * 20 + a, g * 20 + b, 1) for g in range(5) for a, b in combinations(range(10 + g), 2) if rng.random() < 0.6] + [(g * 20, g * 20 + 20, 1) for g in range(4)]
    df = frame(spark, edges)
    got, trace = communities.louvain(df)
    label = {r.node: r.community for r in got.collect()}
    assert {n: c // 20 for n, c in label.items()} == {n: n // 20 for n in label} and trace == sorted(trace)
    assert communities.modularity(df, got) == pytest.approx(plain_modularity(edges, label))
    rank = graph.pagerank(df, 10)
    pr = {r.node: r["rank"] for r in rank.collect()}
    rows = communities.ranked_communities(df, got, rank, 3).orderBy("concept_id").collect()
    sums = {c: round(sum(pr[n] for n in label if label[n] == c), 6) for c in set(label.values())}
    assert [r.community for r in rows] == sorted(sums, key=lambda c: (-sums[c], -sum(x == c for x in label.values()), c))
    for r in rows:
        own = [n for n in label if label[n] == r.community]
        assert r.size == len(own) and r.top == sorted(own, key=lambda n: (-pr[n], n))[:3]
        assert r.bridges == sum((label[u] == r.community) != (label[v] == r.community) for u, v, _ in edges)


def test_louvain_of_many_blocks_moves_no_edges(spark, monkeypatch):
    """Blocks of ten edges tell what one block tells; a round deals labels only."""
    rng = random.Random(5)
    df = frame(spark, [(u * 10, v * 10, rng.randint(1, 3)) for u, v in some_graph(rng, 30, 90)]).cache()
    want, trace = communities.louvain(df, max_passes=1)
    monkeypatch.setattr(communities, "BLOCK_EDGES", 10)
    got, again = communities.louvain(df, max_passes=1)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and again == pytest.approx(trace)
    parts = communities.blocks(graph.both_ways(df))
    k = communities._degrees(parts)
    assert parts.lists.count() > 5 and {r.node: r.k for r in k.collect()} == {r.node: r.strength for r in graph.degrees(df).collect()}
    plan = communities._best(parts, k.withColumn("c", F.col("node")), 2.0, 1.0)._jdf.queryExecution().executedPlan().toString()
    assert "names#" in plan and not any("Exchange" in line and "names" in line for line in plan.splitlines())


def test_louvain_of_no_edges(spark):
    assert communities.louvain(frame(spark, []))[0].count() == 0


def brandes(edges):
    near = {}
    for u, v in edges:
        near.setdefault(u, []).append(v)
        near.setdefault(v, []).append(u)
    total = dict.fromkeys(near, 0.0)
    for s in near:
        dist, paths, order = {s: 0}, {s: 1.0}, [s]
        for x in order:
            for y in near[x]:
                if y not in dist:
                    dist[y], paths[y] = dist[x] + 1, 0.0
                    order.append(y)
                if dist[y] == dist[x] + 1:
                    paths[y] += paths[x]
        need = dict.fromkeys(order, 0.0)
        for y in reversed(order):
            for x in near[y]:
                if dist[x] == dist[y] - 1:
                    need[x] += paths[x] / paths[y] * (1 + need[y])
            if y != s:
                total[y] += need[y]
    return total


def some_graph(rng, n, m):
    return sorted({tuple(sorted(rng.sample(range(n), 2))) for _ in range(m)})


@pytest.mark.parametrize("block,state", [(60_000, 48_000_000), (40, 6_000)])
def test_betweenness(spark, monkeypatch, block, state):
    monkeypatch.setattr(centrality, "BLOCK_EDGES", block)
    monkeypatch.setattr(centrality, "STATE_BYTES", state)
    edges = [(a * 7 - 50, b * 7 - 50) for a, b in some_graph(random.Random(7), 60, 80)]
    want = brandes(edges)
    n = len(want)
    got = {r.node: r.value for r in centrality.betweenness(frame(spark, edges)).collect()}
    assert got == pytest.approx({x: v / ((n - 1) * (n - 2)) for x, v in want.items()}, abs=1e-7)
    got = {r.node: r.value for r in centrality.betweenness(frame(spark, edges), normalized=False).collect()}
    assert got == pytest.approx({x: v / 2 for x, v in want.items()}, abs=1e-7)


@pytest.mark.parametrize("local,place", [(10**6, 10**6), (100, 30), (100, 10), (30, 10), (0, 0)])
def test_betweenness_by_components_and_rounds(spark, monkeypatch, local, place):
    """One place, components that share places, components by themselves, and rounds, alone or beside them."""
    for name, value in {"LOCAL_EDGES": local, "PLACE_EDGES": max(1, place), "STEP_EDGES": 7, "STATE_BYTES": 6_000, "BLOCK_EDGES": 40}.items():
        monkeypatch.setattr(centrality, name, value)
    rng, edges = random.Random(12), []
    for i, (n, m) in enumerate([(30, 60), (12, 20), (5, 6), (3, 2), (20, 24)]):
        edges += [(a + 1_000_003 * i, b + 1_000_003 * i) for a, b in some_graph(rng, n, m)]
    want = brandes(edges)
    walked, rounds = [], centrality._by_rounds
    monkeypatch.setattr(centrality, "_by_rounds", lambda *a: walked.append(1) or rounds(*a))
    got = {r.node: r.value for r in centrality.betweenness(frame(spark, edges), normalized=False).collect()}
    assert got == pytest.approx({x: v / 2 for x, v in want.items()}, abs=1e-7)
    assert bool(walked) == (local < 60)


def test_betweenness_copies_no_edges_for_a_batch(spark, monkeypatch):
    """Edges reach each slot once, however many batches of sources there are."""
    monkeypatch.setattr(centrality, "STATE_BYTES", 6_000)
    seen, real = [], centrality._in_one_place
    monkeypatch.setattr(centrality, "_in_one_place", lambda wire, drawn: seen.append(wire.count()) or real(wire, drawn))
    edges = [(i, i + 1) for i in range(300)]
    got = {r.node: r.value for r in centrality.betweenness(frame(spark, edges), normalized=False).collect()}
    assert got == {i: i * (300 - i) for i in range(301)} and seen[0] <= 4 * len(edges) // 300 + 4


def test_sampled_betweenness_finds_the_top(spark):
    rng = random.Random(8)
    hubs = list(range(20))
    edges = {tuple(sorted((rng.choice(hubs), x))) for x in range(20, 400) for _ in range(2)} | {(a, b) for a, b in combinations(hubs, 2) if rng.random() < 0.3}
    want = brandes(edges)
    got = {r.node: r.value for r in centrality.betweenness(frame(spark, sorted(edges)), exact_nodes=100, sources=200).collect()}
    top = lambda d: set(sorted(d, key=d.get, reverse=True)[:20])
    assert len(top(want) & top(got)) >= 18


def plain_bridges(edges):
    def parts(some):
        root = {}

        def find(i):
            while root.setdefault(i, i) != i:
                i = root[i]
            return i

        for a, b in some:
            root[find(a)] = find(b)
        return find

    return {e for e in edges if (f := parts(edges - {e}))(e[0]) != f(e[1])}


@pytest.mark.parametrize("seed", range(2))
def test_bridges_of_random_graphs(spark, seed):
    rng = random.Random(20 + seed)
    edges = set(some_graph(rng, 60, [50, 66][seed])) | {(i, i + 1) for i in range(60, 75)} | {(62, 66), (68, 74)}
    assert {tuple(r) for r in centrality.bridges(frame(spark, sorted(edges))).collect()} == plain_bridges(edges)


def test_bridges_of_long_chains_take_few_rounds(spark):
    chain = {(i, i + 1) for i in range(120)} | {(50, 60), (121, 122), (122, 123), (121, 123)}
    got = {tuple(r) for r in centrality.bridges(frame(spark, sorted(chain)), max_rounds=16).collect()}
    assert got == {(i, i + 1) for i in range(120) if not 50 <= i < 60}
    forest, parts = centrality.spanning_forest(frame(spark, sorted(chain)))
    assert forest.distinct().count() == 122 and {r.node: r.component for r in parts.collect()} == {i: 0 if i < 121 else 121 for i in range(124)}
    assert centrality.bridges(frame(spark, [])).count() == 0


@pytest.mark.parametrize("block", [3, 1_000])
def test_cooccurrence_of_large_groups(spark, block):
    rng = random.Random(9)
    rows = [(g, rng.randrange(40)) for g in range(6) for _ in range([2, 5, 30, 12, 1, 60][g])]
    df = spark.createDataFrame(rows, "g long, x long")
    want = {}
    for g in range(6):
        for p in combinations(sorted({x for h, x in rows if h == g}), 2):
            want[p] = want.get(p, 0) + 1
    got = graph.cooccurrence(df, "g", "x", 2, block)
    assert {(r.u, r.v): r.w for r in got.collect()} == {p: n for p, n in want.items() if n >= 2}


def test_latent_topics_use_betweenness(spark):
    edges = [(1, 2, 1), (2, 3, 1), (3, 4, 1), (2, 4, 1)]
    df = frame(spark, edges)
    nodes = spark.createDataFrame([(i, 9, 3, 0.1) for i in range(1, 5)], "node long, mentions long, docs long, rank double")
    x = nodes.join(graph.degrees(df).select("node", "degree"), "node").join(centrality.betweenness(df).withColumnRenamed("value", "betweenness"), "node")
    import math

    got = {r.node: r.latent for r in insight.latent_topics(x, 9).collect()}
    btw, deg = {1: 0, 2: 2 / 3, 3: 0, 4: 0}, {1: 1, 2: 3, 3: 2, 4: 2}
    assert got == {i: round((math.log1p(9) + 0.35 * 3 + 5) / (1 + 0.22 * deg[i] + 10 * btw[i]), 4) for i in btw}


def test_numbered(spark):
    df = spark.range(500).select(F.pmod(F.xxhash64("id"), F.lit(50)).alias("a"), "id").repartition(7)
    got = [(r.a, r.id) for r in rel.numbered(df, [F.desc("a"), "id"], "n").orderBy("n").collect()]
    assert got == sorted(got, key=lambda x: (-x[0], x[1])) and [r.n for r in rel.numbered(df, ["id"], "n").orderBy("n").collect()] == list(range(1, 501))


def test_graph_queries_have_rows(spark):
    assert registry.QUERIES["latent_entities"](spark, "/root/testdata/sf0.001").count() == 40
    assert registry.QUERIES["repeated_bridges"](spark, "/root/testdata/sf0.01").count() > 0
