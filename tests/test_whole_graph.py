"""Graph queries over parts of any key, on a small table of widely spread keys, and against brute force."""

import random

import duckdb
import pytest
from lodestrata.plans import registry

from .test_oracles import TABLES, compare


@pytest.fixture(scope="module")
def spread(tmp_path_factory):
    """sf0.001 with part keys times 97, so that most are 400 or more."""
    d = tmp_path_factory.mktemp("spread")
    con = duckdb.connect()
    for t in TABLES:
        key = {"part": "p_partkey", "lineitem": "l_partkey"}.get(t)
        cols = f"* REPLACE ({key} * 97 AS {key})" if key else "*"
        con.execute(f"COPY (SELECT {cols} FROM read_parquet('/root/testdata/sf0.001/{t}.parquet')) TO '{d}/{t}.parquet'")
    assert con.execute(f"SELECT max(l_partkey) FROM read_parquet('{d}/lineitem.parquet')").fetchone()[0] > 4000
    return str(d)


@pytest.mark.parametrize("name", ["cooccurrence_edges", "node_degrees", "pagerank_10", "primary_domain", "domain_density", "supernode_graph", "top_entities_per_cluster"])
def test_all_parts_are_in_the_graph(spark, spread, name):
    assert compare(spark, name, spread) > 0


@pytest.fixture(scope="module")
def sparse(tmp_path_factory):
    """Orders of two parts each, in several components; (folder, edges, brand of each part)."""
    d, rng = tmp_path_factory.mktemp("sparse"), random.Random(11)
    pairs = sorted({tuple(sorted(rng.sample(range(380, 440), 2))) for _ in range(52)})
    brand = {p: f"B{p % 4}" for p in range(380, 440)}
    con = duckdb.connect()
    con.execute("CREATE TABLE lineitem (l_orderkey BIGINT, l_partkey BIGINT, l_discount DOUBLE)")
    con.executemany("INSERT INTO lineitem VALUES (?, ?, 0.1)", [(i, p) for i, e in enumerate(pairs) for p in e])
    con.execute("CREATE TABLE part (p_partkey BIGINT, p_brand VARCHAR)")
    con.executemany("INSERT INTO part VALUES (?, ?)", list(brand.items()))
    for t in ("lineitem", "part"):
        con.execute(f"COPY {t} TO '{d}/{t}.parquet'")
    return str(d), set(pairs), brand


def brute_distances(edges):
    """(distance, number of shortest paths) of all pairs."""
    near = {}
    for u, v in edges:
        near.setdefault(u, set()).add(v)
        near.setdefault(v, set()).add(u)
    out = {}
    for s in near:
        level, dist, n = {s: 1}, {s: 0}, {s: 1}
        while level:
            nxt = {}
            for x in level:
                for y in near[x]:
                    if y not in dist:
                        nxt[y] = nxt.get(y, 0) + n[x]
            dist |= dict.fromkeys(nxt, dist[next(iter(level))] + 1)
            n |= nxt
            level = nxt
        out |= {(s, x): (dist[x], n[x]) for x in dist}
    return out


def test_structure_over_all_edges(spark, sparse):
    d, e, brand = sparse
    run = lambda name: [tuple(r) for r in registry.QUERIES[name](spark, d).collect()]
    dist = brute_distances(e)
    nodes = {x for x, _ in dist}
    comp = {x: min(y for y in nodes if (x, y) in dist) for x in nodes}
    assert len(set(comp.values())) > 1 and dict(run("connected_components")) == comp
    cuts = {(u, v) for u, v in e if (u, v) not in brute_distances(e - {(u, v)})}
    assert 0 < len(cuts) < len(e) and set(run("bridge_edges")) == cuts
    want = {x: sum(dist[a, x][1] * dist[x, b][1] / dist[a, b][1] for a in nodes for b in nodes if a < b and x not in (a, b) and comp[a] == comp[b] == comp[x] and dist[a, x][0] + dist[x, b][0] == dist[a, b][0]) for x in nodes}
    assert dict(run("node_betweenness")) == pytest.approx(want, abs=1e-5)


def test_gaps_count_all_edges(spark, sparse):
    d, e, brand = sparse
    want, names = {}, sorted(set(brand.values()))
    for i, a in enumerate(names):
        for b in names[i + 1 :]:
            n = len({x for u, v in e for x in (u, v) if {brand[u], brand[v]} == {a, b}})
            if n < 3:
                want[a, b] = n
    assert {(r.a, r.b): r.n for r in registry.QUERIES["cluster_gaps"](spark, d).collect()} == want
