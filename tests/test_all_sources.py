"""Betweenness takes every node for a source, however many there are."""

import duckdb
import pytest
from lodestrata.operators import centrality
from lodestrata.plans import registry


def tree(n):
    """Edges of a binary tree, and the pairs whose path passes each node."""
    size, edges = [1] * n, [((i - 1) // 2, i) for i in range(1, n)]
    for u, v in reversed(edges):
        size[u] += size[v]
    parts = [[n - size[i], *(size[j] for j in (2 * i + 1, 2 * i + 2) if j < n)] for i in range(n)]
    return edges, {i: ((n - 1) ** 2 - sum(x * x for x in p)) / 2 for i, p in enumerate(parts)}


@pytest.mark.parametrize("local", [12_000_000, 1_000])
def test_large_graphs_are_not_sampled(spark, monkeypatch, local):
    """5,000 nodes in two components, by shares of the sources in one place or by tasks for a component."""
    monkeypatch.setattr(centrality, "PLACE_EDGES", 100)
    monkeypatch.setattr(centrality, "LOCAL_EDGES", max(local, 4_500))
    (one, want), (two, more) = tree(4_500), tree(500)
    edges = one + [(u + 10_000, v + 10_000) for u, v in two]
    got = centrality.betweenness(spark.createDataFrame(edges, "u long, v long"), normalized=False)
    assert {r.node: r.value for r in got.collect()} == pytest.approx(want | {x + 10_000: y for x, y in more.items()})


def test_node_betweenness_counts_all_paths(spark, tmp_path):
    edges, want = tree(4_200)
    con = duckdb.connect()
    con.execute("CREATE TABLE e AS SELECT i AS l_orderkey, unnest([(i - 1) // 2, i]) AS l_partkey FROM range(1, 4200) AS r(i)")
    con.execute(f"COPY e TO '{tmp_path}/lineitem.parquet'")
    assert {r.node: r.value for r in registry.QUERIES["node_betweenness"](spark, str(tmp_path)).collect()} == pytest.approx(want)
    assert len(edges) == 4_199
