"""Louvain goes on until no node alone can raise modularity, in the registered queries too."""

from collections import Counter
from itertools import combinations

import duckdb
from lodestrata.plans import registry


def test_registered_communities_are_settled(spark, tmp_path):
    """A chain of cliques: after ten rounds of one pass some nodes would still rise."""
    edges = [(g * 10 + a, g * 10 + b) for g in range(12) for a, b in combinations(range(4 + g % 3), 2)] + [(g * 10, g * 10 + 10) for g in range(11)] + [(200 + i, 201 + i) for i in range(150)]
    con = duckdb.connect()
    con.execute("CREATE TABLE e (u BIGINT, v BIGINT)")
    con.executemany("INSERT INTO e VALUES (?, ?)", edges)
    con.execute(f"COPY (SELECT row_number() OVER () AS l_orderkey, unnest([u, v]) AS l_partkey FROM e) TO '{tmp_path}/lineitem.parquet'")
    label = {r.node: r.community for r in registry.QUERIES["communities"](spark, str(tmp_path)).collect()}
    near, two_m = {}, 2 * len(edges)
    for u, v in edges:
        near.setdefault(u, []).append(v)
        near.setdefault(v, []).append(u)
    total = Counter()
    for x, ys in near.items():
        total[label[x]] += len(ys)
    for x, ys in near.items():  # what a move would add, times the edges
        k, links, home = len(ys), Counter(label[y] for y in ys), label[x]
        stay = links[home] - k * (total[home] - k) / two_m
        assert all(n - k * total[c] / two_m <= stay + 1e-6 for c, n in links.items() if c != home)
    ranked = registry.QUERIES["concept_communities"](spark, str(tmp_path)).collect()
    assert Counter(label.values()) == {r.community: r["size"] for r in ranked}
