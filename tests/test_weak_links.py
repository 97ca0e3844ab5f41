"""Weak links by lists of neighbours are those of a plain look at the neighbours."""

import random

from lodestrata.operators import graph as g
from pyspark.sql import functions as F


def test_weak_links_by_lists_and_groups(spark, monkeypatch):
    monkeypatch.setattr(g, "LIST_ROW", 2)  # hubs take several rows
    rng = random.Random(5)
    rows = [(i, x) for i in range(60) for x in rng.choices(range(40), k=rng.choice((1, 2, 2, 2, 3)))] + [(100 + i, x) for i in range(30) for x in (77, 50 + i)]
    groups = spark.createDataFrame(rows, "g long, x long")
    edges = g.cooccurrence(groups, "g", "x", 1)
    profile = spark.createDataFrame([(i, str(i % 3)) for i in range(90)], "node long, domain string")
    w = {(r.u, r.v): r.w for r in edges.collect()}
    near = {}
    for u, v in w:
        near.setdefault(u, set()).add(v)
        near.setdefault(v, set()).add(u)
    for most in (1, 2):
        want = sorted((u, v) for (u, v), n in w.items() if n <= most and u % 3 != v % 3 and not near[u] & near[v])
        for by in (groups, groups.withColumn("extra", F.rand(3)), None):
            assert sorted((r.u, r.v) for r in g.weak_links(edges, profile, "node", most, by).collect()) == want
        assert len(want) > 10
