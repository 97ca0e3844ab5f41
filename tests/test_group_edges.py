"""What is told of edges from the groups that make them, and walks whose tasks do not grow."""

import random

import pytest
from lodestrata.operators import graph as g
from lodestrata.plans import registry, walks

from .test_oracles import compare


@pytest.mark.parametrize("seed,task", [(1, 1_000_000), (2, 7)])
def test_frontier_and_gaps_by_groups(spark, monkeypatch, seed, task):
    monkeypatch.setattr(g, "TASK_ROWS", task)
    rng = random.Random(seed)
    rows = [(i, rng.randrange(90)) for i in range(45) for _ in range(rng.choice([1, 2, 2, 3, 9]))] + [(None, 1), (None, 2), (3, None)]
    groups = spark.createDataFrame(rows, "g long, x long").cache()
    profile = spark.createDataFrame([(x, f"c{x % 40}") for x in range(88)], "node long, domain string").cache()
    edges = g.cooccurrence(groups, "g", "x", 1)
    clusters = profile.withColumnRenamed("domain", "c")
    for fn in (lambda **k: g.frontier(profile=profile, node="node", **k), lambda **k: g.cluster_gaps(cluster=clusters, **k), lambda **k: g.cluster_gaps(cluster=clusters, most=5, **k)):
        want, got = sorted(map(tuple, fn(edges=edges).collect())), sorted(map(tuple, fn(edges=None, groups=groups).collect()))
        assert got == want and len(want) > 0


@pytest.mark.parametrize("name", ["frontier_nodes", "cluster_gaps"])
def test_no_pairs_are_made(spark, monkeypatch, name):
    monkeypatch.setattr(g, "cooccurrence", lambda *a, **k: pytest.fail("pairs"))
    registry.QUERIES[name](spark, "/root/testdata/sf0.001").count()


@pytest.mark.parametrize("name", ["relation_walk", "call_walk"])
def test_walks_are_dealt_by_their_rows(spark, monkeypatch, name):
    monkeypatch.setattr(walks, "TASK_ROWS", 500)
    plan = registry.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("REPARTITION_BY_NUM") >= 3 and compare(spark, name, "/root/testdata/sf0.001") == 40
