"""Pairs without an edge are told off from lists; pairs themselves are not shuffled."""

import random
from itertools import combinations

import pytest
from lodestrata.operators import graph
from lodestrata.plans import registry

from .test_oracles import compare


@pytest.mark.parametrize("block", [1_000, 3])
def test_missing_edges_of_lists(spark, monkeypatch, block):
    monkeypatch.setattr(graph, "NODE_BLOCK", block)
    rng = random.Random(4)
    edges = {tuple(sorted(rng.sample(range(40), 2))) for _ in range(300)}
    nodes = [x for x in range(40) if x % 3] + [4]  # a node that is there twice
    got = graph.missing_edges(spark.createDataFrame([(x,) for x in nodes], "node long"), spark.createDataFrame(sorted(edges), "u long, v long"))
    want = [p for p in combinations(sorted(nodes), 2) if p not in edges and p[0] < p[1]]
    assert sorted(map(tuple, got.collect())) == sorted(want)
    assert "LeftAnti" not in got._jdf.queryExecution().executedPlan().toString()


def test_missing_edges_query(spark):
    assert compare(spark, "missing_edges", "/root/testdata/sf0.001") > 0
    plan = registry.QUERIES["missing_edges"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "LeftAnti" not in plan
