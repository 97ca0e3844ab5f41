"""Pairs of groups are dealt to tasks by their number, which the size of the members does not tell."""

from lodestrata.operators import graph as g
from pyspark.sql import functions as F


def test_small_groups_are_dealt_by_their_pairs(spark, monkeypatch):
    monkeypatch.setattr(g, "TASK_PAIRS", 500)
    rows = spark.range(3_000).select((F.col("id") % 100).alias("g"), (F.col("id") % 7 + F.floor(F.col("id") / 100)).alias("x"))
    plain = {}
    groups = {}
    for r in rows.distinct().collect():
        groups.setdefault(r.g, []).append(r.x)
    for xs in groups.values():
        for u in xs:
            for v in xs:
                if u < v:
                    plain[u, v] = plain.get((u, v), 0) + 1
    got = g.cooccurrence(rows, "g", "x", 1)
    assert {(r.u, r.v): r.w for r in got.collect()} == plain
    made = sum(len(x) * (len(x) - 1) // 2 for x in groups.values())
    assert f"({'g'}#" in (p := got._jdf.queryExecution().toString()) and f"{made // 500 + 1}), REPARTITION_BY_NUM" in p
    assert {(r.u, r.v): r.w for r in g.cooccurrence(rows, "g", "x", 1, block=10).collect()} == plain
