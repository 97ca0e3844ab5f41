"""Sign-bit search goes over rows in slices: no row for each pair of a query and a vector leaves a task."""

import random

from lodestrata.operators import signbits
from pyspark.sql import functions as F


def test_candidates_come_from_slices(spark, monkeypatch):
    monkeypatch.setattr(signbits, "SCORES", 64)
    rng = random.Random(3)
    vec = {i: [rng.gauss(0, 1) for _ in range(70)] for i in range(150)} | {150: None, 151: []}
    v = spark.createDataFrame(list(vec.items()), "id long, v array<double>").repartition(3)
    q = v.where("id % 25 = 0").select(F.col("id").alias("q"), F.col("v").alias("w"))
    got = signbits.knn(v, q, "id", "q", "v", "w", 3, oversample=4)
    cos = lambda a, b: sum(x * y for x, y in zip(a, b)) / (sum(x * x for x in a) * sum(y * y for y in b)) ** 0.5
    want = {}
    for a in range(0, 150, 25):
        far = sorted((sum((x > 0) != (y > 0) for x, y in zip(vec[a], vec[b])), b) for b in range(150))[:12]
        want[a] = [b for _, b in sorted((-round(cos(vec[a], vec[b]), 6), b) for _, b in far)[:3]]
    rows = {}
    for r in got.collect():
        rows.setdefault(r.q, []).append((r["rank"], r.id))
    assert {a: [i for _, i in sorted(x)] for a, x in rows.items()} == want
    assert "BroadcastNestedLoopJoin" not in got._jdf.queryExecution().toString() and "MapInArrow" in got._jdf.queryExecution().toString()
