import math

import numpy as np
from lodestrata.llm import vector_join as vj

SCHEMA = "vec_id long, embedding array<float>, label int, v string, id int, node string"


def brute(rows, bound=0.93):
    unit = []
    for _, v, label in rows:
        fine = label is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)
        unit.append(np.array(v, np.float32).astype(float) / np.linalg.norm(np.array(v, np.float32).astype(float)) if fine else None)
    n, root = len(rows), list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    links = [0] * n
    for i in range(n):
        for j in range(i):
            if unit[i] is not None and unit[j] is not None and rows[i][2] == rows[j][2] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= bound:
                links[i] += 1
                links[j] += 1
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return sorted((rows[i][0], links[i], rows[find(i)][0], find(i) == i) for i in range(n))


def test_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(vj, "CHUNK", 50)
    rng = np.random.default_rng(2)
    rows = []
    for label in (0, 1, None):
        for _ in range(12):
            base = rng.normal(size=64)
            for spread in (0.0, 0.0, 0.1, 0.2, 0.3, 0.36, 0.4, 0.5):
                rows.append([None, [float(x) for x in (base + spread * rng.normal(size=64)) * rng.choice([0.01, 1, 50])], label])
    rows += [[None, v, 0] for v in (None, [], [0.0] * 64, [math.nan] * 64, [math.inf] + [1.0] * 63, [None] + [1.0] * 63, [1.0, 2.0, 3.0], [1.0, 2.0, 3.1], [1e-20] * 64, [2e-20] * 64)]
    rows += [[None, [float(x) for x in r], 3] for r in np.eye(64)[0] + 0.02 * rng.normal(size=(130, 64))]
    for i, r in enumerate(rows):
        r[0] = 3 * i + 1
    df = spark.createDataFrame([(*r, "c", 1, "x") for r in rows], SCHEMA)
    assert sorted(tuple(r) for r in vj.near_duplicates(df).collect()) == brute(rows)


def test_empty_and_null_ids(spark):
    assert vj.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0
    got = vj.near_duplicates(spark.createDataFrame([(None, [1.0, 0.0], 1, "", 1, ""), (5, [1.0, 0.0], 1, "", 1, ""), (5, [1.0, 0.0], 1, "", 1, "")], SCHEMA)).collect()
    assert sorted((tuple(r) for r in got), key=str) == sorted([(None, 0, None, True), (5, 0, 5, True), (5, 0, 5, True)], key=str)


def test_repeated_ids_with_unlike_vectors(spark):
    rows = [(1, [1.0, 0.0], 0), (1, [0.0, 1.0], 0), (2, [1.0, 0.01], 0), (3, [0.01, 1.0], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = sorted(tuple(r) for r in vj.near_duplicates(df).collect())
    assert got == [(1, 1, 1, True), (1, 1, 1, True), (2, 1, 1, False), (3, 1, 1, False)]
