"""The text index keeps each query's best before documents are shuffled by query."""

from lodestrata.operators import facets
from pyspark.sql import functions as F


def test_best_are_kept_before_the_shuffle(spark):
    docs = spark.createDataFrame([(i, "ant " * (i % 7) + "bee " * (i % 3), "ant" if i % 2 else "cow") for i in range(60)], "d long, text string, head string")
    asked = spark.createDataFrame([(1, ["ant", "bee"]), (2, ["cow"]), (3, ["none"])], "q long, terms array<string>")
    got = facets.text_index(docs, "d", asked, "q", "terms", {"text": 1.0, "head": 5.0}, 4)
    raw = {1: [(i % 7 + i % 3 + 5 * (i % 2), i) for i in range(60)], 2: [(5 * (i % 2 == 0), i) for i in range(60)]}
    want = {}
    for q, x in raw.items():
        x = sorted((-r, i) for r, i in x if r)
        want |= {(q, i, n + 1): round(r / x[0][0], 4) for n, (r, i) in enumerate(x[:4])}
    assert {(r.q, r.d, r["rank"]): r.score for r in got.collect()} == want
    assert "WindowGroupLimit" in got._jdf.queryExecution().executedPlan().toString()
