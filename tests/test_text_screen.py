"""The screen by words lets through every pair that the exact scores keep."""

import pytest
from lodestrata.functions import text
from lodestrata.operators import retrieval as r
from pyspark.sql import functions as F


@pytest.mark.parametrize("parted", [False, True])
def test_screened_scores_are_those_of_all_pairs(spark, monkeypatch, parted):
    if parted:
        monkeypatch.setattr(r, "MOST_BROADCAST", 3)
    docs = spark.createDataFrame([(1, "Start of warfare"), (2, None), (3, ""), (4, "the cat sat on the mat"), (5, "café cat, mat"), (6, "the the the"), (7, "a cat sat")], "d long, text string")
    asked = spark.createDataFrame([(1, "art of war"), (2, "the cat sat on a mat"), (3, ""), (4, None), (5, "3rd cat"), (6, "cat"), (2, "mat cat"), (8, "of")], "q long, phrase string")
    asked = asked.withColumn("terms", F.array_distinct(text.words("phrase"))).withColumn("hits", F.lit(1))
    seen = []

    def score(row, q, n):
        seen.append(n)
        return text.lexical_score(q["terms"], row, q["phrase"], n)

    got = r.against_all(docs, "d", asked, "q", text.scanned("text", F.lit("")), score, 0.0, lambda row: row["flat"], "terms", "hits")
    plain = docs.select("d", text.scanned("text", F.lit("")).alias("s")).crossJoin(asked).select("d", "q", text.lexical_score(F.col("terms"), F.col("s"), F.col("phrase")).alias("score")).where("score > 0")
    rows = lambda x: sorted((v.d, v.q, v.score) for v in x.collect())
    assert rows(got) == rows(plain) and len(rows(plain)) > 8 and seen
