"""Questions of the same tokens are answered once, each with its own rows: joins see the tokens, not the questions."""

from lodestrata.operators import planning as pl


def test_questions_of_the_same_tokens_are_answered_once(spark):
    parts = spark.createDataFrame([(i, i % 5 + 1, f"{a} {b}") for i, (a, b) in enumerate([("red", "bolt"), ("blue", "bolt"), ("red", "ring"), ("tin", "ring")] * 6)], "e long, m long, name string")
    asked = spark.createDataFrame([(i, "red bolt" if i % 2 else "bolt red") for i in range(40)] + [(50, "ring"), (51, ""), (52, None), (50, "tin")], "q long, text string")
    got = pl.query_entities(asked, parts, "text", "q", "name", "e", "m", per_token=2)
    rows = {}
    for r in got.collect():
        rows.setdefault(r.q, []).append((r.place, r.e, r.overlap, r.score))
    assert set(rows) == {*range(40), 50}

    def plain(words):
        s = [(len(words & set(r.name.split())), r.m, r.e) for r in parts.collect()]
        s = sorted((-o * m, e, o) for o, m, e in s if o)
        return [(i + 1, e, o, -x) for i, (x, e, o) in enumerate(s[: 2 * len(words)])]

    assert all(sorted(rows[i]) == plain({"red", "bolt"}) for i in range(40)) and sorted(rows[50]) == plain({"ring", "tin"})
