"""Extraction and planning operators on small inputs."""

from lodestrata.operators import extraction as ex
from lodestrata.operators import planning as pl
from pyspark.sql import functions as F


def one(spark, col, value):
    return spark.createDataFrame([(value,)], "t string").select(col.alias("x")).first().x


def test_extraction(spark):
    assert one(spark, ex.script_tokens("t"), "Café_au-lait 東京都 x2") == ["cafe", "au", "lait", "東京", "京都", "x2"]
    assert one(spark, ex.script_tokens("t"), None) == []
    long = one(spark, ex.split_long_lines("t"), "ab\n" + "word " * 1500)
    assert "".join(long) == "ab" + "word " * 1500 and max(map(len, long)) <= 5000
    assert [tuple(r) for r in one(spark, ex.abbreviations("t"), "We use natural language processing (NLP) and (X).")] == [("NLP", "natural language processing")]
    assert tuple(one(spark, ex.citation("t"), "books/Jane Doe - Deep Rivers (2001).pdf")) == ("Jane Doe", "Deep Rivers", 2001)
    assert tuple(one(spark, ex.citation("t"), "Notes.md")) == (None, "Notes", None)
    assert one(spark, ex.tolerant_json("t"), 'Sure: ```{"b": 1, "a": [2]}``` ok') == '{"a": [2], "b": 1}' and one(spark, ex.tolerant_json("t"), "{x}") is None
    assert one(spark, ex.eligible("t", F.lit("toc")), "text") == "noisy" and one(spark, ex.eligible("t", F.lit(None).cast("string")), "w " * 50) is None


def test_tables_claims_packets(spark):
    rows = spark.createDataFrame([(1, 1, ["name", "mass", "note"], ["iron", "7.9 kg", ""]), (1, 2, ["name", "mass", "note"], ["gold", "19", "soft"])], "t long, row_no long, h array<string>, c array<string>")
    got = sorted((r.subject, r.property, r.value, r.quantity, r.unit) for r in ex.table_facts(rows, ["t"], "h", "c").collect())
    assert got == [("gold", "mass", "19", 19.0, None), ("gold", "note", "soft", None, None), ("iron", "mass", "7.9 kg", 7.9, "kg")]
    f = spark.createDataFrame([("A", "is in", "B", "e1"), ("a", "is  in", "b", "e2"), ("A", "is not in", "B", "e3")], "s string, p string, o string, e string")
    got = {(r.negated, r.support, r.contested) for r in ex.claims(f, "s", "p", "o", "e").collect()}
    assert got == {(False, 2, True), (True, 1, True)}
    u = spark.createDataFrame([(1, i, "x" * 40) for i in range(5)], "k long, i long, b string")
    assert [(r.packet, r.units) for r in ex.packets(u, "k", "i", "b", 100).orderBy("packet").collect()] == [(0, 3), (1, 2)]
    d = spark.createDataFrame([(1, "the enzyme and protein"), (2, "nothing")], "i long, t string")
    assert [r.domain for r in ex.resolve_taxonomy(d, "i", "t", [("enzyme", "bio", 1), ("protein", "bio", 1), ("code", "it", 0)]).orderBy("i").collect()] == ["bio", "general"]


def test_planning(spark):
    ls = pl.lanes(spark, 'Compare "red fox" and grey wolf').collect()
    assert ls[0].phrase == "red fox" and ls[0].required and any("grey wolf" in r.phrase for r in ls)
    pool = spark.createDataFrame([(1, "a", 0.1, True), (1, "b", 0.05, False), (2, "a", 0.05, False)], "q long, side string, score double, hit boolean")
    assert pl.drop_low_confidence(pool, "q", "score", F.col("hit"), 0.3).count() == 2
    assert pl.grounded_only(pool, "q", "side", F.col("hit"), 1).count() == 2 and pl.grounded_only(pool, "q", "side", F.col("hit"), 2).count() == 3
    assert pl.with_fallback(pool.limit(1), lambda: pool, 2).count() == 3
    lex = spark.createDataFrame([("Graph", 10, 1, ["graph", "network"]), ("Net", 1, 0, ["net of things"])], "concept string, support long, n_definitions long, aliases array<string>")
    got = {r.term: (r.concept, r.tier) for r in pl.resolve_vocabulary(spark.createDataFrame([("Network",), ("net theory",)], "term string"), lex).collect()}
    assert got == {"Network": ("Graph", 0), "net theory": ("Net", 1)}
    q = spark.createDataFrame([(1, "what is the missing bridge between cells")], "id long, t string")
    ents = spark.createDataFrame([("e1", 5, "Bridge cell"), ("e2", 9, "Cells bridge"), ("e3", 1, "Moon")], "e string, m long, name string")
    assert [(r.e, r.score) for r in pl.query_entities(q, ents, "t", "id", "name", "e", "m").orderBy("place").collect()] == [("e2", 18), ("e1", 5)]
    prof = pl.gap_profile(q, "id", "t", {"structural": {"bridge": 0.4}, "bio": {"cells": 0.5}, "x": {"zz": 1.0}}).orderBy("place").collect()
    assert [(r.domain, r.confidence) for r in prof] == [("structural", 0.65), ("bio", 0.5)]
    cov = pl.evidence_coverage(pool, "q", "side", "side", F.col("hit"), 1).orderBy("q").collect()
    assert [(r.covered, r.lanes, r.complete) for r in cov] == [(1, 2, False), (0, 1, False)]
    assert pl.merge_corpora([pool, pool], ["q", "side"], "score", 2).count() == 2
    left = pl.cascade_delete({"a": pool, "b": q}, pool.where("q = 1"), ["q"])
    assert left["a"].count() == 1 and left["b"].count() == 1 and left["tombstones"].count() == 1
    j = spark.createDataFrame([('{"results":[{"url":"http://A.com/x/?utm_a=1","title":"t","content":"c"},{"url":"http://a.com/x"}]}',)], "p string")
    assert [(r.url, r.title, r.rank) for r in pl.search_hits(j, "p", 5).collect()] == [("http://a.com/x", "t", 1)]
    grown = pl.coverage_rounds(pool, lambda p: p.where("q = 9"), lambda g: g, ["q"], 2)
    assert grown.count() == 3
    a, b = (one(spark, pl.cache_key("t", F.array(F.lit(x), F.lit(y)), "m"), " What  IS") for x, y in (("c1", "c2"), ("c2", "c1")))
    assert a == b


def test_normalized_record(spark):
    from lodestrata.operators import audit

    r = one(spark, audit.normalized_record(F.col("t"), 5, 2), '{"summary": "  long text ", "concepts": [" A", "a", "", "b", "c"]}')
    assert (r.summary, r.concepts) == ("long ", ["a", "b"]) and one(spark, audit.normalized_record(F.col("t")), "{").summary == ""
