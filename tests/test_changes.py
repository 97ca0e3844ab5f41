"""Journals, deletes, archives, rescans and sign-bit search."""

import random

import pytest
from lodestrata.operators import changes, retrieval, signbits
from lodestrata.streaming import jobs
from pyspark.sql import functions as F


def rows(df, *cols):
    return sorted(map(tuple, df.select(*cols).collect() if cols else df.collect()), key=str)


def test_undo_of_overlapping_runs(spark):
    rng = random.Random(1)
    states = [{(i, j): (rng.randint(1, 9), rng.choice(["a", None])) for i in range(6) for j in range(4) if rng.random() < 0.6} for _ in range(4)]
    frames = [spark.createDataFrame([(*k, *v) for k, v in s.items()], "u long, v long, w long, note string") for s in states]
    journals = [changes.journal(a, b, ["u", "v"], i) for i, (a, b) in enumerate(zip(frames, frames[1:], strict=False))]
    both = journals[1].unionByName(journals[2])
    assert rows(changes.undo(frames[3], both, ["u", "v"])) == rows(frames[1])
    assert rows(changes.undo(changes.undo(frames[3], journals[2], ["u", "v"]), both.where("run = 1").unionByName(journals[0]), ["u", "v"])) == rows(frames[0])
    with pytest.raises(ValueError, match="changed since"):
        changes.undo(frames[3], journals[0], ["u", "v"])
    assert rows(changes.undo(frames[0], journals[0].limit(0), ["u", "v"])) == rows(frames[0])


def test_deletes_keep_what_has_other_support(spark):
    edges = spark.createDataFrame([(1, 2, 3), (1, 3, 1), (2, 3, 2), (9, 9, 0)], "u long, v long, support long")
    seen = spark.createDataFrame([(1, 2, "a"), (1, 2, "b"), (1, 2, "c"), (1, 3, "a"), (2, 3, "b"), (2, 3, "c")], "u long, v long, doc_id string")
    gone = spark.createDataFrame([("a",), ("a",), ("z",)], "doc_id string")
    e, p, stones = changes.delete_documents(edges, seen, gone, ["u", "v"])
    assert rows(e) == [(1, 2, 2), (2, 3, 2), (9, 9, 0)] and p.count() == 4 and rows(stones, "doc_id") == [("a",), ("z",)]


def test_archives_get_ids_of_their_own(spark):
    docs = spark.createDataFrame([("d1", "x"), ("d2", "y")], "doc_id string, text string")
    chunks = spark.createDataFrame([("c1", "d1", None), ("c2", "d2", "c1"), ("c3", "lost", "c2")], "chunk_id string, doc_id string, before string")
    tables, ids = changes.remapped({"docs": docs, "chunks": chunks}, {"docs": "doc_id", "chunks": "chunk_id"}, {"chunks": [("doc_id", "docs"), ("before", "chunks")]}, "me")
    new = {(r.table, r.old): r.new for r in ids.collect()}
    assert len(set(new.values())) == 5 and tables["chunks"].columns == chunks.columns
    want = [(new["chunks", "c1"], new["docs", "d1"], None), (new["chunks", "c2"], new["docs", "d2"], new["chunks", "c1"]), (new["chunks", "c3"], None, new["chunks", "c2"])]
    assert rows(tables["chunks"]) == sorted(want, key=str)
    again = changes.remapped({"docs": docs}, {"docs": "doc_id"}, {}, "me")[1]
    assert {r.new for r in again.collect()} == {v for (t, _), v in new.items() if t == "docs"}


def test_folder_is_followed_and_scanned_again(spark, tmp_path):
    root, sink, check = tmp_path / "in", str(tmp_path / "sink"), str(tmp_path / "check")
    (root / "deep").mkdir(parents=True)
    (root / "a.txt").write_text("one")
    (root / "deep" / "b.txt").write_text("two")
    (root / "c.bin").write_text("no")
    for _ in range(2):
        jobs.follow_folder(spark, str(root), "*.txt", sink, check)
        assert jobs.read_upserts(spark, sink).count() == 2
    (root / "d.txt").write_text("three")
    jobs.follow_folder(spark, str(root), "*.txt", sink, check)
    name = lambda p: p.rsplit("/", 1)[1]
    before = {name(r.path): r.hash for r in jobs.read_upserts(spark, sink).collect()}
    assert set(before) == {"a.txt", "b.txt", "d.txt"}
    (root / "a.txt").write_text("one, changed")
    (root / "d.txt").unlink()
    (root / "e.txt").write_text("four")
    states = {name(r.path): r.state for r in jobs.rescan_folder(spark, str(root), "*.txt", sink, 1_000).collect()}
    assert states == {"a.txt": "changed", "b.txt": "unchanged", "d.txt": "gone", "e.txt": "new"}
    after = {name(r.path): r.hash for r in jobs.read_upserts(spark, sink).collect()}
    assert after["a.txt"] != before["a.txt"] and after["b.txt"] == before["b.txt"] and "e.txt" in after


def test_sign_bits(spark):
    v = spark.createDataFrame([(1, [1.0, -1.0, 0.0] + [1.0] * 62), (2, [-1.0] * 65)], "id long, v array<double>")
    got = {r.id: list(r.b) for r in v.select("id", signbits.packed(F.col("v")).alias("b")).collect()}
    bits = "100" + "1" * 61
    assert got == {1: [int(bits, 2) - (1 << 64), 1], 2: [0, 0]}
    assert v.crossJoin(v.select(F.col("v").alias("w"))).select(signbits.hamming(signbits.packed(F.col("v")), signbits.packed(F.col("w"))).alias("h")).orderBy("h").collect()[-1].h == 63


def test_sign_bit_search_recall(spark):
    e = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").withColumn("embedding", F.col("embedding").cast("array<double>"))
    q = e.where("vec_id % 10 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    pairs = lambda df: {(r.query_id, r.vec_id) for r in df.collect()}
    exact = pairs(retrieval.knn(e, q, "vec_id", "query_id", "embedding", "q", 10))
    found = pairs(signbits.knn(e, q, "vec_id", "query_id", "embedding", "q", 10))
    assert len(exact & found) >= 0.9 * len(exact)
    every = pairs(signbits.knn(e, q, "vec_id", "query_id", "embedding", "q", 10, oversample=50))
    assert every == exact
