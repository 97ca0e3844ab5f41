"""run() over the smallest tables, against each stage's rule applied by brute force."""

import re

import corpus_pipeline
from lodestrata.llm import langid, quality, secrets

from .test_ngram_join import brute, features  # noqa: F401


def brute_components(rows):
    sets = {k: features(t, 5) for k, t in rows}
    keys, root = sorted(sets), {k: k for k in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(keys):
        for b in keys[:i]:
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= 80 * len(x | y):
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    return {k for k in keys if find(k) == k}


def test_run(spark):
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    out = corpus_pipeline.run(spark, d).collect()
    model = langid.train(docs)
    kept = [r for r in docs.collect() if (p := model.predict(r.text))[0] != "und" and p[1] >= corpus_pipeline.MIN_MARGIN]
    refs = quality.references(spark.createDataFrame(kept, docs.schema))
    kept = [r for r in kept if quality._judge(r.text, r.lang, refs, quality._Counter())[-1]]
    first = brute_components([(r.doc_id, r.text) for r in kept])
    automata = secrets.infer(secrets.labelled_credentials())
    clean = {r.doc_id: r.text for r in secrets.redact(spark.createDataFrame([r for r in kept if r.doc_id in first], docs.schema), automata).collect()}
    have = {}
    for r in out:
        have[r.doc_id] = have.get(r.doc_id, 0) + r.piece_len
    assert have == {k: len(re.findall(r"[^\x20\x09-\x0D]+", t)) for k, t in clean.items()}
    assert 0.5 * docs.count() < len(have) <= docs.count()


def test_stages_keep_columns_and_rows_that_are_clean(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, docs, "/root/testdata/sf0.01")
        assert got.columns == docs.columns
    lang = corpus_pipeline.identify_language(spark, docs, "")
    assert lang.count() >= 0.99 * docs.count()


def test_stages_take_nulls_repeats_and_empty_tables(spark, docs):
    words = "the quick brown fox jumps over a lazy dog while seven wizards brew strong tea near the old stone bridge today"
    rows = [(None, words, "en"), (1, None, "en"), (2, "", None), (3, words, "en"), (3, words, "en"), (4, words + " again", None), (5, "token = abcdefgh1 " + words[::-1], "de"), (6, "x" * 100_000, "en"), (7, words.upper(), "fr")]
    for table in (docs(rows), docs([])):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            got = stage(spark, table, "")
            assert got.columns == table.columns and got.count() <= len(rows)
        corpus_pipeline.pack_sequences(spark, table, "").count()
    kept = {r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, docs(rows), "").collect()}
    assert 3 in kept and 4 not in kept and {1, 2, 6} <= kept


def test_duplicates_go_by_row(spark, docs):
    a, b = "the quick brown fox jumps over a lazy dog", "while seven wizards brew strong tea near the old stone bridge"
    rows = [(1, a, "en"), (3, a, "en"), (3, b, "en"), (3, b, "en"), (None, a, "en"), (None, "something else that nobody said before", "en"), (7, None, "en"), (7, None, "en"), (8, "", "en")]
    got = sorted(((r.doc_id, r.text) for r in corpus_pipeline.drop_near_duplicates(spark, docs(rows), "").collect()), key=str)
    assert got == sorted([(1, a), (3, b), (None, rows[5][1]), (7, None), (8, "")], key=str)
