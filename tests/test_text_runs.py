"""What Python makes of texts is handed on in runs of characters, however many rows a batch has."""

import pandas as pd
from lodestrata.functions import batches
from lodestrata.operators import chunking, extraction, observations

TEXTS = [None, "", "Ada uses Boxes. Bob has Cats, not Dogs.\n\n- a\n- b\n- c", "x" * 500, "größe Ünder日本語", "Rex is Max. " * 40]


def test_runs_cover_all_rows_once():
    texts = pd.Series(TEXTS * 3)
    for chars in (1, 60, 700, 10**9):
        got = list(batches.runs(texts, chars))
        assert [i for a, b in got for i in range(a, b)] == list(range(len(texts)))
        assert all(sum(len(t or "") for t in texts[a + 1 : b]) <= chars for a, b in got)
    assert len(list(batches.runs(texts, 60))) > 6 and not list(batches.runs(texts[:0], 60))


def test_no_call_sees_a_whole_batch(spark, monkeypatch):
    df = spark.createDataFrame(list(enumerate(TEXTS * 20)), "id long, t string").coalesce(1)

    def size(texts):
        return pd.Series([len(texts)] * len(texts))

    monkeypatch.setattr(batches, "RUN_CHARS", 1_000)
    n = [r.n for r in df.select(batches.text_udf(size, "long")("t").alias("n")).collect()]
    assert len(n) == 120 and max(n) <= 12


def test_results_do_not_depend_on_runs(spark, monkeypatch):
    df = spark.createDataFrame(list(enumerate(TEXTS * 5)), "id long, t string").coalesce(1)
    makes = (
        lambda: df.select("id", extraction.script_tokens("t").alias("w")),
        lambda: observations.observations(df, "id", "t"),
        lambda: chunking.structured_pieces(df, "id", "t", 4, 6),
    )
    whole = [sorted(map(str, m().collect())) for m in makes]
    monkeypatch.setattr(batches, "RUN_CHARS", 50)
    assert [sorted(map(str, m().collect())) for m in makes] == whole and all(whole)
