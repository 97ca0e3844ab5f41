import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _text string, _k0 int, node long, sig long, id string"


def rows_to_docs(spark, rows):
    """rows of (doc_id, text[, lang]); further columns clash with names used inside the operators."""
    full = [(r[0], r[1], r[2] if len(r) > 2 else None, "s", None, "clash", 7, 1, 2, "x") for r in rows]
    return spark.createDataFrame(full, SCHEMA)


@pytest.fixture
def docs(spark):
    return lambda rows: rows_to_docs(spark, rows)


@pytest.fixture(scope="session")
def texts():
    """Texts with near copies at many distances, short ones, empty ones, nulls and a very long one."""
    rng = random.Random(5)
    vocab = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(1, 7))) for _ in range(400)] + ["Éa", "ß", "中文字", "don't", "x|y"]
    out = [None, "", " \n\t", "one", "One two", "one two three", "one two three four", "ONE two  three\nfour", "one two three four"]
    for _ in range(12):
        base = [rng.choice(vocab) for _ in range(rng.choice([6, 12, 30, 80, 200, 300]))]
        out.append(" ".join(base))
        for edits in (0, 1, 1, 2, 3, 4, 6, 9):
            w = list(base)
            for _ in range(edits):
                i = rng.randrange(len(w))
                w[i : i + 1] = rng.choice([[], [rng.choice(vocab)], [w[i], rng.choice(vocab)]])
            out.append(rng.choice([" ", "\n", "  "]).join(w))
    out.append(" ".join(rng.choice(vocab) for _ in range(40_000)))
    return out
