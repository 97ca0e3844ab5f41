"""Shelf roles by hand-made cards, and semantic blocks against a plain version."""

import random
import re
import statistics

import numpy as np
from lodestrata.operators import facets, semantic, shelves


def test_each_role_and_its_conditions(spark):
    rows = [
        ("d", shelves.SUBJECTS, "Trust-Building", "s1"), ("d", shelves.SUBJECTS, "dark patterns", None),
        ("f", shelves.CAPABILITIES, "trust building", "s2"), ("f", shelves.MECHANISMS, "other", "s3"),
        ("g", shelves.CAPABILITIES, "trust building", "s2"), ("g", shelves.MECHANISMS, "loss aversion", None),
        ("b", shelves.PRINCIPLES, "loss_aversion", "s4"), ("n", shelves.PRINCIPLES, "loss_aversion", None),
        ("e", shelves.SUBJECTS, "ethics", "s5"), ("e", shelves.SUBJECTS, "privacy", "s6"), ("e", shelves.SUBJECTS, "unrelated", "s7"),
        ("out", shelves.SUBJECTS, "trust building", "s1"), (None, shelves.SUBJECTS, "trust building", "s1"),
    ]
    cards = spark.createDataFrame(rows, "card string, field string, key string, source string")
    wanted = spark.createDataFrame([(1, "trust_building"), (1, "loss aversion"), (1, "LOSS-AVERSION"), (1, "a"), (1, "b"), (2, ""), (3, "nothing")], "query_id long, key string")
    seats = spark.createDataFrame([(q, c) for q in (1, 2, 3) for c in "dfgbne"], "query_id long, card string")
    got = {(r.card, r.role): (r.score, r.evidence, r.role_place, r.card_place) for r in shelves.shelf_roles(cards, wanted, seats, ["dark_patterns"], ["ethics", "privacy", "x", "y"]).collect()}
    assert {k: v[:3] for k, v in got.items()} == {
        ("d", "direct"): (0.25, ["s1"], 1), ("e", "counterbalance"): (0.5, ["s5", "s6"], 1),
        ("f", "foundational"): (0.25, ["s2", "s3"], 2), ("f", "adjacent"): (0.25, ["s2"], 1),
        ("g", "adjacent"): (0.5, ["s2"], 1), ("b", "bridge"): (0.25, ["s4"], 1),
    }
    places = {c: v[3] for (c, _), v in got.items()}
    assert places == {"e": 1, "g": 2, "b": 3, "d": 4, "f": 5}


def plain_parents(text, least, most, model):
    clean = lambda parts: [p.strip(" ") for p in parts if p.strip(" ")]
    parts = clean(re.split(r"\n\n+", text))
    if len(parts) < 4:
        parts = clean(re.split(r"(?<=[.!?])\s+", text))
    if not parts:
        return []
    size = [len(re.split(r"\s+", p)) for p in parts]
    if sum(size) <= most or len(parts) < 4:
        return [(0, len(parts), sum(size), "\n\n".join(parts))]
    v = [np.array(x) for x in model(__import__("pandas").Series(parts))]
    likeness = [float(a @ b / (np.linalg.norm(a) * np.linalg.norm(b))) if a.any() and b.any() else 0.0 for a, b in zip(v, v[1:], strict=False)]
    low = statistics.fmean(likeness) - statistics.pstdev(likeness)
    blocks = []
    for i, n in enumerate(size):
        if not blocks or blocks[-1][2] + n > most or (i and likeness[i - 1] < low and blocks[-1][2] >= least):
            blocks.append([i, 1, n])
        else:
            blocks[-1][1] += 1
            blocks[-1][2] += n
    if len(blocks) > 1 and blocks[-1][2] < least and blocks[-2][2] + blocks[-1][2] <= most:
        last = blocks.pop()
        blocks[-1][1] += last[1]
        blocks[-1][2] += last[2]
    return [(a, n, t, "\n\n".join(parts[a : a + n])) for a, n, t in blocks]


def test_semantic_parents(spark):
    rng = random.Random(5)
    topics = [[f"{c}{i}" for i in range(12)] for c in "abcd"]
    texts = [None, "", "   ", "One. Two! Three?", "word " * 900]
    for _ in range(12):
        sentences = [" ".join(rng.choice(topics[i * 4 // 30]) for _ in range(rng.randint(2, 25))).capitalize() + rng.choice(".!?") for i in range(rng.randint(3, 30))]
        texts.append(rng.choice([" ", "\n\n", "\n"]).join(sentences))
    df = spark.createDataFrame(list(enumerate(texts)), "id long, t string")
    got = sorted((r.id, r.parent, r.first, r.n_units, r.tokens, r.text) for r in semantic.parents(df, "id", "t", 20, 60).collect())
    want = [(i, p, *b) for i, t in enumerate(texts) if t is not None for p, b in enumerate(plain_parents(t, 20, 60, facets.hashed_embedder()))]
    assert got == want and max(x[1] for x in got) > 3
