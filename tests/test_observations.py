"""Observations against a plain walk over the same tags."""

import hashlib
import random

import pandas as pd
from lodestrata.operators import observations as o


def plain(key, text, version="1"):
    tags = o.regex_tagger()(pd.Series([text]))[0]
    out = []
    for c in (t for t in tags if t["kind"] == "clause"):
        own = sorted((t for t in tags if t["kind"] != "clause" and c["start"] <= t["start"] < c["end"]), key=lambda t: t["start"])
        quals = [f"{t['kind'].split(':')[1]}:{t['value']}" for t in own if t["kind"].startswith("qualifier")]
        for p in (t for t in own if t["kind"] == "predicate"):
            before = [t["value"] for t in own if t["kind"] == "span" and t["end"] <= p["start"]]
            after = [t["value"] for t in own if t["kind"] == "span" and t["start"] >= p["end"]]
            if before or after:
                s, obj = (before or [None])[-1], (after or [None])[0]
                name = "|".join(map(str, (version, key, c["start"], c["end"], p["start"], s or "", p["value"], obj or "")))
                out.append((hashlib.sha256(name.encode()).hexdigest()[:32], key, c["start"], c["end"], s, p["value"], obj, quals))
    return out


def test_observations(spark):
    rng = random.Random(3)
    pool = ["Spark", "uses", "Arrow", "not", "may", "data", "is", "Apache Spark", "if", ",", ".", ";", "\n", "fast", "Éclair", "requires", "Java", "!", "IS", "the"]
    texts = ["Spark uses Arrow, but Python is not fast. If Java fails; it requires Care", None, "", "is", "Alone", "nothing here"]
    texts += [" ".join(rng.choice(pool) for _ in range(rng.randint(1, 60))) for _ in range(40)]
    rows = list(enumerate(texts)) + [(0, texts[0])]
    df = spark.createDataFrame(rows, "id long, text string")
    got = sorted((tuple(r) for r in o.observations(df, "id", "text").collect()), key=str)
    assert got == sorted((x for k, t in rows if t for x in plain(k, t)), key=str)
    first = [r[4:] for r in got if r[1] == 0]
    assert ("Spark", "uses", "Arrow", []) in first and ("Python", "is", None, ["negation:not"]) in first
    again = sorted((tuple(r) for r in o.observations(df.repartition(3), "id", "text").collect()), key=str)
    assert again == got and all(a[0] != b[0] for a, b in zip(got, sorted((tuple(r) for r in o.observations(df, "id", "text", "2").collect()), key=str), strict=True))
