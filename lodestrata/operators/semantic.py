"""Blocks of a text that end where its sentences turn to something else."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.batches import RUN_CHARS, runs
from .facets import hashed_embedder

#: A text of fewer paragraphs is taken by sentences.
LEAST_UNITS = 4


def units(text_col: str) -> Column:
    """Paragraphs between blank lines, or sentences where there are fewer than four."""
    trimmed = lambda c: F.filter(F.transform(c, lambda x: F.trim(x)), lambda x: x != "")
    paragraphs = trimmed(F.split(text_col, r"\n\n+"))
    sentences = trimmed(F.split(text_col, r"(?<=[.!?])\s+"))
    return F.when(F.size(paragraphs) < LEAST_UNITS, sentences).otherwise(paragraphs)


def _turned(v: np.ndarray) -> list[bool]:
    """Of each vector of a text: its cosine with the one before is below the text's mean less one deviation."""
    sums = lambda x: np.add.accumulate(x, axis=1)[:, -1]  # noqa: E731  # term by term, whatever the length
    norm = np.sqrt(sums(v * v))
    both, dot = norm[1:] * norm[:-1], sums(v[1:] * v[:-1])
    like = np.divide(dot, both, out=np.zeros(len(dot)), where=both > 0).tolist()
    total = mean = square = 0.0
    for n, x in enumerate(like, 1):  # moments by updates
        total, step = total + x, x - mean
        mean += step / n
        square += step * (step - step / n)
    low = total / len(like) - math.sqrt(square / len(like)) if like else 0.0
    return [False, *[x < low for x in like]]


def _walk(size: list[int], turn: list[bool], least: int, most: int) -> list[dict]:
    """Blocks of units of so many tokens, see ``parents``."""
    done = []
    for i, (t, turned) in enumerate(zip(size, turn, strict=True)):
        held = done[-1]["tokens"] if done else 0
        if not done or held + t > most or (turned and held >= least):
            done.append({"first": i, "n": 1, "tokens": t})
        else:
            done[-1]["n"] += 1
            done[-1]["tokens"] += t
    if len(done) > 1 and done[-1]["tokens"] < least and done[-2]["tokens"] + done[-1]["tokens"] <= most:
        tail = done.pop()
        done[-1]["n"] += tail["n"]
        done[-1]["tokens"] += tail["tokens"]
    return done


def parents(docs: DataFrame, id_col: str, text_col: str, least: int = 60, most: int = 240, model: Callable[[pd.Series], pd.Series] | None = None) -> DataFrame:
    """(id, parent, first, n_units, tokens, text): blocks of whole units, in order.

    A block ends before a turn once it has ``least`` tokens, and before a unit that would take it past
    ``most``; a last block below ``least`` joins the one before if both fit. A text of at most ``most``
    tokens, or of fewer than four units, is one block; a unit longer than ``most`` is a block of its
    own. A null or empty text has none. A unit is a turn where its likeness to the unit before is
    below the text's mean less one deviation.

    Units are embedded and walked where their text lies, in runs of a batch; nothing is shuffled. Equal
    units of a run share one call of the model.
    """
    model, chars = model or hashed_embedder(), RUN_CHARS

    def told(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for lists, sizes in batches:
            if not len(lists):
                yield pd.Series([], dtype=object)
            for a, b in runs(lists.map("".join), chars):
                some, size = [list(x) for x in lists.iloc[a:b]], [x.tolist() for x in sizes.iloc[a:b]]
                one = [sum(n) <= most or len(n) < LEAST_UNITS for n in size]
                place = {u: i for i, u in enumerate(dict.fromkeys(u for x, o in zip(some, one, strict=True) if not o for u in x))}
                got = list(model(pd.Series(list(place), dtype=object))) if place else []
                dim = max((len(x) for x in got if x is not None), default=1)
                v = np.array([np.zeros(dim) if x is None else x for x in got], np.float64).reshape(len(got), dim)
                whole = lambda n: [{"first": 0, "n": len(n), "tokens": sum(n)}] if n else []
                yield pd.Series([whole(n) if o else _walk(n, _turned(v[[place[u] for u in x]]), least, most) for x, n, o in zip(some, size, one, strict=True)])

    x = docs.where(F.col(text_col).isNotNull()).select(id_col, units(text_col).alias("_u"))
    x = x.select(id_col, "_u", F.transform("_u", lambda u: F.size(F.split(u, r"\s+"))).alias("_n"))
    rows = x.select(id_col, "_u", F.posexplode(F.pandas_udf(told, "array<struct<first:int,n:int,tokens:int>>")("_u", "_n")).alias("parent", "s"))
    return rows.select(id_col, "parent", "s.first", F.col("s.n").alias("n_units"), "s.tokens", F.array_join(F.slice("_u", F.col("s.first") + 1, F.col("s.n")), "\n\n").alias("text"))
