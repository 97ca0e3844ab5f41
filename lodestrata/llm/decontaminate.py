"""Benchmark decontamination: an Aho-Corasick automaton over the windows of all test items, run once over each text.

Items and texts are folded alike: A-Z lower-cased, words of digits, letters and non-ASCII
characters, one blank between words. A window is 10 consecutive words of an item with a blank on
either side, so that matches begin and end with words; an item of fewer words is one window. The
places of matches are words of the folded text, and are told as code points of the original.
"""

from __future__ import annotations

import math
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import FOLD, cut, left_join_skewed, map_texts

WINDOW = 10
#: Bytes of windows and item ids that one automaton holds at most, which are what is broadcast. More
#: windows are dealt to several automata, and each is run over all texts.
AUTOMATON_BYTES = 4_000_000

_SPANS = "array<struct<word:long,word_end:long,start:long,end:long>>"


def fold(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(FOLD).split()


def windows(items: DataFrame, id_col: str = "item_id", text_col: str = "text", size: int = WINDOW) -> DataFrame:
    """(window, words, item): each window of each item; an item without words has none."""

    def make():
        def run(keys, texts):
            window, words, item = [], [], []
            for key, text in zip(keys[0].to_pylist(), texts, strict=True):
                ws = fold(text)
                n = min(size, len(ws))
                places = range(len(ws) - n + 1) if ws else ()
                window += [b" %b " % b" ".join(ws[i : i + n]) for i in places]
                words += [n] * len(places)
                item += [key] * len(places)
            return {"window": window, "words": words, "item": item}

        return run

    return map_texts(items, [F.col(id_col).cast("string")], text_col, make, "window binary, words int, item string")


class Automaton:
    """Windows with their lengths in words and the items that hold them."""

    def __init__(self, rows: list[tuple[bytes, int, str | None]]):
        import ahocorasick

        held: dict[bytes, tuple[int, set]] = {}
        for window, n, item in rows:
            held.setdefault(window, (n, set()))[1].add(item)
        self.automaton = ahocorasick.Automaton()
        for window, value in held.items():
            self.automaton.add_word(window.decode("latin-1"), value)
        if held:
            self.automaton.make_automaton()
        self.none = not held

    def find(self, text: str | None) -> tuple[int, list[dict], list[str]]:
        """(words of the text, its hit spans, the items found, sorted)."""
        ws = fold(text)
        if not ws or self.none:
            return len(ws), [], []
        line = b" %b " % b" ".join(ws)
        found = list(self.automaton.iter(line.decode("latin-1")))
        if not found:
            return len(ws), [], []
        blanks = np.flatnonzero(np.frombuffer(line, np.uint8) == 32)
        end = np.searchsorted(blanks, [e for e, _ in found])
        begin = end - np.array([n for _, (n, _) in found])
        depth = np.bincount(begin, minlength=len(ws) + 1) - np.bincount(end, minlength=len(ws) + 1)
        edges = np.flatnonzero(np.diff(np.concatenate([[0], np.cumsum(depth[:-1]) > 0, [0]])))
        items = set().union(*{id(held): held for _, (_, held) in found}.values()) - {None}
        return len(ws), self._original(text, edges[::2], edges[1::2]), sorted(items)

    @staticmethod
    def _original(text: str, first: np.ndarray, stop: np.ndarray) -> list[dict]:
        raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
        inside = np.frombuffer(FOLD, np.uint8)[raw] != 32
        edges = np.flatnonzero(np.diff(np.concatenate([[0], inside, [0]])))
        point = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
        columns = (first, stop, point[edges[::2][first]], point[edges[1::2][stop - 1]])
        return [dict(zip(("word", "word_end", "start", "end"), map(int, x), strict=True)) for x in zip(*columns, strict=True)]


_built: dict[str, Automaton] = {}


def _scan(df: DataFrame, rows: list[tuple], keys: list[Column], names: str, text_col: str) -> DataFrame:
    """The keys, n_words, spans and items of every row, by one automaton, which a worker process builds once."""
    shared, name = df.sparkSession.sparkContext.broadcast(rows), uuid.uuid4().hex

    def make():
        if name not in _built:
            _built.clear()
            _built[name] = Automaton(shared.value)
        find = _built[name].find

        def run(keys, texts):
            n, spans, items = zip(*map(find, texts), strict=True) if texts else ((), (), ())
            return {f"_key{i}": k for i, k in enumerate(keys)} | {"n_words": n, "spans": spans, "items": items}

        return run

    return map_texts(df, keys, text_col, make, f"{names}, n_words long, spans {_SPANS}, items array<string>")


def _merged(spans: Column) -> Column:
    """The union of spans, as disjoint spans in order."""

    def step(done, s):
        last = F.element_at(done, -1)
        joined = F.struct(last["word"].alias("word"), F.greatest(last["word_end"], s["word_end"]).alias("word_end"), last["start"].alias("start"), F.greatest(last["end"], s["end"]).alias("end"))
        apart = (F.size(done) == 0) | (F.try_element_at(done, F.lit(-1))["word_end"] < s["word"])
        return F.when(apart, F.concat(done, F.array(s))).otherwise(F.concat(F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))), F.array(joined)))

    return F.aggregate(F.array_sort(spans), F.array().cast(_SPANS), step)


def scan(df: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", size: int = WINDOW) -> DataFrame:
    """(id_col, n_words, spans, items), one row per row.

    spans: disjoint runs of hit words (word, word_end) with their code points in the text (start,
    end), ends exclusive; items: ids, as strings and sorted so, of the items with a window in the text.
    A null or empty text has no words; an item without words has no window. Items may repeat: an
    id counts once, and windows of an item whose id is null hit words without an id. Repeated rows
    and null ids stay; empty tables give no rows, or no hits; other columns are ignored.
    """
    found = cut(windows(items, item_id, item_text, size))
    total = found.agg(F.sum(F.length("window") + F.coalesce(F.length("item"), F.lit(0)))).first()[0] or 0
    blocks = max(1, math.ceil(total / AUTOMATON_BYTES))
    kind = df.schema[id_col].dataType.simpleString()
    if blocks == 1:
        got = _scan(df, list(map(tuple, found.collect())), [F.col(id_col)], f"_key0 {kind}", text_col)
        return got.withColumnRenamed("_key0", id_col)
    row = F.xxhash64(F.col(id_col).cast("string"), F.col(text_col))
    deal, hit = F.pmod(F.xxhash64("window", "item"), F.lit(blocks)), None
    for i in range(blocks):
        one = _scan(df, list(map(tuple, found.where(deal == i).collect())), [F.col(id_col), row], f"_key0 {kind}, _key1 long", text_col)
        base, one = one.select(F.col("_key0").alias(id_col), "_key1", "n_words"), cut(one.where("size(spans) > 0").select("_key0", "_key1", "spans", "items"))
        hit = hit.union(one) if hit else one
    hit = hit.select(F.struct(F.col("_key0").alias("id"), F.col("_key1").alias("hash")).alias("_row"), "spans", "items").groupBy("_row")
    hit = hit.agg(_merged(F.flatten(F.collect_set("spans"))).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))
    base = cut(base.select(id_col, "n_words", F.struct(F.col(id_col).alias("id"), F.col("_key1").alias("hash")).alias("_row")))
    out = left_join_skewed(base, cut(hit), ["_row"])
    return out.select(id_col, "n_words", F.coalesce("spans", F.array().cast(_SPANS)).alias("spans"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))
