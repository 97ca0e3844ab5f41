"""Quality rules: counts over words, lines and word windows, and distribution divergence.

A document's histogram of character classes and of common words is compared by Jensen-Shannon
distance with the reference histogram of its language, summed over all documents of it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_texts, runs, words_of

# Frequent function words of four languages.
COMMON = (
    "the of and to in a is that it for was on are as with be by this"
    " de la le et les des en du que qui est un une pour dans par au sur"
    " der die und das den von zu mit sich ist nicht ein eine auf dem"
    " el los las y se del por con no su para es al lo"
).split()
SYMBOLS = b"#*$%&|<>"
#: Character classes by byte: lower, upper, digit, space, line break, stop, other mark, symbol, non-ASCII.
CLASSES = 9
_CLASS = np.full(256, 8, np.int64)
for _c in range(128):
    _ch = bytes([_c])
    _CLASS[_c] = (
        7 if _ch in [bytes([s]) for s in SYMBOLS]
        else 0 if 97 <= _c <= 122
        else 1 if 65 <= _c <= 90
        else 2 if 48 <= _c <= 57
        else 4 if _c in (10, 13)
        else 3 if _c in (32, 9, 11, 12)
        else 5 if _ch in b".,;:!?'"
        else 6
    )


class _Counter:
    def __init__(self):
        import xxhash

        self.hash = xxhash.xxh64_intdigest
        names = sorted({w for c in COMMON for w in (c, c.capitalize())})
        order = sorted({c: i for i, c in enumerate(dict.fromkeys(COMMON))}.items())
        at = dict(order)
        pairs = sorted((self.hash(w.encode()), at[w.lower()]) for w in names)
        self.known = np.array([h for h, _ in pairs], np.uint64)
        self.slot = np.array([s for _, s in pairs], np.int64)
        self.n = len(at)

    def words(self, data: bytes) -> np.ndarray:
        words = words_of(data)
        return np.fromiter(map(self.hash, words), np.uint64, len(words))

    def histogram(self, data: bytes, h: np.ndarray) -> np.ndarray:
        """Counts of character classes, then of common words, then of all other words."""
        classes = np.bincount(_CLASS[np.frombuffer(data, np.uint8)], minlength=CLASSES)
        i = np.minimum(np.searchsorted(self.known, h), len(self.known) - 1)
        hit = self.known[i] == h
        common = np.bincount(self.slot[i[hit]], minlength=self.n)
        return np.concatenate([classes, common, [len(h) - int(hit.sum())]]).astype(np.int64)


def repeated_words(h: np.ndarray, width: int = 5) -> int:
    """Words that lie in a window of ``width`` words found twice or more, the first place included."""
    if len(h) <= width:
        return 0
    m = np.uint64(0x9E3779B97F4A7C15)
    w = np.zeros(len(h) - width + 1, np.uint64)
    for i in range(width):
        w = (w ^ (w >> np.uint64(29))) * m + h[i : len(h) - width + 1 + i]
    order = np.argsort(w)
    s = w[order]
    same = s[1:] == s[:-1]
    if not same.any():
        return 0
    twice = np.zeros(len(w), bool)
    twice[order[1:][same]] = twice[order[:-1][same]] = True
    step = np.zeros(len(h) + 1, np.int64)
    step[: len(w)] += twice
    step[width : width + len(w)] -= twice
    return int((np.cumsum(step)[:-1] > 0).sum())


def duplicate_lines(text: str) -> int:
    """Lines (split at \\n) that hold a word and equal an earlier line."""
    lines = [x for x in text.split("\n") if x.strip(" \t\x0b\x0c\r\n")]
    return len(lines) - len(set(lines))


def js_distance(p: np.ndarray, q: np.ndarray) -> float:
    """Jensen-Shannon distance (base 2, 0 to 1) of two count vectors; 0 if either is all zero."""
    if not p.sum() or not q.sum():
        return 0.0
    p, q = p / p.sum(), q / q.sum()
    m = (p + q) / 2

    def kl(a):
        at = a > 0
        return float((a[at] * np.log2(a[at] / m[at])).sum())

    return float(np.sqrt(max(0.0, (kl(p) + kl(q)) / 2)))


def references(df: DataFrame, text_col: str = "text", lang_col: str = "lang", max_langs: int = 1000) -> dict[str, np.ndarray]:
    """Histogram of each language, summed over all its documents (null texts add nothing).

    Each slice of texts gives one row per language, so what is shuffled follows the number of
    slices. Beyond ``max_langs`` languages those with the most words (ties by name) have a
    reference, and documents of others are held against the nearest one.
    """

    def make():
        c = _Counter()

        def run(keys, texts):
            sums: dict[str, np.ndarray] = {}
            for lang, t in zip(keys[0].to_pylist(), texts, strict=True):
                if t and lang is not None:
                    data = t.encode("utf-8", "surrogatepass")
                    x = c.histogram(data, c.words(data))
                    sums[lang] = sums[lang] + x if lang in sums else x
            return {"lang": list(sums), "counts": list(sums.values())}

        return run

    rows = map_texts(df, [F.col(lang_col).cast("string")], text_col, make, "lang string, counts array<long>")
    size = CLASSES + len(set(COMMON)) + 1
    total = rows.groupBy("lang").agg(*[F.sum(F.col("counts")[i]).alias(f"c{i}") for i in range(size)])
    got = total.orderBy(F.desc(sum(F.col(f"c{i}") for i in range(CLASSES, size))), "lang").limit(max_langs).collect()
    return {r[0]: np.array(r[1:], np.float64) for r in sorted(got, key=lambda r: r[0])}


# Bounds of the method's own verdict.
GUARD_WORDS = 40
MAX_CLASS = 0.30
#: The bound on common words is sqrt(COMMON_BASE**2 + COMMON_NOISE**2 / words): sampling noise shrinks with the root of the number of words.
COMMON_BASE, COMMON_NOISE = 0.10, 3.2
NAMES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "js_class", "js_common", "base_failed", "kept")


def max_common(words: int) -> float:
    return (COMMON_BASE**2 + COMMON_NOISE**2 / words) ** 0.5


def _judge(text: str | None, lang: str | None, refs: dict[str, np.ndarray], c: _Counter, min_words: int = 10, max_repeat: int = 20) -> tuple:
    text = text or ""
    data = text.encode("utf-8", "surrogatepass")
    h = c.words(data)
    repeat = repeated_words(h)
    failed = len(h) < min_words or 100 * repeat > max_repeat * len(h)
    x = c.histogram(data, h)
    away = lambda r: (js_distance(x[:CLASSES], r[:CLASSES]), js_distance(x[CLASSES:], r[CLASSES:]))
    near = lambda: min(map(away, refs.values()), key=sum, default=(0.0, 0.0))
    beyond = lambda d: len(h) >= GUARD_WORDS and (d[0] > MAX_CLASS or d[1] > max_common(len(h)))
    a, b = away(refs[lang]) if lang in refs else near()
    if beyond((a, b)) and lang in refs and not beyond(other := near()):
        a, b = other  # mislabelled
    odd = beyond((a, b))
    blanks = sum(map(text.count, " \t\n\x0b\x0c\r"))
    return len(h), len(text) - blanks, len(data) - len(data.translate(None, SYMBOLS)), duplicate_lines(text), repeat, a, b, failed, not failed and not odd


def assess(df: DataFrame, refs: dict[str, np.ndarray], id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One row per row: the counts, js_class, js_common, base_failed and kept.

    base_failed: fewer than 10 words, or over 20 percent of words in repeated 5-word windows.
    Else a document of GUARD_WORDS words or more is rejected when the distance of its character
    classes or of its common words from the reference of its language is above its bound, and
    so it is from the nearest reference (the only one asked without a known language; of equally
    near ones, the first by name); shorter ones are kept. A null or empty text has no
    words and fails. An empty table gives no rows; repeated rows and null ids stay; other
    columns are ignored.
    """
    shared = df.sparkSession.sparkContext.broadcast(refs)
    kind = df.schema[id_col].dataType.simpleString()

    def make():
        c = _Counter()

        def run(keys, texts):
            cols = zip(*(_judge(t, x, shared.value, c) for t, x in zip(texts, keys[1].to_pylist(), strict=True)), strict=True)
            return {id_col: keys[0]} | {n: list(v) for n, v in zip(NAMES, cols, strict=True)}

        return run

    schema = f"`{id_col}` {kind}, " + ", ".join(f"{n} long" for n in NAMES[:5]) + ", js_class double, js_common double, base_failed boolean, kept boolean"
    return map_texts(df, [F.col(id_col), F.col(lang_col).cast("string")], text_col, make, schema)


def passes(refs: dict[str, np.ndarray], spark, text_col: str = "text", lang_col: str = "lang"):
    """The ``kept`` verdict as a column, evaluated beside the row, without a join."""
    shared = spark.sparkContext.broadcast(refs)

    @F.arrow_udf("boolean")
    def keep(texts: pa.Array, langs: pa.Array) -> pa.Array:
        c = _Counter()
        rows = (x for a, n in runs(texts) for x in zip(texts.slice(a, n).to_pylist(), langs.slice(a, n).to_pylist(), strict=True))
        return pa.array([_judge(t, x, shared.value, c)[-1] for t, x in rows], pa.bool_())

    return keep(F.col(text_col).cast("string"), F.col(lang_col).cast("string"))
