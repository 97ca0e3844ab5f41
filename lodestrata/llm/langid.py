"""Language identification with error-correcting output codes over byte n-gram classifiers.

Each language has a codeword of bits. One linear classifier per bit is fitted by ridge regression
on hashed byte n-grams of a bounded sample of labelled documents; a text's language is the one
whose codeword has the least loss, each bit weighted by how well its classifier separates.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import map_texts, runs

DIM = 4096
#: ASCII bytes other than letters become spaces, so digits, symbols and layout say nothing.
_TABLE = bytes(c if c >= 128 or 97 <= c <= 122 else 32 for c in range(256))
#: Snippets of this many bytes are added to the sample, so that short texts are known too.
SNIPPET = 48


def features(text: str) -> np.ndarray:
    """Unit vector of square roots of hashed 1-, 2- and 3-gram counts of the whole lower-cased text."""
    return _features(text.lower().encode("utf-8", "surrogatepass").translate(_TABLE))


def _features(data: bytes) -> np.ndarray:
    b = np.frombuffer(b" " + data + b" ", np.uint8)
    b = b[~((b == 32) & (np.concatenate([[0], b[:-1]]) == 32))].astype(np.int32)
    two = b[:-1] * 257 + b[1:]
    three = (two[:-1] * 263 + b[2:]) * 40503 >> 5
    x = np.bincount(np.concatenate([b, two * 31 >> 2 & DIM - 1, three & DIM - 1]), minlength=DIM).astype(np.float32)
    np.sqrt(x, out=x)
    return x / max(float(np.sqrt(x @ x)), 1e-9)


def codewords(n: int) -> np.ndarray:
    """One row of -1 and 1 for each of n languages: all splits up to 5, else the best of random codes."""
    if n <= 5:
        return np.array([[1 if b >> i & 1 else -1 for b in range(1, 2 ** (n - 1))] for i in range(n)], np.float64).reshape(n, -1)
    rng, best = np.random.default_rng(n), None
    for _ in range(100):
        m = rng.choice([-1.0, 1.0], (n, int(np.ceil(10 * np.log2(n)))))
        gap = min((m[i] != m[j]).sum() for i in range(n) for j in range(i))
        if best is None or gap > best[0]:
            best = gap, m
    return best[1]


@dataclass
class Model:
    langs: list[str]
    code: np.ndarray
    weight: np.ndarray
    bit_weight: np.ndarray

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """Language, confidence from 0 to 1, and whether the two nearest codewords are close."""
        if not self.langs or not text or not any(map(str.isalpha, text)):
            return "und", 0.0, True
        if len(self.langs) == 1:
            return self.langs[0], 1.0, False
        f = features(text) @ self.weight
        loss = (self.bit_weight * np.maximum(0.0, 1.0 - self.code * f)).sum(1)
        first, second = np.argsort(loss, kind="stable")[:2]
        margin = float((loss[second] - loss[first]) / max(loss[second] + loss[first], 1e-9))
        return self.langs[first], min(1.0, max(0.0, margin)), margin < 0.1


def train(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = 240, max_langs: int = 500) -> Model:
    """Fit on at most ``sample`` labelled documents, as many for each language (their whole texts).

    The sample is the documents with the smallest hashes of their ids. Feature vectors are made
    on the executors; four for each sampled document, of DIM half floats, reach the driver.
    Rows whose text or language is null are left out; no labelled row gives a model that says
    ``und``. Beyond ``max_langs`` languages those with the most documents (ties by name) are learned.
    """
    known = df.where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull())
    counts = known.groupBy(F.col(lang_col).alias("lang")).count().orderBy(F.desc("count"), "lang").limit(max_langs).collect()
    langs = sorted(r["lang"] for r in counts)
    if not langs:
        return Model([], np.zeros((0, 0)), np.zeros((DIM, 0)), np.zeros(0))
    per_lang = max(2, sample // len(langs))
    key = F.pmod(F.xxhash64(F.coalesce(F.col(id_col).cast("string"), F.lit(""))), F.lit(1 << 40))
    shares = F.create_map(*[F.lit(x) for r in counts for x in (r["lang"], float(2 * per_lang / r["count"] + 1e-6))])
    share = F.coalesce(F.try_element_at(shares, F.col(lang_col)), F.lit(0.0))
    some = known.where(key < share * float(1 << 40))

    def make():
        def run(keys, texts):
            return {"k": keys[0], "lang": keys[1], "x": [_sample(t) for t in texts]}

        return run

    rows = map_texts(some, [key, F.col(lang_col)], text_col, make, "k long, lang string, x array<binary>")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("k", "x"))
    got = rows.withColumn("rank", rank).where(F.col("rank") <= per_lang).select("lang", "k", "x").collect()
    got.sort(key=lambda r: (r["lang"], r["k"], r["x"]))
    x = np.empty((sum(len(r["x"]) for r in got), DIM), np.float32)
    for i, v in enumerate(v for r in got for v in r["x"]):
        x[i] = np.frombuffer(v, np.float16)
    y = np.array([langs.index(r["lang"]) for r in got for _ in r["x"]])
    if not len(x):
        return Model([], np.zeros((0, 0)), np.zeros((DIM, 0)), np.zeros(0))
    code = codewords(len(langs))
    target = code[y]
    gram = (x @ x.T).astype(np.float64)
    alpha = np.linalg.solve(gram + 0.3 * np.eye(len(x)), target)
    fit = gram @ alpha
    quality = np.clip((np.sign(fit) == target).mean(0) * 2 - 1, 0.05, 1.0) if code.shape[1] else np.zeros(0)
    return Model(langs, code, (x.T @ alpha).astype(np.float32), quality)


def _sample(text: str) -> list[bytes]:
    data = text.lower().encode("utf-8", "surrogatepass").translate(_TABLE)
    at = [0, len(data) // 3, 2 * len(data) // 3] if len(data) > 3 * SNIPPET else []
    return [_features(d).astype(np.float16).tobytes() for d in [data, *(data[i : i + SNIPPET] for i in at)]]


def identify(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", keep: tuple[Column, ...] = ()) -> DataFrame:
    """(id_col, lang_pred, score, ambiguous), one row per row.

    A text that is null or holds no letter is ``und`` with score 0. Of languages at equal loss the
    first by name is predicted, with score 0. Repeated rows and null ids stay as they are; an empty table gives no rows; other columns are ignored.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)
    kind = df.schema[id_col].dataType.simpleString()

    def make():
        m = shared.value

        def run(keys, texts):
            lang, score, flag = zip(*map(m.predict, texts), strict=True)
            return {id_col: keys[0], "lang_pred": list(lang), "score": list(score), "ambiguous": list(flag)}

        return run

    return map_texts(df, [F.col(id_col)], text_col, make, f"`{id_col}` {kind}, lang_pred string, score double, ambiguous boolean")


def told(model: Model, spark, text_col: str, min_score: float) -> Column:
    """Whether a row's language is told with at least ``min_score``; evaluated beside the row, without a join."""
    shared = spark.sparkContext.broadcast(model)

    def one(t):
        lang, score, _ = shared.value.predict(t)
        return lang != "und" and score >= min_score

    @F.arrow_udf("boolean")
    def keep(texts: pa.Array) -> pa.Array:
        return pa.array([one(t) for a, n in runs(texts) for t in texts.slice(a, n).to_pylist()], pa.bool_())

    return keep(F.col(text_col).cast("string"))


def held_out(id_col: str = "doc_id") -> Column:
    """Documents that no model may learn from: crc32 of the id as text, modulo 4, is 2 (a null id: '')."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 4 == 2
