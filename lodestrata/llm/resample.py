"""Importance resampling towards a target: hashed word n-grams, counted by a vectorised byte automaton.

A slice of texts stays the bytes of its Arrow buffer. A lookup table tells word bytes from others
and folds case; words begin and end where that changes. The CRCs of all words advance together,
one byte of each a step, and go on from a word's predecessors through a blank and its own bytes,
so that runs of two and three words cost no more steps than single words.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import FOLD, buffers, cut, numbered, runs, spans

BUCKETS, MAX_N = 10_000, 3
#: Bytes of text whose words advance together (one text may be longer).
SLICE = 500_000
#: Words go on by themselves after so many bytes.
STEPS = 64

_ALL = np.uint32(0xFFFFFFFF)


def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1)
    return table


_TABLE, _FOLD = _crc_table(), np.frombuffer(FOLD, np.uint8)


def _step(state: np.ndarray, byte: np.ndarray | int) -> np.ndarray:
    return _TABLE[(state ^ byte) & np.uint32(255)] ^ (state >> np.uint32(8))


class Words:
    """The words of a slice, shortest first, with their bytes by step."""

    def __init__(self, data: np.ndarray, start: np.ndarray, end: np.ndarray):
        size = np.minimum(end - start, STEPS + 1).astype(np.uint16)
        self.data, self.start, self.end = data, start, end
        self.order = np.argsort(size, kind="stable")
        begin, size = start[self.order], size[self.order]
        self.from_ = np.searchsorted(size, np.arange(min(STEPS, int(size[-1]) if len(size) else 0)), "right")
        self.bytes = [data[begin[lo:] + k] for k, lo in enumerate(self.from_)]
        self.long = np.flatnonzero(end - start > STEPS)

    def advance(self, state: np.ndarray) -> np.ndarray:
        """Each word's state, after the bytes of the word."""
        s = state[self.order]
        for lo, byte in zip(self.from_, self.bytes, strict=True):
            s[lo:] = _step(s[lo:], byte)
        out = np.empty_like(s)
        out[self.order] = s
        for i in self.long.tolist():
            out[i] = np.uint32(zlib.crc32(self.data[self.start[i] + STEPS : self.end[i]], int(out[i] ^ _ALL))) ^ _ALL
        return out


def features(texts: pa.Array, buckets: int = BUCKETS, max_n: int = MAX_N) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """(words of each row, for n of 1 to max_n: rows and buckets of all runs of n words)."""
    raw, at = buffers(texts)
    data = _FOLD[raw]
    start, end, row = spans(data != 32, at)
    words, out = Words(data, start, end), []
    state = np.full(len(start), _ALL)
    for n in range(1, max_n + 1):
        state = words.advance(state)
        same = row[n - 1 :] == row[: len(row) - n + 1]
        out.append((row[n - 1 :][same], (state[n - 1 :][same] ^ _ALL) % np.uint32(buckets)))
        state = np.concatenate([state[:1], _step(state[:-1], 32)])  # a run that ends with word j goes on with word j + 1
    return np.bincount(row, minlength=len(texts)), out


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for start, n in runs(b.column("_text"), SLICE):
            yield b.slice(start, n)


def bucket_counts(df: DataFrame, text_col: str = "text", buckets: int = BUCKETS, max_n: int = MAX_N) -> np.ndarray:
    """How many features of all texts fall into each bucket; one row a bucket reaches the driver."""

    def run(batches):
        total = np.zeros(buckets, np.int64)
        for b in _slices(batches):
            for _, found in features(b.column("_text"), buckets, max_n)[1]:
                total += np.bincount(found, minlength=buckets)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.int64()), pa.array(total[held])], ["bucket", "n"])

    rows = df.select(F.col(text_col).cast("string").alias("_text")).mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(buckets, np.int64)
    for r in rows.collect():
        out[r["bucket"]] = r["n"]
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln((t + 1) (S + buckets) / ((s + 1) (T + buckets)))) of each bucket, in doubles."""
    n, s_all, t_all = float(len(source)), float(source.sum()), float(target.sum())
    return np.array([math.floor(1000 * math.log((t + 1.0) * (s_all + n) / ((s + 1.0) * (t_all + n)))) for s, t in zip(source.tolist(), target.tolist(), strict=True)], np.int64)


def weigh(df: DataFrame, gain: np.ndarray, id_col: str = "doc_id", text_col: str = "text", max_n: int = MAX_N) -> DataFrame:
    """(id_col, n_words, n_features, weight), one row per row; weight is the sum of the gains of the text's features."""
    shared, kind = df.sparkSession.sparkContext.broadcast(gain), df.schema[id_col].dataType.simpleString()

    def run(batches):
        gain = shared.value.astype(np.float64)  # sums of whole numbers, exact below 2^53
        for b in _slices(batches):
            words, found = features(b.column("_text"), len(gain), max_n)
            n, weight = np.zeros(len(words), np.int64), np.zeros(len(words))
            for row, bucket in found:
                n += np.bincount(row, minlength=len(words))
                weight += np.bincount(row, weights=gain[bucket], minlength=len(words))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(words.astype(np.int64)), pa.array(n), pa.array(weight.astype(np.int64))], [id_col, "n_words", "n_features", "weight"])

    return df.select(F.col(id_col), F.col(text_col).cast("string").alias("_text")).mapInArrow(run, f"`{id_col}` {kind}, n_words long, n_features long, weight long")


def resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_text: str = "text", percent: int = 5, least_words: int = 20, seed: str = "42") -> DataFrame:
    """(id_col, n_words, n_features, weight, score, rank), one row per row.

    Draws ``percent`` of a hundred of the documents with at least ``least_words`` words, without
    replacement, by their weight and Gumbel noise from a hash of ``seed`` and id: rank is 1, 2, ...
    by score, ties to the smaller id (a null id last, its noise that of an empty id), null if not
    drawn. A null or empty text has no features, weight 0 and no rank. Repeated rows are weighed and
    may be drawn each by itself; an empty table gives no rows, an empty target has no features;
    other columns are ignored.
    """
    gain = gains(bucket_counts(docs, text_col), bucket_counts(target, target_text))
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))
    scored = cut(weigh(docs, gain, id_col, text_col).withColumn("score", F.col("weight") + noise))
    able = scored.where(F.col("n_words") >= least_words)
    drawn = numbered(able, [F.col("score").desc(), F.col(id_col).asc_nulls_last()], "rank")
    drawn = drawn.withColumn("rank", F.when(F.col("rank") <= percent * able.count() // 100, F.col("rank")))
    return drawn.union(scored.where(F.col("n_words") < least_words).withColumn("rank", F.lit(None).cast("long")))
