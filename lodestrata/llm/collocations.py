"""Phrase collocations by suffix sorting: one row for each word, sorted so that equal phrases meet.

Every word gives one row: its language and the text from it to the end of its piece, cut after
max_n words. Rows are dealt by language and first word and sorted in descending order; all that
begin with a phrase then stand together, and one stack of open phrases counts every prefix of
every row in a single pass. The parts of the phrases found are joined to them afterwards.
"""

from __future__ import annotations

from collections.abc import Iterator
from urllib.parse import quote

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import _LOWER, buffers, cut, left_join_skewed, numbered, runs, spans

MAX_N, LEAST, TOP = 4, 30, 2_000
#: Bytes of text of one language whose equal suffixes are counted together before the shuffle.
SLICE = 2_000_000
#: First words are hot that begin this share of the words of a sample of about so many documents; so are
#: pairs and triples. The sample decides how rows are dealt to tasks, never what is counted.
HOT_SHARE, SAMPLE = 1 / 1_000, 4_000

_WORD, _BLANK, _BREAK = 0, 1, 2
_CLASS = np.array([_BREAK if c in b".,;:!?\n\x0b\x0c\r" else _BLANK if c in b" \t" else _WORD for c in range(256)], np.uint8)
_FOLD = np.frombuffer(_LOWER, np.uint8)


def _ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... for size[0] numbers, then those of start[1], and so on."""
    end = np.cumsum(size)
    total = int(end[-1]) if len(end) else 0
    kind = np.int32 if total + int(start.max(initial=0)) < 2**31 else np.int64  # half the memory where it fits
    out = np.repeat((start - (end - size)).astype(kind), size)
    out += np.arange(total, dtype=kind)
    return out


def suffixes(texts: pa.Array, head: bytes, max_n: int = MAX_N) -> pa.Array:
    """For each word of the texts: head, then up to max_n words from it on in its piece, each with a blank after it."""
    raw, at = buffers(texts)
    kind = _CLASS[raw]
    start, end, row = spans(kind == _WORD, at)
    size = end - start + 1
    stop = np.cumsum(size)
    line = np.full(int(stop[-1]) if len(stop) else 0, 32, np.uint8)
    where = _ranges(stop - size, size - 1)
    line[where] = _FOLD[raw[_ranges(start, size - 1)]]
    breaks = np.cumsum(kind == _BREAK)
    piece = row + (breaks[start] if len(start) else np.zeros(0, np.int64))  # grows with rows and with breaks
    last = np.searchsorted(piece, piece, "right")
    upto = stop[np.minimum(np.arange(len(start)) + max_n, last) - 1] if len(start) else stop
    begin, n = stop - size, len(head)
    length = upto - begin
    offset = np.concatenate([[0], np.cumsum(length + n)])
    out = np.empty(int(offset[-1]), np.uint8)
    for i, c in enumerate(head):
        out[offset[:-1] + i] = c
    out[_ranges(offset[:-1] + n, length)] = line[_ranges(begin, length)]
    return pa.Array.from_buffers(pa.large_string(), len(start), [None, pa.py_buffer(offset.astype(np.int64)), pa.py_buffer(out)])


def _near_order(keys: pa.Array, skip: int) -> np.ndarray:
    """An order by the eight bytes after ``skip``: rows with much in common stand together in shuffle files."""
    data, at = buffers(keys)
    data = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.lib.stride_tricks.sliding_window_view(data, 8)[at[:-1] + skip]
    return np.argsort(np.ascontiguousarray(eight).view(">u8")[:, 0].astype(np.uint64), kind="stable")


def _counted(batches: Iterator[pa.RecordBatch], max_n: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        langs = b.column("_lang").dictionary_encode()
        for i, lang in enumerate(langs.dictionary.to_pylist()):
            head = f"{quote(lang, safe='')}\n".encode()
            texts = b.column("_text").filter(pc.equal(langs.indices, i))
            for start, n in runs(texts, SLICE):
                found = suffixes(texts.slice(start, n), head, max_n).value_counts()
                order = _near_order(found.field("values"), len(head))
                for k in range(0, len(order), 100_000):
                    part = found.take(pa.array(order[k : k + 100_000]))
                    yield pa.RecordBatch.from_arrays([part.field("values").cast(pa.string()), part.field("counts")], ["key", "c"])


class PrefixStack:
    """Counts prefixes of rows in descending order; what is open after a batch goes on in the next.

    Open are the last row's prefixes of 0 (the language) to max_n words, with what was counted
    of each. A prefix closes when a row no longer begins with it.
    """

    def __init__(self, max_n: int, least: int):
        self.max_n, self.least = max_n, least
        self.open: list[tuple[str, int, bool]] = []
        self.last = None

    def _depths(self, keys: pa.Array) -> np.ndarray:
        """Byte length of each row's prefixes of 0 to max_n words, and of no more where it has fewer."""
        data, at = buffers(keys)
        n = len(keys)
        newline = np.flatnonzero(data == 10)  # one a row, after the language
        blank = np.flatnonzero(data == 32)
        row = np.searchsorted(at, blank, "right") - 1
        number = np.arange(len(blank)) - np.searchsorted(row, np.arange(n))[row]
        ends = np.full((n, self.max_n + 1), -1, np.int64)
        ends[:, 0] = newline + 1 - at[:-1]
        ends[row, number + 1] = blank + 1 - at[row]
        return ends

    @staticmethod
    def _common(keys: pa.Array) -> np.ndarray:
        """How many first bytes each row has in common with the row before; 0 for the first."""
        data, at = buffers(keys)
        size = np.diff(at)
        data = np.concatenate([data, np.zeros(8, np.uint8)])
        eight = np.ndarray((len(data) - 7,), "<u8", data, 0, (1,))
        most = np.minimum(size[1:], size[:-1])
        same = np.zeros(len(keys), np.int64)
        todo = np.arange(1, len(keys))
        while len(todo):
            k = same[todo]
            differ = eight[at[todo] + k] ^ eight[at[todo - 1] + k]
            low = differ & (~differ + np.uint64(1))
            step = np.where(differ == 0, 8, (np.log2(np.maximum(low, 1).astype(np.float64)) // 8).astype(np.int64))
            same[todo] = np.minimum(k + step, most[todo - 1])
            todo = todo[(step == 8) & (same[todo] < most[todo - 1])]
        return same

    def push(self, keys: pa.Array, counts: np.ndarray, hot: np.ndarray) -> list[tuple[list[str], list[int]]]:
        """(prefixes, counts) that closed; hot: how many of the row's shortest prefixes count wherever they stand."""
        carried = self.last is not None
        if carried:  # the row before, so that what it has in common with the first is found
            keys = pa.concat_arrays([pa.array([self.last], keys.type), keys])
            counts, hot = np.concatenate([[0], counts]), np.concatenate([[0], hot])
        ends, common = self._depths(keys), self._common(keys)
        data, at = buffers(keys)
        out, still = [], []
        for j in range(self.max_n + 1):
            rows = np.flatnonzero(ends[:, j] >= 0)
            if not len(rows):
                still.append(None)
                continue
            heads = np.flatnonzero(common[rows] < ends[rows, j])
            if not len(heads) or heads[0]:
                heads = np.concatenate([[0], heads])
            total = np.add.reduceat(counts[rows], heads)
            always = np.logical_or.reduceat(hot[rows] >= j, heads)
            if carried and rows[0] == 0 and self.open[j]:
                total[0] += self.open[j][1]
                always[0] |= self.open[j][2]
            goes_on = rows[-1] == len(keys) - 1  # a shorter last row has closed what is longer
            closed = len(heads) - goes_on
            kept = np.flatnonzero((total[:closed] >= self.least) | always[:closed])
            first = rows[heads[kept]]
            out.append(([data[at[i] : at[i] + ends[i, j]].tobytes().decode() for i in first.tolist()], total[kept].tolist()))
            if goes_on:
                i = rows[heads[-1]]
                still.append((data[at[i] : at[i] + ends[i, j]].tobytes().decode(), int(total[-1]), bool(always[-1])))
            else:
                still.append(None)
        self.open, self.last = still, keys[-1].as_py()
        return out

    def close(self) -> tuple[list[str], list[int]]:
        left = [x for x in self.open if x and (x[1] >= self.least or x[2])]
        return [x[0] for x in left], [x[1] for x in left]


def _prefix(words: int) -> Column:
    """The language and the first words of a key; the whole key, which ends with a blank, if it has fewer."""
    return F.substring_index("key", " ", words)


def _hot(counted: DataFrame, max_n: int) -> list[str]:
    """The phrases that begin at least HOT_SHARE of the words, at most max_n / HOT_SHARE."""
    least = (counted.agg(F.sum("c")).first()[0] or 0) * HOT_SHARE
    phrases = counted.select("c", F.explode(F.array_distinct(F.array(*map(_prefix, range(1, max_n + 1))))).alias("p")).where(~F.col("p").endswith(" "))
    return [r["p"] for r in phrases.groupBy("p").agg(F.sum("c").alias("n")).where(F.col("n") >= least).collect()]


def frequencies(df: DataFrame, lang_col: str = "lang", text_col: str = "text", max_n: int = MAX_N, least: int = LEAST) -> DataFrame:
    """(key, f): every phrase of 1 to max_n words with f >= least, and each language alone with all its words.

    A key is the language, percent-encoded, and a line feed, then the phrase's words with a blank
    after each. Rows that begin with a hot phrase are dealt by their first prefix that is not hot,
    and by their count if all are; what several tasks count of a hot phrase is added up. So a
    phrase is counted whole in one task, or else by every task that sees it.
    """
    texts = df.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("_lang"), F.col(text_col).cast("string").alias("_text")).where("_text is not null")
    counted = lambda t: t.mapInArrow(lambda batches: _counted(batches, max_n), "key string, c long")
    share = min(1.0, SAMPLE / max(1, df.count()))
    hot = _hot(cut(counted(texts.sample(share, 1) if share < 1 else texts)), max_n)
    depth = F.lit(max_n)
    for j in range(max_n, 0, -1):
        depth = F.when(_prefix(j).isin(hot), depth).otherwise(j - 1)
    deal = F.expr("substring_index(key, ' ', cast(v % 8 as int) + 1)")
    rows = counted(texts).select("key", (F.col("c") * 8 + depth).alias("v"))
    rows = rows.repartition(F.when(deal.endswith(" "), F.concat("key", F.col("v").cast("string"))).otherwise(deal)).sortWithinPartitions(F.col("key").desc())

    def run(batches):
        stack = PrefixStack(max_n, least)
        for b in batches:
            if b.num_rows:
                v = b.column(1).to_numpy()
                for keys, n in stack.push(b.column(0), v >> 3, v & 7):
                    yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(n, pa.int64())], ["key", "f"])
        keys, n = stack.close()
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(n, pa.int64())], ["key", "f"])

    return rows.mapInArrow(run, "key string, f long").groupBy("key").agg(F.sum("f").alias("f")).where((F.col("f") >= least) | F.col("key").endswith("\n"))


def _sub(first: str, words: str) -> str:
    return f"concat(lang, '\n', array_join(slice(w, {first}, {words}), ' '), ' ')"


def mine(df: DataFrame, lang_col: str = "lang", text_col: str = "text", max_n: int = MAX_N, least: int = LEAST, top: int = TOP) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the ``top`` phrases of 2 to max_n words of each language.

    a, l and r are the occurrences of the phrase and of its two parts at its lowest-scoring cut, n
    the words of the language. Phrases inside a longer one that has 80 of a hundred of their
    occurrences are left out. A null language is ``und``, as is a language of that name; a null or
    empty text has no words; repeated rows count each; an empty table gives no rows; other columns
    are ignored. Ties go to the larger a, then to the smaller phrase by its bytes.
    """
    found = cut(frequencies(df, lang_col, text_col, max_n, least))
    total = found.where(F.col("key").endswith("\n")).select(F.substring_index("key", "\n", 1).alias("lang"), F.col("f").alias("n"))
    split = found.select("key", F.col("f").alias("a"), F.substring_index("key", "\n", 1).alias("lang"), F.split(F.rtrim(F.substring_index("key", "\n", -1)), " ").alias("w"))
    able = cut(split.withColumn("m", F.size("w")).where("m >= 2"))
    both = f"flatten(transform(sequence(1, m - 1), k -> array(struct(2 * k as role, {_sub('1', 'k')} as part), struct(2 * k + 1 as role, {_sub('k + 1', 'm - k')} as part))))"
    parts = left_join_skewed(cut(able.select("key", F.expr(f"inline({both})"))), found.select(F.col("key").alias("part"), "f"), ["part"])
    parts = parts.groupBy("key").agg(F.map_from_entries(F.collect_list(F.struct("role", "f"))).alias("p"))
    cuts = "array_min(transform(sequence(1, m - 1), k -> struct(cast(a as decimal(20, 0)) * 2000000 div (p[2 * k] + p[2 * k + 1]) as score, k, p[2 * k] as l, p[2 * k + 1] as r)))"
    inner = f"flatten(transform(sequence(2, m - 1), z -> transform(sequence(1, m - z + 1), i -> {_sub('i', 'z')})))"
    longer = able.where("m > 2").select(F.explode(F.expr(inner)).alias("key"), F.col("a").alias("f")).groupBy("key").agg(F.max("f").alias("longest"))
    kept = able.join(parts, "key").join(longer, "key", "left").where("longest is null or 100 * longest < 80 * a")
    kept = kept.select("lang", F.array_join("w", " ").alias("phrase"), "a", F.expr(cuts).alias("cut")).select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")
    placed = cut(numbered(cut(kept), ["lang", F.desc("score"), F.desc("a"), "phrase"], "number"))
    of = cut(placed.groupBy("lang").agg(F.min("number").alias("first")).join(total, "lang"))
    best = left_join_skewed(placed, of, ["lang"]).withColumn("rank", F.col("number") - F.col("first") + 1).where(F.col("rank") <= top)
    return best.select(F.url_decode("lang").alias("lang"), "rank", "phrase", "a", "l", "r", "n", "score")
