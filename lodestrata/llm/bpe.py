"""Byte-level BPE encoding and decoding with DuckDB recursive queries, inside each partition.

The rank table becomes a merge table (left id, right id, merged id). Token positions are rows
(word, position, token); a recursive query joins neighbouring rows with the merge table, takes
each word's smallest (rank, position) and contracts that pair, until no pair of the word is in
the table. Decoding joins token rows with the vocabulary and concatenates in order of position.

Only distinct pieces of a slice of texts reach the query, and pieces met before come from a
bounded memo, so the work follows the vocabulary and not the number of tokens.
"""

from __future__ import annotations

import base64
import tempfile
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_texts

#: Pieces kept in a worker's memo; it is emptied when full, which changes speed only.
MEMO = 300_000
#: Words sent to one recursive query hold about this many bytes in all (one word may be longer).
QUERY_BYTES = 400_000
#: Longer words contract all places of their smallest rank at once where that gives the same; a word where it does not goes one pair at a time.
LONG_WORD = 512
#: Recursion depth of one query over long words; the query repeats until nothing is left to merge.
LONG_DEPTH = 48

_ENCODE = """
WITH RECURSIVE s(i, w, p, t) AS (
  SELECT 0, w, p, t FROM start
  UNION ALL
  SELECT s.i + 1, s.w, CASE WHEN s.p > g.pos THEN s.p - 1 ELSE s.p END, CASE WHEN s.p = g.pos THEN g.best ELSE s.t END
  FROM s JOIN (
    SELECT a.w, (min((m.m::BIGINT << 32) | a.p) >> 32)::INT AS best, (min((m.m::BIGINT << 32) | a.p) & 4294967295)::INT AS pos
    FROM s a JOIN s b ON b.w = a.w AND b.p = a.p + 1 JOIN merges m ON m.l = a.t AND m.r = b.t
    GROUP BY a.w) g ON g.w = s.w
  WHERE s.p <> g.pos + 1
)
SELECT s.w, s.p, s.t FROM s JOIN (SELECT w, max(i) AS i FROM s GROUP BY w) f ON f.w = s.w AND f.i = s.i
ORDER BY s.w, s.p
"""

# All places of the smallest rank that do not overlap, from the left, contract in one step. That equals
# contracting them one by one unless a pair that arises on the way ranks below the one contracted: a
# new token with what stood to its right before the step (worse), or with what stands beside it after
# it, told by the smallest rank falling. Such a word (bad) is encoded anew, one pair at a time.
_ENCODE_LONG = f"""
WITH RECURSIVE s(i, w, p, t, prev, bad) AS (
  SELECT 0, w, p, t, prev, false FROM start
  UNION ALL
  SELECT i + 1, w, (row_number() OVER (PARTITION BY w ORDER BY p))::INT - 1, t, best, best < prev OR worse FROM (
    SELECT i, h.w, p, CASE WHEN hit THEN best ELSE t END AS t, best, prev, lag(hit, 1, false) OVER (PARTITION BY h.w ORDER BY p) AS gone, coalesce(bool_or(hit AND n.m < best) OVER (PARTITION BY h.w), false) AS worse FROM (
      SELECT *, m = best AND (p - min(p) OVER (PARTITION BY w, m = best, island)) % 2 = 0 AS hit FROM (
        SELECT *, p - row_number() OVER (PARTITION BY w, m IS NOT DISTINCT FROM best ORDER BY p) AS island FROM (
          SELECT x.*, m.m, min(m.m) OVER (PARTITION BY x.w) AS best
          FROM (SELECT *, lead(t) OVER (PARTITION BY w ORDER BY p) AS nt, lead(t, 2) OVER (PARTITION BY w ORDER BY p) AS nnt FROM s WHERE NOT bad) x
          LEFT JOIN merges m ON m.l = x.t AND m.r = x.nt))) h
    LEFT JOIN merges n ON h.hit AND n.l = h.best AND n.r = h.nnt)
  WHERE best IS NOT NULL AND i < {LONG_DEPTH} AND NOT coalesce(gone, false)
)
SELECT s.w, s.p, s.t, s.prev, s.bad, f.i AS depth FROM s JOIN (SELECT w, max(i) AS i FROM s GROUP BY w) f ON f.w = s.w AND f.i = s.i
ORDER BY s.w, s.p
"""

_DECODE = """
SELECT k.w, unhex(coalesce(string_agg(hex(v.b), '' ORDER BY k.p), '')) AS b
FROM ids k JOIN vocab v ON v.t = k.t GROUP BY k.w ORDER BY k.w
"""


def read_ranks(data: bytes) -> dict[bytes, int]:
    """A rank file's lines (base64 token, rank) as a dict."""
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines()) if a}


class Codec:
    """Encodes and decodes words by a rank table, through an in-memory DuckDB of its own."""

    def __init__(self, ranks: dict[bytes, int]):
        import duckdb

        if any(bytes([b]) not in ranks for b in range(256)):
            raise ValueError("the rank table must hold all 256 single bytes")
        self.ranks = ranks
        self.known = np.array(sorted(ranks.values()), np.int32)
        self.byte = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        self.scratch = tempfile.TemporaryDirectory(prefix="bpe-")  # where this worker's own queries spill; it goes with the object
        self.con = duckdb.connect(":memory:", config={"threads": 1, "memory_limit": "400MB", "temp_directory": self.scratch.name})
        triples = [(ranks[t[:c]], ranks[t[c:]], i) for t, i in ranks.items() for c in range(1, len(t)) if t[:c] in ranks and t[c:] in ranks]
        left, right, merged = (np.array(x, np.int32) for x in zip(*triples, strict=True)) if triples else (np.zeros(0, np.int32),) * 3
        self._table("merges", pa.table({"l": left, "r": right, "m": merged}))
        self._table("vocab", pa.table({"t": pa.array(list(ranks.values()), pa.int32()), "b": pa.array(list(ranks), pa.binary())}))

    def _table(self, name: str, rows: pa.Table) -> None:
        self.con.register("rows_in", rows)
        self.con.execute(f"CREATE OR REPLACE TABLE {name} AS SELECT * FROM rows_in")
        self.con.unregister("rows_in")

    def _run(self, query: str) -> pa.Table:
        return self.con.sql(query).to_arrow_table()

    def _positions(self, words: Sequence[bytes]) -> pa.Table:
        n = np.array([len(w) for w in words], np.int64)
        w = np.repeat(np.arange(len(words), dtype=np.int32), n)
        p = (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)).astype(np.int32)
        return pa.table({"w": w, "p": p, "t": self.byte[np.frombuffer(b"".join(words), np.uint8)]})

    def _short(self, words: Sequence[bytes]) -> tuple[np.ndarray, np.ndarray]:
        self._table("start", self._positions(words))
        got = self._run(_ENCODE)
        return got["t"].to_numpy().astype(np.int32), np.bincount(got["w"].to_numpy(), minlength=len(words))

    def _long(self, word: bytes) -> np.ndarray:
        rows = self._positions([word]).append_column("prev", pa.array(np.full(len(word), -1, np.int32)))
        while True:
            self._table("start", rows)
            got = self._run(_ENCODE_LONG)
            if got["bad"][0].as_py():
                return self._short([word])[0]
            if got["depth"][0].as_py() < LONG_DEPTH:
                return got["t"].to_numpy().astype(np.int32)
            rows = got.select(["w", "p", "t", "prev"])

    def encode(self, words: Sequence[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words one after another, number of ids of each word).

        A word that is itself a token is that token, as in the usual library.
        """
        whole = [self.ranks.get(w, -1) for w in words]
        ids = np.array(whole, np.int32)
        n = (ids >= 0).astype(np.int64)
        groups, size = [[]], 0
        for i in np.flatnonzero(ids < 0).tolist():
            if size >= QUERY_BYTES:
                groups.append([])
                size = 0
            if 0 < len(words[i]) <= LONG_WORD:
                groups[-1].append(i)
                size += len(words[i])
        done = []
        for g in groups:
            if g:
                flat, count = self._short([words[i] for i in g])
                n[g] = count
                done.append((np.array(g), flat))
        for i, w in enumerate(words):
            if len(w) > LONG_WORD and ids[i] < 0:
                flat = self._long(w)
                n[i] = len(flat)
                done.append((np.array([i]), flat))
        start = np.cumsum(n) - n
        out = np.empty(int(n.sum()), np.int32)
        out[start[ids >= 0]] = ids[ids >= 0]
        for g, flat in done:
            c = n[g]
            out[np.repeat(start[g] - (np.cumsum(c) - c), c) + np.arange(len(flat))] = flat
        return out, n

    def decode(self, flat: np.ndarray, n: np.ndarray) -> pa.Array:
        """Bytes of each id sequence, given as all ids and the number of ids of each; unknown ids raise."""
        if len(flat) and not np.isin(flat, self.known).all():
            raise ValueError("ids hold a token that the vocabulary lacks")
        p = (np.arange(len(flat)) - np.repeat(np.cumsum(n) - n, n)).astype(np.int32)
        self._table("ids", pa.table({"w": np.repeat(np.arange(len(n), dtype=np.int32), n), "p": p, "t": flat.astype(np.int32)}))
        got = self._run(_DECODE)["b"].combine_chunks()
        full = n > 0
        at = np.cumsum(full) - 1
        return pc.fill_null(got.take(pa.array(at, mask=~full)), b"")


class Memo:
    """Pieces met before: slots into one array of ids and one list of decoded bytes; emptied when full."""

    def __init__(self):
        self.slot: dict[str, int] = {}
        self.flat, self.n, self.decoded = np.zeros(0, np.int32), np.zeros(0, np.int64), pa.array([], pa.binary())

    def slots(self, codec: Codec, words: list[str]) -> np.ndarray:
        if len(self.slot) > MEMO:
            self.__init__()
        fresh = [w for w in words if w not in self.slot]
        if fresh:
            flat, n = codec.encode([w.encode() for w in fresh])
            self.decoded = pa.concat_arrays([self.decoded, codec.decode(flat, n)])
            self.slot.update(zip(fresh, range(len(self.slot), len(self.slot) + len(fresh)), strict=True))
            self.flat, self.n = np.concatenate([self.flat, flat]), np.concatenate([self.n, n])
        return np.fromiter(map(self.slot.__getitem__, words), np.int64, len(words))


_codecs: dict[int, tuple[Codec, Memo]] = {}


def _codec(data: bytes) -> tuple[Codec, Memo]:
    """One codec and memo for each rank table and worker process; they outlive a task."""
    if (key := hash(data)) not in _codecs:
        _codecs.clear()
        _codecs[key] = (Codec(read_ranks(data)), Memo())
    return _codecs[key]


def encode(df: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Token ids of every whole text and the bytes that they decode to: (id_col, ids, decoded).

    ``ranks_path`` is a rank file readable by the driver (about 1 MB; its bytes are broadcast) and
    ``pattern`` splits a text into pieces that are encoded separately, without special tokens. Each
    distinct piece is decoded from its own ids; a text's bytes are its pieces' bytes in order.

    Rows map one to one: a null text is an empty text, an empty text has no ids, repeated rows
    are repeated, a null id stays null, and an empty table gives no rows. Lone surrogates cannot
    occur in Spark strings. Other columns are ignored.
    """
    with open(ranks_path, "rb") as f:
        shared = df.sparkSession.sparkContext.broadcast(f.read())
    kind = df.schema[id_col].dataType.simpleString()

    def make():
        import regex

        split = regex.compile(pattern).findall
        codec, memo = _codec(shared.value)

        def run(keys, texts):
            pieces, counts = [], np.zeros(len(texts), np.int64)
            for i, t in enumerate(texts):
                if t:
                    found = split(t)
                    counts[i] = len(found)
                    pieces += found
            words = pa.array(pieces, pa.string()).dictionary_encode()
            del pieces
            at = memo.slots(codec, words.dictionary.to_pylist())[words.indices.to_numpy()]
            starts, long = np.cumsum(memo.n) - memo.n, memo.n[at]
            end = np.cumsum(long)
            tokens = memo.flat[np.repeat(starts[at] - (end - long), long) + np.arange(int(long.sum()))]
            rows = np.concatenate([[0], np.cumsum(counts)])
            total = np.concatenate([[0], end])[rows]
            joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(rows, pa.int32()), memo.decoded.take(pa.array(at))), b"")
            return {id_col: keys[0], "ids": pa.ListArray.from_arrays(pa.array(total, pa.int32()), pa.array(tokens, pa.int32())), "decoded": joined}

        return run

    return map_texts(df, [F.col(id_col)], text_col, make, f"`{id_col}` {kind}, ids array<int>, decoded binary")


def decode(df: DataFrame, ranks_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id_col, decoded): the bytes of each row's ids, by ordered aggregation; null ids give null."""
    with open(ranks_path, "rb") as f:
        shared = df.sparkSession.sparkContext.broadcast(f.read())
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches):
        codec, _ = _codec(shared.value)
        for b in batches:
            lists = b.column(1).to_pylist()
            ids = [np.array(x or [], np.int32) for x in lists]
            got = codec.decode(np.concatenate(ids) if ids else np.zeros(0, np.int32), np.array([len(x) for x in ids], np.int64))
            out = [None if x is None else v for x, v in zip(lists, got.to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], names=[id_col, "decoded"])

    return df.select(F.col(id_col), F.col(ids_col).cast("array<int>")).mapInArrow(run, f"`{id_col}` {kind}, decoded binary")
