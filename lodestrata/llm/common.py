"""What several operators share: text slices in Arrow batches, checkpoints, components."""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Texts handed to Python code together hold about this many bytes at most (one text may be longer).
SLICE_CHARS = 2_000_000

#: The six bytes that separate words in the word contracts: space and \t\n\v\f\r.
SPACES = b" \t\n\x0b\x0c\r"
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))

#: Byte by byte: A-Z lower-cased, digits, a-z and non-ASCII characters as they are, every other byte a blank.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def ascii_lower(text: str) -> bytes:
    """UTF-8 bytes with A-Z lower-cased and every other character as it was."""
    return text.encode("utf-8", "surrogatepass").translate(_LOWER)


def words_of(data: bytes) -> list[bytes]:
    """Runs of bytes that are none of SPACES (bytes.split() splits at exactly these six)."""
    return data.split()


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; only a local master may go on without it, in a folder of its own."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        shared = tempfile.mkdtemp(prefix="lodestrata-checkpoints-")
    return shared.rstrip("/")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(spark))


def cut(df: DataFrame) -> DataFrame:
    """The rows, written once to the reliable checkpoint folder; lineage ends there."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def slices(batch: pa.RecordBatch, text: str) -> Iterator[tuple[pa.RecordBatch, list]]:
    """Cut a batch into runs of rows with about SLICE_CHARS bytes of text, with their texts as a list.

    Lengths are read from the batch, so only one run's texts are Python strings at a time.
    """
    column = batch.column(batch.schema.get_field_index(text))
    for start, n in runs(column):
        yield batch.slice(start, n), column.slice(start, n).to_pylist()


def runs(texts: pa.Array, chars: int = SLICE_CHARS) -> Iterator[tuple[int, int]]:
    """(start, rows) of runs with about ``chars`` bytes."""
    if len(texts):
        size = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        ends = np.flatnonzero(np.diff(size // chars)) + 1
        for a, b in zip([0, *ends.tolist()], [*ends.tolist(), len(texts)], strict=True):
            yield a, b - a


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, n + 1 offsets) of a string array, without copying the bytes; a null is empty."""
    wide = pa.types.is_large_string(texts.type)
    _, at, data = texts.buffers()
    at = np.frombuffer(at, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64) if at is not None and at.size else np.zeros(1, np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8))[at[0] : at[-1]], at - at[0]


def spans(inside: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, row) of the runs of true bytes; ``at`` holds the rows' offsets, which no run crosses."""
    change = np.zeros(len(inside) + 1, bool)
    change[1:-1] = inside[1:] != inside[:-1]
    change[at] = True
    edges = np.flatnonzero(change)
    start, end = edges[:-1], edges[1:]
    kept = inside[start]
    start, end = start[kept], end[kept]
    return start, end, np.searchsorted(at, start, "right") - 1


def map_texts(df: DataFrame, keys: list[Column], text: str, make: Callable[[], Callable], schema: str) -> DataFrame:
    """Apply ``make()(key_arrays, texts) -> dict of columns`` to slices of rows, in Arrow batches.

    ``make`` runs once per task. Only the keys and the text leave the scan, so other columns,
    whatever their names, are neither read nor in the way.
    """
    from pyspark.sql.types import StructType
    from pyspark.sql.pandas.types import to_arrow_schema

    picked = df.select(*[k.alias(f"_k{i}") for i, k in enumerate(keys)], F.col(text).cast("string").alias("_text"))
    kind = StructType.fromDDL(schema)
    names, n_keys = kind.names, len(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fn, out = make(), to_arrow_schema(kind)
        for batch in batches:
            for part, texts in slices(batch, "_text"):
                got = fn([part.column(i) for i in range(n_keys)], texts)
                arrays = [got[n] if isinstance(got[n], pa.Array) else pa.array(got[n], out.field(n).type) for n in names]
                arrays = [a if a.type == out.field(n).type else a.cast(out.field(n).type) for a, n in zip(arrays, names, strict=True)]
                yield pa.RecordBatch.from_arrays(arrays, schema=out)

    return picked.mapInArrow(run, schema)


#: Rows of a range of ``numbered``.
RANGE_ROWS = 500_000


def numbered(df: DataFrame, order: list, name: str) -> DataFrame:
    """1, 2, ... over all rows by a total order; no task holds them all.

    Rows are dealt out in ranges of the order and sorted there, so the number of a row is its number
    in its range and the counts of the ranges before; those counts, one a range, are all that
    reaches the driver.
    """
    spark = df.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-df.count() // RANGE_ROWS))
    at = F.monotonically_increasing_id()  # number of the range, then 33 bits of the number in it
    placed = cut(df.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("_at", at))
    part, before, starts = F.shiftright("_at", 33), 0, []
    for p, n in sorted(map(tuple, placed.groupBy(part.alias("p")).count().collect())):
        starts.append((p, before))
        before += n
    starts = F.broadcast(spark.createDataFrame(starts, "_p long, _before long"))
    x = placed.withColumn("_p", part.cast("long")).join(starts, "_p")
    return x.select(*df.columns, (F.col("_before") + F.col("_at").bitwiseAND((1 << 33) - 1) + 1).alias(name))


#: A key is hot from this many rows, and from this share of all rows; so there are at most HOT_KEYS hot keys.
HOT_ROWS, HOT_KEYS = 1_000, 2_000


def left_join_skewed(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Left join with a side that holds each key once, where a key may hold any share of the left rows.

    The hot keys' right rows, at most HOT_KEYS, are broadcast; rows with a null key go around the
    shuffle; the rest is joined as usual. ``left`` is read three times: cut it first.
    """
    added = [c for c in right.columns if c not in keys]
    none = F.lit(False)
    for k in keys:
        none = none | F.col(k).isNull()
    known = left.where(~none)
    count = known.groupBy(*keys).agg(F.count("*").alias("_n"))
    hot = cut(count.where(F.col("_n") >= F.greatest(F.lit(HOT_ROWS), F.lit(left.count() / HOT_KEYS))).select(*keys))
    out = known.join(F.broadcast(hot), keys, "left_anti").join(right, keys, "left").select(*left.columns, *added)
    out = out.union(known.join(F.broadcast(hot.join(right, keys, "left")), keys).select(*left.columns, *added))
    return out.union(left.where(none).select(*left.columns, *[F.lit(None).cast(right.schema[c].dataType).alias(c) for c in added]))


#: Small edge lists are kept in few files: one for about this many edges.
EDGES_A_PART = 200_000


def components(edges: DataFrame, a: str, b: str, max_rounds: int = 60) -> DataFrame:
    """Connected components: (node, component) for each node with an edge; component is the smallest node.

    Alternates large-star and small-star steps (Kiveris et al. 2014). Each round is two
    shuffles of at most one row per edge, so a hub with millions of neighbours stays a set of
    rows; the minimum per node is found by partial aggregation and joined back. Rounds end when
    the edges no longer change. Null ends and self-loops are left out.
    """
    e = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u is not null and v is not null and u <> v").distinct()
    e = cut(e)
    before = None
    for _ in range(max_rounds):
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before or not now[0]:
            break
        before = now
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        nxt = small.union(low.select("u", F.col("m").alias("v"))).distinct()
        e = cut(nxt.coalesce(max(1, now[0] // EDGES_A_PART)) if now[0] < EDGES_A_PART * 100 else nxt)
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(e.select("v", "v").distinct())
