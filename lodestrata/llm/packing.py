"""Variable-capacity best-fit packing of token sequences into bins of several permitted lengths."""

from __future__ import annotations

from itertools import combinations, product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Permitted sequence lengths.
CAPACITIES = (512, 1024, 2048)
#: Pieces that one packing group holds on average.
GROUP = 40_000
#: Equal rows that are numbered in one step.
NUMBERED = 10_000


def cost(capacity: int) -> float:
    """Cost of training on one sequence: linear work, attention work, and a fixed part for each sequence."""
    return capacity + capacity * capacity / 16384 + 8


def _fill(lengths: np.ndarray, capacities: tuple[int, ...], opens) -> tuple[np.ndarray, list[int]]:
    """Best fit of lengths that fall: each goes to the fullest open bin that holds it; ``opens`` picks a new bin's size."""
    top = capacities[-1]
    by_room: list[list[int]] = [[] for _ in range(top + 1)]
    some = 0  # bit r is set where a bin with room r is open
    at, used = np.empty(len(lengths), np.int64), []
    for i, n in enumerate(lengths.tolist()):
        fits = some >> n
        if fits:
            room = n + (fits & -fits).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                some &= ~(1 << room)
        else:
            b, room = len(used), opens(n)
            used.append(0)
        used[b] += n
        at[i] = b
        if rest := room - n:
            by_room[rest].append(b)
            some |= 1 << rest
    return at, used


def pack(lengths: np.ndarray, capacities: tuple[int, ...] = CAPACITIES) -> tuple[np.ndarray, np.ndarray]:
    """(bin of each piece, capacity of each bin) for lengths from 1 to the largest capacity.

    Pieces are taken from the longest, ties in the order given. The rule that picks a new bin's
    size is chosen over all pieces together: for every subset of sizes open to it, the smallest
    that holds the piece or the one with the least cost per token is tried, each bin is
    downsized to the smallest capacity that holds its contents, and the cheapest whole wins.
    """
    order = np.argsort(-lengths, kind="stable")
    best = None
    some = [(*r, capacities[-1]) for k in range(len(capacities)) for r in combinations(capacities[:-1], k)]
    for sizes, rule in product(some, (lambda c: c, lambda c: (cost(c) / c, c))):
        def opens(n, sizes=sizes, rule=rule):
            return min((c for c in sizes if c >= n), key=rule)

        at, used = _fill(lengths[order], capacities, opens)
        size = np.array(capacities, np.int64)[np.searchsorted(capacities, used)] if used else np.zeros(0, np.int64)
        total = sum(map(cost, size.tolist()))
        if best is None or total < best[0]:
            best = total, at, size
    at = np.empty(len(lengths), np.int64)
    at[order] = best[1]
    return at, best[2]


def best_fit(df: DataFrame, id_col: str = "doc_id", length: Column | None = None, text_col: str = "text", capacities: tuple[int, ...] = CAPACITIES, group: int = GROUP) -> DataFrame:
    """(id_col, piece, piece_start, piece_len, bin_id, bin_pos, bin_len, bin_capacity) for every piece of every row.

    ``length`` is a row's token count; by default words of the text (runs of characters other
    than space and \\t\\n\\v\\f\\r). A row longer than the largest capacity is cut into pieces of that
    capacity and a rest. A null or empty text has length 0: it keeps one row with piece_len 0 and no bin. Repeated
    rows are packed each by itself; null ids are packed as rows; an empty table gives no rows.

    Only ids and lengths are shuffled: equal (id, length) are counted, and each of them is dealt
    by a hash of id, length and its number among its equals into groups of about ``group``
    pieces, as many as the pieces ask for. So a repeated id or length does not gather, and the
    bins, named by (group, number), are the same however the rows are partitioned. Equal lengths
    are taken by id, then by that number.
    """
    from .common import cut

    top = capacities[-1]
    n = length if length is not None else F.regexp_count(F.col(text_col).cast("string"), F.lit(r"[^\x20\x09-\x0D]+"))
    equal = cut(df.select(F.col(id_col).alias("id"), F.coalesce(n, F.lit(0)).cast("long").alias("n")).groupBy("id", "n").agg(F.count("*").alias("rows")))
    pieces = equal.select(F.sum(F.greatest(F.lit(1), F.ceil(F.col("n") / top)) * F.col("rows"))).first()[0] or 0
    groups = max(1, -(-pieces // group))
    kind = df.schema[id_col].dataType.simpleString()
    schema = f"g int, `{id_col}` {kind}, piece long, piece_start long, piece_len long, bin long, bin_pos long, bin_len long, bin_capacity long"

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("n", "descending"), ("id", "ascending"), ("r", "ascending")])
        n = table["n"].to_numpy()
        count = np.maximum(1, -(-n // top))
        row = np.repeat(np.arange(len(n)), count)
        piece = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
        start = piece * top
        size = np.minimum(n[row] - start, top)
        full = np.flatnonzero(size > 0)
        at, cap = pack(size[full], capacities)
        bins = np.full(len(row), -1)
        bins[full] = at
        order = full[np.lexsort((full, at))]
        pos = np.zeros(len(row), np.int64)
        if len(order):
            b = bins[order]
            first = np.flatnonzero(np.concatenate([[True], b[1:] != b[:-1]]))
            pos[order] = np.arange(len(order)) - np.repeat(first, np.diff(np.append(first, len(order))))
        none = bins < 0
        held = np.bincount(at, weights=size[full], minlength=len(cap)).astype(np.int64)
        take = lambda v: pa.array(np.where(none, 0, v[np.maximum(bins, 0)] if len(v) else 0), pa.int64(), mask=none)
        ids = table["id"].combine_chunks().take(pa.array(row))
        g = pa.array(np.repeat(table["g"].to_numpy(), count), pa.int32())
        return pa.table([g, ids, pa.array(piece), pa.array(start), pa.array(size), pa.array(bins, pa.int64(), mask=none), pa.array(pos, pa.int64(), mask=none), take(held), take(cap)],
                        names=["g", id_col, "piece", "piece_start", "piece_len", "bin", "bin_pos", "bin_len", "bin_capacity"])

    part = equal.select("id", "n", "rows", F.explode(F.sequence(F.lit(0), F.col("rows") - 1, F.lit(NUMBERED))).alias("s"))
    items = part.select("id", "n", F.explode(F.sequence(F.col("s"), F.least(F.col("s") + NUMBERED, "rows") - 1)).alias("r"))
    dealt = items.select("id", "n", "r", F.pmod(F.xxhash64("id", "n", "r"), F.lit(groups)).cast("int").alias("g"))
    packed = dealt.groupBy("g").applyInArrow(run, schema)
    return packed.select(id_col, "piece", "piece_start", "piece_len", F.when(F.col("bin").isNotNull(), F.concat_ws("-", "g", "bin")).alias("bin_id"), "bin_pos", "bin_len", "bin_capacity")
