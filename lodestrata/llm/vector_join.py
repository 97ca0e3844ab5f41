"""Near-duplicate vectors by a subspace pigeonhole join.

Unit vectors are rotated by a fixed random orthogonal matrix and split into blocks of few
dimensions. Two vectors at squared distance d2 or less are within d2 / blocks of each other in
some block, so each block is range-joined under that budget: a vector is stored in the grid cell
of its block's first coordinates and looked up in every cell that its range touches. The union of
the blocks' candidates is verified by cosine in double precision on the vectors as given.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, cut, left_join_skewed

BLOCK_DIMS = 8
#: Coordinates of a block that the grid uses.
GRID_DIMS = 3
#: Stored rows of a cell that one task compares with a batch of look-ups.
CHUNK = 4096
#: More blocks than a vector has; a block's name is its dimension times this, and its number.
BLOCKS = 1 << 20
#: Slack on the squared distance, above rounding errors of unit vectors in double precision.
SLACK = 1e-9


def rotation(dim: int, seed: int = 11) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).normal(size=(dim, dim)))
    return q * np.sign(np.diag(r))


def _budget(dim: int, cosine: float) -> float:
    """Squared distance that a block may take: the whole over the number of blocks of this dimension."""
    return (2 * (1 - cosine) + SLACK) / -(-dim // BLOCK_DIMS)


def _exploded(batches, cosine: float):
    """Rows (block, cell, store, id, x) of unit vectors: one stored row and up to 2^GRID_DIMS look-ups for each block."""
    for b in batches:
        lists = b.column(2)
        dims = lists.value_lengths().to_numpy()
        flat, ends = lists.flatten().to_numpy(), np.cumsum(dims)
        for dim in np.unique(dims):
            r = float(np.sqrt(_budget(int(dim), cosine)))
            rows = np.flatnonzero(dims == dim)
            v = flat[(ends[rows] - dim)[:, None] + np.arange(dim)]
            v = v / np.abs(v).max(1, keepdims=True)
            u = (v / np.linalg.norm(v, axis=1, keepdims=True)) @ rotation(int(dim))
            for k, at in enumerate(range(0, int(dim), BLOCK_DIMS)):
                x = u[:, at : at + BLOCK_DIMS]
                g = x[:, :GRID_DIMS]
                home = np.floor(g / (2 * r)).astype(np.int64)
                low, high = np.floor((g - r) / (2 * r)).astype(np.int64), np.floor((g + r) / (2 * r)).astype(np.int64)
                out = [(home, True, np.arange(len(rows)))]
                for pick in itertools.product((0, 1), repeat=g.shape[1]):
                    p = np.array(pick, bool)
                    some = np.flatnonzero(((high > low) | ~p).all(1))
                    out.append((np.where(p, high, low)[some], False, some))
                for cell, store, who in out:
                    key = np.zeros(len(who), np.int64)
                    for j in range(cell.shape[1]):
                        key = key * 4096 + cell[:, j] + 2048
                    yield pa.RecordBatch.from_arrays(
                        [b.column(1).take(pa.array(rows[who])), pa.array(np.full(len(who), int(dim) * BLOCKS + k)), pa.array(key), pa.array(np.full(len(who), store)), b.column(0).take(pa.array(rows[who])), pa.array(list(x[who]), pa.list_(pa.float64()))],
                        names=["label", "block", "cell", "store", "id", "x"],
                    )


def similar_pairs(v: DataFrame, cosine: float = 0.93) -> DataFrame:
    """Pairs (a, b), a < b, of (id, label, v array<double>) rows with equal labels and dimensions and cosine at or above the bound.

    A cell with more than CHUNK stored vectors is dealt out in chunks, each of which meets all the
    cell's look-ups; a task holds one chunk and one Arrow batch of look-ups at a time.
    """
    grid = v.select("id", "label", "v").mapInArrow(lambda it: _exploded(it, cosine), f"label {v.schema['label'].dataType.simpleString()}, block long, cell long, store boolean, id long, x array<double>")
    key = ["label", "block", "cell"]
    count = grid.where("store").groupBy(*key).count().where("count > 0").withColumn("chunks", F.ceil(F.col("count") / CHUNK).cast("int"))
    placed = grid.join(count.select(*key, "chunks"), key)
    mine = F.when(F.col("store"), F.array(F.pmod(F.xxhash64("id"), F.col("chunks")).cast("int"))).otherwise(F.sequence(F.lit(0), F.col("chunks") - 1))
    placed = placed.withColumn("chunk", F.explode(mine))
    by = [*key, "chunk"]

    def near(batches):
        at, ids, xs, norms = None, [], [], None
        for b in batches:
            n = b.num_rows
            cols = [b.column(i).to_numpy(zero_copy_only=False) for i in range(4)]
            change = np.concatenate([[True], np.any([c[1:] != c[:-1] for c in cols], axis=0)]) if n else []
            starts = np.append(np.flatnonzero(change), n)
            store, who = b.column(4).to_numpy(zero_copy_only=False), b.column(5).to_numpy()
            width = b.column(6).value_lengths().to_numpy()
            flat, ends = b.column(6).flatten().to_numpy(), np.cumsum(width)
            left, right = [], []
            for s, e in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
                name = tuple(c[s] for c in cols)
                if name != at:
                    at, ids, xs, norms = name, [], [], None
                x = flat[(ends[s] - width[s]) : ends[e - 1]].reshape(e - s, -1)
                st = store[s:e]
                if st.any():
                    ids.append(who[s:e][st])
                    xs.append(x[st])
                    norms = None
                look, p = who[s:e][~st], x[~st]
                if not len(look) or not ids:
                    continue
                if norms is None:
                    ids, xs = [np.concatenate(ids)], [np.concatenate(xs)]
                    norms = (xs[0] ** 2).sum(1)
                limit = _budget(int(at[1]) // BLOCKS, cosine) + SLACK
                for i in range(0, len(look), 1024):
                    d = norms[None, :] + (p[i : i + 1024] ** 2).sum(1)[:, None] - 2 * (p[i : i + 1024] @ xs[0].T)
                    r, c = np.nonzero(d <= limit)
                    some = look[i + r] < ids[0][c]
                    left.append(look[i + r[some]])
                    right.append(ids[0][c[some]])
            if left:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(left)), pa.array(np.concatenate(right))], names=["a", "b"])

    rows = placed.select(*by, "store", "id", "x").repartition(*by).sortWithinPartitions(*by, F.desc("store"), "id")
    found = rows.mapInArrow(near, "a long, b long").distinct()
    dot = lambda p, q: F.aggregate(F.zip_with(p, q, lambda s, t: s * t), F.lit(0.0), lambda s, t: s + t)
    scaled = F.transform("v", lambda s: s / F.array_max(F.transform("v", F.abs)))
    unit = v.select("id", scaled.alias("v")).select("id", "v", F.sqrt(dot(F.col("v"), F.col("v"))).alias("norm"))
    a, b = unit.select(F.col("id").alias("a"), F.col("v").alias("va"), F.col("norm").alias("na")), unit.select(F.col("id").alias("b"), F.col("v").alias("vb"), F.col("norm").alias("nb"))
    return found.join(a, "a").join(b, "b").where(dot(F.col("va"), F.col("vb")) / (F.col("na") * F.col("nb")) >= cosine).select("a", "b")


def near_duplicates(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", cosine: float = 0.93) -> DataFrame:
    """(id_col, n_links, component_id, kept), one row per row.

    Rows link when labels are equal and not null and the cosine is at or above the bound. A
    vector that is null, empty, all zero, or holds a null or non-finite component links with
    nothing, nor does a row with a null label or id. Equal vectors of one label are one node while
    pairs are sought, and count as links of each other. Rows that repeat an id are one vector if
    they are equal, else vectors of their own. An empty table gives no rows; other columns are ignored.
    """
    v = F.col(vector_col).cast("array<double>")
    fine = F.col("id").isNotNull() & F.col("label").isNotNull() & F.coalesce(F.size("v") > 0, F.lit(False))
    fine &= F.coalesce(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False)) & F.coalesce(F.exists("v", lambda x: x != 0), F.lit(False))
    rows = df.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), v.alias("v")).withColumn("fine", fine)
    rows = cut(rows.withColumn("name", F.when(F.col("fine"), F.sha2(F.to_json(F.struct("label", "v")), 256))))
    groups = rows.where("fine").groupBy("name", "label", "v").agg(F.min("id").alias("least"), F.countDistinct("id").alias("copies"))
    groups = cut(groups.withColumn("node", F.monotonically_increasing_id()))  # a number of its own: ids may repeat
    pairs = cut(similar_pairs(groups.select(F.col("node").alias("id"), "label", "v"), cosine))
    both = pairs.union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    links = both.join(groups.select(F.col("node").alias("b"), "copies"), "b").groupBy(F.col("a").alias("node")).agg(F.sum("copies").alias("others"))
    label = cut(components(pairs, "a", "b"))
    smallest = label.join(groups.select("node", "least"), "node").groupBy("component").agg(F.min("least").alias("component_id"))
    label = left_join_skewed(label, cut(smallest), ["component"]).select("node", "component_id")
    node = groups.join(links, "node", "left").join(label, "node", "left")
    node = node.select("name", (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), F.coalesce("component_id", "least").alias("component_id"))
    joined = left_join_skewed(rows.where("fine").select("id", "name"), cut(node), ["name"]).select("id", "n_links", "component_id")
    alone = rows.where("not fine").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    out = joined.unionByName(alone)
    return out.select(F.col("id").alias(id_col), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))
