"""Exact Jaccard join of word n-gram sets with PartEnum signatures (Arasu, Ganti, Kaushik, VLDB 2006).

Sets fall into bands of nearly equal size. Within a band, Jaccard >= g bounds the symmetric
difference by k. The feature domain is hashed into n1 first-level parts of three second-level
parts each; at most floor(k/2) first-level parts can hold two or more differences, so with
n1 = floor(k/2) + 1 + spare parts at least 1 + spare of them differ in one second-level part or
none, and one of the three subsets of two second-level parts is equal there. Each such subset is
a signature, so every pair above the threshold shares one: nothing is approximate.

Empty subsets would give a signature that all sparse sets share. They are left out; a set in
which more than ``spare`` first-level parts have an empty subset emits a further partitioning with
another seed, and under the last seed its empty signatures too. Two sets lose their shared
signature to emptiness only if both go on to the next seed, where they meet again.

Passages that many documents share would fill whole parts of dissimilar sets alike. Under the
first seed, features that occur in many sets are left out: the difference of what is left is no
larger, so the same k holds, whichever features are left out. Sets that thin out too much by
that are sparse, and go on to seeds over all features. Which features are frequent therefore
changes the work and never the result; they are kept in a Bloom filter of fixed size.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import ascii_lower, components, cut, left_join_skewed, map_texts, slices, words_of


def spare(k: int) -> int:
    """First-level parts beyond those needed: about as many of a set's parts may be sparse."""
    return 1 + k // 24


SEEDS = 4
#: A feature is frequent from this many sets; a task's share counts from LOCAL of its sets.
FREQUENT = 24
LOCAL = 3
#: Features that a task counts at once.
FLUSH = 1_000_000
#: Longs of the parity sketch: each feature flips one of 64 * SKETCH bits, so sketches of two sets
#: differ in no more bits than the sets differ in features.
SKETCH = 32
_M = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None, n: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's word n-grams; fewer than n words count as one."""
    import xxhash

    words = words_of(ascii_lower(text)) if text else []
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    m = min(n, len(h))
    acc = np.full(len(h) - m + 1, m, np.uint64)
    for i in range(m):
        acc = _mix(acc * _M + h[i : len(h) - m + 1 + i])
    return np.unique(acc)


def bands(percent: int, upto: int) -> list[tuple[int, int]]:
    """Size bands [low, high] such that similar sets are in the same or in neighbouring bands."""
    out, low = [], 1
    while low <= upto:
        out.append((low, low * 100 // percent))
        low = out[-1][1] + 1
    return out


def _parts(h: np.ndarray, band: int, k: int, seed: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Signatures of the non-empty subsets, those of the empty ones, the number of sparse parts."""
    tag = np.uint64(((band << 8 | seed) + 1) * int(_M) & 0xFFFFFFFFFFFFFFFF)
    x = _mix(h ^ tag)
    if k == 0:
        return _mix(x.sum(dtype=np.uint64, keepdims=True)), x[:0], 0
    n1 = k // 2 + 1 + spare(k)
    cell = (x >> np.uint64(33)).astype(np.int64) % (n1 * 3)
    order = np.argsort(cell)
    count = np.bincount(cell, minlength=n1 * 3)
    full = np.flatnonzero(count)
    sums = np.zeros(n1 * 3, np.uint64)
    sums[full] = np.add.reduceat(_mix(x + _M)[order], np.concatenate([[0], np.cumsum(count[full])[:-1]]))
    s, c = sums.reshape(n1, 3), count.reshape(n1, 3)
    pair, size = s[:, [0, 0, 1]] + s[:, [1, 2, 2]], c[:, [0, 0, 1]] + c[:, [1, 2, 2]]
    sig = _mix(pair + _mix(np.arange(n1 * 3, dtype=np.uint64).reshape(n1, 3) * _M + tag))
    some = size > 0
    return sig[some], sig[~some], int((~some).any(1).sum())


def signatures(h: np.ndarray, percent: int, table: list[tuple[int, int]], rare: np.ndarray | None = None) -> np.ndarray:
    """The PartEnum signatures of one set, for its own band and the next; ``rare`` marks its infrequent features."""
    if not len(h):
        return np.zeros(0, np.uint64)
    own, out = int(np.searchsorted([r for _, r in table], len(h))), []
    for band in (own, own + 1):
        k = 2 * (100 - percent) * table[band][1] // (100 + percent)
        for seed in range(SEEDS):
            part = h[rare] if seed == 0 and k and rare is not None else h
            if not len(part):
                continue
            sig, empty, sparse = _parts(part, band, k, seed)
            out.append(sig)
            if sparse <= spare(k):
                break
        else:
            out.append(empty)
    return np.concatenate(out)


def _sketch(h: np.ndarray) -> np.ndarray:
    x = _mix(h + np.uint64(7))
    bit = np.bincount((x >> np.uint64(40)).astype(np.int64) % (64 * SKETCH), minlength=64 * SKETCH) & 1
    return np.packbits(bit.astype(np.uint8)).view(np.int64)


def _node(h: np.ndarray) -> int:
    """One 64-bit name for a set: equal sets have equal names."""
    return int(_mix(_mix(h + np.uint64(3)).sum(dtype=np.uint64, keepdims=True) + np.uint64(len(h))).view(np.int64)[0])


def _scan(df: DataFrame, id_col: str, text_col: str, n: int) -> DataFrame:
    """Two kinds of rows from one pass: (id, n, node, sketch) for each text, and (h, times) for
    each feature that a task's share of distinct sets holds LOCAL times or more."""
    picked = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("_text"))

    def scan(batches):
        seen, wait, size = set(), [], 0
        empty = lambda kind, k: pa.nulls(k, kind)
        kinds = {"n": pa.int64(), "node": pa.int64(), "sketch": pa.list_(pa.int64()), "h": pa.int64(), "times": pa.int64()}
        id_kind = None

        def rows(k, **cols):
            return pa.RecordBatch.from_arrays([cols.get("id", empty(id_kind, k))] + [cols[c] if c in cols else empty(kinds[c], k) for c in kinds], names=["id", *kinds])

        def flush():
            nonlocal wait, size
            feature, times = np.unique(np.concatenate(wait), return_counts=True)
            wait, size = [], 0
            some = times >= LOCAL
            return rows(int(some.sum()), h=pa.array(feature[some].view(np.int64)), times=pa.array(times[some], pa.int64()))

        for b in batches:
            id_kind = b.schema.field("id").type
            for part, texts in slices(b, "_text"):
                sets = [shingles(t, n) for t in texts]
                names = [_node(h) if len(h) else None for h in sets]
                sketch = [_sketch(h) if len(h) else None for h in sets]
                yield rows(len(texts), id=part.column(0), n=pa.array([len(h) for h in sets], pa.int64()), node=pa.array(names, pa.int64()), sketch=pa.array(sketch, kinds["sketch"]))
                for name, h in zip(names, sets, strict=True):
                    if name is None or name in seen:
                        continue
                    if len(seen) >= 200_000:
                        seen.clear()
                    seen.add(name)
                    wait.append(h)
                    size += len(h)
                if size >= FLUSH:
                    yield flush()
        if wait:
            yield flush()

    kind = df.schema[id_col].dataType.simpleString()
    return picked.mapInArrow(scan, f"id {kind}, n long, node long, sketch array<long>, h long, times long")


def _packed(sig: np.ndarray, node: np.ndarray, n_buckets: int) -> tuple[list[int], list[bytes]]:
    """Signatures of some sets by bucket, each bucket as one block: nodes, signatures of each, low halves."""
    bucket = ((sig >> np.uint64(32)) * np.uint64(n_buckets) >> np.uint64(32)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    bucket, low, node = bucket[order], sig[order].astype(np.uint32), node[order]
    ends = np.append(np.flatnonzero(bucket[1:] != bucket[:-1]) + 1, len(bucket))
    names, blocks, at = [], [], 0
    for end in ends.tolist():
        first = np.flatnonzero(np.concatenate([[True], node[at + 1 : end] != node[at : end - 1]])) + at
        counts = np.diff(np.append(first, end)).astype(np.uint32)
        names.append(int(bucket[at]))
        blocks.append(np.uint32(len(first)).tobytes() + node[first].tobytes() + counts.tobytes() + low[at:end].tobytes())
        at = end
    return names, blocks


def _unpacked(bucket: int, block: bytes) -> tuple[np.ndarray, np.ndarray]:
    m = int(np.frombuffer(block, np.uint32, 1)[0])
    nodes, counts = np.frombuffer(block, np.int64, m, 4), np.frombuffer(block, np.uint32, m, 4 + 8 * m)
    low = np.frombuffer(block, np.uint32, -1, 4 + 12 * m)
    return low.astype(np.int64) + (bucket << 32), np.repeat(nodes, counts)


#: Signatures of one bucket on average, and of one step of the search for shared ones.
BUCKET = 500_000
STEP = 250_000


def _hits(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Whether a Bloom filter holds each of some 64-bit hashes."""
    mask, there = len(bits) * 64 - 1, np.ones(len(h), bool)
    for x in (h, (h.view(np.uint64) >> np.uint64(20)).view(np.int64)):
        x = x & mask
        there &= (bits[x >> 6].view(np.uint64) >> (x & 63).astype(np.uint64)) & np.uint64(1) == 1
    return there


def _shared(df: DataFrame, text_col: str, n: int, percent: int, n_buckets: int, frequent: np.ndarray) -> DataFrame:
    """(sig, node, hub) for each set that shares a signature with another; hub is one set of that signature.

    Signatures are shuffled as blocks of 4 bytes a signature beside its set's name. A bucket's
    blocks are read in a stream against a table of the signatures met so far, so memory follows
    the distinct signatures of a bucket, which n_buckets bounds, and not how many sets share one.
    """
    often = df.sparkSession.sparkContext.broadcast(frequent)

    def make():
        seen: set[int] = set()
        table = bands(percent, 1 << 34)

        def run(keys, texts):
            sig, node = [], []
            for t in texts:
                h = shingles(t, n)
                if not len(h) or (name := _node(h)) in seen:
                    continue
                if len(seen) >= 200_000:  # copies that slip through meet in their bucket
                    seen.clear()
                seen.add(name)
                s = signatures(h, percent, table, ~_hits(often.value, h.view(np.int64)))
                sig.append(s)
                node.append(np.full(len(s), name, np.int64))
            names, blocks = _packed(np.concatenate(sig), np.concatenate(node), n_buckets) if sig else ([], [])
            return {"bucket": names, "block": blocks}

        return run

    def meet(batches):
        known, hub = np.zeros(0, np.int64), np.zeros(0, np.int64)
        wait, size = [], 0

        def step():
            nonlocal known, hub, wait, size
            key, node = (np.concatenate(x) for x in zip(*wait, strict=True))
            wait, size = [], 0
            order = np.argsort(key, kind="stable")
            key, node = key[order], node[order]
            at = np.minimum(np.searchsorted(known, key), max(len(known) - 1, 0))
            old = known[at] == key if len(known) else np.zeros(len(key), bool)
            first = np.concatenate([[True], key[1:] != key[:-1]]) & ~old
            whose = np.where(old, hub[at] if len(hub) else 0, 0)
            run = np.cumsum(first) - 1
            new_key, new_hub = key[first], node[first]
            whose = np.where(old, whose, new_hub[np.maximum(run, 0)] if len(new_hub) else 0)
            out = node != whose
            known, hub = np.concatenate([known, new_key]), np.concatenate([hub, new_hub])
            order = np.argsort(known, kind="stable")
            known, hub = known[order], hub[order]
            return pa.RecordBatch.from_arrays([pa.array(key[out]), pa.array(node[out]), pa.array(whose[out])], names=["sig", "node", "hub"])

        for b in batches:
            for bucket, block in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                wait.append(_unpacked(bucket, block))
                size += len(wait[-1][0])
                if size >= STEP:
                    yield step()
        if wait:
            yield step()

    blocks = map_texts(df, [], text_col, make, "bucket long, block binary")
    return blocks.repartition(n_buckets, "bucket").mapInArrow(meet, "sig long, node long, hub long").distinct()


def _bloom(values: DataFrame, h, log2_bits: int) -> np.ndarray:
    """A bit set of fixed size, filled by a distributed OR; it holds 2^(log2_bits - 6) longs at most."""
    two = F.explode(F.array(h, F.shiftrightunsigned(h, 20)))
    bits = values.select(two.alias("h")).select(F.expr(f"h & {(1 << log2_bits) - 1}").alias("h"))
    rows = bits.groupBy(F.shiftright("h", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(h & 63 as int))")).alias("b"))
    out = np.zeros(1 << (log2_bits - 6), np.int64)
    got = rows.toPandas()
    out[got["w"].to_numpy(np.int64)] = got["b"].to_numpy(np.int64)
    return out


def _features(df: DataFrame, id_col: str, text_col: str, n: int, wanted: DataFrame, log2_bits: int) -> DataFrame:
    """(node, h): the feature hashes of the sets named in ``wanted`` (node, rep).

    Only the text of one document for each such set is shingled. Up to MOST_BROADCAST of their ids
    are broadcast to the scan; beyond that a Bloom filter of fixed size on the ids drops most
    other documents, and the join the rest.
    """
    few = wanted.count() <= MOST_BROADCAST
    bits = None
    if few:
        df = df.join(F.broadcast(wanted.select(F.col("rep").alias("_rep"))), F.col(id_col) == F.col("_rep"), "left_semi")
    else:
        bits = df.sparkSession.sparkContext.broadcast(_bloom(wanted, F.xxhash64("rep"), log2_bits))

    def make():
        def run(keys, texts):
            h = keys[0].to_numpy(zero_copy_only=False).astype(np.int64)
            there = np.arange(len(h)) if few else np.flatnonzero(_hits(bits.value, h))
            node, feats = [], []
            for i in there:
                s = shingles(texts[i], n)
                if len(s):
                    node.append(_node(s))
                    feats.append(s.view(np.int64))
            return {"node": node, "h": feats}

        return run

    rows = map_texts(df, [F.xxhash64(id_col)], text_col, make, "node long, h array<long>")
    return rows.join(wanted.select("node"), "node", "left_semi").dropDuplicates(["node"])


#: Ids that are broadcast at most (8 MB); beyond that both sides are shuffled.
MOST_BROADCAST = 1_000_000
#: Pairs of one set that are verified before the others: in a dense group they connect nearly all,
#: and pairs within a component need no verifying.
FIRST = 3


def _bits(a: str, b: str):
    return sum((F.bit_count(F.col(a)[i].bitwiseXOR(F.col(b)[i])) for i in range(1, SKETCH)), F.bit_count(F.col(a)[0].bitwiseXOR(F.col(b)[0])))


def _may_link(percent: int):
    """Bounds that every pair above the threshold meets: sizes, and bits in which the sketches differ."""
    small, large = F.least("na", "nb"), F.greatest("na", "nb")
    return (small * 100 >= large * percent) & (_bits("sa", "sb") * (100 + percent) <= (F.col("na") + F.col("nb")) * (100 - percent))


#: Members of one signature that one task compares with as many others.
CHUNK = 1024
#: Pairs of one signature whose bounds a task evaluates at once.
PAIRS = 400_000


def _across(members: DataFrame, percent: int) -> DataFrame:
    """Distinct pairs (a, b) of (sig, size, node, c, n, sketch) rows with equal sig, unlike c, and bounds that a link meets.

    A signature of many members is dealt out by pairs of chunks, so a task holds two chunks at
    most; bounds are evaluated on arrays of pairs.
    """
    chunks = F.ceil(F.col("size") / CHUNK).cast("int")
    own = F.pmod(F.xxhash64("node"), chunks).cast("int")
    rows = members.withColumn("own", own).withColumn("o", F.explode(F.sequence(F.lit(0), chunks - 1)))
    rows = rows.select("sig", F.least("own", "o").alias("i"), F.greatest("own", "o").alias("j"), "own", "node", "c", "n", "sketch")

    def pairs(t):
        sig, i, j, own, node, c, n = (t[x] for x in ("sig", "i", "j", "own", "node", "c", "n"))
        start = np.concatenate([[True], (sig[1:] != sig[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])])
        run = np.cumsum(start) - 1
        ends = np.append(np.flatnonzero(start)[1:], len(sig))[run]
        later = ends - np.arange(len(sig)) - 1
        step = max(1, PAIRS // max(1, int(later.max(initial=1))))
        for at in range(0, len(sig), step):
            k = later[at : at + step]
            a = np.repeat(np.arange(at, at + len(k)), k)
            b = a + 1 + np.arange(len(a)) - np.repeat(np.cumsum(k) - k, k)
            lo, hi = np.minimum(n[a], n[b]), np.maximum(n[a], n[b])
            good = (c[a] != c[b]) & (lo * 100 >= hi * percent) & ((i[a] == j[a]) | (own[a] != own[b]))
            a, b = a[good], b[good]
            for p in range(0, len(a), 50_000):
                x, y = a[p : p + 50_000], b[p : p + 50_000]
                differ = np.bitwise_count(t["sketch"][x] ^ t["sketch"][y]).sum(1, dtype=np.int64)
                near = differ * (100 + percent) <= (n[x] + n[y]) * (100 - percent)
                u, v = node[x[near]], node[y[near]]
                if len(u):
                    yield np.stack([np.minimum(u, v), np.maximum(u, v)], 1)

    def meet(batches):
        held = None

        def out(t):
            got = list(pairs(t))
            if got:
                u = np.unique(np.concatenate(got), axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(u[:, 0].copy()), pa.array(u[:, 1].copy())], names=["a", "b"])

        for b in batches:
            if not b.num_rows:
                continue
            t = {x: b.column(k).to_numpy() for k, x in enumerate(("sig", "i", "j", "own", "node", "c", "n"))}
            t["sketch"] = b.column(7).flatten().to_numpy().view(np.uint64).reshape(b.num_rows, -1)
            if held:
                t = {x: np.concatenate([held[x], t[x]]) for x in t}
            last = (t["sig"] == t["sig"][-1]) & (t["i"] == t["i"][-1]) & (t["j"] == t["j"][-1])
            cut_at = int(np.argmax(last))
            yield from out({x: v[:cut_at] for x, v in t.items()}) if cut_at else ()
            held = {x: v[cut_at:] for x, v in t.items()}
        if held:
            yield from out(held)

    key = ["sig", "i", "j"]
    return rows.repartition(*key).sortWithinPartitions(*key).mapInArrow(meet, "a long, b long").distinct()


def _verified(pairs: DataFrame, features, percent: int) -> DataFrame:
    """Of pairs (a, b), those with 100 * |intersection| >= percent * |union|; ``features`` gives (node, h) of nodes."""
    pairs = cut(pairs)
    feats = cut(features(pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()))
    a, b = feats.select(F.col("node").alias("a"), F.col("h").alias("ha")), feats.select(F.col("node").alias("b"), F.col("h").alias("hb"))
    both = F.size(F.array_intersect("ha", "hb"))
    return cut(pairs.join(a, "a").join(b, "b").where(both * 100 >= (F.size("ha") + F.size("hb") - both) * percent).select("a", "b"))


def _joined(label: DataFrame, links: DataFrame) -> DataFrame:
    """(node, component) after more links: components of the components that they join, then of their nodes."""
    of = lambda x: label.select(F.col("node").alias(x), F.col("component").alias(f"c{x}"))
    up = links.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))
    top = components(up, "a", "b")
    moved = label.join(top.select(F.col("node").alias("component"), F.col("component").alias("top")), "component", "left").select("node", F.coalesce("top", "component").alias("component"))
    return cut(moved.union(top.join(label, "node", "left_anti")))


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 4, percent: int = 85, log2_bits: int = 25) -> DataFrame:
    """Per row: (id_col, n_shingles, component_id) under links of Jaccard >= percent / 100.

    Words are runs of characters other than space and \t\n\v\f\r of the text with A-Z
    lower-cased. A null or wordless text has the empty set, links with nothing and is its own
    component. Repeated rows are repeated with equal results; rows that share an id are one
    document. A null id keeps its row; its component is that of its set, if any document with an
    id is in it. An empty table gives no rows. Other columns are ignored.

    Equal sets collapse to one node. Nodes that share a signature are compared with one hub of
    that signature, not with each other. Links give components. Only signatures whose other
    nodes still are in several components are joined with themselves (one signature for each set
    of nodes), between components, under bounds on sizes and parity sketches; a few pairs of
    each node are verified exactly first, then all that still lie between components. So no
    link that could join two components is missed, and no group is expanded into all its pairs.
    """
    found = cut(_scan(df, id_col, text_col, n))
    docs = found.where("times is null").select("id", "n", "node", "sketch")
    often = found.where("times is not null").groupBy("h").agg(F.sum("times").alias("times")).where(F.col("times") >= FREQUENT)
    info = docs.where("node is not null").groupBy("node").agg(F.min("n").alias("n"), F.min("id").alias("rep"), F.first("sketch").alias("sketch"))
    per_set = F.lit(12) + F.col("n") * (7 * (100 - percent) / (100 + percent))
    total = docs.agg(F.sum(per_set)).first()[0] or 0
    shared = cut(_shared(df, text_col, n, percent, max(1, round(total / BUCKET)), _bloom(often, F.col("h"), log2_bits)))
    side = lambda x: info.select(F.col("node").alias(x), F.col("n").alias(f"n{x}"), F.col("sketch").alias(f"s{x}"))
    near = shared.select(F.col("hub").alias("a"), F.col("node").alias("b")).distinct()
    near = near.join(side("a"), "a").join(side("b"), "b").where(_may_link(percent)).select("a", "b")
    features = lambda nodes: _features(df, id_col, text_col, n, nodes.join(info.select("node", "rep"), "node"), log2_bits)
    links = _verified(near, features, percent)
    label = components(links, "a", "b")
    member = shared.select("sig", "node").join(label, "node", "left").select("sig", "node", F.coalesce("component", "node").alias("c"))
    who = [F.bit_xor(F.xxhash64("node", F.lit(i))).alias(f"who{i}") for i in (1, 2)]
    split = member.groupBy("sig").agg(F.count("*").alias("size"), *who, F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo <> hi")
    split = split.groupBy("size", "who1", "who2").agg(F.min("sig").alias("sig")).select("sig", "size")
    cross = _across(member.join(split, "sig").join(info.select("node", "n", "sketch"), "node"), percent)
    cross = cut(cross.withColumn("turn", F.row_number().over(Window.partitionBy("a").orderBy(F.xxhash64("b"), "b"))))
    label = _joined(label, _verified(cross.where(F.col("turn") <= FIRST).select("a", "b"), features, percent))
    of = lambda x: label.select(F.col("node").alias(x), F.col("component").alias(f"c{x}"))
    rest = cross.where(F.col("turn") > FIRST).join(of("a"), "a", "left").join(of("b"), "b", "left")
    rest = rest.where(F.coalesce("ca", "a") != F.coalesce("cb", "b")).select("a", "b")
    label = _joined(label, _verified(rest, features, percent))
    of = info.select("node", "rep").join(label, "node", "left").select("node", "rep", F.coalesce("component", "node").alias("c"))
    least = of.groupBy("c").agg(F.min("rep").alias("component_id"))
    of = left_join_skewed(cut(of.select("node", "c")), cut(least), ["c"]).select("node", "component_id")
    rows = left_join_skewed(docs.select("id", "n", "node"), cut(of), ["node"])
    return rows.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component_id", "id").alias("component_id"))
