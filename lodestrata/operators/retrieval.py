"""Lexical and vector search, rank fusion, pool merging, boosts, diversity and packing."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import relational as rel
from .relational import cut

#: Most rows, and bytes, of query terms or query vectors that are broadcast; above them sides are shuffled or taken in blocks.
MOST_BROADCAST = 100_000
MOST_BYTES = 64 << 20
#: Scores that a task holds at once (8 bytes each).
SCORES = 4_000_000


def weighed(df: DataFrame, most: int) -> tuple[int, int]:
    """Rows, up to ``most`` + 1, and the bytes of their values as text."""
    row = df.limit(most + 1).agg(F.count("*"), F.sum(F.octet_length(F.to_json(F.struct("*"))))).first()
    return row[0], row[1] or 0


def small(df: DataFrame, most: int = MOST_BROADCAST) -> DataFrame:
    """Broadcast the side if its rows and bytes are proven small, else leave the choice to the planner."""
    rows, size = weighed(df, most)
    return F.broadcast(df) if rows <= most and size <= MOST_BYTES else df


def in_blocks(queries: DataFrame, query_id: str, search) -> DataFrame:
    """``search(block)`` of a bounded part of the queries, over all queries.

    Queries that fit one broadcast go at once; more are dealt by a hash of their id into blocks
    that fit, and each block's answers are written before the next begins.
    """
    rows, size = weighed(queries, MOST_BROADCAST)
    if rows <= MOST_BROADCAST and size <= MOST_BYTES:
        return search(queries)
    queries = cut(queries)
    rows, size = queries.agg(F.count("*"), F.sum(F.octet_length(F.to_json(F.struct("*"))))).first()
    blocks = int(max(rows / MOST_BROADCAST, size / MOST_BYTES) * 1.5) + 1
    return reduce(DataFrame.union, [cut(search(queries.where(F.pmod(F.xxhash64(query_id), F.lit(blocks)) == i))) for i in range(blocks)])


def _near(block: DataFrame, words: str, hits: str):
    """A function of padded texts: places (in ``block``, rows in order) of the queries of which a text holds ``hits`` distinct words, and how many it holds."""
    got = block.select(words, hits).toPandas()
    asked = [np.unique(np.array(list(w if w is not None else ()), object).astype(str)) for w in got[words]]
    vocabulary, term = np.unique(np.concatenate([np.zeros(0, str), *asked]), return_inverse=True)
    order = np.argsort(term, kind="stable")
    query = np.repeat(np.arange(len(asked)), [len(w) for w in asked])[order]
    shared = block.sparkSession.sparkContext.broadcast((vocabulary, np.searchsorted(term[order], np.arange(len(vocabulary) + 1)), query, got[hits].to_numpy(np.int64)))

    kind = pa.list_(pa.struct([("i", pa.int32()), ("n", pa.int32())]))

    def near(flat: pa.Array) -> pa.Array:
        vocabulary, at, query, need = shared.value
        names, rows, out = pa.array(vocabulary, pa.string()), min(1_000, max(1, SCORES // max(1, len(need)))), [pa.array([], kind)]
        for i in range(0, len(flat), rows):
            part = flat.slice(i, rows)
            lists, n = pc.split_pattern(part.fill_null(""), " "), len(part)
            word, doc = pc.index_in(lists.flatten(), value_set=names), pc.list_parent_indices(lists).to_numpy()
            there = word.is_valid().to_numpy(zero_copy_only=False)
            pair = np.unique(doc[there].astype(np.int64) * len(vocabulary) + word.drop_null().to_numpy())
            doc, word = pair // max(1, len(vocabulary)), pair % max(1, len(vocabulary))
            count = at[word + 1] - at[word]
            to = np.repeat(at[word] - np.cumsum(count) + count, count) + np.arange(int(count.sum()))
            held = np.bincount(np.repeat(doc, count) * len(need) + query[to], minlength=n * len(need)).reshape(n, len(need))
            row, place = np.nonzero(held >= need)
            out.append(pa.ListArray.from_arrays(pa.array(np.searchsorted(row, np.arange(n + 1)), pa.int32()), pa.StructArray.from_arrays([pa.array(place, pa.int32()), pa.array(held[row, place], pa.int32())], ["i", "n"])))
        return pa.concat_arrays(out)

    return F.arrow_udf(near, "array<struct<i:int,n:int>>")


def against_all(docs: DataFrame, id_col: str, queries: DataFrame, query_id: str, bound: Column, score, least: float, flat, words: str, hits: str) -> DataFrame:
    """(id_col, query_id, score) with score above ``least``: a stated query set against all rows, without a shuffle.

    What ``bound`` makes of a row is made once; ``flat(bound)`` is its text as single words between
    blanks. A query's ``words`` are distinct words, of which a row must hold ``hits``, one at least,
    to score above ``least``: the words of an Arrow batch are looked up among those of all queries of a
    block, and ``score(bound, query, held)`` sees only the pairs that hold enough.
    """

    def search(block: DataFrame) -> DataFrame:
        block = cut(block.agg(F.collect_list(F.struct("*")).alias("_q"))).select(F.posexplode("_q").alias("_i", "_q"))  # in one order for both uses
        near = _near(block.select("_q.*"), words, hits)
        made = docs.select(id_col, bound.alias("_b"))
        made = made.select(id_col, "_b", F.inline(near(flat(F.col("_b")))).alias("_i", "_n")).join(F.broadcast(block), "_i")  # a block is bounded
        return made.select(id_col, F.col("_q")[query_id].alias(query_id), score(F.col("_b"), F.col("_q"), F.col("_n")).alias("score")).where(F.col("score") > least)

    return in_blocks(queries, query_id, search)


class Best:
    """The k best (score, id) of each query so far; ties go to the smaller id."""

    def __init__(self, k: int):
        self.k, self.query, self.id, self.score = k, np.zeros(0, np.int64), None, np.zeros(0)

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        """Scores (query, row), -inf where a row is no answer."""
        n = scores.shape[1]
        least = np.partition(scores, n - self.k, axis=1)[:, n - self.k, None] if n > self.k else -np.inf
        q, r = np.nonzero((scores >= least) & (scores > -np.inf))
        query, score, id_ = np.concatenate([self.query, q]), np.concatenate([self.score, scores[q, r]]), ids[r]
        id_ = id_ if self.id is None else np.concatenate([self.id, id_])
        order = np.lexsort((np.unique(id_, return_inverse=True)[1], -score, query))
        query = query[order]
        start = np.flatnonzero(np.concatenate([[True], query[1:] != query[:-1]])) if len(query) else query
        place = np.arange(len(query)) - np.repeat(start, np.diff(np.append(start, len(query))))
        kept = order[place < self.k]
        self.query, self.score, self.id = query[place < self.k], score[kept], id_[kept]

    def batch(self, names: np.ndarray, query_id: str, id_col: str):
        if self.id is not None:
            yield pa.RecordBatch.from_arrays([pa.array(names[self.query]), pa.array(self.id), pa.array(self.score)], names=[query_id, id_col, "score"])


def tfidf_search(docs: DataFrame, queries: DataFrame, doc_id: str, query_id: str, tokens: Column, query_tokens: Column, k: int, k1: float | None = None, b: float = 0.0) -> DataFrame:
    """Top k per query by the sum of tf_q * tf_d * idf, idf = ln(1 + (N - df + .5) / (df + .5)); ties by document.

    With ``k1`` the document side is saturated: tf (k1 + 1) / (tf + k1 (1 - b + b len / avg)).
    Queries are a bounded set, in blocks. Words are made once in each of two scans: one counts
    the documents of each term asked for (combined before its shuffle), one scores. The second
    looks the words of an Arrow batch up among the terms, adds up weights in a (query, document)
    matrix and keeps each query's best k, so no (query, document) pair but those is shuffled.
    """
    made = docs.select(F.col(doc_id), tokens.alias("_t"))
    asked = queries.select(query_id, F.explode(query_tokens).alias("term")).groupBy(query_id, "term").agg(F.count("*").alias("tf_q"))
    n_docs, mean = made.agg(F.count("*"), F.lit(0.0) if k1 is None else F.avg(F.size("_t"))).first()
    kinds = f"`{query_id}` {queries.schema[query_id].dataType.simpleString()}, `{doc_id}` {docs.schema[doc_id].dataType.simpleString()}, score double"

    def search(block: DataFrame) -> DataFrame:
        terms = F.broadcast(block.select("term").distinct())  # a block is bounded
        df = made.select(F.explode(F.array_distinct("_t")).alias("term")).join(terms, "term", "left_semi").groupBy("term").agg(F.count("*").alias("df"))
        idf = F.log1p((F.lit(n_docs) - F.col("df") + 0.5) / (F.col("df") + 0.5))
        w = block.join(df, "term").select(query_id, "term", (F.col("tf_q") * idf).alias("w")).toPandas()
        ids, q = np.unique(w[query_id].to_numpy(), return_inverse=True)
        vocabulary, t = np.unique(w["term"].to_numpy(object).astype(str), return_inverse=True)
        order = np.argsort(t, kind="stable")
        shared = block.sparkSession.sparkContext.broadcast((ids, vocabulary, np.searchsorted(t[order], np.arange(len(vocabulary) + 1)), q[order], w["w"].to_numpy(float)[order]))

        def score(batches):
            ids, vocabulary, at, q, weight = shared.value
            best, names, rows = Best(k), pa.array(vocabulary, pa.string()), max(1, SCORES // max(1, len(ids)))
            for whole in batches:
                for i in range(0, whole.num_rows if len(ids) else 0, rows):
                    part = whole.slice(i, rows)
                    lists, n = part.column(1), part.num_rows
                    term, doc = pc.index_in(lists.flatten(), value_set=names), pc.list_parent_indices(lists).to_numpy()
                    there = term.is_valid().to_numpy(zero_copy_only=False)
                    pair, tf = np.unique(doc[there].astype(np.int64) * len(vocabulary) + term.drop_null().to_numpy(), return_counts=True)
                    doc, term = pair // len(vocabulary), pair % len(vocabulary)
                    if k1 is not None:
                        size = lists.value_lengths().fill_null(0).to_numpy()[doc]
                        tf = tf * (k1 + 1) / (tf + k1 * (1 - b + b * size / mean))
                    count = at[term + 1] - at[term]
                    to = np.repeat(at[term] - np.cumsum(count) + count, count) + np.arange(int(count.sum()))
                    cell = q[to] * n + np.repeat(doc, count)
                    total = np.bincount(cell, weights=weight[to] * np.repeat(tf, count), minlength=len(ids) * n)
                    hit = np.zeros(len(ids) * n, bool)
                    hit[cell] = True
                    best.add(np.where(hit, np.round(total, 6), -np.inf).reshape(len(ids), n), part.column(0).to_numpy(zero_copy_only=False))
            yield from best.batch(ids, query_id, doc_id)

        return made.mapInArrow(score, kinds)

    return rel.top_per_key(in_blocks(asked, query_id, search), [query_id], [F.desc("score"), doc_id], k)


def cosine(a: Column, b: Column) -> Column:
    """Cosine in double precision; 0 where a norm is 0."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm).otherwise(0.0)


def knn(vectors: DataFrame, queries: DataFrame, id_col: str, query_id: str, vector: str, query_vector: str, k: int, where: Column | None = None) -> DataFrame:
    """Exact k nearest by cosine, rounded to six places: a bounded query set against all rows, in blocks.

    A block of queries is broadcast to the scan, which keeps each partition's best k per query
    before the shuffle; ties go to the smaller id. ``where`` prunes rows before scoring. Rows and
    queries whose vector is null, or of another length than most queries', are left out.
    """
    rows = vectors.where(where) if where is not None else vectors
    rows = rows.where(F.col(vector).isNotNull()).select(id_col, F.col(vector).cast("array<double>").alias("_v"))
    asked = queries.where(F.col(query_vector).isNotNull()).select(query_id, F.col(query_vector).cast("array<double>").alias("_q"))
    kinds = f"`{query_id}` {queries.schema[query_id].dataType.simpleString()}, `{id_col}` {vectors.schema[id_col].dataType.simpleString()}, score double"

    def search(block: DataFrame) -> DataFrame:
        got = block.toPandas()
        dim = int(got["_q"].map(len).mode().min()) if len(got) else 0
        got = got[got["_q"].map(len) == dim]
        ask = np.array(got["_q"].tolist(), np.float64).reshape(len(got), dim)
        shared = block.sparkSession.sparkContext.broadcast((got[query_id].to_numpy(), ask / np.maximum(np.linalg.norm(ask, axis=1, keepdims=True), 1e-300)))

        def best_of(batches):
            names, m = shared.value
            best, step = Best(k), max(1, SCORES // max(1, len(names)))
            for whole in batches:
                whole = whole.filter(pc.equal(pc.list_value_length(whole.column(1)), dim))
                for i in range(0, whole.num_rows if len(names) else 0, step):
                    part = whole.slice(i, step)
                    v = part.column(1).flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, dim)
                    v = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-300)
                    best.add(np.round(m @ v.T, 6), part.column(0).to_numpy(zero_copy_only=False))
            yield from best.batch(names, query_id, id_col)

        return rows.mapInArrow(best_of, kinds)

    return rel.top_per_key(in_blocks(asked, query_id, search), [query_id], [F.desc("score"), id_col], k)


def rrf(pools: DataFrame, query: str, item: str, lane: str, rank: str, weights: dict[str, float], k: int = 60, other: float = 0.8) -> DataFrame:
    """Weighted reciprocal ranks, sum of w / (k + rank), divided by the query's best."""
    w = F.coalesce(F.create_map(*[x for p in weights.items() for x in map(F.lit, p)])[F.col(lane)], F.lit(other))
    s = pools.groupBy(query, item).agg(F.sum(w / (k + F.col(rank))).alias("raw"), F.count_distinct(lane).alias("lanes"))
    return s.withColumn("score", F.round(F.col("raw") / F.max("raw").over(Window.partitionBy(query)), 6)).drop("raw")


def merge_pools(pool: DataFrame, keys: list[str], score: str, lane: str) -> DataFrame:
    """One row per key: the best score, its lane (ties by name) and all lanes."""
    return pool.groupBy(*keys).agg(F.max(score).alias("score"), F.min_by(lane, F.struct(-F.col(score), F.col(lane))).alias("best_lane"), F.array_join(F.array_sort(F.collect_set(lane)), ",").alias("lanes"))


def min_max(df: DataFrame, query: str, score: str, order: str) -> DataFrame:
    """.82 of min-max plus .18 of rank; .5 for a pool of equal scores."""
    w = Window.partitionBy(query)
    lo, hi, n = F.min(score).over(w), F.max(score).over(w), F.count("*").over(w)
    rank = F.when(n > 1, 1 - (F.row_number().over(w.orderBy(F.desc(score), order)) - 1) / (n - 1)).otherwise(1.0)
    mm = F.when(hi > lo, (F.col(score) - lo) / (hi - lo)).otherwise(0.5)
    return df.withColumn("relevance", F.round(0.82 * mm + 0.18 * rank, 6))


def relevance_floor(df: DataFrame, query: str, score: str, order: str, floor: float) -> DataFrame:
    """score / top at or above the floor; the first row of a query always stays."""
    w = Window.partitionBy(query)
    return df.withColumn("_i", F.row_number().over(w.orderBy(F.desc(score), order))).withColumn("_t", F.max(score).over(w)).where((F.col("_i") == 1) | (F.col(score) >= floor * F.col("_t"))).drop("_i", "_t")


def reserve(df: DataFrame, query: str, lane: str, score: str, item: str, k: int) -> DataFrame:
    """The best of each lane first, then by score, k in all."""
    first = F.row_number().over(Window.partitionBy(query, lane).orderBy(F.desc(score), item)) == 1
    return rel.top_per_key(df.withColumn("reserved", first), [query], [F.when(F.col("reserved"), 0).otherwise(1), F.desc(score), item], k, "seat")


def degree_boost(pool: DataFrame, degree: DataFrame, item: str, score: str) -> DataFrame:
    """score * (1 + .15 ln(1 + min(degree, 50)))."""
    x = pool.join(degree, item, "left")
    return x.withColumn("boosted", F.round(F.col(score) * (1 + 0.15 * F.log1p(F.least(F.coalesce("degree", F.lit(0)), F.lit(50)))), 6))


def mmr(pool: DataFrame, query: str, item: str, doc: str, score: str, tokens: str, k: int, lam: float = 0.65, soft: int = 3, hard: int = 4) -> DataFrame:
    """Maximal marginal relevance with document caps, per query: (query, item, seat).

    Greedy: lam * relevance - (1 - lam) * the greatest token Jaccard with what is chosen, less .14
    for each document repeat past the soft cap; a document at the hard cap and a candidate at
    Jaccard .88 or more are passed over while others remain. Earlier rank wins ties. Pools are
    bounded by the search's k.
    """

    def pick(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values([score, item], ascending=[False, True]).reset_index(drop=True)
        sets = [set(t) for t in g[tokens]]
        left, chosen, per = list(range(len(g))), [], {}

        def near(i):
            return max((len(sets[i] & sets[j]) / max(1, len(sets[i] | sets[j])) for j in chosen), default=0.0)

        while left and len(chosen) < k:
            for strict in (True, False):
                best = None
                for i in left:
                    sim, n = near(i), per.get(g[doc][i], 0)
                    if strict and (n >= hard or sim >= 0.88):
                        continue
                    v = lam * g[score][i] - (1 - lam) * sim - 0.14 * max(0, n + 1 - soft)
                    if best is None or v > best[0] + 1e-12:
                        best = v, i
                if best:
                    break
            chosen.append(best[1])
            left.remove(best[1])
            per[g[doc][best[1]]] = per.get(g[doc][best[1]], 0) + 1
        return pd.DataFrame({query: g[query].iloc[0], item: g[item][chosen].to_numpy(), "seat": range(1, len(chosen) + 1)})

    kinds = f"`{query}` {pool.schema[query].dataType.simpleString()}, `{item}` {pool.schema[item].dataType.simpleString()}, seat long"
    return pool.groupBy(query).applyInPandas(pick, kinds)


def pack_budget(pool: DataFrame, query: str, item: str, rank: str, full: str, summary: str, budget: int) -> DataFrame:
    """Rank walk: the full text if it fits what is left, else the summary, else skipped: (query, item, form, used)."""

    def walk(g: pd.DataFrame) -> pd.DataFrame:
        left, rows = budget, []
        for r in g.sort_values(rank).itertuples():
            for form, cost in (("full", getattr(r, full)), ("summary", getattr(r, summary))):
                if cost <= left:
                    left -= cost
                    rows.append((getattr(r, query), getattr(r, item), form, budget - left))
                    break
        return pd.DataFrame(rows, columns=[query, item, "form", "used"])

    kinds = f"`{query}` {pool.schema[query].dataType.simpleString()}, `{item}` {pool.schema[item].dataType.simpleString()}, form string, used long"
    return pool.groupBy(query).applyInPandas(walk, kinds)


def ranking_metrics(ranked: DataFrame, gold: DataFrame, query: str, item: str, rank: str, grade: str, k: int) -> DataFrame:
    """Per query: mrr, ap, recall and ndcg at k; gains 2^grade - 1; the ideal is over all labels, cut at k."""
    hits = ranked.where(F.col(rank) <= k).join(gold, [query, item], "left").withColumn("g", F.coalesce(grade, F.lit(0)))
    w = Window.partitionBy(query).orderBy(rank)
    hits = hits.withColumn("rel", (F.col("g") > 0).cast("int")).withColumn("cum", F.sum("rel").over(w))
    disc = lambda r: F.log2(F.col(r) + 1)
    got = hits.groupBy(query).agg(
        F.coalesce(F.max(F.when(F.col("rel") == 1, 1 / F.col(rank))), F.lit(0.0)).alias("mrr"),
        F.sum(F.col("rel") * F.col("cum") / F.col(rank)).alias("ap_sum"),
        F.sum("rel").alias("found"),
        F.sum((F.pow(F.lit(2.0), F.col("g")) - 1) / disc(rank)).alias("dcg"),
    )
    ideal = gold.where(F.col(grade) > 0).withColumn("_i", F.row_number().over(Window.partitionBy(query).orderBy(F.desc(grade), item)))
    ideal = ideal.groupBy(query).agg(F.count("*").alias("n"), F.sum(F.when(F.col("_i") <= k, (F.pow(F.lit(2.0), F.col(grade)) - 1) / disc("_i"))).alias("idcg"))
    j = got.join(ideal, query)
    return j.select(query, F.round("mrr", 6).alias("mrr"), F.round(F.col("ap_sum") / F.least("n", F.lit(k)), 6).alias("ap"), F.round(F.col("found") / F.col("n"), 6).alias("recall"), F.round(F.col("dcg") / F.col("idcg"), 6).alias("ndcg"))


def sufficiency_repair(pool: DataFrame, required: DataFrame, query: str, item: str, score: str, atoms: str, seat: str, least: float = 0.8, swaps: int = 2) -> DataFrame:
    """Chosen rows after a bounded repair: (query, item, seat, covered).

    ``pool`` holds all candidates with their atoms and the seats of those chosen (else null);
    ``required`` has (query, needed). While the chosen cover less than ``least`` of the needed
    atoms, the candidate that adds most (ties by score, then id) takes the seat of the chosen
    row whose atoms are all covered by others, the last such seat first; ``swaps`` times at most.
    """

    def repair(g: pd.DataFrame) -> pd.DataFrame:
        need = set(g["needed"].iloc[0] if g["needed"].iloc[0] is not None else ())
        has = {r[item]: set(r[atoms]) & need for _, r in g.iterrows()}
        seats = {r[item]: int(r[seat]) for _, r in g.iterrows() if pd.notna(r[seat])}
        rank = dict(zip(g[item], g[score], strict=True))
        covered = lambda who: set().union(*(has[i] for i in who)) if who else set()
        for _ in range(swaps):
            now = covered(seats)
            if not need or len(now) >= least * len(need):
                break
            best = min((i for i in has if i not in seats), key=lambda i: (-len(has[i] - now), -rank[i], i), default=None)
            spare = max((i for i in seats if has[i] <= covered([j for j in seats if j != i])), key=lambda i: seats[i], default=None)
            if best is None or spare is None or not has[best] - now:
                break
            seats[best] = seats.pop(spare)
        share = round(len(covered(seats)) / len(need), 6) if need else 1.0
        rows = sorted(seats.items(), key=lambda x: x[1])
        return pd.DataFrame({query: [g[query].iloc[0]] * len(rows), item: [i for i, _ in rows], "seat": [s for _, s in rows], "covered": [share] * len(rows)})

    kinds = f"`{query}` {pool.schema[query].dataType.simpleString()}, `{item}` {pool.schema[item].dataType.simpleString()}, seat long, covered double"
    return pool.join(required.select(query, "needed"), query, "left").groupBy(query).applyInPandas(repair, kinds)
