"""Facets of documents and chunks, how a question meets them, routes to documents and sections, and pluggable models."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as tx
from . import relational as rel


def phrase_facets(docs: DataFrame, id_col: str, text: str, k: int, least: int = 2) -> DataFrame:
    """(id, facet, n): the k most frequent pairs of neighbouring content words of each document, of ``least`` places or more (ties by name)."""
    w = docs.select(id_col, tx.content_words(text).alias("_w"))
    pairs = w.select(id_col, F.explode(F.transform(F.filter(F.sequence(F.lit(0), F.greatest(F.size("_w") - 1, F.lit(0))), lambda i: i + 1 < F.size("_w")), lambda i: F.concat_ws(" ", F.get("_w", i), F.get("_w", i + 1)))).alias("facet"))
    n = pairs.groupBy(id_col, "facet").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    return rel.top_per_key(n, [id_col], [F.desc("n"), "facet"], k, "_r").drop("_r")


def label_lens(docs: DataFrame, id_col: str, text: str, by: str, labels: DataFrame, k: int) -> DataFrame:
    """(by, label, docs, share): labels (label, word) whose words occur in most documents of each corpus, k a corpus."""
    words = docs.select(by, id_col, F.explode(F.array_distinct(tx.words(text))).alias("word"))
    hit = words.join(F.broadcast(labels.select("label", "word").distinct()), "word").groupBy(by, "label").agg(F.countDistinct(id_col).alias("docs"))  # a vocabulary of labels
    total = docs.groupBy(by).agg(F.count("*").alias("_n"))
    x = rel.top_per_key(hit, [by], [F.desc("docs"), "label"], k, "_r").join(total, by)
    return x.select(by, "label", "docs", F.round(F.col("docs") / F.col("_n"), 6).alias("share"))


def card(observations: DataFrame, doc: str, kind: str, value: str, source: str, weight: str, k: int) -> DataFrame:
    """(doc, kind, value, weight, sources, n): observations merged by normalised value, the k strongest of each kind."""
    v = F.trim(F.regexp_replace(F.lower(value), r"[^\p{L}\p{N}]+", " "))
    m = observations.withColumn("_v", v).where("_v <> ''").groupBy(doc, kind, F.col("_v").alias("value")).agg(F.round(F.sum(weight), 6).alias("weight"), F.countDistinct(source).alias("sources"), F.count("*").alias("n"))
    return rel.top_per_key(m, [doc, kind], [F.desc("sources"), F.desc("weight"), "value"], k, "_r").drop("_r")


def facet_match(question: Column, values: Column) -> Column:
    """The best of a facet's values against a question: contained 6 + its words (up to 4); words in common
    (two, or one of seven letters) twice their number plus twice their share."""
    plain = lambda c: F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", " "))

    def one(q):
        words = F.array_distinct(F.split(q, " "))

        def score(v):
            w = F.array_distinct(F.split(v, " "))
            both = F.array_intersect(w, words)
            common = (F.size(both) >= 2) | F.exists(both, lambda x: F.length(x) >= 7)
            return F.when(v == "", 0.0).otherwise(F.when(F.contains(q, v), 6.0 + F.least(F.size(w), F.lit(4))).otherwise(0.0) + F.when((F.size(both) > 0) & common, 2.0 * F.size(both) + 2.0 * F.size(both) / F.size(w)).otherwise(0.0))

        return F.coalesce(F.array_max(F.transform(F.transform(values, plain), score)), F.lit(0.0))

    return F.transform(F.array(plain(question)), one)[0]


def merged_metadata(metadata: Column, facets: Column) -> Column:
    """A string map with the facet map's fields folded in under ``facet_``; null and blank ones do not count."""
    some = F.map_filter(facets, lambda k, v: F.coalesce(F.trim(v) != "", F.lit(False)))
    named = F.transform_keys(some, lambda k, v: F.concat(F.lit("facet_"), k))
    base = F.map_filter(F.coalesce(metadata, F.map_from_entries(F.array().cast("array<struct<k:string,v:string>>"))), lambda k, v: ~F.startswith(k, F.lit("facet_")))
    return F.map_concat(base, F.coalesce(named, F.map_from_entries(F.array().cast("array<struct<k:string,v:string>>"))))


def metadata_terms(metadata: Column) -> Column:
    """Sorted distinct lower-case terms of a map's facet fields, with _ read as a blank; lists stand between commas."""
    values = F.flatten(F.transform(F.map_values(F.map_filter(metadata, lambda k, v: F.startswith(k, F.lit("facet_")))), lambda v: F.split(v, ",")))
    return F.array_sort(F.filter(F.array_distinct(F.transform(values, lambda v: F.trim(F.replace(F.lower(v), F.lit("_"), F.lit(" "))))), lambda v: v != ""))


def bonuses(pool: DataFrame, query: str, rank: str, score: str, kind: str, preferred: Column, mechanisms: str, leaders: int = 3, kind_bonus: float = 0.03, shared_bonus: float = 0.02) -> DataFrame:
    """``ranked_score``: the score, .03 more for a preferred kind, and .02 more where a row shares a mechanism with one of the leaders."""
    w = Window.partitionBy(query)
    lead = F.array_distinct(F.flatten(F.collect_list(F.when(F.col(rank) <= leaders, F.col(mechanisms))).over(w)))
    shares = (F.col(rank) > leaders) & F.coalesce(F.arrays_overlap(F.col(mechanisms), F.col("_lead")), F.lit(False))
    x = pool.withColumn("_lead", lead)
    return x.withColumn("ranked_score", F.round(F.col(score) + F.when(F.coalesce(preferred, F.lit(False)), kind_bonus).otherwise(0.0) + F.when(shares, shared_bonus).otherwise(0.0), 6)).drop("_lead")


def text_index(docs: DataFrame, doc: str, queries: DataFrame, query: str, terms: str, fields: dict[str, float], k: int) -> DataFrame:
    """(query, doc, score): weighted term counts over several fields, divided by the query's best, four places; the k best.

    Only words that a query asks for are counted; counts are combined before their shuffle.
    """
    asked = queries.select(query, F.explode(F.array_distinct(terms)).alias("term"))
    vocabulary = asked.select("term").distinct()
    parts = [docs.select(doc, F.explode(tx.words(f)).alias("term"), F.lit(float(w)).alias("w")) for f, w in fields.items()]
    words = parts[0]
    for p in parts[1:]:
        words = words.unionByName(p)
    tf = words.join(vocabulary, "term", "left_semi").groupBy(doc, "term").agg(F.sum("w").alias("tf"))
    s = tf.join(asked, "term").groupBy(query, doc).agg(F.sum("tf").alias("raw"))
    best = rel.top_per_key(s, [query], [F.desc("raw"), doc], k)  # the greatest is among them, so each task may drop the rest before the shuffle
    return best.withColumn("score", F.round(F.col("raw") / F.max("raw").over(Window.partitionBy(query)), 4)).select(query, doc, "score", "rank")


def metrics_boost(pool: DataFrame, degree: DataFrame, rank: DataFrame, item: str, score: str, edges: int) -> DataFrame:
    """score * (1 + .15 ln(1 + min(50, max(degree, 500 rank)))); unchanged where the graph has no edge."""
    if not edges:
        return pool.withColumn("boosted", F.round(score, 6))
    x = pool.join(degree.select(item, "degree"), item, "left").join(rank.select(item, "rank"), item, "left")
    signal = F.least(F.lit(50.0), F.greatest(F.coalesce(F.col("degree").cast("double"), F.lit(0.0)), 500 * F.coalesce("rank", F.lit(0.0))))
    return x.withColumn("boosted", F.round(F.col(score) * (1 + 0.15 * F.log1p(signal)), 6)).drop("degree", "rank")


def route_documents(hits: DataFrame, query: str, doc: str, group: str, score: str, per_group: int, least: float, margin: float, gap: float, k: int, weight: float = 0.8) -> DataFrame:
    """(query, doc, score, seat): documents for a question: the ``per_group`` nearest of each group, above the
    floor and the first cliff, then taken by ``weight`` of score less the rest for each document of the same group already taken."""
    fair = rel.top_per_key(hits, [query, group], [F.desc(score), doc], per_group, "_g").drop("_g")
    cut = rel.cliff_cut(fair, query, score, doc, least, margin, gap)
    nth = F.row_number().over(Window.partitionBy(query, group).orderBy(F.desc(score), doc)) - 1
    v = F.round(weight * F.col(score) - (1 - weight) * F.col("_nth"), 6)
    x = cut.withColumn("_nth", nth).withColumn("_v", v)
    return rel.top_per_key(x, [query], [F.desc("_v"), F.desc(score), doc], k, "seat").drop("_nth", "_v")


def navigate(routes: DataFrame, nodes: DataFrame, members: DataFrame, query: str, doc: str, score: Column, per_doc: int, k: int) -> DataFrame:
    """(query, doc, parent, score): parents under the best sections of each routed document.

    ``nodes`` is (doc, node, ...) with what ``score`` reads, ``members`` (node, parent, position). Each document
    gives its ``per_doc`` best nodes; their parents share the node's score, in order; k parents a question.
    """
    n = routes.select(query, doc).join(nodes, doc).withColumn("_s", score)
    best = rel.top_per_key(n, [query, doc], [F.desc("_s"), "node"], per_doc, "_r").select(query, doc, "node", "_s")
    p = best.join(members, "node").groupBy(query, doc, "parent").agg(F.max("_s").alias("_s"), F.min("position").alias("_p"))
    x = rel.top_per_key(p, [query], [F.desc("_s"), doc, "_p", "parent"], k, "place")
    return x.select(query, doc, "parent", F.round("_s", 6).alias("score"), "place")


def overlap_reranker(question: pd.Series, text: pd.Series) -> pd.Series:
    """Share of the question's words that a text holds: what stands in for a cross-encoder."""
    words = lambda s: set("".join(c if c.isalnum() else " " for c in (s or "").lower()).split())
    return pd.Series([len(words(q) & words(t)) / max(1, len(words(q))) for q, t in zip(question, text, strict=True)])


def rerank(pool: DataFrame, query: str, question: str, text: str, item: str, k: int, model: Callable[[pd.Series, pd.Series], pd.Series] = overlap_reranker) -> DataFrame:
    """The pool by a model's scores of (question, text), in Arrow batches; the k best of each query. ``model`` takes and gives Series."""
    scored = pool.withColumn("rerank_score", F.round(F.pandas_udf(model, "double")(F.col(question), F.col(text)), 6))
    return rel.top_per_key(scored, [query], [F.desc("rerank_score"), item], k)


def hashed_embedder(dim: int = 64) -> Callable[[pd.Series], pd.Series]:
    """Unit vectors of hashed word counts: what stands in for an embedding model."""

    def embed(texts: pd.Series) -> pd.Series:
        import zlib

        import numpy as np

        def one(t):
            v = np.zeros(dim)
            for w in "".join(c if c.isalnum() else " " for c in (t or "").lower()).split():
                h = zlib.crc32(w.encode())
                v[h % dim] += 1.0 if h >> 16 & 1 else -1.0
            n = np.linalg.norm(v)
            return (v / n if n else v).tolist()

        return texts.map(one)

    return embed


def embed(df: DataFrame, text: str, name: str = "embedding", model: Callable[[pd.Series], pd.Series] | None = None) -> DataFrame:
    """A vector for each distinct text, made once: equal texts share one call of the model."""
    model = model or hashed_embedder()
    known = df.select(text).where(F.col(text).isNotNull()).distinct().withColumn(name, F.pandas_udf(model, "array<double>")(F.col(text)))
    return df.join(known, text, "left")
