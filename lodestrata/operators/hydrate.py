"""What candidates get from the stores before they are ranked and shown: texts, names, identities; and how finalists are folded."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import relational as rel


def hydrate(pool: DataFrame, chunks: DataFrame, parents: DataFrame, documents: DataFrame, corpora: DataFrame) -> DataFrame:
    """Candidates (corpus, chunk, parent, doc, ...) with ``text`` of their parent, ``doc_name`` and ``corpus_name``.

    A missing parent or document is looked up in ``chunks`` (corpus, chunk, parent, doc). Text is the
    parent's (corpus, parent, text), else that of the list of parents kept inside the document
    (corpus, doc, name, legacy map of parent to text), else the candidate's own; candidates
    without text are dropped. Stores hold each key once, so no row is multiplied.
    """
    known = chunks.select("corpus", "chunk", F.col("parent").alias("_p"), F.col("doc").alias("_d"))
    x = pool.join(known, ["corpus", "chunk"], "left").withColumn("parent", F.coalesce("parent", "_p")).withColumn("doc", F.coalesce("doc", "_d")).drop("_p", "_d")
    x = x.join(parents.select("corpus", "parent", F.col("text").alias("_t")), ["corpus", "parent"], "left")
    x = x.join(documents.select("corpus", "doc", F.col("name").alias("doc_name"), "legacy"), ["corpus", "doc"], "left")
    x = x.join(corpora.select("corpus", F.col("name").alias("corpus_name")), "corpus", "left")
    blank = lambda c: F.when(F.trim(c) != "", c)
    text = F.coalesce(blank(F.col("_t")), blank(F.try_element_at("legacy", F.col("parent"))), blank(F.col("text")))
    return x.withColumn("text", text).where("text is not null").select(*pool.columns, "doc_name", "corpus_name")


def rerank_texts(pool: DataFrame, chunks: DataFrame, summaries: DataFrame) -> DataFrame:
    """Candidates whose snippet is replaced by the child's full text, or by the parent's summary where they are summaries.

    ``pool`` has (corpus, chunk, parent, is_summary, text); a snippet without a longer text stays.
    """
    x = pool.join(chunks.select("corpus", "chunk", F.col("text").alias("_c")), ["corpus", "chunk"], "left").join(summaries.select("corpus", "parent", F.col("summary").alias("_s")), ["corpus", "parent"], "left")
    full = F.when(F.col("is_summary"), F.col("_s")).otherwise(F.col("_c"))
    return x.withColumn("text", F.when(F.length(full) >= F.length(F.coalesce("text", F.lit(""))), full).otherwise(F.col("text"))).select(pool.columns)


def attach_identities(pool: DataFrame, documents: DataFrame) -> DataFrame:
    """Candidates with the hash of their source file and all corpora that hold a document of that hash.

    ``documents`` is (corpus, doc, source_hash). Without a hash a document is itself: its corpus is its only one.
    """
    held = documents.where("source_hash is not null").groupBy("source_hash").agg(F.array_sort(F.collect_set("corpus")).alias("memberships"))  # as many as there are corpora
    x = pool.join(documents.select("corpus", "doc", "source_hash"), ["corpus", "doc"], "left").join(held, "source_hash", "left")
    return x.withColumn("memberships", F.coalesce("memberships", F.array("corpus"))).select(*pool.columns, "source_hash", "memberships")


def dedupe_across(pool: DataFrame, query: str, score: str, tie: str) -> DataFrame:
    """One row for each text of a query, whatever corpora hold it: the best (ties by ``tie``), with the greatest score and all corpora.

    Texts are equal by source hash and position (hash, ordinal), or else by the text itself.
    """
    same = F.when(F.col("source_hash").isNotNull() & F.col("ordinal").isNotNull(), F.concat_ws("#", "source_hash", F.col("ordinal").cast("string"))).otherwise(F.sha2(F.trim(F.regexp_replace("text", r"\s+", " ")), 256))
    x = pool.withColumn("_k", same)
    w = Window.partitionBy(query, "_k")
    x = x.withColumn("corpora", F.array_sort(F.collect_set("corpus").over(w))).withColumn("copies", F.count("*").over(w))
    return rel.top_per_key(x, [query, "_k"], [F.desc(score), tie], 1, "_r").drop("_k", "_r")


def merge_by_parent(pool: DataFrame, query: str, score: str) -> DataFrame:
    """Pools folded to one row for (query, corpus, parent or else chunk): the best score, all retrievers, and a concrete child.

    The row kept is the best child (not a summary) where the group has one, else the best summary;
    its ``score`` is the greatest of the whole group.
    """
    key = F.coalesce(F.concat(F.lit("p:"), F.col("parent").cast("string")), F.concat(F.lit("c:"), F.col("chunk").cast("string")))
    x = pool.withColumn("_k", key)
    best = F.min_by(F.struct("chunk", "is_summary"), F.struct(F.col("is_summary").cast("int"), -F.col(score), F.col("chunk")))
    out = x.groupBy(query, "corpus", "_k").agg(F.max(score).alias("score"), best.alias("b"), F.first("parent").alias("parent"), F.array_join(F.array_sort(F.collect_set("retriever")), ",").alias("retrievers"), F.count("*").alias("n"))
    return out.select(query, "corpus", "parent", "b.chunk", "b.is_summary", "score", "retrievers", "n")


def dedupe_lane_documents(ranked: DataFrame, query: str, rank: str, doc: str, grounding: str, least: float = 0.75) -> DataFrame:
    """Of finalists of one document that ground the same set of lanes only the best ranked, holding the lanes of all.

    ``grounding`` maps lanes to scores; lanes count from ``least``. Rows without a document or without a lane stay.
    """
    lanes = F.array_sort(F.map_keys(F.map_filter(grounding, lambda k, v: v >= least)))
    x = ranked.withColumn("lanes", F.array_join(lanes, ","))
    alone = F.col(doc).isNull() | (F.coalesce("lanes", F.lit("")) == "")
    first = rel.top_per_key(x.where(~alone), [query, doc, "lanes"], [rank], 1, "_r").drop("_r")
    return x.where(alone).unionByName(first)


def enumerate_finalists(ranked: DataFrame, query: str, rank: str, parent: str, doc: str, answer: str, per_parent: int = 2) -> DataFrame:
    """Finalists of an enumeration: answers first, at most ``per_parent`` of a parent; one supporting row for each document; then by rank."""
    is_answer = F.coalesce(F.col(answer), F.lit(False))
    x = ranked.withColumn("_a", is_answer)
    n = F.row_number().over(Window.partitionBy(query, "_a", F.when(F.col("_a"), F.col(parent).cast("string")).otherwise(F.col(doc).cast("string"))).orderBy(rank))
    key = F.when(F.col("_a"), F.col(parent).isNotNull()).otherwise(F.col(doc).isNotNull())
    kept = x.withColumn("_n", n).where(~key | (F.col("_n") <= F.when(F.col("_a"), per_parent).otherwise(1)))
    return rel.ranked(kept, [query], [F.desc("_a"), rank], "place").drop("_a", "_n")
