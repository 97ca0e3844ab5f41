"""Queries for hydration and folding of candidates. Chunks are line items, parents orders, documents customers, corpora nations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import hydrate as h
from ..operators import relational as rel
from .registry import Tables, query

ITEMS = "(SELECT l_orderkey * 10 + l_linenumber AS chunk, l_linenumber AS n, l_orderkey AS parent, o_custkey AS doc, c_nationkey AS corpus, l_returnflag || ' of ' || l_partkey AS text, l_partkey, l_discount, o_orderpriority FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey)"


def items(t: Tables):
    x = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
    return x.select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("chunk"), F.col("l_linenumber").alias("n"), F.col("l_orderkey").alias("parent"), F.col("o_custkey").alias("doc"), F.col("c_nationkey").alias("corpus"),
        F.concat("l_returnflag", F.lit(" of "), F.col("l_partkey").cast("string")).alias("text"), "l_partkey", "l_discount", "o_orderpriority",
    )


@query(sql=f"""WITH i AS MATERIALIZED (SELECT * FROM {ITEMS}) SELECT chunk, parent, doc, corpus, text, doc_name, corpus_name FROM (SELECT chunk, parent, doc, corpus, coalesce(CASE WHEN parent % 7 > 0 AND parent % 5 > 0 THEN 'order ' || parent END, CASE WHEN parent % 7 = 0 AND parent % 4 > 0 THEN 'legacy ' || parent END, CASE WHEN n <> 3 THEN text END) AS text,
 CASE WHEN doc % 6 > 0 THEN c_name END AS doc_name, n_name AS corpus_name FROM i JOIN customer ON c_custkey = doc JOIN nation ON n_nationkey = corpus WHERE parent % 3 = 0) WHERE text IS NOT NULL""")
def hydrate_candidates(t):
    """Candidates with the text of their parent, or else what the document or the candidate itself holds."""
    i = items(t)
    odd = F.col("n") % 2 == 1
    pool = i.where("parent % 3 = 0").select("corpus", "chunk", F.when(~odd, F.col("parent")).alias("parent"), F.when(~odd, F.col("doc")).alias("doc"), F.when(F.col("n") == 3, " ").otherwise(F.col("text")).alias("text"))
    one = i.select("corpus", "parent", "doc").distinct()
    parents = one.where("parent % 7 > 0 and parent % 5 > 0").select("corpus", "parent", F.concat(F.lit("order "), F.col("parent").cast("string")).alias("text"))
    legacy = one.where("parent % 7 = 0 and parent % 4 > 0").groupBy("corpus", "doc").agg(F.map_from_entries(F.collect_list(F.struct("parent", F.concat(F.lit("legacy "), F.col("parent").cast("string"))))).alias("legacy"))
    docs = one.select("corpus", "doc").distinct().join(legacy, ["corpus", "doc"], "left").join(t.customer, F.col("doc") == F.col("c_custkey")).select("corpus", "doc", F.when(F.col("doc") % 6 > 0, F.col("c_name")).alias("name"), "legacy")
    out = h.hydrate(pool, i.select("corpus", "chunk", "parent", "doc").distinct(), parents, docs, t.nation.select(F.col("n_nationkey").alias("corpus"), F.col("n_name").alias("name")))
    return out.select("chunk", "parent", "doc", "corpus", "text", "doc_name", "corpus_name")


@query(sql=f"""SELECT chunk, text FROM (SELECT chunk, CASE WHEN full_text IS NOT NULL AND length(full_text) >= length(snip) THEN full_text ELSE snip END AS text FROM (SELECT chunk, left(text, 4) AS snip, CASE WHEN n % 4 = 0 THEN CASE WHEN parent % 5 > 0 THEN 'sum ' || parent END ELSE CASE WHEN chunk % 7 > 0 THEN min(text) OVER (PARTITION BY chunk) END END AS full_text FROM {ITEMS} WHERE parent % 3 = 0))""")
def rerank_hydrate(t):
    """Snippets replaced by full child texts or summaries."""
    i = items(t).where("parent % 3 = 0")
    pool = i.select("corpus", "chunk", "parent", (F.col("n") % 4 == 0).alias("is_summary"), F.substring("text", 1, 4).alias("text"))
    summaries = i.where("parent % 5 > 0").select("corpus", "parent", F.concat(F.lit("sum "), F.col("parent").cast("string")).alias("summary")).distinct()
    return h.rerank_texts(pool, i.where("chunk % 7 > 0").groupBy("corpus", "chunk").agg(F.min("text").alias("text")), summaries).select("chunk", "text")


_DOCS = "(SELECT c_nationkey AS corpus, c_custkey AS doc, CASE WHEN c_custkey % 8 > 0 THEN 'h' || c_custkey % 40 END AS source_hash FROM customer)"


def _documents(t: Tables):
    return t.customer.select(F.col("c_nationkey").alias("corpus"), F.col("c_custkey").alias("doc"), F.when(F.col("c_custkey") % 8 > 0, F.concat(F.lit("h"), (F.col("c_custkey") % 40).cast("string"))).alias("source_hash"))


@query(sql=f"SELECT d.corpus, d.doc, d.source_hash, CASE WHEN d.source_hash IS NULL THEN d.corpus::VARCHAR ELSE m.memberships END AS memberships FROM {_DOCS} d LEFT JOIN (SELECT source_hash, string_agg(DISTINCT corpus, ',' ORDER BY corpus) AS memberships FROM {_DOCS} GROUP BY source_hash) m ON m.source_hash = d.source_hash")
def document_identities(t):
    """Documents with the corpora that hold the same source."""
    d = _documents(t)
    return h.attach_identities(d.select("corpus", "doc"), d).select("corpus", "doc", "source_hash", F.array_join(F.transform("memberships", lambda c: c.cast("string")), ",").alias("memberships"))


@query(sql=f"""SELECT query_id, chunk, score, copies, corpora FROM (SELECT *, count(*) OVER (PARTITION BY query_id, k) AS copies, len(list_distinct(list(corpus) OVER (PARTITION BY query_id, k)))::BIGINT AS corpora, row_number() OVER (PARTITION BY query_id, k ORDER BY score DESC, chunk) AS r FROM (
 SELECT n AS query_id, chunk, corpus, l_discount AS score, CASE WHEN source_hash IS NOT NULL AND o_orderpriority LIKE '1%' THEN source_hash || '#' || n ELSE text END AS k FROM {ITEMS} JOIN {_DOCS} USING (corpus, doc))) WHERE r = 1""")
def cross_corpus_dedupe(t):
    """One candidate for each text, with the best score of its copies."""
    x = items(t).join(_documents(t), ["corpus", "doc"]).select(F.col("n").alias("query_id"), "chunk", "corpus", F.col("l_discount").alias("score"), "source_hash", F.when(F.col("o_orderpriority").startswith("1"), F.col("n")).alias("ordinal"), "text")
    return h.dedupe_across(x, "query_id", "score", "chunk").select("query_id", "chunk", "score", "copies", F.size("corpora").cast("long").alias("corpora"))


@query(sql=f"""SELECT query_id, corpus, parent, arg_min(chunk, (is_summary::INT, -l_discount, chunk)) AS chunk, bool_and(is_summary) AS is_summary, max(l_discount) AS score, string_agg(DISTINCT retriever, ',' ORDER BY retriever) AS retrievers, count(*) AS n FROM (
 SELECT parent % 20 AS query_id, corpus, CASE WHEN chunk % 11 > 0 THEN parent END AS parent, coalesce('p' || CASE WHEN chunk % 11 > 0 THEN parent END, 'c' || chunk) AS k, chunk, l_discount, l_partkey % 3 = 0 AS is_summary, CASE n % 3 WHEN 0 THEN 'dense' WHEN 1 THEN 'lexical' ELSE 'graph' END AS retriever FROM {ITEMS}) GROUP BY query_id, corpus, parent, k""")
def pool_coalesce(t):
    """Pools folded by parent, a child before a summary, with all retrievers."""
    x = items(t).select((F.col("parent") % 20).alias("query_id"), "corpus", F.when(F.col("chunk") % 11 > 0, F.col("parent")).alias("parent"), "chunk", F.col("l_discount").alias("score"), (F.col("l_partkey") % 3 == 0).alias("is_summary"), F.when(F.col("n") % 3 == 0, "dense").when(F.col("n") % 3 == 1, "lexical").otherwise("graph").alias("retriever"))
    return h.merge_by_parent(x, "query_id", "score")


def _finalists(t: Tables):
    x = items(t).select((F.col("parent") % 20).alias("query_id"), "chunk", "parent", "doc", F.col("l_discount").alias("score"), "l_partkey", "n")
    return rel.ranked(x, ["query_id"], [F.desc("score"), "chunk"])


FINAL = f"(SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk) AS rank FROM (SELECT parent % 20 AS query_id, chunk, parent, doc, l_discount AS score, l_partkey, n FROM {ITEMS}))"


@query(sql=f"""SELECT query_id, chunk, lanes FROM (SELECT *, row_number() OVER (PARTITION BY query_id, doc, lanes ORDER BY rank) AS r FROM (SELECT *, CASE WHEN l_partkey % 2 = 0 THEN 'a' || CASE WHEN n > 2 THEN ',b' ELSE '' END ELSE CASE WHEN n > 2 THEN 'b' ELSE '' END END AS lanes FROM {FINAL})) WHERE lanes = '' OR r = 1""")
def lane_document_dedupe(t):
    """One finalist for each document and set of lanes."""
    g = F.create_map(F.lit("a"), F.when(F.col("l_partkey") % 2 == 0, 0.9).otherwise(0.1), F.lit("b"), F.when(F.col("n") > 2, 0.8).otherwise(0.2))
    return h.dedupe_lane_documents(_finalists(t).withColumn("g", g), "query_id", "rank", "doc", "g").select("query_id", "chunk", "lanes")


@query(sql=f"""SELECT query_id, chunk, row_number() OVER (PARTITION BY query_id ORDER BY answer DESC, rank) AS place FROM (SELECT *, row_number() OVER (PARTITION BY query_id, answer, CASE WHEN answer THEN 'p' || parent ELSE 'd' || doc END ORDER BY rank) AS r FROM (SELECT *, l_partkey % 4 = 0 AS answer FROM {FINAL})) WHERE r <= CASE WHEN answer THEN 2 ELSE 1 END""")
def enumeration_finalists(t):
    """Answers first, two of a parent; one supporting row of a document."""
    return h.enumerate_finalists(_finalists(t).withColumn("answer", F.col("l_partkey") % 4 == 0), "query_id", "rank", "parent", "doc", "answer").select("query_id", "chunk", "place")


