"""Queries for search, fusion, selection and ranking metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text
from ..operators import relational as rel
from ..operators import retrieval as r
from .registry import Tables, query

WORDS = "regexp_extract_all(lower(text), '[a-z][a-z0-9]*')"


def lexical_sql(k: int) -> str:
    return f"""SELECT item_id, doc_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM (
SELECT q.item_id, d.doc_id, round(sum(q.tf_q * d.tf * i.idf), 6) AS score FROM (SELECT item_id, term, count(*) AS tf_q FROM (SELECT item_id, unnest({WORDS}) AS term FROM benchmark) GROUP BY ALL) q
JOIN (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({WORDS}) AS term FROM documents) GROUP BY ALL) d USING (term)
JOIN (SELECT term, ln(1 + ((SELECT count(*) FROM documents) - count(DISTINCT doc_id) + 0.5) / (count(DISTINCT doc_id) + 0.5)) AS idf FROM (SELECT doc_id, unnest({WORDS}) AS term FROM documents) GROUP BY term) i USING (term)
GROUP BY q.item_id, d.doc_id)) WHERE rank <= {k}"""


def lexical(t: Tables, k: int):
    return r.tfidf_search(t.documents, t.benchmark.withColumnRenamed("text", "q"), "doc_id", "item_id", text.words("text"), text.words("q"), k)


COS = "list_dot_product(a.v, b.v) / (sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v)))"
VEC = "(SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings)"


def dense_sql(k: int) -> str:
    return f"""SELECT query_id, vec_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM (
SELECT b.vec_id AS query_id, a.vec_id, round({COS}, 6) AS score FROM {VEC} a, {VEC} b WHERE b.vec_id % 50 = 0)) WHERE rank <= {k}"""


def dense(t: Tables, k: int, where=None):
    e = t.embeddings
    q = e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    return r.knn(e, q, "vec_id", "query_id", "embedding", "q", k, where)


@query(sql=lexical_sql(10))
def lexical_topk(t):
    return lexical(t, 10)


@query(sql=f"""WITH w AS MATERIALIZED (SELECT doc_id, {WORDS} AS w FROM documents), s AS (SELECT count(*) AS n, avg(len(w)) AS mean FROM w), d AS MATERIALIZED (SELECT doc_id, term, any_value(len(w)) AS size, count(*) AS tf FROM (SELECT doc_id, w, unnest(w) AS term FROM w) GROUP BY doc_id, term),
q AS (SELECT item_id, term, count(*) AS tf_q FROM (SELECT item_id, unnest({WORDS}) AS term FROM benchmark) GROUP BY ALL), i AS (SELECT term, ln(1 + ((SELECT n FROM s) - count(*) + 5e-1) / (count(*) + 5e-1)) AS idf FROM d GROUP BY term)
SELECT item_id, doc_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM (SELECT item_id, doc_id, round(sum(tf_q * idf * (tf * 22e-1 / (tf + 12e-1 * (25e-2 + 75e-2 * size / (SELECT mean FROM s))))), 6) AS score FROM q JOIN d USING (term) JOIN i USING (term) GROUP BY ALL)) WHERE rank <= 10""")
def bm25_topk(t):
    """The same search with saturation and length normalisation."""
    return r.tfidf_search(t.documents, t.benchmark.withColumnRenamed("text", "q"), "doc_id", "item_id", text.words("text"), text.words("q"), 10, k1=1.2, b=0.75)


@query(sql=dense_sql(10))
def dense_knn(t):
    return dense(t, 10)


@query(sql=dense_sql(10).replace("WHERE b.vec_id % 50 = 0", "WHERE b.vec_id % 50 = 0 AND a.label IN (1, 2, 3)"))
def filtered_knn(t):
    """Nearest among rows that a payload filter lets through, applied before scoring."""
    return dense(t, 10, F.col("label").isin(1, 2, 3))


@query(sql=f"""SELECT query_id, label, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id, label ORDER BY score DESC, vec_id) AS r FROM (SELECT k.*, e.label FROM ({dense_sql(50)}) k JOIN embeddings e USING (vec_id))) WHERE r <= 2""")
def fair_knn(t):
    """Two nearest of each group among the fifty nearest."""
    k = dense(t, 50).join(t.embeddings.select("vec_id", "label"), "vec_id")
    return rel.top_per_key(k.drop("rank"), ["query_id", "label"], [F.desc("score"), "vec_id"], 2).select("query_id", "label", "vec_id", "score")


POOLS = f"""(SELECT query_id, vec_id AS item, 'dense' AS lane, rank, score FROM ({dense_sql(12)}) UNION ALL
SELECT query_id, vec_id, 'lexical', row_number() OVER (PARTITION BY query_id ORDER BY vec_id % 7, vec_id), round(score * 0.9, 6) FROM ({dense_sql(20)}) WHERE vec_id % 2 = 0)"""


def pools(t: Tables):
    """Two lanes for the same queries: nearest vectors, and another order of some of them."""
    a = dense(t, 12).select("query_id", F.col("vec_id").alias("item"), F.lit("dense").alias("lane"), "rank", "score")
    b = dense(t, 20).where("vec_id % 2 = 0").drop("rank")
    b = rel.ranked(b, ["query_id"], [F.col("vec_id") % 7, "vec_id"]).select("query_id", F.col("vec_id").alias("item"), F.lit("lexical").alias("lane"), "rank", F.round(F.col("score") * 0.9, 6).alias("score"))
    return a.unionByName(b)


WEIGHTS = {"dense": 1.0, "summary": 0.75, "lexical": 0.85, "graph": 0.9}


@query(sql=f"SELECT query_id, item, lanes, round(raw / max(raw) OVER (PARTITION BY query_id), 6) AS score FROM (SELECT query_id, item, sum(CASE lane WHEN 'dense' THEN 1.0 ELSE 0.85 END / (60.0 + rank)) AS raw, count(DISTINCT lane) AS lanes FROM {POOLS} GROUP BY ALL)")
def rrf_fusion(t):
    return r.rrf(pools(t), "query_id", "item", "lane", "rank", WEIGHTS)


@query(sql=f"SELECT query_id, item, max(score) AS score, arg_min(lane, (-score, lane)) AS best_lane, string_agg(DISTINCT lane, ',' ORDER BY lane) AS lanes FROM {POOLS} GROUP BY ALL")
def pool_merge(t):
    return r.merge_pools(pools(t), ["query_id", "item"], "score", "lane")


@query(sql=f"""SELECT query_id, item, lane, score, round(0.82 * CASE WHEN hi > lo THEN (score - lo) / (hi - lo) ELSE 0.5 END + 0.18 * CASE WHEN n > 1 THEN 1 - (i - 1) / (n - 1) ELSE 1 END, 6) AS relevance FROM (
SELECT *, min(score) OVER w AS lo, max(score) OVER w AS hi, count(*) OVER w AS n, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item) AS i FROM (SELECT * FROM {POOLS} WHERE lane = 'dense') WINDOW w AS (PARTITION BY query_id))""")
def minmax_norm(t):
    return r.min_max(pools(t).where("lane = 'dense'").drop("rank"), "query_id", "score", "item")


@query(sql=f"""SELECT query_id, item, score, reserved, seat FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN reserved THEN 0 ELSE 1 END, score DESC, item) AS seat FROM (
SELECT *, row_number() OVER (PARTITION BY query_id, lane ORDER BY score DESC, item) = 1 AS reserved FROM {POOLS})) WHERE seat <= 6""")
def reserve_topk(t):
    return r.reserve(pools(t), "query_id", "lane", "score", "item", 6).select("query_id", "item", "score", "reserved", "seat")


@query(sql=f"SELECT query_id, item, label FROM (SELECT *, row_number() OVER (PARTITION BY query_id, label ORDER BY rank) AS n FROM (SELECT p.*, e.label FROM {POOLS} p JOIN embeddings e ON e.vec_id = p.item WHERE lane = 'dense')) WHERE n <= 2 OR rank <= 3")
def per_doc_cap(t):
    p = pools(t).where("lane = 'dense'").join(t.embeddings.select(F.col("vec_id").alias("item"), "label"), "item")
    return rel.per_document_cap(p, "query_id", "label", "rank", 2, F.col("rank") <= 3).select("query_id", "item", "label")


@query(sql=f"""SELECT query_id, item, score FROM (SELECT *, max(CASE WHEN gap >= 0.02 THEN (gap, -i) END) OVER (PARTITION BY query_id) AS cut FROM (
 SELECT *, row_number() OVER o AS i, round(score - lead(score) OVER o, 6) AS gap FROM (SELECT *, max(score) OVER (PARTITION BY query_id) AS top FROM (SELECT query_id, vec_id AS item, score FROM ({dense_sql(15)}))) WHERE score >= greatest(0.1, top - 0.9)
 WINDOW o AS (PARTITION BY query_id ORDER BY score DESC, item))) WHERE cut IS NULL OR i <= -cut[2]""")
def cliff_cut(t):
    p = dense(t, 15).select("query_id", F.col("vec_id").alias("item"), "score")
    return rel.cliff_cut(p, "query_id", "score", "item", 0.1, 0.9, 0.02)


@query(sql=f"SELECT query_id, item, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item) AS i, max(score) OVER (PARTITION BY query_id) AS top FROM (SELECT query_id, vec_id AS item, score FROM ({dense_sql(15)}))) WHERE i = 1 OR score >= 0.4 * top")
def relevance_floor(t):
    return r.relevance_floor(dense(t, 15).select("query_id", F.col("vec_id").alias("item"), "score"), "query_id", "score", "item", 0.4)


@query(sql=f"SELECT query_id, item, score, round(score * (1 + 0.15 * ln(1 + least(coalesce(degree, 0), 50))), 6) AS boosted FROM (SELECT query_id, vec_id AS item, score FROM ({dense_sql(10)})) LEFT JOIN (SELECT l_partkey AS item, count(DISTINCT l_orderkey) AS degree FROM lineitem GROUP BY l_partkey) USING (item)")
def degree_boost(t):
    degree = t.lineitem.groupBy(F.col("l_partkey").alias("item")).agg(F.countDistinct("l_orderkey").alias("degree"))
    return r.degree_boost(dense(t, 10).select("query_id", F.col("vec_id").alias("item"), "score"), degree, "item", "score").drop("degree")


@query()
def mmr_select(t):
    """Six diverse documents of each passage's twenty best."""
    pool = lexical(t, 20).join(t.documents.select("doc_id", "source", F.array_distinct(text.content_words("text")).alias("tokens")), "doc_id")
    top = F.max("score").over(rel.Window.partitionBy("item_id"))
    return r.mmr(pool.withColumn("score", F.round(F.col("score") / top, 6)), "item_id", "doc_id", "source", "score", "tokens", 6)


@query()
def pack_budget(t):
    """Full text, summary or nothing for each ranked document, within 4000 words."""
    pool = lexical(t, 20).join(t.documents.select("doc_id", text.token_count("text").alias("full")), "doc_id").withColumn("summary", F.least("full", F.lit(60)).cast("long"))
    return r.pack_budget(pool, "item_id", "doc_id", "rank", "full", "summary", 4000)


GOLD = "(SELECT q.vec_id AS query_id, e.vec_id, CASE WHEN abs(q.vec_id - e.vec_id) < 100 THEN 2 ELSE 1 END AS grade FROM embeddings q JOIN embeddings e ON q.label = e.label WHERE q.vec_id % 50 = 0)"


def metrics_sql(k: int) -> str:
    return f"""WITH h AS (SELECT r.query_id, r.rank, coalesce(g.grade, 0) AS g, CASE WHEN g.grade > 0 THEN 1 ELSE 0 END AS rel FROM ({dense_sql(20)}) r LEFT JOIN {GOLD} g USING (query_id, vec_id) WHERE r.rank <= {k}),
c AS (SELECT *, sum(rel) OVER (PARTITION BY query_id ORDER BY rank) AS cum FROM h),
i AS (SELECT query_id, count(*) AS n, sum(CASE WHEN i <= {k} THEN (2 ** grade - 1) / log2(i + 1) END) AS idcg FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY grade DESC, vec_id) AS i FROM {GOLD}) GROUP BY query_id)
SELECT query_id, round(coalesce(max(CASE WHEN rel = 1 THEN 1 / rank END), 0), 6) AS mrr, round(sum(rel * cum / rank) / least(any_value(n), {k}), 6) AS ap, round(sum(rel) / any_value(n), 6) AS recall, round(sum((2 ** g - 1) / log2(rank + 1)) / any_value(idcg), 6) AS ndcg FROM c JOIN i USING (query_id) GROUP BY query_id"""


@query(sql=metrics_sql(8))
def ranking_metrics(t):
    """Reciprocal rank, average precision, recall and NDCG at 8; same label is relevant, near ids more so."""
    e = t.embeddings
    q = e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "label")
    gold = q.join(e.select("vec_id", "label"), "label").select("query_id", "vec_id", F.when(F.abs(F.col("query_id") - F.col("vec_id")) < 100, 2).otherwise(1).alias("grade"))
    return r.ranking_metrics(dense(t, 20), gold, "query_id", "vec_id", "rank", "grade", 8)


@query(sql=f"SELECT avg(mrr) AS mrr, avg(ap) AS map, avg(ndcg) AS ndcg, quantile_cont(recall, 0.5) AS p50, quantile_cont(recall, 0.95) AS p95, count(*) AS n FROM ({metrics_sql(8)})")
def route_summary(t):
    m = ranking_metrics(t)
    return m.agg(F.avg("mrr").alias("mrr"), F.avg("ap").alias("map"), F.avg("ndcg").alias("ndcg"), F.percentile("recall", F.lit(0.5)).alias("p50"), F.percentile("recall", F.lit(0.95)).alias("p95"), F.count("*").alias("n"))


@query(sql="SELECT label, i - 1 AS pos, round(avg(x), 6) AS mean FROM (SELECT label, unnest(embedding)::DOUBLE AS x, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings) GROUP BY label, i")
def vector_mean_by_label(t):
    """Mean vector of each group, by position."""
    e = t.embeddings.select("label", F.posexplode("embedding").alias("pos", "x"))
    return e.groupBy("label", F.col("pos").cast("long").alias("pos")).agg(F.round(F.avg(F.col("x").cast("double")), 6).alias("mean"))


@query(sql=f"SELECT a.vec_id AS a, b.vec_id AS b, round({COS}, 6) AS cosine FROM {VEC} a JOIN {VEC} b ON a.label = b.label AND a.vec_id // 50 = b.vec_id // 50 AND a.vec_id < b.vec_id WHERE {COS} >= 0.9")
def blocked_vector_pairs(t):
    """Pairs at cosine .90 or more within blocks of label and key prefix."""
    e = t.embeddings.select("vec_id", "label", F.floor(F.col("vec_id") / 50).alias("block"), "embedding")
    b = e.select(F.col("vec_id").alias("b"), "label", "block", F.col("embedding").alias("w"))
    x = e.withColumnRenamed("vec_id", "a").join(b, ["label", "block"]).where("a < b").withColumn("cosine", r.cosine(F.col("embedding"), F.col("w")))
    return x.where("cosine >= 0.9").select("a", "b", F.round("cosine", 6).alias("cosine"))


@query(sql="""SELECT label, t.class AS class, least(t.p, t.g)::BIGINT AS tp, t.p::BIGINT AS predicted, t.g::BIGINT AS gold FROM (SELECT coalesce(p.class, g.class) AS class, coalesce(p.label, g.label) AS label, coalesce(p.n, 0) AS p, coalesce(g.n, 0) AS g FROM
 (SELECT source AS label, lang AS class, count(*) AS n FROM documents WHERE doc_id % 2 = 0 GROUP BY ALL) p FULL JOIN (SELECT source AS label, lang AS class, count(*) AS n FROM documents WHERE doc_id % 2 = 1 GROUP BY ALL) g ON p.label = g.label AND p.class = g.class) t""")
def multiset_overlap(t):
    """Counts of true positives between two multisets of (label, class)."""
    side = lambda odd, n: t.documents.where(F.col("doc_id") % 2 == odd).groupBy(F.col("source").alias("label"), F.col("lang").alias("class")).agg(F.count("*").alias(n))
    j = side(0, "predicted").join(side(1, "gold"), ["label", "class"], "full_outer").fillna(0, ["predicted", "gold"])
    return j.select("label", "class", F.least("predicted", "gold").alias("tp"), "predicted", "gold")


@query(sql="""SELECT item_id, doc_id, score FROM (SELECT item_id, doc_id, CASE WHEN n > 0 THEN round(least(0.98, 0.45 + 0.35 * n / greatest(len(terms), 1) + CASE WHEN contains(low, phrase) THEN 0.18 ELSE 0 END), 4) ELSE 0.0 END AS score FROM (
 SELECT item_id, doc_id, low, terms, phrase, len(list_filter(terms, lambda t: contains(hay, ' ' || t || ' '))) AS n
 FROM (SELECT doc_id, lower(text) AS low, ' ' || trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')) || ' ' AS hay FROM documents), (SELECT item_id, lower(trim(text)) AS phrase, list_distinct(regexp_extract_all(lower(text), '[a-z][a-z0-9]*')) AS terms FROM benchmark))) WHERE score > 0.6""")
def lexical_regex_score(t):
    """The fallback score of all passages against all documents."""
    terms, flat = F.array_distinct(text.words("text")), F.split(F.trim(text.padded("text")), " ")
    # .45 + .35 coverage is above .6 from three sevenths on; a phrase that occurs brings all its whole words but the first and the last
    inner = F.size(F.array_intersect(terms, F.slice(flat, 2, F.greatest(F.size(flat) - 2, F.lit(0)))))
    hits = F.greatest(F.lit(1), F.least(F.ceil(F.size(terms) * 3 / 7 - 1e-6).cast("int"), inner))
    q = t.benchmark.select("item_id", F.col("text").alias("phrase"), terms.alias("terms"), hits.alias("hits"))
    return r.against_all(t.documents, "doc_id", q, "item_id", text.scanned("text", F.lit("")), lambda row, q, n: text.lexical_score(q["terms"], row, q["phrase"], n), 0.6, lambda row: row["flat"], "terms", "hits")
