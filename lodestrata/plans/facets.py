"""Queries for facets, metadata, routing and pluggable models."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text
from ..operators import chunking as ch
from ..operators import facets as fc
from ..operators import graph as g
from .insight import _ranks, uses
from .registry import query
from .retrieval import dense, dense_sql
from .texts import CONTENT


@query(sql=f"""SELECT doc_id, facet, n FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, facet) AS r FROM (SELECT doc_id, facet, count(*) AS n FROM (SELECT doc_id, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS facet FROM (SELECT doc_id, {CONTENT} AS w FROM documents)) GROUP BY ALL HAVING count(*) >= 2)) WHERE r <= 5""")
def phrase_facets(t):
    """Five most frequent word pairs of each document."""
    return fc.phrase_facets(t.documents, "doc_id", "text", 5)


@query(sql=f"""WITH w AS (SELECT source, doc_id, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z][a-z0-9]*'))) AS word FROM documents), l AS (SELECT DISTINCT label, word FROM (SELECT label, word FROM (VALUES ('article', 'the'), ('article', 'der'), ('article', 'le'), ('link', 'and'), ('link', 'und'), ('link', 'y'), ('secret', 'token')) v(label, word)))
SELECT source, label, docs, round(docs / n, 6) AS share FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY docs DESC, label) AS r FROM (SELECT source, label, count(DISTINCT doc_id) AS docs FROM w JOIN l USING (word) GROUP BY ALL)) JOIN (SELECT source, count(*) AS n FROM documents GROUP BY source) USING (source) WHERE r <= 2""")
def schema_lens(t):
    """The labels whose words most documents of a source hold."""
    rows = [("article", "the"), ("article", "der"), ("article", "le"), ("link", "and"), ("link", "und"), ("link", "y"), ("secret", "token")]
    return fc.label_lens(t.documents, "doc_id", "text", "source", t.spark.createDataFrame(rows, "label string, word string"), 2)


@query(sql="""SELECT doc, kind, value, weight, sources, n FROM (SELECT *, row_number() OVER (PARTITION BY doc, kind ORDER BY sources DESC, weight DESC, value) AS r FROM (SELECT l_orderkey AS doc, l_returnflag AS kind, trim(regexp_replace(lower(p_name), '[^a-z0-9]+', ' ', 'g')) AS value, round(sum(l_discount), 6) AS weight, count(DISTINCT l_suppkey) AS sources, count(*) AS n FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY ALL)) WHERE r <= 2""")
def librarian_card(t):
    """Observations of an order's parts merged by name, the strongest of each kind."""
    x = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey"))
    return fc.card(x.select(F.col("l_orderkey").alias("doc"), F.col("l_returnflag").alias("kind"), F.col("p_name").alias("name"), "l_suppkey", "l_discount"), "doc", "kind", "name", "l_suppkey", "l_discount", 2)


@query(sql="""WITH q AS (SELECT item_id, trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')) AS q FROM benchmark), v AS (SELECT item_id, q, f.id, v, list_distinct(string_split(v, ' ')) AS w, list_intersect(list_distinct(string_split(v, ' ')), list_distinct(string_split(q, ' '))) AS b FROM q, (SELECT item_id AS id, unnest([array_to_string(list_slice(string_split(trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')), ' '), 2, 4), ' '), array_to_string(list_slice(string_split(trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')), ' '), 9, 9), ' ')]) AS v FROM benchmark WHERE item_id % 5 = 0) f)
SELECT item_id, id, max(s) AS score FROM (SELECT item_id, id, CASE WHEN v = '' THEN 0.0::DOUBLE ELSE CASE WHEN contains(q, v) THEN 6e0 + least(len(w), 4) ELSE 0 END + CASE WHEN len(b) > 0 AND (len(b) >= 2 OR len(list_filter(b, lambda x: length(x) >= 7)) > 0) THEN 2e0 * len(b) + 2e0 * len(b) / len(w) ELSE 0 END END AS s FROM v) GROUP BY ALL HAVING max(s) > 3""")
def facet_match(t):
    """Passages against the facets of every fifth one."""
    flat = F.split(F.trim(F.regexp_replace(F.lower("text"), "[^a-z0-9]+", " ")), " ")
    f = t.benchmark.where("item_id % 5 = 0").select(F.col("item_id").alias("id"), F.array(F.array_join(F.slice(flat, 2, 3), " "), F.array_join(F.slice(flat, 9, 1), " ")).alias("values"))
    x = t.benchmark.select("item_id", "text").crossJoin(F.broadcast(f) if f.limit(10_001).count() <= 10_000 else f)  # a question's facets
    return x.select("item_id", "id", fc.facet_match(F.col("text"), F.col("values")).alias("score")).where("score > 3")


@query(sql="""SELECT doc_id, array_to_string(list_sort(list_distinct(list_filter(list_transform(list_concat(string_split(ids, ','), CASE WHEN trim(lang) <> '' THEN [lang] ELSE [] END), lambda v: trim(replace(lower(v), '_', ' '))), lambda v: v <> ''))), '|') AS terms, CASE WHEN doc_id % 4 = 0 THEN 2 ELSE 1 END + CASE WHEN trim(lang) <> '' THEN 1 ELSE 0 END AS n FROM (SELECT doc_id, coalesce(lang, '') AS lang, source || ',Topic_' || doc_id % 7 AS ids FROM documents)""")
def metadata_facets(t):
    """Facet fields folded into metadata, and the terms they carry."""
    kept = F.when(F.col("doc_id") % 4 == 0, F.create_map(F.lit("author"), F.lit("x"), F.lit("facet_ids"), F.lit("old")))
    facets = F.create_map(F.lit("ids"), F.concat("source", F.lit(",Topic_"), (F.col("doc_id") % 7).cast("string")), F.lit("lang"), F.col("lang"), F.lit("none"), F.lit(" "))
    m = fc.merged_metadata(kept, facets)
    return t.documents.select("doc_id", F.array_join(fc.metadata_terms(m), "|").alias("terms"), F.size(m).alias("n"))


@query(sql=f"""WITH p AS (SELECT k.query_id, k.vec_id, k.rank, k.score, e.label % 4 AS m, e.label % 3 = 0 AS pref FROM ({dense_sql(10)}) k JOIN embeddings e USING (vec_id))
SELECT query_id, vec_id, round(score + CASE WHEN coalesce(pref, false) THEN 3e-2 ELSE 0 END + CASE WHEN rank > 3 AND m IN (SELECT m FROM p x WHERE x.query_id = p.query_id AND x.rank <= 3) THEN 2e-2 ELSE 0 END, 6) AS ranked_score FROM p""")
def rank_bonuses(t):
    """Bonuses for a preferred kind and for what shares a mechanism with the leaders."""
    p = dense(t, 10).join(t.embeddings.select("vec_id", "label"), "vec_id").withColumn("m", F.array((F.col("label") % 4).cast("string")))
    return fc.bonuses(p, "query_id", "rank", "score", "label", F.col("label") % 3 == 0, "m").select("query_id", "vec_id", "ranked_score")


@query(sql="""WITH a AS (SELECT DISTINCT item_id, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z][a-z0-9]*'))) AS term FROM benchmark), f AS (SELECT doc_id, term, sum(w) AS tf FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z][a-z0-9]*')) AS term, 1.0::DOUBLE AS w FROM documents UNION ALL SELECT doc_id, unnest(regexp_extract_all(lower(source || ' ' || lang), '[a-z][a-z0-9]*')), 5.0 FROM documents) GROUP BY ALL),
s AS (SELECT item_id, doc_id, sum(tf) AS raw FROM a JOIN f USING (term) GROUP BY ALL)
SELECT item_id, doc_id, score, rank FROM (SELECT item_id, doc_id, round(raw / max(raw) OVER (PARTITION BY item_id), 4) AS score, row_number() OVER (PARTITION BY item_id ORDER BY raw DESC, doc_id) AS rank FROM s) WHERE rank <= 5""")
def text_index(t):
    """Weighted counts over heading and text, as shares of the best."""
    d = t.documents.withColumn("head", F.concat_ws(" ", "source", "lang"))
    q = t.benchmark.select("item_id", F.array_distinct(text.words("text")).alias("terms"))
    return fc.text_index(d, "doc_id", q, "item_id", "terms", {"text": 1.0, "head": 5.0}, 5)


@query(sql=f"""WITH {_ranks(5)}, d AS (SELECT src AS vec_id, count(*) AS degree FROM b GROUP BY src)
SELECT query_id, vec_id, round(score * (1 + 15e-2 * ln(1 + least(50e0, greatest(coalesce(degree, 0), 500 * coalesce(round(rank, 9), 0))))), 6) AS boosted FROM (SELECT query_id, vec_id, score FROM ({dense_sql(10)})) LEFT JOIN d USING (vec_id) LEFT JOIN (SELECT node AS vec_id, rank FROM r5) USING (vec_id)""")
def pagerank_boost(t):
    """Scores boosted by degree or PageRank, whichever says more."""
    e = uses(t)
    degree = g.degrees(e).select(F.col("node").alias("vec_id"), "degree")
    rank = g.pagerank(e, 5).select(F.col("node").alias("vec_id"), "rank")
    return fc.metrics_boost(dense(t, 10).drop("rank"), degree, rank, "vec_id", "score", e.limit(1).count()).select("query_id", "vec_id", "boosted")


ROUTES = f"""(SELECT query_id, vec_id, score, seat FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(8e-1 * score - (1 - 8e-1) * nth, 6) DESC, score DESC, vec_id) AS seat FROM (SELECT *, row_number() OVER (PARTITION BY query_id, label ORDER BY score DESC, vec_id) - 1 AS nth FROM (
 SELECT *, max(CASE WHEN gap >= 2e-2 THEN (gap, -i) END) OVER (PARTITION BY query_id) AS cut FROM (SELECT *, row_number() OVER o AS i, round(score - lead(score) OVER o, 6) AS gap FROM (SELECT *, max(score) OVER (PARTITION BY query_id) AS top FROM (SELECT * FROM (SELECT k.query_id, k.vec_id, k.score, e.label, row_number() OVER (PARTITION BY query_id, label ORDER BY score DESC, k.vec_id) AS g FROM ({dense_sql(40)}) k JOIN embeddings e USING (vec_id)) WHERE g <= 3))
 WHERE score >= greatest(1e-1, top - 9e-1) WINDOW o AS (PARTITION BY query_id ORDER BY score DESC, vec_id))) WHERE cut IS NULL OR i <= -cut[2])) WHERE seat <= 6)"""


@query(sql=f"SELECT * FROM {ROUTES}")
def document_routes(t):
    """Documents for a question: fair over groups, cut at the cliff, spread over groups."""
    hits = dense(t, 40).drop("rank").join(t.embeddings.select("vec_id", "label"), "vec_id")
    return fc.route_documents(hits, "query_id", "vec_id", "label", "score", 3, 0.1, 0.9, 0.02, 6).select("query_id", "vec_id", "score", "seat")


@query(sql="""WITH n AS (SELECT o_custkey AS doc, o_orderkey AS node, (o_orderkey * 31 % 97) / 97.0::DOUBLE AS s FROM orders), r AS (SELECT DISTINCT o_custkey % 20 AS query_id, o_custkey AS doc FROM orders), b AS (SELECT * FROM (SELECT query_id, doc, node, s, row_number() OVER (PARTITION BY query_id, doc ORDER BY s DESC, node) AS q FROM r JOIN n USING (doc)) WHERE q <= 2),
p AS (SELECT query_id, doc, l_partkey AS parent, max(s) AS s, min(l_linenumber) AS pos FROM b JOIN lineitem ON l_orderkey = node GROUP BY ALL)
SELECT query_id, doc, parent, round(s, 6) AS score, place FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, doc, pos, parent) AS place FROM p) WHERE place <= 12""")
def tree_navigation(t):
    """Parents under the best nodes of each routed document."""
    n = t.orders.select(F.col("o_custkey").alias("doc"), F.col("o_orderkey").alias("node"), ((F.col("o_orderkey") * 31 % 97) / 97.0).alias("near"))
    routes = t.orders.select((F.col("o_custkey") % 20).alias("query_id"), F.col("o_custkey").alias("doc")).distinct()
    m = t.lineitem.select(F.col("l_orderkey").alias("node"), F.col("l_partkey").alias("parent"), F.col("l_linenumber").alias("position"))
    return fc.navigate(routes, n, m, "query_id", "doc", F.col("near"), 2, 12)


@query(sql="""WITH p AS (SELECT doc_id % 20 AS item_id, doc_id, text FROM documents), q AS (SELECT item_id, list_distinct(list_filter(string_split(regexp_replace(lower(text), '[^\\p{L}\\p{N}]', ' ', 'g'), ' '), lambda w: w <> '')) AS q FROM benchmark)
SELECT item_id, doc_id, rerank_score, rank FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY rerank_score DESC, doc_id) AS rank FROM (SELECT item_id, doc_id, round(len(list_intersect(q, list_distinct(string_split(regexp_replace(lower(text), '[^\\p{L}\\p{N}]', ' ', 'g'), ' ')))) / greatest(1, len(q)), 6) AS rerank_score FROM p JOIN q USING (item_id))) WHERE rank <= 4""")
def model_rerank(t):
    """Candidates by the stand-in for a cross-encoder."""
    p = t.documents.select((F.col("doc_id") % 20).alias("item_id"), "doc_id", "text").join(t.benchmark.select("item_id", F.col("text").alias("q")), "item_id")
    return fc.rerank(p, "item_id", "q", "text", "doc_id", 4).select("item_id", "doc_id", "rerank_score", "rank")


@query()
def model_embedding(t):
    """A hashed vector of each conversation turn."""
    return fc.embed(t.conversations.select("conv_id", "turn", "text"), "text").drop("text")


@query()
def structured_chunks(t):
    """Blocks of all documents by their shape."""
    return ch.structured_pieces(t.documents, "doc_id", "text", 64, 96)


@query()
def page_blocks(t):
    """Turns of a conversation as pages, joined into blocks of 60 words."""
    return ch.page_blocks(t.conversations, "conv_id", "turn", "text", 60, 20, 90)
