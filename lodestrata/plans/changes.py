"""Queries for journals and undo, deletes with provenance, archives, rescans and sign-bit search."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import changes as c
from ..operators import graph as g
from ..operators import signbits
from ..operators.relational import cut
from .graph import EDGES, edges
from .registry import Tables, query
from .retrieval import COS

_MOVED = "(SELECT least(u, v) AS u, greatest(u, v) AS v, sum(w)::BIGINT AS w FROM (SELECT CASE WHEN u % 10 = {0} THEN u - {0} ELSE u END AS u, CASE WHEN v % 10 = {0} THEN v - {0} ELSE v END AS v, w FROM {1}) WHERE u <> v GROUP BY ALL)"


def _merged(table, t: Tables, last: int):
    """Every tenth part is merged into the first of its ten."""
    s = t.part.where(F.col("p_partkey") % 10 == last).select(F.col("p_partkey").alias("node"), (F.col("p_partkey") - last).alias("survivor"))
    return cut(g.redirect(table, s))


@query(sql=f"SELECT u, v, 1::BIGINT AS run, a.w AS old_w, b.w AS new_w FROM {EDGES} a FULL JOIN {_MOVED.format(7, EDGES)} b USING (u, v) WHERE a.w IS DISTINCT FROM b.w")
def merge_journal(t):
    """What merging parts changes in the edges: before and after of each row."""
    e = cut(edges(t))
    return c.journal(e, _merged(e, t, 7), ["u", "v"], 1).select("u", "v", "run", F.col("old.w").alias("old_w"), F.col("new.w").alias("new_w"))


@query(sql=f"SELECT u, v, w FROM {EDGES}")
def merge_undo(t):
    """Two runs of merges over the same survivors, taken back from their journal."""
    e = cut(edges(t))
    one = _merged(e, t, 7)
    two = _merged(one, t, 3)
    changes = cut(c.journal(e, one, ["u", "v"], 1).unionByName(c.journal(one, two, ["u", "v"], 2)))
    return c.undo(two, changes, ["u", "v"])


@query(sql="SELECT l_partkey AS u, l_suppkey AS v, count(DISTINCT l_orderkey) AS support FROM lineitem WHERE l_orderkey % 50 <> 0 GROUP BY ALL")
def document_delete(t):
    """Relations of parts and suppliers after every fiftieth order is deleted: those without other support go."""
    p = t.lineitem.select(F.col("l_partkey").alias("u"), F.col("l_suppkey").alias("v"), F.col("l_orderkey").alias("doc_id")).distinct()
    e = p.groupBy("u", "v").agg(F.count("*").alias("support"))
    gone = t.orders.where("o_orderkey % 50 = 0").select(F.col("o_orderkey").alias("doc_id"))
    return c.delete_documents(e, p, gone, ["u", "v"])[0]


@query(sql="""SELECT substr(sha256('orders|' || o_orderkey || '|copy'), 1, 32) AS o_orderkey, CASE WHEN c_custkey IS NOT NULL THEN substr(sha256('customer|' || o_custkey || '|copy'), 1, 32) END AS o_custkey, o_totalprice
FROM orders LEFT JOIN (SELECT c_custkey FROM customer WHERE c_custkey % 3 > 0) ON c_custkey = o_custkey""")
def archive_remap(t):
    """Orders imported for another owner, with two thirds of the customers: ids and references are new."""
    tables = {"customer": t.customer.where("c_custkey % 3 > 0"), "orders": t.orders.select("o_orderkey", "o_custkey", "o_totalprice")}
    return c.remapped(tables, {"customer": "c_custkey", "orders": "o_orderkey"}, {"orders": [("o_custkey", "customer")]}, "copy")[0]["orders"]


@query(sql="""WITH f AS (SELECT doc_id AS path, sha256(text) AS hash FROM documents WHERE doc_id % 13 > 0), k AS (SELECT doc_id AS path, sha256(CASE WHEN doc_id % 11 = 0 THEN text || '.' ELSE text END) AS hash FROM documents WHERE doc_id % 7 > 0)
SELECT path, coalesce(f.hash, k.hash) AS hash, CASE WHEN k.hash IS NULL THEN 'new' WHEN f.hash IS NULL THEN 'gone' WHEN f.hash = k.hash THEN 'unchanged' ELSE 'changed' END AS state FROM f FULL JOIN k USING (path)""")
def rescan_states(t):
    """Documents against an earlier scan of which some are new, changed or gone."""
    d = t.documents
    now = d.where("doc_id % 13 > 0").select(F.col("doc_id").alias("path"), F.sha2("text", 256).alias("hash"))
    was = d.where("doc_id % 7 > 0").select(F.col("doc_id").alias("path"), F.sha2(F.when(F.col("doc_id") % 11 == 0, F.concat("text", F.lit("."))).otherwise(F.col("text")), 256).alias("hash"))
    return c.rescan(now, was)


_BITS = "(SELECT vec_id, embedding::DOUBLE[] AS v, list_reduce(list_concat([0::UBIGINT], list_transform(embedding[1:63], lambda x: (x > 0)::UBIGINT)), lambda a, b: a * 2 + b) AS hi, (embedding[64] > 0)::INT AS lo FROM embeddings)"


@query(sql=f"""WITH b AS MATERIALIZED {_BITS}, p AS (SELECT q.vec_id AS query_id, a.vec_id, bit_count(xor(a.hi, q.hi)) + (a.lo <> q.lo)::INT AS far FROM b a, b q WHERE q.vec_id % 50 = 0),
n AS (SELECT query_id, vec_id FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY far, vec_id) AS r FROM p) WHERE r <= 160)
SELECT query_id, vec_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM (SELECT n.query_id, n.vec_id, round({COS}, 6) AS score FROM n JOIN b q ON q.vec_id = n.query_id JOIN b b ON b.vec_id = n.query_id JOIN b a ON a.vec_id = n.vec_id)) WHERE rank <= 10""")
def signbit_knn(t):
    """Ten nearest of every fiftieth vector: 160 by sign bits, then by cosine."""
    e = t.embeddings.withColumn("embedding", F.col("embedding").cast("array<double>"))
    q = e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    return signbits.knn(e, q, "vec_id", "query_id", "embedding", "q", 10)
