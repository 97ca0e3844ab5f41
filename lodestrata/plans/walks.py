"""Queries over typed relations. Entities are parts, chunks orders; line items state relations between parts and suppliers' parts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text
from ..operators import walks as w
from ..operators.graph import TASK_ROWS
from .registry import Tables, query

MENTION = "(SELECT l_orderkey AS chunk, l_partkey AS entity, max(l_discount * 10) AS conf FROM lineitem GROUP BY ALL)"
RELATION = """(SELECT l_partkey AS subject, l_suppkey AS object, CASE l_returnflag WHEN 'R' THEN 'related_to' WHEN 'A' THEN 'uses' ELSE 'calls' END AS predicate, l_discount * 10 AS confidence,
 CASE l_linenumber % 3 WHEN 1 THEN 'strong' WHEN 2 THEN 'repaired' END AS strength, CASE WHEN l_linenumber < 4 THEN 'quote' ELSE '' END AS evidence, l_orderkey AS chunk FROM lineitem)"""
USABLE = f"""(SELECT subject AS src, object AS dst, predicate, weight, chunk FROM (SELECT *, confidence * CASE WHEN predicate = 'related_to' THEN 0.5 WHEN strength = 'strong' THEN 1.0 ELSE 0.7 END AS weight FROM {RELATION} WHERE subject <> object AND CASE WHEN predicate = 'related_to' THEN evidence <> '' ELSE strength IS NOT NULL END)
 UNION ALL SELECT object, subject, predicate, weight, chunk FROM (SELECT *, confidence * CASE WHEN predicate = 'related_to' THEN 0.5 WHEN strength = 'strong' THEN 1.0 ELSE 0.7 END AS weight FROM {RELATION} WHERE subject <> object AND CASE WHEN predicate = 'related_to' THEN evidence <> '' ELSE strength IS NOT NULL END))"""


def mentions(t: Tables):
    return t.lineitem.groupBy(F.col("l_orderkey").alias("chunk"), F.col("l_partkey").alias("entity")).agg(F.max(F.col("l_discount") * 10).alias("conf"))


def _dealt(t: Tables):
    """Mentions, and the number of tasks that the rows ask for: those of an order lie in one of them."""
    n = t.lineitem.count() // TASK_ROWS + 1
    m = t.lineitem.select(F.col("l_orderkey").alias("chunk"), F.col("l_partkey").alias("entity"), "l_discount").repartition(n, "chunk")
    return m.groupBy("chunk", "entity").agg(F.max(F.col("l_discount") * 10).alias("conf")), n


def relations(t: Tables):
    predicate = F.when(F.col("l_returnflag") == "R", "related_to").when(F.col("l_returnflag") == "A", "uses").otherwise("calls")
    strength = F.when(F.col("l_linenumber") % 3 == 1, "strong").when(F.col("l_linenumber") % 3 == 2, "repaired")
    return t.lineitem.select(
        F.col("l_partkey").alias("subject"), F.col("l_suppkey").alias("object"), predicate.alias("predicate"), (F.col("l_discount") * 10).alias("confidence"),
        strength.alias("strength"), F.when(F.col("l_linenumber") < 4, "quote").otherwise("").alias("evidence"), F.col("l_orderkey").alias("chunk"),
    )


def seeds(t: Tables):
    return t.orders.where("o_orderkey % 50 = 0").select(F.col("o_orderkey").alias("chunk"))


def _walk_sql(rel: str) -> str:
    return f"""WITH m AS MATERIALIZED (SELECT * FROM {MENTION}), a AS (SELECT entity AS src, sum(conf) AS c1 FROM m WHERE chunk % 50 = 0 GROUP BY entity),
n AS (SELECT dst AS entity, sum(c1 * weight) AS c2 FROM a JOIN {rel} r USING (src) GROUP BY dst)
SELECT chunk, round(sum(c2 * conf), 6) AS score, count(DISTINCT entity) AS via FROM m JOIN n USING (entity) WHERE chunk % 50 <> 0 GROUP BY chunk ORDER BY score DESC, chunk LIMIT 40"""


@query(sql=_walk_sql(USABLE))
def relation_walk(t):
    """Chunks reached from the seed chunks over usable relations."""
    m, n = _dealt(t)
    return w.relation_walk(m, w.usable(relations(t)), seeds(t), 40, n)


@query(sql=_walk_sql(f"(SELECT subject AS src, object AS dst, confidence AS weight FROM {RELATION} WHERE predicate = 'calls' AND subject <> object UNION ALL SELECT object, subject, confidence FROM {RELATION} WHERE predicate = 'calls' AND subject <> object)"))
def call_walk(t):
    """The same walk over call edges."""
    m, n = _dealt(t)
    return w.relation_walk(m, w.calls(relations(t)), seeds(t), 40, n)


@query(sql=f"""WITH m AS MATERIALIZED (SELECT * FROM {MENTION}), mine AS (SELECT DISTINCT entity FROM m WHERE chunk % 500 = 0), b AS (SELECT p_partkey AS a, p_partkey + 1 AS b, 0.3 + (p_partkey % 7) * 0.1 AS score FROM part WHERE p_partkey % 5 = 0),
far AS (SELECT entity, max(score) AS bonus FROM (SELECT a AS near, b AS entity, score FROM b UNION ALL SELECT b, a, score FROM b) WHERE near IN (SELECT entity FROM mine) AND entity NOT IN (SELECT entity FROM mine) GROUP BY entity)
SELECT chunk, score, via FROM (SELECT chunk, round(least(1.0, bonus * conf), 6) AS score, entity AS via, row_number() OVER (PARTITION BY chunk ORDER BY round(least(1.0, bonus * conf), 6) DESC, entity) AS r FROM m JOIN far USING (entity) WHERE chunk % 500 <> 0) WHERE r = 1 ORDER BY score DESC, chunk LIMIT 30""")
def bridge_bonus(t):
    """Chunks across bridges that the seeds touch on one side."""
    b = t.part.where("p_partkey % 5 = 0").select(F.col("p_partkey").alias("a"), (F.col("p_partkey") + 1).alias("b"), (0.3 + (F.col("p_partkey") % 7) * 0.1).alias("score"))
    return w.bridge_bonus(mentions(t), b, t.orders.where("o_orderkey % 500 = 0").select(F.col("o_orderkey").alias("chunk")), 30)


@query(sql=f"""WITH u AS MATERIALIZED (SELECT * FROM {USABLE}), m AS (SELECT chunk AS winner, entity AS src FROM (SELECT *, row_number() OVER (PARTITION BY chunk ORDER BY conf DESC, entity) AS r FROM {MENTION} WHERE chunk % 50 = 0) WHERE r <= 3),
e AS (SELECT src, dst, predicate, max(weight) AS weight FROM u GROUP BY ALL), c AS (SELECT p_partkey AS entity FROM part WHERE contains(p_name, 'ring')),
x AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY winner ORDER BY hits + CASE WHEN predicate = 'uses' THEN 1 ELSE 0 END DESC, weight DESC, src, dst, predicate) AS r FROM (SELECT winner, src, dst, predicate, weight, (src IN (SELECT entity FROM c))::INT + (dst IN (SELECT entity FROM c))::INT AS hits FROM m JOIN e USING (src)) WHERE hits > 0) WHERE r <= 8),
y AS (SELECT * FROM (SELECT x.*, evidence, row_number() OVER (PARTITION BY winner, src, dst, predicate ORDER BY evidence) AS q FROM x JOIN (SELECT DISTINCT src, dst, predicate, chunk AS evidence FROM u) USING (src, dst, predicate) WHERE evidence <> winner) WHERE q <= 2)
SELECT winner, src AS seed, dst AS neighbor, predicate, round(weight, 6) AS weight, evidence FROM x LEFT JOIN (SELECT winner, src, dst, predicate, evidence FROM y) USING (winner, src, dst, predicate)""")
def graph_decoration(t):
    """Relations of winning chunks that touch the question's concepts, with evidence."""
    concepts = t.part.where(F.contains("p_name", F.lit("ring"))).select(F.col("p_partkey").alias("entity"))
    return w.decorate(seeds(t), mentions(t), w.usable(relations(t)), concepts=concepts)


_FACTS = "SELECT l_orderkey * 10 + l_linenumber AS fact, l_partkey AS entity, l_orderkey AS chunk, l_discount * 10 AS confidence FROM lineitem"


@query(sql=f"""SELECT chunk, score, fact FROM (SELECT chunk, round(0.82 + 0.18 * confidence, 6) AS score, fact, row_number() OVER (PARTITION BY chunk ORDER BY confidence DESC, fact) AS r FROM (SELECT f.* FROM ({_FACTS}) f WHERE entity IN (SELECT p_partkey FROM part WHERE contains(p_name, 'ring')) ORDER BY confidence DESC, fact LIMIT 60))
 WHERE r = 1 AND chunk NOT IN (SELECT o_orderkey FROM orders WHERE o_orderpriority LIKE '5%')""")
def fact_seed_chunks(t):
    """Evidence chunks of the asked entities' facts, noisy ones dropped."""
    f = t.lineitem.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("fact"), F.col("l_partkey").alias("entity"), F.col("l_orderkey").alias("chunk"), (F.col("l_discount") * 10).alias("confidence"))
    s = w.fact_seeds(f, t.part.where(F.contains("p_name", F.lit("ring"))).select(F.col("p_partkey").alias("entity")), 60)
    kind = F.when(F.col("o_orderpriority").startswith("5"), "bibliography").otherwise("body")
    return w.drop_noisy(s, t.orders.select(F.col("o_orderkey").alias("chunk"), kind.alias("kind")), text.is_noisy("kind"))


@query(sql=f"""SELECT sha256('support' || chr(31) || edge_key || chr(31) || 'main' || chr(31) || coalesce(parent::VARCHAR, '') || chr(31) || chunk) AS support_id, edge_key, subject, predicate, object, parent, chunk, max(confidence) AS confidence FROM (
 SELECT concat_ws('|', subject, predicate, object) AS edge_key, subject, predicate, object, CASE WHEN o_custkey % 9 > 0 THEN o_custkey END AS parent, chunk, confidence FROM {RELATION} LEFT JOIN orders ON o_orderkey = chunk) GROUP BY ALL""")
def relation_support(t):
    """Deterministic support rows of every relation."""
    parents = t.orders.where("o_custkey % 9 > 0").select(F.col("o_orderkey").alias("chunk"), F.col("o_custkey").alias("parent"))
    return w.support_rows(relations(t), parents, "main")


@query(sql=f"""WITH e AS (SELECT subject, predicate, object, chunk, max(confidence) AS confidence FROM {RELATION} WHERE subject <> object GROUP BY ALL)
SELECT subject, predicate, object, max(confidence) AS confidence, count(*) AS n_evidence, string_agg(chunk, ',' ORDER BY chunk) FILTER (WHERE r <= 5) AS evidence FROM (SELECT *, row_number() OVER (PARTITION BY subject, predicate, object ORDER BY chunk) AS r FROM e) GROUP BY ALL""")
def graph_edges(t):
    """Relation rows folded into edges with provenance."""
    return w.graph_tables(relations(t))


@query(sql=f"""SELECT kind, value, count(*) AS n FROM (SELECT 'family' AS kind, coalesce(v, 'WeakAssociation') AS value FROM (SELECT unnest(CASE WHEN f IS NULL THEN [NULL] ELSE list_distinct([f, g]) END) AS v FROM (SELECT CASE predicate WHEN 'uses' THEN 'Operational' WHEN 'calls' THEN 'Structural' END AS f, CASE WHEN confidence > 0.5 THEN 'Structural' ELSE 'Operational' END AS g FROM {RELATION}))
 UNION ALL SELECT 'state', coalesce(strength, 'typed') FROM {RELATION}) GROUP BY ALL""")
def relation_families(t):
    r = relations(t)
    f = F.when(F.col("predicate") == "uses", "Operational").when(F.col("predicate") == "calls", "Structural")
    g = F.when(F.col("confidence") > 0.5, "Structural").otherwise("Operational")
    return w.family_counts(r.withColumn("families", F.when(f.isNull(), F.array().cast("array<string>")).otherwise(F.array(f, g))), "families", "strength")


_PRIORITY = ", ".join(f"'{x}'" for x in w.TYPE_ORDER)


@query(sql=f"""SELECT entity, CASE entity WHEN 5 THEN 'Law' ELSE arg_min(kind, (coalesce(list_position([{_PRIORITY}], kind), 99), -n, kind)) END AS primary_type FROM (SELECT l_partkey AS entity, CASE l_linenumber WHEN 1 THEN 'Method' WHEN 2 THEN 'Product' WHEN 3 THEN 'Zeta' WHEN 4 THEN 'Alpha' ELSE 'Artifact' END AS kind, count(*) AS n FROM lineitem WHERE l_linenumber <> 6 GROUP BY ALL) GROUP BY entity""")
def primary_entity_type(t):
    """One stable type of the types observed for each entity."""
    n = F.col("l_linenumber")
    kind = F.when(n == 1, "Method").when(n == 2, "Product").when(n == 3, "Zeta").when(n == 4, "Alpha").when(n != 6, "Artifact")
    o = t.lineitem.select(F.col("l_partkey").alias("entity"), kind.alias("kind"))
    return w.primary_type(o, "entity", "kind", {"5": "Law"}).withColumnRenamed("primary", "primary_type")


_NAMES = "(SELECT p_partkey, CASE p_partkey % 9 WHEN 0 THEN 'Table ' || p_size WHEN 1 THEN '[' || p_size || ']' WHEN 2 THEN '2024-05' WHEN 3 THEN p_size::VARCHAR WHEN 4 THEN ' The ' WHEN 5 THEN '1999b' WHEN 6 THEN '3 and x2' ELSE p_name END AS name, CASE WHEN p_size % 6 = 0 THEN 'Date' ELSE p_type END AS kind FROM part)"
_STOP = ", ".join(f"'{x}'" for x in w.STOP_NAMES)


@query(sql=f"""SELECT p_partkey, n = '' OR n IN ({_STOP}) OR regexp_full_match(n, '\\[[0-9]+\\]|[0-9]+|[a-z]|[0-9]+ (and|or) [a-z0-9]+|(chapter|section|figure|table|page|appendix|part|rule) [0-9ivxlcdm]+') AS junk,
 lower(kind) IN ('document', 'timereference', 'time_reference', 'date') OR n = '' OR regexp_full_match(n, '[0-9]{{1,4}}([-/][0-9]{{1,2}}){{0,2}}|(19|20)[0-9]{{2}}[a-z]') AS noise FROM (SELECT *, trim(regexp_replace(lower(name), '\\s+', ' ', 'g')) AS n FROM {_NAMES})""")
def entity_predicates(t):
    """Names that are junk, and nodes that are provenance."""
    m, size = F.col("p_partkey") % 9, F.col("p_size").cast("string")
    name = F.when(m == 0, F.concat(F.lit("Table "), size)).when(m == 1, F.concat(F.lit("["), size, F.lit("]"))).when(m == 2, "2024-05").when(m == 3, size).when(m == 4, " The ").when(m == 5, "1999b").when(m == 6, "3 and x2").otherwise(F.col("p_name"))
    kind = F.when(F.col("p_size") % 6 == 0, "Date").otherwise(F.col("p_type"))
    return t.part.select("p_partkey", w.is_junk_name(name).alias("junk"), w.is_noise_entity(F.col("p_partkey"), kind, name).alias("noise"))


@query(sql="""WITH m AS MATERIALIZED (SELECT o_custkey AS doc, l_partkey AS entity, count(*) AS n, arg_min(l_orderkey, (-l_discount, l_orderkey)) AS chunk FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY ALL), p AS (SELECT DISTINCT a.o_custkey AS doc, b.o_custkey AS other FROM orders a JOIN orders b ON b.o_custkey = a.o_custkey + 1 WHERE a.o_custkey % 10 = 0)
SELECT doc, other, entity, n, m, chunk, near, place FROM (SELECT *, row_number() OVER (PARTITION BY doc, other ORDER BY least(n, m) DESC, n + m DESC, entity) AS place FROM (SELECT p.doc, p.other, x.entity, x.n, y.n AS m, x.chunk, y.chunk AS near FROM p JOIN m x ON x.doc = p.doc JOIN m y ON y.doc = p.other AND y.entity = x.entity)) WHERE place <= 5""")
def document_drilldown(t):
    """What joins each tenth customer to the next one."""
    m = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("o_custkey").alias("doc"), F.col("l_orderkey").alias("chunk"), F.col("l_partkey").alias("entity"), F.col("l_discount").alias("conf"))
    c = t.orders.select(F.col("o_custkey").alias("doc")).distinct()
    pairs = c.where("doc % 10 = 0").withColumn("other", F.col("doc") + 1).join(c.withColumnRenamed("doc", "other"), "other", "left_semi")
    return w.drilldown(m, pairs, 5)
