"""Queries for entity lookup, anchors, excerpts, lexicon, shapes and selections."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text
from ..operators import centrality
from ..operators import graph as g
from ..operators import knowledge as k
from ..operators import relational as rel
from ..operators import retrieval as r
from .graph import BOTH, EDGES, edges, mentions
from .registry import query
from .retrieval import dense, dense_sql
from .texts import CONTENT, SENT


@query(sql="SELECT l_orderkey AS chunk, round(least(sum(l_discount), 1.0), 6) AS score FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE contains(lower(p_name), 'ring')) GROUP BY l_orderkey ORDER BY score DESC, chunk LIMIT 30")
def entity_first_search(t):
    m = t.lineitem.select(F.col("l_orderkey").alias("chunk"), F.col("l_partkey").alias("entity"), F.col("l_discount").alias("conf"))
    return k.entity_first(t.part.withColumnRenamed("p_partkey", "entity"), m, "p_name", "ring", 30)


@query(sql="SELECT l_partkey, l_orderkey, l_quantity FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY l_quantity DESC, l_orderkey, l_linenumber) AS r FROM lineitem WHERE l_partkey % 50 = 0) WHERE r <= 3 ORDER BY l_quantity DESC, l_orderkey, l_linenumber LIMIT 30")
def facts_capped_per_entity(t):
    f = t.lineitem.where("l_partkey % 50 = 0")
    return k.capped_facts(f, "l_partkey", [F.desc("l_quantity"), "l_orderkey", "l_linenumber"], 30, 12).select("l_partkey", "l_orderkey", "l_quantity")


_FLAT = "trim(regexp_replace(lower({}), '[^a-z0-9]+', ' ', 'g'))"


@query(sql=f"""SELECT item, label, round(CASE WHEN q = n THEN 1.0 WHEN len(nt) >= 2 AND contains(' ' || q || ' ', ' ' || n || ' ') THEN 0.95 WHEN len(qt) >= 2 AND contains(' ' || n || ' ', ' ' || q || ' ') THEN 0.88 WHEN sh >= 2 THEN least(0.86, 0.55 + 0.25 * sh / len(nt) + 0.10 * sh / len(qt)) ELSE 0 END, 6) AS score
FROM (SELECT *, len(list_intersect(qt, nt)) AS sh FROM (SELECT *, list_distinct(string_split(q, ' ')) AS qt, list_distinct(string_split(n, ' ')) AS nt FROM (SELECT DISTINCT p_name AS item, {_FLAT.format('p_name')} AS q FROM part), (SELECT c_name AS label, {_FLAT.format("replace(c_name, 'Customer#', 'small ') || ' ring'")} AS n FROM customer WHERE c_custkey < 3 UNION ALL SELECT 'small ring', 'small ring' UNION ALL SELECT 'large ring of steel', 'large ring of steel'))) WHERE q = n OR sh >= 2""")
def fuzzy_anchor(t):
    """A query set of names against a short list of labels."""
    labels = t.customer.where("c_custkey < 3").select(F.col("c_name").alias("label"), F.concat(F.regexp_replace("c_name", "Customer#", "small "), F.lit(" ring")).alias("n"))
    labels = labels.unionByName(t.spark.createDataFrame([("small ring",) * 2, ("large ring of steel",) * 2], "label string, n string"))
    x = t.part.select(F.col("p_name").alias("item")).distinct().crossJoin(F.broadcast(labels))  # five labels
    return x.select("item", "label", F.round(k.anchor_score(F.col("item"), F.col("n")), 6).alias("score")).where("score > 0")


@query(sql=f"""SELECT doc_id, item_id, round(CASE WHEN contains(hay, ' ' || phrase || ' ') THEN 2 + cov ELSE cov END, 6) AS grounding FROM (SELECT *, len(list_filter(terms, lambda t: contains(hay, ' ' || t || ' '))) / len(terms) AS cov FROM
 (SELECT doc_id, ' ' || {_FLAT.format('text')} || ' ' AS hay FROM documents), (SELECT item_id, {_FLAT.format('text')} AS phrase, list_distinct(regexp_extract_all(lower(text), '[a-z][a-z0-9]*')) AS terms FROM benchmark)) WHERE cov >= 0.75""")
def lane_grounding(t):
    """Grounding of all documents in a lane of each benchmark passage."""
    flat = F.trim(F.regexp_replace(F.lower("text"), "[^a-z0-9]+", " "))
    terms = F.array_distinct(text.words("text"))
    lanes = t.benchmark.select("item_id", F.array(text.padded(flat)).alias("phrases"), F.transform(terms, text.padded).alias("terms"), terms.alias("words"), F.greatest(F.lit(1), F.ceil(F.size(terms) * 0.749999).cast("int")).alias("hits"))
    x = r.against_all(t.documents, "doc_id", lanes, "item_id", text.padded("text"), lambda hay, q, n: k.lane_grounding(hay, q["phrases"], q["terms"], n), 0.749999, lambda hay: hay, "words", "hits")
    return x.where("score < 1.000001 or score >= 2.75").select("doc_id", "item_id", F.round("score", 6).alias("grounding"))


@query(sql="""SELECT e.user_id, e.ts AS cue_at, coalesce(arg_max(m.event_type || m.event_id, (m.ts, m.event_id)) FILTER (WHERE m.ts <= e.ts), arg_min(m.event_type || m.event_id, (m.ts, m.event_id))) AS subject FROM (SELECT DISTINCT user_id, ts FROM events WHERE event_type = 'purchase') e
LEFT JOIN (SELECT * FROM events WHERE event_type IN ('view', 'signup')) m ON m.user_id = e.user_id GROUP BY e.user_id, e.ts""")
def nearest_preceding(t):
    """Each purchase attached to the user's nearest view or sign-up at or before it, else the first after."""
    m = t.events.where("event_type in ('view', 'signup')").select("user_id", F.col("ts").alias("at"), F.concat("event_type", F.col("event_id").cast("string")).alias("name"))
    return k.nearest_preceding(t.events.where("event_type = 'purchase'").select("user_id", F.col("ts").alias("cue_at")).distinct(), m, "user_id")


@query(sql=f"""SELECT doc_id, s[1 - best[2]] AS excerpt FROM (SELECT doc_id, s, list_max(list_transform(s, lambda x, i: (len(list_filter(['the', 'and', 'with', 'die', 'les', 'que'], lambda w: contains(' ' || regexp_replace(lower(x), '[^a-z0-9]+', ' ', 'g') || ' ', ' ' || w || ' '))), 1 - i))) AS best FROM (SELECT doc_id, {SENT} AS s FROM documents)) WHERE best[1] > 0""")
def best_excerpt(t):
    x = t.documents.select("doc_id", k.best_excerpt(text.sentences("text"), F.array(*map(F.lit, ("the", "and", "with", "die", "les", "que")))).alias("excerpt"))
    return x.where("excerpt is not null")


@query(sql=f"SELECT w, CASE WHEN bool_or(side = 1) AND bool_or(side = 2) THEN 'both' WHEN bool_or(side = 1) THEN 'entity' ELSE 'term' END AS side FROM (SELECT lower(trim(unnest(string_split(p_name, ' ')))) AS w, 1 AS side FROM part UNION ALL SELECT unnest({CONTENT}), 2 FROM documents) GROUP BY w")
def split_overlay(t):
    names = t.part.select(F.explode(F.split("p_name", " ")).alias("name"))
    return k.split_overlay(names, t.documents.select(F.explode(text.content_words("text")).alias("term")))


@query(sql="WITH c AS (SELECT source, count(*) AS n FROM documents GROUP BY source), gg AS (SELECT round(2 * sum(i * n) / (count(*) * sum(n)) - (count(*) + 1) / count(*), 6) AS gini FROM (SELECT n, row_number() OVER (ORDER BY n) AS i FROM c)), tt AS (SELECT count(*) AS n, max(n) / sum(n) AS top FROM c) SELECT n, round(top, 6) AS top, gini, CASE WHEN gini > 0.6 THEN 'CONCENTRATED' WHEN top > 0.5 THEN 'SKEWED' WHEN n > 5 AND top < 0.25 THEN 'DISPERSED' ELSE 'BALANCED' END AS shape FROM tt, gg")
def discourse_shape(t):
    return k.discourse_shape(t.documents.groupBy("source").agg(F.count("*").alias("n")), "n")


@query(sql=f"""WITH r AS (SELECT q.query_id, q.vec_id AS item, q.rank, q.score, e.label // 5 AS domain FROM ({dense_sql(12)}) q JOIN embeddings e USING (vec_id)),
x AS (SELECT *, max(score) OVER w AS top, first_value(domain) OVER (PARTITION BY query_id ORDER BY rank) AS fd FROM r WINDOW w AS (PARTITION BY query_id)),
y AS (SELECT *, min(CASE WHEN rank <= 4 THEN (domain = fd)::INT END) OVER w AS same FROM x WINDOW w AS (PARTITION BY query_id)),
z AS (SELECT *, CASE WHEN same = 1 THEN min(CASE WHEN rank > 4 AND domain <> fd AND score >= 0.25 * top THEN rank END) OVER w END AS swap FROM y WINDOW w AS (PARTITION BY query_id))
SELECT query_id, item, rank, score, domain FROM z WHERE CASE WHEN swap IS NULL THEN rank <= 4 ELSE rank < 4 OR rank = swap END""")
def domain_reserve(t):
    r = dense(t, 12).join(t.embeddings.select("vec_id", F.floor(F.col("label") / 5).alias("domain")), "vec_id").select("query_id", F.col("vec_id").alias("item"), "rank", "score", "domain")
    return k.domain_reserve(r, "query_id", "rank", "domain", "score", 4)


@query(sql="SELECT user_id, ts AS at FROM (SELECT *, lead(event_type) OVER w AS n1, lead(event_type, 2) OVER w AS n2 FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)) WHERE event_type = 'view' AND n1 = 'click' AND n2 = 'view'")
def motif_match(t):
    return k.motif(t.events, "user_id", "ts", "event_type", ["view", "click", "view"])


@query(sql=f"SELECT a.domain AS a, b.domain AS b, sum(w)::BIGINT AS w, count(*) AS n FROM {EDGES} e JOIN (SELECT p_partkey, p_brand AS domain FROM part) a ON a.p_partkey = u JOIN (SELECT p_partkey, p_brand AS domain FROM part) b ON b.p_partkey = v GROUP BY ALL")
def supernode_graph(t):
    """Edges between communities (brands), folded."""
    p = lambda x: t.part.select(F.col("p_partkey").alias(x), F.col("p_brand").alias("a" if x == "u" else "b"))
    return edges(t).join(p("u"), "u").join(p("v"), "v").groupBy("a", "b").agg(F.sum("w").alias("w"), F.count("*").alias("n"))


@query(sql="SELECT d.o_custkey AS doc, o.o_custkey AS other, count(DISTINCT m.l_partkey) AS shared FROM orders d JOIN lineitem m ON m.l_orderkey = d.o_orderkey JOIN lineitem n ON n.l_partkey = m.l_partkey JOIN orders o ON o.o_orderkey = n.l_orderkey WHERE d.o_custkey % 50 = 0 AND o.o_custkey <> d.o_custkey GROUP BY ALL HAVING count(DISTINCT m.l_partkey) >= 2")
def book_bridges(t):
    """Other documents (customers) that share two entities (parts) or more with a document."""
    m = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).select("o_custkey", "l_partkey").distinct()
    a = m.where("o_custkey % 50 = 0").select(F.col("o_custkey").alias("doc"), "l_partkey")
    x = m.select(F.col("o_custkey").alias("other"), "l_partkey").join(F.broadcast(a) if a.limit(100_001).count() <= 100_000 else a, "l_partkey").where("doc <> other")
    return x.groupBy("doc", "other").agg(F.countDistinct("l_partkey").alias("shared")).where("shared >= 2")


@query(sql="SELECT a.l_orderkey AS chunk, b.l_orderkey AS near, count(DISTINCT a.l_partkey) AS shared FROM (SELECT DISTINCT o_custkey, l_orderkey, l_partkey % 50 AS l_partkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey) a JOIN (SELECT DISTINCT o_custkey, l_orderkey, l_partkey % 50 AS l_partkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey) b ON a.o_custkey = b.o_custkey AND a.l_partkey = b.l_partkey AND a.l_orderkey < b.l_orderkey GROUP BY ALL")
def doc_local_neighbors(t):
    """Chunks of one document that share entities."""
    m = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).select("o_custkey", F.col("l_orderkey").alias("chunk"), (F.col("l_partkey") % 50).alias("e")).distinct()
    x = m.join(m.select("o_custkey", F.col("chunk").alias("near"), "e"), ["o_custkey", "e"]).where("chunk < near")
    return x.groupBy("chunk", "near").agg(F.countDistinct("e").alias("shared"))


@query(sql="SELECT l_orderkey, l_linenumber, CASE WHEN o_orderkey IS NULL THEN 'gone' WHEN o_orderstatus = 'F' AND l_linestatus = 'O' THEN 'contract' WHEN p_partkey IS NULL THEN 'entity' ELSE 'current' END AS reason FROM lineitem LEFT JOIN (SELECT * FROM orders WHERE o_orderkey % 9 > 0) ON l_orderkey = o_orderkey LEFT JOIN (SELECT * FROM part WHERE p_partkey % 11 > 0) ON l_partkey = p_partkey")
def stale_reasons(t):
    """Why a failure row no longer stands: its parent is gone, its contract changed, its entity is gone."""
    x = t.lineitem.join(t.orders.where("o_orderkey % 9 > 0"), F.col("l_orderkey") == F.col("o_orderkey"), "left").join(t.part.where("p_partkey % 11 > 0"), F.col("l_partkey") == F.col("p_partkey"), "left")
    why = F.when(F.col("o_orderkey").isNull(), "gone").when((F.col("o_orderstatus") == "F") & (F.col("l_linestatus") == "O"), "contract").when(F.col("p_partkey").isNull(), "entity").otherwise("current")
    return x.select("l_orderkey", "l_linenumber", why.alias("reason"))


@query(sql="SELECT s_suppkey FROM supplier WHERE s_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey < 3)")
def registry_references(t):
    """Rows whose foreign key a registry lacks."""
    return t.supplier.join(t.nation.where("n_regionkey < 3"), F.col("s_nationkey") == F.col("n_nationkey"), "left_anti").select("s_suppkey")


@query(sql="SELECT source, n, verdict, row_number() OVER (PARTITION BY verdict ORDER BY n DESC, source) AS task FROM (SELECT source, count(*) AS n, CASE WHEN count(quality) < 0.3 * count(*) THEN 'enrich' WHEN avg(toxic) > 0.1 THEN 'review' ELSE 'ok' END AS verdict FROM documents LEFT JOIN labels USING (doc_id) GROUP BY source)")
def enrichment_verdict(t):
    """What each group needs, and the order of work within a verdict."""
    d = t.documents.join(t.labels, "doc_id", "left").groupBy("source").agg(F.count("*").alias("n"), F.count("quality").alias("q"), F.avg("toxic").alias("x"))
    d = d.withColumn("verdict", F.when(F.col("q") < 0.3 * F.col("n"), "enrich").when(F.col("x") > 0.1, "review").otherwise("ok"))
    return rel.ranked(d, ["verdict"], [F.desc("n"), "source"], "task").select("source", "n", "verdict", "task")


@query(sql=f"SELECT doc_id, term, tf, r FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY tf DESC, term) AS r FROM (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({CONTENT}) AS term FROM documents) GROUP BY ALL)) WHERE r <= 4")
def topic_tokens(t):
    """Four most frequent content words of each document."""
    c = t.documents.select("doc_id", F.explode(text.content_words("text")).alias("term")).groupBy("doc_id", "term").agg(F.count("*").alias("tf"))
    return rel.top_per_key(c, ["doc_id"], [F.desc("tf"), "term"], 4, "r")


@query(sql=f"SELECT DISTINCT h.node, l_suppkey % 5 AS lane FROM (SELECT src AS node, count(*) AS degree FROM {BOTH} GROUP BY src ORDER BY degree DESC, node LIMIT 25) h JOIN lineitem ON l_partkey = node")
def degree_capped_graph(t):
    """The 25 nodes of the greatest degree, and the lanes they occur in."""
    top = g.degrees(edges(t)).orderBy(F.desc("degree"), "node").limit(25).select("node")
    return t.lineitem.join(F.broadcast(top), F.col("l_partkey") == F.col("node")).select("node", (F.col("l_suppkey") % 5).alias("lane")).distinct()


@query()
def node_betweenness(t):
    """Unnormalised, as counts of pairs."""
    return centrality.betweenness(edges(t), normalized=False)


@query()
def term_communities(t):
    """Greedy modularity over the 80 most mentioned entities, which is the scope of the operator."""
    top = mentions(t).groupBy("entity").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "entity").limit(80).select(F.col("entity").alias("node"))
    return t.spark.createDataFrame(k.greedy_modularity(g.induced(edges(t), top)), "node long, community long")


@query()
def span_selection(t):
    """Overlapping cue spans of passages reduced to a set without overlaps."""
    w = F.split("text", " ")
    s = t.benchmark.select("item_id", F.posexplode(F.transform(w, F.length)).alias("i", "n"))
    s = s.select("item_id", (F.col("i") * 4).cast("long").alias("start"), (F.col("i") * 4 + F.col("n") + 2).cast("long").alias("end"), (F.col("n") % 5 / 4.0).alias("score"), F.when(F.col("n") > 4, "long").otherwise("short").alias("kind"))
    return k.spans_without_overlap(s, "item_id")


@query()
def document_clusters(t):
    """k-means (k = sqrt(n / 2)) on unit vectors, seed 42."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    e = t.embeddings.select("vec_id", array_to_vector(F.col("embedding").cast("array<double>")).alias("features"))
    n = max(2, int((t.embeddings.count() / 2) ** 0.5))
    model = KMeans(k=n, seed=42, distanceMeasure="cosine", maxIter=10).fit(e)
    return model.transform(e).select("vec_id", F.col("prediction").cast("long").alias("cluster"))
