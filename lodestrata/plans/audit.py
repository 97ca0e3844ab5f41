"""Audit queries: duplicates, readiness, parity and dataset checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text
from ..operators import audit as a
from ..operators import graph as g
from ..operators import relational as rel
from .registry import Tables, query
from .texts import CONTENT

_SETS = f"""w AS MATERIALIZED (SELECT doc_id, {CONTENT} AS w FROM documents),
s AS MATERIALIZED (SELECT DISTINCT doc_id, s FROM (SELECT doc_id, unnest(CASE WHEN len(w) < 5 THEN [] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s FROM w)),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id HAVING count(*) >= 24),
pairs AS MATERIALIZED (SELECT a, b, round(c / (na + nb - c), 6) AS jaccard, round(c / least(na, nb), 6) AS containment FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c, any_value(p.n) AS na, any_value(q.n) AS nb
 FROM s x JOIN s y ON x.s = y.s AND x.doc_id < y.doc_id JOIN n p ON p.doc_id = x.doc_id JOIN n q ON q.doc_id = y.doc_id GROUP BY ALL) WHERE round(c / (na + nb - c), 6) >= 0.1 AND round(c / least(na, nb), 6) >= 0.5)"""


def sets(t: Tables):
    """Alike sets and members, and documents of each."""
    return a.near_duplicate_sets(t.documents, "doc_id", text.shingle_hashes(text.content_words("text"), 5))


@query(sql=f"WITH {_SETS} SELECT a, b, jaccard, containment, CASE WHEN containment >= 0.95 THEN 'certain' WHEN containment >= 0.65 THEN 'likely' ELSE 'review' END AS confidence FROM pairs")
def near_dup_pairs(t):
    return a.every_pair(*sets(t))


CLUSTERS = f"""WITH RECURSIVE {_SETS}, e AS MATERIALIZED (SELECT a, b FROM pairs WHERE containment >= 0.65), d AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e), reach(node, c) AS (SELECT a, a FROM d UNION SELECT d.b, reach.c FROM reach JOIN d ON d.a = reach.node),
cl AS (SELECT node AS doc_id, min(c) AS cluster FROM reach GROUP BY node)"""


def clusters(t: Tables):
    pairs, members = sets(t)
    near = a.rated(pairs).where("containment >= 0.65").select(F.col("a").alias("u"), F.col("b").alias("v"))
    copies = members.where("doc <> rep").select(F.col("rep").alias("u"), F.col("doc").alias("v"))
    return g.components(near.union(copies)).select(F.col("node").alias("doc_id"), F.col("component").alias("cluster"))


@query(sql=f"{CLUSTERS} SELECT doc_id, cluster FROM cl")
def near_dup_clusters(t):
    return clusters(t)


@query(sql=f"{CLUSTERS} SELECT doc_id, cluster, row_number() OVER w = 1 AS kept, first_value(doc_id) OVER w AS keeper FROM cl JOIN documents USING (doc_id) WINDOW w AS (PARTITION BY cluster ORDER BY n_chars DESC, doc_id)")
def canonical_copy(t):
    m = clusters(t).join(t.documents.select("doc_id", "n_chars"), "doc_id")
    return a.canonical_copies(m, "cluster", [F.desc("n_chars"), "doc_id"]).drop("n_chars")


@query(sql="SELECT sha256(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS key0, count(*) AS n, min(doc_id) AS first FROM documents GROUP BY key0 HAVING count(*) >= 2")
def exact_duplicates(t):
    return a.duplicate_groups(t.documents, [F.sha2(F.trim(F.regexp_replace("text", r"\s+", " ")), 256)], "doc_id")


@query(sql="SELECT n_hashes, count(*) AS n_groups FROM (SELECT source, lang, count(DISTINCT sha256(text)) AS n_hashes FROM documents GROUP BY source, lang) GROUP BY n_hashes")
def identity_collisions(t):
    """Identities with several content hashes, by how many."""
    x = t.documents.groupBy("source", "lang").agg(F.countDistinct(F.sha2("text", 256)).alias("n_hashes"))
    return x.groupBy("n_hashes").agg(F.count("*").alias("n_groups"))


@query(sql="SELECT sha256(text) AS hash, min(doc_id) AS doc_id, string_agg(DISTINCT source, ',' ORDER BY source) AS sources FROM documents GROUP BY hash")
def content_dedupe(t):
    """One row per content across sources, memberships united."""
    return t.documents.groupBy(F.sha2("text", 256).alias("hash")).agg(F.min("doc_id").alias("doc_id"), F.array_join(F.array_sort(F.collect_set("source")), ",").alias("sources"))


@query(sql="SELECT source, count(*) AS n, count_if(quality IS NOT NULL) AS labelled, count_if(quality = 1) AS good, CASE WHEN count_if(quality IS NOT NULL) = count(*) AND count_if(quality = 1) = count(*) THEN 'ready' WHEN count_if(quality IS NOT NULL) > 0 OR count_if(quality = 1) > 0 THEN 'partial' ELSE 'empty' END AS state FROM documents LEFT JOIN labels USING (doc_id) GROUP BY source")
def readiness_counts(t):
    d = t.documents.join(t.labels, "doc_id", "left")
    return a.readiness(d, ["source"], labelled=F.col("quality").isNotNull(), good=F.col("quality") == 1)


@query(sql="SELECT coalesce(o_orderkey, l_orderkey) AS k, o.n AS expected, l.n AS actual, CASE WHEN l.n IS NULL THEN 'missing' WHEN o.n IS NULL THEN 'unexpected' WHEN o.n = l.n THEN 'equal' ELSE 'differs' END AS status FROM (SELECT o_orderkey, 1 + o_orderkey % 7 AS n FROM orders WHERE o_orderkey % 5 <> 0) o FULL JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY l_orderkey) l ON o_orderkey = l_orderkey")
def parity_full_outer(t):
    e = t.orders.where("o_orderkey % 5 <> 0").select(F.col("o_orderkey").alias("k"), (1 + F.col("o_orderkey") % 7).alias("n"))
    return rel.parity(e, t.lineitem.groupBy(F.col("l_orderkey").alias("k")).agg(F.count("*").alias("n")), ["k"], "n")


@query(sql="""WITH p AS (SELECT doc_id, regexp_replace(lower(text), '\\s+', ' ', 'g') AS text FROM documents WHERE doc_id % 9 > 0), q AS (SELECT doc_id, CASE WHEN doc_id % 6 = 0 THEN lower(text) || ' x' ELSE lower(text) END AS text FROM documents WHERE doc_id % 8 > 0)
SELECT coalesce(p.doc_id, q.doc_id) AS doc_id, CASE WHEN q.doc_id IS NULL THEN 'missing' WHEN p.doc_id IS NULL THEN 'unexpected' WHEN sha256(p.text) = sha256(regexp_replace(q.text, '\\s+', ' ', 'g')) THEN 'equal' ELSE 'differs' END AS status FROM p FULL JOIN q USING (doc_id)""")
def text_parity(t):
    """Documents of two stores compared by their text, blanks apart; hashes are shuffled, not texts."""
    flat = lambda c: F.sha2(F.regexp_replace(c, r"\s+", " "), 256)
    d = t.documents
    one = d.where("doc_id % 9 > 0").select("doc_id", flat(F.lower("text")).alias("h"))
    two = d.where("doc_id % 8 > 0").select("doc_id", flat(F.when(F.col("doc_id") % 6 == 0, F.concat(F.lower("text"), F.lit(" x"))).otherwise(F.lower("text"))).alias("h"))
    return rel.parity(one, two, ["doc_id"], "h").select("doc_id", "status")


@query(sql="SELECT d.doc_id, l.doc_id IS NOT NULL AS labelled FROM documents d LEFT JOIN labels l USING (doc_id)")
def doc_existence(t):
    d = t.documents.select("doc_id").join(t.labels.select("doc_id", F.lit(True).alias("labelled")).distinct(), "doc_id", "left")
    return d.select("doc_id", F.coalesce("labelled", F.lit(False)).alias("labelled"))


@query(sql="SELECT lang, count(*) AS n, count_if(n_chars < 200) AS short, count_if(n_chars > 8000) AS long, round(avg(n_chars), 4) AS mean FROM documents GROUP BY lang")
def length_check(t):
    return t.documents.groupBy("lang").agg(F.count("*").alias("n"), F.count_if(F.col("n_chars") < 200).alias("short"), F.count_if(F.col("n_chars") > 8000).alias("long"), F.round(F.avg("n_chars"), 4).alias("mean"))


@query(sql="SELECT doc_id, quality, toxic FROM labels WHERE quality NOT IN (0, 1) OR toxic NOT IN (0) OR quality IS NULL")
def label_vocabulary(t):
    """Labels outside the vocabulary (here: not toxic)."""
    return t.labels.where(~F.col("quality").isin(0, 1) | ~F.col("toxic").isin(0) | F.col("quality").isNull()).select("doc_id", "quality", "toxic")


@query(sql="""SELECT source, n_train, n_test, "both" FROM (SELECT source, count_if(doc_id % 4 > 0) AS n_train, count_if(doc_id % 4 = 0) AS n_test FROM documents GROUP BY source) LEFT JOIN (SELECT source, count(*) AS "both" FROM (SELECT source, text FROM documents GROUP BY ALL HAVING bool_or(doc_id % 4 = 0) AND bool_or(doc_id % 4 > 0)) GROUP BY source) USING (source)""")
def split_overlap(t):
    """Texts that are in the training and the test split."""
    d = t.documents
    n = d.groupBy("source").agg(F.count_if(F.col("doc_id") % 4 > 0).alias("n_train"), F.count_if(F.col("doc_id") % 4 == 0).alias("n_test"))
    s = d.groupBy("source", F.sha2("text", 256).alias("h")).agg(F.bool_or(F.col("doc_id") % 4 == 0).alias("test"), F.bool_or(F.col("doc_id") % 4 > 0).alias("train")).where("test and train")
    return n.join(s.groupBy("source").agg(F.count("*").alias("both")), "source", "left")


@query(sql="""SELECT source, sha256(string_agg(b || ':' || x || ':' || n, ',' ORDER BY b)) AS signature FROM (SELECT source, (h % 256)::INT AS b, sum(h)::DECIMAL(38,0) AS x, count(*) AS n FROM (
 SELECT source, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, chr(0)) || chr(31) || coalesce(n_chars::VARCHAR, chr(0))), 1, 15))::BIGINT AS h FROM documents) GROUP BY ALL) GROUP BY source""")
def change_signature(t):
    return a.change_signature(t.documents, "doc_id", "n_chars", ["source"])


@query(sql="SELECT event_id, array_to_string(list_filter([CASE WHEN json_extract_string(props, '$.k') IS NULL THEN 'k' END, CASE WHEN value < 5 THEN 'value' END], lambda x: x IS NOT NULL), ',') AS missing FROM events")
def missing_fields(t):
    """A legacy row's missing fields, all at once (values under 5 count as absent here)."""
    e = t.events.select("event_id", F.get_json_object("props", "$.k").alias("k"), F.when(F.col("value") >= 5, F.col("value")).alias("value"))
    return a.missing_paths(e, ["k", "value"]).select("event_id", F.array_join("missing", ",").alias("missing"))


@query(sql="""SELECT coalesce(sb, sa) AS shape, count_if(hb) AS before, count_if(ha) AS after, count_if(hb IS NULL OR ha IS NULL) AS unmatched, count_if(ha) >= count_if(hb) AND count_if(hb IS NULL OR ha IS NULL) = 0 AS passed FROM
 (SELECT doc_id, lang AS sb, n_chars % 3 = 0 AS hb FROM documents WHERE doc_id % 10 < 9) b FULL JOIN (SELECT doc_id, lang AS sa, n_chars % 2 = 0 AS ha FROM documents WHERE doc_id % 10 > 0) a USING (doc_id) GROUP BY shape""")
def ab_nonregression(t):
    d = t.documents
    b = d.where("doc_id % 10 < 9").select("doc_id", "lang", (F.col("n_chars") % 3 == 0).alias("hit"))
    return a.non_regression(b, d.where("doc_id % 10 > 0").select("doc_id", "lang", (F.col("n_chars") % 2 == 0).alias("hit")), "doc_id", "lang", "hit")


@query(sql="SELECT lang AS engine_a, lang_b AS engine_b, count(*) AS both, round(count(*) / any_value(n), 6) AS rate FROM (SELECT DISTINCT a.lang, b.lang AS lang_b, a.source FROM documents a JOIN documents b ON a.source = b.source AND a.lang < b.lang), (SELECT count(DISTINCT source) AS n FROM documents) GROUP BY ALL")
def engine_parity(t):
    """Overlap of what pairs of engines (languages here) cover."""
    d = t.documents.select("source", "lang").distinct()
    n = t.documents.select("source").distinct().count()
    x = d.join(d.select("source", F.col("lang").alias("engine_b")), "source").where("lang < engine_b")
    return x.groupBy(F.col("lang").alias("engine_a"), "engine_b").agg(F.count("*").alias("both"), F.round(F.count("*") / max(n, 1), 6).alias("rate"))


@query(sql="SELECT source, coalesce(lang, 'unknown') AS facet, n, share FROM (SELECT source, lang, n, round(n / sum(n) OVER (PARTITION BY source), 6) AS share, row_number() OVER (PARTITION BY source ORDER BY n DESC, lang) AS r FROM (SELECT source, lang, count(*) AS n FROM documents GROUP BY ALL)) WHERE r <= 2")
def facet_distribution(t):
    c = t.documents.groupBy("source", "lang").agg(F.count("*").alias("n"))
    c = c.withColumn("share", F.round(F.col("n") / F.sum("n").over(rel.Window.partitionBy("source")), 6))
    return rel.top_per_key(c, ["source"], [F.desc("n"), "lang"], 2).select("source", F.coalesce("lang", F.lit("unknown")).alias("facet"), "n", "share")


@query(sql="SELECT count(*) AS n, count_if(status = 'active') AS active FROM (SELECT coalesce(CASE o_orderstatus WHEN 'F' THEN NULL WHEN 'O' THEN 'active' ELSE 'retired' END, 'active') AS status FROM orders)")
def active_records(t):
    s = F.when(F.col("o_orderstatus") == "O", "active").when(F.col("o_orderstatus") != "F", "retired")
    return t.orders.select(s.alias("status")).agg(F.count("*").alias("n"), F.count_if(text.is_active("status")).alias("active"))


@query(sql="SELECT p_partkey, p_name, p_size, p_retailprice FROM (SELECT p_partkey, p_name, p_size, p_retailprice FROM part WHERE p_partkey % 4 <> 1 UNION ALL SELECT p_partkey, upper(p_name), p_size + 1, p_retailprice FROM part WHERE p_partkey % 4 = 1)")
def upsert_merge(t):
    """Changed rows replace their keys, others stay."""
    p = t.part.select("p_partkey", "p_name", "p_size", "p_retailprice")
    new = p.where("p_partkey % 4 = 1").select("p_partkey", F.upper("p_name").alias("p_name"), (F.col("p_size") + 1).alias("p_size"), "p_retailprice")
    return rel.upsert(p, new, ["p_partkey"])


@query(sql="SELECT o_custkey, string_agg('refs[' || i || ']: ' || v, ';' ORDER BY i) AS errors FROM (SELECT o_custkey, unnest(refs) AS v, unnest(range(len(refs))) AS i FROM (SELECT o_custkey, list(o_orderkey ORDER BY o_orderkey) AS refs FROM orders GROUP BY o_custkey)) WHERE v % 13 = 0 GROUP BY o_custkey")
def reference_errors(t):
    """References of each record that the registry lacks, with their places."""
    r = t.orders.groupBy("o_custkey").agg(F.array_sort(F.collect_list("o_orderkey")).alias("refs"))
    e = a.reference_errors(r, "o_custkey", "refs", t.orders.where("o_orderkey % 13 <> 0"), "o_orderkey")
    return e.select("o_custkey", F.array_join("errors", ";").alias("errors"))


@query(sql="""WITH one AS (SELECT DISTINCT l_orderkey % 40 AS k, l_partkey AS c FROM lineitem WHERE l_linenumber = 1), two AS (SELECT DISTINCT l_orderkey % 40 AS k, l_partkey AS c FROM lineitem WHERE l_linenumber > 1)
SELECT k, count_if(c % 3 = 0) AS gain, round(count_if(c % 3 <> 0) / count(*), 6) AS drift FROM (SELECT * FROM two EXCEPT SELECT * FROM one) GROUP BY k""")
def hop_pruning(t):
    x = t.lineitem.select((F.col("l_orderkey") % 40).alias("k"), F.col("l_partkey").alias("c"), "l_linenumber")
    return a.hop_pruning(x.where("l_linenumber = 1"), x.where("l_linenumber > 1"), "k", "c", x.where("c % 3 = 0"))


@query(sql=f"""WITH {_SETS.split("n AS MATERIALIZED")[0].rstrip().rstrip(",")}, c AS MATERIALIZED (SELECT doc_id, list(s) AS s FROM s GROUP BY doc_id), k AS (SELECT d.doc_id, c.s FROM (SELECT doc_id FROM documents ORDER BY n_chars DESC, doc_id LIMIT 100) d JOIN c USING (doc_id)),
p AS (SELECT i.doc_id AS doc, k.doc_id AS other, len(list_intersect(i.s, k.s)) AS m, len(i.s) AS n, len(k.s) AS q FROM c i, k WHERE i.doc_id % 50 = 0 AND i.doc_id <> k.doc_id)
SELECT doc, other, containment, jaccard FROM (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY containment DESC, jaccard DESC, other) AS r FROM (SELECT doc, other, round(m / least(n, q), 6) AS containment, round(m / (n + q - m), 6) AS jaccard FROM p WHERE m > 0) WHERE containment >= 0.02) WHERE r <= 3""")
def duplicate_probe(t):
    """Incoming documents against the hundred longest."""
    d = t.documents.withColumn("h", text.shingle_hashes(text.content_words("text"), 5))
    return a.duplicate_probe(d.where("doc_id % 50 = 0"), d, "doc_id", "h", "n_chars", 100, 3, 0.02)
