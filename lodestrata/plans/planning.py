"""Queries of extraction and planning operators over the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text
from ..operators import extraction as ex
from ..operators import planning as pl
from .registry import query
from .retrieval import dense, dense_sql

_STOP = ", ".join(f"'{w}'" for w in text.QUERY_STOP_WORDS)


@query(sql="SELECT conv_id, packet, count(*) AS units, sum(n)::BIGINT AS bytes, min(turn) AS first FROM (SELECT conv_id, turn, n, ((sum(n) OVER (PARTITION BY conv_id ORDER BY turn) - n) // 600)::BIGINT AS packet FROM (SELECT conv_id, turn, octet_length(encode(text)) AS n FROM conversations)) GROUP BY ALL")
def parent_packets(t):
    """Turns in packets of about 600 bytes."""
    return ex.packets(t.conversations, "conv_id", "turn", "text", 600)


@query(sql="SELECT doc_id, CASE WHEN trim(text) = '' THEN 'blank' WHEN regexp_full_match(text, '[\\s|\\-:+_=*~.–—─━]*') THEN 'separator' WHEN len(string_split(trim(regexp_replace(text, '\\s+', ' ', 'g')), ' ')) < 40 THEN 'short' END AS reason FROM documents")
def parent_eligibility(t):
    return t.documents.select("doc_id", ex.eligible("text", F.lit("body")).alias("reason"))


@query(sql=f"""SELECT conv_id, l.e AS entity, l.overlap, l.overlap * l.m AS score FROM (SELECT conv_id, p_partkey AS e, p_size AS m, count(*) AS overlap, (SELECT 1) AS x FROM (SELECT conv_id, unnest(list_distinct(list_filter(regexp_extract_all(lower(text), '[a-z][a-z0-9]*'), lambda w: w NOT IN ({_STOP})))) AS w FROM (SELECT conv_id, 'small ring and steel bolt ' || conv_id AS text FROM (SELECT DISTINCT conv_id FROM conversations WHERE conv_id % 50 = 0))) q
 JOIN (SELECT p_partkey, p_size, unnest(list_distinct(regexp_extract_all(lower(p_name), '[a-z][a-z0-9]*'))) AS w FROM part) n USING (w) GROUP BY ALL) l QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY l.overlap * l.m DESC, l.e) <= 20""")
def query_entities(t):
    """Entities that a question names, by shared tokens and mentions."""
    q = t.conversations.where("conv_id % 50 = 0").select("conv_id").distinct().select("conv_id", F.concat(F.lit("small ring and steel bolt "), F.col("conv_id").cast("string")).alias("text"))
    e = t.part.select(F.col("p_partkey").alias("entity"), F.col("p_size").alias("m"), "p_name")
    return pl.query_entities(q, e, "text", "conv_id", "p_name", "entity", "m").select("conv_id", "entity", "overlap", "score")


@query(sql=f"SELECT query_id, count_if(docs >= 2) AS covered, count(*) AS lanes, count_if(docs >= 2) = count(*) AS complete FROM (SELECT query_id, label, count(DISTINCT CASE WHEN score > 0.15 THEN vec_id END) AS docs FROM ({dense_sql(30)}) JOIN embeddings USING (vec_id) GROUP BY ALL) GROUP BY query_id")
def evidence_coverage(t):
    p = dense(t, 30).join(t.embeddings.select("vec_id", "label"), "vec_id")
    return pl.evidence_coverage(p, "query_id", "label", "vec_id", F.col("score") > 0.15, 2)


@query(sql="SELECT lower(lang) AS s, source AS o, negated, count(DISTINCT doc_id) AS support, min(doc_id) AS first_evidence FROM (SELECT lang, source, doc_id, doc_id % 7 = 0 AS negated FROM documents) GROUP BY ALL")
def claim_records(t):
    """Claims (language, is in, source) with support, and negated twins."""
    f = t.documents.select("lang", F.when(F.col("doc_id") % 7 == 0, "is not in").otherwise("is in").alias("p"), "source", "doc_id")
    return ex.claims(f, "lang", "p", "source", "doc_id").select("s", "o", "negated", "support", "first_evidence")


@query(sql="SELECT doc_id, CASE WHEN en + de + fr = 0 THEN 'general' WHEN en >= de AND en >= fr THEN 'english' WHEN fr >= de THEN 'french' ELSE 'german' END AS domain FROM (SELECT doc_id, contains(h, ' the ')::INT + contains(h, ' and ')::INT AS en, contains(h, ' der ')::INT + contains(h, ' die ')::INT AS de, contains(h, ' les ')::INT + contains(h, ' que ')::INT AS fr FROM (SELECT doc_id, ' ' || regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g') || ' ' AS h FROM documents))")
def domain_resolution(t):
    rules = [("the", "english", 0), ("and", "english", 0), ("der", "german", 2), ("die", "german", 2), ("les", "french", 1), ("que", "french", 1)]
    return ex.resolve_taxonomy(t.documents, "doc_id", "text", rules)


@query()
def script_tokens(t):
    """Script-aware tokens of all documents: number of each."""
    return t.documents.select("doc_id", F.size(ex.script_tokens("text")).cast("long").alias("n"))


@query()
def table_facts(t):
    """Facts from delimited lines: the first line of a document is the header."""
    lines = t.documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "line")).where(F.contains("line", F.lit(" | ")))
    rows = lines.select("doc_id", F.col("i").alias("row_no"), F.transform(F.sequence(F.lit(1), F.size(F.split("line", " \\| "))), lambda k: F.concat(F.lit("c"), k.cast("string"))).alias("h"), F.split("line", " \\| ").alias("c"))
    return ex.table_facts(rows, ["doc_id"], "h", "c")
