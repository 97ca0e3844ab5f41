"""Queries for what runs around the stores."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import audit as a
from ..operators import services as s
from .registry import query
from .texts import _QSTOP


@query(sql="""SELECT event_id, action, CASE action WHEN 'pause' THEN 0.0 WHEN 'slow' THEN 0.5 ELSE 1.0 END AS admit FROM (SELECT event_id, CASE WHEN value / 90e0 >= 1 OR user_id % 100 >= 80 THEN 'pause' WHEN value / 90e0 >= 85e-2 OR user_id % 100 >= 40 OR event_id % 13 > 11 THEN 'slow' ELSE 'open' END AS action FROM events)""")
def backpressure(t):
    """Whether work is admitted, from memory, queue and latency."""
    e = t.events.select("event_id", "value", F.lit(90.0).alias("cap"), (F.col("user_id") % 100).alias("queued"), (F.col("event_id") % 13).cast("double").alias("lag"))
    return s.pressure(e, "value", "cap", "queued", 40, "lag", 11.0).select("event_id", "action", "admit")


@query()
def freshness_epochs(t):
    """Epochs of sources whose documents changed since the last signature."""
    now = a.change_signature(t.documents, "doc_id", "n_chars", ["source"])
    before = a.change_signature(t.documents.withColumn("n_chars", F.when(F.col("source").endswith("3"), F.col("n_chars") + 1).otherwise(F.col("n_chars"))), "doc_id", "n_chars", ["source"]).withColumn("epoch", F.lit(4).cast("long"))
    return s.epochs(now, before.where("source not like '%5'"), "source").select("source", "epoch")


_ASK = "(SELECT conv_id, turn, CASE turn % 6 WHEN 0 THEN 'What happened TODAY in ' || text WHEN 1 THEN 'latest release notes' WHEN 2 THEN 'is it up-to-date' WHEN 3 THEN 'plans for 2026' ELSE text END AS q FROM conversations)"


def _list(words):
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


@query(sql=f"""SELECT conv_id, turn, CASE WHEN len(list_filter({_list(s.DAY_WORDS)}, lambda w: contains(flat, ' ' || w || ' '))) > 0 OR len(list_filter({_list(s.DAY_PHRASES)}, lambda m: contains(low, m))) > 0 THEN 'day' WHEN len(list_filter({_list(s.MONTH_MARKERS)}, lambda m: contains(low, m))) > 0 THEN 'month'
 WHEN len(list_filter({_list(s.YEAR_MARKERS)}, lambda m: contains(low, m))) > 0 OR regexp_matches(low, '\\b202[4-9]\\b') THEN 'year' END AS time_range FROM (SELECT conv_id, turn, low, ' ' || trim(regexp_replace(low, '[^a-z0-9]+', ' ', 'g')) || ' ' AS flat FROM (SELECT conv_id, turn, trim(regexp_replace(lower(q), '[\\s-]+', ' ', 'g')) AS low FROM {_ASK}))""")
def query_time_range(t):
    """How fresh a question wants its answers."""
    n = F.col("turn") % 6
    q = F.when(n == 0, F.concat(F.lit("What happened TODAY in "), "text")).when(n == 1, "latest release notes").when(n == 2, "is it up-to-date").when(n == 3, "plans for 2026").otherwise(F.col("text"))
    return t.conversations.select("conv_id", "turn", s.time_range(q).alias("time_range"))


_T = f"list_filter(regexp_extract_all(lower({{}}), '[a-z][a-z0-9]*'), lambda w: w NOT IN {_QSTOP})"
_UNIQUE = "list_filter({0}, lambda x, i: list_position({0}, x) = i)"


@query(sql=f"""WITH c AS (SELECT conv_id, turn, text, lag(text) OVER w AS p1, lag(text, 2) OVER w AS p2 FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn, text)), x AS (SELECT conv_id, turn, text, list_concat({_T.format("text")}, list_filter(list_concat({_T.format("coalesce(p1, '')")}, {_T.format("coalesce(p2, '')")}), lambda w: length(w) > 3)) AS w FROM c)
SELECT conv_id, turn, left(array_to_string(list_slice({_UNIQUE.format("w")}, 1, 12), ' '), 120) AS web_query FROM x""")
def web_queries(t):
    """A bounded web query for each turn, with terms of the two before it."""
    w = a.Window.partitionBy("conv_id").orderBy("turn", "text")
    x = t.conversations.withColumn("ctx", F.array(F.coalesce(F.lag("text").over(w), F.lit("")), F.coalesce(F.lag("text", 2).over(w), F.lit(""))))
    return x.select("conv_id", "turn", s.web_query("text", F.col("ctx"), 12, 120).alias("web_query"))


@query(sql="""WITH c AS (SELECT source, count_if(lang = 'de') AS d, count_if(n_chars > 5000) AS l, count_if(text LIKE '%|%') AS p FROM documents GROUP BY source), r AS (SELECT source, CASE WHEN p > 0 THEN 'tables' WHEN l > 2 THEN 'summaries' WHEN d > 0 THEN 'graph' END AS repair, CASE WHEN p > 0 THEN p WHEN l > 2 THEN l - 2 WHEN d > 0 THEN d END AS backlog FROM c WHERE source NOT LIKE '%7')
SELECT source, repair, backlog, row_number() OVER (ORDER BY backlog DESC, source) AS place FROM r WHERE repair IS NOT NULL ORDER BY backlog DESC, source LIMIT 8""")
def repair_plan(t):
    """The next bounded repairs over sources."""
    c = t.documents.groupBy("source").agg(F.count_if(F.col("lang") == "de").alias("d"), F.count_if(F.col("n_chars") > 5000).alias("l"), F.count_if(F.contains("text", F.lit("|"))).alias("p"))
    return s.repair_plan(c, "source", {"tables": F.col("p"), "summaries": F.greatest(F.col("l") - 2, F.lit(0)), "graph": F.col("d")}, 8, F.col("source").endswith("7"))


@query(sql="""SELECT source, target, kind, corpus, max(confidence) AS confidence FROM (SELECT 'C' || c_custkey AS source, 'N' || c_nationkey AS target, CASE WHEN c_custkey % 3 = 0 THEN 'IMPORTS' ELSE 'CALLS' END AS kind, c_mktsegment AS corpus, CASE WHEN c_custkey % 2 = 0 THEN 0.5 ELSE 1.0 END AS confidence FROM customer WHERE c_custkey % 5 > 0 AND c_custkey % 7 > 0) GROUP BY ALL""")
def code_graph(t):
    """Call and import edges from node-link JSON, one payload a row."""
    c, n = F.col("c_custkey").cast("string"), F.col("c_nationkey").cast("string")
    node = lambda i, name: F.struct(i.alias("id"), name.alias("name"))
    relation = F.when(F.col("c_custkey") % 5 == 0, "contains").when(F.col("c_custkey") % 3 == 0, "imports").otherwise("calls")
    target = F.when(F.col("c_custkey") % 7 == 0, "gone").otherwise("b")
    link = F.struct(F.lit("a").alias("source"), target.alias("target"), relation.alias("relation"), F.when(F.col("c_custkey") % 2 == 0, 0.5).alias("confidence"))
    payload = F.to_json(F.struct(F.array(node(F.lit("a"), F.concat(F.lit("C"), c)), node(F.lit("b"), F.concat(F.lit("N"), n))).alias("nodes"), F.array(link).alias("links")))
    return s.code_graph(t.customer.select(payload.alias("j"), F.col("c_mktsegment").alias("corpus")), "j", ["corpus"])


@query(sql="""WITH h AS (SELECT page_id % 25 AS query_id, regexp_extract(lower(url), '://([^/?#]*)', 1) AS host, html, list_filter(['page', 'the', 'der'], lambda w: contains(' ' || trim(regexp_replace(lower(html), '[^a-z0-9]+', ' ', 'g')) || ' ', ' ' || w || ' ')) AS m FROM pages), a AS (SELECT query_id, count(DISTINCT CASE WHEN length(html) >= 160 AND 2 * len(m) >= 3 THEN host END) AS h, count_if(length(html) >= 160 AND 2 * len(m) >= 3) AS g, len(list_distinct(flatten(list(m)))) AS c FROM h GROUP BY query_id)
SELECT query_id, CASE WHEN h >= 2 OR (c = 3 AND g >= 2) THEN 'enough' WHEN g > 0 THEN 'thin' ELSE 'none' END AS verdict FROM a""")
def snippet_sufficiency(t):
    """Whether the hits of a web search carry an answer by themselves."""
    h = t.pages.select((F.col("page_id") % 25).alias("query_id"), F.regexp_extract(F.lower("url"), "://([^/?#]*)", 1).alias("host"), "html")
    return s.snippet_verdict(h, "query_id", "html", "host", F.array(F.lit("page"), F.lit("the"), F.lit("der")))
