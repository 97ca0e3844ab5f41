"""Queries for scores of a pool and what is chosen from it. Candidates are documents: twenty questions, sources as their documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text
from ..operators import ranking as rk
from ..operators import relational as rel
from .registry import Tables, query

CAND = """(SELECT doc_id % 20 AS query_id, doc_id AS item, source AS doc, doc_id // 6 AS parent, text, lang, (doc_id * 37 % 101) / 101.0::DOUBLE AS score,
 CASE n_chars % 4 WHEN 0 THEN 'summary' WHEN 1 THEN 'child+lexical' WHEN 2 THEN 'graph_fact_seed' ELSE 'vector' END AS tier, ['specific', 'balanced', 'broad'][doc_id % 3 + 1] AS need FROM documents)"""
TERMS = "['the', 'and', 'der', 'que']"
HAY = "' ' || trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')) || ' '"
KIND = "CASE WHEN tier = 'graph_fact_seed' THEN 'fact' WHEN contains(tier, '+lexical') THEN 'lexical' WHEN contains(tier, 'summary') THEN 'summary' ELSE 'child' END"


def candidates(t: Tables):
    d = F.col("doc_id")
    tier = F.when(F.col("n_chars") % 4 == 0, "summary").when(F.col("n_chars") % 4 == 1, "child+lexical").when(F.col("n_chars") % 4 == 2, "graph_fact_seed").otherwise("vector")
    need = F.get(F.array(*map(F.lit, ("specific", "balanced", "broad"))), (d % 3).cast("int"))
    return t.documents.select((d % 20).alias("query_id"), d.alias("item"), F.col("source").alias("doc"), F.floor(d / 6).alias("parent"), "text", "lang", ((d * 37 % 101) / 101.0).alias("score"), tier.alias("tier"), need.alias("need"))


_WEIGHTS = " ".join(f"WHEN need = '{n}' AND kind = '{k}' THEN {w}" for (t, n), row in rk.LANE_WEIGHTS.items() if t == "rich" for k, w in row.items())


@query(sql=f"SELECT query_id, item, kind, round(score * CASE {_WEIGHTS} ELSE 1.0 END, 6) AS weighted FROM (SELECT *, {KIND} AS kind FROM {CAND})")
def candidate_weights(t):
    """Scores by the table of need, kind and tier."""
    x = candidates(t).withColumn("kind", rk.candidate_kind(F.col("tier"), F.array().cast("array<string>")))
    return x.select("query_id", "item", "kind", F.round(F.col("score") * rk.lane_weight(F.col("kind"), F.col("need"), F.lit("hybrid")), 6).alias("weighted"))


_BEAR = f"SELECT item, lang, score, list_transform({TERMS}, lambda t: len(string_split(replace({HAY}, ' ', '  '), ' ' || t || ' ')) - 1) AS n FROM {CAND}"


@query(sql=f"""SELECT item, len(list_filter(n, lambda x: x > 0)) AS distinct_terms, list_sum(n)::BIGINT AS density, round(least(1.0, greatest(0.0, score + 0.06 * len(list_filter(n, lambda x: x > 0)) / 4 - CASE WHEN lang = 'de' THEN 0.08 ELSE 0 END)), 4) AS adjusted FROM ({_BEAR})""")
def answer_bearing(t):
    """Distinct terms, their occurrences, and the score with heading penalty and coverage bonus."""
    terms = F.array(*map(F.lit, ("the", "and", "der", "que")))
    x = candidates(t).select("item", "score", rk.bearing(F.col("text"), terms).alias("b"), rk.peripheral_penalty(F.when(F.col("lang") == "de", F.array(F.lit("Part 2"), F.lit("Further Reading"))).otherwise(F.array(F.lit("Body"))), F.lit("body")).alias("p"))
    return x.select("item", F.col("b.distinct").alias("distinct_terms"), F.col("b.density").alias("density"), rk.with_signals(F.col("score"), F.col("b"), terms, F.col("p"), F.lit(True)).alias("adjusted"))


_HITS = f"(SELECT item, CASE WHEN item % 5 = 0 THEN score * 9 - 4 ELSE score END AS score, len(list_filter({TERMS}, lambda t: contains(hay, ' ' || t || ' '))) AS hits FROM (SELECT *, {HAY} AS hay FROM {CAND}))"


@query(sql=f"""SELECT item, hits, round(CASE WHEN score >= 0 AND score <= 1 THEN CASE WHEN hits <= 0 THEN greatest(0.0, score * 30e-2) WHEN hits < 4 THEN least(1.0, greatest(0.0, score * (62e-2 + 18e-2 * (hits / 4)) + 4e-2 * hits)) ELSE least(1.0, greatest(0.0, score * 104e-2 + 12e-2)) END
 ELSE CASE WHEN hits <= 0 THEN score - 1.25 WHEN hits < 4 THEN score - 65e-2 * (1 - hits / 4) + 10e-2 * hits ELSE score + 75e-2 + 10e-2 * least(hits, 3) END END, 4) AS grounded FROM {_HITS}""")
def grounded_scores(t):
    """Scores rescaled by the share of the question's concepts that a candidate covers, on both scales."""
    concepts = F.array(*[F.array(F.lit(w)) for w in ("the", "and", "der", "que")])
    x = candidates(t).select("item", F.when(F.col("item") % 5 == 0, F.col("score") * 9 - 4).otherwise(F.col("score")).alias("score"), rk.grounding_note(concepts, F.col("text"))["matched_count"].alias("hits"))
    return x.select("item", "hits", rk.grounded(F.col("score"), F.col("hits"), F.lit(4), F.lit("")).alias("grounded"))


@query(sql=f"SELECT query_id, item, score FROM (SELECT *, max(score) OVER (PARTITION BY query_id) AS top FROM (SELECT query_id, item, CASE WHEN query_id = 3 THEN score * 0.4 WHEN query_id = 4 THEN score * 7 ELSE score END AS score FROM {CAND})) WHERE top > 1.0001 OR top < 0.5 OR score >= greatest(0.05, 0.2 * top)")
def tail_trim(t):
    """Near-zero tails of bounded pools; weak and mixed pools stay whole."""
    x = candidates(t).select("query_id", "item", F.when(F.col("query_id") == 3, F.col("score") * 0.4).when(F.col("query_id") == 4, F.col("score") * 7).otherwise(F.col("score")).alias("score"))
    return rk.trim_tail(x, "query_id", "score", "item")


_SCALES = f"(SELECT query_id, item, doc, CASE WHEN query_id % 3 = 1 THEN score * 5 - 2 WHEN query_id % 3 = 2 THEN 0.0 ELSE score END AS score FROM {CAND})"
_RELEVANCE = f"""(SELECT query_id, item, doc, score, i, lo, hi, round(CASE WHEN lo >= 0 AND hi <= 1 AND hi > 0 THEN 0.90 * score / hi + 0.10 * r WHEN hi - lo > 1e-9 THEN 0.82 * (score - lo) / (hi - lo) + 0.18 * r ELSE r END, 6) AS relevance FROM (SELECT *, 1 - (i - 1) / greatest(n - 1, 1) AS r FROM (
 SELECT *, min(score) OVER w AS lo, max(score) OVER w AS hi, count(*) OVER w AS n, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item) AS i FROM {_SCALES} WINDOW w AS (PARTITION BY query_id))))"""


def _scaled(t: Tables):
    q = F.col("query_id") % 3
    return candidates(t).select("query_id", "item", "doc", F.when(q == 1, F.col("score") * 5 - 2).when(q == 2, 0.0).otherwise(F.col("score")).alias("score"))


@query(sql=f"SELECT query_id, item, score, relevance FROM {_RELEVANCE}")
def blended_relevance(t):
    """Relevance of bounded, unbounded and flat pools."""
    return rk.pool_relevance(_scaled(t), "query_id", "score", "item").select("query_id", "item", "score", "relevance")


@query(sql=f"SELECT query_id, item, relevance FROM {_RELEVANCE} WHERE i = 1 OR CASE WHEN score >= 0 AND hi <= 1 AND hi > 0 THEN score / hi ELSE relevance END >= CASE WHEN doc LIKE '%1' THEN 0.4 ELSE 0.85 END")
def relaxed_floor(t):
    """The floor of .85, of .40 for rows of trusted documents."""
    return rk.passes_floor(_scaled(t), "query_id", "score", "item", 0.85, F.col("doc").endswith("1")).select("query_id", "item", "relevance")


@query()
def first_cliff_budget(t):
    """Candidates above the first gap of .02, within 900 words, overflowing ones passed over."""
    x = candidates(t).select("query_id", "item", F.pow("score", F.lit(3)).alias("score"), text.token_count("text").alias("cost"))
    return rk.first_cliff(x, "query_id", "score", "item", "cost", 0.05, 0.9, 0.02, 900)


def _pool(t: Tables):
    x = rel.top_per_key(candidates(t), ["query_id"], [F.desc("score"), "item"], 30)
    atoms = F.array_compact(F.array("lang", F.when(F.col("item") % 3 == 0, "number"), F.when(F.col("item") % 5 == 0, "definition")))
    predicates = F.when(F.col("item") % 4 == 0, F.array(F.lit("uses"))).otherwise(F.array().cast("array<string>"))
    return x.select(
        "query_id", "item", "score", "doc", "parent", F.array_distinct(text.content_words("text")).alias("tokens"), atoms.alias("atoms"), predicates.alias("predicates"),
        F.slice(F.array(*map(F.lit, ("dense", "lexical", "graph"))), 1, (F.col("item") % 3 + 1).cast("int")).alias("retrievers"),
        (F.col("item") % 4 == 0).alias("graph"), (F.col("item") % 11 == 0).alias("anchor"), (F.col("item") % 2 == 0).alias("grounded"),
    )


@query()
def mmr_graph_broad(t):
    """Eight seats of each question's thirty best, in the graph tier, for a broad need."""
    return rk.diversify(_pool(t), "query_id", "item", "score", 8, "graph", "broad", 2)


@query()
def mmr_hybrid_specific(t):
    return rk.diversify(_pool(t), "query_id", "item", "score", 8, "hybrid", "specific")


@query()
def reserved_finalists(t):
    """The diverse seats with each language that the question must cover."""
    pool = _pool(t)
    lanes = pool.join(t.documents.select(F.col("doc_id").alias("item"), F.array("lang").alias("lanes")), "item")
    return rk.reserve_lanes(lanes, rk.diversify(pool, "query_id", "item", "score", 4, "hybrid", "balanced"), "query_id", "item", "score", "lanes", ["en", "de", "fr", "es"], 4)


@query()
def waterfall_packet(t):
    """A packet of 1500 words from anchors, parents, orphans, entities and notes."""
    n = text.token_count("text")
    kind = F.get(F.array(*map(F.lit, ("parent", "anchor", "parent", "orphan", "parent", "entity", "note"))), (F.col("item") % 7).cast("int"))
    x = rel.ranked(candidates(t), ["query_id"], [F.desc("score"), "item"]).select("query_id", "item", "rank", kind.alias("kind"), n.alias("full"), F.least(n, F.lit(40)).alias("summary"), (F.col("item") - 3).alias("up"), "score")
    return rk.pack_packet(x, "query_id", "item", "rank", "kind", "full", "summary", "up", "score", 1500, spill=0.3)
