"""Query-side planning: lanes, vocabulary, scope, coverage, filters with fallback, merges across corpora."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as tx
from ..functions import web
from . import relational as rel


def with_fallback(filtered: DataFrame, unfiltered: Callable[[], DataFrame], least: int) -> DataFrame:
    """The filtered result if it has enough rows, else the unfiltered one (made only then)."""
    return filtered if filtered.limit(least).count() >= least else unfiltered()


def drop_low_confidence(pool: DataFrame, query: str, score: str, overlap: Column, floor: float) -> DataFrame:
    """A query's whole pool goes when its best score is under the floor and no row shares a query term."""
    w = Window.partitionBy(query)
    return pool.withColumn("_k", (F.max(score).over(w) >= floor) | F.max(overlap.cast("int")).over(w).cast("boolean")).where("_k").drop("_k")


def grounded_only(pool: DataFrame, query: str, side: str, grounded: Column, sides: int) -> DataFrame:
    """Ungrounded rows go only where every side has grounded evidence; else the pool stays as it is."""
    w = Window.partitionBy(query)
    x = pool.withColumn("_g", grounded).withColumn("_n", F.size(F.collect_set(F.when(F.col("_g"), F.col(side))).over(w)))
    return x.where(F.col("_g") | (F.col("_n") < sides)).drop("_g", "_n")


def lanes(spark: SparkSession, question: str, most: int = 6) -> DataFrame:
    """(lane_id, phrase, terms, required): quoted phrases, then sides of a comparison, then the question's n-grams."""
    import re

    low = question.lower()
    quoted = re.findall(r'"([^"]+)"', low)
    sides = [s.strip(" ?.,") for s in re.split(r"\b(?:versus|vs|compared with|and)\b", re.sub(r"^.*?\b(?:compare|between)\b", "", low))] if re.search(r"\b(compare|versus|vs|between)\b", low) else []
    words = [w for w in re.findall("[a-z][a-z0-9]*", low) if w not in tx.QUERY_STOP_WORDS]
    grams = [" ".join(words[i : i + 2]) for i in range(max(0, len(words) - 1))] or words
    rows, seen = [], set()
    for required, phrases in ((True, quoted), (True, sides), (False, grams)):
        for p in phrases:
            if p and p not in seen and len(rows) < most:
                seen.add(p)
                rows.append((f"lane{len(rows)}", p, re.findall("[a-z0-9]+", p), required))
    return spark.createDataFrame(rows, "lane_id string, phrase string, terms array<string>, required boolean")


def resolve_vocabulary(terms: DataFrame, lexicon: DataFrame, aliases: str = "aliases") -> DataFrame:
    """(term, concept, tier, evidence): exact alias before shared-token match; evidence grows with support and definitions."""
    a = lexicon.select("concept", "support", "n_definitions", F.explode(aliases).alias("alias")).withColumn("alias", F.lower("alias"))
    exact = terms.join(a, F.lower("term") == F.col("alias")).select("term", "concept", F.lit(0).alias("tier"), "support", "n_definitions")
    near = terms.withColumn("w", F.explode(F.split(F.lower("term"), " "))).join(a.withColumn("w", F.explode(F.split("alias", " "))), "w").select("term", "concept", F.lit(1).alias("tier"), "support", "n_definitions").distinct()
    e = F.when(F.col("tier") == 0, 1.0).otherwise(0.5 + F.least(F.lit(0.12), 0.018 * F.log1p("support")) + F.when(F.col("n_definitions") > 0, 0.08).otherwise(0.0))
    x = exact.unionByName(near).withColumn("evidence", F.round(e, 6))
    return rel.top_per_key(x, ["term"], ["tier", F.desc("evidence"), "concept"], 1, "_r").select("term", "concept", "tier", "evidence")


def query_entities(questions: DataFrame, entities: DataFrame, question: str, qid: str, name: str, entity: str, mentions: str, per_token: int = 5) -> DataFrame:
    """Entities whose name shares tokens with the question: overlap * mentions, the best tokens * per_token of each question.

    Questions of the same tokens are answered once, and a task keeps the best of each before the shuffle.
    """
    q = questions.select(qid, F.explode(tx.query_terms(question)).alias("w")).groupBy(qid).agg(F.array_sort(F.collect_list("w")).alias("_ws"))  # the tokens of one question
    q = rel.cut(q.join(q.groupBy("_ws").agg(F.min(qid).alias("_s")), "_ws").select(qid, "_s", "_ws"))
    asked = q.where(F.col(qid) == F.col("_s")).select("_s", "_ws", F.size("_ws").alias("tokens"))
    most = (asked.agg(F.max("tokens")).first()[0] or 0) * per_token
    n = entities.select(entity, mentions, F.explode(F.array_distinct(tx.words(name))).alias("w"))
    s = asked.select("_s", F.explode("_ws").alias("w")).join(n, "w").groupBy("_s", entity, mentions).agg(F.count("*").alias("overlap")).withColumn("score", F.col("overlap") * F.col(mentions))
    best = rel.top_per_key(s, ["_s"], [F.desc("score"), entity], most, "place").join(asked.select("_s", "tokens"), "_s").where(F.col("place") <= F.col("tokens") * per_token)
    return q.select(qid, "_s").join(best, "_s").select(qid, entity, "overlap", "score", "place")


def evidence_coverage(pool: DataFrame, query: str, lane: str, doc: str, strong: Column, need: int) -> DataFrame:
    """Per query: lanes with at least ``need`` distinct documents of strong evidence, lanes in all, and whether all are covered."""
    c = pool.groupBy(query, lane).agg(F.countDistinct(F.when(strong, F.col(doc))).alias("docs"))
    return c.groupBy(query).agg(F.count_if(F.col("docs") >= need).alias("covered"), F.count("*").alias("lanes")).withColumn("complete", F.col("covered") == F.col("lanes"))


def gap_profile(questions: DataFrame, qid: str, question: str, specs: dict[str, dict[str, float]], least: float = 0.38) -> DataFrame:
    """(qid, domain, confidence, place): keyword weights of each domain, +.25 structural on explicit gap wording, the best and three more."""
    hay = F.concat(F.lit(" "), F.regexp_replace(F.lower(question), "[^a-z0-9]+", " "), F.lit(" "))
    scored = []
    for d, words in sorted(specs.items()):
        s = sum((F.when(F.contains(hay, F.lit(f" {w} ")), x).otherwise(0.0) for w, x in sorted(words.items())), F.lit(0.0))
        if d == "structural":
            s = s + F.when(hay.rlike(" (gap|gaps|missing|disconnected|bridge) "), 0.25).otherwise(0.0)
        scored.append(F.struct(F.lit(d).alias("domain"), F.round(F.least(F.lit(1.0), s), 4).alias("confidence")))
    x = questions.select(qid, F.explode(F.array(*scored)).alias("x")).select(qid, "x.*")
    x = rel.ranked(x, [qid], [F.desc("confidence"), "domain"], "place")
    return x.where((F.col("place") == 1) | ((F.col("place") <= 4) & (F.col("confidence") >= least)))


def cache_key(question: Column | str, corpora: Column, model: str) -> Column:
    """Deterministic key of a refined query: normalised question, sorted corpora, model."""
    q = F.trim(F.regexp_replace(F.lower(tx.as_column(question)), r"\s+", " "))
    return web.domain_hash("refine", q, F.array_join(F.array_sort(corpora), ","), F.lit(model))


def merge_corpora(parts: list[DataFrame], keys: list[str], score: str, k: int) -> DataFrame:
    """Results of several corpora as one: best row of each key, ranked again."""
    both = parts[0]
    for p in parts[1:]:
        both = both.unionByName(p, allowMissingColumns=True)
    return rel.top_per_key(rel.latest(both, keys, [F.desc(score)]), [F.lit(0)], [F.desc(score), *keys], k, "place")


def coverage_rounds(pool: DataFrame, missing: Callable[[DataFrame], DataFrame], search: Callable[[DataFrame], DataFrame], keys: list[str], rounds: int = 2) -> DataFrame:
    """Search again for uncovered concepts and add what is new, at most ``rounds`` times."""
    for _ in range(rounds):
        gaps = missing(pool)
        if not gaps.limit(1).count():
            break
        pool = pool.unionByName(search(gaps).join(pool.select(*keys), keys, "left_anti"))
    return pool


def cascade_delete(tables: dict[str, DataFrame], gone: DataFrame, keys: list[str]) -> dict[str, DataFrame]:
    """Each table without the rows of deleted keys, and ``tombstones`` with those keys."""
    out = {n: df.join(gone.select(*keys).distinct(), keys, "left_anti") if set(keys) <= set(df.columns) else df for n, df in tables.items()}
    return out | {"tombstones": gone.select(*keys).distinct()}


def search_hits(payloads: DataFrame, column: str, most: int) -> DataFrame:
    """(url, title, snippet, rank) of metasearch JSON: canonical URLs, first of equals, at most ``most``."""
    kind = "struct<results:array<struct<url:string,title:string,content:string>>>"
    x = payloads.select(F.posexplode(F.from_json(column, kind)["results"]).alias("i", "r")).where("r.url is not null")
    x = x.select("i", web.canonical_url("r.url").alias("url"), F.col("r.title").alias("title"), F.col("r.content").alias("snippet"))
    return rel.ranked(rel.latest(x, ["url"], ["i"]), [F.lit(0)], ["i"], "rank").where(F.col("rank") <= most).drop("i")
