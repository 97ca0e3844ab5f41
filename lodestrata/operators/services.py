"""What runs around the stores: pressure, freshness, caches, repair, adapters from other formats, and the outward functions."""

from __future__ import annotations

import time
from collections import OrderedDict
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from . import relational as rel


def pressure(snapshot: DataFrame, rss_mb: str, cap_mb: str, queued: str, depth: int, latency_s: str, slow_s: float) -> DataFrame:
    """``action`` and ``admit``: pause at the memory cap or with a queue twice too deep; slow (half) from 85 % of
    the cap, from the depth, or with slow answers; else open. ``admit`` is the share of workers to run."""
    used = F.col(rss_mb) / F.col(cap_mb)
    stop = (F.coalesce(used, F.lit(0.0)) >= 1) | (F.coalesce(queued, F.lit(0)) >= 2 * depth)
    slow = (F.coalesce(used, F.lit(0.0)) >= 0.85) | (F.coalesce(queued, F.lit(0)) >= depth) | (F.coalesce(latency_s, F.lit(0.0)) > slow_s)
    action = F.when(stop, "pause").when(slow, "slow").otherwise("open")
    return snapshot.withColumn("action", action).withColumn("admit", F.when(stop, 0.0).when(slow, 0.5).otherwise(1.0))


def read_bounded(spark: SparkSession, path: str, schema: str, files: int) -> DataFrame:
    """A stream that takes so many files a trigger: what admits work where Spark reads by itself."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def epochs(signatures: DataFrame, previous: DataFrame, key: str) -> DataFrame:
    """(key, signature, epoch): the epoch rises by one where a corpus's signature changed; new corpora begin at 1, gone ones are left out."""
    p = previous.select(key, F.col("signature").alias("_s"), F.col("epoch").alias("_e"))
    x = signatures.select(key, "signature").join(p, key, "left")
    return x.select(key, "signature", F.when(F.col("_e").isNull(), 1).when(F.col("signature") == F.col("_s"), F.col("_e")).otherwise(F.col("_e") + 1).cast("long").alias("epoch"))


class ResultCache:
    """Results by key, at most ``size`` of them, each for ``ttl`` seconds; the least recently used goes first.

    The key should hold the epochs of what a result was made from, so a change makes it a new one.
    Cached DataFrames are persisted, and released when they leave.
    """

    def __init__(self, size: int, ttl: float, clock: Callable[[], float] = time.monotonic):
        self.size, self.ttl, self.clock, self.rows = size, ttl, clock, OrderedDict()

    def _drop(self, key) -> None:
        value, _ = self.rows.pop(key)
        if isinstance(value, DataFrame):
            value.unpersist()

    def get(self, key, make: Callable):
        now = self.clock()
        if key in self.rows:
            value, until = self.rows[key]
            if now < until:
                self.rows.move_to_end(key)
                return value
            self._drop(key)
        value = make()
        value = value.persist() if isinstance(value, DataFrame) else value
        self.rows[key] = (value, now + self.ttl)
        while len(self.rows) > self.size:
            self._drop(next(iter(self.rows)))
        return value


# Wordings that ask for what is of the day, the month, the year.
DAY_WORDS, DAY_PHRASES = ("today", "yesterday"), ("this week", "last week")
MONTH_MARKERS = ("breaking change", "changelog", "cve", "latest", "earnings", "market news", "market sentiment", "release notes", "security advisory", "this month")
YEAR_MARKERS = ("as of", "current", "currently", "recent", "this year", "up to date", "way ahead")


def time_range(question: Column | str) -> Column:
    """day, month or year where a question asks for what is fresh, else null; hyphens stand for blanks."""
    low = F.trim(F.regexp_replace(F.lower(tx.as_column(question)), r"[\s-]+", " "))
    flat = tx.padded(low)
    has = lambda markers: F.exists(F.array(*map(F.lit, markers)), lambda m: F.contains(low, m))
    word = lambda words: F.exists(F.array(*[F.lit(f" {w} ") for w in words]), lambda w: F.contains(flat, w))
    return F.when(word(DAY_WORDS) | has(DAY_PHRASES), "day").when(has(MONTH_MARKERS), "month").when(has(YEAR_MARKERS) | low.rlike(r"\b202[4-9]\b"), "year")


def web_query(question: Column | str, context: Column, most: int = 12, chars: int = 300) -> Column:
    """A bounded web query: the question's terms, then new ones of the context (most recent first), ``most`` in all."""
    own = tx.query_terms(question)
    more = F.filter(F.array_distinct(F.flatten(F.transform(context, tx.query_terms))), lambda w: F.length(w) > 3)
    return F.substring(F.array_join(F.slice(F.array_distinct(F.concat(own, more)), 1, most), " "), 1, chars)


def repair_plan(corpora: DataFrame, key: str, needs: dict[str, Column], limit: int, cooldown: Column) -> DataFrame:
    """(key, repair, place): the next repairs: one for each corpus that is not cooling down, its first need in
    the order given, the largest backlog first, ``limit`` at most."""
    first = F.coalesce(*[F.when(c > 0, F.struct(F.lit(n).alias("repair"), c.cast("long").alias("backlog"))) for n, c in needs.items()])
    x = corpora.where(~F.coalesce(cooldown, F.lit(False))).select(key, first.alias("r")).where("r is not null").select(key, "r.repair", "r.backlog")
    return rel.ranked(x.orderBy(F.desc("backlog"), key).limit(limit), [F.lit(0)], [F.desc("backlog"), key], "place")


def code_graph(payloads: DataFrame, column: str, keep: list[str]) -> DataFrame:
    """(source, target, kind, confidence, *keep) of node-link JSON: CALLS and IMPORTS links between named nodes; confidence is 1 where none is given.

    Links to unknown nodes, to themselves, and of other kinds are left out; repeats count once.
    """
    shape = "struct<nodes:array<struct<id:string,name:string,type:string>>,links:array<struct<source:string,target:string,relation:string,confidence:double>>>"
    p = payloads.select(*keep, F.from_json(column, shape).alias("g"), F.monotonically_increasing_id().alias("_p"))
    nodes = p.select("_p", F.explode("g.nodes").alias("n")).where("n.id is not null").groupBy("_p", F.col("n.id").alias("id")).agg(F.first(F.coalesce("n.name", "n.id")).alias("name"))
    links = p.select("_p", *keep, F.explode("g.links").alias("l")).select("_p", *keep, F.col("l.source").alias("s"), F.col("l.target").alias("t"), F.upper("l.relation").alias("kind"), F.coalesce("l.confidence", F.lit(1.0)).alias("confidence"))
    links = links.where(F.col("kind").isin("CALLS", "IMPORTS"))
    of = lambda x, c: nodes.select("_p", F.col("id").alias(x), F.col("name").alias(c))
    x = links.join(of("s", "source"), ["_p", "s"]).join(of("t", "target"), ["_p", "t"]).where("source <> target")
    return x.groupBy("source", "target", "kind", *keep).agg(F.max("confidence").alias("confidence"))


def split_by_corpus(points: DataFrame, corpus: str, path: str) -> None:
    """The points written to one folder for each corpus (partitionBy), so that readers of one corpus open its files only.

    Rows are dealt by corpus and a salt of their id, so a corpus that holds most points is written by many tasks.
    """
    points.withColumn("_salt", F.pmod(F.xxhash64(*points.columns), F.lit(16))).repartition(corpus, "_salt").drop("_salt").write.mode("overwrite").partitionBy(corpus).parquet(path)


def snippet_verdict(hits: DataFrame, query: str, text: str, host: str, terms: Column, chars: int = 160, hosts: int = 2) -> DataFrame:
    """(query, verdict): whether a search's snippets answer by themselves: enough (two hosts with long snippets that hold
    half of the terms, or all terms covered over two hits), thin (one such), or none."""
    n = F.size(F.filter(terms, lambda t: F.contains(tx.padded(text), F.concat(F.lit(" "), t, F.lit(" ")))))
    good = (F.length(text) >= chars) & (2 * n >= F.size(terms)) & (F.size(terms) > 0)
    x = hits.select(query, host, good.alias("_g"), F.filter(terms, lambda t: F.contains(tx.padded(text), F.concat(F.lit(" "), t, F.lit(" ")))).alias("_t"), F.size(terms).alias("_n"))
    a = x.groupBy(query).agg(F.countDistinct(F.when(F.col("_g"), F.col(host))).alias("h"), F.count_if("_g").alias("g"), F.size(F.array_distinct(F.flatten(F.collect_list("_t")))).alias("c"), F.max("_n").alias("n"))
    return a.select(query, F.when((F.col("h") >= hosts) | ((F.col("c") == F.col("n")) & (F.col("g") >= 2)), "enough").when(F.col("g") > 0, "thin").otherwise("none").alias("verdict"))
