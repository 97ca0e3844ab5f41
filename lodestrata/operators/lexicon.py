"""A corpus's lexicon: observations of names folded into entries with a canonical name, aliases, definitions and support."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import graph as g
from . import relational as rel


def identity(name: Column) -> Column:
    """Lower-case words of letters and digits between single blanks: the key under which spellings meet."""
    return F.trim(F.regexp_replace(F.lower(name), "[^a-z0-9]+", " "))


def is_abbreviation(name: Column) -> Column:
    """Two to six capitals, digits after the first letter allowed."""
    return F.trim(name).rlike("^[A-Z][A-Z0-9]{1,5}$")


def expands(short: Column, long: Column) -> Column:
    """Whether the initials of a key's words spell the short form."""
    initials = F.array_join(F.transform(F.split(identity(long), " "), lambda w: F.substring(w, 1, 1)), "")
    return (F.length(short) >= 2) & (F.lower(short) == initials)


def strong_links(links: DataFrame, keys: DataFrame, separated: DataFrame) -> DataFrame:
    """Alias links (source, target, surface) that merge two entries: (u, v).

    Both ends are known keys that nothing separates. A link holds if the surface, or one end, is the
    other's abbreviation, or if it is asserted both ways and three quarters of the shorter key's
    words are shared with at most two words' difference in length.
    """
    k = keys.select("key").distinct()
    x = links.where("source <> target").join(k.withColumnRenamed("key", "source"), "source", "left_semi").join(k.withColumnRenamed("key", "target"), "target", "left_semi")
    back = links.select(F.col("target").alias("source"), F.col("source").alias("target"), F.lit(True).alias("back")).distinct()
    x = x.join(back, ["source", "target"], "left")
    s, t = F.array_distinct(F.split("source", " ")), F.array_distinct(F.split("target", " "))
    shared = F.size(F.array_intersect(s, t)) / F.greatest(F.lit(1), F.least(F.size(s), F.size(t)))
    alike = F.coalesce("back", F.lit(False)) & (shared >= 0.75) & (F.abs(F.size(s) - F.size(t)) <= 2)
    short = (is_abbreviation(F.col("surface")) & expands(F.trim("surface"), F.col("source"))) | expands(F.col("source"), F.col("target")) | expands(F.col("target"), F.col("source"))
    x = x.where(F.coalesce(short, F.lit(False)) | alike).select(F.least("source", "target").alias("u"), F.greatest("source", "target").alias("v")).distinct()
    no = separated.select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct()
    return x.join(no, ["u", "v"], "left_anti")


def trailing_codes(keys: DataFrame) -> DataFrame:
    """(u, v): a key of five words or more that ends in a number, and the key without it, where both exist;
    a single variant needs a number above nine."""
    k = keys.select("key").distinct()
    x = k.select(F.col("key").alias("v"), F.regexp_extract("key", r"^(.* .* .* .*) ([0-9]+[a-z]?)$", 1).alias("u"), F.regexp_extract("key", "([0-9]+)[a-z]?$", 1).cast("long").alias("code")).where("u <> ''")
    x = x.join(k.withColumnRenamed("key", "u"), "u", "left_semi")
    many = x.groupBy("u").agg(F.count("*").alias("n"))
    return x.join(many, "u").where("n >= 2 or code > 9").select("u", "v")


def materialize(names: DataFrame, links: DataFrame, separated: DataFrame, definitions: DataFrame, aliases: int = 8, definitions_kept: int = 3) -> DataFrame:
    """(entry, canonical, aliases, support, confidence, definitions), one row for each group of keys.

    ``names`` is (name, support, confidence), one row an observation; ``definitions`` (name, text, score).
    Keys join by strong links and trailing codes. The canonical name has no trailing code before one, is no
    abbreviation before one, then of the most words (up to eight), then the most supported, then the last by name; support is the sum,
    confidence the mean weighted by it; the other names are aliases, most supported first.
    """
    n = names.where(identity(F.col("name")) != "").select(identity(F.col("name")).alias("key"), F.trim(F.regexp_replace("name", r"\s+", " ")).alias("name"), "support", "confidence")
    n = g.cut(n.groupBy("key", "name").agg(F.sum("support").alias("support"), F.sum(F.col("support") * F.col("confidence")).alias("mass")))
    codes = g.cut(trailing_codes(n))
    e = strong_links(links, n, separated).union(codes).distinct()
    root = g.components(e.select("u", "v", F.lit(1).alias("w"))).select(F.col("node").alias("key"), F.col("component").alias("entry"))
    n = g.cut(n.join(root, "key", "left").withColumn("entry", F.coalesce("entry", "key")))
    n = n.join(codes.select(F.col("v").alias("key"), F.lit(1).alias("_code")), "key", "left")
    order = F.struct(F.col("_code").isNull().cast("int"), (~is_abbreviation(F.col("name"))).cast("int"), F.least(F.size(F.split("key", " ")), F.lit(8)), "support", F.lower("name"), "name")
    by = n.groupBy("entry").agg(F.max_by("name", order).alias("canonical"), F.sum("support").alias("support"), F.round(F.sum("mass") / F.sum("support"), 6).alias("confidence"))
    other = n.join(by.select("entry", "canonical"), "entry").where("name <> canonical")
    other = rel.top_per_key(other, ["entry"], [F.desc("support"), "name"], aliases, "_r").groupBy("entry").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_r", "name"))), lambda x: x["name"]), "|").alias("aliases"))
    d = definitions.select(identity(F.col("name")).alias("key"), "text", "score").join(n.select("key", "entry").distinct(), "key").groupBy("entry", "text").agg(F.max("score").alias("score"))
    d = rel.top_per_key(d, ["entry"], [F.desc("score"), "text"], definitions_kept, "_r").groupBy("entry").agg(F.count("*").alias("definitions"))
    return by.join(other, "entry", "left").join(d, "entry", "left").select("entry", "canonical", F.coalesce("aliases", F.lit("")).alias("aliases"), "support", "confidence", F.coalesce("definitions", F.lit(0)).alias("definitions"))


def matches(terms: DataFrame, entries: DataFrame, aliases: DataFrame, k: int) -> DataFrame:
    """(term, entry, tier, score): the entries that a term names, strongest first, k a term.

    ``aliases`` is (entry, alias). An equal key scores 1; one that shares words scores their share plus
    min(.12, .018 ln(1 + support)), .08 with a definition, .02 with aliases, less .12 for a single
    unproven observation. Kept are those at max(.55, .75 of the term's best).
    """
    a = aliases.select("entry", identity(F.col("alias")).alias("key")).distinct()
    q = terms.select("term", identity(F.col("term")).alias("q")).distinct()
    exact = q.join(a, F.col("q") == F.col("key")).select("term", "entry", F.lit(1.0).alias("raw"), F.lit(0).alias("tier"))
    w = a.select("entry", "key", F.size(F.array_distinct(F.split("key", " "))).alias("n"), F.explode(F.array_distinct(F.split("key", " "))).alias("w"))
    near = q.select("term", F.size(F.array_distinct(F.split("q", " "))).alias("m"), F.explode(F.array_distinct(F.split("q", " "))).alias("w")).join(w, "w").groupBy("term", "entry", "key", "m", "n").agg(F.count("*").alias("both"))
    near = near.groupBy("term", "entry").agg(F.max(F.col("both") / (F.col("m") + F.col("n") - F.col("both"))).alias("raw")).withColumn("tier", F.lit(1))
    x = exact.unionByName(near).groupBy("term", "entry").agg(F.min("tier").alias("tier"), F.max("raw").alias("raw")).join(entries.select("entry", "support", "definitions", (F.col("aliases") != "").alias("named")), "entry")
    bonus = F.least(F.lit(0.12), 0.018 * F.log1p("support")) + F.when(F.col("definitions") > 0, 0.08).otherwise(0.0) + F.when(F.col("named"), 0.02).otherwise(0.0)
    weak = F.when((F.col("support") <= 1) & (F.col("definitions") == 0), 0.12).otherwise(0.0)
    x = x.withColumn("score", F.round(F.when(F.col("tier") == 0, F.greatest("raw", F.lit(1.0))).otherwise(F.col("raw") + bonus - weak), 6))
    bar = F.greatest(F.lit(0.55), 0.75 * F.max("score").over(rel.Window.partitionBy("term")))
    return rel.top_per_key(x.withColumn("_b", bar).where("score >= _b"), ["term"], [F.desc("score"), "entry"], k, "_r").select("term", "entry", "tier", "score")


def parity(entries: DataFrame, points: DataFrame) -> DataFrame:
    """(state, n): entries whose indexed copy is equal, differs or is missing, and points without an entry."""
    e = entries.select("entry", F.sha2(F.concat_ws("\x1f", "canonical", "aliases", F.col("support").cast("string")), 256).alias("e"))
    p = points.select("entry", F.col("content_hash").alias("p"))
    s = F.when(F.col("p").isNull(), "missing").when(F.col("e").isNull(), "orphan").when(F.col("e") == F.col("p"), "equal").otherwise("differs")
    return e.join(p, "entry", "full_outer").groupBy(s.alias("state")).agg(F.count("*").alias("n"))
