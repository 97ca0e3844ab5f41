"""Walks from chunks over mentions and typed relations: expansion, decoration, fact seeds, graph tables and what is kept out of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import web
from . import relational as rel
from .graph import GENERIC, STRONG

# A list of our own: words and parts of books that are no names of entities.
STOP_NAMES = (
    "and", "or", "the", "this", "that", "these", "those", "it", "its", "they", "left", "middle", "right", "up", "down",
    "chapter", "section", "figure", "table", "page", "appendix", "author", "authors", "example", "the book",
)
# Types and id prefixes of provenance nodes, predicates that define.
NOISE_TYPES = ("document", "timereference", "time_reference", "date")
NOISE_PREFIXES = ("document:", "timereference:", "date:")
DEFINING = ("is_a", "defines", "part_of", "uses")
TYPE_ORDER = ("Person", "Organization", "Location", "Event", "Document", "Rule", "Law", "Product", "Artifact", "Method")


def is_junk_name(name: Column) -> Column:
    """Blank, a stop name, a bare number or letter, a bracketed number, ``1 and x``, or a numbered part such as ``Table 3``."""
    n = F.trim(F.regexp_replace(F.lower(F.coalesce(name, F.lit(""))), r"\s+", " "))
    shapes = (r"\[[0-9]+\]", "[0-9]+", "[a-z]", "[0-9]+ (and|or) [a-z0-9]+", "(chapter|section|figure|table|page|appendix|part|rule) [0-9ivxlcdm]+")
    out = (n == "") | n.isin(*STOP_NAMES)
    for s in shapes:
        out = out | n.rlike(f"^{s}$")
    return out


def is_noise_entity(entity: Column, kind: Column, name: Column) -> Column:
    """Nodes of provenance: by type, by id, or with a label that is a number, a date or a year."""
    label, out = F.lower(F.trim(F.coalesce(name, F.lit("")))), F.coalesce(F.lower(kind).isin(*NOISE_TYPES), F.lit(False))
    for p in NOISE_PREFIXES:
        out = out | F.coalesce(F.startswith(F.lower(entity.cast("string")), F.lit(p)), F.lit(False))
    return out | (label == "") | label.rlike(r"^[0-9]{1,4}([-/][0-9]{1,2}){0,2}$") | label.rlike("^(19|20)[0-9]{2}[a-z]$")


def primary_type(observed: DataFrame, entity: str, kind: str, override: dict[str, str] | None = None) -> DataFrame:
    """(entity, primary): the override, else the first of TYPE_ORDER that was observed, else the most frequent (ties by name)."""
    order = F.coalesce(F.try_element_at(F.create_map(*[x for i, t in enumerate(TYPE_ORDER) for x in (F.lit(t), F.lit(i))]), F.col(kind)), F.lit(len(TYPE_ORDER)))
    c = observed.where(F.col(kind).isNotNull()).groupBy(entity, kind).agg(F.count("*").alias("n"))
    best = c.groupBy(entity).agg(F.min_by(kind, F.struct(order, -F.col("n"), F.col(kind))).alias("primary"))
    if not override:
        return best
    named = F.create_map(*[F.lit(x) for p in override.items() for x in p])
    return best.withColumn("primary", F.coalesce(F.try_element_at(named, F.col(entity).cast("string")), "primary"))


def usable(relations: DataFrame) -> DataFrame:
    """Relations that a traversal may use, both ways, with ``weight``: confidence times 1 for strong, .7 for
    repaired ones; generic ones count half, and only with evidence."""
    generic = F.col("predicate").isin(*GENERIC)
    ok = F.coalesce(F.col("strength").isin(*STRONG), F.lit(False)) & ~generic | generic & (F.coalesce("evidence", F.lit("")) != "")
    w = F.coalesce("confidence", F.lit(0.5)) * F.when(generic, 0.5).when(F.col("strength") == "strong", 1.0).otherwise(0.7)
    r = relations.where(ok & (F.col("subject") != F.col("object"))).withColumn("weight", w)
    return r.select(F.col("subject").alias("src"), F.col("object").alias("dst"), "predicate", "weight", "chunk").union(r.select("object", "subject", "predicate", "weight", "chunk"))


def relation_walk(mentions: DataFrame, relations: DataFrame, seeds: DataFrame, k: int, parts: int | None = None) -> DataFrame:
    """(chunk, score, via): chunks that mention entities related to those of the seed chunks, the k best.

    score sums, over all paths, mention confidence * relation weight * mention confidence (null
    counts as .5); via is the number of related entities. Mentions are (chunk, entity, conf). With
    ``parts`` mentions and relations are dealt to so many tasks, so that what a task sorts need not grow with the input.
    """
    deal = lambda df, key: df.repartition(parts, key) if parts else df
    conf = F.coalesce("conf", F.lit(0.5))
    start = mentions.join(seeds, "chunk", "left_semi").select(F.col("entity").alias("src"), conf.alias("c1")).groupBy("src").agg(F.sum("c1").alias("c1"))
    near = start.join(deal(relations.select("src", "dst", "weight"), "src"), "src").groupBy(F.col("dst").alias("entity")).agg(F.sum(F.col("c1") * F.col("weight")).alias("c2"))
    found = deal(mentions.join(seeds, "chunk", "left_anti").select("chunk", "entity", conf.alias("c3")), "entity").join(near, "entity")
    out = deal(found, "chunk").groupBy("chunk").agg(F.round(F.sum(F.col("c2") * F.col("c3")), 6).alias("score"), F.countDistinct("entity").alias("via"))
    return out.orderBy(F.desc("score"), "chunk").limit(k)


def calls(relations: DataFrame, predicate: str = "calls") -> DataFrame:
    """Call edges both ways; a null confidence counts as 1."""
    c = relations.where((F.col("predicate") == predicate) & (F.col("subject") != F.col("object"))).withColumn("weight", F.coalesce("confidence", F.lit(1.0)))
    return c.select(F.col("subject").alias("src"), F.col("object").alias("dst"), "weight").union(c.select("object", "subject", "weight"))


def bridge_bonus(mentions: DataFrame, bridges: DataFrame, seeds: DataFrame, k: int) -> DataFrame:
    """(chunk, score, via): chunks of entities on the far side of bridges (a, b, score) that the seed chunks touch on one side.

    An entity takes its best bridge's score; a chunk the best of that times its mention's confidence, 1 at most.
    """
    mine = mentions.join(seeds, "chunk", "left_semi").select(F.col("entity").alias("near")).distinct()
    both = bridges.select(F.col("a").alias("near"), F.col("b").alias("entity"), "score").union(bridges.select("b", "a", "score"))
    far = both.join(mine, "near", "left_semi").join(mine.withColumnRenamed("near", "entity"), "entity", "left_anti").groupBy("entity").agg(F.max("score").alias("bonus"))
    hit = mentions.join(seeds, "chunk", "left_anti").groupBy("chunk", "entity").agg(F.max(F.coalesce("conf", F.lit(0.5))).alias("conf")).join(far, "entity")
    hit = hit.withColumn("score", F.round(F.least(F.lit(1.0), F.col("bonus") * F.col("conf")), 6))
    best = hit.groupBy("chunk").agg(F.max_by(F.struct("score", "entity"), F.struct("score", -F.col("entity"))).alias("b")).select("chunk", "b.score", F.col("b.entity").alias("via"))
    return best.orderBy(F.desc("score"), "chunk").limit(k)


def decorate(winners: DataFrame, mentions: DataFrame, relations: DataFrame, per_chunk: int = 3, per_winner: int = 8, chunks: int = 2, concepts: DataFrame | None = None) -> DataFrame:
    """(winner, seed, neighbor, predicate, weight, evidence): graph context of each winning chunk.

    A winner's ``per_chunk`` best mentioned entities lead to its ``per_winner`` best relations, each
    with up to ``chunks`` evidence chunks other than the winner. With ``concepts`` (entity) relations
    rank first by how many of their ends are among them, one more for a defining predicate, and
    those that touch none are left out.
    """
    m = mentions.join(winners.select(F.col("chunk").alias("winner")), F.col("chunk") == F.col("winner")).groupBy("winner", F.col("entity").alias("src")).agg(F.max(F.coalesce("conf", F.lit(0.5))).alias("c"))
    m = rel.top_per_key(m, ["winner"], [F.desc("c"), "src"], per_chunk, "_r").select("winner", "src")
    e = relations.groupBy("src", "dst", "predicate").agg(F.max("weight").alias("weight"))
    x = m.join(e, "src").withColumn("hits", F.lit(0))
    if concepts is not None:
        c = concepts.select(F.col("entity").alias("_e"), F.lit(1).alias("_h")).distinct()
        x = x.join(c.select(F.col("_e").alias("src"), F.col("_h").alias("h1")), "src", "left").join(c.select(F.col("_e").alias("dst"), F.col("_h").alias("h2")), "dst", "left")
        n = F.coalesce("h1", F.lit(0)) + F.coalesce("h2", F.lit(0))
        x = x.where(n > 0).withColumn("hits", n + F.col("predicate").isin(*DEFINING).cast("int"))
    x = rel.top_per_key(x, ["winner"], [F.desc("hits"), F.desc("weight"), "src", "dst", "predicate"], per_winner, "_r").select("winner", "src", "dst", "predicate", "weight")
    proof = relations.select("src", "dst", "predicate", F.col("chunk").alias("evidence")).distinct()
    y = x.join(proof, ["src", "dst", "predicate"], "left").where("evidence is null or evidence <> winner")
    y = rel.top_per_key(y, ["winner", "src", "dst", "predicate"], ["evidence"], chunks, "_r")
    full = x.join(y.select("winner", "src", "dst", "predicate", "evidence"), ["winner", "src", "dst", "predicate"], "left")
    return full.select("winner", F.col("src").alias("seed"), F.col("dst").alias("neighbor"), "predicate", F.round("weight", 6).alias("weight"), "evidence")


def fact_seeds(facts: DataFrame, entities: DataFrame, limit: int) -> DataFrame:
    """(chunk, score, fact): chunks that prove facts of the asked entities, .82 + .18 confidence of the best fact, the first ``limit`` facts.

    Facts are (fact, entity, chunk, confidence), ranked by confidence, then name.
    """
    f = facts.join(entities.select("entity").distinct(), "entity", "left_semi").where("chunk is not null").withColumn("c", F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce("confidence", F.lit(0.0)))))
    f = f.orderBy(F.desc("c"), "fact").limit(limit)
    return f.groupBy("chunk").agg(F.min_by(F.struct(F.round(0.82 + 0.18 * F.col("c"), 6).alias("score"), "fact"), F.struct(-F.col("c"), F.col("fact"))).alias("b")).select("chunk", "b.score", "b.fact")


def drop_noisy(seeds: DataFrame, chunks: DataFrame, noisy: Column) -> DataFrame:
    """Seeds whose chunk is of no noisy kind; a seed without a chunk row stays."""
    return seeds.join(chunks.where(noisy).select("chunk"), "chunk", "left_anti")


def support_rows(relations: DataFrame, parents: DataFrame, corpus: str) -> DataFrame:
    """One deterministic row for each relation of a chunk: (support_id, edge_key, subject, predicate, object, parent, chunk, confidence).

    Rows without a chunk, an end or a predicate are left out; the parent is looked up where it is known.
    """
    r = relations.where("chunk is not null and subject is not null and object is not null and coalesce(predicate, '') <> ''")
    r = r.join(parents.select("chunk", "parent"), "chunk", "left").withColumn("edge_key", F.concat_ws("|", "subject", "predicate", "object"))
    sid = web.domain_hash("support", F.col("edge_key"), F.lit(corpus), F.coalesce(F.col("parent").cast("string"), F.lit("")), F.col("chunk"))
    r = r.withColumn("support_id", sid)
    best = r.groupBy("support_id").agg(F.max(F.coalesce("confidence", F.lit(0.0))).alias("confidence"), *[F.first(c).alias(c) for c in ("edge_key", "subject", "predicate", "object", "parent", "chunk")])
    return best.select("support_id", "edge_key", "subject", "predicate", "object", "parent", "chunk", "confidence")


def graph_tables(relations: DataFrame, most: int = 5) -> DataFrame:
    """Edges folded from relation rows: (subject, predicate, object, confidence, n_evidence, evidence), where evidence
    is the ``most`` smallest chunks; every one of them stays in the support rows."""
    key = ["subject", "predicate", "object"]
    each = relations.where("subject <> object").groupBy(*key, "chunk").agg(F.max(F.coalesce("confidence", F.lit(0.5))).alias("confidence"))
    all_ = each.groupBy(*key).agg(F.max("confidence").alias("confidence"), F.count("*").alias("n_evidence"))
    few = rel.top_per_key(each, key, ["chunk"], most, "_r").groupBy(*key).agg(F.array_join(F.array_sort(F.collect_list("chunk")), ",").alias("evidence"))
    return all_.join(few, key)


def family_counts(edges: DataFrame, families: str, state: str) -> DataFrame:
    """(kind, value, n): edges by each relation family that they hold (none: WeakAssociation) and by state (none: typed)."""
    f = edges.select(F.explode(F.when(F.size(families) > 0, F.array_distinct(families)).otherwise(F.array(F.lit(None).cast("string")))).alias("v")).groupBy(F.coalesce("v", F.lit("WeakAssociation")).alias("value")).agg(F.count("*").alias("n"))
    s = edges.groupBy(F.coalesce(state, F.lit("typed")).alias("value")).agg(F.count("*").alias("n"))
    return f.select(F.lit("family").alias("kind"), "value", "n").unionByName(s.select(F.lit("state").alias("kind"), "value", "n"))


def drilldown(mentions: DataFrame, pairs: DataFrame, k: int) -> DataFrame:
    """(doc, other, entity, n, m, chunk, near, place): what joins two documents: their shared entities by the lesser
    number of mentions, k a pair, each with its best mentioned chunk on either side.

    Mentions are (doc, chunk, entity, conf); they are folded to one row for each document and entity first.
    """
    best = F.min_by("chunk", F.struct(-F.coalesce("conf", F.lit(0.5)), F.col("chunk")))
    one = mentions.groupBy("doc", "entity").agg(F.count("*").alias("n"), best.alias("chunk"))
    x = pairs.select("doc", "other").distinct().join(one, "doc").join(one.select(F.col("doc").alias("other"), "entity", F.col("n").alias("m"), F.col("chunk").alias("near")), ["other", "entity"])
    return rel.top_per_key(x, ["doc", "other"], [F.desc(F.least("n", "m")), F.desc(F.col("n") + F.col("m")), "entity"], k, "place").select("doc", "other", "entity", "n", "m", "chunk", "near", "place")
