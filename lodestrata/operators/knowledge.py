"""Entity lookup, anchors, facts, lexicon, spans, claims and corpus summaries."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text
from . import relational as rel


def entity_first(entities: DataFrame, mentions: DataFrame, name: str, term: str, k: int) -> DataFrame:
    """Chunks by the confidence of their mentions of entities whose name contains a term: min(sum, 1), top k."""
    hit = entities.where(F.contains(F.lower(name), F.lit(term.lower()))).select("entity")
    s = mentions.join(hit, "entity", "left_semi").groupBy("chunk").agg(F.round(F.least(F.sum("conf"), F.lit(1.0)), 6).alias("score"))
    return s.orderBy(F.desc("score"), "chunk").limit(k)


def capped_facts(facts: DataFrame, entity: str, order: list, limit: int, entities: int) -> DataFrame:
    """ceil(limit / entities) facts of each entity, then the best over all."""
    per = -(-limit // max(1, entities))
    return rel.top_per_key(facts, [entity], order, per, "_r").drop("_r").orderBy(*order).limit(limit)


def anchor_score(query: Column, label: Column, document: bool = False) -> Column:
    """Match of a query with a label: equal, contained, or by shared tokens; 0 below two shared tokens."""
    flat = lambda c: F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", " "))
    q, n = flat(query), flat(label)
    qt, nt = F.array_distinct(F.split(q, " ")), F.array_distinct(F.split(n, " "))
    pad = lambda c: F.concat(F.lit(" "), c, F.lit(" "))
    shared = F.size(F.array_intersect(qt, nt))
    cov, qcov = shared / F.size(nt), shared / F.size(qt)
    inside = (F.size(nt) >= 2) & pad(q).contains(pad(n))
    if document:
        good = F.when(F.size(nt) <= 3, cov >= 1.0).when(F.size(nt) <= 5, cov >= 0.75).otherwise((cov >= 0.75) | (shared >= 4))
        return F.when(q == n, 1.0).when(inside, 0.98).when((shared >= 2) & good, F.least(F.lit(0.94), 0.56 + 0.30 * cov + 0.08 * qcov)).otherwise(0.0)
    return F.when(q == n, 1.0).when(inside, 0.95).when((F.size(qt) >= 2) & pad(n).contains(pad(q)), 0.88).when(shared >= 2, F.least(F.lit(0.86), 0.55 + 0.25 * cov + 0.10 * qcov)).otherwise(0.0)


def lane_grounding(hay: Column, phrases: Column, terms: Column, held: Column | None = None) -> Column:
    """2 + coverage if a phrase of two tokens or more occurs, else coverage; halved for a two-token or numbered first phrase without a match.

    The text, the phrases and the terms are ``padded``, each once; ``held`` is the number of terms in the text where that is known.
    """
    cov = (F.size(F.filter(terms, lambda t: F.contains(hay, t))) if held is None else held) / F.greatest(F.size(terms), F.lit(1))
    exact = F.exists(phrases, lambda p: p.rlike("^ [^ ]+ [^ ]") & F.contains(hay, p))
    first = F.get(phrases, F.lit(0))
    weak = first.rlike("^ [^ ]+ [^ ]+ $") | first.rlike("[0-9]")
    return F.when(exact, 2 + cov).when(F.coalesce(weak, F.lit(False)), cov / 2).otherwise(cov)


def nearest_preceding(cues: DataFrame, mentions: DataFrame, key: str) -> DataFrame:
    """Each cue (key, cue_at) with the closest mention at or before it, else the closest after: one pass, no pairs."""
    m = mentions.select(key, F.col("at").alias("_t"), F.lit(0).alias("_s"), "name")
    c = cues.select(key, F.col("cue_at").alias("_t"), F.lit(1).alias("_s"), F.lit(None).cast("string").alias("name"))
    w = Window.partitionBy(key).orderBy("_t", "_s")
    both = m.unionByName(c)
    before = F.last("name", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    after = F.first("name", ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
    return both.withColumn("subject", F.coalesce(before, after)).where("_s = 1").select(key, F.col("_t").alias("cue_at"), "subject")


def spans_without_overlap(spans: DataFrame, key: str) -> DataFrame:
    """Of (key, start, end, score, kind): best per span, then greedily by score, length and start, dropping overlaps."""

    def pick(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(["score", "kind"], ascending=[False, True]).drop_duplicates(["start", "end"])
        g = g.assign(n=g["end"] - g["start"]).sort_values(["score", "n", "start"], ascending=[False, False, True])
        taken: list[tuple[int, int]] = []
        keep = []
        for r in g.itertuples():
            if all(r.end <= a or r.start >= b for a, b in taken):
                taken.append((r.start, r.end))
                keep.append(r.Index)
        return g.loc[keep].drop(columns="n").sort_values("start")

    return spans.groupBy(key).applyInPandas(pick, spans.schema)


def best_excerpt(s: Column, terms: Column) -> Column:
    """The sentence with the most distinct terms; the first of equals. Null if none has any."""
    pad = lambda c: F.concat(F.lit(" "), F.regexp_replace(F.lower(c), "[^a-z0-9]+", " "), F.lit(" "))
    scored = F.transform(s, lambda x, i: F.struct(F.size(F.filter(terms, lambda t: pad(x).contains(F.concat(F.lit(" "), t, F.lit(" "))))).alias("n"), (-i).alias("i"), x.alias("s")))
    top = F.array_max(scored)
    return F.when(top["n"] > 0, top["s"])


def definitions(docs: DataFrame, id_col: str, text_col: str, names: DataFrame, name: str) -> DataFrame:
    """First sentence of each name of the form ``Name is a ...`` over documents, at most 200 characters."""
    s = docs.select(id_col, F.posexplode(text.sentences(text_col)).alias("i", "s"))
    s = s.withColumn("head", F.lower(F.regexp_extract("s", r"^([A-Za-z][A-Za-z ]{0,40}?) (is|are|was) (a|an|the) ", 1))).where("head <> ''")
    hit = s.join(names.select(F.lower(name).alias("head"), F.col(name).alias("name")).distinct(), "head")
    return hit.groupBy("name").agg(F.min_by(F.substring("s", 1, 200), F.struct(id_col, "i")).alias("definition"))


def split_overlay(names: DataFrame, terms: DataFrame) -> DataFrame:
    """Full outer union of two vocabularies with a side label, and alignment |both| / |either| beside each row."""
    n, t = names.select(F.lower(F.trim("name")).alias("w")).distinct(), terms.select(F.lower(F.trim("term")).alias("w")).distinct()
    j = n.withColumn("a", F.lit(1)).join(t.withColumn("b", F.lit(1)), "w", "full_outer")
    side = F.when(F.col("a").isNull(), "term").when(F.col("b").isNull(), "entity").otherwise("both")
    return j.select("w", side.alias("side"))


def discourse_shape(clusters: DataFrame, size: str) -> DataFrame:
    """Gini over .6 CONCENTRATED; largest over .5 SKEWED; more than five and largest under .25 DISPERSED; else BALANCED."""
    g = rel.gini(clusters, size)
    t = clusters.agg(F.count("*").alias("n"), (F.max(size) / F.sum(size)).alias("top"))
    x = t.crossJoin(g)  # one row each
    return x.select("n", F.round("top", 6).alias("top"), "gini", F.when(F.col("gini") > 0.6, "CONCENTRATED").when(F.col("top") > 0.5, "SKEWED").when((F.col("n") > 5) & (F.col("top") < 0.25), "DISPERSED").otherwise("BALANCED").alias("shape"))


def domain_reserve(df: DataFrame, query: str, rank: str, domain: str, score: str, k: int) -> DataFrame:
    """The first k; if all share a domain, the best later candidate of another with score >= .25 top takes the last seat."""
    w = Window.partitionBy(query)
    x = df.withColumn("_top", F.max(score).over(w)).withColumn("_first", F.first(domain).over(w.orderBy(rank)))
    x = x.withColumn("_same", F.min(F.when(F.col(rank) <= k, (F.col(domain) == F.col("_first")).cast("int"))).over(w))
    other = (F.col(rank) > k) & (F.col(domain) != F.col("_first")) & (F.col(score) >= 0.25 * F.col("_top"))
    x = x.withColumn("_swap", F.when(F.col("_same") == 1, F.min(F.when(other, F.col(rank))).over(w)))
    keep = F.when(F.col("_swap").isNull(), F.col(rank) <= k).otherwise((F.col(rank) < k) | (F.col(rank) == F.col("_swap")))
    return x.where(keep).select(df.columns)


def motif(df: DataFrame, key: str, order: str, value: str, pattern: list[str]) -> DataFrame:
    """Places where consecutive values equal the pattern: (key, at)."""
    w = Window.partitionBy(key).orderBy(order)
    match = F.lit(True)
    for i, p in enumerate(pattern):
        match = match & F.coalesce(F.lead(value, i).over(w) == p, F.lit(False))
    return df.withColumn("_m", match).where("_m").select(key, F.col(order).alias("at"))


def greedy_modularity(edges: DataFrame) -> pd.DataFrame:
    """Communities of a small graph (at most 80 terms by definition) by greedy modularity: (node, community)."""
    e = edges.select("u", "v", "w").limit(80 * 79 // 2 + 1).toPandas()
    m2 = 2 * float(e["w"].sum())
    deg: dict = {}
    for r in e.itertuples():
        deg[r.u] = deg.get(r.u, 0) + r.w
        deg[r.v] = deg.get(r.v, 0) + r.w
    if len(deg) > 80:
        raise ValueError("more than 80 nodes")
    group = {n: {n} for n in sorted(deg)}
    a = {n: deg[n] / m2 for n in group}
    between: dict = {}
    for r in e.itertuples():
        between[frozenset((r.u, r.v))] = between.get(frozenset((r.u, r.v)), 0) + r.w / m2
    while True:
        best = max(((2 * (w - a[min(p)] * a[max(p)]), -i, p) for i, (p, w) in enumerate(sorted(between.items(), key=lambda x: sorted(x[0])))), default=None, key=lambda x: x[:2])
        if not best or best[0] <= 1e-12:
            break
        keep, gone = sorted(best[2])
        group[keep] |= group.pop(gone)
        a[keep] += a.pop(gone)
        merged: dict = {}
        for p, w in between.items():
            q = frozenset(keep if x == gone else x for x in p)
            if len(q) == 2:
                merged[q] = merged.get(q, 0) + w
        between = merged
    return pd.DataFrame([(n, min(g)) for g in group.values() for n in sorted(g)], columns=["node", "community"])
