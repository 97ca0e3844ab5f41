"""Scores of a retrieved pool and what is chosen from it: weights, grounding, floors, trims, diversity, budgets."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as tx
from . import relational as rel

# Weights of a candidate's kind by tier (vector, or any richer one) and by how broad a question is.
LANE_WEIGHTS = {
    ("vector", "specific"): {"child": 1.08, "summary": 0.94},
    ("vector", "balanced"): {"child": 1.00, "summary": 1.02},
    ("vector", "broad"): {"child": 0.96, "summary": 1.10},
    ("rich", "specific"): {"child": 1.06, "summary": 0.95, "lexical": 1.12, "fact": 1.04},
    ("rich", "balanced"): {"child": 1.00, "summary": 1.04, "lexical": 1.06, "fact": 1.04},
    ("rich", "broad"): {"child": 0.96, "summary": 1.12, "lexical": 1.02, "fact": 1.06},
}
# Headings and kinds of chunks that stand beside the content.
PERIPHERAL_HEADINGS = (
    "footnote", "endnote", "sidebar", "appendix", "appendices", "bibliography", "references", "works cited", "glossary", "acknowledg",
    "about the author", "further reading", "see also", "table of contents", "copyright", "colophon", "review questions",
)
PERIPHERAL_KINDS = ("caption", "footnote", "header", "footer", "toc", "nav")
HEADING_PENALTY, KIND_PENALTY, BEARING_BONUS, UNBOUNDED = 0.08, 0.04, 0.06, 5.0
# Floors and bonuses of the diversity pass.
ABS_FLOOR, FLOOR_RATIO, MIN_KEEP, GROUNDED_FLOOR, SPECIFIC_FLOOR, NEAR = 0.10, 0.25, 3, 0.40, 0.50, 0.88


def candidate_kind(source: Column, retrievers: Column) -> Column:
    """fact, lexical, summary or child, by the name of a candidate's source and the retrievers that found it."""
    s = F.lower(F.coalesce(source, F.lit("")))
    has = lambda *names: F.coalesce(F.arrays_overlap(retrievers, F.array(*map(F.lit, names))), F.lit(False))
    return F.when((s == "graph_fact_seed") | has("graph_fact"), "fact").when(F.contains(s, F.lit("+lexical")) | has("lexical", "sparse"), "lexical").when(F.contains(s, F.lit("summary")), "summary").otherwise("child")


def lane_weight(kind: Column, need: Column, tier: Column) -> Column:
    """The weight of (tier, need, kind); 1 where the table has none."""
    rows = [x for (t, n), row in LANE_WEIGHTS.items() for k, w in row.items() for x in (F.lit(f"{t} {n} {k}"), F.lit(w))]
    key = F.concat_ws(" ", F.when(tier == "vector", "vector").otherwise("rich"), need, kind)
    return F.coalesce(F.try_element_at(F.create_map(*rows), key), F.lit(1.0))


def bearing(text: Column, terms: Column) -> Column:
    """struct(distinct, density): query terms that occur as whole words, and how often all of them do."""

    def of(hay):
        n = F.transform(terms, lambda t: F.size(F.split(hay, F.concat(F.lit(" "), t, F.lit("(?= )")))) - 1)
        return F.struct(F.size(F.filter(n, lambda x: x > 0)).cast("long").alias("distinct"), F.aggregate(n, F.lit(0), lambda a, x: a + x).cast("long").alias("density"))

    return F.transform(F.array(tx.padded(text)), of)[0]


def peripheral_penalty(headings: Column, kind: Column) -> Column:
    path = F.lower(F.array_join(headings, " "))
    known = F.exists(F.array(*map(F.lit, PERIPHERAL_HEADINGS)), lambda m: F.contains(path, m))
    return F.when(F.coalesce(known, F.lit(False)), HEADING_PENALTY).otherwise(0.0) + F.when(F.coalesce(F.lower(kind).isin(*PERIPHERAL_KINDS), F.lit(False)), KIND_PENALTY).otherwise(0.0)


def with_signals(score: Column, found: Column, terms: Column, penalty: Column, bounded: Column) -> Column:
    """Score plus .06 of term coverage less the penalty; five times both, and no clamp to 0..1, on an unbounded scale."""
    cover = F.when(F.size(terms) > 0, found["distinct"] / F.size(terms)).otherwise(0.0)
    delta = cover * BEARING_BONUS - penalty
    return F.round(F.when(bounded, F.least(F.lit(1.0), F.greatest(F.lit(0.0), score + delta))).otherwise(score + delta * UNBOUNDED), 4)


def grounded(score: Column, hits: Column, total: Column, scale: Column) -> Column:
    """A score by how many of the question's concepts a candidate covers; unchanged without concepts."""
    bounded = scale.isin("probability", "cosine") | ((score >= 0) & (score <= 1))
    cover = hits / total
    unit = lambda c: F.least(F.lit(1.0), F.greatest(F.lit(0.0), c))
    low = F.when(hits <= 0, F.greatest(F.lit(0.0), score * 0.30)).when(hits < total, unit(score * (0.62 + 0.18 * cover) + 0.04 * hits)).otherwise(unit(score * 1.04 + 0.12))
    high = F.when(hits <= 0, score - 1.25).when(hits < total, score - 0.65 * (1 - cover) + 0.10 * hits).otherwise(score + 0.75 + 0.10 * F.least(hits, F.lit(3)))
    return F.when(total <= 0, score).otherwise(F.round(F.when(bounded, low).otherwise(high), 4))


def grounding_note(concepts: Column, text: Column) -> Column:
    """struct(matched, matched_count, concept_count): concepts (arrays of aliases) of which some alias is in the text as whole words."""
    return F.transform(
        F.array(tx.padded(text)),
        lambda hay: F.transform(
            F.array(F.transform(F.filter(concepts, lambda c: F.exists(c, lambda a: F.contains(hay, tx.padded(a)))), lambda c: c[0])),
            lambda m: F.struct(m.alias("matched"), F.size(m).cast("long").alias("matched_count"), F.size(concepts).cast("long").alias("concept_count")),
        )[0],
    )[0]


def pool_relevance(df: DataFrame, query: str, score: str, order: str) -> DataFrame:
    """``relevance`` from score and rank: .90 of score / top + .10 of rank on a 0..1 scale, .82 of min-max
    + .18 of rank on another, rank alone where all scores are equal. Rank falls from 1 to 0."""
    w = Window.partitionBy(query)
    lo, hi, n = F.min(score).over(w), F.max(score).over(w), F.count("*").over(w)
    rank = 1 - (F.row_number().over(w.orderBy(F.desc(score), order)) - 1) / F.greatest(n - 1, F.lit(1))
    x = df.withColumn("_lo", lo).withColumn("_hi", hi).withColumn("_r", rank)
    unit = (F.col("_lo") >= 0) & (F.col("_hi") <= 1) & (F.col("_hi") > 0)
    rel_ = F.when(unit, 0.90 * F.col(score) / F.col("_hi") + 0.10 * F.col("_r")).when(F.col("_hi") - F.col("_lo") > 1e-9, 0.82 * (F.col(score) - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) + 0.18 * F.col("_r")).otherwise(F.col("_r"))
    return x.withColumn("relevance", F.round(rel_, 6)).drop("_lo", "_hi", "_r")


def passes_floor(df: DataFrame, query: str, score: str, order: str, floor: float, relaxed: Column) -> DataFrame:
    """Rows at or above the floor: score / top on a 0..1 scale, else ``relevance``; ``relaxed`` rows need .40 only, the first row nothing."""
    w = Window.partitionBy(query)
    x = pool_relevance(df, query, score, order).withColumn("_top", F.max(score).over(w)).withColumn("_low", F.min(score).over(w)).withColumn("_i", F.row_number().over(w.orderBy(F.desc(score), order)))
    bar = F.when(relaxed, F.least(F.lit(floor), F.lit(GROUNDED_FLOOR))).otherwise(floor)
    unit = (F.col(score) >= 0) & (F.col("_top") <= 1) & (F.col("_top") > 0)
    return x.where((F.col("_i") == 1) | (F.when(unit, F.col(score) / F.col("_top")).otherwise(F.col("relevance")) >= bar)).drop("_top", "_low", "_i")


def trim_tail(df: DataFrame, query: str, score: str, order: str) -> DataFrame:
    """Pools of bounded scores whose top is .5 or more, without rows under max(.05, .2 top); other pools as they are."""
    w = Window.partitionBy(query)
    x = df.withColumn("_top", F.max(score).over(w))
    mixed = F.col("_top") > 1.0001
    return x.where(mixed | (F.col("_top") < 0.5) | (F.col(score) >= F.greatest(F.lit(0.05), 0.2 * F.col("_top")))).drop("_top")


def first_cliff(df: DataFrame, query: str, score: str, order: str, cost: str, min_score: float, margin: float, gap: float, budget: int) -> DataFrame:
    """Rows down to the first gap of ``gap`` or more, above max(min_score, top - margin), then a walk that
    passes over (and does not stop at) what the token budget no longer holds."""
    w = Window.partitionBy(query)
    o = w.orderBy(F.desc(score), order)
    x = df.withColumn("_top", F.max(score).over(w)).where(F.col(score) >= F.greatest(F.lit(min_score), F.col("_top") - margin))
    x = x.withColumn("_i", F.row_number().over(o)).withColumn("_gap", F.round(F.col(score) - F.lead(score).over(o), 6))
    x = x.withColumn("_cut", F.min(F.when(F.col("_gap") >= gap, F.col("_i"))).over(w)).where("_cut is null or _i <= _cut").drop("_top", "_gap", "_cut")
    walk = x.groupBy(query).agg(F.array_sort(F.collect_list(F.struct("_i", F.col(cost).cast("long").alias("c"), F.struct(*[F.col(c) for c in df.columns if c != query]).alias("r")))).alias("rows"))
    start = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast("array<int>").alias("kept"))
    step = lambda a, r: F.when(a["used"] + r["c"] <= budget, F.struct((a["used"] + r["c"]).alias("used"), F.concat(a["kept"], F.array(r["_i"])).alias("kept"))).otherwise(a)
    kept = walk.withColumn("k", F.aggregate("rows", start, step)["kept"]).select(query, F.explode(F.filter("rows", lambda r: F.array_contains(F.col("k"), r["_i"]))).alias("x"))
    return kept.select(query, "x.r.*")


def mmr_policy(tier: str, need: str, k: int, corpora: int = 1) -> dict:
    """The diversity pass's parameters for a tier (vector, hybrid, graph) and a need (specific, balanced, broad)."""
    least, target, soft, hard, more = {"specific": (1, 2, 2, 4, 0.08), "broad": (3, 4, -(-k // 8), -(-k // 8), 0.0)}.get(need, (2, 3, 3, 4, 0.03))
    if corpora > 1:
        least, target = max(least, min(3, k)), max(target, min(4, k))
    base, floor = {"vector": (0.75, 0.90), "hybrid": (0.65, 0.85), "graph": (0.55, 0.80)}[tier]
    if need == "broad" and tier != "vector":
        floor = 0.35
    return {"lam": min(0.88, base + more), "floor": floor, "min_docs": min(least, k), "target_docs": min(target, k), "soft": max(1, soft), "hard": max(1, hard), "parents": 2, "predicates": 3 if tier == "graph" else None}


def _jaccard(a: frozenset, b: frozenset) -> float:
    return len(a & b) / len(a | b) if a and b else 0.0


def similarity(a: dict, b: dict, tier: str) -> float:
    """The greatest of the ways in which two candidates are alike, by tier."""
    ways = [0.92 * (a["parent"] is not None and a["parent"] == b["parent"]), 0.24 * (a["doc"] is not None and a["doc"] == b["doc"]), _jaccard(a["tokens"], b["tokens"])]
    if tier == "hybrid":
        ways.append(0.68 * _jaccard(a["atoms"], b["atoms"]))
    elif tier == "graph":
        ways += [w * _jaccard(a[f], b[f]) for f, w in (("atoms", 0.62), ("entities", 0.66), ("facts", 0.78), ("predicates", 0.58))]
    return max(ways)


_SETS = ("tokens", "atoms", "entities", "facts", "predicates", "retrievers")


class _Diversity:
    """One pool, best first; ``take`` fills seats by the objective."""

    def __init__(self, rows: list[dict], k: int, tier: str, need: str, corpora: int):
        self.rows, self.k, self.tier, self.need = rows, k, tier, need
        self.p = mmr_policy(tier, need, k, corpora)
        self.top = rows[0]["score"]
        self.unit = 0.0 <= self.top <= 1.0
        self.main = max(ABS_FLOOR, self.top * FLOOR_RATIO) if self.unit else 0.0
        self.chosen: list[int] = []

    def above(self, i: int, floor: float) -> bool:
        r = self.rows[i]
        if 0.0 <= r["score"] <= self.top <= 1.0 and self.top > 0:
            return r["score"] / self.top >= floor
        return r["relevance"] >= floor

    def relevant(self, i: int) -> bool:
        r, floor = self.rows[i], self.p["floor"]
        if (r["graph"] and r["grounded"] and (r["facts"] or r["predicates"])) or (r["anchor"] and r["grounded"]):
            floor = min(floor, GROUNDED_FLOOR)
        return i == 0 or self.above(i, floor)

    def value(self, i: int, relaxed: bool) -> float | None:
        r, p, seated = self.rows[i], self.p, [self.rows[j] for j in self.chosen]
        docs = [s["doc"] for s in seated if s["doc"] is not None]
        of_doc, of_parent = docs.count(r["doc"]), sum(s["parent"] == r["parent"] for s in seated if s["parent"] is not None)
        enough = len(seated) >= min(self.k, MIN_KEEP)
        if not self.relevant(i):
            trusted = r["grounded"] or not (r["anchor"] or r["graph"])
            if not (relaxed and self.tier != "vector" and not enough and self.above(i, FLOOR_RATIO) and trusted):
                return None
        weak = self.tier != "vector" and not r["graph"] and self.unit and r["score"] < self.main
        full = of_doc >= p["hard"] or of_parent >= p["parents"]
        same = [sum(q in s["predicates"] for s in seated) for q in r["predicates"]] if self.tier == "graph" else []
        if relaxed:
            if enough and (weak or full):
                return None
        elif weak or full or any(_jaccard(r["tokens"], s["tokens"]) >= NEAR for s in seated) or (same and max(same) >= p["predicates"]):
            return None
        distinct, seen = len(set(docs)), frozenset().union(*(s["atoms"] for s in seated))
        v = p["lam"] * r["relevance"] - (1 - p["lam"]) * max((similarity(r, s, self.tier) for s in seated), default=0.0)
        v += min(0.14, 0.035 * len(r["atoms"] - seen)) + min(0.08, 0.025 * max(0, len(r["retrievers"]) - 1)) + 0.32 * r["anchor"]
        if r["doc"] is not None and not of_doc:
            v += 0.10 if distinct < p["target_docs"] else 0.04
        if self.tier == "graph" and r["graph"]:
            v += 0.08 + 0.04 * bool(r["facts"]) + 0.03 * bool(r["predicates"])
        v -= 0.08 * (of_doc > 0 and distinct < p["min_docs"]) + 0.14 * max(0, of_doc - p["soft"] + 1) + 0.10 * of_parent + 0.04 * sum(same)
        return v

    def run(self) -> list[int]:
        while len(self.chosen) < min(self.k, len(self.rows)):
            best = None
            for relaxed in (False, True):
                for i in range(len(self.rows)):
                    if i not in self.chosen and (v := self.value(i, relaxed)) is not None and (best is None or v > best[0]):
                        best = v, i
                if best:
                    break
            if not best:
                break
            self.chosen.append(best[1])
        if self.need == "specific" and self.tier != "vector" and self.unit:
            bar = max(ABS_FLOOR, self.top * SPECIFIC_FLOOR)
            self.chosen = [i for i in self.chosen if self.rows[i]["score"] >= bar or self.relevant(i)]
        return self.chosen


def diversify(pool: DataFrame, query: str, item: str, score: str, k: int, tier: str, need: str, corpora: int = 1) -> DataFrame:
    """(query, item, seat): maximal marginal relevance under the policy of tier and need.

    ``pool`` may have the columns doc, parent, tokens, atoms, entities, facts, predicates, retrievers
    (arrays) and graph, anchor, grounded (booleans); what it lacks is empty or false. Each step
    seats the candidate of the greatest value in a strict pass, or else in a relaxed one; of equal
    values the better ranked (score, then item). Pools are bounded by the searches' k, so one
    query's pool is one task's list.
    """

    def pick(g: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for r in g.sort_values([score, item], ascending=[False, True]).to_dict("records"):
            sets = {c: frozenset(r.get(c) if r.get(c) is not None else ()) for c in _SETS}
            flags = {c: bool(r.get(c)) and not pd.isna(r.get(c)) for c in ("graph", "anchor", "grounded")}
            rows.append(sets | flags | {"item": r[item], "score": float(r[score]), "relevance": float(r["relevance"])} | {c: None if r.get(c) is None or pd.isna(r.get(c)) else r[c] for c in ("doc", "parent")})
        seats = _Diversity(rows, k, tier, need, corpora).run()
        return pd.DataFrame({query: [g[query].iloc[0]] * len(seats), item: [rows[i]["item"] for i in seats], "seat": range(1, len(seats) + 1)})

    x = pool_relevance(pool, query, score, item)
    kinds = f"`{query}` {pool.schema[query].dataType.simpleString()}, `{item}` {pool.schema[item].dataType.simpleString()}, seat long"
    return x.groupBy(query).applyInPandas(pick, kinds)


def reserve_lanes(ranked: DataFrame, preferred: DataFrame, query: str, item: str, score: str, lanes: str, required: list[str], k: int) -> DataFrame:
    """``preferred`` seats (query, item, seat) with the best row of each required lane that none of them serves.

    A lane's candidate must be supported (``lanes`` holds it) and score max(.05, .25 top) or more where
    scores are 0..1. A missing lane takes a free seat, else the last seat whose row serves no
    required lane. Lanes are served in the order given.
    """
    need = F.array(*map(F.lit, required))
    w = Window.partitionBy(query)
    x = ranked.withColumn("_top", F.max(score).over(w)).withColumn("_lo", F.min(score).over(w)).join(preferred.select(query, item, "seat"), [query, item], "left")
    fit = F.when((F.col("_lo") >= 0) & (F.col("_top") <= 1) & (F.col("_top") > 0), F.col(score) >= F.greatest(F.lit(0.05), 0.25 * F.col("_top"))).otherwise(True)
    x = x.withColumn("_lanes", F.array_intersect(lanes, need)).withColumn("_fit", fit)
    seated = F.array_distinct(F.flatten(F.collect_list(F.when(F.col("seat").isNotNull(), F.col("_lanes"))).over(w)))
    x = x.withColumn("_missing", F.array_except(need, seated))
    best = x.where("seat is null and _fit").select(query, item, score, "_missing", F.explode(F.array_intersect("_lanes", "_missing")).alias("_lane"))
    best = rel.top_per_key(best, [query, "_lane"], [F.desc(score), item], 1, "_r").drop("_r").groupBy(query, item).agg(F.min(F.array_position(need, F.col("_lane"))).alias("_turn"))
    best = rel.ranked(best, [query], ["_turn", item], "_turn")
    kept = x.where("seat is not null")
    n = kept.groupBy(query).agg(F.count("*").alias("_n"))
    spare = rel.ranked(kept.where(F.size("_lanes") == 0), [query], [F.desc("seat")], "_spare").select(query, item, "_spare")
    need_ = best.join(n, query, "left").withColumn("_n", F.coalesce("_n", F.lit(0))).withColumn("_over", F.greatest(F.lit(0), F.col("_n") + F.col("_turn") - k) - F.greatest(F.lit(0), F.col("_n") + F.col("_turn") - 1 - k))
    free = need_.where("_over = 0").select(query, item, (F.col("_n") + F.col("_turn")).alias("seat"))
    swaps = rel.ranked(need_.where("_over = 1"), [query], ["_turn"], "_spare").select(query, F.col(item).alias("_new"), "_spare")
    moved = kept.select(query, item, "seat").join(spare, [query, item], "left").join(swaps, [query, "_spare"], "left").select(query, F.coalesce("_new", item).alias(item), F.col("seat").cast("long").alias("seat"))
    return moved.unionByName(free)


def pack_packet(rows: DataFrame, query: str, item: str, rank: str, kind: str, full: str, summary: str, parent: str, score: str, budget: int, quota: float = 0.6, spill: float | None = None) -> DataFrame:
    """(query, item, form, used): a budgeted packet; ``used`` is the whole packet's tokens.

    ``kind`` says what a row is: anchor and parent rows walk by rank (full text if it fits, else the
    summary, else passed over), anchors first within ``quota`` of the budget and only with a score of
    ``spill`` or more, parents within all that is left. Then orphan rows whose ``parent`` is not in yet,
    then entity rows, take their full text if it fits. Then summaries are promoted to full texts in
    packet order where that fits, and note rows come last.
    """

    def walk(g: pd.DataFrame) -> pd.DataFrame:
        all_rows = g.sort_values([rank, item]).to_dict("records")
        of = lambda k: [r for r in all_rows if r[kind] == k]
        cost = lambda r, f: int(r[full if f == "full" else summary]) if not pd.isna(r[full if f == "full" else summary]) else None
        packet: list = []
        used = 0

        def ladder(some, limit, forms):
            nonlocal used
            spent = 0
            for r in some:
                for f in forms:
                    c = cost(r, f)
                    if c and spent + c <= limit:
                        packet.append([r, f])
                        spent += c
                        break
            used += spent

        ladder([r for r in of("anchor") if spill is None or r[score] >= spill], int(budget * quota), ("full", "summary"))
        ladder(of("parent"), budget - used, ("full", "summary"))
        inside = {r[item] for r, _ in packet}
        for r in of("orphan"):
            if r[parent] not in inside:
                before = len(packet)
                ladder([r], budget - used, ("full",))
                if len(packet) > before:
                    inside.add(r[parent])
        ladder(of("entity"), budget - used, ("full",))
        for entry in packet:
            r, f = entry
            c = cost(r, "full")
            if f == "summary" and c and used - cost(r, "summary") + c <= budget:
                used += c - cost(r, "summary")
                entry[1] = "full"
        ladder(of("note"), budget - used, ("full",))
        return pd.DataFrame({query: [g[query].iloc[0]] * len(packet), item: [r[item] for r, _ in packet], "form": [f for _, f in packet], "used": [used] * len(packet)})

    kinds = f"`{query}` {rows.schema[query].dataType.simpleString()}, `{item}` {rows.schema[item].dataType.simpleString()}, form string, used long"
    return rows.groupBy(query).applyInPandas(walk, kinds)
