"""Rows that extraction yields beyond names: qualitative facts, refined predicates, assessed claims, payloads to filter by, document flags."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from . import relational as rel

# Maturity words and what they mean, kinds too general to be a category, cues of conditions and duties.
MATURITY = {"deprecated": "deprecated", "obsolete": "deprecated", "experimental": "experimental", "alpha": "experimental", "beta": "beta", "preview": "beta", "stable": "stable", "production-ready": "stable"}
GENERAL = ("way", "kind", "type", "sort", "form", "part", "thing", "set", "number", "lot", "case", "example")
CONDITIONS = ("if", "when", "unless", "provided that", "in case")
DUTIES = ("must", "shall", "should", "required to", "have to", "has to")


def qualitative_facts(df: DataFrame, id_col: str, text: str, entities: str) -> DataFrame:
    """(id, subject, kind, property, value, condition, sentence): status, category, rule and tag facts of texts.

    A sentence yields facts only where one of the ``entities`` (array of names) stands in it. Status and duties go to the
    nearest entity, a category (``X is a Y``) to the one before the cue, tags of a ``Tags:`` line to the first
    entity. Values are slices of the sentence. Equal facts of a document count once.
    """
    words = lambda some: "|".join(map(re.escape, sorted(some, key=len, reverse=True)))
    status = re.compile(rf"\b({words(MATURITY)})\b", re.I)
    category = re.compile(r"\b(?:is|are|was|were) (?:an?|the) ", re.I)
    cond, duty = re.compile(rf"\b({words(CONDITIONS)})\b ", re.I), re.compile(rf"\b({words(DUTIES)})\b ", re.I)
    tags = re.compile(r"^\s*(?:tags|keywords|topics)\s*:", re.I | re.M)
    clean = lambda s: " ".join(s.split())

    def facts(t, names):
        names = [clean(n) for n in (names if names is not None else ()) if n and n.strip()]
        out = []
        for s in re.split(r"(?<=[.!?])\s+|\n+", t or ""):
            s = clean(s)
            low = s.lower()
            at = sorted((low.find(n.lower()), n) for n in names if n.lower() in low)
            if not at:
                continue
            nearest = lambda i: min(at, key=lambda x: (abs(x[0] - i), x[0]))[1]
            clause = lambda i: re.split(r"[,;.!?]", s[i:], maxsplit=1)[0].strip()
            out += [(nearest(m.start()), "status", "maturity", MATURITY[m[1].lower()], "", s) for m in status.finditer(s)]
            for m in category.finditer(s):
                before = [n for i, n in at if i < m.start()]
                value = clause(m.end())
                if before and value and value.split()[0].lower() not in GENERAL:
                    out.append((before[-1], "category", "category", value, "", s))
            c, d = cond.search(s), duty.search(s)
            when = clause(c.end()) if c else ""
            if d and clause(d.end()):
                out.append((nearest(d.start()), "rule_action", "obligation", clause(d.end()), when, s))
            if when:
                out.append((nearest(c.start()), "rule_condition", "condition", when, "", s))
        for m in tags.finditer(t or "") if names else ():
            line = t[m.end() :].split("\n", 1)[0]
            out += [(names[0], "tag", "tags", clean(x).strip(" ."), "", clean(line)) for x in re.split("[,;]", line) if 0 < len(clean(x).strip(" .")) <= 60]
        seen = {}
        for f in out:
            seen.setdefault(tuple(x.lower() for x in f[:5]), f)
        return list(seen.values())

    def run(frames):
        for f in frames:
            rows = [(k, *x) for k, t, n in zip(f[id_col], f[text], f[entities], strict=True) for x in facts(t, n)]
            yield pd.DataFrame(rows, columns=[id_col, "subject", "kind", "property", "value", "condition", "sentence"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(id_col, text, entities).mapInPandas(run, f"`{id_col}` {kind}, subject string, kind string, property string, value string, condition string, sentence string")


def refine_predicates(relations: DataFrame, rules: DataFrame, cues: DataFrame) -> DataFrame:
    """Relations with ``refined`` and ``strength``: a general predicate becomes that of the first rule for its ends'
    families, or of the first cue word in its evidence; others stay.

    ``rules`` is (subject_family, object_family, predicate, priority), ``cues`` (word, predicate, priority). Strength is strong for a
    specific predicate stated as such with confidence .5 or more, repaired for a refined one, else weak.
    """
    r = relations.withColumn("_id", F.monotonically_increasing_id())
    general = F.col("predicate") == "related_to"
    by_rule = r.where(general).join(F.broadcast(rules), ["subject_family", "object_family"]).groupBy("_id").agg(F.min_by(rules["predicate"], F.col("priority")).alias("_rule"))  # a registry of rules
    hay = tx.padded("evidence")
    words = F.broadcast(cues.select(F.collect_list(F.struct("priority", "word", F.col("predicate").alias("p"))).alias("_c")))
    x = r.join(by_rule, "_id", "left").crossJoin(words)  # one row of cue words
    cue = F.get(F.array_sort(F.filter("_c", lambda c: F.contains(hay, F.concat(F.lit(" "), F.lower(c["word"]), F.lit(" "))))), F.lit(0))["p"]
    x = x.withColumn("refined", F.when(general, F.coalesce("_rule", cue, "predicate")).otherwise(F.col("predicate")))
    strength = F.when(~general & (F.coalesce("confidence", F.lit(0.0)) >= 0.5), "strong").when(general & (F.col("refined") != "related_to"), "repaired").otherwise("weak")
    return x.withColumn("strength", strength).drop("_id", "_rule", "_c")


def assess_claims(claims: DataFrame, observations: DataFrame) -> DataFrame:
    """Claims (claim, s, p, o, negated, parent, evidence, text) with ``issues``, a sorted list; nothing is dropped.

    unsupported: no observation of the same pair; contradicted: a claim of the same three that says the opposite;
    orphan: its parent claim is not there; cycle: it is its own parent; quote: the subject is not in its evidence text.
    """
    held = observations.select("s", "o", F.lit(True).alias("_held")).distinct()
    known = claims.select(F.col("claim").alias("parent"), F.lit(True).alias("_known")).distinct()
    sides = claims.groupBy("s", "p", "o").agg(F.countDistinct("negated").alias("_sides"))
    x = claims.join(held, ["s", "o"], "left").join(known, "parent", "left").join(sides, ["s", "p", "o"], "left")
    named = F.contains(tx.padded("text"), tx.padded("s"))
    flags = {
        "contradicted": F.col("_sides") > 1,
        "cycle": F.col("parent") == F.col("claim"),
        "orphan": F.col("parent").isNotNull() & F.col("_known").isNull(),
        "quote": ~F.coalesce(named, F.lit(False)),
        "unsupported": F.col("_held").isNull(),
    }
    return x.withColumn("issues", F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in flags.items()]))).select(*claims.columns, "issues")


def promote(entities: DataFrame, relations: DataFrame, facts: DataFrame, key: str) -> DataFrame:
    """(key, concepts, families, predicates, fact_types, related, has_relations): what a chunk's payload is filtered by.

    Values are lower-case, distinct and sorted; related are the ends of the chunk's own relations. A chunk's rows are
    few by the extraction's own bounds.
    """
    low = lambda c: F.trim(F.regexp_replace(F.lower(c), r"\s+", " "))
    sets = lambda c, name: F.array_sort(F.collect_set(F.when(c != "", c))).alias(name)
    e = entities.withColumn("_a", F.explode(F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>"))))).groupBy(key).agg(sets(low(F.col("_a")), "concepts"), sets(low(F.col("family")), "families"))
    r = relations.withColumn("_e", F.explode(F.array("subject", "object"))).groupBy(key).agg(sets(low(F.col("predicate")), "predicates"), sets(low(F.col("_e").cast("string")), "related"))
    f = facts.groupBy(key).agg(sets(low(F.col("kind")), "fact_types"))
    x = e.join(r, key, "full_outer").join(f, key, "full_outer")
    empty = F.array().cast("array<string>")
    return x.select(key, *[F.coalesce(c, empty).alias(c) for c in ("concepts", "families", "predicates", "fact_types", "related")], F.col("predicates").isNotNull().alias("has_relations"))


def document_flags(docs: DataFrame, id_col: str, name: str, facets: Column, types: Column) -> DataFrame:
    """(id, role, scopes): the part a source plays (primary, manual, review, log, notes) by its name and facets, and
    the models it may serve (people, places, methods) by the types of its entities. Hints only."""
    n = F.lower(F.coalesce(name, F.lit("")))
    has = lambda *f: F.coalesce(F.arrays_overlap(facets, F.array(*map(F.lit, f))), F.lit(False))
    role = F.when(n.rlike(r"(manual|guide|handbook|reference)") | has("procedure"), "manual").when(n.rlike(r"(review|survey|meta-?analysis)") | has("review"), "review").when(n.rlike(r"(log|transcript|chat)"), "log").when(n.rlike(r"(notes?|draft|journal)"), "notes").otherwise("primary")
    kinds = {"methods": ("Method", "Artifact", "Product"), "people": ("Person", "Organization"), "places": ("Location", "Event")}
    scopes = F.array_compact(F.array(*[F.when(F.coalesce(F.arrays_overlap(types, F.array(*map(F.lit, v))), F.lit(False)), F.lit(k)) for k, v in kinds.items()]))
    return docs.select(id_col, role.alias("role"), scopes.alias("scopes"))


def facet_lanes(pool: DataFrame, query: str, item: str, lane: str, doc: str, score: str, missing: list[str], k: int, per_lane: int, per_doc: int) -> DataFrame:
    """(query, item, seat, step): the final rows by facet lanes, in four steps of one order.

    First the best row of each missing lane, in the order given; then rows up to ``per_lane`` of a lane and ``per_doc`` of a
    document; then rows up to ``per_doc`` of a document; then the rest by score, k in all. Ties go to the smaller item.
    """
    w = lambda *by: rel.Window.partitionBy(query, *by).orderBy(F.desc(score), item)
    turn = F.array_position(F.array(*map(F.lit, missing)), F.col(lane)) if missing else F.lit(0)
    x = pool.withColumn("_l", F.row_number().over(w(lane))).withColumn("_d", F.row_number().over(w(doc)))
    step = F.when((turn > 0) & (F.col("_l") == 1), 1).when((F.col("_l") <= per_lane) & (F.col("_d") <= per_doc), 2).when(F.col("_d") <= per_doc, 3).otherwise(4)
    x = x.withColumn("step", step.cast("long")).withColumn("_t", F.when(F.col("step") == 1, turn).otherwise(0))
    return rel.top_per_key(x, [query], ["step", "_t", F.desc(score), item], k, "seat").select(query, item, "seat", "step")
