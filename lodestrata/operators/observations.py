"""Observations: who does what to what in a clause, and under which qualifiers, with ids that stay the same."""

from __future__ import annotations

import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.batches import text_udf

# A list of our own: wordings of predicates and qualifiers for the tagger without a model.
PREDICATES = ("is", "are", "was", "were", "has", "have", "had", "uses", "used", "causes", "caused", "requires", "supports", "contains", "includes", "improves", "reduces", "est", "sont", "ist", "sind", "es", "son")
QUALIFIERS = {
    "negation": ("not", "no", "never", "without", "pas", "nicht"),
    "modality": ("may", "might", "could", "should", "must", "can"),
    "time": ("before", "after", "during", "until", "since", "when"),
    "condition": ("if", "unless", "only", "except"),
}
TAGS = "array<struct<kind:string,start:int,end:int,value:string>>"

_CLAUSE = re.compile(r"[^.!?;:,\n]+")
_NAME = re.compile(r"[^\W\d_a-zß-ÿ][\w'-]*(?:[ \t]+[^\W\d_a-zß-ÿ][\w'-]*)*")
_WORD = re.compile(r"[^\W\d_]+")


def regex_tagger(predicates=PREDICATES, qualifiers=QUALIFIERS) -> Callable[[pd.Series], pd.Series]:
    """Clauses between marks, names as runs of capitalised words, predicates and qualifiers by their wording."""
    cues = dict.fromkeys(predicates, "predicate") | {w: f"qualifier:{k}" for k, ws in qualifiers.items() for w in ws}

    def tag(text: str | None) -> list[dict]:
        out = [("clause", *m.span(), m[0].strip()) for m in _CLAUSE.finditer(text or "") if m[0].strip()]
        out += [("span", *m.span(), m[0]) for m in _NAME.finditer(text or "") if m[0].lower() not in cues]
        out += [(cues[m[0].lower()], *m.span(), m[0].lower()) for m in _WORD.finditer(text or "") if m[0].lower() in cues]
        return [dict(zip(("kind", "start", "end", "value"), x, strict=True)) for x in out]

    return lambda texts: texts.map(tag)


def observations(docs: DataFrame, id_col: str, text_col: str, version: str = "1", tagger: Callable[[pd.Series], pd.Series] | None = None) -> DataFrame:
    """(observation_id, id, clause_start, clause_end, subject, predicate, object, qualifiers): one row for each predicate of a clause.

    ``tagger`` marks clauses, spans, predicates and qualifiers with code points; a model may stand in.
    What begins within a clause belongs to it: an as-of join of tags with clauses by one window. The
    subject is the nearest span before the predicate, the object the nearest after it, in the same
    clause; one of them must be there. Qualifiers are those of the clause, kind and wording, in order.
    The id is a hash of version, document, places and values, so running again gives the same ids. A
    null or empty text has none; repeated documents give their rows each.
    """
    numbered = docs.select(F.monotonically_increasing_id().alias("_row"), F.col(id_col), text_udf(tagger or regex_tagger(), TAGS)(F.col(text_col)).alias("_t"))
    tagged = numbered.select("_row", id_col, F.inline("_t"))
    w = Window.partitionBy("_row").orderBy("start", (F.col("kind") != "clause").cast("int")).rowsBetween(Window.unboundedPreceding, 0)
    clause = F.last(F.when(F.col("kind") == "clause", F.struct("start", "end")), ignorenulls=True).over(w)
    inside = tagged.withColumn("_c", clause).where("kind <> 'clause' and start < _c.end")
    g = inside.groupBy("_row", id_col, "_c").agg(F.array_sort(F.collect_list(F.struct("start", "end", "kind", "value"))).alias("t"))  # the tags of one clause
    of = lambda kind: F.filter("t", lambda x: x["kind"] == kind)
    g = g.select("_row", id_col, "_c", of("span").alias("s"), F.transform(F.filter("t", lambda x: x["kind"].startswith("qualifier:")), lambda x: F.concat(F.substring_index(x["kind"], ":", -1), F.lit(":"), x["value"])).alias("qualifiers"), F.explode(of("predicate")).alias("p"))
    before = F.try_element_at(F.filter("s", lambda x: x["end"] <= F.col("p.start")), F.lit(-1))
    after = F.get(F.filter("s", lambda x: x["start"] >= F.col("p.end")), F.lit(0))
    x = g.select(id_col, F.col("_c.start").alias("clause_start"), F.col("_c.end").alias("clause_end"), before["value"].alias("subject"), F.col("p.value").alias("predicate"), after["value"].alias("object"), "qualifiers", F.col("p.start").alias("_at"))
    x = x.where("subject is not null or object is not null")
    key = F.concat_ws("|", F.lit(version), F.col(id_col).cast("string"), "clause_start", "clause_end", "_at", F.coalesce("subject", F.lit("")), "predicate", F.coalesce("object", F.lit("")))
    return x.select(F.substring(F.sha2(key, 256), 1, 32).alias("observation_id"), *[c for c in x.columns if c != "_at"])
