"""Queries for the lexicon. Observed names are part names in several spellings; links and definitions are made from them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import lexicon as lx
from .registry import Tables, query

OBSERVED = """(SELECT CASE p_partkey % 4 WHEN 0 THEN p_name WHEN 1 THEN upper(p_name) WHEN 2 THEN replace(p_name, ' ', '-') ELSE '  ' || p_name || ' part' END AS name, p_size AS support, (p_partkey % 10) / 10.0::DOUBLE AS confidence FROM part)"""
KEY = "trim(regexp_replace(lower({}), '[^a-z0-9]+', ' ', 'g'))"


def observed(t: Tables):
    k, n = F.col("p_partkey") % 4, F.col("p_name")
    name = F.when(k == 0, n).when(k == 1, F.upper(n)).when(k == 2, F.replace(n, F.lit(" "), F.lit("-"))).otherwise(F.concat(F.lit("  "), n, F.lit(" part")))
    return t.part.select(name.alias("name"), F.col("p_size").alias("support"), ((F.col("p_partkey") % 10) / 10.0).alias("confidence"))


def _links(t: Tables):
    """Both ways between a name and the name with ``part`` behind it."""
    a = t.part.select(lx.identity(F.col("p_name")).alias("source")).distinct().withColumn("target", F.concat("source", F.lit(" part"))).withColumn("surface", F.col("target"))
    return a.unionByName(a.select(F.col("target").alias("source"), F.col("source").alias("target"), F.col("source").alias("surface")))


def _separated(t: Tables):
    a = t.part.where("p_name like 's%'").select(lx.identity(F.col("p_name")).alias("a")).distinct()
    return a.withColumn("b", F.concat("a", F.lit(" part")))


def _definitions(t: Tables):
    return t.part.where("p_partkey % 9 = 0").select(F.col("p_name").alias("name"), F.concat(F.lit("a thing of "), F.col("p_type")).alias("text"), F.col("p_retailprice").alias("score"))


def entries(t: Tables):
    return lx.materialize(observed(t), _links(t), _separated(t), _definitions(t))


_K = KEY.format("name")
LEX = f"""n AS MATERIALIZED (SELECT key, name, sum(support) AS support, sum(support * confidence) AS mass FROM (SELECT {_K} AS key, trim(regexp_replace(name, '\\s+', ' ', 'g')) AS name, support, confidence FROM {OBSERVED}) GROUP BY ALL),
m AS MATERIALIZED (SELECT *, CASE WHEN NOT starts_with(key, 's') AND ends_with(key, ' part') AND left(key, length(key) - 5) IN (SELECT key FROM n) THEN left(key, length(key) - 5) ELSE key END AS entry FROM n),
o AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY entry ORDER BY (NOT regexp_full_match(name, '[A-Z][A-Z0-9]{{1,5}}'))::INT DESC, least(len(string_split(key, ' ')), 8) DESC, support DESC, lower(name) DESC, name DESC) AS r FROM m),
al AS (SELECT entry, string_agg(name, '|' ORDER BY support DESC, name) AS aliases FROM (SELECT *, row_number() OVER (PARTITION BY entry ORDER BY support DESC, name) AS q FROM o WHERE r > 1) WHERE q <= 8 GROUP BY entry),
df AS (SELECT entry, least(3, count(DISTINCT text)) AS definitions FROM (SELECT {KEY.format("p_name")} AS key, 'a thing of ' || p_type AS text FROM part WHERE p_partkey % 9 = 0) JOIN (SELECT DISTINCT key, entry FROM m) USING (key) GROUP BY entry),
ent AS MATERIALIZED (SELECT entry, max(CASE WHEN r = 1 THEN name END) AS canonical, coalesce(any_value(aliases), '') AS aliases, sum(support)::BIGINT AS support, round(sum(mass) / sum(support), 6) AS confidence, coalesce(any_value(definitions), 0)::BIGINT AS definitions FROM o LEFT JOIN al USING (entry) LEFT JOIN df USING (entry) GROUP BY entry)"""


@query(sql=f"WITH {LEX} SELECT * FROM ent")
def lexicon_entries(t):
    """Spellings folded into entries by identity, strong links and what separates them."""
    return entries(t)


def _aliases(t: Tables, e):
    return e.select("entry", F.explode(F.concat(F.array("canonical"), F.split("aliases", r"\|"))).alias("alias")).where("alias <> ''")


TERMS = "(SELECT DISTINCT trim(string_split(p_name, ' ')[1] || ' ' || string_split(p_name, ' ')[2]) AS term FROM part UNION SELECT DISTINCT p_name FROM part WHERE p_partkey % 50 = 0)"


@query(sql=f"""WITH {LEX}, a AS MATERIALIZED (SELECT DISTINCT entry, {KEY.format("alias")} AS key FROM (SELECT entry, unnest(list_concat([canonical], string_split(aliases, '|'))) AS alias FROM ent) WHERE alias <> ''), q AS MATERIALIZED (SELECT term, {KEY.format("term")} AS q FROM {TERMS}),
x AS (SELECT term, entry, min(tier) AS tier, max(raw) AS raw FROM (SELECT term, entry, 0 AS tier, 1.0::DOUBLE AS raw FROM q JOIN a ON q.q = a.key UNION ALL SELECT term, entry, 1, cm / (m + n - cm) FROM (SELECT term, entry, len(list_distinct(string_split(q, ' '))) AS m, len(list_distinct(string_split(key, ' '))) AS n, len(list_intersect(list_distinct(string_split(q, ' ')), string_split(key, ' '))) AS cm FROM q, a) WHERE cm > 0) GROUP BY ALL),
s AS (SELECT term, entry, tier, round(CASE WHEN tier = 0 THEN greatest(raw, 1.0) ELSE raw + (least(12e-2, 18e-3 * ln(1 + support)) + CASE WHEN definitions > 0 THEN 8e-2 ELSE 0 END + CASE WHEN aliases <> '' THEN 2e-2 ELSE 0 END) - CASE WHEN support <= 1 AND definitions = 0 THEN 12e-2 ELSE 0 END END, 6) AS score FROM x JOIN ent USING (entry))
SELECT term, entry, tier, score FROM (SELECT *, row_number() OVER (PARTITION BY term ORDER BY score DESC, entry) AS r FROM (SELECT *, max(score) OVER (PARTITION BY term) AS top FROM s) WHERE score >= greatest(55e-2, 75e-2 * top)) WHERE r <= 5""")
def lexicon_matches(t):
    """Entries that terms name, by alias or by shared words."""
    e = entries(t)
    words = F.split("p_name", " ")
    terms = t.part.select(F.trim(F.concat_ws(" ", words[0], words[1])).alias("term")).union(t.part.where("p_partkey % 50 = 0").select("p_name")).distinct()
    return lx.matches(terms, e, _aliases(t, e), 5)


@query(sql=f"""WITH {LEX}, h AS (SELECT entry, sha256(canonical || chr(31) || aliases || chr(31) || support) AS e FROM ent), p AS (SELECT entry, CASE WHEN support % 5 = 0 THEN 'old' ELSE sha256(canonical || chr(31) || aliases || chr(31) || support) END AS p FROM ent WHERE support % 7 > 0 UNION ALL SELECT 'gone ' || p_partkey, 'x' FROM part WHERE p_partkey < 5)
SELECT CASE WHEN p IS NULL THEN 'missing' WHEN e IS NULL THEN 'orphan' WHEN e = p THEN 'equal' ELSE 'differs' END AS state, count(*) AS n FROM h FULL JOIN p USING (entry) GROUP BY 1""")
def lexicon_parity(t):
    """Entries against their indexed copies."""
    e = entries(t)
    h = F.sha2(F.concat_ws("\x1f", "canonical", "aliases", F.col("support").cast("string")), 256)
    points = e.where("support % 7 > 0").select("entry", F.when(F.col("support") % 5 == 0, "old").otherwise(h).alias("content_hash"))
    gone = t.part.where("p_partkey < 5").select(F.concat(F.lit("gone "), F.col("p_partkey").cast("string")).alias("entry"), F.lit("x").alias("content_hash"))
    return lx.parity(e, points.unionByName(gone))
