"""Deterministic extraction: abbreviations, table facts, citations, tolerant JSON, taxonomies, claims, packets."""

from __future__ import annotations

import json
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions import text as tx
from ..functions import web
from ..functions.batches import text_udf


def _script_tokens(texts: pd.Series) -> pd.Series:

    def script(c):
        if "一" <= c <= "鿿" or "぀" <= c <= "ヿ" or "가" <= c <= "힣":
            return "cjk"
        return "latin" if c.isascii() or unicodedata.name(c, "").startswith("LATIN") else "other"

    def one(t):
        out = []
        for run in re.findall(r"[^\W_]+", unicodedata.normalize("NFKC", t or "").lower()):
            start = 0
            for i in range(1, len(run) + 1):
                if i == len(run) or script(run[i]) != script(run[start]):
                    piece, kind = run[start:i], script(run[start])
                    if kind == "cjk":
                        out += [piece[j : j + 2] for j in range(max(1, len(piece) - 1))]
                    else:
                        out.append(unicodedata.normalize("NFD", piece).encode("ascii", "ignore").decode() if kind == "latin" else piece)
                    start = i
        return [x for x in out if x]

    return texts.map(one)


def script_tokens(texts: str | Column) -> Column:
    """Tokens of NFKC text, cut where the script changes; connectors split, Latin folded, CJK in bigrams."""
    return text_udf(_script_tokens, T.ArrayType(T.StringType()))(texts)


@F.pandas_udf(T.ArrayType(T.StringType()))
def split_long_lines(texts: pd.Series) -> pd.Series:
    """Lines; one of over 5000 characters is cut at the last blank or mark of each 2000-character window."""

    def one(t):
        out = []
        for line in (t or "").split("\n"):
            while len(line) > 5000:
                at = max(line.rfind(c, 0, 2000) for c in " ,;|.")
                at = at + 1 if at > 0 else 2000
                out.append(line[:at])
                line = line[at:]
            out.append(line)
        return out

    return texts.map(one)


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("short", T.StringType()), T.StructField("long", T.StringType())])))
def abbreviations(texts: pd.Series) -> pd.Series:
    """``long form (SF)`` and ``SF (long form)`` pairs: the letters of SF found from right to left in the words beside it (Schwartz, Hearst)."""

    def long_of(short, before):
        s, i = len(short) - 1, len(before) - 1
        while s >= 0:
            c = short[s].lower()
            while i >= 0 and (before[i].lower() != c or (s == 0 and i > 0 and before[i - 1].isalnum())):
                i -= 1
            if i < 0:
                return None
            s, i = s - 1, i - 1
        return before[i + 1 :].strip()

    def one(t):
        out = {}
        for m in re.finditer(r"\(([A-Z][A-Za-z0-9]{1,9})\)", t or ""):
            words = re.findall(r"\S+", t[max(0, m.start() - 200) : m.start()])
            most = min(len(m[1]) + 5, 2 * len(m[1]))
            found = long_of(m[1], " ".join(words[-most:]))
            if found and len(found) > len(m[1]):
                out.setdefault(m[1], found)
        for m in re.finditer(r"\b([A-Z][A-Za-z0-9-]{1,9})\s*\(([A-Za-z][^()]{2,60})\)", t or ""):
            rest = iter(reversed(m[2].lower()))
            if all(c in rest for c in reversed(m[1].lower()) if c.isalnum()) and len(m[2].strip()) > len(m[1]):
                out.setdefault(m[1], " ".join(m[2].split()))
        return [{"short": k, "long": v} for k, v in out.items()]

    return texts.map(one)


def table_facts(rows: DataFrame, keys: list[str], header: str, cells: str, cap: int = 24) -> DataFrame:
    """(keys, subject, property, value, quantity, unit): row label, column and cell; at most ``cap`` facts of each table."""
    f = rows.select(*keys, "row_no", F.get(cells, F.lit(0)).alias("subject"), F.posexplode(F.arrays_zip(F.col(header).alias("h"), F.col(cells).alias("c"))).alias("i", "x"))
    f = f.where("i > 0").select(*keys, "row_no", "i", "subject", F.trim("x.h").alias("property"), F.trim("x.c").alias("value")).where("coalesce(value, '') <> ''")
    q = r"^([-+]?[0-9]+(?:\.[0-9]+)?)\s*([A-Za-z%]*)$"
    f = f.withColumn("quantity", F.try_to_number(F.nullif(F.regexp_extract("value", q, 1), F.lit("")), F.lit("S999999999.999999")).cast("double")).withColumn("unit", F.nullif(F.regexp_extract("value", q, 2), F.lit("")))
    n = F.row_number().over(Window.partitionBy(*keys).orderBy("row_no", "i"))
    return f.withColumn("_n", n).where(F.col("_n") <= cap).drop("_n", "row_no", "i")


def citation(name: Column | str) -> Column:
    """struct(author, title, year) from file names like ``Author - Title (2001).pdf`` or ``2001 - Author - Title``."""
    n = F.regexp_replace(F.regexp_replace(tx.as_column(name), r"^.*/", ""), r"\.[A-Za-z0-9]{1,5}$", "")
    year = F.nullif(F.regexp_extract(n, r"\b(1[5-9][0-9]{2}|20[0-9]{2})\b", 1), F.lit(""))
    bare = F.trim(F.regexp_replace(F.regexp_replace(n, r"[(\[]?\b(1[5-9][0-9]{2}|20[0-9]{2})\b[)\]]?", ""), r"^[\s\-_]+|[\s\-_]+$", ""))
    parts = F.split(bare, r"\s+-\s+", 2)
    two = F.size(parts) > 1
    return F.struct(F.when(two, F.trim(parts[0])).alias("author"), F.trim(F.when(two, parts[1]).otherwise(bare)).alias("title"), year.cast("int").alias("year"))


@F.pandas_udf(T.StringType())
def tolerant_json(texts: pd.Series) -> pd.Series:
    """The first JSON object in a text (fences and prose around it dropped), with sorted keys; null if none parses."""

    def one(t):
        t = t or ""
        for start in (i for i, c in enumerate(t) if c == "{"):
            try:
                return json.dumps(json.JSONDecoder().raw_decode(t[start:])[0], sort_keys=True, ensure_ascii=False)
            except ValueError:
                continue
        return None

    return texts.map(one)


def resolve_taxonomy(df: DataFrame, id_col: str, text_col: str, taxonomy: list[tuple[str, str, int]], default: str = "general") -> DataFrame:
    """(id, domain): of (keyword, domain, priority) rules, the domain with the most hits, ties by priority, then name."""
    hay = F.concat(F.lit(" "), F.regexp_replace(F.lower(text_col), "[^a-z0-9]+", " "), F.lit(" "))
    domains = sorted({d for _, d, _ in taxonomy})
    scored = []
    for d in domains:
        words = [w for w, x, _ in taxonomy if x == d]
        hits = sum((F.when(F.contains(hay, F.lit(f" {w} ")), 1).otherwise(0) for w in words), F.lit(0))
        scored.append(F.struct((-hits).alias("n"), F.lit(min(p for _, x, p in taxonomy if x == d)).alias("p"), F.lit(d).alias("d")))
    best = F.array_min(F.array(*scored))
    return df.select(id_col, F.when(best["n"] < 0, best["d"]).otherwise(default).alias("domain"))


def claims(facts: DataFrame, subject: str, predicate: str, obj: str, evidence: str) -> DataFrame:
    """One row per (subject, predicate, object): signature, support, evidence ids, and whether a negated twin exists."""
    norm = lambda c: F.trim(F.regexp_replace(F.lower(c), r"\s+", " "))
    negated = F.col(predicate).rlike(r"(?i)\b(not|never|no)\b")
    base = F.trim(F.regexp_replace(norm(F.col(predicate)), r"\b(not|never|no)\b ?", ""))
    f = facts.select(norm(F.col(subject)).alias("s"), base.alias("p"), norm(F.col(obj)).alias("o"), negated.alias("negated"), F.col(evidence).alias("e"))
    c = f.groupBy("s", "p", "o", "negated").agg(F.countDistinct("e").alias("support"), F.min("e").alias("first_evidence"))
    twin = F.count("*").over(Window.partitionBy("s", "p", "o")) > 1
    return c.withColumn("signature", web.domain_hash("claim", F.col("s"), F.col("p"), F.col("o"), F.col("negated"))).withColumn("contested", twin)


def packets(units: DataFrame, key: str, order: str, body: str, most_bytes: int) -> DataFrame:
    """Consecutive units of each key in packets whose UTF-8 bytes start below multiples of the cap; one unit is never cut."""
    size = F.octet_length(body)
    before = F.sum(size).over(Window.partitionBy(key).orderBy(order)) - size
    return units.withColumn("packet", F.floor(before / most_bytes)).groupBy(key, "packet").agg(F.count("*").alias("units"), F.sum(size).alias("bytes"), F.min(order).alias("first"))


def eligible(text: Column | str, kind: Column | str, least: int = 40) -> Column:
    """Reason why a parent is not summarised, or null: blank, separator, noisy, short."""
    t = tx.as_column(text)
    return F.when(F.coalesce(F.trim(t), F.lit("")) == "", "blank").when(tx.is_separator_only(t), "separator").when(tx.is_noisy(kind), "noisy").when(tx.token_count(t) < least, "short")
