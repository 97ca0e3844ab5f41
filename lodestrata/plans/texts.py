"""Queries over documents, pages and conversations: scans, filters, scalar and table functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import dates, text, web
from ..operators import relational as rel
from ..operators import retrieval as ret
from .registry import query

STOP = "(" + ", ".join(f"'{w}'" for w in text.CONTENT_STOP_WORDS) + ")"
CONTENT = f"list_filter(list_transform(regexp_extract_all(lower(text), '[a-z][a-z0-9_''-]{{2,}}'), lambda w: regexp_replace(w, '^[''_-]+|[''_-]+$', '', 'g')), lambda w: w <> '' AND w NOT IN {STOP})"
SENT = "list_filter(list_transform(flatten(list_transform(list_filter(string_split(text, chr(10)), lambda x: NOT starts_with(ltrim(x), '#')), lambda x: string_split(regexp_replace(x, '([.!?])\\s+', '\\1␞', 'g'), '␞'))), lambda s: trim(s)), lambda s: s <> '')"


@query(sql=f"SELECT doc_id, len({CONTENT})::BIGINT AS n_words, len(list_distinct({CONTENT}))::BIGINT AS n_distinct FROM documents")
def content_word_counts(t):
    w = text.content_words("text")
    return t.documents.select("doc_id", F.size(w).cast("long").alias("n_words"), F.size(F.array_distinct(w)).cast("long").alias("n_distinct"))


@query(sql=f"SELECT term, count(*) AS n, count(DISTINCT doc_id) AS n_docs FROM (SELECT doc_id, unnest({CONTENT}) AS term FROM documents) GROUP BY term HAVING count(*) >= 5")
def term_frequency(t):
    terms = t.documents.select("doc_id", F.explode(text.content_words("text")).alias("term"))
    return terms.groupBy("term").agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("n_docs")).where("n >= 5")


@query(sql=f"SELECT doc_id, len({SENT})::BIGINT AS n_sentences, list_max(list_transform({SENT}, lambda s: length(s)))::BIGINT AS longest FROM documents")
def sentence_split(t):
    s = text.sentences("text")
    return t.documents.select("doc_id", F.size(s).cast("long").alias("n_sentences"), F.array_max(F.transform(s, F.length)).cast("long").alias("longest"))


@query(sql=f"""SELECT doc_id, string_agg(s, ' ' ORDER BY i) AS summary FROM (
  SELECT doc_id, s, i, sum(n) OVER (PARTITION BY doc_id ORDER BY i) AS upto FROM (
    SELECT doc_id, s[i] AS s, i, len(string_split(trim(regexp_replace(s[i], '\\s+', ' ', 'g')), ' ')) AS n
    FROM (SELECT doc_id, {SENT} AS s FROM documents), unnest(range(1, len(s) + 1)) u(i)))
WHERE i <= 8 AND (upto <= 120 OR i = 1) GROUP BY doc_id""")
def extractive_summary(t):
    """The first sentences, eight at most, that together keep to 120 words."""
    s = t.documents.select("doc_id", F.posexplode(text.sentences("text")).alias("i", "s"))
    s = s.withColumn("upto", F.sum(text.token_count("s")).over(rel.Window.partitionBy("doc_id").orderBy("i"))).where("i < 8 and (upto <= 120 or i = 0)")
    picked = F.array_sort(F.collect_list(F.struct("i", "s")))
    return s.groupBy("doc_id").agg(F.array_join(F.transform(picked, lambda x: x["s"]), " ").alias("summary"))


@query(sql="SELECT doc_id, (trim(text) = '' OR regexp_full_match(text, '[\\s|\\-:+_=*~.–—─━]*')) AS separator_only FROM documents")
def separator_only(t):
    return t.documents.select("doc_id", text.is_separator_only("text").alias("separator_only"))


@query(sql="SELECT doc_id, string_agg(line, chr(10) ORDER BY i) AS table_text FROM (SELECT doc_id, i, l[i] AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents), unnest(range(1, len(l) + 1)) u(i)) WHERE contains(line, ' | ') GROUP BY doc_id")
def table_lines(t):
    lines = t.documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "line")).where(F.contains("line", F.lit(" | ")))
    return lines.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "line"))), lambda x: x["line"]), "\n").alias("table_text"))


@query(sql="""SELECT doc_id, i::BIGINT AS line_no, (len(cells))::BIGINT AS n_cells, 'Row ' || i || ': ' || array_to_string(list_transform(cells, lambda c, k: 'c' || k || '=' || trim(c)), '; ') AS row_text
FROM (SELECT doc_id, i, string_split(l[i], ' | ') AS cells FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents), unnest(range(1, len(l) + 1)) u(i) WHERE contains(l[i], ' | '))""")
def table_linearize(t):
    """Rows of delimited lines as ``Row N: c1=v1; c2=v2``."""
    lines = t.documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "line")).where(F.contains("line", F.lit(" | ")))
    cells = F.split("line", " \\| ")
    named = F.transform(cells, lambda c, k: F.concat(F.lit("c"), (k + 1).cast("string"), F.lit("="), F.trim(c)))
    return lines.select("doc_id", (F.col("i") + 1).cast("long").alias("line_no"), F.size(cells).cast("long").alias("n_cells"), F.concat(F.lit("Row "), F.col("i") + 1, F.lit(": "), F.array_join(named, "; ")).alias("row_text"))


@query(sql="""WITH l AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '') AS l FROM documents)
SELECT doc_id, CASE WHEN len(l) = 0 THEN 'body' WHEN len(list_filter(l, lambda x: regexp_matches(x, '\\.{3,}\\s*[0-9]+\\s*$'))) / len(l) >= 0.4 THEN 'toc'
 WHEN len(list_filter(l, lambda x: regexp_matches(x, '^\\s*\\[[0-9]+\\]|\\([12][0-9]{3}\\)'))) / len(l) >= 0.5 THEN 'bibliography'
 WHEN len(list_filter(l, lambda x: regexp_matches(x, 'https?://'))) / len(l) >= 0.6 THEN 'links'
 WHEN len(list_filter(l, lambda x: regexp_matches(x, '\\|.*\\|'))) / len(l) >= 0.6 THEN 'table' ELSE 'body' END AS kind FROM l""")
def content_kind(t):
    return t.documents.select("doc_id", text.content_kind("text").alias("kind"))


@query(sql="""SELECT page_id, lower(regexp_extract(u, '^([a-zA-Z]+://[^/?]*)', 1)) || regexp_replace(regexp_replace(regexp_extract(u, '^([^?]*)', 1), '^[a-zA-Z]+://[^/]*', ''), '/+$', '')
 || CASE WHEN q = '' THEN '' ELSE '?' || q END AS canonical, lower(regexp_extract(u, '^[a-zA-Z]+://([^/?#]*)', 1)) AS host
FROM (SELECT page_id, u, array_to_string(list_sort(list_filter(string_split(regexp_extract(u, '\\?(.*)$', 1), '&'), lambda p: p <> '' AND NOT starts_with(p, 'utm_') AND regexp_extract(p, '^([^=]*)', 1) NOT IN ('fbclid', 'gclid', 'mc_cid', 'mc_eid', 'ref', 'ref_src', 'igshid'))), '&') AS q
 FROM (SELECT page_id, regexp_replace(trim(url), '#.*$', '') AS u FROM pages))""")
def url_canonical(t):
    return t.pages.select("page_id", web.canonical_url("url").alias("canonical"), web.host("url").alias("host"))


@query(sql="SELECT host, count(*) AS n, count(DISTINCT page_id) AS n_pages FROM (SELECT page_id, lower(regexp_extract(url, '^[a-zA-Z]+://([^/?#]*)', 1)) AS host FROM pages) GROUP BY host")
def pages_by_host(t):
    return t.pages.groupBy(web.host("url").alias("host")).agg(F.count("*").alias("n"), F.countDistinct("page_id").alias("n_pages"))


_H = "html"
for _p, _r in (("(?is)<(nav|header|footer|aside)\\b.*?</(nav|header|footer|aside)>", " "), *text.SCRUB):
    _H = f"regexp_replace({_H}, '{_p}', '{_r.replace('$', chr(92))}', 'g')"


@query(sql=f"SELECT page_id, trim(regexp_replace(trim(regexp_replace(regexp_replace({_H}, ' *\\n *', chr(10), 'g'), '\\n{{2,}}', chr(10), 'g')), '\\s+', ' ', 'g')) AS main_text FROM pages")
def html_main_text(t):
    return t.pages.select("page_id", web.html_text("html").alias("main_text"))


@query(sql=f"SELECT c_custkey, regexp_replace(regexp_replace(lower(trim(c_name)), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') AS snake, regexp_replace(regexp_replace(lower(trim(c_name)), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug, regexp_replace(lower(c_name), '[\\s_\\-]+', '', 'g') AS squash FROM customer")
def name_normal_forms(t):
    return t.customer.select("c_custkey", text.snake("c_name").alias("snake"), text.slug("c_name").alias("slug"), text.squash("c_name").alias("squash"))


@query(sql="SELECT p_partkey, array_to_string(list_sort(list_distinct(list_filter([replace(n, ' ', '_'), replace(n, ' ', '-'), replace(n, '-', ' '), replace(n, '_', ' ')], lambda x: x <> n))), '|') AS aliases FROM (SELECT p_partkey, lower(trim(regexp_replace(p_name, '\\s+', ' ', 'g'))) AS n FROM part)")
def alias_variants(t):
    return t.part.select("p_partkey", F.array_join(text.alias_variants("p_name"), "|").alias("aliases"))


@query(sql="SELECT doc_id, sha256('doc' || chr(31) || source || chr(31) || doc_id || chr(31) || sha256(text)) AS version_id FROM documents")
def deterministic_ids(t):
    return t.documents.select("doc_id", web.domain_hash("doc", F.col("source"), F.col("doc_id"), F.sha2("text", 256)).alias("version_id"))


@query(sql="SELECT event_id, '{\"event\":\"' || event_type || '\",\"k\":\"' || json_extract_string(props, '$.k') || '\"}' AS canonical FROM events")
def canonical_json(t):
    m = F.create_map(F.lit("k"), F.get_json_object("props", "$.k"), F.lit("event"), F.col("event_type"))
    return t.events.select("event_id", web.canonical_json(m).alias("canonical"))


@query(sql="SELECT event_id, json_extract(props, '$.k')::BIGINT AS k, (json_extract(props, '$.k')::BIGINT) % 7 AS bucket FROM events")
def json_fields(t):
    k = F.from_json("props", "k long")["k"]
    return t.events.select("event_id", k.alias("k"), (k % 7).alias("bucket"))


@query()
def date_parse(t):
    """Dates of several forms with their precision; the forms are made from order dates."""
    d = F.col("o_orderdate")
    forms = F.array(F.date_format(d, "yyyy-MM-dd"), F.date_format(d, "d MMMM yyyy"), F.date_format(d, "MMMM d, yyyy"), F.date_format(d, "MMMM yyyy"), F.date_format(d, "yyyy-MM"), F.date_format(d, "yyyy"), F.lit("soon"))
    raw = F.get(forms, (F.col("o_orderkey") % 7).cast("int"))
    return t.orders.select("o_orderkey", raw.alias("raw"), dates.parse_date(raw).alias("d")).select("o_orderkey", "raw", "d.date", "d.precision")


@query(sql="""SELECT item_id, array_to_string(list_distinct_ordered, ' ') AS terms FROM (SELECT item_id, list(w ORDER BY i) AS list_distinct_ordered FROM (
 SELECT item_id, w, min(i) AS i FROM (SELECT item_id, unnest(l) AS w, unnest(range(1, len(l) + 1)) AS i FROM (SELECT item_id, regexp_extract_all(lower(text), '[a-z][a-z0-9]*') AS l FROM benchmark))
 WHERE w NOT IN (""" + ", ".join(f"'{w}'" for w in text.QUERY_STOP_WORDS) + """) GROUP BY item_id, w) GROUP BY item_id)""")
def query_terms(t):
    return t.benchmark.select("item_id", F.array_join(text.query_terms("text"), " ").alias("terms"))


@query()
def query_ngrams(t):
    return t.benchmark.select("item_id", F.array_join(text.ngram_terms(text.words("text")), "|").alias("grams"))


_TERMS = "(SELECT DISTINCT item_id, unnest(regexp_extract_all(lower(text), '[a-z][a-z0-9]*')) AS term FROM benchmark)"
_QSTOP = "(" + ", ".join(f"'{w}'" for w in text.QUERY_STOP_WORDS) + ")"


@query(sql=f"SELECT item_id, term, list_reduce(list_transform(range(1, length(term) + 1), lambda i: ascii(substr(term, i, 1))::UBIGINT), lambda a, c: (xor(a, c) * 16777619) & 4294967295, 2166136261::UBIGINT)::BIGINT & 2147483647 AS token_id FROM {_TERMS} WHERE term NOT IN {_QSTOP}")
def sparse_token_ids(t):
    w = t.benchmark.select("item_id", F.explode(text.query_terms("text")).alias("term"))
    return w.select("item_id", "term", text.fnv1a31("term").alias("token_id"))


@query(sql="SELECT conv_id, turn, CASE WHEN regexp_matches(x, ' (list|enumerate|all the|which ones) ') THEN 'enumeration' WHEN regexp_matches(x, ' (compare|versus|vs|difference between) ') THEN 'comparison' WHEN regexp_matches(x, ' (what is|what are|define|meaning of) ') THEN 'definition' WHEN regexp_matches(x, ' (how to|how do|steps) ') THEN 'procedure' ELSE 'lookup' END AS intent FROM (SELECT conv_id, turn, ' ' || lower(text) || ' ' AS x FROM conversations)")
def query_intent(t):
    return t.conversations.select("conv_id", "turn", text.intent("text").alias("intent"))


@query(sql="SELECT conv_id, count(*) AS n_children, max_by(text, turn) AS last_text, max_by(role, turn) AS last_role FROM conversations GROUP BY conv_id")
def conversation_last_message(t):
    c = t.conversations
    return rel.lateral_latest(c.select("conv_id").distinct(), c, "conv_id", "turn", ["text", "role"])


@query(sql="""SELECT conv_id, turn, n_tokens FROM (SELECT *, sum(n_tokens) OVER (PARTITION BY conv_id ORDER BY turn DESC) AS s, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r
 FROM (SELECT conv_id, turn, len(string_split(trim(regexp_replace(text, '\\s+', ' ', 'g')), ' '))::BIGINT AS n_tokens FROM conversations WHERE trim(text) <> '')) WHERE s <= 60 OR r = 1""")
def conversation_trim(t):
    c = t.conversations.where(F.trim("text") != "").select("conv_id", "turn", text.token_count("text").alias("n_tokens"))
    return rel.suffix_within_budget(c, "conv_id", "turn", "n_tokens", 60)


@query(sql="SELECT conv_id, g AS run, min(turn) AS first_turn, count(*) AS n FROM (SELECT *, sum(CASE WHEN long IS DISTINCT FROM prev OR rn = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn)::BIGINT AS g FROM (SELECT *, lag(long) OVER (PARTITION BY conv_id ORDER BY turn) AS prev, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rn FROM (SELECT conv_id, turn, length(text) > 200 AS long FROM conversations))) GROUP BY conv_id, g")
def consecutive_groups(t):
    """Runs of turns that are alike in being long or short."""
    c = t.conversations.withColumn("long", F.length("text") > 200)
    prev = F.lag("long").over(rel.Window.partitionBy("conv_id").orderBy("turn"))
    g = rel.islands(c, ["conv_id"], "turn", F.col("long") != prev, "run")
    return g.groupBy("conv_id", "run").agg(F.min("turn").alias("first_turn"), F.count("*").alias("n"))


@query(sql="SELECT doc_id, w, count(*) AS n FROM (SELECT doc_id, ntile(4) OVER (PARTITION BY source ORDER BY doc_id)::BIGINT AS w FROM documents) GROUP BY doc_id, w")
def ntile_windows(t):
    w = F.ntile(4).over(rel.Window.partitionBy("source").orderBy("doc_id")).cast("long")
    return t.documents.select("doc_id", w.alias("w")).groupBy("doc_id", "w").agg(F.count("*").alias("n"))


@query(sql=f"SELECT doc_id, i::BIGINT AS i, fact_value, unit FROM (SELECT doc_id, i, regexp_extract(s[i], '([0-9]+(?:\\.[0-9]+)?)\\s*(%|percent|ms|kg|km|mb|gb)', 1) AS fact_value, regexp_extract(s[i], '([0-9]+(?:\\.[0-9]+)?)\\s*(%|percent|ms|kg|km|mb|gb)', 2) AS unit FROM (SELECT doc_id, {SENT} AS s FROM documents), unnest(range(1, len(s) + 1)) u(i)) WHERE fact_value <> ''")
def fact_quantities(t):
    """Numbers with a unit, by sentence."""
    p = r"([0-9]+(?:\.[0-9]+)?)\s*(%|percent|ms|kg|km|mb|gb)"
    s = t.documents.select("doc_id", F.posexplode(text.sentences("text")).alias("i", "s"))
    out = s.select("doc_id", (F.col("i") + 1).cast("long").alias("i"), F.regexp_extract("s", p, 1).alias("fact_value"), F.regexp_extract("s", p, 2).alias("unit"))
    return out.where("fact_value <> ''")


@query(sql="SELECT i.item_id, d.doc_id, d.text = i.text AS equal FROM (SELECT item_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS text FROM benchmark) i JOIN (SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS text FROM documents) d ON i.text <> '' AND contains(d.text, i.text)")
def contamination(t):
    """Documents that hold a benchmark passage, white space aside.

    Candidates share the passage's first eight words in a row, found by an equi-join on their
    hash without the first and last of them; containment is then checked. A passage of one or
    two words may lie within words: such passages are held against all documents in blocks. An
    empty passage is in no document.
    """
    flat = lambda c: F.trim(F.regexp_replace(c, r"\s+", " "))
    items = t.benchmark.select("item_id", flat("text").alias("passage"))
    items = items.where("passage <> ''").withColumn("n", F.least(F.size(F.split("passage", " ")), F.lit(8)))
    short = items.where("n < 3").select("item_id", "passage")
    head = F.array_join(F.slice(F.split("passage", " "), 2, F.greatest(F.col("n") - 2, F.lit(1))), " ")
    items = items.where("n >= 3").withColumn("key", F.xxhash64(head, "n"))
    sizes = [r[0] for r in items.select("n").distinct().collect()]  # at most six values
    docs = t.documents.select("doc_id", flat("text").alias("body"))

    def grams_of(n):
        size = max(n - 2, 1)

        def of(w):
            made = F.transform(F.sequence(F.lit(1), F.greatest(F.size(w) - size + 1, F.lit(1))), lambda i: F.xxhash64(F.array_join(F.slice(w, i, size), " "), F.lit(n)))
            return F.when(F.size(w) >= size, made)

        return F.transform(F.array(F.split("body", " ")), of)[0]  # bound once

    keys = [grams_of(n) for n in sizes]
    none = F.array().cast("array<bigint>")
    grams = docs.select("doc_id", F.explode(F.array_distinct(F.concat(none, *[F.coalesce(k, none) for k in keys]))).alias("key"))
    hits = grams.join(items.select("item_id", "key"), "key").select("doc_id", "item_id").distinct()
    found = hits.join(docs, "doc_id").join(items, "item_id").where(F.contains("body", F.col("passage"))).select("item_id", "doc_id", "body", "passage")
    within = ret.in_blocks(short, "item_id", lambda block: docs.join(F.broadcast(block), F.contains("body", F.col("passage"))).select("item_id", "doc_id", "body", "passage"))
    return found.union(within).select("item_id", "doc_id", (F.col("body") == F.col("passage")).alias("equal"))
