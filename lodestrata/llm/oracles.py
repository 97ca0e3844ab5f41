"""SQL that gives the rows of those queries that SQL can express."""

from __future__ import annotations

from . import license_scan, url_rules

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_REACH = "reach(node, c) AS (SELECT a, a FROM links UNION SELECT links.b, reach.c FROM reach JOIN links ON links.a = reach.node), comp AS (SELECT node, min(c) AS c FROM reach GROUP BY node)"

NGRAM_JACCARD = rf"""WITH RECURSIVE w AS MATERIALIZED (SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS MATERIALIZED (SELECT DISTINCT doc_id, g FROM (SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) END) AS g FROM w)),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
links AS MATERIALIZED (SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS shared FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY ALL) p JOIN n p1 ON p1.doc_id = a JOIN n p2 ON p2.doc_id = b WHERE 100 * shared >= 85 * (p1.n + p2.n - shared)),
{_REACH}
SELECT doc_id, coalesce(n, 0) AS n_shingles, coalesce(c, doc_id) AS component_id FROM documents LEFT JOIN n USING (doc_id) LEFT JOIN comp ON node = doc_id"""

VECTOR_NEAR_DUP = f"""WITH RECURSIVE e AS MATERIALIZED (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings),
links AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM e a JOIN e b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE list_dot_product(a.v, b.v) / (sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v))) >= 0.93),
{_REACH}
SELECT vec_id, coalesce(n, 0) AS n_links, coalesce(c, vec_id) AS component_id, coalesce(c, vec_id) = vec_id AS kept FROM e LEFT JOIN (SELECT a, count(*) AS n FROM links GROUP BY a) ON a = vec_id LEFT JOIN comp ON node = vec_id"""

_RULES = sorted(url_rules.SITE_RULES, key=lambda r: -len(r[1] + r[2]))
_FITS = [f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')" for _, h, p in _RULES]
_LIKE = [(c, g.replace("\\", r"\\").replace("_", r"\_").replace("%", r"\%").replace("*", "%").replace("?", "_")) for c, g in url_rules.JUNK_GLOBS]
_JUNK = "CASE " + " ".join(f"WHEN x LIKE '{g}' ESCAPE '\\' THEN '{c}'" for c, g in _LIKE) + " END"
_READ = _LOWER.format("path")
for _c in [c for c in range(0x21, 0x7F) if c != 0x25] + [0x25]:
    _READ = f"replace({_READ}, '%{_c:02x}', '{chr(_c).lower().replace(chr(39), chr(39) * 2)}')"
_KEPT = "list_reduce(list_transform(list_filter(string_split(read, '/'), lambda s: s NOT IN ('', '.')), lambda s: [s]), lambda a, s: CASE WHEN s[1] = '..' THEN a[1:len(a) - 1] ELSE list_concat(a, s) END, []::VARCHAR[])"
URL_FILTER = f"""SELECT page_id, host, path, CASE {' '.join(f"WHEN {f} THEN '{r[1] + r[2]}'" for f, r in zip(_FITS, _RULES, strict=True))} END AS rule,
CASE {' '.join(f"WHEN {f} THEN '{r[0]}'" for f, r in zip(_FITS, _RULES, strict=True))} WHEN category IS NOT NULL THEN 'block' ELSE 'allow' END AS verdict, category
FROM (SELECT *, {_JUNK} AS category FROM (SELECT *, array_to_string(list_concat([rtrim(regexp_replace(regexp_replace(host, '^.*@', ''), ':[0-9]*$', ''), '.')], {_KEPT}), '/') AS x FROM (SELECT *, {_READ} AS read
 FROM (SELECT page_id, {_LOWER.format("regexp_extract(rest, '^([^/?#]*)', 1)")} AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
 FROM (SELECT page_id, CASE WHEN contains(url, '://') THEN substring(url, position('://' IN url) + 3) ELSE '' END AS rest FROM pages)))))"""

_PHRASES = ", ".join(f"('{p}', '{label}')" for p, label in license_scan.PHRASES)
_TEMPLATES = ", ".join(f"({i}, '{t}', '{label}', {license_scan.block_of(t)})" for i, (t, label) in enumerate(license_scan.TEMPLATES))
_PAIRS = "list_distinct(list_transform(list_zip({0}, ({0})[2:], true), lambda z: z[1] || ' ' || z[2]))"
LICENSE_SCAN = rf"""WITH w AS MATERIALIZED (SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
p AS (SELECT doc_id, i - 1 AS i, label FROM (SELECT doc_id, w, phrase, label, unnest(range(1, len(w) + 1)) AS i FROM w, (VALUES {_PHRASES}) v(phrase, label)) WHERE array_to_string(w[i:i + len(string_split(phrase, ' ')) - 1], ' ') = phrase),
t AS MATERIALIZED (SELECT label, size, {_PAIRS.format("string_split(body, ' ')")} AS tokens FROM (VALUES {_TEMPLATES}) v(id, body, label, size)),
b AS (SELECT doc_id, size, {_PAIRS.format('w[s + 1:s + size]')} AS block FROM (SELECT doc_id, w, size, unnest(range(0, greatest(1, len(w) - size // 2), size // 2)) AS s FROM w, (SELECT DISTINCT size FROM t))),
f AS MATERIALIZED (SELECT doc_id, label, len(list_intersect(block, tokens)) / len(tokens) AS c FROM b JOIN t USING (size) WHERE len(list_intersect(block, tokens)) >= {license_scan.SHARE} * len(tokens) - 0.000000001)
SELECT doc_id, len(w)::BIGINT AS n_words, (SELECT count(*) FROM p WHERE p.doc_id = w.doc_id) AS n_base, (SELECT min(i) FROM p WHERE p.doc_id = w.doc_id) AS first_word, (SELECT max(i) FROM p WHERE p.doc_id = w.doc_id) AS last_word,
coalesce((SELECT string_agg(DISTINCT label, ',' ORDER BY label) FROM p WHERE p.doc_id = w.doc_id), '') AS base_labels,
coalesce((SELECT string_agg(DISTINCT label, ',' ORDER BY label) FROM (SELECT doc_id, label FROM p UNION ALL SELECT doc_id, label FROM f) u WHERE u.doc_id = w.doc_id), '') AS labels,
coalesce((SELECT max(c) FROM f WHERE f.doc_id = w.doc_id), 0) AS score FROM w"""

_WORDS = rf"regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
DECONTAMINATION = f"""WITH w AS MATERIALIZED (SELECT doc_id, {_WORDS} AS w FROM documents), b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
win AS MATERIALIZED (SELECT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS g FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS i FROM (SELECT *, least(10, len(w)) AS n FROM b WHERE len(w) > 0))),
hit AS MATERIALIZED (SELECT DISTINCT doc_id, i, n, item_id FROM (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS g FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM w, (SELECT DISTINCT n FROM win))) JOIN win USING (n, g)),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS id FROM hit) GROUP BY doc_id),
words AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS j FROM hit) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated FROM w LEFT JOIN items USING (doc_id) LEFT JOIN words USING (doc_id)"""

_CRC_TABLE = "(SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce(list_concat([i], range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) AS c FROM range(256) r(i)))"
_GRAMS = "SELECT id, n, unnest(CASE WHEN len(w) < n THEN [] ELSE list_transform(range(1, len(w) - n + 2), lambda i: array_to_string(w[i:i + n - 1], ' ')) END) AS g FROM {}, range(1, 4) r(n)"
_BYTES = "list_transform(range(octet_length(encode(g))), lambda i: ('0x' || substr(hex(encode(g)), 2 * i + 1, 2))::BIGINT)"
RESAMPLING = f"""WITH d AS MATERIALIZED (SELECT doc_id AS id, {_WORDS} AS w FROM documents), b AS (SELECT item_id AS id, {_WORDS} AS w FROM benchmark),
g AS MATERIALIZED (SELECT 0 AS side, id, g, count(*) AS k FROM ({_GRAMS.format('d')}) GROUP BY ALL UNION ALL SELECT 1, id, g, count(*) FROM ({_GRAMS.format('b')}) GROUP BY ALL),
c AS MATERIALIZED (SELECT g, xor(list_reduce(list_concat([4294967295], {_BYTES}), lambda s, x: xor(s // 256, t[xor(s % 256, x) + 1])), 4294967295) % 10000 AS bucket FROM (SELECT DISTINCT g FROM g), {_CRC_TABLE}),
n AS (SELECT bucket, coalesce(sum(k) FILTER (side = 0), 0)::DOUBLE AS s, coalesce(sum(k) FILTER (side = 1), 0)::DOUBLE AS t FROM g JOIN c USING (g) GROUP BY bucket),
gain AS MATERIALIZED (SELECT bucket, floor(1000 * ln((t + 1) * ((SELECT sum(s) FROM n) + 10000) / ((s + 1) * ((SELECT sum(t) FROM n) + 10000))))::BIGINT AS gain FROM n),
v AS (SELECT id, sum(k)::BIGINT AS n_features, sum(k * gain)::BIGINT AS weight FROM g JOIN c USING (g) JOIN gain USING (bucket) WHERE side = 0 GROUP BY id),
x AS MATERIALIZED (SELECT id AS doc_id, len(w) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight, coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('42:' || id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score FROM d LEFT JOIN v USING (id)),
o AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM x WHERE n_words >= 20)
SELECT x.doc_id, n_features, weight, score, CASE WHEN rank <= (SELECT count(*) FROM o) * 5 // 100 THEN rank END AS rank FROM x LEFT JOIN o USING (doc_id)"""

COLLOCATIONS = rf"""WITH p AS (SELECT coalesce(lang, 'und') AS lang, regexp_extract_all(unnest(regexp_split_to_array({_LOWER.format("coalesce(text, '')")}, '[.,;:!?\x0A-\x0D]')), '[^\x20\x09]+') AS w FROM documents),
f AS MATERIALIZED (SELECT lang, g, count(*) AS f FROM (SELECT lang, w[i:i + z - 1] AS g FROM (SELECT lang, w, z, unnest(range(1, len(w) - z + 2)) AS i FROM p, range(1, 5) r(z))) GROUP BY ALL HAVING count(*) >= 30),
n AS (SELECT lang, sum(len(w))::BIGINT AS n FROM p GROUP BY lang),
c AS MATERIALIZED (SELECT lang, g, f AS a, unnest(range(1, len(g))) AS k FROM f WHERE len(g) > 1),
s AS (SELECT c.lang, c.g, a, k, x.f AS l, y.f AS r, (2000000::HUGEINT * a // (x.f + y.f))::BIGINT AS score FROM c JOIN f x ON x.lang = c.lang AND x.g = c.g[:k] JOIN f y ON y.lang = c.lang AND y.g = c.g[k + 1:]),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, k) = 1),
o AS (SELECT lang, h[i:i + z - 1] AS g, max(f) AS f FROM (SELECT lang, g AS h, f, z, unnest(range(1, len(g) - z + 2)) AS i FROM f, range(2, 4) r(z) WHERE z < len(g)) GROUP BY ALL),
t AS (SELECT b.lang, array_to_string(b.g, ' ') AS phrase, a, l, r, score FROM b LEFT JOIN o ON o.lang = b.lang AND o.g = b.g WHERE o.f IS NULL OR 100 * o.f < 80 * a)
SELECT lang, rank, phrase, a, l, r, n, score FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM t) JOIN n USING (lang) WHERE rank <= 2000"""

ORACLES = {"op11_benchmark_decontamination": DECONTAMINATION, "op12_importance_resampling": RESAMPLING, "op13_phrase_collocations": COLLOCATIONS, "op2_ngram_jaccard": NGRAM_JACCARD, "op5_vector_near_dup": VECTOR_NEAR_DUP, "op6_license_scan": LICENSE_SCAN, "op8_url_filter": URL_FILTER}
