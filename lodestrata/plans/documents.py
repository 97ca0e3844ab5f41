"""Chunking, trees and sections over the documents table."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import chunking
from .registry import query


@query()
def chunk_children(t):
    """Whole documents in parents and children by lines."""
    return chunking.chunks(t.documents, "doc_id", "text")


@query()
def chunk_idea(t):
    return chunking.chunks(t.documents, "doc_id", "text", policy="idea")


@query()
def chunk_hard(t):
    return chunking.chunks(t.documents, "doc_id", "text", policy="hard")


@query(sql="""WITH p AS (SELECT source AS doc, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS i, count(*) OVER (PARTITION BY source) AS n FROM documents),
r AS (SELECT doc, doc_id, ntile AS rollup FROM (SELECT doc, doc_id, i, n, ceil(n / 20)::BIGINT AS k, n // ceil(n / 20)::BIGINT AS big, n % ceil(n / 20)::BIGINT AS rest FROM p) q, LATERAL (SELECT CASE WHEN i < rest * (big + 1) THEN i // (big + 1) ELSE rest + (i - rest * (big + 1)) // big END AS ntile)),
l1 AS (SELECT doc, 'rollup' AS node_type, rollup AS node_no, count(*) AS children, min(doc_id) AS first, max(doc_id) AS last FROM r GROUP BY doc, rollup)
SELECT * FROM l1 UNION ALL SELECT doc, 'document', 0, count(*), min(first), max(last) FROM l1 GROUP BY doc""")
def summary_tree(t):
    return chunking.tree(t.documents.select(F.col("source").alias("doc"), "doc_id"), "doc", "doc_id")


@query(sql="""SELECT doc_id, group_no, min(i) AS row_start, max(i) AS row_end, 'Row | Line' || chr(10) || string_agg(line, chr(10) ORDER BY i) AS text FROM (
SELECT doc_id, i, line, ((sum(n) OVER (PARTITION BY doc_id ORDER BY i) - n) // 60)::BIGINT AS group_no FROM (SELECT doc_id, i::BIGINT AS i, l[i] AS line, len(string_split(trim(regexp_replace(l[i], '\\s+', ' ', 'g')), ' ')) AS n FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents), unnest(range(1, len(l) + 1)) u(i) WHERE contains(l[i], ' | '))) GROUP BY doc_id, group_no""")
def table_row_groups(t):
    lines = t.documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("p", "line")).where(F.contains("line", F.lit(" | "))).select("doc_id", (F.col("p") + 1).cast("long").alias("i"), "line", F.lit("Row | Line").alias("header"))
    return chunking.table_groups(lines, ["doc_id"], "i", "line", "header", 60)
