"""Parents and children from section text: paragraph, sentence and hard splits, packing, coalescing, table groups."""

from __future__ import annotations

import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import batches

# Chunk budgets in tokens.
PARENT_TARGET, PARENT_MIN, PARENT_MAX, CHILD_TARGET, FRAGMENT_FLOOR = 1200, 400, 1800, 128, 24


def count_tokens(text: str) -> int:
    return len(text.split())


def hard_split(text: str, most: int, count: Callable[[str], int] = count_tokens) -> list[str]:
    """Pieces of at most ``most`` tokens, cut between words."""
    words, out = text.split(" "), []
    while words:
        n, size = 0, 0
        while n < len(words) and (size := size + max(1, count(words[n]))) <= most:
            n += 1
        n = max(n, 1)
        out.append(" ".join(words[:n]))
        words = words[n:]
    return [p for p in out if p.strip()]


def sentence_pieces(text: str) -> list[str]:
    return [s for s in re.split(r"(?<=[.!?])\s+", text) if s.strip()]


def pack(units: list[str], target: int, most: int, join: str = " ", overlap: int = 0, count: Callable[[str], int] = count_tokens) -> list[str]:
    """Units in order, joined until the target; a unit over ``most`` is cut into sentences, then hard.

    With ``overlap`` the last units of a piece, up to that many tokens, begin the next.
    """
    out, cur, size, fresh = [], [], 0, False
    for u in units:
        n = count(u)
        if n > most:
            if fresh:
                out.append(join.join(cur))
            cur, size, fresh = [], 0, False
            parts = sentence_pieces(u)
            out += pack(parts, target, most, " ", overlap, count) if len(parts) > 1 else hard_split(u, target, count)
            continue
        if cur and size + n > target:
            out.append(join.join(cur))
            tail, kept = [], 0
            while cur and overlap and kept + count(cur[-1]) <= overlap:
                kept += count(cur[-1])
                tail.insert(0, cur.pop())
            cur, size, fresh = tail, kept, False
        cur.append(u)
        size += n
        fresh = True
    if fresh:
        out.append(join.join(cur))
    return out


def coalesce_small(pieces: list[str], least: int, most: int, join: str = "\n", count: Callable[[str], int] = count_tokens) -> list[str]:
    """Pieces under ``least`` go to the one before, else the one after, while the sum keeps to ``most``."""
    out: list[str] = []
    for p in pieces:
        if out and (count(p) < least or count(out[-1]) < least) and count(out[-1]) + count(p) <= most:
            out[-1] = out[-1] + join + p
        else:
            out.append(p)
    return out


def chunk_text(text: str, separator: str = "\n", target: int = CHILD_TARGET, policy: str = "boundary") -> list[str]:
    """boundary: paragraphs packed to the target; idea: one piece a paragraph, fragments coalesced; hard: token cuts."""
    paragraphs = [p for p in text.split(separator) if p.strip()]
    if policy == "hard":
        return hard_split(text, target)
    if policy == "idea":
        return coalesce_small([x for p in paragraphs for x in pack([p], target, target * 3 // 2)], FRAGMENT_FLOOR, target, separator)
    return pack(paragraphs, target, target * 3 // 2, separator)


def chunks(df: DataFrame, id_col: str, text_col: str, separator: str = "\n", parent: int = PARENT_TARGET, child: int = CHILD_TARGET, policy: str = "boundary") -> DataFrame:
    """(id, parent_no, child_no, text, tokens): children within parents, in order; null and blank texts give none."""
    kind = df.schema[id_col].dataType.simpleString()

    def run(frames):
        for f in frames:
            rows = []
            for key, text in zip(f[id_col], f[text_col], strict=True):
                for i, p in enumerate(chunk_text(text or "", separator, parent)):
                    rows += [(key, i, j, c, count_tokens(c)) for j, c in enumerate(chunk_text(p, separator, child, policy))]
            yield pd.DataFrame(rows, columns=[id_col, "parent_no", "child_no", "text", "tokens"])

    return df.select(id_col, text_col).mapInPandas(run, f"`{id_col}` {kind}, parent_no long, child_no long, text string, tokens long")


def table_groups(lines: DataFrame, keys: list[str], order: str, row: str, header: str, target: int) -> DataFrame:
    """Rows of a table in groups of about ``target`` tokens, each under the header: first and last row, and text."""
    from pyspark.sql.window import Window

    n = F.size(F.split(F.trim(F.col(row)), r"\s+"))
    before = F.sum(n).over(Window.partitionBy(*keys).orderBy(order)) - n
    g = lines.withColumn("group_no", F.floor(before / target)).groupBy(*keys, "group_no").agg(F.min(order).alias("row_start"), F.max(order).alias("row_end"), F.first(header).alias("_h"), F.array_sort(F.collect_list(F.struct(order, row))).alias("_r"))
    return g.select(*keys, "group_no", "row_start", "row_end", F.concat_ws("\n", "_h", F.array_join(F.transform("_r", lambda x: x[row]), "\n")).alias("text"))


def tree(parents: DataFrame, doc: str, parent: str, width: int = 20) -> DataFrame:
    """Summary tree: parents, near-equal rollups of at most ``width`` parents (the first ones larger), and a document node."""
    from pyspark.sql.window import Window

    w = Window.partitionBy(doc).orderBy(parent)
    n = F.count("*").over(Window.partitionBy(doc))
    k = F.ceil(n / width)
    i = F.row_number().over(w) - 1
    big, rest = F.floor(n / k), n % k
    roll = F.when(i < rest * (big + 1), F.floor(i / (big + 1))).otherwise(rest + F.floor((i - rest * (big + 1)) / big))
    x = parents.withColumn("rollup", roll.cast("long"))
    level1 = x.groupBy(doc, "rollup").agg(F.count("*").alias("children"), F.min(parent).alias("first"), F.max(parent).alias("last")).select(doc, F.lit("rollup").alias("node_type"), F.col("rollup").alias("node_no"), "children", "first", "last")
    level0 = level1.groupBy(doc).agg(F.count("*").alias("children"), F.min("first").alias("first"), F.max("last").alias("last")).select(doc, F.lit("document").alias("node_type"), F.lit(0).cast("long").alias("node_no"), "children", "first", "last")
    return level1.unionByName(level0)


_ITEM = re.compile(r"\s*(?:[-*+•]|\(?[0-9]{1,3}[.)]|\(?[A-Za-z][.)])\s+")


def _filled(text: str) -> list[str]:
    return [line for line in text.split("\n") if line.strip()]


def is_list(text: str) -> bool:
    """Three item marks or more, on half of the filled lines at least."""
    lines = _filled(text)
    marks = sum(bool(_ITEM.match(x)) for x in lines)
    return marks >= 3 and 2 * marks >= len(lines)


def is_line_structured(text: str) -> bool:
    """Five filled lines or more with fewer ends of sentences than a third of them: logs, verse, transcripts."""
    lines = _filled(text)
    return len(lines) >= 5 and 3 * len(re.findall(r"[.!?](?=\s|$)", text)) < len(lines)


def list_items(text: str) -> list[str]:
    """Each item with the lines that go on with it; lines before the first item are a unit of their own."""
    out: list[str] = []
    for line in _filled(text):
        if not out or _ITEM.match(line):
            out.append(line)
        else:
            out[-1] += "\n" + line
    return out


def routed(text: str, target: int, most: int, count: Callable[[str], int] = count_tokens) -> list[str]:
    """A block's pieces by its shape: whole list items, whole lines, or packed sentences of prose."""
    if count(text) <= most:
        return [text] if text.strip() else []
    if is_list(text):
        return pack(list_items(text), target, most, "\n", 0, count)
    if is_line_structured(text):
        return pack(_filled(text), target, most, "\n", 0, count)
    return pack(sentence_pieces(text), target, most, " ", 0, count)


def structured_pieces(df: DataFrame, id_col: str, text: str, target: int = CHILD_TARGET, most: int = 2 * CHILD_TARGET) -> DataFrame:
    """(id, i, kind, piece, n_tokens) of each block (text between blank lines) of each document, by the block's shape."""
    chars = batches.RUN_CHARS

    def run(frames):
        for f, (a, b) in ((f, run) for f in frames for run in batches.runs(f[text], chars)):
            rows = []
            for key, t in zip(f[id_col].iloc[a:b], f[text].iloc[a:b], strict=True):
                i = 0
                for block in re.split(r"\n\s*\n", t or ""):
                    kind = "list" if is_list(block) else "lines" if is_line_structured(block) else "prose"
                    for piece in routed(block, target, most):
                        rows.append((key, i, kind, piece, count_tokens(piece)))
                        i += 1
            yield pd.DataFrame(rows, columns=[id_col, "i", "kind", "piece", "n_tokens"])

    return df.select(id_col, text).mapInPandas(run, f"`{id_col}` {df.schema[id_col].dataType.simpleString()}, i long, kind string, piece string, n_tokens long")


def page_blocks(pages: DataFrame, doc: str, page: str, text: str, target: int = PARENT_TARGET, least: int = PARENT_MIN, most: int = PARENT_MAX) -> DataFrame:
    """(doc, block, label, first, last, n_tokens, text): consecutive pages joined into parents.

    A block closes before a page that would carry it over ``most``, or over ``target`` once it has ``least``
    tokens; a page over ``most`` is cut into blocks of its own; blank pages are left out. A document's
    pages are one task's list, in order.
    """

    def join(g: pd.DataFrame) -> pd.DataFrame:
        rows: list = []
        held: list = []
        size = 0

        def close():
            nonlocal held, size
            if held:
                rows.append((held[0][0], held[-1][0], "\n\n".join(t for _, t in held)))
            held, size = [], 0

        for n, t in zip(*(g.sort_values(page)[c] for c in (page, text)), strict=True):
            t = (t or "").strip()
            k = count_tokens(t)
            if not t:
                continue
            if k > most:
                close()
                rows += [(n, n, p) for p in pack(sentence_pieces(t), target, most)]
                continue
            if held and (size + k > most or (size + k > target and size >= least)):
                close()
            held.append((n, t))
            size += k
        close()
        label = [f"page_{a}" if a == b else f"pages_{a}-{b}" for a, b, _ in rows]
        return pd.DataFrame({doc: [g[doc].iloc[0]] * len(rows), "block": range(len(rows)), "label": label, "first": [r[0] for r in rows], "last": [r[1] for r in rows], "n_tokens": [count_tokens(r[2]) for r in rows], "text": [r[2] for r in rows]})

    kind = pages.schema[doc].dataType.simpleString()
    return pages.select(doc, page, text).groupBy(doc).applyInPandas(join, f"`{doc}` {kind}, block long, label string, first long, last long, n_tokens long, text string")
