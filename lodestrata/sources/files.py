"""File sources: folders of documents to sections and rows; each format has one local parser."""

from __future__ import annotations

import csv
import html
import io
import re
import zipfile
from collections.abc import Iterator
from html.parser import HTMLParser
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SECTION = "path string, section_no long, heading_path array<string>, kind string, text string, start_s double, end_s double"
# Extensions by format.
FORMATS = {"md": "markdown", "markdown": "markdown", "txt": "text", "html": "html", "htm": "html", "csv": "table", "tsv": "table", "vtt": "subtitle", "srt": "subtitle", "docx": "docx", "epub": "epub", "xlsx": "xlsx", "py": "code", "lua": "code", "luau": "code", "js": "code"}


def route(name: str, head: bytes = b"") -> str:
    """Format by extension, else by what the first bytes look like."""
    ext = name.rsplit(".", 1)[-1].lower() if "." in name else ""
    if ext in FORMATS:
        return FORMATS[ext]
    if head[:2] == b"PK":
        return "docx"
    if head[:5] == b"%PDF-":
        return "pdf"
    return "html" if re.match(rb"\s*<(!doctype|html)", head[:200].lower()) else "text"


def discover(spark: SparkSession, root: str, extensions: list[str], recursive: bool = True, limit: int | None = None) -> DataFrame:
    """(path, size, modified) of files by extension, in order of path."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", recursive).load(root).select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"))
    files = files.where(F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).isin(extensions)).orderBy("path")
    return files.limit(limit) if limit else files


def unseen(files: DataFrame, known: DataFrame) -> DataFrame:
    """Files whose path is not among the known ones: an incremental rescan."""
    return files.join(known.select("path").distinct(), "path", "left_anti")


def markdown(text: str) -> Iterator[tuple]:
    path: list[str] = []
    kind, lines, fence = "body", [], False

    def done():
        body = "\n".join(lines).strip("\n")
        if body.strip():
            yield list(path), kind, body, None, None

    for line in text.split("\n"):
        if line.startswith("```"):
            if fence:
                yield from done()
                kind, lines, fence = "body", [], False
            else:
                yield from done()
                kind, lines, fence = "code", [], True
            continue
        m = None if fence else re.match(r"(#{1,6})\s+(.*)", line)
        table = not fence and line.lstrip().startswith("|")
        if m:
            yield from done()
            level = len(m[1])
            path[level - 1 :] = [m[2].strip()]
            kind, lines = "body", []
        elif not fence and table != (kind == "table"):
            yield from done()
            kind, lines = ("table" if table else "body"), [line]
        else:
            lines.append(line)
    yield from done()


class _Blocks(HTMLParser):
    SKIP = ("script", "style", "nav", "header", "footer", "aside", "noscript")
    BREAK = ("p", "div", "li", "br", "tr", "section", "article", "h1", "h2", "h3", "h4", "h5", "h6")

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out, self.buf, self.path, self.skip, self.head = [], [], [], 0, 0

    def flush(self):
        text = re.sub(r"\s+", " ", "".join(self.buf)).strip()
        self.buf = []
        if text and self.head:
            self.path[self.head - 1 :] = [text]
        elif text:
            self.out.append((list(self.path), "body", text, None, None))

    def handle_starttag(self, tag, attrs):
        if tag in self.SKIP:
            self.skip += 1
        if tag in self.BREAK:
            self.flush()
            self.head = int(tag[1]) if re.fullmatch("h[1-6]", tag) else 0

    def handle_endtag(self, tag):
        if tag in self.SKIP:
            self.skip = max(0, self.skip - 1)
        if tag in self.BREAK:
            self.flush()
            self.head = 0

    def handle_data(self, data):
        if not self.skip:
            self.buf.append(data)


def html_blocks(text: str) -> Iterator[tuple]:
    p = _Blocks()
    p.feed(text)
    p.flush()
    yield from p.out


def table_rows(rows: list[list[str]], caption: str) -> Iterator[tuple]:
    """A table as text: caption, columns and one line for each row."""
    if not rows:
        return
    cols = [c.strip() or f"c{i + 1}" for i, c in enumerate(rows[0])]
    lines = [f"Table: {caption}", "Columns: " + ", ".join(cols)]
    for i, r in enumerate(rows[1:], 1):
        lines.append(f"Row {i}: " + "; ".join(f"{c}={v.strip()}" for c, v in zip(cols, r, strict=False) if v.strip()))
    yield [caption], "table", "\n".join(lines), None, None


def subtitles(text: str) -> Iterator[tuple]:
    """Cues of VTT or SRT with start and end in seconds."""
    at = r"(?:(\d+):)?(\d{1,2}):(\d{2})[.,](\d{3})"
    sec = lambda g: int(g[0] or 0) * 3600 + int(g[1]) * 60 + int(g[2]) + int(g[3]) / 1000
    for block in re.split(r"\n\s*\n", text.replace("\r\n", "\n")):
        m = re.search(at + r"\s*-->\s*" + at, block)
        if m:
            said = re.sub(r"<[^>]+>", "", block[m.end() :].split("\n", 1)[-1]).strip()
            if said:
                yield [], "transcript", re.sub(r"\s+", " ", said), sec(m.groups()[:4]), sec(m.groups()[4:])


def _xml_text(node, tag: str) -> str:
    return "".join(x.text or "" for x in node.iter() if x.tag.endswith(tag))


def docx(data: bytes) -> Iterator[tuple]:
    path: list[str] = []
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml"))
    for p in (x for x in body.iter() if x.tag.endswith("}p")):
        style = next((v for x in p.iter() if x.tag.endswith("}pStyle") for k, v in x.attrib.items() if k.endswith("}val")), "")
        text = _xml_text(p, "}t").strip()
        if m := re.fullmatch(r"[Hh]eading\s?([1-6])", style):
            path[int(m[1]) - 1 :] = [text]
        elif text:
            yield list(path), "body", text, None, None


def epub(data: bytes) -> Iterator[tuple]:
    """Chapters in order of the spine."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        root = ElementTree.fromstring(z.read("META-INF/container.xml"))
        opf = next(x.attrib["full-path"] for x in root.iter() if x.tag.endswith("}rootfile"))
        top = opf.rsplit("/", 1)[0] + "/" if "/" in opf else ""
        pack = ElementTree.fromstring(z.read(opf))
        files = {x.attrib["id"]: x.attrib["href"] for x in pack.iter() if x.tag.endswith("}item")}
        for ref in (x.attrib["idref"] for x in pack.iter() if x.tag.endswith("}itemref")):
            yield from html_blocks(z.read(top + files[ref]).decode("utf-8", "replace"))


def xlsx(data: bytes) -> Iterator[tuple]:
    """Each worksheet as a table."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = z.namelist()
        words = []
        if "xl/sharedStrings.xml" in names:
            words = [_xml_text(s, "}t") for s in ElementTree.fromstring(z.read("xl/sharedStrings.xml")) if s.tag.endswith("}si")]
        for sheet in sorted(n for n in names if re.fullmatch(r"xl/worksheets/[^/]+\.xml", n)):
            rows = []
            for r in (x for x in ElementTree.fromstring(z.read(sheet)).iter() if x.tag.endswith("}row")):
                cells: list[str] = []
                for c in (x for x in r if x.tag.endswith("}c")):
                    col = 0
                    for ch in re.match("[A-Z]+", c.attrib.get("r", "A"))[0]:
                        col = col * 26 + ord(ch) - 64
                    v = _xml_text(c, "}v") or _xml_text(c, "}t")
                    cells += [""] * (col - 1 - len(cells)) + [words[int(v)] if c.attrib.get("t") == "s" else v]
                rows.append(cells)
            yield from table_rows(rows, sheet.rsplit("/", 1)[-1][:-4])


def code(text: str) -> Iterator[tuple]:
    """Top-level definitions, each with what stands before it; symbols are the heading path."""
    start, name = 0, []
    for m in re.finditer(r"(?m)^(?:async\s+)?(?:def|class|function|local function)\s+([A-Za-z_][\w.]*(?::\w+)?)", text):
        if text[start : m.start()].strip():
            yield name, "code", text[start : m.start()].strip("\n"), None, None
        start, name = m.start(), [m[1]]
    if text[start:].strip():
        yield name, "code", text[start:].strip("\n"), None, None


def parse(name: str, data: bytes) -> list[tuple]:
    """Sections of one file: (heading path, kind, text, start, end). What cannot be parsed is text as it is."""
    kind = route(name, data[:512])
    try:
        if kind == "docx":
            return list(docx(data))
        if kind == "epub":
            return list(epub(data))
        if kind == "xlsx":
            return list(xlsx(data))
    except (zipfile.BadZipFile, KeyError, ElementTree.ParseError, StopIteration):
        return [([], "unreadable", "", None, None)]
    text = data.decode("utf-8", "replace")
    if kind == "table":
        return list(table_rows(list(csv.reader(io.StringIO(text), delimiter="\t" if name.lower().endswith("tsv") else ",")), name.rsplit("/", 1)[-1]))
    made = {"markdown": markdown, "html": html_blocks, "subtitle": subtitles, "code": code}.get(kind)
    return list(made(text)) if made else [([], "body", html.unescape(text) if kind == "html" else text, None, None)]


def sections(spark: SparkSession, root: str, glob: str = "*") -> DataFrame:
    """All sections of all files below a folder, parsed where the files are read; one row a section."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(root).select("path", "content")

    def run(frames):
        for f in frames:
            for path, data in zip(f["path"], f["content"], strict=True):
                rows = [(path, i, *s) for i, s in enumerate(parse(path, bytes(data)))]
                if rows:
                    yield pd.DataFrame(rows, columns=["path", "section_no", "heading_path", "kind", "text", "start_s", "end_s"])

    return files.mapInPandas(run, SECTION)


def export_archive(tables: dict[str, DataFrame], path: str) -> None:
    """Each table as JSON lines below one folder."""
    for name, df in tables.items():
        df.write.mode("overwrite").json(f"{path}/{name}")


def import_archive(spark: SparkSession, path: str, schemas: dict[str, str], owner: str | None = None) -> dict[str, DataFrame]:
    """The archive's tables under their schemas; ``owner`` replaces user_id where there is one."""
    out = {}
    for name, schema in schemas.items():
        df = spark.read.schema(schema).json(f"{path}/{name}")
        out[name] = df.withColumn("user_id", F.lit(owner)) if owner and "user_id" in df.columns else df
    return out
