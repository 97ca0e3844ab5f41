"""Parsers of each format, sinks and archives."""

import io
import zipfile

from lodestrata.operators import relational as rel
from lodestrata.sources import files


def zipped(**parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, data in parts.items():
            z.writestr(name.replace("__", "/").replace("_DOT_", "."), data)
    return out.getvalue()


def test_routes():
    assert files.route("a.md") == "markdown" and files.route("x", b"PK\x03") == "docx" and files.route("x", b"<!DOCTYPE html>") == "html" and files.route("x", b"hi") == "text"


def test_markdown_html_subtitles_table_code():
    md = "# A\nintro\n## B\ntext\n| x | y |\n| 1 | 2 |\n```\ncode\n```\nend"
    got = [(s[0], s[1], s[2]) for s in files.parse("a.md", md.encode())]
    assert got == [(["A"], "body", "intro"), (["A", "B"], "body", "text"), (["A", "B"], "table", "| x | y |\n| 1 | 2 |"), (["A", "B"], "code", "code"), (["A", "B"], "body", "end")]
    page = "<nav>menu</nav><h1>T</h1><p>one<p>two &amp; three<script>var a='</p>'</script><ul><li>x</li></ul>"
    assert [(s[0], s[2]) for s in files.parse("a.html", page.encode())] == [(["T"], "one"), (["T"], "two & three"), (["T"], "x")]
    vtt = "WEBVTT\n\n00:01.500 --> 00:02.000\n<b>Hi</b>\nthere\n\n1\n01:00:00,000 --> 01:00:01,250\nbye"
    assert [(s[2], s[3], s[4]) for s in files.parse("a.vtt", vtt.encode())] == [("Hi there", 1.5, 2.0), ("bye", 3600.0, 3601.25)]
    assert files.parse("t.csv", b'a,b\n1,"x, y"\n,3\n')[0][2] == "Table: t.csv\nColumns: a, b\nRow 1: a=1; b=x, y\nRow 2: b=3"
    assert [s[0] for s in files.parse("m.py", b"import os\n\ndef f():\n    pass\n\nclass C:\n    x = 1\n")] == [[], ["f"], ["C"]]


def test_zip_formats():
    w = 'xmlns:w="http://w"'
    doc = f'<w:document {w}><w:body><w:p><w:pPr><w:pStyle w:val="Heading1"/></w:pPr><w:r><w:t>Top</w:t></w:r></w:p><w:p><w:r><w:t>some </w:t></w:r><w:r><w:t>text</w:t></w:r></w:p></w:body></w:document>'
    assert files.parse("a.docx", zipped(word__document_DOT_xml=doc)) == [(["Top"], "body", "some text", None, None)]
    s = 'xmlns="http://s"'
    sheet = f'<worksheet {s}><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="C1"><v>h</v></c></row><row><c r="A2"><v>1</v></c><c r="C2"><v>2</v></c></row></sheetData></worksheet>'
    got = files.parse("a.xlsx", zipped(xl__sharedStrings_DOT_xml=f"<sst {s}><si><t>n</t></si></sst>", xl__worksheets__sheet1_DOT_xml=sheet))
    assert got[0][2] == "Table: sheet1\nColumns: n, c2, h\nRow 1: n=1; h=2"
    con = '<container xmlns="c"><rootfiles><rootfile full-path="o/p.opf"/></rootfiles></container>'
    opf = '<package xmlns="p"><manifest><item id="b" href="b.html"/><item id="a" href="a.html"/></manifest><spine><itemref idref="a"/><itemref idref="b"/></spine></package>'
    book = zipped(**{"META-INF__container_DOT_xml": con, "o__p_DOT_opf": opf, "o__a_DOT_html": "<h1>One</h1><p>x</p>", "o__b_DOT_html": "<p>y</p>"})
    assert [(s[0], s[2]) for s in files.parse("b.epub", book)] == [(["One"], "x"), ([], "y")]
    assert files.parse("bad.docx", b"PK broken")[0][1] == "unreadable"


def test_folder_scan_and_rescan(spark, tmp_path):
    (tmp_path / "in/sub").mkdir(parents=True)
    (tmp_path / "in/a.md").write_text("# H\nx")
    (tmp_path / "in/sub/b.csv").write_text("k\n1\n")
    got = files.sections(spark, str(tmp_path / "in")).orderBy("path").collect()
    assert [(r.path.rsplit("/", 1)[-1], r.kind) for r in got] == [("a.md", "body"), ("b.csv", "table")]
    found = files.discover(spark, str(tmp_path / "in"), ["md", "csv"])
    assert found.count() == 2 and files.unseen(found, found.limit(1)).count() == 1 and files.discover(spark, str(tmp_path / "in"), ["md"], limit=5).count() == 1


def test_archive_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("u1", 1, ["a", "b"])], "user_id string, n long, tags array<string>")
    files.export_archive({"items": df}, str(tmp_path / "x"))
    back = files.import_archive(spark, str(tmp_path / "x"), {"items": df.schema.simpleString()[7:-1].replace(":", " ")}, owner="u2")["items"]
    assert [tuple(r) for r in back.select("user_id", "n").collect()] == [("u2", 1)]


def test_upsert_keeps_newest(spark):
    old = spark.createDataFrame([(1, "a", 1), (2, "b", 1)], "k long, v string, at long")
    new = spark.createDataFrame([(2, "c", 2), (2, "d", 3), (3, "e", 1)], "k long, v string, at long")
    assert sorted(tuple(r) for r in rel.upsert(old, new, ["k"], "at").collect()) == [(1, "a", 1), (2, "d", 3), (3, "e", 1)]
