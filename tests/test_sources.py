"""Parsers on files made here, and sinks read back."""

import io
import zipfile

import pytest
from pyspark.sql import functions as F

from quarrymill.sources import files, html_markdown, layout, sinks


def zipped(parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in parts.items():
            z.writestr(name, text)
    return out.getvalue()


W = 'xmlns:w="w"'
CASES = {
    "a.txt": (b" one \r\n two\r\n\r\n\r\nthree", "one\ntwo\n\nthree\n"),
    "a.md": (b"# T\r\n", "# T\n"),
    "a.csv": ('﻿a,"b|c"\n\n1,"x\ny"\n'.encode(), "| a   | b\\|c |\n| --- | ---- |\n| 1   | x y  |\n"),
    "a.docx": (zipped({"word/document.xml": f'<w:document {W}><w:body><w:p><w:pPr><w:pStyle w:val="Heading1"/></w:pPr><w:r><w:t>Head</w:t></w:r></w:p><w:p><w:r><w:t>bo</w:t></w:r><w:r><w:t>dy</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>x</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>'}), "# Head\n\nbody\n\n| x   |\n| --- |\n"),
    "a.pptx": (zipped({"ppt/slides/slide2.xml": "<s xmlns:a='a'><a:p><a:t>B</a:t></a:p></s>", "ppt/slides/slide1.xml": "<s xmlns:a='a'><a:p><a:t>A</a:t></a:p><a:p><a:t>x</a:t></a:p></s>", "ppt/notesSlides/notesSlide1.xml": "<s xmlns:a='a'><a:p><a:t>n</a:t></a:p></s>"}), "## Slide 1\n**A**\n- x\n*n*\n\n## Slide 2\n**B**\n"),
    "a.xlsx": (zipped({"xl/workbook.xml": "<w xmlns:r='r'><sheets><sheet name='S' r:id='r1'/></sheets></w>", "xl/_rels/workbook.xml.rels": "<R><Relationship Id='r1' Target='worksheets/sheet1.xml'/></R>", "xl/sharedStrings.xml": "<s><si><t>hi</t></si></s>", "xl/worksheets/sheet1.xml": "<w><row><c t='s'><v>0</v></c><c><v>2</v></c></row></w>"}), "## S\n\n| hi  | 2   |\n| --- | --- |\n"),
    "a.odt": (zipped({"content.xml": "<o xmlns:t='t'><t:h t:outline-level='2'>H</t:h><t:p>p q</t:p></o>"}), "## H\n\np q\n"),
    "a.epub": (zipped({"META-INF/container.xml": "<c><rootfile full-path='o/p.opf'/></c>", "o/p.opf": "<p><manifest><item id='b' href='b.html'/><item id='a' href='a.html'/></manifest><spine><itemref idref='a'/><itemref idref='b'/></spine></p>", "o/a.html": "<h1>One</h1>", "o/b.html": "<p>Two</p>"}), "# One\n\nTwo\n"),
    "a.mht": (b"MIME-Version: 1.0\nContent-Type: multipart/related; boundary=x\n\n--x\nContent-Type: text/html; charset=utf-8\nContent-Transfer-Encoding: quoted-printable\n\n<p>caf=C3=A9</p>\n--x--\n", "café\n"),
    "a.rtf": (b"{\\rtf1\\ansi{\\fonttbl x;}Hello \\" + b"u20013?\\'d6\\'d0\\par next}", "Hello 中中\n\nnext\n"),
    "a.ofd": (zipped({"Doc_0/Pages/Page_0/Content.xml": "<p><TextCode>one</TextCode><TextCode>two</TextCode></p>"}), "one\ntwo\n"),
}


def test_files(spark, tmp_path):
    for name, (data, _) in CASES.items():
        (tmp_path / name).write_bytes(data)
    (tmp_path / "bad.docx").write_bytes(b"no zip")
    (tmp_path / "x.pdf").write_bytes(b"%PDF")
    got = {r.path.rsplit("/", 1)[-1]: r for r in files.to_markdown_rows(files.read_files(spark, str(tmp_path))).collect()}
    for name, (_, want) in CASES.items():
        assert (got[name].error, got[name].markdown) == (None, want), name
    assert got["bad.docx"].error.startswith("PARSE_FAILED") and got["x.pdf"].error == "UNSUPPORTED_FORMAT"


@pytest.mark.parametrize("limits", [(1, 10**9, 10**9), (9, 999, 10**9), (9, 10**9, 5_000)])
def test_zip_budget(limits):
    data = zipped({f"f{i}": "x" * 1_000 for i in range(6)})
    with pytest.raises(ValueError):
        files.open_zip(data, *limits)


def test_html():
    md = html_markdown.to_markdown("<nav>menu</nav><article><h1>T</h1><p>a <b>b</b> <a href='/x'>l</a></p><ul><li>1<ul><li>2</li></ul></li></ul><pre><code class='language-py'>x = 1</code></pre><table><tr><th>h|1</th></tr><tr><td>c</td></tr></table>" + "<p>" + "long " * 30 + "</p></article><footer>f</footer>")
    assert md.startswith("# T\n\na **b** [l](/x)\n\n- 1\n  - 2\n\n```py\nx = 1\n```\n\n| h\\|1 |\n| ---- |\n| c    |\n\nlong long")
    assert "menu" not in md and md.endswith("long\n")


def test_layout(spark):
    docs = spark.createDataFrame([(1, "\n\n".join(["line"] * 60)), (2, None)], "doc_id long, md string")
    rows = layout.synthetic(docs).collect()
    assert {r.doc_id for r in rows} == {1} and [r.page for r in rows] == [1] * 46 + [2] * 14 and all(r.text == "line" and r.type == "text" for r in rows)
    assert (rows[0].bbox, rows[1].bbox, rows[46].bbox) == ([50, 776, 545, 792], [50, 760, 545, 776], [50, 776, 545, 792])
    texts = spark.createDataFrame([(1, "ab cd ab"), (2, None), (4, "x")], "doc_id long, md string")
    blocks = spark.createDataFrame([(1, 0, 0, "ab"), (1, 1, 1, "zz"), (1, 2, 2, "ab"), (1, 3, 3, None), (2, 0, 5, "a"), (3, 0, 1, "b")], "doc_id long, idx int, page int, text string")
    got = [tuple(r) for r in layout.located(texts, blocks).orderBy("doc_id", "idx").collect()]
    assert got == [(1, 0, 0, 0, 2), (1, 1, 0, 2, 2), (1, 2, 2, 6, 8), (1, 3, 2, 8, 8), (2, 0, 0, 0, 0), (3, 0, 0, 0, 0)]
    lines = layout.text_lines(spark.createDataFrame([(1, 0, 10.0, 700.1, 5.0, "b"), (1, 0, 0.0, 700.0, 5.0, "a"), (1, 0, 0.0, 690.0, 5.0, "c")], "doc_id long, page int, x double, y double, w double, text string"))
    assert sorted(r.text for r in lines.collect()) == ["a b", "c"]
    parts = spark.createDataFrame([(1, 0, "abc", 2), (1, 1, "d", 3)], "doc_id long, part int, md string, pages int")
    assert [(r.page_offset, r.char_offset) for r in layout.merged_parts(parts).orderBy("part").collect()] == [(0, 0), (2, 5)]


def test_sinks(spark, tmp_path):
    chunks = spark.createDataFrame([(1, 1, "b", 0), (1, 0, 'a "q"', 0), (2, 0, "c", 1)], "doc_id long, seq int, text string, doc_bucket int")
    assert {r.doc_id: r.markdown for r in sinks.chunks_markdown(chunks).collect()} == {1: '## #0\n\na "q"\n\n## #1\n\nb', 2: "## #0\n\nc"}
    sinks.chunks_csv(chunks, str(tmp_path / "csv"))
    assert spark.read.option("header", True).option("escape", '"').csv(str(tmp_path / "csv")).where(F.col("text") == 'a "q"').count() == 1
    sinks.chunks_json(chunks, str(tmp_path / "json"))
    assert spark.read.json(str(tmp_path / "json")).count() == 3
    sinks.replace_partitions(chunks, str(tmp_path / "p"))
    sinks.replace_partitions(chunks.where("doc_bucket = 0").limit(1), str(tmp_path / "p"))
    assert spark.read.parquet(str(tmp_path / "p")).count() == 2
    sinks.backup({"chunks": chunks}, str(tmp_path / "backup"))
    assert sinks.restore(spark, str(tmp_path / "backup"))["chunks"].count() == 3
    m = spark.createDataFrame([("docs", {"kb": "a"}, 3)], "name string, labels map<string,string>, value long")
    assert sinks.prometheus(m).first().line == 'kb_docs{kb="a"} 3'
    sinks.create_collection(spark, "kb_test", 4)
    sinks.create_collection(spark, "kb_test", 4)
    assert spark.table("kb_test").count() == 0


def test_blocks_fill_pages():
    fill = lambda *texts: [(p, a, b, t) for _, p, a, b, _, t in layout.fill_pages([("paragraph", 0, len(t), t) for t in texts])]
    assert fill("", " \n", "x") == [(1, 0, 1, "x")]
    # Forty lines, then ten that don't fit in the six left, then one.
    assert [x[:3] for x in fill("a" * 40 * 88, "b" * 10 * 88, "c")] == [(1, 0, 3_520), (2, 0, 880), (2, 0, 1)]
    # Of 100 lines, 46 fit the first page and 46 the second; what is cut keeps its own text, the end the beginning of all.
    long = "".join(chr(97 + k // 88 % 26) for k in range(8_800))
    assert [x[:3] for x in fill(long)] == [(1, 0, 4_048), (2, 4_048, 8_096), (3, 8_096, 8_800)]
    assert [x[3] for x in fill(long)] == [long[:200], long[4_048:4_248], long[:200]]
    # A block over a page after another: six lines are left of the first, and no more than 95 % go at once.
    assert [x[:3] for x in fill("a" * 40 * 88, "b" * 47 * 88)] == [(1, 0, 3_520), (1, 0, 528), (2, 528, 4_136)]
    assert fill("\u4e2d" * 44)[0][:3] == (1, 0, 44) and len(fill("\u4e2d" * 44 * 46)) == 1 and len(fill("\u4e2d" * 44 * 47)) == 2
    assert layout.fill_pages([("heading", 5, 8, "# x"), ("code", 9, 10, "y")])[1][:4] == ("code", 1, 9, 10)
