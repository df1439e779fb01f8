"""Files read as bytes, routed by extension and turned into Markdown, a row a file."""

from __future__ import annotations

import csv
import email
import email.policy
import io
import posixpath
import re
import zipfile
from urllib.parse import unquote
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrymill.sources.html_markdown import clean, pipe_table, to_markdown

# Extensions by parser, and the budgets of archives and tables.
ROUTES = {
    "markdown": ("md", "markdown", "mdx"), "text": ("txt", "text", "log", "srt"), "html": ("html", "htm", "xhtml"), "csv": ("csv",), "tsv": ("tsv",), "xlsx": ("xlsx",), "pptx": ("pptx",), "docx": ("docx",),
    "odf": ("odt", "ods", "odp"), "epub": ("epub",), "mhtml": ("mht", "mhtml"), "rtf": ("rtf",), "ofd": ("ofd",),
}
ZIP_ENTRIES, ZIP_ENTRY_BYTES, ZIP_BYTES = 5_000, 256 << 20, 512 << 20
TABLE_ROWS, TABLE_COLUMNS = 10_000, 512
RTF = re.compile(rb"\\'([0-9a-fA-F]{2})|\\u(-?\d+) ?|\\([a-zA-Z]+)(-?\d+)? ?|\\([^a-zA-Z])|([{}])|[\r\n]+|([^\\{}\r\n]+)")
RTF_HIDDEN = frozenset(b"fonttbl colortbl stylesheet info pict header footer generator themedata datastore listtable listoverridetable rsidtbl xmlnstbl".split())


def extension(path):
    return F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))


def route(ext):
    """The parser of an extension, null where no local one has it."""
    out = F.lit(None).cast("string")
    for parser, known in ROUTES.items():
        out = F.when(ext.isin(*known), parser).otherwise(out)
    return out


def open_zip(data: bytes, entries: int = ZIP_ENTRIES, entry_bytes: int = ZIP_ENTRY_BYTES, total: int = ZIP_BYTES) -> zipfile.ZipFile:
    """An archive whose listing is within the budget, checked before anything is inflated."""
    z = zipfile.ZipFile(io.BytesIO(data))
    sizes = [i.file_size for i in z.infolist()]
    if len(sizes) > entries or max(sizes, default=0) > entry_bytes or sum(sizes) > total:
        raise ValueError("archive over budget")
    return z


def decoded(data: bytes) -> str:
    for encoding in ("utf-8-sig", "gb18030"):
        try:
            return data.decode(encoding)
        except UnicodeDecodeError:
            continue
    return data.decode("utf-8", "replace")


def paragraphs(text: str) -> str:
    """S3."""
    parts = [[x.strip() for x in p.split("\n") if x.strip()] for p in re.split(r"\n\s*\n", text.replace("\r\n", "\n"))]
    return "\n\n".join("\n".join(p) for p in parts if p)


def table_text(text: str, delimiter: str = ",") -> str:
    """S5."""
    rows = [r[:TABLE_COLUMNS] for r in csv.reader(io.StringIO(text.lstrip("﻿")), delimiter=delimiter) if any(c.strip() for c in r)]
    return pipe_table(rows[:TABLE_ROWS])


def _local(tag: str) -> str:
    return tag.rsplit("}", 1)[-1]


def _said(node: ElementTree.Element, tag: str) -> str:
    return "".join(x.text or "" for x in node.iter() if _local(x.tag) == tag)


def _xml(z: zipfile.ZipFile, name: str) -> ElementTree.Element | None:
    return ElementTree.fromstring(z.read(name)) if name in z.namelist() else None


def _related(z: zipfile.ZipFile, of: str) -> dict[str, str]:
    base, name = posixpath.split(of)
    rels = _xml(z, f"{base}/_rels/{name}.rels")
    return {r.get("Id"): posixpath.normpath(posixpath.join(base, r.get("Target"))) if not r.get("Target").startswith("/") else r.get("Target")[1:] for r in rels} if rels is not None else {}


def xlsx(data: bytes) -> str:
    """Sheets in the workbook's order; cells in the order they stand, gaps not filled."""
    z = open_zip(data)
    strings = _xml(z, "xl/sharedStrings.xml")
    shared = [_said(s, "t") for s in strings] if strings is not None else []
    targets, out = _related(z, "xl/workbook.xml"), []
    for sheet in (x for x in _xml(z, "xl/workbook.xml").iter() if _local(x.tag) == "sheet"):
        path = targets.get(next((v for k, v in sheet.attrib.items() if _local(k) == "id"), ""))
        rows = []
        for row in (x for x in _xml(z, path).iter() if _local(x.tag) == "row"):
            cells = []
            for c in (x for x in row if _local(x.tag) == "c"):
                value = _said(c, "v")
                cells.append(shared[int(value)] if c.get("t") == "s" and value else _said(c, "t") if c.get("t") == "inlineStr" else value)
            if any(x.strip() for x in cells):
                rows.append(cells[:TABLE_COLUMNS])
        out.append(f"## {sheet.get('name')}\n\n{pipe_table(rows[:TABLE_ROWS])}")
    return "\n\n".join(out)


def pptx(data: bytes) -> str:
    """Slides by number, the first paragraph bold, others as bullets, notes in italics."""
    z = open_zip(data)
    slides = sorted((int(m[1]), m[0]) for n in z.namelist() if (m := re.fullmatch(r"ppt/slides/slide(\d+)\.xml", n)))
    out = []
    for number, name in slides:
        said = [t for p in _xml(z, name).iter() if _local(p.tag) == "p" and (t := _said(p, "t").strip())]
        lines = [f"## Slide {number}", *([f"**{said[0]}**"] if said else []), *(f"- {t}" for t in said[1:])]
        notes = _xml(z, f"ppt/notesSlides/notesSlide{number}.xml")
        if notes is not None:
            lines += [f"*{t}*" for p in notes.iter() if _local(p.tag) == "p" and (t := _said(p, "t").strip())]
        out.append("\n".join(lines))
    return "\n\n".join(out)


def docx(data: bytes) -> str:
    """Headings, list items, tables and paragraphs of the document part."""
    out = []
    for node in next(x for x in _xml(open_zip(data), "word/document.xml") if _local(x.tag) == "body"):
        if _local(node.tag) == "tbl":
            out.append(pipe_table([[_said(c, "t") for c in r if _local(c.tag) == "tc"] for r in node if _local(r.tag) == "tr"]))
        elif text := _said(node, "t").strip():
            style = next((v for x in node.iter() if _local(x.tag) == "pStyle" for v in x.attrib.values()), "")
            heading = re.fullmatch(r"(?i)heading\s?([1-6])", style)
            listed = any(_local(x.tag) == "numPr" for x in node.iter())
            out.append("#" * int(heading[1]) + " " + text if heading else f"- {text}" if listed else text)
    return "\n\n".join(x for x in out if x)


def odf(data: bytes) -> str:
    """Headings, lists, paragraphs and tables; repeated cells at most 50 times."""

    def text(node: ElementTree.Element) -> str:
        return " ".join("".join(node.itertext()).split())

    out, done = [], set()
    for node in _xml(open_zip(data), "content.xml").iter():
        tag = _local(node.tag)
        if id(node) in done:
            continue
        if tag == "table":
            rows = []
            for r in (x for x in node.iter() if _local(x.tag) == "table-row"):
                cells = []
                for c in (x for x in r if _local(x.tag) == "table-cell"):
                    times = int(next((v for k, v in c.attrib.items() if _local(k) == "number-columns-repeated"), 1))
                    cells += [text(c)] * min(50, times)
                if any(cells):
                    rows.append(cells)
            out.append(pipe_table(rows[:TABLE_ROWS]))
            done |= {id(x) for x in node.iter()}
        elif tag in ("h", "p", "list-item") and text(node):
            level = int(next((v for k, v in node.attrib.items() if _local(k) == "outline-level"), 1))
            out.append({"h": "#" * level + " ", "p": "", "list-item": "- "}[tag] + text(node))
            done |= {id(x) for x in node.iter()}
    return "\n\n".join(x for x in out if x)


def epub(data: bytes) -> str:
    """Chapters in the order of the spine."""
    z = open_zip(data)
    package = next(x.get("full-path") for x in _xml(z, "META-INF/container.xml").iter() if _local(x.tag) == "rootfile")
    opf = _xml(z, package)
    files = {x.get("id"): posixpath.normpath(posixpath.join(posixpath.dirname(package), unquote(x.get("href")))) for x in opf.iter() if _local(x.tag) == "item"}
    spine = [files[x.get("idref")] for x in opf.iter() if _local(x.tag) == "itemref" and x.get("idref") in files]
    return "\n\n".join(said for name in spine if name in z.namelist() and (said := to_markdown(decoded(z.read(name)), whole=True).strip()))


def mhtml(data: bytes) -> str:
    """The HTML part of a saved page, else its text."""
    parts = list(email.message_from_bytes(data, policy=email.policy.default).walk())
    for kind in ("text/html", "text/plain"):
        for p in parts:
            if p.get_content_type() == kind:
                return to_markdown(p.get_content()) if kind == "text/html" else paragraphs(p.get_content())
    return ""


def rtf(data: bytes) -> str:
    r"""Text of the shown groups; \'hh in GBK, \uN with its \ucN substitutes skipped."""
    out, stack, hidden, skip, uc, pending = [], [], False, 0, 1, b""

    def flush() -> None:
        nonlocal pending
        if pending:
            out.append(pending.decode("gbk", "replace"))
            pending = b""

    for m in RTF.finditer(data):
        byte, unicode, word, number, symbol, brace, plain = m.groups()
        if byte is not None:
            if skip:
                skip -= 1
            elif not hidden:
                pending += bytes([int(byte, 16)])
            continue
        flush()
        if brace == b"{":
            stack.append((hidden, uc))
        elif brace == b"}":
            hidden, uc = stack.pop() if stack else (False, 1)
        elif unicode is not None:
            if not hidden:
                out.append(chr(int(unicode) % 65536))
            skip = uc
        elif word == b"uc":
            uc = int(number or 1)
        elif word in RTF_HIDDEN or symbol == b"*":
            hidden = True
        elif word in (b"par", b"line", b"row"):
            out.append("" if hidden else "\n")
        elif word in (b"tab", b"cell"):
            out.append("" if hidden else "\t")
        elif symbol in (b"\\", b"{", b"}") and not hidden:
            out.append(symbol.decode())
        elif plain and not hidden:
            out.append(plain[skip:].decode("latin-1"))
            skip = max(0, skip - len(plain))
    flush()
    return "\n\n".join(x.strip() for x in "".join(out).split("\n") if x.strip())


def ofd(data: bytes) -> str:
    """The text codes of the pages, in the document's order."""
    z = open_zip(data)
    pages = sorted((int(m[1]), n) for n in z.namelist() if (m := re.search(r"Pages/Page_(\d+)/Content\.xml$", n)))
    return "\n\n".join("\n".join(t for x in _xml(z, name).iter() if _local(x.tag) == "TextCode" and (t := (x.text or "").strip())) for _, name in pages)


PARSERS = {
    "markdown": lambda d: decoded(d).replace("\r\n", "\n"), "text": lambda d: paragraphs(decoded(d)), "html": lambda d: to_markdown(decoded(d)), "csv": lambda d: table_text(decoded(d)), "tsv": lambda d: table_text(decoded(d), "\t"),
    "xlsx": xlsx, "pptx": pptx, "docx": docx, "odf": odf, "epub": epub, "mhtml": mhtml, "rtf": rtf, "ofd": ofd,
}


def parse_bytes(parser: str | None, data: bytes) -> tuple[str | None, str | None]:
    """(Markdown, error); a file that can't be read gives an error, not a failed job."""
    if parser is None:
        return None, "UNSUPPORTED_FORMAT"
    try:
        return clean(PARSERS[parser](data)), None
    except Exception as e:  # a broken file is a result
        return None, f"PARSE_FAILED: {type(e).__name__}: {e}"


def read_files(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """(path, ext, parser, size, content_hash, content) of the files under a path that Spark reads."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    files = (reader.option("pathGlobFilter", glob) if glob else reader).load(path)
    ext = extension(F.col("path"))
    return files.select("path", ext.alias("ext"), route(ext).alias("parser"), F.col("length").alias("size"), F.sha2("content", 256).alias("content_hash"), "content")


def to_markdown_rows(files: DataFrame) -> DataFrame:
    """read_files' rows with markdown and error in place of content."""

    @F.pandas_udf("markdown string, error string")
    def run(parser: pd.Series, content: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([parse_bytes(p, bytes(c)) for p, c in zip(parser, content, strict=True)], columns=["markdown", "error"])

    return files.withColumn("out", run("parser", "content")).select("path", "ext", "parser", "size", "content_hash", "out.markdown", "out.error")
