"""Layout of pages: normalising what an OCR service returns, and making up one for plain text."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarrymill.functions.text import WIDE

# A page of A4 in points, its margin and line height, how many units of width a line has, and how much of a block's text its layout keeps.
PAGE_W, PAGE_H, MARGIN, LINE_H, WIDTH_UNITS, KEPT = 595, 842, 50, 16, 88, 200
LINES_PER_PAGE = (PAGE_H - 2 * MARGIN) // LINE_H
KINDS = {"heading": "title", "code": "code", "table": "table", "image": "image"}
PREFIX = 60
LAYOUT_SCHEMA = "doc_id long, idx int, type string, page int, b_start long, b_end long, bbox array<double>, text string"
_WIDE = re.compile(WIDE)


def located(docs: DataFrame, blocks: DataFrame) -> DataFrame:
    """Blocks (doc_id, idx, page, text) of docs (doc_id, md) with the offsets b_start and b_end: each is looked for by its first 60 characters from where the last one ended; one not found has no width there and the last page found.

    A document's text meets its blocks once, beside them, not on each of their rows. Blocks of unknown documents and of null texts are found nowhere; documents without blocks have no rows.
    """

    def find(key: tuple, of: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        md = next((x for x in of["own_md"] if x), "") if len(of) else ""
        at, page, out = 0, 0, []
        for r in rows.sort_values("idx").itertuples():
            start = md.find(r.text[:PREFIX], at) if r.text else -1
            if start >= 0:
                at, page = start + len(r.text), r.page
            out.append((key[0], r.idx, page, start if start >= 0 else at, at))
        return pd.DataFrame(out, columns=["doc_id", "idx", "page", "b_start", "b_end"])

    texts = docs.select(F.col("doc_id").alias("own_id"), F.col("md").alias("own_md"))
    return texts.groupBy("own_id").cogroup(blocks.select("doc_id", "idx", "page", "text").groupBy("doc_id")).applyInPandas(find, "doc_id long, idx int, page int, b_start long, b_end long")


def fill_pages(blocks: list[tuple[str, int, int, str]]) -> list[tuple]:
    """(type, page from 1, start, end, box, text) of the blocks (kind, start, end, text) of a document, set line after line.

    A block of more lines than are left on its page goes to the next one; only one of over a page is cut, by the share of its lines that
    fits and at most 95 % of its characters, and goes on there. The last part of a block keeps the beginning of its text, others their
    own. The box of a part that is cut reaches to its page's last line.
    """
    out, page, line = [], 1, 0
    box = lambda top, bottom: [float(MARGIN), float(PAGE_H - MARGIN - bottom * LINE_H), float(PAGE_W - MARGIN), float(PAGE_H - MARGIN - top * LINE_H)]
    for kind, start, end, text in blocks:
        at = 0
        while text.strip() and at < len(text):
            rest = len(text) - at
            need = max(1, -(-(rest + len(_WIDE.findall(text, at))) // WIDTH_UNITS))
            free = LINES_PER_PAGE - line
            if need <= free:
                out.append((KINDS.get(kind, "text"), page, start + at, end, box(line, line + need), text[:KEPT]))
                line, at = line + need, len(text)
                continue
            if free > 0 and need > LINES_PER_PAGE:
                cut = max(1, int(rest * min(0.95, free / need)))
                out.append((KINDS.get(kind, "text"), page, start + at, start + at + cut, box(line, LINES_PER_PAGE), text[at : at + cut][:KEPT]))
                at += cut
            page, line = page + 1, 0
    return out


def synthetic(docs: DataFrame) -> DataFrame:
    """A layout for docs (doc_id, md); see fill_pages. Empty and null texts have none."""

    def lay(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from quarrymill.operators.chunking import blocks

        for frame in frames:
            rows = []
            for doc, md in zip(frame["doc_id"], frame["md"], strict=True):
                set_ = fill_pages([(b.kind, b.start, b.end, b.text) for b in blocks((md or "").replace("\r\n", "\n"))])
                rows += [(doc, idx, *x) for idx, x in enumerate(set_)]
            yield pd.DataFrame(rows, columns=["doc_id", "idx", "type", "page", "b_start", "b_end", "bbox", "text"])

    return docs.select("doc_id", "md").mapInPandas(lay, LAYOUT_SCHEMA)


def merged_parts(parts: DataFrame) -> DataFrame:
    """Parts (doc_id, part, md, pages) with the pages and characters before them once joined by blank lines."""
    before = Window.partitionBy("doc_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    zero = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0)).cast("long")
    return parts.withColumns({"page_offset": zero(F.col("pages")), "char_offset": zero(F.length("md") + 2)})


def text_lines(glyphs: DataFrame) -> DataFrame:
    """S14's grouping: glyphs (doc_id, page, x, y, w, text) into lines by half-point steps of y, left to right, with a space where the gap is over 3 points."""
    line = glyphs.withColumn("row", F.round(F.col("y") * 2) / 2)
    order = Window.partitionBy("doc_id", "page", "row").orderBy("x")
    gap = F.col("x") - F.lag(F.col("x") + F.col("w")).over(order)
    spaced = line.withColumn("said", F.concat(F.when(gap > 3, " ").otherwise(""), F.col("text")))
    joined = spaced.groupBy("doc_id", "page", "row").agg(F.array_sort(F.collect_list(F.struct("x", "said"))).alias("parts"), F.min("x").alias("x0"), F.max(F.col("x") + F.col("w")).alias("x1"))
    return joined.select("doc_id", "page", F.col("row").alias("y"), "x0", "x1", F.array_join("parts.said", "").alias("text"))
