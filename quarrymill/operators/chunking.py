"""Parent and child chunks of Markdown: the scan over one document is sequential, so it runs per row within partitions; all that follows is relational."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrymill.functions.text import TOKEN, chunk_id, fingerprint16, uuid5
from quarrymill.operators.tables import overlaps

_TOKEN = regex.compile(TOKEN)
_S = r"[^\S\n]"  # white space within a line
_STARTS = {
    "code": rf"{_S}{{0,3}}`{{3,}}",
    "html": rf"(?=[^\n]*<(?i:table)(?:{_S}|>))",
    "table": rf"[^\n]*\|[^\n]*\n(?=[^\n]*-)(?=[^\n]*\|){_S}*\|?[ :|-]*-[ :|-]*\|?{_S}*(?=\n|\Z)",
    "heading": rf"#{{1,6}}{_S}+[^\n]*",
    "image": rf"{_S}*!\[[^\]\n]*\]\([^)\n]*\){_S}*(?=\n|\Z)",
    "blank": rf"{_S}*(?=\n|\Z)",
}
_REST = {
    "code": rf"[^\n]*(?:\n(?!{_S}{{0,3}}`{{3,}}{_S}*(?=\n|\Z))[^\n]*)*(?:\n{_S}{{0,3}}`{{3,}}{_S}*)?",
    "html": r"[\s\S]*?(?:</(?i:table)>[^\n]*|\Z)",
    "table": r"(?:\n[^\n]*\|[^\n]*)*",
}
_ANY = "|".join(_STARTS.values())
#: One alternative a kind, in order of precedence; a paragraph is the lines that begin none of them.
BLOCK = regex.compile("^(?:" + "|".join(f"(?P<{k}>{s}{_REST.get(k, '')})" for k, s in _STARTS.items()) + rf"|(?P<paragraph>[^\n]+(?:\n(?!{_ANY})[^\n]+)*))(?:\n|\Z)", regex.M)
_FULL_STOP = r"""\.(?=\Z|\s\Z|\s[A-Z0-9一-鿿「“（(\[])"""
SENTENCE = regex.compile(rf"(?:(?!{_FULL_STOP}|[。！？!?;；\n])[\s\S])*(?:(?:{_FULL_STOP}|[。！？!?;；\n])+|\Z)")


@dataclass(frozen=True)
class Config:
    """C13. Sizes are in tokens."""

    size: int = 512
    overlap: int = 0
    parent_size: int = 2_000
    strategy: str = "hybrid"
    protects: tuple[str, ...] = ("code", "table")

    def clamped(self) -> Config:
        size = self.size or 512
        return replace(self, size=max(16, size), overlap=max(0, min(self.overlap, size // 4)), parent_size=max(size, self.parent_size or 2_000))


@dataclass(frozen=True)
class Part:
    """A stretch of the text: a block, or a piece of one."""

    kind: str
    start: int
    end: int
    text: str
    tokens: int


def count(text: str) -> int:
    return len(_TOKEN.findall(text))


def _part(kind: str, start: int, text: str) -> Part:
    return Part(kind, start, start + len(text), text, count(text))


def blocks(md: str) -> list[Part]:
    """Fenced code (to the end if never closed), HTML and pipe tables, headings, lone images and paragraphs, without the line ends after them."""
    found = [(m.lastgroup, m.start(), m[m.lastgroup]) for m in BLOCK.finditer(md)]
    return [_part("table" if kind == "html" else kind, start, text) for kind, start, text in found if kind != "blank" and text]


def packed(parts: list[Part], limit: int, keep: Callable[[list[Part]], bool] = lambda group: False) -> list[list[Part]]:
    """Runs of parts one after another, each up to limit tokens; a part alone may have more."""
    out: list[list[Part]] = []
    total = 0
    for p in parts:
        if out and (total + p.tokens <= limit or keep(out[-1])):
            out[-1].append(p)
            total += p.tokens
        else:
            out.append([p])
            total = p.tokens
    return out


def parents(parts: list[Part], config: Config) -> list[list[Part]]:
    """Sections from heading to heading, small ones merged into the one before, long ones packed; without headings, packed blocks."""
    if config.strategy == "token" or all(p.kind != "heading" for p in parts):
        return packed(parts, config.parent_size)
    sections: list[list[Part]] = []
    for p in parts:
        if p.kind == "heading" or not sections:
            sections.append([])
        sections[-1].append(p)
    if config.strategy == "hybrid":
        merged = sections[:1]
        for section in sections[1:]:
            before, tokens = merged[-1], sum(p.tokens for p in section)
            small = tokens <= max(1, config.size // 2) and section[0].start - before[-1].end <= 3
            # What stands before the first heading takes a small section in whatever the sum.
            if small and (before[0].kind != "heading" or sum(p.tokens for p in before) + tokens <= config.parent_size):
                before.extend(section)
            else:
                merged.append(section)
        sections = merged
    return [group for s in sections for group in packed(s, config.parent_size)]


def sentences(text: str) -> list[tuple[int, str]]:
    """(offset, sentence with its delimiters); blank ones go."""
    return [(m.start(), m[0]) for m in SENTENCE.finditer(text) if m[0].strip()]


def hard_cut(part: Part, target: int, overlap: int) -> list[Part]:
    """Pieces of as many characters as the target's tokens take on average, each beginning before the last one's end by the overlap; none of a text without tokens."""
    if not part.tokens:
        return []
    each = len(part.text) / part.tokens
    size, back = max(8, math.floor(target * each + 0.5)), max(0, math.floor(overlap * each + 0.5))
    out, at = [], 0
    while True:
        end = min(len(part.text), at + size)
        if part.text[at:end].strip():
            out.append(_part(part.kind, part.start + at, part.text[at:end]))
        if end == len(part.text):
            return out
        at = end - back if end - back > at else end


def _joined(group: list[Part], between: str) -> Part:
    return group[0] if len(group) == 1 else Part(group[0].kind, group[0].start, group[-1].end, between.join(p.text for p in group), sum(p.tokens for p in group))


def pieces(block: Part, config: Config) -> list[Part]:
    """A protected block stays whole, or goes by lines where it is too long; another is text, cut by sentences where it is too long."""
    if block.kind in config.protects and block.kind in ("code", "table", "image"):
        if block.tokens <= config.size:
            return [block]
        at, lines = block.start, []
        for line in block.text.split("\n"):
            lines.append(_part(block.kind, at, line))
            at += len(line) + 1
        groups = packed(lines, config.size)
        out = [p for g in groups for p in (hard_cut(g[0], config.size, 0) if len(g) == 1 and g[0].tokens > config.size else [_joined(g, "\n")])]
        return [p for p in out if p.text.strip()]
    text = replace(block, kind="text")
    if text.tokens <= config.size:
        return [text]
    said = [_part("text", text.start + at, s) for at, s in sentences(text.text)]
    return [p for g in packed(said, config.size) for p in (hard_cut(g[0], config.size, config.overlap) if g[0].tokens > config.size else [_joined(g, "")])]


def children(parent: list[Part], config: Config) -> list[Part]:
    """Pieces of text one after another are joined up to the size; others stand alone."""
    out: list[Part] = []
    for p in (p for b in parent for p in pieces(b, config)):
        if out and out[-1].kind == p.kind == "text" and out[-1].tokens + p.tokens <= config.size:
            out[-1] = _joined([out[-1], p], "\n\n")
        else:
            out.append(p)
    return [p for p in out if p.text.strip()]


BLOCK_SCHEMA = "doc_id long, idx int, kind string, level int, char_start long, char_end long, text string, n_tokens long"
CHUNK_SCHEMA = "doc_id long, seq int, is_parent boolean, parent_seq int, doc_type string, text string, token_count long, char_start long, char_end long, parent_hash string"


def md_blocks(docs: DataFrame) -> DataFrame:
    """C1 over docs (doc_id, md); null counts as empty. CR LF counts as LF."""

    def scan(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for doc, md in zip(frame["doc_id"], frame["md"], strict=True):
                for i, b in enumerate(blocks((md or "").replace("\r\n", "\n"))):
                    level = len(b.text) - len(b.text.lstrip("#")) if b.kind == "heading" else 0
                    rows.append((doc, i, b.kind, level, b.start, b.end, b.text, b.tokens))
            yield pd.DataFrame(rows, columns=["doc_id", "idx", "kind", "level", "char_start", "char_end", "text", "n_tokens"])

    return docs.select("doc_id", "md").mapInPandas(scan, BLOCK_SCHEMA)


def chunk_markdown(docs: DataFrame, config: Config = Config()) -> DataFrame:
    """Parents and children of docs (doc_id, md), numbered parent, its children, next parent. Offsets are in code points."""
    config = config.clamped()

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows: list[tuple] = []
            for doc, md in zip(frame["doc_id"], frame["md"], strict=True):
                md, seq = (md or "").replace("\r\n", "\n"), 0
                for group in parents(blocks(md), config):
                    top, text = seq, md[group[0].start : group[-1].end]
                    digest = hashlib.sha256(text.encode()).hexdigest()[:16]
                    rows.append((doc, top, True, None, "text", text, count(text), group[0].start, group[-1].end, None))
                    for seq, c in enumerate(children(group, config), top + 1):
                        rows.append((doc, seq, False, top, c.kind, c.text, c.tokens, c.start, c.end, digest))
                    seq += 1
            out = pd.DataFrame(rows, columns=["doc_id", "seq", "is_parent", "parent_seq", "doc_type", "text", "token_count", "char_start", "char_end", "parent_hash"])
            yield out.astype({"parent_seq": "Int32"})

    return docs.select("doc_id", "md").mapInPandas(cut, CHUNK_SCHEMA)


def with_ids(chunks: DataFrame, kb: str, parent_text: bool = False) -> DataFrame:
    """Chunk and parent ids, fingerprints, previews and, if asked for, the parent's text where it has at most 2 000 tokens. A parent's id follows from the hash that the cut has left with its children; only its text is a join."""
    doc = F.col("doc_id").cast("string")
    parent = F.when(F.col("parent_hash").isNotNull(), uuid5(F.concat_ws(":", F.lit(kb), doc, F.col("parent_seq").cast("string"), F.col("parent_hash"))))
    columns = {"chunk_id": chunk_id(F.lit(kb), doc, F.col("seq").cast("string"), F.col("text")), "parent_id": parent, "fingerprint": fingerprint16(F.col("is_parent"), F.col("text")), "text_preview": F.substring("text", 1, 500)}
    named = chunks.withColumns(columns).drop("parent_hash")
    if not parent_text:
        return named
    top = chunks.where("is_parent").select("doc_id", F.col("seq").alias("parent_seq"), F.when(F.col("token_count") <= 2_000, F.col("text")).alias("parent_text"))
    return named.join(top, ["doc_id", "parent_seq"], "left")


def stats(chunks: DataFrame) -> DataFrame:
    """A10 by document: over children."""
    c = chunks.where("not is_parent")
    return c.groupBy("doc_id").agg(F.count(F.lit(1)).alias("total"), F.min("token_count").alias("token_min"), F.max("token_count").alias("token_max"), (F.floor(F.avg("token_count") * 10 + 0.5) / 10).alias("token_avg"), F.expr("percentile_disc(0.95) WITHIN GROUP (ORDER BY token_count)").cast("long").alias("token_p95"))


def backfilled(chunks: DataFrame, layout: DataFrame) -> DataFrame:
    """C11: pages and boxes of the first and last layout block (doc_id, b_start, b_end, page, bbox) that each chunk overlaps."""
    keyed = chunks.withColumnsRenamed({"char_start": "c_start", "char_end": "c_end"})
    met = overlaps(keyed.select("doc_id", "seq", "c_start", "c_end"), layout, "doc_id").groupBy("doc_id", "seq").agg(
        F.min_by("page", "b_start").alias("page_from"), F.max_by("page", "b_start").alias("page_to"), F.min_by("bbox", "b_start").alias("bbox_from"), F.max_by("bbox", "b_start").alias("bbox_to")
    )
    return chunks.join(met, ["doc_id", "seq"], "left")
