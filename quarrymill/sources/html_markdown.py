"""HTML to Markdown, by the standard library's parser, one document a row."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrymill.functions.text import BLANK, CLEANING, ZERO_WIDTH

# What is dropped whole, what breaks a block, and where the main content is looked for.
DROPPED = frozenset("script style noscript template svg canvas iframe object embed form button input select textarea nav header footer aside link meta".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
BLOCKS = frozenset("address article blockquote body dd details div dl dt fieldset figcaption figure h1 h2 h3 h4 h5 h6 html hr li main ol p pre section table td th tr ul".split())
MAIN_LEAST, BEST_LEAST, BEST_ACCEPTED = 80, 200, 300
SPACES = re.compile(r"[ \t\r\n\f\v 　]+")


class Element:
    def __init__(self, tag: str, attributes: dict[str, str], parent: Element | None) -> None:
        self.tag, self.attributes, self.parent, self.kids = tag, attributes, parent, []

    def walk(self) -> Iterator[Element]:
        stack = [self]
        while stack:
            at = stack.pop()
            yield at
            stack += [k for k in reversed(at.kids) if isinstance(k, Element)]

    def text(self) -> str:
        out, stack = [], [self]
        while stack:
            at = stack.pop()
            if isinstance(at, str):
                out.append(at)
            else:
                stack += reversed(at.kids)
        return "".join(out)


class _Builder(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = self.at = Element("html", {}, None)
        self.hidden = 0

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if self.hidden or tag in DROPPED:
            self.hidden += tag not in VOID
            return
        if tag in ("p", "li", "tr", "td", "th") or tag in BLOCKS and self.at.tag == "p":
            implied = {"tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th")}.get(tag, (tag,) if tag == "li" else ("p",))
            if self.at.tag in implied and self.at.parent is not None:
                self.at = self.at.parent
        new = Element(tag, {k: v or "" for k, v in attrs}, self.at)
        self.at.kids.append(new)
        if tag not in VOID:
            self.at = new

    def handle_endtag(self, tag: str) -> None:
        if self.hidden:
            self.hidden -= tag not in VOID
            return
        at = self.at
        while at is not None and at.tag != tag:
            at = at.parent
        if at is not None and at.parent is not None:
            self.at = at.parent

    def handle_data(self, data: str) -> None:
        if not self.hidden:
            self.at.kids.append(data)


def parse(text: str) -> Element:
    builder = _Builder()
    builder.feed(text)
    builder.close()
    return builder.root


def _size(e: Element) -> int:
    return len("".join(e.text().split()))


def main_content(root: Element) -> Element:
    """The first article, main, [role=main], #content or .mw-parser-output with over 80 characters; else the longest container of 200 and more, those mostly of links counting for less, if it still comes to 300; else the body, or all where there is none."""
    wanted = (lambda e: e.tag == "article", lambda e: e.tag == "main", lambda e: e.attributes.get("role") == "main", lambda e: e.attributes.get("id") == "content", lambda e: "mw-parser-output" in e.attributes.get("class", "").split())
    for is_main in wanted:
        for e in root.walk():
            if is_main(e) and _size(e) > MAIN_LEAST:
                return e
    best, most = None, 0.0
    for e in root.walk():
        if e.tag in ("div", "section", "article", "td") and (n := _size(e)) >= BEST_LEAST:
            linked = sum(_size(a) for a in e.walk() if a.tag == "a")
            score = n * (0.3 if linked > n / 2 else 1)
            if score > most:
                best, most = e, score
    return best if best is not None and most >= BEST_ACCEPTED else next((e for e in root.walk() if e.tag == "body"), root)


def _inline(e: Element) -> str:
    out = []
    for k in e.kids:
        if isinstance(k, str):
            out.append(SPACES.sub(" ", k))
            continue
        inner = _inline(k) if k.tag != "code" else k.text()
        said = inner.strip()
        if k.tag == "br":
            out.append("\n")
        elif k.tag == "img":
            out.append(f"![{k.attributes.get('alt', '')}]({k.attributes['src']})" if k.attributes.get("src") else "")
        elif not said:
            out.append(inner)
        elif k.tag == "a" and k.attributes.get("href", "").startswith(("http", "/", "mailto:")):
            out.append(f"[{said}]({k.attributes['href']})")
        else:
            mark = {"b": "**", "strong": "**", "i": "*", "em": "*", "s": "~~", "del": "~~", "code": "`"}.get(k.tag, "")
            out.append(f"{mark}{said}{mark}" if mark else inner)
    return "".join(out)


def _width(text: str) -> int:
    return len(text) + len(re.findall("[ᄀ-ᅟ⺀-꓏가-힣豈-﫿︰-﹏＀-｠￠-￦]", text))


def pipe_table(rows: list[list[str]]) -> str:
    """Cells without line ends and with | escaped, padded to the width of their column, the first row as the head."""
    cells = [[SPACES.sub(" ", c).strip().replace("|", "\\|") for c in r] for r in rows if r]
    if not cells:
        return ""
    columns = max(map(len, cells))
    cells = [r + [""] * (columns - len(r)) for r in cells]
    widths = [max(3, *(_width(r[i]) for r in cells)) for i in range(columns)]
    line = lambda r: "| " + " | ".join(c + " " * (w - _width(c)) for c, w in zip(r, widths, strict=True)) + " |"
    return "\n".join([line(cells[0]), "| " + " | ".join("-" * w for w in widths) + " |", *map(line, cells[1:])])


def _items(e: Element, depth: int) -> list[str]:
    out = []
    for i, item in enumerate([k for k in e.kids if isinstance(k, Element) and k.tag == "li"], 1):
        own = Element("li", {}, None)
        own.kids = [k for k in item.kids if isinstance(k, str) or k.tag not in ("ul", "ol")]
        out.append("  " * depth + (f"{i}. " if e.tag == "ol" else "- ") + SPACES.sub(" ", _inline(own)).strip())
        for k in item.kids:
            if isinstance(k, Element) and k.tag in ("ul", "ol"):
                out += _items(k, depth + 1)
    return out


def _blocks(e: Element) -> list[str]:
    out: list[str] = []
    loose = Element("p", {}, None)

    def flush() -> None:
        if said := "\n".join(" ".join(x.split()) for x in _inline(loose).split("\n")).strip():
            out.append(said)
        loose.kids = []

    for k in e.kids:
        if isinstance(k, str) or k.tag not in BLOCKS and not any(x.tag in BLOCKS for x in k.walk()):
            loose.kids.append(k)
            continue
        flush()
        if re.fullmatch("h[1-6]", k.tag):
            if said := SPACES.sub(" ", _inline(k)).strip():
                out.append("#" * int(k.tag[1]) + " " + said)
        elif k.tag in ("ul", "ol"):
            out.append("\n".join(_items(k, 0)))
        elif k.tag == "pre":
            code = next((x for x in k.walk() if x.tag == "code"), k)
            language = next((c.split("-", 1)[1] for c in code.attributes.get("class", "").split() if c.startswith(("language-", "lang-"))), "")
            out.append(f"```{language}\n{k.text().strip(chr(10))}\n```")
        elif k.tag == "table":
            out.append(pipe_table([[_inline(c) for c in r.kids if isinstance(c, Element) and c.tag in ("td", "th")] for r in k.walk() if r.tag == "tr"]))
        elif k.tag == "blockquote":
            out.append("\n".join("> " + x for x in "\n\n".join(_blocks(k)).split("\n")))
        elif k.tag == "hr":
            out.append("---")
        else:
            out += _blocks(k)
    flush()
    return [x for x in out if x]


def clean(text: str) -> str:
    """F11 in Python, for the texts that are rendered here."""
    for pattern, by in CLEANING:
        text = re.sub(pattern, by.replace("$", "\\"), text)
    return text + "\n" if text else ""


def to_markdown(text: str, whole: bool = False) -> str:
    root = parse(text)
    return clean("\n\n".join(_blocks(root if whole else main_content(root))))


def html_to_markdown(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(id, markdown) of each row; null counts as empty."""

    @F.pandas_udf("string")
    def render(html: pd.Series) -> pd.Series:
        return html.map(lambda x: to_markdown(x or ""))

    return pages.select(id_col, render(F.col(html_col)).alias("markdown"))


class _Titles(HTMLParser):
    """Gathers the text of the first title and the first h1 of a page, wherever they stand."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.said: dict[str, list[str]] = {}
        self.open: list[str] = []

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in ("title", "h1") and tag not in self.said:
            self.said[tag] = []
            self.open.append(tag)

    def handle_endtag(self, tag: str) -> None:
        if tag in self.open:
            self.open.remove(tag)

    def handle_data(self, data: str) -> None:
        for tag in self.open:
            self.said[tag].append(data)


def titles_of(text: str) -> tuple[str, str]:
    """(title, h1) of a page, as F10 cleans them, without spaces at the ends; empty where there is none."""
    parser = _Titles()
    parser.feed(text)
    parser.close()
    return tuple(re.sub(f"{BLANK}+", " ", re.sub(ZERO_WIDTH, "", "".join(parser.said.get(tag, [])))).strip(" ") for tag in ("title", "h1"))


def page_titles(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(id, title, h1) of each row; null html has none."""

    @F.pandas_udf("title string, h1 string")
    def of(html: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([titles_of(x or "") for x in html], columns=["title", "h1"])

    return pages.select(id_col, of(F.col(html_col)).alias("said")).select(id_col, "said.*")
