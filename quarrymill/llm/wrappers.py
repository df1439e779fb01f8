"""HTML extraction by wrappers: same-host token streams, aligned into union-free regular expressions of tags, optional groups, repeated groups and text slots."""

from __future__ import annotations

import hashlib
import html
import json
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrymill.llm.common import materialize

# Comments; elements that only machines read, up to their ends (script and style without one up to the page's, as browsers have it), unless the tag closes itself; declarations; tags; text.
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|svg|iframe|textarea)\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*(?<!/)>.*?</\1\s*>|<(?:script|style)\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*(?<!/)>.*\Z|<[!?][^>]*>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|</?[a-zA-Z][^<>]*\Z|[^<]+|<", re.S | re.I)
MARK = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)

# Elements without content, elements whose start ends another, elements that don't break a block, elements and marks of what isn't the article.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr script style noscript template svg iframe textarea".split())
CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
ENDS_PARAGRAPH = frozenset("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
SCOPES = frozenset("article aside body div footer form header html main nav ol section table td th ul".split())
INLINE = frozenset("a abbr b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
ASIDE_TAGS = frozenset("aside button dialog footer form head header input label menu nav select title".split())
ASIDE_MARKS = frozenset("ad ads advert adverts advertisement advertisements banner breadcrumb breadcrumbs comment comments complementary contentinfo cookie cookies consent disqus footer header menu modal nav navbar navigation newsletter notice notices popup promo promotion related share sharing sidebar social sponsor sponsored subscribe toolbar".split())
# Of marks of several words, what the last one or, before a word for a container, the first one says counts; what only tells that something is there does not.
CONTAINERS = frozenset("area bar block box button buttons container content form group inner item items left links list outer panel posts right section signup slot text thread top unit widget wrap wrapper".split())
TELLING = frozenset("has is no not show with without".split())
MAIN_TAGS, MAIN_MARKS = ("article", "main"), frozenset({"main", "article"})

MAX_DEPTH = 150
MERGE_FAN = 16
BROADCAST_CHARS = 16 << 20


class Node:
    """A part of a wrapper: an element or text slot (key "#"), and whether it may be missing or come again. Of a slot it holds the text while all pages have the same one, the characters seen and the pages that have it."""

    __slots__ = ("key", "kids", "optional", "repeated", "text", "chars", "pages")

    def __init__(self, key: str, kids: list | None = None, optional: bool = False, repeated: bool = False, text: str | None = None, chars: int = 0, pages: int = 1) -> None:
        self.key, self.kids, self.optional, self.repeated, self.text, self.chars, self.pages = key, kids or [], optional, repeated, text, chars, pages

    def packed(self) -> list:
        return [self.key, self.optional, self.repeated, self.text, self.chars, self.pages, [k.packed() for k in self.kids]]

    @staticmethod
    def unpacked(x: list) -> Node:
        return Node(x[0], [Node.unpacked(k) for k in x[6]], x[1], x[2], x[3], x[4], x[5])


def key_of(name: str, attributes: str) -> str:
    """A tag with the marks that tell what it is for; other attributes differ from page to page."""
    marks = [f"{m[1].lower()}={' '.join(sorted((m[2] or m[3] or m[4] or '').lower().split()))}" for m in MARK.finditer(attributes)] if attributes and "=" in attributes else []
    return " ".join([name, *sorted(marks)])


def parse(text: str) -> Node:
    """The tree of a page's token stream. Ends that the page leaves out are put in; ends without a start and what only machines read are left out."""
    root = Node("root")
    # Elements over MAX_DEPTH deep are open by name too, so that their ends end them and none above; what they hold counts as their last ancestor's, but for that of asides, which goes to a node outside the tree. edges are the places in names that implied ends look at.
    stack, names, edges, open_names = [root], ["root"], [], Counter()

    def end(at: int) -> None:
        open_names.subtract(names[at:])
        del names[at:], stack[at:]
        while edges and edges[-1] >= at:
            edges.pop()

    for m in TOKEN.finditer(text):
        name = m[3]
        if name is None:
            if m[0][0] != "<" or m[0] == "<":
                if stack[-1].kids and stack[-1].kids[-1].key == "#":
                    stack[-1].kids[-1].text += m[0]
                else:
                    stack[-1].kids.append(Node("#", text=m[0]))
            continue
        name = name.lower()
        if m[2]:
            if open_names[name] > 0:
                at = len(names) - 1
                while names[at] != name:
                    at -= 1
                end(at)
            continue
        closes = CLOSES.get(name, set()) | ({"p"} if name in ENDS_PARAGRAPH else set())
        if closes:
            for at in reversed(edges):
                if names[at] in closes:
                    end(at)
                    break
                if names[at] in SCOPES:
                    break
        node = Node(key_of(name, m[4]))
        stack[-1].kids.append(node)
        if name not in VOID and not m[4].endswith("/"):
            if name in CLOSES or name in SCOPES:
                edges.append(len(names))
            stack.append(node if len(stack) < MAX_DEPTH or _is_aside(node.key) else stack[-1])
            if len(stack) > MAX_DEPTH and stack[-1] is node:
                stack[-2].kids.pop()
            names.append(name)
            open_names[name] += 1
    return root


def _joined(a: Node, b: Node, one_page: bool = False) -> Node:
    """The wrapper of what either of two of one key may hold, in two sets of pages or twice in the same ones."""
    pages = max(a.pages, b.pages) if one_page else a.pages + b.pages
    if a.key == "#":
        return Node("#", None, a.optional or b.optional, a.repeated or b.repeated, a.text if a.text == b.text else None, a.chars + b.chars, pages)
    return Node(a.key, aligned(a.kids, b.kids, one_page), a.optional or b.optional, a.repeated or b.repeated, pages=pages)


def folded(kids: list[Node]) -> list[Node]:
    """Siblings one after another of one key become one repeated group."""
    out: list[Node] = []
    for k in kids:
        if out and out[-1].key == k.key:
            out[-1] = _joined(out[-1], k, True)
            out[-1].repeated = True
        else:
            out.append(k)
    return _squared(out)


def _squared(kids: list[Node]) -> list[Node]:
    """Pairs of siblings that come again at once (such as dt and dd) become repeated too."""
    out: list[Node] = []
    for k in kids:
        if len(out) >= 3 and out[-1].key != k.key and out[-2].key == k.key and out[-3].key == out[-1].key:
            last = out.pop()
            out[-2], out[-1] = _joined(out[-2], last, True), _joined(out[-1], k, True)
            out[-2].repeated = out[-1].repeated = True
        else:
            out.append(k)
    return out


def expression(node: Node) -> Node:
    """A page as a wrapper of its own: text as slots with a digest of what they hold, repeats folded."""
    if node.key == "#":
        said = " ".join(html.unescape(node.text).split())
        return Node("#", text=said if len(said) <= 40 else f"{hash_of(said)}", chars=len(said))
    kids = [expression(k) for k in node.kids if k.key != "#" or not k.text.isspace()]
    return Node(node.key, folded(kids))


def hash_of(text: str) -> str:
    return hashlib.md5(text.encode("utf-8", "replace")).hexdigest()[:16]


def aligned(a: list[Node], b: list[Node], one_page: bool = False) -> list[Node]:
    """One list of both: what stands in both by key is joined in order (a longest common subsequence), what stands in one becomes optional; then repeats are folded."""
    if [x.key for x in a] == [x.key for x in b]:
        return [_joined(x, y, one_page) for x, y in zip(a, b, strict=True)]
    n, m = len(a), len(b)
    longest = [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(n - 1, -1, -1):
        for j in range(m - 1, -1, -1):
            longest[i][j] = longest[i + 1][j + 1] + 1 if a[i].key == b[j].key else max(longest[i + 1][j], longest[i][j + 1])
    out, i, j = [], 0, 0
    while i < n or j < m:
        if i < n and j < m and a[i].key == b[j].key:
            out.append(_joined(a[i], b[j], one_page))
            i, j = i + 1, j + 1
        elif j == m or i < n and longest[i + 1][j] >= longest[i][j + 1]:
            a[i].optional = True
            out.append(a[i])
            i += 1
        else:
            b[j].optional = True
            out.append(b[j])
            j += 1
    return folded(out)


def regular_expression(node: Node) -> str:
    """A wrapper written out, # for a text slot."""
    inner = "".join(regular_expression(k) for k in node.kids)
    said = ("#" if node.text is None else repr(node.text)) if node.key == "#" else f"<{node.key}>{inner}</{node.key.split(' ')[0]}>"
    return f"({said})" + ("*" if node.optional and node.repeated else "?" if node.optional else "+") if node.optional or node.repeated else said


def _says(mark: str) -> str:
    """The aside that a word of a class, id or role names; empty for none."""
    first, *rest = [x for x in re.split(r"[_-]+", mark) if x] or [""]
    if not rest:
        return first if first in ASIDE_MARKS else ""
    if first in TELLING:
        return ""
    return rest[-1] if rest[-1] in ASIDE_MARKS else first if first in ASIDE_MARKS and rest[-1] in CONTAINERS else ""


def _aside(key: str) -> str:
    """What of the page an element is, if it is none of its article: header, form or aside; empty for none."""
    name, *marks = key.split(" ")
    if name in ("html", "body", "main", "article"):
        return ""
    said = {_says(m.split("=", 1)[-1]) for m in marks} - {""}
    if name in ASIDE_TAGS - {"header", "form"} or said - {"header"}:
        return "aside"
    return "form" if name == "form" else "header" if name == "header" or said else ""


def _is_aside(key: str) -> bool:
    return _aside(key) != ""


def _is_main(key: str, name: str) -> bool:
    parts = key.split(" ")
    return parts[0] == name or f"role={name}" in parts or f"id={name}" in parts


def _marked(node: Node, name: str, anywhere: bool) -> list[Node]:
    if _is_main(node.key, name):
        return [node]
    return [] if _is_aside(node.key) and not anywhere else [x for k in node.kids for x in _marked(k, name, anywhere)]


class _Met:
    """The elements or texts of a page that one part of the wrapper stands for, with the mean characters of that part's slots in a page: those that change from page to page, and all."""

    __slots__ = ("key", "nodes", "kids", "changing", "chars")

    def __init__(self, model: Node, nodes: list[Node]) -> None:
        self.key, self.nodes, self.kids, self.changing, self.chars = model.key, nodes, [], 0.0, 0.0
        if model.key == "#":
            self.chars = model.chars / model.pages
            # A text of one page isn't known to be the same in others.
            self.changing = self.chars if model.text is None or model.pages == 1 else 0.0
        elif not _is_aside(model.key):
            held: dict[int, list[Node]] = {}
            for node in nodes:
                at = 0
                for k in node.kids:
                    if k.key == "#" and k.text.isspace():
                        continue
                    found = next((i for i in [*range(at, len(model.kids)), *range(at)] if model.kids[i].key == k.key), None)
                    if found is not None:
                        at = found
                        held.setdefault(found, []).append(k)
            self.kids = [_Met(model.kids[i], x) for i, x in sorted(held.items())]
            self.changing, self.chars = sum(k.changing for k in self.kids), sum(k.chars for k in self.kids)


def changing_parts(at: _Met) -> list[Node]:
    """The deepest element of a page that holds most of the text that changes among its host's pages, by the parts of the wrapper that this page has, so that other layouts of the host have no say. Where nothing changes, all text counts."""
    weight = (lambda x: x.changing) if at.changing else (lambda x: x.chars)
    while True:
        best = max((k for k in at.kids if k.key != "#" and not _is_aside(k.key)), key=weight, default=None)
        if best is None or best.key.split(" ")[0] in {"p", "li", "td", "h1", "h2", "h3"} | INLINE or weight(best) * 10 < weight(at) * 7:
            return at.nodes
        at = best


def article_text(page: Node, wrapper: Node) -> str:
    """The text of a page's article: of all its article elements, or its main elements; where it has none with text, of changing_parts.

    Left out are menus, footers, adverts and the like within it (by tags and marks), and headers but those of articles and main elements.
    Nothing is left out because other pages of the host say the same, so a page gives one text beside any number of others of its layout.
    """
    for name, anywhere in [(n, a) for a in (False, True) for n in MAIN_TAGS]:
        if (chosen := _marked(page, name, anywhere)) and (said := _text_of(page, chosen, True)):
            return said
    return _text_of(page, changing_parts(_Met(wrapper, [page])), False)


def _whole_forms(page: Node) -> set[int]:
    """The forms that hold over half of a page's text, which are the page and not a part of it to fill in."""
    sizes: dict[int, int] = {}
    forms: list[Node] = []

    def size(node: Node) -> int:
        if node.key == "#":
            return len(node.text.strip())
        sizes[id(node)] = 0 if node.key.split(" ")[0] in ASIDE_TAGS - {"form", "header"} else sum(map(size, node.kids))
        if node.key.split(" ")[0] == "form":
            forms.append(node)
        return sizes[id(node)]

    whole = size(page)
    return {id(f) for f in forms if 2 * sizes[id(f)] > whole}


def _text_of(page: Node, chosen: list[Node], own_headers: bool) -> str:
    blocks: list[str] = []
    open_block: list[str] = []
    starts, forms = set(map(id, chosen)), _whole_forms(page)

    def kept(node: Node) -> bool:
        kind = _aside(node.key)
        return not kind or kind == "header" and own_headers or kind == "form" and id(node) in forms

    def flush() -> None:
        if said := " ".join(html.unescape("".join(open_block)).split()):
            blocks.append(said)
        open_block.clear()

    def walk(node: Node, inside: bool) -> None:
        for k in node.kids:
            if k.key == "#":
                if inside:
                    open_block.append(k.text)
                continue
            breaks = k.key.split(" ")[0] not in INLINE
            if breaks:
                flush()
            walk(k, id(k) in starts or (inside and kept(k)))
            if breaks:
                flush()

    walk(page, id(page) in starts)
    flush()
    return " ".join(blocks)


def _host():
    return F.coalesce(F.lower(F.regexp_extract("url", r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]*)", 1)), F.lit(""))


def _fold(wrappers: list[Node]) -> Node:
    """Aligned pairwise, neighbours first, so that the order of the pages matters little."""
    while len(wrappers) > 1:
        wrappers = [_joined(*wrappers[i : i + 2]) if i + 1 < len(wrappers) else wrappers[i] for i in range(0, len(wrappers), 2)]
    return wrappers[0]


def infer_wrappers(pages: DataFrame) -> DataFrame:
    """(host, wrapper, pages) of pages (host, html): each task aligns its pages by host, then the tasks' wrappers are aligned MERGE_FAN ways and then by host. A wrapper's size follows the layout, not the number of pages, so a host of very many pages is no burden for one task."""

    def of_task(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[str, list[Node]] = {}
        seen: dict[str, int] = {}
        for frame in frames:
            for host, text in zip(frame["host"], frame["html"], strict=True):
                # Folded as they come, like carries of a binary counter: a host has at most log2(pages) wrappers here.
                stack, n = held.setdefault(host, []), seen.get(host, 0) + 1
                stack.append(expression(parse(text)))
                seen[host] = n
                while n % 2 == 0:
                    last = stack.pop()
                    stack[-1], n = _joined(stack[-1], last), n // 2
        part = TaskContext.get().partitionId() % MERGE_FAN
        yield pd.DataFrame([(h, part, json.dumps(_fold(w).packed()), seen[h]) for h, w in held.items()], columns=["host", "part", "wrapper", "pages"])

    def merge(rows: pd.DataFrame) -> tuple[str, int]:
        ordered = sorted(rows["wrapper"])
        return json.dumps(_fold([Node.unpacked(json.loads(w)) for w in ordered]).packed()), int(rows["pages"].sum())

    local = pages.select("host", "html").mapInPandas(of_task, "host string, part int, wrapper string, pages long")
    some = local.groupBy("host", "part").applyInPandas(lambda key, rows: pd.DataFrame([(key[0], *merge(rows))], columns=["host", "wrapper", "pages"]), "host string, wrapper string, pages long")

    def last(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        packed, n = merge(rows)
        return pd.DataFrame([(key[0], packed, n)], columns=["host", "wrapper", "pages"])

    return some.groupBy("host").applyInPandas(last, "host string, wrapper string, pages long")


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text) for each row: the main text, by the marks of the page itself or else by its host's wrapper, so that a host may have any number of layouts.

    Character references are decoded, white space within a block becomes one space, blocks are joined by one space in page order.
    Null html counts as empty and gives an empty text; rows with a null or odd url share one host; a host of one page has that page as
    its wrapper; repeated rows are extracted each. Elements nested over MAX_DEPTH deep count as part of the last one above, but asides there are left out as anywhere.
    """
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("html")).withColumn("host", _host())
    wrappers = materialize(infer_wrappers(rows))
    if (wrappers.agg(F.sum(F.length("wrapper"))).first()[0] or 0) <= BROADCAST_CHARS:
        joined = rows.join(F.broadcast(wrappers.select("host", "wrapper")), "host")
    else:
        salted = wrappers.select("host", "wrapper", F.explode(F.sequence(F.lit(0), F.lit(MERGE_FAN - 1))).alias("salt"))
        joined = rows.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(MERGE_FAN)).cast("int")).join(salted, ["host", "salt"])
    schema = f"page_id {pages.schema[id_col].dataType.simpleString()}, url string, text string"

    def apply(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[str, Node] = {}
        for frame in frames:
            if len(known) > 2_000:
                known.clear()
            out = []
            for host, text, wrapper in zip(frame["host"], frame["html"], frame["wrapper"], strict=True):
                if host not in known:
                    known[host] = Node.unpacked(json.loads(wrapper))
                out.append(article_text(parse(text), known[host]))
            yield pd.DataFrame({"page_id": frame["page_id"], "url": frame["url"], "text": out})

    return joined.select("page_id", "url", "host", "html", "wrapper").mapInPandas(apply, schema)
