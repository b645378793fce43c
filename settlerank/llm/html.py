"""Main text of web pages by scoring the tree of elements.

The markup is read leniently into a tree (unclosed paragraphs and list items end where a block begins, unknown closing
tags are ignored, an unclosed element ends with its parent). Elements that never hold main text (menus, headers,
footers, asides, forms, scripts, ...) are left out, as are those whose class, id or role names one of these (adverts,
notices, reader comments, ...). Each paragraph gives points for its length and its commas to its parent and half of
them to its grandparent; a container's points are discounted by its link density. The main text is all of the article or
main element around the best container, without blocks beside that container which are mostly links, and what lies beside
that element and scores well or is prose or a heading. Where there is no such element, it is the outermost container around
the best one that is no list of links, and all beside it but blocks of links.

A null, empty or wordless page gives an empty text. Repeated rows each get a row; ties go to the container that comes
first. Nothing is cut: a very long page is one string of one row. Clashing columns do not matter: the operator reads
id, url and html only.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from settlerank.llm.arrays import parts, plain

#: Nothing here is read again: a failed tag ends at the next ``<``, and a quote without a partner is a letter like others.
_MARKUP = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|"
                     r"<(/?)([a-zA-Z][^\s/><]*+)((?:[^<>\"']++|\"[^\"]*+\"|'[^']*+'|[\"'])*+)(?:>|\Z)", re.DOTALL)
_ATTRIBUTE = re.compile(r"(class|id|role|hidden|aria-hidden)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
_BLANK = re.compile(r"\s+")

# Names of HTML elements and words that sites use in class names.
_RAW = {"script", "style", "textarea", "title", "noscript", "template", "iframe", "svg", "math", "xmp", "noembed",
        "noframes"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_BLOCK = {"address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "dir",
          "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6",
          "head", "header", "hgroup", "hr", "html", "legend", "li", "main", "menu", "nav", "ol", "p", "pre", "section",
          "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul"}
_NEVER = {"head", "nav", "footer", "aside", "form", "button", "select", "option", "menu", "dialog", "fieldset", "canvas",
          "object", "audio", "video", "label", "input"}
_PARAGRAPH = {"p", "pre", "td", "blockquote", "li", "dd", "figcaption", "h1", "h2", "h3", "h4", "h5", "h6"}
_HEADING = {"h1", "h2", "h3", "h4", "h5", "h6"}
_ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
         "th": {"td", "th"}, "option": {"option"}}
_NAMED = re.compile(
    r"(?:^|[\s_-])(?:ad|ads|advert|adverts|advertisement|advertising|banner|sponsor|sponsored|promo|promotion|comment|"
    r"comments|commentlist|disqus|cookie|cookies|consent|gdpr|notice|notices|alert|popup|modal|overlay|newsletter|"
    r"subscribe|subscription|sidebar|side-bar|rail|widget|widgets|menu|nav|navbar|navigation|breadcrumb|breadcrumbs|"
    r"footer|header|masthead|topbar|toolbar|share|sharing|social|related|recommended|pagination|pager|login|signup|"
    r"search|tags|skip|respond|replies|reactions|complementary|contentinfo|banner|dialog|form)(?:$|[\s_-])", re.I)
#: Link density from which a block beside the main text is no part of it.
_LINKED = 0.25
_HEADER = re.compile(r"(?:^|(?<=[_-]))header(?=$|[_-])", re.I)
_BODY = re.compile(r"(?:^|[\s_-])(?:article|content|main|body|post|entry|story|text)(?:$|[\s_-])", re.I)
_SCOPE = {"table", "td", "th", "body", "html", "article", "section", "main", "div", "aside", "nav", "header", "footer",
          "form", "blockquote", "figure", "details"}


class Node:
    __slots__ = ("tag", "parent", "children", "dropped", "score", "weight")

    def __init__(self, tag: str, parent: Node | None, dropped: bool = False, weight: float = 0.0):
        self.tag, self.parent, self.dropped, self.weight = tag, parent, dropped, weight
        self.children: list[Node | str] = []
        self.score = None


def _unwanted(value: str, inside: bool) -> bool:
    """Whether a class or id names a part that is no text of the article.

    A name by itself does (``comments``), and so does one in a longer word (``post-comments``), unless another word names the text alone
    (``content has-sidebar``). The header of a part inside the article belongs to it (``entry-header``).
    """
    words = value.split()
    named = [w for w in words if _NAMED.search(w)]
    if any(_NAMED.fullmatch(w) for w in named):
        return True
    if any(_BODY.search(w) for w in words if w not in named):
        return False
    return any(not (inside and _BODY.search(w) and not _NAMED.search(_HEADER.sub("", w))) for w in named)


def _named(tag: str, attributes: str, inside: bool = False) -> tuple[bool, float]:
    """Whether an element is left out for its attributes, and its head start. ``inside``: of an article or main element."""
    weight = 25.0 if tag in ("article", "main") else 0.0
    if not attributes or tag in ("html", "body"):
        return False, weight
    dropped = False
    for m in _ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name == "hidden" or name == "aria-hidden" and value == "true":
            dropped = True
        elif name in ("class", "id", "role") and tag not in ("article", "main"):
            if _unwanted(value, inside) if name != "role" else _NAMED.search(value):
                dropped = True
            elif _BODY.search(value):
                weight = max(weight, 15.0)
        elif name in ("class", "id") and _BODY.search(value):
            weight = max(weight, 15.0)
    return dropped, weight


class _Open:
    """How often each tag is open, in the whole page and since the last element that inline tags do not reach over."""

    def __init__(self):
        self.tags: Counter = Counter()
        self.scopes: list[Counter] = [Counter()]

    def enter(self, node: Node) -> Node:
        self.tags[node.tag] += 1
        if node.tag in _SCOPE:
            self.scopes.append(Counter())
        self.scopes[-1][node.tag] += 1
        return node

    def leave(self, node: Node, to: Node) -> Node:
        """Everything from ``node`` up to its ancestor ``to`` is closed; each element is once in its life."""
        while node is not to:
            self.tags[node.tag] -= 1
            self.scopes[-1][node.tag] -= 1
            if node.tag in _SCOPE:
                self.scopes.pop()
            node = node.parent
        return to

    def can_close(self, tag: str) -> bool:
        return (self.tags if tag in _BLOCK else self.scopes[-1])[tag] > 0


def parse(page: str) -> Node:
    root = Node("#root", None)
    node, at, size, held = root, 0, len(page), _Open()
    while at < size:
        m = _MARKUP.search(page, at)
        start = m.start() if m else size
        if start > at:
            node.children.append(page[at:start])
        if not m:
            break
        at = m.end()
        tag = m[2]
        if tag is None:
            continue
        tag = tag.lower()
        if m[1]:
            if held.can_close(tag):
                node = held.leave(node, _close(node, tag))
            continue
        if tag in _BLOCK and held.scopes[-1]["p"]:
            node = held.leave(node, _open_paragraph(node))
        if tag in _ENDS and any(held.tags[t] for t in _ENDS[tag]):
            node = held.leave(node, _end_before(node, _ENDS[tag]))
        inside = held.tags["article"] + held.tags["main"] > 0
        dropped, weight = _named(tag, m[3], inside)
        child = Node(tag, node, dropped or tag in _NEVER or tag in _RAW or tag == "header" and not inside, weight)
        node.children.append(child)
        if tag in _RAW:
            end = re.compile(f"</{re.escape(tag)}[\\s/>]", re.I).search(page, at)
            close = page.find(">", end.start()) if end else -1
            at = close + 1 if close >= 0 else size
        elif tag not in _VOID and (not m[3].endswith("/") or tag in _BLOCK):
            node = held.enter(child)
    return root


def _open_paragraph(node: Node) -> Node:
    """A block ends a paragraph that is open, with the inline elements in it."""
    up = node
    while up.parent is not None and up.tag not in _SCOPE and up.tag not in ("li", "dd", "dt", "#root"):
        if up.tag == "p":
            return up.parent
        up = up.parent
    return node


def _end_before(node: Node, tags: set) -> Node:
    up = node
    while up.parent is not None and up.tag not in ("ul", "ol", "dl", "table", "menu", "select", "#root"):
        if up.tag in tags:
            return up.parent
        up = up.parent
    return node


def _close(node: Node, tag: str) -> Node:
    up = node
    while up.parent is not None:
        if up.tag == tag:
            return up.parent
        if up.tag in _SCOPE and tag not in _BLOCK:
            return node                     # an inline closing tag does not end a block
        up = up.parent
    return node


def _measure(root: Node) -> dict[int, tuple[int, int, int]]:
    """Characters, linked characters and commas of the text below every kept element, without recursion."""
    found: dict[int, tuple[int, int, int]] = {}
    stack = [(root, False, False)]
    while stack:
        node, linked, done = stack.pop()
        linked = linked or node.tag == "a"
        if not done:
            stack.append((node, linked, True))
            stack.extend((c, linked, False) for c in node.children if isinstance(c, Node) and not c.dropped)
            continue
        chars = links = commas = 0
        for c in node.children:
            if isinstance(c, str):
                n = len(" ".join(c.split()))
                chars, commas = chars + n, commas + c.count(",")
                links += n if linked else 0
            elif not c.dropped:
                a, b, d = found[id(c)]
                chars, links, commas = chars + a, links + b, commas + d
        found[id(node)] = (chars, links, commas)
    return found


def _nodes(root: Node) -> Iterator[Node]:
    stack = [root]
    while stack:
        node = stack.pop()
        yield node
        stack.extend(c for c in reversed(node.children) if isinstance(c, Node) and not c.dropped)


def _blocks(tops: list[Node]) -> list[str]:
    """Texts of the blocks below some elements, in page order."""
    blocks: list[str] = []
    now: list[str] = []

    def end():
        text = _BLANK.sub(" ", entities.unescape("".join(now))).strip()
        if text:
            blocks.append(text)
        now.clear()

    for top in tops:
        stack: list = [top]
        while stack:
            item = stack.pop()
            if item is None:
                end()
            elif isinstance(item, str):
                now.append(item)
            elif item.tag == "br":
                now.append(" ")
            elif not item.dropped:
                block = item.tag in _BLOCK or item is top
                if block:
                    end()
                    stack.append(None)
                stack.extend(reversed(item.children))
        end()
    return blocks


def main_text(page: str | None) -> str:
    """The main text of one page, blocks joined by line feeds."""
    if not page:
        return ""
    root = parse(page)
    sizes = _measure(root)
    if not sizes[id(root)][0]:
        return ""

    def density(node: Node) -> float:
        chars, links, _ = sizes[id(node)]
        return links / chars if chars else 0.0

    scored: list[Node] = []

    def give(node: Node | None, points: float) -> None:
        if node is not None:
            if node.score is None:
                node.score = node.weight
                scored.append(node)
            node.score += points

    for node in _nodes(root):
        loose = node.tag not in _PARAGRAPH and any(isinstance(c, str) and not c.isspace() for c in node.children) \
            and node.tag in _BLOCK or node is root and any(isinstance(c, str) and not c.isspace() for c in node.children)
        if loose:                           # text straight in a container is a paragraph of it
            texts = " ".join(c for c in node.children if isinstance(c, str))
            give(node, 1 + texts.count(",") + min(len(texts) / 100, 3))
        elif node.tag in _PARAGRAPH:
            chars, _, commas = sizes[id(node)]
            if chars:
                points = (1 + commas + min(chars / 100, 3)) * (1 - density(node))
                give(node.parent, points)
                give(node.parent.parent if node.parent else None, points / 2)
    if not scored:
        return "\n".join(_blocks([root]))
    order = {id(n): i for i, n in enumerate(_nodes(root))}
    value = {id(n): n.score * (1 - density(n)) for n in scored}
    best = max(scored, key=lambda n: (value[id(n)], -order[id(n)]))
    if best.parent is None:
        return "\n".join(_blocks([best]))
    least = max(10.0, value[id(best)] * 0.2)

    def well(node: Node) -> bool:
        chars = sizes[id(node)][0]
        prose = node.tag == "p" and (chars > 80 and density(node) < _LINKED or 0 < chars <= 80 and not density(node))
        return value.get(id(node), 0) >= least or prose or node.tag in _HEADING and density(node) < _LINKED

    def drop_links_beside(node: Node) -> None:
        """Links within loose text are part of it."""
        loose = any(isinstance(c, str) and not c.isspace() for c in node.parent.children)
        for c in node.parent.children:
            if isinstance(c, Node) and not c.dropped and c is not node and (c.tag in _BLOCK or not loose):
                c.dropped = density(c) >= _LINKED and not well(c)

    whole = best
    while whole is not None and whole.tag not in ("article", "main"):
        whole = whole.parent
    node = best
    if whole is None:
        while node.parent.tag not in ("body", "html", "#root") and density(node.parent) < _LINKED:
            drop_links_beside(node)
            node = node.parent
        drop_links_beside(node)
        return "\n".join(_blocks([node.parent]))
    while node is not whole:
        drop_links_beside(node)
        node = node.parent
    kept = [c for c in whole.parent.children if isinstance(c, Node) and not c.dropped and (c is whole or well(c))]
    return "\n".join(_blocks(kept))


def extract_main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url",
                      html_col: str = "html") -> DataFrame:
    """id, url, text and n_chars (code points) of every row. One pass, no shuffle."""
    kinds = dict(pages.dtypes)

    def extract(batches):
        for batch in parts(batches, 100):
            texts = [main_text(p) for p in plain(batch.column(2)).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()),
                 pa.array([len(t) for t in texts], pa.int64())], ["_id", "_url", "text", "n_chars"])

    rows = pages.select(pages[id_col].alias("_id"), pages[url_col].alias("_url"), pages[html_col].alias("_html"))
    out = rows.mapInArrow(extract, f"_id {kinds[id_col]}, _url {kinds[url_col]}, text string, n_chars long")
    return out.withColumnsRenamed({"_id": id_col, "_url": url_col})
