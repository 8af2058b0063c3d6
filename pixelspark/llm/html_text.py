"""HTML extraction: a tree builder with implied tags, visibility rules, and a layout of text.

The builder keeps the open elements on a stack and closes what a new tag implies (a paragraph
before a block, a list item before the next, cells and rows of a table).  The renderer walks the
tree: inline text flows and its white space collapses, blocks start lines, some blocks have blank
lines around them, list items get markers and hang, table cells are padded into columns.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator
from html import unescape
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Element classes of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = frozenset("head title script style template noscript iframe object audio video canvas datalist noembed noframes".split())
RAW = frozenset("script style textarea title noscript iframe noembed noframes xmp".split())
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li listing main menu nav ol optgroup option p pre search section summary table ul caption tr td th tbody thead tfoot".split()
)
SPACED = frozenset("blockquote dl figure h1 h2 h3 h4 h5 h6 hr menu ol p pre table ul fieldset".split())
CLOSES_P = BLOCKS - frozenset("body html dd dt li option optgroup caption tr td th tbody thead tfoot legend".split()) | frozenset("dd dt li".split())

# What an opening tag closes, up to the elements that bound the search.
_LISTS = frozenset("ul ol menu dir dl table td th body".split())
_TABLE = frozenset(["table", "body"])
IMPLIED: dict[str, tuple[frozenset, frozenset]] = {
    "li": (frozenset(["li"]), _LISTS),
    "dt": (frozenset(["dt", "dd"]), _LISTS),
    "dd": (frozenset(["dt", "dd"]), _LISTS),
    "option": (frozenset(["option"]), frozenset(["select", "datalist", "body"])),
    "optgroup": (frozenset(["option", "optgroup"]), frozenset(["select", "body"])),
    "td": (frozenset(["td", "th"]), frozenset(["tr", "table", "body"])),
    "th": (frozenset(["td", "th"]), frozenset(["tr", "table", "body"])),
    "tr": (frozenset(["tr", "td", "th", "caption", "colgroup"]), _TABLE),
    "tbody": (frozenset(["tbody", "thead", "tfoot", "tr", "td", "th", "caption", "colgroup"]), _TABLE),
    "thead": (frozenset(["tbody", "thead", "tfoot", "tr", "td", "th", "caption", "colgroup"]), _TABLE),
    "tfoot": (frozenset(["tbody", "thead", "tfoot", "tr", "td", "th", "caption", "colgroup"]), _TABLE),
    "body": (frozenset(["head"]), frozenset(["body"])),
}
#: End tags do not reach through these.
BARRIERS = frozenset(["table", "td", "th", "caption"])

_TAG = re.compile(r"""<(/?)([A-Za-z][^\s/><]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>""")
_ATTR = re.compile(r"""([^\s=/"'>]++)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s"'>]++)))?""")
_GONE = re.compile(r"(?:^|[;\s])display\s*:\s*none", re.I)
_VISIBILITY = re.compile(r"(?:^|[;\s])visibility\s*:\s*(visible|hidden|collapse)", re.I)
_SPACE = re.compile(r"[ \t\n\r\f]+")
_WATCHED = re.compile(r"hidden|style|colspan|rowspan|start|open|type", re.I)


class Node:
    __slots__ = ("attrs", "children", "tag")

    def __init__(self, tag: str, attrs: dict[str, str]):
        self.tag, self.attrs, self.children = tag, attrs, []


def _attributes(source: str) -> dict[str, str]:
    if not source or not _WATCHED.search(source):
        return {}
    return {m[1].lower(): unescape(m[2] or m[3] or m[4] or "") for m in _ATTR.finditer(source)}


def build(html: str) -> Node:
    """The tree of a page; children are nodes and strings (entities decoded)."""
    root = Node("body", {})
    stack = [root]
    at, n = 0, len(html)
    while at < n:
        lt = html.find("<", at)
        if lt < 0:
            lt = n
        if lt > at:
            stack[-1].children.append(unescape(html[at:lt]))
        if lt == n:
            break
        if html.startswith("<!--", lt):
            end = html.find("-->", lt + 4)
            at = n if end < 0 else end + 3
            continue
        follows = html[lt + 1 : lt + 2]
        if follows in ("!", "?"):
            end = html.find(">", lt)
            at = n if end < 0 else end + 1
            continue
        m = _TAG.match(html, lt)
        if not m:
            if follows == "/" or follows.isalpha():  # an unfinished tag, or one with an open quote
                end = html.find(">", lt)
                at = n if end < 0 else end + 1
            else:
                stack[-1].children.append("<")
                at = lt + 1
            continue
        at = m.end()
        tag = m[2].lower()
        if m[1]:
            if tag == "br":
                stack[-1].children.append(Node("br", {}))
            elif tag == "p" and not any(x.tag == "p" for x in stack):
                stack[-1].children.append(Node("p", {}))
            else:
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i].tag == tag:
                        del stack[i:]
                        break
                    if stack[i].tag in BARRIERS and tag not in ("table", "tr", "tbody", "thead", "tfoot"):
                        break
            continue
        if tag in ("html", "body") and len(stack) > 1 and tag == "html":
            continue
        if tag in IMPLIED:
            closes, bounds = IMPLIED[tag]
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag in closes:
                    del stack[i:]
                    if tag not in ("tr", "tbody", "thead", "tfoot"):
                        break
                elif stack[i].tag in bounds:
                    break
        if tag in CLOSES_P:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == "p":
                    del stack[i:]
                    break
                if stack[i].tag in BLOCKS:
                    break
        if tag in ("td", "th") and stack[-1].tag in ("table", "tbody", "thead", "tfoot"):
            row = Node("tr", {})
            stack[-1].children.append(row)
            stack.append(row)
        node = Node(tag, _attributes(m[3]))
        stack[-1].children.append(node)
        if tag in VOID or m[3].endswith("/") and tag in ("svg", "path", "g"):
            continue
        if tag in RAW:
            close = re.compile(rf"</{tag}(?=[\s/>])", re.I).search(html, at)
            body = html[at : close.start()] if close else html[at:]
            if tag in ("textarea", "title", "xmp"):
                node.children.append(unescape(body))
            end = html.find(">", close.start()) if close else -1
            at = n if end < 0 else end + 1
            continue
        stack.append(node)
    return root


def apply_visibility(root: Node) -> None:
    """Takes out what ``visibility`` hides: the text of hidden elements, but not elements in them that are visible again.

    Unlike ``display: none`` it is inherited and may be turned back, and what it hides keeps its place: list
    items count and table cells hold their column.
    """
    stack = [(root, False)]
    while stack:
        node, hidden = stack.pop()
        kept = []
        for child in node.children:
            if isinstance(child, str):
                if not hidden:
                    kept.append(child)
                continue
            said = _VISIBILITY.findall(child.attrs.get("style") or "")
            off = said[-1].lower() != "visible" if said else hidden
            if not (off and child.tag in ("br", "hr")):
                kept.append(child)
            stack.append((child, off))
        node.children[:] = kept


def visible(node: Node) -> bool:
    if node.tag in HIDDEN:
        return False
    attrs = node.attrs
    if not attrs:
        return node.tag != "dialog"
    if "hidden" in attrs or node.tag == "dialog" and "open" not in attrs:
        return False
    return not (attrs.get("style") and _GONE.search(attrs["style"]))


class Flow:
    """Lines of text; inline text joins the last line, white space collapses."""

    __slots__ = ("blank", "fresh", "line", "lines", "space")

    def __init__(self) -> None:
        self.lines: list[str] = []
        self.line: list[str] = []
        self.space = False  # white space is due before the next text
        self.blank = False  # a blank line is due before the next line
        self.fresh = True

    def text(self, s: str) -> None:
        words = _SPACE.sub(" ", s).replace("\xa0", " ")
        if words == " " or not words:
            self.space = self.space or bool(words)
            return
        if words[0] == " ":
            self.space = True
            words = words[1:]
        if self.line:
            if self.space:
                self.line.append(" ")
        elif self.blank and self.lines:
            self.lines.append("")
        self.blank = False
        self.space = words[-1] == " "
        self.line.append(words[:-1] if self.space else words)

    def end_line(self) -> None:
        if self.line:
            self.lines.append("".join(self.line).rstrip())
            self.line = []
        self.space = False

    def line_break(self) -> None:
        if self.line:
            self.end_line()
        elif self.lines:
            self.blank = True

    def put(self, lines: list[str], spaced: bool) -> None:
        self.end_line()
        if not lines:
            return
        if (self.blank or spaced) and self.lines:
            self.lines.append("")
        self.lines += lines
        self.blank = spaced

    def done(self) -> list[str]:
        self.end_line()
        return self.lines


def _int(value: str | None, default: int) -> int:
    try:
        return int(value) if value else default
    except ValueError:
        return default


def _span(value: str | None) -> int:
    return max(1, min(1000, _int(value, 1)))


def _cells(table: Node) -> tuple[list[list[str]], list[list[tuple[int, Node]]]]:
    """Captions as lines, and for each row (column, cell), spans taken into account."""
    captions, rows, taken = [], [], {}

    def walk(node: Node) -> None:
        for child in node.children:
            if isinstance(child, str) or not visible(child):
                continue
            if child.tag == "tr":
                row, column = [], 0
                for cell in child.children:
                    if isinstance(cell, str):
                        if cell.strip():  # shown before the table
                            captions.append([_SPACE.sub(" ", cell).strip()])
                        continue
                    if not visible(cell):
                        continue
                    while taken.get(column, 0) > 0:
                        column += 1
                    row.append((column, cell))
                    for c in range(column, column + _span(cell.attrs.get("colspan"))):
                        taken[c] = max(taken.get(c, 0), _span(cell.attrs.get("rowspan")))
                    column += _span(cell.attrs.get("colspan"))
                for c in taken:
                    taken[c] -= 1
                rows.append(row)
            elif child.tag in ("tbody", "thead", "tfoot"):
                walk(child)
            elif child.tag not in ("colgroup", "col"):
                captions.append(layout(child))
        for child in node.children:
            if isinstance(child, str) and child.strip():
                captions.append([_SPACE.sub(" ", child).strip()])

    walk(table)
    return captions, rows


def _table(table: Node) -> list[str]:
    captions, rows = _cells(table)
    filled = [[(c, layout(cell), _span(cell.attrs.get("colspan"))) for c, cell in row] for row in rows]
    width: dict[int, int] = {}
    for row in filled:
        for c, lines, span in row:
            if span == 1:
                width[c] = max(width.get(c, 0), max(map(len, lines), default=0))
    out = [line for lines in captions for line in lines]
    last = max((c for row in filled for c, _, _ in row), default=0)
    left_of = list(accumulate((width.get(k, 0) + 2 for k in range(last)), initial=0))
    for row in filled:
        for i in range(max((len(lines) for _, lines, _ in row), default=0)):
            line, at = "", 0
            for c, lines, _ in row:
                left = left_of[c]
                text = lines[i] if i < len(lines) else ""
                if text:
                    line = line.ljust(left) if len(line) <= left else line + "  "
                    line += text
            out.append(line.rstrip())
    return out


def _marked(lines: list[str], marker: str) -> list[str]:
    pad = " " * len(marker)
    return [marker + lines[0], *((pad + x if x else x) for x in lines[1:])] if lines else []


def _render(node: Node, flow: Flow, number: list[int] | None = None) -> None:
    for child in node.children:
        if isinstance(child, str):
            flow.text(child)
            continue
        if not visible(child):
            continue
        tag = child.tag
        if tag == "br":
            flow.line_break()
        elif tag == "hr":
            flow.end_line()
            flow.blank = True
        elif tag in ("pre", "textarea", "listing", "xmp"):
            flow.put(_verbatim(child), tag == "pre")
        elif tag == "table":
            flow.put(_table(child), True)
        elif tag in ("ul", "menu", "dir"):
            flow.put(_items(child, None), number is None)
        elif tag == "ol":
            flow.put(_items(child, _int(child.attrs.get("start"), 1)), number is None)
        elif tag == "li":
            flow.put(_marked(layout(child), "- "), False)
        elif tag == "dd":
            flow.put(["  " + x if x else x for x in layout(child)], False)
        elif tag == "blockquote":
            flow.put(["  " + x if x else x for x in layout(child)], True)
        elif tag in SPACED:
            flow.put(layout(child), True)
        elif tag in BLOCKS:
            flow.end_line()
            _render(child, flow)
            flow.end_line()
        else:
            _render(child, flow)


def _items(node: Node, number: int | None) -> list[str]:
    flow = Flow()
    for child in node.children:
        if isinstance(child, str):
            flow.text(child)
        elif child.tag == "li" and visible(child):
            inner = Flow()
            _render(child, inner, [0])
            flow.put(_marked(inner.done(), "- " if number is None else f"{number}. "), False)
            if number is not None:
                number += 1
        elif visible(child):
            _render(_wrapped(child), flow, [0])
    return flow.done()


def _wrapped(node: Node) -> Node:
    out = Node("div", {})
    out.children = [node]
    return out


def _verbatim(node: Node) -> list[str]:
    parts: list[str] = []

    def walk(x: Node) -> None:
        for child in x.children:
            if isinstance(child, str):
                parts.append(child)
            elif child.tag == "br":
                parts.append("\n")
            elif visible(child):
                walk(child)

    walk(node)
    lines = "".join(parts).replace("\r\n", "\n").replace("\xa0", " ").split("\n")
    if lines and not lines[0]:
        lines = lines[1:]
    while lines and not lines[-1].strip():
        lines.pop()
    return [x.rstrip() for x in lines]


def layout(node: Node) -> list[str]:
    flow = Flow()
    _render(node, flow)
    return flow.done()


def title_of(root: Node) -> str | None:
    stack = [root]
    while stack:
        node = stack.pop()
        if node.tag == "title":
            return _SPACE.sub(" ", "".join(x for x in node.children if isinstance(x, str))).strip()
        stack += [x for x in reversed(node.children) if not isinstance(x, str)]
    return None


def extract(html: str) -> tuple[str, str | None]:
    """Visible text of a page, laid out, and its title."""
    root = build(html)
    if "visibility" in html.lower():
        apply_visibility(root)
    # The renderer takes at most four frames a level, and no page is deeper than its tags; calls from Python
    # to Python do not use the C stack, so only the counter of frames has to allow for it.
    before = sys.getrecursionlimit()
    sys.setrecursionlimit(min(2**31 - 1, before + 4 * html.count("<")))
    try:
        return "\n".join(layout(root)), title_of(root)
    finally:
        sys.setrecursionlimit(before)


def _run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [extract(v) if v else (v, None) for v in batch.column(1).to_pylist()]
        columns = [batch.column(0), pa.array([t for t, _ in found], pa.string()), pa.array([t for _, t in found], pa.string())]
        yield pa.record_batch(columns, names=["id", "text", "title"])


def extract_text(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """Visible text of every whole page.

    Returns the id, ``text`` and ``title``.  A null page gives a null text, an empty one an empty
    text; a page without tags is text.  Hidden elements (by element, the ``hidden`` attribute
    or an inline ``display: none``) are left out with all they hold; an inline ``visibility: hidden`` hides
    text up to elements that are ``visible`` again.  Elements may be nested to any depth, and pages be of any length.  Rows are independent: repeated
    rows and null ids stay, an empty table gives an empty result, other columns are ignored.
    """
    kind = dict(pages.dtypes)[id_col]
    slim = pages.select(F.col(id_col).alias("id"), F.col(html_col).alias("html"))
    return slim.mapInArrow(_run, f"id {kind}, text string, title string").withColumnRenamed("id", id_col)
