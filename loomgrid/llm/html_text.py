"""HTML extraction: a tree builder with implied tags, visibility rules, and a layout-aware rendering.

All visible text comes out, in document order but for text between the rows of a table, which stands before
it (as HTML's foster parenting has it). Blocks are parted by line breaks, paragraphs, headings, lists and
tables by a blank line; list items get their marker and are indented, up to ``MAX_INDENT`` columns; table
cells are padded so that columns align; ``pre`` keeps its white space, blank lines too; ``br`` breaks the line.

A cell of more than ``MAX_WIDTH`` characters does not widen its column, and a table whose padding would be
far larger than its text has its cells parted by two spaces instead; so the output grows with the page.

Defined cases: null and empty pages give empty text; a page without any tag is its own text; unknown
tags are inline; a tag or comment that never ends runs to the end of the page; elements may be nested to
any depth (no step recurses); repeated rows give equal rows, null ids stay null, an empty table gives an
empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Element kinds of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
HIDDEN = frozenset("script style template noscript head title meta link iframe noembed noframes datalist object audio video canvas svg math".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table ul "
    "caption tbody thead tfoot tr td th".split()
)
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl menu dir blockquote pre table figure fieldset hr".split())
CLOSES_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 "
    "h6 header hgroup hr main menu nav ol p pre search section summary table ul li dd dt".split()
)
HEAD_ONLY = frozenset("base link meta title style script template noscript".split())
#: Start tag: the open elements it ends, and the elements at which the search for them stops.
IMPLIED_END = {
    "li": (("li",), ("ul", "ol", "menu", "dir")),
    "dt": (("dt", "dd"), ("dl",)),
    "dd": (("dt", "dd"), ("dl",)),
    "option": (("option",), ("select", "datalist")),
    "optgroup": (("optgroup", "option"), ("select",)),
    "tr": (("tr", "td", "th", "caption"), ("table",)),
    "td": (("td", "th"), ("tr", "table")),
    "th": (("td", "th"), ("tr", "table")),
    "thead": (("thead", "tbody", "tfoot", "tr", "td", "th", "caption"), ("table",)),
    "tbody": (("thead", "tbody", "tfoot", "tr", "td", "th", "caption"), ("table",)),
    "tfoot": (("thead", "tbody", "tfoot", "tr", "td", "th", "caption"), ("table",)),
}
#: HTML's own limits of the two spans.
MAX_COLSPAN, MAX_ROWSPAN = 1000, 65534
MAX_INDENT, MAX_WIDTH = 64, 80
#: A table is aligned while its lines take up to so many characters for each one of text, and so many beside.
PAD_FACTOR, PAD_FREE = 16, 4096
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())

_TAG = re.compile(r"""</?([A-Za-z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>""")
_ATTR = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")
_UNSEEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*(?:hidden|collapse)", re.IGNORECASE)
_SPACE = re.compile(r"[ \t\n\r\f]+")


class Node:
    __slots__ = ("attrs", "children", "tag")

    def __init__(self, tag: str, attrs: dict):
        self.tag, self.attrs, self.children = tag, attrs, []


def tokens(page: str) -> Iterator[tuple[str, str, dict | None]]:
    """(kind, name or text, attributes) with kinds start, end and text."""
    at, size = 0, len(page)
    while at < size:
        lt = page.find("<", at)
        if lt < 0:
            lt = size
        if lt > at:
            yield "text", html.unescape(page[at:lt]), None
        if lt == size:
            return
        nxt = page[lt + 1 : lt + 2]
        if page.startswith("<!--", lt):
            end = page.find("-->", lt + 4)
            at = size if end < 0 else end + 3
        elif nxt in ("!", "?"):
            end = page.find(">", lt)
            at = size if end < 0 else end + 1
        elif nxt.isascii() and (nxt.isalpha() or (nxt == "/" and page[lt + 2 : lt + 3].isalpha())):
            m = _TAG.match(page, lt)
            if not m:  # a quote or the tag itself never ends
                end = page.find(">", lt)
                m = re.compile(r"</?([A-Za-z][^\s/>]*)([^>]*)").match(page, lt, size if end < 0 else end)
                at = size if end < 0 else end + 1
            else:
                at = m.end()
            name = m[1].lower()
            if nxt == "/":
                yield "end", name, None
                continue
            attrs = {}
            for a in _ATTR.finditer(m[2]):
                value = next((v for v in a.groups()[1:] if v is not None), "")
                attrs.setdefault(a[1].lower(), html.unescape(value))
            yield "start", name, attrs
            if name in RAW:
                close = re.compile(rf"</{name}(?=[\s/>])", re.IGNORECASE).search(page, at)
                body = page[at : close.start() if close else size]
                at = close.start() if close else size
                if name in ("textarea", "title"):
                    body = html.unescape(body)
                if body:
                    yield "text", body, None
        else:
            yield "text", "<", None
            at = lt + 1


def parse(page: str) -> Node:
    """The tree of a page; html, head, body, tbody and tr are put in where tags imply them."""
    root = Node("html", {})
    body: Node | None = None
    head: Node | None = None
    stack = [root]
    places: dict[str, list[int]] = {}  # of each tag's open elements in the stack, without the root

    def push(node: Node) -> None:
        stack[-1].children.append(node)
        if node.tag not in VOID:
            places.setdefault(node.tag, []).append(len(stack))
            stack.append(node)

    def cut(size: int) -> None:
        while len(stack) > size:
            places[stack.pop().tag].pop()

    def top(tags) -> int:
        """Place of the innermost open element of these tags, 0 if there is none."""
        return max((places[t][-1] for t in tags if places.get(t)), default=0)

    def need_body() -> None:
        nonlocal body
        if body is None:
            cut(1)
            body = Node("body", {})
            push(body)

    def close(tags, stop) -> None:
        border = top(stop)
        while (i := top(tags)) > border:
            cut(i)

    for kind, name, attrs in tokens(page):
        if kind == "text":
            if head is not None and stack[-1] is not root and places.get("head"):
                if stack[-1] is head and not name.strip():
                    continue
                if stack[-1] is head:
                    need_body()
            elif body is None:
                if not name.strip():
                    continue
                need_body()
            if stack[-1].tag in ("table", "tbody", "thead", "tfoot", "tr") and not name.strip():
                continue
            stack[-1].children.append(name)
        elif kind == "start":
            if name == "html":
                root.attrs = attrs | root.attrs
                continue
            if name == "head":
                if head is None and body is None:
                    head = Node("head", attrs)
                    push(head)
                continue
            if name == "body":
                if body is None:
                    cut(1)
                    body = Node("body", attrs)
                    push(body)
                continue
            if body is None:
                if name in HEAD_ONLY:
                    if head is None:
                        head = Node("head", {})
                        push(head)
                else:
                    need_body()
            if name in CLOSES_P:
                close(("p",), ("table", "td", "th", "caption", "button", "body"))
            if name in HEADINGS and stack[-1].tag in HEADINGS:
                cut(len(stack) - 1)
            if name in IMPLIED_END:
                close(*IMPLIED_END[name])
                if name in ("td", "th") and stack[-1].tag in ("table", "tbody", "thead", "tfoot"):
                    if stack[-1].tag == "table":
                        push(Node("tbody", {}))
                    push(Node("tr", {}))
                elif name == "tr" and stack[-1].tag == "table":
                    push(Node("tbody", {}))
            push(Node(name, attrs))
        else:
            if name == "p" and not places.get("p"):
                need_body()
                stack[-1].children.append(Node("p", {}))
            elif name == "br":
                need_body()
                stack[-1].children.append(Node("br", {}))
            elif name in ("html", "body"):
                continue  # what still follows belongs to the body
            else:
                match = HEADINGS if name in HEADINGS else (name,)
                stop = ("table", "td", "th", "body") if name not in ("table", "td", "th", "tr", "tbody", "thead", "tfoot") else ("body",)
                if name in ("td", "th", "tr", "tbody", "thead", "tfoot"):
                    stop = ("table", "body")
                if (i := top(match)) > top(stop):
                    cut(i)
    return root


def visible(node: Node) -> bool:
    """Whether an element and what it holds is shown at all."""
    a = node.attrs
    if node.tag in HIDDEN or "hidden" in a and a["hidden"].lower() != "until-found":
        return False
    if node.tag == "input" and a.get("type", "").lower() == "hidden" or node.tag == "dialog" and "open" not in a:
        return False
    return not ("style" in a and _UNSEEN.search(a["style"]))


class Page:
    """Lines of text with pending white space and margins, as a browser lays blocks out."""

    def __init__(self):
        self.lines: list[str] = []
        self.line: list[str] = []  # parts of the open line
        self.gap = 0  # blank lines due before the next text
        self.space = False
        self.indent = ""
        self.marker = ""

    def text(self, s: str) -> None:
        s = _SPACE.sub(" ", s)
        if s.startswith(" "):
            self.space, s = bool(self.line), s[1:]
        if not s:
            return
        more = s.endswith(" ")
        self.put((" " if self.space and self.line else "") + (s[:-1] if more else s))
        self.space = more

    def put(self, s: str) -> None:
        if not self.line:
            if self.gap and self.lines:
                self.lines += [""] * self.gap
            self.gap = 0
            self.line.append(self.indent[: max(0, len(self.indent) - len(self.marker))] + self.marker if self.marker else self.indent)
            self.marker = ""
        self.line.append(s)

    def end_line(self) -> None:
        if self.line:
            self.lines.append("".join(self.line).rstrip(" "))
        self.line, self.space = [], False

    def block(self, margin: int) -> None:
        self.end_line()
        self.gap = max(self.gap, margin)

    def done(self) -> list[str]:
        self.end_line()
        return self.lines


def _number(value: str, default: int) -> int:
    return int(value) if re.fullmatch(r"\s*-?[0-9]{1,9}\s*", value) else default


def _work(task: Iterator) -> None:
    """Runs a task to its end; the tasks that it yields are run where they are yielded, without recursion."""
    tasks = [task]
    while tasks:
        inner = next(tasks[-1], None)
        if inner is None:
            tasks.pop()
        else:
            tasks.append(inner)


def _span(value: str, least: int, most: int) -> int:
    """A span of cells: 1 if it is no number, else clamped."""
    number = re.fullmatch(r"\s*0*([0-9]+)\s*", value)
    if not number:
        return 1
    return most if len(number[1]) > 9 else min(max(int(number[1]), least), most)


def _render(node: Node, page: Page) -> Iterator:
    for child in node.children:
        if isinstance(child, str):
            page.text(child)
        elif visible(child):
            yield _element(child, page)


def _element(node: Node, page: Page) -> Iterator:
    tag = node.tag
    if tag == "br":
        if page.line:
            page.end_line()
        elif page.lines and page.lines[-1]:
            page.gap = max(page.gap, 1)
        return
    if tag == "wbr" or tag in VOID and tag != "hr":
        return
    if tag not in BLOCK:
        if tag == "q":
            page.text("“")
        yield _render(node, page)
        if tag == "q":
            page.text("”")
        return
    margin = int(tag in SPACED)
    if tag in ("ul", "ol", "menu", "dir") and page.indent:
        margin = 0  # a list inside a list
    page.block(margin)
    indent = page.indent
    if tag in ("pre", "textarea"):
        parts: list[str] = []
        yield _plain(node, parts)
        for line in parts[0].rstrip().split("\n") if parts[0].strip() else ():
            if line.strip():
                page.put(line)
                page.end_line()
            else:
                page.gap += 1
    elif tag in ("ul", "ol", "menu", "dir"):
        number = _number(node.attrs.get("start", ""), 1)
        for child in node.children:
            if isinstance(child, str):
                page.text(child)
            elif not visible(child):
                continue
            elif child.tag == "li":
                page.end_line()
                number = _number(child.attrs.get("value", ""), number) if tag == "ol" else number
                mark = f"{number}. " if tag == "ol" else "- "
                number += 1
                page.indent, page.marker = (indent + " " * len(mark))[:MAX_INDENT], mark
                yield _render(child, page)
                page.end_line()
                page.indent, page.marker = indent, ""
            else:
                yield _element(child, page)
    elif tag == "table":
        yield _table(node, page)
    elif tag in ("dd", "blockquote"):
        page.indent = (page.indent + ("    " if tag == "dd" else "  "))[:MAX_INDENT]
        yield _render(node, page)
    elif tag == "details" and "open" not in node.attrs:
        for child in node.children:
            if isinstance(child, Node) and child.tag == "summary" and visible(child):
                yield _element(child, page)
                break
    else:
        yield _render(node, page)
    page.block(margin)
    page.indent = indent


def _plain(node: Node, to: list[str]) -> Iterator:
    """Adds the text of the element to the list."""
    out: list[str] = []
    for child in node.children:
        if isinstance(child, str):
            out.append(child)
        elif visible(child):
            if child.tag == "br":
                out.append("\n")
            else:
                yield _plain(child, out)
    to.append("".join(out).replace("\r\n", "\n").removeprefix("\n"))


def _rows(node: Node) -> Iterator[tuple[Node, Node]]:
    """(section, row); rows outside any section are the table's own."""
    for child in node.children:
        if isinstance(child, Node) and visible(child):
            if child.tag == "tr":
                yield node, child
            elif child.tag in ("thead", "tbody", "tfoot"):
                yield from _rows(child)


def _table(node: Node, page: Page) -> Iterator:
    """Caption and stray text first, then rows whose cells begin at the same column."""
    grid: list[dict[int, tuple[list[str], int]]] = []
    taken: list[tuple[int, int, float]] = []  # columns [start, end) and the row before which they are free again
    part: Node | None = None
    for child in node.children:
        if isinstance(child, str):
            page.text(child)
        elif visible(child) and child.tag not in ("thead", "tbody", "tfoot", "tr", "col", "colgroup"):
            yield _element(child, page)
            page.end_line()
    for section in node.children:  # text that stands between rows is shown before the table
        if isinstance(section, Node) and section.tag in ("thead", "tbody", "tfoot") and visible(section):
            for child in section.children:
                if isinstance(child, str):
                    page.text(child)
                elif child.tag != "tr" and visible(child):
                    yield _element(child, page)
    page.end_line()
    for y, (section, row) in enumerate(_rows(node)):
        # A span ends with its section at the latest.
        taken = sorted(t for t in taken if t[2] > y) if section is part else []
        part, at, held = section, 0, []
        cells: dict[int, tuple[list[str], int]] = {}
        x = 0
        for child in row.children:
            if isinstance(child, Node) and not visible(child):
                continue
            if isinstance(child, str) and not child.strip():
                continue
            while at < len(taken) and taken[at][0] <= x:
                x = max(x, taken[at][1])
                at += 1
            inner = Page()
            span = down = 1
            if isinstance(child, Node) and child.tag in ("td", "th"):
                span = _span(child.attrs.get("colspan", ""), 1, MAX_COLSPAN)
                down = _span(child.attrs.get("rowspan", ""), 0, MAX_ROWSPAN)
                yield _render(child, inner)
            elif isinstance(child, Node):
                yield _element(child, inner)
            else:
                inner.text(child)
            cells[x] = (inner.done(), span)
            if down != 1:  # 0: to the end of the section
                held.append((x, x + span, y + down if down else float("inf")))
            x += span
        taken += held
        grid.append(cells)
    widths: dict[int, int] = {}
    size = free = 0
    for cells in grid:
        for x, (lines, span) in cells.items():
            if span == 1:
                widths[x] = max(widths.get(x, 0), *(len(s) for s in lines if len(s) <= MAX_WIDTH), 0)
            size += sum(map(len, lines)) + 4
    wide = sorted(widths)
    before = [0]
    for x in wide:
        before.append(before[-1] + widths[x])
    starts = []  # of each row's cells
    for cells in grid:
        own = [(x, before[bisect_left(wide, x)] + 2 * x) for x in sorted(cells)]
        starts.append(own)
        done = 0  # a line is padded up to the last cell that has it
        for x, column in reversed(own):
            free += max(0, len(cells[x][0]) - done) * column
            done = max(done, len(cells[x][0]))
    aligned = free <= PAD_FACTOR * size + PAD_FREE
    for cells, own in zip(grid, starts):
        rest = [(column if aligned else 0, cells[x][0]) for x, column in own]
        k = 0
        while rest := [r for r in rest if len(r[1]) > k]:
            parts, length = [], 0
            for column, lines in rest:
                if piece := lines[k]:
                    pad = column - length if length <= column or not length else 2
                    parts += [" " * pad, piece]
                    length += pad + len(piece)
            if any(p.strip() for p in parts):
                page.put("".join(parts))
            page.end_line()
            k += 1


def extract(page: str | None) -> str:
    """The visible text of a page."""
    if not page:
        return ""
    out = Page()
    root = parse(page)
    if visible(root):
        _work(_render(root, out))
    return "\n".join(out.done())


def render(pages: DataFrame, *, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """Per page: id, text, n_chars, n_lines."""
    base = pages.select(F.col(id_col).alias("page_id"), F.col(html_col).alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                texts = [extract(v.as_py()) for v in part.column("html")]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("page_id"),
                        pa.array(texts, pa.string()),
                        pa.array([len(t) for t in texts], pa.int64()),
                        pa.array([t.count("\n") + 1 if t else 0 for t in texts], pa.int64()),
                    ],
                    names=["page_id", "text", "n_chars", "n_lines"],
                )

    return base.mapInArrow(run, f"page_id {base.schema['page_id'].dataType.simpleString()}, text string, n_chars long, n_lines long")
