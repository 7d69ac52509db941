"""Layout-aware rendering of HTML pages as text.

A tree builder closes what HTML lets authors leave open (paragraphs, list items,
table parts) and ignores stray end tags. The tree is then laid out: hidden
elements are left out, blocks start on lines of their own, paragraphs and the
like stand apart by an empty line, list items have markers and indents, and the
cells of a table are padded to common widths, also around cells that reach over several
rows. What stands in a table but in none of its cells is moved in front of it, as in
browsers. All other white space is one space.

Null and empty pages give empty text. Text of a page that is cut off in a tag is
kept up to there.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from lodestone.llm.registry import query, table

# -- what HTML fixes (fixed values)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes plaintext".split())
SPACED = frozenset(
    "p h1 h2 h3 h4 h5 h6 ul ol dl table blockquote pre figure fieldset hr menu".split()
)
BLOCK = SPACED | frozenset(
    "html body address article aside center details dialog div dd dt figcaption footer form "
    "header hgroup legend li main nav option optgroup search section summary caption tr".split()
)
HIDDEN = frozenset(
    "head script style template noscript title meta link base datalist audio video iframe "
    "object canvas noembed noframes param source track area col colgroup".split()
)
#: A start tag (left) closes these, up to a boundary.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "option": ({"option"}, {"select", "datalist"}),
    "optgroup": ({"option", "optgroup"}, {"select"}),
    "tr": ({"tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "thead": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "tbody": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "body": ({"head"}, set()),
}
#: Elements that an end tag outside of them does not reach into.
SCOPE = frozenset("table td th caption template html".split())

#: Elements in which only parts of tables may stand; what else does goes in front of the table.
TABLE = frozenset("table thead tbody tfoot tr".split())
TABLE_PARTS = frozenset("caption colgroup col thead tbody tfoot tr td th".split())
NOT_MOVED = TABLE_PARTS | frozenset("table body head script style template".split())

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)",
    re.S,
)
_ATTRIBUTE = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'=<>`]+))?")
_SPACE = re.compile(r"[ \t\n\r\f]+")
_UNSEEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*(?:hidden|collapse)", re.I)


MOST_DEPTH = 512


class Node:
    __slots__ = ("attributes", "children", "tag")

    def __init__(self, tag: str, attributes: dict[str, str] | None = None):
        self.tag, self.attributes, self.children = tag, attributes or {}, []


def _attributes(source: str) -> dict[str, str]:
    found: dict[str, str] = {}
    for name, value in _ATTRIBUTE.findall(source):
        found.setdefault(name.lower(), html.unescape(value.strip("\"'")))
    return found


class TreeBuilder:
    """Builds a tree from a page; every start tag is honoured, ends are implied."""

    def __init__(self) -> None:
        self.root = Node("html")
        self._open = [self.root]

    def feed(self, page: str) -> Node:
        at = 0
        while at < len(page):
            m = _TOKEN.search(page, at)
            self._text(page[at : m.start() if m else len(page)])
            if not m:
                break
            at = m.end()
            if m[2]:
                name = m[2].lower()
                if m[1]:
                    self._end(name)
                else:
                    self._start(name, _attributes(m[3]) if m[3] else {})
                    if name in RAW and self._open[-1].tag == name:
                        end = re.compile(f"</{re.escape(name)}(?=[\\s/>])", re.I).search(page, at)
                        stop = end.start() if end and name != "plaintext" else len(page)
                        self._open.pop().children.append(html.unescape(page[at:stop]))
                        at = stop
        return self.root

    def _text(self, source: str) -> None:
        if source:
            source = html.unescape(source)
            self._add(source, bool(source.strip(" \t\n\r\f")))

    def _add(self, item: Node | str, move: bool) -> None:
        """Below the open element, or in front of its table if it may not stand there."""
        if move and self._open[-1].tag == "colgroup":
            self._open.pop()
        if not move or self._open[-1].tag not in TABLE:
            self._open[-1].children.append(item)
            return
        i = max((i for i, node in enumerate(self._open) if node.tag == "table"), default=0)
        if not i:  # parts of no table
            self._open[-1].children.append(item)
            return
        siblings = self._open[i - 1].children
        at = len(siblings) - 1
        while siblings[at] is not self._open[i]:
            at -= 1
        siblings.insert(at, item)

    def _back_to_table(self) -> None:
        """Parts of a table end what stands in it but in no cell."""
        for i in range(len(self._open) - 1, 0, -1):
            tag = self._open[i].tag
            if tag in TABLE:
                del self._open[i + 1 :]
            if tag in TABLE or tag in ("td", "th", "caption", "colgroup"):
                return

    def _start(self, name: str, attributes: dict[str, str]) -> None:
        if name == "html":
            self.root.attributes.update(attributes)
            return
        if self._open[-1].tag == "head" and name not in HIDDEN | {"title"}:
            self._open.pop()
        if name in TABLE_PARTS:
            self._back_to_table()
        elif name == "table" and self._open[-1].tag in TABLE | {"colgroup"}:
            self._end("table")
        if name in CLOSES:
            self._close(*CLOSES[name])
        elif name in BLOCK:
            self._close({"p"}, SCOPE | {"button"})
        if name in ("td", "th") and self._open[-1].tag in ("table", "thead", "tbody", "tfoot"):
            self._start("tr", {})
        node = Node(name, attributes)
        self._add(node, name not in NOT_MOVED)
        # Like browsers: what is nested deeper stands side by side.
        if name not in VOID and (len(self._open) < MOST_DEPTH or name in RAW):
            self._open.append(node)

    def _close(self, names: set[str], boundary: set[str]) -> None:
        """Close open elements of these names, the outermost before the boundary."""
        outermost = None
        for i in range(len(self._open) - 1, 0, -1):
            if self._open[i].tag in boundary:
                break
            if self._open[i].tag in names:
                outermost = i
                if names == {"p"}:
                    break
        if outermost is not None:
            del self._open[outermost:]

    def _end(self, name: str) -> None:
        for i in range(len(self._open) - 1, 0, -1):
            tag = self._open[i].tag
            if tag == name:
                del self._open[i:]
                return
            if tag in SCOPE and name not in ("table", "body", "html", "tr", "tbody", "thead", "tfoot"):
                return


def hidden(node: Node) -> bool:
    a = node.attributes
    return (
        node.tag in HIDDEN
        or "hidden" in a
        or bool(_UNSEEN.search(a.get("style", "")))
        or (node.tag == "input" and a.get("type", "text").lower() == "hidden")
        or (node.tag == "dialog" and "open" not in a)
    )


class Writer:
    """Lines of text with indents and spacing between blocks."""

    def __init__(self) -> None:
        self.lines: list[str] = []
        self._parts: list[str] = []
        self._spaced = True  # whether more white space would be dropped
        self._gap = False
        self.indents: list[str] = []
        self._marker = ""

    def text(self, source: str, preserved: bool) -> None:
        if preserved:
            first, *others = source.split("\n")
            self._put(first)
            for line in others:
                self.break_line(True)
                self._put(line)
            return
        source = _SPACE.sub(" ", source)
        if self._spaced:
            source = source.lstrip(" ")
        if source:
            self._put(source)
            self._spaced = source.endswith(" ")

    def _put(self, source: str) -> None:
        if source:
            self._parts.append(source)
            self._spaced = False

    def mark(self, marker: str) -> None:
        self._marker = marker

    def break_line(self, always: bool = False) -> None:
        """End the line; an empty one only if it is asked for."""
        line = "".join(self._parts).rstrip(" ")
        self._parts, self._spaced = [], True
        if not line and not self._marker and not always:
            return
        if self._gap and self.lines:
            self.lines.append("")
        self._gap = False
        indent = "".join(self.indents)
        if self._marker:
            indent = indent[: len(indent) - len(self._marker)] + self._marker
            self._marker = ""
        self.lines.append((indent + line).rstrip(" "))

    def block(self, spaced: bool) -> None:
        if self._parts or self._marker and not spaced:
            self.break_line()
        if spaced and self.lines and not self._marker:
            self._gap = True

    def result(self) -> list[str]:
        self.break_line()
        return self.lines


MOST_NESTED_TABLES = 20


def render(node: Node, tables: int = 0) -> list[str]:
    """Lines of the visible text below a node."""
    out = Writer()
    lists: list[int | None] = []
    stack: list[tuple] = [("in", child, False) for child in reversed(node.children)]
    while stack:
        what, item, preserved = stack.pop()
        if isinstance(item, str):
            out.text(item, preserved)
            continue
        tag = item.tag
        if what == "out":
            if tag in BLOCK:
                out.block(tag in SPACED and not (tag in ("ul", "ol", "menu") and len(lists) > 1))
            if tag in ("ul", "ol", "menu"):
                lists.pop()
            if tag in ("li", "blockquote", "dd"):
                out.break_line()
                out.indents.pop()
            continue
        if hidden(item):
            continue
        if tag == "br":
            out.break_line(True)
            continue
        if tag == "table" and tables < MOST_NESTED_TABLES:
            out.block(True)
            for line in table_lines(item, tables + 1):
                out.text(line, True)
                out.break_line(True)
            out.block(True)
            continue
        if tag in ("td", "th"):
            out.text(" ", False)
        if tag in BLOCK:
            out.block(tag in SPACED and not (tag in ("ul", "ol", "menu") and lists))
        if tag in ("ul", "ol", "menu"):
            start = item.attributes.get("start", "1")
            lists.append(int(start) if tag == "ol" and start.isdecimal() and len(start) < 10 else 1 if tag == "ol" else None)
        elif tag == "li":
            number = lists[-1] if lists else None
            marker = "- " if number is None else f"{number}. "
            if number is not None:
                lists[-1] = number + 1
            out.indents.append(" " * len(marker))
            out.mark(marker)
        elif tag in ("blockquote", "dd"):
            out.indents.append("  ")
        stack.append(("out", item, preserved))
        inner = preserved or tag in ("pre", "textarea", "xmp", "plaintext")
        stack.extend(("in", child, inner) for child in reversed(item.children))
    return out.result()


def _rows(node: Node) -> tuple[list[tuple[Node, Node]], list[Node]]:
    """Visible rows of a table, each with the element that holds it, and its captions."""
    rows, captions, stack = [], [], [(item, node) for item in reversed(node.children)]
    while stack:
        item, group = stack.pop()
        if isinstance(item, str) or hidden(item):
            continue
        if item.tag == "tr":
            rows.append((item, group))
        elif item.tag in ("thead", "tbody", "tfoot"):
            stack.extend((child, item) for child in reversed(item.children))
        else:
            captions.append(item)
    return rows, captions


def _span(cell: Node, name: str, most: int) -> int:
    span = cell.attributes.get(name, "1").strip()
    return min(int(span), most) if span.isdecimal() and len(span) < 6 else 1


def table_lines(node: Node, tables: int) -> list[str]:
    """Captions, then rows whose cells are padded to the widths of their columns."""
    rows, captions = _rows(node)
    lines = [line for c in captions for line in render(c, tables)]
    grid: list[list[list[str]]] = []
    taken: list[int] = []  # of each column, the first row below the cells so far
    within = None
    for number, (row, group) in enumerate(rows):
        if group is not within:
            taken, within = [], group
        cells: list[list[str]] = []
        for cell in row.children:
            if isinstance(cell, str) or hidden(cell):
                continue
            while len(cells) < len(taken) and taken[len(cells)] > number:
                cells.append([])
            first = len(cells)
            cells.append(render(cell, tables))
            cells.extend([[]] * (_span(cell, "colspan", 1000) - 1))
            # 0 is all rows of the group.
            below = number + (_span(cell, "rowspan", 65534) or len(rows))
            if below > number + 1:
                taken.extend([0] * (len(cells) - len(taken)))
                taken[first : len(cells)] = [max(t, below) for t in taken[first : len(cells)]]
        grid.append(cells)
    widths: list[int] = []
    for cells in grid:
        for i, cell in enumerate(cells):
            if i == len(widths):
                widths.append(0)
            widths[i] = max(widths[i], *(len(line) for line in cell), 0)
    for cells in grid:
        for k in range(max((len(c) for c in cells), default=0)):
            parts = [(c[k] if k < len(c) else "").ljust(w) for c, w in zip(cells, widths, strict=False)]
            lines.append("  ".join(parts).rstrip(" "))
    return lines


def render_page(page: str | None) -> str:
    return "\n".join(render(TreeBuilder().feed(page or "")))


def render_pages(pages: DataFrame) -> DataFrame:
    """``page_id, text`` of every page."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            made = pd.DataFrame({"text": [render_page(p) for p in rows["html"].tolist()]})
            made.insert(0, "page_id", rows["page_id"].astype("Int64"))
            yield made

    return pages.select("page_id", "html").mapInPandas(run, "page_id long, text string")


@query("op3_html_rendering")
def op3_html_rendering(spark: SparkSession, folder: str) -> DataFrame:
    """The visible text of every page."""
    return render_pages(table(spark, folder, "pages"))
