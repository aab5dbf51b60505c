"""Visible text of HTML pages, laid out: blocks, lists and aligned table cells."""

from __future__ import annotations

import html
import re
import sys
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import unused

# Fixed values of the HTML standard, and the defaults of its style sheet.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style noscript template iframe noembed noframes xmp title textarea".split())
HIDDEN = set(
    "area audio base canvas datalist embed head iframe link map meta noembed noframes noscript object param rp "
    "script source style svg template title track video".split()
)
BLOCK = set(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search "
    "section summary table ul".split()
)
# Blocks with an empty line before and after them.
SPACED = set("blockquote dl fieldset figure h1 h2 h3 h4 h5 h6 hr menu ol p pre table ul".split())
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
CELLS, GROUPS = {"td", "th"}, {"thead", "tbody", "tfoot"}
LISTS = {"ul", "ol", "menu", "dir"}
# An open p ends where one of these begins.
ENDS_P = (BLOCK - {"body", "caption", "dd", "dt", "html", "li", "legend", "optgroup", "option"}) | {"li", "dd", "dt"}
# What a start tag closes, and the element that stops the search for it.
CLOSES = {
    "li": ({"li"}, LISTS),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "option": ({"option"}, {"select", "datalist"}),
    "optgroup": ({"option", "optgroup"}, {"select"}),
    "tr": ({"tr"} | CELLS, {"table"}),
    "td": (CELLS, {"tr", "table"}),
    "th": (CELLS, {"tr", "table"}),
    "thead": (GROUPS | {"tr", "caption", "colgroup"} | CELLS, {"table"}),
    "tbody": (GROUPS | {"tr", "caption", "colgroup"} | CELLS, {"table"}),
    "tfoot": (GROUPS | {"tr", "caption", "colgroup"} | CELLS, {"table"}),
    "rt": ({"rt", "rp"}, {"ruby"}),
    "rp": ({"rt", "rp"}, {"ruby"}),
}
# An end tag looks for its start tag no further up than the nearest of these.
SCOPE = {"table", "td", "th", "caption", "html", "body"}
# Parts of a table that hold no text; what else is in them belongs before the table.
PARTS = GROUPS | {"tr", "table", "colgroup"}
STRUCTURE = CELLS | GROUPS | {"tr", "caption", "colgroup", "col"}
IN_PLACE = STRUCTURE | {"script", "style", "template"}
# The part that a start tag of the structure ends all elements up to.
HOLDERS = {
    **dict.fromkeys(GROUPS | {"caption", "colgroup"}, {"table"}), "tr": GROUPS | {"table"},
    **dict.fromkeys(CELLS, GROUPS | {"tr", "table"}), "col": {"colgroup", "table"},
}
# Deeper elements become children of the last one at this depth, as in browsers, which stop at 512.
DEEPEST = 2000

_TOKEN = re.compile(
    r"<!--(?:>|->|.*?(?:-->|--!>|\Z))|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    # A quote delimits a value only right after the sign.
    r"|<(/?)([a-zA-Z][^\s/>]*+)((?:[\s/]++|[^\s/>][^\s/>=]*+(?:\s*+=\s*+(?:\"[^\"]*+\"|'[^']*+'|[^\s>]++)?)?)*+)(?:>|\Z)",
    re.S,
)
_ATTRIBUTE = re.compile(r"([^\s/>][^\s/>=]*)\s*(?:=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?")
_STYLE = re.compile(r"(display|visibility)\s*:\s*([a-z-]+)")
_BLANKS = re.compile(r"[ \t\n\r\f]+")


class Element:
    """A node of the tree; children are elements and texts."""

    __slots__ = ("tag", "attributes", "children")

    def __init__(self, tag: str, attributes: dict[str, str] | None = None):
        self.tag, self.attributes, self.children = tag, attributes or {}, []


def attributes_of(source: str) -> dict[str, str]:
    found: dict[str, str] = {}
    if not source or source.isspace():
        return found
    for m in _ATTRIBUTE.finditer(source):
        value = m[2] or ""
        if value[:1] in "\"'" and value[-1:] == value[:1]:
            value = value[1:-1]
        found.setdefault(m[1].lower(), html.unescape(value))
    return found


def tree(source: str) -> Element:
    """The elements of a page, with the tags that may be left out put in."""
    root = Element("html")
    stack = [root]

    def add(child: Element | str) -> None:
        """To the innermost element; what no part of a table can hold goes before the table."""
        if stack[-1].tag in PARTS and not (child.isspace() if isinstance(child, str) else child.tag in IN_PLACE):
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == "table":
                    stack[i - 1].children.insert(-1, child)  # an open table is the last child
                    return
        stack[-1].children.append(child)

    def part() -> int:
        """Where the table is whose parts the next tag is in, outside of cells and captions; or 0."""
        inside = False
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].tag == "table":
                return i
            if stack[i].tag in PARTS:
                inside = True
            elif not inside and stack[i].tag in CELLS | {"caption"}:
                return 0
        return 0

    def open_(tag: str, attributes: dict[str, str] | None = None) -> Element:
        made = Element(tag, attributes)
        add(made)
        if tag not in VOID and len(stack) < DEEPEST:
            stack.append(made)
        return made

    def close(tags: set[str], stops: set[str]) -> None:
        """End all open elements of these tags above the nearest stop."""
        last = None
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].tag in stops:
                break
            if stack[i].tag in tags:
                last = i
        if last is not None:
            del stack[last:]

    def text(piece: str) -> None:
        if piece:
            add(html.unescape(piece) if "&" in piece else piece)

    at, raw = 0, None
    while at < len(source):
        if raw:
            end = re.compile(rf"</{raw}(?=[\s/>]|\Z)[^>]*>?", re.I).search(source, at)
            piece = source[at : end.start() if end else len(source)]
            if piece:
                stack[-1].children.append(html.unescape(piece) if raw in ("title", "textarea") else piece)
            if stack[-1].tag == raw:
                stack.pop()
            at, raw = (end.end() if end else len(source)), None
            continue
        m = _TOKEN.search(source, at)
        if m is None:
            text(source[at:])
            break
        text(source[at : m.start()])
        at = m.end()
        if m[2] is None:
            if m[0].startswith("<![CDATA["):
                text_ = m[0][9:].removesuffix("]]>")
                if text_:
                    add(text_)
            continue
        tag = m[2].lower()
        if m[1]:
            if tag in ("html", "body"):
                continue
            if tag in VOID:
                if tag == "br":
                    open_("br")
                continue
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    del stack[i:]
                    break
                if stack[i].tag in SCOPE and tag not in SCOPE and tag not in GROUPS | {"tr"}:
                    break
            else:
                if tag == "p":
                    add(Element("p"))
            continue
        attributes = attributes_of(m[3])
        if tag in ("html", "body", "head"):
            # These are there once; what follows the head is the page.
            if tag == "head":
                open_("head", attributes)
            else:
                close({"head"}, set())
                for name, value in attributes.items():
                    root.attributes.setdefault(name, value)
            continue
        if stack[-1].tag == "head" and tag not in HIDDEN | VOID:
            stack.pop()
        if tag in ENDS_P:
            close({"p"}, {"table", "td", "th", "caption", "button", "object"})
        if tag in CLOSES:
            close(*CLOSES[tag])
        if tag == "table" and (at_table := part()):
            del stack[at_table:]
        if tag == "form" and part():
            continue
        if tag in STRUCTURE and any(x.tag == "table" for x in stack):
            while stack[-1].tag not in HOLDERS[tag]:
                stack.pop()
        if tag in HEADINGS and stack[-1].tag in HEADINGS:
            stack.pop()
        if tag == "tr" and stack[-1].tag == "table":
            open_("tbody")
        if tag in CELLS and stack[-1].tag in GROUPS | {"table"}:
            if stack[-1].tag == "table":
                open_("tbody")
            open_("tr")
        open_(tag, attributes)
        if tag in RAW and stack[-1].tag == tag and not m[0].endswith("/>"):
            raw = tag
    return root


def shown(element: Element, visible: bool) -> tuple[bool, bool]:
    """Whether an element takes part in the layout, and whether its own text is seen."""
    a = element.attributes
    if element.tag in HIDDEN or "hidden" in a and a["hidden"] != "until-found":
        return False, False
    if element.tag == "input" or element.tag == "dialog" and "open" not in a:
        return False, False
    for name, value in _STYLE.findall(a.get("style", "").lower()):
        if name == "display" and value == "none":
            return False, False
        if name == "visibility":
            visible = value not in ("hidden", "collapse")
    return True, visible


def width_of(line: str) -> int:
    """Columns that a line takes; wide characters take two, combining ones none."""
    if line.isascii():
        return len(line)
    return sum(
        0 if unicodedata.combining(c) else 2 if unicodedata.east_asian_width(c) in "WF" else 1 for c in line
    )


class Page:
    """Lines of text in the making. ``gap`` is the empty lines due before the next text."""

    def __init__(self):
        self.lines: list[str] = []
        self.line: list[str] = []
        self.blank = False  # a blank is due before the next word
        self.gap = 0

    def word(self, piece: str) -> None:
        if not self.line:
            self.lines += [""] * self.gap if self.lines else []
            self.gap = 0
        elif self.blank:
            self.line.append(" ")
        self.line.append(piece)
        self.blank = False

    def flow(self, piece: str) -> None:
        """Text whose runs of white space count as one blank."""
        parts = _BLANKS.sub(" ", piece)
        if parts.startswith(" "):
            self.blank = bool(self.line)
        inner = parts.strip(" ")
        if inner:
            self.word(inner)
            self.blank = parts.endswith(" ")

    def end_line(self) -> None:
        if self.line:
            self.lines.append("".join(self.line).rstrip(" "))
            self.line = []
        self.blank = False

    def space(self, n: int) -> None:
        self.end_line()
        self.gap = max(self.gap, n)

    def add(self, lines: list[str], first: str = "", rest: str = "") -> None:
        """Finished lines, each after its indent."""
        self.end_line()
        if lines:
            self.lines += [""] * self.gap if self.lines else []
            self.gap = 0
            self.lines += [((first if i == 0 else rest) + x).rstrip(" ") for i, x in enumerate(lines)]


def draw(element: Element, page: Page, visible: bool = True, kept: bool = False) -> None:
    """Add an element's text to the page; ``kept`` keeps white space as in pre."""
    item = int(m[0]) if element.tag == "ol" and (m := re.match(r"-?\d{1,9}", element.attributes.get("start", "1"))) else 1
    for child in element.children:
        if isinstance(child, str):
            if not visible:
                continue
            if kept:
                pieces = child.replace("\r\n", "\n").split("\n")
                for k, piece in enumerate(pieces):
                    if k:
                        page.end_line() if page.line else page.add([""])
                    if piece:
                        page.word(piece)
            else:
                page.flow(child)
            continue
        there, seen = shown(child, visible)
        if not there:
            continue
        tag = child.tag
        if tag == "br":
            page.end_line() if page.line else page.add([""]) if page.lines else None
        elif tag == "hr":
            page.space(1)
        elif tag == "img":
            if seen and child.attributes.get("alt", "").strip():
                page.flow(f" {child.attributes['alt']} ")
        elif tag == "table":
            page.space(1)
            page.add(table_lines(child, seen))
            page.space(1)
        elif tag in ("li", "dd", "blockquote"):
            inner = Page()
            draw(child, inner, seen, kept)
            mark = "    " if tag == "dd" else "  "
            if tag == "li":
                value = child.attributes.get("value", "")
                item = int(value) if re.fullmatch(r"-?\d{1,9}", value) else item
                mark = f"{item}. " if element.tag == "ol" else "- "
                item += 1
            page.space(1 if tag == "blockquote" else 0)
            page.add(finished(inner), mark, " " * len(mark))
            page.space(1 if tag == "blockquote" else 0)
        elif tag in BLOCK:
            inside = element.tag in ("li", "dd") or tag in LISTS and element.tag in LISTS
            gap = 1 if tag in SPACED and not (inside and tag in LISTS) else 0
            page.space(gap)
            draw(child, page, seen, kept or tag == "pre")
            page.space(gap)
        else:
            draw(child, page, seen, kept)


def finished(page: Page) -> list[str]:
    page.end_line()
    lines = page.lines
    while lines and not lines[-1]:
        lines.pop()
    first = next((i for i, x in enumerate(lines) if x), len(lines))
    return lines[first:]


def rows_of(element: Element, visible: bool) -> Iterator[tuple[Element, bool]]:
    for child in element.children:
        if isinstance(child, Element):
            there, seen = shown(child, visible)
            if there and child.tag == "tr":
                yield child, seen
            elif there and child.tag in GROUPS:
                yield from rows_of(child, seen)


def table_lines(table: Element, visible: bool) -> list[str]:
    """Caption and rows; the cells of a column begin at one place, two blanks apart."""
    page = Page()
    loose = Element("div")
    loose.children = [
        c for c in table.children if isinstance(c, str) or c.tag not in GROUPS | {"tr", "colgroup", "col"}
    ]
    draw(loose, page, visible)
    above = finished(page)
    grid: list[list[list[str]]] = []
    wide: list[tuple[int, int, int]] = []  # row, column and span of cells over several columns
    down: dict[int, int] = {}  # columns that a cell from above still covers, with the rows left
    for row, seen in rows_of(table, visible):
        cells: list[list[str]] = []
        for cell in row.children:
            if isinstance(cell, str) or cell.tag not in CELLS:
                continue
            there, lit = shown(cell, seen)
            if not there:
                continue
            while down.get(len(cells)):
                down[len(cells)] -= 1
                cells.append([])
            inner = Page()
            draw(cell, inner, lit)
            span = _span(cell, "colspan", 1000)
            tall = _span(cell, "rowspan", 65534)
            if span > 1:
                wide.append((len(grid), len(cells), span))
            for k in range(span):
                if tall > 1:
                    down[len(cells) + k] = tall - 1
            cells += [finished(inner)] + [[]] * (span - 1)
        for k in [k for k in down if k >= len(cells)]:
            down[k] = max(0, down[k] - 1)
        grid.append(cells)
    columns = max(map(len, grid), default=0)
    spread = {(r, c) for r, c, _ in wide}
    sizes = [0] * columns
    for r, cells in enumerate(grid):
        for c, lines in enumerate(cells):
            if (r, c) not in spread:
                sizes[c] = max(sizes[c], max(map(width_of, lines), default=0))
    out = []
    for cells in grid:
        for k in range(max(map(len, cells), default=0)):
            line, at = "", 0
            for c, lines in enumerate(cells):
                if k < len(lines) and lines[k]:
                    used = width_of(line)
                    line += " " * (max(at - used, 2 if used else 0)) + lines[k]
                at += sizes[c] + 2 if sizes[c] else 0
            out.append(line.rstrip(" "))
    return above + out


def _span(cell: Element, name: str, most: int) -> int:
    value = cell.attributes.get(name, "1").strip()
    return min(max(int(value), 1), most) if value.isascii() and value.isdigit() and len(value) < 7 else 1


def render(source: str | None) -> str:
    """The visible text of a page; nothing for null."""
    if not source:
        return ""
    # An element is drawn by up to two calls inside those of its parent.
    sys.setrecursionlimit(max(sys.getrecursionlimit(), 3 * DEEPEST + 1000))
    page = Page()
    root = tree(source.replace("\x00", ""))
    there, seen = shown(root, True)
    if there:
        draw(root, page, seen)
    return "\n".join(finished(page))


def title_of(source: str | None) -> str | None:
    m = re.search(r"<title[^>]*>(.*?)(?:</title|\Z)", source or "", re.S | re.I)
    return _BLANKS.sub(" ", html.unescape(m[1])).strip() if m else None


def extract(df: DataFrame, source: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """``keep`` with title, text and n_lines for every row.

    A null, empty or invisible page has an empty text and no line; a page without a title has
    a null one. Every page is rendered by itself and whole, so copies give equal texts.
    Elements nested deeper than DEEPEST are rendered as children of the last at that depth.
    """
    page, = unused(df.select(*keep), "source")
    rows = df.select(*keep, F.col(source).alias(page))
    schema = rows.drop(page).schema.add("title", "string").add("text", "string").add("n_lines", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                pages = part.column(part.num_columns - 1).to_pylist()
                texts = [render(p) for p in pages]
                yield pa.RecordBatch.from_arrays(
                    [
                        *part.columns[:-1], pa.array([title_of(p) for p in pages], pa.string()), pa.array(texts, pa.string()),
                        pa.array([t.count("\n") + 1 if t else 0 for t in texts], pa.int64()),
                    ],
                    names=[*part.schema.names[:-1], "title", "text", "n_lines"],
                )

    return rows.mapInArrow(run, schema)
