r"""HTML extraction by layout-aware rendering.

A tokenizer cuts the page into tags and text; a tree builder closes what HTML lets authors leave
open (p, li, dt, dd, option, table rows and cells, and whatever is open when an outer element ends)
and adds the rows that stray cells need. A renderer walks the tree and writes all visible text:
blocks on lines of their own, a blank line around paragraphs, headings, lists, tables and the like,
list items with markers and indentation, table cells in aligned columns, preformatted text as it
stands. Formulas (math), the labels of drawings (svg) and the contents of a textarea stand in line.
Visibility follows the elements that never show, the ``hidden`` attribute, and the inline
styles ``display:none`` and ``visibility:hidden`` (which a child may lift by ``visible``). Of a closed
``details`` only its summary shows, of a closed ``dialog`` nothing. Of a select the chosen option is written (the last
that is marked, else the first), of one that shows several lines every option; of buttons the label.

Both walks use explicit stacks, so that depth of nesting is no limit. A page is read whole. What grows with
the layout rather than with the page is bounded: lines are indented by ``MOST_INDENT`` characters at most, a
cell of more than ``MOST_WIDTH`` characters does not move the columns beside it, and a line is padded by at most
``MOST_PADDING`` blanks (beyond that, cells stand two blanks apart). No text is left out for it.

Defined results: null and empty pages, and pages that show nothing, give an empty text; broken markup
is read as text or closed at the end; repeated rows give repeated results; an empty table gives an
empty result; other columns stay, and one named ``text`` is replaced.
"""

from __future__ import annotations

import html
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tagloom.llm.common import slices

# Names of HTML's elements by what a renderer does with them.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
UNSEEN = frozenset("head script style title template noscript noembed noframes iframe object audio video canvas datalist area base link meta param source track map annotation annotation-xml mphantom".split())
#: Elements of a drawing that show no text where they stand; all other text of a drawing shows only inside DRAWN_TEXT.
UNDRAWN = frozenset("defs symbol clippath mask pattern marker metadata desc".split())
DRAWN_TEXT = frozenset(("text", "foreignobject"))
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table ul xmp caption tr".split())
SPACED = frozenset("blockquote dl fieldset figure h1 h2 h3 h4 h5 h6 ol p pre table ul menu hr".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section summary table ul xmp".split())
#: A start tag ends these open elements, unless one of the walls is nearer.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "tr": ({"tr", "caption", "colgroup"}, {"table"}),
    "tbody": ({"tbody", "thead", "tfoot", "caption", "colgroup"}, {"table"}), "thead": ({"tbody", "thead", "tfoot", "caption", "colgroup"}, {"table"}),
    "tfoot": ({"tbody", "thead", "tfoot", "caption", "colgroup"}, {"table"}), "option": ({"option"}, {"select"}), "optgroup": ({"option", "optgroup"}, {"select"}),
    "body": ({"head"}, set()),
}
CELL_WALLS = frozenset(("td", "th", "caption", "table"))
TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?"
    r"|<(?P<end>/?)(?P<name>[A-Za-z][^\s/>]*)(?P<rest>(?:[^>\"']++|\"[^\"]*\"|'[^']*')*+)>|</?[A-Za-z][^>]*>",
    re.S,
)
UNENDED = re.compile(r"(?P<end>)(?P<name>(?!))?(?P<rest>)(?:<!--.*|<!\[CDATA\[.*|<[!?][^>]*)", re.S)
ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
BLANKS = re.compile(r"[ \t\n\f\r]+")
HIDES, UNSEES, SEES = (re.compile(p, re.I) for p in (r"(?:^|;)\s*display\s*:\s*none", r"(?:^|;)\s*visibility\s*:\s*(?:hidden|collapse)", r"(?:^|;)\s*visibility\s*:\s*visible"))
MOST_COLUMNS = 1000  # what HTML allows a cell to span
MOST_INDENT, MOST_WIDTH, MOST_PADDING = 40, 200, 1000
BUTTONS = frozenset(("submit", "button", "reset"))
ZEROS, HUGE = re.compile(r"&#0+(?=[0-9])"), re.compile(r"&#[0-9]{8,};?")
SLICE = 4_000_000


class Node:
    __slots__ = ("tag", "attrs", "children")

    def __init__(self, tag: str, attrs: dict[str, str] | None = None):
        self.tag, self.attrs, self.children = tag, attrs or {}, []


def unescape(text: str) -> str:
    """Character references resolved; numbers beyond all characters become U+FFFD."""
    if "&#" in text:
        text = HUGE.sub("\ufffd", ZEROS.sub("&#", text))
    return html.unescape(text)


def attributes(rest: str) -> dict[str, str]:
    if not rest or rest.isspace():
        return {}
    return {m[1].lower(): unescape(m[2].strip("\"'")) if m[2] else "" for m in ATTRIBUTE.finditer(rest)}


def tree(page: str) -> Node:
    """The page's elements; text is in the children as str."""
    root = Node("#root")
    stack = [root]
    opened: dict[str, list[int]] = {}  # places in the stack by tag
    at = 0
    last_end = page.rfind(">")

    def enter(node: Node) -> None:
        opened.setdefault(node.tag, []).append(len(stack))
        stack.append(node)

    def nearest(*names: str) -> int:
        """The place of the innermost open element of these names, 0 if there is none."""
        return max((opened[n][-1] for n in names if opened.get(n)), default=0)

    def close_until(names, walls) -> None:
        """End the nearest open element of these names, and all inside it, if no wall is nearer."""
        k = nearest(*names)
        if k and k >= nearest(*walls):
            for n in stack[k:]:
                opened[n.tag].pop()
            del stack[k:]

    # behind the last ">" only a comment or the like can begin
    while m := (TOKEN.search(page, at) if at <= last_end else UNENDED.search(page, at)):
        if m.start() > at:
            stack[-1].children.append(unescape(page[at : m.start()]))
        at = m.end()
        tag = m["name"]
        if tag is None:
            if page.startswith("<![CDATA[", m.start()):
                stack[-1].children.append(page[m.start() + 9 : at].removesuffix("]]>"))
            continue
        tag = tag.lower()
        if m["end"]:
            if tag == "p" and not opened.get("p"):
                stack[-1].children.append(Node("p"))
            elif tag == "br":
                stack[-1].children.append(Node("br"))
            else:
                close_until({tag}, CELL_WALLS if tag not in ("table", "tr", "td", "th", "tbody", "thead", "tfoot", "caption", "body", "html") else {"table"} - {tag})
            continue
        if tag in CLOSES_P:
            close_until({"p"}, {"button", *CELL_WALLS})
        if tag in ENDS:
            names, walls = ENDS[tag]
            close_until(names, walls)
            if tag in ("td", "th"):
                if nearest("tr") <= nearest("table"):
                    row = Node("tr")
                    stack[-1].children.append(row)
                    enter(row)
            elif tag == "tr":
                close_until({"td", "th"}, {"table"})
        node = Node(tag, attributes(m["rest"]))
        stack[-1].children.append(node)
        if tag in VOID or m["rest"].endswith("/") and (tag in ("svg", "math", "path") or nearest("svg", "math") > nearest("foreignobject")):
            continue
        if tag in RAW:
            end = re.compile(rf"</{tag}(?=[\s/>])[^>]*>?", re.I).search(page, at)
            inner = page[at : end.start() if end else len(page)]
            if tag == "xmp":
                node.children.append(inner)
            elif tag == "textarea":
                node.children.append(unescape(re.sub(r"\A\r?\n", "", inner)))
            at = end.end() if end else len(page)
            continue
        enter(node)
    if at < len(page):
        stack[-1].children.append(unescape(page[at:]))
    return root


class Writer:
    """Lines of text with collapsed blanks, block breaks and indentation."""

    def __init__(self):
        self.lines: list[str] = []
        self.line = ""
        self.space = self.blank = False
        self.indent: list[int] = []
        self.width = 0
        self.marker = ""

    def text(self, s: str) -> None:
        s = BLANKS.sub(" ", s)
        if s[:1] == " ":
            self.space = bool(self.line) or self.space
            s = s[1:]
        if not s:
            return
        trailing = s[-1] == " "
        s = s[:-1] if trailing else s
        if self.space and self.line:
            self.line += " "
        self.line += s
        self.space = trailing

    def enter(self, width: int) -> None:
        self.indent.append(width)
        self.width += width

    def leave(self) -> None:
        self.width -= self.indent.pop()

    def close_line(self) -> None:
        if self.line:
            self.put(self.line)
        self.line, self.space = "", False

    def put(self, line: str) -> None:
        if self.blank and self.lines:
            self.lines.append("")
        self.blank = False
        width = self.width
        if self.marker:
            indent = " " * min(MOST_INDENT, width - len(self.marker)) + self.marker
            self.marker = ""
        else:
            indent = " " * min(MOST_INDENT, width)
        self.lines.append((indent + line).rstrip())

    def line_break(self) -> None:
        if self.line:
            self.close_line()
        elif self.lines and not self.blank:
            self.blank = True

    def text_ahead(self) -> None:
        """Write the blank that is due before preformatted text in line."""
        if self.space and self.line:
            self.line += " "
        self.space = False

    def raw(self, s: str) -> None:
        head, *rest = s.replace("\r\n", "\n").replace("\r", "\n").split("\n")
        self.line += head
        for x in rest:
            self.put(self.line)
            self.line = x


class Table:
    def __init__(self):
        self.rows: list[list[tuple[list[str], int, int]]] = []

    def lines(self) -> list[str]:
        """Cells in aligned columns, two blanks apart; a cell of several lines makes its row higher."""
        grid: list[dict[int, list[str]]] = []
        taken: list[tuple[int, int, int]] = []  # columns that cells from above still fill, as stretches with the rows that are left
        width: dict[int, int] = {}
        for row in self.rows:
            cells: dict[int, list[str]] = {}
            col = k = 0
            below = [(a, b, n - 1) for a, b, n in taken if n > 1]
            for lines, across, down in row:
                while k < len(taken) and taken[k][0] <= col:
                    col = max(col, taken[k][1])
                    k += 1
                cells[col] = lines
                if any(lines):
                    longest = max(map(len, lines)) if across == 1 else 0
                    width[col] = max(width.get(col, 0), longest if longest <= MOST_WIDTH else 0)
                if down > 1:
                    below.append((col, col + across, down - 1))
                col += across
            grid.append(cells)
            taken = sorted(below)
        # where each column that has any text begins
        start, place = {}, 0
        for c in sorted(width):
            start[c] = place
            place += width[c] + 2
        out = []
        for cells in grid:
            full = sorted((c, lines) for c, lines in cells.items() if any(lines))
            for k in range(max((len(lines) for _, lines in full), default=0)):
                line, room = "", MOST_PADDING
                for c, lines in full:
                    if k < len(lines) and lines[k]:
                        wanted = start[c] - len(line)
                        least = 2 if line else 0
                        pad = max(least, wanted) if wanted <= room else least
                        room -= pad
                        line += " " * pad + lines[k]
                out.append(line.rstrip())
        return [x for x in out if x]


def shown_options(select: Node) -> list[Node]:
    """The options that a select shows before anyone touches it."""
    every, todo = [], [select]
    while todo:
        node = todo.pop()
        if node.tag == "option" and "hidden" not in node.attrs:
            every.append(node)
        todo.extend(x for x in reversed(node.children) if isinstance(x, Node))
    size = select.attrs.get("size", "").strip()
    if "multiple" in select.attrs or size.isascii() and size.isdigit() and len(size) < 10 and int(size) > 1:
        return every
    marked = [x for x in every if "selected" in x.attrs]
    free = [x for x in every if "disabled" not in x.attrs]
    return marked[-1:] or free[:1] or every[:1]


def _span(node: Node, name: str) -> int:
    value = node.attrs.get(name, "1").strip()
    return max(1, int(value) if len(value) < 5 and int(value) < MOST_COLUMNS else MOST_COLUMNS) if value.isascii() and value.isdigit() else 1


def render(page: str) -> str:
    """The visible text of a page."""
    writers, tables, lists = [Writer()], [], []
    # entries: node or text, whether it is the leaving of the node, visible, preformatted, in a drawing but not in its text
    todo: list[tuple] = [(tree(page), False, True, False, False)]
    while todo:
        node, leaving, visible, pre, drawing = todo.pop()
        w = writers[-1]
        if isinstance(node, str):
            if visible and not drawing:
                w.raw(node) if pre else w.text(node)
            continue
        tag = node.tag
        if leaving:
            if tag in ("td", "th") and tables and len(writers) > 1:
                w.close_line()
                writers.pop()
                tables[-1].rows[-1].append((w.lines or [""], _span(node, "colspan"), _span(node, "rowspan")))
                continue
            if tag == "table":
                for line in tables.pop().lines():
                    w.put(line)
                lists.pop()
            elif tag in ("ul", "ol", "menu", "dir"):
                lists.pop()
            elif tag in ("li", "dd", "blockquote"):
                w.close_line()
                w.leave()
                w.marker = ""
            elif tag in DRAWN_TEXT and drawing:
                w.text(" ")
            if tag in BLOCK:
                w.close_line()
            if tag in SPACED:
                w.blank = w.blank or bool(w.lines) and not (tag in ("ul", "ol", "menu") and lists and lists[-1] is not None)
            continue
        attrs = node.attrs
        if attrs:
            style = attrs.get("style", "")
            if "hidden" in attrs or style and HIDES.search(style):
                continue
            if style and UNSEES.search(style):
                visible = False
            elif style and SEES.search(style):
                visible = True
        if tag in UNSEEN or drawing and tag in UNDRAWN or tag == "dialog" and "open" not in attrs:
            continue
        if tag == "input":
            if visible and not drawing and attrs.get("type", "").strip().lower() in BUTTONS:
                w.text(f" {attrs.get('value', '')} ")
            continue
        children = node.children
        if tag == "details" and "open" not in attrs:
            children = [x for x in children if isinstance(x, Node) and x.tag == "summary"][:1]
        elif tag == "select":
            children = [x for option in shown_options(node) for x in (" ", *option.children, " ")]
        if tag == "br":
            if visible:
                w.line_break()
            continue
        if tag in BLOCK:
            w.close_line()
        if tag in SPACED:
            # a list inside a list's item keeps close to it
            w.blank = w.blank or bool(w.lines) and not (tag in ("ul", "ol", "menu") and lists and lists[-1] is not None)
        if tag == "table":
            tables.append(Table())
            lists.append(None)
        elif tag == "tr" and tables:
            tables[-1].rows.append([])
        elif tag in ("td", "th") and tables:
            if not tables[-1].rows:
                tables[-1].rows.append([])
            writers.append(Writer())
        elif tag in ("ul", "ol", "menu", "dir"):
            first = attrs.get("start", "1")
            lists.append([int(first) if first.isascii() and first.isdigit() and len(first) < 10 else 1] if tag == "ol" else [])
        elif tag == "li":
            mark = "- "
            if lists and lists[-1]:
                mark = f"{lists[-1][0]}. "
                lists[-1][0] += 1
            w.enter(len(mark))
            w.marker = mark
        elif tag in ("dd", "blockquote"):
            w.enter(2)
        elif tag in DRAWN_TEXT and drawing:
            w.text(" ")  # labels stand apart
        elif tag == "textarea" and visible:
            w.text_ahead()
        pre = pre or tag in ("pre", "xmp", "listing", "textarea")
        todo.append((node, True, visible, pre, drawing))
        drawing = tag == "svg" or drawing and tag not in DRAWN_TEXT
        todo.extend((child, False, visible, pre, drawing) for child in reversed(children))
    w = writers[0]
    w.close_line()
    return "\n".join(w.lines).strip("\n")


def extract(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """``pages`` without ``html_col`` and with ``text``, what a reader of the page sees."""
    kept = [c for c in pages.columns if c not in (html_col, "text")]
    schema = T.StructType([*(pages.schema[c] for c in kept), T.StructField("text", T.StringType())])

    def each(batches):
        for batch in (part for b in batches for part in slices(b, len(kept), SLICE)):
            texts = [render(p or "") for p in batch.column(len(kept)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], pa.array(texts, pa.string())], [*kept, "text"])

    return pages.select(*kept, pages[html_col].cast("string").alias("__html")).mapInArrow(each, schema)
