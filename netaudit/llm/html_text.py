"""HTML extraction: layout-aware rendering of all visible text."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from netaudit.llm.common import free, quoted
from netaudit.llm.words import slices

#: Fixed values of HTML: elements without content, without visible text, that stand as blocks, whose text runs to their end tag, that belong in a head.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
HIDDEN = frozenset("script style head title desc template noscript iframe object datalist audio video canvas annotation annotation-xml".split())
BLOCK = frozenset("address article aside blockquote body center details dialog dd div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol optgroup option p pre section summary textarea ul".split())
RAW = frozenset("script style textarea title iframe noscript".split())
HEAD = frozenset("base link meta title style script template noscript".split())
PARTS = frozenset("thead tbody tfoot tr".split())
#: An opening tag closes these, up to the elements that bound the search.
_CLOSES = {"li": ("li", "ul ol menu table"), "dt": ("dt dd", "dl table"), "dd": ("dt dd", "dl table"), "tr": ("tr", "table"), "td": ("td th", "table"), "th": ("td th", "table"), "option": ("option", "select table"), "optgroup": ("option optgroup", "select table")}
_CLOSES |= {t: ("thead tbody tfoot tr", "table") for t in ("thead", "tbody", "tfoot")}
_CLOSES = {t: (tuple(a.split()), tuple(b.split())) for t, (a, b) in _CLOSES.items()}
_ENDS_P = BLOCK - {"li", "dd", "dt", "body", "html", "option", "optgroup", "textarea"} | {"p", "table"}
_SPACED = frozenset("p h1 h2 h3 h4 h5 h6 blockquote ul ol dl pre figure".split())
_OPENING = re.compile(r"<(?:(/?)([a-zA-Z][^\s/>]*)|!--|!\[CDATA\[|[!?/])")
_QUOTED_END = re.compile(r"(?:[^>\"']|\"[^\"]*\"|'[^']*')*+>")
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*+=\s*+(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_RAW_END = {t: re.compile(rf"</{t}(?=[\s/>])", re.I) for t in RAW}
_COMMENT = re.compile(r"/\*.*?(?:\*/|\Z)", re.S)
_SIMPLE = re.compile(r"([a-zA-Z][\w-]*)?([.#][\w-]+)?")
_DECLARED = re.compile(r"(display|visibility)\s*+:\s*+([a-z-]+)", re.I)
_EMPTY_COMMENT = re.compile(r"-?>")
#: Display values of elements that stand in lines of their own, and of those that stand in a line; buttons of a form and what they say by themselves.
_AS_BLOCK = frozenset("block flex grid list-item table flow-root table-row table-caption table-row-group".split())
_AS_INLINE = frozenset("inline inline-block inline-flex inline-grid inline-table contents".split())
_BUTTONS = {"submit": "Submit", "reset": "Reset", "button": ""}
_BLANK = re.compile(r"[ \t\r\n\f]+")
#: Tags with an unclosed quote after which quotes count no more in a page; tables in tables beyond which cells are plain blocks; the widest column that
#: cells are padded to; most columns and rows that one cell spans; columns
#: in which cells of rows below make way for it; the deepest indent. They bound time and memory and drop no text.
_BAD_QUOTES, _DEEPEST, _WIDEST, _SPAN, _COVERED, _INDENTS = 8, 6, 80, 100, 4, 16


#: Attributes that matter on these elements only.
_OWN = {"li": ("value",), "input": ("type", "value")}


@dataclass(slots=True)
class Node:
    tag: str
    attributes: dict[str, str] = field(default_factory=dict)
    children: list = field(default_factory=list)


@dataclass
class Page:
    """The element tree and the text of its style elements."""

    root: Node
    styles: list[str]


def parse(html: str) -> Page:
    """The element tree. Missing tags are implied: a block closes an open p, items and cells close their forerunners, cells get the
    row they need, text closes an open head, and an end tag closes what is open within its element or else is passed over. A tag whose quote is never closed ends
    at the next >. Time is linear in the page: open elements are found by their tag, not by a walk."""
    page = Page(Node("html"), [])
    stack, at_tag = [page.root], {"html": [0]}  # open elements, and for each tag the places of its open ones
    at, bad, last = 0, 0, html.rfind(">")

    def put(text: str) -> None:
        if text:
            if "head" in at_tag and at_tag["head"] and not text.isspace():
                close(("head",))
            stack[-1].children.append(text)

    def latest(tags: tuple[str, ...]) -> int:
        return max((at_tag[t][-1] for t in tags if at_tag.get(t)), default=-1)

    def close(tags: tuple[str, ...], bounds: tuple[str, ...] = ()) -> None:
        k = latest(tags)
        if k > max(0, latest(bounds)):
            while len(stack) > k:
                at_tag[stack.pop().tag].pop()

    def push(node: Node) -> None:
        stack[-1].children.append(node)
        at_tag.setdefault(node.tag, []).append(len(stack))
        stack.append(node)

    while at <= last:
        m = _OPENING.search(html, at)
        if not m or m.start() > last:
            break
        put(unescape(html[at : m.start()]))
        at, tag = m.end(), (m[2] or "").lower()
        if not tag:
            if m[0] == "<!--" and (empty := _EMPTY_COMMENT.match(html, at)):
                at = empty.end()
                continue
            mark = "-->" if m[0] == "<!--" else "]]>" if m[0] == "<![CDATA[" else ">"
            end = html.find(mark, at)
            if m[0] == "<![CDATA[":
                put(html[at : end if end >= 0 else len(html)])
            at = end + len(mark) if end >= 0 else len(html)
            continue
        end = _QUOTED_END.match(html, at) if bad < _BAD_QUOTES else None
        if end:
            text, at = html[at : end.end() - 1], end.end()
        else:
            bad += 1
            to = html.find(">", at)
            text, at = html[at:to], to + 1
        if m[1]:
            if tag == "br":
                stack[-1].children.append(Node("br"))
            elif tag == "p" and not at_tag.get("p"):
                stack[-1].children.append(Node("p"))
            else:
                close((tag,), () if tag in ("table", "body", "html") else ("table",))
            continue
        if tag == "html" or (tag == "body" and at_tag.get("body")):
            continue
        if tag in _ENDS_P:
            close(("p",), ("table", "td", "th", "li", "div", "button"))
        if tag not in HEAD and tag != "head":
            close(("head",))
        if tag in _CLOSES:
            close(*_CLOSES[tag])
        if tag in ("td", "th") and latest(("table",)) >= 0 and latest(("tr",)) < latest(("table",)):
            push(Node("tr"))
        found = {a[1].lower(): a[2] or a[3] or a[4] or "" for a in reversed(list(_ATTRIBUTE.finditer(text)))} if text.strip(" /") else {}
        node = Node(tag, {k: unescape(found[k]) for k in ("hidden", "style", "class", "id", "start", "colspan", "rowspan", "open", "label", *_OWN.get(tag, ())) if k in found})
        if tag in RAW:
            stack[-1].children.append(node)
            end = _RAW_END[tag].search(html, at)
            inside = html[at : end.start() if end else len(html)]
            at = end.end() if end else len(html)
            at = (html.find(">", at) + 1 or len(html)) if end else at
            if tag == "style":
                page.styles.append(inside)
            elif tag == "textarea":
                node.children.append(unescape(inside))
        elif tag in VOID:
            stack[-1].children.append(node)
        else:
            push(node)
    left = _OPENING.search(html, at)  # a tag or comment that never ends
    put(unescape(html[at : left.start() if left else len(html)]))
    return page


def _declared(text: str) -> dict[str, str]:
    return {m[1].lower(): m[2].lower() for m in _DECLARED.finditer(text)}


class Styles:
    """display and visibility from a page's style rules with simple selectors: a tag, a class, an id, or a tag with either. Of several that
    fit, ids go before classes before tags, and later before earlier. Rules inside @media and the like are passed over."""

    def __init__(self, texts: list[str]):
        self.rules: dict[str, dict[str, str]] = {}
        depth = 0
        for part in _COMMENT.sub(" ", "\n".join(texts)).split("}"):
            opened = part.count("{")
            if depth == 0 and opened == 1:
                names, body = part.split("{")
                said = _declared(body)
                for name in names.split(",") if said and not names.lstrip().startswith("@") else ():
                    if _SIMPLE.fullmatch(name.strip()) and name.strip():
                        self.rules[name.strip()] = self.rules.pop(name.strip(), {}) | said
            depth = max(0, depth + opened - 1)

    def of(self, node: Node) -> dict[str, str]:
        """What holds for an element, its own style and its hidden attribute included."""
        a = node.attributes
        said = {"display": "none"} if node.tag in HIDDEN or "hidden" in a or (node.tag == "dialog" and "open" not in a) else {}
        if self.rules:
            own = [f".{c}" for c in a.get("class", "").split()]
            ids = [f"#{a['id']}"] if a.get("id") else []
            for name in (node.tag, *own, *(node.tag + c for c in own), *ids, *(node.tag + c for c in ids)):
                said |= self.rules.get(name, {})
        return said | _declared(a["style"]) if "style" in a else said


class _Lines:
    """Text laid out in lines: blanks collapse, blocks start lines, and at most one empty line stands between them."""

    def __init__(self) -> None:
        self.lines: list[str] = []
        self.line: list[str] = []
        self.blank, self.gap, self.pending = True, 0, ""

    def text(self, s: str, pre: bool = False) -> None:
        if pre:
            first, *rest = s.replace("\r\n", "\n").split("\n")
            self.add(first)
            for x in rest:
                self.end(keep=True)
                self.add(x)
            return
        s = _BLANK.sub(" ", s)
        self.add(s.removeprefix(" ") if self.blank else s)

    def add(self, s: str) -> None:
        if s:
            if not self.line:
                if self.gap and self.lines:
                    self.lines += [""] * (self.gap - 1)
                if self.pending:
                    self.line.append(self.pending)
                self.gap, self.pending = 0, ""
            self.line.append(s)
            self.blank = s.endswith(" ")

    def end(self, keep: bool = False) -> None:
        line = "".join(self.line).rstrip()
        if line:
            self.lines.append(line)
        elif keep and self.lines:
            self.lines.append("")
        self.line, self.blank = [], True

    def block(self, spaced: bool) -> None:
        self.end()
        self.gap = max(self.gap, 2 if spaced else 1)

    def done(self) -> list[str]:
        self.end()
        while self.lines and not self.lines[-1]:
            self.lines.pop()
        return self.lines


class _Grid:
    """A table under way: its rows of cells, each cell its lines and the columns it spans."""

    def __init__(self) -> None:
        self.rows: list[list[tuple[list[str], int]]] = []
        self.at = 0  # columns of the last row so far
        self.down: dict[int, int] = {}  # columns that a cell above still covers, for so many rows

    def row(self) -> None:
        self.down = {c: n - 1 for c, n in self.down.items() if n > 1}
        self.rows.append([])
        self.at = 0

    def cell(self, lines: list[str], span: int, rows: int) -> None:
        if not self.rows:
            self.row()
        while self.down.get(self.at):
            self.rows[-1].append(([], 1))
            self.at += 1
        self.rows[-1].append((lines, span))
        if rows > 1:
            self.down |= {c: rows for c in range(self.at, min(self.at + span, _COVERED))}
        self.at += span

    def laid_out(self) -> list[str]:
        """The rows, cells padded to their columns' widths and parted by ` | `; a row is as high as its highest cell."""
        widths: dict[int, int] = {}
        for row in self.rows:
            at = 0
            for lines, span in row:
                if span == 1:
                    widths[at] = max(widths.get(at, 0), min(_WIDEST, max(map(len, lines), default=0)))
                at += span
        out = []
        for row in self.rows:
            places, at = [], 0
            for lines, span in row:
                places.append((lines, min(_WIDEST, sum(widths.get(at + k, 0) for k in range(span)) + 3 * (span - 1))))
                at += span
            for k in range(max((len(lines) for lines, _ in places), default=0)):
                out.append(" | ".join((lines[k] if k < len(lines) else "").ljust(w) for lines, w in places).rstrip())
        return out


def _span(node: Node, name: str) -> int:
    value = node.attributes.get(name, "")
    return min(_SPAN, max(1, int(value))) if re.fullmatch(r"\d{1,9}", value) else 1


def _shown_children(n: Node) -> list:
    """An element's children as they are shown: of details that are closed the first summary, and a table's foot after its bodies."""
    if n.tag == "details" and "open" not in n.attributes:
        return [c for c in n.children if isinstance(c, Node) and c.tag == "summary"][:1]
    if n.tag == "table":
        return sorted(n.children, key=lambda c: isinstance(c, Node) and c.tag == "tfoot")
    return n.children


def render(page: Page) -> str:
    """All visible text of a page. Walks with a stack of its own, so deep nesting costs memory and no recursion. Each cell of a table has lines of
    its own, blocks and tables in it too; tables nested deeper than _DEEPEST are plain blocks. Whatever of a table stands outside its cells comes before it."""
    styles, out = Styles(page.styles), _Lines()
    outer: list[tuple[_Lines, _Grid | None]] = []  # for each open cell and table what it goes back to
    grid = None
    todo: list[tuple] = [("in", c, (0, False, None, True, 0)) for c in reversed(page.root.children)]
    while todo:
        what, n, (depth, pre, count, seen, tables) = todo.pop()
        if what == "out":
            out.block(n.tag in _SPACED and not (n.tag in ("ul", "ol") and depth > 1))
            if n.tag == "li":
                out.pending = ""
        elif what == "cell":
            lines = out.done()
            out, grid = outer.pop()
            grid.cell(lines, _span(n, "colspan"), _span(n, "rowspan"))
        elif what == "table":
            lines = grid.laid_out()
            out.block(False)
            out, grid = outer.pop()
            for line in lines:
                out.text(line, pre=True)
                out.end()
                out.gap = max(out.gap, 1)
            out.block(True)
        elif isinstance(n, str):
            if seen:
                out.text(n, pre)
        else:
            said = styles.of(n)
            if said.get("display") == "none" or n.tag == "img":
                continue
            if "visibility" in said:
                seen = said["visibility"] == "visible" or (said["visibility"] not in ("hidden", "collapse") and seen)
            inner = (depth, pre or n.tag in ("pre", "textarea"), count, seen, tables)
            if n.tag == "br":
                if seen:
                    out.end(keep=True)
                continue
            if n.tag == "input":
                kind = n.attributes.get("type", "").lower()
                if seen and kind in _BUTTONS:
                    out.text(n.attributes.get("value", _BUTTONS[kind]))
                continue
            shown = said.get("display", "")
            if n.tag == "table" and tables < _DEEPEST:
                out.block(True)
                todo.append(("table", n, inner))
                outer.append((out, grid))
                grid = _Grid()
                inner = (0, pre, None, seen, tables + 1)
            elif n.tag == "tr" and grid is not None and tables <= _DEEPEST:
                out.block(False)
                grid.row()
            elif n.tag in ("td", "th") and grid is not None and tables <= _DEEPEST:
                todo.append(("cell", n, inner))
                outer.append((out, grid))
                out, grid = _Lines(), None
                inner = (0, pre, None, seen, tables)
            else:
                if n.tag in ("ul", "ol"):
                    start = n.attributes.get("start", "")
                    depth, count = depth + 1, [(int(start) if re.fullmatch(r"-?\d{1,9}", start) else 1) if n.tag == "ol" else None]
                    inner = (depth, pre, count, seen, tables)
                block = n.tag in BLOCK or n.tag in PARTS or n.tag in ("table", "td", "th", "caption")
                if shown in _AS_BLOCK or (block and shown not in _AS_INLINE):
                    if n.tag == "table":
                        inner = (depth, pre, count, seen, _DEEPEST + 1)
                    out.block(n.tag in _SPACED and not (n.tag in ("ul", "ol") and depth > 1))
                    todo.append(("out", n, (depth, pre, count, seen, tables)))
                if n.tag == "li":
                    value = n.attributes.get("value", "")
                    if count and count[0] is not None and re.fullmatch(r"-?\d{1,9}", value):
                        count[0] = int(value)
                    number = count[0] if count else None
                    if seen:
                        out.pending = "  " * min(_INDENTS, max(0, depth - 1)) + ("- " if number is None else f"{number}. ")
                    if number is not None:
                        count[0] += 1
                if n.tag == "optgroup" and n.attributes.get("label") and seen:
                    out.text(n.attributes["label"])
                    out.end()
            todo += [("in", c, inner) for c in reversed(_shown_children(n))]
    return "\n".join(out.done()).strip("\n")


def _rendered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for b in slices(whole, "html"):
            texts = [render(parse(h)) if h else "" for h in b.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("row"), pa.array(texts, pa.string())], names=["row", "visible_text"])


def html_text(pages: DataFrame, columns: list[str], html_col: str = "html") -> DataFrame:
    """The given columns of every row of pages with visible_text, all text that a browser shows, laid out; if visible_text is among the
    columns, the added one is _visible_text.

    Scripts, styles, the head, comments and elements hidden by attribute, inline style or a simple rule of the page's own style elements give nothing;
    visibility can be turned on again inside, and display makes blocks of other elements and the reverse. Closed details show their summary, buttons their value. Blocks begin lines, paragraphs, headings, lists and
    tables stand apart by an empty line, list items get bullets or numbers and an indent, cells of a table are aligned, with their own lines, `pre`
    keeps its blanks. Navigation and footers are text like any other. A null or empty page gives the empty text. Broken markup is read as far as it
    goes. Very long pages take time in proportion. Rows are rendered one by one, so repeated rows get equal texts, and an empty table gives an empty result."""
    rows = pages.select(F.struct(*quoted(columns)).alias("row"), F.col(html_col).alias("html"))
    out = rows.mapInArrow(_rendered, StructType([rows.schema["row"], StructField("visible_text", StringType())]))
    return out.select("row.*", F.col("visible_text").alias(*free(pages.select(*quoted(columns)), "visible_text")))
