"""Visible text of web pages, laid out as a browser would.

A tolerant tree builder turns the markup into elements: void elements, raw-text elements and implied end tags (a paragraph
ends where a block starts, an item where the next item starts, a cell where the next cell or row starts) are known, end tags
without a start are ignored, and what is open at the end of the page is closed.  Visibility rules drop what a reader does not
see: the head, scripts, styles, templates, the invisible parts of drawings and formulas, elements with ``hidden`` or ``display:none`` or ``visibility:hidden``, and the closed
part of ``details``.  A layout pass walks the tree with a stack of its own, so depth is no limit, and writes *all* remaining
text: blocks on lines of their own with blank lines where they have margins, bulleted and numbered lists with indentation,
preformatted text as it is, and tables with aligned columns.

Defined results: a null or empty page has the empty text.  Broken markup never fails: a ``<`` that opens no tag is text, an
unfinished tag or comment at the end is dropped.  Repeated rows are rendered each; null ids are kept; extra columns are not
read.  Pages are read whole.
"""

from __future__ import annotations

import html
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame

from changegate.llm.common import arrow_map

SCHEMA = "page_id bigint, text string, n_lines int, n_chars int"

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style xmp iframe noembed noframes noscript textarea title".split())
UNSEEN = frozenset(
    "head script style template noscript iframe noembed noframes title datalist object audio video canvas "
    "desc defs metadata symbol clippath mask pattern marker annotation annotation-xml".split()  # of drawings and formulas
)
# Blocks and the blank lines around them.
MARGIN = {
    **dict.fromkeys(
        "html body div section article aside header footer nav main form fieldset legend address center li dt dd summary details "
        "figcaption caption option optgroup select textarea button hgroup search menuitem tr thead tbody tfoot".split(), 0
    ),
    **dict.fromkeys("p h1 h2 h3 h4 h5 h6 ul ol dl menu dir pre blockquote figure table hr xmp listing".split(), 1),
}
INLINE_BLOCKS = frozenset("select button".split())
CLOSE_P = frozenset(MARGIN) - frozenset("html body li dt dd option optgroup select button tr thead tbody tfoot caption legend".split())
LISTS = frozenset("ul ol menu dir".split())
# A start tag ends the nearest open element of the first set, unless one of the second is in between.
_TABLE = frozenset(["table"])
IMPLIED = {
    "li": (frozenset(["li"]), LISTS | _TABLE),
    "dt": (frozenset(["dt", "dd"]), frozenset(["dl", "table"])),
    "dd": (frozenset(["dt", "dd"]), frozenset(["dl", "table"])),
    "option": (frozenset(["option"]), frozenset(["select", "datalist", "optgroup"])),
    "optgroup": (frozenset(["optgroup", "option"]), frozenset(["select"])),
    "td": (frozenset(["td", "th"]), _TABLE),
    "th": (frozenset(["td", "th"]), _TABLE),
    "tr": (frozenset(["tr"]), _TABLE),
    "thead": (frozenset(["thead", "tbody", "tfoot"]), _TABLE),
    "tbody": (frozenset(["thead", "tbody", "tfoot"]), _TABLE),
    "tfoot": (frozenset(["thead", "tbody", "tfoot"]), _TABLE),
    "body": (frozenset(["head"]), frozenset()),
}
SCOPE = frozenset("table td th caption button".split())
MAX_SPAN = 1000  # HTML's own bound of a column span
# Memory stays linear in the page: where aligning all of a table would take more than PADDING times its text and some thousand
# characters, its cells wider than NARROW are not aligned to; levels beyond the depth that browsers build are not indented further.
PADDING, SPARE, NARROW, MAX_INDENTS = 16, 1 << 16, 60, 512

_TAG = re.compile(r"<(?:(!--)|([!?])|(/?)([a-zA-Z][^\s/>]*+))")
_ATTRIBUTES = re.compile(r"""[^>"']*+(?:"[^"]*+"[^>"']*+|'[^']*+'[^>"']*+)*+>""")
_ATTRIBUTE = re.compile(r"""([^\s"'<>/=]++)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s"'<>`]++)))?""")
_HIDING = re.compile(r"hidden|style|open|value|type|span|start|reversed|selected", re.I)
_DISPLAY_NONE = re.compile(r"display\s*:\s*none", re.I)
_VISIBILITY = re.compile(r"visibility\s*:\s*(hidden|collapse|visible)", re.I)


class Element:
    __slots__ = ("tag", "attributes", "children")

    def __init__(self, tag: str, attributes: dict[str, str]):
        self.tag, self.attributes, self.children = tag, attributes, []


def _attributes(source: str) -> dict[str, str]:
    """The attributes of a start tag; most tags have none that matters here."""
    if not source or not _HIDING.search(source):
        return {}
    return {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "") for m in _ATTRIBUTE.finditer(source)}


def parse(page: str) -> Element:
    """The tree of a page."""
    root = Element("html", {})
    stack, opened = [root], Counter()
    at, size, last_end = 0, len(page), page.rfind(">")

    def close(to: int) -> None:
        while len(stack) > to:
            opened[stack.pop().tag] -= 1

    def nearest(tags: frozenset, stop: frozenset) -> int | None:
        if not any(opened[t] for t in tags):
            return None
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].tag in tags:
                return i
            if stack[i].tag in stop:
                return None
        return None

    while at < size:
        found = _TAG.search(page, at)
        if found is None or last_end < found.start():
            # What opens a tag and never ends is dropped; otherwise the rest is text.
            stack[-1].children.append(html.unescape(page[at : found.start() if found else size]))
            break
        if found.start() > at:
            stack[-1].children.append(html.unescape(page[at : found.start()]))
        if found[1]:
            end = page.find("-->", found.end() - 2)
            at = size if end < 0 else end + 3
            continue
        if found[2]:
            end = page.find(">", found.end())
            at = size if end < 0 else end + 1
            continue
        tag = found[4].lower()
        end = page.find(">", found.end())
        source = page[found.end() : end]
        if '"' in source or "'" in source:
            whole = _ATTRIBUTES.match(page, found.end())
            if whole:  # else a quote is never closed, and the tag ends at the first ">"
                end = whole.end() - 1
                source = page[found.end() : end]
        at = end + 1
        if found[3]:
            if tag == "p" and not opened["p"]:
                stack[-1].children.append(Element("p", {}))
            elif tag == "br":
                stack[-1].children.append(Element("br", {}))
            else:
                i = nearest(frozenset([tag]), frozenset() if tag in SCOPE or tag in ("tr", "tbody", "thead", "tfoot") else SCOPE - {tag})
                if i is not None:
                    close(i)
            continue
        if tag in IMPLIED:
            tags, stop = IMPLIED[tag]
            i = nearest(tags, stop)
            if i is not None:
                close(i)
        if tag in CLOSE_P:
            i = nearest(frozenset(["p"]), SCOPE)
            if i is not None:
                close(i)
        if tag in ("html", "body") and tag != "body":
            continue  # the root is there already
        element = Element(tag, _attributes(source))
        stack[-1].children.append(element)
        if tag in VOID or (source.endswith("/") and tag in ("svg", "path")):
            continue
        if tag in RAW:
            stop = re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.I).search(page, at)
            text = page[at : stop.start() if stop else size]
            element.children.append(html.unescape(text) if tag in ("textarea", "title") else text)
            end = page.find(">", stop.end()) if stop else -1
            at = size if end < 0 else end + 1
            continue
        stack.append(element)
        opened[tag] += 1
    return root


class _Flow:
    """Lines of one box: the page, or a table cell."""

    def __init__(self):
        self.lines: list[str] = []
        self.line: list[str] = []
        self.indents: list[str] = []
        self.bullet: str | None = None
        self.gap = 0
        self.spaced = False  # white space was met since the last word of this line

    def text(self, text: str) -> None:
        words = text.split(" ") if "\xa0" in text else None
        if words is not None:
            words = [w for part in words for w in re.split(r"[\t\n\f\r]+", part) if w]
            first, last = text[0] in " \t\n\f\r", text[-1] in " \t\n\f\r"
        else:
            words = text.split()
            first, last = text[:1].isspace(), text[-1:].isspace()
        if not words:
            self.spaced = self.spaced or bool(text)
            return
        if self.line and (self.spaced or first):
            self.line.append(" ")
        self.line.append(" ".join(words))
        self.spaced = last

    def verbatim(self, text: str) -> None:
        first, *rest = text.replace("\r\n", "\n").replace("\r", "\n").split("\n")
        self.line.append(first)
        for part in rest:
            self.new_line(keep=True)
            self.line.append(part)

    def new_line(self, keep: bool = False) -> None:
        """End the line; an empty one counts only where it is kept."""
        if self.line or keep:
            self.put("".join(self.line))
            self.line = []
        self.spaced = False

    def put(self, text: str) -> None:
        if self.gap and self.lines:
            self.lines.append("")
        self.gap = 0
        if self.bullet is not None:
            prefix, self.bullet = "".join(self.indents[:-1][:MAX_INDENTS]) + self.bullet, None
        else:
            prefix = "".join(self.indents[:MAX_INDENTS])
        self.lines.append((prefix + text).rstrip(" \t\n\r\f"))

    def block(self, margin: int) -> None:
        self.new_line()
        # Margins do not part an item's mark from its first line.
        if self.bullet is None:
            self.gap = max(self.gap, margin)

    def finish(self) -> list[str]:
        self.new_line()
        if self.bullet is not None:
            self.put("")
        while self.lines and not self.lines[-1]:
            self.lines.pop()
        return self.lines


class _Table:
    """Rows of cells, each cell its lines, with the columns that it covers."""

    def __init__(self):
        self.rows: list[list[tuple[int, int, list[str]]]] = []
        self.blocked: dict[int, int] = {}  # column -> rows below that a cell above still covers
        self.column = 0

    def row(self) -> None:
        self.rows.append([])
        self.column = 0
        self.covered = {c for c, n in self.blocked.items() if n > 0}
        self.blocked = {c: n - 1 for c, n in self.blocked.items() if n > 1}

    def cell(self, lines: list[str], across: int, down: int) -> None:
        if not self.rows:
            self.row()
        while self.column in self.covered:
            self.column += 1
        self.rows[-1].append((self.column, across, lines))
        if down > 1:
            for c in range(self.column, self.column + across):
                self.blocked[c] = down - 1
        self.column += across

    def starts(self, widest: int | None) -> dict[int, int]:
        """Where the columns start if cells up to a width are aligned to."""
        widths: dict[int, int] = {}
        for row in self.rows:
            for column, across, lines in row:
                widths.setdefault(column, 0)
                if across == 1:
                    fits = [len(line) for line in lines if widest is None or len(line) <= widest]
                    widths[column] = max([widths[column], *fits])
        starts, place = {}, 0
        for column in sorted(widths):
            starts[column] = place
            place += widths[column] + 2
        return starts

    def lines(self) -> list[str]:
        starts = self.starts(None)
        text = sum(len(line) for row in self.rows for _, _, lines in row for line in lines)
        padded = sum(starts[row[-1][0]] * max(len(lines) for _, _, lines in row) for row in self.rows if row)
        if padded > PADDING * text + SPARE:
            starts = self.starts(NARROW)
        out = []
        for row in self.rows:
            for k in range(max((len(lines) for _, _, lines in row), default=0)):
                line = ""
                for column, _, lines in row:
                    if k < len(lines) and lines[k]:
                        line = (line + "  " if len(line) > starts[column] - 2 and line else line).ljust(starts[column]) + lines[k]
                out.append(line.rstrip())
        return out


def _number(text: str | None, low: int, high: int, default: int) -> int:
    found = re.match(r"\s*([+-]?\d{1,9})", text or "")
    return min(high, max(low, int(found[1]))) if found else default


def _unseen(element: Element) -> bool:
    given = element.attributes
    return element.tag in UNSEEN or "hidden" in given or ("style" in given and bool(_DISPLAY_NONE.search(given["style"])))


def render(root: Element) -> list[str]:
    """The lines of the tree's visible text."""
    flows, tables, counters = [_Flow()], [], []
    # Entries are (node, visible, preformatted, entering).
    todo: list[tuple] = [(root, True, False, True)]
    while todo:
        node, visible, pre, entering = todo.pop()
        flow = flows[-1]
        if isinstance(node, str):
            if visible and node:
                if pre:
                    flow.verbatim(node)
                elif tables and tables[-1][1] is flow and not node.strip():
                    pass  # white space between rows and cells
                else:
                    flow.text(node)
            continue
        tag = node.tag
        if entering:
            if _unseen(node):
                continue
            if "style" in node.attributes and (found := _VISIBILITY.search(node.attributes["style"])):
                visible = found[1].lower() == "visible"
            if tag == "br":
                flow.new_line(keep=visible and bool(flow.lines or flow.line))
                continue
            if tag == "input":
                if visible and node.attributes.get("type", "text").lower() in ("text", "submit", "button", "reset", "search", "email", "url", "tel", "number"):
                    flow.text(f" {node.attributes.get('value', '')} ")
                continue
            if tag in MARGIN and tag not in INLINE_BLOCKS:
                # The first block of a list inside a list has no blank line.
                flow.block(0 if (tag in LISTS and counters) else MARGIN[tag])
            elif tag in INLINE_BLOCKS:
                flow.text(" ")
            if tag == "hr":
                continue
            children = node.children
            if tag in LISTS:
                ordered = tag == "ol"
                start = _number(node.attributes.get("start"), -(10**9), 10**9, 1) if ordered else None
                counters.append([start, flow])
            elif tag == "li":
                owner = counters[-1] if counters and counters[-1][1] is flow else None
                mark = "- "
                if owner and owner[0] is not None:
                    mark = f"{_number(node.attributes.get('value'), -(10**9), 10**9, owner[0])}. "
                    owner[0] = int(mark[:-2]) + 1
                flow.indents.append(" " * len(mark))
                flow.bullet = mark
            elif tag in ("dd", "blockquote"):
                flow.indents.append("  ")
            elif tag == "q":
                flow.text("“") if not flow.spaced else flow.text(" “")
            elif tag == "table":
                tables.append((_Table(), flow))
            elif tag == "tr" and tables and tables[-1][1] is flow:
                tables[-1][0].row()
            elif tag in ("td", "th") and tables and tables[-1][1] is flow:
                flows.append(_Flow())
            elif tag == "details" and "open" not in node.attributes:
                children = [c for c in children if isinstance(c, Element) and c.tag == "summary"]
            pre = pre or tag in ("pre", "textarea", "xmp", "listing")
            if tag in ("pre", "textarea", "listing") and children and isinstance(children[0], str):
                children = [children[0].removeprefix("\n"), *children[1:]]
            todo.append((node, visible, pre, False))
            todo.extend((child, visible, pre, True) for child in reversed(children))
            continue
        # Leaving the element.
        if tag in ("td", "th") and len(flows) > 1 and tables and tables[-1][1] is not flow:
            lines = flows.pop().finish()
            across = _number(node.attributes.get("colspan"), 1, MAX_SPAN, 1)
            tables[-1][0].cell(lines, across, _number(node.attributes.get("rowspan"), 1, 65534, 1))
            continue
        if tag == "table" and tables and tables[-1][1] is flow:
            table, _ = tables.pop()
            flow.block(1)
            for line in table.lines():
                flow.put(line)
        elif tag in LISTS and counters:
            counters.pop()
        elif tag == "li":
            flow.new_line()
            if flow.bullet is not None:
                flow.put("")  # an empty item keeps its mark
            flow.indents.pop()
        elif tag in ("dd", "blockquote"):
            flow.new_line()
            flow.indents.pop()
        elif tag == "q":
            flow.spaced = False
            flow.text("”")
        if tag in MARGIN and tag not in INLINE_BLOCKS:
            flow.block(0 if (tag in LISTS and counters) else MARGIN[tag])
        elif tag in INLINE_BLOCKS:
            flow.text(" ")
    while len(flows) > 1:
        rest = flows.pop().finish()
        for line in rest:
            flows[-1].put(line)
    return flows[0].finish()


def visible_text(page: str | None) -> str:
    return "\n".join(render(parse(page))).replace("\xa0", " ") if page else ""


def _extract(batch: pa.RecordBatch) -> list:
    texts = [visible_text(page) for page in batch.column(1).to_pylist()]
    return [batch.column(0), texts, [t.count("\n") + 1 if t else 0 for t in texts], [len(t) for t in texts]]


def extract_text(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """page_id, the whole visible text, its lines and characters; one row per page and no shuffle."""
    narrow = pages.selectExpr(f"cast(`{id_col}` as bigint) as page_id", f"cast(`{html_col}` as string) as html")
    return arrow_map(narrow, _extract, SCHEMA)
