"""Layout-aware rendering of HTML pages to text.

A tree builder reads tags as a browser does in the main: void elements, raw text elements, implied html, head and body,
tags that an open paragraph, list item, definition, option, row, cell or row group implies closed, end tags that close
what stands open inside, and stray end tags that are ignored. The renderer walks the tree without recursion and emits all
visible text in order:

* not visible: head matter, scripts, styles, templates and the like, what objects, canvas, audio and video hold for browsers without
  them; titles, descriptions and definitions of drawings, and annotations of formulas, whose labels and symbols are text; `hidden`; `display:none` or `visibility:hidden`
  in a style attribute; hidden inputs; comments;
* inline white space collapses; blocks begin and end lines, and paragraphs, headings, lists, quotes, tables and preformatted
  text have a blank line around them; `br` breaks; preformatted text is kept as it is; `hr` is a rule;
* list items have a bullet or their number, and nested lists are indented;
* table cells are rendered each for itself and aligned in columns, with column and row spans.

Nulls and odd input: a null or empty page gives an empty text; broken markup is read as far as it goes, a `<` that opens no tag
is text; an empty table gives an empty result; rows that repeat an id are rendered each for itself. The work is linear
in the page, however deep it is nested, tables too: a line is filled up to 1000 places, and a wide cell takes as many steps as columns, at most 1000.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterable, Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from .common import table

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style xmp iframe noembed noframes textarea title".split())
UNSEEN = frozenset("head script style template noscript title meta link base iframe noembed noframes object canvas audio video datalist desc defs metadata annotation annotation-xml".split())
#: Blocks, and of these the ones with a blank line around them.
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody tfoot thead tr ul caption xmp".split())
SPACED = frozenset("blockquote dl figure h1 h2 h3 h4 h5 h6 menu ol p pre table ul xmp".split())
LISTS = frozenset(("ul", "ol", "menu", "dir"))
CELLS = frozenset(("td", "th"))
#: In these, tags can close themselves.
FOREIGN = frozenset(("svg", "math"))
#: An opening tag closes these if they are open, looking no further out than the bounds.
CLOSES = {
    "li": (("li",), LISTS),
    "dt": (("dt", "dd"), frozenset(("dl",))),
    "dd": (("dt", "dd"), frozenset(("dl",))),
    "option": (("option",), frozenset(("select", "datalist"))),
    "optgroup": (("option", "optgroup"), frozenset(("select",))),
    "tr": (("tr", "td", "th"), frozenset(("table",))),
    "td": (("td", "th"), frozenset(("table", "tr"))),
    "th": (("td", "th"), frozenset(("table", "tr"))),
    "thead": (("thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"), frozenset(("table",))),
    "tbody": (("thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"), frozenset(("table",))),
    "tfoot": (("thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"), frozenset(("table",))),
}
#: Blocks that end an open paragraph.
ENDS_P = BLOCK - {"body", "html", "option", "optgroup", "legend", "tr", "tbody", "thead", "tfoot", "caption"}
SCOPE = frozenset(("table", "td", "th", "caption", "html", "template", "button"))
HEAD = frozenset("head title meta link base style script template noscript".split())

TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|</([a-zA-Z][^\s/>]*)[^>]*(?:>|\Z)|<([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<([a-zA-Z][^\s/>]*)([^>]*)>""", re.S)
#: What is open at the end of a page without a further ">".
UNENDED = re.compile(r"<!|<\?|</[a-zA-Z]")
ATTR = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
GONE = re.compile(r"(?:display\s*:\s*none|visibility\s*:\s*(?:hidden|collapse))", re.I)
SPACE = re.compile(r"[ \t\n\r\f]+")


class Node:
    __slots__ = ("tag", "attrs", "children")

    def __init__(self, tag: str, attrs: str = ""):
        self.tag, self.attrs, self.children = tag, attrs, []

    def attr(self, name: str) -> str | None:
        """The attribute's value, "" if it has none, None if it is missing."""
        if name not in self.attrs.lower():
            return None
        for m in ATTR.finditer(self.attrs):
            if m[1].lower() == name:
                return unescape(next((x for x in m.groups()[1:] if x is not None), ""))
        return None

    def visible(self) -> bool:
        if self.tag in UNSEEN:
            return False
        if not self.attrs:
            return True
        if self.attr("hidden") is not None or (self.tag == "input" and (self.attr("type") or "").lower() == "hidden"):
            return False
        return not GONE.search(self.attr("style") or "")


class Open:
    """The open elements, and for each tag where it stands among them, so that no look-up walks the stack."""

    def __init__(self, root: Node):
        self.nodes = [root]
        self.places: dict[str, list[int]] = {root.tag: [0]}

    def push(self, node: Node) -> None:
        self.places.setdefault(node.tag, []).append(len(self.nodes))
        self.nodes.append(node)

    def cut(self, n: int) -> None:
        """Close all but the first n."""
        while len(self.nodes) > n:
            self.places[self.nodes.pop().tag].pop()

    def last(self, tags: Iterable[str]) -> int:
        """The place of the innermost of tags below the root, 0 if none is open."""
        return max((p[-1] for t in tags if (p := self.places.get(t))), default=0)

    def first_after(self, tags: Iterable[str], place: int) -> int | None:
        """The place of the outermost of tags behind `place`."""
        found = [p[i] for t in tags if (p := self.places.get(t)) and (i := bisect_right(p, place)) < len(p)]
        return min(found, default=None)


def parse(html: str) -> Node:
    root = Node("html")
    body = None
    stack = Open(root)
    at, n = 0, len(html)
    whole = html.rfind(">") + 1  # behind it no tag ends

    def text(s: str) -> None:
        nonlocal body
        if not s:
            return
        if len(stack.nodes) == 1 or stack.nodes[-1].tag == "head":
            if not s.strip(" \t\n\r\f"):
                return
            open_body()
        stack.nodes[-1].children.append(s)

    def open_body() -> None:
        nonlocal body
        if body is None:
            body = Node("body")
            root.children.append(body)
        stack.cut(1)
        stack.push(body)

    def close(tags: tuple[str, ...], bounds: frozenset) -> None:
        """Close the outermost of tags that is open inside the bounds (of a single tag the innermost), with all in it."""
        bound = stack.last(bounds)
        found = stack.first_after(tags, bound) if len(tags) > 1 else max(stack.last(tags), bound)
        if found is not None and found > bound:
            stack.cut(found)

    while at < n:
        m = TOKEN.search(html, at, whole) if at < whole else UNENDED.search(html, at)
        if m is None:
            text(unescape(html[at : max(at, whole)]))
            at = max(at, whole)
            if at == whole < n and UNENDED.search(html, at) is None:
                text(unescape(html[at:]))
                break
            if at >= n:
                break
            continue
        if m.start() > at:
            text(unescape(html[at : m.start()]))
        at = m.end()
        if m.re is UNENDED or (html.startswith("<!--", m.start()) and not m[0].endswith("-->")):
            break  # a comment or tag to the end of the page
        if m[1]:
            tag = m[1].lower()
            if tag == "br":
                stack.nodes[-1].children.append(Node("br"))
            elif tag not in ("html", "body") and tag not in VOID:
                place = stack.last((tag,))
                bounds = frozenset() if tag in ("table", "td", "th", "tr", "tbody", "thead", "tfoot", "caption") else SCOPE
                if tag not in BLOCK and tag not in CELLS:
                    bounds = bounds | CELLS
                if place > stack.last(bounds - {tag}):
                    stack.cut(place)
            continue
        tag = (m[2] or m[4] or "").lower()
        if not tag:
            continue
        attrs = m[3] or m[5] or ""
        if tag == "html":
            root.attrs = root.attrs or attrs
            continue
        if tag == "body":
            if body is None:
                body = Node("body", attrs)
                root.children.append(body)
            stack.cut(1)
            stack.push(body)
            continue
        if len(stack.nodes) == 1 and tag not in HEAD or stack.nodes[-1].tag == "head" and tag not in HEAD:
            open_body()
        if tag in CLOSES:
            close(*CLOSES[tag])
        if tag in ENDS_P:
            close(("p",), SCOPE)
        if re.fullmatch("h[1-6]", tag) and re.fullmatch("h[1-6]", stack.nodes[-1].tag):
            stack.cut(len(stack.nodes) - 1)
        node = Node(tag, attrs)
        stack.nodes[-1].children.append(node)
        if tag in RAW:
            end = re.compile(f"</{tag}(?=[\\s/>])[^>]*>", re.I).search(html, at)
            stop = end.start() if end else n
            raw = html[at:stop]
            node.children.append(unescape(raw) if tag in ("textarea", "title") else raw)
            at = end.end() if end else n
        elif tag not in VOID and not (attrs.endswith("/") and (tag in FOREIGN or stack.last(FOREIGN))):
            stack.push(node)
    return root


class Lines:
    """Lines of text; blocks ask for line breaks or blank lines, which come when text follows."""

    def __init__(self):
        self.lines: list[str] = []
        self.now: list[str] = []
        self.space = self.blank = False
        self.prefix = ""  # of the next line: a bullet or number
        self.indent = 0

    def text(self, s: str, pre: bool = False) -> None:
        if pre:
            first, *more = s.split("\n")
            self._put(first, True)
            for x in more:
                self.end(True)
                self._put(x, True)
            return
        words = SPACE.sub(" ", s)
        if words.startswith(" "):
            self.space = True
            words = words[1:]
        if words:
            tail = words.endswith(" ")
            self._put(words[:-1] if tail else words, False)
            self.space = tail

    def _put(self, s: str, pre: bool) -> None:
        if not s:
            return
        if not self.now:
            if self.blank and self.lines:
                self.lines.append("")
            self.blank = False
            lead = " " * self.indent
            if self.prefix:
                lead = lead[: max(0, self.indent - len(self.prefix))] + self.prefix
                self.prefix = ""
            self.now.append(lead)
        elif self.space and not pre:
            self.now.append(" ")
        self.space = False
        self.now.append(s)

    def end(self, forced: bool = False) -> None:
        """End the line; forced: an empty one counts too."""
        if self.now:
            self.lines.append("".join(self.now).rstrip())
            self.now = []
        elif forced and self.lines:
            self.lines.append("")
        self.space = False

    def block(self, spaced: bool) -> None:
        self.end()
        self.blank = self.blank or spaced

    def done(self) -> list[str]:
        self.end()
        while self.lines and not self.lines[-1]:
            self.lines.pop()
        return self.lines


def number(s: str | None, default: int, most: int) -> int:
    m = re.match(r"\s*(-?\d{1,6})", s or "")
    return max(1, min(most, int(m[1]))) if m else default


def joined(spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Sorted spans, with neighbours that end with the same row as one."""
    out = spans[:1]
    for lo, hi, until in spans[1:]:
        if lo <= out[-1][1] and until == out[-1][2]:
            out[-1] = (out[-1][0], max(hi, out[-1][1]), until)
        else:
            out.append((lo, hi, until))
    return out


#: Cells are aligned as far as this place of a line; what begins behind it, or behind a wider cell, follows after two spaces.
LAYOUT = 1000


def grid(rows: list[list[tuple[list[str], int, int]]]) -> list[str]:
    """Rows of cells (lines, column span, row span) as aligned lines. A line is filled up to LAYOUT places at most, so that a wide cell does
    not widen all other rows: the output stays in proportion to the page. No text is cut."""
    placed: list[dict[int, list[str]]] = []
    spans: list[tuple[int, int, int]] = []  # columns from, to, that cells above take up before row `until`; sorted, apart
    widths: dict[int, int] = {}
    wide: list[tuple[int, int, int]] = []
    for r, cells in enumerate(rows):
        spans = [x for x in spans if x[2] > r]
        c, row, at, new = 0, {}, 0, []
        for lines, cs, rs in cells:
            while at < len(spans) and spans[at][0] <= c:
                c = max(c, spans[at][1])
                at += 1
            row[c] = lines
            w = max(map(len, lines), default=0)
            if cs == 1:
                widths[c] = max(widths.get(c, 0), w)
            else:
                wide.append((c, cs, w))
                widths.setdefault(c, 0)
                widths.setdefault(c + cs - 1, 0)
            if rs > 1 and r + 1 < len(rows):
                new.append((c, c + cs, min(r + rs, len(rows))))
            c += cs
        if new:
            spans = joined(sorted(spans + new))
        placed.append(row)
    for c, cs, w in wide:  # what a wide cell needs more goes to its last column
        have = sum(widths.get(k, 0) for k in range(c, c + cs)) + 2 * (cs - 1)
        widths[c + cs - 1] += max(0, w - have)
    start, x = {}, 0
    for c in sorted(widths):
        start[c] = x
        x += widths[c] + 2 if widths[c] else 0
    out = []
    for row in placed:
        left = [c for c in sorted(row) if row[c]]
        i = 0
        while left:
            line, size = [], 0
            for c in left:
                if row[c][i]:
                    at = max(start[c] if start[c] <= LAYOUT else 0, size + 2 if size else 0)
                    line += [" " * (at - size), row[c][i]]
                    size = at + len(row[c][i])
            out.append("".join(line).rstrip())
            i += 1
            left = [c for c in left if len(row[c]) > i]
    return out


def render(html: str | None) -> str:
    """The page's visible text."""
    if not html:
        return ""
    outs = [Lines()]
    tables: list[list[list[tuple[list[str], int, int]]]] = []
    lists: list[list] = []  # (ordered?, next number)
    pre = 0
    todo: list[tuple[object, bool]] = [(parse(html), False)]
    while todo:
        node, leaving = todo.pop()
        out = outs[-1]
        if isinstance(node, str):
            out.text(node, pre > 0)
            continue
        tag = node.tag
        if not leaving:
            if not node.visible():
                continue
            if tag == "br":
                out.end(True)
                continue
            if tag == "hr":
                out.block(False)
                out.text("----")
                out.block(False)
                continue
            if tag == "input":
                value = node.attr("value")
                if value and (node.attr("type") or "text").lower() in ("text", "submit", "button", "reset", "search", "email", "url", "number"):
                    out.text(f" {value} ")
                continue
            if tag in VOID:
                continue
            if tag in ("text", "foreignobject", "math"):  # a drawing's labels, and formulas, stand apart
                out.text(" ")
            todo.append((node, True))
            if tag in CELLS and tables:
                if not tables[-1]:
                    tables[-1].append([])
                outs.append(Lines())
            elif tag == "tr" and tables:
                tables[-1].append([])
            elif tag == "table":
                out.block(True)
                tables.append([])
            elif tag in BLOCK:
                out.block(tag in SPACED and not (tag in LISTS and lists))
            if tag in ("pre", "xmp", "textarea"):
                pre += 1
                if node.children and isinstance(node.children[0], str):  # the line end behind the tag is not content
                    node.children[0] = node.children[0].removeprefix("\n")
            if tag in LISTS:
                out.indent += 2 if lists else 0
                first = node.attr("start") if tag == "ol" else None
                lists.append([tag == "ol", number(first, 1, 999_999)])
            elif tag == "li":
                if lists and lists[-1][0]:
                    out.prefix = f"{lists[-1][1]}. "
                    lists[-1][1] += 1
                else:
                    out.prefix = "- "
                out.indent += len(out.prefix)
                todo[-1] = (node, len(out.prefix))
            elif tag == "dd":
                out.indent += 2
            elif tag == "blockquote":
                out.indent += 2
            todo.extend((c, False) for c in reversed(node.children))
            continue
        if tag in ("text", "foreignobject", "math"):
            out.text(" ")
        if tag in ("pre", "xmp", "textarea"):
            pre -= 1
        if tag in CELLS and tables:
            lines = outs.pop().done()
            tables[-1][-1].append((lines, number(node.attr("colspan"), 1, 1000), number(node.attr("rowspan"), 1, 65_534)))
        elif tag == "table":
            rows = tables.pop()
            out.end()
            for line in grid(rows):
                out.text(line, True)
                out.end()
            out.block(True)
        elif tag in BLOCK and not (tag == "tr" and tables):
            if tag in LISTS:
                lists.pop()
                out.block(not lists)
                out.indent -= 2 if lists else 0
            else:
                out.block(tag in SPACED)
            if tag == "li":
                out.indent -= leaving
                out.prefix = ""
            elif tag in ("dd", "blockquote"):
                out.indent -= 2
    return "\n".join(outs[0].done())


def extract(pages: DataFrame, html: str = "html") -> DataFrame:
    """pages without the html column, with text, the rendered page."""
    kept = [f for f in pages.schema.fields if f.name not in (html, "text")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                texts = [render(x) for x in part.column("_html").to_pylist()]
                yield pa.RecordBatch.from_arrays([*(part.column(f.name) for f in kept), pa.array(texts, pa.string())], names=[*(f.name for f in kept), "text"])

    return pages.select(*(f.name for f in kept), F.col(html).alias("_html")).mapInArrow(run, StructType([*(StructField(f.name, f.dataType) for f in kept), StructField("text", StringType())]))


def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = extract(table(spark, sf_dir, "pages"))
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"), F.sha2("text", 256).alias("text_sha256"))
