"""HTML extraction as a layout: a tree with implied tags, visibility rules, and all visible text with its block spacing.

The tree builder closes what the next tag implies (p before a block, li before li, cells and rows of a table, options,
dt and dd), ends a head at the first tag or text that can't stand in it, and adds the rows that stray cells need. Hidden are
the parts no browser shows: head, script, style, template and the like, elements with `hidden`, and inline styles that hide
(what an invisible element holds is shown again where it is made visible). Scripts don't run, so noscript is shown. Blocks
stand on lines of their own, paragraphs and headings apart by an empty line, list items behind their mark and indented by
depth, table cells in aligned columns and rows, `pre` as it is.

A page is read in one pass: no position is searched twice for the same end, and elements may be nested to any depth.

Defined results: null html has null text; empty html has empty text; an unclosed tag or comment ends with the document and
shows nothing; a quote that is never closed is a plain sign of its tag. Pages are rendered one by one: repeated rows, ties
and extra columns change nothing.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator
from html import unescape
from itertools import zip_longest

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Tag names by role, after the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
HIDDEN = frozenset("head script style template title datalist iframe object audio video canvas noembed noframes".split())
#: What may stand in head; any other start tag, or text, ends it.
IN_HEAD = frozenset("base basefont bgsound link meta title style script noscript noframes template".split())
#: Parts of svg and math that aren't drawn.
UNDRAWN = frozenset("annotation annotation-xml clippath defs desc marker mask metadata pattern symbol".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table ul caption "
    "thead tbody tfoot tr".split()
)
#: Parts of a table, looked for through wrappers.
PARTS = frozenset("tr caption td th".split())
APART = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl table blockquote pre figure form article section".split())
CLOSES_P = BLOCK - frozenset("body html caption thead tbody tfoot tr".split())
#: Tag -> (tags that it closes, tags that stop the search).
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th", "caption", "colgroup"}, {"table", "thead", "tbody", "tfoot"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "thead": ({"thead", "tbody", "tfoot", "caption", "colgroup"}, {"table"}),
    "tbody": ({"thead", "tbody", "tfoot", "caption", "colgroup"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tfoot", "caption", "colgroup"}, {"table"}),
    "option": ({"option"}, {"select", "datalist"}),
    "body": ({"head"}, {"html"}),
}
#: Fixed values of the HTML standard: the most columns and rows of a cell.
MOST_COLUMNS, MOST_ROWS = 1000, 65534

NAME = re.compile(r"[^\s/>]+")
SIGN = re.compile("""[>"']""")
ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
HIDING = re.compile(r"display\s*:\s*none", re.I)
VISIBILITY = re.compile(r"visibility\s*:\s*([a-z]+)", re.I)
WHOLE = re.compile(r"\s*([+-]?[0-9]{1,9})")
SPACE = re.compile(r"[ \t\n\r\f]+")


class Element:
    """see: visible or not by its own style, else None; lines, span: rows and columns of a cell; start: number of a list or
    of its item; held: kinds of table parts somewhere below, not in a table of its own."""

    __slots__ = ("tag", "below", "hidden", "see", "span", "lines", "start", "held")

    def __init__(self, tag: str, attributes: str = ""):
        self.tag, self.below, self.hidden, self.see = tag, [], tag in HIDDEN, None
        self.span, self.lines, self.start, self.held = 1, 1, None, frozenset()
        if attributes and ("=" in attributes or "hidden" in attributes.lower()):
            named = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in ATTRIBUTE.finditer(attributes)}
            style = named.get("style", "")
            self.hidden |= "hidden" in named or bool(HIDING.search(style)) or tag == "input"
            if m := VISIBILITY.search(style):
                self.see = m[1].lower() not in ("hidden", "collapse")
            number = lambda name: int(m[1]) if (m := WHOLE.match(named.get(name, ""))) else None
            self.span = min(max(1, number("colspan") or 1), MOST_COLUMNS)
            self.lines = min(max(1, number("rowspan") or 1), MOST_ROWS)
            self.start = number("start" if tag == "ol" else "value")


class Tags:
    """Tags of a page in order; what was looked for once and isn't there isn't looked for again."""

    def __init__(self, html: str):
        self.html, self.gone = html, {}

    def find(self, what: str, at: int) -> int:
        if at >= self.gone.get(what, len(self.html) + 1):
            return -1
        k = self.html.find(what, at)
        if k < 0:
            self.gone[what] = at
        return k

    def close(self, at: int) -> int:
        """Where the tag that is open at `at` ends, -1 if nowhere; quotes count behind an equals sign."""
        while m := SIGN.search(self.html, at):
            if m[0] == ">":
                return m.start()
            at = m.end()
            k = m.start() - 1
            while k >= 0 and self.html[k] in " \t\n\r\f":
                k -= 1
            if self.html[k] == "=" and (end := self.find(m[0], at)) >= 0:
                at = end + 1
        return -1

    def next(self, at: int) -> tuple[int, int, str, bool, str] | None:
        """(start, end, name, whether an end tag, attributes) of the next tag from `at` on; name is empty for comments."""
        html = self.html
        while (k := html.find("<", at)) >= 0:
            head = html[k + 1 : k + 2]
            if html.startswith("!--", k + 1):
                end = self.find("-->", k + 4)
                return k, end + 3 if end >= 0 else len(html), "", False, ""
            if head in ("!", "?"):
                end = self.find(">", k)
                return k, end + 1 if end >= 0 else len(html), "", False, ""
            name = k + 1 + (head == "/")
            if html[name : name + 1].isascii() and html[name : name + 1].isalpha():
                m = NAME.match(html, name)
                end = self.close(m.end())
                if end < 0:
                    return k, len(html), "", False, ""
                return k, end + 1, m[0].lower(), head == "/", html[m.end() : end]
            at = k + 1
        return None


def build(html: str) -> Element:
    """Tree of a page; text is str among the elements below."""
    root = Element("#root")
    stack, drawn = [root], 0
    places: dict[str, list[int]] = {}  # where in the stack elements of each tag are open, so that no scan of it is needed
    tags, at, end = Tags(html), 0, len(html)

    def push(x: Element) -> None:
        nonlocal drawn
        places.setdefault(x.tag, []).append(len(stack))
        stack.append(x)
        drawn += x.tag in ("svg", "math")

    def pop(to: int) -> None:
        nonlocal drawn
        for x in reversed(stack[to:]):
            places[x.tag].pop()
            drawn -= x.tag in ("svg", "math")
        del stack[to:]

    def innermost(tags) -> int:
        """Place of the innermost open element of these tags, 0 if none is."""
        return max((places[t][-1] for t in tags if places.get(t)), default=0)

    def close(which: set, stops: set) -> None:
        while 0 < (i := innermost(which)) >= innermost(stops):
            pop(i)

    def text(s: str) -> None:
        if s:
            while stack[-1].tag == "head" and s.strip(" \t\n\r\f"):
                pop(len(stack) - 1)
            stack[-1].below.append(unescape(s) if "&" in s else s)

    def put(x: Element) -> None:
        stack[-1].below.append(x)
        if x.tag in PARTS and not x.hidden:
            for up in reversed(stack):
                if up.hidden or x.tag in up.held or up.tag == "table":
                    break
                up.held |= {x.tag}

    while at < end:
        found = tags.next(at)
        if found is None:
            text(html[at:])
            break
        start, after, tag, ends, attributes = found
        text(html[at:start])
        at = after
        if not tag:
            continue
        if ends:
            # an end tag doesn't reach out of its table
            if (i := innermost((tag,))) and (tag in ("body", "html") or i >= innermost(("table",))):
                pop(i)
            continue
        while stack[-1].tag == "head" and tag not in IN_HEAD:
            pop(len(stack) - 1)
        if tag in CLOSES_P:
            close({"p"}, {"table", "td", "th", "li", "div", "section", "article", "blockquote"})
        if tag in IMPLIED:
            close(*IMPLIED[tag])
        if tag in ("td", "th") and stack[-1].tag in ("table", "thead", "tbody", "tfoot"):
            row = Element("tr")
            put(row)
            push(row)
        element = Element(tag, attributes)
        drawing = tag in ("svg", "math") or drawn > 0
        element.hidden |= drawing and tag in UNDRAWN
        put(element)
        if tag in RAW:
            stop = re.compile(rf"</{re.escape(tag)}[\s/>]", re.I).search(html, at)
            if not element.hidden:
                element.below.append(unescape(html[at : stop.start() if stop else end]))
            at = stop.start() if stop else end
            if stop:
                at = html.find(">", at) + 1 or end
        elif tag not in VOID and not (drawing and attributes.endswith("/")):
            push(element)
    return root


class Flow:
    """Lines of a block; gap is how many empty lines must stand before the next text."""

    def __init__(self) -> None:
        self.lines: list[str] = []
        self.now, self.gap = "", 0

    def add(self, s: str) -> None:
        s = SPACE.sub(" ", s)
        if not self.now or self.now.endswith(" "):
            s = s.lstrip(" ")
        self.now += s

    def end(self, gap: int = 0) -> None:
        self.put([self.now.rstrip(" ")] if self.now.strip() else [])
        self.now = ""
        self.gap = max(self.gap, gap)

    def put(self, lines: list[str]) -> None:
        if lines:
            if self.lines:
                self.lines += [""] * self.gap
            self.lines += lines
            self.gap = 0


def sorted_out(x: Element, kinds: tuple, through: tuple, see: bool, stray: list) -> Iterator[tuple[Element, bool]]:
    """Elements of these kinds below x and within the wrappers there, and whether they are visible; what is neither goes to
    stray, in order.

    A wrapper is an element of `through`, or one that has such an element below it, however deep but not in a table of its own.
    """
    todo = [(y, see) for y in reversed(x.below)]
    while todo:
        y, see = todo.pop()
        if isinstance(y, str):
            stray.append((y, see))
            continue
        if y.hidden:
            continue
        inner = see if y.see is None else y.see
        if y.tag in kinds:
            yield y, inner
        elif y.tag in through or (y.tag != "table" and not y.held.isdisjoint(kinds)):
            todo += [(z, inner) for z in reversed(y.below)]
        else:
            stray.append((y, see))


def put_table(table: Element, flow: Flow, see: bool) -> None:
    stray: list[tuple[Element | str, bool]] = []
    rows: list[list[list[str]]] = []
    below: dict[int, int] = {}  # column -> rows that a cell above still covers
    for x, shown in sorted_out(table, ("tr", "caption"), ("thead", "tbody", "tfoot", "colgroup"), see, stray):
        if x.tag == "caption":
            flow.put(lines_of(x, see=shown))
            continue
        cells: list[list[str]] = []
        taken, below = below, {k: n - 1 for k, n in below.items() if n > 1}

        def pass_over() -> None:
            while len(cells) in taken:
                cells.append([])

        loose: list[tuple[Element | str, bool]] = []
        for c, seen in sorted_out(x, ("td", "th"), (), shown, loose):
            pass_over()
            if c.lines > 1:
                below |= {k: c.lines - 1 for k in range(len(cells), len(cells) + c.span)}
            cells += [lines_of(c, see=seen), *([[]] * (c.span - 1))]
        pass_over()
        rows.append(cells)
        stray += loose
    widths = [max((len(s) for r in rows for s in (r[i] if i < len(r) else ())), default=0) for i in range(max(map(len, rows), default=0))]
    for r in rows:
        flow.put(["  ".join(s.ljust(w) for s, w in zip(part, widths)).rstrip() for part in zip_longest(*r, fillvalue="")])
    for x, shown in stray:  # what stands in a table outside its cells is shown after it
        render(x, flow, 0, shown)
    flow.end()


def render(x: Element | str, flow: Flow, depth: int = 0, see: bool = True) -> None:
    if isinstance(x, str):
        if see:
            flow.add(x)
        return
    if x.hidden:
        return
    if x.see is not None:
        see = x.see
    if x.tag == "br":
        flow.put([flow.now.rstrip(" ")])
        flow.now = ""
        return
    if x.tag not in BLOCK:
        for y in x.below:
            render(y, flow, depth, see)
        if x.tag in ("td", "th", "text"):  # text is a label of an svg
            flow.add(" ")
        return
    gap = int(x.tag in APART and not (x.tag in ("ul", "ol") and depth))
    flow.end(gap)
    if x.tag in ("ul", "ol", "menu", "dir"):
        number = 1 if x.start is None or x.tag != "ol" else x.start
        for y in x.below:
            if isinstance(y, Element) and y.tag == "li" and not y.hidden:
                number = number if y.start is None else y.start
                mark = f"{number}. " if x.tag == "ol" else "- "
                number += 1
                inner = lines_of(y, depth + 1, see if y.see is None else y.see)
                flow.end()
                flow.put([(mark if not i else " " * len(mark) * bool(s)) + s for i, s in enumerate(inner)])
            else:
                render(y, flow, depth, see)
    elif x.tag == "table":
        put_table(x, flow, see)
    elif x.tag == "pre":
        raw = "".join(plain(x, see)).strip("\n")
        flow.put(raw.split("\n") if raw else [])
    else:
        for y in x.below:
            render(y, flow, depth, see)
    flow.end(gap)


def plain(x: Element, see: bool) -> Iterator[str]:
    todo = [(y, see) for y in reversed(x.below)]
    while todo:
        y, see = todo.pop()
        if isinstance(y, str):
            if see:
                yield y
        elif y.tag == "br":
            yield "\n"
        elif not y.hidden:
            inner = see if y.see is None else y.see
            todo += [(z, inner) for z in reversed(y.below)]


def lines_of(x: Element, depth: int = 0, see: bool = True) -> list[str]:
    flow = Flow()
    for y in x.below:
        render(y, flow, depth, see)
    flow.end()
    return flow.lines


def visible_text(html: str) -> str:
    before = sys.getrecursionlimit()
    # calls follow the nesting of elements, of which there are fewer than "<" signs
    sys.setrecursionlimit(max(before, 1000 + 4 * html.count("<")))
    try:
        return "\n".join(lines_of(build(html)))
    finally:
        sys.setrecursionlimit(before)


def extract_text(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(page_id, text): a narrow map over Arrow batches, no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [None if h is None else visible_text(h) for h in b.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("page_id"), pa.array(out, pa.string())], ["page_id", "text"])

    rows = pages.select(F.col(id_col).alias("page_id"), F.col(html_col).alias("html"))
    return rows.mapInArrow(run, f"page_id {rows.schema['page_id'].dataType.simpleString()}, text string")
