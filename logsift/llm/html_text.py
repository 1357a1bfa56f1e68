"""HTML extraction with layout: a tree builder feeds a renderer that emits all visible text.

The builder keeps the stack of open elements and closes or opens what the markup implies (paragraphs
before blocks, list items, table rows and cells, misnested and missing end tags), so the renderer
sees balanced elements. Visibility follows the elements that never show, the ``hidden`` attribute,
inline ``display`` and ``visibility`` styles and closed ``details``. The renderer collapses white
space, separates blocks by their margins, marks and indents list items, keeps preformatted lines and
aligns table cells in columns.

Both work on one pass over the markup with explicit stacks: nesting depth and page length are limited
by memory alone, and time grows in proportion to the page.
"""

from __future__ import annotations

import html
import math
import re
from bisect import bisect_left, bisect_right
from collections import Counter, defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logsift.llm.common import bounded_batches, text_or_empty

# Element classes of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
NEVER = frozenset("head script style template noscript iframe object audio video canvas datalist noframes "
                  "noembed title area base basefont link meta param rp source track annotation annotation-xml".split())
#: SVG shows the text of its text elements and of foreign HTML, but not what stands in these.
FOREIGN, SVG_SHOWN = frozenset(("svg", "math")), ("text", "foreignobject")
SVG_NEVER = frozenset("defs symbol clippath mask pattern marker desc metadata".split())
#: HTML elements end SVG and MathML left open, unless they stand in one of the elements that hold HTML.
HOLDS_HTML = frozenset("foreignobject desc title annotation-xml mi mo mn ms mtext".split())
ENDS_FOREIGN = frozenset("b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing "
                         "menu meta nobr ol p pre ruby s small span strong strike sub sup table tt u ul var".split())
RAW = frozenset("script style iframe noembed noframes noscript xmp".split())
RAW_DECODED = frozenset(("title", "textarea"))
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl blockquote pre figure fieldset hr menu dir listing xmp".split())
PLAIN_BLOCK = frozenset("address article aside body center details dialog dd div dt figcaption footer form header hgroup html "
                        "legend li main nav optgroup option search section select summary caption textarea".split())
BLOCK = SPACED | PLAIN_BLOCK
CLOSES_P = (SPACED | frozenset("address article aside center details dialog dd div dt figcaption footer form header hgroup "
                               "li main nav search section summary table".split()))
TABLE_PARTS = frozenset("table caption colgroup thead tbody tfoot tr td th".split())
WALL = frozenset("html table td th caption template object button".split())
LISTS = frozenset("ul ol menu dir".split())
SIBLINGS = {"li": (frozenset(("li",)), LISTS), "dt": (frozenset(("dt", "dd")), frozenset(("dl",))),
            "dd": (frozenset(("dt", "dd")), frozenset(("dl",))), "option": (frozenset(("option",)), frozenset(("select", "datalist"))),
            "optgroup": (frozenset(("option", "optgroup")), frozenset(("select",)))}
PRE = frozenset(("pre", "listing", "xmp", "textarea"))

_TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+')?+)*+)>""")
_ATTR = re.compile(r"""([^\s/>=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>"']\S*))?""")
_SPACES = re.compile(r"[ \t\n\f\r]+")
_STYLE = re.compile(r"(?:^|;)\s*(display|visibility|white-space)\s*:\s*([a-z-]+)", re.IGNORECASE)
_END = {name: re.compile(rf"</{name}(?=[\s/>])", re.IGNORECASE) for name in RAW | RAW_DECODED}
#: Open elements that are looked through one by one; beyond, the places kept by name tell the nearest.
NEAR = 64
#: Levels that indent a line; deeper ones keep their marks, or nested lists would take room by the square of their depth.
LEVELS = 512
#: Inputs whose value is not shown as text.
NO_VALUE = frozenset("checkbox color file hidden image password radio range".split())
#: Blanks that align a table, at most so many times its text and cells.
MOST_BLANKS = 32


def attributes(source: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for m in _ATTR.finditer(source):
        value = m.group(2) or ""
        out.setdefault(m.group(1).lower(), html.unescape(value.strip("\"'") if value[:1] in "\"'" else value))
    return out


def _number(value: str | None, default: int, most: int) -> int:
    m = re.match(r"\s*([+-]?\d{1,9})", value or "")
    return min(int(m.group(1)), most) if m else default


class Flow:
    """Lines of one block container: the page or a table cell."""

    def __init__(self):
        self.lines: list[str] = []
        self.part: list[str] = []
        self.gap = self.space = False
        self.indents: list[list[str | None]] = []
        self.told = 0  # levels before this one have shown their marks

    def text(self, data: str) -> None:
        for_line = _SPACES.sub(" ", data)
        if for_line == " " or not for_line:
            self.space = self.space or (bool(for_line) and bool(self.part))
            return
        if self.part and (self.space or for_line[0] == " "):
            self.part.append(" ")
        self.part.append(for_line.strip(" "))
        self.space = for_line[-1] == " "

    def kept(self, data: str) -> None:
        """Preformatted text: its line ends are line ends, its blanks stay."""
        first, *rest = data.split("\n")
        if first:
            self.part.append(first)
        for line in rest:
            self.end_line(force=True)
            if line:
                self.part.append(line)

    def end_line(self, force: bool = False) -> None:
        if self.part or force:
            self.put("".join(self.part).rstrip(" \t\r"))
            self.part = []
        self.space = False

    def put(self, line: str) -> None:
        if self.gap and self.lines:
            self.lines.append("")
        self.gap = False
        told = min(self.told, len(self.indents))
        lead = "".join(level[0] for level in self.indents[:min(told, LEVELS)])
        for k in range(told, len(self.indents)):
            level = self.indents[k]
            lead += level[1] if level[1] is not None else level[0] if k < LEVELS else ""
            level[1] = None
        self.told = len(self.indents)
        self.lines.append((lead + line).rstrip(" "))

    def block(self, spaced: bool) -> None:
        self.end_line()
        self.gap = self.gap or (spaced and bool(self.lines))


class Grid:
    """Rows and cells of one table, laid out when it ends.

    Cells that reach down hold intervals of columns, so a cell costs the same however many columns it spans; placing
    it passes the held intervals between its neighbour and its place.
    """

    def __init__(self):
        self.rows: list[list[tuple[int, int, list[str]]]] = []
        #: columns held from above: start, end and the last row held, disjoint and ascending
        self.spans: list[tuple[int, int, int]] = []
        self.held: list[tuple[int, int, int]] = []
        self.caption: list[str] = []

    def row(self) -> None:
        self.rows.append([])

    def cell(self, lines: list[str], across: int, down: int) -> None:
        if not self.rows:
            self.row()
        row, now = self.rows[-1], len(self.rows)
        at = row[-1][0] + row[-1][1] if row else 0
        k = bisect_right(self.spans, (at, math.inf, 0))
        if k and self.spans[k - 1][1] > at:
            k -= 1
        while k < len(self.spans) and self.spans[k][0] <= at:
            if self.spans[k][2] < now:
                del self.spans[k]  # its rows are over
            else:
                at = max(at, self.spans[k][1])
                k += 1
        row.append((at, across, lines))
        if down > 1:
            self.held.append((at, at + across, now + down - 1))

    def end_row(self) -> None:
        for span in self.held:
            self.hold(*span)
        self.held = []

    def hold(self, start: int, end: int, until: int) -> None:
        """Holds columns; where others hold them already, the longer one counts."""
        k = bisect_left(self.spans, (start,))
        if k and self.spans[k - 1][1] > start:
            k -= 1
        first, at, parts = k, start, []
        while k < len(self.spans) and self.spans[k][0] < end:
            a, b, other = self.spans[k]
            k += 1
            if a < start:
                parts.append((a, start, other))
            if at < a:
                parts.append((at, a, until))
            at = min(b, end)
            parts.append((max(a, start), at, max(other, until)))
            if b > end:
                parts.append((end, b, other))
        if at < end:
            parts.append((at, end, until))
        self.spans[first:k] = parts

    def starts(self, limit: int) -> dict[int, int]:
        """Where the cells of a column begin, if no column is made wider than ``limit`` by a cell."""
        columns = sorted({at + across - 1 for row in self.rows for at, across, _ in row})
        place = {c: i for i, c in enumerate(columns)}
        slot = [0] * len(columns)  # widths with the two blanks behind them
        for row in self.rows:
            for at, across, lines in row:
                if across == 1:
                    slot[place[at]] = max(slot[place[at]], needed(lines, limit))
        sums = PrefixSums(slot)
        for row in self.rows:  # spanning cells widen their last column
            for at, across, lines in row:
                if across > 1:
                    last = place[at + across - 1]
                    need = needed(lines, limit * across) - (sums.before(last) - sums.before(bisect_left(columns, at)))
                    if need > slot[last]:
                        sums.add(last, need - slot[last])
                        slot[last] = need
        return {at: sums.before(bisect_left(columns, at)) for row in self.rows for at, _, _ in row}

    def aligned(self) -> dict[int, int]:
        """Starts by the widest cells. Where that would write more than ``MOST_BLANKS`` times as many blanks as the table has
        text and cells, columns count as half as wide, and so on: the output stays in proportion to the page."""
        room = 4096 + MOST_BLANKS * sum(1 + sum(map(len, lines)) for row in self.rows for _, _, lines in row)
        limit = max((len(line) for row in self.rows for _, _, lines in row for line in lines), default=0)
        while True:
            start = self.starts(limit)
            blanks = 0
            for row in self.rows:
                done = 0  # lines of the row whose last cell is known
                for at, _, lines in reversed(row):
                    blanks += start[at] * max(0, len(lines) - done)
                    done = max(done, len(lines))
            if blanks <= room or not limit:
                return start
            limit //= 2

    def lines(self) -> list[str]:
        start = self.aligned()
        out = list(self.caption)
        for row in self.rows:
            told = [""] * max((len(lines) for _, _, lines in row), default=0)
            for at, _, lines in row:
                for k, text in enumerate(lines):
                    if text:
                        gap = start[at] - len(told[k])
                        told[k] += " " * (gap if gap > 0 or not told[k] else 2) + text
            out.extend(told)
        return out


def needed(lines: list[str], limit: int) -> int:
    width = min(limit, max(map(len, lines), default=0))
    return width + 2 if width else 0


class PrefixSums:
    """Sums of the first values of a list whose values change (a binary indexed tree)."""

    def __init__(self, values: list[int]):
        self.tree = [0, *values]
        for i in range(1, len(self.tree)):
            if (up := i + (i & -i)) < len(self.tree):
                self.tree[up] += self.tree[i]

    def add(self, at: int, more: int) -> None:
        at += 1
        while at < len(self.tree):
            self.tree[at] += more
            at += at & -at

    def before(self, n: int) -> int:
        total = 0
        while n:
            total += self.tree[n]
            n -= n & -n
        return total


class Page:
    """Tree builder and renderer of one page."""

    def __init__(self):
        self.flow = Flow()
        self.flows: list[Flow] = []
        self.grids: list[Grid] = []
        #: name, and whether its subtree is not displayed, its text invisible, its blanks kept, and list state
        self.open: list[list] = []
        self.depth_of: Counter[str] = Counter()
        self.places: defaultdict[str, list[int]] = defaultdict(list)
        self.gone = 0
        self.unseen = False
        self.pre = 0
        self.drop_newline = False

    # Tree building

    def has(self, names, walls=WALL) -> bool:
        if not any(self.depth_of[name] for name in names):
            return False
        for e in self.open[:-NEAR - 1:-1]:
            if e[0] in names:
                return True
            if e[0] in walls:
                return False
        return self.last(names) >= max(0, self.last(walls))

    def last(self, names) -> int:
        """Place of the innermost open element of these names, or -1."""
        return max((self.places[name][-1] for name in names if self.depth_of[name]), default=-1)

    def close_to(self, names) -> None:
        """Close open elements up to and including the nearest of these names."""
        while self.open:
            if self.leave_last() in names:
                return

    def start(self, name: str, source: str) -> None:
        if name in ENDS_FOREIGN and (self.depth_of["svg"] or self.depth_of["math"]) and self.last(FOREIGN) > self.last(HOLDS_HTML):
            self.close_to(FOREIGN)
        if name in ("html", "body") and self.depth_of[name]:
            return
        if name == "body" or (name in BLOCK and name not in ("html", "head")):
            if self.has(("head",), ()):
                self.close_to(("head",))
        if name in CLOSES_P and self.has(("p",)):
            self.close_to(("p",))
        if name in SIBLINGS:
            same, walls = SIBLINGS[name]
            if self.has(same, walls | WALL):
                self.close_to(same)
        elif name[0] == "h" and name[1:] in "123456" and len(name) == 2 and self.open and self.open[-1][0][0] == "h" \
                and len(self.open[-1][0]) == 2 and self.open[-1][0] != "hr":
            self.close_to((self.open[-1][0],))
        elif name in TABLE_PARTS and name != "table":
            if not self.has(("table",), ()):
                return
            self.table_part(name)
        self.enter(name, attributes(source) if source.strip(" /\n\t\r\f") else {})
        if name in VOID or (source.endswith("/") and (self.depth_of["svg"] or self.depth_of["math"])
                            and self.last(FOREIGN) >= self.last(HOLDS_HTML - {name})):
            self.leave_last()

    def table_part(self, name: str) -> None:
        """Close what a row, cell or section ends, and open what it stands in."""
        inner = {"td": ("td", "th", "caption", "colgroup"), "th": ("td", "th", "caption", "colgroup"),
                 "tr": ("td", "th", "tr", "caption", "colgroup")}.get(
            name, ("td", "th", "tr", "thead", "tbody", "tfoot", "caption", "colgroup"))
        while self.has(inner, ("table",)):
            self.close_to(inner)
        if name in ("td", "th") and not self.has(("tr",), ("table",)):
            self.table_part("tr")
            self.enter("tr", {})
        elif name == "tr" and not self.has(("thead", "tbody", "tfoot"), ("table",)):
            self.enter("tbody", {})

    def end(self, name: str) -> None:
        if name == "br":
            self.start("br", "")
        elif name == "p" and not self.has(("p",)):
            self.start("p", "")
            self.close_to(("p",))
        elif name in VOID or name in ("html", "body"):
            return  # what follows still belongs to the body
        elif len(name) == 2 and name[0] == "h" and name[1] in "123456":
            headings = ("h1", "h2", "h3", "h4", "h5", "h6")
            if self.has(headings):
                self.close_to(headings)
        elif name in TABLE_PARTS:
            if self.has((name,), ("table",) if name != "table" else ()):
                self.close_to((name,))
        elif name in BLOCK or name in RAW:
            if self.has((name,), WALL | (LISTS if name == "li" else frozenset())):
                self.close_to((name,))
        elif self.has((name,), WALL | BLOCK):
            self.close_to((name,))

    # Rendering

    def enter(self, name: str, attrs: dict[str, str]) -> None:
        gone, unseen, pre = name in NEVER, self.unseen, name in PRE
        if attrs:
            gone = gone or ("hidden" in attrs and attrs["hidden"].lower() != "until-found")
            gone = gone or (name == "input" and attrs.get("type", "").lower() == "hidden")
            for prop, value in _STYLE.findall(attrs.get("style", "")):
                prop, value = prop.lower(), value.lower()
                if prop == "display":
                    gone = name in NEVER or value == "none"
                elif prop == "visibility":
                    unseen = value in ("hidden", "collapse")
                else:
                    pre = value.startswith("pre") and value != "pre-line"
        if self.depth_of["svg"]:
            gone = gone or name in SVG_NEVER or attrs.get("display") == "none"
            unseen = unseen or attrs.get("visibility") in ("hidden", "collapse")
        if name == "dialog" and "open" not in attrs:
            gone = True
        if self.open and self.open[-1][0] == "details" and name != "summary" and not self.open[-1][4]:
            gone = True
        # name, gone, former unseen, pre, state
        element = [name, gone, self.unseen, pre, "open" in attrs if name == "details" else None]
        self.places[name].append(len(self.open))
        self.open.append(element)
        self.depth_of[name] += 1
        self.gone += gone
        self.unseen = unseen
        self.pre += pre
        if self.gone:
            return
        self.drop_newline = name in PRE
        flow = self.flow
        if name == "text" and self.depth_of["svg"]:
            flow.text(" ")
        if name == "br":
            flow.end_line(force=True)
        elif name == "hr":
            flow.block(True)
        elif name == "table":
            flow.block(True)
            self.grids.append(Grid())
        elif name == "tr" and self.grids:
            self.grids[-1].row()
        elif name in ("td", "th", "caption") and self.grids:
            element[4] = (_number(attrs.get("colspan"), 1, 1000), _number(attrs.get("rowspan"), 1, 65534))
            self.flows.append(flow)
            self.flow = Flow()
        elif name in BLOCK:
            nested = name in LISTS and sum(self.depth_of[x] for x in LISTS) > 1
            flow.block(name in SPACED and not nested)
            if name in LISTS:
                step = -1 if "reversed" in attrs else 1
                element[4] = [name == "ol", _number(attrs.get("start"), 1, 10**9), step]
            elif name == "li":
                flow.indents.append(self.marker(attrs))
            elif name in ("dd", "blockquote"):
                flow.indents.append(["  ", None])
        elif name == "input" and attrs.get("type", "").lower() not in NO_VALUE and not self.unseen:
            flow.text(attrs.get("value", ""))

    def marker(self, attrs: dict[str, str]) -> list[str | None]:
        e = self.open[at] if (at := self.last(LISTS)) >= 0 else [None] * 5
        if e[4] and e[4][0]:
            e[4][1] = _number(attrs.get("value"), e[4][1], 10**9)
            mark = f"{e[4][1]}. "
            e[4][1] += e[4][2]
            return [" " * len(mark), mark]
        return ["  ", "- "]

    def leave_last(self) -> str:
        name, gone, unseen, pre, state = self.open.pop()
        self.depth_of[name] -= 1
        self.places[name].pop()
        shown = not self.gone
        self.gone -= gone
        self.unseen = unseen
        self.pre -= pre
        if not shown:
            return name
        flow = self.flow
        if name == "table" and self.grids:
            lines = self.grids.pop().lines()
            while lines and not lines[-1]:
                lines.pop()
            for line in lines:
                flow.put(line)
            flow.block(True)
        elif name == "tr" and self.grids:
            self.grids[-1].end_row()
        elif name in ("td", "th", "caption") and self.flows:
            flow.end_line()
            self.flow = self.flows.pop()
            if self.grids and name == "caption":
                self.grids[-1].caption += flow.lines
            elif self.grids:
                across, down = state or (1, 1)
                self.grids[-1].cell(flow.lines, max(1, across), max(1, down))
        elif name in BLOCK and name != "br":
            flow.block(name in SPACED and not (name in LISTS and any(self.depth_of[x] for x in LISTS)))
            if name in ("li", "dd", "blockquote") and flow.indents:
                flow.indents.pop()
                flow.told = min(flow.told, len(flow.indents))
        return name

    def data(self, text: str) -> None:
        if self.drop_newline and text[:1] in ("\n", "\r"):
            text = text[2:] if text[:2] == "\r\n" else text[1:]
        if text:
            self.drop_newline = False
        if not text or self.gone or self.unseen:
            return
        if self.depth_of["svg"] and self.last(SVG_SHOWN) < self.last(("svg",)):
            return
        if self.open and self.open[-1][0] == "details" and not self.open[-1][4]:
            return
        if self.grids and self.open[-1][0] in ("table", "thead", "tbody", "tfoot", "tr", "colgroup"):
            # Text between cells is shown before its table.
            target = self.flow
            if text.strip(" \t\n\f\r"):
                target.text(text)
                target.block(True)
            return
        if self.pre:
            self.flow.kept(text)
        else:
            self.flow.text(text)

    def result(self) -> str:
        while self.open:
            self.leave_last()
        self.flow.end_line()
        lines = self.flow.lines
        while lines and not lines[-1]:
            lines.pop()
        return "\n".join(lines)


def render(markup: str) -> str:
    """All visible text of a page; empty for empty markup."""
    page, at, n = Page(), 0, len(markup)
    while at < n:
        lt = markup.find("<", at)
        if lt < 0:
            lt = n
        if lt > at:
            text = markup[at:lt]
            page.data((html.unescape(text) if "&" in text else text).replace("\0", ""))
            at = lt
            continue
        if (m := _TAG.match(markup, at)) is not None:
            name, at = m.group(2).lower(), m.end()
            if m.group(1):
                page.end(name)
                continue
            page.start(name, m.group(3))
            if name in _END:
                stop = _END[name].search(markup, at)
                end = stop.start() if stop else n
                if name in RAW_DECODED or name == "xmp":
                    text = markup[at:end]
                    page.data((html.unescape(text) if name in RAW_DECODED else text).replace("\0", ""))
                at = end
                if not stop:
                    break
            continue
        if markup.startswith("<!--", at):
            end = markup.find("-->", at + 2)
            at = end + 3 if end >= 0 else n
        elif markup.startswith(("<!", "<?"), at) or re.match(r"</[^a-zA-Z]", markup[at:at + 3]):
            end = markup.find(">", at)
            at = end + 1 if end >= 0 else n
        elif re.match(r"</?[a-zA-Z]", markup[at:at + 3]):
            break  # the page ends inside a tag
        else:
            page.data("<")
            at += 1
    return page.result()


def with_visible_text(pages: DataFrame, markup: str = "html", out: str = "text") -> DataFrame:
    """``pages`` plus the visible text of the whole page. Null and empty pages give the empty text; rows
    are independent; repeated rows and other columns pass through (``out`` replaces its namesake)."""
    bounded_batches(pages.sparkSession)

    @F.pandas_udf("string")
    def visible(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in parts:
            yield pd.Series([render(x) for x in s], dtype=object)

    return pages.withColumn(out, visible(text_or_empty(markup)))
