"""Visible text of HTML pages, laid out as blocks, lists and tables.

A tree is built first: start tags close what they imply (a paragraph, list item, cell, row, option), end tags close up to
their element, void elements have no content, and the content of scripts, styles and text areas is taken raw.  The
tree is then walked without recursion.  Elements that a browser does not show are skipped; white space is collapsed but in
``pre``; blocks stand on lines of their own, paragraphs, headings, lists and tables have an empty line around
them; list items get a dash or number and are indented by depth; table cells are padded to their column.  Formulas and the texts of drawings
are inline content, each drawn text a word of its own; what only describes them is not shown.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basketlens.llm.shared import blocks, ship

MARKUP = re.compile(
    r"<!--(?:.*?-->|.*)"
    r"|<!\[CDATA\[(?:.*?\]\]>|.*)"
    r"|<[!?][^>]*>?"
    r"|<(/?)([a-zA-Z][^\s/>]*+)([^>\"']*+(?:\"[^\"]*+\"[^>\"']*+|'[^']*+'[^>\"']*+)*+|[^>]*+)>",
    re.S,
)
ATTRIBUTE = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'=<>`]+)))?")
SPACE = re.compile(r"[ \t\n\f\r]+")
NOT_SHOWN = re.compile(r"(?:^|;)\s*display\s*:\s*none", re.I)
VISIBILITY = re.compile(r"(?:^|;)\s*visibility\s*:\s*(visible|hidden|collapse)", re.I)
NUMBER = re.compile(r"-?[0-9]{1,9}")

# Element names of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
UNSEEN = frozenset("head script style template noscript iframe noembed noframes title meta link datalist object audio video canvas param source track area map rp".split())
# Within a formula or drawing: what is not shown, in lower case, and in a drawing the elements that show text.
UNSEEN_IN = {
    "math": frozenset(["annotation", "annotation-xml"]),
    "svg": frozenset("defs metadata title desc symbol clippath mask pattern marker lineargradient radialgradient filter".split()),
}
DRAWN = frozenset(["text", "foreignobject"])
# A start tag of these ends an open formula or drawing, but within an element that holds HTML.
BREAKOUT = frozenset(
    "b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing menu meta nobr ol p pre ruby s small span strong strike sub sup table tt u ul var".split()
)
HOLDS_HTML = frozenset("foreignobject desc title annotation-xml mi mo mn ms mtext".split())
PARAGRAPH_ENDS = frozenset(
    "address article aside blockquote details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split()
)
BLOCKS = PARAGRAPH_ENDS | frozenset("html body li dt dd summary legend caption option optgroup select textarea center tr td th tbody thead tfoot xmp".split())
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre xmp ul ol dl table figure hr".split())
# A start tag of the key closes an open element of the set, up to the nearest of the borders.
IMPLIED = {
    "li": (frozenset(["li"]), frozenset("ul ol menu dir table".split())),
    "dt": (frozenset(["dt", "dd"]), frozenset(["dl", "table"])),
    "dd": (frozenset(["dt", "dd"]), frozenset(["dl", "table"])),
    "td": (frozenset(["td", "th"]), frozenset(["table"])),
    "th": (frozenset(["td", "th"]), frozenset(["table"])),
    "tr": (frozenset(["tr", "td", "th", "caption", "colgroup"]), frozenset(["table"])),
    "tbody": (frozenset("tbody thead tfoot tr td th caption colgroup".split()), frozenset(["table"])),
    "thead": (frozenset("tbody thead tfoot tr td th caption colgroup".split()), frozenset(["table"])),
    "tfoot": (frozenset("tbody thead tfoot tr td th caption colgroup".split()), frozenset(["table"])),
    "option": (frozenset(["option"]), frozenset(["select", "datalist"])),
    "optgroup": (frozenset(["option", "optgroup"]), frozenset(["select"])),
    "body": (frozenset(["head"]), frozenset()),
}
SCOPES = frozenset("table td th caption html template button".split())
WIDEST_PADDED = 60


# As in browsers.
MOST_ROWS, MOST_COLUMNS = 65_534, 1_000


class Node:
    __slots__ = ("tag", "hidden", "ordered", "children", "visible", "span", "back")

    def __init__(self, tag: str, hidden: bool = False, ordered: int | None = None):
        self.tag, self.hidden, self.ordered, self.children = tag, hidden, ordered, []
        self.visible: bool | None = None  # None: as the parent
        self.span = (1, 1)  # rows and columns of a cell
        self.back = False  # numbers go down


def _attributes(raw: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for name, *values in ATTRIBUTE.findall(raw):
        out.setdefault(name.lower(), html.unescape(next((v for v in values if v), "")))
    return out


def _number(a: dict[str, str], name: str) -> int | None:
    value = a.get(name, "").strip()
    return int(value) if NUMBER.fullmatch(value) else None


def _open(tag: str, raw: str) -> Node:
    hidden = tag in UNSEEN
    ordered = None
    visible, span, back = None, (1, 1), False
    if raw and not raw.isspace():
        a = _attributes(raw)
        hidden = hidden or "hidden" in a or bool(NOT_SHOWN.search(a.get("style", ""))) or (tag == "input" and a.get("type", "").lower() == "hidden")
        if tag == "dialog":
            hidden = hidden or "open" not in a
        if style := VISIBILITY.findall(a.get("style", "")):
            visible = style[-1].lower() == "visible"
        if tag == "ol":
            ordered, back = _number(a, "start"), "reversed" in a
            if ordered is None and not back:
                ordered = 1
        if tag == "li":
            ordered = _number(a, "value")
        if tag in ("td", "th"):
            down, across = _number(a, "rowspan"), _number(a, "colspan")
            # no rows means all that follow
            span = MOST_ROWS if down == 0 else min(max(down or 1, 1), MOST_ROWS), min(max(across or 1, 1), MOST_COLUMNS)
        if tag == "details":
            ordered = 1 if "open" in a else 0
        if tag == "input" and not hidden and a.get("type", "text").lower() in ("submit", "button", "reset", "text", "search", "email", "url", "tel"):
            node = Node(tag)
            node.visible = visible
            if a.get("value"):
                node.children.append(a["value"])
            return node
    elif tag == "dialog":
        hidden = True
    elif tag == "ol":
        ordered = 1
    elif tag == "details":
        ordered = 0
    node = Node(tag, hidden, ordered)
    node.visible, node.span, node.back = visible, span, back
    return node


def build(page: str) -> Node:
    """The tree of a page; texts are children as plain strings, with entities resolved."""
    root = Node("#root")
    stack, counts, at = [root], {}, 0

    def close(n: int) -> None:
        while len(stack) > n:
            counts[stack.pop().tag] -= 1

    def text(raw: str) -> None:
        if raw:
            stack[-1].children.append(html.unescape(raw) if "&" in raw else raw)

    while True:
        m = MARKUP.search(page, at)
        if m is None:
            text(page[at:])
            return root
        if m.start() > at:
            text(page[at : m.start()])
        at = m.end()
        tag = m[2]
        if tag is None:
            if page.startswith("<![CDATA[", m.start()):
                text(page[m.start() + 9 : at - 3 if page.endswith("]]>", 0, at) else at])
            continue
        tag = tag.lower()
        if m[1]:
            if counts.get(tag):
                for n in range(len(stack) - 1, 0, -1):
                    if stack[n].tag == tag:
                        close(n)
                        break
                    if stack[n].tag in ("td", "th", "caption") and tag not in ("table", "tr", "tbody", "thead", "tfoot", "body", "html"):
                        break  # a cell holds in what is opened in it
            elif tag == "p":
                stack[-1].children.append(Node("p"))
            elif tag == "br":
                stack[-1].children.append(Node("br"))
            continue
        if tag in BREAKOUT and (counts.get("math") or counts.get("svg")):
            for n in range(len(stack) - 1, 0, -1):
                if stack[n].tag in HOLDS_HTML:
                    break
                if stack[n].tag in UNSEEN_IN:
                    close(n)
                    break
        if tag in IMPLIED:
            ends, borders = IMPLIED[tag]
            if any(counts.get(e) for e in ends):
                lowest = None
                for n in range(len(stack) - 1, 0, -1):
                    if stack[n].tag in ends:
                        lowest = n
                    elif stack[n].tag in borders:
                        break
                if lowest is not None:
                    close(lowest)
        if tag in PARAGRAPH_ENDS and counts.get("p"):
            for n in range(len(stack) - 1, 0, -1):
                if stack[n].tag == "p":
                    close(n)
                    break
                if stack[n].tag in SCOPES:
                    break
        inside = next((x for x in ("math", "svg") if counts.get(x)), None)
        node = _open(tag, m[3])
        if inside:
            # of formula and drawing, the inner one decides
            inside = next(n.tag for n in reversed(stack) if n.tag in UNSEEN_IN) if counts.get("math") and counts.get("svg") else inside
            node.hidden = node.hidden or tag in UNSEEN_IN[inside]
        stack[-1].children.append(node)
        if inside and m[3].endswith("/"):
            continue  # such elements may close themselves
        if tag in RAW and not (inside and tag == "title"):
            end = re.compile(rf"</{re.escape(tag)}\s*/?>", re.I).search(page, at)
            raw = page[at : end.start() if end else len(page)]
            if tag in ("textarea", "title"):
                node.children.append(html.unescape(raw))
            elif tag == "xmp":
                node.children.append(raw)
            at = end.end() if end else len(page)
        elif tag not in VOID:
            stack.append(node)
            counts[tag] = counts.get(tag, 0) + 1


class Lines:
    """Text being laid out: finished lines, the open line, and what separates it from what follows."""

    def __init__(self):
        self.done: list[str] = []
        self.open: list[str] = []
        self.space = False
        self.gap = False
        self.indent = 0
        self.mark = ""

    def add(self, text: str) -> None:
        if not text:
            return
        if not self.open:
            if self.gap and self.done:
                self.done.append("")
            self.gap = False
            self.open.append(" " * self.indent + self.mark)
            self.mark = ""
        elif self.space:
            self.open.append(" ")
        self.space = False
        self.open.append(text)

    def words(self, text: str) -> None:
        flat = SPACE.sub(" ", text)
        body = flat.strip(" ")
        if flat[:1] == " " and self.open:
            self.space = True
        if body:
            self.add(body)
            self.space = flat[-1] == " "

    def end_line(self) -> None:
        if self.open:
            self.done.append("".join(self.open))
            self.open, self.space = [], False

    def block(self, spaced: bool) -> None:
        self.end_line()
        self.gap = self.gap or spaced

    def as_is(self, text: str) -> None:
        first, *rest = text.split("\n")
        if first:
            self.add(first)
        for line in rest:
            self.end_line() if self.open else self.done.append("")
            if line:
                self.add(line)

    def text(self) -> str:
        self.end_line()
        return "\n".join(self.done)


Cell = tuple[str, int, int]  # text, rows, columns


def grid(rows: list[list[Cell]]) -> list[list[tuple[int, int, str]]]:
    """For each row its cells as (first column, column after the last, text), past the columns that cells above reach into."""
    out, taken = [], []  # for each column, how many more rows it is taken
    for row in rows:
        placed, at = [], 0
        left = list(taken)
        for text, down, across in row:
            while at < len(taken) and taken[at]:
                at += 1
            end = at + across
            taken += [0] * (end - len(taken))
            left += [0] * (end - len(left))
            for i in range(at, end):
                left[i] = max(left[i], down)
            placed.append((at, end, text))
            at = end
        taken = [max(0, n - 1) for n in left]
        out.append(placed)
    return out


def table_lines(rows: list[list[Cell]]) -> list[str]:
    """Cells side by side, padded to the widest of their column; longer ones than ``WIDEST_PADDED`` overflow."""
    placed = [row for row in grid(rows) if any(text.strip() for *_, text in row)]
    # only columns in which some cell begins
    begins = sorted({at for row in placed for at, _, _ in row})
    number = {at: i for i, at in enumerate(begins)}
    cells = [[(number[at], bisect_left(begins, end), text.strip("\n").split("\n")) for at, end, text in row] for row in placed]
    widths = [0] * len(begins)

    def room(i: int, j: int) -> int:
        return sum(widths[i:j]) + 3 * (j - i - 1)

    for span in sorted({j - i for row in cells for i, j, _ in row}):
        for row in cells:
            for i, j, lines in row:
                if j - i == span:
                    widest = max((len(x) for x in lines if len(x) <= WIDEST_PADDED), default=0)
                    widths[j - 1] += max(0, widest - room(i, j))
    out = []
    for row in cells:
        for k in range(max((len(lines) for *_, lines in row), default=0)):
            parts, at = [], 0
            for i, j, lines in row:
                parts += ["".ljust(widths[c]) for c in range(at, i)]  # what a cell above reaches into
                parts.append((lines[k] if k < len(lines) else "").ljust(room(i, j)))
                at = j
            out.append(" | ".join(parts).rstrip())
    return out


def render(root: Node) -> str:
    """The visible text of a tree."""
    page = Lines()
    out, outs = page, []  # cells are laid out apart
    tables: list[list[list[Cell]]] = []
    lists: list[list[int | None]] = []  # the next number, and what it goes on by
    shown = [True]
    pre = 0
    drawn: list[bool] = []  # for each open drawing, whether text is shown here
    todo: list[tuple[object, bool]] = [(root, False)]
    while todo:
        node, leaving = todo.pop()
        if isinstance(node, str):
            if (drawn and not drawn[-1]) or not shown[-1]:
                continue
            out.as_is(node) if pre else out.words(node)
            continue
        tag = node.tag
        if not leaving:
            if node.hidden:
                continue
            if node.visible is not None and tag not in VOID:
                shown.append(node.visible)
            if tag == "br":
                out.end_line() if out.open else out.done.append("") if out.done and not out.gap else None
                continue
            if tag in ("td", "th", "caption") and tables:
                if tag != "caption":
                    if not tables[-1]:
                        tables[-1].append([])
                    outs.append(out)
                    out = Lines()
                else:
                    out.block(False)
            elif tag == "tr" and tables:
                tables[-1].append([])
            elif tag == "table":
                out.block(True)
                tables.append([])
            elif tag in BLOCKS:
                out.block(tag in SPACED and not (tag in ("ul", "ol") and lists))
            if tag in ("ul", "ol", "menu", "dir"):
                number = node.ordered
                if number is None and node.back:
                    number = sum(isinstance(c, Node) and c.tag == "li" and not c.hidden for c in node.children)
                lists.append([number, -1 if node.back else 1])
                out.indent += 2 * (len(lists) > 1)
            elif tag == "li":
                mark = "- "
                if lists and lists[-1][0] is not None:
                    if node.ordered is not None:
                        lists[-1][0] = node.ordered
                    mark = f"{lists[-1][0]}. "
                    lists[-1][0] += lists[-1][1]
                out.mark = mark if shown[-1] else ""
            elif tag in ("dd", "blockquote"):
                out.indent += 2
            elif tag in ("pre", "xmp", "textarea"):
                pre += 1
            elif tag == "svg":
                drawn.append(False)
                out.space = out.space or bool(out.open)
            elif drawn and tag in DRAWN:
                drawn.append(True)
                out.space = out.space or bool(out.open)
            elif tag == "hr":
                if shown[-1] and node.visible is not False:
                    out.add("---")
                out.block(True)
            elif tag in ("input", "button"):
                out.space = out.space or bool(out.open)
            todo.append((node, True))
            children = node.children
            if tag == "details" and not node.ordered:  # closed: its summary alone shows
                children = [c for c in children if isinstance(c, Node) and c.tag == "summary"][:1]
            todo.extend((c, False) for c in reversed(children))
            continue
        if tag in ("td", "th") and tables and outs:
            tables[-1][-1].append((out.text(), *node.span))
            out = outs.pop()
        elif tag == "table":
            out.block(True)
            for line in table_lines(tables.pop()):
                if line:
                    out.add(line)
                    out.end_line()
            out.block(True)
        elif tag in BLOCKS and tag != "tr":
            if tag == "li" and out.mark:
                out.mark = ""
            out.block(tag in SPACED and not (tag in ("ul", "ol") and len(lists) > 1))
        if tag in ("ul", "ol", "menu", "dir"):
            out.indent -= 2 * (len(lists) > 1)
            lists.pop()
        elif tag in ("dd", "blockquote"):
            out.indent -= 2
        elif tag in ("pre", "xmp", "textarea"):
            pre -= 1
        elif drawn and (tag == "svg" or tag in DRAWN):
            drawn.pop()
            out.space = out.space or bool(out.open)
        if node.visible is not None and tag not in VOID:
            shown.pop()
    return page.text().strip("\n")


def visible_text(page: str) -> str:
    return render(build(page))


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for block in blocks(batches):
        texts = [visible_text(block.text(i).decode("utf-8")) for i in range(len(block))]
        yield pa.RecordBatch.from_arrays([block.batch.column("doc_id").cast(pa.int64()), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "text", "n_chars"])


def extract_text(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """page_id, text, n_chars for every page.

    Null and empty pages have the empty text.  Broken markup never fails: unclosed elements end with their parent or the
    page, unknown end tags are ignored, nesting may be of any depth.  Pages of any length are read whole; equal
    pages give equal texts; no rows give no rows; other columns are not read.
    """
    rows = pages.select(F.col(f"`{id_col}`").alias("doc_id"), F.coalesce(F.col(f"`{html_col}`").cast("string"), F.lit("")).alias("text"))
    return rows.mapInArrow(_extract, "page_id long, text string, n_chars long")


def query(spark: SparkSession, folder: str) -> DataFrame:
    ship(spark)
    return extract_text(spark.read.parquet(f"{folder}/pages.parquet"))
