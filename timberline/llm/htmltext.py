"""Layout-aware text of HTML pages.

A tree builder with implied tags makes a tree of any input; visibility rules
drop what a browser would not show (by element, attribute, style attribute and
the simple selectors of style elements); a renderer then emits all other text
with its block spacing, lists (bullets and numbers, nested) and tables whose
cells are aligned in columns, also across rows and for wide characters.  Neither
recurses, so depth is no limit.

The query (op4) returns page_id, n_chars and n_lines (long) and text of every row.

Edge cases: null or empty HTML gives an empty text; unclosed tags, comments and
quotes end with the page; pages of any length and depth are read whole, in memory
of some 100 bytes an element; repeated rows are each rendered; other columns are
ignored, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernel as K

#: Element names of HTML by their role.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style xmp iframe noembed noframes plaintext".split())
RCDATA = frozenset("title textarea".split())
HIDDEN = frozenset("head title script style template noscript iframe noembed noframes datalist audio video canvas object param source track area base link meta rp".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li listing main menu nav ol optgroup option p plaintext pre search section summary table caption thead tbody tfoot tr td th ul xmp".split())
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl menu dir table blockquote pre listing figure hr fieldset".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl dd dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li listing main menu nav ol p pre search section summary table ul xmp".split())
#: A start tag closes the nearest open element of these, unless one of the fences is nearer.
IMPLIED = {
    "li": (("li",), ("ul", "ol", "menu", "dir")),
    "dt": (("dt", "dd"), ("dl",)),
    "dd": (("dt", "dd"), ("dl",)),
    "option": (("option",), ("select", "datalist")),
    "optgroup": (("optgroup", "option"), ("select",)),
    "tr": (("tr", "caption", "colgroup"), ("table",)),
    "td": (("td", "th"), ("tr", "table")),
    "th": (("td", "th"), ("tr", "table")),
    "thead": (("thead", "tbody", "tfoot", "caption", "colgroup"), ("table",)),
    "tbody": (("thead", "tbody", "tfoot", "caption", "colgroup"), ("table",)),
    "tfoot": (("thead", "tbody", "tfoot", "caption", "colgroup"), ("table",)),
    "rt": (("rt", "rp"), ("ruby",)),
    "rp": (("rt", "rp"), ("ruby",)),
}
IN_HEAD = frozenset("base basefont bgsound link meta noframes noscript script style template title head html".split())
FENCES = frozenset("table td th caption button template object".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())

_TAG = re.compile(r"<!--(?:-?>|.*?(?:--!?>|\Z))|<[!?][^>]*(?:>|\Z)|</[^a-zA-Z>][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?>[^>=]+|=\s*\"[^\"]*\"|=\s*'[^']*'|=)*+)(?:>|\Z)", re.S)
_ATTR = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_SPACE = re.compile("[ \t\n\f\r]+")


class Node:
    __slots__ = ("tag", "attrs", "children")

    def __init__(self, tag: str, attrs: dict[str, str]):
        self.tag, self.attrs, self.children = tag, attrs, []


def _attrs(raw: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for m in _ATTR.finditer(raw):
        out.setdefault(m[1].lower(), html.unescape(m[2] or m[3] or m[4] or ""))
    return out


def parse(page: str) -> Node:
    """The tree of a page."""
    root = Node("html", {})
    stack, at, n = [root], 0, len(page)
    open_tags: Counter[str] = Counter()

    def pop() -> None:
        open_tags[stack.pop().tag] -= 1

    def close(names, fences) -> None:
        if not any(open_tags[x] for x in names):
            return
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].tag in names:
                while len(stack) > i:
                    pop()
                return
            if stack[i].tag in fences:
                return

    def text(s: str) -> None:
        if s:
            if stack[-1].tag == "head" and s.strip():
                pop()
            stack[-1].children.append(s)

    while at < n:
        lt = page.find("<", at)
        if lt < 0:
            text(html.unescape(page[at:]))
            break
        m = _TAG.match(page, lt)
        if m is None:
            text(html.unescape(page[at : lt + 1]))
            at = lt + 1
            continue
        text(html.unescape(page[at:lt]))
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            if tag == "br":
                stack[-1].children.append(Node("br", {}))
            elif tag == "p" and not open_tags["p"]:
                stack[-1].children.append(Node("p", {}))
            elif tag not in ("html", "body"):  # what follows them is still of the page
                close(HEADINGS if tag in HEADINGS else (tag,), () if tag in FENCES or tag in ("tr", "thead", "tbody", "tfoot") else FENCES)
            continue
        if tag in ("html", "body"):
            close(("head",), ())
            if tag == "body" and _attrs(m[3]):
                for k, v in _attrs(m[3]).items():
                    root.attrs.setdefault(k, v)
            continue
        if len(stack) > 1 and stack[-1].tag == "head" and tag not in IN_HEAD:
            pop()
        if tag in CLOSES_P:
            close(("p",), FENCES)
        if tag in HEADINGS and stack[-1].tag in HEADINGS:
            pop()
        if tag in IMPLIED:
            close(*IMPLIED[tag])
        node = Node(tag, _attrs(m[3]))
        stack[-1].children.append(node)
        if tag in RAW or tag in RCDATA:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*(?:>|\Z)", re.I).search(page, at) if tag != "plaintext" else None
            body = page[at : end.start()] if end else page[at:]
            node.children.append(html.unescape(body) if tag in RCDATA else body)
            at = end.end() if end else n
        elif tag not in VOID:
            stack.append(node)
            open_tags[tag] += 1
    return root


_DISPLAY_NONE = re.compile(r"(?:^|;)\s*display\s*:\s*none\b", re.I)
_VISIBILITY = re.compile(r"(?:^|;)\s*visibility\s*:\s*(hidden|collapse|visible)\b", re.I)


def is_hidden(node: Node) -> bool:
    a = node.attrs
    return node.tag in HIDDEN or "hidden" in a or (node.tag == "dialog" and "open" not in a) or ("style" in a and bool(_DISPLAY_NONE.search(a["style"])))


_RULE = re.compile(r"([^{}]*)\{([^{}]*)\}")
_CSS_COMMENT = re.compile(r"/\*.*?(?:\*/|\Z)", re.S)
_SELECTOR = re.compile(r"([a-zA-Z][\w-]*)?((?:[.#][\w-]+)*)")


class Sheet:
    """What style elements hide by simple selectors: a tag, classes and an id; the last rule that speaks of an element's display holds."""

    def __init__(self, root: Node):
        self.rules: list[tuple[str, frozenset[str], str, bool]] = []
        todo: list[Node | str] = [root]
        while todo:
            node = todo.pop()
            if isinstance(node, str):
                continue
            if node.tag == "style":
                self._add("".join(x for x in node.children if isinstance(x, str)))
            todo += reversed(node.children)

    def _add(self, css: str) -> None:
        depth_one = _CSS_COMMENT.sub(" ", css)
        # rules within @media and the like hold on some screens only
        depth_one = re.sub(r"@[^{};]*(?:;|\{(?:[^{}]|\{[^{}]*\})*\})", " ", depth_one)
        for m in _RULE.finditer(depth_one):
            display = re.findall(r"(?:^|;)\s*display\s*:\s*([a-z-]+)", m[2], re.I)
            for selector in m[1].split(",") if display else ():
                if (x := _SELECTOR.fullmatch(selector.strip())) and x[0]:
                    names = re.findall(r"[.#][\w-]+", x[2])
                    ids = [n[1:] for n in names if n[0] == "#"]
                    if len(ids) < 2:
                        self.rules.append(((x[1] or "").lower(), frozenset(n[1:] for n in names if n[0] == "."), ids[0] if ids else "", display[-1].lower() == "none"))

    def hides(self, node: Node) -> bool:
        out = False
        classes = set(node.attrs.get("class", "").split()) if self.rules else ()
        for tag, needed, name, hidden in self.rules:
            if tag in ("", node.tag) and needed <= classes and (not name or name == node.attrs.get("id")):
                out = hidden
        return out


class Block:
    """Lines of text being laid out: white space collapsed, margins merged, prefixes for lists and quotes."""

    def __init__(self):
        self.lines: list[str] = []
        self.line: list[str] = []
        self.space = False
        self.margin = 0
        self.prefix: list[list[str]] = []

    def word_text(self, s: str) -> None:
        parts = _SPACE.split(s)
        if len(parts) > 1 and not parts[0]:
            self.space = True
        for i, w in enumerate(parts):
            if w:
                if (self.space or i and parts[i - 1]) and self.line:
                    self.line.append(" ")
                self.line.append(w)
                self.space = False
        if len(parts) > 1 and not parts[-1]:
            self.space = True

    def pre_text(self, s: str) -> None:
        for i, part in enumerate(s.replace("\r\n", "\n").replace("\r", "\n").split("\n")):
            if i:
                self.end_line(force=True)
            if part:
                self.line.append(part)

    def end_line(self, force: bool = False) -> None:
        if self.line or force:
            if self.margin and self.lines:
                self.lines += [""] * self.margin
            self.margin = 0
            lead = ""
            for p in self.prefix:
                lead += p[0]
                p[0] = p[1]
            self.lines.append((lead + "".join(self.line)).rstrip())
            self.line = []
        self.space = False

    def gap(self, lines: int) -> None:
        self.end_line()
        self.margin = max(self.margin, lines)

    def done(self) -> list[str]:
        self.end_line()
        return self.lines


def _width(s: str) -> int:
    """Columns of a terminal: two for wide characters, none for marks that combine."""
    return len(s) if s.isascii() else sum(0 if unicodedata.combining(c) else 2 if unicodedata.east_asian_width(c) in "WF" else 1 for c in s)


def _table(rows: list[list[tuple[list[str], int, int]]]) -> list[str]:
    """Rows of cells (lines, columns and rows they span) with their columns aligned; below a cell that spans rows its columns stay blank."""
    width: dict[int, int] = {}
    placed, taken = [], {}
    for row in rows:
        cells, c = [], 0
        for lines, span, deep in row:
            while taken.get(c, 0) > 0:
                c += 1
            cells.append((c, lines, span))
            if span == 1:
                width[c] = max([width.get(c, 0), *map(_width, lines)])
            for k in range(c, c + span):
                taken[k] = max(taken.get(k, 0), deep)
            c += span
        placed.append(cells)
        taken = {k: n - 1 for k, n in taken.items() if n > 1}
    out = []
    for cells in placed:
        for i in range(max([1, *(len(lines) for _, lines, _ in cells)])):
            line, at = "", 0
            for c, lines, span in cells:
                line += " " * sum(width.get(k, 0) + 2 for k in range(at, c))
                text = lines[i] if i < len(lines) else ""
                room = sum(width.get(k, 0) for k in range(c, c + span)) + 2 * (span - 1)
                line += text + " " * (max(0, room - _width(text)) + 2)
                at = c + span
            out.append(line.rstrip())
    return [x for x in out if x]


def _span(node: Node, name: str, most: int, nought: int) -> int:
    value = node.attrs.get(name, "1")
    return min(most, int(value) or nought) if re.fullmatch("[0-9]{1,9}", value) else 1


def render(root: Node) -> str:
    """All visible text of a tree."""
    blocks = [Block()]
    tables: list[list[list[tuple[list[str], int, int]]]] = []
    sheet = Sheet(root)
    counters: list[int | None] = []
    # (node or text, whether it ends, whether it is preformatted, whether it is visible)
    todo: list[tuple[Node | str, bool, bool, bool]] = [(root, False, False, True)]
    while todo:
        node, ends, pre, visible = todo.pop()
        out = blocks[-1]
        if isinstance(node, str):
            if visible:
                out.pre_text(node) if pre else out.word_text(node)
            continue
        tag = node.tag
        cell = tag in ("td", "th") and tables
        if ends:
            if cell:
                lines = blocks.pop().done()
                tables[-1] = tables[-1] or [[]]
                # the largest spans of HTML; 0 rows are all that are left
                tables[-1][-1].append((lines, _span(node, "colspan", 1000, 1), _span(node, "rowspan", 65534, 65534)))
            elif tag == "table":
                rows = tables.pop()
                captions = blocks.pop().done()
                out = blocks[-1]
                out.gap(1)
                for line in captions + _table(rows):
                    out.line = [line]
                    out.end_line()
                out.gap(1)
            elif tag == "q":
                out.word_text("”")
            elif tag in BLOCK:
                out.end_line()
                if tag in ("ul", "ol", "menu", "dir"):
                    counters.pop()
                    out.prefix.pop()
                elif tag == "li":
                    out.prefix.pop()
                elif tag in ("blockquote", "dd"):
                    out.prefix.pop()
                if tag in SPACED and not (tag in ("ul", "ol", "menu", "dir") and counters):
                    out.gap(1)
            continue
        if is_hidden(node) or (sheet.rules and sheet.hides(node)):
            continue
        if "style" in node.attrs and (v := _VISIBILITY.search(node.attrs["style"])):
            visible = v[1].lower() == "visible"
        children = node.children
        if tag == "br":
            out.end_line(force=True)
            continue
        if tag == "img":
            continue  # alternative text is not shown beside a loaded image
        if tag == "details" and "open" not in node.attrs:
            children = [x for x in children if isinstance(x, Node) and x.tag == "summary"][:1]
        if cell:
            tables[-1] = tables[-1] or [[]]
            blocks.append(Block())
        elif tag == "table":
            tables.append([])
            blocks.append(Block())
        elif tag == "tr" and tables:
            tables[-1].append([])
        elif tag == "q":
            out.word_text("“")
        elif tag in BLOCK:
            nested = tag in ("ul", "ol", "menu", "dir") and bool(counters)
            out.gap(1) if tag in SPACED and not nested else out.end_line()
            if tag in ("ul", "ol", "menu", "dir"):
                start = node.attrs.get("start", "1")
                counters.append((int(start) if re.fullmatch(r"-?[0-9]{1,9}", start) else 1) if tag == "ol" else None)
                out.prefix.append(["  ", "  "] if nested else ["", ""])
            elif tag == "li":
                number = counters[-1] if counters else None
                value = node.attrs.get("value", "")
                if number is not None and re.fullmatch(r"-?[0-9]{1,9}", value):
                    number = int(value)
                mark = "• " if number is None else f"{number}. "
                if number is not None:
                    counters[-1] = number + 1
                out.prefix.append([mark, " " * len(mark)])
            elif tag == "blockquote":
                out.prefix.append(["> ", "> "])
            elif tag == "dd":
                out.prefix.append(["    ", "    "])
            elif tag == "hr":
                out.line = ["---"]
                out.end_line()
        todo.append((node, True, pre, visible))
        pre = pre or tag in ("pre", "listing", "textarea", "xmp", "plaintext")
        if pre and tag in ("pre", "listing", "textarea") and children and isinstance(children[0], str) and children[0].startswith("\n"):
            children = [children[0][1:], *children[1:]]
        todo += [(x, False, pre, visible) for x in reversed(children)]
    lines = blocks[0].done()
    while lines and not lines[-1]:
        lines.pop()
    while lines and not lines[0]:
        lines.pop(0)
    return "\n".join(lines)


def text_of(page: str | None) -> str:
    return render(parse(page)) if page else ""


def extract(pages: DataFrame) -> DataFrame:
    """page_id, n_chars, n_lines and text of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 512):
                part = batch.slice(i, 512)
                texts = [text_of(x) for x in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array([t.count("\n") + 1 if t else 0 for t in texts], pa.int64()), pa.array(texts, pa.string())], ["page_id", "n_chars", "n_lines", "text"])

    return K.bounded(pages).select(F.col("page_id").cast("long").alias("page_id"), "html").mapInArrow(run, "page_id long, n_chars long, n_lines long, text string")
