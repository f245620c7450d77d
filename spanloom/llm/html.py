"""HTML extraction: a layout-aware rendering of all visible text.

A tokenizer (tags, text, comments, raw text of scripts and the like) feeds a tree builder with the implied tags of HTML:
elements whose end tags may be left out are closed by what follows them, wrong end tags are ignored, and cells, rows and
list items get their place. As in browsers, what can't stand in a table, its sections and rows stands before the table, and
cells, rows and sections are lifted out of elements that open between them and the table. The tree is rendered with block spacing (a blank line around paragraphs, headings, lists,
tables; a new line for other blocks), bullets and numbers of lists, indented nested lists, tables with their cells in
aligned columns (up to COLUMN and ALIGNED characters; what is wider is kept and pushes the rest of its line on), preformatted text as it is, and character references decoded.

Not visible: head, script, style, template, noscript (scripting is taken to be on), and other elements that don't show
text; what isn't drawn of svg (all but text and foreignObject) and the annotations of math; the attributes hidden, aria-hidden="true" and type="hidden"; inline styles display:none and visibility:hidden;
closed details except their summary; comments. Everything else is kept, navigation and advertisements too: this
operator renders and doesn't judge.

Null or empty html has an empty text and no blocks. Damaged html never fails: what isn't a tag is text, and attributes that
should be numbers count up to the first other character. Nesting has no limit: neither the tree nor the rendering recurses, nested tables
are rendered from the inside out. Rows are rendered alone, so equal rows are equal, and repeated or null ids mean nothing; an empty
table gives an empty result. Long pages are rendered whole, in runs of about a megabyte of html or one page. Columns of pages
with the names of the results (text, n_chars, n_lines, n_blocks) in any case give way to them; all others but html are carried along.
"""

from __future__ import annotations

import html as entities
import re
from collections import defaultdict
from dataclasses import dataclass, field
from unicodedata import east_asian_width

import pyarrow as pa
from pyspark.sql import DataFrame

from spanloom.llm.shared import slices

# The most columns and rows that a cell can span in HTML.
COLUMNS, ROWS = 1000, 65534
#: Lines of a cell that are wider don't widen its column, and no column is moved further to the right: a row gets so many blanks at most, however wide cells are.
COLUMN, ALIGNED = 80, 240
# Element classes of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style xmp iframe noembed noframes noscript plaintext".split())
ESCAPABLE = frozenset("textarea title".split())
HIDDEN = frozenset("head script style template noscript iframe noembed noframes object audio video canvas annotation annotation-xml mphantom datalist select map area param source track title meta link base".split())
PARAGRAPHS = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl menu table pre blockquote figure hr fieldset form article section".split())
BLOCKS = PARAGRAPHS | frozenset("html body div header footer main nav aside address li dt dd tr caption thead tbody tfoot details summary figcaption legend center dir hgroup search option optgroup td th".split())
ENDS_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section summary table ul".split())
#: A start tag closes these open elements, up to the elements of the second set.
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "option": ({"option"}, {"select", "optgroup"}),
    "optgroup": ({"option", "optgroup"}, {"select"}),
    "tr": ({"tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "thead": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "tbody": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "rt": ({"rt", "rp"}, {"ruby"}),
    "rp": ({"rt", "rp"}, {"ruby"}),
    "caption": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "body": ({"head"}, {"html"}),
}
SECTIONS = frozenset("thead tbody tfoot".split())
#: Elements that hold no text or other elements of their own; the start tags that stand in them, and in what.
FRAMES = SECTIONS | {"table", "tr"}
INSIDE = {"td": FRAMES, "th": FRAMES, "tr": SECTIONS | {"table"}} | dict.fromkeys([*SECTIONS, "caption", "colgroup"], frozenset({"table"}))
IN_FRAMES = frozenset("td th tr thead tbody tfoot caption colgroup col form script style template".split())
#: Elements of svg whose contents are not drawn in their place.
UNDRAWN = frozenset("defs symbol clippath mask pattern marker desc metadata".split())
#: An end tag doesn't reach through these.
WALLS = frozenset("table td th caption template html body".split())

_TAG = re.compile(r"<(?:(!--)|([!?])|(/?)([A-Za-z][^\s/>]*))")
_ATTRIBUTE = re.compile(r"""[\s/]*([^\s/>=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]*)))?""")
_END = re.compile(r"""(?:[^>"']|"[^"]*"|'[^']*')*?>""")
#: A-Z in lower case, without other letters whose lower case has another length.
_LOWER = {c: c + 32 for c in range(65, 91)}
_INTEGER = re.compile(r"[ \t\n\r\f]*([+-]?)([0-9]+)")
_SPACES = re.compile(r"[ \t\n\r\f]+")
_GONE = re.compile(r"(?:^|;)\s*(?:display\s*:\s*none|visibility\s*:\s*(?:hidden|collapse))\b", re.I)


@dataclass(slots=True)
class Node:
    tag: str
    attributes: dict = field(default_factory=dict)
    children: list = field(default_factory=list)
    #: Of tables and drawings: their rendered lines.
    lines: list | None = None


# --- tokens and tree -----------------------------------------------------------------------------------------------


def tokens(source: str):
    """("text", s), ("start", tag, attributes, closed) and ("end", tag) of source."""
    at, n = 0, len(source)
    low = None
    while at < n:
        m = _TAG.search(source, at)
        if not m:
            yield "text", source[at:]
            return
        if m.start() > at:
            yield "text", source[at : m.start()]
        if m[1]:
            end = source.find("-->", m.end() - 2 if source.startswith("<!-->", m.start()) else m.end())
            at = n if end < 0 else end + 3
            continue
        if m[2]:
            end = source.find(">", m.end())
            at = n if end < 0 else end + 1
            continue
        close = source.find(">", m.end())
        if close < 0:
            return  # an unfinished tag at the end is dropped
        inner = source[m.end() : close]
        if '"' in inner or "'" in inner:
            whole = _END.match(source, m.end())
            if whole:
                close = whole.end() - 1
                inner = source[m.end() : close]
        tag, at = m[4].lower(), close + 1
        if m[3]:
            yield "end", tag
            continue
        attributes = {}
        if inner and not inner.isspace():
            for a in _ATTRIBUTE.finditer(inner):
                value = next((v for v in (a[2], a[3], a[4]) if v is not None), "")
                attributes.setdefault(a[1].lower(), entities.unescape(value) if "&" in value else value)
        yield "start", tag, attributes, inner.endswith("/")
        if tag in RAW or tag in ESCAPABLE:
            low = low or source.translate(_LOWER)
            end = low.find(f"</{tag}", at) if tag != "plaintext" else -1
            end = n if end < 0 else end
            if end > at:
                yield ("text" if tag in ESCAPABLE else "raw"), source[at:end]
            at = end


def build(source: str) -> Node:
    """The tree of source under one root."""
    root = Node("#root")
    stack = [root]
    opened: defaultdict[str, list[int]] = defaultdict(list)  # the places in the stack of the open elements of a tag: nothing is looked for step by step

    def push(node: Node) -> None:
        opened[node.tag].append(len(stack))
        stack.append(node)

    def cut(i: int) -> None:
        """Close the i-th open element and what is open in it."""
        for x in stack[i:]:
            opened[x.tag].pop()
        del stack[i:]

    def nearest(tags) -> int:
        """The place of the innermost open element of tags; 0 if there is none."""
        return max((opened[t][-1] for t in tags if opened[t]), default=0)

    def close(tags, walls) -> None:
        """Close the open elements of tags (of P the nearest one), with what is open in them, unless a wall stands before."""
        while (i := nearest(tags)) > nearest(walls):
            cut(i)
            if tags is P:
                return

    def frame() -> int:
        """The place of the table in the stack whose frame (and no cell or caption of it) is the nearest around; 0 if none."""
        i = nearest(("table",))
        return i if i > nearest(("td", "th", "caption", "template")) else 0

    def put(child) -> None:
        """Add child to the open element, or before the table if that is a frame of one."""
        space = isinstance(child, str) and child.isspace()
        if stack[-1].tag == "colgroup" and not space:
            cut(len(stack) - 1)
        if stack[-1].tag in FRAMES and not space and (i := frame()):
            stack[i - 1].children.insert(-1, child)
        else:
            stack[-1].children.append(child)

    for token in tokens(source):
        kind, what = token[0], token[1]
        if kind in ("text", "raw"):
            if kind == "text" and "&" in what:
                what = entities.unescape(what)
            put(what)
        elif kind == "start":
            _, tag, attributes, closed = token
            if tag in IMPLIED:
                close(*IMPLIED[tag])
            if tag in ENDS_P:
                close(P, WALLS)
                if tag in HEADINGS and stack[-1].tag in HEADINGS:
                    cut(len(stack) - 1)
            if tag == "table" and (i := frame()):
                cut(i)
            if tag in INSIDE and frame():
                while stack[-1].tag not in INSIDE[tag]:
                    cut(len(stack) - 1)
            if tag == "tr" and stack[-1].tag == "table":
                push(_add(stack, "tbody", {}))
            elif tag in ("td", "th") and stack[-1].tag in ("table", "tbody", "thead", "tfoot"):
                if stack[-1].tag == "table":
                    push(_add(stack, "tbody", {}))
                push(_add(stack, "tr", {}))
            if tag in ("html", "body") and opened[tag]:
                continue
            if stack[-1].tag in FRAMES | {"colgroup"} and tag not in IN_FRAMES:
                put(node := Node(tag, attributes))
            else:
                node = _add(stack, tag, attributes)
                if tag == "form" and stack[-1].tag in FRAMES and frame():
                    continue
            foreign = closed and (opened["svg"] or opened["math"] or tag in ("svg", "math"))
            if tag not in VOID and not foreign:
                push(node)
        elif what == "br":
            put(Node("br"))
        elif what == "p" and not opened["p"]:
            put(Node("p"))
        else:
            own = HEADINGS if what in HEADINGS else {what}
            walls = WALLS if what not in ("table", "tr", "tbody", "thead", "tfoot", "body", "html", "template") else {"table"} if what != "table" else frozenset()
            if (i := nearest(own)) > nearest(walls - own):
                cut(i)
    return root


P = frozenset({"p"})
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())


def _add(stack: list[Node], tag: str, attributes: dict) -> Node:
    node = Node(tag, attributes)
    stack[-1].children.append(node)
    return node


def visible(node: Node) -> bool:
    if node.tag in HIDDEN:
        return False
    a = node.attributes
    if not a:
        return True
    if "hidden" in a or a.get("aria-hidden", "").lower() == "true" or node.tag == "input" and a.get("type", "").lower() == "hidden" or node.tag == "dialog" and "open" not in a:
        return False
    return not ("style" in a and _GONE.search(a["style"]))


# --- rendering -----------------------------------------------------------------------------------------------------


class Page:
    """Text in the making: pending spaces and line breaks are written when more text follows."""

    def __init__(self):
        self.out: list[str] = []
        self.breaks = 0
        self.space = False
        self.indent: list[str] = []
        self.bullet = ""
        self.blocks = 0

    def block(self, lines: int) -> None:
        if self.out:
            self.breaks = max(self.breaks, lines)
        self.space = False

    def _flush(self) -> None:
        if self.breaks or not self.out:
            self.out.append("\n" * self.breaks)
            self.blocks += 1
            lead = "".join(self.indent)
            if self.bullet:
                lead, self.bullet = lead[: len(lead) - len(self.bullet)] + self.bullet, ""
            self.out.append(lead)
            self.breaks, self.space = 0, False
        elif self.bullet:
            self.out.append(self.bullet)
            self.bullet = ""
        elif self.space:
            self.out.append(" ")
            self.space = False

    def inline(self, text: str) -> None:
        words = _SPACES.sub(" ", text)
        if words == " " or not words:
            self.space = self.space or bool(words)
            return
        if words[0] == " ":
            self.space = True
            words = words[1:]
        tail = words[-1] == " "
        self._flush()
        self.out.append(words[:-1] if tail else words)
        self.space = tail

    def lines(self, text: str) -> None:
        """Preformatted text: each line as it is."""
        for i, line in enumerate(text.split("\n")):
            if i:
                self.breaks += 1 if self.out else 0
                self.space = False
            if line:
                self._flush()
                self.out.append(line.rstrip("\r"))

    def text(self) -> str:
        return "".join(self.out)


def width(s: str) -> int:
    """Columns that s takes: two for wide characters."""
    return len(s) if s.isascii() else sum(2 if east_asian_width(c) in "WF" else 1 for c in s)


def _cells(row: Node) -> list[Node]:
    return [c for c in row.children if isinstance(c, Node) and c.tag in ("td", "th") and visible(c)]


def _rows(table: Node) -> list[tuple[Node, int]]:
    """The rows of a table, each with the number of rows of its section from it on."""
    out = []
    for c in table.children:
        if isinstance(c, Node) and visible(c):
            rows = [c] if c.tag == "tr" else [r for r in c.children if isinstance(r, Node) and r.tag == "tr" and visible(r)] if c.tag in SECTIONS else []
            out += [(r, len(rows) - i) for i, r in enumerate(rows)]
    return out


def _number(node: Node, name: str, default: int, least: int = -(2**31), most: int = 2**31 - 1) -> int:
    """The integer that an attribute begins with, moved into the bounds; default where there is none."""
    m = _INTEGER.match(node.attributes.get(name, ""))
    if not m:
        return default
    digits = m[2].lstrip("0") or "0"
    value = int(digits) if len(digits) < 12 else 10**12
    return max(least, min(-value if m[1] == "-" else value, most))


def table_lines(table: Node) -> list[str]:
    """The rows of a table with their cells in aligned columns, joined by two blanks; a cell may have several lines. Blanks are in proportion to the rows."""
    grid: list[list[tuple[int, int, list[str]]]] = []
    above: list[tuple[int, int, int]] = []  # columns (from, to) that cells above take, and up to which row; by their first column
    for number, (row, rest) in enumerate(_rows(table)):
        line, at, passed, new = [], 0, 0, []
        cells = _cells(row)
        if cells:
            above = [x for x in above if x[2] > number]
        for cell in cells:
            while passed < len(above) and above[passed][0] <= at:
                at = max(at, above[passed][1])
                passed += 1
            n = _number(cell, "colspan", 1, 1, COLUMNS)
            line.append((at, n, render(cell).split("\n")))
            down = min(_number(cell, "rowspan", 1, 0, ROWS) or rest, rest)
            if down > 1:
                if new and new[-1][1:] == (at, number + down):
                    new[-1] = (new[-1][0], at + n, number + down)
                else:
                    new.append((at, at + n, number + down))
            at += n
        if new:
            above = sorted([*above, *new])
        grid.append(line)
    widths: dict[int, int] = {}
    for line in grid:
        for at, n, lines in line:
            own = [w for w in map(width, lines) if w <= COLUMN] if n == 1 else ()
            widths[at] = max(widths.get(at, 0), *own, 0)
    places, x = {}, 0
    for k in sorted(widths):
        places[k] = min(x, ALIGNED)
        x += widths[k] + 2
    out = []
    for line in grid:
        for i in range(max([len(lines) for _, _, lines in line], default=0)):
            text = ""
            for at, _, lines in line:
                if i < len(lines) and lines[i]:
                    gap = places[at] - width(text)
                    text += " " * max(gap, 2 if text else 0) + lines[i]
            out.append(text.rstrip())
    return out


def drawn(svg: Node) -> list[Node]:
    """The elements below svg that show text."""
    out, walk = [], list(reversed(svg.children))
    while walk:
        c = walk.pop()
        if isinstance(c, Node) and visible(c) and c.tag not in UNDRAWN:
            if c.tag in ("text", "foreignobject"):
                out.append(c)
            else:
                walk += reversed(c.children)
    return out


def _prepare(root: Node) -> None:
    """Render the tables and drawings below root from the inside out, so that none has to render another one."""
    found, walk = [], [root]
    while walk:
        node = walk.pop()
        if node is not root and not visible(node):
            continue
        if node.tag in ("table", "svg"):
            found.append(node)
        walk += [c for c in node.children if isinstance(c, Node)]
    for node in reversed(found):  # an element is found before what is in it
        if node.tag == "svg":
            node.lines = [render(c) for c in drawn(node)]
        else:
            captions = [c for c in node.children if isinstance(c, Node) and c.tag == "caption" and visible(c)]
            node.lines = [*map(render, captions), *table_lines(node)]


def render(node: Node, page: Page | None = None) -> str:
    """The visible text below node, by a walk without recursion; the tables and drawings in it are rendered already."""
    page = page or Page()
    walk: list = [(node, False)]
    pre = 0
    lists: list[list] = []  # [kind, next number]
    for_each = lambda n: walk.extend((c, False) for c in reversed(n.children))
    while walk:
        item, leaving = walk.pop()
        if isinstance(item, str):
            (page.lines if pre else page.inline)(item)
            continue
        tag = item.tag
        if leaving:
            if tag in ("ul", "ol", "menu", "dir"):
                lists.pop()
            elif tag in ("li", "dd", "blockquote"):
                page.indent.pop()
                page.bullet = ""
            elif tag in ("pre", "textarea"):
                pre -= 1
            elif tag == "q":
                page.inline("”")
            if tag in BLOCKS:
                page.block(2 if tag in PARAGRAPHS and not (tag in ("ul", "ol", "menu") and lists) else 1)
            continue
        if item is node:
            for_each(item)
            continue
        if not visible(item):
            continue
        if tag == "br":
            page.breaks += 1 if page.out else 0
            page.space = False
            continue
        if tag == "wbr" or tag == "col":
            continue
        if tag == "img":
            if alt := item.attributes.get("alt", "").strip():
                page.inline(alt)
            continue
        if tag == "input":
            if item.attributes.get("type", "text").lower() in ("submit", "button", "reset"):
                page.inline(item.attributes.get("value", ""))
            continue
        if tag == "table":
            page.block(2)
            for line in item.lines or ():
                page.lines(line)
                page.block(1)
            page.block(2)
            continue
        if tag == "svg":
            for line in item.lines or ():
                page.block(1)
                page.inline(line)
                page.block(1)
            continue
        if tag in BLOCKS:
            page.block(2 if tag in PARAGRAPHS and not (tag in ("ul", "ol", "menu") and lists) else 1)
        walk.append((item, True))
        if tag in ("ul", "ol", "menu", "dir"):
            lists.append([tag, _number(item, "start", 1)])
        elif tag == "li":
            if lists and lists[-1][0] == "ol":
                number = _number(item, "value", lists[-1][1])
                lists[-1][1] = number + 1
                page.bullet = f"{number}. "
            else:
                page.bullet = "- "
            page.indent.append(" " * len(page.bullet))
        elif tag == "dd":
            page.indent.append("    ")
        elif tag == "blockquote":
            page.indent.append("  ")
        elif tag in ("pre", "textarea"):
            pre += 1
            if item.children and isinstance(item.children[0], str) and item.children[0].startswith("\n"):
                item.children[0] = item.children[0][1:]
        elif tag == "q":
            page.inline("“")
        elif tag == "details" and "open" not in item.attributes:
            walk.extend((c, False) for c in reversed(item.children) if isinstance(c, Node) and c.tag == "summary")
            continue
        for_each(item)
    return page.text()


def extract(source: str | None) -> str:
    root = build(source or "")
    _prepare(root)
    return render(root)


def render_pages(pages: DataFrame) -> DataFrame:
    """The columns of pages without html, with text, n_chars, n_lines and n_blocks (runs of lines between blank ones)."""
    keep = [c for c in pages.columns if c.lower() not in ("html", "text", "n_chars", "n_lines", "n_blocks")]

    def run(batches):
        for batch in batches:
            for part in slices(batch, "html"):
                texts = [extract(h) for h in part.column("html").to_pylist()]
                lines = [len([x for x in t.split("\n") if x]) for t in texts]
                blocks = [len([x for x in re.split(r"\n{2,}", t) if x.strip()]) for t in texts]
                yield pa.RecordBatch.from_arrays([part.column(k) for k in keep] + [pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64()), pa.array(lines, pa.int64()), pa.array(blocks, pa.int64())], names=[*keep, "text", "n_chars", "n_lines", "n_blocks"])

    schema = pages.select(*keep).schema
    for name, kind in (("text", "string"), ("n_chars", "bigint"), ("n_lines", "bigint"), ("n_blocks", "bigint")):
        schema = schema.add(name, {"string": "string", "bigint": "long"}[kind])
    return pages.select(*keep, "html").mapInArrow(run, schema)


def op1_html(spark, sf_dir: str) -> DataFrame:
    """The visible text of every page."""
    return render_pages(spark.read.parquet(f"{sf_dir}/pages.parquet"))
