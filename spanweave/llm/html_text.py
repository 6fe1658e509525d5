"""Layout-aware text of HTML pages (operator 3).

Markup is read into a tree: void elements hold nothing, raw-text elements end at their own end tag,
end tags that the standard lets authors leave out (``p``, ``li``, ``dt``, ``dd``, ``option``, ``optgroup``,
ruby and table parts) are implied, stray end tags are dropped. A ``head`` ends, without its end tag, at
the first text or element that no head may hold; ``html``, ``head`` and ``body`` exist once, later tags of
theirs open nothing. The tree is then rendered: elements that browsers do
not show, by name, by the ``hidden`` attribute or by an inline ``display: none``, are left out, as are closed dialogs
and what closed details hold beside their summary; an inline
``visibility: hidden`` leaves out text but not descendants made visible again; of several declarations the last valid one
counts, important ones first; form fields show their values, placeholders and labels; blocks stand on lines of their own, headings and paragraphs with
a blank line around; list items carry their mark and indentation; the cells of a table are aligned in
columns by the width that characters take, also below cells of several rows; preformatted text keeps its white space; elsewhere white space collapses.

Defined results: a null or empty page has an empty text; markup that never closes runs to the end of
the page; nesting of any depth is rendered without recursion limits; repeated rows each return their
row; an empty table gives an empty result; further columns are not read.
"""

from __future__ import annotations

import re
import unicodedata
from html import unescape

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_texts

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
#: Raw text whose character references are decoded.
DECODED = frozenset(["textarea", "title"])
HIDDEN = frozenset("head script style template noscript iframe datalist audio video canvas noembed noframes title meta link meter progress".split())
#: Elements that keep white space, and fields that show no text of theirs.
KEPT = frozenset("pre textarea xmp listing plaintext".split())
WORDLESS = frozenset("hidden checkbox radio file color range password".split())
#: Values of ``display``, and those of ``white-space`` that keep white space.
DISPLAYS = frozenset("block contents flex flow-root grid inherit initial inline inline-block inline-flex inline-grid inline-table list-item none revert revert-layer ruby table table-caption table-cell table-column table-column-group table-footer-group table-header-group table-row table-row-group unset".split())
SPACED = frozenset("break-spaces pre pre-line pre-wrap".split())
#: What may stand in a head; anything else ends it.
METADATA = frozenset("base basefont bgsound link meta noframes noscript script style template title".split())
#: Elements of foreign content that are not shown where they stand.
UNSHOWN = {"svg": frozenset("title desc defs metadata".split()), "math": frozenset("annotation annotation-xml".split())}
APART = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre table figure hr dl xmp listing plaintext".split())
BLOCK = APART | frozenset("html body div section article aside header footer nav main address form fieldset ul ol li dt dd figcaption details summary tr caption thead tbody tfoot center option select optgroup legend dialog search hgroup menu dir".split())
#: Start tag -> the open elements whose end it implies, and the elements that it does not look beyond.
LIST, TABLE = frozenset(["ul", "ol", "menu", "dir"]), frozenset(["table"])
IMPLIED = {
    "li": (frozenset(["li"]), LIST),
    "dt": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "dd": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "option": (frozenset(["option"]), frozenset(["select"])),
    "optgroup": (frozenset(["option", "optgroup"]), frozenset(["select"])),
    **{x: (frozenset(["rb", "rt", "rtc", "rp"]), frozenset(["ruby"])) for x in ("rb", "rt", "rtc", "rp")},
    "tr": (frozenset(["tr", "td", "th", "caption", "colgroup"]), TABLE),
    "td": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "th": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    **{x: (frozenset(["thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"]), TABLE) for x in ("thead", "tbody", "tfoot")},
    **{x: (frozenset(["p"]), frozenset(["button", "td", "th", "table", "object"])) for x in (APART | BLOCK) - frozenset("html body li dt dd tr caption thead tbody tfoot option optgroup select legend".split())},
}
PARSED = re.compile(r"<!--(?:-?>|.*?(?:--!?>|\Z))|<[!?][^>]*(?:>|\Z)|</(?=[^A-Za-z])[^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>=]++|=\s*+(?:\"[^\"]*\"|'[^']*'|[^\s\"'>][^\s>]*+)?)*+)(?:>|\Z)|([^<]+|<)", re.S)
ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>][^\s>]*)))?""")
CLOSED = re.compile(r"""(?:^|[\s"']|\s[^\s="']+)/\Z""")
DECLARATION = re.compile(r"""((?:[^;"']|"[^"]*"|'[^']*'|["'])+)""")
IMPORTANT = re.compile(r"\s*!\s*important\Z")
SPACES = re.compile(r"[ \t\n\f\r]+")


class Node:
    """An element with its children, nodes or strings."""

    __slots__ = ("attrs", "children", "name")

    def __init__(self, name: str, attrs: dict[str, str]):
        self.name, self.attrs, self.children = name, attrs, []


def attributes(raw: str) -> dict[str, str]:
    found: dict[str, str] = {}
    for name, a, b, c in ATTRIBUTE.findall(raw):
        found.setdefault(name.lower(), unescape(a or b or c))
    return found


def parse(html: str) -> Node:
    """The tree of a page."""
    root = Node("#root", {})
    stack, at = [root], 0
    open_names: dict[str, int] = {}
    headed = False  # no head may begin any more

    def close(depth: int) -> None:
        while len(stack) > depth:
            open_names[stack.pop().name] -= 1

    while at < len(html):
        if (open_names.get("svg") or open_names.get("math")) and html.startswith("<![CDATA[", at):
            end = html.find("]]>", at)
            stack[-1].children.append(html[at + 9 : end if end >= 0 else len(html)])
            at = end + 3 if end >= 0 else len(html)
            continue
        m = PARSED.match(html, at)
        if m is None:  # an end tag or a quote that never closes
            m = re.compile(r"<[^<]*").match(html, at)
            at = m.end()
            stack[-1].children.append(unescape(m[0]))
            continue
        at = m.end()
        name = m[2].lower() if m[2] is not None else None
        if stack[-1].name == "head" and (m[4] is not None and m[4].strip(" \t\n\f\r") or name is not None and (name not in METADATA if not m[1] else name in ("body", "html", "br"))):
            close(len(stack) - 1)
        headed |= m[4] is not None and stack[-1].name != "head" and m[4].strip(" \t\n\f\r") != ""
        if m[4] is not None:
            stack[-1].children.append(unescape(m[4]))
        elif name is not None:
            if not m[1]:
                if (name == "head" and headed) or (name in ("html", "body") and open_names.get(name)):
                    continue
                headed |= name != "html" and name not in METADATA
            if m[1]:
                if open_names.get(name):
                    depth = max(i for i, node in enumerate(stack) if node.name == name)
                    close(depth)
                elif name in ("p", "br"):
                    stack[-1].children.append(Node(name, {}))
                continue
            if name == "image" and not open_names.get("svg"):
                name = "img"
            if name == "plaintext":
                stack[-1].children.append(node := Node(name, {}))
                node.children.append(html[at:])
                break
            if name in IMPLIED:
                ended, stop = IMPLIED[name]
                if any(map(open_names.get, ended)):
                    to = len(stack)
                    for i in range(len(stack) - 1, 0, -1):
                        if stack[i].name in stop:
                            break
                        if stack[i].name in ended:
                            to = i
                    close(to)
            node = Node(name, attributes(m[3]) if m[3].strip(" /\n\t\r\f") else {})
            stack[-1].children.append(node)
            if (open_names.get("svg") or open_names.get("math") or name in UNSHOWN) and CLOSED.search(m[3]):
                continue
            if name in RAW:
                end = re.compile(rf"</{name}(?=[\s/>])[^>]*(?:>|\Z)", re.I).search(html, at)
                stop_at = end.start() if end else len(html)
                node.children.append(unescape(html[at:stop_at]) if name in DECODED else html[at:stop_at])
                at = end.end() if end else len(html)
            elif name not in VOID:
                stack.append(node)
                open_names[name] = open_names.get(name, 0) + 1
    return root


def declared(node: Node, name: str, valid: frozenset[str]) -> str | None:
    """The value that inline style gives a property: the last valid one, of important ones if there are any."""
    style = node.attrs.get("style", "").lower()
    if name not in style:
        return None
    found = [None, None]
    for part in DECLARATION.findall(re.sub(r"/\*.*?(?:\*/|\Z)", "", style, flags=re.S)):
        key, _, value = part.partition(":")
        if key.strip() == name:
            bare = IMPORTANT.sub("", value.strip())
            if bare in valid:
                found[bare != value.strip()] = bare
    return found[1] or found[0]


def shown(node: Node) -> bool:
    """Whether a browser would show the element."""
    if node.name in HIDDEN or "hidden" in node.attrs or (node.name == "dialog" and "open" not in node.attrs):
        return False
    return declared(node, "display", DISPLAYS) != "none"


def visible(node: Node, inherited: bool) -> bool:
    """Whether the element's own text is visible: as declared, or else what its parent has."""
    said = declared(node, "visibility", frozenset(["collapse", "hidden", "initial", "visible"]))
    return inherited if said is None else said in ("visible", "initial")


def field_text(node: Node) -> str:
    """What a form field shows."""
    kind = node.attrs.get("type", "").lower()
    if kind in WORDLESS:
        return ""
    if kind == "image":
        return node.attrs.get("alt", "")
    return node.attrs.get("value") or (node.attrs.get("placeholder", "") if kind not in ("submit", "reset", "button") else "")


def children(node: Node) -> list:
    """The children that are shown; a closed ``details`` shows its first summary only, a labelled option its label."""
    if node.name == "details" and "open" not in node.attrs:
        return [c for c in node.children if not isinstance(c, str) and c.name == "summary"][:1]
    if node.name == "option" and node.attrs.get("label"):
        return [node.attrs["label"]]
    if node.name == "optgroup" and node.attrs.get("label"):
        return [node.attrs["label"], *node.children]
    if node.name == "textarea" and not any(node.children):
        return [node.attrs.get("placeholder", "")]
    return node.children


def numeral(n: int, kind: str) -> str:
    """The number of a list item: decimal, letters or Roman numerals; what has none of the latter is decimal."""
    if kind in ("a", "A") and n > 0:
        out = ""
        while n:
            n, k = divmod(n - 1, 26)
            out = chr(97 + k) + out
    elif kind in ("i", "I") and 0 < n < 4000:
        out = ""
        for value, digits in ((1000, "m"), (900, "cm"), (500, "d"), (400, "cd"), (100, "c"), (90, "xc"), (50, "l"), (40, "xl"), (10, "x"), (9, "ix"), (5, "v"), (4, "iv"), (1, "i")):
            out, n = out + digits * (n // value), n % value
    else:
        return str(n)
    return out.upper() if kind.isupper() else out


def whole(raw: str | None) -> int | None:
    return int(raw) if raw is not None and re.fullmatch(r"\s*[-+]?[0-9]{1,9}\s*", raw) else None


class Page:
    """Lines under construction: pending blank lines, the line's prefix and whether a space is due."""

    def __init__(self):
        self.lines: list[str] = []
        self.line: list[str] = []
        self.space = self.blank = False
        self.prefix, self.mark = "", ""

    def text(self, raw: str, keep: bool) -> None:
        if keep:
            for k, part in enumerate(raw.split("\n")):
                if k:
                    self.end(force=True)
                if part:
                    self.add(part)
            return
        if not raw:
            return
        parts = SPACES.split(raw)
        self.space |= parts[0] == "" and len(parts) > 1
        for k, part in enumerate(p for p in parts if p):
            self.space |= k > 0
            self.add(part)
        self.space |= parts[-1] == "" and len(parts) > 1

    def add(self, part: str) -> None:
        if not self.line:
            if self.blank and self.lines:
                self.lines.append("")
            self.blank = False
            self.line.append(self.prefix + self.mark)
            if self.mark:
                self.prefix, self.mark = self.prefix + " " * len(self.mark), ""
        elif self.space:
            self.line.append(" ")
        self.line.append(part)
        self.space = False

    def end(self, blank: bool = False, force: bool = False) -> None:
        if self.line or force:
            self.lines.append("".join(self.line).rstrip(" "))
            self.line = []
        self.space = False
        self.blank |= blank

    def result(self) -> str:
        self.end()
        return "\n".join(self.lines).strip("\n")


def width(text: str) -> int:
    """Columns that a text takes: two for wide characters, none for combining ones."""
    if text.isascii():
        return len(text)
    return sum(0 if unicodedata.combining(c) else 2 if unicodedata.east_asian_width(c) in "WF" else 1 for c in text)


def aligned(rows: list[list[str]]) -> list[str]:
    """Rows of cells with columns of even width; a cell of several lines makes its row several lines high."""
    split = [[c.split("\n") for c in row] for row in rows]
    wide = [max((width(x) for row in split if k < len(row) for x in row[k]), default=0) for k in range(max(map(len, split), default=0))]
    fill = lambda x, w: x + " " * (w - width(x))
    return ["  ".join(fill(c[i] if i < len(c) else "", w) for c, w in zip(row, wide, strict=False)).rstrip(" ") for row in split for i in range(max(map(len, row), default=0))]


def rendered(root: Node) -> str:
    """The visible text of a tree; a work list instead of recursion, as pages nest at will."""
    page = Page()
    # each step: (what, node or text, page, extra); extra of nodes and texts: white space stays, visible, what the foreign content around does not show
    work: list[tuple] = [("node", root, page, (False, True, frozenset()))]
    counters: list[list] = []
    while work:
        what, x, page, extra = work.pop()
        if what == "text":
            if extra[1]:
                page.text(x, extra[0])
        elif what == "end":
            page.end(blank=x.name in APART)
            if extra is not None:
                page.prefix, page.mark = extra, ""
            if x.name in LIST:
                counters.pop()
        elif what == "table":
            rows = [[c.result() for c in row] for row in extra if row]
            page.end(blank=True)
            for line in aligned(rows):
                if line:
                    page.add(line)
                    page.end()
            page.end(blank=True)
        elif shown(x) and x.name not in extra[2]:
            inner = (extra[0] or x.name in KEPT or declared(x, "white-space", SPACED) is not None, visible(x, extra[1]), UNSHOWN.get(x.name, extra[2]) if x.name != "foreignobject" else frozenset())
            if x.name == "br":
                page.end(force=True)
            elif x.name == "hr":
                page.end(blank=True)
            elif x.name == "img":
                if inner[1]:
                    page.text(x.attrs.get("alt", ""), False)
            elif x.name == "input":
                if inner[1] and field_text(x).strip():
                    page.text(f" {field_text(x)} ", False)
            elif x.name == "table":
                _table(x, page, work, inner[1])
            else:
                before = None
                if x.name in BLOCK:
                    page.end(blank=x.name in APART)
                    if x.name == "li":
                        kind = counters[-1] if counters else ["ul", 0, 1, "1"]
                        said = whole(x.attrs.get("value"))
                        kind[1] = kind[1] + kind[2] if said is None else said
                        before = page.prefix
                        page.mark = f"{numeral(kind[1], x.attrs.get('type') or kind[3])}. " if kind[0] == "ol" else "- "
                    elif x.name in ("dd", "blockquote"):
                        before, page.prefix = page.prefix, page.prefix + "  "
                    work.append(("end", x, page, before))
                if x.name in LIST:
                    back = x.name == "ol" and "reversed" in x.attrs
                    first = whole(x.attrs.get("start"))
                    if first is None:
                        first = sum(not isinstance(c, str) and c.name == "li" for c in x.children) if back else 1
                    counters.append([x.name, first + 1 if back else first - 1, -1 if back else 1, x.attrs.get("type", "1")])
                inside = children(x)
                if x.name in ("pre", "listing", "textarea") and inside and isinstance(inside[0], str) and inside[0].startswith("\n"):
                    inside = [inside[0][1:], *inside[1:]]  # the line break right behind the start tag is none
                for child in reversed(inside):
                    work.append(("text" if isinstance(child, str) else "node", child, page, inner))
    return page.result()


def _span(raw: str, most: int) -> int:
    return min(int(raw), most) if re.fullmatch("[0-9]{1,9}", raw) else 1


def _table(table: Node, page: Page, work: list[tuple], seen: bool) -> None:
    """Plan a table: its caption, then its cells, each on a page of its own, then their alignment."""
    rows: list[list[Page]] = []
    plan: list[tuple] = []
    # column -> rows that cells above still reach into, and the columns of this row that they take
    below: dict[int, int] = {}
    covered: frozenset[int] = frozenset()
    todo = [(c, seen) for c in reversed(table.children)]
    while todo:
        x, seen = todo.pop()
        if isinstance(x, str):
            if x.strip(" \t\n\f\r"):
                plan.append(("text", x, page, (False, seen, frozenset())))
            continue
        if not shown(x):
            continue
        inner = (False, visible(x, seen), frozenset())
        if x.name in ("td", "th"):
            if not rows:
                rows.append([])
            row, cell = rows[-1], Page()
            while len(row) in covered:
                row.append(Page())
            start = len(row)
            row.append(cell)
            kept = (declared(x, "white-space", SPACED) is not None, *inner[1:])
            plan += [("text" if isinstance(c, str) else "node", c, cell, kept) for c in x.children]
            row += [Page() for _ in range(_span(x.attrs.get("colspan", "1"), 1000) - 1)]
            down = _span(x.attrs.get("rowspan", "1"), 65_534) or 65_534  # 0: to the end of the row group
            if down > 1:
                below |= dict.fromkeys(range(start, len(row)), down - 1)
        elif x.name in ("tr", "thead", "tbody", "tfoot"):
            if x.name == "tr":
                rows.append([])
                covered, below = frozenset(below), {c: n - 1 for c, n in below.items() if n > 1}
            else:
                below = {}
            todo += [(c, inner[1]) for c in reversed(x.children)]
        elif x.name not in ("col", "colgroup"):
            plan.append(("node", x, page, (False, seen, frozenset())))
    work.append(("table", table, page, rows))
    work.extend(reversed(plan))
    page.end(blank=True)


def visible_text(html: str | None) -> str:
    return rendered(parse(html)) if html else ""


def extract(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """page_id and text, one row per row of ``pages``."""

    def batch(ids: list, htmls: list) -> dict:
        return {"page_id": ids, "text": [visible_text(h) for h in htmls]}

    return map_texts(pages.select(F.col(id_col).cast("long"), F.col(html_col)), batch, "page_id long, text string")

