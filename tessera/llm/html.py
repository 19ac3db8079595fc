"""Layout-aware HTML extraction.

A tree builder reads the tags, supplies the end tags that HTML implies (an open paragraph ends at a block, a list item at the
next item, a cell at the next cell, and so on) and ignores stray ones. The tree is then rendered as a reader would see it:

- hidden are head, script, style, template, noscript and similar elements, the ``hidden`` attribute, ``display: none`` and
  ``visibility: hidden`` (until made visible again inside) in a ``style`` attribute or in a ``style`` element's rules of simple
  selectors (tag, classes, ids, by specificity and order; at-rules don't count), hidden inputs, closed dialogs, and the body of
  closed details;
- blocks stand on lines of their own, paragraphs, headings, lists, tables and quotes with an empty line around them;
- list items have a bullet or a number (``start``, ``value`` and ``reversed`` count) and are indented by depth, up to
  ``INDENT`` columns;
- table rows are lines whose cells are padded to the column's width, ``colspan`` and ``rowspan`` included (bounded as in the
  HTML standard); a cell of more than ``PAD`` characters is whole but doesn't widen its column;
- white space collapses but in ``pre`` and ``textarea``; ``br`` breaks lines; images give their alternative text.

Edge cases: null html gives null text; empty html, or one with nothing visible, gives ''; unclosed and crossing tags follow
the implied rules; a quote that nothing closes is an ordinary character, and a tag within which the page ends is text; a table
or list inside a cell is rendered on one line; depth and length are unlimited (rendering keeps its own stack and doesn't
recurse, and tags are read in linear time); repeated rows render alike; extra columns are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from html import unescape
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import pieces

WHITE = " \t\n\r\f"
TAG = re.compile(r"[a-zA-Z][^ \t\n\r\f/>]*+")
#: What stands between attributes, a name, an equals sign, a value without quotes.
BETWEEN, NAME, EQUALS, BARE = (re.compile(x) for x in (r"[ \t\n\r\f/]*+", r"=?[^ \t\n\r\f/>=]*+", r"[ \t\n\r\f]*+=[ \t\n\r\f]*+", r"[^ \t\n\r\f>]*+"))
NUMBER = re.compile(r"[ \t\n\r\f]*\+?0*([0-9]{1,9})")
COMMENT, BRACE, PART = re.compile(r"/\*.*?(?:\*/|\Z)", re.S), re.compile(r"[{}]"), re.compile(r"[.#][^.#]+")
SIMPLE = re.compile(r"([a-z][a-z0-9]*|\*)?((?:[.#][a-z0-9_-]+)*)")
SPACE = re.compile(r"[ \t\n\r\f]+")

VOID = frozenset("area base br col embed hr img input link meta source track wbr param".split())
RAW = {t: re.compile(rf"</{t}(?=[\s/>])", re.I) for t in ("script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes")}
HIDDEN = frozenset("head script style template noscript title meta link base iframe noembed noframes object audio video canvas svg datalist param source track area".split())
#: Blocks by the empty lines around them.
PARAGRAPHS = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl table pre blockquote figure fieldset hr menu".split())
BLOCKS = PARAGRAPHS | frozenset("html body div section article aside main nav header footer address form center details summary dialog figcaption li dt dd legend tr caption option optgroup hgroup search".split())
#: Blocks whose start ends an open paragraph.
ENDS_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section summary table ul li dt dd".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
CELLS, SECTIONS = frozenset(("td", "th")), frozenset(("thead", "tbody", "tfoot"))
#: A start tag ends these open elements, searched up to the barrier.
IMPLIED = {
    "li": (frozenset(("li",)), frozenset(("ul", "ol", "menu", "table", "td", "th"))),
    "dt": (frozenset(("dt", "dd")), frozenset(("dl", "table", "td", "th"))),
    "dd": (frozenset(("dt", "dd")), frozenset(("dl", "table", "td", "th"))),
    "tr": (frozenset(("tr", "caption", "colgroup")), frozenset(("table",))),
    "td": (CELLS, frozenset(("tr", "table"))),
    "th": (CELLS, frozenset(("tr", "table"))),
    "option": (frozenset(("option",)), frozenset(("select", "datalist", "optgroup"))),
    "optgroup": (frozenset(("option", "optgroup")), frozenset(("select",))),
} | {t: (SECTIONS | {"caption", "colgroup"}, frozenset(("table",))) for t in (*SECTIONS, "caption", "colgroup")}
#: Columns of text that indentation takes at most, and the longest cell that widens its column.
INDENT, PAD = 64, 120
#: An end tag doesn't reach over these.
SCOPE = frozenset(("table", "td", "th", "caption", "html"))


class Node:
    __slots__ = ("tag", "attributes", "children", "looks")

    def __init__(self, tag: str, attributes: dict):
        self.tag, self.attributes, self.children = tag, attributes, []
        self.looks = {k: v for k, (v, _) in declared(attributes["style"]).items()} if "style" in attributes else {}


def declared(css: str) -> dict[str, tuple[str, bool]]:
    """display and visibility as declared, each with whether it is important; the last one counts."""
    out: dict[str, tuple[str, bool]] = {}
    for d in css.split(";"):
        name, _, value = d.partition(":")
        if (name := name.strip().lower()) in ("display", "visibility"):
            value, bang, _ = value.lower().partition("!")
            if bang or not out.get(name, ("", False))[1]:
                out[name] = value.strip(), bool(bang)
    return out


def style(root: Node, sheets: list[str]) -> None:
    """Give the nodes what rules of simple selectors (tag, classes, ids) declare; rules within at-rules don't count."""
    rules: dict[tuple, dict] = {}
    for css in sheets:
        css, at = COMMENT.sub(" ", css), 0
        while (brace := css.find("{", at)) >= 0:
            selectors, end = css[at:brace].rpartition(";")[2].strip().lower(), css.find("}", brace)
            if selectors.startswith("@"):
                depth, end = 0, -1
                for m in BRACE.finditer(css, brace):
                    depth += 1 if m.group() == "{" else -1
                    if depth == 0:
                        end = m.start()
                        break
            elif said := declared(css[brace + 1 : end if end >= 0 else len(css)]):
                for one in selectors.split(","):
                    if (m := SIMPLE.fullmatch(one.strip())) and m.group():
                        parts = PART.findall(m.group(2))
                        key = m.group(1) or "*", frozenset(x[1:] for x in parts if x[0] == "."), frozenset(x[1:] for x in parts if x[0] == "#")
                        for name, (value, important) in said.items():
                            if important or not rules.get(key, {}).get(name, (0, 0, "", False))[3]:
                                rules.setdefault(key, {})[name] = (len(key[2]) << 20 | len(key[1]) << 1 | (key[0] != "*"), brace, value, important)
            if end < 0:
                break
            at = end + 1
    if not rules:
        return
    by: dict[tuple, list] = {}  # rules by an id, a class or the tag that they ask for
    for key, said in rules.items():
        tag, classes, ids = key
        by.setdefault(("#", min(ids)) if ids else (".", min(classes)) if classes else ("", tag), []).append((key, said))
    todo = [root]
    while todo:
        node = todo.pop()
        todo += [c for c in node.children if isinstance(c, Node)]
        own, ids = frozenset(node.attributes.get("class", "").lower().split()), frozenset(node.attributes.get("id", "").lower().split())
        best: dict[str, tuple] = {}
        for kind in (("", node.tag), ("", "*"), *((".", c) for c in own), *(("#", i) for i in ids)):
            for (tag, classes, wanted), said in by.get(kind, ()):
                if tag in ("*", node.tag) and classes <= own and wanted <= ids:
                    for name, (weight, place, value, important) in said.items():
                        best[name] = max(best.get(name, (False,)), (important, weight, place, value))
        for name, (important, _, _, value) in best.items():
            if important or name not in node.looks:
                node.looks[name] = value


class Scanner:
    """Reads tags from left to right, every character a bounded number of times."""

    def __init__(self, html: str):
        self.html, self.over = html, set()  # quotes of which none is left

    def attributes(self, at: int) -> tuple[dict, int]:
        """The attributes of a tag from behind its name, and the place behind the tag; -1 where the page ends within it."""
        html, out = self.html, {}
        end = len(html)
        while True:
            at = BETWEEN.match(html, at).end()
            if at >= end:
                return out, -1
            if html[at] == ">":
                return out, at + 1
            m = NAME.match(html, at)
            name, at, value = m.group().lower(), m.end(), ""
            if m := EQUALS.match(html, at):
                at = m.end()
                quote, to = html[at : at + 1], -1
                if quote in ('"', "'") and quote not in self.over:
                    to = html.find(quote, at + 1)
                    if to < 0:
                        self.over.add(quote)
                if to >= 0:
                    value, at = html[at + 1 : to], to + 1
                else:  # no quote ends it
                    m = BARE.match(html, at)
                    value, at = m.group(), m.end()
            out.setdefault(name, unescape(value) if "&" in value else value)


def build(html: str) -> Node:
    """The tree of a page."""
    root = Node("html", {})
    stack = [root]
    sheets: list[str] = []
    places: dict[str, list[int]] = {}  # of the open elements by tag, so that deep nesting needs no search

    def innermost(tags) -> int:
        return max((p[-1] for t in tags if (p := places.get(t))), default=0)

    def pop() -> None:
        places[stack.pop().tag].pop()

    def close(names, barrier) -> None:
        k = innermost(names)
        if k and (k >= innermost(barrier)):
            while len(stack) > k:
                pop()

    at, end = 0, len(html)
    scan = Scanner(html)
    while at < end:
        lt = html.find("<", at)
        if lt < 0:
            stack[-1].children.append(unescape(html[at:]))
            break
        closing = html.startswith("</", lt)
        m = TAG.match(html, lt + 1 + closing)
        if m is None:
            if html.startswith("<!--", lt):
                to = html.find("-->", lt + 4) if not html.startswith(("<!-->", "<!--->"), lt) else html.index(">", lt) - 2
                to, kept = (to + 3 if to >= 0 else end), ""
            elif html.startswith("<![CDATA[", lt):
                to = html.find("]]>", lt)
                kept = html[lt + 9 : to if to >= 0 else end]
                to = to + 3 if to >= 0 else end
            elif html.startswith(("<!", "<?", "</"), lt):
                to, kept = html.find(">", lt) + 1 or end, ""
            else:
                to, kept = lt + 1, "<"
            if lt > at:
                stack[-1].children.append(unescape(html[at:lt]))
            if kept:
                stack[-1].children.append(kept)
            at = to
            continue
        tag = m.group()
        attributes, to = ({}, m.end() + 1) if html.startswith(">", m.end()) else scan.attributes(m.end())
        if to < 0:  # the page ends within a tag, which is read as text
            stack[-1].children.append(unescape(html[at:]))
            break
        if lt > at:
            stack[-1].children.append(unescape(html[at:lt]))
        at = to
        tag = tag.lower()
        if closing:
            if tag == "br":
                stack[-1].children.append(Node("br", {}))
            elif tag in HEADINGS:
                close(HEADINGS, SCOPE)
            elif tag == "p":
                if not places.get("p"):
                    stack[-1].children.append(Node("p", {}))
                close(("p",), SCOPE)
            elif tag not in ("html", "body"):
                close((tag,), SCOPE - {tag} if tag not in ("table", "tr") and tag not in SECTIONS else frozenset(("table",)) - {tag})
            continue
        if tag in ("html", "body"):
            root.attributes = {**attributes, **root.attributes}
            if tag == "body":
                close(("head",), ())
            continue
        if stack[-1].tag == "head" and tag not in HIDDEN:
            pop()
        if tag in ENDS_P:
            close(("p",), SCOPE | {"button", "li", "dd", "dt"} if tag not in ("li", "dd", "dt") else SCOPE)
            if tag in HEADINGS and stack[-1].tag in HEADINGS:
                pop()
        if rule := IMPLIED.get(tag):
            if tag in SECTIONS or tag == "tr":
                close(CELLS, ("table",))
            if tag in SECTIONS:
                close(("tr",), ("table",))
            close(*rule)
        node = Node(tag, attributes)
        stack[-1].children.append(node)
        if tag in RAW:
            stop = RAW[tag].search(html, at)
            node.children.append(html[at : stop.start()] if stop else html[at:])
            if stop:
                at = html.find(">", stop.end()) + 1 or end
            else:
                at = end
            if tag == "style":
                sheets += node.children
            if tag in ("textarea", "title"):
                node.children = [unescape(c) for c in node.children]
        elif tag not in VOID:
            places.setdefault(tag, []).append(len(stack))
            stack.append(node)
    if any("display" in x or "visibility" in x for x in sheets):
        style(root, sheets)
    return root


class Lines:
    """Output under construction: lines, the line being written, empty lines that are due."""

    def __init__(self):
        self.lines: list[str] = []
        self.now, self.space, self.due, self.prefix, self.mark = [], False, 0, "", ""

    def text(self, s: str) -> None:
        if "  " in s or "\n" in s or "\t" in s or "\r" in s or "\f" in s:
            s = SPACE.sub(" ", s)
        if s[:1] == " ":
            self.space = bool(self.now)
            s = s[1:]
        if not s:
            return
        if self.space:
            self.now.append(" ")
        self.space = s[-1] == " "
        self.now.append(s[:-1] if self.space else s)

    def raw(self, s: str) -> None:
        if self.space and self.now:
            self.now.append(" ")
        self.space = False
        self.now.append(s)

    def flush(self) -> None:
        if self.now:
            line = "".join(self.now).rstrip(" ")
            if self.due and self.lines:
                self.lines.extend([""] * self.due)
            self.due = 0
            head = self.prefix
            if self.mark:
                head, self.mark = head[: len(head) - len(self.mark)] + self.mark, ""
            self.lines.append((head + line).rstrip(" "))
        self.now, self.space = [], False

    def block(self, empty: int) -> None:
        self.flush()
        self.due = max(self.due, empty)


def _run(step):
    """The result of a rendering step. A step is a generator that yields the steps it needs done, and gets their results."""
    stack, result = [step], None
    while stack:
        try:
            stack.append(stack[-1].send(result))
            result = None
        except StopIteration as done:
            stack.pop()
            result = done.value
    return result


def _flat(node: Node, seen: bool):
    """A cell's text on one line (a step)."""
    out = Lines()
    yield _render(node, out, seen, False, 0, inner=True)
    out.flush()
    return SPACE.sub(" ", " ".join(x.strip() for x in out.lines if x)).strip()


def _span(value: str | None, most: int) -> int:
    """A span as the standard reads it, which has the same bounds; 0 rows mean all that follow."""
    m = NUMBER.match(value) if value else None
    return min(most, int(m.group(1))) if m else 1


def _cell(node: Node, seen: bool):
    return (yield _flat(node, seen)), _span(node.attributes.get("colspan"), 1000) or 1, _span(node.attributes.get("rowspan"), 65_534) or 65_534


def _grid(rows: list[list[tuple[str, int, int]]]) -> list[list[tuple[int, int, str]]]:
    """(first column, columns, text) of the cells of each row; cells that reach down from rows above keep their columns."""
    held: list[list[int]] = []  # [first column, end, first row that is free again], by column
    out = []
    for r, row in enumerate(rows):
        held, at, k, cells, new = [h for h in held if h[2] > r], 0, 0, [], []
        for text, across, down in row:
            while k < len(held) and held[k][0] <= at:
                at = max(at, held[k][1])
                k += 1
            cells.append((at, across, text))
            if down > 1:
                new.append([at, at + across, r + down])
            at += across
        if new:
            merged: list[list[int]] = []
            for h in sorted(held + new):
                if merged and merged[-1][1] == h[0] and merged[-1][2] == h[2]:
                    merged[-1][1] = h[1]
                else:
                    merged.append(h)
            held = merged
        out.append(cells)
    return out


def _table(node: Node, out: Lines, seen: bool):
    rows: list[list[tuple[str, int, int]]] = []

    def walk(n: Node, seen: bool):
        row = None
        for c in n.children:
            if isinstance(c, str):
                if seen and c.strip():
                    out.text(c)
                continue
            if gone(c):
                continue
            sight = visible(c, seen)
            if c.tag in CELLS:
                if row is None:
                    rows.append(row := [])
                row.append((yield _cell(c, sight)))
            elif c.tag == "tr":
                rows.append(cells := [])
                for d in c.children:
                    if isinstance(d, Node) and d.tag in CELLS and not gone(d):
                        cells.append((yield _cell(d, visible(d, sight))))
                loose = [d for d in c.children if not (isinstance(d, Node) and d.tag in CELLS)]
                if any(not isinstance(d, str) or d.strip() for d in loose):
                    rest = Node("span", {})
                    rest.children = loose
                    if said := (yield _flat(rest, sight)):
                        cells.append((said, 1, 1))
            elif c.tag in SECTIONS:
                yield walk(c, sight)
            elif c.tag == "caption":
                out.block(0)
                yield _children(c, out, sight, False, 0, False)
                out.block(0)
            elif c.tag != "colgroup":
                yield _render(c, out, sight, False, 0)
                out.block(0)

    yield walk(node, seen)
    out.block(0)
    grid = _grid(rows)
    columns = sorted({at for r in grid for at, _, _ in r})  # those in which a cell begins; others are as wide as nothing
    width = [0] * len(columns)
    for r in grid:
        for at, across, text in r:
            k = bisect_left(columns, at)
            if len(text) <= PAD and (k + 1 == len(columns) or columns[k + 1] >= at + across):
                width[k] = max(width[k], len(text))
    begins = [0, *accumulate(w + 2 for w in width)]
    for r in grid:
        if any(text for *_, text in r):
            line, long = [], 0
            for at, _, text in r:
                blank = max(begins[bisect_left(columns, at)] - long, 2 if line else 0)
                line += [" " * blank, text]
                long += blank + len(text)
            out.now.append("".join(line))
            out.flush()


def gone(node: Node) -> bool:
    """Not rendered, children included."""
    if node.tag in HIDDEN:
        return True
    a = node.attributes
    if not a:
        return node.tag == "dialog" or node.looks.get("display") == "none"
    return "hidden" in a and a["hidden"].lower() != "until-found" or node.looks.get("display") == "none" or node.tag == "input" and a.get("type", "").lower() == "hidden" or node.tag == "dialog" and "open" not in a


def visible(node: Node, before: bool) -> bool:
    if not node.looks:
        return before
    said = node.looks.get("visibility")
    return False if said in ("hidden", "collapse") else True if said == "visible" else before


def _children(node: Node, out: Lines, seen: bool, pre: bool, depth: int, inner: bool):
    for c in node.children:
        if isinstance(c, Node):
            yield _render(c, out, seen, pre, depth, inner)
        elif seen:
            if not pre:
                out.text(c)
            else:
                first, *rest = c.replace("\r\n", "\n").split("\n")
                out.raw(first)
                for line in rest:
                    if not out.now:
                        out.now.append("")
                    out.flush()
                    out.raw(line)


def _render(node: Node, out: Lines, seen: bool, pre: bool, depth: int, inner: bool = False):
    if gone(node):
        return
    tag, a = node.tag, node.attributes
    seen = visible(node, seen)
    if tag == "br":
        if seen:
            if not out.now:
                out.now.append("")
            out.flush()
        return
    if tag == "wbr":
        return
    if tag == "img":
        if seen and a.get("alt"):
            out.text(a["alt"])
        return
    if tag == "input":
        if seen and a.get("type", "text").lower() not in ("checkbox", "radio", "password", "file", "image", "range", "color") and a.get("value"):
            out.text(a["value"])
        return
    if tag == "hr":
        out.block(1)
        return
    empty = 1 if tag in PARAGRAPHS else 0
    if tag in ("ul", "ol", "menu"):
        out.block(1 if depth == 0 else 0)
        items = [c for c in node.children if isinstance(c, Node) and c.tag == "li" and not gone(c)]
        step = -1 if "reversed" in a else 1
        start = a.get("start", "").strip()
        number = int(start) if re.fullmatch(r"-?\d{1,9}", start) else len(items) if step < 0 else 1
        indent = out.prefix
        for c in node.children:
            if isinstance(c, str):
                if seen:
                    out.text(c)
                continue
            if c.tag != "li":
                yield _render(c, out, seen, pre, depth + 1, inner)
                continue
            if gone(c):
                continue
            if tag == "ol":
                value = c.attributes.get("value", "").strip()
                number = int(value) if re.fullmatch(r"-?\d{1,9}", value) else number
                mark, number = f"{number}. ", number + step
            else:
                mark = "- "
            out.block(0)
            out.prefix, out.mark = (indent + " " * len(mark))[:INDENT], mark
            yield _children(c, out, visible(c, seen), pre, depth + 1, inner)
            out.block(0)
            out.prefix, out.mark = indent, ""
        out.block(1 if depth == 0 else 0)
        return
    if tag in BLOCKS:
        out.block(empty if depth == 0 or tag not in ("p",) else 0)
        if tag == "table" and not inner:
            yield _table(node, out, seen)
        elif tag == "details" and "open" not in a:
            for c in node.children:
                if isinstance(c, Node) and c.tag == "summary":
                    yield _render(c, out, seen, pre, depth, inner)
                    break
        elif tag in ("blockquote", "dd"):
            before, out.prefix = out.prefix, (out.prefix + "    ")[:INDENT]
            yield _children(node, out, seen, pre, depth, inner)
            out.flush()
            out.prefix = before
        else:
            yield _children(node, out, seen, pre or tag == "pre", depth, inner)
        out.block(empty if depth == 0 or tag not in ("p",) else 0)
        return
    if tag in CELLS:
        if inner:
            out.block(0)
        yield _children(node, out, seen, pre, depth, inner)
        if inner:
            out.block(0)
        else:
            out.text(" ")
        return
    yield _children(node, out, seen, pre or tag in ("textarea", "xmp"), depth, inner)


def extract(html: str | None) -> str | None:
    """The visible text of a page."""
    if html is None:
        return None
    out = Lines()
    _run(_render(build(html), out, True, False, 0))
    out.flush()
    return re.sub(r"\n{3,}", "\n\n", "\n".join(out.lines)).strip("\n")


def extracted(pages: DataFrame) -> DataFrame:
    """page_id and text for every row of pages."""

    def run(batches):
        for b in pieces(batches, 1):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([extract(h) for h in b.column(1).to_pylist()], pa.string())], names=["page_id", "text"])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("html").cast("string").alias("html")).mapInArrow(run, "page_id long, text string")
