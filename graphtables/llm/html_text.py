"""Layout-aware rendering of HTML to text.

A small tree builder (implied end tags, void and raw-text elements, stray end tags) makes the page's tree; visibility rules drop what
a browser would not paint: elements that are never drawn, the hidden attribute, and display and visibility of style attributes and of
the page's own style elements (rules of single compound selectors of names, ids and classes, by specificity; rules inside of @media and
the like and those of other selectors hide nothing). The rest is laid out: paragraphs and headings between blank lines, other blocks on
lines of their own, list items with their marks, preformatted text as it is, table cells aligned in columns, also beside spanning ones.
All visible text is emitted, whole; only blanks are bounded: of indents (DEEPEST levels) and of columns (WIDEST characters).

One map over the table, one page at a time; no recursion, so deep nesting costs no stack."""

from __future__ import annotations

import html
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import arrow_map, slices

# Element classes of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style xmp iframe noembed noframes".split())
ESCAPABLE_RAW = frozenset("textarea title".split())
UNSEEN = frozenset("head script style template noscript title iframe noembed noframes object audio video canvas datalist meter progress".split())
#: What svg and math elements hold without painting it.
UNSEEN_DRAWN = frozenset("title desc metadata defs annotation annotation-xml".split())
#: Drawn apart from what stands beside them, on the same line.
APART = frozenset("td th text mtd".split())
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl pre blockquote figure table menu fieldset".split())
BLOCK = SPACED | frozenset("html body div section article aside header footer nav main address li dt dd form hr figcaption center details summary legend caption tr thead tbody tfoot dialog search hgroup option optgroup select".split())
#: An opening tag closes these open elements, unless one of the limits stands between.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th", "caption"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "thead": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption"}, {"table"}), "tbody": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption"}, {"table"}), "option": ({"option"}, {"select", "datalist"}), "optgroup": ({"option", "optgroup"}, {"select"}),
    "body": ({"head"}, set()),
}
P_ENDS = BLOCK - {"html", "body", "li", "dt", "dd", "tr", "thead", "tbody", "tfoot", "caption", "option", "optgroup", "select", "legend"} | {"li", "dt", "dd"}
SCOPE = frozenset("table td th caption button object html".split())
IN_HEAD = frozenset("base link meta script style template title noscript".split())

_TAG = re.compile(r"<(?:!--(?P<comment>.*?)(?:--!?>|\Z)|(?P<end>/)?(?P<name>[a-zA-Z][^\s/>]*+)(?P<rest>(?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?+)*+)>|[!?/][^>]*+(?:>|\Z))", re.S)
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?")
_DECLARED = re.compile(r"(?:^|;)\s*(display|visibility)\s*:\s*([a-zA-Z-]+)([^;]*)", re.I)
_STYLE = re.compile(r"<style\b[^>]*>(.*?)(?:</style|\Z)", re.I | re.S)
_COMPOUND = re.compile(r"(?:\*|([a-z][\w-]*))?((?:[.#][\w-]+)*)", re.I)
_BLANK = re.compile(r"[ \t\n\r\f]+")
#: Widest column that is filled up with blanks.
WIDEST = 48


class Node:
    __slots__ = ("across", "children", "down", "hidden", "name", "seen", "start")

    def __init__(self, name: str, hidden: bool = False, start: int = 1, seen: bool | None = None, across: int = 1, down: int = 1):
        self.name, self.hidden, self.start, self.children = name, hidden, start, []
        self.seen, self.across, self.down = seen, across, down  # seen: own visibility, then that which holds; cells' spans


def _declared(style: str) -> list[tuple[bool, str, str]]:
    """(important, property, value) of display and visibility, in order."""
    return [(True if "!" in rest and "important" in rest.lower() else False, name.lower(), value.lower()) for name, value, rest in _DECLARED.findall(style)]


def hiding_rules(page: str) -> list[tuple]:
    """(name, id, classes, specificity, order, declarations) of the rules of the page's style elements that may hide something."""
    rules = []
    for css in _STYLE.findall(page):
        low = css.lower()
        if "none" not in low and "visibility" not in low:
            continue
        css = re.sub(r"/\*.*?(?:\*/|\Z)", " ", css, flags=re.S).replace("<!--", " ").replace("-->", " ")
        at = 0
        while (brace := css.find("{", at)) >= 0:
            head = css[at:brace].rpartition(";")[2].strip()
            if head.startswith("@"):  # its whole block goes
                depth, at = 1, brace + 1
                while depth and at < len(css):
                    m = re.compile(r"[{}]").search(css, at)
                    if m is None:
                        at = len(css)
                        break
                    depth += 1 if m[0] == "{" else -1
                    at = m.end()
                continue
            end = css.find("}", brace)
            end = len(css) if end < 0 else end
            found = _declared(css[brace + 1 : end])
            at = end + 1
            for selector in head.split(",") if found else ():
                m = _COMPOUND.fullmatch(selector.strip())
                if m is None or not selector.strip():
                    continue
                marks = re.findall(r"[.#][\w-]+", m[2])
                ids, classes = {x[1:] for x in marks if x[0] == "#"}, frozenset(x[1:] for x in marks if x[0] == ".")
                if len(ids) < 2:
                    rules.append(((m[1] or "").lower(), next(iter(ids), ""), classes, (len(ids), len(classes), int(bool(m[1]))), len(rules), found))
    return rules


def _attributes(rest: str, of: str, rules: list[tuple]) -> tuple[bool, int, bool | None, int, int]:
    """Whether the element is hidden, where a list's numbers start, its own visibility, and its spans."""
    low = rest.lower()
    if not rules and not any(x in low for x in ("hid", "none", "collapse", "start", "visib", "span", "display")):
        return False, 1, None, 1, 1
    hidden, start, seen, across, down, own, ident, classes = False, 1, None, 1, 1, "", "", frozenset()
    for name, value in reversed(_ATTRIBUTE.findall(rest)):  # the first of a name counts
        name, value = name.lower(), html.unescape(value.strip("\"'"))
        if name == "hidden":
            hidden = value.lower() != "until-found"
        elif name == "style":
            own = value
        elif of == "input" and name == "type":
            hidden |= value.lower() == "hidden"
        elif name == "start" and re.fullmatch(r"[+-]?[0-9]{1,9}", value):
            start = int(value)
        elif name == "colspan" and re.fullmatch(r"[0-9]{1,4}", value):
            across = min(max(1, int(value)), 1000)
        elif name == "rowspan" and re.fullmatch(r"[0-9]{1,5}", value):
            down = min(int(value), 65534)
        elif name == "id":
            ident = value
        elif name == "class":
            classes = frozenset(value.split())
    found = [((x[0], 1, (0, 0, 0), i), x[1:]) for i, x in enumerate(_declared(own))] if own else []
    for name, want, needs, specificity, order, declared in rules:
        if (not name or name == of) and (not want or want == ident) and needs <= classes:
            found += [((x[0], 0, specificity, order), x[1:]) for x in declared]
    for _, (what, value) in sorted(found, key=lambda x: x[0]):
        if what == "display":
            hidden = value == "none"
        elif value in ("visible", "hidden", "collapse"):
            seen = value == "visible"
    return hidden, start, seen, across, down


def parse(page: str) -> tuple[Node, list[Node]]:
    """The page's tree, and its tables in the order of their opening tags."""
    root = Node("html")
    stack, tables = [root], []
    rules = hiding_rules(page)
    veiled = False  # something has a visibility of its own
    open_names = {"html": 1}

    def pop_to(i: int) -> None:
        for x in stack[i:]:
            open_names[x.name] -= 1
        del stack[i:]

    def close(names, limits) -> None:
        """Close down to the outermost of ``names`` that is open inside the limits."""
        if not any(open_names.get(x) for x in names):
            return
        found = 0
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].name in names:
                found = i
            elif stack[i].name in limits:
                break
        if found:
            pop_to(found)

    at, n = 0, len(page)
    while at < n:
        tag = page.find("<", at)
        if tag < 0:
            stack[-1].children.append(html.unescape(page[at:]))
            break
        m = _TAG.match(page, tag)
        if tag > at:
            text = page[at:tag]
            if open_names.get("head") and stack[-1].name == "head" and text.strip():
                pop_to(len(stack) - 1)
            stack[-1].children.append(html.unescape(text))
        if m is None:
            stack[-1].children.append("<")
            at = tag + 1
            continue
        at = m.end()
        name = m["name"]
        if name is None:
            continue
        name = name.lower()
        if m["end"]:
            if name == "br":
                stack[-1].children.append(Node("br"))
            elif name == "p" and not open_names.get("p"):
                stack[-1].children.append(Node("p"))
            elif open_names.get(name) and name not in ("html", "body"):
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i].name == name:
                        pop_to(i)
                        break
                    if stack[i].name in SCOPE and name not in SCOPE | {"tr", "thead", "tbody", "tfoot"}:
                        break
            continue
        hidden, start, seen, across, down = _attributes(m["rest"], name, rules)
        veiled |= seen is not None
        if name in ("html", "body"):
            close({"head"}, set())
            if name == "html":
                root.hidden |= hidden
                root.seen = seen if seen is not None else root.seen
            if name == "body" and not open_names.get("body"):
                node = Node("body", hidden, seen=seen)
                stack[-1].children.append(node)
                stack.append(node)
                open_names["body"] = 1
            continue
        if stack[-1].name == "head" and name not in IN_HEAD:
            pop_to(len(stack) - 1)
        if name in P_ENDS and open_names.get("p"):
            close({"p"}, SCOPE)
        if name in CLOSES:
            close(*CLOSES[name])
        if name[0] == "h" and name[1:] in "123456" and stack[-1].name[0] == "h" and stack[-1].name[1:] in set("123456"):
            pop_to(len(stack) - 1)
        drawn = open_names.get("svg") or open_names.get("math")
        node = Node(name, hidden or name in UNSEEN or bool(drawn) and name in UNSEEN_DRAWN, start, seen, across, down)
        stack[-1].children.append(node)
        empty = bool(drawn) and m["rest"].endswith("/")
        if (name in RAW or name in ESCAPABLE_RAW) and not empty:
            end = re.compile(rf"</{name}(?=[\s/>])", re.I).search(page, at)
            stop = end.start() if end else n
            node.children.append(html.unescape(page[at:stop]) if name in ESCAPABLE_RAW else page[at:stop])
            close_at = page.find(">", stop) if end else n
            at = n if close_at < 0 else close_at + 1
        elif name not in VOID and not empty:
            if name == "table":
                tables.append(node)
            stack.append(node)
            open_names[name] = open_names.get(name, 0) + 1
    if veiled:  # visibility comes from the nearest element that has one
        todo = [(root, True)]
        while todo:
            x, above = todo.pop()
            x.seen = above if x.seen is None else x.seen
            todo.extend((c, x.seen) for c in x.children if not isinstance(c, str))
    return root, tables


class Page:
    """Lines as they are laid out: text flows, blocks end a line, spaced blocks leave a blank line."""

    def __init__(self):
        self.lines: list[str] = []
        self.flow: list[str] = []
        self.gap = 0  # blank lines owed before the next text
        self.mark = ""  # an item's mark, before its first text
        self.indent = 0

    def line(self, blank: int = 0) -> None:
        text = _BLANK.sub(" ", "".join(self.flow)).strip(" ")
        self.flow.clear()
        if text:
            self.emit([text])
        self.gap = max(self.gap, blank)

    def emit(self, lines: list[str]) -> None:
        if self.gap and self.lines:
            self.lines.extend([""] * self.gap)
        self.gap = 0
        pad = "  " * self.indent
        for x in lines:
            if self.mark:
                x, self.mark = pad[: -2 or None] + self.mark + x, ""
            elif x:
                x = pad + x
            self.lines.append(x.rstrip())


#: Most levels that are indented.
DEEPEST = 12


def layout(root: Node, drawn: dict[int, list[str]]) -> list[str]:
    """The lines of a tree; ``drawn``: the lines of tables inside it, by identity."""
    page = Page()
    lists: list[list] = []  # [kind, next number]
    pre = 0
    todo: list[tuple] = [("open", root)]
    while todo:
        what, x = todo.pop()
        if what == "text":
            page.flow.append(x)
            continue
        name = x.name
        if what == "open":
            if x.hidden:
                continue
            if id(x) in drawn and x is not root:
                page.line(1)
                if drawn[id(x)]:
                    page.emit(drawn[id(x)])
                page.line(1)
                continue
            if name == "br":
                if pre:
                    page.flow.append("\n")
                elif "".join(page.flow).strip():
                    page.line()
                else:
                    page.flow.clear()
                    page.gap += 1
                continue
            if name == "pre":
                page.line(1)
                pre += 1
            elif name in ("ul", "ol", "menu"):
                page.line(0 if lists else 1)
                lists.append([name, x.start])
            elif name == "li":
                page.line()
                kind = lists[-1] if lists else ["ul", 1]
                page.mark = "" if x.seen is False else f"{kind[1]}. " if kind[0] == "ol" else "- "
                kind[1] += 1
                page.indent = min(max(1, len(lists)), DEEPEST)
            elif name == "dd":
                page.line()
                page.indent = min(page.indent + 1, DEEPEST)
            elif name in BLOCK:
                page.line(1 if name in SPACED and not (page.mark and not page.flow) else 0)
            elif name in APART:
                page.flow.append(" ")
            todo.append(("close", x))
            todo.extend(("text", c) if isinstance(c, str) else ("open", c) for c in reversed(x.children) if x.seen is not False or not isinstance(c, str))
            continue
        if name == "pre":
            pre -= 1
            text = "".join(page.flow).removeprefix("\n")
            page.flow.clear()
            if text.strip():
                page.emit(text.rstrip().split("\n"))
            page.line(1)
        elif name in ("ul", "ol", "menu"):
            page.line()
            lists.pop()
            page.indent = min(len(lists), DEEPEST)
            page.mark = ""
            page.line(0 if lists else 1)
        elif name == "li":
            page.line()
            page.mark = ""
            page.gap = 0
            page.indent = min(max(0, len(lists)), DEEPEST)
        elif name == "dd":
            page.line()
            page.indent = max(0, page.indent - 1)
        elif name in BLOCK:
            page.line(1 if name in SPACED else 0)
        elif name in APART:
            page.flow.append(" ")
    page.line()
    return page.lines


def _draw(table: Node, drawn: dict[int, list[str]]) -> list[str]:
    """A table's caption, then its rows, cells of a column beginning at the same place; a spanning cell keeps its columns and rows."""
    captions, rows, loose = [], [], []
    reached: dict[int, float] = {}  # of columns that cells of earlier rows reach into: how many more rows
    queue = list(reversed(table.children))

    def add(cells: list[Node]) -> None:
        row, column = [], 0
        for column in [c for c, n in reached.items() if n <= 0]:
            del reached[column]
        column, fresh = 0, {}
        for cell in cells:
            while column in reached:
                column += 1
            row.append((column, cell.across, layout(cell, drawn)))
            if cell.down != 1:
                fresh |= dict.fromkeys(range(column, column + cell.across), cell.down - 1 if cell.down else float("inf"))
            column += cell.across
        for c in reached:
            reached[c] -= 1
        reached.update(fresh)
        rows.append(row)

    while queue:
        x = queue.pop()
        if isinstance(x, str):
            if x.strip() and table.seen is not False:
                loose.append(x)
        elif x.hidden:
            continue
        elif x.name in ("thead", "tbody", "tfoot", "colgroup"):
            reached.clear()
            queue.extend(reversed([c for c in x.children if not isinstance(c, str) or x.seen is not False]))
        elif x.name == "caption":
            captions.extend(layout(x, drawn))
        elif x.name == "tr":
            add([c for c in x.children if not isinstance(c, str) and not c.hidden and c.name in ("td", "th")])
            loose.extend(c for c in x.children if isinstance(c, str) and c.strip() and x.seen is not False or not isinstance(c, str) and c.name not in ("td", "th"))
        elif x.name in ("td", "th"):
            add([x])
        else:
            loose.append(x)
    widths: dict[int, int] = {}
    for spanning in (False, True):  # what spans widens the last of its columns
        for row in rows:
            for column, across, cell in row:
                if (across > 1) == spanning:
                    own = max((len(x) for x in cell if len(x) <= WIDEST), default=0)
                    others = sum(widths.get(c, 0) + 2 for c in range(column, column + across - 1))
                    last = column + across - 1
                    widths[last] = max(widths.get(last, 0), min(own - others, WIDEST))
    places, at = [], 0
    for column in range(max(widths, default=-1) + 1):
        places.append(at)
        at += widths.get(column, 0) + 2
    lines = captions
    if loose:  # what stands between the cells is painted before the table
        before = Node("div")
        before.children = loose
        lines = layout(before, drawn) + lines
    for row in rows:
        for k in range(max((len(x[2]) for x in row), default=0)):
            line = ""
            for column, _, cell in row:
                if k < len(cell) and cell[k]:
                    line = (line.ljust(places[column] - 2) + "  " if column else line) + cell[k]
            lines.append(line.rstrip())
    return lines


def render(page: str | None) -> str:
    """All visible text of a page. Null, empty and textless pages give the empty text; no input is an error, however long or deep."""
    if not page:
        return ""
    root, tables = parse(page)
    drawn: dict[int, list[str]] = {}
    for table in reversed(tables):  # inner tables open later
        drawn[id(table)] = _draw(table, drawn)
    return "\n".join(layout(root, drawn))


def extract(pages: DataFrame, column: str = "html", out: str = "text") -> DataFrame:
    """``pages`` with the visible text of each whole page in place of ``column``; other columns stay, but for one of the name ``out``.

    Null pages give the empty text, as empty ones do; repeated rows each keep theirs; an empty table gives no rows."""
    kept = [f for f in pages.schema.fields if f.name not in (column, out)]
    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in kept)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[dict]:
        for whole in batches:
            for batch in slices(whole, column, most_bytes=4 << 20):
                yield {f.name: batch.column(f.name) for f in kept} | {out: [render(x) for x in batch.column(column).to_pylist()]}

    return arrow_map(pages, run, f"{fields}`{out}` string")
