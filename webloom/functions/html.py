"""HTML as a small tree on the standard library's tokeniser: cleaning, tables, links."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from html.parser import HTMLParser

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from webloom.functions import urls
from webloom.functions.text import WHITESPACE

#: Elements that hold no readable text, and elements after which a line ends.
REMOVED = frozenset("script style noscript template svg canvas iframe audio video picture object embed nav header footer aside".split())
BLOCKS = frozenset(
    "address article blockquote dd div dl dt figcaption figure h1 h2 h3 h4 h5 h6 li main ol p pre section table tbody td tfoot th thead tr ul".split()
)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_CLOSES_P = frozenset(
    "address article aside blockquote center details dialog dir div dl dd dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre section summary table ul".split()
)
#: Fixed values of the HTML standard: formatting elements, bounds of a scope, elements with rules of their own, parts of tables and their depth.
_FORMATTING = frozenset("a b big code em font i nobr s small strike strong tt u".split())
_SCOPES = frozenset("applet caption html marquee object table td template th".split())
_SPECIAL = frozenset(
    "address applet area article aside base basefont bgsound blockquote body br button caption center col colgroup dd details dir div dl dt embed fieldset figcaption figure footer form frame frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html iframe img input keygen li link listing main marquee menu meta nav noembed noframes noscript object ol p param plaintext pre script search section select source style summary table tbody td template textarea tfoot th thead title tr track ul wbr xmp".split()
)
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_MARKED = frozenset("applet caption marquee object td template th".split())
_PART_LEVEL = {"caption": 1, "colgroup": 1, "tbody": 1, "thead": 1, "tfoot": 1, "col": 2, "tr": 2, "td": 3, "th": 3}
_PARTS = frozenset({"table", "template", *_PART_LEVEL} - {"col"})
_STRUCTURE = frozenset("table tbody thead tfoot tr".split())
_BETWEEN = _STRUCTURE | {"colgroup"}
#: An item of a list closes the one before it.
_LISTED = {"li": frozenset({"li"}), "dd": frozenset({"dd", "dt"}), "dt": frozenset({"dd", "dt"})}
_HEAD_ONLY = frozenset("title meta base link style script noscript template".split())
_RAW = frozenset("title style script textarea".split())

MAX_TABLES, MAX_ROWS, MAX_CELLS, MAX_CELL = 20, 200, 30, 1000
_SPACE = re.compile(f"[{WHITESPACE}]+")
_INLINE = re.compile(f"[{WHITESPACE.replace(chr(10), '')}]+")


@dataclass(eq=False)
class Node:
    tag: str
    attributes: dict[str, str | None] = field(default_factory=dict)
    parent: Node | None = None
    children: list = field(default_factory=list)
    is_open: bool = False

    def walk(self):
        """Elements below this one, in document order."""
        stack = [c for c in reversed(self.children) if isinstance(c, Node)]
        while stack:
            node = stack.pop()
            yield node
            stack += [c for c in reversed(node.children) if isinstance(c, Node)]

    def first(self, tag: str) -> Node | None:
        return next((n for n in self.walk() if n.tag == tag), None)

    def text(self) -> str:
        out, stack = [], [self]
        while stack:
            x = stack.pop()
            if isinstance(x, str):
                out.append(x)
            else:
                stack += reversed(x.children)
        return "".join(out)

    def closest(self, tag: str) -> Node | None:
        node = self
        while node is not None and node.tag != tag:
            node = node.parent
        return node


class _Builder(HTMLParser):
    """Builds the tree of a page, wrong nesting and content misplaced in tables included.

    ``tags`` counts the open elements by tag, so that a look for one that is not open costs nothing however deep the page
    is; ``parts`` holds the places of the open parts of tables. ``formatting`` lists the formatting elements that apply to
    what follows, with None where a cell, caption or object began. As the standard has it, formatting that is never closed
    is rebuilt in each block after it, three times at most for equal elements.
    """

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("#document")
        self.open = [self.root]
        self.tags: Counter[str] = Counter()
        self.parts: list[int] = []
        self.formatting: list[Node | None] = []
        self.html = self.body = None
        self.quirks = True

    # the open elements

    def _place(self) -> tuple[Node, int | None]:
        """Where the next node goes: the current element, or what is before the table if that holds no such content itself."""
        return self._outside() if self.open[-1].tag in _STRUCTURE else (self.open[-1], None)

    def _outside(self) -> tuple[Node, int | None]:
        at = next(i for i in reversed(self.parts) if self.open[i].tag in ("table", "template"))
        table = self.open[at]
        if table.tag == "template":
            return table, None
        if table.parent is None:
            return self.open[at - 1], None
        return table.parent, _index(table.parent.children, table)

    def _push(self, tag: str, attributes: dict | None = None, inside: bool = False) -> Node:
        """Open an element; ``inside`` for parts of tables, which are never put before the table."""
        parent, before = (self.open[-1], None) if inside else self._place()
        node = Node(tag, attributes or {}, parent)
        parent.children.insert(len(parent.children) if before is None else before, node)
        self._enter(len(self.open), node)
        if tag == "html":
            self.html = self.html or node
        elif tag == "body":
            self.body = self.body or node
        if tag in _MARKED:
            self.formatting.append(None)
        return node

    def _enter(self, at: int, node: Node) -> None:
        if node.tag in _PARTS:
            self.parts.append(at)
        self.open.insert(at, node)
        node.is_open = True
        self.tags[node.tag] += 1

    def _leave(self, at: int) -> None:
        """Take one element, no part of a table, out of the open ones."""
        node = self.open.pop(at)
        node.is_open = False
        self.tags[node.tag] -= 1
        self.parts = [i - (i > at) for i in self.parts]

    def _close(self, at: int) -> None:
        """Close the open elements from the given one on."""
        for node in self.open[at:]:
            node.is_open = False
            self.tags[node.tag] -= 1
            if node.tag in _MARKED:
                while self.formatting and self.formatting.pop() is not None:
                    pass
        del self.open[at:]
        while self.parts and self.parts[-1] >= at:
            self.parts.pop()

    def _find(self, tags: set[str] | frozenset[str], bounds: set[str] | frozenset[str]) -> int | None:
        if not any(self.tags[t] for t in tags):
            return None
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag in tags:
                return i
            if self.open[i].tag in bounds:
                return None
        return None

    def _close_found(self, tags: set[str] | frozenset[str], bounds: set[str] | frozenset[str] = frozenset()) -> bool:
        at = self._find(tags, bounds or _SCOPES)
        if at is not None:
            self._close(at)
        return at is not None

    def _part(self) -> str | None:
        """The innermost open part of a table."""
        return self.open[self.parts[-1]].tag if self.parts else None

    # head and body

    def _leave_head(self) -> None:
        if self.tags["head"]:
            self._close(next(i for i, n in enumerate(self.open) if n.tag == "head"))

    def _ensure_body(self) -> None:
        if not (self.tags["body"] or self.tags["head"] or self.tags["frameset"]):
            if not self.tags["html"]:
                self._push("html")
            self._push("body")

    def _frame(self, tag: str, attributes: dict) -> None:
        """One html, one body, and a head before it."""
        known = {"html": self.html, "head": self.body, "body": self.body}[tag]
        if known is not None:
            return
        if tag == "body":
            self._leave_head()
        if tag != "html" and not self.tags["html"]:
            self._push("html")
        self._push(tag, attributes)

    # formatting

    def _apply_formatting(self) -> None:
        """Open again the formatting elements that were closed by something else."""
        first = len(self.formatting)
        while first and (node := self.formatting[first - 1]) is not None and not node.is_open:
            first -= 1
        for i in range(first, len(self.formatting)):
            self.formatting[i] = self._push(self.formatting[i].tag, dict(self.formatting[i].attributes))

    def _add_formatting(self, node: Node) -> None:
        equal = []
        for i in range(len(self.formatting) - 1, -1, -1):
            other = self.formatting[i]
            if other is None:
                break
            if other.tag == node.tag and other.attributes == node.attributes:
                equal.append(i)
        if len(equal) >= 3:
            del self.formatting[equal[-1]]
        self.formatting.append(node)

    def _last_formatting(self, tag: str) -> Node | None:
        for node in reversed(self.formatting):
            if node is None:
                return None
            if node.tag == tag:
                return node
        return None

    def _end_formatting(self, tag: str) -> None:
        """The end of a formatting element. A block that was opened inside is moved out of it and gets one of its own."""
        if self.open[-1].tag == tag and self.open[-1] not in self.formatting:
            self._close(len(self.open) - 1)
            return
        for turn in range(8):
            wanted = self._last_formatting(tag)
            if wanted is None:
                if not turn:
                    self._end_other(tag)
                return
            if not wanted.is_open:
                self.formatting.remove(wanted)
                return
            at, block_at = len(self.open) - 1, None
            while self.open[at] is not wanted:
                if self.open[at].tag in _SCOPES:
                    return
                if self.open[at].tag in _SPECIAL:
                    block_at = at
                at -= 1
            if block_at is None:
                self._close(at)
                self.formatting.remove(wanted)
                return
            self._part_block(at, block_at, wanted)

    def _part_block(self, at: int, block_at: int, wanted: Node) -> None:
        block, last = self.open[block_at], self.open[block_at]
        spot = self.formatting.index(wanted)
        seen = 0
        for i in range(block_at - 1, at, -1):
            node, seen = self.open[i], seen + 1
            listed = node in self.formatting
            if listed and seen > 3:
                k = self.formatting.index(node)
                del self.formatting[k]
                spot -= k < spot
                listed = False
            if not listed:
                self._leave(i)
                continue
            copy = Node(node.tag, dict(node.attributes), is_open=True)
            node.is_open = False
            k = self.formatting.index(node)
            self.formatting[k] = self.open[i] = copy
            if last is block:
                spot = k + 1
            _move(last, copy)
            last = copy
        ancestor = self.open[at - 1]
        _detach(last)
        parent, before = self._outside() if ancestor.tag in _STRUCTURE else (ancestor, None)
        parent.children.insert(len(parent.children) if before is None else before, last)
        last.parent = parent
        copy = Node(wanted.tag, dict(wanted.attributes), block, block.children)
        for child in copy.children:
            if isinstance(child, Node):
                child.parent = copy
        block.children = [copy]
        k = self.formatting.index(wanted)
        self.formatting.insert(spot, copy)
        del self.formatting[k + (k >= spot)]
        self._leave(at)
        self._enter(_index(self.open, block) + 1, copy)

    # tokens

    def updatepos(self, i, j):
        """Lines are not counted."""
        return j

    def handle_decl(self, decl):
        if self.html is None and decl.lower().startswith("doctype html"):
            self.quirks = False

    def handle_starttag(self, tag, attrs):
        attributes: dict[str, str | None] = {}
        for name, value in attrs:
            attributes.setdefault(name, "" if value is None else value)
        if tag in ("html", "head", "body"):
            self._frame(tag, attributes)
            return
        if self.tags["head"] and tag not in _HEAD_ONLY:
            self._leave_head()
        if not self.tags["head"] and (tag not in _HEAD_ONLY or self.body is not None):
            self._ensure_body()
        if tag in _PART_LEVEL:
            self._start_part(tag, attributes)
            return
        part = self._part()
        if part == "colgroup":
            self._close(self.parts[-1])
            part = self._part()
        if part in _STRUCTURE and self._start_in_table(tag, attributes):
            return
        self._start_in_body(tag, attributes)

    def _start_part(self, tag: str, attributes: dict) -> None:
        """A part of a table closes those it cannot stand in and brings those that it needs; outside of tables it is nothing."""
        if not self.parts:
            return
        level = _PART_LEVEL[tag]
        while (part := self._part()) not in ("table", "template") and (_PART_LEVEL[part] >= level or part in ("caption", "colgroup")) and (tag, part) != ("col", "colgroup"):
            self._close(self.parts[-1])
        self._close(self.parts[-1] + 1)
        if part == "table":
            for needed in {"tr": ("tbody",), "td": ("tbody", "tr"), "th": ("tbody", "tr"), "col": ("colgroup",)}.get(tag, ()):
                self._push(needed, inside=True)
        elif level == 3 and part in ("tbody", "thead", "tfoot"):
            self._push("tr", inside=True)
        self._push(tag, attributes, inside=True)
        if tag == "col":
            self._close(len(self.open) - 1)

    def _start_in_table(self, tag: str, attributes: dict) -> bool:
        """Whether an element was dealt with that stands between the parts of a table."""
        if tag == "table":
            at = next(i for i in reversed(self.parts) if self.open[i].tag in ("table", "template"))
            self._close(at + (self.open[at].tag == "template"))
            return False
        if tag in ("style", "script", "template"):
            self._push(tag, attributes, inside=True)
            return True
        if tag == "form" or (tag == "input" and (attributes.get("type") or "").lower() == "hidden"):
            if tag == "input" or not self.tags["form"]:
                self._push(tag, attributes, inside=True)
                self._close(len(self.open) - 1)
            return True
        return False

    def _start_in_body(self, tag: str, attributes: dict) -> None:
        if tag == "form" and self.tags["form"]:
            return
        if tag in _LISTED:
            self._close_found(_LISTED[tag], _SPECIAL - _LISTED[tag] - {"address", "div", "p"})
        if tag in _CLOSES_P and not (tag == "table" and self.quirks):
            self._close_found({"p"}, _SCOPES | {"button"})
        if tag in _HEADINGS and self.open[-1].tag in _HEADINGS:
            self._close(len(self.open) - 1)
        if tag in ("a", "nobr") and (before := self._last_formatting(tag)) is not None:
            self._end_formatting(tag)
            if before in self.formatting:
                self.formatting.remove(before)
            if before.is_open and before.tag == "a":
                self._leave(_index(self.open, before))
        elif tag == "button":
            self._close_found({"button"})
        elif tag in ("option", "optgroup") and self.open[-1].tag == "option":
            self._close(len(self.open) - 1)
        if tag not in _CLOSES_P and tag not in _HEAD_ONLY and tag not in ("frameset", "param", "source", "track"):
            self._apply_formatting()
        node = self._push(tag, attributes)
        if tag in _VOID:
            self._close(len(self.open) - 1)
        elif tag in _FORMATTING:
            self._add_formatting(node)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        if tag in ("html", "body"):
            return
        if tag == "br":
            self.handle_starttag("br", [])
        elif tag == "head":
            self._leave_head()
        elif tag in _PARTS:
            at = next((i for i in reversed(self.parts) if self.open[i].tag in (tag, "table", "template")), None)
            if at is not None and self.open[at].tag == tag:
                self._close(at)
        elif tag in _FORMATTING:
            self._end_formatting(tag)
        elif tag == "p":
            if not self._close_found({"p"}, _SCOPES | {"button"}):
                self._ensure_body()
                self._push("p")
                self._close(len(self.open) - 1)
        elif tag in _HEADINGS:
            self._close_found(_HEADINGS)
        elif tag in _LISTED:
            self._close_found({tag}, _SCOPES | ({"ol", "ul"} if tag == "li" else set()))
        elif tag in _SPECIAL:
            self._close_found({tag}, _SCOPES - {tag})
        else:
            self._end_other(tag)

    def _end_other(self, tag: str) -> None:
        at = self._find({tag}, _SPECIAL - {tag})
        if at is not None:
            self._close(at)

    def handle_data(self, data):
        current = self.open[-1].tag
        if current in ("#document", "html", "head"):
            if not data.strip(WHITESPACE):
                return
            self._leave_head()
            self._ensure_body()
        elif current in _RAW:
            self.open[-1].children.append(data)
            return
        if self._part() in _BETWEEN and not data.strip(WHITESPACE):
            self.open[-1].children.append(data)
            return
        if self._part() == "colgroup":
            self._close(self.parts[-1])
        self._apply_formatting()
        parent, before = self._place()
        parent.children.insert(len(parent.children) if before is None else before, data)


def _index(nodes: list, wanted: Node) -> int:
    """Place of a node in a list, looked for from the end."""
    return next(i for i in range(len(nodes) - 1, -1, -1) if nodes[i] is wanted)


def _detach(node: Node) -> None:
    if node.parent is not None:
        del node.parent.children[_index(node.parent.children, node)]


def _move(node: Node, parent: Node) -> None:
    _detach(node)
    parent.children.append(node)
    node.parent = parent


def parse(html: str) -> Node:
    builder = _Builder()
    builder.feed(html or "")
    builder.close()
    return builder.root


def normalize_text(value: str) -> str:
    """Lines trimmed and collapsed, empty ones dropped."""
    value = re.sub(r"\r\n?", "\n", value.replace("\u00a0", " "))
    lines = (_INLINE.sub(" ", line).strip(WHITESPACE) for line in value.split("\n"))
    return "\n".join(line for line in lines if line)


def _drop(root: Node) -> None:
    """Take the elements without readable text out of a tree, however deep."""
    stack = [root]
    while stack:
        node = stack.pop()
        node.children = [c for c in node.children if isinstance(c, str) or c.tag not in REMOVED]
        stack += [c for c in node.children if isinstance(c, Node)]


def _spaced(root: Node) -> str:
    """Text of a tree: white space of text nodes collapsed, a line end for each br and at the end of each block below the root."""
    out: list[str] = []
    stack: list = [*reversed(root.children)]
    while stack:
        x = stack.pop()
        if x is None:
            out.append("\n")
        elif isinstance(x, str):
            out.append(_SPACE.sub(" ", x))
        elif x.tag == "br":
            out.append("\n")
        else:
            if x.tag in BLOCKS:
                stack.append(None)
            stack += reversed(x.children)
    return "".join(out)


def clean(html: str) -> tuple[str | None, str]:
    """(title or null, readable text) of a page."""
    return _title_and_text(parse(html))


def _title_and_text(root: Node) -> tuple[str | None, str]:
    """As ``clean``; takes what is not readable out of the tree."""
    title_node = root.first("title")
    title = normalize_text(title_node.text()) if title_node is not None else ""
    _drop(root)
    readable = root.first("main") or root.first("article") or root.first("body")
    if readable is None:
        return title or None, ""
    heading = readable.first("h1")
    heading_title = normalize_text(heading.text()) if heading is not None else ""
    return title or heading_title or None, normalize_text(_spaced(readable))


def _bounded(text: str) -> str:
    value = normalize_text(text)
    if len(value) * 2 <= MAX_CELL or value.isascii():
        return value[:MAX_CELL]
    return value.encode("utf-16-le")[: 2 * MAX_CELL].decode("utf-16-le", "ignore")  # lengths are UTF-16 units


def _has_child(node: Node, tag: str) -> bool:
    return any(isinstance(c, Node) and c.tag == tag for c in node.children)


def tables(html: str) -> list[dict]:
    """The first tables of a page, nested ones too: caption, headers and rows."""
    return _tables(parse(html))


def _tables(root: Node) -> list[dict]:
    found = []
    for table in [n for n in root.walk() if n.tag == "table"][:MAX_TABLES]:
        own = [n for n in table.walk() if n.tag == "tr" and n.closest("table") is table]
        head = next((c for c in table.children if isinstance(c, Node) and c.tag == "thead"), None)
        if head is not None:
            header = next((r for r in own if r.closest("thead") is head), None)
        else:
            header = next((r for r in own if _has_child(r, "th")), None)

        def cells(row: Node) -> list[str]:
            return [_bounded(c.text()) for c in [c for c in row.children if isinstance(c, Node) and c.tag in ("th", "td")][:MAX_CELLS]]

        rows: list[list[str]] = []
        for row in own:
            if len(rows) >= MAX_ROWS:
                break
            if row is not header and any(line := cells(row)):
                rows.append(line)
        caption = next((c for c in table.children if isinstance(c, Node) and c.tag == "caption"), None)
        found.append({"caption": (_bounded(caption.text()) if caption is not None else "") or None, "headers": cells(header) if header is not None else [], "rows": rows})
    return found


def links(html: str, page_url: str, allowed_origin: str) -> list[str]:
    """Normalised links of a page that a crawl of ``allowed_origin`` may follow, each once, in order."""
    root = parse(html)
    for node in root.walk():
        if node.tag == "meta" and (node.attributes.get("name") or "").lower() in ("robots", "googlebot"):
            if "nofollow" in re.split(rf"[{WHITESPACE},]+", (node.attributes.get("content") or "").lower()):
                return []
    final, _ = urls.try_normalize(page_url, allowed_origin=allowed_origin, reject_downloadable=False)
    if final is None:
        return []
    base = next((n.attributes["href"] for n in root.walk() if n.tag == "base" and n.attributes.get("href") is not None), None)
    if base:
        final = urls.try_normalize(base, base_url=final, allowed_origin=allowed_origin, reject_downloadable=False)[0] or final
    found: dict[str, None] = {}
    for node in root.walk():
        href = (node.attributes.get("href") or "").strip(WHITESPACE) if node.tag == "a" else ""
        if not href or "download" in node.attributes or "nofollow" in _SPACE.split((node.attributes.get("rel") or "").lower()):
            continue
        url, _ = urls.try_normalize(href, base_url=final, allowed_origin=allowed_origin)
        if url is not None:
            found.setdefault(url)
    return list(found)


TABLES_TYPE = "array<struct<caption:string,headers:array<string>,rows:array<array<string>>>>"
_TABLES_ARROW = pa.list_(pa.struct([("caption", pa.string()), ("headers", pa.list_(pa.string())), ("rows", pa.list_(pa.list_(pa.string())))]))
#: Pages that are read before their results go out.
_PAGES = 64
_PAGE_ARROW = pa.struct([("title", pa.string()), ("content", pa.string()), ("tables", _TABLES_ARROW)])


def clean_html(html: Column) -> Column:
    """struct<title, content> of each page."""

    @F.pandas_udf("title string, content string")
    def run(pages: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([clean(p or "") for p in pages], columns=["title", "content"])

    return run(html)


def extract_tables(html: Column) -> Column:
    """The page's tables as an array of structs."""

    def run(pages: pa.Array) -> pa.Array:
        return pa.array([tables(p) for p in pages.to_pylist()], _TABLES_ARROW)

    return F.arrow_udf(run, TABLES_TYPE)(html)


def read_pages(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """Title, content and tables of pages; some go out before the next are read."""
    for pages in columns:
        for begin in range(0, len(pages), _PAGES):
            found = []
            for page in pages.slice(begin, _PAGES).to_pylist():
                root = parse(page)
                structured = _tables(root)  # before what is not readable goes
                title, content = _title_and_text(root)
                found.append({"title": title, "content": content, "tables": structured})
            yield pa.array(found, _PAGE_ARROW)


def read_page(html: Column) -> Column:
    """struct<title, content, tables> of each page, which is parsed once for all of them."""

    def run(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        return read_pages(columns)

    return F.arrow_udf(run, f"struct<title:string,content:string,tables:{TABLES_TYPE}>")(html)


def serialize_tables(found: Column) -> Column:
    """Tables as lines of text; empty if there are none."""

    def one(table: Column, i: Column) -> Column:
        name = F.concat(F.lit("Table "), (i + 1).cast("string"), F.when(table["caption"].isNotNull() & (table["caption"] != ""), F.concat(F.lit(": "), table["caption"])).otherwise(""))
        headers = F.when(F.size(table["headers"]) > 0, F.array(F.array_join(table["headers"], " | "))).otherwise(F.array().cast("array<string>"))
        rows = F.transform(table["rows"], lambda row: F.array_join(row, " | "))
        return F.array_join(F.concat(F.array(name), headers, rows), "\n")

    return F.when(F.size(found) > 0, F.concat(F.lit("Structured tables:\n"), F.array_join(F.transform(found, one), "\n\n"))).otherwise(F.lit(""))


def discover_links(html: Column, page_url: Column, allowed_origin: Column) -> Column:
    """The page's links as an array of normalised URLs."""

    @F.pandas_udf("array<string>")
    def run(pages: pd.Series, page_urls: pd.Series, origins: pd.Series) -> pd.Series:
        return pd.Series([links(p or "", u or "", o or "") for p, u, o in zip(pages, page_urls, origins, strict=True)])

    return run(html, page_url, allowed_origin)
