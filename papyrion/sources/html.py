"""Markup to rows: one parse per document in an Arrow-batched stage, then plain column rules.

HTML mode knows void elements and closes what a new block element closes; ``xml`` mode nests
whatever is not closed. Entities stay as they are written, as in the texts that are sent on.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Tags and words of the rules.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CLOSES_P = frozenset("address article aside blockquote div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
BLACKLIST = frozenset("script style svg path rect circle ellipse line polyline polygon g defs symbol use meta link noscript template iframe canvas form input textarea select option button".split())
BLOCKED = frozenset("nav header footer aside menu dialog".split())
KEYWORDS = tuple("nav navigation navbar menu header footer sidebar toolbar dropdown popup modal dialog notification notifications user-card profile avatar search donate theme-switcher login signup register auth comment comments".split())
INTERACTIVE = frozenset("button input textarea select option form iframe canvas svg template".split())
NO_CHILD = BLOCKED | INTERACTIVE | frozenset("script style div section article main table ul ol li figure figcaption blockquote".split())
INLINE = frozenset("span a em strong b i u small sup sub cite q abbr".split())
HIDDEN = frozenset("script style noscript svg meta link template iframe canvas".split())
EXPLICIT = frozenset("p li h1 h2 h3 h4 h5 h6 caption title".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
ROOTS = ("html", "head", "body")

_SPACE = re.compile(r"\s+")
_NUMBER = re.compile(r"\d+(?:[.,:/-]\d+)*")


def squeeze(text: str) -> str:
    return _SPACE.sub(" ", text.replace("\u00a0", " ")).strip()


_PLAIN = re.compile(r"[^\W_]+")  # what str.isalnum accepts


def mostly_symbols(text: str) -> bool:
    """FLT-04 in Python, for decisions inside a walk."""
    c = "".join(text.split())
    if not c or _NUMBER.fullmatch(c):
        return True
    marks = len(_PLAIN.sub("", c))
    return marks == len(c) or marks / len(c) >= 0.6


@dataclass(eq=False)
class Page:
    """Text and markup of a whole parsed page; every node knows its stretch of both until the tree is changed."""

    text: str = ""
    html: str = ""
    live: bool = False
    paths: dict[int, str] = field(default_factory=dict)


@dataclass(eq=False)
class Node:
    tag: str
    attrs: dict[str, str] = field(default_factory=dict)
    parent: Node | None = None
    children: list[Node | str] = field(default_factory=list)
    start: str = ""
    page: Page = field(default_factory=Page)
    kids: list[Node] = field(default_factory=list)
    #: Stretches of the page's text and inner markup; number among equal siblings; interactive elements below; elements below.
    t: tuple[int, int] = (0, 0)
    h: tuple[int, int] = (0, 0)
    nth: int = 0
    active: bool = False
    below: int = 0

    @property
    def elements(self) -> list[Node]:
        return self.kids if self.page.live else [c for c in self.children if isinstance(c, Node)]

    def walk(self) -> Iterator[Node]:
        """All elements below, in document order; no recursion, so depth is no limit."""
        stack = self.elements[::-1]
        while stack:
            node = stack.pop()
            yield node
            stack.extend(node.elements[::-1])

    @property
    def text(self) -> str:
        if self.page.live:
            return self.page.text[slice(*self.t)]
        out: list[str] = []
        stack: list[Node | str] = [self]
        while stack:
            item = stack.pop()
            if isinstance(item, str):
                out.append(item)
            else:
                stack.extend(item.children[::-1])
        return "".join(out)

    @property
    def html(self) -> str:
        """Inner markup."""
        if self.page.live:
            return self.page.html[slice(*self.h)]
        out: list[str] = []
        stack: list[Node | str | tuple[str]] = list(self.children[::-1])
        while stack:
            item = stack.pop()
            if isinstance(item, str):
                out.append(item)
            elif isinstance(item, tuple):
                out.append(item[0])
            else:
                out.append(item.start)
                if item.tag not in VOID:
                    stack.append((f"</{item.tag}>",))
                    stack.extend(item.children[::-1])
        return "".join(out)

    @property
    def path(self) -> str:
        """EXP-13: tags with their number among equal siblings."""
        parts, node, known = [], self, self.page.paths
        while node.parent is not None and id(node) not in known:
            nth = node.nth if node.page.live else next(k for k, e in enumerate((e for e in node.parent.elements if e.tag == node.tag), 1) if e is node)
            parts.append(f"{node.tag}:nth-of-type({nth})")
            node = node.parent
        if id(node) in known:
            parts.append(known[id(node)])
        path = " > ".join(reversed(parts))
        if self.page.live:
            if len(known) > 64:  # elements near by share their way
                known.clear()
            known[id(self)] = path
        return path


_MARKUP = re.compile("<")


class _Builder(HTMLParser):
    """Only markup is looked for in texts, so entities stay as they are written, unfinished ones too."""

    def __init__(self, xml: bool):
        super().__init__(convert_charrefs=False)
        self.xml = xml
        self.root = self.at = Node("#root")

    def reset(self):
        super().reset()
        self.interesting = _MARKUP

    def clear_cdata_mode(self):
        super().clear_cdata_mode()
        self.interesting = _MARKUP

    def _open(self, tag: str, attrs: list, empty: bool) -> None:
        if not self.xml:
            closing = {"li": ("li", ("ul", "ol")), "td": ("td", ("tr",)), "tr": ("tr", ("table",)), "option": ("option", ("select",)), "dt": ("dt", ("dl",)), "dd": ("dd", ("dl",))}.get(tag)
            if tag in CLOSES_P:
                self._close_to("p", ("body", "td", "th", "li", "div", "section", "article"))
            if closing:
                self._close_to(*closing)
        node = Node(tag, {k: v or "" for k, v in attrs}, self.at, start=self.get_starttag_text() or f"<{tag}>", page=self.root.page)
        self.at.children.append(node)
        if not empty and (self.xml or tag not in VOID):
            self.at = node

    def _close_to(self, tag: str, stop: tuple[str, ...]) -> None:
        node = self.at
        while node.parent is not None and node.tag not in stop:
            if node.tag == tag:
                self.at = node.parent
                return
            node = node.parent

    def handle_starttag(self, tag, attrs):
        self._open(tag, attrs, False)

    def handle_startendtag(self, tag, attrs):
        self._open(tag, attrs, True)

    def handle_endtag(self, tag):
        node = self.at
        while node.parent is not None:
            if node.tag == tag:
                self.at = node.parent
                return
            node = node.parent

    def handle_data(self, data):
        self.at.children.append(data)


def parse(html: str | None, xml: bool = False) -> Node:
    builder = _Builder(xml)
    builder.feed(html or "")
    builder.close()
    _survey(builder.root)
    return builder.root


def _survey(root: Node) -> None:
    """One pass over a new tree: where each node's text and markup lie in the page's, and what is below it."""
    texts: list[str] = []
    marks: list[str] = []
    t = h = 0
    stack: list[tuple[Node | str, bool]] = [(root, False)]
    while stack:
        item, done = stack.pop()
        if isinstance(item, str):
            texts.append(item)
            marks.append(item)
            t, h = t + len(item), h + len(item)
        elif not done:
            if item is not root:
                marks.append(item.start)
                h += len(item.start)
            item.t, item.h = (t, t), (h, h)
            item.kids = [c for c in item.children if isinstance(c, Node)]
            if item.kids and item.tag in VOID:  # markup that leaves out children can't be one stretch
                return
            seen: dict[str, int] = {}
            for kid in item.kids:
                kid.nth = seen[kid.tag] = seen.get(kid.tag, 0) + 1
            stack.append((item, True))
            stack.extend((c, False) for c in item.children[::-1])
        else:
            item.t, item.h = (item.t[0], t), (item.h[0], h)
            item.active = any(k.active or k.tag in INTERACTIVE for k in item.kids)
            item.below = sum(1 + k.below for k in item.kids)
            if item is not root and item.tag not in VOID:
                marks.append(f"</{item.tag}>")
                h += len(item.tag) + 3
    page = root.page
    page.text, page.html, page.live = "".join(texts), "".join(marks), True


def body(root: Node) -> Node:
    return next((n for n in root.walk() if n.tag == "body"), root)


# ---------------------------------------------------------------- node rules


def shadow(node: Node) -> bool:
    return any("shadowroot" in k.lower() for k in node.attrs)


def blocked_region(node: Node) -> bool:
    """FLT-05; keywords count anywhere in id and class."""
    mark = f"{node.attrs.get('id', '')} {node.attrs.get('class', '')}".lower()
    return node.tag in BLOCKED or any(k in mark for k in KEYWORDS)


def interactive(node: Node) -> bool:
    """FLT-07."""
    inside = node.active if node.page.live else any(n.tag in INTERACTIVE for n in node.walk())
    return node.tag in INTERACTIVE or node.tag in ("script", "style") or inside


def simple_container(node: Node) -> bool:
    """FLT-08."""
    return node.tag not in ("span", "a", "div") or (len(node.elements) <= 8 and not any(c.tag in NO_CHILD for c in node.elements))


def text_dominant(node: Node) -> bool:
    """FLT-09."""
    text = squeeze(node.text)
    if len(text) < 3 or mostly_symbols(text):
        return False
    direct = len(squeeze("".join(c for c in node.children if isinstance(c, str))))
    kids = node.elements
    inline = bool(kids) and all(k.tag in INLINE for k in kids)
    if not inline and (direct == 0 or (kids and direct < 2)):
        return False
    below = min(8, node.below) if node.page.live else sum(1 for _ in zip(range(8), node.walk(), strict=False))
    return len(text) >= max(3, 4 * len(kids) + 2 * below)


def visible(root: Node) -> list[tuple[str, int, Node, str]]:
    """EXP-02: (id, order, node, reason) of elements whose own text is worth sending; excluded ones have a reason and no id."""
    kept: list[tuple[str, int, Node, str]] = []
    out: list[tuple[str, int, Node, str]] = []
    chosen: dict[int, int] = {}
    order = 0
    stack: list[tuple[Node, int, bool]] = [(root, -1, False)]
    while stack:  # children first; ids are given on the way up, order on the way down
        node, place, done = stack.pop()
        if not done:
            place, order = order, order + 1
            if node.tag in HIDDEN:
                out.append(("", place, node, "blacklisted_tag"))
                continue
            stack.append((node, place, True))
            stack.extend((c, -1, False) for c in node.elements[::-1])
            continue
        below = max((chosen.get(id(c), 0) for c in node.elements), default=0)
        chosen[id(node)] = below
        if node.tag in ("html", "body", "#root"):
            continue
        size = len(text := squeeze(node.text))
        if size < 1:
            continue
        if mostly_symbols(text):
            out.append(("", place, node, "mostly_symbols"))
        elif below and below >= 0.7 * size:
            out.append(("", place, node, "duplicate_parent"))
        elif node.html.strip():
            kept.append((f"node_{len(kept)}", place, node, ""))
            chosen[id(node)] = max(size, below)
    if not kept and root.tag == "body" and not mostly_symbols(squeeze(root.text)):
        kept.append(("node_0", 0, root, ""))
    return sorted(kept + out, key=lambda r: r[1])


def structural(root: Node) -> list[tuple[str, int, Node, str]]:
    """EXP-03: like ``visible``, by structure: the first element on each way down that passes all rules."""
    out: list[tuple[str, int, Node, str]] = []
    n = order = 0
    up, blocked = root, False
    while up is not None and up.tag != "#root":
        blocked |= blocked_region(up) or shadow(up)
        up = up.parent
    stack = [(c, blocked) for c in root.elements[::-1]]
    while stack:
        node, under = stack.pop()
        order += 1
        text = squeeze(node.text)
        cut = "blacklisted_tag" if node.tag in BLACKLIST or shadow(node) else "custom_element" if "-" in node.tag else "blocked_ancestor" if under else ""
        if cut:
            for inner in (node, *node.walk()):
                out.append(("", order, inner, cut))
                order += 1
            continue
        reason = (
            "not_text_dominant" if node.tag in ROOTS else "interactive_node" if interactive(node) else "not_text_dominant" if not simple_container(node)
            else "too_short" if len(text) < 3 else "mostly_symbols" if mostly_symbols(text) else "not_text_dominant" if not text_dominant(node) else ""
        )
        if reason:
            out.append(("", order, node, reason))
            inside = blocked_region(node) or shadow(node)
            stack.extend((c, under or inside) for c in node.elements[::-1])
        elif node.html.strip():
            out.append((f"node_{n}", order, node, ""))
            n += 1
    return out


def explicit(root: Node) -> list[tuple[str, int, Node, str]]:
    """EXP-01: text elements; the id counts empty ones too."""
    found = [n for n in root.walk() if n.tag in EXPLICIT]
    return [(f"node_{k}" if n.html.strip() else "", k, n, "" if n.html.strip() else "empty") for k, n in enumerate(found)]


def content_root(root: Node) -> Node:
    """EXP-15: the element that looks most like the main text, else the body."""
    wanted = lambda n: n.tag in ("article", "main", "section") or n.attrs.get("role") == "main" or any(w in f"{n.attrs.get('id', '')} {n.attrs.get('class', '')}".lower() for w in ("content", "article", "post", "entry", "main"))
    best, top = None, 0.0
    for node in (n for n in root.walk() if wanted(n)):
        text = len(squeeze(node.text))
        inside = list(node.walk())
        linked = sum(len(squeeze(a.text)) for a in inside if a.tag == "a")
        score = text + 50 * sum(n.tag in ("p", "li") for n in inside) - 500 * (linked / max(text, 1))
        if score > top:
            best, top = node, score
    if best is None:
        best = max(body(root).elements, key=lambda n: len(squeeze(n.text)), default=body(root))
    return best


def unwrap_spans(root: Node, ids: set[str], classes: set[str]) -> None:
    """EXP-16: spans without language, style, a referenced id or a defined class give way to their children."""
    root.page.live = False
    root.page.paths.clear()
    for node in [n for n in root.walk() if n.tag == "span"]:
        needed = "lang" in node.attrs or "xml:lang" in node.attrs or "style" in node.attrs or node.attrs.get("id", "") in ids or classes & set(node.attrs.get("class", "").split())
        if not needed and node.parent is not None:
            at = next(k for k, c in enumerate(node.parent.children) if c is node)
            node.parent.children[at : at + 1] = node.children
            for child in node.elements:
                child.parent = node.parent


def _plain_text(node: Node) -> str:
    """Text without notes and links."""
    out, stack = [], [node]
    while stack:
        item = stack.pop()
        if isinstance(item, str):
            out.append(item)
        elif item.tag != "sup" and not (item.tag == "a" and "href" in item.attrs):
            stack.extend(item.children[::-1])
    return squeeze("".join(out))


def _closest(node: Node | None, tags: frozenset[str] | set[str]) -> Node | None:
    while node is not None and node.tag not in tags:
        node = node.parent
    return node


def _group_title(group: Node) -> str:
    inside = list(group.walk())
    typed = lambda kind, tags: next((n for n in inside if kind in n.attrs.get("epub:type", "").split() or n.tag in tags), None)
    ordinal, title = typed("ordinal", ("h1", "h2", "h3")), typed("title", ("h4", "h5", "h6"))
    a, b = _plain_text(ordinal) if ordinal else "", _plain_text(title) if title else ""
    return f"{a}：{b}" if a and b else b or a or _plain_text(group)


def anchor_title(root: Node, anchor: str | None) -> str | None:
    """JOIN-03: what a link to an anchor is called: heading group, own text, inner, next or enclosing heading, else the page's first."""
    titled = lambda n: _group_title(g) if (g := _closest(n, {"hgroup"})) else _plain_text(n)
    target = next((n for n in root.walk() if anchor and n.attrs.get("id") == anchor), None)
    if target is not None:
        if group := _closest(target, {"hgroup"}):
            return _group_title(group)
        if text := _plain_text(target):
            return text
        inner = next((n for n in target.walk() if n.tag in HEADINGS), None)
        if inner is None and target.parent is not None:
            after = target.parent.elements
            inner = next((n for n in after[next(k for k, e in enumerate(after) if e is target) + 1 :] if n.tag in ("h1", "h2", "h3", "h4")), None)
        for found in (inner, _closest(target, HEADINGS)):
            if found is not None and (text := titled(found)):
                return text
    group = next((n for n in root.walk() if n.tag == "hgroup"), None)
    if group is not None:
        return _group_title(group)
    first = next((n for n in root.walk() if n.tag in ("h1", "h2", "h3")), None)
    return (_plain_text(first) if first else "") or None


def first_heading(root: Node) -> str | None:
    """EXP-14: the first h1 or h2, else the title."""
    for tags in (("h1", "h2"), ("title",)):
        node = next((n for n in root.walk() if n.tag in tags), None)
        if node is not None and (tags[0] == "h1" or squeeze(node.text)):
            return squeeze(node.text)
    return None


# ---------------------------------------------------------------- Spark

#: Characters of a batch of elements before it is handed on.
OUT_CHARS = 4_000_000
NODES = "key {key}, id string, ord long, tag string, css_class string, dom_path string, content string, text string, cells array<string>, reason string"


def explode(docs: DataFrame, key: str, how: Callable[[Node], list[tuple[str, int, Node, str]]], html: str = "html", xml: bool = False) -> DataFrame:
    """One row per element that ``how`` gives: key, id (empty: excluded), ord, tag, css_class, dom_path, content, text, cells (of tables), reason."""
    kind = docs.schema[key].dataType.simpleString()
    types = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.string(), pa.list_(pa.string()), pa.string()]
    names = ["id", "ord", "tag", "css_class", "dom_path", "content", "text", "cells", "reason"]

    def together(key_type: pa.DataType, keys: list, out: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*out, strict=True)) or [()] * len(names)
        return pa.RecordBatch.from_arrays([pa.array(keys, key_type), *(pa.array(list(c), t) for c, t in zip(columns, types, strict=True))], names=["key", *names])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kind, keys, out, size = batch.schema.field(0).type, [], [], 0
            for k, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                for name, order, node, reason in how(parse(text.as_py(), xml)):
                    cells = [squeeze(c.text) for c in node.walk() if c.tag in ("td", "th")] if node.tag == "table" else None
                    row = (name, order, node.tag, node.attrs.get("class"), node.path, node.html.strip(), squeeze(node.text), cells, reason)
                    keys.append(k)
                    out.append(row)
                    size += len(row[4]) + 2 * len(row[5])
                    if size >= OUT_CHARS:  # nested elements repeat their content, so a batch is bounded by what it holds
                        yield together(kind, keys, out)
                        keys, out, size = [], [], 0
            yield together(kind, keys, out)

    return docs.select(F.col(key).alias("key"), F.col(html).cast("string").alias("html")).mapInArrow(rows, NODES.format(key=kind)).withColumnRenamed("key", key)


def tables(root: Node) -> list[tuple[str, int, Node, str]]:
    """EXP-04."""
    return [(f"table_{k}", k, n, "") for k, n in enumerate(n for n in root.walk() if n.tag == "table")]


def headings(root: Node) -> list[tuple[str, int, Node, str]]:
    """EXP-05."""
    return [(f"std_{k}", k, n, "") for k, n in enumerate(n for n in root.walk() if n.tag in HEADINGS)]


def visible_body(root: Node) -> list[tuple[str, int, Node, str]]:
    return visible(body(root))


def structural_body(root: Node) -> list[tuple[str, int, Node, str]]:
    return structural(body(root))


def unique_headings(rows: DataFrame, key: str) -> DataFrame:
    """EXP-05: of equal texts the first."""
    order = Window.partitionBy(key, "text").orderBy("ord")
    return rows.where("text <> ''").withColumn("_r", F.row_number().over(order)).where("_r = 1").drop("_r")


def numbered_headings(rows: DataFrame, key: str) -> DataFrame:
    """EXP-06: headings of a book numbered over its chapters; ``rows`` has chapter and ord."""
    order = Window.partitionBy(key).orderBy("chapter", "ord")
    return rows.where("text <> ''").withColumn("id", F.concat(F.lit("std_"), (F.row_number().over(order) - 1).cast("string")))


def links(docs: DataFrame, key: str, html: str = "html") -> DataFrame:
    """EXP-07, SRC-18: (key, ord, href, file, anchor) of all links, by one regular expression; the anchor is what follows the first #."""
    found = F.regexp_extract_all(html, F.lit(r"(?i)<a\s[^>]*?href\s*=\s*[\"']([^\"']*)[\"']"), 1)
    rows = docs.select(key, F.posexplode(found).alias("ord", "href"))
    at = F.instr("href", "#")
    return rows.select(key, "ord", "href", F.when(at > 0, F.substr("href", F.lit(1), at - 1)).otherwise(F.col("href")).alias("file"), F.when(at > 0, F.substr("href", at + 1)).alias("anchor"))


def referenced_ids(docs: DataFrame, key: str, html: str = "html") -> DataFrame:
    """SRC-18: distinct anchors."""
    return links(docs, key, html).where("anchor <> ''").select("anchor").distinct()


def css_classes(sheets: DataFrame, css: str = "css") -> DataFrame:
    """SRC-17: distinct class names of style sheets."""
    return sheets.select(F.explode(F.regexp_extract_all(css, F.lit(r"\.([a-zA-Z][\w-]*)"), 1)).alias("class")).distinct()


def read(spark: SparkSession, path: str) -> DataFrame:
    """SRC-03: (path, html, title): a file is one chapter."""
    rows = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("html"))
    stem = F.regexp_extract("path", r"([^/]+?)(?:\.[^./]*)?$", 1)
    head = F.regexp_replace(F.regexp_extract("html", r"(?is)<h[12][^>]*>(.*?)</h[12]>", 1), "<[^>]*>", "")
    return rows.withColumn("title", F.coalesce(F.nullif(F.trim(F.regexp_replace(head, r"\s+", " ")), F.lit("")), F.nullif(stem, F.lit("")), F.lit("Untitled")))
