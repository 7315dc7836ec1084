"""Tables and algorithms on pages (TBL-01, TBL-02): one grouped stage per page over a model of its blocks.

A page is small; what depends on earlier choices (clusters, claimed blocks, merges) is decided
in ``detect_page``. Pages are independent, so documents of any size spread over tasks.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable
from dataclasses import dataclass, field
from functools import cached_property
from itertools import pairwise
from statistics import median

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from papyrion.operators.grouped import each

Box = tuple[float, float, float, float]

# Kinds of blocks that never are table bodies, words and signs of algorithms and formulas.
NO_TABLE = {"caption", "heading", "page_header", "page_footer", "other", "footnote", "reference_block", "code", "formula_display"}
NO_STEPS = {"heading", "caption", "page_header", "page_footer", "other", "footnote", "reference_block"}
STEP_WORDS = ("input", "output", "procedure", "for step", "return", "while", "repeat", "queue", "loss", "update")
_CALLS = re.compile(r"(?i)\b(?:sin|cos|max|min|softmax|concat|attention)\s*\(")
_ASSIGNED = re.compile(r"\b[A-Za-z]\w*\s*=")
_NUMBER = re.compile(r"\b\d+(?:\.\d+)?[KMBkmb%]?\b")
_TABLE_TITLE = re.compile(r"(?i)^(?:table|表)\s*\d+\b")
_STEP = re.compile(r"(?:^|\s)\d{1,2}:")


def union(boxes: Iterable[Box]) -> Box | None:
    rows = list(boxes)
    return (min(b[0] for b in rows), min(b[1] for b in rows), max(b[2] for b in rows), max(b[3] for b in rows)) if rows else None


def width(b: Box) -> float:
    return max(b[2] - b[0], 0.0)


def height(b: Box) -> float:
    return max(b[3] - b[1], 0.0)


def shared(a: Box, b: Box) -> float:
    """Common horizontal extent over the smaller width."""
    return max(0.0, min(a[2], b[2]) - max(a[0], b[0])) / max(min(width(a), width(b)), 1.0)


def below(upper: Box, lower: Box) -> float:
    return lower[1] - upper[3]


def anchor_bins(values: Iterable[float], tolerance: float, least: int) -> int:
    """WIN-14: positions fall into the first bin whose mean is near; bins with enough of them."""
    bins: list[list[float]] = []
    for v in sorted(values):
        for group in bins:
            if abs(v - sum(group) / len(group)) <= tolerance:
                group.append(v)
                break
        else:
            bins.append([v])
    return sum(len(g) >= least for g in bins)


def sentence(text: str, numbers: int) -> bool:
    """FLT-28: running text, not cells."""
    stops, words, marked = len(re.findall(r"[，。；：!?]", text)), len(re.findall(r"[A-Za-z][A-Za-z'-]*", text)), re.search(r"[.,;:]", text)
    opens = text.strip().lower().startswith(("from ", "we ", "this ", "that ", "by ", "for "))
    return bool((stops >= 2 and numbers < 4) or (len(text) >= 90 and stops >= 1 and numbers < 5) or (words >= 40 and marked) or (words >= 14 and numbers <= 10 and (marked or opens)))


@dataclass(eq=False)
class Block:
    """A block with what the rules ask for, worked out once."""

    raw: dict
    page_width: float = 0.0
    box: Box | None = field(init=False)

    def __post_init__(self):
        b = self.raw.get("bbox")
        self.box = tuple(map(float, b)) if b is not None and len(b) == 4 else None
        self.id, self.kind = str(self.raw.get("id") or ""), str(self.raw.get("blockType") or "")
        self.text = str(self.raw.get("text") or "").strip()
        self.plain = " ".join(self.text.split())
        self.heading = self.raw.get("role") == "heading"
        self.size = float(self.raw.get("fontSize") or 0.0)
        lines = self.raw.get("layoutLines")
        self.lines = list(lines) if lines is not None else []

    @cached_property
    def items(self) -> list[tuple[str, Box | None]]:
        out = []
        for line in self.lines:
            for i in line.get("items") if line.get("items") is not None else []:
                text, b = str(i.get("text") or "").strip(), i.get("bbox")
                if text and str(i.get("type") or "") in ("text", "formula"):
                    out.append((" ".join(text.split()), tuple(map(float, b)) if b is not None and len(b) == 4 else None))
        return out

    @cached_property
    def stats(self) -> tuple[int, float, float, float]:
        """AGG-18: items, share of short ones, share of numeric ones, upper median of lengths."""
        texts = [t for t, _ in self.items]
        sizes = sorted(len(t) for t in texts)
        n = max(len(texts), 1)
        numeric = sum(bool(re.search(r"[\d↑↓%@±]", t)) for t in texts)
        return len(texts), sum(s <= 12 for s in sizes) / n, numeric / n, float(sizes[len(sizes) // 2]) if sizes else 0.0

    @cached_property
    def numbers(self) -> int:
        return len(_NUMBER.findall(self.plain))

    @cached_property
    def reads(self) -> bool:
        return sentence(self.text, self.numbers)

    @cached_property
    def formula(self) -> bool:
        """FLT-28."""
        if self.box is None or not self.plain or width(self.box) > max(self.page_width * 0.72, 360.0):
            return False
        if self.kind in ("table_body", "table_header") and width(self.box) >= max(self.page_width * 0.35, 180.0):
            return False
        t = self.text
        few = len(self.lines) <= 4 and ((t.count("=") and t.count("(")) or (t.count("(") >= 2 and t.count(")") >= 2) or _ASSIGNED.search(t))
        return bool(_CALLS.search(self.plain) or set(t) & set("∈∀∑√") or few)

    @cached_property
    def rows(self) -> list[list[Box]]:
        """WIN-14: item boxes by running mean of their middle."""
        out: list[list[Box]] = []
        middle = lambda b: (b[1] + b[3]) / 2
        for b in sorted((b for _, b in self.items if b), key=lambda b: (middle(b), b[0])):
            row = next((r for r in out if abs(middle(b) - sum(map(middle, r)) / len(r)) <= 6.0), None)
            row.append(b) if row is not None else out.append([b])
        return [sorted(r) for r in out]

    def columns(self) -> bool:
        """AGG-20: rows with gaps at the same places."""
        wide = [r for r in self.rows if len(r) >= 3]
        gaps = sum(any(b[0] - a[2] >= 18.0 for a, b in pairwise(r)) for r in wide)
        if len(self.rows) < 6 or len(wide) < 4 or gaps < 4:
            return False
        return max(anchor_bins((b[0] for r in wide for b in r[1:]), 12.0, 4), anchor_bins((b[2] for r in wide for b in r[:-1]), 12.0, 4)) >= 2

    def compact(self) -> bool:
        """AGG-20: a narrow block of many short, aligned items."""
        numbers = len(re.findall(r"\b\d+(?:\.\d+)?(?:%|\+\d+%)?\b", self.plain))
        if self.box is None or width(self.box) > max(self.page_width * 0.5, 310.0) or len(self.plain) < 16 or numbers < 4 or sentence(self.text, numbers) or len(self.lines) < 6:
            return False
        boxes = [b for _, b in self.items if b]
        if len(self.items) < 8 or len(boxes) < 8 or sum(len(t) <= 18 for t, _ in self.items) / len(self.items) < 0.8:
            return False
        return max(anchor_bins((b[0] for b in boxes), 14.0, 2), anchor_bins((b[2] for b in boxes), 14.0, 2)) >= 2

    def single_body(self) -> bool:
        return self.kind in ("table_body", "metadata", "body") and (self.columns() or self.compact())

    def _may_hold(self, least: int) -> bool:
        return self.box is not None and self.kind not in NO_TABLE and not self.heading and len(self.plain) >= least and not self.formula and not self.reads

    def seed(self) -> bool:
        """FLT-28: starts a table."""
        if not self._may_hold(12):
            return False
        n, short, numeric, mid = self.stats
        w, p = width(self.box), self.page_width
        typed = self.kind in ("table_body", "table_header") and w >= max(p * 0.12, 70.0) and n >= 1 and mid <= 18
        cells = self.numbers >= 8 or (n >= 6 and short >= 0.65 and mid <= 10) or (self.numbers >= 6 and numeric >= 0.35 and short >= 0.45)
        return typed or (w >= max(p * 0.3, 180.0) and cells)

    def supports(self) -> bool:
        """FLT-28: belongs to a table nearby."""
        if not self._may_hold(8):
            return False
        n, short, numeric, mid = self.stats
        w, p = width(self.box), self.page_width
        typed = self.kind in ("table_body", "table_header") and n >= 1 and mid <= 18
        wide = w >= max(p * 0.28, 170.0) and ((self.numbers >= 6 and numeric >= 0.3) or (n >= 4 and short >= 0.65 and mid <= 12))
        return typed or wide or (w >= max(p * 0.2, 120.0) and n <= 4 and short >= 0.75 and mid <= 14)

    def headerish(self) -> bool:
        """FLT-28: a row of column titles."""
        if self.box is None or not self.plain or len(self.plain) > 120 or self.formula:
            return False
        n, short, _, mid = self.stats
        band = n >= 8 and short >= 0.85 and mid <= 4 and self.numbers <= 2
        if (len(self.plain) > 72 and n < 5) or (self.reads and not band):
            return False
        fits = width(self.box) >= max(self.page_width * 0.18, 90.0) and height(self.box) <= max(self.size * 5.5, 42.0)
        return fits and (n >= 2 or len(self.lines) >= 2 or (short >= 0.7 and mid <= 12))

    def table_title(self) -> bool:
        return self.kind == "caption" and bool(_TABLE_TITLE.match(self.text))

    def algorithm_title(self) -> bool:
        return self.kind not in NO_STEPS - {"heading", "caption"} and bool(re.match(r"(?i)^algorithm\s+\d+\b", self.text))

    def algorithm_body(self) -> bool:
        if self.box is None or self.kind in NO_STEPS or self.heading or width(self.box) < max(self.page_width * 0.45, 220.0) or len(self.plain) < 24:
            return False
        steps, low = len(_STEP.findall(self.text)), self.text.lower()
        words, signs = sum(w in low for w in STEP_WORDS), self.text.count("←") + self.text.count("▷")
        if self.reads and steps == 0 and words < 2:
            return False
        return steps >= 2 or (len(self.lines) >= 6 and (words >= 2 or signs >= 2) and self.stats[0] >= 8)

    def note_of(self, body: Box) -> bool:
        """A footnote right below a body."""
        b = self.box
        near = b is not None and shared(b, body) >= 0.6 and -2.0 <= below(body, b) <= 28.0 and width(b) >= max(self.page_width * 0.5, 220.0)
        return bool(near and self.size <= 7.5 and re.match(r"^(?:[a-zA-Z*†‡]\b|Note[:.]?)", self.text))


# ---------------------------------------------------------------- rules of a page


def group_rules(lines: list[Box], page_width: float) -> list[list[Box]]:
    """WIN-15: long horizontal rules with equal ends, three different ones at least."""
    long_ = sorted((r for r in lines if width(r) >= max(page_width * 0.35, 180.0)), key=lambda r: (width(r), r[0], r[2]), reverse=True)
    groups: list[list[Box]] = []
    for r in long_:
        home = next((g for g in groups if abs(r[0] - g[0][0]) <= 18 and abs(r[2] - g[0][2]) <= 18), None)
        home.append(r) if home is not None else groups.append([r])
    unique = [sorted({tuple(round(v, 3) for v in r) for r in g}, key=lambda r: (r[1], r[0])) for g in groups]
    return [g for g in unique if len(g) >= 3]


def _cut(rows: list, at: list[int]) -> list[list]:
    """Parts between cuts that have three rows or more; all in one if none has."""
    ends = [0, *sorted(set(at)), len(rows)]
    return [p for p in (rows[a:b] for a, b in pairwise(ends)) if len(p) >= 3] or [rows]


def split_rules(group: list[Box]) -> list[list[Box]]:
    """WIN-08: a gap larger than twice the median (and 60) parts two tables."""
    gaps = [b[1] - a[1] for a, b in pairwise(group)]
    usual = [g for g in gaps if g > 0]
    if len(group) < 4 or not usual:
        return [group]
    limit = max(60.0, 2 * median(usual))
    at = [k for k, g in enumerate(gaps, 1) if g > limit]
    return _cut(group, at) if at else [group]


def rule_regions(lines: list[Box], page_width: float) -> list[tuple[Box, list[Box]]]:
    """WIN-15: (box, rules) of regions between rules that are not too far apart, in reading order."""
    found = []
    for group in group_rules(lines, page_width):
        for part in split_rules(group):
            box, gaps = union(part), [b[1] - a[1] for a, b in pairwise(part)]
            if box and gaps and height(box) >= 24 and width(box) >= max(page_width * 0.35, 180.0) and max(gaps) <= 120:
                found.append((box, part))
    return sorted(found, key=lambda r: (r[0][1], r[0][0]))


def split_by_captions(region: tuple[Box, list[Box]], blocks: list[Block]) -> list[tuple[Box, list[Box]]]:
    """WIN-09: captions inside a region part it between the rules around them."""
    box, rules = region
    if len(rules) < 4:
        return [region]
    at = []
    for c in (b.box for b in blocks if b.kind == "caption" and b.box):
        if shared(c, box) >= 0.6 and box[1] + 8 < c[1] and c[3] < box[3] - 8:
            at += [k for k, (a, b) in enumerate(pairwise(rules), 1) if a[1] <= c[1] and b[1] >= c[3]][:1]
    return [(union(p), p) for p in _cut(rules, at)] if at else [region]


def refine(box: Box, lines: list[Box]) -> Box:
    """GEO-06: out to the farthest rule right above (36) and below (18)."""
    fit = [r for r in lines if shared(r, box) >= 0.7]
    top = min((r for r in fit if 0 <= box[1] - r[1] <= 36), key=lambda r: r[1], default=None)
    bottom = max((r for r in fit if 0 <= r[1] - box[3] <= 18), key=lambda r: r[1], default=None)
    ends = [r for r in (top, bottom) if r]
    return (min([box[0], *(r[0] for r in ends)]), min(box[1], top[1]) if top else box[1], max([box[2], *(r[2] for r in ends)]), max(box[3], bottom[3]) if bottom else box[3])


# ---------------------------------------------------------------- clusters


def linked(a: Block, b: Block) -> bool:
    """WIN-16: two seeds of one table."""
    p, q = a.box, b.box
    gap = abs(below(p, q))
    band = abs(p[1] - q[1]) <= max(a.size, b.size, 10.0)
    alike = abs(p[0] - q[0]) <= 28 and abs(p[2] - q[2]) <= 32
    return shared(p, q) >= 0.45 and gap <= 34 and (band or alike or gap <= 14)


def clusters(seeds: list[Block]) -> list[list[Block]]:
    """WIN-16: what links reach, starting with the first seed that is left."""
    left, out = list(seeds), []
    while left:
        group, grown = [left.pop(0)], True
        while grown:
            joined = [b for b in left if any(linked(a, b) for a in group)]
            grown = bool(joined)
            group += joined
            left = [b for b in left if b not in joined]
        out.append(sorted(group, key=lambda b: b.box[1]))
    return out


def grown(cluster: list[Block], blocks: list[Block]) -> list[Block]:
    """WIN-16: supporting blocks right above and below, until no more come."""
    group = list(cluster)
    while True:
        box = union(b.box for b in group)
        near = lambda b: any(-6 <= g <= 16 for g in (below(b.box, box), below(box, b.box)))
        more = [b for b in blocks if b not in group and b.box and b.supports() and shared(b.box, box) >= 0.48 and near(b)]
        if not more:
            return sorted(group, key=lambda b: b.box[1])
        group += more


def figure_labels(cluster: list[Block], box: Box) -> bool:
    """FLT-28: a few short labels of a figure."""
    told = [b for b in cluster if b.plain]
    if not 0 < len(cluster) <= 4 or height(box) > 72 or any(len(b.lines) >= 8 or b.stats[0] >= 10 for b in told):
        return False
    few = sum(b.numbers for b in told) < 3 and sum(len(b.lines) for b in told) <= 10 and sum(b.stats[0] for b in told) <= 12
    return few and sum(len(b.plain) <= 36 and b.stats[3] <= 12 for b in told) >= max(len(cluster) - 1, 1)


def region_is_table(inside: list[Block]) -> bool:
    if len(inside) != 1:
        return len(inside) > 1
    b = inside[0]
    return not b.formula and (len(b.lines) >= 6 or b.stats[0] >= 8 or b.numbers >= 6 or b.kind in ("table_body", "table_header"))


def _structure(name: str, kind: str, box: Box, display: Box, **members: list[Block]) -> dict:
    out = {"id": name, "kind": kind, "bbox": list(box), "displayBBox": list(display)}
    for part in ("body", "header", "caption", "footnote"):
        rows = members.get(part) or []
        out[f"{part}BlockIds"], out[f"{part}Texts"] = [b.id for b in rows], [str(b.raw.get("text") or "") for b in rows]
    return out


def single_bodies(page: int, blocks: list[Block], used: set[str]) -> list[dict]:
    """JOIN-14: a caption right above or below one block that is a table by itself."""
    out = []
    for title in sorted((b for b in blocks if b.table_title() and b.box and b.id not in used), key=lambda b: (b.box[1], b.box[0])):
        best, top = None, None
        for body in blocks:
            if body is title or body.id in used or not body.box or not body.single_body():
                continue
            under = body.box[1] >= title.box[1]
            gap = below(title.box, body.box) if under else below(body.box, title.box)
            header = _header(title if under else None, body, blocks)
            if under and header is not None:
                gap = below(header.box, body.box)
            over = shared(title.box, body.box)
            if not -2 <= gap <= 42 or over < 0.45:
                continue
            score = 10 * over + 0.08 * len(body.lines) - 0.05 * gap - (0.35 if header is None else 0)
            if top is None or score > top:
                best, top = (body, header), score
        if best is None:
            continue
        body, header = best
        core = union(b.box for b in (body, header) if b)
        notes = [b for b in blocks if b not in (title, body, header) and b.note_of(body.box)]
        out.append(_structure(f"p{page}_single_{len(out) + 1}", "table", core, union([core, title.box, *(n.box for n in notes)]), body=[body], header=[header] if header else [], caption=[title], footnote=notes))
        used |= {b.id for b in (title, body, header, *notes) if b}
    return out


def _header(title: Block | None, body: Block, blocks: list[Block]) -> Block | None:
    """JOIN-14: the best row of column titles right above a body (below its caption, where that is above)."""
    def score(b: Block) -> float | None:
        if b is title or b is body or not b.box or b.box[1] >= body.box[1]:
            return None
        gap = below(b.box, body.box)
        if not -2 <= gap <= 24 or shared(b.box, body.box) < 0.72 or not b.headerish():
            return None
        if title is not None and (b.box[1] <= title.box[1] or not -2 <= below(title.box, b.box) <= 20):
            return None
        return 10 * shared(b.box, body.box) - 0.08 * gap + len(b.lines)

    scored = [(s, -k, b) for k, b in enumerate(blocks) if (s := score(b)) is not None]
    return max(scored, key=lambda x: x[:2])[2] if scored else None


def dedupe(tables: list[dict]) -> list[dict]:
    """TOP-05: larger ones first; subsets and near-equal ones go."""
    kept: list[tuple[set, dict]] = []
    for t in sorted(tables, key=lambda t: (-len(t["bodyBlockIds"]), -len(t["headerBlockIds"]), -len(t["captionBlockIds"]), t["id"])):
        ids = set(t["bodyBlockIds"])
        if ids and not any(ids <= other or len(ids & other) / len(ids | other) >= 0.8 for other, _ in kept):
            kept.append((ids, t))
    return sorted((t for _, t in kept), key=lambda t: t["id"])


def merge(page: int, tables: list[dict], blocks: list[Block], most: float = 34.0) -> list[dict]:
    """WIN-10: tables right below each other without a caption between them become one; ids are given anew."""
    def members(t: dict) -> set[str]:
        return {i for part in ("body", "header", "caption") for i in t[f"{part}BlockIds"]}

    def fits(a: dict, b: dict) -> bool:
        p, q = tuple(a["bbox"]), tuple(b["bbox"])
        if b["captionBlockIds"] or shared(p, q) < 0.78 or not -4 <= below(p, q) <= most or abs(p[2] - q[2]) > 24:
            return False
        way, own = (min(p[0], q[0]), p[3], max(p[2], q[2]), q[1]), members(a) | members(b)
        between = [x for x in blocks if x.id not in own and x.box and shared(x.box, way) >= 0.45 and way[1] < (x.box[1] + x.box[3]) / 2 < way[3]]
        return not any(x.kind in ("heading", "caption", "page_header", "page_footer") or x.heading or sentence(x.text, 0) for x in between)

    out: list[dict] = []
    for t in sorted(tables, key=lambda t: (t["bbox"][1], t["bbox"][0])):
        if out and fits(out[-1], t):
            last = out[-1]
            for box in ("bbox", "displayBBox"):
                last[box] = list(union((tuple(last[box]), tuple(t[box]))))
            for part in ("body", "header", "caption", "footnote"):
                for names in (f"{part}BlockIds", f"{part}Texts"):
                    last[names] = list(dict.fromkeys([*last[names], *t[names]]))
        else:
            out.append(dict(t))
    return [t | {"id": f"p{page}_t{k}"} for k, t in enumerate(out, 1)] if len(tables) > 1 else tables


def algorithms(page: int, blocks: list[Block], used: set[str]) -> list[dict]:
    """WIN-11: steps that follow an algorithm's title downwards."""
    out, order = [], sorted((b for b in blocks if b.box), key=lambda b: (b.box[1], b.box[0]))
    for title in order:
        if title.id in used or not title.algorithm_title():
            continue
        bottom, steps = title.box[3], []
        for b in order:
            if b is title or b.id in used or (not steps and b.box[1] < bottom - 6):
                continue
            if (max(0.0, b.box[1] - bottom) if steps else b.box[1] - bottom) > 24:
                break
            if shared(title.box, b.box) < 0.72:
                continue
            if b.algorithm_body():
                steps.append(b)
                bottom = max(bottom, b.box[3])
            elif steps:
                break
        if steps:
            box = union(b.box for b in (title, *steps))
            out.append(_structure(f"p{page}_a{len(out) + 1}", "algorithm", box, box, body=steps, caption=[title]))
            used |= {title.id, *(b.id for b in steps)}
    return out


def detect_page(page: int, raw: list[dict], lines: list[Box], most_gap: float = 34.0) -> list[dict]:
    """TBL-01: the structures of a page, top to bottom."""
    wide = float(raw[0].get("pageWidth") or 0.0) if raw else 0.0
    blocks = [Block(r, wide) for r in raw]
    boxed = [b for b in blocks if b.box]
    found: list[dict] = []
    seen: set[tuple[str, ...]] = set()
    used: set[str] = set()
    titles_of = lambda box: [b for b in boxed if b.table_title() and shared(b.box, box) >= 0.5 and -6 <= below(b.box, box) <= 72]

    def add(body: list[Block], header: list[Block], titles: list[Block], core: Box) -> None:
        box = refine(core, lines)
        if titles:
            box = (box[0], max(box[1], core[1]), box[2], box[3])
        display = union([box, core, *(t.box for t in titles)])
        ids = sorted(b.id for b in body)
        t = _structure(f"p{page}_t{len(found) + 1}", "table", box, display, body=body, header=header, caption=titles)
        found.append(t | {"bodyBlockIds": ids})
        seen.add(tuple(ids))
        used.update(ids, (b.id for b in (*header, *titles)))

    for region in rule_regions(lines, wide):
        for box, _ in split_by_captions(region, blocks):
            inside = sorted((b for b in boxed if b.kind != "caption" and shared(b.box, box) >= 0.45 and box[1] - 6 <= (b.box[1] + b.box[3]) / 2 <= box[3] + 6), key=lambda b: b.box[1])
            if region_is_table(inside) and tuple(sorted(b.id for b in inside)) not in seen:
                own = union(b.box for b in inside)
                add(inside, [], titles_of(own), union((own, box)))
    for cluster in clusters([b for b in boxed if b.seed()]):
        body = grown(cluster, boxed)
        own = union(b.box for b in body)
        if len(body) < 2 or tuple(sorted(b.id for b in body)) in seen:
            continue
        titles = titles_of(own)
        if not titles and figure_labels(body, own):
            continue
        header = sorted((b for b in boxed if b.box[1] < own[1] and shared(b.box, own) >= 0.5 and -4 <= below(b.box, own) <= 28 and b.headerish()), key=lambda b: b.box[1])
        add(body, header, titles, union((own, *(h.box for h in header))))
    found += single_bodies(page, blocks, used)
    tables = merge(page, dedupe(found), blocks, most_gap)
    return sorted(tables + algorithms(page, blocks, used), key=lambda s: (s["bbox"][1], s["bbox"][0]))


# ---------------------------------------------------------------- turned pages


def turned(blocks: list[Block]) -> bool:
    """GEO-11: many tall and narrow blocks: a table that lies on its side."""
    return sum(1 for b in blocks if b.box and b.kind not in ("page_header", "page_footer") and height(b.box) >= 2.2 * max(width(b.box), 1.0) and height(b.box) >= 40) >= 8


def turn(b: Box, region: Box, degrees: int) -> Box:
    """GEO-04: into upright coordinates of a region that is turned."""
    if degrees == 90:
        return (b[1] - region[1], region[2] - b[2], b[3] - region[1], region[2] - b[0])
    return (region[3] - b[3], b[0] - region[0], region[3] - b[1], b[2] - region[0])


def turn_back(b: Box, region: Box, degrees: int) -> Box:
    if degrees == 90:
        return (region[2] - b[3], region[1] + b[0], region[2] - b[1], region[1] + b[2])
    return (region[0] + b[1], region[3] - b[2], region[0] + b[3], region[3] - b[0])


def detect_turned(page: int, raw: list[dict], most_gap: float = 34.0) -> list[dict]:
    """TBL-02, GEO-11: a page without upright tables that lies on its side: detect upright, then map back; else its whole region."""
    blocks = [Block(r) for r in raw]
    tall = [b for b in blocks if b.box and height(b.box) >= 2.2 * max(width(b.box), 1.0) and height(b.box) >= 40]
    if not turned(blocks):
        return []
    region = union(b.box for b in tall)
    inside = [b for b in blocks if b.box and region[0] - 6 <= b.box[0] and b.box[2] <= region[2] + 6 and region[1] - 6 <= b.box[1] and b.box[3] <= region[3] + 6]
    best: list[dict] = []
    for degrees in (90, 270):
        upright = []
        for b in inside:
            fresh = dict(b.raw) | {"bbox": list(turn(b.box, region, degrees)), "pageWidth": height(region), "pageHeight": width(region)}
            fresh["layoutLines"] = [{"bbox": list(turn(tuple(line["bbox"]), region, degrees)) if line.get("bbox") is not None and len(line["bbox"]) == 4 else None, "items": [dict(i) | {"bbox": list(turn(tuple(i["bbox"]), region, degrees))} for i in (line.get("items") if line.get("items") is not None else []) if i.get("bbox") is not None and len(i["bbox"]) == 4]} for line in b.lines]
            upright.append(fresh)
        got = [s for s in detect_page(page, sorted(upright, key=lambda r: (r["bbox"][1], r["bbox"][0])), [], most_gap) if s["kind"] == "table"]
        if len(got) > len(best):
            best = [s | {k: list(turn_back(tuple(s[k]), region, degrees)) for k in ("bbox", "displayBBox")} for s in got]
    if best:
        return best
    return [_structure(f"p{page}_t1", "table", region, region, body=sorted(inside, key=lambda b: (b.box[1], b.box[0])))]


# ---------------------------------------------------------------- Spark

STRUCTURES = "doc {doc}, page int, id string, kind string, bbox array<double>, displayBBox array<double>, " + ", ".join(f"{p}BlockIds array<string>, {p}Texts array<string>" for p in ("body", "header", "caption", "footnote"))


def detect(blocks: DataFrame, rules: DataFrame | None = None, most_gap: float = 34.0) -> DataFrame:
    """TBL-02: structures of all pages of ``blocks`` (doc, page and the columns of ``schemas.BLOCK``).

    ``rules`` has doc, page and bbox of horizontal rules. Blocks go through as JSON, so nested
    columns keep their names; page numbers of rules are integers in both tables.
    """
    names = [c for c in blocks.columns if c not in ("doc", "page")]
    rows = blocks.select("doc", F.col("page").cast("int").alias("page"), F.to_json(F.struct(*names)).alias("block"), F.lit(None).cast("array<double>").alias("rule"))
    if rules is not None:
        rows = rows.unionByName(rules.select("doc", F.col("page").cast("int").alias("page"), F.lit(None).cast("string").alias("block"), F.col("bbox").alias("rule")))

    def run(group: list[dict]) -> list[dict]:
        doc, page = group[0]["doc"], int(group[0]["page"])
        raw = sorted((json.loads(r["block"]) for r in group if r["block"] is not None), key=lambda r: ((r.get("bbox") or [0, 0, 0, 0])[1], (r.get("bbox") or [0, 0, 0, 0])[0], str(r.get("id"))))
        lines = sorted(tuple(map(float, r["rule"])) for r in group if r["rule"] is not None)
        found = detect_page(page, raw, lines, most_gap) if raw else []
        if raw and not any(s["kind"] == "table" for s in found):
            found = sorted(found + detect_turned(page, raw, most_gap), key=lambda s: (s["bbox"][1], s["bbox"][0]))
        return [{"doc": doc, "page": page, **s} for s in found]

    return each(rows.where("page is not null"), ["doc", "page"], [], run, STRUCTURES.format(doc=blocks.schema["doc"].dataType.simpleString()))


#: What can be a number in Python; digits that only newer versions of Unicode know lie beyond the first plane.
_NUMBERS = r"\p{Nd}+|[\x{10000}-\x{10FFFF}]"


def _start() -> Column:
    """A block without which no table begins: a wider test than ``seed`` and ``single_body``, of lengths, numbers and items only."""
    b = F.col("bbox")
    typed = F.coalesce(F.col("blockType").isin("table_body", "table_header"), F.lit(False)) | F.coalesce(F.col("doclingLabel") == "table", F.lit(False))
    items = F.aggregate(F.coalesce(F.col("layoutLines.items"), F.array()), F.lit(0), lambda n, x: n + F.coalesce(F.size(x), F.lit(0)))
    numbers = (b[2] - b[0] >= 180.0) & (F.regexp_count("text", F.lit(_NUMBERS)) >= 6)
    return F.coalesce(F.size("bbox") == 4, F.lit(False)) & (typed | (items >= 6) | F.coalesce(numbers, F.lit(False)))


def _tall() -> Column:
    """A block that ``turned`` counts, margins too."""
    b = F.col("bbox")
    w, h = b[2] - b[0], b[3] - b[1]
    return F.coalesce((F.size("bbox") == 4) & (h >= 2.2 * F.greatest(w, F.lit(1.0))) & (h >= 40.0), F.lit(False))


def may_hold(blocks: DataFrame) -> DataFrame:
    """Adds ``mayHold``: false on pages without rules on which ``detect`` finds no table, whatever else they hold; block types may be set later."""
    page = Window.partitionBy("doc", "page")
    some = F.max(_start()).over(page) | (F.sum(_tall().cast("int")).over(page) >= 8)
    return blocks.withColumn("mayHold", some & F.col("page").isNotNull())


def mark(blocks: DataFrame, structures: DataFrame) -> DataFrame:
    """JOIN-15: bodies and headers of tables become preserved table blocks; captions and notes only get tableId and tableRole."""
    parts = F.array(*(F.struct(F.lit(role).alias("_role"), F.col(f"{part}BlockIds").alias("_ids")) for part, role in (("body", "table_body"), ("header", "table_header"), ("caption", "table_caption"), ("footnote", "table_footnote"))))
    ids = structures.where("kind = 'table'").select("doc", F.col("id").alias("_table"), F.inline(parts)).select("doc", "_table", "_role", F.explode("_ids").alias("id"))
    first = ids.groupBy("doc", "id").agg(F.min(F.struct("_table", "_role")).alias("_m"))
    joined = blocks.join(first, ["doc", "id"], "left")
    taken = F.coalesce(F.col("_m._role").isin("table_body", "table_header"), F.lit(False))
    return joined.withColumns({
        "blockType": F.when(taken, F.col("_m._role")).otherwise(F.col("blockType")), "preserveOriginal": taken | F.coalesce(F.col("preserveOriginal"), F.lit(False)),
        "role": F.when(taken, "preserved").otherwise(F.col("role")), "preserveReason": F.when(taken, F.col("_m._role")).otherwise(F.col("preserveReason")),
        "tableId": F.col("_m._table"), "tableRole": F.col("_m._role"),
    }).drop("_m")
