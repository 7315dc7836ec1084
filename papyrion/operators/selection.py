"""Selecting pages and chapters, ordering by a plan, leaving out what is done."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from papyrion.functions.text import normalize

_QUOTES = {'"': '"', "'": "'", "“": "”", "‘": "’"}


def parse_pages(spec: str | None) -> list[int] | None:
    """FLT-33: ``1,3-5`` to sorted distinct numbers; None selects all."""
    if spec is None or spec == "":
        return None
    if not spec.strip():
        raise ValueError("no page selector was given")
    pages: set[int] = set()
    for part in (p.strip() for p in spec.split(",")):
        m = re.fullmatch(r"(\d+)(?:\s*-\s*(\d+))?", part)
        if not m:
            raise ValueError(f"not a page selector: {part!r}")
        first, last = int(m[1]), int(m[2] or m[1])
        if first < 1 or first > last:
            raise ValueError(f"not a page range: {part!r}")
        pages |= set(range(first, last + 1))
    return sorted(pages)


def select_pages(rows: DataFrame, spec: str | None, page: str = "page") -> DataFrame:
    """The rows of selected pages; runs of numbers are ranges, so the filter reaches the scan."""
    pages = parse_pages(spec)
    if pages is None:
        return rows
    test, start = F.lit(False), None
    for p, after in zip(pages, [*pages[1:], None], strict=True):
        start = p if start is None else start
        if after != p + 1:
            test, start = test | F.col(page).between(start, p), None
    return rows.where(test)


def _split(spec: str) -> list[str]:
    """Parts between commas outside of quotes."""
    parts, held, closing = [], "", None
    for c in spec:
        if closing is None and c == ",":
            parts.append(held)
            held = ""
            continue
        if closing is None and c in _QUOTES and not held.strip().rstrip("-").strip():
            closing = _QUOTES[c]
        elif closing is None and c in _QUOTES and held.rstrip().endswith("-"):
            closing = _QUOTES[c]
        elif c == closing:
            closing = None
        held += c
    return [p for p in [*parts, held]]


def parse_chapters(spec: str) -> list[tuple[str, str, str]]:
    """FLT-34: parts as (kind, from, to); kind is index or title."""
    out = []
    quoted = r"(?:\"([^\"]*)\"|'([^']*)'|“([^”]*)”|‘([^’]*)’)"
    for part in (p.strip() for p in _split(spec)):
        if not part:
            raise ValueError("empty chapter selector")
        if m := re.fullmatch(r"(\d+)(?:\s*-\s*(\d+))?", part):
            out.append(("index", m[1], m[2] or m[1]))
        elif m := re.fullmatch(rf"{quoted}\s*-\s*{quoted}", part):
            first, last = ([g for g in m.groups()[k : k + 4] if g is not None][0] for k in (0, 4))
            out.append(("title", first, last))
        else:
            m = re.fullmatch(quoted, part)
            title = next(g for g in m.groups() if g is not None) if m else part
            out.append(("title", title, title))
    return out


def select_chapters(chapters: DataFrame, spec: str | None, order: str = "ord", title: str = "title") -> DataFrame:
    """FLT-34: chapters by place (from 1), ranges of places in any direction, titles and ranges of titles; the order stays.

    Places are numbers of rows in ``order``. A title has to name one chapter. A title's place is
    looked up on the cluster; only the few places asked for come to the driver.
    """
    if not spec:
        return chapters
    placed = chapters.withColumn("_place", F.row_number().over(Window.orderBy(order)))
    parts = parse_chapters(spec)
    titles = sorted({t for kind, *ends in parts for t in ends if kind == "title"})
    n = chapters.count()
    where = {}
    for wanted in titles:
        hits = placed.where(F.lower(normalize(title)) == F.lower(normalize(F.lit(wanted)))).select("_place").limit(2).collect()
        if len(hits) != 1:
            raise ValueError(f"chapter title {'not found' if not hits else 'is ambiguous'}: {wanted!r}")
        where[wanted] = hits[0][0]
    test = F.lit(False)
    for kind, a, b in parts:
        first, last = sorted((int(a), int(b)) if kind == "index" else (where[a], where[b]))
        if first < 1 or last > n:
            raise ValueError(f"chapter out of range: {a}-{b} (available: 1-{n})")
        test = test | F.col("_place").between(first, last)
    return placed.where(test).drop("_place")


def plan_order(chapters: DataFrame, plan: DataFrame, key: str = "book", chapter: str = "chapter", ordinal: str = "ord") -> DataFrame:
    """JOIN-18: (key, chapter, place): chapters in the plan's order (first mention counts, unknown ones are passed over), then the rest as they were.

    ``chapters`` has key, chapter and ordinal; ``plan`` key, chapter and pos.
    """
    mentioned = plan.groupBy(key, chapter).agg(F.min("pos").alias("pos"))
    placed = chapters.select(key, chapter, ordinal).join(mentioned, [key, chapter], "left")
    order = Window.partitionBy(key).orderBy(F.col("pos").isNull(), "pos", ordinal)
    return placed.select(key, chapter, F.row_number().over(order).alias("place"))


def unfinished(rows: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """JOIN-19: rows without a finished counterpart."""
    return rows.join(done.select(key).distinct(), key, "left_anti")
