"""Chapters of a book: text metrics, the structural verdict, links between chapters, tables of contents."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from papyrion.functions import text
from papyrion.sources import html as dom

#: Titles of chapters that never count as structural.
EXEMPT = r"(?i)toc|table\s+of\s+contents|contents?|copyright|title\s*page|cover|dedication|acknowledg|preface|foreword|index|bibliograph|about\s+the\s+author|reviews?"


def metrics(chapters: DataFrame, key: str) -> DataFrame:
    """AGG-07: (key, body, explicit_nodes, explicit_chars, structural_nodes, structural_chars), counts of text lengths."""
    explicit = dom.explode(chapters, key, dom.explicit)
    judged = text.classify_node(F.col("tag"), F.col("text"), F.col("content"), F.lit(None).cast("string"), F.lit(False))
    explicit = explicit.where("id <> ''").withColumn("_c", judged).where(~text.bypass(F.col("_c")))
    e = explicit.groupBy(key).agg(F.count("*").alias("explicit_nodes"), F.sum(F.length("text")).alias("explicit_chars"))
    s = dom.explode(chapters, key, dom.structural_body).where("id <> ''").groupBy(key).agg(F.count("*").alias("structural_nodes"), F.sum(F.length("text")).alias("structural_chars"))
    whole = dom.explode(chapters, key, _body).select(key, F.length("text").alias("body"))
    zero = ["explicit_nodes", "explicit_chars", "structural_nodes", "structural_chars"]
    return whole.join(e, key, "left").join(s, key, "left").na.fill(0, zero)


def _body(root: dom.Node) -> list[tuple[str, int, dom.Node, str]]:
    return [("body", 0, dom.body(root), "")]


def fallback() -> Column:
    """FLT-11: explicit nodes hold too little of the body."""
    few = (F.col("explicit_nodes") <= 2) & (F.col("explicit_chars") < F.col("body") * 0.35)
    return (F.col("body") >= 80) & ((F.col("explicit_nodes") == 0) | (F.col("explicit_chars") == 0) | few | (F.col("explicit_chars") < F.col("body") * 0.25))


def exempt(title: Column) -> Column:
    """FLT-12."""
    named = F.trim(F.coalesce(title, F.lit(""))).rlike(EXEMPT)
    return named | (F.col("body") < 500) | ((F.col("structural_nodes") <= 1) & (F.col("body") < 1200))


def verdict(measured: DataFrame, book: str) -> DataFrame:
    """AGG-08: adds fallback, strong, enabled (of the book) and prefer_structural; chapters with less than 80 characters are not analysed."""
    rows = measured.where("body >= 80").withColumn("fallback", fallback())
    rows = rows.withColumn("strong", (F.col("explicit_nodes") <= 2) & (F.col("structural_nodes") >= 3) & (F.col("structural_chars") >= F.col("body") * 0.45))
    books = rows.groupBy(book).agg(F.count("*").alias("chapters"), F.count_if("fallback").alias("fallbacks"), F.count_if("strong").alias("strongs"))
    on = (F.col("fallbacks") >= F.greatest(F.lit(3), F.ceil(F.col("chapters") * 0.45))) | (F.col("strongs") >= F.greatest(F.lit(2), F.ceil(F.col("chapters") * 0.35)))
    joined = rows.join(books.withColumn("enabled", on), book)
    title = F.col("title") if "title" in measured.columns else F.lit("")
    return joined.withColumn("prefer_structural", F.col("enabled") & F.col("fallback") & ~exempt(title))


def normalize_href(href: Column) -> Column:
    """JOIN-02: decoded, without anchor and leading ./, lower case; a plus stays a plus."""
    plain = F.regexp_replace(F.coalesce(href, F.lit("")), r"\+", "%2B")
    decoded = F.coalesce(F.try_url_decode(plain), F.coalesce(href, F.lit("")))
    out = F.regexp_replace(F.split_part(decoded, F.lit("#"), F.lit(1)), r"^\./", "")
    return F.trim(F.lower(F.replace(out, F.lit("\\"), F.lit("/"))))


def find_chapters(links: DataFrame, chapters: DataFrame, key: str) -> DataFrame:
    """JOIN-02: the chapter that a link's file names: equal, or one ends with ``/`` and the other; exact before first in order.

    ``links`` has key, ord and file, ``chapters`` key, chapter, ord and href. Endings are equal
    joins on the parts behind each slash, so no pair of a book's links and chapters is tried.
    """
    tails = lambda name: F.array_distinct(F.transform(F.sequence(F.lit(1), F.size(F.split(name, "/"))), lambda n: F.array_join(F.slice(F.split(name, "/"), F.size(F.split(name, "/")) - n + 1, n), "/")))
    left = links.select(key, F.col("ord").alias("link"), normalize_href(F.col("file")).alias("want")).where("want <> ''")
    latest = Window.partitionBy(key, "have").orderBy(F.col("place").desc())
    right = chapters.select(key, "chapter", F.col("ord").alias("place"), normalize_href(F.col("href")).alias("have")).where("have <> ''").withColumn("_r", F.row_number().over(latest)).where("_r = 1").drop("_r")
    longer = right.withColumn("want", F.explode(tails(F.col("have"))))
    shorter = left.withColumn("have", F.explode(tails(F.col("want"))))
    hits = left.join(longer, [key, "want"]).select(key, "link", "want", "chapter", "place", "have").unionByName(shorter.join(right, [key, "have"]).select(key, "link", "want", "chapter", "place", "have"))
    best = hits.groupBy(key, "link").agg(F.min_by("chapter", F.struct((F.col("want") != F.col("have")).alias("a"), "place")).alias("chapter"))
    return best


def anchor_titles(links: DataFrame, chapters: DataFrame, key: str) -> DataFrame:
    """JOIN-03: adds the title that a link's target has; ``links`` has key, chapter and anchor, ``chapters`` key, chapter and html."""
    joined = links.join(chapters.select(key, "chapter", "html"), [key, "chapter"], "left")
    wanted = joined.groupBy(key, "chapter").agg(F.first("html").alias("html"), F.collect_set(F.coalesce("anchor", F.lit(""))).alias("anchors"))
    kinds = ", ".join(f"{c} {wanted.schema[c].dataType.simpleString()}" for c in (key, "chapter"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                root = dom.parse(row["html"])
                out += [{key: row[key], "chapter": row["chapter"], "_anchor": a, "title": dom.anchor_title(root, a or None)} for a in row["anchors"]]
            schema = pa.schema([batch.schema.field(0), batch.schema.field(1), ("_anchor", pa.string()), ("title", pa.string())])
            yield pa.RecordBatch.from_pylist(out, schema=schema)

    titles = wanted.mapInArrow(run, f"{kinds}, _anchor string, title string")
    return links.withColumn("_anchor", F.coalesce("anchor", F.lit(""))).join(titles, [key, "chapter", "_anchor"], "left").drop("_anchor")


def sync_contents(chapters: DataFrame, contents: DataFrame, key: str) -> DataFrame:
    """JOIN-04: (key, link, chapter, title) for links of a contents chapter to others: new texts of its links or navigation points."""
    toc = contents.select(key, F.col("chapter").alias("_toc"), "html")
    found = dom.links(toc, key)
    where = find_chapters(found, chapters, key)
    rows = found.select(key, F.col("ord").alias("link"), "anchor").join(where, [key, "link"]).join(toc.select(key, "_toc"), key).where("chapter <> _toc").drop("_toc")
    return anchor_titles(rows, chapters, key).where("title is not null")


def glossary_text(pages: DataFrame, key: str) -> DataFrame:
    """SRC-04: (key, html): the contents of a page's visible elements in order, which is what terms are mined from."""
    nodes = dom.explode(pages, key, dom.visible_body).where("id <> ''")
    rows = F.array_sort(F.collect_list(F.struct("ord", "content")))
    return nodes.groupBy(key).agg(F.array_join(F.transform(rows, lambda r: r["content"]), " ").alias("html"))
