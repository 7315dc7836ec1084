"""Table regions by score, figure labels, and what is written of blocks for inspection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from papyrion.functions import geom
from papyrion.functions.text import count, escape_html, normalize
from papyrion.operators import grouped, inline, layout

#: The least score of a table; weights and what they are counted up to.
LEAST_SCORE = 6.0
WEIGHTS = (("lines", 1.3, 8), ("tableish", 1.2, 8), ("short", 0.35, 10), ("numeric", 0.35, 8), ("captions", 3.0, 1))
TABLE_CAPTION = r"(?i)^table\s+\d+[.:]?\s+"
FIGURE_CAPTION = r"(?i)^(?:figure|fig\.)\s+\d+[.:]?\s+|^图\s*\d+[：:.\s]"
#: SNK-10: columns of a block that are written for inspection.
DEBUG = ("id", "page", "role", "preserveOriginal", "preserveReason", "fontSize", "bbox", "text", "translatedText", "translationMetaNote")


def _named(frame: DataFrame, name: str) -> DataFrame:
    return frame.withColumnRenamed("bbox", name)


def scores(candidates: DataFrame, blocks: DataFrame, rules: DataFrame | None = None, key: tuple[str, ...] = ("doc", "page"), extra: tuple[str, ...] = ()) -> DataFrame:
    """AGG-21: (key, extra, bbox, score): how much a candidate region (key, extra, bbox) looks like a table.

    Counts are of the blocks that meet the region: rule lines, table-like, short and number-rich texts, captions,
    distinct rows and columns; prose counts against it. ``rules`` are level segments (key, x0, y, x1).
    """
    t = normalize("text")
    has = lambda c: F.count(F.when((F.col("_t") != "") & c, 1))
    shaped = blocks.select(*key, "bbox", F.coalesce("pageWidth", F.lit(1.0)).alias("_page"), t.alias("_t"), layout.tableish("text").alias("_tableish"))
    met = _named(candidates, "_region").join(_named(shaped, "_box"), list(key)).where(geom.intersects(F.col("_box"), F.col("_region")))
    box, region = F.col("_box"), F.col("_region")
    prose = (F.length("_t") >= 70) & F.col("_t").rlike("[，。；：.!?]")
    found = met.groupBy(*key, *extra, "_region").agg(
        F.count("*").alias("blocks"), has(F.lit(True)).alias("filled"), has(F.length("_t") <= 24).alias("short"), has(F.col("_tableish")).alias("tableish"), has(F.col("_t").rlike(TABLE_CAPTION)).alias("captions"),
        has(count(F.col("_t"), r"\d") >= 2).alias("numeric"), has(prose).alias("prose"), F.max("_page").alias("_page"),
        F.countDistinct(F.when(F.col("_t") != "", F.bround((box[1] + box[3]) / 2, 0))).alias("rows"), F.countDistinct(F.when(F.col("_t") != "", F.bround(box[0] / 12, 0))).alias("columns"),
    )
    if rules is None:
        found = found.withColumn("lines", F.lit(0))
    else:
        near = (F.col("x0") >= region[0] - 8) & (F.col("x1") <= region[2] + 8) & F.col("y").between(region[1] - 8, region[3] + 8)
        hits = _named(candidates, "_region").join(rules.select(*key, "x0", "y", "x1"), list(key)).where(near).groupBy(*key, *extra, "_region").agg(F.count("*").alias("lines"))
        found = found.join(hits, [*key, *extra, "_region"], "left").withColumn("lines", F.coalesce("lines", F.lit(0)))
    score = sum((F.least(F.col(name), F.lit(most)) * weight for name, weight, most in WEIGHTS), F.lit(0.0))
    bonus = lambda c, value: F.when(c, F.lit(value)).otherwise(0.0)
    score = score + bonus(F.col("rows") >= 4, 2.0) + bonus(F.col("columns") >= 3, 2.0) + bonus(F.col("blocks") >= 6, 1.0) - F.col("prose") * 2.2
    wide = (region[2] - region[0]) / F.greatest(F.col("_page"), F.lit(1.0)) > 0.85
    score = score - bonus(wide & (F.col("prose") >= 2), 2.5)
    return found.select(*key, *extra, region.alias("bbox"), F.when(F.col("filled") > 0, score).otherwise(0.0).alias("score"))


def _absorb(rows: list[dict]) -> list[dict]:
    """Regions of one page, in falling order of score."""
    taken: list[dict] = []
    for row in rows:
        a = row["bbox"]
        host = next((t for t in taken if a[0] < t["bbox"][2] and t["bbox"][0] < a[2] and a[1] < t["bbox"][3] and t["bbox"][1] < a[3]), None)
        if host is None:
            taken.append({**row, "region": len(taken), "bbox": list(a)})
        else:
            b = host["bbox"]
            host["bbox"] = [min(a[0], b[0]), min(a[1], b[1]), max(a[2], b[2]), max(a[3], b[3])]
    return taken


def merged(scored: DataFrame, key: tuple[str, ...] = ("doc", "page"), least: float = LEAST_SCORE) -> DataFrame:
    """TOP-06: (key, region, bbox, score): by falling score, a region joins the first accepted one that it meets; the candidates of one page are held."""
    rows = scored.where(F.col("score") >= least).select(*key, "bbox", "score", (-F.col("score")).alias("_order"), F.col("bbox")[1].alias("_top"), F.col("bbox")[0].alias("_left"))
    kinds = ", ".join(f"{k} {scored.schema[k].dataType.simpleString()}" for k in key)
    return grouped.each(rows, list(key), ["_order", "_top", "_left"], _strip(key), f"{kinds}, region int, bbox array<double>, score double")


def _strip(key: tuple[str, ...]):
    def run(rows: list[dict]) -> list[dict]:
        return [{k: r[k] for k in (*key, "region", "bbox", "score")} for r in _absorb(rows)]

    return run


def figure_labels(blocks: DataFrame, page_body_size: Column, key: tuple[str, ...] = ("doc", "page")) -> DataFrame:
    """JOIN-11: (key, id) of labels that belong to a figure above its caption.

    Labels end above the caption, in a window of 28 % of the page's height (220 at most), near its width. With four
    anchors among them (in a picture, or turned) those within 16 of the box around the anchors stay.
    """
    b = blocks.withColumn("_label", layout.figure_label(page_body_size)).withColumn("_anchor", (F.coalesce("doclingLabel", F.lit("")) == "picture") | (F.abs(F.coalesce("rotation", F.lit(0))) > 0))
    captions = blocks.where(normalize("text").rlike(FIGURE_CAPTION)).select(*key, F.col("id").alias("_caption"), F.col("bbox").alias("_c"), F.coalesce("pageHeight", F.lit(0.0)).alias("_h"), F.coalesce("pageWidth", F.lit(0.0)).alias("_w"))
    c, box = F.col("_c"), F.col("bbox")
    window = F.array(F.greatest(c[0] - 40, F.lit(0.0)), F.greatest(c[1] - F.least(F.col("_h") * 0.28, F.lit(220.0)), F.lit(0.0)), F.least(F.col("_w"), c[2] + 40), F.greatest(c[1] - 4, F.lit(0.0)))
    near = (F.col("id") != F.col("_caption")) & geom.intersects(box, window) & (box[2] >= c[0] - 48) & (box[0] <= c[2] + 48) & (box[3] <= c[1] - 2)
    found = b.where("_label").join(captions, list(key)).where(near).select(*key, "id", "bbox", "_anchor", "_caption")
    around = found.where("_anchor").groupBy(*key, "_caption").agg(geom.union(box).alias("_around"), F.count("*").alias("_n")).where("_n >= 4")
    kept = found.join(around, [*key, "_caption"]).where(geom.intersects(box, geom.expand(F.col("_around"), 16.0)))
    return kept.select(*key, "id").distinct()


def debug_columns(blocks: DataFrame, key: tuple[str, ...] = ("doc",)) -> DataFrame:
    """SNK-10: what is written of blocks for inspection; flags that are not set are false."""
    value = lambda c: F.coalesce(F.col(c), F.lit(False)).alias(c) if c == "preserveOriginal" else F.col(c)
    return blocks.select(*key, *map(value, DEBUG))


def to_markup(blocks: DataFrame, key: str = "doc", title: Column | None = None) -> DataFrame:
    """SNK-05: (key, html): a document of the blocks that are translated, in order: headings and paragraphs that name their block and page.

    Code in monospace, what is preserved and references are left out; formulas become placeholders.
    """
    code = inline.monospace() >= 0.95
    left_out = F.coalesce("preserveOriginal", F.lit(False)) | F.coalesce(code, F.lit(False)) | (F.coalesce("blockType", F.lit("")) == "reference_block") | (F.coalesce("doclingLabel", F.lit("")) == "reference")
    tag = F.when(F.col("role") == "heading", "h2").otherwise("p")
    body = inline.protect_formulas(escape_html(F.coalesce("text", F.lit(""))))["html"]
    element = F.concat(F.lit("<"), tag, F.lit(' data-pdf-block-id="'), escape_html("id"), F.lit('" data-page="'), F.col("page").cast("string"), F.lit('">'), body, F.lit("</"), tag, F.lit(">"))
    order = F.struct("page", F.col("bbox")[1].alias("y"), F.col("bbox")[0].alias("x"), "id", element.alias("e"))
    rows = blocks.where(~left_out).groupBy(key).agg(F.sort_array(F.collect_list(order)).alias("rows"))
    head = F.coalesce(title if title is not None else F.lit(None), F.lit("PDF Document"))
    top = F.concat(F.lit('<!DOCTYPE html>\n<html xmlns="http://www.w3.org/1999/xhtml">\n<head><title>'), escape_html(head), F.lit("</title></head>\n<body>\n"))
    return rows.select(key, F.concat(top, F.array_join(F.transform("rows", lambda r: r["e"]), "\n"), F.lit("\n</body>\n</html>")).alias("html"))
