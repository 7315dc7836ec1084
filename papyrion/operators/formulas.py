"""Formulas inside of texts: markup of lines with placeholders, texts and style runs that come back, mixed tokens, and the items that placeholders stand for."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from papyrion.functions.text import escape_html, normalize
from papyrion.operators.inline import PLACEHOLDER, tokens
from papyrion.sources import html as dom

FORMULA, KEPT, STYLE = "data-inline-formula", "data-inline-preserve", "data-style-marker"


def line_markup(lines: Column) -> Column:
    """STR-12: struct(html, placeholders) of a block's lines: formula items and monospace items become elements that
    name a placeholder, numbered together; null where there is none. Placeholders keep text, box, the line's box, font and kind."""
    filled = lambda line: F.filter(F.coalesce(line["items"], F.lit(None)), lambda i: F.coalesce(i["text"], F.lit("")) != "")
    slim = lambda line, at: F.transform(filled(line), lambda i: F.struct(
        at.alias("line"), i["text"].alias("text"), i["bbox"].alias("bbox"), line["bbox"].alias("lineBBox"), F.coalesce(i["font"], F.lit("")).alias("font"),
        F.when(i["type"] == "formula", "formula").when(F.coalesce(i["isMonospaceLike"], F.lit(False)), "preserve").otherwise("text").alias("kind"),
    ))
    items = F.flatten(F.filter(F.transform(lines, slim), lambda part: part.isNotNull()))
    guarded = F.filter(items, lambda i: i["kind"] != "text")
    key = lambda i, n: F.concat(F.lit("@@INLINE_"), F.upper(i["kind"]), F.lit("_"), (n + 1).cast("string"), F.lit("@@"))
    start = F.struct(F.lit("").alias("html"), F.lit(0).alias("n"), F.lit(-1).alias("line"))

    def step(state: Column, i: Column) -> Column:
        text = escape_html(i["text"])
        element = F.concat(F.lit("<span data-inline-"), i["kind"], F.lit('="'), key(i, state["n"]), F.lit('" translate="no">'), text, F.lit("</span>"))
        plain = i["kind"] == "text"
        gap = F.when((state["line"] >= 0) & (state["line"] != i["line"]), " ").otherwise("")
        return F.struct(F.concat(state["html"], gap, F.when(plain, text).otherwise(element)).alias("html"), (state["n"] + F.when(plain, 0).otherwise(1)).alias("n"), i["line"].alias("line"))

    body = F.aggregate(items, start, step, lambda state: state["html"])
    pairs = F.transform(guarded, lambda i, n: F.struct(key(i, n).alias("key"), F.struct(i["text"].alias("text"), i["bbox"].alias("bbox"), i["lineBBox"].alias("lineBBox"), i["font"].alias("font"), i["kind"].alias("kind")).alias("value")))
    return F.when(F.size(guarded) > 0, F.struct(body.alias("html"), F.map_from_entries(pairs).alias("placeholders")))


def styled(node: dom.Node) -> tuple[str, list[tuple[str, int, int]]]:
    """Text of an answer with placeholders in place of their elements, and (marker, start, end) of what stands in style elements."""
    text, runs = "", []
    stack: list[tuple[dom.Node | str, str]] = [(node, "")]
    while stack:
        item, marker = stack.pop()
        attrs = {} if isinstance(item, str) else item.attrs
        added = item if isinstance(item, str) else attrs.get(FORMULA) or attrs.get(KEPT) or ""
        if added:
            if marker and runs and runs[-1][0] == marker and runs[-1][2] == len(text):
                runs[-1] = (marker, runs[-1][1], len(text) + len(added))
            elif marker:
                runs.append((marker, len(text), len(text) + len(added)))
            text += added
        elif not isinstance(item, str):
            inside = attrs.get(STYLE) or marker
            stack.extend((child, inside) for child in item.children[::-1])
    return text, runs


def answered(rows: DataFrame, key: str, html: str = "html") -> DataFrame:
    """STR-13: (key, text, runs) of translated markup: its text with placeholders, and the stretches that each style marker covers."""
    kind = rows.schema[key].dataType.simpleString()
    runs = pa.list_(pa.struct([("marker", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [styled(dom.parse(text, xml=True)) for text in batch.column(1).to_pylist()]
            parts = [[{"marker": m, "start": a, "end": b} for m, a, b in some] for _, some in found]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([t for t, _ in found], pa.string()), pa.array(parts, runs)], names=["key", "text", "runs"])

    out = rows.select(F.col(key).alias("key"), F.col(html).alias("html")).mapInArrow(run, f"key {kind}, text string, runs array<struct<marker:string,start:int,end:int>>")
    return out.withColumnRenamed("key", key)


def mixed_tokens(text: Column, widths: Column) -> Column:
    """EXP-11: tokens of a text as (kind, text, width): placeholders with the width that a map has for them, words without one."""
    keys, parts = F.regexp_extract_all(text, F.lit(f"({PLACEHOLDER})"), F.lit(1)), F.split(text, PLACEHOLDER, -1)
    plain = lambda p: F.transform(tokens(p), lambda t: F.struct(F.lit("text").alias("kind"), t.alias("text"), F.lit(None).cast("double").alias("width")))
    held = lambda k: F.array(F.struct(F.lit("formula").alias("kind"), k.alias("text"), F.element_at(widths, k).cast("double").alias("width")))
    return F.flatten(F.transform(parts, lambda p, i: F.when(i < F.size(keys), F.concat(plain(p), held(F.get(keys, i)))).otherwise(plain(p))))


def matched_items(placeholders: DataFrame, items: DataFrame, key: tuple[str, ...] = ("doc", "id")) -> DataFrame:
    """JOIN-21: (key, name, item): the first formula item (key, item, bbox, text) that a placeholder (key, name, bbox, text) stands for: its box within 0.8, or the same text that begins within 2."""
    a = placeholders.select(*key, "name", F.col("bbox").alias("p"), normalize("text").alias("pt"))
    b = items.select(*key, "item", F.col("bbox").alias("q"), normalize("text").alias("qt"))
    off = lambda k: F.abs(F.col("p")[k] - F.col("q")[k])
    box = (off(0) <= 0.8) & (off(1) <= 0.8) & (off(2) <= 0.8) & (off(3) <= 0.8)
    same = (F.col("pt") != "") & (F.col("pt") == F.col("qt")) & (off(0) <= 2.0) & (off(1) <= 2.0)
    return a.join(b, list(key)).where((F.size("p") == 4) & (F.size("q") == 4) & (box | same)).groupBy(*key, "name").agg(F.min("item").alias("item"))
