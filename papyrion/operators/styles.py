"""Styles of blocks: colours, font names, and drop caps with the blocks that they open."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from papyrion.functions.text import normalize
from papyrion.operators import grouped, layout

#: Names of fonts by family and style.
FONTS = {
    "cour": dict.fromkeys(("normal", "bold", "italic", "bold_italic", "monospace"), "cour"),
    "helv": {"normal": "helv", "monospace": "helv", "bold": "hebo", "italic": "heit", "bold_italic": "hebi"},
    "times": {"normal": "Times-Roman", "monospace": "cour", "bold": "Times-Bold", "italic": "Times-Italic", "bold_italic": "Times-BoldItalic"},
}


def font_name(family: Column, style: Column, bold: Column) -> Column:
    """PRJ-05: the font of a Latin family (times, where it is another) in a style; plain text of a bold block is bold."""
    known = F.when(F.lower(family).isin("cour", "helv"), F.lower(family)).otherwise("times")
    wanted = F.when(style.isin("bold", "italic", "bold_italic", "monospace"), style).otherwise("normal")
    plain = (wanted == "normal") | ((known == "helv") & (wanted == "monospace"))
    wanted = F.when(plain & bold, "bold").otherwise(wanted)
    return F.coalesce(*(F.when((known == f) & (wanted == s), name) for f, styles in FONTS.items() for s, name in styles.items()))


def primary_colors(blocks: DataFrame, key: tuple[str, ...] = ("doc", "id")) -> DataFrame:
    """PRJ-04: (key, color): the colour that most characters of a block have, the first of equals; black where there is no text."""
    lines = F.coalesce("layoutLines", F.array().cast(blocks.schema["layoutLines"].dataType))
    items = F.flatten(F.transform(lines, lambda line: F.coalesce(line["items"], F.lit(None))))
    rows = blocks.select(*key, F.posexplode(F.filter(items, lambda i: (i["type"] == "text") & (normalize(i["text"]) != ""))).alias("at", "i"))
    color = F.transform(F.coalesce("i.color", F.array(F.lit(0.0), F.lit(0.0), F.lit(0.0))), lambda v: F.round(v, 6))
    weighed = rows.groupBy(*key, color.alias("color")).agg(F.sum(F.length(normalize("i.text"))).alias("n"), F.min("at").alias("at"))
    best = weighed.groupBy(*key).agg(F.max_by("color", F.struct("n", -F.col("at"))).alias("color"))
    return blocks.select(*key).join(best, list(key), "left").withColumn("color", F.coalesce("color", F.array(F.lit(0.0), F.lit(0.0), F.lit(0.0))))


def drop_cap_hosts(blocks: DataFrame, page_body_size: Column, key: tuple[str, ...] = ("doc", "page")) -> DataFrame:
    """JOIN-08: (key, id, host, anchorTop, score): drop caps, in reading order, with the best body block beside them that has none yet.

    Lines that the cap reaches down to count 8 each, 10 more if they start to its right, those that go on below it 3;
    what lies between cap and host counts against it. Candidates of a page are scored in a join, then taken in order.
    """
    base = F.coalesce(page_body_size, F.lit(0.0))
    caps = blocks.where(layout.drop_cap(page_body_size)).select(*key, "id", F.col("bbox").alias("_d"), base.alias("_base"))
    body = (F.coalesce("blockType", F.lit("")) == "body") & ~F.coalesce("preserveOriginal", F.lit(False)) & (F.length(normalize("text")) >= 32) & (F.size("bbox") == 4)
    early = F.slice(F.filter(F.transform("layoutLines", lambda line: line["bbox"]), lambda b: b.isNotNull() & (F.size(b) == 4)), 1, 3)
    hosts = blocks.where(body).select(*key, F.col("id").alias("host"), F.col("bbox").alias("_h"), early.alias("_lines"))
    d, h, size = F.col("_d"), F.col("_h"), F.col("_base")
    pairs = caps.join(hosts, list(key)).where((F.col("id") != F.col("host")) & (h[2] > d[2]) & (F.least(d[3], h[3]) - F.greatest(d[1], h[1]) > F.greatest(size * 0.6, F.lit(6.0))))
    slack = F.greatest(size * 0.35, F.lit(4.0))
    reached = F.filter("_lines", lambda b: F.least(b[3], d[3]) - F.greatest(b[1], d[1]) > F.greatest(size * 0.4, F.lit(4.0)))
    pairs = pairs.withColumn("_reached", reached).withColumn("_right", F.filter("_reached", lambda b: b[0] >= d[2] - slack))
    below = F.filter("_lines", lambda b: (F.least(b[3], d[3]) - F.greatest(b[1], d[1]) <= F.greatest(size * 0.4, F.lit(4.0))) & (b[1] >= d[3] - slack))
    left = F.array_min(F.transform("_lines", lambda b: b[0]))
    score = F.size("_reached") * 8.0 + F.size("_right") * 10.0 + F.size(below) * 3.0 - F.greatest(h[0] - d[2], F.lit(0.0)) - F.abs(h[1] - d[1]) * 0.45 - F.abs(left - d[2]) * 0.35
    scored = pairs.where(F.size("_right") > 0).select(*key, "id", "host", F.array_min(F.transform("_right", lambda b: b[1])).alias("anchorTop"), score.alias("score"), d[1].alias("y"), d[0].alias("x"), (-score).alias("worse"), h[1].alias("hy"), h[0].alias("hx"))

    def run(rows: list[dict]) -> list[dict]:
        taken: dict[str, dict] = {}
        used: set[str] = set()
        for r in rows:
            if r["id"] not in taken and r["host"] not in used:
                taken[r["id"]] = {k: r[k] for k in (*key, "id", "host", "anchorTop", "score")}
                used.add(r["host"])
        return list(taken.values())

    kinds = ", ".join(f"{k} {blocks.schema[k].dataType.simpleString()}" for k in key)
    return grouped.each(scored, list(key), ["y", "x", "id", "worse", "hy", "hx"], run, f"{kinds}, id string, host string, anchorTop double, score double")
