"""Geometry of pages, table regions and decisions on single blocks; ``lineitem`` lends boxes, ``documents`` texts."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from papyrion.functions import geom, text
from papyrion.operators import inline, layout, regions, repair
from papyrion.queries.layout import _BLOCKS, blocks
from papyrion.registry import query, table
from papyrion.runtime import ensure_checkpoint_dir
from papyrion.sinks import epub as html_sink
from papyrion.sources import epub

#: Two boxes of each line item: a small one and one that is moved by its discount and tax.
_PAIRS = """
p as (select l_orderkey as doc, l_linenumber as pos, (l_partkey % 400)::double as ax0, (l_suppkey % 500)::double as ay0, (l_partkey % 400 + l_quantity * 3)::double as ax1, (l_suppkey % 500 + l_quantity)::double as ay1,
    (l_partkey % 400 + l_linenumber * 9 - 20)::double as bx0, (l_suppkey % 500 + l_linenumber * 4 - 10)::double as by0, (l_partkey % 400 + 90)::double as bx1, (l_suppkey % 500 + 30)::double as by1 from lineitem)
"""


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    x, y, q, k = F.col("l_partkey") % 400, F.col("l_suppkey") % 500, F.col("l_quantity").cast("double"), F.col("l_linenumber")
    box = lambda *c: F.array(*(v.cast("double") for v in c))
    return li.select(F.col("l_orderkey").alias("doc"), k.alias("pos"), box(x, y, x + q * 3, y + q).alias("a"), box(x + k * 9 - 20, y + k * 4 - 10, x + 90, y + 30).alias("b"))


@query(f"""
with {_PAIRS}, o as (select *, greatest(least(ax1, bx1) - greatest(ax0, bx0), 0) as ox from p)
select doc, count(*) as n, round(sum(ox / greatest(least(ax1 - ax0, bx1 - bx0), 1)), 6) as shares, round(sum(by0 - ay1), 3) as gaps from o group by doc
""")
def box_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """GEO-02: overlap in width over the smaller box, and signed distances."""
    a, b = F.col("a"), F.col("b")
    return pairs(spark, sf_dir).groupBy("doc").agg(F.count("*").alias("n"), F.round(F.sum(geom.overlap_x_ratio(a, b)), 6).alias("shares"), F.round(F.sum(geom.gap_y(a, b)), 3).alias("gaps"))


@query(f"""
with {_PAIRS}, m as (select *, ax1 / 100 as ma, pos * 0.5 as mb, -pos * 0.25 as mc, ay1 / 100 as md, bx0 as me, by0 as mf from p),
c as (select *, ma * 2 as na, mb * 3 as nb, mc * 2 as nc, md * 3 as nd, me * 2 + 5 as ne, mf * 3 - 7 as nf from m),
t as (select doc, na * ax0 + nc * ay0 + ne as px, nb * ax0 + nd * ay0 + nf as py, na * ax0 + nc * ay1 + ne as qx, nb * ax0 + nd * ay1 + nf as qy, na * ax1 + nc * ay0 + ne as rx, nb * ax1 + nd * ay0 + nf as ry, na * ax1 + nc * ay1 + ne as sx, nb * ax1 + nd * ay1 + nf as sy from c)
select doc, round(sum(least(px, qx, rx, sx)), 2) as x0, round(sum(800 - greatest(py, qy, ry, sy)), 2) as y0, round(sum(greatest(px, qx, rx, sx)), 2) as x1, round(sum(800 - least(py, qy, ry, sy)), 2) as y1 from t group by doc
""")
def affine_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """GEO-03: matrices multiplied, boxes transformed and flipped to an origin at the top."""
    a, b, pos = F.col("a"), F.col("b"), F.col("pos")
    m = F.array(a[2] / 100, pos * 0.5, -pos * 0.25, a[3] / 100, b[0], b[1])
    n = F.array(*map(F.lit, (2.0, 0.0, 0.0, 3.0, 5.0, -7.0)))
    rows = pairs(spark, sf_dir).withColumn("t", geom.flip(geom.transform_box(geom.multiply(m, n), a), F.lit(800.0)))
    return rows.groupBy("doc").agg(*(F.round(F.sum(F.col("t")[k]), 2).alias(c) for k, c in enumerate(("x0", "y0", "x1", "y1"))))


@query(f"""
with {_PAIRS} select doc, round(sum(greatest(ax0 - 6, 0)), 3) as x0, round(sum(greatest(ay0 - 6, 0)), 3) as y0, round(sum(least(ax1 + 6, 450)), 3) as x1, round(sum(least(ay1 + 6, 520)), 3) as y1, round(sum(round_even((ax1 - ax0) / 18, 0)), 0)::bigint as buckets from p group by doc
""")
def expanded_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """GEO-05 and GEO-10: boxes with a margin, cut to the page; widths in buckets, halves to even."""
    rows = pairs(spark, sf_dir).withColumn("e", geom.expand(F.col("a"), 6.0, F.lit(450.0), F.lit(520.0)))
    return rows.groupBy("doc").agg(*(F.round(F.sum(F.col("e")[k]), 3).alias(c) for k, c in enumerate(("x0", "y0", "x1", "y1"))), F.sum(geom.bucket(F.col("a")[2] - F.col("a")[0], 18.0)).alias("buckets"))


@query("""
with s as (select l_orderkey as doc, l_linenumber as k, l_partkey as c, (l_suppkey % 32)::int as flags, ([1, 0, -1, 0, 0.9])[(l_partkey % 5 + 1)::int] as dx, ([0, 1, 0, -1, 0.1])[(l_partkey % 5 + 1)::int] as dy from lineitem)
select doc, k, c, ([0, 90, 180, 270, 0])[(c % 5 + 1)::int]::int as rotation, (flags & 1) > 0 as superscript, (flags & 2) > 0 as italic, (flags & 8) > 0 as monospace, (flags & 16) > 0 as bold,
    round(((c // 65536) % 256) / 255.0, 6)::double as red, round(((c // 256) % 256) / 255.0, 6)::double as green, round((c % 256) / 255.0, 6)::double as blue from s
""")
def span_styles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-12 and GEO-07: writing direction, flags and colour of a span."""
    li = table(spark, sf_dir, "lineitem")
    pick = lambda *v: F.get(F.array(*map(F.lit, v)), (F.col("l_partkey") % 5).cast("int"))
    flags, color = (F.col("l_suppkey") % 32).cast("int"), geom.rgb(F.col("l_partkey"))
    return li.select(
        F.col("l_orderkey").alias("doc"), F.col("l_linenumber").alias("k"), F.col("l_partkey").alias("c"), geom.direction_to_rotation(pick(1.0, 0.0, -1.0, 0.0, 0.9), pick(0.0, 1.0, 0.0, -1.0, 0.1)).alias("rotation"),
        *(geom.flag(flags, f).alias(f) for f in ("superscript", "italic", "monospace", "bold")), *(F.round(color[k], 6).alias(c) for k, c in enumerate(("red", "green", "blue"))),
    )


@query(f"""
with {_PAIRS}, t as (select * from p where pos <= 2), c as (select * from p)
select doc, count(*) as n from (select distinct c.doc, c.pos from c join t using (doc)
    where greatest(least(c.ax1, t.bx1) - greatest(c.ax0, t.bx0), 0) * greatest(least(c.ay1, t.by1) - greatest(c.ay0, t.by0), 0) >= 0.6 * (c.ax1 - c.ax0) * (c.ay1 - c.ay0)) group by doc
""")
def region_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JOIN-10: boxes of which 60 % lie in one region of their page."""
    rows = pairs(spark, sf_dir).withColumn("id", F.col("pos"))
    some = layout.inside_regions(rows.select("doc", "id", F.col("a").alias("bbox")), rows.where("pos <= 2").select("doc", F.col("b").alias("bbox")), key=("doc",))
    return some.select("doc", "id").distinct().groupBy("doc").agg(F.count("*").alias("n"))


@query(f"""
with {_PAIRS} select p.doc, p.pos as id, string_agg(distinct 'o' || o.pos, ',' order by 'o' || o.pos) as anchors from p join p o using (doc)
where greatest(least(p.ax1, o.bx1) - greatest(p.ax0, o.bx0), 0) * greatest(least(p.ay1, o.by1) - greatest(p.ay0, o.by0), 0) >= 0.35 * (p.ax1 - p.ax0) * (p.ay1 - p.ay0) group by all
""")
def block_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JOIN-09: embedded objects that cover 35 % of a block."""
    rows = pairs(spark, sf_dir)
    found = layout.anchors(rows.select("doc", F.col("pos").alias("id"), F.col("a").alias("bbox")), rows.select("doc", F.concat(F.lit("o"), "pos").alias("name"), F.col("b").alias("bbox")), key=("doc",))
    return found.select("doc", "id", F.array_join("anchors", ",").alias("anchors"))


@query(f"""
with {_PAIRS} select doc, count(distinct h) as n from (select h.doc, h.pos as h from p h join p t using (doc) where t.by0 - h.ay1 between -2 and 25
    and greatest(least(h.ax1, t.bx1) - greatest(h.ax0, t.bx0), 0) / greatest(least(h.ax1 - h.ax0, t.bx1 - t.bx0), 1) >= 0.55) group by doc
""")
def header_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JOIN-07: boxes right above a table body."""
    rows = pairs(spark, sf_dir).withColumn("fontSize", F.lit(10.0))
    found = layout.adjacent_headers(rows.select("doc", "fontSize", F.col("pos").alias("id"), F.col("a").alias("bbox")), rows.select("doc", F.col("b").alias("bbox")), key=("doc",))
    return found.groupBy("doc").agg(F.countDistinct("id").alias("n"))


_CANDIDATES = rf"""
{_BLOCKS}, cand0 as (select distinct doc, page, (pos % 12) // 4 as part from b),
cand as (select doc, page, part, 40.0 as x0, 30.0 + part * 224 as y0, 560.0 as x1, 30.0 + part * 224 + 230 as y1 from cand0),
feat as (select *, len(regexp_extract_all(t, '\d')) as d, len(regexp_extract_all(t, '[A-Za-z]{{2,}}')) as w, len(regexp_extract_all(t, '[×·.=<>≤≥%/+\-]')) as s, len(regexp_extract_all(t, '[A-Z]')) as u from b),
shaped as (select *, t <> '' and (regexp_matches(t, 'BLEU|FLOPs|EN-DE|EN-FR') or (d >= 4 and (w <= 10 or s >= 2)) or (u >= 6 and w <= 8)) as tableish from feat),
met as (select c.doc, c.page, c.part, g.t, g.tableish, g.d, g.x0, g.y0, g.y1 from cand c join shaped g using (doc, page) where g.x0 < c.x1 and c.x0 < g.x1 and g.y0 < c.y1 and c.y0 < g.y1),
sums as (
    select doc, page, part, count(*) as blocks, count(*) filter (t <> '') as filled, count(*) filter (t <> '' and length(t) <= 24) as short, count(*) filter (t <> '' and tableish) as tableish,
        count(*) filter (t <> '' and regexp_matches(t, '(?i)^table\s+\d+[.:]?\s+')) as captions, count(*) filter (t <> '' and d >= 2) as numeric, count(*) filter (t <> '' and length(t) >= 70 and regexp_matches(t, '[，。；：.!?]')) as prose,
        count(distinct round_even((y0 + y1) / 2, 0)) filter (t <> '') as rows, count(distinct round_even(x0 / 12, 0)) filter (t <> '') as columns from met group by all
)
"""


@query(f"""
with {_CANDIDATES}
select doc, page, part, round(case when filled = 0 then 0 else least(tableish, 8) * 1.2 + least(short, 10) * 0.35 + least(numeric, 8) * 0.35 + least(captions, 1) * 3 + case when rows >= 4 then 2 else 0 end + case when columns >= 3 then 2 else 0 end
    + case when blocks >= 6 then 1 else 0 end - prose * 2.2 - case when prose >= 2 then 2.5 else 0 end end, 4)::double as score from sums
""")
def region_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-21: scores of three candidate regions on every page."""
    b = blocks(spark, sf_dir)
    part = F.floor(F.col("pos") % 12 / 4)
    top = 30.0 + F.col("part") * 224
    found = b.select("doc", "page", part.alias("part")).distinct().withColumn("bbox", F.array(F.lit(40.0), top, F.lit(560.0), top + 230))
    scored = regions.scores(found, b.withColumn("pageWidth", F.lit(600.0)), rules=None, extra=("part",))
    return scored.select("doc", "page", "part", F.round("score", 4).alias("score"))


@query("""
with e(page, region, x0, y0, x1, y1, score) as (values (1, 0, 10.0, 10.0, 60.0, 60.0, 9.0), (1, 1, 200.0, 10.0, 260.0, 50.0, 7.0), (2, 0, 0.0, 0.0, 130.0, 130.0, 8.0), (3, 0, 5.0, 5.0, 20.0, 20.0, 6.0)) select page, region, x0::double as x0, y0::double as y0, x1::double as x1, y1::double as y1, score::double as score from e
""")
def region_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TOP-06: by falling score, a region joins the first accepted one that it meets. Fixed rows: overlapping, apart, chained, too low."""
    rows = [(1, [10.0, 10.0, 50.0, 50.0], 9.0), (1, [40.0, 40.0, 60.0, 60.0], 6.5), (1, [200.0, 10.0, 260.0, 50.0], 7.0), (1, [300.0, 300.0, 310.0, 310.0], 5.9), (2, [0.0, 0.0, 50.0, 50.0], 8.0), (2, [90.0, 90.0, 130.0, 130.0], 6.1), (2, [40.0, 40.0, 100.0, 100.0], 7.0), (3, [5.0, 5.0, 20.0, 20.0], 6.0)]
    found = regions.merged(spark.createDataFrame(rows, "page int, bbox array<double>, score double"), ("page",))
    return found.select("page", "region", *(F.col("bbox")[k].alias(c) for k, c in enumerate(("x0", "y0", "x1", "y1"))), "score")


@query(rf"""
with {_BLOCKS}, z as (select *, regexp_replace(lower(t), '\d+', '#', 'g') as sig from b)
select doc, page, count(*) as n, md5(string_agg('p' || page || '_b' || pos || '|' || page || '|' || role || '|' || coalesce(text, '') || '|' || upper(text), chr(10) order by pos)) as md5 from b where regexp_matches(text, '^[ -~]*$') group by doc, page
""")
def debug_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK-10: the ten columns of a block that are written for inspection."""
    b = regions.debug_columns(blocks(spark, sf_dir).where(F.col("text").rlike("^[ -~]*$")).withColumn("role", F.col("role")))
    line = F.concat_ws("|", "id", "page", "role", F.coalesce("text", F.lit("")), "translatedText")
    pos = F.regexp_extract("id", r"_b(\d+)$", 1).cast("int")
    rows = F.sort_array(F.collect_list(F.struct(pos.alias("pos"), line.alias("x"))))
    keyed = b.withColumn("doc", F.col("doc"))
    return keyed.groupBy("doc", "page").agg(F.count("*").alias("n"), F.md5(F.array_join(F.transform(rows, lambda r: r["x"]), "\n")).alias("md5"))


@query(r"""
with t as (select doc_id, text as x from documents)
select doc_id, md5(trim(regexp_replace(x, '\s+', ' ', 'g'), ' ')) as normal_md5, md5(regexp_replace(x, '\s+', '', 'g')) as compact_md5, (length(x) - length(replace(x, ',', '')))::bigint as commas from t
""")
def normal_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR-01, STR-02 and STR-25: texts with single spaces, without any, and counted matches."""
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(text.normalize("text")).alias("normal_md5"), F.md5(text.compact("text")).alias("compact_md5"), text.count(F.col("text"), ",").cast("long").alias("commas"))


@query("""
with p as (select l_orderkey as doc, (l_quantity % 256)::int as a, (l_partkey % 256)::int as b, (l_suppkey % 256)::int as c from lineitem where l_linenumber <> 3)
select doc, count(*) as "maskPixels", count(*) filter (greatest(abs(a - b), abs(b - c)) >= 24) as "changedPixels", round(count(*) filter (greatest(abs(a - b), abs(b - c)) >= 24) / count(*)::double, 6) as share from p group by doc
""")
def changed_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-23: pixels under a mask that differ by 24 or more in a channel; a line item is a pixel of two channels."""
    channel = lambda c: (F.col(c) % 256).cast("int")
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc"), (F.col("l_linenumber") != 3).alias("masked"), F.array(channel("l_quantity"), channel("l_partkey")).alias("before"), F.array(channel("l_partkey"), channel("l_suppkey")).alias("after"))
    return repair.changed_share(rows, ("doc",)).select("doc", "maskPixels", "changedPixels", F.round("changedRatio", 6).alias("share"))


@query(r"""
with l as (select doc_id as doc, generate_subscripts(string_split(text, chr(10)), 1) - 1 as pos from documents)
select doc, pos, (pos % 12 + 1)::int as last, '@@INLINE_FORMULA_' || (pos % 12 + 1) || '@@' as name from l
""")
def placeholder_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TOP-08: placeholders in order of their number, ten after nine."""
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    keys = F.reverse(F.transform(F.sequence(F.lit(1), F.col("pos") % 12 + 1), lambda i: F.concat(F.lit("@@INLINE_FORMULA_"), i, F.lit("@@"))))
    ordered = inline.placeholder_order(keys)
    return rows.select("doc", "pos", F.size(ordered).alias("last"), F.element_at(ordered, -1).alias("name"))


@query(rf"""
with {_BLOCKS}, c as (select t, len(regexp_extract_all(t, '{text.FORMULA_SYMBOLS}')) as symbols, len(regexp_extract_all(t, '{text.FORMULA_TOKENS}')) as tokens, len(regexp_extract_all(t, '{text.WORD}')) as words,
    len(regexp_extract_all(t, '[A-Za-z0-9]')) as letters, len(regexp_extract_all(t, '[()]')) as brackets, role from b)
select (symbols > 0 and tokens >= 1) or (tokens >= 2 and letters >= 4 and words <= 6) or (brackets >= 2 and symbols >= 1) as formula, role = 'heading' as section, lower(t) in ('references', 'bibliography', '参考文献') as reference,
    length(t) <= 180 and regexp_matches(t, '{layout.BYLINE.replace("'", "''")}') as byline, count(*) as n from c group by all
""")
def line_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT-17, FLT-19 and FLT-21: rows by verdicts on formulas, sections, reference headings and bylines."""
    b = blocks(spark, sf_dir)
    verdicts = {"formula": text.formula_like("text"), "section": layout.section_signal(), "reference": layout.reference_heading(), "byline": layout.byline()}
    return b.groupBy(*(v.alias(k) for k, v in verdicts.items())).agg(F.count("*").alias("n"))


@query(r"""
with l as (select doc_id as doc, generate_subscripts(string_split(text, chr(10)), 1) - 1 as pos, unnest(string_split(text, chr(10))) as text from documents)
select doc, count(*) as blocks, sum(length(text))::bigint as chars, count(distinct pos // 5)::bigint as pages, count(*) filter (pos % 5 = 0)::bigint as rules from l where doc % 7 <> 3 group by doc
""")
def payload_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-16: JSON payloads, of blocks or of pages of blocks, with rule lines; those of version 1 are left out."""
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), F.posexplode(F.split("text", "\n")).alias("pos", "text")).withColumn("page", F.floor(F.col("pos") / 5).cast("int") + 1)
    block = F.struct(F.col("pos").cast("string").alias("id"), "page", "text")
    pages = rows.groupBy("doc", "page").agg(F.sort_array(F.collect_list(block)).alias("blocks"))
    docs = pages.groupBy("doc").agg(F.sort_array(F.collect_list(F.struct("page", "blocks"))).alias("pages"), F.map_from_entries(F.collect_list(F.struct(F.col("page").cast("string"), F.array(F.array(F.lit(1.0), F.lit(2.0), F.lit(3.0), F.lit(4.0)))))).alias("pageLineHints"))
    flat = F.flatten(F.transform("pages", lambda p: p["blocks"]))
    by_blocks = F.to_json(F.struct(F.lit(2).alias("version"), flat.alias("blocks"), "pageLineHints"))
    by_pages = F.to_json(F.struct(F.when(F.col("doc") % 7 == 3, 1).otherwise(3).alias("version"), "pages", "pageLineHints"))
    files = docs.select("doc", F.when((F.col("doc") % 2 == 0) & (F.col("doc") % 7 != 3), by_blocks).otherwise(by_pages).alias("value"))
    found = epub.payload_blocks(files).groupBy("doc").agg(F.count("*").alias("blocks"), F.sum(F.length("text")).alias("chars"), F.countDistinct("page").alias("pages"))
    return found.join(epub.payload_rules(files).groupBy("doc").agg(F.count("*").alias("rules")), "doc")


@query("""
select doc_id as doc, case when doc_id % 3 = 0 then 'needs_review' else 'ok' end as status, case when doc_id % 3 = 0 then 2 else 0 end::bigint as issues from documents
""")
def validation_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """VAL-02 and SNK-08: a document is fine without issues; issues are written and read again."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"))
    issues = docs.where("doc % 3 = 0").select("doc", F.explode(F.array(F.lit("translation_missing"), F.lit("source_text_residue"))).alias("type"))
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/issues-{uuid.uuid4().hex}"
    repair.write_report(issues, path)
    return repair.report(spark.read.json(path, "doc long, type string"), docs)


@query("select page_id, length(html)::bigint as chars from pages where not contains(html, chr(10)) and not contains(html, chr(13))")
def html_written(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK-02 and SRC-03: pages written as files and read again; those with line breaks would be several lines."""
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/pages-{uuid.uuid4().hex}"
    pages = table(spark, sf_dir, "pages").where(~F.contains("html", F.lit("\n")) & ~F.contains("html", F.lit("\r")))
    html_sink.write_html(pages.select(F.concat(F.col("page_id").cast("string"), F.lit(":"), "html").alias("html")), path)
    back = spark.read.text(path)
    return back.select(F.substring_index("value", ":", 1).cast("long").alias("page_id"), (F.length("value") - F.length(F.substring_index("value", ":", 1)) - 1).cast("long").alias("chars"))
