"""Layout operators. Boxes come from ``documents`` (a block per line, twelve to a page) or, as numbers, from ``lineitem``; both only lend raw material."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from papyrion.functions import geom
from papyrion.operators import layout
from papyrion.registry import query, table

_BLOCKS = r"""
l as (select doc_id as doc, generate_subscripts(string_split(text, chr(10)), 1) - 1 as pos, unnest(string_split(text, chr(10))) as text from documents),
k as (select *, length(text) as n, trim(regexp_replace(text, '\s+', ' ', 'g'), ' ') as t from l),
b as (
    select doc, (pos // 12 + 1)::int as page, pos, text, t, n, (72 + (n % 3) * 18)::double as x0, (40 + (pos % 12) * 56)::double as y0, (72 + (n % 3) * 18 + least(440, 5 * n))::double as x1,
        (40 + (pos % 12) * 56 + 14 * greatest(1, least(3, n // 90 + 1)))::double as y1, (20 + n % 3)::double / 2 as size, case when n < 40 and pos % 5 = 0 then 'heading' else 'paragraph' end as role from k
)
"""


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks with every column of ``schemas.BLOCK`` that the rules read."""
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), F.posexplode(F.split("text", "\n")).alias("pos", "text"))
    n, slot = F.length("text"), F.col("pos") % 12
    left, top = 72.0 + (n % 3) * 18, 40.0 + slot * 56
    box = F.array(left.cast("double"), top.cast("double"), (left + F.least(F.lit(440), n * 5)).cast("double"), (top + 14 * F.greatest(F.lit(1), F.least(F.lit(3), F.floor(n / 90) + 1))).cast("double"))
    rows = rows.withColumns({"bbox": box, "page": (F.floor(F.col("pos") / 12) + 1).cast("int"), "fontSize": (10.0 + (n % 3) * 0.5).cast("double"), "role": F.when((n < 40) & (F.col("pos") % 5 == 0), "heading").otherwise("paragraph")})
    item = F.struct(F.lit("text").alias("type"), F.col("text"), F.col("bbox"), F.lit("Times").alias("font"), F.col("fontSize").alias("size"), (F.col("pos") % 32).cast("int").alias("flags"), (F.col("pos") % 4 == 0).alias("isBoldLike"), F.lit(False).alias("isItalicLike"), (F.col("pos") % 7 == 0).alias("isMonospaceLike"))
    null = lambda kind: F.lit(None).cast(kind)
    return rows.withColumns({
        "id": F.concat(F.lit("p"), "page", F.lit("_b"), "pos"), "pageWidth": F.lit(600.0), "pageHeight": F.lit(720.0), "rotation": F.lit(0), "blockType": null("string"), "doclingLabel": null("string"),
        "renderPolicy": null("string"), "preserveOriginal": null("boolean"), "preserveReason": null("string"), "isBodyLike": null("boolean"), "demotedFromHeading": null("boolean"), "translationMetaNote": null("string"),
        "translatedText": F.upper("text"), "layoutLines": F.array(F.struct(F.col("bbox"), F.array(item).alias("items"))),
    })


@query(rf"""
with {_BLOCKS},
c as (select *, len(regexp_extract_all(t, '\d')) as d, len(regexp_extract_all(t, '[A-Za-z]{{2,}}')) as w, len(regexp_extract_all(t, '[×·.=<>≤≥%/+\-]')) as s, len(regexp_extract_all(t, '[A-Z]')) as u from b),
e as (select *, t <> '' and (regexp_matches(t, 'BLEU|FLOPs|EN-DE|EN-FR') or (d >= 4 and (w <= 10 or s >= 2)) or (u >= 6 and w <= 8)) as tableish, length(t) >= 70 and regexp_matches(t, '[，。；：.!?]') as prose from c),
f as (select *, t <> '' and (tableish or (length(t) <= 32 and d >= 1) or (length(t) <= 24 and w <= 4)) as short from e)
select tableish, short, prose, t <> '' and not regexp_matches(t, '(?i)^table\s+\d+[.:]?\s+') and not regexp_matches(t, '^(?:\d+(?:\.\d+)*|[A-Z])(?:[.)])?\s+[^\s].{{0,120}}$') and role <> 'heading' and not prose and (tableish or (short and length(t) <= 48)) as table_body,
    regexp_matches(t, '^\d{{1,3}}$') as page_number, regexp_matches(t, '^[A-Z][A-Z\s/&-]{{0,23}}$') and length(t) <= 24 and len(string_split(t, ' ')) between 1 and 3 as running,
    t <> '' and length(t) <= 140 and (regexp_matches(t, '^(?:\d+(?:\.\d+)*|[A-Z])(?:[.)])?\s+[^\s].{{0,120}}$') or size >= 11.8) as heading, count(*) as n from f group by all
""")
def block_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT-20, FLT-22, FLT-25 and FLT-26: rows by verdicts."""
    b = blocks(spark, sf_dir)
    return b.groupBy(
        layout.tableish().alias("tableish"), layout.short_or_tableish().alias("short"), layout.prose_like().alias("prose"), layout.table_body().alias("table_body"),
        layout.page_number().alias("page_number"), layout.running_label("text").alias("running"), layout.heading(F.lit(10.0)).alias("heading"),
    ).agg(F.count("*").alias("n"))


@query(rf"""
with {_BLOCKS},
m as (select doc, page, coalesce(median(case when length(t) >= 20 and size between 6 and 14 then size end), 10.0)::double as base from b group by doc, page),
c as (select b.*, m.base, len(regexp_extract_all(t, '[，。；：.!?]')) as marks from b join m using (doc, page)),
e as (select *, t <> '' and role <> 'heading' and not regexp_matches(t, '(?i)^(?:figure|fig\.|table)\s+\d+[.:]?\s+|^(?:图|表)\s*\d+[：:.\s]') and x1 - x0 > 0 and (x1 - x0) / 600 between 0.3 and 0.86
    and abs(size - base) <= greatest(base * 0.22, 1.5) and ((length(t) >= 80 and marks >= 1) or length(t) >= 140) as body from c)
select case when regexp_matches(t, '(?i)^(?:figure|fig\.|table)\s+\d+[.:]?\s+|^(?:图|表)\s*\d+[：:.\s]') then 'caption' when role = 'heading' then 'heading' when body then 'body' else 'metadata' end as block_type, base as body_size, count(*) as n from e group by all
""")
def block_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-10 and PRJ-02: types against the page's body size. No block here is a formula, so that rule is silent."""
    b = blocks(spark, sf_dir)
    sized = b.join(layout.page_body_size(b), ["doc", "page"])
    return sized.groupBy(layout.block_type(F.lit(None).cast("double"), F.col("bodySize")).alias("block_type"), F.col("bodySize").alias("body_size")).agg(F.count("*").alias("n"))


@query()
def block_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PRJ-01, PRJ-06, ACT-01 and WIN-07 chained: blocks by type, intent, policy, shape and action."""
    b = blocks(spark, sf_dir)
    typed = b.join(layout.page_body_size(b), ["doc", "page"]).withColumn("blockType", layout.block_type(F.lit(None).cast("double"), F.col("bodySize")))
    typed = typed.withColumn("layoutIntent", layout.layout_intent(F.lit(None).cast("double"), F.col("bodySize"))).withColumn("shape", layout.wrap_shape())
    return layout.decide(typed).groupBy("blockType", "layoutIntent", F.col("renderPolicy").alias("policy"), "shape", "action").agg(F.count("*").alias("n"))


@query(rf"""
with {_BLOCKS}, r as (select doc, page, pos, greatest(x0 - 0.9, 0) as rx0, greatest(y0 - 0.9, 0) as ry0, least(x1 + 0.9, 600) as rx1, least(y1 + 0.9, 720) as ry1 from b where n > 0 and t <> '')
select doc, page, count(*) as n, round(min(rx0)::double, 4) as x0, round(min(ry0)::double, 4) as y0, round(max(rx1)::double, 4) as x1, round(max(ry1)::double, 4) as y1, round(sum(((rx1 - rx0) * (ry1 - ry0)))::double, 2) as area from r group by doc, page
""")
def erase_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ERZ-01 and AGG-17: rectangles of replaced blocks, united per page. Blocks are plain paragraphs here."""
    b = blocks(spark, sf_dir).where(F.trim(F.regexp_replace("text", r"\s+", " ")) != "").withColumn("blockType", F.lit("body"))
    rects = layout.erase_rects(b.withColumn("text", F.lit("x")).withColumn("translatedText", F.lit("x")).withColumn("role", F.lit("paragraph")))
    u, r = F.col("u"), F.col("rect")
    sums = rects.groupBy("doc", "page").agg(F.count("*").alias("n"), geom.union(r).alias("u"), F.round(F.sum(geom.area(r)), 2).alias("area"))
    return sums.select("doc", "page", "n", *(F.round(u[k], 4).alias(c) for k, c in enumerate(("x0", "y0", "x1", "y1"))), "area")


@query(rf"""
with {_BLOCKS},
z as (select *, regexp_replace(lower(t), '\d+', '#', 'g') as sig, regexp_replace(upper(t), '[^A-Z0-9]+', '', 'g') as caps from b),
s as (select doc, page, sig, pos, 'top' as zone from z where y1 <= 720 * 0.11 union all select doc, page, sig, pos, 'bottom' from z where y0 >= 720 * 0.89),
o as (select doc, zone, sig from s where length(sig) between 3 and 160 and not regexp_matches(sig, '^[\d\s./-]+$') group by all having count(distinct page) >= 2),
r as (
    select doc, page, pos from z where y0 >= 720 * 0.89 and regexp_matches(t, '^\d{{1,3}}$')
    union all select doc, page, pos from z where y0 >= 720 * 0.94 and regexp_matches(caps, 'NATURE|VOL') and (regexp_matches(caps, 'CORRECTED|SEPTEMBER') or regexp_matches(t, '(?:^|[^A-Za-z0-9_])\d{{1,3}}(?:$|[^A-Za-z0-9_])'))
    union all select doc, page, pos from z where y1 <= 720 * 0.12 and t <> '' and (contains(lower(t), 'arxiv') or (regexp_matches(t, '\[[A-Za-z.:-]+\]') and regexp_matches(t, '\d{{4}}'))
        or regexp_matches(t, '(?i)(?:^|[^A-Za-z0-9_])(?:cs|math|stat|econ|q-bio|hep|astro-ph)\.[A-Z-]+(?:$|[^A-Za-z0-9_-])'))
)
select doc, count(*) as n from (select s.doc, s.page, s.pos from s join o using (doc, zone, sig) union select * from r) group by doc
""")
def periphery_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-15 and FLT-25 by document: repeated signatures, page numbers, journal footers and identifiers in the margins."""
    return layout.periphery(blocks(spark, sf_dir)).groupBy("doc").agg(F.count("*").alias("n"))


_SIZES = "s as (select l_orderkey as page, l_linenumber as pos, l_quantity / 3.0 as size, (l_extendedprice / 100.0)::double as width, l_returnflag as flag from lineitem)"


@query(f"""
with {_SIZES}, r as (select page, round_even(size, 1) as size from s where size > 0), c as (select page, size, count(*) as n from r group by all),
d as (select page, max(struct_pack(n := n, size := size)).size as dominant from c group by page)
select d.page, d.dominant, m.representative from d join (select page, median(size) as representative from r group by page) m using (page)
""")
def dominant_font(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-09: the quantity of a line item lends a font size."""
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("page"), (F.col("l_quantity") / 3.0).alias("size"))
    return layout.font_sizes(rows, ("page",))


@query(f"""
with {_SIZES}, k as (select page, round_even(width / 18.0, 0)::int as b, count(*) as n, avg(width) as mean, median(width) as middle from s group by all),
x as (select page, n, middle, row_number() over (partition by page order by n desc, mean desc) as r from k)
select x.page, round(case when x.n >= 2 then x.middle else a.middle end, 6) as body_width from x join (select page, median(width) as middle from s group by page) a using (page) where x.r = 1
""")
def page_body_width(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-11: the price lends a width."""
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("page"), (F.col("l_extendedprice") / 100.0).alias("width"))
    return layout.page_body_width(rows, ("page",)).select("page", F.round("bodyWidth", 6).alias("body_width"))


@query(f"""
with {_SIZES}, c as (select page, flag, sum(pos) as n from s group by all), r as (select page, flag, row_number() over (partition by page order by n desc, flag desc) as r from c) select page, flag as family from r where r = 1
""")
def dominant_family(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-13: the return flag lends a family, the line number its words."""
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("page"), F.col("l_returnflag").alias("family"), F.col("l_linenumber").alias("words"))
    return layout.dominant_family(rows, ("page",))


_BOXES = "x as (select l_orderkey as page, l_linenumber as pos, (l_partkey % 400)::double as x0, (l_suppkey % 90 * 8)::double as y0, (l_partkey % 400 + 20 + l_quantity * 3)::double as x1, (l_suppkey % 90 * 8 + 10 + l_quantity)::double as y1 from lineitem)"


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A box for each line item, an order is a page."""
    left, top, q = F.col("l_partkey") % 400, F.col("l_suppkey") % 90 * 8, F.col("l_quantity")
    box = F.array(*(c.cast("double") for c in (left, top, left + 20 + q * 3, top + 10 + q)))
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("page"), F.col("l_linenumber").alias("pos"), box.alias("bbox"))


@query(f"with {_BOXES} select page, min(x0) as x0, min(y0) as y0, max(x1) as x1, max(y1) as y1, count(*) as n from x group by page")
def bbox_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-17."""
    u = boxes(spark, sf_dir).groupBy("page").agg(geom.union(F.col("bbox")).alias("u"), F.count("*").alias("n"))
    return u.select("page", *(F.col("u")[k].alias(c) for k, c in enumerate(("x0", "y0", "x1", "y1"))), "n")


@query(f"""
with {_BOXES}
select a.page, a.pos as a, b.pos as b, round((greatest(least(a.x1, b.x1) - greatest(a.x0, b.x0), 0) * greatest(least(a.y1, b.y1) - greatest(a.y0, b.y0), 0)) / ((a.x1 - a.x0) * (a.y1 - a.y0)), 6) as share
from x a join x b on a.page = b.page and a.pos < b.pos and a.x0 < b.x1 and b.x0 < a.x1 and a.y0 < b.y1 and b.y0 < a.y1
""")
def bbox_overlap_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """GEO-01 as a theta join within pages; a page has few boxes."""
    a = boxes(spark, sf_dir).select("page", F.col("pos").alias("a"), F.col("bbox").alias("p"))
    b = boxes(spark, sf_dir).select("page", F.col("pos").alias("b"), F.col("bbox").alias("q"))
    hits = a.join(b, "page").where((F.col("a") < F.col("b")) & geom.intersects(F.col("p"), F.col("q")))
    return hits.select("page", "a", "b", F.round(geom.overlap_ratio(F.col("p"), F.col("q")), 6).alias("share"))


@query(f"""
with {_BOXES}, i as (select * from x where pos <= 2), s as (
    select b.page, b.pos, i.pos as ord, (greatest(least(b.x1, i.x1) - greatest(b.x0, i.x0), 0) * greatest(least(b.y1, i.y1) - greatest(b.y0, i.y0), 0)) / ((b.x1 - b.x0) * (b.y1 - b.y0)) as o from x b join i on b.page = i.page and b.pos > 2),
r as (select *, row_number() over (partition by page, pos order by o * 0.8 desc, ord) as r from s where o > 0.15)
select page, 'b' || pos as id, 'label' || ord as label, round(o * 0.8, 6) as score from r where r = 1
""")
def docling_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JOIN-06: the first two boxes of a page are layout items; there is no text, so only overlap counts."""
    b = boxes(spark, sf_dir)
    blocks_ = b.where("pos > 2").select("page", F.concat(F.lit("b"), "pos").alias("id"), "bbox", F.lit("a").alias("text"))
    items = b.where("pos <= 2").select("page", F.concat(F.lit("label"), "pos").alias("label"), F.col("pos").alias("ord"), "bbox", F.lit("").alias("text"))
    return layout.label_blocks(blocks_, items, ("page",)).select("page", "id", "label", F.round("score", 6).alias("score"))


@query(f"""
with {_BOXES}, g as (select *, y0 - lag(y1) over o as gap from x window o as (partition by page order by y0, x0, pos)),
n as (select *, sum(case when gap > 24 then 1 else 0 end) over (partition by page order by y0, x0, pos rows unbounded preceding) as grp from g)
select page, grp::bigint as grp, count(*) as n, min(y0) as top, max(y1) as bottom from n group by page, grp
""")
def vertical_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN-06: islands by vertical gap."""
    rows = boxes(spark, sf_dir).withColumn("id", F.col("pos"))
    grouped = layout.vertical_groups(rows, ("page",)).groupBy("page", F.col("group").alias("grp"))
    return grouped.agg(F.count("*").alias("n"), F.min(F.col("bbox")[1]).alias("top"), F.max(F.col("bbox")[3]).alias("bottom"))


@query("""
with t as (select conv_id as doc, turn as page, min(role) as role, min(text) as text from conversations group by all),
h as (select *, case when page % 3 = 0 then page % 2 = 0 end as ref from t),
w as (select *, last_value(ref ignore nulls) over (partition by doc order by page rows unbounded preceding) as inside from h)
select doc, page, case when coalesce(inside, false) and ref is null then 'reference_block' else role end as kind from w
""")
def reference_carry_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN-02: every third turn is a heading, the even ones a references heading."""
    rows = table(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("doc"), F.col("turn").alias("page")).agg(F.min("role").alias("r"), F.min("text").alias("text"))
    head = F.col("page") % 3 == 0
    b = rows.select("doc", "page", F.col("r").alias("blockType"), F.when(head, "heading").otherwise("text").alias("role"), F.when(head & (F.col("page") % 2 == 0), "References").otherwise("x").alias("text"), F.array(F.lit(0.0), F.lit(0.0), F.lit(1.0), F.lit(1.0)).alias("bbox"), F.lit("").alias("doclingLabel"), F.lit(False).alias("preserveOriginal"), F.lit("").alias("preserveReason"))
    return layout.mark_references(b).select("doc", "page", F.col("blockType").alias("kind"))


@query("""
with s as (select l_orderkey as page, l_linenumber as pos, min(l_returnflag) as font, min(l_linestatus) as text, max(l_quantity) as q from lineitem group by all),
g as (select *, case when font = lag(font) over (partition by page order by pos) then 0 else 1 end as fresh from s),
r as (select *, sum(fresh) over (partition by page order by pos rows unbounded preceding) as run from g)
select page, run::bigint as run, string_agg(text, '' order by pos) as text, max(q) as x1, count(*) as items from r group by page, run
""")
def span_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN-12: neighbouring items of one style become one."""
    null = F.lit(None).cast("int")
    one = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_returnflag").alias("l_returnflag"), F.min("l_linestatus").alias("l_linestatus"), F.max("l_quantity").alias("l_quantity"))
    rows = one.select(
        F.col("l_orderkey").alias("page"), F.col("l_linenumber").alias("pos"), F.lit("text").alias("type"), null.alias("flags"), F.col("l_returnflag").alias("font"), F.lit(1.0).alias("size"),
        F.array(F.lit(0.0)).alias("color"), F.col("l_linestatus").alias("text"), F.array(F.lit(0.0), F.lit(0.0), F.col("l_quantity").cast("double"), F.lit(1.0)).alias("bbox"),
    )
    return layout.merge_spans(rows, ("page",), "pos").select("page", "run", "text", F.col("bbox")[2].alias("x1"), "items")


@query(f"""
with {_BOXES}, r as (select page, min(x0) as rx0, min(y0) as ry0, max(x1) as rx1, max(y1) as ry1 from x group by page),
t as (select x.*, r.*, case when pos % 2 = 0 then [y0 - ry0, rx1 - x1, y1 - ry0, rx1 - x0] else [ry1 - y1, x0 - rx0, ry1 - y0, x1 - rx0] end as u from x join r using (page))
select page, count(*) as n, round(sum(u[1] + 2 * u[2] + 3 * u[3] + 4 * u[4]), 3) as turned, round(sum(x0 + 2 * y0 + 3 * x1 + 4 * y1), 3) as back from t group by page
""")
def rotation_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """GEO-04: boxes of a region turned by 90 or 270 degrees, and turned back."""
    b = boxes(spark, sf_dir)
    region = geom.union(F.col("bbox"))
    rows = b.join(b.groupBy("page").agg(region.alias("region")), "page").withColumn("d", F.when(F.col("pos") % 2 == 0, 90).otherwise(270))
    rows = rows.withColumn("u", geom.rotate_in(F.col("bbox"), F.col("region"), F.col("d")))
    rows = rows.withColumn("v", geom.rotate_back(F.col("u"), F.col("region"), F.col("d")))
    weighed = lambda c: F.round(F.sum(sum((F.col(c)[k] * (k + 1) for k in range(1, 4)), F.col(c)[0])), 3)
    return rows.groupBy("page").agg(F.count("*").alias("n"), weighed("u").alias("turned"), weighed("v").alias("back"))


@query("""
with d as (select l_orderkey as page, l_linenumber as line, (l_partkey % 300)::double as x0, (l_suppkey % 90 * 8)::double as y0, l_quantity * 8 as w from lineitem),
r as (select page, line, x0, y0, x0 + w as x1 from d where w >= 150)
select page, count(*) as n, min(x0) as left_, max(x1) as right_, min(struct_pack(y := y0, x := x0)).y as first_y from r group by page
""")
def rule_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-11: long thin rectangles of a page in reading order; a quantity lends the length."""
    d = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("page"), (F.col("l_partkey") % 300).cast("double").alias("x0"), (F.col("l_suppkey") % 90 * 8).cast("double").alias("y0"), (F.col("l_quantity") * 8).alias("w"))
    rects = d.select("page", F.array("x0", "y0", F.col("x0") + F.col("w"), F.col("y0") + 1.0).alias("bbox"))
    b = F.col("bbox")
    ruled = rects.where(((geom.width(b) >= 150) & (geom.height(b) <= 3)) | ((geom.height(b) >= 150) & (geom.width(b) <= 3)))
    order = Window.partitionBy("page").orderBy(b[1], b[0])
    placed = ruled.withColumn("ord", F.row_number().over(order))
    return placed.groupBy("page").agg(F.count("*").alias("n"), F.min(b[0]).alias("left_"), F.max(b[2]).alias("right_"), F.min_by(b[1], "ord").alias("first_y"))
