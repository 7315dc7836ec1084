"""Operators inside of blocks; ``lineitem`` lends numbers, ``events`` lends streams of instructions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from papyrion.operators import formulas, inline
from papyrion.queries.layout import blocks
from papyrion.registry import query, table


@query(f"select doc_id, len(t)::int as n, length(list_aggregate(t, 'string_agg', ''))::int as chars, t[1] as first, t[len(t)] as last from (select doc_id, regexp_extract_all(text, '{inline.TOKENS.replace(chr(39), chr(39) * 2)}') as t from documents)")
def plain_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EXP-10: tokens of whole documents; together they are the text."""
    rows = table(spark, sf_dir, "documents").select("doc_id", inline.tokens("text").alias("t"))
    return rows.select("doc_id", F.size("t").alias("n"), F.length(F.array_join("t", "")).alias("chars"), F.get("t", F.lit(0)).alias("first"), F.element_at("t", -1).alias("last"))


@query(r"""
with t as (select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as pos from documents),
f as (select doc_id, pos, regexp_replace(line, '[$\\\\]', '', 'g') as plain from t),
m as (select *, case when pos % 3 = 0 then 'a $x_' || pos || '$ b \\(y+' || pos || '\\) ' || plain when pos % 3 = 1 then '$$z$$' || plain else plain end as text from f)
select doc_id, sum(case pos % 3 when 0 then 2 when 1 then 1 else 0 end)::bigint as n, md5(string_agg(case pos % 3 when 0 then 'a @@INLINE_FORMULA_1@@ b @@INLINE_FORMULA_2@@ ' || plain when 1 then '@@INLINE_FORMULA_1@@' || plain else plain end, chr(10) order by pos)) as protected_md5,
    md5(string_agg(text, chr(10) order by pos)) as restored_md5 from m group by doc_id
""".replace("\\\\", "\\"))
def formula_placeholders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR-11: formulas of two thirds of all lines become placeholders and come back."""
    rows = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("p", "line")).withColumn("pos", F.col("p") + 1)
    plain, pos, kind = F.regexp_replace("line", r"[$\\]", ""), F.col("pos").cast("string"), F.col("pos") % 3
    text = F.when(kind == 0, F.concat(F.lit("a $x_"), pos, F.lit("$ b \\(y+"), pos, F.lit("\\) "), plain)).when(kind == 1, F.concat(F.lit("$$z$$"), plain)).otherwise(plain)
    rows = rows.withColumn("t", text).withColumn("p", inline.protect_formulas("t"))
    joined = lambda c: F.md5(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", c.alias("x")))), lambda r: r["x"]), "\n"))
    return rows.groupBy("doc_id").agg(F.sum(F.size("p.formulas")).alias("n"), joined(F.col("p.html")).alias("protected_md5"), joined(inline.restore_formulas(F.col("p.html"), F.col("p.formulas"))).alias("restored_md5"))


@query("""
with x as (select l_orderkey as doc, l_linenumber as ord, max(l_quantity)::double as units, min(case when l_returnflag = 'N' then null else l_returnflag end) as own from lineitem group by all),
r as (select *, sum(units) over (partition by doc order by ord rows unbounded preceding) as run, sum(units) over (partition by doc) as total,
      last_value(own ignore nulls) over (partition by doc order by ord rows unbounded preceding) as before, first_value(own ignore nulls) over (partition by doc order by ord rows between current row and unbounded following) as after from x)
select doc, ord, round((run - units) / total, 6) as "from", round(run / total, 6) as "to", coalesce(own, before, after) as script from r
""")
def style_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN-13 and WIN-19: shares of a block's units, and scripts of neutral tokens."""
    flag = F.when(F.col("l_returnflag") != "N", F.col("l_returnflag"))
    rows = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("doc"), F.col("l_linenumber").alias("ord")).agg(F.max("l_quantity").cast("double").alias("units"), F.min(flag).alias("own"))
    out = inline.script_context(inline.style_runs(rows, ("doc",), "ord"), ("doc",), "ord")
    return out.select("doc", "ord", F.round("from", 6).alias("from"), F.round("to", 6).alias("to"), "script")


_OPS = "i as (select user_id as doc, event_id as ord, case event_id % 5 when 0 then 'BT' when 3 then 'ET' when 4 then 'q' else 'Tj' end as op, event_type as text from events)"


@query(f"""
with {_OPS}, w as (select *, sum((op = 'BT')::int) over o as b, sum((op = 'ET')::int) over o as e from i window o as (partition by doc order by ord rows unbounded preceding))
select doc, (b - 1)::bigint as object, count(*) as n, coalesce(string_agg(case when op = 'Tj' then text else '' end, '' order by ord), '') as text from w where b > e and op <> 'BT' group by doc, b
""")
def text_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-14, STR-21 and WIN-20: events stand for instructions; a user is a stream."""
    k = F.col("event_id") % 5
    op = F.when(k == 0, "BT").when(k == 3, "ET").when(k == 4, "q").otherwise("Tj")
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("doc"), F.col("event_id").alias("ord"), op.alias("op"), F.col("event_type").alias("text"))
    return inline.text_objects(rows, ("doc",)).select("doc", "object", "n", "text")


@query("""
with l as (select l_orderkey as doc, (l_partkey % 300)::double as px, l_suppkey::double as py, (l_partkey % 300 + l_quantity * 4)::double as qx, (l_suppkey + l_linenumber % 3)::double as qy from lineitem)
select doc, count(*) as n, min(px) as x0, max(qx) as x1, round(sum((py + qy) / 2), 3) as y from l where qx - px >= 40 and abs(qy - py) <= 1.5 group by doc
""")
def horizontal_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-12."""
    left, level = F.col("l_partkey") % 300, F.col("l_suppkey")
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc"), left.cast("double").alias("px"), level.cast("double").alias("py"), (left + F.col("l_quantity") * 4).cast("double").alias("qx"), (level + F.col("l_linenumber") % 3).cast("double").alias("qy"))
    found = inline.horizontal_segments(rows, ("doc",))
    return found.groupBy("doc").agg(F.count("*").alias("n"), F.min("x0").alias("x0"), F.max("x1").alias("x1"), F.round(F.sum("y"), 3).alias("y"))


@query()
def segment_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN-15: clusters of level segments per order."""
    left = F.col("l_partkey") % 60
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc"), left.cast("double").alias("x0"), F.col("l_suppkey").cast("double").alias("y"), (left + 200 + F.col("l_quantity") % 12).cast("double").alias("x1"))
    return inline.cluster_segments(rows, ("doc",)).groupBy("doc").agg(F.countDistinct("cluster").alias("clusters"), F.count("*").alias("n"))


@query()
def heading_tails(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN-04: every block of a document as a demoted heading; repeated lines lose their second text."""
    b = blocks(spark, sf_dir).withColumn("sequence", F.lit(True))
    out = inline.suppress_tails(b)
    return out.groupBy((F.col("translatedText") == "").alias("empty")).agg(F.count("*").alias("n"))


@query(r"""
with l as (select doc_id, generate_subscripts(string_split(text, chr(10)), 1) - 1 as pos, unnest(string_split(text, chr(10))) as text from documents),
b as (select doc_id, pos // 2 as block, pos, greatest(length(trim(regexp_replace(text, '\s+', ' ', 'g'), ' ')), 1) as n, regexp_matches(trim(regexp_replace(text, '\s+', ' ', 'g'), ' '), '[\p{L}\p{N}]') as worth from l),
s as (select doc_id, block, coalesce(sum(n) filter (pos % 3 = 0 and worth), 0)::double / greatest(coalesce(sum(n) filter (worth), 0), 1) as share from b group by all)
select doc_id, count(*) as blocks, round(sum(share), 6) as shares, count(*) filter (share >= 0.95) as code from s group by doc_id
""")
def monospace_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT-31: blocks of two lines, each an item, every third of them monospace; lines without letters or digits do not count."""
    rows = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "text")).withColumn("text", F.when(F.col("text").rlike(r"[\p{L}\p{N}]"), F.col("text")).otherwise("--"))
    item = F.struct("pos", F.col("text"), (F.col("pos") % 3 == 0).alias("isMonospaceLike"))
    lines = F.array(F.struct(F.sort_array(F.collect_list(item)).alias("items")))
    share = rows.groupBy("doc_id", F.floor(F.col("pos") / 2)).agg(lines.alias("layoutLines")).withColumn("share", inline.monospace())
    return share.groupBy("doc_id").agg(F.count("*").alias("blocks"), F.round(F.sum("share"), 6).alias("shares"), F.count(F.when(F.col("share") >= 0.95, 1)).alias("code"))


@query(f"""
with d as (select doc_id, regexp_replace(text, '@', ' ', 'g') as x from documents), t as (select doc_id, len(regexp_extract_all(x, '{inline.TOKENS.replace(chr(39), chr(39) * 2)}')) as n from d)
select doc_id, (2 * n + 3)::bigint as tokens, 3::bigint as formulas, (10.5 + 10.5 + 4)::double as width from t
""")
def mixed_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EXP-11: texts between placeholders as tokens, placeholders with their widths."""
    text = F.regexp_replace("text", "@", " ")
    name = lambda n: F.lit(f"@@INLINE_FORMULA_{n}@@")
    widths = F.create_map(name(1), F.lit(10.5), name(2), F.lit(4.0))
    rows = table(spark, sf_dir, "documents").select("doc_id", formulas.mixed_tokens(F.concat(name(1), text, name(2), text, name(1)), widths).alias("t"))
    held = F.filter("t", lambda x: x["kind"] == "formula")
    return rows.select("doc_id", F.size("t").cast("long").alias("tokens"), F.size(held).cast("long").alias("formulas"), F.aggregate(held, F.lit(0.0), lambda a, x: a + x["width"]).alias("width"))
