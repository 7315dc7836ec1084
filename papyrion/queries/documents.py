"""Tables, repairs, validation, e-books, jobs and the streaming extension."""

from __future__ import annotations

import io
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from papyrion.operators import repair, tables, translate
from papyrion.plans import jobs
from papyrion.queries.flow import srt_files
from papyrion.queries.layout import blocks
from papyrion.registry import query, table
from papyrion.runtime import ensure_checkpoint_dir
from papyrion.sinks import epub as epub_sink
from papyrion.sources import epub
from papyrion.streaming import incremental


def grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of orders: a caption, and a row block with number cells for each line item; an order is a page."""
    item = lambda k, c, top: F.struct(F.lit("text").alias("type"), c.cast("string").alias("text"), F.array(F.lit(80.0 + 110 * k), top, F.lit(130.0 + 110 * k), top + 9.0).alias("bbox"))
    one = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_quantity").cast("int").alias("a"), F.max("l_partkey").alias("b"), F.max("l_suppkey").alias("c"), F.max("l_extendedprice").cast("int").alias("d"))
    top = (100.0 + F.col("l_linenumber") * 12).cast("double")
    cells = F.array(*(item(k, F.col(c), top) for k, c in enumerate("abcd")))
    text = F.concat_ws(" ", "a", "b", "c", "d", "a", "b", "c", "d")
    body = one.select(F.col("l_orderkey").alias("doc"), F.lit(1).alias("page"), F.concat(F.lit("r"), "l_linenumber").alias("id"), F.lit(612.0).alias("pageWidth"), F.array(F.lit(80.0), top, F.lit(460.0), top + 9.0).alias("bbox"), text.alias("text"), F.lit(9.0).alias("fontSize"), F.lit("table_body").alias("blockType"), F.lit("paragraph").alias("role"), F.array(F.struct(F.array(F.lit(80.0), top, F.lit(460.0), top + 9.0).alias("bbox"), cells.alias("items"))).alias("layoutLines"))
    title = one.select(F.col("l_orderkey").alias("doc")).distinct()
    box = F.array(F.lit(80.0), F.lit(88.0), F.lit(460.0), F.lit(100.0))
    title = title.select("doc", F.lit(1).alias("page"), F.lit("cap").alias("id"), F.lit(612.0).alias("pageWidth"), box.alias("bbox"), F.concat(F.lit("Table 1: order "), "doc").alias("text"), F.lit(9.0).alias("fontSize"), F.lit("caption").alias("blockType"), F.lit("paragraph").alias("role"), F.array(F.struct(box.alias("bbox"), F.array(item(0, F.lit("Table 1"), F.lit(88.0))).alias("items"))).alias("layoutLines"))
    return body.unionByName(title)


#: Lines more than 34 points apart (over three numbers) part two tables; a line alone is none.
_ISLANDS = """
d as (select distinct l_orderkey as doc, l_linenumber as k from lineitem),
g as (select *, case when k - lag(k) over (partition by doc order by k) <= 3 then 0 else 1 end as begins from d),
i as (select *, sum(begins) over (partition by doc order by k) as island from g),
t as (select doc, island, count(*) as rows from i group by all having count(*) >= 2)
"""


@query(f"with {_ISLANDS} select doc, count(*)::bigint as tables, sum(rows)::bigint as rows from t group by doc")
def table_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TBL-01 and WIN-16: the tables of every order, parted at its gaps or not."""
    found = tables.detect(grid(spark, sf_dir)).where("kind = 'table'")
    return found.groupBy("doc").agg(F.count("*").alias("tables"), F.sum(F.size("bodyBlockIds")).alias("rows"))


@query(f"with {_ISLANDS} select doc, sum(rows)::bigint as marked from t group by doc")
def table_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JOIN-15: blocks of tables become preserved table blocks."""
    g = grid(spark, sf_dir).withColumns({"preserveOriginal": F.lit(False), "preserveReason": F.lit("")})
    return tables.mark(g, tables.detect(g)).where("tableRole = 'table_body' and preserveOriginal").groupBy("doc").agg(F.count("*").alias("marked"))


def mend(sources: list[str], texts: list[str]) -> list[str | None]:
    """Offline stub: the source in upper case."""
    return [s.upper() for s in sources]


@query()
def repair_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN-05 and FLT-36: every seventh translation is cut to a fifth, so its run looks wrong."""
    b = blocks(spark, sf_dir).withColumn("role", F.lit("paragraph"))
    broken = b.withColumn("translatedText", F.when(F.col("pos") % 7 == 3, F.substr("translatedText", F.lit(1), F.floor(F.length("text") / 5).cast("int"))).otherwise(F.col("translatedText")))
    fixed = repair.repair(broken, mend)
    return fixed.groupBy("repaired").agg(F.count("*").alias("n"), F.sum(F.length("translatedText")).alias("chars"))


@query(r"""
with l as (select doc_id as doc, generate_subscripts(string_split(text, chr(10)), 1) - 1 as pos, unnest(string_split(text, chr(10))) as text from documents),
b as (select *, (pos // 12 + 1)::int as page, regexp_replace(text, '\s+', '', 'g') as c, regexp_replace('T ' || text, '\s+', '', 'g') as t from l),
p as (select doc, page, string_agg(case when pos % 5 = 1 then c || chr(10) || t when pos % 5 = 2 then '' when pos % 5 = 3 then t || t else t end, chr(10) order by pos) as raw from b group by doc, page),
q as (select doc, page, regexp_replace(raw, '\s+', '', 'g') as pg from p),
n as (select b.doc, b.page, substr(c, 1, 80) as s, substr(t, 1, 80) as g, length(c) as cl, length(t) as tl, pg from b join q using (doc, page)),
h as (select *, case when cl >= 12 then (length(pg) - length(replace(pg, s, ''))) // length(s) end as hs, case when tl >= 12 then (length(pg) - length(replace(pg, g, ''))) // length(g) end as ht from n)
select type, count(*) as n from (
    select case when hs > 0 and s <> coalesce(case when tl >= 12 then g end, '') then 'source_text_residue' end as type from h
    union all select case when ht = 0 then 'translation_missing' end from h union all select case when ht > 1 then 'translation_duplicate' end from h) where type is not null group by type
""")
def text_layer_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """VAL-01: pages on which some translations are missing, doubled or stand beside their source."""
    b = blocks(spark, sf_dir).withColumn("translatedText", F.concat(F.lit("T "), "text")).withColumns({"action": F.lit("replace"), "expectedAction": F.lit("replace")})
    kind = F.col("pos") % 5
    shown = F.when(kind == 1, F.concat_ws("\n", "text", "translatedText")).when(kind == 2, "").when(kind == 3, F.concat("translatedText", "translatedText")).otherwise(F.col("translatedText"))
    page = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", shown.alias("s")))), lambda x: x["s"]), "\n")
    pages = b.groupBy("doc", "page").agg(page.alias("pageText"))
    return repair.text_issues(b, pages).groupBy("type").agg(F.count("*").alias("n"))


def book_of(chapters: list[tuple[int, str]]) -> bytes:
    """A small e-book; its names hold spaces."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("mimetype", "application/epub+zip", compress_type=zipfile.ZIP_STORED)
        items = "".join(f'<item id="c{k}" href="Text/ch%20{k}.xhtml" media-type="application/xhtml+xml"/>' for k, _ in chapters)
        z.writestr("OEBPS/content.opf", f'<package xmlns="http://www.idpf.org/2007/opf"><manifest>{items}<item id="gone" href="no.xhtml" media-type="application/xhtml+xml"/><item id="css" href="s.css" media-type="text/css"/></manifest></package>')
        for k, html in chapters:
            z.writestr(f"OEBPS/Text/ch {k}.xhtml", html)
    return out.getvalue()


def books(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, content): 25 pages in a row are an e-book."""
    import pandas as pd

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = sorted(zip(pdf["page_id"].tolist(), pdf["html"].tolist(), strict=True))
        return pd.DataFrame({"path": [f"book{int(pdf['book'].iloc[0])}.epub"], "content": [book_of(rows)]})

    pages = table(spark, sf_dir, "pages").select(F.floor(F.col("page_id") / 25).alias("book"), "page_id", "html")
    return pages.groupBy("book").applyInPandas(run, "path string, content binary")


@query("select 'book' || (page_id // 25) || '.epub' as path, count(*) as chapters, sum(length(html))::bigint as chars, true as same from pages group by 1")
def epub_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-02, SNK-01 and JOIN-01: chapters out of e-books, marked, written back and read again."""
    files = books(spark, sf_dir)
    first = epub.chapters(files)
    marked = first.withColumn("html", F.concat("html", F.lit("<!-- x -->")))
    again = epub.chapters(epub_sink.write_epub(files, marked)).select("path", "id", F.col("html").alias("now"))
    both = first.join(again, ["path", "id"], "full_outer")
    same = F.col("now").eqNullSafe(F.concat("html", F.lit("<!-- x -->")))
    return both.groupBy("path").agg(F.count("*").alias("chapters"), F.sum(F.length("html")).alias("chars"), F.bool_and(same).alias("same"))


@query("select conv_id, count(distinct turn) as cues, count(distinct turn) as again from conversations where trim(text) <> '' group by conv_id")
def subtitle_job(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JOB-04 with the identity stub."""
    return jobs.subtitles(srt_files(spark, sf_dir), translate.Identity(), "conv_id").select("conv_id", "cues", "again")


@query()
def html_job(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JOB-02 and JOB-05: pages without a finished label through the upper-case stub."""
    done = table(spark, sf_dir, "labels").where("quality = 1").select(F.col("doc_id").alias("page_id"))
    out = jobs.html(table(spark, sf_dir, "pages"), translate.Upper(), "page_id", done)
    return out.groupBy("ok").agg(F.countDistinct("page_id").alias("pages"), F.count("*").alias("nodes"), F.sum(F.length("translated")).alias("chars"))


@query()
def block_job(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JOB-03 on the blocks of documents."""
    return jobs.blocks(blocks(spark, sf_dir).drop("pos"), translate.Upper()).groupBy("blockType", "action").agg(F.count("*").alias("n"))


@query()
def incremental_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extension: pages as a stream of files, their visible nodes appended batch by batch."""
    shared = f"{ensure_checkpoint_dir(spark).rstrip('/')}/incremental-{uuid.uuid4().hex}"
    table(spark, sf_dir, "pages").repartition(3).write.parquet(f"{shared}/in")
    stream = incremental.nodes(incremental.pages(spark, f"{shared}/in", files_per_batch=1))
    incremental.into_table(stream, f"{shared}/out", f"{shared}/state", "page_id").awaitTermination()
    out = spark.read.parquet(f"{shared}/out")
    return out.groupBy("tag").agg(F.count("*").alias("n"), F.countDistinct("page_id").alias("pages"))
