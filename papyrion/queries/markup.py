"""Markup operators over ``pages``; a book is a host."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from papyrion.functions import text
from papyrion.operators import structure
from papyrion.registry import query, table
from papyrion.sources import html as dom


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages")


def _counts(rows: DataFrame) -> DataFrame:
    c = text.classify_node(F.col("tag"), F.col("text"), F.col("content"), F.col("css_class"), F.lit(False))
    judged = rows.where("id <> ''").withColumn("c", c)
    return judged.groupBy("tag", "c.type", "c.action", "c.reason").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))


@query()
def html_visible_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EXP-02, FLT-01 and FLT-02: visible text elements by verdict."""
    return _counts(dom.explode(_pages(spark, sf_dir), "page_id", dom.visible_body))


@query()
def html_explicit_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EXP-01."""
    return _counts(dom.explode(_pages(spark, sf_dir), "page_id", dom.explicit))


@query()
def html_structural_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EXP-03."""
    return _counts(dom.explode(_pages(spark, sf_dir), "page_id", dom.structural_body))


@query()
def html_exclusion_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """LOG-01: excluded elements by reason, in both ways to choose."""
    pages = _pages(spark, sf_dir)
    ways = [dom.explode(pages, "page_id", how).where("id = ''").select(F.lit(name).alias("way"), "reason", "tag") for name, how in (("visible", dom.visible_body), ("structural", dom.structural_body))]
    return ways[0].unionByName(ways[1]).groupBy("way", "reason").agg(F.count("*").alias("n"), F.countDistinct("tag").alias("tags"))


@query()
def html_pseudo_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EXP-04 and FLT-03: a table of dots and the page's own tables."""
    grid = "<table>" + "<tr>" + "<td>0</td><td>o.</td><td>#</td>" * 5 + "</tr></table>"
    pages = _pages(spark, sf_dir).select("page_id", F.concat("html", F.when(F.col("page_id") % 2 == 0, grid).otherwise("<table><tr><td>plain words here</td></tr></table>")).alias("html"))
    rows = dom.explode(pages, "page_id", dom.tables)
    kind = text.classify_node(F.col("tag"), F.col("text"), F.col("content"), F.col("css_class"), text.pseudo_table(F.col("cells"), F.col("content")))
    marked = rows.withColumn("c", kind)
    return marked.groupBy("c.type", "c.action", text.placeholder(F.col("c.type"), F.lit("div")).alias("placeholder")).agg(F.count("*").alias("n"))


_HEADS = r"""
h as (select page_id, regexp_extract_all(html, '(?is)<h([1-6])[^>]*>(?:.*?)</h[1-6]>', 1) as levels, regexp_extract_all(html, '(?is)<h[1-6][^>]*>(.*?)</h[1-6]>', 1) as raw from pages),
x as (select page_id, generate_subscripts(raw, 1) - 1 as ord, 'h' || unnest(levels) as tag, trim(regexp_replace(replace(regexp_replace(unnest(raw), '<[^>]*>', '', 'g'), chr(160), ' '), '\s+', ' ', 'g')) as text from h)
"""


@query(f"with {_HEADS}, r as (select *, row_number() over (partition by page_id, text order by ord) as r from x where text <> '') select page_id, ord, tag, text from r where r = 1")
def html_headings_unique(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EXP-05."""
    rows = dom.explode(_pages(spark, sf_dir), "page_id", dom.headings)
    return dom.unique_headings(rows, "page_id").select("page_id", "ord", "tag", "text")


@query(f"with {_HEADS}, r as (select *, page_id // 25 as book from x where text <> '') select book, page_id as chapter, ord, tag, 'std_' || (row_number() over (partition by book order by page_id, ord) - 1) as id, text from r")
def html_headings_numbered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EXP-06: headings of 25 pages in a row, numbered on and on."""
    rows = dom.explode(_pages(spark, sf_dir), "page_id", dom.headings).withColumn("book", F.expr("page_id div 25")).withColumnRenamed("page_id", "chapter")
    return dom.numbered_headings(rows, "book").select("book", "chapter", "ord", "tag", "id", "text")


_LINKS = r"""
l as (select page_id, regexp_extract_all(html, '(?i)<a\s[^>]*?href\s*=\s*["'']([^"'']*)["'']', 1) as hs from pages),
k as (select page_id, generate_subscripts(hs, 1) - 1 as ord, unnest(hs) as href from l),
f as (select page_id, ord::int as ord, href, case when instr(href, '#') > 0 then substr(href, 1, instr(href, '#') - 1) else href end as file, case when instr(href, '#') > 0 then substr(href, instr(href, '#') + 1) end as anchor from k)
"""


@query(f"with {_LINKS} select * from f")
def html_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EXP-07."""
    return dom.links(_pages(spark, sf_dir), "page_id")


@query(f"with {_LINKS} select distinct anchor from f where anchor <> ''")
def html_referenced_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-18."""
    return dom.referenced_ids(_pages(spark, sf_dir), "page_id")


@query(r"select distinct unnest(regexp_extract_all(html, '\.([a-zA-Z][\w-]*)', 1)) as class from pages")
def css_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-17; whole pages stand for style sheets."""
    return dom.css_classes(_pages(spark, sf_dir), "html")


@query(r"""
with u as (select page_id, url, regexp_replace(lower(replace(split_part(url, '#', 1), chr(92), '/')), '^\./', '') as have from pages)
select page_id, trim(have) as href, regexp_extract(have, '[^/]*$') as tail from u where not contains(url, '%')
""")
def href_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JOIN-02: normalised urls, escaped ones too; the SQL, without a decoder that keeps a plus, fits tables that have none of these."""
    have = structure.normalize_href(F.col("url"))
    return _pages(spark, sf_dir).select("page_id", have.alias("href"), F.regexp_extract(have, "[^/]*$", 0).alias("tail"))


_CHAPTERS = "c as (select page_id // 25 as book, page_id as chapter, page_id as ord, 'Text/ch' || page_id || '.xhtml' as href from pages)"


@query(f"""
with {_CHAPTERS}, l as (select book, chapter as link, case when chapter % 3 = 0 then 'ch' || chapter || '.xhtml' when chapter % 3 = 1 then '../OEBPS/Text/ch' || chapter || '.xhtml' else 'missing' || chapter end as file from c)
select book, link, link as chapter from l where file not like 'missing%'
""")
def href_suffix_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JOIN-02: links that name the end of a chapter's path, or have it as their end."""
    c = F.col("chapter").cast("string")
    chapters = _pages(spark, sf_dir).select(F.floor(F.col("page_id") / 25).alias("book"), F.col("page_id").alias("chapter"), F.col("page_id").alias("ord")).withColumn("href", F.concat(F.lit("Text/ch"), c, F.lit(".xhtml")))
    file = F.when(F.col("chapter") % 3 == 0, F.concat(F.lit("./ch"), c, F.lit(".xhtml#x"))).when(F.col("chapter") % 3 == 1, F.concat(F.lit("../OEBPS/Text/ch"), c, F.lit(".xhtml"))).otherwise(F.concat(F.lit("missing"), c))
    links = chapters.select("book", F.col("chapter").alias("ord"), file.alias("file"))
    return structure.find_chapters(links, chapters, "book").select("book", "link", "chapter")


@query()
def structural_book_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-07, AGG-08, FLT-11 and FLT-12: a host's pages are a book."""
    pages = _pages(spark, sf_dir)
    measured = structure.metrics(pages, "page_id").join(pages.select("page_id", F.regexp_extract("url", "://([^/]*)", 1).alias("book")), "page_id")
    return structure.verdict(measured, "book").groupBy("enabled", "fallback", "strong", "prefer_structural").agg(F.count("*").alias("n"), F.sum("body").alias("chars"))


@query()
def contents_sync(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JOIN-03 and JOIN-04: every 25 pages are a book whose first page links to the others."""
    pages = _pages(spark, sf_dir)
    chapters = pages.select(F.floor(F.col("page_id") / 25).alias("book"), F.col("page_id").alias("chapter"), F.col("page_id").alias("ord"), F.concat(F.lit("ch"), "page_id", F.lit(".xhtml")).alias("href"), "html")
    link = F.concat(F.lit('<a href="ch'), "chapter", F.lit('.xhtml">x</a>'))
    contents = chapters.groupBy("book").agg(F.min("chapter").alias("chapter"), F.array_join(F.array_sort(F.collect_list(link)), "").alias("html"))
    return structure.sync_contents(chapters, contents, "book").select("book", "chapter", "title")
