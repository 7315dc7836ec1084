"""Term mining over ``documents``: a book is 50 documents in a row, a chapter is a document."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from papyrion.functions.text import signature
from papyrion.operators import glossary
from papyrion.registry import query, table

_WORDS = r"""
docs as (select doc_id // 50 as book, doc_id as chapter, text from documents),
w0 as (select book, chapter, list_filter(regexp_extract_all(lower(text), '[a-z0-9_]+'),
       lambda x: length(x) > 1 and x not in ('the','and','a','of','to','in','is','it','that','with','as','for','was')) as ws from docs),
w as (select book, chapter, unnest(ws) as word, generate_subscripts(ws, 1) - 1 as pos from w0)
"""


def _grams(n: int, over: str) -> str:
    parts = " || ' ' || ".join(["word", *(f"lead(word, {k}) over o" for k in range(1, n))])
    return f"(select book, chapter, pos, {parts} as term from w window o as (partition by {over} order by chapter, pos))"


def _top(n: int, k: int) -> str:
    return f"""
with {_WORDS}, g as {_grams(n, "book")},
c as (select book, term, count(*) as count, min((chapter, pos)) as first from g where term is not null group by book, term),
r as (select book, term, count, row_number() over (partition by book order by count desc, first) as place from c)
select book, term, count, place from r where place <= {k}
"""


def chapters(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.select(F.floor(F.col("doc_id") / 50).alias("book"), F.col("doc_id").alias("chapter"), "text")


def _words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return glossary.word_lists(chapters(spark, sf_dir))


@query(_top(1, 100))
def unigram_top100(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-01 and TOP-01."""
    return glossary.top_terms(glossary.ngrams(_words(spark, sf_dir), 1), 100)


@query(_top(2, 100))
def bigram_top100(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-02 and AGG-03: pairs across chapter borders count."""
    return glossary.top_terms(glossary.ngrams(_words(spark, sf_dir), 2), 100)


@query(_top(3, 100))
def trigram_top100(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-03."""
    return glossary.top_terms(glossary.ngrams(_words(spark, sf_dir), 3), 100)


@query(_top(4, 50))
def fourgram_top50(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-03."""
    return glossary.top_terms(glossary.ngrams(_words(spark, sf_dir), 4), 50)


def _chapter_list(n: int, k: int) -> str:
    return f"""select book, term, count, {n} as n, chapter, place from (
    select book, chapter, term, count(*) as count, row_number() over (partition by book, chapter order by count(*) desc, min(pos)) as place
    from {_grams(n, "book, chapter").replace("from w window", "from lw window")} where term is not null group by book, chapter, term) where place <= {k} and count >= 3"""


_CHAPTERS = f"""
lw as (select * from w where (book, chapter) in (select (book, chapter) from w group by book, chapter having count(*) >= 50)),
cl as ({" union all ".join(_chapter_list(n, k) for n, k in glossary.CHAPTER_LISTS)}),
cs as (select book, term, sum(count)::bigint as count, min((chapter, n, place)) as first from cl group by book, term),
ct as (select book, term, count, row_number() over (partition by book order by count desc, first) as place from cs qualify place <= 150)
"""


@query(f"with {_WORDS}, {_CHAPTERS} select book, term, count, place from ct")
def chapter_ngram_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-04."""
    return glossary.chapter_terms(_words(spark, sf_dir))


def _book_list(i: int, n: int, k: int) -> str:
    return f"""select book, term, count, place, {i} as list from (select book, term, count(*) as count, row_number() over (partition by book order by count(*) desc, min((chapter, pos))) as place
    from {_grams(n, "book")} where term is not null group by book, term) where place <= {k} and count >= 3"""


_CANDIDATES = f"""
with {_WORDS}, {_CHAPTERS},
al as ({" union all ".join(_book_list(i, n, k) for i, (n, k) in enumerate(glossary.BOOK_LISTS))} union all select book, term, count, place, 4 as list from ct),
f as (select *, row_number() over (partition by book, term order by list, place) as r from al),
h as (select f.book, f.term, d.chapter, instr(lower(d.text), lower(f.term)) as hit, d.text from f join docs d on f.book = d.book and contains(lower(d.text), lower(f.term)) where f.r = 1),
x as (select book, term, arg_min('...' || trim(regexp_replace(substr(text, greatest(hit - 41, 0) + 1, least(hit - 1 + length(term) + 40, length(text)) - greatest(hit - 41, 0)), '\\s+', ' ', 'g')) || '...', chapter) as context from h group by book, term)
select f.book, f.term, f.count, f.list, f.place, coalesce(x.context, '') as context from f left join x on f.book = x.book and f.term = x.term where f.r = 1
"""


@query(_CANDIDATES)
def glossary_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SET-01, AGG-05 and STR-04: candidates of each book with the context of their first chapter."""
    found = glossary.candidates(_words(spark, sf_dir))
    return glossary.with_context(found, chapters(spark, sf_dir)).select("book", "term", "count", "list", "place", "context")


@query("""
with g as (select distinct lower(split_part(text, ' ', 2)) as term from benchmark where split_part(text, ' ', 2) <> '')
select d.doc_id, count(*) as n, min(g.term) as first, max(g.term) as last from documents d join g on contains(lower(d.text), g.term) group by d.doc_id
""")
def glossary_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JOIN-05: terms (a word of each benchmark item) in documents."""
    terms = table(spark, sf_dir, "benchmark").select(F.lower(F.split_part("text", F.lit(" "), F.lit(2))).alias("term"))
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("content"))
    hits = glossary.found_terms(docs, terms)
    return hits.groupBy("doc_id").agg(F.count("*").alias("n"), F.min("term").alias("first"), F.max("term").alias("last"))


@query(r"""
with l as (select doc_id as page, string_split(text, chr(10)) as ls from documents),
z as (select page, 'top' as zone, ls[1] as x from l union all select page, 'bottom', ls[len(ls)] from l),
s as (select page, zone, regexp_replace(lower(trim(regexp_replace(x, '\s+', ' ', 'g'))), '\d+', '#', 'g') as signature from z)
select zone, signature, count(distinct page) as pages from s where length(signature) between 3 and 160 group by zone, signature having count(distinct page) >= 2
""")
def repeated_periphery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-15 and FLT-26: first and last lines that several documents share."""
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("page"), F.split("text", "\n").alias("ls"))
    zones = rows.select("page", F.inline(F.array(F.struct(F.lit("top").alias("zone"), F.col("ls")[0].alias("x")), F.struct(F.lit("bottom").alias("zone"), F.element_at("ls", -1).alias("x")))))
    lines = zones.select("page", "zone", signature("x").alias("signature")).where(F.length("signature").between(3, 160))
    return glossary.repeated_periphery(lines)


@query("select event_type as label, count(*) as n from events group by 1 order by 2 desc, 1 limit 6")
def label_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-19: label counts, the six most frequent (the feature is a preview of labels)."""
    return table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("label")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "label").limit(6)


@query("select item_id, (row_number() over (order by item_id) - 1) // 100 as chunk from benchmark")
def candidate_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN-18."""
    return glossary.chunks(table(spark, sf_dir, "benchmark").select("item_id"), "item_id")


@query("""
with p as (select lang, source as term, lower(source) || '-' || lang as translation, doc_id as ord from documents),
f as (select *, row_number() over (partition by lang, term order by ord) as r from p)
select lang, count(*) as n, min(term) as first, max(translation) as last from f where r = 1 group by lang
""")
def glossary_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-06: pairs of each language, first wins."""
    pairs = table(spark, sf_dir, "documents").select("lang", F.col("source").alias("term"), F.concat(F.lower("source"), F.lit("-"), "lang").alias("translation"), F.col("doc_id").alias("ord"))
    firsts = glossary.first_wins(pairs, ("lang", "term"), ("ord",))
    return firsts.groupBy("lang").agg(F.count("*").alias("n"), F.min("term").alias("first"), F.max("translation").alias("last"))
