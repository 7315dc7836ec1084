"""Subtitles synthesised from ``conversations``, batching, selection, plans and the text stage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from papyrion.operators import batching, selection, translate
from papyrion.registry import query, table
from papyrion.sinks import srt as srt_sink
from papyrion.sources import srt

_TIME_SQL = "lpad((({0}) // 3600)::varchar, 2, '0') || ':' || lpad((({0}) // 60 % 60)::varchar, 2, '0') || ':' || lpad((({0}) % 60)::varchar, 2, '0') || ',000'"
_TEXT_SQL = r"trim(regexp_replace(text, '\s+', ' ', 'g'))"


def _time(seconds):
    part = lambda x: F.lpad(x.cast("string"), 2, "0")
    return F.concat(part(F.floor(seconds / 3600)), F.lit(":"), part(F.floor(seconds / 60) % 60), F.lit(":"), part(seconds % 60), F.lit(",000"))


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One cue per turn, two seconds each; equal (conv_id, turn) rows are one."""
    rows = table(spark, sf_dir, "conversations").groupBy("conv_id", "turn").agg(F.min(F.trim(F.regexp_replace("text", r"\s+", " "))).alias("text"))
    return rows.where("text <> ''")


def srt_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(conv_id, content): a subtitle file for each conversation; every third cue has a name, every fifth settings."""
    t = F.col("turn")
    name = F.when(t % 3 == 1, F.concat(F.lit("\nname"), t)).otherwise("")
    block = F.concat((t + 1).cast("string"), name, F.lit("\n"), _time(t * 2), F.lit(" --> "), _time(t * 2 + 2), F.when(t % 5 == 0, " align:start").otherwise(""), F.lit("\r\n"), F.col("text"))
    ordered = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turn", block.alias("b")))), lambda x: x["b"]), "\n\n\n")
    return turns(spark, sf_dir).groupBy("conv_id").agg(F.concat(F.lit("﻿"), ordered).alias("content"))


_TURNS = f"t as (select conv_id, turn, min({_TEXT_SQL}) as text from conversations group by conv_id, turn having min({_TEXT_SQL}) <> '')"
_CUES = f"""
with {_TURNS}, n as (select *, row_number() over (partition by conv_id order by turn) as sequence from t)
select conv_id, 'node_' || lpad(sequence::varchar, 5, '0') as id, sequence::int as sequence, case when turn % 3 = 1 then 'name' || turn end as cue_identifier,
    {_TIME_SQL.format("turn * 2")} as start, {_TIME_SQL.format("turn * 2 + 2")} as "end", case when turn % 5 = 0 then 'align:start' else '' end as settings, text as source_text,
    turn * 2000 as start_ms, turn * 2000 + 2000 as end_ms from n
"""


@query(_CUES)
def srt_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-05 and SRC-06."""
    return srt.parse(srt_files(spark, sf_dir)).where("error is null").drop("error")


@query(f"""
with c as ({_CUES}),
b as (select conv_id, sequence, sequence::varchar || chr(10) || coalesce(cue_identifier || chr(10), '') || start || ' --> ' || "end" || case when settings <> '' then ' ' || settings else '' end || chr(10) || source_text as x from c)
select conv_id, md5(string_agg(x, chr(10) || chr(10) order by sequence)) as content_md5, count(*) as cues from b group by conv_id
""")
def srt_serialize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK-03."""
    cues = srt.parse(srt_files(spark, sf_dir)).withColumn("translated_text", F.lit(""))
    written = srt_sink.serialize(cues, "conv_id")
    n = cues.groupBy("conv_id").agg(F.count("*").alias("cues"))
    return written.join(n, "conv_id").select("conv_id", F.md5("content").alias("content_md5"), "cues")


@query(f"with c as ({_CUES}) select conv_id, sequence, cue_identifier, start, \"end\", settings, source_text from c")
def srt_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-05 and SNK-03: what is read back from written subtitle files, names and settings included."""
    cues = srt.parse(srt_files(spark, sf_dir)).withColumn("translated_text", F.lit(""))
    again = srt.parse(srt_sink.serialize(cues, "conv_id")).where("error is null")
    return again.select("conv_id", "sequence", "cue_identifier", "start", "end", "settings", "source_text")


@query(f"""
with c as ({_CUES}), e as (select *, replace(replace(replace(replace(source_text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;') as x from c)
select conv_id, md5('<?xml version="1.0" encoding="utf-8"?><html><head><title>Subtitle Document</title></head><body>' || string_agg('<p data-subtitle-id="' || id || '">' || x || '</p>', chr(10) order by sequence) || '</body></html>') as html_md5 from e group by conv_id
""")
def srt_markup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK-04."""
    return srt_sink.to_markup(srt.parse(srt_files(spark, sf_dir)), "conv_id").select("conv_id", F.md5("html").alias("html_md5"))


@query(f"with c as ({_CUES}) select conv_id, id, case when sequence % 4 = 0 then source_text else 'T: ' || source_text end as translated_text from c")
def cue_apply_translation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JOIN-16: every fourth paragraph comes back empty or not at all."""
    cues = srt.parse(srt_files(spark, sf_dir))
    html = F.concat(F.when(F.col("sequence") % 4 == 0, F.lit("<i> </i>")).otherwise(F.concat(F.lit("<b>T: "), F.col("source_text"), F.lit("</b>"))))
    back = cues.where("sequence % 8 <> 0").select("conv_id", "id", html.alias("html"))
    return srt_sink.apply_translation(cues, back, "conv_id").select("conv_id", "id", "translated_text")


_STREAMS = ((1, 0, 1, "fr", 1), (1, 1, 2, "en", 0), (2, 0, 3, "deu", 0), (2, 1, 4, "jpn", 1), (3, 0, 2, None, 0), (3, 1, 1, "xx", 0), (4, 0, 5, "eng", 0), (4, 1, 3, "English", 0))
_STREAM_VALUES = ", ".join(f"({v}, {o}, {i}, {'null' if t is None else repr(t)}, {d})" for v, o, i, t, d in _STREAMS)


def _best(rank: str) -> str:
    return f"""select video, "index" from (select *, row_number() over (partition by video order by {rank}, case when {rank} = 1 then ord else 0 end, "index") as r from s) where r = 1"""


@query(f"""
with s as (select * from (values {_STREAM_VALUES}) v(video, ord, "index", tag, d))
select 'any' as wanted, video, "index" from ({_best("case when tag in ('en', 'eng', 'English') then 0 when d = 1 then 1 else 2 end")})
union all select 'French', video, "index" from ({_best("case when tag = 'fr' then 0 when d = 1 then 1 else 2 end")})
union all select 'Korean', video, "index" from ({_best("case when d = 1 then 1 else 2 end")})
""")
def stream_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TOP-03 and CFG-03 on fixed rows."""
    rows = spark.createDataFrame([(v, o, i, {"language": t} if t else {}, {"default": d}) for v, o, i, t, d in _STREAMS], "video int, ord int, index int, tags map<string,string>, disposition map<string,int>")
    rows = rows.withColumn("resolved_language", srt.languages.stream_language(F.col("tags")))
    picks = [srt.select_stream(rows, "video", w).select(F.lit(w or "any").alias("wanted"), "video", "index") for w in (None, "French", "Korean")]
    return picks[0].unionByName(picks[1]).unionByName(picks[2])


_BINS = """
with recursive l as (select doc_id, generate_subscripts(string_split(text, chr(10)), 1) as pos, length(unnest(string_split(text, chr(10)))) as size from documents),
b as (
    select doc_id, pos, size, 0 as batch, size as held, 1 as n from l where pos = 1
    union all
    select l.doc_id, l.pos, l.size, case when b.held + l.size > {chars} or b.n >= {rows} then b.batch + 1 else b.batch end,
           case when b.held + l.size > {chars} or b.n >= {rows} then l.size else b.held + l.size end, case when b.held + l.size > {chars} or b.n >= {rows} then 1 else b.n + 1 end
    from b join l on l.doc_id = b.doc_id and l.pos = b.pos + 1
)
select doc_id, batch::bigint as batch, count(*) as rows, sum(size)::bigint as chars from b group by doc_id, batch
"""


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line")).select("doc_id", "pos", F.length("line").alias("size"))


def _bins(spark: SparkSession, sf_dir: str, mode: str) -> DataFrame:
    return batching.batches(_lines(spark, sf_dir), "doc_id", "pos", "size", mode).groupBy("doc_id", "batch").agg(F.count("*").alias("rows"), F.sum("size").alias("chars"))


@query(_BINS.format(chars=5000, rows=10**9))
def batch_greedy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN-01 with the limit of 5000 characters."""
    return _bins(spark, sf_dir, "epub")


@query(_BINS.format(chars=6000, rows=24))
def batch_subtitle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN-01 with 6000 characters and 24 rows."""
    return _bins(spark, sf_dir, "subtitle")


_PLAN = "p as (select doc_id // 50 as book, doc_id + case when doc_id % 7 = 0 then 10000000 else 0 end as chapter, row_number() over (order by toxic desc, quality desc, doc_id) as pos from labels)"


@query(f"""
with {_PLAN}, c as (select doc_id // 50 as book, doc_id as chapter, doc_id as ord from documents), m as (select book, chapter, min(pos) as pos from p group by all)
select c.book, c.chapter, row_number() over (partition by c.book order by m.pos is null, m.pos, c.ord)::int as place from c left join m on c.book = m.book and c.chapter = m.chapter
""")
def plan_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JOIN-18: the labelled documents are the plan; some of its entries are unknown."""
    docs = table(spark, sf_dir, "documents").select(F.floor(F.col("doc_id") / 50).alias("book"), F.col("doc_id").alias("chapter"), F.col("doc_id").alias("ord"))
    chapter = F.col("doc_id") + F.when(F.col("doc_id") % 7 == 0, 10_000_000).otherwise(0)
    pos = F.struct((-F.col("toxic")).alias("a"), (-F.col("quality")).alias("b"), "doc_id")
    plan = table(spark, sf_dir, "labels").select(F.floor(F.col("doc_id") / 50).alias("book"), chapter.alias("chapter"), pos.alias("pos"))
    return selection.plan_order(docs, plan)


@query("select doc_id, length(text) as chars from documents d where not exists (select 1 from labels l where l.doc_id = d.doc_id and l.quality = 1)")
def resume_antijoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JOIN-19: documents without a finished label."""
    done = table(spark, sf_dir, "labels").where("quality = 1")
    return selection.unfinished(table(spark, sf_dir, "documents").select("doc_id", F.length("text").alias("chars")), done, "doc_id")


@query("select page_id, url from pages where page_id in (1, 3, 4, 5, 11)")
def page_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT-33: the selection is the feature; it becomes a filter of the scan."""
    return selection.select_pages(table(spark, sf_dir, "pages").select("page_id", "url"), "3-5,1, 11", "page_id")


@query("select item_id, text as title from (select *, row_number() over (order by item_id) as r from benchmark) where r between 2 and 5 or r = 9")
def chapter_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT-34: ranges in any direction."""
    rows = table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("title"))
    return selection.select_chapters(rows, "5-2,9", "item_id")


@query(f"with {_TURNS} select conv_id, turn, array_to_string(list_transform(string_split(text, ' '), lambda w: case w when 'the' then 'LE' when 'of' then 'DE' else w end), ' ') as translated, true as ok from t")
def translate_stub(spark: SparkSession, sf_dir: str) -> DataFrame:
    """UDF-01 with the dictionary stub."""
    return translate.translate(turns(spark, sf_dir), translate.Dictionary({"the": "LE", "of": "DE"})).select("conv_id", "turn", "translated", "ok")


class _Round(translate.Flaky):
    def __init__(self, n: int):
        super().__init__()
        self.round = n


@query()
def translate_retry_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EXE-03: a stub that answers a quarter more in each round; what is left keeps its source."""
    return translate.rounds(turns(spark, sf_dir), _Round).select("conv_id", "turn", "text", "translated", "ok", "round")


@query(f"""
with c as ({_CUES}) select conv_id, conv_id::varchar as file, 'fr' as language, count(*) as cues, min(source_text) as first, max("end") as until from c group by conv_id
""")
def subtitle_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR-26: one JSON document for each subtitle file, read back."""
    out = srt_sink.documents(srt.parse(srt_files(spark, sf_dir)).where("error is null"), "conv_id", F.lit("srt"), F.lit("en"), F.lit("fr"))
    read = F.from_json("document", "version int, sourceFile string, targetLanguage string, cues array<struct<sequence:int,sourceText:string,end:string>>")
    rows = out.select("conv_id", read.alias("d")).where("d.version = 1")
    texts = F.transform("d.cues", lambda c: c["sourceText"])
    return rows.select("conv_id", F.col("d.sourceFile").alias("file"), F.col("d.targetLanguage").alias("language"), F.size("d.cues").cast("long").alias("cues"), F.array_min(texts).alias("first"), F.array_max(F.transform("d.cues", lambda c: c["end"])).alias("until"))
