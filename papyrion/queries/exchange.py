"""Exchange with a provider: lines of ``documents`` are nodes, ten to a batch; the provider is a formula that drops and empties some."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from papyrion.operators import exchange
from papyrion.registry import query, table

KEY = ["doc", "batch"]
_NODES = r"""
l as (select doc_id as doc, generate_subscripts(string_split(text, chr(10)), 1) - 1 as pos, unnest(string_split(text, chr(10))) as text from documents),
k as (select doc, pos // 10 as batch, pos, trim(regexp_replace(regexp_replace(text, '[<>&"`]', ' ', 'g'), '\s+', ' ', 'g'), ' ') as content from l),
nodes as (select doc, batch, pos, 'n' || pos as id, content, count(*) over (partition by doc, batch) as n, (doc * 7 + pos) % 23 as luck from k where content <> '')
"""
_ANSWER = "case when luck = 1 then '' when luck = 2 then '<node id=\"' || id || '\"/>' when n = 1 and luck < 12 then ('T ' || content) else '<node id=\"' || id || '\"> <b>' || ('T ' || content) || '</b> </node>' end"


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), F.posexplode(F.split("text", "\n")).alias("pos", "text"))
    content = F.trim(F.regexp_replace(F.regexp_replace("text", r'[<>&"`]', " "), r"\s+", " "))
    rows = rows.select("doc", F.floor(F.col("pos") / 10).alias("batch"), "pos", F.concat(F.lit("n"), "pos").alias("id"), content.alias("content")).where("content <> ''")
    return rows


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = nodes(spark, sf_dir)
    rows = rows.join(rows.groupBy(*KEY).agg(F.count("*").alias("n")), KEY).withColumn("luck", (F.col("doc") * 7 + F.col("pos")) % 23)
    open_ = F.concat(F.lit('<node id="'), "id", F.lit('"'))
    said = (
        F.when(F.col("luck") == 1, "").when(F.col("luck") == 2, F.concat(open_, F.lit("/>"))).when((F.col("n") == 1) & (F.col("luck") < 12), F.concat(F.lit("T "), "content"))
        .otherwise(F.concat(open_, F.lit("> <b>"), F.concat(F.lit("T "), "content"), F.lit("</b> </node>")))
    )
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", said.alias("x")))), lambda r: r["x"]), "\n")
    return rows.groupBy(*KEY).agg(F.concat(F.lit("```xml\n"), joined, F.lit("\n```")).alias("response"))


@query(f"""
with {_NODES} select doc, batch, md5(case when max(n) = 1 then max(content) else string_agg('<node id="' || id || '">' || content || '</node>', chr(10) order by pos) end) as request_md5, count(*)::int as n from nodes group by doc, batch
""")
def batch_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """UDF-02 and STR-08: batches as they are sent; a lone node goes without markup."""
    out = exchange.requests(nodes(spark, sf_dir), KEY, single=True)
    return out.select(*KEY, F.md5("request").alias("request_md5"), "n")


@query(f"""
with {_NODES}, a as (select *, {_ANSWER} as said from nodes)
select doc, batch, id, case when luck = 2 then '' else '<b>' || ('T ' || content) || '</b>' end as content from a where said like '<node%'
""")
def response_explode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EXP-08: nodes of each response."""
    return exchange.explode_response(responses(spark, sf_dir), KEY)


@query(f"""
with {_NODES}, a as (select *, {_ANSWER} as said from nodes),
g as (select doc, batch, coalesce(string_agg(id, ', ' order by pos) filter (said = '' or luck = 2), '') as gone from a group by doc, batch)
select doc, batch, id, gone = '' as ok, case when gone = '' then '' else 'missing or empty: ' || gone end as error, case when gone = '' then case when n = 1 and luck < 12 then ('T ' || content) else '<b>' || ('T ' || content) || '</b>' end end as translated from a join g using (doc, batch)
""")
def response_accept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JOIN-17, EXE-04 and EXE-06: a batch is accepted whole or fails whole; a lone node may be answered in plain text."""
    return exchange.accept(nodes(spark, sf_dir), responses(spark, sf_dir), KEY).select(*KEY, "id", "ok", "error", "translated")


def _templates_sql() -> str:
    return ", ".join(f"('{m}', '{t}')" for m, t in exchange.TEMPLATES.items())


_FILL = "replace(replace(replace(replace(replace(tpl, '{{TARGET_LANGUAGE}}', 'English'), '{{SOURCE_LANGUAGE}}', coalesce(lang, '')), '{{CHAPTER_TITLE}}', title), '{{GLOSSARY_BLOCK}}', glossary), '{{STYLE_GUIDE}}', 'Plain style.')"


@query(f"""
with t(mode, tpl) as (values {_templates_sql()}),
d as (select doc_id, lang, ['html', 'pdf', 'subtitle', 'other'][(doc_id % 4 + 1)::int] as wanted, regexp_replace(substr(text, 1, 30), '[{{}}]', '', 'g') as title, case when doc_id % 3 = 0 then '' else '* term ' || doc_id end as glossary from documents)
select doc_id, md5(trim({_FILL})) as prompt_md5 from d join t on t.mode = case when wanted in ('html', 'pdf', 'subtitle') then wanted else 'default' end
""")
def prompt_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-19 and STR-20: a prompt for each document, by its kind."""
    kinds = F.array(*map(F.lit, ("html", "pdf", "subtitle", "other")))
    docs = table(spark, sf_dir, "documents").withColumn("mode", F.get(kinds, (F.col("doc_id") % 4).cast("int")))
    values = {
        "TARGET_LANGUAGE": F.lit("English"), "SOURCE_LANGUAGE": F.col("lang"), "CHAPTER_TITLE": F.regexp_replace(F.substring("text", 1, 30), "[{}]", ""),
        "GLOSSARY_BLOCK": F.when(F.col("doc_id") % 3 == 0, "").otherwise(F.concat(F.lit("* term "), "doc_id")), "STYLE_GUIDE": F.lit("Plain style."),
    }
    return docs.select("doc_id", F.md5(exchange.prompt(exchange.template(F.col("mode")), values)).alias("prompt_md5"))
