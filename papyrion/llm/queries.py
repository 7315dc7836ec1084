"""Registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from papyrion.llm import decontaminate, mixing, pii, quality, secrets, simhash, token_output, topk, toxicity, url_filter
from papyrion.llm.shared import table

Query = Callable[[SparkSession, str], DataFrame]


def tokenizer_path() -> str:
    """The default tokenizer file; the operator takes any path."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.personal_data(table(spark, sf_dir, "documents"))


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), k=20, every=20)


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"), url_filter.fixed_rules(spark))


def op7_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_output.token_output(table(spark, sf_dir, "documents"), tokenizer_path())


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Query] = {f.__name__: f for f in (op1_simhash, op2_pii, op3_secrets, op4_quality, op5_topk, op6_url_filter, op7_token_output, op8_mixing, op9_toxicity, op10_decontaminate)}

_TOPK_SQL = """
with v as (
    select vec_id, list_transform(embedding, lambda x: floor(64 * x::double)::bigint) as e from embeddings
    where vec_id is not null and embedding is not null
      and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0
),
d as (select vec_id, unnest(e) as x, generate_subscripts(e, 1) as i from v),
s as (
    select q.vec_id as query_id, c.vec_id as vec_id, sum(q.x * c.x)::bigint as score
    from d q join d c on q.i = c.i and q.vec_id % 20 = 0 and c.vec_id <> q.vec_id group by all
)
select query_id, rank::int as rank, vec_id, score from (
    select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s
) where rank <= 20
"""

_URL_SQL = """
with u as (select page_id, case when instr(url, '://') > 0 then substr(url, instr(url, '://') + 3) else '' end as rest from pages),
h as (select page_id, regexp_extract(rest, '^[^/?#]*') as raw, rest from u),
p as (
    select page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
           regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') as path from h
),
r as (
    select page_id, host, path, case
        when ('.' || host) like '%.www.example.com' and path like '/en/%' then 'www.example.com/en/'
        when ('.' || host) like '%.example.com' and path like '/en/%' then 'example.com/en/'
        when ('.' || host) like '%.net' and path like '/es/%' then 'net/es/'
        when ('.' || host) like '%.net' and path like '/fr/%' then 'net/fr/'
        when ('.' || host) like '%.com' and path like '/%' then 'com/' end as rule from p
)
select page_id, host, path, rule,
       case when rule in ('example.com/en/', 'net/es/', 'net/fr/') then 'block' else 'allow' end as verdict from r
"""

_MIX_SQL = r"""
with sized as (
    select row_number() over () as row, doc_id, source,
           coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size,
           md5('42:' || coalesce(doc_id::varchar, '')) as key from documents
),
src as (select source, sum(size)::bigint as source_size, row_number() over (order by encode(source) nulls last) - 1 as place from sized group by source),
w as (select *, ([5, 2, 1])[(place % 3 + 1)::int] as weight, 3 * source_size as stop from src),
lv as (
    select *, (sum(source_size) over () - coalesce(sum(stop) over o, 0))::double / (sum(weight) over () - coalesce(sum(weight) over o, 0))::double as lev from w
    window o as (order by stop::double / weight, place rows between unbounded preceding and 1 preceding)
),
goal as (
    select source, source_size, least(stop::double, (select max(lev) from lv where lev <= stop::double / weight) * weight) as target from lv
),
served as (
    select s.*, g.source_size, g.target, sum(size) over (partition by s.source order by key, doc_id, size, row rows unbounded preceding)::bigint as total
    from sized s join goal g on s.source is not distinct from g.source where size > 0
),
queue as (
    select row, doc_id, key, size, copy, (total + copy * source_size)::double / target as finish
    from served cross join (select unnest([0, 1, 2]) as copy)
    where (total + copy * source_size - size)::double / target < 1
),
run as (select *, sum(size) over (order by finish, key, doc_id, size, row, copy rows unbounded preceding) as running from queue),
taken as (select row, count(*) as copies from run where running <= (select sum(source_size) from src) group by row)
select s.doc_id, s.size, g.source_size, g.target, (s.size * coalesce(t.copies, 0))::bigint as taken
from sized s join goal g on s.source is not distinct from g.source left join taken t on s.row = t.row
"""

ORACLES: dict[str, str] = {"op5_topk": _TOPK_SQL, "op6_url_filter": _URL_SQL, "op8_mixing": _MIX_SQL}
