"""Row rules and string functions over lines and tokens of ``documents``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from papyrion.functions import languages, text
from papyrion.registry import query, table

#: Rows that the corpus itself does not have, so that every rule is seen.
PROBES = (
    "", "   ", "bad � char", "Table 3", "FIG. 2-a", "Figure 1: Results", "12", "1.5", "A b", "123", "1,234.50", "....a", "---x",
    "x^2 + y^2 = z", "sin x + cos y", "a * b * c", "the state |0⟩ equals the vector = here", "⟨a| = b is a state vector here", "--- *** ---", "Привет мир", "4%a!1", "#1@2", "[1]",
    "同上。", "ibid.", "Same as above", "(NOTE: node_12 was kept)", "node_3 sid 4 kept", "（注：按规则）", "plain text with words", "∑ a_i = b_{j} ≤ c^2", "H₂O and CO₂ with x⁻³ units", " glyph",
    "$x+1$", "\\(a\\)", "$$b$$", "```json\n{}\n```", "a < b & c > \"d\"", "Ab 1你", "我们 です 漢字", "이것은", "été année", "El niño comió", "à la forêt", "nodes 12", "https://a.b/c?d",
)
_WS = r"[\s\x{0B}\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]+"
_PROBE_SQL = "(select unnest([" + ", ".join("'" + p.replace("'", "''") + "'" for p in PROBES) + "]) as x)"
#: Lines of all documents and the probes, as ``t(x)``.
_LINES = f"t as (select unnest(string_split(text, chr(10))) as x from documents union all select x from {_PROBE_SQL})"
_TOKENS = f"t as (select unnest(regexp_split_to_array(text, '[ \\n]')) as x from documents union all select x from {_PROBE_SQL})"
_N = f"trim(regexp_replace(coalesce(x, ''), '{_WS}', ' ', 'g'))"
_C = f"regexp_replace(coalesce(x, ''), '{_WS}', '', 'g')"


def _count(text_: str, pattern: str) -> str:
    return f"len(regexp_extract_all({text_}, '{pattern}'))"


def _probes(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(p,) for p in PROBES], "x string")


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.explode(F.split("text", "\n")).alias("x")).unionByName(_probes(spark))


def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.explode(F.split("text", "[ \n]")).alias("x")).unionByName(_probes(spark))


def _ladder(source: str) -> str:
    return f"""
with {source},
m as (select x, {_N} as n, {_C} as c from t),
k as (select *, {_count("n", "[A-Za-z]")} as a, {_count("n", "[0-9]")} as d, {_count("n", "[^A-Za-z0-9[:space:]]")} as s, {_count("n", "[A-Za-z]{3,}")} as w, length(c) as z from m),
r as (select case
    when n = '' then 'TEXT_NOISE/DROP/empty'
    when contains(n, '�') then 'TEXT_NOISE/DROP/replacement_char'
    when regexp_matches(n, '(?i)^(fig(?:ure)?\\.?|table)\\s*[A-Za-z0-9.\\-:]*$') then 'CAPTION/KEEP/caption_label'
    when z <= 3 and a <= 2 and d <= 2 and w = 0 then 'TEXT_NOISE/DROP/short_noise'
    when regexp_matches(n, '^\\d+(?:[.,:/-]\\d+)*$') then 'TEXT_NUMERIC/KEEP/numeric_only'
    when regexp_matches(n, '^([A-Za-z]\\s+[A-Za-z][\\-.,:]?|[.\\-_:]{{3,}}[A-Za-z]?|[A-Za-z]?[.\\-_:]{{3,}})$') then 'TEXT_NOISE/DROP/broken_ocr_fragment'
    when regexp_matches(n, '[=≈≤≥∑∫√^×÷]|(?:^|[^A-Za-z0-9_])(?:sin|cos|tan|log|ln)(?:$|[^A-Za-z0-9_])|[A-Za-z0-9]\\s*[*]\\s*[A-Za-z0-9]') and a + d > 0 and s >= 2 and w <= 2 then 'FORMULA/SKIP/formula_like_text'
    when regexp_matches(n, '\\|[^|]+⟩|⟨[^⟩]+\\|') and contains(n, '=') then 'FORMULA/SKIP/quantum_notation'
    when w = 0 and z >= 4 and (regexp_matches(n, '^[0-9oO#.:,_\\-/\\\\|()\\[\\]{{}}*+=~`"'' ]+$') or s / greatest(z, 1) >= 0.45) then 'TEXT_NOISE/DROP/mostly_symbols'
    when w = 0 and z <= 6 and a <= 2 and s + d >= greatest(z - 1, 1) then 'TEXT_NOISE/DROP/isolated_fragment'
    else 'TEXT_NORMAL/KEEP/default_keep' end as v, length(n) as chars from k)
select split_part(v, '/', 1) as type, split_part(v, '/', 2) as action, split_part(v, '/', 3) as reason, count(*) as n, sum(chars)::bigint as chars from r group by all
"""


def _classified(rows: DataFrame) -> DataFrame:
    c = text.classify_text("x")
    judged = rows.select(c.alias("c"), F.length(text.normalize("x")).alias("chars"))
    return judged.groupBy("c.type", "c.action", "c.reason").agg(F.count("*").alias("n"), F.sum("chars").alias("chars"))


@query(_ladder(_LINES))
def text_classify_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT-01 over lines: rows and characters by verdict."""
    return _classified(lines(spark, sf_dir))


@query(_ladder(_TOKENS))
def text_classify_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT-01 over tokens."""
    return _classified(tokens(spark, sf_dir))


@query(f"""
with {_TOKENS}, m as (select {_C} as c from t), k as (select c, {_count("c", "[^\\p{L}\\p{N}]")} as o from m)
select c = '' or regexp_matches(c, '^\\d+(?:[.,:/-]\\d+)*$') or o = length(c) or o / greatest(length(c), 1) >= 0.6 as symbols, count(*) as n, sum(length(c))::bigint as chars
from k group by 1
""")
def mostly_symbols_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT-04 over tokens."""
    return tokens(spark, sf_dir).groupBy(text.mostly_symbols("x").alias("symbols")).agg(F.count("*").alias("n"), F.sum(F.length(text.compact("x"))).alias("chars"))


@query(f"""
with {_LINES}, m as (select x, {_N} as n from t),
k as (select x, n, regexp_matches(n, '(?i)^[（(]?\\s*(注|NOTE)\\s*[:：]')::int + regexp_matches(n, '(?i)(?:^|[^A-Za-z0-9_])node[_\\s-]?\\d+(?:$|[^A-Za-z0-9_])')::int
    + regexp_matches(n, '(?i)(?:^|[^A-Za-z0-9_])sid(?:$|[^A-Za-z0-9_])')::int + regexp_matches(n, '按规则|严格保留|不合并|不调整|原文此处编号有误')::int as h from m)
select h >= 2 or (h >= 1 and length(n) <= 120 and regexp_matches(n, '^[（(\\[]')) as note,
       regexp_matches(n, '^(?:同上|同前|如上|上同|见上|见前)[。．.!！?？]*$') or regexp_matches(n, '(?i)^(?:ibid\\.?|same as above|see above|same as prior)[.?!]*$') as shorthand,
       regexp_matches(coalesce(x, ''), '[\\x{{E000}}-\\x{{F8FF}}\\x{{F0000}}-\\x{{FFFFD}}\\x{{100000}}-\\x{{10FFFD}}]') as private_use, count(*) as n
from k group by 1, 2, 3
""")
def meta_note_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT-13, FLT-14 and the private-use rule of FLT-17 over lines."""
    return lines(spark, sf_dir).groupBy(text.meta_note("x").alias("note"), text.shorthand("x").alias("shorthand"), text.private_use("x").alias("private_use")).agg(F.count("*").alias("n"))


@query(f"""
with {_LINES}, m as (select {_N} as n from t),
k as (select n, {_count("n", "[=≈≤≥∑∫√^×÷∈∉∞∂∆∇∝⊂⊆⊕⊗→←↔±≠]")} as s, {_count("n", "[_^₀-₉⁰-⁹]")} as i, {_count("n", text.FORMULA_TOKENS)} as b, {_count("n", "[A-Za-z0-9]")} as a, {_count("n", "[A-Za-z]")} as l from m)
select regexp_matches(n, '[\\x{{E000}}-\\x{{F8FF}}\\x{{F0000}}-\\x{{FFFFD}}\\x{{100000}}-\\x{{10FFFD}}]') or (s >= 2 and b >= 2) or (b >= 4 and a >= 8) or (i >= 3 and l >= 4) as heavy,
       (s > 0 and b >= 1) or (b >= 2 and a >= 4 and {_count("n", "[A-Za-z]{3,}")} <= 6) or ({_count("n", "[()]")} >= 2 and s >= 1) as formula, count(*) as n, sum(s + i + b)::bigint as signs from k group by 1, 2
""")
def formula_heavy_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT-17 over lines."""
    n = text.normalize("x")
    signs = text.count(n, text.FORMULA_SYMBOLS) + text.count(n, text.SCRIPT_MARKS) + text.count(n, text.FORMULA_TOKENS)
    return lines(spark, sf_dir).groupBy(text.formula_heavy("x").alias("heavy"), text.formula_like("x").alias("formula")).agg(F.count("*").alias("n"), F.sum(signs).alias("signs"))


@query(r"""
with k as (select doc_id, text as x, len(regexp_extract_all(text, '[ \t\n\r\f\x0B]')) as s, len(regexp_extract_all(text, '[\x{3040}-\x{30FF}\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{AC00}-\x{D7AF}\x{F900}-\x{FAFF}\x{FF00}-\x{FFEF}]')) as w,
    len(regexp_extract_all(text, '[A-Z0-9]')) as l, len(regexp_extract_all(text, '[a-z]')) as m from documents)
select doc_id, round(s * 0.35::double + w * 1.0::double + l * 0.68::double + m * 0.56::double + (length(x) - s - w - l - m) * 0.6::double, 2) as units from k
""")
def text_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR-15: estimated width of each document."""
    return table(spark, sf_dir, "documents").select("doc_id", text.text_units("text").alias("units"))


@query(r"""
with t as (select text as x, lang from documents),
k as (select *, len(regexp_extract_all(x, '(?i)[ñáéíóúü¿¡]')) as s, len(regexp_extract_all(x, '(?i)[àâæçéèêëîïôœùûüÿ]')) as f from t)
select lang, case when regexp_matches(x, '[\x{3040}-\x{30ff}]') then 'Japanese' when regexp_matches(x, '[\x{ac00}-\x{d7af}]') then 'Korean' when regexp_matches(x, '[\x{0400}-\x{04ff}]') then 'Russian'
    when regexp_matches(x, '[\x{4e00}-\x{9fff}]') then 'Chinese (Simplified)' when s > f and s >= 2 then 'Spanish' when f > s and f >= 2 then 'French' when regexp_matches(x, '[A-Za-z]') then 'English' end as inferred,
    count(*) as n from k group by 1, 2
""")
def language_infer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CFG-02: inferred against recorded languages."""
    return table(spark, sf_dir, "documents").groupBy("lang", text.infer_language("text").alias("inferred")).agg(F.count("*").alias("n"))


_ALIAS_SQL = "(values " + ", ".join(f"('{a}', '{n}', '{languages.SUBTITLE_CODES[n]}')" for n, al in languages.ALIASES.items() for a in al) + ") a(alias, language, code)"


@query(f"""
select d.lang, a.language, coalesce(a.code, 'und') as code, count(*) as n from documents d left join {_ALIAS_SQL} on regexp_replace(lower(trim(d.lang)), '[_\\s]+', '-', 'g') = a.alias group by 1, 2, 3
""")
def language_alias_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CFG-01 as a lookup join with the alias table, which has a fixed size."""
    docs = table(spark, sf_dir, "documents").select("lang", languages.alias_key(F.col("lang")).alias("alias"))
    joined = docs.join(F.broadcast(languages.alias_table(spark)), "alias", "left")
    return joined.groupBy("lang", "language", F.coalesce("code", F.lit("und")).alias("code")).agg(F.count("*").alias("n"))


@query("select page_id, length(html) as chars, length(html) + 4 * (length(html) - length(replace(html, '&', ''))) + 3 * (length(html) - length(replace(replace(html, '<', ''), '>', ''))) + 5 * (length(html) - length(replace(html, '\"', ''))) as escaped_chars, true as same from pages")
def html_escape_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR-05: escaping and decoding gives the text back."""
    pages = table(spark, sf_dir, "pages").withColumn("escaped", text.escape_html("html"))
    return pages.select("page_id", F.length("html").alias("chars"), F.length("escaped").alias("escaped_chars"), (text.decode_html("escaped") == F.col("html")).alias("same"))


@query(f"""
with t as (select x from {_PROBE_SQL})
select x, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(trim(x, ' '), '^\\$\\$([^$]*)\\$\\$$', '\\1'), '^\\$([^$]*)\\$$', '\\1'), '^\\\\\\(([^$]*)\\\\\\)$', '\\1'), '^\\\\\\[([^$]*)\\\\\\]$', '\\1'), ' ') as latex,
    regexp_replace(regexp_replace(x, '```[A-Za-z]*\n?', '', 'g'), '^\\s+|\\s+$', '', 'g') as fenced,
    regexp_replace(lower({_N}), '\\d+', '#', 'g') as signature,
    regexp_replace(upper(x), '[^A-Z0-9]', '', 'g') as upper_signature from t
""")
def cleaned_probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR-07, STR-10 and STR-11 on fixed rows."""
    return _probes(spark).select("x", text.strip_latex("x").alias("latex"), text.strip_fences("x").alias("fenced"), text.signature("x").alias("signature"), text.upper_signature("x").alias("upper_signature"))


@query(f"""
with t as (select doc_id, text as x from documents)
select doc_id, case when length({_N}) > 80 then substr({_N}, 1, 80) || '...' else {_N} end as preview, md5(regexp_replace(lower({_N}), '\\d+', '#', 'g')) as signature_md5 from t
""")
def preview_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TOP-07 and STR-10 over documents."""
    return table(spark, sf_dir, "documents").select("doc_id", text.preview("text").alias("preview"), F.md5(text.signature("text")).alias("signature_md5"))


@query(r"""
select page_id, coalesce(nullif(substr(regexp_replace(regexp_replace(regexp_replace(regexp_replace(url, '["'']', '', 'g'), '[<>:/\\|?*\s]+', '_', 'g'), '_+', '_', 'g'), '^_|_$', '', 'g'), 1, 60), ''), 'selected') as slug,
    regexp_replace(url, '[/\\:*?"<>|]', '_', 'g') as file_token from pages
""")
def slugify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK-13 and SNK-09: names made of urls."""
    return table(spark, sf_dir, "pages").select("page_id", text.slug("url").alias("slug"), text.file_token("url").alias("file_token"))


@query(r"""
with b as (select item_id, split_part(text, ' ', 2) as needle from benchmark)
select d.doc_id, b.item_id, ((length(d.text) - length(replace(d.text, b.needle, ''))) // length(b.needle))::bigint as n from documents d join b on length(b.needle) > 0 and contains(d.text, b.needle)
""")
def needle_occurrences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR-18: non-overlapping hits of every item's needle in every document."""
    return _needle_hits(spark, sf_dir, table(spark, sf_dir, "benchmark"))


def _needle_hits(spark: SparkSession, sf_dir: str, items: DataFrame) -> DataFrame:
    """Items with one needle are searched for together."""
    needles = items.select("item_id", F.split_part("text", F.lit(" "), F.lit(2)).alias("needle")).where("needle <> ''")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    hits = docs.join(F.broadcast(needles.groupBy("needle").agg(F.collect_list("item_id").alias("items"))), F.contains("text", F.col("needle")))
    return hits.select("doc_id", F.explode("items").alias("item_id"), text.occurrences(F.col("text"), F.col("needle")).alias("n"))


@query(r"""
select conv_id, turn, coalesce(nullif(regexp_replace(regexp_replace(regexp_replace(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)), '\n{2,}', chr(10), 'g'), '[ \t]+\n', chr(10), 'g'), '^\s+|\s+$', '', 'g'), ''), '-') as cue from conversations
""")
def sanitized_cues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR-06 over turns."""
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", text.sanitize_cue("text", "-").alias("cue"))
