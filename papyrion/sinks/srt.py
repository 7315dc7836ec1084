"""Cues back to subtitle files, markup and player arguments (SNK-03, SNK-04, SNK-06, JOIN-16)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from papyrion.functions.text import decode_html, escape_html, sanitize_cue


def _joined(value: Column, separator: str) -> Column:
    """Aggregate: values of a file in order of sequence."""
    return F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("sequence", value.alias("v")))), lambda c: c["v"]), separator)


def serialize(cues: DataFrame, key: str, translated: bool = True) -> DataFrame:
    """SNK-03: (key, content): cues renumbered from 1; identifiers that are no number on a line of their own."""
    chosen = F.when(F.length("translated_text") > 0, F.col("translated_text")).otherwise(F.col("source_text")) if translated else F.col("source_text")
    text = sanitize_cue(chosen, F.trim(F.coalesce("source_text", F.lit(""))))
    named = F.col("cue_identifier").isNotNull() & ~F.trim("cue_identifier").rlike(r"^\d+$")
    time = F.concat("start", F.lit(" --> "), "end", F.when(F.length("settings") > 0, F.concat(F.lit(" "), "settings")).otherwise(""))
    body = F.concat(F.when(named, F.concat("cue_identifier", F.lit("\n"))).otherwise(""), time, F.lit("\n"), text)
    ordered = F.sort_array(F.collect_list(F.struct("sequence", body.alias("v"))))
    blocks = F.transform(ordered, lambda c, i: F.regexp_replace(F.concat((i + 1).cast("string"), F.lit("\n"), c["v"]), r"\s+$", ""))
    return cues.groupBy(key).agg(F.array_join(blocks, "\n\n").alias("content"))


def to_markup(cues: DataFrame, key: str, title: Column | None = None) -> DataFrame:
    """SNK-04: (key, html): a paragraph for each cue, line breaks kept."""
    cue = F.concat(F.lit('<p data-subtitle-id="'), F.col("id"), F.lit('">'), F.replace(escape_html("source_text"), F.lit("\n"), F.lit("<br/>")), F.lit("</p>"))
    head = F.concat(F.lit('<?xml version="1.0" encoding="utf-8"?><html><head><title>'), escape_html(F.coalesce(title if title is not None else F.lit(None), F.lit("Subtitle Document"))), F.lit("</title></head><body>"))
    return cues.groupBy(key).agg(_joined(cue, "\n").alias("_body")).select(key, F.concat(head, "_body", F.lit("</body></html>")).alias("html"))


def cue_text(html: Column) -> Column:
    """Text of a translated paragraph."""
    plain = F.regexp_replace(F.regexp_replace(html, r"(?i)<br\s*/?>", "\n"), r"</?[^>]+>", "")
    return F.regexp_replace(F.replace(decode_html(plain), F.lit("\r\n"), F.lit("\n")), r"^\s+|\s+$", "")


def apply_translation(cues: DataFrame, translated: DataFrame, key: str) -> DataFrame:
    """JOIN-16: translated paragraphs (key, id, html) onto cues; the source text where there is none."""
    texts = translated.select(key, "id", cue_text(F.col("html")).alias("_t"))
    return cues.drop("translated_text").join(texts, [key, "id"], "left").withColumn("translated_text", F.coalesce(F.nullif("_t", F.lit("")), F.coalesce("source_text", F.lit("")))).drop("_t")


def mux_arguments(video: Column, subtitle: Column, n_embedded: Column, externals: Column, language: Column, title: Column, output: Column) -> Column:
    """SNK-06: arguments of the muxing program: old tracks not default, external ones copied, the new one last and default."""
    files = F.flatten(F.transform(externals, lambda f: F.array(F.lit("-i"), f)))
    maps = F.flatten(F.transform(F.sequence(F.lit(1), F.size(externals) + 1), lambda i: F.array(F.lit("-map"), i.cast("string"))))
    tracks = n_embedded + F.size(externals)
    old = F.when(tracks > 0, F.flatten(F.transform(F.sequence(F.lit(0), F.greatest(tracks - 1, F.lit(0))), lambda i: F.array(F.concat(F.lit("-disposition:s:"), i.cast("string")), F.lit("0"))))).otherwise(F.array().cast("array<string>"))
    last = tracks.cast("string")
    new = F.array(F.concat(F.lit("-metadata:s:s:"), last), F.concat(F.lit("language="), language), F.concat(F.lit("-metadata:s:s:"), last), F.concat(F.lit("title="), title), F.concat(F.lit("-disposition:s:"), last), F.lit("default"))
    return F.concat(F.array(F.lit("-y"), F.lit("-i"), video), files, F.array(F.lit("-i"), subtitle), F.array(F.lit("-map"), F.lit("0")), maps, F.array(F.lit("-c"), F.lit("copy"), F.lit("-c:s"), F.lit("srt")), old, new, F.array(output))


def documents(cues: DataFrame, key: str, source_type: Column, source: Column, target: Column) -> DataFrame:
    """STR-26: (key, document): one JSON document of each file's cues in order, with its languages."""
    cue = F.struct("sequence", "id", F.col("cue_identifier").alias("cueIdentifier"), "start", "end", "settings", F.col("source_text").alias("sourceText"))
    parts = F.struct(F.lit(1).alias("version"), F.col(key).cast("string").alias("sourceFile"), source_type.alias("sourceType"), source.alias("sourceLanguage"), target.alias("targetLanguage"), F.col("cues"))
    return cues.groupBy(key).agg(F.sort_array(F.collect_list(cue)).alias("cues")).select(key, F.to_json(parts).alias("document"))
