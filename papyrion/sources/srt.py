"""Subtitle files as rows (SRC-05, SRC-06) and subtitle streams (SRC-07, SRC-08, TOP-03)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from papyrion.functions import languages

TIME = r"^(\d{2}:\d{2}:\d{2},\d{3})\s+-->\s+(\d{2}:\d{2}:\d{2},\d{3})(?:\s+(.*))?$"
EXTERNAL = ("srt", "ass", "ssa", "vtt")
TEXT_CODECS = ("subrip", "srt", "ass", "ssa", "webvtt", "mov_text", "text")
STREAMS = "struct<streams: array<struct<index: int, codec_name: string, tags: map<string, string>, disposition: map<string, int>>>>"


def _trimmed(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def blocks(content: Column) -> Column:
    """SRC-05: the array of cue blocks."""
    unified = F.regexp_replace(F.regexp_replace(content, "^﻿", ""), "\r\n?", "\n")
    return F.filter(F.transform(F.split(unified, r"\n{2,}"), _trimmed), lambda b: b != "")


def milliseconds(time: Column) -> Column:
    part = lambda k: F.regexp_extract(time, r"^(\d{2}):(\d{2}):(\d{2}),(\d{3})$", k).cast("long")
    return F.when(time.rlike(r"^\d{2}:\d{2}:\d{2},\d{3}$"), ((part(1) * 60 + part(2)) * 60 + part(3)) * 1000 + part(4))


def parse(files: DataFrame, strict: bool = False) -> DataFrame:
    """SRC-06: one row per block of ``content``: id, sequence, cue_identifier, start, end, settings, source_text, start_ms, end_ms, error.

    A first line without an arrow is an identifier (null if a number); a number may be followed
    by an identifier of its own line, as the writer puts it. Blocks that are no cue have an
    ``error``; with ``strict`` they stop the query.
    """
    keys = [c for c in files.columns if c != "content"]
    rows = files.select(*keys, F.posexplode(blocks(F.col("content"))).alias("_at", "_block"))
    lines = F.split(F.replace("_block", F.lit("\x00"), F.lit("")), "\n")
    rows = rows.withColumn("_lines", lines)
    line = lambda k: F.coalesce(F.get("_lines", F.lit(k)), F.lit(""))
    arrow = lambda k: F.contains(line(k), F.lit("-->"))
    numbered = _trimmed(line(0)).rlike(r"^\d+$")
    at = F.when(arrow(0), 0).when(~arrow(1) & numbered & arrow(2), 2).otherwise(1)
    name = F.when(at == 1, _trimmed(line(0))).when(at == 2, _trimmed(line(1)))
    rows = rows.withColumn("_t", at).withColumn("_name", F.when(name.rlike(r"^\d+$") | (name == ""), F.lit(None)).otherwise(name))
    time = _trimmed(F.coalesce(F.get("_lines", F.col("_t")), F.lit("")))
    number = (F.col("_at") + 1).cast("string")
    error = F.when(F.size("_lines") < 2, F.concat(F.lit("Invalid SRT cue at block "), number)).when(~time.rlike(TIME), F.concat(F.lit("Invalid SRT time range at block "), number))
    if strict:
        error = F.when(error.isNotNull(), F.raise_error(error)).otherwise(error)
    get = lambda k: F.regexp_extract(time, TIME, k)
    rest = F.slice("_lines", F.col("_t") + 2, F.greatest(F.size("_lines") - F.col("_t") - 1, F.lit(0)))
    out = rows.select(
        *keys, F.concat(F.lit("node_"), F.lpad(number, 5, "0")).alias("id"), (F.col("_at") + 1).alias("sequence"), F.col("_name").alias("cue_identifier"),
        get(1).alias("start"), get(2).alias("end"), get(3).alias("settings"), _trimmed(F.array_join(rest, "\n")).alias("source_text"), error.alias("error"),
    )
    return out.withColumns({"start_ms": milliseconds(F.col("start")), "end_ms": milliseconds(F.col("end"))})


def probed_streams(probes: DataFrame) -> DataFrame:
    """SRC-07: rows of ``stdout`` (JSON of a stream probe) to one row per stream; unreadable JSON gives none."""
    keys = [c for c in probes.columns if c != "stdout"]
    rows = probes.select(*keys, F.explode(F.from_json("stdout", STREAMS)["streams"]).alias("s")).select(*keys, "s.*")
    return rows.withColumn("kind", F.lit("embedded")).withColumn("resolved_language", languages.stream_language(F.col("tags")))


def external_files(files: DataFrame) -> DataFrame:
    """SRC-08: rows (video, name) of files beside a video to its subtitle files, numbered by name."""
    ext = F.lower(F.regexp_extract("name", r"\.([^.]+)$", 1))
    stem = F.lower(F.regexp_replace("name", r"\.[^.]+$", ""))
    base = F.lower(F.regexp_replace("video", r"\.[^.]+$", ""))
    fits = (stem == base) | F.startswith(stem, F.concat(base, F.lit("."))) | F.startswith(stem, F.concat(base, F.lit("_"))) | F.startswith(stem, F.concat(base, F.lit("-")))
    rows = files.where(ext.isin(*EXTERNAL) & fits)
    order = Window.partitionBy("video").orderBy(F.lower("name"), "name")
    return rows.select("video", "name", (F.row_number().over(order) - 1).alias("index"), ext.alias("codec_name"), languages.file_language(F.regexp_replace("name", r"\.[^.]+$", "")).alias("resolved_language"), F.lit("external").alias("kind"))


def all_streams(embedded: DataFrame, external: DataFrame) -> DataFrame:
    """SET-02: both kinds one below the other."""
    return embedded.unionByName(external, allowMissingColumns=True)


def select_stream(streams: DataFrame, key: str, preferred: str | None = None, fallback: str = "English") -> DataFrame:
    """TOP-03: one stream per key: of the wanted language, else (nothing wanted) the fallback's, else the default one, else the first."""
    language = F.col("resolved_language")
    default = F.coalesce(F.element_at("disposition", F.lit("default")), F.lit(0)) == 1 if "disposition" in streams.columns else F.lit(False)
    wanted = languages.matches(language, F.lit(preferred or fallback))
    rank = F.when(wanted, 0).when(default, 1).otherwise(2)
    order = Window.partitionBy(key).orderBy(rank, F.when(rank == 1, F.coalesce("ord", F.lit(0))) if "ord" in streams.columns else F.lit(0), "index")
    return streams.withColumn("_r", F.row_number().over(order)).where("_r = 1").drop("_r")


def supported(streams: DataFrame) -> DataFrame:
    """FLT-35: text codecs only."""
    return streams.where(F.lower("codec_name").isin(*TEXT_CODECS, *EXTERNAL))


def read(spark: SparkSession, path: str) -> DataFrame:
    """(path, content) of subtitle files."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("content"))
