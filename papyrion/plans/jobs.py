"""Whole jobs as chains of operators (JOB-01 to JOB-05): documents in, documents out, failures as rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from papyrion.functions import text
from papyrion.operators import selection, translate
from papyrion.sinks import srt as srt_sink
from papyrion.sources import html as dom
from papyrion.sources import srt


def html(pages: DataFrame, translator: translate.Translator, key: str, done: DataFrame | None = None) -> DataFrame:
    """JOB-02, JOB-05: (key, id, ord, source, translated, ok, error) of the visible texts of pages that are not finished."""
    todo = selection.unfinished(pages, done, key) if done is not None else pages
    nodes = dom.explode(todo, key, dom.visible_body).where("id <> ''")
    judged = nodes.withColumn("c", text.classify_node(F.col("tag"), F.col("text"), F.col("content"), F.col("css_class"), F.lit(False)))
    kept = judged.where(~text.bypass(F.col("c"), "html")).select(key, "id", "ord", F.col("content").alias("source"))
    return translate.translate(kept, translator, "source", pause=0)


def book(chapters: DataFrame, translator: translate.Translator, spec: str | None = None) -> DataFrame:
    """JOB-01: chapters of one book (path, id, ord, title, html), selected by place or title, through the html job."""
    chosen = selection.select_chapters(chapters, spec, "ord", "title") if spec else chapters
    keyed = chosen.withColumn("chapter", F.concat_ws("#", "path", "id"))
    return html(keyed, translator, "chapter")


def subtitles(files: DataFrame, translator: translate.Translator, key: str) -> DataFrame:
    """JOB-04: (key, content, cues, again): files of cues to files of translated cues, parsed once more as a check."""
    cues = srt.parse(files).where("error is null")
    judged = cues.withColumn("c", text.classify_text("source_text"))
    sent = translate.translate(judged.where(~text.bypass(F.col("c"), "subtitle")).select(key, "id", "source_text"), translator, "source_text", pause=0)
    back = sent.where("ok").select(key, "id", text.escape_html("translated").alias("html"))
    done = srt_sink.serialize(srt_sink.apply_translation(cues, back, key), key)
    counts = cues.groupBy(key).agg(F.count("*").alias("cues"))
    again = srt.parse(done).where("error is null").groupBy(key).agg(F.count("*").alias("again"))
    return done.join(counts, key).join(again, key)


def blocks(payload: DataFrame, translator: translate.Translator) -> DataFrame:
    """JOB-03: decided blocks (doc, page, id, action, translatedText): labels, references, margins, tables, texts, actions.

    Blocks are dealt by document once; what depends on others stands beside them, and only pages that may hold a table go through the detection.
    """
    from papyrion.operators import layout, tables

    base = layout.with_body_size(layout.mark_references(payload.drop("translatedText")))
    parted = layout.repeated_margin(tables.may_hold(base))
    parted = parted.withColumn("_plain", text.normalize("text"))
    with layout.normalized(text="_plain"):
        kind, ruled = layout.block_type(F.lit(None).cast("double"), F.col("bodySize")), layout.ruled_margin()
    typed = parted.withColumn("blockType", F.coalesce("blockType", kind)).drop("bodySize")
    some, rest = typed.where("mayHold").drop("mayHold"), typed.where("not mayHold").drop("mayHold")
    found = tables.detect(some.select("doc", "page", "id", "pageWidth", "bbox", "text", "fontSize", "blockType", "role", "layoutLines"))
    none = F.lit(None).cast("string")
    marked = tables.mark(some, found).unionByName(rest.withColumns({"tableId": none, "tableRole": none}))
    stays = F.coalesce("preserveOriginal", F.lit(False)) | F.col("repeated") | F.coalesce(ruled, F.lit(False))
    kept = marked.withColumn("preserveOriginal", stays)
    done = kept.withColumn("translatedText", translate.answers(F.when(~F.col("preserveOriginal"), F.coalesce("text", F.lit(""))), translator, pause=0))
    with layout.normalized(text="_plain"):
        decided = layout.decide(done)
    return decided.select("doc", "page", "id", "blockType", "renderPolicy", "action", "translatedText", "tableId", "tableRole")
