"""Repairing and validating translations (WIN-05, FLT-36, VAL-01, VAL-02, SNK-08)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from papyrion.functions import geom
from papyrion.functions.text import compact, meta_note, normalize, occurrences, shorthand
from papyrion.operators.grouped import each

LONGEST = 4
SENTENCE_END = r"[.!?。！？…][\"'”’」』）)]*$"


def pairs(blocks: DataFrame, doc: str = "doc") -> DataFrame:
    """FLT-36: adds ``follows``: the block goes on where the one before it stopped.

    Same page, both paragraphs that are not preserved, like font size, close below, overlapping
    columns, and the text before does not end a sentence.
    """
    order = Window.partitionBy(doc).orderBy("page", F.col("bbox")[1], F.col("bbox")[0], "id")
    before = F.lag(F.struct("page", "bbox", "fontSize", "role", "preserveOriginal", "text")).over(order)
    plain = lambda role, kept: (F.coalesce(role, F.lit("")) == "paragraph") & ~F.coalesce(kept, F.lit(False))
    p = F.col("_p")
    near = F.abs(p["fontSize"] - F.col("fontSize")) <= F.greatest(F.lit(2.5), 0.18 * F.greatest(p["fontSize"], F.col("fontSize")))
    gap = geom.gap_y(p["bbox"], F.col("bbox"))
    fits = (p["page"] == F.col("page")) & plain(p["role"], p["preserveOriginal"]) & plain(F.col("role"), F.col("preserveOriginal")) & near & gap.between(-8, 90)
    fits = fits & (geom.overlap_x_ratio(p["bbox"], F.col("bbox")) >= 0.28) & ~normalize(p["text"]).rlike(SENTENCE_END)
    return blocks.withColumn("_p", before).withColumn("follows", F.coalesce(fits, F.lit(False))).drop("_p")


def runs(marked: DataFrame, doc: str = "doc") -> DataFrame:
    """WIN-05: islands of blocks that follow each other: adds ``run`` and ``place`` in it."""
    order = Window.partitionBy(doc).orderBy("page", F.col("bbox")[1], F.col("bbox")[0], "id")
    numbered = marked.withColumn("run", F.sum(F.when(F.col("follows"), 0).otherwise(1)).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.withColumn("place", F.row_number().over(Window.partitionBy(doc, "run").orderBy("page", F.col("bbox")[1], F.col("bbox")[0], "id")))


def suspicious(sources: list[str], translated: list[str]) -> bool:
    """FLT-36: a run whose translations seem shifted: lengths out of proportion, remarks or nothing at all."""
    shares = [len("".join(t.split())) / max(len("".join(s.split())), 1) for s, t in zip(sources, translated, strict=True)]
    return any(not t.strip() for t in translated) or max(shares) / max(min(shares), 0.01) > 2.2


def valid(sources: list[str], before: list[str], after: list[str | None]) -> bool:
    """FLT-36: a repair keeps all parts, 0.65 to 1.45 times the length, and adds no remarks."""
    if len(after) != len(before) or any(not (t or "").strip() for t in after):
        return False
    size = lambda rows: sum(len("".join((t or "").split())) for t in rows)
    share = size(after) / max(size(before), 1)
    return 0.65 <= share <= 1.45 and not any((t or "").strip().lower().startswith(("(note", "（注", "ibid", "同上")) for t in after)


def repair(blocks: DataFrame, mend: Callable[[list[str], list[str]], list[str | None]], doc: str = "doc") -> DataFrame:
    """WIN-05: (doc, id, translatedText, repaired): windows of up to four blocks of a run are mended where they look wrong.

    After a mended window the next begins behind it, after a refused one a block later. A run is
    a few blocks, so one group holds it.
    """
    slim = runs(pairs(blocks, doc), doc).select(F.col(doc).alias("doc"), "run", "place", "id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce("translatedText", F.lit("")).alias("translatedText"))

    def run(rows: list[dict]) -> list[dict]:
        sources, texts = [r["text"] for r in rows], [r["translatedText"] for r in rows]
        done, at = [False] * len(texts), 0
        while at < len(texts):
            end = min(at + LONGEST, len(texts))
            if end - at >= 2 and suspicious(sources[at:end], texts[at:end]):
                got = mend(sources[at:end], texts[at:end])
                if valid(sources[at:end], texts[at:end], got):
                    texts[at:end], done[at:end] = got, [True] * (end - at)
                    at = end
                    continue
            at += 1
        return [{"doc": r["doc"], "id": r["id"], "translatedText": t, "repaired": d} for r, t, d in zip(rows, texts, done, strict=True)]

    kind = slim.schema["doc"].dataType.simpleString()
    return each(slim, ["doc", "run"], ["place"], run, f"doc {kind}, id string, translatedText string, repaired boolean")


def needle(text: Column) -> Column:
    """TOP-07: the part of a text that is looked for: 12 to 80 characters without white space."""
    c = compact(text)
    return F.when(F.length(c) >= 12, F.substring(c, 1, 80))


def text_issues(blocks: DataFrame, pages: DataFrame, key: tuple[str, ...] = ("doc", "page")) -> DataFrame:
    """VAL-01: (key, id, type) issue rows of decided blocks against the text of their finished page.

    ``blocks`` has action and expectedAction; ``pages`` has ``pageText``.
    """
    joined = blocks.join(pages.select(*key, compact("pageText").alias("_page")), list(key), "left").withColumn("_page", F.coalesce("_page", F.lit("")))
    source, target, replaced = needle(F.col("text")), needle(F.col("translatedText")), F.col("action") == "replace"
    hits = lambda n: F.coalesce(occurrences(F.col("_page"), n), F.lit(0))
    changed = source != F.coalesce(target, F.lit(""))
    tests = {
        "action_mismatch": F.col("action") != F.col("expectedAction"), "review_block": F.col("action") == "review",
        "source_text_residue": replaced & source.isNotNull() & changed & (hits(source) > 0),
        "translation_missing": replaced & target.isNotNull() & (hits(target) == 0), "translation_duplicate": replaced & target.isNotNull() & (hits(target) > 1),
        "translation_note": replaced & (meta_note("translatedText") | shorthand("translatedText")),
    }
    found = F.array_compact(F.array(*(F.when(F.coalesce(t, F.lit(False)), F.lit(name)) for name, t in tests.items())))
    return joined.select(*key, "id", F.explode(found).alias("type"))


def changed_share(pixels: DataFrame, key: tuple[str, ...], least: int = 24) -> DataFrame:
    """AGG-23: of masked pixels (before, after: arrays of channels) those whose largest difference reaches ``least``."""
    most = F.array_max(F.zip_with("before", "after", lambda a, b: F.abs(a - b)))
    sums = pixels.where("masked").groupBy(*key).agg(F.count("*").alias("maskPixels"), F.count_if(most >= least).alias("changedPixels"))
    return sums.withColumn("changedRatio", F.col("changedPixels") / F.greatest(F.col("maskPixels"), F.lit(1))).withColumn("low", F.col("changedRatio") < 0.05)


def report(issues: DataFrame, docs: DataFrame, doc: str = "doc") -> DataFrame:
    """VAL-02: (doc, status, issues): ok without issues."""
    counts = issues.groupBy(doc).agg(F.count("*").alias("issues"))
    return docs.select(doc).distinct().join(counts, doc, "left").select(doc, F.when(F.col("issues").isNull(), "ok").otherwise("needs_review").alias("status"), F.coalesce("issues", F.lit(0)).alias("issues"))


def write_report(issues: DataFrame, path: str) -> None:
    """SNK-08."""
    issues.write.mode("overwrite").json(path)
