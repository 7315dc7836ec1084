"""What goes to a text provider and what comes back: prompts, request markup, responses taken apart and accepted.

A batch is named by ``key`` columns; its nodes have (id, pos, content). A provider answers a batch
with one string. A batch whose answer lacks a node, leaves one empty or gives a remark in place of
a translation fails as a whole, with the reason in its rows.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from papyrion.functions.text import merge_split_letters, meta_note, normalize, strip_fences, strip_tags

#: SRC-19: default templates for each kind of text; a caller may give others with the same placeholders.
TEMPLATES = {
    "default": "Translate from {{SOURCE_LANGUAGE}} to {{TARGET_LANGUAGE}}. Chapter: {{CHAPTER_TITLE}}.\n{{GLOSSARY_BLOCK}}\n{{STYLE_GUIDE}}\nAnswer with one node element for each that is given, ids and inner markup unchanged.",
    "html": "Translate parts of a web page from {{SOURCE_LANGUAGE}} to {{TARGET_LANGUAGE}}. Page: {{CHAPTER_TITLE}}.\n{{GLOSSARY_BLOCK}}\n{{STYLE_GUIDE}}\nKeep every node element with its id; links and inline tags stay as they are.",
    "pdf": "Translate blocks of a printed page from {{SOURCE_LANGUAGE}} to {{TARGET_LANGUAGE}}. Document: {{CHAPTER_TITLE}}.\n{{GLOSSARY_BLOCK}}\n{{STYLE_GUIDE}}\nKeep node elements, ids and placeholders such as @@INLINE_FORMULA_1@@.",
    "subtitle": "Translate subtitle cues from {{SOURCE_LANGUAGE}} to {{TARGET_LANGUAGE}}. Film: {{CHAPTER_TITLE}}.\n{{GLOSSARY_BLOCK}}\n{{STYLE_GUIDE}}\nOne short answer for each cue, in its node element.",
}
PLACEHOLDERS = ("TARGET_LANGUAGE", "SOURCE_LANGUAGE", "CHAPTER_TITLE", "GLOSSARY_BLOCK", "STYLE_GUIDE")


def template(mode: Column) -> Column:
    """SRC-19: the template of a mode; unknown ones get the default."""
    cases = F.coalesce(*(F.when(mode == name, F.lit(text)) for name, text in TEMPLATES.items() if name != "default"))
    return F.coalesce(cases, F.lit(TEMPLATES["default"]))


def replace_first(text: Column, needle: str, value: Column) -> Column:
    """The text with the first occurrence of a needle replaced, taken literally."""
    at = F.instr(text, needle)
    whole = F.concat(F.substr(text, F.lit(1), at - 1), F.coalesce(value, F.lit("")), F.substr(text, at + len(needle)))
    return F.when(at > 0, whole).otherwise(text)


def prompt(text: Column, values: dict[str, Column]) -> Column:
    """STR-20: placeholders filled one after the other, the first occurrence of each; a value may bring a later one in."""
    for name in PLACEHOLDERS:
        text = replace_first(text, f"{{{{{name}}}}}", values.get(name, F.lit("")))
    return F.trim(text)


def requests(nodes: DataFrame, key: list[str], single: bool = False) -> DataFrame:
    """(key, request, n): a batch as it is sent, its nodes in order of ``pos``; a lone node goes without markup where ``single``."""
    element = F.concat(F.lit('<node id="'), F.col("id"), F.lit('">'), merge_split_letters("content"), F.lit("</node>"))
    rows = F.sort_array(F.collect_list(F.struct("pos", element.alias("x"), F.col("content").alias("c"))))
    joined = nodes.groupBy(*key).agg(rows.alias("rows")).withColumn("n", F.size("rows"))
    text = F.array_join(F.transform("rows", lambda r: r["x"]), "\n")
    alone = F.when(F.col("n") == 1, F.get("rows", F.lit(0))["c"]) if single else F.lit(None).cast("string")
    return joined.select(*key, F.coalesce(alone, text).alias("request"), "n")


def answer(batches: DataFrame, provider: Callable[[str], str]) -> DataFrame:
    """UDF-01: adds the provider's response to each request; a failure is null. Arrow batches bound what a call holds."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            said = []
            for request in frame["request"]:
                try:
                    said.append(provider(request))
                except Exception:  # noqa: BLE001  any failure of a provider becomes a row
                    said.append(None)
            yield frame.assign(response=said)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in batches.schema.fields)
    return batches.mapInPandas(run, f"{schema}, response string")


def json_answer(batches: DataFrame, provider: Callable[[str], str], schema: str, tries: int = 3) -> DataFrame:
    """EXE-08, UDF-03: adds ``planned``, the provider's answer read by ``schema``, and the number of tries; null where no try gave readable JSON.

    What a planner says is read, never trusted: the caller joins it back and keeps its default where it is null.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            said, used = [], []
            for request in frame["request"]:
                answer_, n = None, 0
                while answer_ is None and n < tries:
                    n += 1
                    try:
                        text = provider(request).strip().removeprefix("```json").removeprefix("```").removesuffix("```")
                        json.loads(text)
                        answer_ = text
                    except Exception:  # noqa: BLE001  any failure of a provider is one more try
                        continue
                said.append(answer_)
                used.append(n)
            yield frame.assign(_said=said, tries=used)

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in batches.schema.fields)
    out = batches.mapInPandas(run, f"{kinds}, _said string, tries int")
    return out.withColumn("planned", F.from_json("_said", schema)).drop("_said")


_NODE = r'(?s)<node\b[^>]*?\bid="([^"]*)"[^>]*?(?:/>|>(.*?)</node>)'


def explode_response(responses: DataFrame, key: list[str], response: str = "response") -> DataFrame:
    """EXP-08: (key, id, content): the nodes of each response without code fences; of nodes with one id the first."""
    text = strip_fences(F.coalesce(F.col(response), F.lit("")))
    pairs = F.arrays_zip(F.regexp_extract_all(text, F.lit(_NODE), F.lit(1)).alias("id"), F.regexp_extract_all(text, F.lit(_NODE), F.lit(2)).alias("content"))
    rows = responses.select(*key, F.posexplode(pairs).alias("place", "node"))
    return rows.groupBy(*key, F.col("node.id").alias("id")).agg(F.min_by(F.trim(F.col("node.content")), "place").alias("content"))


def accept(nodes: DataFrame, responses: DataFrame, key: list[str], response: str = "response") -> DataFrame:
    """JOIN-17: nodes with (translated, ok, error); a batch is accepted whole or not at all.

    EXE-04: the answer to a lone node may come without markup. Nodes that are missing or empty, and remarks
    of the translator where the source has none, fail their batch; ``error`` names the first such ids.
    """
    said = explode_response(responses, key, response).withColumnRenamed("content", "translated")
    raw = F.trim(strip_fences(F.coalesce(F.col(response), F.lit(""))))
    size = nodes.groupBy(*key).agg(F.count("*").alias("_n"))
    plain = responses.join(size, key).select(*key, F.when((F.col("_n") == 1) & (raw != "") & ~raw.rlike(r"(?i)<node\b"), raw).alias("_plain"))
    rows = nodes.join(said, [*key, "id"], "left").join(plain, key, "left")
    rows = rows.withColumn("translated", F.coalesce("translated", "_plain"))
    missing = F.coalesce(F.col("translated"), F.lit("")) == ""
    remark = ~missing & meta_note(normalize(strip_tags("translated"))) & ~meta_note(normalize(strip_tags("content")))
    rows = rows.withColumns({"_missing": missing, "_remark": remark})
    order = F.sort_array(F.collect_list(F.when(F.col("_missing"), F.struct("pos", "id"))))
    verdicts = rows.groupBy(*key).agg(order.alias("gone"), F.min(F.when(F.col("_remark"), F.struct("pos", "id"))).alias("remark"))
    error = F.when(F.col("remark").isNotNull(), F.concat(F.lit("remark instead of a translation: "), F.col("remark.id"))).when(
        F.size("gone") > 0, F.concat(F.lit("missing or empty: "), F.array_join(F.transform("gone", lambda g: g["id"]), ", "))
    )
    verdicts = verdicts.select(*key, F.coalesce(error, F.lit("")).alias("error"))
    out = rows.drop("_missing", "_remark", "_plain").join(verdicts, key)
    return out.withColumn("ok", F.col("error") == "").withColumn("translated", F.when(F.col("ok"), F.col("translated")))
