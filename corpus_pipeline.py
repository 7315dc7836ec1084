"""A corpus pipeline of the training-data operators, stage by stage.

Each stage gets all rows that the one before kept; ``run`` chains them lazily, a caller may as
well write each result and read it back.

Every stage judges rows, whatever their doc_id: null and repeated ids, columns that are null or of
any other name, and very long texts change nothing; an empty table gives an empty one. All but the
last return the columns that they got. What each does with null and empty texts, ties and equal
rows stands with it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from papyrion.llm import decontaminate, mixing, simhash, token_output, toxicity
from papyrion.llm.queries import tokenizer_path
from papyrion.llm.shared import table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity score rejects go; the lexicon learns from these documents' labels. Null and empty texts stay; equal texts share a fate."""
    return toxicity.remove_toxic(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: that with the smallest doc_id (null last), of ties and equal rows one. Null and empty texts are one group."""
    return simhash.keep_first(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, up to a few edits, go. Null and empty texts stay; equal texts share a fate; without items all stay."""
    return decontaminate.remove_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents come as often as the mix of sources takes them, equal rows each for itself. Texts without words are never taken; null sources are one source."""
    return mixing.apply_mix(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Binary shards of the mix, read back as one row per document, repeats included. A null or empty text has the end id alone."""
    return token_output.token_output(docs, tokenizer_path())


STAGES = [("toxicity", drop_toxic), ("near_dedup", near_dedup), ("decontamination", decontaminated), ("mixing", mixed), ("tokens", tokens)]

#: The stages hash, train and tokenize; the tests hold them against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
    return docs
