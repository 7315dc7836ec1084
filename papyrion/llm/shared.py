"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from papyrion.runtime import ensure_checkpoint_dir, settle

__all__ = ["WORD", "ensure_checkpoint_dir", "partitions", "pieces", "sampled", "settle", "table", "word_count"]

#: Code points that separate words: space and U+0009 to U+000D.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def word_count(text: Column) -> Column:
    """Number of words of a text; a null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def sampled(rows: DataFrame, most_rows: int, most_chars: int, label: Callable[[DataFrame], DataFrame] | None = None) -> list[tuple]:
    """(row, label) of distinct rows of ``rows`` (doc_id and text among the columns): at most ``most_rows``, with ``most_chars`` characters of text together.

    Rows are chosen and ordered by a hash of all their columns, so copies of a row count once and
    a value that repeats in very many rows brings no more than these bounds. ``label`` gets (key, doc_id,
    chars) of all rows, leaves out some and adds a column ``label``; texts take no part in its joins, and
    only those that are chosen are moved.
    """
    keyed = rows.withColumn("_sample_key", F.xxhash64(*rows.columns))
    sizes = keyed.select("_sample_key", "doc_id", F.length("text").alias("chars"))
    sizes = (label(sizes) if label else sizes.withColumn("label", F.lit(None).cast("int"))).groupBy("_sample_key").agg(F.max("chars").alias("chars"), F.max("label").alias("label"))
    keys, held = {}, 0
    for key, chars, value in sizes.orderBy("_sample_key").limit(most_rows).collect():
        if held + chars <= most_chars:
            keys[key] = value
            held += chars
    if not keys:
        return []
    chosen = rows.sparkSession.createDataFrame([(key,) for key in keys], "_sample_key long")
    some = keyed.join(F.broadcast(chosen), "_sample_key", "left_semi").dropDuplicates(["_sample_key"])
    found = {r["_sample_key"]: r for r in some.toLocalIterator()}
    return [(found[key], keys[key]) for key in sorted(found)]


#: Bytes of an Arrow batch that a function takes at once.
TAKEN = 4 << 20


def pieces(batches: Iterator[pa.RecordBatch], size: int = TAKEN) -> Iterator[pa.RecordBatch]:
    """The batches in pieces of about ``size`` bytes, one row at least."""
    for batch in batches:
        step = max(1, int(size * batch.num_rows / max(batch.nbytes, 1)))
        for at in range(0, batch.num_rows, step):
            yield batch.slice(at, step)


def partitions(spark: SparkSession) -> int:
    """Tasks for an explicit repartition: what the cluster has set for shuffles."""
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
