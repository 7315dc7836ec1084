"""Extension: the explode stages over newly arriving files, with Structured Streaming.

Nothing here has a counterpart in batch-only document tools; the same operators run on streams.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from papyrion.sources import html as dom


def pages(spark: SparkSession, path: str, schema: str = "page_id bigint, url string, html string", files_per_batch: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def nodes(stream: DataFrame, key: str = "page_id") -> DataFrame:
    """Visible nodes of a stream of pages."""
    return dom.explode(stream, key, dom.visible_body).where("id <> ''")


def into_table(stream: DataFrame, path: str, checkpoint: str, key: str, act: Callable[[DataFrame], DataFrame] = lambda df: df):
    """EXE-05: each micro-batch is acted on and appended once: a replayed batch overwrites its own folder."""

    def write(batch: DataFrame, number: int) -> None:
        act(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def cue_windows(cues: DataFrame, length: str = "30 seconds") -> DataFrame:
    """Cues per window of their start time; works on streams with a watermark."""
    at = F.timestamp_millis("start_ms")
    return cues.withColumn("at", at).withWatermark("at", "1 minute").groupBy(F.window("at", length)).agg(F.count("*").alias("cues"), F.sum(F.length("source_text")).alias("chars"))
