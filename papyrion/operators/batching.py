"""Greedy batches (WIN-01): each unit's rows in order, a new batch where the next row would not fit."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from papyrion.operators.grouped import each

#: Characters and rows of a batch by mode; 0: no limit.
LIMITS = {"epub": (5000, 0), "html": (5000, 0), "subtitle": (6000, 24), "pdf": (5000, 1)}


def assign(sizes: list[int], chars: int, rows: int) -> list[int]:
    """Batch number of each size; an oversize row has a batch for itself."""
    out, batch, held, n = [], 0, 0, 0
    for size in sizes:
        if n and (held + size > chars or (rows and n >= rows)):
            batch, held, n = batch + 1, 0, 0
        out.append(batch)
        held, n = held + size, n + 1
    return out


def batches(nodes: DataFrame, key: str, order: str, size: str, mode: str = "epub") -> DataFrame:
    """(key, order, size, batch). Only these columns pass through Python; a key is one chapter or document, which bounds its rows."""
    chars, rows = LIMITS[mode]
    slim = nodes.select(F.col(key).alias("k"), F.col(order).cast("long").alias("o"), F.col(size).cast("long").alias("s"))

    def run(group: list[dict]) -> list[dict]:
        return [{**r, "b": b} for r, b in zip(group, assign([r["s"] or 0 for r in group], chars, rows), strict=True)]

    kind = slim.schema["k"].dataType.simpleString()
    return each(slim, ["k"], ["o"], run, f"k {kind}, o long, s long, b long").select(F.col("k").alias(key), F.col("o").alias(order), F.col("s").alias(size), F.col("b").alias("batch"))
