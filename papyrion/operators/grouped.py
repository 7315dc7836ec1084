"""Ordered passes over the rows of a key, many keys to an Arrow batch.

Keys such as pages, chapters and runs are small and many. Rows are dealt by key, sorted inside
partitions and handed to a plain function key by key, so a key costs what its rows cost; only the
rows of one key are held.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

Row = dict
OUT = 2048


def each(rows: DataFrame, key: list[str], order: list[str], run: Callable[[list[Row]], list[Row]], schema: str) -> DataFrame:
    """``run`` gets the rows of one key in order and gives rows of ``schema``."""
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def passes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[Row] = []
        done: list[Row] = []
        now = None
        for batch in batches:
            for row in batch.to_pylist():
                name = tuple(row[k] for k in key)
                if name != now and held:
                    done += run(held)
                    held = []
                    if len(done) >= OUT:
                        yield pa.RecordBatch.from_pylist(done, schema=arrow)
                        done = []
                now = name
                held.append(row)
        if held:
            done += run(held)
        if done:
            yield pa.RecordBatch.from_pylist(done, schema=arrow)

    return rows.repartition(*key).sortWithinPartitions(*key, *order).mapInArrow(passes, schema)
