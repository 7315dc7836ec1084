"""Mixing sources to target weights by weighted fair queueing, in DataFrame operations only.

Every document of a source, in a fixed shuffled order, asks for service in turn; the source is
served in proportion to its target. A document's *virtual finish time* is the words of its
source up to and with it, divided by the source's target; a source whose target is larger than
itself starts over, so its documents come with several finish times. Sorted by finish time over
all sources, documents are taken until the total budget is used up. A document whose service
would begin at or after time 1 (when its source has its target) is not in the queue.

No source, shuffle key or finish time has to fit into one task: running sums go over ranges of
the sorted rows, and one row for each range carries the sums in between.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from papyrion.llm.shared import partitions, settle, word_count

WEIGHTS = (5, 2, 1)
MOST_COPIES = 3
SEED = 42
#: Parts of a source's rows in joins by source.
SALT = 32


def _shuffled(doc_id: Column, seed: int) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))))


def _ahead(rows: DataFrame, order: list[Column], sums: dict[str, Column]) -> DataFrame:
    """``rows`` with a column for each of ``sums``: its sum over all rows that come before in ``order``, which has no ties.

    Rows are sorted in ranges, so no task sees more than its range; what lies before a range comes
    from one row for each range.
    """
    rows = rows.withColumns({name: F.coalesce(value, F.lit(0)) for name, value in sums.items()})
    dealt = settle(rows.repartitionByRange(partitions(rows.sparkSession), *order).withColumn("range", F.spark_partition_id()))
    totals = dealt.groupBy("range").agg(*(F.sum(name).alias(f"{name} before") for name in sums))
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("range", *(F.coalesce(F.sum(f"{name} before").over(before(Window.orderBy("range"))), F.lit(0)).alias(f"{name} before") for name in sums))
    inside = Window.partitionBy("range").orderBy(*order)
    dealt = dealt.withColumns({name: F.coalesce(F.sum(name).over(before(inside)), F.lit(0)) for name in sums})
    dealt = dealt.join(F.broadcast(totals), "range")  # as many rows as ranges
    return dealt.withColumns({name: F.col(name) + F.col(f"{name} before") for name in sums}).drop("range", *(f"{name} before" for name in sums))


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_COPIES) -> DataFrame:
    """(source, source_size) -> the same with weight and target.

    Sources in order of code points (null last) get ``weights`` in turn and share the sum of all
    sizes. A target stops at ``most`` times its source's size; what is over goes to the others by
    weight. In order of size per weight, the sources that stop are a prefix: with those before a
    source stopped, the others would get ``level`` for each unit of weight; it is the right level
    from the first source on that stays below its stop.
    """
    ranked = _ahead(sizes, [F.col("source").asc_nulls_last()], {"place": F.lit(1)})
    cases = F.element_at(F.array(*map(F.lit, weights)), (F.col("place") % len(weights) + 1).cast("int"))
    ranked = ranked.withColumn("weight", cases.cast("long")).withColumn("stop", F.col("source_size") * most)
    ranked = _ahead(ranked, [F.col("stop") / F.col("weight"), F.col("place")], {"stopped": F.col("stop"), "weighed": F.col("weight")})
    ranked = settle(ranked)
    sizes_, weights_ = ranked.agg(F.sum("source_size"), F.sum("weight")).first()  # two numbers
    level = (F.lit(sizes_ or 0) - F.col("stopped")) / (F.lit(weights_ or 0) - F.col("weighed"))
    right = ranked.withColumn("level", level).where(F.col("level") <= F.col("stop") / F.col("weight")).agg(F.max("level")).first()[0]
    return ranked.select("source", "source_size", "weight", F.least(F.col("stop").cast("double"), F.lit(right).cast("double") * F.col("weight")).alias("target"))


def mix(docs: DataFrame, seed: int = SEED, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """One row per document: doc_id, size, source_size, target (of its source), taken; and copies.

    ``docs`` needs doc_id, text and source; other columns are not read. Size is the number of
    words; a null text has none. Null sources are one source. Repeated rows are served each,
    rows without words never. Equal finish times go by shuffle key, then doc_id, size and row. Very
    long texts count whole. An empty table gives an empty result.
    """
    served = _served(docs, F.monotonically_increasing_id(), seed, weights)
    return served.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies", "source")


def _served(docs: DataFrame, row: Column, seed: int, weights: tuple[int, ...]) -> DataFrame:
    """One row per document: row (its number), doc_id, source, size, copies, source_size, target."""
    spark = docs.sparkSession
    sized = docs.select(F.col("doc_id").cast("long"), F.col("source").cast("string"), word_count(F.col("text")).alias("size"), row.alias("row"))
    sized = settle(sized.withColumn("key", _shuffled(F.col("doc_id"), seed)))
    goals = settle(targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights))

    # words before each document, then those before its source's first one
    order = [F.col("source").asc_nulls_last(), F.col("key"), F.col("doc_id"), F.col("size"), F.col("row")]
    served = settle(_ahead(sized.where("size > 0"), order, {"ahead": F.col("size")}))
    first = served.groupBy("source").agg(F.min("ahead").alias("first"))
    goal = goals.join(first.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")), "left").drop("s")
    # a source may hold very many rows: its one row of goals comes in SALT copies, each for a part of them
    goal = settle(goal.select(F.col("source").alias("s"), "source_size", "target", "first"))
    salted = goal.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    same = F.col("source").eqNullSafe(F.col("s")) & ((F.col("row") % SALT).cast("int") == F.col("part"))
    served = served.join(salted, same)
    total = F.col("ahead") - F.col("first") + F.col("size")
    queue = served.select("row", "doc_id", "key", "size", "source_size", "target", total.alias("total"), F.explode(F.sequence(F.lit(0), F.lit(MOST_COPIES - 1))).alias("copy"))
    queue = queue.withColumn("total", F.col("total") + F.col("copy") * F.col("source_size"))
    queue = queue.where((F.col("total") - F.col("size")) / F.col("target") < 1)
    queue = queue.select((F.col("total") / F.col("target")).alias("finish"), "key", "doc_id", "copy", "row", "size")

    # the sorted queue is cut where the budget ends
    queue = _ahead(queue, [F.col(c) for c in ("finish", "key", "doc_id", "size", "row", "copy")], {"running": F.col("size")})
    budget = goals.agg(F.sum("source_size")).first()[0] or 0  # a number
    taken = queue.where(F.col("running") + F.col("size") <= F.lit(budget))
    taken = taken.groupBy("row").agg(F.count("*").alias("copies"))
    out = sized.join(taken, "row", "left").withColumn("copies", F.coalesce("copies", F.lit(0)))
    return out.join(salted, same).select("row", "doc_id", "source", "size", "copies", "source_size", "target")


def apply_mix(docs: DataFrame, seed: int = SEED, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """The rows of ``docs`` as often as the mix takes them.

    Every row has a number of its own, settled together with its columns, so rows that share
    doc_id, source and size (all null ids do) are told apart, and each comes as often as it is taken.
    Null, empty and wordless texts are never taken; a document with very many words may end the mix
    short of its budget by less than its size. Columns of any name pass. An empty table gives an
    empty one.
    """
    rows = settle(docs.select(F.struct("*").alias("doc"), F.monotonically_increasing_id().alias("row")))
    taken = _served(rows.select("doc.doc_id", "doc.text", "doc.source", "row"), F.col("row"), seed, weights)
    taken = taken.where("copies > 0").select("row", F.col("copies").cast("int").alias("copies"))
    return rows.join(taken, "row").select("doc", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("doc.*")
