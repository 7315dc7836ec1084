"""Benchmark decontamination by pigeonhole edit matching.

A test item of n characters (normalised: lower case, words separated by one space) may appear in
a document with up to ``floor(rate * n)`` character edits. Split into one piece more than that
budget, at least one piece of any such appearance is untouched. All pieces of all items stand in
one Aho-Corasick automaton that runs over each whole text; around every piece hit, Myers'
bit-parallel algorithm finds the least edit distance of the whole item to a passage. Short items
are one piece without a budget, which must stand between word borders.
"""

from __future__ import annotations

import functools
import itertools
import re
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from papyrion.llm.shared import pieces as taken
from papyrion.llm.shared import settle

SCHEMA = "doc_id long, item_id long, distance int, budget int, passage_end int"
#: Edits for each character of an item; items with fewer normalised characters than MIN_CHARS have none, and appear as whole words only.
RATE, MIN_CHARS = 0.05, 24
#: Normalised characters of the items that are matched in one pass over the documents.
BLOCK_CHARS = 4_000_000
_WORDS = re.compile(r"\w+")


def normalise(text: str) -> str:
    return " ".join(_WORDS.findall(text.lower()))


def pieces(n: int, budget: int) -> list[tuple[int, int]]:
    """Borders of budget + 1 pieces of n characters."""
    return [(k * n // (budget + 1), (k + 1) * n // (budget + 1)) for k in range(budget + 1)]


class Pattern:
    """One item for Myers' algorithm: least distance to any substring of a text."""

    def __init__(self, item: str):
        self.n = len(item)
        self.masks: dict[str, int] = defaultdict(int)
        for k, c in enumerate(item):
            self.masks[c] |= 1 << k
        self.masks = dict(self.masks)
        self.full, self.high = (1 << self.n) - 1, 1 << (self.n - 1)

    def best(self, text: str, budget: int) -> tuple[int, int] | None:
        """(distance, end) of the best passage within the budget, the first of equals."""
        plus, minus, score, full, high = self.full, 0, self.n, self.full, self.high
        get, found = self.masks.get, None
        least = budget + 1
        for at, c in enumerate(text):
            eq = get(c, 0)
            xv = eq | minus
            xh = (((eq & plus) + plus) ^ plus) | eq
            ph = minus | (full & ~(xh | plus))
            mh = plus & xh
            if ph & high:
                score += 1
            elif mh & high:
                score -= 1
            # a passage may begin anywhere, so no difference enters at the top
            ph, mh = (ph << 1) & full, (mh << 1) & full
            plus = mh | (full & ~(xv | ph))
            minus = ph & xv
            if score < least:
                least, found = score, (score, at + 1)
        return found


class Index:
    """Pieces of a block of items, ready to scan texts."""

    def __init__(self, items: list[tuple[int, str]], rate: float):
        import ahocorasick

        self.items = [(i, t, int(rate * len(t)) if len(t) >= MIN_CHARS else 0) for i, t in items]
        self.patterns: dict[int, Pattern] = {}
        where: dict[str, list[tuple[int, int]]] = defaultdict(list)
        for k, (_, text, budget) in enumerate(self.items):
            for a, b in pieces(len(text), budget):
                where[text[a:b]].append((k, a))
        self.automaton = ahocorasick.Automaton()
        for piece, owners in where.items():
            self.automaton.add_word(piece, (len(piece), owners))
        self.automaton.make_automaton()

    def scan(self, text: str) -> list[tuple[int, int, int, int]]:
        """(item, distance, budget, end) for each item that appears: its best passage in the normalised text."""
        begins: dict[int, set[int]] = defaultdict(set)
        for end, (size, owners) in self.automaton.iter(text):
            for k, a in owners:
                s = end + 1 - size - a
                if len(self.items[k][1]) >= MIN_CHARS or ((s == 0 or text[s - 1] == " ") and text[end + 1 : end + 2] in ("", " ")):
                    begins[k].add(s)
        out = []
        for k, starts in begins.items():
            item, pattern, budget = self.items[k]
            if len(pattern) < MIN_CHARS:
                out.append((item, 0, 0, min(starts) + len(pattern)))
                continue
            if k not in self.patterns:
                self.patterns[k] = Pattern(pattern)
            best, upto = None, None
            spans: list[list[int]] = []
            for s in sorted(starts):  # an appearance begins and ends within the budget of where a piece says
                a, b = max(0, s - budget), min(len(text), s + len(pattern) + budget)
                if spans and a <= spans[-1][1] and s - upto <= budget:
                    spans[-1][1] = b
                else:
                    spans.append([a, b])
                upto = s
            for a, b in spans:
                hit = self.patterns[k].best(text[a:b], budget)
                if hit and (best is None or hit[0] < best[0]):
                    best = (hit[0], a + hit[1])
            if best:
                out.append((item, best[0], budget, best[1]))
        return out


@functools.lru_cache(maxsize=1)
def _kept(items: tuple[tuple[int, str], ...], rate: float) -> Index:
    return Index(list(items), rate)


def _index(items: list[tuple[int, str]], rate: float) -> Index:
    """The index of one block, which a worker keeps until it meets another."""
    return _kept(tuple(map(tuple, items)), rate)


def _scan(shared, rate: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = _index(shared.value, rate)
        for batch in taken(batches):
            rows = [(doc, *hit) for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for hit in index.scan(normalise(text or ""))]
            doc, item, distance, budget, end = zip(*rows, strict=True) if rows else ((),) * 5
            yield pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(item, pa.int64()), pa.array(distance, pa.int32()), pa.array(budget, pa.int32()), pa.array(end, pa.int32())], names=["doc_id", "item_id", "distance", "budget", "passage_end"])

    return run


def _blocks(benchmark: DataFrame) -> Iterator[list[tuple[int, str]]]:
    """Items in blocks of a bounded size, read one partition at a time."""
    block: list[tuple[int, str]] = []
    held = 0
    for row in benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string")).where("text is not null and item_id is not null").toLocalIterator():
        text = normalise(row[1])
        if not text:
            continue
        if block and held + len(text) > BLOCK_CHARS:
            yield block
            block, held = [], 0
        block.append((row[0], text))
        held += len(text)
    if block:
        yield block


def matches(docs: DataFrame, benchmark: DataFrame, rate: float = RATE) -> DataFrame:
    """Items that appear in documents: doc_id, item_id, distance, budget, passage_end.

    One row for each pair of a document row and an item: the least distance and the end of the first such
    passage, in characters of the normalised text. Null texts hold nothing; items that are null,
    have a null id or hold no word take no part, those with fewer than MIN_CHARS characters match as
    whole words without edits; items that are equal are
    reported each; repeated rows of ``docs`` come out each; very long texts are read whole; other
    columns are not read. Empty tables give an empty result.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    blocks = _blocks(benchmark)
    first, second = next(blocks, None), next(blocks, None)
    if first is None:
        return spark.createDataFrame([], SCHEMA)
    if second is None:  # at most BLOCK_CHARS characters, or one item
        return texts.mapInArrow(_scan(spark.sparkContext.broadcast(first), rate), SCHEMA)
    out = None
    for block in itertools.chain([first, second], blocks):  # one block at a time is out
        shared = spark.sparkContext.broadcast(block)
        found = settle(texts.mapInArrow(_scan(shared, rate), SCHEMA))
        shared.destroy()
        out = found if out is None else out.unionByName(found)
    return out


def _clean(shared, rate: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = _index(shared.value, rate)
        for batch in taken(batches):
            at = batch.schema.get_field_index("text")
            keep = [not index.scan(normalise(text or "")) for text in batch.column(at).to_pylist()]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return run


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, rate: float = RATE) -> DataFrame:
    """The rows of ``docs`` whose text holds no item.

    Every row is judged by its own text, whatever its doc_id: null and repeated ids and columns of
    any name change nothing. Null and empty texts stay; very long ones are read whole; equal rows
    share a fate. Without items all rows stay; an empty table gives an empty one.
    """
    spark = docs.sparkSession
    blocks = _blocks(benchmark)
    first, second = next(blocks, None), next(blocks, None)
    if first is None:
        return docs
    if second is None:
        return docs.mapInArrow(_clean(spark.sparkContext.broadcast(first), rate), docs.schema)
    for block in itertools.chain([first, second], blocks):
        shared = spark.sparkContext.broadcast(block)
        docs = settle(docs.mapInArrow(_clean(shared, rate), docs.schema))
        shared.destroy()
    return docs
