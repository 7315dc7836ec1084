"""Term mining: n-gram counts, top-k lists, their union, contexts, and terms found in texts.

A *book* is the unit: a bounded number of chapters (as in an e-book), so windows over a book's
words fit a task. Counts are partial aggregates before they are shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType

from papyrion.functions.text import context
from papyrion.runtime import settle

#: Stop words.
STOP_WORDS = {
    "english": "the and a of to in is it that with as for was",
    "spanish": "el la los las un una unos unas de del al y o en a con por para es son que se su sus",
    "french": "le la les un une des du de et ou en a à dans sur pour par avec est sont que qui se son sa ses",
}
#: List number, words of a term and terms kept: over a whole book; over each chapter.
BOOK_LISTS, CHAPTER_LISTS = ((1, 100), (2, 100), (3, 100), (4, 50)), ((2, 50), (3, 50), (4, 30))
LEAST_COUNT, CHAPTER_WORDS, CHAPTER_TERMS = 3, 50, 150


def word_lists(chapters: DataFrame, language: str = "english", pattern: str = "[a-z0-9_]+") -> DataFrame:
    """STR-19, FLT-37: (book, chapter, words) of (book, chapter, text): words of more than one character that are no stop words.

    English words are ASCII; give ``[\\p{L}\\p{N}_]+`` for other languages. Tokenizers for
    unspaced scripts plug in here as a function that gives the same columns.
    """
    found = F.regexp_extract_all(F.lower("text"), F.lit(pattern), 0)
    stops = STOP_WORDS.get(language.lower(), STOP_WORDS["english"]).split()
    kept = F.filter(found, lambda w: (F.length(w) > 1) & ~w.isin(stops))
    return chapters.select("book", "chapter", kept.alias("words")).where(F.size("words") > 0)


def ngrams(found: DataFrame, n: int, within: tuple[str, ...] = ("book",)) -> DataFrame:
    """AGG-02: (within..., chapter, pos, term) of word lists: n words in a row; over a book they run across chapters.

    Terms are formed inside of each list. At its end come the first words of the chapters that follow: each has a
    word, so n - 1 of them are enough, and only lists are sorted.
    """
    whole = F.col("words")
    if n > 1 and "chapter" not in within:
        after = Window.partitionBy(*within).orderBy("chapter").rowsBetween(1, n - 1)
        found = found.withColumn("_next", F.slice(F.flatten(F.collect_list(F.slice("words", 1, n - 1)).over(after)), 1, n - 1))
        whole = F.concat("words", "_next")
    found = found.withColumn("_all", whole)
    last = F.least(F.size("words"), F.size("_all") - (n - 1))
    if n == 1:
        grams = F.transform("words", lambda w, i: F.struct(i.alias("pos"), w.alias("term")))
    else:
        at = F.when(last > 0, F.sequence(F.lit(0), F.greatest(last - 1, F.lit(0)))).otherwise(F.array().cast("array<int>"))
        grams = F.transform(at, lambda i: F.struct(i.alias("pos"), F.array_join(F.slice("_all", i + 1, n), " ").alias("term")))
    return found.select(*dict.fromkeys((*within, "chapter")), F.inline(grams))


def top_terms(terms: DataFrame, k: int, within: tuple[str, ...] = ("book",)) -> DataFrame:
    """TOP-01: (within..., term, count, place): the k most frequent, the first seen before others of equal count."""
    counts = terms.groupBy(*within, "term").agg(F.count("*").alias("count"), F.min(F.struct("chapter", "pos")).alias("first"))
    order = Window.partitionBy(*within).orderBy(F.col("count").desc(), "first")
    return counts.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k).drop("first")


#: Between the words of a list on its way to ``frequent``; words of a pass that are counted at once, whole books.
_GLUE, _WORDS = "\x1f", 400_000


def frequent(found: DataFrame, in_books: bool = True, in_chapters: bool = True) -> DataFrame:
    """AGG-02, AGG-04: (book, chapter, list, n, term, count, place) of BOOK_LISTS (chapter is null) and CHAPTER_LISTS (list is their number), counts from LEAST_COUNT on.

    Word lists are moved once, to the task of their book. A term that is frequent there has frequent parts, so terms are
    looked for only where those of one word less were found, and no table of all n-grams is made.
    """
    kinds = found.schema
    schema = StructType([StructField("book", kinds["book"].dataType), StructField("chapter", kinds["chapter"].dataType), *(StructField(c, t) for c, t in (("list", IntegerType()), ("n", IntegerType()), ("term", StringType()), ("count", LongType()), ("place", IntegerType())))])
    rows = found.where(F.size("words") > 0).select("book", "chapter", F.array_join("words", _GLUE).alias("_text"))
    return rows.repartition("book").sortWithinPartitions("book", "chapter").mapInArrow(_count(in_books, in_chapters), schema)


def _count(in_books: bool, in_chapters: bool):
    def whole(books: list, chapters: list, texts: list[pa.Array], batch: pa.Schema) -> Iterator[pa.RecordBatch]:
        lists = pc.split_pattern(pa.chunked_array(texts).cast(pa.large_string()), _GLUE).combine_chunks()
        if isinstance(lists, pa.ChunkedArray):
            lists = lists.chunk(0)
        words = lists.flatten()
        sizes = np.diff(lists.offsets.to_numpy())
        codes = words.dictionary_encode().indices.to_numpy().astype(np.int64)
        change = lambda keys: np.cumsum([0, *(a != b for a, b in zip(keys, keys[1:]))])
        row, pos = np.repeat(np.arange(len(sizes)), sizes), np.arange(len(codes)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        parts = []
        if in_books:
            unit = change(books)[row]
            parts += [(i, n, k, *hit) for i, (n, k) in enumerate(BOOK_LISTS) for hit in _grams(codes, unit, unit, np.arange(len(codes)), n, k)]
        if in_chapters:
            some = np.repeat(sizes >= CHAPTER_WORDS, sizes)
            kept = np.flatnonzero(some)
            unit = change(list(zip(books, chapters)))[row]
            parts += [(len(BOOK_LISTS), n, k, kept[at], count, place) for n, k in CHAPTER_LISTS for at, count, place in _grams(codes[kept], unit[kept], row[kept], pos[kept], n, k)]
        for number, n, _, at, count, place in parts:
            terms = words.take(pa.array(at))
            for step in range(1, n):
                terms = pc.binary_join_element_wise(terms, words.take(pa.array(at + step)), pa.scalar(" ", pa.large_string()))
            where = row[at].tolist()
            yield pa.RecordBatch.from_arrays(
                [pa.array([books[k] for k in where], batch.field(0).type), pa.array([chapters[k] if number == len(BOOK_LISTS) else None for k in where], batch.field(1).type), pa.array([number] * len(at), pa.int32()),
                 pa.array([n] * len(at), pa.int32()), terms.cast(pa.string()), pa.array(count, pa.int64()), pa.array(place, pa.int32())], names=["book", "chapter", "list", "n", "term", "count", "place"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books: list = []
        chapters: list = []
        texts: list[pa.Array] = []
        held = 0
        for batch in batches:
            keys, parts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            sizes = pc.binary_length(batch.column(2)).to_numpy()
            at = 0
            for k, (key, size) in enumerate(zip(keys, sizes.tolist())):
                if held >= 6 * _WORDS and key != (keys[k - 1] if k else books[-1]):
                    yield from whole(books + keys[at:k], chapters + parts[at:k], [*texts, batch.column(2).slice(at, k - at)], batch.schema)
                    books, chapters, texts, held, at = [], [], [], 0, k
                held += size
            books, chapters, texts = books + keys[at:], chapters + parts[at:], [*texts, batch.column(2).slice(at)]
        if books:
            yield from whole(books, chapters, texts, batch.schema)

    return run


def _grams(codes, unit, run, pos, n: int, k: int):
    """(index of one hit, count, place) of the ``k`` most frequent terms of ``n`` words of each unit, the least ``pos`` first; terms stay inside of a run."""
    at, key = np.arange(len(codes)), unit * (codes.max(initial=0) + 1) + codes
    for size in range(1, n + 1):
        _, one, term, count = np.unique(key, return_index=True, return_inverse=True, return_counts=True)
        often = count >= LEAST_COUNT
        if size < n:
            ids = np.full(len(codes) + 1, -1)
            ids[at] = np.where(often[term], term, -1)
            at = np.flatnonzero((ids[:-1] >= 0) & (ids[1:] >= 0) & np.append(run[:-1] == run[1:], False)) if len(codes) else at
            key = ids[at] * (len(count) + 1) + ids[at + 1]
    first = np.full(len(count), np.iinfo(np.int64).max)
    np.minimum.at(first, term, pos[at])
    one, count, first = at[one[often]], count[often], first[often]
    order = np.lexsort((first, -count, unit[one]))
    one, count = one[order], count[order]
    place = np.arange(len(one)) - np.searchsorted(unit[one], unit[one]) + 1
    top = place <= k
    if top.any():
        yield one[top], count[top], place[top]


def _merged(kept: DataFrame) -> DataFrame:
    summed = kept.groupBy("book", "term").agg(F.sum("count").alias("count"), F.min(F.struct("chapter", "n", "place")).alias("first"))
    order = Window.partitionBy("book").orderBy(F.col("count").desc(), "first")
    return summed.withColumn("place", F.row_number().over(order)).where(F.col("place") <= CHAPTER_TERMS).drop("first")


def chapter_terms(found: DataFrame) -> DataFrame:
    """AGG-04: (book, term, count, place): frequent n-grams of long chapters, summed over chapters."""
    return _merged(frequent(found, in_books=False))


def candidates(found: DataFrame) -> DataFrame:
    """AGG-03, SET-01, AGG-05: (book, term, count, list): all lists one after the other; of a term the first stays.

    Counts below three go after the top-k lists are cut, so they may leave a list short.
    """
    counted = settle(frequent(found))  # short, and read twice
    last = len(BOOK_LISTS)
    columns = ("book", "term", "count", "place", "list")
    lists = counted.where(F.col("list") < last).select(*columns).unionByName(_merged(counted.where(F.col("list") == last)).withColumn("list", F.lit(last)))
    return first_wins(lists, ("book", "term"), ("list", "place"))


def first_wins(rows: DataFrame, key: tuple[str, ...], order: tuple[str, ...]) -> DataFrame:
    """AGG-05, AGG-06: of rows with one key the first in order."""
    return rows.withColumn("_row", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("_row = 1").drop("_row")


def with_context(terms: DataFrame, chapters: DataFrame) -> DataFrame:
    """STR-04: adds the context of a term in the first chapter of its book that has it; empty if none. Each text is searched once, for the terms of its book."""
    terms = settle(terms)  # short, and read twice
    own = terms.where("term <> ''").groupBy("book").agg(F.sort_array(F.collect_set("term")).alias("_terms"))
    texts = chapters.join(own, "book").select("book", "chapter", "_terms", _spot_own()(F.lower("text"), F.transform("_terms", lambda t: F.lower(t))).alias("_at"))
    hits = texts.select("book", "chapter", F.explode(F.transform("_at", lambda k: F.get("_terms", k))).alias("term"))
    where = hits.groupBy("book", "term").agg(F.min("chapter").alias("chapter")).groupBy("book", "chapter").agg(F.collect_list("term").alias("_terms"))
    shown = where.join(chapters, ["book", "chapter"]).select("book", F.inline(F.transform("_terms", lambda t: F.struct(t.alias("term"), context(F.col("text"), t).alias("context")))))
    return terms.join(shown.groupBy("book", "term").agg(F.min("context").alias("context")), ["book", "term"], "left").withColumn("context", F.coalesce("context", F.lit("")))


#: Terms and their characters that go out as one automaton; a larger glossary is joined by keys.
MOST_TERMS, MOST_CHARS = 200_000, 4_000_000


def found_terms(batches: DataFrame, glossary: DataFrame, most: int = MOST_TERMS) -> DataFrame:
    """JOIN-05: (columns of batches, term): terms that a batch's content holds, whatever the case, markup included.

    A glossary of checked size (``most`` terms, MOST_CHARS characters) is one automaton that reads each
    text once. A larger one is joined by the first three characters of its terms, shorter terms by all
    they have. Both give the same rows.
    """
    terms = glossary.select("term").where("term <> ''").distinct().withColumn("_low", F.lower("term"))
    low = F.lower("content")
    n, chars = terms.agg(F.count("*"), F.coalesce(F.sum(F.length("_low")), F.lit(0))).first()
    if n <= most and chars <= MOST_CHARS:
        words: dict[str, list[str]] = {}
        for term, key in terms.collect():
            words.setdefault(key, []).append(term)
        shared = batches.sparkSession.sparkContext.broadcast(words)
        return batches.withColumn("_found", _spot(shared)(low)).select(*batches.columns, F.explode("_found").alias("term"))
    cut = lambda n: F.transform(F.sequence(F.lit(1), F.greatest(F.length(low) - n + 1, F.lit(1))), lambda i: F.substr(low, i, F.lit(n)))
    keyed = batches.withColumn("_gram", F.explode(F.array_distinct(F.concat(*map(cut, (1, 2, 3))))))
    keys = terms.select("term", "_low", F.substr("_low", F.lit(1), F.lit(3)).alias("_gram"))
    return keyed.join(keys, "_gram").where(F.contains(low, F.col("_low"))).drop("_gram", "_low")


def _spot(shared):
    """Of each text the terms that it holds; only texts and terms pass through Python."""

    @F.arrow_udf("array<string>")
    def spot(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        names = [term for terms in shared.value.values() for term in terms]
        groups, at = {}, 0
        for key, terms in shared.value.items():
            groups[key] = range(at, at := at + len(terms))
        search, every = _automaton(groups), pa.array(names, pa.string())
        for texts in batches:
            hits, ends = [], [0]
            for text in texts:
                for numbers in search(text.as_py() or ""):
                    hits.extend(numbers)
                ends.append(len(hits))
            yield pa.ListArray.from_arrays(pa.array(ends, pa.int32()), every.take(pa.array(hits, pa.int32())))

    return spot


def _spot_own():
    """Of each text the places of the terms that it holds in the list beside it; one search for texts in a row with one list."""

    @F.arrow_udf("array<int>")
    def spot(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        now, search = None, None
        for texts, lists in batches:
            hits, ends = [], [0]
            for k, text in enumerate(texts):
                keys = lists[k].values
                if now is None or not keys.equals(now):
                    now, groups = keys, {}
                    for i, key in enumerate(keys.to_pylist()):
                        groups.setdefault(key, []).append(i)
                    search = _automaton(groups)
                for numbers in search(text.as_py() or ""):
                    hits.extend(numbers)
                ends.append(len(hits))
            yield pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(hits, pa.int32()))

    return spot.asNondeterministic()  # else Spark asks twice, for the filter of an explode too


def _automaton(groups: dict):
    """A function of a text that gives the values of the keys that it holds, each once."""
    import ahocorasick

    found = ahocorasick.Automaton()
    for key, value in groups.items():
        found.add_word(key, (key, value))
    if not len(found):
        return lambda text: []
    found.make_automaton()
    return lambda text: dict(x for _, x in found.iter(text)).values()


def glossary_map(pairs: DataFrame) -> Column:
    """AGG-06: aggregate of (term, translation, ord) rows to a map; pairs need both sides."""
    rows = F.sort_array(F.collect_list(F.when((F.trim("term") != "") & (F.trim("translation") != ""), F.struct("ord", "term", "translation"))))
    firsts = F.filter(rows, lambda x, i: ~F.exists(F.slice(rows, 1, i), lambda y: y["term"] == x["term"]))
    return F.map_from_entries(F.transform(firsts, lambda r: F.struct(r["term"].alias("key"), r["translation"].alias("value"))))


def repeated_periphery(lines: DataFrame, least: int = 2) -> DataFrame:
    """AGG-15: (zone, signature, pages): margin texts seen on several distinct pages."""
    return lines.groupBy("zone", "signature").agg(F.countDistinct("page").alias("pages")).where(F.col("pages") >= least)


def chunks(rows: DataFrame, order: str, size: int = 100) -> DataFrame:
    """WIN-18: adds the number of the fixed-size chunk; for lists that are cut to a bounded length before."""
    return rows.withColumn("chunk", F.floor((F.row_number().over(Window.orderBy(order)) - 1) / size))
