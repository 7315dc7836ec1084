"""Toxicity by a weighted lexicon, matched with an Aho-Corasick automaton over folded text.

*Folding* lower-cases, turns homoglyphs (full-width, Cyrillic and Greek letters that look Latin)
and digit substitutions into letters and lets ``l`` and ``i`` coincide, since ``1`` stands for
both. The lexicon holds word beginnings; an entry counts where a folded word begins with it.

*Weights* come from labels: of a bounded sample of labelled documents (never a held-out one),
word beginnings are weighed by how much oftener toxic documents have them. Seed words keep a
default weight where labels say nothing. *Exception phrases* lift the entries inside them.

The *score* is a logistic function of the weights found, alone and divided by the length of the
text; it is fitted on the same sample.
"""

from __future__ import annotations

import math
import re
import unicodedata
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from papyrion.llm.shared import pieces as taken
from papyrion.llm.shared import sampled

#: Labelled documents that may be used for learning, and the characters they may have together.
TRAIN_ROWS, TRAIN_CHARS = 6000, 30_000_000
THRESHOLD = 0.3
#: Shortest and longest word beginning in folded characters; entries learned at most.
SHORTEST, LONGEST, ENTRIES = 4, 10, 3000
#: Toxic documents that must have an entry; least log ratio of its frequencies.
SUPPORT, LEAST_WEIGHT = 4, 3.0
SEED_WEIGHT = 3.0

#: Words that insult, and phrases in which such words do not.
SEED_WORDS = ("idiot", "imbecile", "moron", "stupid", "loser", "pathetic", "worthless", "scum", "scumbag", "trash", "clown", "disgusting", "dumbass", "bastard", "asshole", "bitch")
EXCEPTIONS = ("trash can", "trash bin", "trash bag", "trash collection", "clown fish", "clownfish", "circus clown", "idiot proof", "pond scum", "soap scum", "sore loser", "stupid question")
#: Characters that are written for others.
HOMOGLYPHS = {"а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ѕ": "s", "ԁ": "d", "к": "k", "м": "m", "т": "t", "н": "h", "в": "b", "α": "a", "ο": "o", "ι": "i", "ρ": "p", "ν": "v", "ı": "i", "ℓ": "l"}
SUBSTITUTIONS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "l": "i"}

BLANKS = "\n\t\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u2028\u2029"
_WORD = re.compile(r"[^\W_]+")
_FOREIGN = re.compile("[^\0-\u024f]")
_TABLE: dict[int, str | int] = {ord(a): b for a, b in (*HOMOGLYPHS.items(), *SUBSTITUTIONS.items())}
for _code in range(0xFF01, 0xFF5F):  # full-width forms of ASCII
    _c = unicodedata.normalize("NFKC", chr(_code)).lower()
    _TABLE[_code] = SUBSTITUTIONS.get(_c, _c)
for _code in range(0x200B, 0x2010):  # zero-width marks
    _TABLE[_code] = ""


def fold(text: str) -> str:
    """The text in lower case, look-alike characters replaced, each white space character a space."""
    low = text.lower()
    if _FOREIGN.search(low):
        low = low.translate(_TABLE)
    for written, meant in SUBSTITUTIONS.items():
        low = low.replace(written, meant)
    for blank in BLANKS:
        low = low.replace(blank, " ")
    return low


def words(folded: str) -> set[str]:
    return set(_WORD.findall(folded))


@dataclass
class Lexicon:
    """Entries (folded word beginnings) with weights, exception phrases (folded) and the score's coefficients."""

    weights: dict[str, float]
    exceptions: tuple[str, ...] = ()
    bias: float = -3.0
    slope: tuple[float, float] = (0.6, 0.3)
    _automaton: object = field(default=None, repr=False, compare=False)

    def __getstate__(self):
        return {**self.__dict__, "_automaton": None}

    @property
    def automaton(self):
        if self._automaton is None:
            import ahocorasick

            a = ahocorasick.Automaton()
            for entry, weight in self.weights.items():
                a.add_word(entry, (len(entry), weight))
            for phrase in self.exceptions:
                a.add_word(phrase, (len(phrase), -1.0))
            a.make_automaton()
            self._automaton = a
        return self._automaton

    def found(self, folded: str) -> tuple[float, int]:
        """(sum of the weights of all words that an entry begins, characters of the text)."""
        best: dict[int, float] = {}
        lifted: list[tuple[int, int]] = []
        for end, (size, weight) in self.automaton.iter(folded):
            start = end - size + 1
            if start and folded[start - 1].isalnum():
                continue
            if weight < 0:
                lifted.append((start, end))
            elif weight > best.get(start, 0.0):
                best[start] = weight
        if lifted:  # both in order of start, each read once
            free, until, k = {}, -1, 0
            lifted.sort()
            for s in sorted(best):
                while k < len(lifted) and lifted[k][0] <= s:
                    until = max(until, lifted[k][1])
                    k += 1
                if s > until:
                    free[s] = best[s]
            best = free
        return sum(best.values()), len(folded)

    def score(self, text: str | None) -> float:
        return self.probability(*self.found(fold(text or "")))

    def features(self, total: float, chars: int) -> tuple[float, float]:
        return math.log1p(total), math.log1p(5000.0 * total / (chars + 100.0))

    def probability(self, total: float, chars: int) -> float:
        z = self.bias + sum(s * x for s, x in zip(self.slope, self.features(total, chars), strict=True))
        return 1.0 / (1.0 + math.exp(-max(-30.0, min(30.0, z))))


def _beginnings(found: set[str]) -> set[str]:
    return {w[:k] for w in found for k in range(SHORTEST, min(len(w), LONGEST) + 1)}


def _kin(found: set[str]) -> int:
    """A number that copies of a text mostly share: the smallest hash of its words."""
    return min((zlib.crc32(w.encode()) for w in found if len(w) > SHORTEST), default=0)


def learn(rows: list[tuple[str, int]]) -> Lexicon:
    """A lexicon from (text, label) rows; without labels of both kinds, the seed words alone."""
    seeds = {fold(w): SEED_WEIGHT for w in SEED_WORDS}
    exceptions = tuple(map(fold, EXCEPTIONS))
    n = [sum(1 for _, y in rows if not y), sum(1 for _, y in rows if y)]
    if not all(n):
        return Lexicon(seeds, exceptions)
    folded = [fold(t) for t, _ in rows]
    found = [words(t) for t in folded]
    # copies of one text count once, or all of its rare words would look toxic
    kin: dict[str, set[int]] = {}
    for have, (_, y) in zip(found, rows, strict=True):
        if y:
            mark = _kin(have)
            for f in _beginnings(have):
                kin.setdefault(f, set()).add(mark)
    n[1] = len({_kin(have) for have, (_, y) in zip(found, rows, strict=True) if y})
    toxic = {f: len(marks) for f, marks in kin.items() if len(marks) >= SUPPORT or f in seeds}
    clean: Counter[str] = Counter()
    stems = {f[:SHORTEST] for f in toxic}
    for have, (_, y) in zip(found, rows, strict=True):
        if not y:
            clean.update(f for f in _beginnings({w for w in have if w[:SHORTEST] in stems}) if f in toxic)
    weights = {f: math.log((c + 0.5) / (n[1] + 1)) - math.log((clean[f] + 1.5) / (n[0] + 2)) for f, c in toxic.items()}
    kept = {f: w for f, w in weights.items() if w >= LEAST_WEIGHT}
    # a beginning that one longer beginning explains nearly always gives way to it
    longer: dict[str, int] = {}
    for f in toxic:
        longer[f[:-1]] = max(longer.get(f[:-1], 0), toxic[f])
    kept = {f: w for f, w in kept.items() if longer.get(f, 0) < 0.95 * toxic[f]}
    best = sorted(kept, key=lambda f: (-kept[f] * math.sqrt(toxic[f]), f))[:ENTRIES]
    lexicon = Lexicon({**seeds, **{f: kept[f] for f in best}}, exceptions)
    totals = [lexicon.found(t) for t in folded]
    x = np.array([(1.0, *lexicon.features(*t)) for t in totals])
    y = np.array([y for _, y in rows], dtype=float)
    beta = np.zeros(3)
    for _ in range(50):  # Newton steps with a little ridge, so separable data stay finite
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        grad = x.T @ (y - p) - 0.05 * beta
        hess = (x * (p * (1 - p))[:, None]).T @ x + 0.05 * np.eye(3)
        step = np.linalg.solve(hess, grad)
        beta += step
        if np.abs(step).max() < 1e-8:
            break
    lexicon.bias, lexicon.slope = float(beta[0]), (float(beta[1]), float(beta[2]))
    return lexicon


def held_out(doc_id: Column) -> Column:
    """Rows that never teach: crc32 of the id as text leaves 2 when divided by 4. A null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("long").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame) -> Lexicon:
    """Learn from at most TRAIN_ROWS distinct labelled texts of TRAIN_CHARS characters together, chosen by a hash.

    Labels with a null doc_id or label are left out; of several labels of a document the largest holds.
    """
    known = labels.where("doc_id is not null and toxic is not null").where(~held_out(F.col("doc_id")))
    chosen = known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    texts = docs.where("text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = sampled(texts, TRAIN_ROWS, TRAIN_CHARS, lambda sizes: sizes.join(chosen.withColumnRenamed("toxic", "label"), "doc_id"))
    return learn([(r["text"], int(toxic > 0)) for r, toxic in rows])


def _scores(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = shared.value
        for batch in taken(batches):
            scores = [lexicon.score(t) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(scores, pa.float64()), pa.array([int(s >= THRESHOLD) for s in scores], pa.int32())], names=["doc_id", "held_out", "score", "predicted"])

    return run


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document: doc_id, held_out, score (0 to 1), predicted (1 from THRESHOLD on).

    Texts are the only input of a score; null and empty texts get the score of a text without
    entries. Very long texts are read whole. Repeated rows come out each, null doc_ids too. Without
    labels the seed words decide. Other columns are not read. An empty table gives an empty result.
    """
    lexicon = train(docs, labels)
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)  # at most ENTRIES entries and the seeds
    rows = docs.select(F.col("doc_id").cast("long"), held_out(F.col("doc_id")).alias("held_out"), F.col("text").cast("string"))
    return rows.mapInArrow(_scores(shared), "doc_id long, held_out boolean, score double, predicted int")


def _clean(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = shared.value
        for batch in taken(batches):
            at = batch.schema.get_field_index("text")
            keep = [lexicon.score(t) < THRESHOLD for t in batch.column(at).to_pylist()]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return run


def remove_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that ``score`` does not predict as toxic, each judged by its own text.

    Null and empty texts stay; very long ones are read whole; equal rows share a fate; null doc_ids
    and columns of any name pass; an empty table gives an empty one.
    """
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, labels))
    return docs.mapInArrow(_clean(shared), docs.schema)
