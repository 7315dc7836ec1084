"""Quality classifier by co-training of two views.

*Text view*: shape of the text (word lengths, variety, repeats, marks, capitals, lines) and a
bag of hashed words. *Metadata view*: what is known about a document without reading it (its
source, language, recorded length).

Both start from the labelled sample. Each round, each view labels the unlabelled pool; the
documents of which it is surest go, with its pseudo-labels, to the *other* view's training set.
Afterwards each view is calibrated on labelled documents that neither trained on (Platt
scaling), and a document's score adds the calibrated log odds of both views, counting the prior
once. A view that tells nothing is calibrated flat and adds nothing.

Models are fitted with numpy on the driver from bounded samples; all documents are scored where
they are.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from papyrion.llm.shared import pieces as taken
from papyrion.llm.shared import sampled

#: Labelled and unlabelled documents that are fetched for training, and the characters they may have together.
LABELLED, UNLABELLED, SAMPLE_CHARS = 4000, 2000, 30_000_000
ROUNDS, EXCHANGED, SURE = 4, 150, 0.95
HASHED = 1 << 11
THRESHOLD = 0.5
VIEWED = ("text", "source", "lang", "n_chars")
_MARKS = re.compile(r"[^\w\s.,;:'’-]")


# ---------------------------------------------------------------- views

SHAPES = 13


def text_view(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(shape, slots of hashed words) of a whole text."""
    text = text or ""
    words = text.split()
    n, chars = len(words), max(len(text), 1)
    kinds = Counter(words)
    lines = text.count("\n") + 1
    marks = len(_MARKS.findall(text))
    low = text.lower()
    most = max(kinds.values(), default=0)
    again = sum(a == b for a, b in zip(words, words[1:], strict=False))
    length = sum(map(len, words))
    upper = sum(w.isupper() and len(w) > 1 for w in kinds)
    shape = np.array([
        1.0, math.log1p(n) / 8, length / max(n, 1) / 10, len(kinds) / max(n, 1), most / max(n, 1), again / max(n - 1, 1),
        marks / chars * 10, upper / max(len(kinds), 1), (low != text) * 1.0, lines / max(n, 1) * 10, (n < 5) * 1.0,
        sum(w.isdigit() for w in kinds) / max(len(kinds), 1), n / chars * 5,
    ])
    slots = {zlib.crc32(w.lower().encode()) % HASHED for w in kinds}
    return shape, np.fromiter(slots, dtype=np.int64, count=len(slots))


def meta_view(source: str | None, lang: str | None, n_chars: int | None) -> tuple[np.ndarray, np.ndarray]:
    """(shape, slots) of what is known about a document."""
    size = math.log1p(max(n_chars or 0, 0))
    shape = np.array([1.0, size / 10, (size / 10) ** 2, (source is None) * 1.0, (lang is None) * 1.0, (n_chars is None) * 1.0])
    site = source or ""
    top = site.rstrip("0123456789")
    names = (f"source={site}", f"kind={top}", f"lang={lang}", f"both={site}|{lang}", f"size={int(size * 2)}")
    return shape, np.array(sorted({zlib.crc32(x.encode()) % HASHED for x in names}), dtype=np.int64)


@dataclass
class Logistic:
    """Logistic regression over (shape, slots) rows."""

    dense: np.ndarray
    slots: np.ndarray
    scale: float = 1.0
    shift: float = 0.0

    def logit(self, shape: np.ndarray, slots: np.ndarray) -> float:
        bag = self.slots[slots].sum() / math.sqrt(len(slots)) if len(slots) else 0.0
        return self.scale * (float(self.dense @ shape) + float(bag)) + self.shift


def _fit(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, epochs: int = 30, ridge: float = 1e-3) -> Logistic:
    """Adagrad over all rows; slots are weighted by the root of their number."""
    dense = np.stack([r[0] for r in rows])
    which = np.repeat(np.arange(len(rows)), [len(r[1]) for r in rows])
    slot = np.concatenate([r[1] for r in rows]) if len(rows) else np.zeros(0, dtype=np.int64)
    value = 1 / np.sqrt(np.bincount(which, minlength=len(rows)))[which]
    w, v = np.zeros(dense.shape[1]), np.zeros(HASHED)
    gw, gv = np.full(dense.shape[1], 1e-6), np.full(HASHED, 1e-6)
    balance = np.where(y > 0.5, 0.5 / max(y.mean(), 1e-6), 0.5 / max(1 - y.mean(), 1e-6))
    for _ in range(epochs * 4):
        z = dense @ w + np.bincount(which, v[slot] * value, minlength=len(rows))
        err = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) * balance / len(rows)
        dw = dense.T @ err + ridge * w
        dv = np.bincount(slot, err[which] * value, minlength=HASHED) + ridge * v
        gw += dw**2
        gv += dv**2
        w -= 0.3 * dw / np.sqrt(gw)
        v -= 0.3 * dv / np.sqrt(gv)
    return Logistic(w, v)


def _calibrate(model: Logistic, rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray) -> None:
    """Platt scaling: scale and shift of the logits; never a negative scale."""
    z = np.array([model.logit(*r) for r in rows])
    target = np.where(y > 0.5, (y.sum() + 1) / (y.sum() + 2), 1 / ((1 - y).sum() + 2))
    spread = max(float(z.std()), 1e-9)
    u = (z - z.mean()) / spread  # Newton on standard logits, steps halved until the loss falls
    loss = lambda p: float(np.logaddexp(0, p[0] * u + p[1]).sum() - (target * (p[0] * u + p[1])).sum() + 0.05 * p[0] ** 2)
    p = np.array([1.0, 0.0])
    for _ in range(100):
        q = 1 / (1 + np.exp(-np.clip(p[0] * u + p[1], -30, 30)))
        d = q * (1 - q)
        grad = np.array([((q - target) * u).sum() + 0.1 * p[0], (q - target).sum()])
        hess = np.array([[(d * u * u).sum() + 0.1, (d * u).sum()], [(d * u).sum(), d.sum() + 1e-6]])
        step, now = np.linalg.solve(hess, grad), loss(p)
        rate = next((r for r in 0.5 ** np.arange(30) if loss(p - r * step) <= now), 0.0)
        p = p - rate * step
        if rate * np.abs(step).max() < 1e-9:
            break
    if p[0] > 0:
        model.scale, model.shift = float(p[0] / spread), float(p[1] - p[0] * z.mean() / spread)
    else:
        model.scale, model.shift = 0.0, float(math.log(target.mean() / (1 - target.mean())))


@dataclass
class Judge:
    text: Logistic
    meta: Logistic
    prior: float

    def score(self, text, source, lang, n_chars) -> tuple[float, float, float]:
        """(text, metadata, combined) probabilities that the quality is 1."""
        a, b = self.text.logit(*text_view(text)), self.meta.logit(*meta_view(source, lang, n_chars))
        squash = lambda z: 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))
        return squash(a), squash(b), squash(a + b - self.prior)


def cotrain(labelled: list[tuple], unlabelled: list[tuple]) -> Judge:
    """Rows are (text, source, lang, n_chars[, label]); with one kind of label only, its share is every score."""
    share = sum(r[4] for r in labelled) / len(labelled) if labelled else 0.5
    if not labelled or share in (0, 1):
        flat = lambda n: Logistic(np.zeros(n), np.zeros(HASHED), 0.0, 0.0)
        level = math.log((share * len(labelled) + 1) / ((1 - share) * len(labelled) + 1))
        return Judge(flat(SHAPES), flat(6), -level)
    views = {"text": lambda r: text_view(r[0]), "meta": lambda r: meta_view(*r[1:4])}
    cut = max(1, len(labelled) // 4)  # calibration rows, then training rows
    calibrate, learn = labelled[:cut], labelled[cut:] or labelled
    if len({r[4] for r in calibrate}) < 2 or len({r[4] for r in learn}) < 2:
        calibrate = learn = labelled
    have = {k: ([f(r) for r in learn], [float(r[4]) for r in learn]) for k, f in views.items()}
    pool = {k: [f(r) for r in unlabelled] for k, f in views.items()}
    left = {k: set(range(len(unlabelled))) for k in views}
    models = {}
    for turn in range(ROUNDS + 1):
        for k, (rows, y) in have.items():
            models[k] = _fit(rows, np.array(y))
        if turn == ROUNDS:
            break
        base = {k: float(np.mean(y)) for k, (_, y) in have.items()}
        gifts = {}
        for k in views:
            other = "meta" if k == "text" else "text"
            at = sorted(left[other])
            p = np.array([1 / (1 + math.exp(-max(-30.0, min(30.0, models[k].logit(*pool[k][i]))))) for i in at])
            up = [i for i in np.argsort(-p, kind="stable")[: round(EXCHANGED * base[k])] if p[i] >= SURE]
            down = [i for i in np.argsort(p, kind="stable")[: round(EXCHANGED * (1 - base[k]))] if p[i] <= 1 - SURE]
            gifts[other] = [(at[i], 1.0) for i in up] + [(at[i], 0.0) for i in down]
        for k, given in gifts.items():
            for i, y in given:
                have[k][0].append(pool[k][i])
                have[k][1].append(y)
                left[k].discard(i)
    y = np.array([float(r[4]) for r in calibrate])
    for k, f in views.items():
        _calibrate(models[k], [f(r) for r in calibrate], y)
    prior = math.log((y.sum() + 1) / (len(y) - y.sum() + 1))
    return Judge(models["text"], models["meta"], prior)


# ---------------------------------------------------------------- Spark


def held_out(doc_id: Column) -> Column:
    """Labels that never teach, kept for measuring: crc32 of the id as text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(doc_id.cast("long").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _columns(docs: DataFrame) -> DataFrame:
    get = lambda name, kind: (F.col(name) if name in docs.columns else F.lit(None)).cast(kind).alias(name)
    return docs.select(get("doc_id", "long"), get("text", "string"), get("source", "string"), get("lang", "string"), get("n_chars", "long"))


def train(docs: DataFrame, labels: DataFrame) -> Judge:
    """Co-train on at most LABELLED labelled and UNLABELLED other distinct rows, chosen by a hash; nulls are seen as they are scored.

    Labelled texts get two thirds of SAMPLE_CHARS, the others one.
    """
    rows = _columns(docs).where("text is not null")
    known = labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("quality").cast("int")).alias("quality"))
    rows = rows.select("doc_id", *VIEWED)
    taught = known.where(~held_out(F.col("doc_id"))).withColumnRenamed("quality", "label")
    teach = sampled(rows, LABELLED, SAMPLE_CHARS * 2 // 3, lambda sizes: sizes.join(taught, "doc_id"))
    other = sampled(rows, UNLABELLED, SAMPLE_CHARS // 3, lambda sizes: sizes.join(known, "doc_id", "left_anti").withColumn("label", F.lit(None).cast("int")))
    view = lambda r: tuple(r[c] for c in VIEWED)
    return cotrain([(*view(r), int(quality > 0)) for r, quality in teach], [view(r) for r, _ in other])


def _scores(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = shared.value
        for batch in taken(batches):
            found = [judge.score(*r) for r in zip(*(batch.column(k).to_pylist() for k in range(2, 6)), strict=True)]
            text, meta, both = zip(*found, strict=True) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(text, pa.float64()), pa.array(meta, pa.float64()), pa.array(both, pa.float64()), pa.array([int(s >= THRESHOLD) for s in both], pa.int32())], names=["doc_id", "held_out", "text_score", "meta_score", "score", "predicted"])

    return run


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document: doc_id, held_out, text_score, meta_score, score, predicted (1: good).

    ``docs`` needs doc_id and text; source, lang and n_chars are used where they are there, and
    may be null; other columns are not read. Null texts count as empty, very long ones are read whole.
    Repeated rows and null ids come out each. Labels with
    a null doc_id or quality are left out; of several the largest holds. Without labels every
    score is 0.5. Empty tables give an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, labels))  # two weight vectors of fixed size
    rows = _columns(docs).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text", "source", "lang", "n_chars")
    return rows.mapInArrow(_scores(shared), "doc_id long, held_out boolean, text_score double, meta_score double, score double, predicted int")
