"""The pluggable text stage: a translator per batch, retries, rounds, and a checkpoint.

A translator is any object with ``translate(texts: list[str]) -> list[str | None]``; it may raise.
Failures stay rows: (ok, error, attempts), never exceptions of the job.
"""

from __future__ import annotations

import time
import zlib
from collections.abc import Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from papyrion.runtime import settle

ATTEMPTS, PAUSE, ROUNDS = 3, 2.0, 3
#: Signals in messages of refused and of broken requests.
POLICY_SIGNALS = ("content policy", "content_policy", "safety", "moderation", "sensitive", "blocked by", "policy violation", "inappropriate")
OTHER_SIGNALS = ("json", "timeout", "timed out", "rate limit", "too many requests", "network", "econnreset", "parse")


class Translator(Protocol):
    def translate(self, texts: list[str]) -> list[str | None]: ...


class Upper:
    """Offline stub: upper case."""

    def translate(self, texts: list[str]) -> list[str | None]:
        return [t.upper() for t in texts]


class Identity:
    def translate(self, texts: list[str]) -> list[str | None]:
        return list(texts)


class Dictionary:
    """Offline stub: words of a table, others as they are."""

    def __init__(self, words: dict[str, str]):
        self.words = words

    def translate(self, texts: list[str]) -> list[str | None]:
        return [" ".join(self.words.get(w, w) for w in t.split(" ")) for t in texts]


class Flaky:
    """Offline stub for rounds: text number h (crc32) fails until round h % most."""

    def __init__(self, most: int = 4):
        self.most, self.round = most, 0

    def translate(self, texts: list[str]) -> list[str | None]:
        return [t.upper() if zlib.crc32(t.encode()) % self.most <= self.round else None for t in texts]


def is_policy_error(message: str) -> bool:
    """FLT-32: a refusal, not a broken request."""
    low = message.lower()
    return any(s in low for s in POLICY_SIGNALS) and not any(s in low for s in OTHER_SIGNALS)


def call(translator: Translator, texts: list[str], attempts: int = ATTEMPTS, pause: float = PAUSE, fallback: Translator | None = None, limit: float = 90.0) -> tuple[list[str | None], str, int]:
    """EXE-02, EXE-07: (results, error, attempts): tries again after a pause, once with the fallback after a refusal; empty texts are not sent."""
    send = [k for k, t in enumerate(texts) if t]
    out: list[str | None] = ["" if not t else None for t in texts]
    error, used = "", 0
    for used in range(1, attempts + 1):
        began = time.monotonic()
        try:
            got = translator.translate([texts[k] for k in send]) if send else []
            if time.monotonic() - began > limit:
                raise TimeoutError(f"timeout after {limit} s")
            if len(got) != len(send):
                raise ValueError("the answer does not match the batch")
            for k, t in zip(send, got, strict=True):
                out[k] = t
            return out, "" if all(t is not None for t in out) else "missing", used
        except Exception as e:  # noqa: BLE001  any failure of a provider becomes a row
            error = f"{type(e).__name__}: {e}"
            if fallback is not None and is_policy_error(str(e)):
                translator, fallback = fallback, None
            elif used < attempts and pause:
                time.sleep(pause)
    return out, error, used


def translate(nodes: DataFrame, translator: Translator, text: str = "text", pause: float = PAUSE, fallback: Translator | None = None) -> DataFrame:
    """EXE-01, UDF-01: adds translated, ok, error, attempts; an Arrow batch is a request batch, partitions bound the concurrency."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            texts = ["" if t is None else t for t in pdf[text].tolist()]
            out, error, used = call(translator, texts, pause=pause, fallback=fallback)
            yield pdf.assign(translated=out, ok=[t is not None for t in out], error=["" if t is not None else error or "missing" for t in out], attempts=used)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in nodes.schema.fields)
    return nodes.mapInPandas(run, f"{schema}, translated string, ok boolean, error string, attempts int")


def answers(text: Column, translator: Translator, pause: float = PAUSE, fallback: Translator | None = None) -> Column:
    """EXE-01 as a column: the answer to each text, null where there is none; only the texts go through the stage, null ones are not sent."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            texts = batch.tolist()
            out, _, _ = call(translator, [t or "" for t in texts], pause=pause, fallback=fallback)
            yield pd.Series([None if t is None else o for t, o in zip(texts, out, strict=True)], dtype=object)

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(run, "string").asNondeterministic()(text)


def rounds(nodes: DataFrame, make, text: str = "text", most: int = ROUNDS) -> DataFrame:
    """EXE-03: what a round leaves open goes into the next; after the last the source text stays (ok is false).

    ``make(n)`` gives round n's translator. Each round's answers are settled in the shared
    checkpoint folder, so no text is sent twice when a later round or a lost executor asks again.
    """
    left, done = nodes, None
    for n in range(most):
        tried = settle(translate(left, make(n), text, pause=0).withColumn("round", F.lit(n)))
        good = tried.where("ok")
        done = good if done is None else done.unionByName(good)
        left = tried.where("not ok").select(*nodes.columns)
    rest = left.select("*", F.col(text).alias("translated"), F.lit(False).alias("ok"), F.lit("unresolved").alias("error"), F.lit(0).alias("attempts"), F.lit(most).alias("round"))
    return done.unionByName(rest)
