"""Token ids in binary shards, compressed by a Re-Pair grammar.

A shard holds whole documents in ascending doc_id order. Its payload (little-endian):

=============  =========================================================
header         magic ``RPS1``; uint32: symbol width in bytes, base size (first
               nonterminal), documents, rules, symbols; uint64: ids
doc ids        int64 for each document; uint8 for each: 1 if the id is not null
lengths        uint32 for each document: its ids, the end id included
doc symbols    uint32 for each document: index of its first symbol
rules          two symbols for each rule (rule r is the nonterminal base + r)
expansions     uint32 for each rule: number of ids that it stands for
symbols        the compressed sequence
=============  =========================================================

The end id takes part in no rule, so a document starts and ends on symbol borders and
``decode_document`` expands one document alone. Re-Pair runs in rounds: each counts all
neighbouring pairs of the shard exactly, replaces the most frequent ones (left to right,
without overlaps) by new nonterminals. It ends when no pair occurs MIN_COUNT times, or when the
symbol width has no number left (2^16 symbols, base ids included, where these fit 16 bits).

Payloads travel as rows of a Parquet table: Spark's commit protocol makes a written shard
whole or absent when an executor is lost, on any file system that Spark can write.
"""

from __future__ import annotations

import functools
import json
import struct
import unicodedata
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from papyrion.llm.shared import ensure_checkpoint_dir, partitions, pieces

MAGIC = b"RPS1"
HEADER = struct.Struct("<4sIIIIIQ")
END_ID = 0
#: Ids of a shard before it is closed; a longer document makes a longer shard.
SHARD_IDS = 1 << 20
#: A pair that occurs less often gets no rule; new rules a round (fewer than 2^15).
MIN_COUNT, RULES_A_ROUND = 12, 6000
#: Bytes of known pieces with their ids that a Python worker keeps; of an entry beside its contents.
CACHE_BYTES, ENTRY_BYTES = 24 << 20, 24
#: Bytes of texts that are cut and looked up together; pieces encoded in one call.
TOGETHER, PIECES = 4 << 20, 16384


# ---------------------------------------------------------------- encoding

#: What a tokenizer's file has to say for its texts to be cut into pieces here; others encode whole texts.
_BYTE_LEVEL = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}
_OTHER, _LETTER, _NUMBER, _SPACE, _ODD = range(5)
#: Endings that the byte-level pattern cuts off after an apostrophe.
_ENDINGS = ("s", "t", "re", "ve", "m", "ll", "d")
#: Code points that the table of classes covers; texts with others are encoded whole.
_COVERED = 0x20000


@functools.cache
def _classes() -> np.ndarray:
    """Class of each code point: letter, number, white space, other; odd where versions of Unicode may differ."""
    out = np.full(_COVERED, _OTHER, dtype=np.uint8)
    old = unicodedata.ucd_3_2_0
    for code in range(_COVERED):
        c = chr(code)
        kind = unicodedata.category(c)
        if kind[0] in "LN":
            out[code] = (_LETTER if kind[0] == "L" else _NUMBER) if old.category(c)[0] == kind[0] else _ODD
        elif kind in ("Cn", "Cs"):
            out[code] = _ODD
    out[[0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]] = _SPACE
    out[[0x1C, 0x1D, 0x1E, 0x1F, 0x180E]] = _ODD
    return out


def piece_starts(codes: np.ndarray, text_starts: np.ndarray) -> np.ndarray:
    """Marks the characters that begin a piece of the byte-level pattern.

    ``codes`` are the code points of several texts, one after the other; ``text_starts`` marks
    where each begins. A piece is a run of letters, of numbers or of other characters, with one
    space before it; of a longer run of white space all but the last character is a piece.
    """
    kind = _classes()[codes]
    space, before = kind == _SPACE, np.concatenate(([_OTHER], kind[:-1]))
    text_ends = np.concatenate((text_starts[1:], [True]))
    run = text_starts | (before != kind)
    followed = np.concatenate((~space[1:], [False])) & ~text_ends
    after_blank = np.concatenate(([False], codes[:-1] == 0x20)) & ~text_starts
    starts = np.where(space, run | followed, run & ~after_blank)
    marks = np.flatnonzero((codes == 0x27) & starts)
    if len(marks):  # endings like 's are pieces of their own
        around = np.concatenate((codes, [0, 0]))
        stop = np.concatenate((text_starts, [True, True]))
        one, two = around[marks + 1], around[np.minimum(marks + 2, len(codes) + 1)]
        has_one = ~stop[marks + 1]
        has_two = has_one & ~stop[np.minimum(marks + 2, len(codes) + 1)]
        size = np.zeros(len(marks), dtype=np.int64)
        for ending in _ENDINGS:
            fits = has_one & (one == ord(ending[0])) if len(ending) == 1 else has_two & (one == ord(ending[0])) & (two == ord(ending[1]))
            size[(size == 0) & fits] = len(ending)
        marks, size = marks[size > 0], size[size > 0]
        starts[marks + 1] = False
        after = marks + 1 + size
        inside = after < len(codes)
        starts[after[inside]] |= ~space[after[inside]]
    return starts


class TextEncoder:
    """Ids of whole texts by the tokenizers library, each distinct piece of many texts encoded once.

    A byte-level BPE cuts a text by a fixed pattern before it merges, so a piece has the ids that it
    has in the whole text. Many texts are cut at once, the distinct pieces of all of them are
    looked up or encoded, and the ids are put together again. Texts with special tokens or with
    characters of which versions of Unicode differ are encoded whole, and so are all texts of
    another kind of tokenizer.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer, models, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.base = max(self.tokenizer.get_vocab(with_added_tokens=True).values()) + 1
        self.special = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        # known pieces, their ids one after the other, how many each has and when it was used last
        self.known = pa.array([], pa.large_binary())
        self.ids, self.counts, self.used, self.turn = np.zeros(0, "<u4"), np.zeros(0, np.int64), np.zeros(0, np.int64), 0
        model, cut = self.tokenizer.model, self.tokenizer.pre_tokenizer
        said = json.loads(cut.__getstate__()) if cut is not None else {}
        options = ("dropout", "continuing_subword_prefix", "end_of_word_suffix")
        plain = isinstance(model, models.BPE) and all(getattr(model, o) in (None, "") for o in options)
        self.pieces = None
        if plain and self.tokenizer.normalizer is None and self.tokenizer.truncation is None and _BYTE_LEVEL.items() <= said.items():
            # the letters that stand for bytes: printable ones for themselves, the others from U+0100 on
            own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
            rest = [b for b in range(256) if b not in own]
            self.letters = np.arange(256, dtype="<u4")
            self.letters[rest] = 0x100 + np.arange(len(rest))
            parting = chr(self.letters[0])  # of U+0000, which parts the pieces that are encoded together
            self.mark = self.tokenizer.token_to_id(parting)
            if self.mark is not None and sum(parting in token for token in self.tokenizer.get_vocab()) == 1:
                self.pieces = Tokenizer(model)
                self.pieces.pre_tokenizer = pre_tokenizers.Split(parting, "isolated")

    def _whole(self, text: str) -> np.ndarray:
        return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4")

    def _encode_pieces(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces, one after the other, and how many each has; many pieces go in one call."""
        flat, counts = [], []
        for at in range(0, len(pieces), PIECES):
            part = pieces.slice(at, PIECES)
            joined = b"\0".join(part.to_pylist())
            if joined.count(b"\0") >= len(part):  # U+0000 inside of a piece
                ids = [self._whole(p.decode()) for p in part.to_pylist()]
                flat += ids
                counts.append(np.fromiter(map(len, ids), dtype=np.int64, count=len(ids)))
                continue
            letters = self.letters[np.frombuffer(joined, dtype=np.uint8)].tobytes().decode("utf-32-le")
            ids = np.asarray(self.pieces.encode_batch_fast([letters], add_special_tokens=False)[0].ids, dtype="<u4")
            marks = ids == self.mark
            counts.append(np.diff(np.concatenate(([-1], np.flatnonzero(marks), [len(ids)]))) - 1)
            flat.append(ids[~marks])
        return np.concatenate([*flat, np.zeros(0, "<u4")]), np.concatenate([*counts, np.zeros(0, np.int64)])

    def _look_up(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids one after the other, first, how many): of distinct pieces, known ones or new."""
        self.turn += 1
        at = pc.index_in(pieces, value_set=self.known)
        missing = at.is_null().to_numpy(zero_copy_only=False)
        at = at.fill_null(0).to_numpy().astype(np.int64)
        fresh = pieces.filter(pa.array(missing))
        flat, counts = self._encode_pieces(fresh)
        at[missing] = len(self.known) + np.arange(len(fresh))
        self.known = pa.concat_arrays([self.known, fresh])
        self.ids, self.counts = np.concatenate((self.ids, flat)), np.concatenate((self.counts, counts))
        self.used = np.concatenate((self.used, np.zeros(len(fresh), dtype=np.int64)))
        self.used[at] = self.turn
        ids, first, counts = self.ids, (np.cumsum(self.counts) - self.counts)[at], self.counts[at]
        self._forget()
        return ids, first, counts

    def _forget(self) -> None:
        """Beyond CACHE_BYTES, the pieces used last stay, up to half of it."""
        sizes = pc.binary_length(self.known).to_numpy().astype(np.int64) + 4 * self.counts + ENTRY_BYTES
        if int(sizes.sum()) <= CACHE_BYTES:
            return
        order = np.argsort(-self.used, kind="stable")
        keep = np.sort(order[np.cumsum(sizes[order]) <= CACHE_BYTES // 2])
        counts = self.counts[keep]
        first, ends = (np.cumsum(self.counts) - self.counts)[keep], np.cumsum(counts)
        self.ids = self.ids[np.repeat(first - (ends - counts), counts) + np.arange(int(counts.sum()))]
        self.known, self.counts, self.used = self.known.take(pa.array(keep)), counts, self.used[keep]

    def _together(self, raw: list[bytes]) -> list[np.ndarray]:
        """Ids of UTF-8 texts that have none of what is encoded whole."""
        data = b"".join(raw)
        sizes = np.fromiter(map(len, raw), dtype=np.int64, count=len(raw))
        begins = np.cumsum(sizes) - sizes
        codes = np.frombuffer(data.decode().encode("utf-32-le"), dtype="<u4")
        octets = np.frombuffer(data, dtype=np.uint8)
        chars = np.flatnonzero((octets & 0xC0) != 0x80) if len(codes) < len(octets) else None
        text_starts = np.zeros(len(codes), dtype=bool)
        filled = begins[sizes > 0]
        text_starts[filled if chars is None else np.searchsorted(chars, filled)] = True
        at = np.flatnonzero(piece_starts(codes, text_starts))
        del codes, text_starts
        at = at if chars is None else chars[at]
        offsets = pa.py_buffer(np.append(at, len(octets)))
        coded = pa.Array.from_buffers(pa.large_binary(), len(at), [None, offsets, pa.py_buffer(data)]).dictionary_encode()
        ids, first, counts = self._look_up(coded.dictionary)
        which = coded.indices.to_numpy()
        counts = counts[which]
        ends = np.cumsum(counts)
        flat = ids[np.repeat(first[which] - (ends - counts), counts) + np.arange(int(ends[-1]) if len(ends) else 0)]
        # ids before each text: those of the pieces that begin before it
        before = np.concatenate(([0], ends))[np.searchsorted(at, begins)]
        return np.split(flat, before[1:])

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text, little-endian uint32; texts are cut and looked up together up to TOGETHER bytes."""
        out: list[np.ndarray | None] = [None] * len(texts)
        held: list[int] = []
        raw: list[bytes] = []
        size = 0

        def flush() -> None:
            nonlocal held, raw, size
            if raw:
                for k, ids in zip(held, self._together(raw), strict=True):
                    out[k] = ids
            held, raw, size = [], [], 0

        for k, text in enumerate(texts):
            data = text.encode()
            if self.pieces is None or any(s in data for s in self.special) or _odd(text):
                out[k] = self._whole(text)
                continue
            held.append(k)
            raw.append(data)
            size += len(data)
            if size >= TOGETHER:
                flush()
        flush()
        return out  # type: ignore[return-value]


def _odd(text: str) -> bool:
    """Whether versions of Unicode may differ on a character of the text."""
    if text.isascii():
        return any(c in text for c in "\x1c\x1d\x1e\x1f")
    codes = np.frombuffer(text.encode("utf-32-le"), dtype="<u4")
    return bool((codes >= _COVERED).any() or (_classes()[codes] == _ODD).any())


@functools.lru_cache(maxsize=1)
def encoder(path: str) -> TextEncoder:
    """A worker keeps one tokenizer, with CACHE_BYTES of known pieces at most."""
    return TextEncoder(path)


# ---------------------------------------------------------------- grammar


def _pairs(seq: np.ndarray, width: int) -> np.ndarray:
    """A key for each pair of neighbours."""
    if width == 4:
        return seq[:-1].astype(np.uint64) << np.uint64(32) | seq[1:]
    return seq[:-1] << np.uint32(16) | seq[1:]


def _frequent(seq: np.ndarray, keys: np.ndarray, room: int, floor: int) -> np.ndarray:
    """Keys of the pairs to replace next, the most frequent first."""
    inner = seq != END_ID
    keys = np.sort(keys[inner[:-1] & inner[1:]])
    if not len(keys):
        return keys
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    counts = np.diff(np.append(first, len(keys)))
    good = counts >= floor
    counts, found = counts[good], keys[first[good]]
    order = np.lexsort((found, -counts))[: min(room, RULES_A_ROUND)]
    return found[order]


def _slots(keys: np.ndarray) -> np.ndarray:
    """A number below 2^20 for each key."""
    kind = keys.dtype.type
    return ((keys * kind(2654435761)) >> kind(8)) & kind((1 << 20) - 1)


def _settled(at: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which of the pairs found at ascending positions are replaced: of overlapping ones the most frequent."""
    near = np.diff(at) == 1
    begins = np.concatenate(([True], ~(near & (rank[1:] == rank[:-1]))))  # of one pair, every second counts
    odd = (np.arange(len(at)) - np.flatnonzero(begins)[np.cumsum(begins) - 1]) % 2 == 1
    at, rank = at[~odd], rank[~odd]
    done = [(at[:0], rank[:0])]
    while len(at):
        near, none = np.diff(at) == 1, np.array([False])
        before, after = np.concatenate((none, near)), np.concatenate((near, none))
        alone = ~before & ~after
        best = (~before | (rank < np.roll(rank, 1))) & (~after | (rank < np.roll(rank, -1)))
        lost = (before & np.roll(best, 1)) | (after & np.roll(best, -1))
        done.append((at[alone], rank[alone]))
        at, rank = at[~alone & ~lost], rank[~alone & ~lost]
    return tuple(np.concatenate(x) for x in zip(*done, strict=True))  # type: ignore[return-value]


def _replace(seq: np.ndarray, keys: np.ndarray, chosen: np.ndarray, base: int) -> tuple[np.ndarray, np.ndarray]:
    """The sequence with the chosen pairs (most frequent first) replaced, and those that were, in the order of their symbols."""
    table, slots = np.full(1 << 20, -1, dtype=np.int16), _slots(chosen)
    table[slots[::-1]] = np.arange(len(chosen) - 1, -1, -1)  # of two pairs in one slot the rarer waits for the next round
    chosen = chosen[table[slots] == np.arange(len(chosen))]
    table[_slots(chosen)] = np.arange(len(chosen))
    rank = table[_slots(keys)]
    at = np.flatnonzero(rank >= 0)
    rank = rank[at]
    hit = chosen[rank] == keys[at]
    at, rank = _settled(at[hit], rank[hit])
    seq = seq.copy()
    seq[at] = base + rank.astype(np.uint32)
    keep = np.ones(len(seq), dtype=bool)
    keep[at + 1] = False
    return seq[keep], chosen


def compress(ids: np.ndarray, base: int) -> tuple[np.ndarray, np.ndarray]:
    """Re-Pair: (symbols, rules); rule r stands for its two symbols and is written base + r."""
    seq, rules = ids.astype(np.uint32), np.zeros((0, 2), dtype=np.uint32)
    width = 2 if base < 1 << 16 else 4
    limit = (1 << 16 if width == 2 else 1 << 31) - base
    while len(seq) >= 2 and len(rules) < limit:
        keys = _pairs(seq, width)
        chosen = _frequent(seq, keys, limit - len(rules), MIN_COUNT)
        if not len(chosen):
            break
        seq, chosen = _replace(seq, keys, chosen, base + len(rules))
        shift = chosen.dtype.type(32 if width == 4 else 16)
        rules = np.concatenate((rules, np.stack((chosen >> shift, chosen & chosen.dtype.type((1 << int(shift)) - 1)), axis=1).astype(np.uint32)))
    return seq, rules


def _expansions(rules: np.ndarray, base: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids, lengths) of all rules, one after the other."""
    seq, owner = base + np.arange(len(rules), dtype=np.int64), np.arange(len(rules))
    while len(seq) and (deep := seq >= base).any():
        sizes = 1 + deep
        starts = np.cumsum(sizes) - sizes
        out = np.empty(int(sizes.sum()), dtype=np.int64)
        out[starts[~deep]] = seq[~deep]
        out[starts[deep]], out[starts[deep] + 1] = rules[seq[deep] - base, 0], rules[seq[deep] - base, 1]
        seq, owner = out, np.repeat(owner, sizes)
    return seq.astype(np.uint32), np.bincount(owner, minlength=len(rules)).astype(np.uint32)


def expand(seq: np.ndarray, rules: np.ndarray, base: int) -> np.ndarray:
    """Ids that a sequence of symbols stands for."""
    if not (seq >= base).any():
        return seq.astype(np.uint32)
    bodies, sizes = _expansions(rules, base)
    # every symbol is a stretch of one table: a plain id of itself, a nonterminal of its body
    table = np.concatenate((np.arange(base, dtype=np.uint32), bodies))
    size = np.concatenate((np.ones(base, dtype=np.int32), sizes.astype(np.int32)))
    begin = np.concatenate((np.arange(base, dtype=np.int64), base + np.cumsum(sizes, dtype=np.int64) - sizes))
    lengths = size[seq]
    ends = np.cumsum(lengths, dtype=np.int64)
    return table[np.repeat(begin[seq] - (ends - lengths), lengths) + np.arange(int(ends[-1]))]


def pack(doc_ids: list[int | None], parts: list[bytes], base: int) -> bytes:
    """A shard of documents: their ids (uint32, the end id included) as bytes."""
    lengths = np.array([len(p) // 4 for p in parts], dtype="<u4")
    ids = np.frombuffer(b"".join(parts), dtype="<u4")
    seq, rules = compress(ids, base)
    width = 2 if base + len(rules) <= 1 << 16 else 4
    _, sizes = _expansions(rules, base)
    ends = np.flatnonzero(seq == END_ID)
    # an END_ID inside a text is a symbol of its own as well, so borders are counted in ids
    spans = np.ones(len(seq), dtype=np.int64)
    spans[seq >= base] = sizes[seq[seq >= base].astype(np.int64) - base]
    starts = np.cumsum(spans) - spans
    first = np.searchsorted(starts, np.cumsum(lengths, dtype=np.int64) - lengths)
    assert len(ends) >= len(lengths)
    kind = f"<u{width}"
    return b"".join((
        HEADER.pack(MAGIC, width, base, len(parts), len(rules), len(seq), len(ids)),
        np.array([d or 0 for d in doc_ids], dtype="<i8").tobytes(),
        np.array([d is not None for d in doc_ids], dtype="u1").tobytes(),
        lengths.tobytes(),
        first.astype("<u4").tobytes(),
        rules.astype(kind).tobytes(),
        sizes.astype("<u4").tobytes(),
        seq.astype(kind).tobytes(),
    ))


class Shard:
    """A payload, opened."""

    def __init__(self, payload: bytes):
        magic, width, self.base, docs, rules, symbols, self.n_ids = HEADER.unpack_from(payload)
        if magic != MAGIC:
            raise ValueError("not a shard of token ids")
        at, kind = HEADER.size, f"<u{width}"

        def take(dtype: str, n: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(payload, dtype=dtype, count=n, offset=at)
            at += out.nbytes
            return out

        ids, known = take("<i8", docs), take("u1", docs)
        self.doc_ids = [int(d) if k else None for d, k in zip(ids.tolist(), known.tolist(), strict=True)]
        self.lengths, self.first = take("<u4", docs), take("<u4", docs)
        self.rules = take(kind, 2 * rules).reshape(-1, 2).astype(np.uint32)
        self.sizes = take("<u4", rules)
        self.symbols = take(kind, symbols).astype(np.uint32)

    def decode(self) -> np.ndarray:
        ids = expand(self.symbols, self.rules, self.base)
        if len(ids) != self.n_ids:
            raise ValueError("a shard does not expand to its ids")
        return ids

    def decode_document(self, k: int) -> np.ndarray:
        """Ids of the k-th document; only its own symbols are expanded."""
        end = int(self.first[k + 1]) if k + 1 < len(self.first) else len(self.symbols)
        return expand(self.symbols[int(self.first[k]) : end], self.rules, self.base)


# ---------------------------------------------------------------- Spark


def _write_shards(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part, number = encoder(path), TaskContext.get().partitionId(), 0
        docs: list[int | None] = []
        parts: list[bytes] = []
        held = before = 0

        def close() -> pa.RecordBatch:
            nonlocal number, held, before, docs, parts
            payload = pack(docs, parts, enc.base)
            row = pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "number": pa.array([number], pa.int32()), "before": pa.array([before], pa.int64()), "n_ids": pa.array([held], pa.int64()), "payload": pa.array([payload], pa.binary())})
            number, before, held, docs, parts = number + 1, before + held, 0, [], []
            return row

        end = struct.pack("<I", END_ID)
        for some in pieces(batches, TOGETHER):
            texts = [t or "" for t in some.column(1).to_pylist()]
            for doc, ids in zip(some.column(0).to_pylist(), enc.encode(texts), strict=True):
                docs.append(doc)
                parts.append(ids.tobytes() + end)
                held += len(ids) + 1
                if held >= SHARD_IDS:
                    yield close()
        if docs:
            yield close()
        pa.default_memory_pool().release_unused()

    return run


def _read_shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in range(batch.num_rows):
            shard = Shard(batch.column("payload")[row].as_py())
            ids = np.ascontiguousarray(shard.decode().astype("<u4"))
            ends = np.cumsum(shard.lengths, dtype=np.int64)
            starts = ends - shard.lengths
            view = memoryview(ids).cast("B")
            crc = [zlib.crc32(view[4 * a : 4 * b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
            base = batch.column("base")[row].as_py()
            yield pa.RecordBatch.from_pydict({"doc_id": pa.array(shard.doc_ids, pa.int64()), "start": pa.array(starts + base, pa.int64()), "n_tokens": pa.array(shard.lengths.astype(np.int64), pa.int64()), "ids_crc32": pa.array(crc, pa.int64())})


def write_token_shards(docs: DataFrame, tokenizer_path: str, target: str | None = None) -> str:
    """Encode ``docs`` (doc_id, text) and write the shards; returns the table's path.

    Null texts count as empty (the end id alone); null doc_ids come first; rows of one doc_id are
    in order of their texts' hashes, repeated rows are written each; other columns, of any name, are not
    read. A very long text makes a long shard. An empty table gives an empty shard table. The table
    stays until the caller removes it.
    """
    spark = docs.sparkSession
    target = target or f"{ensure_checkpoint_dir(spark).rstrip('/')}/token-shards-{uuid.uuid4().hex}"
    ordered = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.xxhash64("text").alias("hash"), F.monotonically_increasing_id().alias("row"))
    # range partitioning keeps the global order; hash and row spread the rows of an id that repeats, null included
    order = [F.col("doc_id").asc_nulls_first(), F.col("hash"), F.col("row")]
    ordered = ordered.repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order).select("doc_id", "text")
    ordered.mapInArrow(_write_shards(tokenizer_path), "part int, number int, before long, n_ids long, payload binary").write.mode("overwrite").parquet(target)
    return target


def read_token_shards(spark: SparkSession, path: str) -> DataFrame:
    """One row per document, from the shards: doc_id, start, n_tokens, ids_crc32."""
    shards = spark.read.parquet(path)
    sums = shards.groupBy("part").agg(F.sum("n_ids").alias("n"))
    ahead = F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    sums = sums.select("part", F.coalesce(ahead, F.lit(0)).alias("ahead"))
    # one row for each partition that wrote; payloads stay where they are
    joined = shards.join(F.broadcast(sums), "part").select((F.col("ahead") + F.col("before")).alias("base"), "payload")
    return joined.mapInArrow(_read_shards, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_output(docs: DataFrame, tokenizer_path: str, target: str | None = None) -> DataFrame:
    """Write the shards of ``docs`` and read them back as one row per document."""
    return read_token_shards(docs.sparkSession, write_token_shards(docs, tokenizer_path, target))
