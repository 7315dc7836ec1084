"""SimHash near-duplicates by a hierarchical index in Gray order.

Fingerprints that differ in at most two bits are linked. The index has these levels:

1. *Top nodes* share a masked bit pattern. The three masks cut the 64 bits into blocks, so two
   fingerprints within distance two agree on at least one whole block and meet below a top
   node. A top node with many fingerprints gives way to nodes that fix a block of the remaining
   bits as well, by the same argument, until none has many (after a few levels too few bits are
   left); so hot nodes are spread over tasks and no pair is lost.
2. *Inner nodes*: below a top node, fingerprints stand in Gray order (neighbours share most
   bits). Runs of neighbours are factored into nodes that hold the mask of the bits on which
   all below agree, and their pattern; runs of such nodes again, up to one node.
3. *Leaves* are the fingerprints.

The search joins the index with itself, level by level: a pair of nodes carries the
differences accumulated over bits that both fix, each level adds those of newly fixed bits,
and a pair above two is dropped with all that is below it.

Exact copies share a fingerprint and stand in the index once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from papyrion.llm.components import components, mix64
from papyrion.llm.shared import partitions, settle

SEED = 42
SHINGLE = 3
DISTANCE = 2
#: Fingerprints below a top node before a block of its remaining bits is fixed too; with FEW bits open it can't have more.
HOT_NODE, FEW = 2048, 11
LEAF, FAN = 8, 8
#: Node pairs expanded, shingles hashed and fingerprints indexed at once.
FRONTIER, CHUNK, INDEXED = 1 << 19, 1 << 16, 1 << 18


# ---------------------------------------------------------------- fingerprints


def fingerprint(text: bytes, size: int = SHINGLE) -> int:
    """64-bit SimHash of a UTF-8 text: ASCII lower case, words between ASCII white space, XXH64 of word shingles."""
    words = text.lower().split()
    if not words:
        return 0
    if len(words) <= size:
        shingles: Iterator[bytes] = iter((b" ".join(words),))
        n = 1
    else:
        shingles = map(b" ".join, zip(*(words[i:] for i in range(size))))
        n = len(words) - size + 1
    hashed, seen = xxhash.xxh64_intdigest, np.zeros(64, dtype=np.int64)
    for at in range(0, n, CHUNK):
        part = min(CHUNK, n - at)
        h = np.fromiter((hashed(next(shingles), SEED) for _ in range(part)), dtype="<u8", count=part)
        bits = np.unpackbits(h.view(np.uint8).reshape(part, 8), axis=1, bitorder="little")
        seen += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * seen > n, bitorder="little").view("<u8")[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        raw = batch.column(1).cast(pa.binary())
        out = np.fromiter((fingerprint(raw[k].as_py() or b"") for k in range(batch.num_rows)), dtype=np.uint64, count=batch.num_rows)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out.view(np.int64))], names=["doc_id", "fp"])


def _named_fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        of = next(_fingerprints(iter([batch.select(["doc_id", "text"])])))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *of.columns], names=["h1", "h2", "doc_id", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp long): the fingerprint's bits as a signed long. A null text counts as empty."""
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_fingerprints, "doc_id long, fp long")


# ---------------------------------------------------------------- index


def _levels(fp: np.ndarray, group: np.ndarray) -> list[dict[str, np.ndarray]]:
    """Levels of the index from the leaves up; group: number of each fingerprint's top node, ascending."""
    ones = np.full(len(fp), np.uint64(0xFFFFFFFFFFFFFFFF))
    level = {"all": fp, "any": fp, "mask": ones, "group": group}
    levels, fan = [level], LEAF
    while True:
        g = level["group"]
        begins = np.flatnonzero(np.concatenate(([True], g[1:] != g[:-1])))
        if len(begins) == len(g):
            return levels
        within = np.arange(len(g)) - np.repeat(begins, np.diff(np.append(begins, len(g))))
        first = np.flatnonzero(within % fan == 0)
        both, some = np.bitwise_and.reduceat(level["all"], first), np.bitwise_or.reduceat(level["any"], first)
        level = {"all": both, "any": some, "mask": ~(both ^ some), "group": g[first], "first": first, "size": np.diff(np.append(first, len(g)))}
        levels.append(level)
        fan = FAN


def _children(i: np.ndarray, j: np.ndarray, level: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of children of node pairs, each unordered pair once; index of the parents' pair."""
    ni, nj = level["size"][i], level["size"][j]
    n = ni * nj
    parent = np.repeat(np.arange(len(i)), n)
    k = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    a, b = level["first"][i[parent]] + k // nj[parent], level["first"][j[parent]] + k % nj[parent]
    keep = (i != j)[parent] | (a <= b)
    return a[keep], b[keep], parent[keep]


class _Forest:
    """Union of local links: labels[k] is the smallest position known to be linked to k."""

    def __init__(self, n: int):
        self.labels = np.arange(n)

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        labels = self.labels
        while True:
            la, lb = labels[a], labels[b]
            if not (apart := la != lb).any():
                return
            a, b, la, lb = a[apart], b[apart], la[apart], lb[apart]
            np.minimum.at(labels, np.maximum(la, lb), np.minimum(la, lb))
            while True:
                up = labels[labels]
                if (up == labels).all():
                    break
                labels[:] = up


def search(fp: np.ndarray, group: np.ndarray, distance: int = DISTANCE) -> np.ndarray:
    """For each fingerprint the position of the first one that links reach within its top node."""
    forest, levels = _Forest(len(fp)), _levels(fp, group)
    top = len(levels) - 1
    roots = np.arange(len(levels[top]["group"]))
    stack = [(top, roots[at : at + FRONTIER], roots[at : at + FRONTIER], np.zeros(len(roots[at : at + FRONTIER]), dtype=np.uint8), np.zeros(len(roots[at : at + FRONTIER]), dtype=np.uint64)) for at in range(0, len(roots), FRONTIER)]
    while stack:
        depth, i, j, found, fixed = stack.pop()
        level = levels[depth]
        joint = level["mask"][i] & level["mask"][j]
        # bits that both nodes fix and their parents did not both fix; those were counted above
        found = found + np.bitwise_count((level["all"][i] ^ level["all"][j]) & joint & ~fixed).astype(np.uint8)
        near = found <= distance
        i, j, found, joint = i[near], j[near], found[near], joint[near]
        if depth == 0:
            other = i != j
            forest.link(i[other], j[other])
            continue
        cost = np.cumsum(level["size"][i] * level["size"][j])
        cuts = np.searchsorted(cost, np.arange(FRONTIER, int(cost[-1]) if len(cost) else 0, FRONTIER))
        for part in np.split(np.arange(len(i)), cuts):
            if len(part):
                a, b, parent = _children(i[part], j[part], level)
                stack.append((depth - 1, a, b, found[part][parent], joint[part][parent]))
    return forest.labels


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (mask, pattern, fp) in order of top node and Gray rank -> links (a, b)."""

    def linked(keys: list[np.ndarray], fp: np.ndarray) -> Iterator[pa.RecordBatch]:
        change = np.zeros(len(fp), dtype=bool)
        for k in keys:
            change[1:] |= k[1:] != k[:-1]
        group = np.cumsum(change)
        several = np.bincount(group)[group] > 1
        group, fp = group[several], fp[several]
        if len(fp):
            labels = search(fp, group)
            moved = np.flatnonzero(labels != np.arange(len(fp)))
            mixed = mix64(fp).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(mixed[moved]), pa.array(mixed[labels[moved]])], names=["a", "b"])

    held: list[list[np.ndarray]] = []
    rows = 0
    for batch in batches:
        held.append([c.to_numpy(zero_copy_only=False) for c in batch.columns])
        rows += batch.num_rows
        if rows < INDEXED:
            continue
        columns = [np.concatenate(c) for c in zip(*held, strict=True)]
        last = np.ones(rows, dtype=bool)  # the last top node may go on in the next batch
        for k in columns[:2]:
            last &= k == k[-1]
        cut = int(np.argmax(last))
        if cut:
            yield from linked([c[:cut] for c in columns[:2]], columns[2][:cut].view(np.uint64))
        held, rows = [[c[cut:] for c in columns]], rows - cut
    if rows:
        columns = [np.concatenate(c) for c in zip(*held, strict=True)]
        yield from linked(columns[:2], columns[2].view(np.uint64))


def _deeper(mask: int) -> list[int]:
    """Masks that fix a block of the open bits of ``mask`` as well: one of the three is equal for fingerprints that differ in two bits."""
    rest = [bit for bit in range(64) if not mask >> bit & 1]
    cuts = [k * len(rest) // (DISTANCE + 1) for k in range(DISTANCE + 2)]
    return [mask | sum(1 << bit for bit in rest[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


def _long(mask: int):
    return F.lit(mask - (1 << 64) if mask >> 63 else mask).cast("long")


def _gray_rank(fp):
    for shift in (1, 2, 4, 8, 16, 32):
        fp = fp.bitwiseXOR(F.shiftrightunsigned(fp, shift))
    return fp


def links(distinct: DataFrame) -> DataFrame:
    """Links between distinct fingerprints (fp long): (a, b), mixed names of ``mix64``, a forest for each top node."""
    spark = distinct.sparkSession
    fp, node = F.col("fp"), ["mask", "pattern"]
    masks = _deeper(0)
    below = lambda rows, choice: rows.select("fp", F.explode(choice).alias("mask")).withColumn("pattern", fp.bitwiseAND(F.col("mask")))
    nodes, small = below(distinct, F.array(*map(_long, masks))), None
    while True:
        hot = settle(nodes.groupBy(*node).count().where((F.col("count") > HOT_NODE) & (F.bit_count("mask") < 64 - FEW)).select(*node))
        if hot.isEmpty():
            break
        cold = nodes.join(hot, node, "left_anti")
        small = cold if small is None else small.unionByName(cold)
        choice = F.coalesce(*(F.when(F.col("mask") == _long(m), F.array(*map(_long, _deeper(m)))) for m in masks))
        nodes = settle(below(nodes.join(hot, node, "left_semi"), choice).distinct())  # two ways may lead to one node
        masks = sorted({deep for m in masks for deep in _deeper(m)})
    nodes = nodes if small is None else small.unionByName(nodes)
    dealt = nodes.repartition(partitions(spark), *node)
    ordered = dealt.withColumn("gray", _gray_rank(fp)).withColumn("gray", F.col("gray").bitwiseXOR(F.lit(-(1 << 63)).cast("long")))
    return ordered.sortWithinPartitions(*node, "gray").select(*node, "fp").mapInArrow(_links, "a long, b long")


def _mixed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        v = mix64(batch.column(0).to_numpy().view(np.uint64)).view(np.int64)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(v)], names=[*batch.schema.names, "v"])


def _classes(prints: DataFrame) -> DataFrame:
    """(fp, root, component_id): the component of each fingerprint and its smallest doc_id."""
    distinct = settle(prints.groupBy("fp").agg(F.min("doc_id").alias("first")).mapInArrow(_mixed, "fp long, first long, v long"))
    roots = components(links(distinct))
    named = distinct.join(roots, "v", "left").select("fp", "first", F.coalesce("root", "v").alias("root"))
    smallest = named.groupBy("root").agg(F.min("first").alias("component_id"))
    return named.join(smallest, "root").select("fp", "root", "component_id")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id (smallest doc_id that links reach).

    ``docs`` needs doc_id and text; other columns are not read. Null texts count as empty and
    documents without words have fingerprint zero, linked like any other. Repeated rows come
    out each. A null doc_id is kept and never is a component_id unless a component has no other.
    Very long texts are hashed in stretches. An empty table gives an empty result.
    """
    prints = settle(fingerprints(docs))
    classes = _classes(prints).drop("root")
    return prints.join(classes, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_first(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` without near-duplicates: of each component the row with the smallest doc_id stays.

    A row is named by two hashes of all its columns, so rows that share a doc_id, and those with a
    null one, are judged each by their own text. Null doc_ids come after all others; of several rows
    with the smallest doc_id that with the smallest hash stays, of equal rows one. Null and empty texts
    are near-duplicates of each other. Columns of any name pass; an empty table gives an empty one.
    """
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    named = docs.select(F.xxhash64(row).alias("h1"), F.xxhash64(F.lit(1), row).alias("h2"), row.alias("doc"))
    prints = settle(named.select("h1", "h2", F.col("doc.doc_id").cast("long").alias("doc_id"), F.col("doc.text").cast("string").alias("text")).mapInArrow(_named_fingerprints, "h1 long, h2 long, doc_id long, fp long"))
    classes = _classes(prints.select("doc_id", "fp")).select("fp", "root")
    rank = F.struct(F.col("doc_id").isNull(), "doc_id", "h1", "h2")
    first = prints.join(classes, "fp").groupBy("root").agg(F.min(rank).alias("first")).select("first.h1", "first.h2")
    several = prints.groupBy("h1", "h2").count().where("count > 1").select("h1", "h2", F.lit(True).alias("several"))
    first = settle(first.join(several, ["h1", "h2"], "left"))
    key = ["h1", "h2"]
    kept = named.join(first.where("several is null").select(*key), key, "left_semi")
    repeated = first.where("several").select(*key)
    if not repeated.isEmpty():
        kept = kept.unionByName(named.join(repeated, key, "left_semi").groupBy(*key).agg(F.first("doc").alias("doc")))
    return kept.select("doc.*")
