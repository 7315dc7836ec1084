"""Exact top-k search by inner product: columnar branch and bound.

Vectors are whole numbers, floor(64 x) for each component. Candidates stand in blocks in
vertical layout: one row for each dimension. For a block of queries the products are summed
dimension block by dimension block, those with the most mass first. After each, a candidate's
score can be no more than what it has plus what the rest of its mass allows (by Cauchy-Schwarz,
the norms of both rests); candidates that cannot reach any query's k-th best known score are
dropped and the survivors are compacted before the next dimensions. Scores are exact integers;
bounds are rounded outwards.

Queries and candidates are dealt over a grid of blocks: a cell holds one block of each, so no task
grows with the data. Candidates are blocked by falling norm, ties by row, so a vector that repeats
has no block for itself. All queries meet the first block, that with the largest norms, before the
others; the k-th best score found there bounds each query from below. A query goes on only to the
blocks whose largest norm times its own can reach that bound, and a block only to the queries'
blocks that ask for it; the bound also prunes inside the cells.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from papyrion.llm.shared import settle

SCALE = 64
#: Vectors in a block: of candidates (about) and of queries (about); dimensions summed at once.
CANDIDATES, QUERIES, DIMENSIONS = 8192, 2048, 16
#: Queries whose bounds are kept side by side.
TILE = 128


def _matrix(vectors: pd.Series) -> np.ndarray:
    """Rows of equal width; shorter vectors end in zeros."""
    rows = vectors.to_list()
    width = max((len(r) for r in rows), default=0)
    if all(len(r) == width for r in rows):
        return np.stack(rows).astype(np.int64) if rows else np.zeros((0, 0), dtype=np.int64)
    out = np.zeros((len(rows), width), dtype=np.int64)
    for k, r in enumerate(rows):
        out[k, : len(r)] = r
    return out


def best_of_block(queries: np.ndarray, query_rows: np.ndarray, cands: np.ndarray, cand_ids: np.ndarray, cand_rows: np.ndarray, k: int, bounds: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, candidate id, score): for each query its k best candidates of the block, but for its own row.

    ``bounds``: scores that a query's k-th best is known to reach; candidates below may be left out.
    """
    width = max(queries.shape[1], cands.shape[1])
    queries, cands = (np.pad(m, ((0, 0), (0, width - m.shape[1]))) for m in (queries, cands))
    largest = float(np.abs(queries).max(initial=0)) * float(np.abs(cands).max(initial=0)) * max(width, 1)
    kind = np.float64 if largest < 2**52 else np.int64  # sums of whole numbers are exact in doubles below 2^53
    order = np.lexsort((cand_rows, cand_ids))  # ties go to the smaller id
    cands, cand_ids, cand_rows = cands[order], cand_ids[order], cand_rows[order]
    bounds = np.full(len(queries), -np.inf) if bounds is None else bounds
    dims = np.argsort(-(np.abs(cands).sum(axis=0, dtype=np.float64) * np.abs(queries).sum(axis=0, dtype=np.float64)), kind="stable")
    columns = np.ascontiguousarray(cands[:, dims].T.astype(kind))  # vertical layout: a row for each dimension
    wanted = np.ascontiguousarray(queries[:, dims].astype(kind))
    cuts = [*range(0, width, DIMENSIONS), width] if width else [0, 0]

    def rest(m: np.ndarray, axis: int) -> list[np.ndarray]:
        """Norms of what follows each cut."""
        squares = np.square(m.astype(np.float64))
        return [np.sqrt((squares[c:] if axis == 0 else squares[:, c:]).sum(axis=axis)) for c in cuts]

    rest_c, rest_q = rest(columns, 0), rest(wanted, 1)
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for at in range(0, len(wanted), TILE):
        q, alive = wanted[at : at + TILE], np.arange(len(cand_ids))
        rows, block = query_rows[at : at + TILE], columns
        sums = np.zeros((len(q), len(alive)), dtype=kind)
        for n, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False), 1):
            sums += q[:, a:b] @ block[a:b]
            if b == width or not len(alive):
                continue
            slack = rest_q[n][at : at + TILE, None] * rest_c[n][alive][None, :] * (1 + 1e-9) + 1e-6
            known = bounds[at : at + TILE]
            if len(alive) > k:  # k-th best lower bound of each query; its own row takes no part
                low = np.where(cand_rows[alive][None, :] == rows[:, None], -np.inf, sums - slack)
                known = np.maximum(known, np.partition(low, len(alive) - k, axis=1)[:, len(alive) - k])
            keep = ((sums + slack) >= known[:, None]).any(axis=0)
            if keep.sum() < 0.8 * len(alive):
                alive, block, sums = alive[keep], np.ascontiguousarray(block[:, keep]), np.ascontiguousarray(sums[:, keep])
        names, own = cand_ids[alive], cand_rows[alive][None, :] == rows[:, None]
        for row in range(len(q)):
            scores, other = sums[row], names
            if own[row].any():
                scores, other = scores[~own[row]], names[~own[row]]
            if bounds[at + row] > -np.inf:  # what stays below is not among the best of all
                pick = np.flatnonzero(scores >= bounds[at + row])
                scores, other = scores[pick], other[pick]
            if len(scores) > k:
                least = np.partition(scores, len(scores) - k)[len(scores) - k]
                pick = np.flatnonzero(scores >= least)
                scores, other = scores[pick], other[pick]
            top = np.lexsort((other, -scores))[:k]
            found.append((np.full(len(top), rows[row]), other[top], scores[top].astype(np.int64)))
    if not found:
        return (np.zeros(0, dtype=np.int64),) * 3
    return tuple(np.concatenate(c) for c in zip(*found, strict=True))  # type: ignore[return-value]


def _cell(k: int):
    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"query": [], "vec_id": [], "score": []}).astype("int64")
        bounds = left["bound"].fillna(-np.inf).to_numpy(dtype=np.float64)
        q, v, s = best_of_block(_matrix(left["v"]), left["row"].to_numpy(), _matrix(right["c_v"]), right["c_id"].to_numpy(), right["c_row"].to_numpy(), k, bounds)
        return pd.DataFrame({"query": q, "vec_id": v, "score": s})

    return run


def quantised(vectors: DataFrame) -> DataFrame:
    """(id long, v array<long>) of the vectors that take part."""
    x = F.col("embedding").cast("array<double>")
    odd = F.exists(x, lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == F.lit(float("inf"))))
    rows = vectors.where(F.col("embedding").isNotNull() & F.col("vec_id").isNotNull()).where(~F.coalesce(odd, F.lit(False)))
    return rows.select(F.col("vec_id").cast("long").alias("id"), F.transform(x, lambda e: F.floor(e * SCALE)).alias("v"))


def top_k(vectors: DataFrame, k: int = 20, every: int = 20) -> DataFrame:
    """The k highest inner products of each query: query_id, rank (from 1), vec_id, score.

    ``vectors`` needs vec_id and embedding; other columns are not read. Queries are the rows whose
    vec_id ``every`` divides, each row one, also where ids repeat; candidates are all rows but the
    query's own; ties go to the smaller vec_id, candidates with one id stand side by side. Vectors
    that are null, have a null id or a component that is null or not finite take no part; shorter
    vectors count as ending in zeros, so empty ones score 0. Scores have to fit 64 bits. An empty
    table gives an empty result.
    """
    rows = quantised(vectors).withColumn("row", F.monotonically_increasing_id())
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    n = rows.count()
    blocks, query_blocks = max(1, -(-n // CANDIDATES)), max(1, -(-n // every // QUERIES))
    rows = rows.withColumn("norm", norm).repartitionByRange(blocks, F.col("norm").desc(), "row")
    rows = settle(rows.withColumn("cb", F.spark_partition_id()))
    spread = F.pmod(F.xxhash64("row"), F.lit(query_blocks)).cast("int")
    queries = rows.where(F.col("id") % every == 0).withColumn("qb", spread)
    columns, result = ["row", "v", "bound", "qb", "cb"], "query long, vec_id long, score long"

    def cells(asked: DataFrame, cands: DataFrame) -> DataFrame:
        other = cands.select(*(F.col(c).alias(f"c_{c}") for c in ("id", "row", "v", "qb", "cb")))  # names of their own: both come from one table
        return asked.select(*columns).groupBy("qb", "cb").cogroup(other.groupBy("c_qb", "c_cb")).applyInPandas(_cell(k), result)

    begin = rows.agg(F.min("cb")).first()[0] or 0  # the first block that holds rows
    everywhere = F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1)))
    seeds = queries.withColumn("bound", F.lit(None).cast("double")).withColumn("cb", F.lit(begin))
    best = settle(cells(seeds, rows.where(F.col("cb") == begin).withColumn("qb", everywhere)))
    if blocks > 1:
        bounds = best.groupBy("query").agg(F.count("*").alias("n"), F.min("score").cast("double").alias("bound")).where(F.col("n") >= k).select(F.col("query").alias("row"), "bound")
        tops = rows.where(F.col("cb") > begin).groupBy("cb").agg(F.max("norm").alias("top"))
        tops = tops.agg(F.sort_array(F.collect_list(F.struct("cb", "top"))).alias("tops"))  # one number for each block
        asked = queries.drop("cb").join(bounds, "row", "left").join(F.broadcast(tops), F.lit(True))
        reach = F.filter("tops", lambda t: F.col("bound").isNull() | (t["top"] * F.col("norm") * (1 + 1e-9) + 1e-6 >= F.col("bound")))
        asked = settle(asked.select("row", "v", "bound", "qb", F.explode(F.transform(reach, lambda t: t["cb"])).alias("cb")))
        wanted = asked.groupBy(F.col("qb"), F.col("cb").alias("block")).agg(F.lit(1)).select("qb", "block")  # as many rows as cells
        best = best.unionByName(cells(asked, rows.join(wanted, F.col("cb") == F.col("block"))))
    order = Window.partitionBy("query").orderBy(F.col("score").desc(), "vec_id")
    ranked = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    names = queries.select(F.col("row").alias("query"), F.col("id").alias("query_id"))
    return ranked.join(names, "query").select("query_id", "rank", "vec_id", "score")
