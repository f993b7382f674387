"""Exact top-k inner-product search with Fagin's threshold algorithm.

Components are turned into integers floor(64 * x). Candidates are dealt by a hash of their id into
blocks and queries into groups; each (block, group) cell is one task's work of bounded size. A cell
sorts its block once along each dimension. A query reads the lists of its non-zero dimensions from
their better end, so many entries deeper at a time; each row seen is scored in full, and the bound, the query's
inner product with the values at the current depth, covers every row unseen. It stops once the
bound is below the k-th score found (at equality a row of a smaller id might still come). The cells'
answers for a query are then ranked together.

Defined results: vectors that are null or hold null or non-finite components take no part, nor do
rows without id; missing components count as 0; rows that repeat an id count once, with the least
of their vectors; ties go to the smaller id. Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

K = 20
SCALE = 64
BLOCK_ROWS = 16_384
GROUP_ROWS = 2_048
_STEP = 64
_OUT = "query_id long, vec_id long, score long"
_ARROW = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])


def quantised(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """(vec_id, q array<long>) of the rows that take part, one for each id."""
    x = F.transform("embedding", lambda v: v.cast("double"))
    good = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return (vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).where(F.coalesce(good, F.lit(False)))
            .select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(x, lambda v: F.floor(v * scale).cast("long")).alias("q"))
            .groupBy("vec_id").agg(F.min("q").alias("q")))


def _matrix(lists: pa.ChunkedArray, width: int) -> np.ndarray:
    out = np.zeros((len(lists), width), np.int64)
    at = 0
    for chunk in lists.chunks:
        sizes = np.diff(chunk.offsets.to_numpy())
        flat = chunk.flatten().to_numpy()
        if len(sizes) and (sizes == width).all():
            out[at:at + len(sizes)] = flat.reshape(-1, width)
        else:
            first = np.cumsum(sizes) - sizes
            for i, n in enumerate(sizes):
                out[at + i, :n] = flat[first[i]:first[i] + n]
        at += len(sizes)
    return out


def _width(*lists: pa.ChunkedArray) -> int:
    return max((int(np.diff(c.offsets.to_numpy()).max()) for x in lists for c in x.chunks if len(c)), default=0)


def threshold_search(query: np.ndarray, own: int, rows: np.ndarray, ids: np.ndarray, lists: np.ndarray,
                     k: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids, scores) of the k best of ``rows`` but ``own``. lists[d]: row numbers by falling value of dimension d."""
    n = len(rows)
    used = np.flatnonzero(query)
    seen = np.zeros(n, bool)
    best_id, best = np.zeros(0, np.int64), np.zeros(0, np.int64)
    depth = 0
    while depth < n:
        to = min(n, depth + max(_STEP, depth))
        if len(used) * to >= n:  # by now most rows are likely to be seen: take all that are left
            to = n
        if to == n or not len(used):
            new = np.flatnonzero(~seen)
        else:
            spans = [lists[d][depth:to] if query[d] > 0 else lists[d][n - to:n - depth] for d in used]
            new = np.unique(np.concatenate(spans))
            new = new[~seen[new]]
        seen[new] = True
        new = new[ids[new] != own]
        all_ids, scores = np.concatenate((best_id, ids[new])), np.concatenate((best, rows[new] @ query))
        if len(scores) > k:
            near = np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k])
            all_ids, scores = all_ids[near], scores[near]
        order = np.lexsort((all_ids, -scores))[:k]
        best_id, best = all_ids[order], scores[order]
        depth = to
        if depth < n and len(best) == k:
            edge = [rows[lists[d][depth - 1] if query[d] > 0 else lists[d][n - depth], d] for d in used]
            if int(query[used] @ np.array(edge, np.int64)) < best[-1]:
                break
    return best_id, best


def _cell(candidates: pa.Table, asked: pa.Table, k: int) -> pa.Table:
    """Answers of one block of candidates to one group of queries."""
    if not candidates.num_rows or not asked.num_rows:
        return _ARROW.empty_table()
    width = max(_width(candidates["q"], asked["q"]), 1)
    rows, ids = _matrix(candidates["q"], width), candidates["vec_id"].to_numpy()
    wanted, own = _matrix(asked["q"], width), asked["vec_id"].to_numpy()
    lists = np.argsort(-rows, axis=0, kind="stable").T.astype(np.int32)
    if float(np.abs(rows).max()) * float(np.abs(wanted).max()) * width < 2.0 ** 53:
        rows = rows.astype(np.float64)  # sums stay exact
    found = [(me, *threshold_search(query, me, rows, ids, lists, k)) for query, me in zip(wanted, own)]
    return pa.table([pa.array(np.repeat(own, [len(got) for _, got, _ in found])),
                     pa.array(np.concatenate([got for _, got, _ in found]).astype(np.int64)),
                     pa.array(np.concatenate([scores for _, _, scores in found]).astype(np.int64))], schema=_ARROW)


def top_k(vectors: DataFrame, is_query: Column, k: int = K, block_rows: int = BLOCK_ROWS, group_rows: int = GROUP_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best candidates of each row of ``quantised`` ``vectors`` that ``is_query``."""
    queries = vectors.where(is_query)
    n, n_queries = vectors.count(), queries.count()
    blocks, groups = max(1, -(-n // block_rows)), max(1, -(-n_queries // group_rows))
    dealt = lambda parts, seed: F.pmod(F.xxhash64(F.lit(seed), "vec_id"), F.lit(parts)).cast("int")
    every = lambda parts: F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))
    have = vectors.select(dealt(blocks, 1).alias("block"), every(groups).alias("group"), "vec_id", "q")
    ask = queries.select(every(blocks).alias("block"), dealt(groups, 2).alias("group"), "vec_id", "q")
    found = have.groupBy("block", "group").cogroup(ask.groupBy("block", "group")).applyInArrow(
        lambda candidates, asked: _cell(candidates, asked, k), _OUT)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
