"""Exact top-k by inner product with MaxScore.

Dimensions are the terms. Rows and queries are dealt into blocks; every query block visits every row block, a
shard, as one task's group, and the shards' results are merged. In a shard a term has a greatest contribution
for a query, from the largest and smallest weight in its posting column. Terms are ordered by it; the tail
whose bounds add up to no more than the k-th best score so far is non-essential: a row in none of the other
postings can't win. Essential postings are traversed for all rows, the others are probed, strongest first, only
for rows that can still reach the k-th best score.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SCALE = 1024
K = 10
QUERY_MODULUS = 100
#: Rows and queries of a block, on average.
ROW_BLOCK, QUERY_BLOCK = 8192, 1024


def usable(vector: Column) -> Column:
    """Not null, every component a finite number."""
    return vector.isNotNull() & F.coalesce(F.forall(vector, lambda x: x.isNotNull() & (F.abs(x.cast("double")) <= F.lit(1.7976931348623157e308))), F.lit(False))


def quantised(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = SCALE) -> DataFrame:
    """(id, v array<long>): components floor(scale * x), at most 9e18 in size, of rows with an id and a usable vector."""
    v = F.col(vector_col)
    kept = rows.where(F.col(id_col).isNotNull() & usable(v))
    return kept.select(F.col(id_col).cast("long").alias("id"), F.transform(v, lambda x: F.floor(F.greatest(F.least(x.cast("double") * scale, F.lit(9e18)), F.lit(-9e18))).cast("long")).alias("v"))


def matrix(vectors: list[np.ndarray], width: int) -> np.ndarray:
    """Rows of equal width; a shorter vector's missing components are 0."""
    out = np.zeros((len(vectors), width), dtype=np.int64)
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return out


def maxscore(rows: np.ndarray, ids: np.ndarray, query: np.ndarray, own: int, k: int = K) -> tuple[np.ndarray, np.ndarray]:
    """(ids, scores) of a query's k best rows, ties to smaller ids, the query's own id left out.

    rows is a matrix of numbers in which sums of products are exact: floats below 2^53, else Python or 64-bit integers.
    """
    keep = ids != own
    if not keep.all():
        rows, ids = rows[keep], ids[keep]
    n = len(ids)
    if not n:
        return ids, np.zeros(0, dtype=np.int64)
    bound = np.maximum(query * rows.max(axis=0), query * rows.min(axis=0))
    order = np.argsort(-bound, kind="stable")
    rest = np.concatenate((np.cumsum(bound[order][::-1])[::-1], [0]))  # what terms from here on can add at most
    seeds = rows[: 4 * k] @ query
    floor = np.partition(seeds, len(seeds) - k)[len(seeds) - k] if n >= k and len(seeds) >= k else None
    # the essential terms: without any of them a row cannot reach the k-th best score
    essential = len(order) if floor is None else int(np.argmax(rest < floor)) if (rest < floor).any() else len(order)
    essential = max(essential, min(len(order), 8))
    terms = order[:essential]
    score = rows[:, terms] @ query[terms]
    alive = np.arange(n)
    at = essential
    while at < len(order):
        if floor is not None:
            fits = score + rest[at] >= floor
            alive, score = alive[fits], score[fits]
            best = alive[np.argpartition(score, len(score) - k)[len(score) - k :]] if len(score) > k else alive
            if len(best) >= k:
                floor = max(floor, (rows[best] @ query).min())
        step = order[at : at + 8]
        score = score + rows[np.ix_(alive, step)] @ query[step]
        at += 8
    if len(score) > 8 * k:
        cut = np.partition(score, len(score) - k)[len(score) - k]
        alive, score = alive[score >= cut], score[score >= cut]
    top = np.lexsort((ids[alive], -score))[:k]
    return ids[alive[top]], score[top]


def _exact(rows: np.ndarray, queries: np.ndarray) -> np.dtype:
    """The fastest type in which every partial sum is exact."""
    if not rows.size or not queries.size:
        return np.dtype(np.float64)
    most = sum(int(a) * int(b) for a, b in zip(np.abs(rows.astype(object)).max(axis=0), np.abs(queries.astype(object)).max(axis=0)))
    return np.dtype(np.float64) if most < 1 << 53 else np.dtype(np.int64) if most < 1 << 62 else np.dtype(object)


def _longs(scores: np.ndarray) -> np.ndarray:
    """Scores as 64-bit numbers; those beyond saturate, after they were compared exactly."""
    return np.clip(scores, -(1 << 63), (1 << 63) - 1).astype(np.int64)


def search(rows: DataFrame, is_query: Column | None = None, k: int = K, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = SCALE, row_block: int = ROW_BLOCK, query_block: int = QUERY_BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best rows of each query, ranks from 1, ties to smaller ids.

    Queries are rows of the table, by default those whose id is divisible by 100; rows of a query's id are no
    candidates for it. Null ids, null vectors and vectors with a null or non-finite component take no part.
    Shorter vectors count as padded with zeros. Rows repeated under one id count each, a repeated query once.
    Scores beyond 64 bits saturate. Fewer than k candidates give fewer rows; empty tables give none.
    """
    vectors = quantised(rows, id_col, vector_col, scale)
    asked = F.col("id") % QUERY_MODULUS == 0 if is_query is None else is_query
    queries = vectors.where(asked).dropDuplicates(["id"])
    n, q = vectors.count(), vectors.where(asked).count()
    shards, groups = max(1, -(-n // row_block)), max(1, -(-q // query_block))
    every = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    # blocks meet by an equality of both block numbers; only the blocks are repeated, never row by row
    left = vectors.withColumn("s", F.pmod(F.xxhash64("id", "v"), F.lit(shards)).cast("int")).withColumn("g", every(groups))
    right = queries.withColumn("g", F.pmod(F.xxhash64("id"), F.lit(groups)).cast("int")).withColumn("s", every(shards))

    def visit(block: pd.DataFrame, asks: pd.DataFrame) -> pd.DataFrame:
        if not len(block) or not len(asks):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype("int64")
        width = max(max(map(len, block["v"])), max(map(len, asks["v"])))
        x, a = matrix(list(block["v"]), width), matrix(list(asks["v"]), width)
        kind = _exact(x, a)
        x, a, ids = x.astype(kind), a.astype(kind), block["id"].to_numpy()
        out = [(qid, *maxscore(x, ids, query, qid, k)) for qid, query in zip(asks["id"].to_numpy(), a)]
        return pd.DataFrame(
            {"query_id": np.concatenate([np.full(len(i), qid, dtype=np.int64) for qid, i, _ in out]), "vec_id": np.concatenate([i for _, i, _ in out]).astype(np.int64), "score": _longs(np.concatenate([s for _, _, s in out]))}
        )

    found = left.groupBy("g", "s").cogroup(right.groupBy("g", "s")).applyInPandas(visit, "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
