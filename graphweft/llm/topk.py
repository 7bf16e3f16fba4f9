"""Exact top-k inner products by columnar branch and bound.

Vectors become whole numbers, floor(scale * x). Queries and candidates are cut into blocks of bounded
size; each (query block, candidate block) pair is one group of one task. There candidates lie
vertically, a row per dimension. Dimensions are taken block by block in the order of falling mass of
the query; after each block a candidate's score lies within its partial sum plus or minus the product
of the remaining norms, and candidates that cannot reach the k-th best lower bound are compacted away.
Sums are exact in 64 bits; bounds are widened by a unit, so rounding never costs a result.

Plan: all queries against all candidates is the operation asked for, quadratic in the table as the
queries are a fixed share of it. Queries are replicated to every candidate block and candidates to
every query block, nothing is broadcast, and no task holds more than one block of each side. Each pair
returns k rows a query; ranks are cut per partition before the last shuffle.

Defined results: a vector that is null, empty or holds a null or non-finite component takes no part;
vectors of other lengths are never compared; rows with the query's own id are never its candidates;
exactly repeated rows count once; ties go to the smaller id; fewer candidates than k give all.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

QUERY_BLOCK = 1024
CANDIDATE_BLOCK = 16384
DIMENSIONS = 8


def quantize(vectors: DataFrame, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, v array<long>) of the rows that take part."""
    fine = F.forall(vector_col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = vectors.where(F.col(id_col).isNotNull() & (F.size(vector_col) > 0) & fine)
    return rows.select(
        F.col(id_col).cast("long").alias("vec_id"), F.transform(vector_col, lambda x: F.floor(F.lit(scale) * x.cast("double"))).alias("v")
    )


class CandidateBlock:
    """Candidates in vertical layout: one row per dimension, and each dimension block's mass per candidate."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        self.ids, width = ids, vectors.shape[1]
        self.blocks = [slice(a, min(a + DIMENSIONS, width)) for a in range(0, width, DIMENSIONS)]
        self.largest = float(np.abs(vectors).max(initial=0))
        self.whole = np.ascontiguousarray(vectors.T)
        self.floats = self.whole.astype(np.float64)
        self.masses = np.stack([(self.floats[b] ** 2).sum(axis=0) for b in self.blocks])

    def best(self, query: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, scores) of the k best for one query, best first."""
        # Sums of products below 2^53 are exact as doubles, and faster.
        exact = float(np.abs(query).max(initial=0)) * self.largest * len(query) < 1 << 53
        columns, q = (self.floats, query.astype(np.float64)) if exact else (self.whole, query)
        own_mass = np.array([float((query[b].astype(np.float64) ** 2).sum()) for b in self.blocks])
        order = np.argsort(-own_mass, kind="stable")
        rest = np.sqrt(np.maximum(0.0, own_mass.sum() - np.cumsum(own_mass[order])))
        alive = np.flatnonzero(self.ids != own)
        partial = np.zeros(len(alive), q.dtype)
        left = self.masses.sum(axis=0)[alive]
        for step, block in enumerate(order):
            cut = self.blocks[block]
            partial += q[cut] @ columns[cut].take(alive, axis=1)
            if len(alive) <= k or step == len(order) - 1:
                continue
            left = left - self.masses[block][alive]
            slack = (rest[step] + 1e-6) * (np.sqrt(np.maximum(0.0, left)) + 1e-6) * (1 + 1e-9) + 1.0
            low = partial - slack
            reach = np.partition(low, len(low) - k)[len(low) - k]
            kept = np.flatnonzero(partial + slack >= reach)
            if len(kept) < len(alive):
                alive, partial, left = alive[kept], partial[kept], left[kept]
        if len(alive) > k:
            kept = partial >= np.partition(partial, len(partial) - k)[len(partial) - k]
            alive, partial = alive[kept], partial[kept]
        best = np.lexsort((self.ids[alive], -partial))[:k]
        return self.ids[alive][best], partial[best].astype(np.int64)


def search_blocks(queries: tuple[np.ndarray, np.ndarray], candidates: tuple[np.ndarray, np.ndarray], k: int) -> tuple[list, list, list]:
    """(query ids, candidate ids, scores) of the k best of a candidate block for each query of a block."""
    block = CandidateBlock(*candidates)
    out: tuple[list, list, list] = ([], [], [])
    for own, query in zip(queries[0].tolist(), queries[1]):
        found, scores = block.best(query, own, k)
        out[0].extend([own] * len(found))
        out[1].extend(found.tolist())
        out[2].extend(scores.tolist())
    return out


def _side(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    ids = np.asarray(table.column("vec_id").combine_chunks(), dtype=np.int64)
    vectors = table.column("v").combine_chunks()
    flat = vectors.flatten() if isinstance(vectors, (pa.ListArray, pa.LargeListArray)) else vectors
    return ids, np.asarray(flat, dtype=np.int64).reshape(len(ids), -1)


def top_k(vectors: DataFrame, is_query: Column, k: int = 5) -> DataFrame:
    """(query_id, rank, vec_id, score) of quantised vectors (vec_id, v); ``is_query`` picks the queries."""
    distinct = vectors.withColumn("dim", F.size("v")).dropDuplicates(["vec_id", "v"])
    sizes = distinct.agg(F.count(F.lit(1)).alias("n"), F.count_if(is_query).alias("q")).first()
    n_candidate_blocks = max(1, -(-sizes["n"] // CANDIDATE_BLOCK))
    n_query_blocks = max(1, -(-sizes["q"] // QUERY_BLOCK))
    dealt = F.xxhash64("vec_id", "v")

    def spread(rows: DataFrame, own: str, own_blocks: int, other: str, other_blocks: int) -> DataFrame:
        return rows.withColumn(own, F.pmod(dealt, F.lit(own_blocks)).cast("int")).withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(other_blocks - 1))))

    queries = spread(distinct.where(is_query), "qb", n_query_blocks, "cb", n_candidate_blocks)
    candidates = spread(distinct, "cb", n_candidate_blocks, "qb", n_query_blocks)

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            found: tuple = ([], [], [])
        else:
            found = search_blocks(_side(left), _side(right), k)
        return pa.table([pa.array(c, pa.int64()) for c in found], names=["query_id", "vec_id", "score"])

    keys = ["dim", "qb", "cb"]
    found = queries.groupBy(*keys).cogroup(candidates.groupBy(*keys)).applyInArrow(search, "query_id long, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
