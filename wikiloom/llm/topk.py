"""Exact top-k search by inner product with block-at-a-time pruning.

Vectors are lists of integer terms. Ranges of vec_id form shards, and shards are cut into blocks of
consecutive vectors; a block knows the largest and smallest value of each term and its forward
index, the matrix of its vectors. For a query, the sum over the terms of the larger of the two
products is a bound on any score in the block. A query scores its blocks in descending order of
bounds until these fall below its k-th best score. Queries come in groups, and each group meets
each shard once; what a shard finds, at most k rows per query, is merged by rank.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wikiloom.llm.common import column
from wikiloom.session import WorkFolder

SHARD_VECTORS = 16_384
BLOCK_VECTORS = 128
GROUP_QUERIES = 512


def integer_terms(vectors: DataFrame, scale: int, vec_id: str, embedding: str) -> DataFrame:
    """vec_id and terms (``floor(scale * x)`` of each component) of the rows that take part.

    Rows without a vec_id or vector, and vectors with null or non-finite components, do not.
    """
    rows = vectors.select(column(vectors, vec_id).cast("bigint").alias("vec_id"), column(vectors, embedding).cast("array<double>").alias("x"))
    finite = F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("x").isNotNull() & finite)
    return rows.select("vec_id", F.transform("x", lambda v: F.floor(v * scale)).alias("terms"))


def _matrix(lists: pa.ChunkedArray, width: int) -> np.ndarray:
    rows = lists.to_pylist()
    out = np.zeros((len(rows), max([width, *map(len, rows)])), np.int64)
    for k, r in enumerate(rows):
        out[k, : len(r)] = r
    return out


class Shard:
    """The blocks of a shard: matrices, bounds of their terms, and vec_ids in ascending order."""

    def __init__(self, ids: np.ndarray, matrix: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.matrix = ids[order], matrix[order]
        self.starts = np.arange(0, len(ids), BLOCK_VECTORS)
        self.high = np.maximum.reduceat(self.matrix, self.starts) if len(ids) else self.matrix
        self.low = np.minimum.reduceat(self.matrix, self.starts) if len(ids) else self.matrix

    def search(self, own: int, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """vec_ids and scores of the best ``k`` rows other than ``own``; of equal scores, smaller vec_ids first."""
        bounds = (np.maximum(self.high * query, self.low * query)).sum(axis=1)
        best_ids, best = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for b in np.lexsort((self.starts, -bounds)):
            a = self.starts[b]
            if len(best) == k:
                if bounds[b] < best[-1]:
                    break
                if bounds[b] == best[-1] and self.ids[a] > best_ids[-1]:
                    continue
            ids = self.ids[a : a + BLOCK_VECTORS]
            scores = self.matrix[a : a + BLOCK_VECTORS] @ query
            keep = ids != own
            if len(best) == k:
                keep &= scores >= best[-1]
            if not keep.any():
                continue
            ids, scores = np.concatenate([best_ids, ids[keep]]), np.concatenate([best, scores[keep]])
            top = np.lexsort((ids, -scores))[:k]
            best_ids, best = ids[top], scores[top]
        return best_ids, best


def top_k(
    vectors: DataFrame,
    queries: DataFrame,
    work: WorkFolder,
    k: int = 5,
    scale: int = 256,
    vec_id: str = "vec_id",
    embedding: str = "embedding",
) -> DataFrame:
    """query_id, rank (from 1), vec_id and score of the ``k`` best rows of ``vectors`` for each row of ``queries``.

    A row does not find rows with its own vec_id. Fewer than ``k`` other rows are all returned, and
    ties go to the smaller vec_id. Vectors of different lengths are padded with zeros. Rows that
    repeat are found as often as they are there; queries that repeat vec_id and vector count once,
    those that repeat the vec_id alone are answered each. Scores must fit into 64 bits. No vectors
    or no queries give no rows; other columns are ignored.
    """
    rows = work.keep(integer_terms(vectors, scale, vec_id, embedding), "terms")
    shards = max(1, -(-rows.count() // SHARD_VECTORS))
    asked = integer_terms(queries, scale, vec_id, embedding).withColumn("query", F.xxhash64("terms")).distinct()
    asked = work.keep(asked, "queries")
    groups = max(1, -(-asked.count() // GROUP_QUERIES))

    bounds: list[int] = []
    if shards > 1:
        steps = [i / shards for i in range(1, shards)]
        bounds = sorted(set(rows.agg(F.percentile_approx("vec_id", steps, 100 * shards).alias("b")).head()["b"]))

    @F.pandas_udf("int")
    def shard_of(ids: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(np.array(bounds, np.int64), ids.to_numpy(), side="right").astype(np.int32))

    every_group = F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))
    every_shard = F.explode(F.sequence(F.lit(0), F.lit(len(bounds))))
    group_of = F.pmod(F.xxhash64("vec_id", "query"), F.lit(groups)).cast("int")
    left = rows.select(shard_of("vec_id").alias("shard"), "vec_id", "terms").withColumn("group", every_group)
    right = asked.select(group_of.alias("group"), "vec_id", "query", "terms").withColumn("shard", every_shard)

    def meet(vectors: pa.Table, queries: pa.Table) -> pa.Table:
        found = [np.zeros(0, np.int64) for _ in range(4)]
        if vectors.num_rows and queries.num_rows:
            asked = _matrix(queries.column("terms"), 0)
            matrix = _matrix(vectors.column("terms"), asked.shape[1])
            asked = np.pad(asked, ((0, 0), (0, matrix.shape[1] - asked.shape[1])))
            shard = Shard(vectors.column("vec_id").to_numpy(), matrix)
            own = queries.column("vec_id").to_numpy()
            hits = [shard.search(int(i), q, k) for i, q in zip(own, asked, strict=True)]
            sizes = [len(h[0]) for h in hits]
            found = [np.repeat(x, sizes) for x in (own, queries.column("query").to_numpy())]
            found += [np.concatenate([h[x] for h in hits]) for x in (0, 1)]
        return pa.table(dict(zip(("query_id", "query", "vec_id", "score"), found, strict=True)))

    hits = (
        left.groupBy("shard", "group")
        .cogroup(right.groupBy("shard", "group"))
        .applyInArrow(meet, "query_id bigint, query bigint, vec_id bigint, score bigint")
    )
    order = Window.partitionBy("query_id", "query").orderBy(F.desc("score"), "vec_id")
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
