"""Exact top-k by integer inner product: columnar branch and bound.

Queries and candidates are dealt into blocks; a task takes one query block and one slice of the
candidates, laid out by dimension. For each query it adds the products dimension block by
dimension block; what the remaining dimensions can still add is bounded by the product of the
remaining lengths (Cauchy-Schwarz), and candidates that cannot reach the k-th best lower bound
are dropped from the arrays. Each task returns k rows per query, and these are merged.

Vectors of different lengths are compared over the shorter one. Broken vectors and repeated or
null ids: see ``vectors``. A component beyond 2^20 in size makes its slice use exact integers of
any length; a score outside the range of a long is set to its nearest end. Empty vectors score 0.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from paneltide.llm.common import store
from paneltide.llm.registry import query, table
from paneltide.llm.vectors import is_whole, one_per_id

QUERY_BLOCK = 2048
CANDIDATE_SLICE = 16384
DIMENSION_BLOCK = 16
LONG = 2 ** 63


def columns(lists: pa.Array, scale: int) -> np.ndarray:
    """floor(scale * x) of every component, one row per dimension; short vectors end in zeros."""
    size = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = pc.list_flatten(lists).to_numpy(zero_copy_only=False).astype(np.float64)
    out = np.zeros((int(size.max(initial=0)), len(size)))
    row = np.repeat(np.arange(len(size)), size)
    out[np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size), row] = np.floor(flat * scale)
    return out


def rest(x: np.ndarray, edges: list[int]) -> np.ndarray:
    """Length of every column from each edge on, a little more than exact."""
    tail = np.cumsum((x * x)[::-1], axis=0)[::-1]
    return np.sqrt(np.array([tail[e] if e < len(x) else np.zeros(x.shape[1]) for e in edges])) * (1 + 1e-12)


def best(own: int, q: np.ndarray, q_rest: np.ndarray, ids: np.ndarray, x: np.ndarray, x_rest: np.ndarray,
         edges: list[int], k: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and scores of the k best candidates of one query; ids ascend with the columns of x."""
    alive = np.flatnonzero(ids != own)
    score = np.zeros(len(alive))
    for n, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
        part = x[a:b] if len(alive) == x.shape[1] else x[a:b, alive]
        score = score + q[a:b] @ part
        if b < edges[-1] and len(alive) > k:
            slack = q_rest[n + 1] * x_rest[n + 1, alive] + 1
            low = np.partition(score - slack, len(alive) - k)[len(alive) - k]
            left = score + slack >= low
            alive, score = alive[left], score[left]
    if len(alive) > k:
        left = score >= np.partition(score, len(score) - k)[len(score) - k]
        alive, score = alive[left], score[left]
    order = np.lexsort((ids[alive], -score))[:k]
    return ids[alive[order]], score[order]


def block_search(queries: pa.Table, candidates: pa.Table, k: int, scale: int) -> pa.Table:
    """The k best candidates of every query, of those in this slice."""
    candidates = candidates.sort_by("id")
    q_ids, ids = (t.column("id").to_numpy() for t in (queries, candidates))
    q = columns(queries.column("v").combine_chunks(), scale)
    x = columns(candidates.column("v").combine_chunks(), scale)
    dims = min(len(q), len(x))
    q, x = q[:dims], x[:dims]
    found = []
    if max(np.abs(q).max(initial=0), np.abs(x).max(initial=0)) > 2 ** 20 or dims > 2 ** 12:
        # Beyond what doubles hold exactly.
        big = np.array([[int(v) for v in col] for col in x.T], dtype=object).reshape(len(ids), dims)
        for own, col in zip(q_ids, q.T, strict=True):
            score = big @ np.array([int(v) for v in col], dtype=object) if dims else np.zeros(len(ids), object)
            order = sorted((i for i in range(len(ids)) if ids[i] != own), key=lambda i: (-score[i], ids[i]))[:k]
            found += [(own, ids[i], max(-LONG, min(LONG - 1, int(score[i])))) for i in order]
    else:
        # Dimensions with much mass first, so that the bounds close early.
        order = np.argsort(-(x * x).sum(axis=1), kind="stable")
        q, x = q[order], np.ascontiguousarray(x[order])
        edges = [*range(0, dims, DIMENSION_BLOCK), dims]
        q_rest, x_rest = rest(q, edges), rest(x, edges)
        for n, own in enumerate(q_ids):
            near, score = best(own, q[:, n], q_rest[:, n], ids, x, x_rest, edges, k)
            found += zip([own] * len(near), near, score.astype(np.int64), strict=True)
    frame = pd.DataFrame(found, columns=["query_id", "vec_id", "score"]).astype("int64")
    return pa.Table.from_pandas(frame, preserve_index=False)


def top_k(vectors: DataFrame, is_query, k: int = 5, scale: int = 256, id_col: str = "vec_id",
          vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score) of the rows where ``is_query(id)`` holds, against all others."""
    rows = store(one_per_id(vectors, id_col, vector_col).where(is_whole(F.col("v"))), "vectors")
    queries = rows.where(is_query(F.col("id")))
    n_blocks = max(1, -(-queries.count() // QUERY_BLOCK))
    n_slices = max(1, -(-rows.count() // CANDIDATE_SLICE))

    def every(n):
        return F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))

    def deal(n, salt):
        return F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(n))

    left = queries.select("id", "v", deal(n_blocks, 1).alias("block"),
                          every(n_slices).alias("slice"))
    right = rows.select("id", "v", every(n_blocks).alias("block"),
                        deal(n_slices, 2).alias("slice"))

    def search(a: pa.Table, b: pa.Table) -> pa.Table:
        return block_search(a, b, k, scale)

    found = (left.groupBy("block", "slice").cogroup(right.groupBy("block", "slice"))
             .applyInArrow(search, "query_id bigint, vec_id bigint, score bigint"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return (found.withColumn("rank", place).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))


@query("op3_top_k", """
WITH v AS (SELECT vec_id, [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS z FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum([a[1] * a[2] FOR a IN list_zip(q.z, c.z)]) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM p)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5""")
def op3_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), lambda i: i % 50 == 0)
