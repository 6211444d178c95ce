"""Embedding near-duplicates: p-stable hashing for Euclidean distance, then exact cosines.

Vectors are scaled to length one, so that a cosine is a distance. A table of the index joins k
projections onto Gaussian directions, shifted and cut into intervals; vectors are compared if
all k intervals of some table agree. k follows from the number of rows (so that a bucket holds
few strangers) and the number of tables from k (so that a pair at the threshold is missed with
a probability of ``MISS`` at most). Buckets of many vectors are cut into blocks, and pairs of
blocks go to different tasks. Tasks return counts of links per vector and, for the components,
links that span each connected part of a block; so the result grows with the vectors, not with
the pairs. A pair that several tables find is counted in the first one.

Equal vectors are one candidate with a weight. Null, zero, broken and empty vectors link with
nothing; vectors of different lengths are never linked. See ``vectors`` for repeated ids.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paneltide.llm.common import components, mix64, store
from paneltide.llm.registry import query, table
from paneltide.llm.vectors import is_whole, matrix, one_per_id

WIDTH = 1.2
MISS = 0.03
#: Vectors of a bucket that one block holds.
BLOCK = 1024


def agreement(distance: float) -> float:
    """Probability that one projection puts two vectors at this distance into one interval."""
    t = WIDTH / distance
    return math.erf(t / math.sqrt(2)) - 2 / (math.sqrt(2 * math.pi) * t) * (1 - math.exp(-t * t / 2))


def index_size(n: int, least_cosine: float) -> tuple[int, int]:
    """Projections per table and tables, for n vectors."""
    near, far = agreement(math.sqrt(2 - 2 * least_cosine)), agreement(math.sqrt(2))
    k = max(6, math.ceil(math.log(max(n, 2) / 8) / -math.log(far)))
    return k, math.ceil(math.log(MISS) / math.log(1 - near ** k))


def unit(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length one."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def bucket_keys(x: np.ndarray, k: int, tables: int) -> np.ndarray:
    """A 64-bit key per row and table."""
    rng = np.random.default_rng([k, tables, x.shape[1]])
    axes = rng.standard_normal((x.shape[1], k * tables))
    cell = np.floor((x @ axes) / WIDTH + rng.random(k * tables)).astype(np.int64).astype(np.uint64)
    key = np.tile(np.arange(tables, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(x.shape[1]),
                  (len(x), 1))
    cell = cell.reshape(len(x), tables, k)
    for i in range(k):
        key = mix64(key * np.uint64(31) + cell[:, :, i])
    return key.view(np.int64)


def spanning(a: np.ndarray, b: np.ndarray, n: int) -> list[tuple[int, int]]:
    """(place, smallest place of its part) for the parts that the pairs connect."""
    top = list(range(n))

    def find(i: int) -> int:
        while top[i] != i:
            top[i] = top[top[i]]
            i = top[i]
        return i

    for i, j in zip(a.tolist(), b.tolist(), strict=True):
        i, j = find(i), find(j)
        if i != j:
            top[max(i, j)] = min(i, j)
    return [(i, r) for i in range(n) if (r := find(i)) != i]


def compare(ids: np.ndarray, weight: np.ndarray, x: np.ndarray, side: np.ndarray, keys: np.ndarray,
            at: int, least_cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """(id, links) rows and (a, b) spanning links of a bucket's block pair.

    ``side`` is 1 for the left block, 2 for the right one, 3 if they are one block.
    """
    left, right = np.flatnonzero(side & 1), np.flatnonzero(side & 2)
    near = x[left] @ x[right].T >= least_cosine
    near &= ids[left][:, None] < ids[right] if side[0] == 3 else ids[left][:, None] != ids[right]
    i, j = np.nonzero(near)
    i, j = left[i], right[j]
    for earlier in range(at):
        own = keys[i, earlier] != keys[j, earlier]
        i, j = i[own], j[own]
    links = np.bincount(i, weight[j], len(ids)) + np.bincount(j, weight[i], len(ids))
    some = links > 0
    tree = spanning(i, j, len(ids))
    return (np.column_stack([ids[some], links[some].astype(np.int64)]),
            np.array([(ids[a], ids[b]) for a, b in tree], np.int64).reshape(-1, 2))


def near_vectors(vectors: DataFrame, least_cosine: float = 0.95, id_col: str = "vec_id",
                 vector_col: str = "embedding") -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every id."""
    rows = store(one_per_id(vectors, id_col, vector_col), "vectors")
    usable = rows.where(is_whole(F.col("v")) & F.exists("v", lambda x: x != 0))
    classes = store(usable.groupBy("v").agg(F.min("id").alias("rep"), F.count("*").alias("weight")), "classes")
    k, tables = index_size(classes.count(), least_cosine)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = pc.list_value_length(batch.column(1)).to_numpy()
            for dims in np.unique(size):
                part = batch.filter(pa.array(size == dims))
                for start in range(0, len(part), 4096):
                    piece = part.slice(start, 4096)
                    key = bucket_keys(unit(matrix(piece.column(1))), k, tables)
                    held = pa.ListArray.from_arrays(np.arange(0, key.size + 1, tables, dtype=np.int32), key.ravel())
                    yield pa.RecordBatch.from_arrays([piece.column(0), held], names=["rep", "keys"])

    keys = (classes.select("rep", "v").mapInArrow(hashed, "rep bigint, keys array<bigint>")
            .select("rep", F.posexplode("keys").alias("at", "key")))
    keys = store(keys, "keys")
    full = store(keys.groupBy("at", "key").agg(F.count("*").alias("n")).where("n > 1"), "buckets")
    blocks = F.ceil(F.col("n") / BLOCK).cast("long")
    dealt = (keys.join(full, ["at", "key"]).withColumn("blocks", blocks)
             .withColumn("own", F.pmod(F.xxhash64("rep"), "blocks"))
             .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
             .withColumn("lo", F.least("own", "other")).withColumn("hi", F.greatest("own", "other"))
             .withColumn("side", F.when(F.col("own") == F.col("other"), 3)
                         .when(F.col("own") < F.col("other"), 1).otherwise(2))
             .select("at", "key", "lo", "hi", "rep", "side"))
    joined = (dealt.join(classes, "rep").select("at", "key", "lo", "hi", "side", "rep", "weight", "v")
              .repartition("at", "key", "lo", "hi").sortWithinPartitions("at", "key", "lo", "hi", "rep"))

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def run(parts: pa.Table) -> Iterator[pa.RecordBatch]:
            size = pc.list_value_length(parts.column("v")).to_numpy()
            for dims in np.unique(size):
                yield run_one(parts.filter(pa.array(size == dims)))

        def run_one(part: pa.Table) -> pa.RecordBatch:
            x = unit(matrix(part.column("v")))
            own = bucket_keys(x, k, tables)
            group = np.column_stack([part.column(c).to_numpy() for c in ("at", "key", "lo", "hi")])
            cuts = np.flatnonzero((group[1:] != group[:-1]).any(axis=1)) + 1
            ids, weight, side = (part.column(c).to_numpy() for c in ("rep", "weight", "side"))
            counts, trees = [], []
            for a, b in zip([0, *cuts], [*cuts, len(group)], strict=True):
                if b - a > 1:
                    count, tree = compare(ids[a:b], weight[a:b].astype(float), x[a:b], side[a:b], own[a:b],
                                          int(group[a, 0]), least_cosine)
                    counts.append(count)
                    trees.append(tree)
            count, tree = np.concatenate(counts or [np.zeros((0, 2), np.int64)]), np.concatenate(
                trees or [np.zeros((0, 2), np.int64)])
            both = np.concatenate([np.column_stack([count, np.full(len(count), -1)]),
                                   np.column_stack([tree[:, 0], np.zeros(len(tree), np.int64), tree[:, 1]])])
            return pa.RecordBatch.from_arrays([pa.array(c) for c in both.astype(np.int64).T],
                                             names=["id", "links", "other"])

        held: pa.Table | None = None
        for batch in batches:
            now = pa.Table.from_batches([batch])
            held = pa.concat_tables([held, now]) if held is not None else now
            if len(held) < 4 * BLOCK:
                continue
            last = held.slice(len(held) - 1)
            same = np.ones(len(held), bool)
            for c in ("at", "key", "lo", "hi"):
                same &= held.column(c).to_numpy() == last.column(c)[0].as_py()
            cut = int(np.argmax(same))  # the last group may go on
            if cut:
                yield from run(held.slice(0, cut))
                held = held.slice(cut)
        if held is not None and len(held):
            yield from run(held)

    found = store(joined.mapInArrow(linked, "id bigint, links bigint, other bigint"), "found")
    counts = found.where("other = -1").groupBy(F.col("id").alias("rep")).agg(F.sum("links").alias("links"))
    parts = components(found.where("other <> -1").select(F.col("id").alias("a"), F.col("other").alias("b")))
    reps = (classes.join(counts, "rep", "left").join(parts, F.col("rep") == F.col("id"), "left")
            .select("v", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"),
                    F.coalesce("component", "rep").alias("component_id")))
    return (rows.join(reps, "v", "left")
            .select(F.col("id").alias("vec_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
                    F.coalesce("component_id", "id").alias("component_id"),
                    (F.coalesce("component_id", "id") == F.col("id")).alias("kept")))


@query("op2_near_vectors")
def op2_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))
