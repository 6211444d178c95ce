"""Helpers shared by the operators: stored tables, checked joins, words, components."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paneltide.session import scratch_path

#: A word: a run of bytes other than space and tab to carriage return.
WORD = r"[^\x20\x09-\x0D]+"
#: A table is broadcast up to this estimate of its size.
BROADCAST_BYTES = 32 << 20
#: Spark's setting for dropping the shuffle files of a query that has ended.
SHUFFLES_GO = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def store(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the cluster's shared folder and read it again.

    This cuts the lineage: a lost executor costs at most the tasks that run. The shuffle files of the
    write go when it ends, and not when the driver collects its garbage.
    """
    spark = df.sparkSession
    path, before = scratch_path(spark, name), spark.conf.get(SHUFFLES_GO, None)
    spark.conf.set(SHUFFLES_GO, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(SHUFFLES_GO) if before is None else spark.conf.set(SHUFFLES_GO, before)
    return spark.read.schema(df.schema).parquet(path)


def small_side(stored: DataFrame, row_bytes: int, limit: int = BROADCAST_BYTES) -> DataFrame:
    """A stored table, marked for broadcast only if its counted rows are under ``limit`` bytes."""
    return F.broadcast(stored) if stored.count() * row_bytes <= limit else stored


def free_names(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores before it as it takes to differ from all columns."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def remainder(col: Column, divisor: int) -> Column:
    """crc32 of the id as text modulo ``divisor``; 0 for a null id."""
    return F.coalesce(F.crc32(col.cast("string").cast("binary")) % divisor, F.lit(0))


def mix64(x: np.ndarray) -> np.ndarray:
    """Finish a 64-bit hash so that every bit depends on all others."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def split_words(texts: pa.Array, lower: bool) -> tuple[np.ndarray, pa.Array]:
    """Words of a batch: their offsets per text (null counts as empty) and the words in order."""
    # A fresh array: the kernels below misread the offsets of a slice.
    texts = pa.array([t or "" for t in texts.to_pylist()], pa.large_string())
    if lower:
        texts = pc.ascii_lower(texts)
    lists = pc.ascii_split_whitespace(texts)
    words = lists.flatten()
    starts = lists.offsets.to_numpy().astype(np.int64)
    starts = starts - starts[0]
    # Leading and trailing white space leaves empty strings.
    full = pc.greater(pc.binary_length(words), 0)
    if len(words) and not pc.all(full).as_py():
        kept = np.concatenate([[0], np.cumsum(full.to_numpy(zero_copy_only=False))])
        words, starts = words.filter(full), kept[starts]
    return starts, words


def word_hashes(words: pa.Array) -> np.ndarray:
    """A stable 64-bit hash of every word; distinct words of the batch are hashed once."""
    import pandas as pd

    if not len(words):
        return np.zeros(0, np.uint64)
    coded = words.dictionary_encode()
    own = pd.util.hash_array(coded.dictionary.to_numpy(zero_copy_only=False), categorize=False)
    return own[coded.indices.to_numpy()]


def slices(col: pa.Array, most_bytes: int = 8 << 20):
    """Row ranges of a batch whose texts have about ``most_bytes`` together."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(col), 0).to_numpy())
    start = 0
    while start < len(sizes):
        base = sizes[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(sizes, base + most_bytes, side="right")))
        yield start, stop
        start = stop


def components(edges: DataFrame) -> DataFrame:
    """(id, component) of every id in ``edges`` (a, b): the smallest id reachable.

    Alternating large and small stars: each round hangs the neighbours of a node on the
    smallest of them, by a minimum per node and a join; no neighbourhood is gathered.
    """
    now = store(edges.where("a <> b").select(F.greatest("a", "b").alias("a"),
                                            F.least("a", "b").alias("b")).distinct(), "edges")
    mark = None
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = (both.where("b > a").join(least, "a")
                 .select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct())
        large = store(large, "large")
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (large.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
                 .unionByName(low.select("a", F.col("m").alias("b"))).where("a <> b")
                 .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
        now = store(small, "small")
        found = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if found == mark:
            break
        mark = found
    ends = now.select(F.col("a").alias("id"), F.col("b").alias("component"))
    return ends.unionByName(now.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct())


def near_pairs(pairs: DataFrame, traits: DataFrame, near: str) -> DataFrame:
    """Those of the pairs (a, b) whose rows ``l`` and ``r`` of ``traits`` (id, ...) are ``near``."""
    return (pairs.join(traits.alias("l"), F.expr("a = l.id")).join(traits.alias("r"), F.expr("b = r.id"))
            .where(near).select("a", "b"))


def star_pairs(keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(key, id, lead) of ids that share a key, and the pairs (a, b) of each id with the smallest
    id of its key. ``keys``: (key, id)."""
    lead = (keys.groupBy("key").agg(F.min("id").alias("lead"), F.max("id").alias("last"))
            .where("lead < last").drop("last"))
    shared = store(keys.join(lead, "key").where("id <> lead"), "shared")
    return shared, shared.select(F.col("lead").alias("a"), F.col("id").alias("b")).distinct()


def cross_pairs(shared: DataFrame, found: DataFrame, light: DataFrame, rough: str) -> DataFrame:
    """Pairs (a, b) that share a key, besides those with its smallest id, where ``rough`` holds for
    their rows of ``light`` and that stand in different components of ``found``."""
    own = shared.drop("lead").join(found, "id", "left").withColumn("component", F.coalesce("component", "id"))
    mixed = (own.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi"))
             .where("lo < hi").select("key"))
    own = store(own.join(mixed, "key").join(light, "id"), "mixed")
    return (own.alias("l").join(own.alias("r"), F.expr(
        f"l.key = r.key AND l.id < r.id AND l.component <> r.component AND ({rough})"))
        .select(F.col("l.id").alias("a"), F.col("r.id").alias("b")).distinct())


def link_groups(keys: DataFrame, traits: DataFrame, near: str, verify) -> DataFrame:
    """(id, component) over the verified links that the candidate keys allow.

    First every id is checked against the smallest id that shares a key; then ids that share a
    key but not yet a component are checked with one another. So a large group of copies costs
    links in its size, not in its square, and no link that joins two components is missed.
    ``keys``: (key, id); ``traits``: a stored table (id, ...); ``near``: a necessary condition on two
    of its rows ``l`` and ``r`` and a key ``{key}`` that they share, by which a pair is left to its other
    keys; ``verify`` takes pairs (a, b) and returns those that hold.
    """
    shared, _ = star_pairs(keys)
    stars = (shared.alias("k").join(traits.alias("l"), F.expr("k.lead = l.id")).join(traits.alias("r"), F.expr("k.id = r.id"))
             .where(near.format(key="k.key")).select(F.col("k.lead").alias("a"), F.col("k.id").alias("b")).distinct())
    tried = store(stars, "stars")
    links = store(verify(tried), "links")
    found = components(links)
    rest = cross_pairs(shared, found, traits, near.format(key="l.key")).join(tried, ["a", "b"], "left_anti")
    more = store(verify(store(rest, "rest")), "more")
    return components(links.unionByName(more)) if more.limit(1).count() else found


def candidate_clusters(keys: DataFrame, light: DataFrame, rough: str, traits: DataFrame, near: str) -> DataFrame:
    """(id, component): any two ids that share a key, and for which ``rough`` holds on ``light`` (id,
    few columns) and ``near`` on ``traits``, stand in one component.

    Pairs are only listed with the smallest id of a key, and between components that these leave
    apart, so a family of near copies is not paired with itself.
    """
    shared, stars = star_pairs(keys)

    def hold(pairs: DataFrame, name: str) -> DataFrame:
        return store(near_pairs(pairs, traits, near), name)

    stars = hold(near_pairs(stars, light, rough), "stars")
    found = components(stars)
    rest = hold(cross_pairs(shared, found, light, rough), "rest")
    return components(stars.unionByName(rest)) if rest.limit(1).count() else found
