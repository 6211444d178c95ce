"""N-gram Jaccard join by vertical partitioning.

All n-grams stand in one global order: by how often they occur, rare ones first, then by hash.
Only the most frequent ones are ranked by number; the order decides what is compared, not the
result. Two documents that reach the threshold share one of the first n-grams of either, so the
rare heads of the sets find the candidates, which form clusters. For these the sets are cut into
fragments by ranges of the hash; a fragment's overlaps are counted by itself, for all pairs of a
cluster at once, and the counts are summed per pair and held against the threshold in whole
numbers. Clusters of many documents are cut into blocks, and pairs of blocks go to different
tasks.

Documents with equal sets are one node, weighted by their number. The result has a row per document;
of a block pair, tasks return how many documents each node is linked with, and links that span
each connected part, not all pairs.

Null, empty or wordless texts have an empty set and link with nothing. A null id links with
nothing. Of rows that share an id, one set (the largest by fingerprint) stands for it in links;
``n_shingles`` is each row's own. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paneltide.llm.common import (candidate_clusters, components, mix64, slices, small_side, split_words, store,
                                  word_hashes)
from paneltide.llm.near_vectors import spanning
from paneltide.llm.registry import query, table
from paneltide.llm.substrings import BASES, lists, rolling

#: N-grams that are ranked by number; bounds what each task gets at 2 MB.
RANKED = 1 << 17
#: An n-gram is counted where so many documents of one block have it.
LEAST_COUNT = 3
#: log2 of the fragments in which overlaps are counted.
FRAGMENT_BITS = 3
#: Documents of a cluster that one block holds, and n-grams counted at once in a task.
BLOCK, COUNTED = 1024, 2048
GROUP = ["component", "lo", "hi"]


def shingle_set(words: np.ndarray, size: int) -> np.ndarray:
    """Sorted distinct hashes of the n-grams; of the whole sequence if it is shorter."""
    if not len(words):
        return np.zeros(0, np.uint64)
    length = min(size, len(words))
    return np.unique(rolling(words, length, BASES[0]) ^ np.uint64(length - size & 0xFFFF))


def sets(batches: Iterator[pa.RecordBatch], size: int, text_at: int = 1):
    """Parts of the batches and the n-gram sets of their texts."""
    for batch in batches:
        for start, stop in slices(batch.column(text_at)):
            part = batch.slice(start, stop - start)
            starts, words = split_words(part.column(text_at), lower=True)
            hashes = word_hashes(words)
            yield part, [shingle_set(hashes[a:b], size) for a, b in zip(starts[:-1], starts[1:], strict=True)]


def fingerprint(own: np.ndarray) -> tuple[int, int]:
    one = int(mix64(own).sum(dtype=np.uint64)) if len(own) else 0
    two = int(mix64(own ^ np.uint64(BASES[1])).sum(dtype=np.uint64)) if len(own) else 0
    return tuple(int(np.uint64(x).view(np.int64)) for x in (one, two))


def frequent(docs: DataFrame, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent n-grams, sorted by hash, with their numbers of documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, found in sets(batches, size):
            if found:
                gram, n = np.unique(np.concatenate(found), return_counts=True)
                often = n >= LEAST_COUNT
                yield pa.RecordBatch.from_arrays([pa.array(gram[often].view(np.int64)), pa.array(n[often])],
                                                 names=["gram", "n"])

    top = (docs.mapInArrow(run, "gram bigint, n bigint").groupBy("gram").agg(F.sum("n").alias("n"))
           .orderBy(F.desc("n"), "gram").limit(RANKED).toPandas().sort_values("gram"))
    gram = top["gram"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(gram)
    return gram[order], top["n"].to_numpy(np.int64)[order]


def sketch(docs: DataFrame, size: int, percent: int) -> DataFrame:
    """(id, n, f1, f2, head, probe): set size, fingerprint, the n-grams that find candidates, and
    the set's part in the first fragment of the hash range, 32 bits of each."""
    sent = docs.sparkSession.sparkContext.broadcast(frequent(docs, size))

    def head(own: np.ndarray, gram: np.ndarray, often: np.ndarray) -> np.ndarray:
        count = len(own) - -(-percent * len(own) // 100) + 1
        if not len(own) or not len(gram):
            return own[:count] if len(own) else own
        at = np.minimum(np.searchsorted(gram, own), len(gram) - 1)
        return own[np.argsort(np.where(gram[at] == own, often[at], 0), kind="stable")[:count]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gram, often = sent.value
        first_end = np.uint64(1 << (64 - FRAGMENT_BITS))
        for part, found in sets(batches, size):
            marks = [fingerprint(own) for own in found]
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array([len(own) for own in found], pa.int64()),
                 pa.array([m[0] for m in marks], pa.int64()), pa.array([m[1] for m in marks], pa.int64()),
                 lists([head(own, gram, often).view(np.int64) for own in found], pa.int64()),
                 lists([np.unique(own[:np.searchsorted(own, first_end)].astype(np.uint32).view(np.int32))
                        for own in found], pa.int32())],
                names=["id", "n", "f1", "f2", "head", "probe"])

    return docs.mapInArrow(run, "id bigint, n bigint, f1 bigint, f2 bigint, head array<bigint>, probe array<int>")


def fragments(docs: DataFrame, size: int) -> DataFrame:
    """(id, fragment, part) of (id, text, f1): the sets with that fingerprint, cut by hash range."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, found in sets(batches, size):
            ids, marks = part.column(0).to_pylist(), part.column(2).to_pylist()
            rows = [(i, f, piece) for i, mark, own in zip(ids, marks, found, strict=True)
                    if fingerprint(own)[0] == mark
                    for f, piece in enumerate(np.split(own, np.searchsorted(own, np.arange(
                        1, 1 << FRAGMENT_BITS, dtype=np.uint64) << np.uint64(64 - FRAGMENT_BITS)))) if len(piece)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int32()),
                 lists([r[2].view(np.int64) for r in rows], pa.int64())], names=["id", "fragment", "part"])

    return docs.mapInArrow(run, "id bigint, fragment int, part array<bigint>")


def block_overlaps(part: pa.Table, percent: int) -> np.ndarray:
    """(a, b, links) of one block pair, from (id, n, weight, side, fragment, part) rows.

    Rows with a = b count the documents that a is linked with in the other block, all others span the
    linked parts. ``side`` is 1 for the left block, 2 for the right one, 3 if they are one block.
    """
    row_id = part.column("id").to_numpy()
    ids, first, doc = np.unique(row_id, return_index=True, return_inverse=True)
    n, weight, side = (part.column(c).to_numpy()[first] for c in ("n", "weight", "side"))
    left, right = np.flatnonzero(side & 1), np.flatnonzero(side & 2)
    grams = part.column("part").combine_chunks()
    size = pc.list_value_length(grams).to_numpy(zero_copy_only=False)
    gram, owner = pc.list_flatten(grams).to_numpy(), np.repeat(doc, size)
    fragment = np.repeat(part.column("fragment").to_numpy(), size)
    common = np.zeros((len(left), len(right)), np.int64)
    for own in range(1 << FRAGMENT_BITS):
        inside = fragment == own
        _, code, times = np.unique(gram[inside], return_inverse=True, return_counts=True)
        shared = times[code] > 1
        code, holder = code[shared], owner[inside][shared]
        _, code = np.unique(code, return_inverse=True)
        for start in range(0, int(code.max(initial=-1)) + 1, COUNTED):
            here = (code >= start) & (code < start + COUNTED)
            has = np.zeros((len(ids), COUNTED), np.float32)
            has[holder[here], code[here] - start] = 1
            common += (has[left] @ has[right].T).astype(np.int64)
    linked = 100 * common >= percent * (n[left][:, None] + n[right] - common)
    linked &= ids[left][:, None] != ids[right]
    i, j = np.nonzero(linked)
    links = np.zeros(len(ids), np.int64)
    np.add.at(links, left[i], weight[right[j]])
    if not (side == 3).any():  # in one block every pair stands in the matrix twice
        np.add.at(links, right[j], weight[left[i]])
    tree = [(ids[a], ids[b], 0) for a, b in spanning(left[i], right[j], len(ids))]
    own = np.flatnonzero(links)
    return np.concatenate([np.array(tree, np.int64).reshape(-1, 3), np.column_stack([ids[own], ids[own], links[own]])])


def cluster_links(dealt: DataFrame, percent: int) -> DataFrame:
    """(a, b, links) of (component, lo, hi, side, id, n, weight, fragment, part), block pair by block pair."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def links(table: pa.Table) -> pa.RecordBatch:
            group = np.column_stack([table.column(c).to_numpy() for c in GROUP])
            cuts = [0, *(np.flatnonzero((group[1:] != group[:-1]).any(axis=1)) + 1), len(group)]
            found = np.concatenate([block_overlaps(table.slice(a, b - a), percent)
                                    for a, b in zip(cuts[:-1], cuts[1:], strict=True)])
            return pa.RecordBatch.from_arrays([pa.array(c) for c in found.T], names=["a", "b", "links"])

        held: pa.Table | None = None
        for batch in batches:
            now = pa.Table.from_batches([batch])
            held = now if held is None else pa.concat_tables([held, now])
            same = np.ones(len(held), bool)
            for c in GROUP:
                same &= held.column(c).to_numpy() == held.column(c)[len(held) - 1].as_py()
            if cut := int(np.argmax(same)):  # the last block pair may go on
                yield links(held.slice(0, cut))
                held = held.slice(cut).combine_chunks()
        if held is not None and len(held):
            yield links(held)

    return (dealt.repartition(*GROUP).sortWithinPartitions(*GROUP).mapInArrow(run, "a bigint, b bigint, links bigint"))


def jaccard_groups(docs: DataFrame, size: int, percent: int, id_col: str = "doc_id",
                   text_col: str = "text") -> DataFrame:
    """(id, n_shingles, n_links, component_id) of every row, linked from ``percent`` per cent similarity on.

    ``n_links`` is the number of other ids linked directly, those with an equal set among them; 0 for
    a null id.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    sketched = store(sketch(texts, size, percent), "sketch")
    one = (sketched.where("id IS NOT NULL AND n > 0").groupBy("id")
           .agg(F.max(F.struct("f1", "f2", "n")).alias("s")).select("id", "s.*"))
    classes = store(one.groupBy("f1", "f2", "n").agg(F.min("id").alias("rep"), F.count("*").alias("weight")), "classes")
    size_of = classes.select(F.col("rep").alias("id"), "n", "f1", "f2", "weight")
    reps = sketched.drop("n").join(small_side(size_of.drop("weight"), 40), ["id", "f1", "f2"])
    # Dealt by key once, for the smallest id of a key and for the rows that share it.
    keys = reps.select(F.explode("head").alias("key"), "id").repartition("key")
    traits = store(reps.select("id", "n", "probe"), "traits")

    def verify(clusters: DataFrame) -> DataFrame:
        many = clusters.groupBy("component").agg(F.ceil(F.count("*") / BLOCK).cast("long").alias("blocks"))
        dealt = (clusters.join(many, "component").join(size_of, "id")
                 .withColumn("own", F.pmod(F.xxhash64("id"), "blocks"))
                 .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
                 .select("component", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"),
                         F.when(F.col("own") == F.col("other"), 3).when(F.col("own") < F.col("other"), 1)
                         .otherwise(2).alias("side"), "id", "n", "weight", "f1"))
        dealt = store(dealt, "dealt")
        asked = store(dealt.select("id", "f1").distinct(), "asked")
        parts = fragments(texts.join(small_side(asked, 24), "id").select("id", "text", "f1"), size)
        return cluster_links(parts.join(small_side(dealt.drop("f1"), 72), "id"), percent)

    rough = f"100 * least(l.n, r.n) >= {percent} * greatest(l.n, r.n)"
    # What the first fragments miss bounds the overlap, and rules most candidates out at once.
    near = (f"{100 + percent} * (size(array_intersect(l.probe, r.probe)) + "
            f"least(l.n - size(l.probe), r.n - size(r.probe))) >= {percent} * (l.n + r.n)")
    clusters = candidate_clusters(keys, size_of.select("id", "n"), rough, traits, near)
    links = store(verify(clusters), "links")
    found = components(links.where("a <> b").select("a", "b"))
    counts = links.where("a = b").groupBy(F.col("a").alias("rep")).agg(F.sum("links").alias("links"))
    group = (one.join(classes, ["f1", "f2", "n"]).join(found.withColumnRenamed("id", "rep"), "rep", "left")
             .join(counts, "rep", "left")
             .select("id", F.coalesce("component", "rep").alias("component"),
                     (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("links")))
    return (sketched.select("id", "n").join(group, "id", "left")
            .select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"),
                    F.coalesce("links", F.lit(0)).cast("long").alias("n_links"),
                    F.coalesce("component", "id").alias("component_id")))


SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
  'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN CAST([] AS VARCHAR[]) WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
  ELSE list_distinct([array_to_string(w[i:i+2], ' ') FOR i IN range(1, len(w) - 1)]) END AS s FROM w),
e AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, a.n AS nx, b.n AS ny, count(*) AS c FROM e a JOIN e b
  ON a.g = b.g AND a.doc_id < b.doc_id AND 100 * least(a.n, b.n) >= 90 * greatest(a.n, b.n) GROUP BY ALL),
l AS (SELECT x, y FROM p WHERE 100 * c >= 90 * (nx + ny - c)),
r(doc_id, reach) AS (SELECT doc_id, doc_id FROM s UNION
  SELECT CASE WHEN r.doc_id = l.x THEN l.y ELSE l.x END, r.reach FROM r JOIN l ON r.doc_id IN (l.x, l.y))
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, coalesce(k.n_links, 0) AS n_links, c.component_id
FROM s JOIN (SELECT doc_id, min(reach) AS component_id FROM r GROUP BY doc_id) c USING (doc_id)
LEFT JOIN (SELECT doc_id, count(*) AS n_links FROM (SELECT x AS doc_id FROM l UNION ALL SELECT y FROM l) GROUP BY doc_id) k
  USING (doc_id)"""


@query("op6_ngram_join", SQL)
def op6_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_groups(table(spark, sf_dir, "documents"), size=3, percent=90)
