"""Substring dedup: seeds from winnowed anchors, extended both ways to repeats of 50 words and more.

A document's anchors are the smallest hashes of its runs of 20 words among every 31 neighbouring
runs, so each stretch of 50 words holds one, chosen by that stretch alone. Anchors that two
documents share are the seeds. Around every seed a document is extended both ways as far as a
stretch of 50 words can reach over it; stretches are compared by a 96-bit hash, and of each
repeated one only the smallest document keeps its words. Overlapping stretches form the maximal
repeats. Seeds and stretches are counted and joined, never paired with one another, so a passage
that a third of all documents share costs rows in its occurrences.

Documents with the same words as a smaller document are decided as copies first. A text that is
null, empty or below 50 words keeps all its words. A document without an id covers nothing and
keeps all its words; rows that share an id do not cover one another. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paneltide.llm.common import mix64, slices, small_side, split_words, store, word_hashes
from paneltide.llm.registry import query, table

WINDOW = 50
#: Words of an anchor. Shorter ones are shared by chance or by common phrases more often.
ANCHOR = 20
#: Odd multipliers of the two rolling hashes.
BASES = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)


@lru_cache(maxsize=4)
def powers(base: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of ``base`` and of its inverse modulo 2^64."""
    out = []
    for b in (base, pow(base, -1, 1 << 64)):
        steps = np.full(size, b, np.uint64)
        steps[0] = 1
        out.append(np.cumprod(steps, dtype=np.uint64))
    return out[0], out[1]


def rolling(words: np.ndarray, length: int, base: int) -> np.ndarray:
    """Hash of every run of ``length`` words."""
    up, down = powers(base, 1 << max(12, len(words).bit_length()))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words * up[:len(words)], dtype=np.uint64)])
    return mix64((sums[length:] - sums[:-length]) * down[:len(words) - length + 1])


def sliding(op, a: np.ndarray, width: int) -> np.ndarray:
    """Least or largest value of every ``width`` neighbours."""
    span = 1
    while span * 2 <= width:
        a, span = op(a[:-span], a[span:]), span * 2
    return op(a[:len(a) - (width - span)], a[width - span:]) if width > span else a


def anchors(words: np.ndarray, anchor: int = ANCHOR, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and places of the anchors of a document's word hashes."""
    if len(words) < window:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    own, width = rolling(words, anchor, BASES[0]), window - anchor + 1
    low = np.pad(sliding(np.minimum, own, width), width - 1)
    places = np.flatnonzero(sliding(np.maximum, low, width) == own)
    return own[places], places


def stretches(words: np.ndarray, places: np.ndarray, anchor: int = ANCHOR, window: int = WINDOW) -> np.ndarray:
    """Starts of the windows that hold an anchor at one of ``places``."""
    marks = np.zeros(len(words) - window + 2, np.int64)
    np.add.at(marks, np.maximum(places + anchor - window, 0), 1)
    np.add.at(marks, np.minimum(places, len(words) - window) + 1, -1)
    return np.flatnonzero(np.cumsum(marks[:-1]) > 0)


def lists(rows: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    ends = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int32)
    flat = np.concatenate(rows) if rows else np.zeros(0)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, kind))


def blocks(batches: Iterator[pa.RecordBatch], text_at: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Parts of the batches with the word starts and word hashes of their texts."""
    for batch in batches:
        for start, stop in slices(batch.column(text_at)):
            part = batch.slice(start, stop - start)
            starts, words = split_words(part.column(text_at), lower=False)
            yield part, starts, word_hashes(words)


def sha(words: list[bytes]) -> str:
    return hashlib.sha256(b" ".join(words)).hexdigest()


def sketch(docs: DataFrame) -> DataFrame:
    """(id, twin, n_words, sha, anchor, place) of (id, twin, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, starts, words in blocks(batches, 2):
            found = [anchors(words[a:b]) for a, b in zip(starts[:-1], starts[1:], strict=True)]
            digests = [sha((t or "").encode().split()) for t in part.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(1), pa.array(np.diff(starts), pa.int64()), pa.array(digests),
                 lists([f[0].view(np.int64) for f in found], pa.int64()),
                 lists([f[1].astype(np.int32) for f in found], pa.int32())],
                names=["id", "twin", "n_words", "sha", "anchor", "place"])

    return docs.mapInArrow(run, "id bigint, twin int, n_words bigint, sha string, anchor array<bigint>, place array<int>")


def window_hashes(docs: DataFrame) -> DataFrame:
    """(w1, w2, id, spot) of (id, twin, text, places): the windows around the shared anchors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, starts, words in blocks(batches, 2):
            places, out = part.column(3).to_pylist(), []
            ids, twins = part.column(0).to_numpy(), part.column(1).to_numpy().astype(np.int64)
            for n, (a, b) in enumerate(zip(starts[:-1], starts[1:], strict=True)):
                own = words[a:b]
                at = stretches(own, np.array(places[n], np.int64))
                one, two = (rolling(own, WINDOW, base)[at] for base in BASES)
                out.append((one.view(np.int64), (two >> np.uint64(33)).astype(np.int32),
                            np.full(len(at), ids[n]), twins[n] << 32 | at))
            if out:
                w1, w2, own, spot = (np.concatenate(c) for c in zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(w1), pa.array(w2), pa.array(own, pa.int64()), pa.array(spot, pa.int64())],
                    names=["w1", "w2", "id", "spot"])

    return docs.mapInArrow(run, "w1 bigint, w2 int, id bigint, spot bigint")


def merge_spans(removed: DataFrame) -> DataFrame:
    """(id, twin, from, upto) of (id, twin, starts): the maximal repeats as word ranges."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lo, hi = [], []
            for starts in batch.column(2).to_pylist():
                at = np.unique(np.array(starts, np.int64))
                cut = np.flatnonzero(np.diff(at) > WINDOW)
                lo.append(at[np.concatenate([[0], cut + 1])])
                hi.append(at[np.concatenate([cut, [len(at) - 1]])] + WINDOW)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), lists(lo, pa.int64()), lists(hi, pa.int64())],
                names=["id", "twin", "from", "upto"])

    return removed.mapInArrow(run, "id bigint, twin int, from array<bigint>, upto array<bigint>")


def cut_out(docs: DataFrame) -> DataFrame:
    """(id, twin, n_removed, kept_sha256, kept) of (id, twin, text, from, upto)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, stop in slices(batch.column(2)):
                part = batch.slice(start, stop - start)
                gone, kept = [], []
                for text, lo, hi in zip(*(part.column(i).to_pylist() for i in (2, 3, 4)), strict=True):
                    words, last, out = text.encode().split(), 0, []
                    for a, b in zip(lo, hi, strict=True):
                        out += words[last:a]
                        last = b
                    out += words[last:]
                    gone.append(len(words) - len(out))
                    kept.append(b" ".join(out))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(gone, pa.int64()),
                     pa.array([hashlib.sha256(k).hexdigest() for k in kept]), pa.array(kept, pa.binary()).cast(pa.string())],
                    names=["id", "twin", "gone", "left_sha", "kept"])

    return docs.mapInArrow(run, "id bigint, twin int, gone bigint, left_sha string, kept string")


def repeated_spans(texts: DataFrame, sketched: DataFrame, copies: DataFrame) -> DataFrame:
    """(id, twin, from, upto): what documents other than copies repeat of smaller documents."""
    seeds = (sketched.where(f"id IS NOT NULL AND n_words >= {WINDOW}")
             .join(small_side(copies.select("id", "twin"), 24), ["id", "twin"], "left_anti")
             .select("id", "twin", F.explode(F.arrays_zip("anchor", "place")).alias("s"))
             .select("id", "twin", F.col("s.anchor").alias("anchor"), F.col("s.place").alias("place")))
    shared = (seeds.groupBy("anchor").agg(F.min("id").alias("lo"), F.max("id").alias("hi"))
              .where("lo < hi").select("anchor"))
    hits = store(seeds.join(shared, "anchor").groupBy("id", "twin").agg(F.collect_list("place").alias("places")),
                 "seeds")
    windows = store(window_hashes(texts.join(small_side(hits, 64), ["id", "twin"])
                                  .select("id", "twin", "text", "places")), "windows")
    first = windows.groupBy("w1", "w2").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).where("lo < hi")
    starts = (windows.join(first.drop("hi"), ["w1", "w2"]).where("id > lo")
              .groupBy("id", F.shiftright("spot", 32).cast("int").alias("twin"))
              .agg(F.collect_list(F.col("spot").bitwiseAND(0xFFFFFFFF)).alias("starts")))
    return store(merge_spans(starts), "spans")


def drop_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 with_text: bool = False) -> DataFrame:
    """(id, n_words, n_removed, kept_sha256) of every row, with ``with_text`` also the kept words."""
    # The twin tells rows with one id and different texts apart.
    texts = docs.select(F.col(id_col).cast("long").alias("id"),
                        F.xxhash64(text_col).bitwiseAND(0x3FFFFFFF).cast("int").alias("twin"),
                        F.col(text_col).alias("text"))
    sketched = store(sketch(texts), "sketch")
    whole = sketched.where(f"id IS NOT NULL AND n_words >= {WINDOW}").select("id", "twin", "sha")
    first = (whole.groupBy("sha").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).where("lo < hi"))
    copies = store(whole.join(first, "sha").where("id > lo").select("id", "twin").distinct(), "copies")
    spans = repeated_spans(texts, sketched, copies)
    cut = cut_out(texts.join(small_side(spans, 96), ["id", "twin"]).select("id", "twin", "text", "from", "upto"))
    cut = store(cut if with_text else cut.drop("kept"), "cut").dropDuplicates(["id", "twin"])
    out = (sketched.select("id", "twin", "n_words", "sha").join(cut, ["id", "twin"], "left")
           .join(copies.withColumn("copy", F.lit(True)), ["id", "twin"], "left"))
    copy = F.coalesce("copy", F.lit(False))
    cols = [F.col("id").alias(id_col), "n_words",
            F.when(copy, F.col("n_words")).otherwise(F.coalesce("gone", F.lit(0))).cast("long").alias("n_removed"),
            F.when(copy, F.sha2(F.lit(b""), 256)).otherwise(F.coalesce("left_sha", "sha")).alias("kept_sha256")]
    if with_text:
        same = texts.dropDuplicates(["id", "twin"])
        out = out.join(same.withColumnRenamed("text", "_text"), F.expr("true") & out["id"].eqNullSafe(same["id"])
                       & out["twin"].eqNullSafe(same["twin"])).drop(same["id"]).drop(same["twin"])
        plain = F.array_join(F.filter(F.split(F.coalesce("_text", F.lit("")), r"[ \t-\r]+"), lambda w: w != ""), " ")
        cols.append(F.when(copy, F.lit("")).otherwise(F.coalesce("kept", plain)).alias("kept_text"))
    return out.select(*cols)


@query("op7_substrings")
def op7_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drop_repeats(table(spark, sf_dir, "documents"))
