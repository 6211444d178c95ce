"""Ranked lexical search by pipelined term partitioning.

Terms are dealt to owners by how many documents hold them: the first owner has the rarest terms.
Documents stand in slices, and an owner's posting lists are kept slice by slice, so the list of a
common term is in many tasks. Items travel in bundles from owner to owner. A bundle carries, per
slice, a sparse accumulator for every item: documents and scores so far. At each stage, bundles
and the owner's lists meet in a cogroup, and whole-number contributions are added.

Before a stage, the tenth best score of an item so far is known over all slices. What the later
owners can add at most is known as well; a document that cannot reach the tenth score with it is
let go. That bound is exact, so the result is that of full scoring. Rare terms come first, which
makes it sharp before the long lists are read.

Documents without a term (null, empty) count nowhere. A document without an id counts in all
statistics and ranks after others of its score. Rows that share an id are documents of their own,
equal rows in no order. Items that share an id are one item with the terms of all; items without
an id, text or term have no result. Other columns are not looked at.
"""

from __future__ import annotations

import re
from array import array
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from paneltide.llm.common import BROADCAST_BYTES, small_side, store
from paneltide.llm.registry import query, table

#: The terms of a text, as characters and as UTF-8 bytes; constants of the score.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
TERM_BYTES = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
SCALE, TF_SCALE, LENGTH_SCALE, LENGTH_SHARE = 1_000_000_000, 1000, 8, 90

#: Documents of a slice, and items of a bundle, about.
SLICE_DOCS, BUNDLE_ITEMS = 1 << 14, 256
#: An owner has the terms in up to this share of the documents; the last owner has the rest.
OWNERS = (1 / 1024, 1 / 64, 1 / 8)

LISTS = ("slice bigint, term string, docs array<int>, tf array<int>, sizes array<int>, top_tf int, low_size int, "
         "ids array<{kind}>")


def terms(text: Column) -> Column:
    import string

    return F.regexp_extract_all(F.translate(text, string.ascii_uppercase, string.ascii_lowercase), F.lit(TERM), F.lit(0))


def posting_lists(docs: DataFrame, asked: frozenset[bytes] | None) -> DataFrame:
    """The lists of the ``asked`` terms (all if None) of (id, text), slice by slice.

    Of every slice there is also a row without a term: the ids of its documents in order, and
    their sizes in terms. Places in a list are places in that order.
    """
    from pyspark import TaskContext

    kind = docs.schema["id"].dataType.simpleString()
    key = pa.int64() if kind == "bigint" else pa.int32() if kind == "int" else pa.string()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        ids, sizes, held = [], array("i"), defaultdict(lambda: (array("i"), array("i")))

        def flush() -> pa.RecordBatch:
            nonlocal number, ids, sizes, held
            order = sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] if ids[i] is not None else 0))
            place = np.empty(len(ids), np.int32)
            place[order] = np.arange(len(ids), dtype=np.int32)
            size = np.frombuffer(sizes, np.int32)
            names, own = list(held), [place[np.frombuffer(d, np.int32)] for d, _ in held.values()]
            tf = [np.frombuffer(t, np.int32) for _, t in held.values()]
            n_of = [size[np.frombuffer(d, np.int32)] for d, _ in held.values()]
            none = [None]
            batch = pa.RecordBatch.from_arrays(
                [pa.array([number] * (len(names) + 1), pa.int64()),
                 pa.array([n.decode("utf-8") for n in names] + none, pa.string()),
                 pa.array(own + none, pa.list_(pa.int32())), pa.array(tf + none, pa.list_(pa.int32())),
                 pa.array(n_of + [size[order]], pa.list_(pa.int32())),
                 pa.array([int(t.max()) for t in tf] + none, pa.int32()),
                 pa.array([int(n.min()) for n in n_of] + none, pa.int32()),
                 pa.array([None] * len(names) + [[ids[i] for i in order]], pa.list_(key))],
                names=["slice", "term", "docs", "tf", "sizes", "top_tf", "low_size", "ids"])
            number += 1
            ids, sizes, held = [], array("i"), defaultdict(lambda: (array("i"), array("i")))
            return batch

        for batch in batches:
            for at, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                raw = text.as_buffer()
                found = TERM_BYTES.findall(raw.to_pybytes().lower()) if raw is not None else []
                if not found:
                    continue
                for term, n in Counter(found if asked is None else filter(asked.__contains__, found)).items():
                    docs_of, tf_of = held[term]
                    docs_of.append(len(ids))
                    tf_of.append(n)
                ids.append(at)
                sizes.append(len(found))
                if len(ids) == SLICE_DOCS:
                    yield flush()
        if ids:
            yield flush()

    return docs.mapInArrow(run, LISTS.format(kind=kind))


def impact(tf: np.ndarray, size: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """What a term of weight 1 adds to documents that hold it ``tf`` times, in 64-bit integers."""
    m = 100 - LENGTH_SHARE + LENGTH_SHARE * size.astype(np.int64) * n_docs // n_terms
    tf = tf.astype(np.int64)
    return SCALE * tf // (TF_SCALE * tf + LENGTH_SCALE * m)


def lists_of(col: pa.ChunkedArray) -> list[np.ndarray]:
    whole = col.combine_chunks()
    flat, ends = whole.flatten().to_numpy(zero_copy_only=False), whole.offsets.to_numpy()
    return [flat[a - ends[0]:b - ends[0]] for a, b in zip(ends[:-1], ends[1:], strict=True)]


ACCUMULATORS = "bundle bigint, slice bigint, item {kind}, docs array<int>, scores array<bigint>, best array<bigint>"


def stage(carried: DataFrame | None, lists: DataFrame, k: int, n_docs: int, n_terms: int, kind: str) -> DataFrame:
    """The accumulators after an owner: ``carried`` plus contributions of ``lists``.

    ``carried``: (bundle, slice, item, docs, scores, least, after); ``lists``: (bundle, slice, w, docs,
    tf, sizes, items), where ``items`` are structs (item, least, before, after). A score of less than
    ``least`` with all that can come ``after`` is dropped.
    """
    schema = ACCUMULATORS.format(kind=kind)
    kinds = pa.schema([("bundle", pa.int64()), ("slice", pa.int64()),
                       ("item", {"bigint": pa.int64(), "int": pa.int32()}.get(kind, pa.string())),
                       ("docs", pa.list_(pa.int32())), ("scores", pa.list_(pa.int64())), ("best", pa.list_(pa.int64()))])

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        own: dict = {}
        if len(left):
            for item, docs, scores, least, after in zip(
                    left.column("item").to_pylist(), lists_of(left.column("docs")), lists_of(left.column("scores")),
                    left.column("least").to_pylist(), left.column("after").to_pylist(), strict=True):
                own[item] = [docs, scores, least, after, True, []]
        added: list[tuple[np.ndarray, np.ndarray]] = []
        if len(right):
            for w, docs, tf, sizes, items in zip(
                    right.column("w").to_pylist(), lists_of(right.column("docs")), lists_of(right.column("tf")),
                    lists_of(right.column("sizes")), right.column("items").to_pylist(), strict=True):
                for it in items:
                    # Documents that only now appear count if this and later owners can lift them.
                    mine = own.setdefault(it["item"], [np.zeros(0, np.int32), np.zeros(0, np.int64),
                                                       it["least"], it["after"], True, []])
                    mine[4] = it["before"] >= it["least"]
                    mine[5].append(len(added))
                added.append((docs, w * impact(tf, sizes, n_docs, n_terms)))
        width = 1 + max([int(d.max()) for d, _ in added if len(d)] + [int(o[0].max()) for o in own.values() if len(o[0])] + [-1])
        total = np.zeros(width, np.int64)
        out = []
        for item, (docs, scores, least, after, fresh, terms_of) in own.items():
            total[:] = 0
            total[docs] = scores
            for n in terms_of:
                total[added[n][0]] += added[n][1]
            reach = np.flatnonzero(total > 0) if fresh else docs
            score = total[reach]
            if len(score) > k:  # the tenth of the slice bounds the tenth of all from below
                least = max(least, int(np.partition(score, -k)[-k]))
            keep = score + after >= least
            reach, score = reach[keep].astype(np.int32), score[keep]
            best = np.sort(score)[::-1][:k]
            if after == 0:  # nothing follows: the first k of the slice, equal scores by id
                first = np.lexsort((reach, -score))[:k]
                reach, score = reach[first], score[first]
            if len(reach):
                out.append((item, reach, score, best))
        key = left if len(left) else right
        at = {c: key.column(c)[0].as_py() for c in ("bundle", "slice")}
        return pa.table([pa.array([at[c]] * len(out), pa.int64()) for c in ("bundle", "slice")]
                        + [pa.array([o[n] for o in out], kinds.field(n + 2).type) for n in range(4)], schema=kinds)

    by = lists.groupBy("bundle", "slice")
    return carried.groupBy("bundle", "slice").cogroup(by).applyInArrow(meet, schema)


def tenth(carried: DataFrame, k: int) -> DataFrame:
    """(item, least): the k-th best score of each item so far, where it has so many."""
    def top(rows: DataFrame, *by: str) -> DataFrame:
        return rows.groupBy(*by).agg(F.slice(F.sort_array(F.flatten(F.collect_list("best")), asc=False), 1, k).alias("best"))

    part = top(carried.select("item", F.pmod(F.xxhash64("slice"), F.lit(256)).alias("part"), "best"), "item", "part")
    return top(part, "item").where(F.size("best") >= k).select("item", F.col("best")[k - 1].alias("least"))


def search(docs: DataFrame, items: DataFrame, k: int = 10, doc_col: str = "doc_id", item_col: str = "item_id",
           text_col: str = "text") -> DataFrame:
    """(item, rank, doc, score): the ``k`` best documents of every item."""
    spark = docs.sparkSession
    asked = store(items.where(F.col(item_col).isNotNull())
                  .select(F.col(item_col).alias("item"), F.explode(terms(F.col(text_col))).alias("term")).distinct(), "asked")
    kind, doc_kind = asked.schema["item"].dataType.simpleString(), docs.schema[doc_col].dataType.simpleString()
    names = asked.select("term").distinct()
    extent = names.agg(F.coalesce(F.sum(F.octet_length("term") + 64), F.lit(0))).first()[0]
    # Past that size, all terms are listed and the join below picks the asked ones.
    known = (frozenset(r.term.encode() for r in names.toLocalIterator()) if extent <= BROADCAST_BYTES else None)
    lists = store(posting_lists(docs.select(F.col(doc_col).alias("id"), F.col(text_col).alias("text")), known), "lists")
    totals = lists.where("term IS NULL").agg(
        F.sum(F.size("sizes")).alias("n"), F.sum(F.expr("aggregate(sizes, 0L, (a, x) -> a + x)")).alias("terms")).first()
    n_docs, n_terms = int(totals.n or 0), int(totals.terms or 0)
    share = F.col("df") / F.lit(float(max(n_docs, 1)))
    owner = F.lit(len(OWNERS))
    for i in reversed(range(len(OWNERS))):
        owner = F.when(share <= OWNERS[i], F.lit(i)).otherwise(owner)
    m = F.lit(100 - LENGTH_SHARE) + F.expr(f"({LENGTH_SHARE}L * low_size * {n_docs}L) div {max(n_terms, 1)}L")
    weighed = (lists.where("term IS NOT NULL").groupBy("term")
               .agg(F.sum(F.size("docs")).alias("df"), F.max("top_tf").cast("long").alias("tf"), F.min("low_size").alias("low_size"))
               .withColumn("w", F.floor(F.lit(1000.0) * F.log(F.lit(float(2 * n_docs + 2)) / (2 * F.col("df") + 1))).cast("long"))
               .where("w > 0").withColumn("m", m)
               .select("term", "w", owner.alias("owner"),
                       F.expr(f"w * (({SCALE}L * tf) div ({TF_SCALE} * tf + {LENGTH_SCALE} * m))").alias("most")))
    n_bundles = -(-asked.select("item").distinct().count() // BUNDLE_ITEMS) or 1
    wanted = store(asked.join(weighed, "term").withColumn("bundle", F.pmod(F.xxhash64("item"), F.lit(n_bundles))), "wanted")
    bounds = store(wanted.groupBy("item").agg(F.array(*[F.coalesce(F.sum(F.when(F.col("owner") >= i, F.col("most"))), F.lit(0))
                                                      for i in range(len(OWNERS) + 2)]).alias("rest")), "bounds")

    carried = spark.createDataFrame([], ACCUMULATORS.format(kind=kind))
    for i in range(len(OWNERS) + 1):
        known_least = store(bounds.join(tenth(carried, k), "item", "left").select(
            "item", F.coalesce("least", F.lit(1)).cast("long").alias("least"), F.col("rest")[i].alias("before"),
            F.col("rest")[i + 1].alias("after")), "least")
        sharp = small_side(known_least, 64)
        routed = store(wanted.where(F.col("owner") == i).join(sharp, "item").groupBy("bundle", "term", "w")
                       .agg(F.collect_list(F.struct("item", "least", "before", "after")).alias("items")), "routed")
        met = (lists.where("term IS NOT NULL").select("slice", "term", "docs", "tf", "sizes")
               .join(small_side(routed, 64 + 32 * BUNDLE_ITEMS), "term"))
        bundles = carried.join(sharp.select("item", "least", "after"), "item")
        carried = store(stage(bundles, met, k, n_docs, n_terms, kind), f"stage{i}")
    ids = lists.where("term IS NULL").select("slice", "ids")
    found = (carried.select("slice", "item", F.explode(F.arrays_zip("docs", "scores")).alias("d")).join(ids, "slice")
             .select("item", F.get("ids", F.col("d.docs")).alias("id"), F.col("d.scores").alias("score")))
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.col("id").asc_nulls_last())
    return (found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            .select(F.col("item").alias(item_col), "rank", F.col("id").cast(doc_kind).alias(doc_col), "score"))


SQL = r"""
WITH b AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t FROM documents),
d AS (SELECT row_number() OVER () AS r, doc_id, t, len(t) AS n FROM b WHERE len(t) > 0),
s AS (SELECT CAST(count(*) AS BIGINT) AS nn, CAST(sum(n) AS BIGINT) AS l FROM d),
p AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(t) AS term FROM d) GROUP BY ALL),
w AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * nn + 2 AS DOUBLE) / (2 * count(*) + 1))) AS BIGINT) AS w
  FROM p, s GROUP BY term, nn),
q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
  'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark WHERE item_id IS NOT NULL),
x AS (SELECT item_id, r, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * nn) // l)))) AS BIGINT) AS score
  FROM q JOIN p USING (term) JOIN w USING (term) JOIN d USING (r), s GROUP BY item_id, r),
o AS (SELECT item_id, doc_id, score, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank
  FROM x JOIN d USING (r) WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM o WHERE rank <= 10"""


@query("op13_lexical_search", SQL)
def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
