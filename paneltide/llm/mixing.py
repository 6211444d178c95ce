"""Mixing sources to target weights by weighted fair queueing.

Within a source the documents stand in a shuffled order, fixed by a digest of the id. A document
finishes at the virtual time (words of its source up to its end) / (target of the source); a
source that may repeat goes on with a second pass in the same order. All takes are sorted by
finish time and taken while the total stays within the budget, so every source ends within one
document of its target. Running sums never gather a source or the whole corpus in one task:
the order is cut into ranges, the sums of the ranges are added up, and only the rows of one
range stand in a window.

Null text has size 0, and documents of size 0 are never taken (there is nothing to take). A null
source is a source of its own, after all others. Rows with a null id, or with a repeated id,
are documents of their own; the order among equal ones does not matter, as it is broken by size.
Only rows that are equal in id, source and size share one decision order. An empty table gives
an empty mix.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from paneltide.llm.common import WORD, small_side, store
from paneltide.llm.registry import query, table

WEIGHTS = (3, 1, 2)
#: Share of all words that the mix holds, and passes over a document at most.
TOTAL_SHARE = 1.5
PASSES = 2
#: Rows of one range of the order, about.
RANGE_ROWS = 20_000
SEED = "mix-1"
#: Values of the digest that orders documents: 60 bits.
DIGEST_BITS = 60


def digest(id_col: Column, salt: str) -> Column:
    """A number from the id, evenly spread below 2^60."""
    text = F.concat(F.coalesce(id_col.cast("string"), F.lit("null")), F.lit(salt))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, DIGEST_BITS // 4), 16, 10).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, total_share: float = TOTAL_SHARE,
                   passes: int = PASSES) -> DataFrame:
    """(source, source_size, target) of (source, size): the level at which ``weight * level``,
    cut at ``passes`` times the source's size, sums to the total.

    One row per source; sources with the smallest size per weight reach their end first.
    """
    by = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    by = by.withColumn("weight", F.element_at(F.array(*[F.lit(w) for w in weights]),
                                              (place % len(weights) + 1).cast("int")).cast("double"))
    order = Window.orderBy((F.col("source_size") / F.col("weight")), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    by = (by.withColumn("all_size", F.sum("source_size").over(everything))
          .withColumn("full_before", F.coalesce(F.sum("source_size").over(before), F.lit(0)))
          .withColumn("weight_left", F.sum("weight").over(after))
          # The level if this source and all later ones stayed below their ends.
          .withColumn("level", (F.col("all_size") * F.lit(total_share) - F.col("full_before") * F.lit(float(passes)))
                      / F.col("weight_left")))
    open_ = F.col("level") * F.col("weight") <= F.col("source_size") * F.lit(float(passes))
    return (by.withColumn("level_found", F.min(F.when(open_, F.struct("full_before", "level"))).over(everything)["level"])
            .withColumn("target", F.least(F.col("source_size") * F.lit(float(passes)),
                                          F.coalesce(F.col("level_found") * F.col("weight"),
                                                     F.col("source_size") * F.lit(float(passes)))))
            .select("source", "source_size", "target"))


def running_sum(df: DataFrame, name: str, group: list[str], bucket: str, order: list, value: str) -> DataFrame:
    """``df`` with ``name``: the sum of ``value`` up to each row, in each group, by bucket and order.

    ``bucket`` numbers ranges of the order from 0 to the number of ranges; only the ranges' sums
    stand in a window of the group.
    """
    sums = df.groupBy(*group, bucket).agg(F.sum(value).alias("_part"))
    before = Window.partitionBy(*group).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    base = sums.withColumn("_base", F.coalesce(F.sum("_part").over(before), F.lit(0))).drop("_part")
    inside = Window.partitionBy(*group, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return (df.join(base, [*group, bucket]).withColumn(name, F.col("_base") + F.sum(value).over(inside))
            .drop("_base"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, total_share: float = TOTAL_SHARE,
        passes: int = PASSES, id_col: str = "doc_id", text_col: str = "text",
        source_col: str = "source") -> DataFrame:
    """(id, size, source_size, target, taken) of every row, and ``source``."""
    rows = store(docs.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"),
                             F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
                             digest(F.col(id_col), SEED).alias("place")), "sizes")
    targets = store(source_targets(rows, weights, total_share, passes)
                    .withColumn("number", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))),
                    "targets")
    n_ranges = max(1, rows.count() // RANGE_ROWS)
    # Ranges of a source's order: the digest is even, so they are about equal.
    wide = (rows.join(small_side(targets, 200), rows["source"].eqNullSafe(targets["source"]))
            .select("id", rows["source"], "size", "place", "source_size", "target", "number",
                    F.floor(F.col("place") / F.lit(float(2 ** DIGEST_BITS)) * n_ranges).cast("long").alias("range")))
    ordered = running_sum(wide, "upto", ["number"], "range",
                          ["place", F.col("id").asc_nulls_last(), "size"], "size")
    ordered = store(ordered.drop("range"), "ordered")
    # Takes of all passes on the common clock.
    takes = (ordered.where("size > 0").withColumn("pass", F.explode(F.array(*[F.lit(i) for i in range(passes)])))
             .withColumn("finish", (F.col("upto") + F.col("pass") * F.col("source_size")) / F.col("target")))
    takes = takes.withColumn("range", F.floor(F.col("finish") * n_ranges).cast("long")).withColumn("all", F.lit(0))
    clock = running_sum(takes, "total", ["all"], "range",
                        ["finish", "number", "place", F.col("id").asc_nulls_last(), "size", "pass"], "size")
    budget = targets.agg(F.sum("target").alias("budget"))
    taken = (clock.join(F.broadcast(budget), F.col("total") <= F.col("budget"))
             .select("number", "place", "id", "size", "upto", "pass"))
    key = ["number", "place", "upto", "size"]
    count = taken.groupBy("id", *key).agg(F.count("*").alias("times")).select(
        "times", *[F.col(c).alias(f"_{c}") for c in ("id", *key)])
    same = F.expr(" AND ".join(f"{c} <=> _{c}" for c in ("id", *key)))
    return (ordered.join(count, same, "left")
            .select(F.col("id").alias(id_col), "source", "size", "source_size", "target",
                    (F.col("size") * F.coalesce("times", F.lit(0))).cast("long").alias("taken")))


SQL = """
WITH d AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size,
  CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR) || 'mix-1'), 1, 15) AS BIGINT) AS place FROM documents),
s0 AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
s1 AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS number FROM s0),
s2 AS (SELECT *, CAST([3, 1, 2][CAST((number - 1) % 3 + 1 AS INTEGER)] AS DOUBLE) AS weight FROM s1),
s3 AS (SELECT *, CAST(sum(source_size) OVER () AS BIGINT) AS all_size,
  CAST(coalesce(sum(source_size) OVER (ORDER BY source_size / weight, number
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS full_before,
  sum(weight) OVER (ORDER BY source_size / weight, number ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weight_left
  FROM s2),
s4 AS (SELECT *, (all_size * CAST(1.5 AS DOUBLE) - full_before * CAST(2 AS DOUBLE)) / weight_left AS level FROM s3),
s5 AS (SELECT *, (SELECT arg_min(level, full_before) FROM s4 WHERE level * weight <= source_size * CAST(2 AS DOUBLE)) AS found FROM s4),
t AS (SELECT source, number, source_size,
  least(source_size * CAST(2 AS DOUBLE), coalesce(found * weight, source_size * CAST(2 AS DOUBLE))) AS target FROM s5),
o AS (SELECT d.*, number, source_size, target,
  sum(size) OVER (PARTITION BY number ORDER BY place, doc_id, size ROWS UNBOUNDED PRECEDING) AS upto
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
k AS (SELECT o.*, pass, CAST(upto + pass * source_size AS DOUBLE) / target AS finish
  FROM o, (SELECT unnest([0, 1]) AS pass) WHERE size > 0),
c AS (SELECT *, sum(size) OVER (ORDER BY finish, number, place, doc_id, size, pass ROWS UNBOUNDED PRECEDING) AS total FROM k),
n AS (SELECT doc_id, place, number, count(*) AS times FROM c WHERE total <= (SELECT sum(target) FROM t) GROUP BY ALL)
SELECT o.doc_id, o.size, o.source_size, o.target, CAST(o.size * coalesce(n.times, 0) AS BIGINT) AS taken
FROM o LEFT JOIN n USING (doc_id, place, number)"""


@query("op8_mixing", SQL)
def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")
