"""Merkle manifest of a dataset: digests of rows, of groups of rows and of the whole.

A leaf is the digest of a row's fields. The rows of a group stand in order, and while a level has
several nodes, every ``FAN`` of them become the digest of their hex strings put together. The last
node of a group is its subroot; the subroots, in order of the group, form a tree of the same kind.

Positions come from one range sort over (group, id), with the offsets of the ranges added, so a
group may span all tasks. Levels are kept as strings: a block of ``BLOCK`` aligned nodes holds a
level as one hex string, in which every node has a fixed width. The parents of a block are digests
of substrings of that string, and the siblings of a node are the substrings beside it. The last
node of each block goes on to the next, ``BLOCK`` times smaller table of blocks, and the proof of
a block's node is handed down from there to all nodes below. DataFrame functions only.

A null field is written as ``-``, so it differs from an empty one. A null group is a group of its
own and comes first, as do rows with a null id in their group; a row without an id is never
tampered with. Rows that share an id are ordered by their leaves; equal rows have equal leaves and
places of their own. An empty table has no rows, and no root. Other columns are not looked at.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from paneltide.llm.common import small_side, store
from paneltide.llm.registry import query, table

#: Nodes that become one, hex digits of a node, and nodes of a block: ``FAN`` times ``FAN``.
FAN, WIDTH = 16, 64
BLOCK = FAN * FAN
RUN = FAN * WIDTH
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
TAMPERED = 5
SEGMENTS = "array<struct<before:string,after:string>>"


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def field(col: Column) -> Column:
    """A field as its byte count, a colon and its value."""
    text = col.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaves(docs: DataFrame, fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """(id, group, row, leaf, changed): ``changed`` is the leaf after tampering, else null.

    The first two fields are the id and the group, the last one is the text.
    """
    id_col, text = F.col(fields[0]), F.col(fields[-1])
    folded = F.translate(text, string.ascii_uppercase, string.ascii_lowercase)
    head = [field(F.col(c)) for c in fields[:-1]]
    hit = F.crc32(id_col.cast("string").cast("binary")) % TAMPERED == 0
    return docs.select(id_col.alias("id"), F.col(fields[1]).cast("string").alias("group"),
                       F.monotonically_increasing_id().alias("row"), digest(*head, field(text)).alias("leaf"),
                       F.when(hit, digest(*head, field(folded))).alias("changed"))


def numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """``rows`` with ``pos`` (from 0, by ``order`` inside ``group``) and ``n``, the group's rows.

    ``order`` is unique. A range of the sort order holds parts of few groups or a part of one.
    """
    keys = [F.col(c).asc_nulls_first() for c in ("group", *order)]
    cut = store(rows.repartitionByRange(*keys).sortWithinPartitions(*keys)
                .withColumn("slice", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id()), "ordered")
    group = Window.partitionBy("group")
    before = group.orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = (cut.groupBy("group", "slice").agg(F.min("at").alias("first"), F.count("*").alias("rows"))
              .select(F.col("group").alias("_group"), F.col("slice").alias("_slice"),
                      (F.coalesce(F.sum("rows").over(before), F.lit(0)) - F.col("first")).alias("shift"),
                      F.sum("rows").over(group).alias("n")))
    same = F.col("group").eqNullSafe(F.col("_group")) & (F.col("slice") == F.col("_slice"))
    return (cut.join(small_side(store(starts, "starts"), 80), same)
            .withColumn("pos", F.col("at") + F.col("shift")).drop("slice", "at", "shift", "_group", "_slice"))


def parents(level: Column) -> Column:
    """The next level of a block's level, both as one hex string."""
    runs = F.sequence(F.lit(0), F.ceil(F.length(level) / RUN).cast("int") - 1)
    return F.array_join(F.transform(runs, lambda i: F.sha2(
        level.substr(i * RUN + 1, F.lit(RUN)).cast("binary"), 256)), "")


def climb(nodes: DataFrame) -> list[DataFrame]:
    """Tables of blocks, from the nodes (group, pos, n, hash, kept) up to the subroots.

    Each has (group, block, n, level0, level1, own): a level is null where the group ends below it;
    ``own`` are the ``kept`` structs of the first table's nodes in order. ``top`` is the block's
    last node: the subroot where ``n`` is at most ``BLOCK``, else a node of the next table.
    """
    most = nodes.agg(F.max("n")).first()[0] or 1
    out = []
    while True:
        block = (F.col("pos") / BLOCK).cast("long")
        inside = F.array_sort(F.collect_list(F.struct("pos", "hash", "kept")))
        rows = (nodes.groupBy("group", block.alias("block")).agg(F.max("n").alias("n"), inside.alias("nodes"))
                .select("group", "block", "n", F.array_join(F.col("nodes.hash"), "").alias("level0"),
                        F.col("nodes.kept").alias("own"))
                .withColumn("level1", F.when(F.col("n") > 1, parents(F.col("level0")))))
        top = (F.when(F.col("n") == 1, F.col("level0")).when(F.col("n") <= FAN, F.col("level1"))
               .otherwise(F.sha2(F.col("level1").cast("binary"), 256)))
        out.append(store(rows.withColumn("top", top), f"blocks{len(out)}"))
        if most <= BLOCK:
            return out
        most = -(-most // BLOCK)
        nodes = out[-1].where(F.col("n") > BLOCK).select(
            "group", F.col("block").alias("pos"), F.ceil(F.col("n") / BLOCK).cast("long").alias("n"),
            F.col("top").alias("hash"), F.lit(0).alias("kept"))


def subroots(blocks: list[DataFrame]) -> DataFrame:
    """(group, hash): one row per group."""
    tops = [b.where(F.col("n") <= BLOCK).select("group", F.col("top").alias("hash")) for b in blocks]
    out = tops[0]
    for more in tops[1:]:
        out = out.unionByName(more)
    return out


def segment(before: Column, after: Column) -> Column:
    return F.array(F.struct(before.alias("before"), after.alias("after")))


def handed_down(blocks: list[DataFrame], tails: DataFrame | None) -> DataFrame:
    """(group, pos, hash, kept, path) of the nodes of the first table of blocks.

    ``path`` has, level by level, the hex strings of the siblings before and after the node or the
    node above it. ``tails`` (group, tail) are the paths of the subroots.
    """
    none = F.array().cast(SEGMENTS)
    above = None
    for rows in reversed(blocks):
        if tails is not None:
            ends = tails.select(F.col("group").alias("_group"), F.col("tail").alias("_end"))
            rows = rows.join(ends, F.col("group").eqNullSafe(F.col("_group")) & (F.col("n") <= BLOCK), "left").drop("_group")
        else:
            rows = rows.withColumn("_end", none)
        if above is not None:
            rows = rows.join(above.select(F.col("group").alias("_group"), F.col("pos").alias("_block"), F.col("path").alias("_path")),
                             F.col("group").eqNullSafe(F.col("_group")) & (F.col("block") == F.col("_block"))
                             & (F.col("n") > BLOCK), "left").drop("_group", "_block")
        else:
            rows = rows.withColumn("_path", F.lit(None).cast(SEGMENTS))
        tail = F.coalesce("_path", "_end", none)
        run = F.col("run")
        one = (rows.withColumn("tail", tail)
               .withColumn("run", F.explode(F.sequence(F.lit(0), F.ceil(F.size("own") / FAN).cast("int") - 1)))
               .select("group", "n", "block", "run", F.slice("own", run * FAN + 1, F.lit(FAN)).alias("own"),
                       F.col("level0").substr(run * RUN + 1, F.lit(RUN)).alias("level"),
                       F.when(F.col("n") > FAN, F.concat(
                           segment(F.col("level1").substr(F.lit(1), run * WIDTH),
                                   F.col("level1").substr((run + 1) * WIDTH + 1, F.lit(RUN))), "tail"))
                       .otherwise(F.col("tail")).alias("tail")))
        at = F.col("i")
        above = (one.select("group", "n", "block", "run", "level", "tail", F.posexplode("own").alias("i", "kept"))
                 .select("group", (F.col("block") * BLOCK + F.col("run") * FAN + at).alias("pos"), "kept",
                         F.col("level").substr(at * WIDTH + 1, F.lit(WIDTH)).alias("hash"),
                         F.when(F.col("n") > 1, F.concat(
                             segment(F.col("level").substr(F.lit(1), at * WIDTH),
                                     F.col("level").substr((at + 1) * WIDTH + 1, F.lit(RUN))), "tail"))
                         .otherwise(F.col("tail")).alias("path")))
    return above


def fold(start: Column, path: Column) -> Column:
    """The root that a leaf and the siblings on its path lead to."""
    return F.aggregate(path, start, lambda node, step: F.sha2(
        F.concat(step["before"], node, step["after"]).cast("binary"), 256))


def manifest(docs: DataFrame, fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """(id, group, leaf, subroot, root, path, proof_sha256, folded_root, verified) of every row."""
    rows = numbered(store(leaves(docs, fields), "leaves"), ["id", "leaf", "row"])
    steps = climb(rows.select("group", "pos", "n", F.col("leaf").alias("hash"), F.struct("id", "changed").alias("kept")))
    tops = store(subroots(steps), "subroots")
    ranked = numbered(tops.select(F.lit("all").alias("group"), F.struct(F.col("group").alias("of"), "hash").alias("kept"),
                                  "hash", F.col("group").alias("of")), ["of"])
    over = climb(ranked.select("group", "pos", "n", "hash", "kept"))
    found = subroots(over).first()
    root = F.lit(found["hash"] if found else None).cast("string")
    tails = store(handed_down(over, None).select(F.col("kept.of").alias("group"), F.col("path").alias("tail"),
                                                 F.col("kept.hash").alias("subroot")), "tails")
    below = handed_down(steps, small_side(tails, 3 * RUN).select("group", "tail"))
    names = small_side(tails, 200).select(F.col("group").alias("_group"), "subroot")
    whole = F.concat_ws("", F.flatten(F.transform("path", lambda s: F.array(s["before"], s["after"]))))
    return (below.join(names, F.col("group").eqNullSafe(F.col("_group")))
            .select(F.col("kept.id").alias("id"), "group", F.col("hash").alias("leaf"), "subroot", root.alias("root"), "path",
                    F.sha2(whole.cast("binary"), 256).alias("proof_sha256"),
                    fold(F.coalesce("kept.changed", "hash"), F.col("path")).alias("folded_root"))
            .withColumn("verified", F.col("folded_root") == F.col("root")))


def manifest_sql(levels: int = 5) -> str:
    """The manifest in SQL, for groups and numbers of groups of up to ``FAN ** levels`` rows."""
    def h(c: str) -> str:
        return f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')"

    fields = " || ".join(h(c) for c in FIELDS[:-1])
    small = f"translate(text, '{string.ascii_uppercase}', '{string.ascii_lowercase}')"
    step = "list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))"
    shifted = ("list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(doc_id AS VARCHAR), ''), "
               "lambda ch: CAST(ord(ch) AS BIGINT))), lambda c, b: " + step + ")")
    ctes = [f"d AS (SELECT doc_id, source AS grp, sha256({fields} || {h('text')}) AS leaf, "
            f"CASE WHEN xor({shifted}, 4294967295) % {TAMPERED} = 0 THEN sha256({fields} || {h(small)}) END AS changed FROM documents)",
            "t0 AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY doc_id NULLS FIRST, leaf) - 1 AS p0, "
            "leaf AS hash, count(*) OVER (PARTITION BY grp) AS n FROM d)",
            "a0 AS (SELECT grp, p0 AS pos, hash, n FROM t0)"]

    def tree(name: str, key: str) -> None:
        for k in range(levels):
            ctes.append(f"{name}r{k} AS (SELECT {key}, pos // {FAN} AS run, list(hash ORDER BY pos) AS h, max(n) AS n "
                        f"FROM {name}{k} GROUP BY ALL)")
            ctes.append(f"{name}{k + 1} AS (SELECT {key}, run AS pos, CASE WHEN n = 1 THEN h[1] ELSE "
                        f"sha256(array_to_string(h, '')) END AS hash, (n + {FAN - 1}) // {FAN} AS n FROM {name}r{k})")

    tree("a", "grp")
    ctes.append(f"b0 AS (SELECT 0 AS one, row_number() OVER (ORDER BY grp NULLS FIRST) - 1 AS pos, hash, "
                f"count(*) OVER () AS n, grp FROM a{levels})")
    tree("b", "one")
    ctes.append("f0 AS (SELECT doc_id, leaf, grp, coalesce(changed, leaf) AS folded, '' AS proof, p0 AS p FROM t0)")
    last, n = "f0", 0

    def walk(name: str, key: str, given: str) -> None:
        nonlocal last, n
        for k in range(levels):
            n += 1
            before, after = f"array_to_string(h[1:p % {FAN}], '')", f"array_to_string(h[p % {FAN} + 2:], '')"
            ctes.append(f"f{n} AS (SELECT f.doc_id, f.leaf, f.grp, {given}, CASE WHEN r.n = 1 THEN folded ELSE "
                        f"sha256({before} || folded || {after}) END AS folded, proof || {before} || {after} AS proof, "
                        f"p // {FAN} AS p FROM {last} f JOIN {name}r{k} r ON {key} AND r.run = p // {FAN})")
            last = f"f{n}"

    walk("a", "f.grp IS NOT DISTINCT FROM r.grp", "1 AS x")
    n += 1
    ctes.append(f"f{n} AS (SELECT f.doc_id, f.leaf, f.grp, b.hash AS subroot, folded, proof, b.pos AS p "
                f"FROM {last} f JOIN b0 b ON f.grp IS NOT DISTINCT FROM b.grp)")
    last = f"f{n}"
    walk("b", "r.one = 0", "subroot")
    return (f"WITH {', '.join(ctes)} SELECT doc_id, leaf, subroot, (SELECT hash FROM b{levels}) AS root, "
            f"sha256(proof) AS proof_sha256, folded AS folded_root, folded = (SELECT hash FROM b{levels}) AS verified FROM {last}")


@query("op12_merkle_manifest", manifest_sql())
def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest(table(spark, sf_dir, "documents")).select(
        F.col("id").alias("doc_id"), "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")
