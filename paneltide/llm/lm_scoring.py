"""LM scoring: online logistic mixing of hashed-context bit predictors.

1. Words are counted over all training texts; the most frequent ones form the lexicon.
2. Each training shard goes through its texts in order: slot counts are updated piece by piece,
   and on every piece the mixing weights take gradient steps on predictions made before that
   piece is counted. The first pieces are small, later ones grow up to a batch. Spellings depend on the word alone, so shards
   of the table of counts learn them, each distinct word with its count. Spark sums the slot counts of all shards and averages the weights.
3. Every text is scored with the finished model: log probabilities of its bits are summed. The
   unigram baseline needs exact counts, so words outside the lexicon are joined with the table
   of all counts; behind that join, sorted by word, they are spelled.

Scored are the lower-cased words and the end of a text, as in the baseline; how much white space
separates words is not part of either. A null text scores like an empty one: its end alone. A
null id counts as remainder 0, so it is a training text. Repeated rows are scored each. With no
training text all counts are 0. The model has a fixed size (``SLOT_BITS``, ``LEXICON``); what is
counted into it grows with the corpus.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from paneltide.llm.common import remainder, slices, split_words, store
from paneltide.llm.mixing_model import (BATCH, CONTEXTS, END, GATES, SLOT_BITS, STEPS, Decisions, Lexicon, Mixer,
                                        block_parts, looked_up, shared_decisions, state, states_of)
from paneltide.llm.registry import query, table

LEXICON = (1 << 16) - 2
#: Longer words are always spelled, which bounds the lexicon's bytes.
LEXICON_WORD_BYTES = 64
#: Text whose bits a worker holds at once.
BLOCK_BYTES = 1 << 18
#: Words that are spelled at once.
SPELLED_BYTES = 1 << 16
#: Bits of the first piece; a later one has at most as many as were counted before, over ``GROWTH``.
FIRST_PIECE, GROWTH = 1 << 10, 4
CHUNK_BITS = 14
#: Distinct words that a task counts before it passes the counts on.
COUNTED = 150_000


def count_words(texts: DataFrame) -> DataFrame:
    """(word, n) of (text); the end of a text counts as the empty word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []

        def merged() -> pa.Table:
            return pa.concat_tables(held).group_by("word").aggregate([("n", "sum")]).rename_columns(["word", "n"])

        size = 0
        for batch in batches:
            for start, stop in slices(batch.column(0)):
                starts, words = split_words(batch.column(0).slice(start, stop - start), lower=True)
                counts = pc.value_counts(words)
                held.append(pa.table({
                    "word": pa.concat_arrays([counts.field("values"), pa.array([END], pa.large_string())]),
                    "n": pa.concat_arrays([counts.field("counts"), pa.array([len(starts) - 1], pa.int64())])}))
                size += len(held[-1])
                if size > COUNTED:
                    held = [merged()]
                    size = len(held[0])
                    if size > COUNTED // 2:
                        yield from held.pop().cast(pa.schema({"word": pa.string(), "n": pa.int64()})).to_batches()
                        size = 0
        if held:
            yield from merged().cast(pa.schema({"word": pa.string(), "n": pa.int64()})).to_batches()

    return texts.mapInArrow(run, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def make_lexicon(counts: DataFrame) -> tuple[Lexicon, int, int]:
    """The lexicon, the number of training tokens and of distinct ones."""
    total = counts.agg(F.sum("n").alias("n"), F.count("*").alias("v")).first()
    words = counts.where((F.col("word") != END) & (F.octet_length("word") <= LEXICON_WORD_BYTES))
    # The least count that at most LEXICON words reach: one row per distinct count is ordered.
    above = F.sum("words").over(Window.orderBy(F.desc("n")))
    least = (words.groupBy("n").agg(F.count("*").alias("words")).withColumn("above", above)
             .where(F.col("above") <= LEXICON).agg(F.min("n")).first()[0])
    top = (words.where(F.col("n") >= (least if least is not None else 1 << 62)).toPandas()
           .sort_values(["n", "word"], ascending=[False, True]))
    end = counts.where(F.col("word") == END).first()
    words, n = [END, *top["word"]], np.array([end.n if end else 0, *top["n"]], np.int64)
    n_all = int(total.n or 0)
    return Lexicon(words, n, max(1, n_all - int(n.sum()))), n_all, int(total.v)


def add_slices(sums: Iterator[tuple[int, bytes]]) -> Iterator[tuple[int, np.ndarray, np.ndarray | None]]:
    """Sums of the arrays of equal chunks; equal chunks come one after another.

    Slots of one shard hold uses and ones in halves of a number; over all shards they are summed
    apart, each in 64 bits. Other numbers have no second part.
    """
    at, first, second = None, None, None
    for chunk, raw in sums:
        if chunk >= 0:
            cell = np.frombuffer(raw, np.uint64)
            one, two = cell >> np.uint64(32), cell & np.uint64(0xFFFFFFFF)
        else:
            one, two = np.frombuffer(raw, np.float64).copy(), None
        if chunk == at:
            first += one
            if two is not None:
                second += two
        else:
            if at is not None:
                yield at, first, second
            at, first, second = chunk, one, two
    if at is not None:
        yield at, first, second


def train(texts: DataFrame, lexicon: Lexicon, counts: DataFrame | None = None) -> tuple[list[np.ndarray], Mixer]:
    """Slot states of the contexts and the mixer; ``counts`` (word, n) are those of ``texts``."""
    spark = texts.sparkSession
    sent = spark.sparkContext.broadcast(lexicon)
    counts = store(count_words(texts), "words") if counts is None else counts

    def paths(batches: Iterator[pa.RecordBatch]) -> Iterator[Decisions]:
        for batch in batches:
            for start, stop in slices(batch.column(0), BLOCK_BYTES):
                starts, words = split_words(batch.column(0).slice(start, stop - start), lower=True)
                yield block_parts(sent.value, starts, words)[2]

    def spellings(batches: Iterator[pa.RecordBatch]) -> Iterator[Decisions]:
        """Every distinct word once as a new one, then as often as it comes again."""
        for batch in batches:
            for start, stop in slices(batch.column(0), SPELLED_BYTES):
                part = batch.slice(start, stop - start)
                words = part.column(0).cast(pa.large_string())
                lacking = np.flatnonzero(sent.value.symbols(words) == len(sent.value.words))
                again = part.column(1).to_numpy()[lacking] - 1
                for own, times in ((lacking, np.ones(len(lacking))), (lacking[again > 0], again[again > 0])):
                    if len(own):
                        yield shared_decisions(sent.value, words.take(pa.array(own)), times)[0]

    def shard(decisions: Iterator[Decisions]) -> Iterator[pa.RecordBatch]:
        # A slot's uses in the upper and its ones in the lower half.
        tables = [np.zeros(1 << SLOT_BITS, np.uint64) for _ in range(CONTEXTS)]
        mixer, counted = Mixer(), [0, 0]

        def take(d: Decisions) -> None:
            start = 0
            while start < len(d.bit):
                stop = min(len(d.bit), start + BATCH, start + max(FIRST_PIECE, counted[d.spelled] // GROWTH))
                piece(d, slice(start, stop))
                counted[d.spelled] += stop - start
                start = stop

        def piece(d: Decisions, part: slice) -> None:
            """Predict and learn, then count."""
            bit, weight, slots = d.bit[part], d.weight[part], [at[part].astype(np.intp) for at in d.slots]
            mixer.learn([states_of(looked_up(own, at)) for own, at in zip(tables, slots, strict=True)], bit, weight, d.spelled)
            use = (np.uint64(1 << 32) | bit.astype(np.uint64))
            if d.spelled:
                use *= weight.astype(np.uint64)
            for own, at in zip(tables, slots, strict=True):
                np.add.at(own, at, use)

        for d in decisions:
            take(d)
        step = 1 << CHUNK_BITS
        for k, own in enumerate(tables):
            for n in range(0, len(own), step):
                if own[n:n + step].any():
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([(k << SLOT_BITS | n) >> CHUNK_BITS], pa.int32()),
                         pa.array([own[n:n + step].tobytes()], pa.binary())], names=["chunk", "sums"])
        mass = mixer.seen.sum(axis=1)
        sums = np.concatenate([(mixer.weights * mass[:, None]).ravel(), mass, mixer.seen.ravel(), mixer.ones.ravel()])
        yield pa.RecordBatch.from_arrays([pa.array([-1], pa.int32()), pa.array([sums.tobytes()], pa.binary())],
                                         names=["chunk", "sums"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True))
        for chunk, total, ones in add_slices(rows):
            if ones is not None:
                total = state(total.astype(np.float64), ones.astype(np.float64)).astype(np.int16)
            yield pa.RecordBatch.from_arrays([pa.array([chunk], pa.int32()), pa.array([total.tobytes()], pa.binary())],
                                             names=["chunk", "sums"])

    def shards(rows: DataFrame, decisions) -> DataFrame:
        few = rows.coalesce(max(spark.sparkContext.defaultParallelism, rows.rdd.getNumPartitions() // 4))
        return few.mapInArrow(lambda batches: shard(decisions(batches)), "chunk int, sums binary")

    summed = store(shards(texts, paths).unionByName(shards(counts.select("word", "n"), spellings)).repartition("chunk")
                   .sortWithinPartitions("chunk").mapInArrow(add, "chunk int, sums binary"), "model")
    states = np.zeros(CONTEXTS << SLOT_BITS, np.int16)
    mixer, step = Mixer(), 1 << CHUNK_BITS
    for row in summed.toLocalIterator():
        if row.chunk >= 0:
            states[row.chunk * step:(row.chunk + 1) * step] = np.frombuffer(row.sums, np.int16)
        else:
            sums = np.frombuffer(row.sums, np.float64)
            own, mass, rest = np.split(sums, [GATES * CONTEXTS, GATES * (CONTEXTS + 1)])
            known = mass > 0
            mixer.weights[known] = own.reshape(GATES, CONTEXTS)[known] / mass[known, None]
            mixer.seen, mixer.ones = (x.reshape(GATES, STEPS).copy() for x in np.split(rest, 2))
    return np.split(states, CONTEXTS), mixer.close()


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 5,
          held_fold: int = 1) -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte) of every
    row; the model learns from the rows whose id has another remainder than ``held_fold``."""
    teaching = docs.where(remainder(F.col(id_col), folds) != held_fold).select(F.col(text_col).alias("text"))
    counts = store(count_words(teaching), "words")
    lexicon, n_all, n_distinct = make_lexicon(counts)
    states, mixer = train(teaching, lexicon, counts)
    sent = docs.sparkSession.sparkContext.broadcast((lexicon, states, mixer))
    per_token = math.log10(n_all + 0.5 * (n_distinct + 1))

    def log_prob(d: Decisions, n: int) -> np.ndarray:
        _, states, mixer = sent.value
        own = np.zeros(len(d.bit))
        for a in range(0, len(own), BATCH):
            part = slice(a, a + BATCH)
            own[part] = mixer.log_prob([looked_up(s, at[part]) for s, at in zip(states, d.slots, strict=True)], d.bit[part], d.spelled)
        return np.bincount(d.owner, own, n)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        lexicon = sent.value[0]
        log_count = np.append(np.log10(lexicon.counts + 0.5), 0.0)
        known = np.append((lexicon.counts > 0).astype(np.int64), 0)
        row = TaskContext.get().partitionId() << 40

        for batch in batches:
            for start, stop in slices(batch.column(1), BLOCK_BYTES):
                part = batch.slice(start, stop - start)
                starts, words = split_words(part.column(1), lower=True)
                tokens, symbols, path, rare, number, places = block_parts(lexicon, starts, words)
                per = log_prob(path, len(symbols))
                first, n_docs = tokens[:-1], len(tokens) - 1
                total = np.add.reduceat(per, first) / math.log(10)
                # Words outside the lexicon, once per document.
                doc = np.searchsorted(tokens, places, side="right") - 1
                pair, n = np.unique(doc * max(1, len(rare)) + number, return_counts=True)
                ends = np.searchsorted(pair // max(1, len(rare)), np.arange(n_docs + 1)).astype(np.int32)
                names = (rare.cast(pa.string()).take(pa.array(pair % max(1, len(rare)))) if len(rare)
                         else pa.array([], pa.string()))
                ends = pa.array(ends, pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(np.arange(row, row + n_docs)), pa.array(np.diff(tokens)),
                     pa.array(np.add.reduceat(known[symbols], first)),
                     pa.array(np.add.reduceat(log_count[symbols], first)), pa.array(total),
                     pc.fill_null(pc.binary_length(part.column(1)), 0).cast(pa.int64()),
                     pa.ListArray.from_arrays(ends, names), pa.ListArray.from_arrays(ends, pa.array(n, pa.int64()))],
                    names=["id", "row", "n_tokens", "n_known", "base", "score", "n_bytes", "rare", "rare_n"])
                row += n_docs

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The words' log10 probabilities behind the escape; rows come sorted by word."""
        for batch in batches:
            for start, stop in slices(batch.column(0), SPELLED_BYTES):
                part = batch.slice(start, stop - start)
                coded = part.column(0).cast(pa.large_string()).dictionary_encode()
                words = coded.dictionary
                own, word, owner = shared_decisions(sent.value[0], words, np.ones(len(words)))
                per_byte = log_prob(own, int(owner.max()) + 1)[owner]
                per_word = np.bincount(word, per_byte, len(words)) / math.log(10)
                yield pa.RecordBatch.from_arrays([*part.columns[1:], pa.array(per_word[coded.indices.to_numpy()])],
                                                 names=["row", "times", "n", "spelled"])

    kind = docs.schema[id_col].dataType.simpleString()
    scored = store(docs.select(id_col, text_col).mapInArrow(
        run, f"id {kind}, row bigint, n_tokens bigint, n_known bigint, base double, score double, n_bytes bigint, "
        "rare array<string>, rare_n array<bigint>"), "scored")
    rare = (scored.select("row", F.explode(F.arrays_zip("rare", "rare_n")).alias("r"))
            .select("row", F.col("r.rare").alias("word"), F.col("r.rare_n").alias("times")))
    rest = (rare.join(counts, "word", "left").select("word", "row", "times", F.coalesce("n", F.lit(0)).alias("n"))
            .mapInArrow(spell, "row bigint, times bigint, n bigint, spelled double").groupBy("row")
            .agg(F.sum(F.col("times") * F.log10(F.col("n") + F.lit(0.5))).alias("rare_base"),
                 F.sum(F.when(F.col("n") > 0, F.col("times")).otherwise(0)).alias("rare_known"),
                 F.sum(F.col("times") * F.col("spelled")).alias("spelled")))
    score = F.col("score") + F.coalesce("spelled", F.lit(0.0))
    return (scored.drop("rare", "rare_n").join(rest, "row", "left")
            .select(F.col("id").alias(id_col), (remainder(F.col("id"), folds) == held_fold).alias("held_out"), "n_tokens",
                    (F.col("n_known") + F.coalesce("rare_known", F.lit(0))).cast("long").alias("n_known"),
                    F.lit(n_all).cast("long").alias("train_tokens"),
                    (F.col("base") + F.coalesce("rare_base", F.lit(0.0)) - F.col("n_tokens") * per_token).alias("base_score"),
                    score.alias("score"),
                    F.when(F.col("n_bytes") > 0, -score / math.log10(2) / F.col("n_bytes")).alias("bits_per_byte")))


@query("op1_lm_scoring")
def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"))
