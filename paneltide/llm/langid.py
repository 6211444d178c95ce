"""Language identification: multinomial naive Bayes over hashed character n-grams.

Tasks count the n-grams of their labelled texts per (language, bucket); Spark sums these counts
over all labelled documents. The log-probability matrix (buckets x languages) has a fixed size
per language and goes to the tasks once; a block of texts is scored in numpy by gathering the
rows of its n-grams and summing them per text.

Null text or text without a letter: ``und``, score 0. Null languages teach nothing. Without any
labelled text every prediction is ``und``. A null id counts as remainder 0, so such a document
is not held out. Ties between languages go to the smaller name. Repeated rows count and are
predicted like any other row. More than ``MAX_LANGUAGES`` languages raise ``ValueError``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paneltide.llm.common import remainder, slices, store
from paneltide.llm.registry import query, table

BUCKET_BITS = 16
ORDERS = (1, 2, 3)
SMOOTHING = 0.5
#: Bounds the matrix at 1,000 x 65,536 doubles.
MAX_LANGUAGES = 1000
UNKNOWN = "und"
LETTER = regex.compile(r"\p{L}")
MULTIPLIERS = (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D)
PAD = "  "


def buckets(texts: list[str]) -> tuple[list[np.ndarray], np.ndarray]:
    """Bucket of the n-gram that starts at each place, for each order, and the first place of each text.

    Every text stands between two spaces on each side, so an n-gram that reaches into the next
    text holds spaces only.
    """
    padded = [PAD + t.lower() + PAD for t in texts]
    starts = np.concatenate([[0], np.cumsum([len(t) for t in padded])])[:-1]
    code = np.frombuffer("".join([*padded, PAD]).encode("utf-32-le", "surrogatepass"), np.uint32)
    size = len(code) - len(PAD)
    out = []
    for order in ORDERS:
        mixed = np.full(size, order * 0x27D4EB2F & 0xFFFFFFFF, np.uint32)
        for k in range(order):
            mixed = (mixed ^ code[k:k + size]) * np.uint32(MULTIPLIERS[k])
            mixed ^= mixed >> np.uint32(15)
        out.append((mixed * np.uint32(MULTIPLIERS[0])) >> np.uint32(32 - BUCKET_BITS))
    return out, starts


@dataclass
class LanguageModel:
    languages: list[str]
    log_prob: np.ndarray  # buckets x languages
    log_prior: np.ndarray

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """Language and its posterior probability of every text."""
        names, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
        asked = [i for i, t in enumerate(texts) if self.languages and t and LETTER.search(t)]
        if asked:
            found, starts = buckets([texts[i] for i in asked])
            total = np.tile(self.log_prior, (len(asked), 1))
            for bucket in found:
                total += np.add.reduceat(self.log_prob[bucket], starts, axis=0)
            best = total.argmax(axis=1)
            share = np.exp(total - total.max(axis=1, keepdims=True))
            scores[asked] = 1.0 / share.sum(axis=1)
            for i, b in zip(asked, best, strict=True):
                names[i] = self.languages[b]
        return names, scores


def fit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> LanguageModel:
    """Learn from every row of ``docs`` with a text and a language."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = 1 << BUCKET_BITS
        seen: dict[str, np.ndarray] = {}
        rows: dict[str, int] = {}
        for batch in batches:
            for start, stop in slices(batch.column(0)):
                by: dict[str, list[str]] = {}
                for text, lang in zip(batch.column(0).slice(start, stop - start).to_pylist(),
                                      batch.column(1).slice(start, stop - start).to_pylist(), strict=True):
                    by.setdefault(lang, []).append(text)
                for lang, texts in by.items():
                    total = seen.setdefault(lang, np.zeros(size, np.int64))
                    for bucket in buckets(texts)[0]:
                        total += np.bincount(bucket, minlength=size)
                    rows[lang] = rows.get(lang, 0) + len(texts)
        for lang, total in seen.items():
            at = np.flatnonzero(total)
            # Bucket -1 holds the number of texts.
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * (len(at) + 1), pa.string()),
                 pa.array(np.append(at, -1), pa.int32()), pa.array(np.append(total[at], rows[lang]), pa.int64())],
                names=["lang", "bucket", "n"])

    labelled = docs.where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull())
    counts = store(labelled.select(F.col(text_col), F.col(lang_col).cast("string"))
                   .mapInArrow(count, "lang string, bucket int, n bigint")
                   .groupBy("lang", "bucket").agg(F.sum("n").alias("n")), "ngrams")
    texts = {r.lang: r.n for r in counts.where("bucket = -1").orderBy("lang").limit(MAX_LANGUAGES + 1).collect()}
    if len(texts) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    languages = sorted(texts)
    matrix = np.full((1 << BUCKET_BITS, len(languages)), SMOOTHING)
    if languages:
        cells = counts.where("bucket >= 0").toPandas()
        place = {lang: i for i, lang in enumerate(languages)}
        matrix[cells["bucket"].to_numpy(), cells["lang"].map(place).to_numpy()] += cells["n"].to_numpy()
    prior = np.array([texts[x] for x in languages], float)
    return LanguageModel(languages, np.log(matrix / matrix.sum(axis=0)) if languages else matrix,
                         np.log(prior / prior.sum()) if languages else prior)


def predict(docs: DataFrame, model: LanguageModel, keep: list[str], text_col: str = "text") -> DataFrame:
    """The columns ``keep`` of every row with ``lang_pred`` and ``score``."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    asked = keep if text_col in keep else [*keep, text_col]
    inner = docs.select(*[F.col(c).alias(f"_{i}") for i, c in enumerate(asked)])
    names = [*[f"_{i}" for i in range(len(keep))], "lang_pred", "score"]
    schema = ", ".join([*[f"_{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(keep)],
                        "lang_pred string, score double"])
    at = asked.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, stop in slices(batch.column(at)):
                part = batch.slice(start, stop - start)
                found, scores = sent.value.predict(part.column(at).to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:len(keep)], pa.array(found, pa.string()), pa.array(scores, pa.float64())], names=names)

    return inner.mapInArrow(run, schema).toDF(*keep, "lang_pred", "score")


@query("op9_language_id")
def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = remainder(F.col("doc_id"), 4) == 2
    model = fit(docs.where(~held_out))
    return (predict(docs, model, ["doc_id"])
            .select("doc_id", held_out.alias("held_out"), "lang_pred", "score"))
