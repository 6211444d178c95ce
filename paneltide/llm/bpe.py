"""Byte-level BPE encoding and decoding by merge replay.

A text is cut by the pattern of the vocabulary into pieces. The distinct pieces of a block of
documents form one corpus; an inverted index from token pair (named by the rank of its merge)
to positions in it applies the merges in rank order, and a merge updates only the index entries
of the two neighbours it touches. Ids of documents are then put together by piece number.

Null and empty texts give no ids. Whole texts of any length take part; a repeated row is
encoded like any other. Input columns other than the id and the text are not looked at.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession

from paneltide.llm.common import slices
from paneltide.llm.registry import query, table

#: Distinct chunks whose ids a worker remembers from one block to the next.
REMEMBERED = 600_000
#: Bytes of text in one block.
BLOCK_BYTES = 32 << 20


def ragged(flat: np.ndarray, starts: np.ndarray, numbers: np.ndarray) -> np.ndarray:
    """The rows ``numbers`` of a ragged table, one after another."""
    start = starts[numbers]
    size = starts[numbers + 1] - start
    ends = np.cumsum(size)
    return flat[np.arange(ends[-1] if len(ends) else 0) + np.repeat(start - (ends - size), size)]


def starts_of(sizes) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(np.asarray(sizes, np.int64))]).astype(np.int64)


def read_ranks(content: bytes) -> list[bytes]:
    """Tokens in order of rank; a line of the file has a base64 token and its rank."""
    ranks = {int(rank): base64.b64decode(token)
             for token, rank in (line.split() for line in content.splitlines() if line)}
    if sorted(ranks) != list(range(len(ranks))):
        raise ValueError("ranks must be 0, 1, 2, ... without a gap")
    return [ranks[i] for i in range(len(ranks))]


class Codec:
    """Encodes lists of texts to ids and ids to bytes, for one vocabulary."""

    def __init__(self, tokens: list[bytes], pattern: str):
        self.tokens = tokens
        self.rank = {t: i for i, t in enumerate(tokens)}
        if len(self.rank) != len(tokens) or any(bytes([b]) not in self.rank for b in range(256)):
            raise ValueError("every single byte must be a token, and no token may repeat")
        self.byte_rank = np.array([self.rank[bytes([b])] for b in range(256)], np.int64)
        self.pattern = regex.compile(pattern)
        pairs = sorted((a * len(tokens) + b, r) for r, t in enumerate(tokens) for cut in range(1, len(t))
                       if (a := self.rank.get(t[:cut])) is not None
                       and (b := self.rank.get(t[cut:])) is not None)
        self.pair_keys = np.array([k for k, _ in pairs] or [-1], np.int64)
        self.pair_ranks = np.array([r for _, r in pairs] or [-1], np.int64)
        self.bytes = np.frombuffer(b"".join(tokens), np.uint8)
        self.byte_starts = starts_of([len(t) for t in tokens])
        self.forget()

    def forget(self) -> None:
        """Start with no known chunks."""
        self.number: dict[str, int] = {}
        self.spaced: dict[str, int] = {}
        self.new: list[str] = []
        self.flat = np.zeros(0, np.uint32)
        self.starts = np.zeros(1, np.int64)

    def ranks_of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of the merge of each two tokens, -1 where there is none."""
        keys = a * len(self.tokens) + b
        at = np.minimum(np.searchsorted(self.pair_keys, keys), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == keys, self.pair_ranks[at], -1)

    def replay(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces one after another, and where each piece starts."""
        raw = [p.encode("utf-8") for p in pieces]
        whole = np.array([self.rank.get(x, -1) for x in raw], np.int64)
        size = np.array([len(x) for x in raw], np.int64)
        first = np.concatenate([[0], np.cumsum(size)])
        sym = self.byte_rank[np.frombuffer(b"".join(raw), np.uint8)]
        owner = np.repeat(np.arange(len(raw)), size)
        after = np.arange(1, len(sym) + 1)
        before = np.arange(-1, len(sym) - 1)
        after[first[1:] - 1] = -1
        before[first[:-1]] = -1
        done = whole >= 0
        sym[first[:-1][done]] = whole[done]
        after[first[:-1][done]] = -1
        live = ~done[owner]
        live[first[:-1]] = True
        odd: set[int] = set()

        index: dict[int, list[np.ndarray]] = {}
        heap: list[int] = []

        def note(at: np.ndarray, ranks: np.ndarray) -> None:
            if not len(at):
                return
            order = np.argsort(ranks, kind="stable")
            at, ranks = at[order], ranks[order]
            cuts = np.flatnonzero(np.diff(ranks, prepend=-1))
            for rank, part in zip(ranks[cuts].tolist(), np.split(at, cuts[1:]), strict=True):
                if rank in index:
                    index[rank].append(part)
                else:
                    index[rank] = [part]
                    heapq.heappush(heap, rank)

        at = np.flatnonzero(live & (after >= 0))
        ranks = self.ranks_of(sym[at], sym[after[at]])
        note(at[ranks >= 0], ranks[ranks >= 0])
        while heap:
            rank = heapq.heappop(heap)
            parts = index.pop(rank)
            i = parts[0] if len(parts) == 1 else np.concatenate(parts)
            i = i[live[i] & (after[i] >= 0)]
            i = np.unique(i[self.ranks_of(sym[i], sym[after[i]]) == rank])
            if not len(i):
                continue
            j = after[i]
            # Overlapping places, as in a run of one letter: every other one, from the left.
            if len(i) > 1 and len(hit := np.intersect1d(i, j, assume_unique=True)):
                taken: set[int] = set()
                for x, y in zip(i.tolist(), j.tolist(), strict=True):
                    if x not in taken:
                        taken.add(y)
                i = i[~np.isin(i, np.array(sorted(taken)))]
                j = after[i]
            k = after[j]
            # A merge with a neighbour that this round changes as well, were it ranked lower.
            between = self.ranks_of(np.full(len(k), rank), sym[k])
            odd.update(owner[i[(k >= 0) & (between >= 0) & (between <= rank)]].tolist())
            sym[i] = rank
            live[j] = False
            after[i] = k
            before[k[k >= 0]] = i[k >= 0]
            p = before[i]
            left, right = np.concatenate([p[p >= 0], i[k >= 0]]), np.concatenate([i[p >= 0], k[k >= 0]])
            ranks = self.ranks_of(sym[left], sym[right])
            if len(low := left[(ranks >= 0) & (ranks <= rank)]):
                odd.update(owner[low].tolist())
            note(left[ranks > rank], ranks[ranks > rank])
        ids, count = sym[live].astype(np.uint32), np.bincount(owner[live], minlength=len(raw))
        if odd:
            parts = np.split(ids, np.cumsum(count)[:-1])
            for n in odd:
                parts[n] = self.merge_alone(raw[n])
            ids, count = np.concatenate(parts), np.array([len(x) for x in parts])
        return ids, np.concatenate([[0], np.cumsum(count)]).astype(np.int64)

    def merge_alone(self, raw: bytes) -> np.ndarray:
        """Ids of one piece in which a merge made room for a lower one: a heap of its pairs."""
        sym: list[bytes] = [raw[i:i + 1] for i in range(len(raw))]
        after, before = list(range(1, len(raw) + 1)), list(range(-1, len(raw) - 1))
        heap = [(r, i) for i in range(len(raw) - 1) if (r := self.rank.get(sym[i] + sym[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            r, i = heapq.heappop(heap)
            j = after[i]
            if not sym[i] or j == len(raw) or self.rank.get(sym[i] + sym[j]) != r:
                continue
            sym[i], sym[j], after[i] = sym[i] + sym[j], b"", after[j]
            if after[i] < len(raw):
                before[after[i]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y < len(raw) and (r := self.rank.get(sym[x] + sym[y])) is not None:
                    heapq.heappush(heap, (r, x))
        return np.array([self.rank[x] for x in sym if x], np.uint32)

    def cut(self, text: str) -> np.ndarray:
        """Numbers of the text's chunks; chunks not seen before wait for ``learn``.

        No piece of the pattern reaches over the place before a single space between two other
        characters, so the text may be cut there, and a chunk be cut into pieces only once.
        """
        head, *rest = text.split(" ")
        out = [self._number(head)] if head else []
        spaced = self.spaced
        for part in rest:
            n = spaced.get(part)
            if n is None:
                wide = not part or part[0].isspace() or part[-1].isspace()
                n = spaced[part] = -1 if wide else self._number(" " + part)
            out.append(n)
        if -1 in out or rest and head[-1:].isspace():
            return np.array([self._number(text)], np.int32)
        return np.array(out, np.int32)

    def _number(self, chunk: str) -> int:
        n = self.number.get(chunk)
        if n is None:
            n = self.number[chunk] = len(self.number)
            self.new.append(chunk)
        return n

    def learn(self) -> None:
        """Encode the waiting chunks: replay their distinct pieces and put these together."""
        if not self.new:
            return
        piece: dict[str, int] = {}
        numbers, counts, find = [], [], self.pattern.findall
        for chunk in self.new:
            found = find(chunk)
            counts.append(len(found))
            for p in found:
                numbers.append(piece.setdefault(p, len(piece)))
        ids, starts = self.replay(list(piece))
        numbers = np.array(numbers, np.int64)
        ends = starts_of(starts[numbers + 1] - starts[numbers])[starts_of(counts)]
        self.flat = np.concatenate([self.flat, ragged(ids, starts, numbers)])
        self.starts = np.concatenate([self.starts, self.starts[-1] + ends[1:]])
        self.new = []

    def ids(self, numbers: np.ndarray) -> np.ndarray:
        """Token ids of a row of chunks, little-endian unsigned 32-bit integers."""
        return ragged(self.flat, self.starts, numbers).astype("<u4")

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of every text."""
        cut = [self.cut(t) for t in texts]
        self.learn()
        return [self.ids(x) for x in cut]

    def decode(self, ids: np.ndarray) -> bytes:
        return ragged(self.bytes, self.byte_starts, ids.astype(np.int64)).tobytes()


@lru_cache(maxsize=1)
def load_codec(path: str, pattern: str) -> Codec:
    """The codec of a worker; it keeps what it knows from one task to the next."""
    with open(path, "rb") as file:
        return Codec(read_ranks(file.read()), pattern)


def encode_documents(docs: DataFrame, vocabulary: str, pattern: str, id_col: str = "doc_id",
                     text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """One row per document: (id, n_tokens, ids_sha256, decoded_sha256), with ``with_ids`` also
    the ids and the bytes decoded from them. No shuffle; a task holds one block of texts.

    ``vocabulary`` is a rank file on the driver; its content goes to the tasks once.
    """
    spark = docs.sparkSession
    spark.sparkContext.addFile(vocabulary)
    name = vocabulary.rsplit("/", 1)[-1]
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    names = [id_col, "n_tokens", "ids_sha256", "decoded_sha256"]
    if with_ids:
        schema += ", ids array<bigint>, decoded binary"
        names += ["ids", "decoded"]

    def rows(codec: Codec, held: list[tuple[pa.Array, list[np.ndarray]]]) -> Iterator[pa.RecordBatch]:
        codec.learn()
        for keys, cut in held:
            found = [codec.ids(x) for x in cut]
            back = [codec.decode(x) for x in found]
            cols = [keys, pa.array([len(x) for x in found], pa.int64()),
                    pa.array([hashlib.sha256(x.tobytes()).hexdigest() for x in found], pa.string()),
                    pa.array([hashlib.sha256(x).hexdigest() for x in back], pa.string())]
            if with_ids:
                cols += [pa.array([x.tolist() for x in found], pa.list_(pa.int64())),
                         pa.array(back, pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, names=names)
        held.clear()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = load_codec(SparkFiles.get(name), pattern)
        held: list[tuple[pa.Array, list[np.ndarray]]] = []
        waiting = 0
        for batch in batches:
            for start, stop in slices(batch.column(1), 2 << 20):
                part = batch.slice(start, stop - start)
                texts = part.column(1).to_pylist()
                held.append((part.column(0), [codec.cut(t or "") for t in texts]))
                waiting += sum(len(t or "") for t in texts)
                if waiting >= BLOCK_BYTES:
                    yield from rows(codec, held)
                    waiting = 0
                    if len(codec.number) > REMEMBERED:
                        codec.forget()
        yield from rows(codec, held)
        if len(codec.number) > REMEMBERED:
            codec.forget()

    return docs.select(id_col, text_col).mapInArrow(run, schema)


@query("op4_byte_bpe")
def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode_documents(table(spark, sf_dir, "documents"),
                            public_tokenizers.path("byte_bpe_multi_50k.tiktoken"),
                            public_tokenizers.PATTERN)
