"""Token ids in binary files, coded by a static range asymmetric numeral system.

1. The texts are encoded and kept; the frequencies of all ids over all documents make one table,
   scaled to ``2 ** SCALE_BITS``.
2. Documents are range-sorted by id; a task writes its documents, one after another, into files of
   about ``FILE_TOKENS`` ids. A file is a list of blocks that do not depend on one another. In a
   block, ``LANES`` coders take turns: lane j codes the ids j, j + ``LANES``, ... All lanes write
   32-bit words to one stream, in the order in which the decoder asks for them.
3. Every ``SEGMENT_STEPS`` steps a block keeps a checkpoint: the states of its lanes and the place
   in its stream. The reader decodes all segments of all blocks side by side, or only those that
   a range of ids needs. Blocks and files carry checksums of their bytes and of the ids.

Files are rows (part, file, content) of a stored table, as Spark has no writer for plain binary
files. The ids before a file are the sums of the files before it: per part, then per file of a part.

A null or empty text has the end id alone. Rows without an id come first; rows that share an id
stand beside one another, in no order. Texts of any length take part, each within one file. An
empty table gives no files. Other columns are not looked at. Texts that spell a special token are
ordinary text.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from paneltide.llm.bpe import ragged, starts_of
from paneltide.llm.common import slices, small_side, store
from paneltide.llm.registry import query, table

#: Fixed values of the format.
MAGIC, VERSION = b"RANSTOK1", 1
LOW = np.uint64(1 << 31)
WORD_BITS = np.uint64(32)

SCALE_BITS = 20
LANES = 128
#: Ids of a block, and steps of all its lanes from one checkpoint to the next.
BLOCK_TOKENS, SEGMENT_STEPS = 1 << 17, 512
FILE_TOKENS = 1 << 21
#: Distinct stretches of text whose ids a worker remembers from one slice of texts to the next.
REMEMBERED = 500_000
SLICE_BYTES = 4 << 20
END_ID = 0
#: Where a stretch starts besides spaces: line breaks, and marks that never join with a letter.
MARKS = "\n,."
#: Characters below this one that Python takes for letters are letters in all tables of characters.
KNOWN_LETTERS = "\u0500"
#: Words of Latin, Greek and Cyrillic letters.
LETTERS = r"^[A-Za-z\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{24F}\x{388}-\x{38A}\x{38E}-\x{3A1}\x{3A3}-\x{3F5}\x{400}-\x{481}\x{48A}-\x{4FF}]+$"


def byte_characters() -> dict[int, int]:
    """The character by which byte-level vocabularies write a byte; a line break stands for itself."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: 256 + i for i, b in enumerate(hidden) if b != 10}


class Encoder:
    """Ids of texts by a byte-level tokenizer of the tokenizers library.

    No piece of such a tokenizer reaches over the place before white space that follows other text,
    nor over the place between a letter and a comma or stop. Texts are cut there, and every distinct
    stretch is given to the library once. A stretch that is a space and letters is one piece, so it
    goes to the library's merges without its search for pieces.
    """

    def __init__(self, content: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer, self.merges = Tokenizer.from_str(content), Tokenizer.from_str(content)
        self.tokenizer.encode_special_tokens = self.merges.encode_special_tokens = True
        self.merges.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        self.characters = byte_characters()
        vocabulary, space = self.tokenizer.get_vocab(), self.characters[0x20]
        self.spaced = np.zeros(1 + max(vocabulary.values()), bool)
        self.spaced[[i for token, i in vocabulary.items() if token[:1] == chr(space)]] = True
        self.forget()

    def forget(self) -> None:
        self.number: dict[str, int] = {}
        self.flat, self.starts = np.zeros(0, np.uint32), np.zeros(1, np.int64)

    def _add(self, stretches: list[str], flat, sizes: np.ndarray) -> None:
        first = len(self.number)
        self.number.update(zip(stretches, range(first, first + len(stretches)), strict=True))
        self.flat = np.concatenate([self.flat, np.array(flat, np.uint32)])
        self.starts = np.concatenate([self.starts, self.starts[-1] + np.cumsum(sizes)])

    def words(self, words: list[str]) -> list[int]:
        """Numbers of words of letters alone, each with a space before it; the space is not given."""
        known = self.number
        new = [w for w in words if w not in known]
        plain = [w for w in new if w.isascii()]
        other = [w for w in new if not w.isascii()]
        space = chr(self.characters[0x20])
        for group in (plain, other):
            if group:
                joined = "\n".join(group)
                if group is other:
                    joined = joined.encode("utf-8").decode("latin-1").translate(self.characters)
                joined = space + joined.replace("\n", "\n" + space)
                # A word has its space in its first id and nowhere else.
                ids = np.array(self.merges.encode_batch_fast([joined], add_special_tokens=False)[0].ids, np.int64)
                self._add(group, ids, np.diff(np.append(np.flatnonzero(self.spaced[ids]), len(ids))))
        return list(map(known.__getitem__, words))

    def others(self, stretches: list[str]) -> list[int]:
        """Numbers of any stretches, as they are but for a line break that keeps them from words."""
        known = self.number
        keys = ["\n" + s for s in stretches]
        new = [k for k in dict.fromkeys(keys) if k not in known]
        if new:
            ids = [e.ids for e in self.tokenizer.encode_batch_fast([k[1:] for k in new], add_special_tokens=False)]
            self._add(new, [i for own in ids for i in own], np.array([len(own) for own in ids]))
        return list(map(known.__getitem__, keys))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and where each text starts."""
        if len(self.number) > REMEMBERED:
            self.forget()
        clean = pa.array([t or "" for t in texts.to_pylist()], pa.large_string())
        # A space before every mark, then a cut at every space; a mark begins its stretch.
        for mark in MARKS:
            clean = pc.replace_substring(clean, mark, " " + mark)
        lists = pc.split_pattern(clean, " ")
        bounds = lists.offsets.to_numpy()
        coded = lists.flatten().dictionary_encode()
        values, code = coded.dictionary, coded.indices.to_numpy().astype(np.int64)
        # All at once; ``to_pylist`` makes a scalar of each.
        value = values.to_numpy(zero_copy_only=False).tolist()
        open_end = ends(values, -1, None, lambda c: not c or c.isspace())
        letter_end = ends(values, -1, None, lambda c: c.isalpha() and c < KNOWN_LETTERS or c.isascii() and c.isdigit())
        marked = ends(values, 0, 1, lambda c: c != "" and c in MARKS)
        stop = ends(values, 0, 1, lambda c: c != "" and c in MARKS[1:])
        letters = pc.match_substring_regex(values, LETTERS).to_numpy(zero_copy_only=False)
        first, glued = np.zeros(len(code), bool), np.zeros(len(code), bool)
        first[bounds[:-1]] = True
        # Where the place of the cut may lie inside a piece, the stretch stays with the one before.
        glued[1:] = np.where(stop[code[1:]], ~letter_end[code[:-1]], open_end[code[:-1]]) & ~first[1:]
        apart = first | glued | np.append(glued[1:], False)
        used = np.bincount(code[~apart], minlength=len(value)) > 0
        number = np.full(len(value), -1, np.int64)
        at = np.flatnonzero(used & letters)
        number[at] = self.words([value[c] for c in at.tolist()])
        at = np.flatnonzero(used & ~letters)
        number[at] = self.others([value[c] if marked[c] else " " + value[c] for c in at.tolist()])
        unit = number[code]
        # The first stretch of a text has no space before it; glued ones are put together.
        places, own = [], []
        for i in np.flatnonzero(apart).tolist():
            v = value[code[i]]
            if not (first[i] or marked[code[i]]):
                v = " " + v
            if glued[i]:
                own[-1] += v
            else:
                places.append(i)
                own.append(v)
        kept = ~glued
        full = np.array([v != "" for v in own], bool)
        places = np.array(places, np.int64)
        kept[places[~full]] = False
        unit[places[full]] = self.others([v for v in own if v])
        units = unit[kept]
        sizes = self.starts[units + 1] - self.starts[units]
        return ragged(self.flat, self.starts, units), starts_of(sizes)[np.concatenate([[0], np.cumsum(kept)])[bounds]]


def ends(values: pa.Array, start: int, stop: int | None, holds) -> np.ndarray:
    """Whether ``holds`` is true of the first or last character of each value."""
    coded = pc.utf8_slice_codeunits(values, start, stop).dictionary_encode()
    return np.array([holds(c) for c in coded.dictionary.to_pylist()] or [False], bool)[coded.indices.to_numpy()]


@lru_cache(maxsize=1)
def load_encoder(content: str) -> Encoder:
    """The encoder of a worker; it keeps what it knows from one task to the next."""
    return Encoder(content)


@dataclass
class Frequencies:
    """Scaled frequencies of the ids: all that occur have at least one of the ``2 ** bits``."""

    count: np.ndarray
    bits: int = SCALE_BITS
    freq: np.ndarray = field(init=False)
    start: np.ndarray = field(init=False)
    table: np.ndarray | None = field(default=None, init=False, repr=False)

    def __post_init__(self) -> None:
        total, whole = int(self.count.sum()), 1 << self.bits
        used = np.flatnonzero(self.count)
        if len(used) > whole:
            raise ValueError(f"more than {whole} different ids")
        freq = np.zeros(len(self.count), np.int64)
        if total:
            share = self.count[used].astype(object) * whole // total
            freq[used] = np.maximum(1, share.astype(np.int64))
            # What rounding left or took goes to the most frequent ids, which feel it least.
            over = int(freq.sum()) - whole
            for i in used[np.argsort(-self.count[used], kind="stable")]:
                if not over:
                    break
                change = max(-over, 1 - int(freq[i]))
                freq[i] += change
                over += change
        self.freq = freq.astype(np.uint64)
        self.start = (np.cumsum(freq) - freq).astype(np.uint64)

    def slots(self) -> np.ndarray:
        """Of every slot, in one number: its id, the frequency of the id less 1, its place among the
        id's slots; each ``bits`` wide but the id. One look at memory decodes an id."""
        if self.table is None:
            n, bits = self.freq.astype(np.int64), np.uint64(self.bits)
            inside = np.arange(n.sum(), dtype=np.uint64) - np.repeat(self.start, n)
            own = np.repeat(np.arange(len(n), dtype=np.uint64), n)
            self.table = ((own << bits | np.repeat(self.freq, n) - np.uint64(1)) << bits) | inside
        return self.table

    def mark(self) -> int:
        return zlib.crc32(self.freq.astype("<u4").tobytes())


def encode_blocks(ids: np.ndarray, lanes: int, model: Frequencies) -> list[bytes]:
    """Payloads of blocks of equal size (blocks, steps * lanes): checkpoints, then words."""
    blocks, steps = len(ids), ids.shape[1] // lanes
    ids = ids.reshape(blocks, steps, lanes)
    bits, top = np.uint64(model.bits), np.uint64(63 - model.bits)
    words = np.zeros((steps, blocks, lanes), np.uint32)
    out = np.zeros((steps, blocks, lanes), bool)
    marks = -(-steps // SEGMENT_STEPS)
    states = np.zeros((marks, blocks, lanes), np.uint64)
    x = np.full((blocks, lanes), LOW, np.uint64)
    for t in range(steps - 1, -1, -1):
        own = ids[:, t]
        f = model.freq[own]
        full = x >= (f << top)
        words[t], out[t] = x.astype(np.uint32), full
        x = np.where(full, x >> WORD_BITS, x)
        quotient = x // f
        x = (quotient << bits) + (x - quotient * f) + model.start[own]
        if t % SEGMENT_STEPS == 0:
            states[t // SEGMENT_STEPS] = x
    sent = out.sum(axis=2, dtype=np.int64)
    before = np.concatenate([np.zeros((1, blocks), np.int64), np.cumsum(sent, axis=0)])
    place = before[:-1:SEGMENT_STEPS].astype("<u4")
    result = []
    for b in range(blocks):
        stream = words[:, b][out[:, b]].astype("<u4")
        result.append(struct.pack("<II", marks, len(stream)) + place[:, b].tobytes()
                      + states[:, b].astype("<u8").tobytes() + stream.tobytes())
    return result


def decode_segments(parts: list[tuple[np.ndarray, np.ndarray]], steps: int, model: Frequencies) -> np.ndarray:
    """Ids (segments, steps * lanes) of segments with as many steps: (states, words from there on)."""
    bits, mask = np.uint64(model.bits), np.uint64((1 << model.bits) - 1)
    x = np.stack([s for s, _ in parts])
    need = [min(len(w), steps * x.shape[1]) for _, w in parts]
    # Lanes without need of a word look at the one before; the first and last are never used.
    stream = np.concatenate([np.zeros(1, np.uint32), *[w[:n] for (_, w), n in zip(parts, need, strict=True)]]).astype(np.uint64)
    at = starts_of(need)[:-1]
    slots = model.slots()
    out = np.zeros((len(parts), steps, x.shape[1]), np.uint32)
    for t in range(steps):
        slot = (x & mask).astype(np.int64)
        own = slots[slot]
        out[:, t] = own >> (bits + bits)
        x = ((own >> bits & mask) + np.uint64(1)) * (x >> bits) + (own & mask)
        low = x < LOW
        order = np.cumsum(low, axis=1)
        order += at[:, None]
        x = np.where(low, (x << WORD_BITS) | stream[order], x)
        at = order[:, -1].copy()
    return out.reshape(len(parts), -1)


def pack_file(doc_ids: list[int | None], sizes: np.ndarray, ids: np.ndarray, model: Frequencies) -> bytes:
    """A file of documents: header, table of documents, table of blocks, blocks."""
    full = len(ids) // BLOCK_TOKENS
    payloads = encode_blocks(ids[:full * BLOCK_TOKENS].reshape(full, BLOCK_TOKENS), LANES, model) if full else []
    rest = ids[full * BLOCK_TOKENS:]
    if len(rest):
        padded = np.full(-(-len(rest) // LANES) * LANES, rest[-1], ids.dtype)
        padded[:len(rest)] = rest
        payloads += encode_blocks(padded[None], LANES, model)
    count = [BLOCK_TOKENS] * full + [len(rest)] * bool(len(rest))
    blocks = b"".join(struct.pack("<IIII", n, len(p), zlib.crc32(p), zlib.crc32(
        ids[i * BLOCK_TOKENS:i * BLOCK_TOKENS + n].astype("<u4").tobytes()))
        for i, (n, p) in enumerate(zip(count, payloads, strict=True)))
    null = np.array([d is None for d in doc_ids], bool)
    docs = zlib.compress(np.array([d or 0 for d in doc_ids], "<i8").tobytes() + np.packbits(null).tobytes()
                         + sizes.astype("<u4").tobytes(), 1)
    head = struct.pack("<8sIIIQII", MAGIC, VERSION, model.mark(), len(doc_ids), len(ids), len(count), len(docs))
    body = docs + blocks
    return head + struct.pack("<I", zlib.crc32(head + body)) + body + b"".join(payloads)


HEAD = struct.calcsize("<8sIIIQII")


class TokenFile:
    """A file that was read: ``doc_ids``, ``sizes`` and, on demand, ids."""

    def __init__(self, content: bytes, model: Frequencies):
        if len(content) < HEAD + 4:
            raise ValueError("file is cut off")
        magic, version, mark, n_docs, self.n_tokens, n_blocks, n_bytes = struct.unpack_from("<8sIIIQII", content)
        if magic != MAGIC or version != VERSION:
            raise ValueError("not a token file")
        if mark != model.mark():
            raise ValueError("file was written with other frequencies")
        at, body = HEAD + 4, n_bytes + 16 * n_blocks
        if zlib.crc32(content[:HEAD] + content[at:at + body]) != struct.unpack_from("<I", content, HEAD)[0]:
            raise ValueError("header does not match its checksum")
        raw = zlib.decompress(content[at:at + n_bytes])
        null = np.unpackbits(np.frombuffer(raw, np.uint8, -(-n_docs // 8), 8 * n_docs), count=n_docs).astype(bool)
        own = np.frombuffer(raw, "<i8", n_docs)
        self.doc_ids = pa.array(own, mask=null)
        self.sizes = np.frombuffer(raw, "<u4", n_docs, 8 * n_docs + -(-n_docs // 8)).astype(np.int64)
        self.blocks = np.frombuffer(content, "<u4", 4 * n_blocks, at + n_bytes).reshape(-1, 4).astype(np.int64)
        self.block_at = at + body + starts_of(self.blocks[:, 1])
        if self.block_at[-1] != len(content) or self.blocks[:, 0].sum() != self.n_tokens or self.sizes.sum() != self.n_tokens:
            raise ValueError("lengths do not add up")
        self.content, self.model = content, model

    def ids(self, start: int = 0, stop: int | None = None) -> np.ndarray:
        """Ids from ``start`` to ``stop``; only the segments that hold them are decoded, and the
        checksum of a block's ids is looked at where the block is decoded in full."""
        stop = self.n_tokens if stop is None else min(stop, self.n_tokens)
        if start >= stop:
            return np.zeros(0, np.uint32)
        first = starts_of(self.blocks[:, 0])
        by_steps: dict[int, list] = {}
        order, segment = [], SEGMENT_STEPS * LANES
        for b in range(int(np.searchsorted(first, start, side="right")) - 1, int(np.searchsorted(first, stop))):
            n, size, crc, _ = self.blocks[b].tolist()
            raw = self.content[self.block_at[b]:self.block_at[b] + size]
            if zlib.crc32(raw) != crc:
                raise ValueError(f"block {b} does not match its checksum")
            marks, n_words = struct.unpack_from("<II", raw)
            place = np.frombuffer(raw, "<u4", marks, 8)
            states = np.frombuffer(raw, "<u8", marks * LANES, 8 + 4 * marks).reshape(marks, LANES)
            words = np.frombuffer(raw, "<u4", n_words, 8 + 4 * marks + 8 * marks * LANES)
            steps = -(-n // LANES)
            for k in range(max(0, (start - first[b]) // segment), min(marks, -(-(stop - first[b]) // segment))):
                own = min(SEGMENT_STEPS, steps - k * SEGMENT_STEPS)
                group = by_steps.setdefault(own, [])
                order.append((own, len(group), first[b] + k * segment, min(own * LANES, n - k * segment), b))
                group.append((states[k], words[place[k]:]))
        found = {steps: decode_segments(parts, steps, self.model) for steps, parts in by_steps.items()}
        whole: dict[int, list[np.ndarray]] = {}
        for steps, i, _, n, b in order:
            whole.setdefault(b, []).append(found[steps][i][:n])
        for b, parts in whole.items():
            if sum(map(len, parts)) == self.blocks[b, 0]:
                crc = 0
                for p in parts:
                    crc = zlib.crc32(p.astype("<u4").tobytes(), crc)
                if crc != self.blocks[b, 3]:
                    raise ValueError(f"ids of block {b} do not match their checksum")
        out = np.concatenate([p for parts in whole.values() for p in parts])
        return out[start - order[0][2]:stop - order[0][2]]


def tokenize(docs: DataFrame, content: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, row, n, ids): the ids of every document with the end id, compressed; ``row`` is unique."""
    sent = docs.sparkSession.sparkContext.broadcast(content)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encoder, row = load_encoder(sent.value), TaskContext.get().partitionId() << 40
        press = zstandard.ZstdCompressor(level=1, write_content_size=True).compress
        for batch in batches:
            for a, b in slices(batch.column(1), SLICE_BYTES):
                part = batch.slice(a, b - a)
                ids, starts = encoder.encode(part.column(1))
                ids = np.insert(ids, starts[1:], END_ID).astype("<u4")
                starts = starts + np.arange(len(starts))
                # Two bytes are enough for most vocabularies; the width follows from the largest id.
                width = "<u2" if not len(ids) or ids.max() < 1 << 16 else "<u4"
                own = ids.astype(width)
                packed = [press(own[i:j].tobytes()) for i, j in zip(starts[:-1], starts[1:], strict=True)]
                n = len(packed)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(np.arange(row, row + n)), pa.array(np.diff(starts)), pa.array(packed, pa.binary())],
                    names=["id", "row", "n", "ids"])
                row += n

    return (docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
            .mapInArrow(run, "id bigint, row bigint, n bigint, ids binary"))


def unpack(batch: pa.RecordBatch, n_at: int, ids_at: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids of the documents of a batch one after another, and where each starts."""
    read = zstandard.ZstdDecompressor().decompress
    out, sizes = [], batch.column(n_at).to_numpy()
    for n, raw in zip(sizes.tolist(), batch.column(ids_at), strict=True):
        own = read(raw.as_buffer())
        out.append(np.frombuffer(own, "<u2" if len(own) == 2 * n else "<u4").astype(np.uint32))
    return np.concatenate(out or [np.zeros(0, np.uint32)]), starts_of(sizes)


def count_ids(tokens: DataFrame) -> Frequencies:
    """Frequencies of the ids of all documents; one row per id, so of the vocabulary's size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in batches:
            own = np.bincount(unpack(batch, 0, 1)[0], minlength=len(total))
            own[:len(total)] += total
            total = own
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], names=["token", "n"])

    rows = tokens.select("n", "ids").mapInArrow(run, "token bigint, n bigint").groupBy("token").agg(F.sum("n").alias("n")).toPandas()
    count = np.zeros(int(rows["token"].max()) + 1 if len(rows) else 1, np.int64)
    count[rows["token"].to_numpy(np.int64)] = rows["n"].to_numpy(np.int64)
    return Frequencies(count)


def write_files(tokens: DataFrame, model: Frequencies) -> DataFrame:
    """(part, file, n_docs, n_tokens, content): the documents of ``tokenize`` in ascending order."""
    from pyspark import TaskContext

    sent = tokens.sparkSession.sparkContext.broadcast(model)
    schema = "part int, file int, n_docs bigint, n_tokens bigint, content binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        part, file = TaskContext.get().partitionId(), 0
        names, sizes, held, n = [], [], [], 0

        def flush() -> pa.RecordBatch:
            nonlocal file, names, sizes, held, n
            raw = pack_file(names, np.concatenate(sizes), np.concatenate(held), model)
            row = pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([file], pa.int32()), pa.array([len(names)], pa.int64()),
                 pa.array([n], pa.int64()), pa.array([raw], pa.binary())], names=["part", "file", "n_docs", "n_tokens", "content"])
            file, names, sizes, held, n = file + 1, [], [], [], 0
            return row

        for rows in batches:
            (ids, starts), keys, at = unpack(rows, 1, 2), rows.column(0).to_pylist(), 0
            while at < len(keys):
                # Up to the document that fills the file.
                stop = max(at + 1, min(len(keys), int(np.searchsorted(starts, starts[at] + FILE_TOKENS - n))))
                names += keys[at:stop]
                sizes.append(np.diff(starts[at:stop + 1]))
                held.append(ids[starts[at]:starts[stop]])
                n += int(starts[stop] - starts[at])
                at = stop
                if n >= FILE_TOKENS:
                    yield flush()
        if names:
            yield flush()

    # The row number splits rows that share an id between ranges.
    order = [F.col("id").asc_nulls_first(), F.col("row")]
    return tokens.repartitionByRange(*order).sortWithinPartitions(*order).select("id", "n", "ids").mapInArrow(run, schema)


def with_starts(files: DataFrame) -> DataFrame:
    """The files with ``start``: the ids of all files before."""
    sizes = files.select("part", "file", "n_tokens")
    parts = sizes.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    base = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("base"))
    inner = F.sum("n_tokens").over(Window.partitionBy("part").orderBy("file")) - F.col("n_tokens")
    starts = sizes.select("part", "file", inner.alias("inner")).join(F.broadcast(base), "part")
    starts = store(starts.select("part", "file", (F.col("base") + F.col("inner")).alias("start")), "starts")
    return files.join(small_side(starts, 24), ["part", "file"])


def read_files(files: DataFrame, model: Frequencies) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32, ids) of the documents of files (start, content)."""
    sent = files.sparkSession.sparkContext.broadcast(model)
    schema = "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint, ids binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for batch in batches:
            for start, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                file = TokenFile(raw.as_py(), model)
                ids, at = file.ids().astype("<u4"), starts_of(file.sizes)
                for a in range(0, len(at) - 1, 1000):
                    own = at[a:a + 1001]
                    parts = [ids[i:j].tobytes() for i, j in zip(own[:-1], own[1:], strict=True)]
                    yield pa.RecordBatch.from_arrays(
                        [file.doc_ids.slice(a, len(parts)), pa.array(start + own[:-1]), pa.array(np.diff(own)),
                         pa.array([zlib.crc32(p) for p in parts], pa.int64()), pa.array(parts, pa.binary())],
                        names=["doc_id", "start", "n_tokens", "ids_crc32", "ids"])

    return files.select("start", "content").mapInArrow(run, schema)


@query("op11_token_files")
def op11_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as file:
        content = file.read()
    tokens = store(tokenize(table(spark, sf_dir, "documents"), content), "tokens")
    model = count_ids(tokens)
    files = store(write_files(tokens, model), "token_files")
    return read_files(with_starts(files), model).select("doc_id", "start", "n_tokens", "ids_crc32")
