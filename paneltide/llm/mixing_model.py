"""The bit model of ``lm_scoring``: codes, hashed contexts, gated mixing. Numpy on one block.

A word of the lexicon is a path of bits in a Huffman tree; any other word is an escape path and
then the paths of its bytes and of a closing space in a second tree, made from the lexicon's bytes. Every bit is predicted in four contexts
(for a path: none, one, two, three words back; for bytes: two, three, four and six bytes back,
within the word). A context and the place in the code hash to a slot with two counts. The log odds
of the four slots are summed with weights from a gate, which is chosen by how often each context
was seen; a final table, by gate and by the mixed odds, corrects the result.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from paneltide.llm.common import mix64, word_hashes
from paneltide.llm.bpe import starts_of
from paneltide.llm.substrings import powers

CONTEXTS = 4
#: log2 of the slots per context.
SLOT_BITS = 21
GATES = 2 << 6
STEPS = 33
MULTIPLIER = np.uint32(0x9E3779B1)
END = ""
#: Decisions between two steps of the weights; their numbers fit a core's cache.
BATCH = 1 << 14
RATE = 0.6
SPELL_BASE = 0xD1342543DE82EF95
#: Bytes back in the contexts of spelled words.
SPELL_BACK = (2, 3, 4, 6)
#: Inner nodes of the bytes' tree are numbered from here.
SPELL_NODE = np.uint32(1 << 20)


def huffman(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts of the symbols' paths, and the inner nodes and bits on them."""
    heap = [(max(1, int(c)), i) for i, c in enumerate(counts)]
    heapq.heapify(heap)
    n = len(counts)
    parent, bit = np.zeros(2 * n, np.int64), np.zeros(2 * n, np.uint8)
    fresh = n
    while len(heap) > 1:
        (a, i), (b, j) = heapq.heappop(heap), heapq.heappop(heap)
        parent[i] = parent[j] = fresh
        bit[j] = 1
        heapq.heappush(heap, (a + b, fresh))
        fresh += 1
    # All paths at once, one step up the tree at a time; kept from the leaf, then turned round.
    root, at = fresh - 1, np.arange(n)
    owner, steps, nodes, bits = [], [], [], []
    for step in range(2 * n):
        open_ = np.flatnonzero(at != root)
        if not len(open_):
            break
        owner.append(open_)
        steps.append(np.full(len(open_), step))
        bits.append(bit[at[open_]])
        at[open_] = parent[at[open_]]
        nodes.append(at[open_] - n)
    if not owner:
        return np.zeros(n + 1, np.int64), np.zeros(0, np.uint32), np.zeros(0, np.uint8)
    owner, steps, nodes, bits = (np.concatenate(x) for x in (owner, steps, nodes, bits))
    order = np.lexsort((-steps, owner))
    return (starts_of(np.bincount(owner, minlength=n)), nodes[order].astype(np.uint32), bits[order].astype(np.uint8))


def expand(starts: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sizes of the rows of a ragged table and the places of their items."""
    start = starts[rows]
    size = starts[rows + 1] - start
    ends = np.cumsum(size)
    return size, np.arange(ends[-1] if len(ends) else 0) + np.repeat(start - (ends - size), size)


def state(n: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Log odds (in 1/256) and a confidence from 0 to 3, in one number of 16 bits."""
    odds = ones + np.float32(0.4)
    odds /= n - ones + np.float32(0.4)
    np.log(odds, out=odds)
    odds *= np.float32(256)
    level = (n > 0).view(np.int8) + (n > 2).view(np.int8) + (n > 15).view(np.int8)
    return (np.clip(odds, -2047, 2047, out=odds).astype(np.int16) << np.int16(2)) | level


def byte_states() -> np.ndarray:
    """The states of all counts below 256, at uses times 256 and ones."""
    n, ones = np.divmod(np.arange(1 << 16), 256)
    return state(n.astype(np.float32), np.minimum(ones, n).astype(np.float32))


BYTE_STATES = byte_states()


def states_of(cells: np.ndarray) -> np.ndarray:
    """States of slots that hold their uses in the upper and their ones in the lower half."""
    large = np.flatnonzero(cells >= np.uint64(1 << 40))
    if 4 * len(large) > len(cells):
        return wide_states(cells)
    out = BYTE_STATES.take(((cells >> np.uint64(24) | cells) & np.uint64(0xFFFF)).astype(np.intp))
    if len(large):
        out[large] = wide_states(cells[large])
    return out


def wide_states(cells: np.ndarray) -> np.ndarray:
    return state((cells >> np.uint64(32)).astype(np.float32), cells.astype(np.uint32).astype(np.float32))


def looked_up(table: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Items of a table at places that are all inside it; then "clip" only spares a copy."""
    return table.take(at.astype(np.intp, copy=False), mode="clip")


@dataclass
class Decisions:
    """The bits of one block: which, at what slots, and how they fall to the owners."""

    bit: np.ndarray
    slots: list[np.ndarray]
    owner: np.ndarray
    weight: np.ndarray
    spelled: int


@dataclass
class Lexicon:
    """Frequent words with their counts in the training texts; the last symbol is the escape."""

    words: list[str]
    counts: np.ndarray
    rest: int
    value_set: pa.Array = field(init=False)
    hashes: np.ndarray = field(init=False)
    by_hash: np.ndarray = field(init=False)
    sorted_hashes: np.ndarray = field(init=False)
    end: int = field(init=False)

    def __post_init__(self) -> None:
        self.value_set = pa.array(self.words, pa.large_string())
        self.hashes = word_hashes(self.value_set)
        self.by_hash = np.argsort(self.hashes)
        self.sorted_hashes = self.hashes[self.by_hash]
        self.end = self.words.index(END)
        self.starts, self.nodes, self.bits = huffman(np.append(self.counts, self.rest))
        used = np.frombuffer(" ".join(self.words).encode(), np.uint8)
        self.byte_starts, self.byte_nodes, self.byte_bits = huffman(np.bincount(used, minlength=256) + 1)

    def symbols(self, words: pa.Array) -> np.ndarray:
        return self.symbols_of(words, word_hashes(words))

    def symbols_of(self, words: pa.Array, hashes: np.ndarray) -> np.ndarray:
        """The words' symbols: their hashes are looked for in those of the lexicon, then the words compared."""
        at = np.minimum(np.searchsorted(self.sorted_hashes, hashes), len(self.words) - 1)
        hit = np.flatnonzero(self.sorted_hashes[at] == hashes)
        found = self.by_hash[at[hit]]
        same = pc.equal(self.value_set.take(pa.array(found)), words.take(pa.array(hit)).cast(pa.large_string()))
        same = same.to_numpy(zero_copy_only=False)
        out = np.full(len(words), len(self.words), np.int64)
        out[hit[same]] = found[same]
        return out


def slot(context: np.ndarray, place: np.ndarray, salt: int) -> np.ndarray:
    """Slots of contexts at places that were multiplied by ``MULTIPLIER``. ``context`` is overwritten."""
    context ^= place
    context *= np.uint32(0x85EBCA6B + 2 * salt)
    context >>= np.uint32(32 - SLOT_BITS)
    return context


def path_decisions(lexicon: Lexicon, symbols: np.ndarray, hashes: np.ndarray, starts: np.ndarray) -> Decisions:
    """Bits of the tokens' paths; ``starts`` are the documents' first tokens."""
    size, at = expand(lexicon.starts, symbols)
    place = lexicon.nodes[at] * MULTIPLIER
    context, slots = np.zeros(len(symbols), np.uint64), []
    for back in range(CONTEXTS):
        if back:
            earlier = np.zeros(len(symbols), np.uint64)
            earlier[back:] = hashes[:-back] if len(hashes) > back else hashes[:0]
            for k in range(back):  # nothing stands before a document
                first = starts[:-1][starts[:-1] + k < starts[1:]] + k
                earlier[first] = 0
            context = mix64(context ^ (earlier + np.uint64(back)))
        slots.append(slot(np.repeat(context.astype(np.uint32), size), place, back))
    owner = np.repeat(np.arange(len(symbols), dtype=np.int32), size)
    return Decisions(lexicon.bits[at], slots, owner, np.ones(0), 0)


def spelled(words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of the words, each with its closing space: the bytes, their words and places in them, and
    prefix sums of a rolling hash, which starts anew in every word."""
    size = pc.binary_length(words).to_numpy().astype(np.int64) + 1
    code = np.frombuffer("".join(w + " " for w in words.to_numpy(zero_copy_only=False)).encode(), np.uint8)
    inside = np.arange(len(code)) - np.repeat(starts_of(size)[:-1], size)
    up, _ = powers(SPELL_BASE, int(size.max(initial=1)) + 1)
    sums = np.zeros(len(code) + 1, np.uint64)
    np.cumsum((code + np.uint64(1)) * up[inside], out=sums[1:])
    return code, np.repeat(np.arange(len(words), dtype=np.int32), size), inside, sums


def byte_decisions(lexicon: Lexicon, code: np.ndarray, inside: np.ndarray, sums: np.ndarray, at: np.ndarray,
                   owner: np.ndarray, weight: np.ndarray) -> Decisions:
    """Bits of the bytes at the places ``at``, which have owners and weights."""
    inside = inside[at]
    _, down = powers(SPELL_BASE, int(inside.max(initial=0)) + 2)
    n_bits, bits_at = expand(lexicon.byte_starts, code[at].astype(np.int64))
    place = (lexicon.byte_nodes[bits_at] + SPELL_NODE) * MULTIPLIER
    slots = []
    for k, back in enumerate(SPELL_BACK):
        # The last bytes, as differences of the prefix sums; not over the word's start.
        known = np.minimum(inside, back)
        last = (sums[at] - sums[at - known]) * down[inside - known]
        context = mix64(last + (known.astype(np.uint64) << np.uint64(56))).astype(np.uint32)
        slots.append(slot(np.repeat(context, n_bits), place, 8 + k))
    return Decisions(lexicon.byte_bits[bits_at], slots, np.repeat(owner, n_bits),
                     np.repeat(weight, n_bits) if len(owner) else np.ones(0), 1)


def spelling_decisions(lexicon: Lexicon, words: pa.Array, counts: np.ndarray) -> Decisions:
    """Bits of the bytes of distinct words, each with its closing space; ``counts`` weigh them."""
    code, word, inside, sums = spelled(words)
    return byte_decisions(lexicon, code, inside, sums, np.arange(len(code)), word, counts[word])


def shared_decisions(lexicon: Lexicon, words: pa.Array, counts: np.ndarray) -> tuple[Decisions, np.ndarray, np.ndarray]:
    """As ``spelling_decisions``, but bytes after equal beginnings, whose bits are the same, are decided
    once with their weights summed. Also the word of every byte and the owner of its decisions."""
    code, word, inside, sums = spelled(words)
    begin = sums[1:] - sums[np.arange(len(code)) - inside]
    order = np.argsort(begin)
    fresh = np.ones(len(code), bool)
    fresh[1:] = begin[order[1:]] != begin[order[:-1]]
    # Beginnings are numbered as they first occur.
    first = np.minimum.reduceat(order, np.flatnonzero(fresh))
    number = np.empty(len(first), np.int32)
    number[np.argsort(first)] = np.arange(len(first), dtype=np.int32)
    owner = np.empty(len(code), np.int32)
    owner[order] = number[np.cumsum(fresh) - 1]
    own = byte_decisions(lexicon, code, inside, sums, np.sort(first), np.arange(len(first), dtype=np.int32),
                         np.bincount(owner, counts[word], len(first)))
    return own, word, owner


@dataclass
class Mixer:
    """Weights by gate and the final correction."""

    weights: np.ndarray = field(default_factory=lambda: np.full((GATES, CONTEXTS), 0.4, np.float32))
    seen: np.ndarray = field(default_factory=lambda: np.zeros((GATES, STEPS)))
    ones: np.ndarray = field(default_factory=lambda: np.zeros((GATES, STEPS)))

    def inputs(self, states: list[np.ndarray], spelled: int) -> tuple[list[np.ndarray], np.ndarray]:
        """The log odds, in 1/256, and the gates."""
        gate = np.full(len(states[0]), spelled << 6, np.int16)
        for k, s in enumerate(states[1:]):
            gate |= (s & np.int16(3)) << np.int16(2 * k)
        return [(s >> np.int16(2)).astype(np.float32) for s in states], gate

    def mixed(self, x: list[np.ndarray], gate: np.ndarray) -> np.ndarray:
        columns, at = np.ascontiguousarray(self.weights.T) * np.float32(1 / 256), gate.astype(np.intp)
        total = looked_up(columns[0], at)
        total *= x[0]
        for k in range(1, CONTEXTS):
            part = looked_up(columns[k], at)
            part *= x[k]
            total += part
        return np.clip(total, -12, 12, out=total)

    @staticmethod
    def chance(total: np.ndarray) -> np.ndarray:
        p = np.exp(-total)
        p += 1
        return np.reciprocal(p, out=p)

    @staticmethod
    def cell(total: np.ndarray, gate: np.ndarray) -> np.ndarray:
        """The place in the final table."""
        step = total * np.float32(2)
        np.rint(step, out=step)
        step += np.float32(STEPS // 2)
        return np.clip(step, 0, STEPS - 1, out=step).astype(np.int16) + gate * np.int16(STEPS)

    def learn(self, states: list[np.ndarray], bit: np.ndarray, weight: np.ndarray, spelled: int) -> None:
        """One step on at most ``BATCH`` decisions, which are predicted before it. Without weights all weigh 1."""
        x, gate = self.inputs(states, spelled)
        total = self.mixed(x, gate)
        w = weight if len(weight) else None
        found = np.bincount(self.cell(total, gate) * np.int16(2) + bit, w, 2 * GATES * STEPS)
        ones, found = found[1::2].reshape(GATES, STEPS), (found[::2] + found[1::2]).reshape(GATES, STEPS)
        self.seen += found
        self.ones += ones
        error = bit - self.chance(total)
        if w is not None:
            error *= w
        n, gate = 256. * (found.sum(axis=1) + 50), gate.astype(np.intp)
        for k in range(CONTEXTS):
            self.weights[:, k] += RATE * np.bincount(gate, np.multiply(error, x[k], dtype=np.float64), GATES) / n

    def log_prob(self, states: list[np.ndarray], bit: np.ndarray, spelled: int) -> np.ndarray:
        """Natural logarithm of the probability of each bit."""
        x, gate = self.inputs(states, spelled)
        total = self.mixed(x, gate)
        p = self.chance(total)
        p += looked_up(self.corrected.ravel(), self.cell(total, gate))
        p *= np.float32(.5)
        # A zero has what is left to 1.
        p -= bit ^ 1
        np.abs(p, out=p)
        return np.log(np.clip(p, 1e-6, 1, out=p), out=p)

    def close(self) -> "Mixer":
        middle = 1 / (1 + np.exp(-(np.arange(STEPS) - STEPS // 2) / 2))
        self.corrected = ((self.ones + 20 * middle) / (self.seen + 20)).astype(np.float32)
        return self


def block_parts(lexicon: Lexicon, starts: np.ndarray, words: pa.Array):
    """Tokens of a block (words and one end per document): starts, symbols, decisions of the paths,
    and for the words that the lexicon lacks: their distinct values, numbers and places."""
    n_docs = len(starts) - 1
    token_starts = starts + np.arange(n_docs + 1)
    escape, coded = len(lexicon.words), words.dictionary_encode()
    # Distinct words are hashed and looked up once.
    number, own_hashes = coded.indices.to_numpy(), word_hashes(coded.dictionary)
    own = lexicon.symbols_of(coded.dictionary, own_hashes)
    lacking = np.flatnonzero(own == escape)
    rare = coded.dictionary.take(pa.array(lacking))
    is_end = np.zeros(token_starts[-1], bool)
    is_end[token_starts[1:] - 1] = True
    inner = np.flatnonzero(~is_end)
    symbols = np.full(token_starts[-1], lexicon.end)
    hashes = np.ones(token_starts[-1], np.uint64)
    symbols[inner], hashes[inner] = own[number], own_hashes[number]
    rare_number = np.zeros(len(own), np.int32)
    rare_number[lacking] = np.arange(len(lacking))
    at = np.flatnonzero(own[number] == escape)
    return (token_starts, symbols, path_decisions(lexicon, symbols, hashes, token_starts), rare,
            rare_number[number[at]], inner[at])
