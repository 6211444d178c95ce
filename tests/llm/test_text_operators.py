"""Operators on documents against plain computations over a small, awkward corpus."""

import hashlib
import math
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from paneltide.llm import bpe, langid, line_dedup, lm_scoring, mixing, ngram_join, substrings

rng = random.Random(5)
VOCABULARY = ["".join(rng.choice("abdeinorst") for _ in range(rng.randrange(2, 8))) for _ in range(300)]


def prose(n, seed):
    r = random.Random(seed)
    return " ".join(r.choice(VOCABULARY) for _ in range(n))


def changed(text, every, seed=1):
    words = text.split(" ")
    for i in range(seed, len(words), every):
        words[i] = "changed"
    return " ".join(words)


PASSAGE = prose(70, 99)
CORPUS = [
    (0, None), (1, ""), (2, " \t\n "), (3, "one"), (4, "One  two"), (5, "one two"), (6, prose(200, 1)),
    (7, prose(200, 1)), (8, prose(200, 1).upper()), (9, changed(prose(200, 1), 90)), (10, changed(prose(200, 1), 60, 7)),
    (11, prose(30, 2) + " " + PASSAGE + " " + prose(40, 3)), (12, PASSAGE + "\n" + prose(90, 4)),
    (13, "Größe café 日本語 \x0b  x y " + prose(49, 5)), (14, "x" * 20_000), (15, "na " * 3000),
    (16, prose(20_000, 6)), (17, prose(60, 7) + "\n" + prose(60, 7)), (18, PASSAGE + " " + PASSAGE),
    (19, prose(12, 8) + "\n" + prose(12, 9) + "\n\n"), (20, prose(12, 9) + "\n" + prose(12, 10)),
    (21, changed(prose(40, 11), 100, 20) + "\n" + prose(9, 12)), (22, prose(40, 11) + "\n" + prose(8, 13)),
    (23, prose(120, 14)), (23, prose(120, 14)), (None, prose(200, 1)), (25, "12 + 34 = 46"),
]
WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def words(text, lower=False):
    raw = (text or "").encode()
    return WORD.findall(raw.lower() if lower else raw)


def by_id(df, col="doc_id"):
    out = defaultdict(list)
    for row in df.collect():
        out[row[col]].append(row)
    return out


def test_bpe_matches_library_and_round_trip(documents):
    import public_tokenizers
    import tiktoken

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    tokens = bpe.read_ranks(open(path, "rb").read())
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, special_tokens={},
                            mergeable_ranks={t: i for i, t in enumerate(tokens)})
    texts = [*CORPUS, (30, "<|endoftext|> it's   we'll\n\n 'S"), (31, " lead"), (32, "trail "), (33, "\u0085 ​﻿")]
    found = by_id(bpe.encode_documents(documents(texts), path, public_tokenizers.PATTERN, with_ids=True))
    assert sum(map(len, found.values())) == len(texts)
    for i, text in texts:
        ids = own.encode_ordinary(text or "")
        row = found[i][0]
        assert row.ids == ids and row.n_tokens == len(ids)
        assert row.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert bytes(row.decoded) == (text or "").encode()
        assert row.decoded_sha256 == hashlib.sha256((text or "").encode()).hexdigest()


def test_bpe_ranks_that_rise_and_fall():
    """A vocabulary in which a merge makes room for a lower one; every piece against the plain rule."""
    extra = [b"ab", b"bc", b"abc", b"cab", b"aa", b"aab", b"bb", b"abcab", b"ca", b"aaa"]
    letters = [bytes([b]) for b in range(256)]
    for seed in range(20):
        tokens = [*letters, *random.Random(seed).sample(extra, len(extra))]
        codec = bpe.Codec(tokens, r"\S+")
        r = random.Random(seed)
        texts = ["".join(r.choice("abc") for _ in range(r.randrange(1, 14))) for _ in range(200)]
        for text, got in zip(texts, codec.encode(texts), strict=True):
            parts = [bytes([b]) for b in text.encode()]
            while codec.rank.get(text.encode()) is None:
                ranks = [(codec.rank.get(a + b, 10 ** 9), i) for i, (a, b) in enumerate(zip(parts, parts[1:]))]
                if not ranks or min(ranks)[0] == 10 ** 9:
                    break
                i = min(ranks)[1]
                parts[i:i + 2] = [parts[i] + parts[i + 1]]
            else:
                parts = [text.encode()]
            assert got.tolist() == [codec.rank[p] for p in parts], text


def test_substrings_match_brute_force(documents):
    found = by_id(substrings.drop_repeats(documents(CORPUS), with_text=True))
    first = {}
    for i, text in sorted((r for r in CORPUS if r[0] is not None), key=lambda r: r[0]):
        own = words(text)
        for s in range(len(own) - 49):
            first.setdefault(tuple(own[s:s + 50]), i)
    for i, text in CORPUS:
        own = words(text)
        gone = [False] * len(own)
        for s in range(len(own) - 49):
            if i is not None and first[tuple(own[s:s + 50])] < i:
                gone[s:s + 50] = [True] * 50
        kept = b" ".join(w for w, g in zip(own, gone, strict=True) if not g)
        for row in found[i]:
            assert (row.n_words, row.n_removed) == (len(own), sum(gone)), i
            assert row.kept_sha256 == hashlib.sha256(kept).hexdigest() and row.kept_text.encode() == kept
    assert len(found[23]) == 2 and found[7][0].n_removed == 200 and found[8][0].n_removed == 0


def brute_groups(rows, size, percent):
    """Sets of n-grams and smallest reachable ids."""
    sets, top, _ = brute_links(rows, size, percent)
    return sets, top


def brute_links(rows, size, percent):
    """Sets of n-grams, smallest reachable ids and numbers of links."""
    sets = {}
    for i, text in rows:
        own = words(text, lower=True)
        sets[i] = {tuple(own[s:s + size]) for s in range(len(own) - size + 1)} if len(own) >= size else (
            {tuple(own)} if own else set())
    ids = sorted(i for i in sets if i is not None)
    links = [(a, b) for a in ids for b in ids if a < b and (both := len(sets[a] & sets[b]))
             and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both)]
    top = {i: i for i in ids}
    for _ in ids:
        for a, b in links:
            top[a] = top[b] = min(top[a], top[b])
    return sets, top, {i: sum(i in pair for pair in links) for i in ids}


@pytest.mark.parametrize("size,percent", [(3, 90), (5, 80)])
def test_jaccard_groups_match_brute_force(documents, size, percent):
    found = by_id(ngram_join.jaccard_groups(documents(CORPUS), size, percent))
    sets, top, links = brute_links(CORPUS, size, percent)
    for i, _ in CORPUS:
        for row in found[i]:
            assert row.n_shingles == len(sets[i]) and row.component_id == (None if i is None else top[i])
            assert row.n_links == links.get(i, 0)
    assert {top[i] for i in (6, 7, 8, 9)} == {6} and top[5] == 4 and top[12] == 12


@pytest.mark.parametrize("block,counted", [(1024, 2048), (7, 16)])
def test_jaccard_many_near_copies(documents, monkeypatch, block, counted):
    """A large group with links of all shapes, in one block and in many."""
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    monkeypatch.setattr(ngram_join, "COUNTED", counted)
    base = prose(100, 21).split(" ")
    rows = [(i, " ".join(base[:5 * (i % 7)] + ["other"] * (i % 3) + base[5 * (i % 7):])) for i in range(60)]
    found = ngram_join.jaccard_groups(documents(rows), 3, 90).collect()
    _, top, links = brute_links(rows, 3, 90)
    assert {r.doc_id: r.component_id for r in found} == top
    assert {r.doc_id: r.n_links for r in found} == links and len(set(links.values())) > 2


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def plain_simhash(line):
    hashes = [xxhash.xxh64_intdigest(w.encode(), 42) for w in line.split()]
    return sum(1 << j for j in range(56) if sum(h >> j & 1 for h in hashes) > len(hashes) / 2)


def brute_lines(rows):
    """(document, line number) of the lines that go."""
    occurrences = defaultdict(list)
    for i, text in rows:
        for n, line in enumerate((text or "").split("\n")):
            plain = re.sub(r"[\W_]+", " ", line.lower()).strip()
            if i is not None and plain:
                occurrences[plain].append((i, n))
    lines = list(occurrences)
    top = list(range(len(lines)))

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for a in range(len(lines)):
        for b in range(a):
            size = max(len(lines[a]), len(lines[b]))
            if min(len(lines[a]), len(lines[b])) >= .8 * size and edit_distance(lines[a], lines[b]) <= .2 * size:
                x, y = find(a), find(b)
                top[max(x, y)] = min(x, y)
    groups = defaultdict(set)
    for x, line in enumerate(lines):
        groups[find(x)] |= set(occurrences[line])
    return {place for places in groups.values() for place in sorted(places)[1:]}


def test_line_dedup(documents):
    rows = [r for r in CORPUS if r[0] not in (14, 16)]
    out = line_dedup.dedup_lines(documents(rows))
    assert {"id", "n", "size", "component"} <= set(out.columns)
    found, gone = by_id(out), brute_lines(rows)
    for i, text in rows:
        for row in found[i]:
            split = (text or "").split("\n")
            kept = [line for n, line in enumerate(split) if (i, n) not in gone]
            assert row.text == (None if text is None else "\n".join(kept)), i
            assert row._n_removed == len(split) - len(kept)
            assert row._n_lines == (0 if text is None else len(split))
    assert (21, 0) not in gone and (20, 0) in gone and (7, 0) in gone


def edited(line, share, seed):
    """``line`` with edits of single characters, up to ``share`` of its size."""
    r, out = random.Random(seed), list(line)
    for _ in range(int(share * len(line))):
        i = r.randrange(len(out))
        kind = r.randrange(3)
        out[i:i + (kind != 1)] = [] if kind == 2 and len(out) > 1 else [r.choice("abdeinorst")]
    return "".join(out)


def test_line_dedup_finds_pairs_of_the_asked_similarity(documents):
    """Recall against plain edit similarity, by the kind of the lines and of the edits."""
    han = [chr(0x4E00 + n) for n in range(0, 9000, 3)]
    r = random.Random(3)
    kinds = {}
    for n in range(40):
        for k, size in enumerate((3, 6, 12, 20)):  # one word replaced
            line = prose(size, 1000 * k + n)
            own = line.split(" ")
            own[r.randrange(size)] = r.choice(VOCABULARY)
            kinds.setdefault(f"word of {size}", []).append((line, " ".join(own)))
        for size in (5, 12, 30):  # characters
            line = prose(size, 5000 + 100 * size + n)
            kinds.setdefault(f"characters of {size}", []).append((line, edited(line, .15, n)))
        line = "".join(r.choice(han) for _ in range(10 + n))
        kinds.setdefault("no spaces", []).append((line, line[:n // 4] + "\u4e01" + line[n // 4 + 1:]))
        line = "".join(r.choice("abdeinorst") for _ in range(5 + n % 8))
        kinds.setdefault("tiny", []).append((line, edited(line, .2, n)))
    for kind, pairs in kinds.items():
        pairs[:] = [(a, b) for a, b in pairs if a != b and b.strip() == b and "  " not in b
                    and edit_distance(a, b) <= .2 * max(len(a), len(b)) + 1e-9]
    rows = [(i, text) for i, text in enumerate(t for pairs in kinds.values() for pair in pairs for t in pair)]
    gone = {r.doc_id for r in line_dedup.dedup_lines(documents(rows)).collect() if r._n_removed}
    at = 0
    for kind, pairs in kinds.items():
        assert len(pairs) >= 5, kind
        found = sum(at + 2 * n + 1 in gone for n in range(len(pairs)))
        assert found >= .9 * len(pairs), (kind, found, len(pairs))
        at += 2 * len(pairs)


def test_line_dedup_links_lines_of_any_form(documents):
    rows = [(0, "Copyright 2023 Example"), (1, "Copyright 2024 Example"), (2, "Example 9"), (3, "Copyright"), (4, "ab"),
            (5, "ac"), (6, prose(200, 1)), (10, changed(prose(200, 1), 60, 7)), (11, "\u65e5\u672c\u8a9e\u306e\u6587"),
            (12, "\u65e5\u672c\u8a9e\u306e\u672c"), (13, None)]
    gone = {r.doc_id for r in line_dedup.dedup_lines(documents(rows)).collect() if r._n_removed}
    assert gone == {1, 10, 12}


def test_line_dedup_keeps_marks_and_clashing_names(documents):
    """Vowel signs tell words apart; columns with the names used inside are passed on."""
    rows = [(0, "यह कि है"), (1, "यह की है"), (2, "ที่นี่ดี"), (3, "ทีนีดี"), (4, "\u0301\u0301"), (5, "\u0301\u0301")]
    docs = documents(rows).withColumnsRenamed({"id": "_id", "n": "_twin", "size": "_gone", "component": "_ID2"})
    out = line_dedup.dedup_lines(docs, 0.9).collect()
    assert sorted((r.doc_id, r.text) for r in out) == rows and {(r._id, r._twin, r._gone) for r in out} == {("x", "y", "z")}


def test_simhash_is_the_majority_of_bits(spark, monkeypatch):
    """Both lane widths, against bits counted one by one."""
    from pyspark.sql import functions as F

    monkeypatch.setattr(line_dedup, "LANE_WORDS", 300)
    texts = [prose(n, n) for n in (4, 7, 126, 127, 128, 129, 300, 301, 400)]
    df = (spark.createDataFrame(list(enumerate(texts)), "row bigint, t string")
          .select("row", F.lit(1).alias("line"), F.lit(1).alias("size"), F.split("t", " ").alias("words")))
    got = {r.row: r.sim for r in line_dedup.simhashes(df).collect()}
    assert got == {n: plain_simhash(t) for n, t in enumerate(texts)}


def test_line_simhash_sums_places_by_rows(spark, monkeypatch):
    """The same hashes as from every n-gram on its own, for ends in and at a row and for long lines."""
    from pyspark.sql import functions as F

    monkeypatch.setattr(line_dedup, "LANE_WORDS", 500)
    texts = ["a", "ab", "abcdefg", "abcdefgh", "abcdefghi", "x\U00020000y\U00020001zz", "\u65e5\u672c\u8a9e",
             *[prose(n, n)[:size] for n, size in ((60, 255), (60, 256), (120, 499), (120, 500), (120, 501))]]
    df = spark.createDataFrame(list(enumerate(texts)), "line bigint, norm string").select("line", F.length("norm").alias("size"), "norm")
    got = {r.line: r.sim for r in line_dedup.line_simhashes(df).collect()}
    plain = line_dedup.simhashes(df.select(F.lit(0).alias("row"), "line", "size", line_dedup.grams(F.col("norm"), 3).alias("words")))
    assert len(got) == len(texts) and got == {r.line: r.sim for r in plain.collect()}


def test_stored_tables_leave_no_shuffle_files(spark):
    from paneltide.llm.common import SHUFFLES_GO, store

    def shuffled():
        return set(re.findall(r"shuffle_\d+_\d+_\d+\.data", spark._jvm.org.apache.spark.SparkEnv.get().blockManager()
                              .diskBlockManager().getAllFiles().mkString(" ")))

    before, setting = shuffled(), spark.conf.get(SHUFFLES_GO, None)
    out = store(spark.range(100_000, numPartitions=4).groupBy("id").count(), "counts")
    for _ in range(50):
        if not shuffled() - before:
            break
        time.sleep(.1)
    assert not shuffled() - before and spark.conf.get(SHUFFLES_GO, None) == setting
    assert out.count() == 100_000


def test_line_features_are_ngrams_of_whole_characters(spark):
    """From every place on, whatever the script; hashed as four bytes a character."""
    from pyspark.sql import functions as F

    lines = ["a", "ab", "abc d", "\u65e5\u672c\u8a9e\u306e\u6587", "x\U00020000y\U00020001zz", prose(40, 3)]
    df = spark.createDataFrame([(t,) for t in lines], "t string")
    for line, words, hashes in df.select("t", line_dedup.grams(F.col("t"), 3), line_dedup.inner_grams(F.col("t"), 4)).collect():
        plain = [line[i:i + 3].encode("utf-32-be") for i in range(len(line))]
        assert [bytes(w) for w in words] == plain
        full = [xxhash.xxh64_intdigest(line[i:i + 4].encode("utf-32-be"), 42) for i in range(len(line) - 3)]
        assert [h % (1 << 64) for h in hashes or []] == full


def test_lm_learns_on_a_shard_of_one_block(spark):
    """Also one text alone moves the weights and fills the correction."""
    texts = spark.createDataFrame([(prose(3000, 31),)], "text string").coalesce(1)
    lexicon, *_ = lm_scoring.make_lexicon(lm_scoring.count_words(texts))
    _, mixer = lm_scoring.train(texts, lexicon)
    assert np.abs(mixer.weights - 0.4).max() > 0.01
    per_word = np.diff(lexicon.starts)[lexicon.symbols(pa.array(prose(3000, 31).split(" "), pa.large_string()))]
    assert mixer.seen.sum() == per_word.sum() + lexicon.starts[1]  # every bit of every token taught once


def test_mix_matches_plain_queueing(documents):
    rows = [(i, prose(10 + i % 50, i), None, [None, "a", "b", "ä", "Z", "a"][i % 6]) for i in range(150)]
    rows += [(200, None, None, "b"), (201, "", None, "c"), (202, "single", None, "d")]
    found = by_id(mixing.mix(documents(rows)))
    sizes = {i: len(words(t)) for i, t, *_ in rows}
    of = {i: s for i, _, _, s in rows}
    names = sorted({s for s in of.values() if s is not None}, key=lambda s: s.encode()) + [None]
    full = {s: sum(sizes[i] for i in of if of[i] == s) for s in names}
    weight = {s: (3, 1, 2)[n % 3] for n, s in enumerate(names)}
    closed, total = set(), 1.5 * sum(full.values())
    while True:  # fill by weight, close what is over, share the rest
        rest = total - sum(2 * full[s] for s in closed)
        share = {s: rest * weight[s] / sum(weight[x] for x in names if x not in closed) for s in names if s not in closed}
        over = {s for s in share if share[s] > 2 * full[s]}
        if not over:
            break
        closed |= over
    target = {s: share.get(s, 2 * full[s]) for s in names}
    taken = Counter()
    for i, *_ in rows:
        row = found[i][0]
        assert row.size == sizes[i] and row.source_size == full[of[i]] and math.isclose(row.target, target[of[i]])
        assert row.taken in (0, row.size, 2 * row.size)
        taken[of[i]] += row.taken
    for s in names:
        assert abs(taken[s] - target[s]) <= 60
    assert sum(taken.values()) <= total
    again = by_id(mixing.mix(documents(rows).repartition(5)))
    assert {i: r[0].taken for i, r in again.items()} == {i: r[0].taken for i, r in found.items()}


def test_mix_keeps_repeated_rows(documents):
    rows = [(1, "a b c", None, "s")] * 3 + [(None, "d e", None, "s"), (None, None, None, None)]
    out = mixing.mix(documents(rows)).collect()
    assert len(out) == 5 and sum(r.taken for r in out) <= 1.5 * 11


def test_language_id(documents):
    def text(kind, i):
        r = random.Random(i)
        return " ".join("".join(r.choice(kind) for _ in range(4)) for _ in range(40))

    kinds = {"xx": ["th", "in", "er"], "yy": ["ou", "eau", "que"], "zz": ["日", "本", "語"]}
    rows = [(i, text(kinds[k], i), k) for i, k in enumerate(list(kinds) * 20)]
    docs = documents(rows)
    model = langid.fit(docs)
    asked = documents([(1000 + i, text(kinds[k], 1000 + i), k) for i, k in enumerate(list(kinds) * 5)]
                      + [(None, None, "xx"), (2, "", "xx"), (3, "12 34 !", "xx"), (4, "THTHIN ERTH", None)])
    got = langid.predict(asked, model, ["doc_id", "lang"]).collect()
    assert all(r.lang_pred == r.lang and .5 < r.score <= 1 for r in got if (r.doc_id or 0) >= 1000)
    assert [r.lang_pred for r in got if (r.doc_id or 0) < 1000] == ["und", "und", "und", "xx"]
    nothing = langid.fit(documents([(1, "text", None), (2, None, "xx")]))
    assert {r.lang_pred for r in langid.predict(asked, nothing, ["doc_id"]).collect()} == {"und"}


def test_lm_scoring_baseline_and_gain(documents):
    rows = [*CORPUS, *[(100 + i, prose(300, 100 + i)) for i in range(60)]]
    found = by_id(lm_scoring.score(documents(rows)))
    counts = Counter()
    for i, text in rows:
        if i is None or zlib.crc32(str(i).encode()) % 5 != 1:
            counts.update([*words(text, lower=True), b""])
    n, v = sum(counts.values()), len(counts)
    for i, text in rows:
        own = [*words(text, lower=True), b""]
        base = sum(math.log10((counts[w] + .5) / (n + .5 * (v + 1))) for w in own)
        for row in found[i]:
            assert math.isclose(row.base_score, base, rel_tol=1e-9)
            assert (row.n_tokens, row.n_known, row.train_tokens) == (len(own), sum(counts[w] > 0 for w in own), n)
            assert row.held_out == (i is not None and zlib.crc32(str(i).encode()) % 5 == 1)
            assert row.score < 0 and (row.bits_per_byte is None) == (not text)
    held = [r for rs in found.values() for r in rs if r.held_out and r.doc_id and r.doc_id >= 100]
    assert sum(r.score for r in held) > 1.1 * sum(r.base_score for r in held)


def test_lm_counts_beyond_32_bits():
    """Sums over many shards, each within 32 bits."""
    part = np.array([(3 << 30) << 32 | 2 << 30, 1 << 32], np.uint64)
    (chunk, uses, ones), = lm_scoring.add_slices([(5, part.tobytes())] * 7)
    assert chunk == 5 and uses.tolist() == [7 * (3 << 30), 7] and ones.tolist() == [7 * (2 << 30), 0]
    (chunk, sums, none), = lm_scoring.add_slices([(-1, np.array([.5, 2.]).tobytes())] * 3)
    assert chunk == -1 and sums.tolist() == [1.5, 6.] and none is None


def test_lm_probabilities_sum_to_one():
    """Over all symbols of a code, whatever the weights say."""
    from paneltide.llm import mixing_model as m

    lexicon = m.Lexicon(["", "a", "b", "c"], np.array([5, 9, 2, 1]), 3)
    symbols, hashes = np.arange(5), np.full(5, 7, np.uint64)
    d = m.path_decisions(lexicon, symbols, hashes, np.arange(6))
    mixer = m.Mixer().close()
    r = np.random.default_rng(1)
    states = [r.integers(-5000, 5000, 1 << m.SLOT_BITS, dtype=np.int16)[at] for at in d.slots]
    log_prob = np.bincount(d.owner, mixer.log_prob(states, d.bit, 0), 5)
    assert math.isclose(np.exp(log_prob).sum(), 1, rel_tol=1e-5)


def test_lm_spells_by_a_code_of_the_bytes():
    """Usual bytes take few bits, any byte has a code, and the codes leave nothing over."""
    from paneltide.llm import mixing_model as m

    frequent = sorted({prose(1, n) for n in range(300)})
    lexicon = m.Lexicon(["", *frequent], np.arange(len(frequent) + 1, 0, -1), 3)
    words = pa.array([prose(1, 900 + n) + "no" for n in range(50)], pa.large_string())
    d = m.spelling_decisions(lexicon, words, np.arange(50))
    n_bytes = [len(w) + 1 for w in words.to_pylist()]
    assert len(d.bit) < 5 * sum(n_bytes) and d.owner.tolist() == sorted(d.owner) and set(d.owner) == set(range(50))
    assert (d.weight == d.owner).all() and all(len(at) == len(d.bit) and at.max() < 1 << m.SLOT_BITS for at in d.slots)
    odd = m.spelling_decisions(lexicon, pa.array(["\u4e2d\U0001f600\x01"], pa.large_string()), np.ones(1))
    assert len(odd.bit) > 8 * 8 and set(odd.owner) == {0}
    assert math.isclose((.5 ** np.diff(lexicon.byte_starts)).sum(), 1)


def test_lm_spells_equal_beginnings_once():
    """Fewer decisions, but the same counts in every slot and the same probability of every word."""
    from paneltide.llm import mixing_model as m

    frequent = sorted({prose(1, n) for n in range(300)})
    lexicon = m.Lexicon(["", *frequent], np.arange(len(frequent) + 1, 0, -1), 3)
    words = pa.array([a + b for a in frequent[:20] for b in frequent[20:40]], pa.large_string())
    times = np.arange(1, len(words) + 1)
    plain = m.spelling_decisions(lexicon, words, times)
    shared, word, owner = m.shared_decisions(lexicon, words, times)
    assert len(shared.bit) < .7 * len(plain.bit)
    mixer, r = m.Mixer().close(), np.random.default_rng(1)
    states = r.integers(-5000, 5000, 1 << m.SLOT_BITS, dtype=np.int16)
    for k in range(m.CONTEXTS):
        uses, ones = ([np.bincount(d.slots[k], d.weight * bit, 1 << m.SLOT_BITS) for bit in (1, d.bit)]
                      for d in (plain, shared))
        assert all((a == b).all() for a, b in zip(uses, ones, strict=True))
    per = [np.bincount(d.owner, mixer.log_prob([states[at] for at in d.slots], d.bit, 1)) for d in (plain, shared)]
    assert np.allclose(np.bincount(word, per[1][owner]), per[0], rtol=1e-5)
    assert (lexicon.symbols(pa.array([*frequent, "", *words.to_pylist()], pa.large_string()))
            == [*range(1, len(frequent) + 1), 0, *(frequent.index(w) + 1 if w in frequent else len(frequent) + 1
                                                   for w in words.to_pylist())]).all()


def test_lm_states_of_small_and_large_counts():
    from paneltide.llm import mixing_model as m

    r = np.random.default_rng(4)
    for most in (1, 3, 255, 256, 400, 1 << 31):
        n = r.integers(0, most, 3000, endpoint=True)
        ones = (n * r.random(3000)).astype(np.int64)
        cells = n.astype(np.uint64) << np.uint64(32) | ones.astype(np.uint64)
        plain = m.state(n.astype(np.float32), ones.astype(np.float32))
        assert np.array_equal(m.states_of(cells), plain)
        odds = np.log((ones + .4) / (n - ones + .4)) * 256
        assert (np.abs((plain >> 2) - np.clip(odds, -2047, 2047)) <= 1).all()
        assert np.array_equal(plain & 3, (n > 0).astype(int) + (n > 2) + (n > 15))


@pytest.mark.parametrize("rows", [[], [(1, None)], [(None, None)], [(1, ""), (1, "")]])
def test_empty_and_null_tables(documents, rows):
    import public_tokenizers

    docs = documents(rows)
    n = len(rows)
    assert substrings.drop_repeats(docs).count() == n
    assert ngram_join.jaccard_groups(docs, 3, 90).count() == n
    assert line_dedup.dedup_lines(docs).count() == n
    assert mixing.mix(docs).count() == n
    assert lm_scoring.score(docs).count() == n
    assert {r.lang_pred for r in langid.predict(docs, langid.fit(docs), ["doc_id"]).collect()} <= {"und"}
    out = bpe.encode_documents(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    assert [r.n_tokens for r in out.collect()] == [0] * n


def brute_mix(rows):
    """Times that (id, text, source) rows are taken."""
    sizes = [len(words(t)) for _, t, _ in rows]
    names = sorted({s for *_, s in rows}, key=lambda s: (s is None, (s or "").encode()))
    full = {s: sum(n for n, r in zip(sizes, rows, strict=True) if r[2] == s) for s in names}
    weight = {s: (3., 1., 2.)[n % 3] for n, s in enumerate(names)}
    target, left, total = {}, sorted(names, key=lambda s: (full[s] / weight[s], names.index(s))), 1.5 * sum(full.values())
    while left:
        level = total / sum(weight[s] for s in left)
        if level * weight[left[0]] <= 2 * full[left[0]]:
            target |= {s: level * weight[s] for s in left}
            break
        target[left[0]] = 2. * full[left[0]]
        total -= target[left.pop(0)]
    takes, upto = [], Counter()
    place = [int(hashlib.md5(f"{'null' if r[0] is None else r[0]}{mixing.SEED}".encode()).hexdigest()[:15], 16) for r in rows]
    for k in sorted(range(len(rows)), key=lambda k: (place[k], rows[k][0] is None, rows[k][0] or 0, sizes[k])):
        s = rows[k][2]
        upto[s] += sizes[k]
        takes += [((upto[s] + p * full[s]) / target[s], names.index(s), place[k], rows[k][0] is None, rows[k][0] or 0,
                   sizes[k], p, k) for p in (0, 1) if sizes[k]]
    times, total = Counter(), 0
    for take in sorted(takes):
        total += sizes[take[-1]]
        if total > sum(target.values()):
            break
        times[take[-1]] += 1
    return times


def test_pipeline_matches_brute_force(spark, documents, tmp_path):
    """All five stages over a corpus, against the plain versions one after the other."""
    import public_tokenizers
    import tiktoken

    import corpus_pipeline

    rows = [(i, t, "en", ["a", "b", None][n % 3]) for n, (i, t) in enumerate(CORPUS)
            if i not in (14, 15, 16, 23, None)]
    rows += [(300 + i, prose(80, 300 + i) + "\n" + prose(20, 400 + i % 7), "en", "ab"[i % 2]) for i in range(30)]
    rows += [(400 + i, "\n".join(prose(12, 500 + j) if j != i else "now for something else it is" for j in range(40)),
              "en", "c") for i in range(3)]
    documents(rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((r.doc_id, r.n_tokens, r.ids_sha256) for r in corpus_pipeline.run(spark, str(tmp_path)).collect())
    now = [(i, t, s) for i, t, _, s in rows if t and any(c.isalpha() for c in t)]
    gone = brute_lines([r[:2] for r in now])
    kept = []
    for i, text, s in now:
        left = "\n".join(line for n, line in enumerate(text.split("\n")) if (i, n) not in gone)
        if left == text or any(c.isalnum() for c in left):
            kept.append((i, left, s))
    top = brute_groups([r[:2] for r in kept], corpus_pipeline.SHINGLE_WORDS, corpus_pipeline.SIMILARITY)[1]
    kept = [r for r in kept if top[r[0]] == r[0]]
    times = brute_mix(kept)
    tokens = bpe.read_ranks(open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb").read())
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, special_tokens={},
                            mergeable_ranks={t: i for i, t in enumerate(tokens)})
    wanted = []
    for k, (i, text, _) in enumerate(kept):
        ids = own.encode_ordinary(text)
        wanted += [(i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())] * times[k]
    assert got == sorted(wanted) and len(got) > 30
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, documents(rows), "").columns == documents(rows).columns, name
    assert corpus_pipeline.STAGES[-1][1](spark, documents([]), "").count() == 0
