"""Token files, Merkle manifests and lexical search against plain versions."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from paneltide.llm import lexical, manifest, token_files
from paneltide.llm.common import store

rng = random.Random(8)
VOCABULARY = ["".join(rng.choice("abdeinorstAé") for _ in range(rng.randrange(2, 8))) for _ in range(120)]


def prose(n, seed):
    r = random.Random(seed)
    return " ".join(VOCABULARY[min(119, int(r.expovariate(.05)))] for _ in range(n))


CORPUS = [(0, None), (1, ""), (2, " \t\n "), (3, "one"), (4, "Größe café 日本語 \x0b x  y"), (5, "x" * 20_000),
          (6, prose(8000, 1)), (7, "a ,b.\n\n c ...,d.e 3.14, 'tis it's\r\n.x <|endoftext|>\x1c ,"), (8, prose(40, 2)), (9, prose(40, 2)),
          (9, prose(40, 2)), (None, prose(40, 2)), (None, None), (-3, "minus " + prose(5, 3)), (12, "\n" + prose(60, 4) + "\n")]
CORPUS += [(100 + i, prose(30 + i % 9, 50 + i % 31)) for i in range(90)]


def sources(rows):
    return [(i, t, [None, "en", "de"][n % 3], [None, "a", "b", "ä", "Z"][n % 5] if n % 4 else "hot")
            for n, (i, t) in enumerate(rows)]


def tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    own = Tokenizer.from_file(path)
    own.encode_special_tokens = True
    return own, open(path, encoding="utf-8").read()


def test_stretches_give_the_ids_of_whole_texts():
    own, content = tokenizer()
    encoder, r = token_files.Encoder(content), random.Random(1)
    parts = ["a", "B", "é", "  ", " ", "\n", "\n\n", ",", ".", "..", "'s", "'", "3", "中", "ß", "\t", " ", "\x1c", "word", "!",
             " ,", "Ж", "́", "ʰ", "²", "\r\n", " ", "　", "<|endoftext|>"]
    for size in (0, 3, 12, 40):
        texts = ["".join(r.choices(parts, k=r.randint(0, size))) for _ in range(400)]
        ids, starts = encoder.encode(pa.array(texts))
        wanted = own.encode_batch(texts, add_special_tokens=False)
        assert [ids[a:b].tolist() for a, b in zip(starts[:-1], starts[1:])] == [e.ids for e in wanted]


def test_known_stretches_cost_less_than_a_scalar_of_each():
    """Texts whose stretches are known already are not taken apart into Arrow scalars."""
    import time

    encoder, r = token_files.Encoder(tokenizer()[1]), random.Random(2)
    words = list({"".join(r.choices("abdeinorst", k=7)) for _ in range(100_000)})
    texts, scalars = pa.array([" ".join(words)]), pa.array(words, pa.large_string())

    def least(run):
        took = []
        for _ in range(5):
            start = time.process_time()
            run()
            took.append(time.process_time() - start)
        return min(took)

    encoder.encode(texts)
    assert least(lambda: encoder.encode(texts)) < 1.2 * least(scalars.to_pylist)


@pytest.mark.parametrize("file_tokens", [1 << 21, 700])
def test_token_files_hold_all_ids_in_order(documents, monkeypatch, file_tokens):
    own, content = tokenizer()
    monkeypatch.setattr(token_files, "FILE_TOKENS", file_tokens)
    tokens = store(token_files.tokenize(documents(CORPUS).repartition(3), content), "tokens")
    model = token_files.count_ids(tokens)
    files = store(token_files.write_files(tokens, model), "files")
    got = sorted(token_files.read_files(token_files.with_starts(files), model).collect(), key=lambda r: r.start)
    assert (files.count() > 8) == (file_tokens < 1000)
    at = 0
    texts = Counter((i, t or "") for i, t in CORPUS)
    for row, last in zip(got, [None, *got]):
        ids = np.frombuffer(row.ids, "<u4")
        assert (row.start, row.n_tokens) == (at, len(ids)) and ids[-1] == 0 and row.ids_crc32 == zlib.crc32(row.ids)
        texts[row.doc_id, own.decode(ids[:-1].tolist(), skip_special_tokens=False)] -= 1
        assert last is None or (last.doc_id is None, last.doc_id or 0) >= (row.doc_id is None, row.doc_id or 0) or \
            last.doc_id is None or last.doc_id <= row.doc_id
        at += len(ids)
    assert not +texts and len(got) == len(CORPUS) and [r.doc_id for r in got[:2]] == [None, None]
    wanted = {i: own.encode(t or "", add_special_tokens=False).ids for i, t in CORPUS if i is not None}
    assert all(np.frombuffer(r.ids, "<u4").tolist() == [*wanted[r.doc_id], 0] for r in got if r.doc_id is not None)


@pytest.mark.parametrize("n", [1, 127, 128, 129, 5000, 9000])
def test_file_round_trip_ranges_and_checksums(monkeypatch, n):
    monkeypatch.setattr(token_files, "BLOCK_TOKENS", 4096)
    monkeypatch.setattr(token_files, "SEGMENT_STEPS", 8)
    r = np.random.default_rng(n)
    ids = np.minimum(r.pareto(.6, n) * 5, 70_000).astype(np.uint32)
    model = token_files.Frequencies(np.bincount(ids))
    assert model.freq.sum() == 1 << token_files.SCALE_BITS and (model.freq[ids] > 0).all()
    sizes = np.array([n // 2, n - n // 2])
    raw = token_files.pack_file([None, -5], sizes, ids, model)
    file = token_files.TokenFile(raw, model)
    assert file.doc_ids.to_pylist() == [None, -5] and file.sizes.tolist() == sizes.tolist()
    assert (file.ids() == ids).all()
    for start, stop in [(0, 1), (n - 1, n), (n // 3, n // 2 + 1), (n // 5, n), (n, n + 5), (4090, 4100)]:
        assert file.ids(start, stop).tolist() == ids[start:stop].tolist()
    for at in (0, 9, len(raw) - 1, len(raw) // 2, token_files.HEAD + 20):
        broken = bytearray(raw)
        broken[at] ^= 1
        with pytest.raises(ValueError):
            token_files.TokenFile(bytes(broken), model).ids()
    with pytest.raises(ValueError):
        token_files.TokenFile(raw[:-1], model)
    with pytest.raises(ValueError):
        token_files.TokenFile(raw, token_files.Frequencies(np.bincount(ids) + 1))


def test_frequencies_near_their_limit():
    """As many ids as slots, one of them far ahead."""
    model = token_files.Frequencies(np.array([10 ** 15] + [1] * 255 + [0]), bits=8)
    assert model.freq.tolist() == [1] * 256 + [0]
    model = token_files.Frequencies(np.array([3, 10 ** 15, 0, 1]), bits=8)
    assert model.freq.tolist() == [1, 254, 0, 1]
    with pytest.raises(ValueError):
        token_files.Frequencies(np.ones(257, np.int64), bits=8)


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_leaf(doc_id, source, lang, n_chars, text):
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)])


def plain_tree(nodes):
    """The last node, and the siblings of each leaf from the bottom up."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for leaf, i in enumerate(at):
            run = nodes[i // 16 * 16:i // 16 * 16 + 16]
            paths[leaf].append((run[:i % 16], run[i % 16 + 1:]))
        nodes, at = [h(*nodes[i:i + 16]) for i in range(0, len(nodes), 16)], [i // 16 for i in at]
    return nodes[0], paths


def plain_manifest(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r[1], []).append((r, plain_leaf(*r)))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in names:
        groups[s].sort(key=lambda x: (x[0][0] is not None, x[0][0] or 0, x[1]))
        trees[s] = plain_tree([leaf for _, leaf in groups[s]])
    root, above = plain_tree([trees[s][0] for s in names])
    out = []
    for s, tops in zip(names, above, strict=True):
        for (r, leaf), path in zip(groups[s], trees[s][1], strict=True):
            node = leaf
            if r[0] is not None and r[4] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0:
                node = plain_leaf(*r[:4], "".join(c.lower() if "A" <= c <= "Z" else c for c in r[4]))
            for before, after in [*path, *tops]:
                node = h(*before, node, *after)
            proof = h(*[x for before, after in [*path, *tops] for x in [*before, *after]])
            out.append((r[0], leaf, trees[s][0], root, proof, node, node == root))
    return sorted(out, key=str)


def shown(df):
    return sorted(((r.id, r.leaf, r.subroot, r.root, r.proof_sha256, r.folded_root, r.verified)
                   for r in manifest.manifest(df).collect()), key=str)


@pytest.mark.parametrize("n", [1, 16, 17, 256, 257, 700, 5000])
def test_manifest_matches_plain_trees(spark, n):
    """Sources of one leaf, of full and broken runs, of one block and of several; ids that repeat."""
    names = [None, "", "a", "Z", "ä", "b"] + [f"s{i}" for i in range(20 if n >= 700 else 0)]
    r = random.Random(n)
    rows = [(i if i % 50 else None, "hot" if r.random() < .6 else r.choice(names), r.choice([None, "en"]), i % 7 or None,
             None if i % 11 == 0 else f"Text {i % 13} É") for i in range(n)]
    rows += rows[:3]
    df = spark.createDataFrame([(*x, "clash", "clash") for x in rows],
                               "doc_id bigint, source string, lang string, n_chars bigint, text string, id string, pos string")
    got, wanted = shown(df.repartition(4)), plain_manifest(rows)
    assert got == wanted
    if n >= 256:
        assert {v for *_, v in got} == {True, False}


def test_manifest_of_whole_rows_folds_to_the_root(documents):
    rows = sources(CORPUS)
    df = documents(rows)
    assert shown(df) == plain_manifest([(i, s, lang, None if t is None else len(t), t) for i, t, lang, s in rows])
    assert shown(documents([])) == []


TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def plain_search(docs, items, k=10):
    own = [(i, Counter(terms(t))) for i, t in docs if terms(t)]
    total = sum(sum(c.values()) for _, c in own)
    df = Counter(t for _, c in own for t in c)
    asked = {}
    for i, text in items:
        if i is not None:
            asked.setdefault(i, set()).update(terms(text))
    out = []
    for i, names in asked.items():
        scores = []
        for doc, c in own:
            m = 100 - 90 + (90 * sum(c.values()) * len(own)) // total
            s = sum(math.floor(1000 * math.log((2 * len(own) + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * m))
                    for t in names if c[t])
            if s > 0:
                scores.append((-s, doc is None, doc or 0, doc))
        out += [(i, n, doc, -s) for n, (s, _, _, doc) in enumerate(sorted(scores, key=lambda x: x[:3])[:k], 1)]
    return sorted(out)


@pytest.mark.parametrize("slice_docs,bundle,limit", [(1 << 14, 256, 1 << 25), (7, 3, 1 << 25), (7, 2, 0)])
def test_search_matches_full_scoring(spark, documents, monkeypatch, slice_docs, bundle, limit):
    """Few and many slices and bundles; asked terms sent to the scan or joined."""
    monkeypatch.setattr(lexical, "SLICE_DOCS", slice_docs)
    monkeypatch.setattr(lexical, "BUNDLE_ITEMS", bundle)
    monkeypatch.setattr(lexical, "BROADCAST_BYTES", limit)
    items = [(i, prose(12, 50 + i)) for i in range(7)] + [(7, None), (8, ""), (9, "nowhere at-all"), (10, prose(40, 2)),
             (11, prose(3, 9)), (11, prose(4, 10)), (None, prose(9, 1)), (12, "日本語 café ONE")]
    asked = spark.createDataFrame([(*x, "clash", "clash") for x in items], "item_id bigint, text string, term string, item string")
    got = sorted(tuple(r) for r in lexical.search(documents(CORPUS).repartition(3), asked).select("item_id", "rank", "doc_id", "score")
                 .collect())
    wanted = plain_search(CORPUS, items)
    key = lambda rows: sorted((i, n, -1 if d is None else d, s) for i, n, d, s in rows)
    assert key(got) == key(wanted) and len({i for i, *_ in got}) == 10


def test_search_of_many_equal_documents(spark, documents):
    """Copies far beyond ten with one score: the smallest ids, from all slices."""
    rows = [(1000 - i, "same words here") for i in range(300)] + [(i, prose(20, i)) for i in range(50)]
    asked = spark.createDataFrame([(1, "same words"), (2, prose(20, 3))], "item_id int, text string")
    got = lexical.search(documents(rows).repartition(5), asked).where(F.col("item_id") == 1).orderBy("rank").collect()
    assert [r.doc_id for r in got] == list(range(701, 711)) and len({r.score for r in got}) == 1


@pytest.mark.parametrize("rows", [[], [(1, None)], [(None, None)], [(1, ""), (1, "")]])
def test_empty_and_null_tables(spark, documents, rows):
    _, content = tokenizer()
    asked = spark.createDataFrame([(1, "same words")], "item_id bigint, text string")
    tokens = store(token_files.tokenize(documents(rows), content), "tokens")
    model = token_files.count_ids(tokens)
    files = store(token_files.write_files(tokens, model), "files")
    assert [r.n_tokens for r in token_files.read_files(token_files.with_starts(files), model).collect()] == [1] * len(rows)
    assert lexical.search(documents(rows), asked).count() == 0
    assert lexical.search(documents(CORPUS), asked.where("false")).count() == 0
    assert manifest.manifest(documents(rows)).count() == len(rows)
