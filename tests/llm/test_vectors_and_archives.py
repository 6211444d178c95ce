"""Operators on vectors and pages against brute force and exact round trips."""

import hashlib
import math
from collections import defaultdict

import numpy as np
import pytest
import zstandard

from paneltide.llm import near_vectors, topk, warc
from paneltide.llm.common import components

NAN, INF = float("nan"), float("inf")


def cloud(n, dims, seed):
    return np.random.default_rng(seed).standard_normal((n, dims))


def vector_rows():
    x = cloud(300, 24, 1)
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    rows += [(1000 + i, (x[i % 40] + .05 * d).tolist()) for i, d in enumerate(cloud(160, 24, 2))]
    rows += [(2000 + i, (x[0] * (i + 1)).tolist()) for i in range(5)]
    rows += [(3000 + i, x[5].tolist()) for i in range(30)]
    return rows + [(4000, None), (4001, []), (4002, [0.0] * 24), (4003, [NAN] * 24), (4004, [1.0, INF]),
                   (4005, [None] * 24), (4006, x[0].tolist()[:23]), (4007, [1e300] * 24), (4008, [1e-300] * 24),
                   (None, x[1].tolist()), (7, x[7].tolist()), (7, x[7].tolist())]


def whole(v):
    return v is not None and all(c is not None and math.isfinite(c) for c in v)


@pytest.mark.parametrize("block", [1024, 7])
def test_near_vectors(vectors, monkeypatch, block):
    monkeypatch.setattr(near_vectors, "BLOCK", block)
    rows = vector_rows()
    got = {r.vec_id: r for r in near_vectors.near_vectors(vectors(rows)).collect()}
    ids = sorted({i for i, _ in rows if i is not None})
    assert sorted(got) == ids
    of = dict(r for r in rows if r[0] is not None)
    unit = {i: np.array(v) / max(map(abs, v)) for i, v in of.items() if whole(v) and any(v)}
    unit = {i: v / np.linalg.norm(v) for i, v in unit.items()}
    links, top = defaultdict(int), {i: i for i in ids}
    pairs = [(a, b) for a in unit for b in unit if a < b and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= .95]
    for a, b in pairs:
        links[a] += 1
        links[b] += 1
    for _ in range(5):
        for a, b in pairs:
            top[a] = top[b] = min(top[a], top[b])
    assert sum(r.n_links for r in got.values()) >= .95 * 2 * len(pairs) > 0
    for i in ids:
        assert got[i].n_links <= links[i] and got[i].component_id >= top[i]
        assert got[i].kept == (got[i].component_id == i)
    assert sum(got[i].component_id == top[i] for i in ids) >= .97 * len(ids)
    assert all(got[i].n_links == 0 for i in (4000, 4001, 4002, 4003, 4004, 4005))
    assert got[3029].component_id == 5 and got[4007].n_links == 1


def test_index_holds_its_promise():
    """Pairs at the threshold meet in some table with the planned probability."""
    r = np.random.default_rng(3)
    a = near_vectors.unit(r.standard_normal((3000, 16)))
    b = near_vectors.unit(r.standard_normal((3000, 16)))
    b = near_vectors.unit(b - (a * b).sum(1, keepdims=True) * a)
    near = .95 * a + math.sqrt(1 - .95 ** 2) * b
    for n in (1000, 10 ** 9):
        k, tables = near_vectors.index_size(n, .95)
        met = (near_vectors.bucket_keys(a, k, tables) == near_vectors.bucket_keys(near, k, tables)).any(axis=1)
        assert met.mean() > 1 - 1.5 * near_vectors.MISS


@pytest.mark.parametrize("cut", [(16384, 2048), (50, 3)])
def test_top_k(vectors, monkeypatch, cut):
    monkeypatch.setattr(topk, "CANDIDATE_SLICE", cut[0])
    monkeypatch.setattr(topk, "QUERY_BLOCK", cut[1])
    rows = [r for r in vector_rows() if r[0] not in (4007,)]
    got = defaultdict(list)
    for r in topk.top_k(vectors(rows), lambda i: i % 50 == 0).collect():
        got[r.query_id].append((r.rank, r.vec_id, r.score))
    z = {i: [math.floor(256 * c) for c in v] for i, v in rows if i is not None and whole(v)}
    for q in (i for i in z if i % 50 == 0):
        all_ = sorted((-sum(a * b for a, b in zip(z[q], z[i])), i) for i in z if i != q)[:5]
        assert sorted(got[q]) == [(n + 1, i, -s) for n, (s, i) in enumerate(all_)]
    assert 4000 not in got and 4001 not in got


def test_top_k_of_huge_and_few(vectors):
    got = topk.top_k(vectors([(0, [1e300, 1.0]), (1, [1e300, 2.0]), (3, [-1e300, 0.5])]), lambda i: i == 0).collect()
    assert [(r.rank, r.vec_id, r.score) for r in sorted(got)] == [(1, 1, 2 ** 63 - 1), (2, 3, -2 ** 63)]
    assert topk.top_k(vectors([(0, [1.0])]), lambda i: i == 0).count() == 0
    assert topk.top_k(vectors([]), lambda i: i == 0).count() == 0
    assert near_vectors.near_vectors(vectors([])).count() == 0


def test_components_of_a_long_path(spark):
    edges = [(i, i + 1) for i in range(300)] + [(1000, 1001), (1002, 1001), (5000, 5000)]
    got = {r.id: r.component for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {**{i: 0 for i in range(301)}, **{i: 1000 for i in (1000, 1001, 1002)}}


LONG = "<p>" + "é" * 200 + "</p>"
PAGES = [(1, "http://a/\r\nx: y", LONG), (2, None, LONG), (3, "u", "short"), (4, "u", "short"), (5, "u", None),
         (6, "u", ""), (7, "u", "\r\n\r\nWARC/1.1\r\n" * 20), (8, "ü", "x" * 300_000), (1, "twice", LONG),
         (None, "no id", LONG), (None, "no id", "alone" * 30), (9, "u", "y" * 99), (10, "u", "y" * 99),
         (11, "u", "y" * 100), (12, "u", "y" * 100), (-5, "u", "z" * 100), (3, "u", "z" * 100)]


def test_archives_round_trip(pages, monkeypatch):
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 2000)
    marked = warc.mark_repeats(pages(PAGES))
    archives = warc.write_archives(marked)
    assert archives.count() > 3
    got = sorted((r.page_id is None, r.page_id or 0, r.url or "", r.record_type, r.refers_to, r.payload_bytes,
                  r.payload_digest, bytes(r.payload) if r.payload is not None else None)
                 for r in warc.read_archives(archives).collect())
    wanted = []
    for page_id, url, html in PAGES:
        raw = (html or "").encode()
        same = [i for i, _, h in PAGES if h == html and i is not None]
        first = min(same) if same and len(raw) >= 100 else None
        again = first is not None and (page_id is None or page_id > first)
        url = "http://a/%0D%0Ax:%20y" if url and "\r" in url else url.replace(" ", "%20") if url else ""
        wanted.append((page_id is None, page_id or 0, url, "revisit" if again else "response", first if again else None,
                       len(raw), hashlib.sha256(raw).hexdigest(), None if again else raw))
    assert got == sorted(wanted, key=lambda r: r[:5])
    assert warc.read_archives(warc.write_archives(warc.mark_repeats(pages([])))).count() == 0


def test_reader_takes_other_writers_and_reports_faults(spark):
    digest = hashlib.sha256(b"hello").hexdigest()
    record = warc.record_bytes(1, "u", b"hello", digest, None, "2020-01-01T00:00:00Z")
    samples = [warc.record_bytes(i, f"http://x/{i}", b"page %d of many " % i * 20, digest, None, "d") for i in range(200)]
    trained = zstandard.train_dictionary(2048, samples).as_bytes()
    packed = zstandard.ZstdCompressor().compress(trained)
    writer = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(trained), write_content_size=False)
    head = warc.DICTIONARY_MAGIC.to_bytes(4, "little")
    stream = zstandard.ZstdCompressor().compressobj()
    good = {
        "plain dictionary": head + len(trained).to_bytes(4, "little") + trained + writer.compress(record),
        "packed dictionary": head + len(packed).to_bytes(4, "little") + packed + writer.compress(record),
        "no dictionary": stream.compress(record) + stream.flush(),
        "other skippable": (0x184D2A51).to_bytes(4, "little") + (3).to_bytes(4, "little") + b"abc" + zstandard.ZstdCompressor().compress(record),
    }
    bad = {
        "cut": warc.pack([record])[:-9], "junk": b"no frames at all", "length": warc.pack([record.replace(b"hello", b"hell")]),
        "digest": warc.pack([record.replace(b"hello", b"hallo")]), "header": warc.pack([b"WARC/1.1\r\nnothing\r\n\r\n"]),
        "type": warc.pack([record.replace(b"response\r\n", b"other\r\n", 1)]), "null": None,
    }
    rows = [(n, None if c is None else bytearray(c)) for n, c in {**good, **bad}.items()]
    found = defaultdict(list)
    for r in warc.read_archives(spark.createDataFrame(rows, "archive string, content binary"), keep_errors=True).collect():
        found[r.archive].append(r)
    for name in good:
        assert [(bytes(r.payload), r.error) for r in found[name]] == [(b"hello", None)], name
    for name in set(bad) - {"null"}:
        assert found[name] and found[name][-1].error and found[name][-1].payload is None, name
    assert "null" not in found
    with pytest.raises(Exception, match="junk, record 0"):
        warc.read_archives(spark.createDataFrame([("junk", bytearray(b"no frames at all"))],
                                                 "archive string, content binary")).collect()
