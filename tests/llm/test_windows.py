"""Operators 5 and 6 against brute force over all windows."""

import dataclasses
import hashlib
import re
from collections import Counter

import numpy as np
import pytest
import xxhash

from sablework.llm import anchors, bucket_refinement, fmindex

SF = "/root/testdata/sf0.001"

SPACE = re.compile(rb"[^\x20\x09-\x0D]+")


def brute_words(rows, width=20):
    seen, out = set(), {}
    for i, t in sorted(rows):
        w = SPACE.findall((t or "").encode())
        gone = [False] * len(w)
        for a in range(len(w) - width + 1):
            h = tuple(w[a : a + width])
            if h in seen:
                gone[a : a + width] = [True] * width
            seen.add(h)
        out[i] = (len(w), sum(gone), b" ".join(x for x, g in zip(w, gone, strict=True) if not g).decode())
    return out


def brute_bytes(rows, width=400):
    count, out = Counter(), {}
    raw = {i: (t or "").encode() for i, t in rows}
    for b in raw.values():
        count.update(xxhash.xxh3_128_digest(b[a : a + width]) for a in range(len(b) - width + 1))
    for i, b in raw.items():
        gone = np.zeros(len(b), bool)
        for a in range(len(b) - width + 1):
            if count[xxhash.xxh3_128_digest(b[a : a + width])] > 1:
                gone[a : a + width] = True
        runs = int((np.diff(np.concatenate([[0], gone.astype(np.int8)])) == 1).sum())
        out[i] = (len(b), int(gone.sum()), runs, bytes(np.frombuffer(b, np.uint8)[~gone]))
    return out


@pytest.fixture(scope="module")
def pairs(unique_docs):
    return [(r.doc_id, r.text) for r in unique_docs.collect()]


@pytest.mark.parametrize("hot", [anchors.HOT, 1], ids=["index", "hot"])
def test_words(unique_docs, pairs, hot):
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in fmindex.substring_dedup(unique_docs, hot).collect()}
    want = brute_words(pairs)
    assert got == want and sum(x[1] for x in want.values()) > 1000


@pytest.mark.parametrize("hot", [anchors.HOT, 1], ids=["index", "hot"])
def test_bytes(unique_docs, pairs, hot):
    short = [(i, t) for i, t in pairs if i != 71]
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in bucket_refinement.suffix_dedup(unique_docs.where("doc_id <> 71"), hot).collect()}
    want = brute_bytes(short)
    assert got == want and sum(x[1] for x in want.values()) > 1000


def test_long_texts_in_pieces(unique_docs, pairs, monkeypatch):
    some = unique_docs.where("doc_id >= 60")
    want = brute_words([p for p in pairs if p[0] >= 60])
    monkeypatch.setattr(anchors, "PIECE", 64)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in fmindex.substring_dedup(some).collect()}
    assert got == want


def test_segments_are_independent_of_pieces(monkeypatch):
    v = np.random.default_rng(0).integers(0, 2**63, 500).astype(np.uint64)
    counts = np.array([3, 0, 200, 297])
    rest = v.tobytes(), np.arange(0, 4000, 8), np.arange(8, 4008, 8), 20, 6
    a = anchors.segments(v, counts, *rest)
    monkeypatch.setattr(anchors, "PIECE", 37)
    b = anchors.segments(v, counts, *rest)
    windows = lambda x: sorted((t, s + k, key) for t, s, n, key in zip(x["text"], x["start"], x["n"], x["key"], strict=True) for k in range(n))
    assert windows(a) == windows(b) and len(windows(a)) == 181 + 278


def test_null_and_repeated_ids_and_empty_tables(spark, edge_docs, no_docs):
    """Rows of one id and rows without id are documents of their own; equal rows may take each other's place."""
    extra = [(1, "p q r " * 10), (1, "s t u " * 10), (None, "s t u " * 10), (None, "v w " * 300)]
    docs = edge_docs.where("doc_id is null or doc_id <> 71").unionByName(spark.createDataFrame([(i, t, "aa", "s1", 1, 7, "k", 0.5, "t") for i, t in extra], edge_docs.schema))
    rows = sorted(((r.doc_id is None, r.doc_id or 0, r.text or "") for r in docs.collect()))
    key = lambda r: (r[0] is None, r[0] or 0)
    want = brute_bytes([(n, t) for n, (_, _, t) in enumerate(rows)])
    got = [(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in bucket_refinement.suffix_dedup(docs).collect()]
    assert sorted((*key(r), *r[1:]) for r in got) == sorted((*rows[n][:2], *w) for n, w in want.items())
    words = fmindex.substring_dedup(docs).collect()
    assert sum(r.n_removed for r in words) == sum(g for _, g, _ in brute_words([(n, t) for n, (_, _, t) in enumerate(rows)]).values())
    assert fmindex.substring_dedup(no_docs).count() == 0 == bucket_refinement.suffix_dedup(no_docs).count()


@pytest.mark.parametrize("hot", [anchors.HOT, 1], ids=["index", "hot"])
def test_what_the_index_does_not_find_stays(unique_docs, monkeypatch, hot):
    nothing = lambda bodies, n, where, copies: ([np.zeros(k, bool) for k in n], [np.zeros(k, bool) for k in n])
    for module, run in ((fmindex, fmindex.substring_dedup), (bucket_refinement, bucket_refinement.suffix_dedup)):
        monkeypatch.setattr(module, "SEARCH", dataclasses.replace(module.SEARCH, shared=nothing))
        assert {r.n_removed for r in run(unique_docs.where("doc_id <> 71"), hot).collect()} == {0}


def test_queries(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    want = {i: (n, g, hashlib.sha256(k.encode()).hexdigest()) for i, (n, g, k) in brute_words(rows).items()}
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in fmindex.op5_fm_index(spark, SF).collect()} == want
    want = {i: (n, g, s, hashlib.sha256(k).hexdigest()) for i, (n, g, s, k) in brute_bytes(rows).items()}
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in bucket_refinement.op6_bucket_refinement(spark, SF).collect()} == want


def test_wavelet_matrix_and_index():
    rng = np.random.default_rng(1)
    s = rng.integers(0, 9, 500)
    w = fmindex.WaveletMatrix(s)
    c, i = rng.integers(0, 9, 200), rng.integers(0, 501, 200)
    assert list(w.rank(c, i)) == [int((s[:b] == a).sum()) for a, b in zip(c, i, strict=True)]
    s = np.repeat(s, rng.integers(1, 6, 500))
    packed, plain = fmindex.RunLengths(s), fmindex.WaveletMatrix(s)
    c, i = np.repeat(np.arange(9), len(s) + 1), np.tile(np.arange(len(s) + 1), 9)
    assert (packed.rank(c, i) == plain.rank(c, i)).all() and len(packed.symbols) < 500
    text = np.concatenate([rng.integers(1, 4, 300), [0]])
    lane, group = fmindex.FMIndex(text, 5).repeated(np.arange(296), 5, np.full(296, 2))
    grams = [tuple(text[a : a + 5]) for a in range(296)]
    assert set(lane) == {a for a, g in enumerate(grams) if grams.count(g) > 1}
    assert len(set(group)) == len({grams[a] for a in lane}) == len({(grams[a], g) for a, g in zip(lane, group, strict=True)})


def test_bucket_refinement():
    rng = np.random.default_rng(2)
    bodies = [bytes(rng.integers(97, 99, 60).astype(np.uint8)) for _ in range(40)] + [b"ab" * 30, b"short"]
    raw = np.frombuffer(b"".join(bodies), np.uint8)
    ends = np.cumsum([len(b) for b in bodies])
    left = np.repeat(ends, [len(b) for b in bodies]) - np.arange(len(raw))
    for width in (3, 8, 11, 16, 37):
        grams = {p: bytes(raw[p : p + width]) for p in range(len(raw)) if left[p] >= width}
        count = Counter(grams.values())
        assert set(np.flatnonzero(bucket_refinement.equal_suffixes(raw, left, width, np.zeros(len(raw), bool)))) == {p for p, g in grams.items() if count[g] > 1}


def test_queries_on_a_larger_table(spark):
    """Both queries over all documents of sf0.01."""
    sf = "/root/testdata/sf0.01"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    sha = lambda kept: hashlib.sha256(kept if isinstance(kept, bytes) else kept.encode()).hexdigest()
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in fmindex.op5_fm_index(spark, sf).collect()}
    assert got == {i: (n, gone, sha(kept)) for i, (n, gone, kept) in brute_words(rows).items()}
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in bucket_refinement.op6_bucket_refinement(spark, sf).collect()}
    assert got == {i: (n, gone, runs, sha(kept)) for i, (n, gone, runs, kept) in brute_bytes(rows).items()}


def test_words_with_one_polynomial_hash_are_two_words(spark):
    t = "a"
    for _ in range(11):
        t += t.translate(str.maketrans("ab", "ba"))
    u = t.translate(str.maketrans("ab", "ba"))
    rest = " ".join(f"q{i}" for i in range(19))
    rows = [(1, f"{t} {rest}"), (2, f"{u} {rest}"), (3, f"z {t} {rest}"), (4, f"y {u} {rest} y")]
    for hot in (anchors.HOT, 1):
        out = fmindex.substring_dedup(spark.createDataFrame(rows, "doc_id bigint, text string"), hot)
        assert {r.doc_id: r.n_removed for r in out.collect()} == {1: 0, 2: 0, 3: 20, 4: 20}
