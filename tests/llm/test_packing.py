import zlib
from collections import defaultdict

import numpy as np

from sablework.llm import packing

SF = "/root/testdata/sf0.001"


def check(rows, ids):
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    for doc_id, want in ids.items():
        pos = 0
        for p in sorted(pieces[doc_id], key=lambda r: r.start):
            assert p.start == pos and p.length > 0 and p.doc_tokens == len(want)
            assert p.ids_crc32 == zlib.crc32(want[pos : pos + p.length].tobytes())
            pos += p.length
        assert pos == len(want)
    padding = 0
    for s in sequences.values():
        pos = 0
        for p in sorted(s, key=lambda r: r.offset):
            assert p.offset == pos
            pos += p.length
        assert pos <= packing.WINDOW
        padding += 0 if pos & (pos - 1) == 0 else packing.WINDOW - pos
    return padding / sum(map(len, ids.values()))


def encoded(docs):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packing.public_tokenizers.path(f"{packing.VOCABULARY}.json"))
    return {r.doc_id: np.array([*t.encode(r.text or "", add_special_tokens=False).ids, 0], "<u4") for r in docs.collect()}


def test_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert check(packing.op8_packing(spark, SF).collect(), encoded(docs)) < 0.02


def test_ids_are_those_of_the_tokenizer_file(spark):
    """On the whole table of the second size, as the ids come from the vocabulary's ranks."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    assert check(packing.pack(docs).collect(), encoded(docs)) < 0.02


def test_edges(unique_docs, edge_docs, no_docs):
    assert check(packing.pack(unique_docs).collect(), encoded(unique_docs)) < 0.03
    assert packing.pack(no_docs).count() == 0
    assert {r.doc_id for r in packing.pack(edge_docs).collect()} == {r.doc_id for r in edge_docs.collect()}


def test_special_tokens_in_texts():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packing.public_tokenizers.path(f"{packing.VOCABULARY}.json"))
    e = packing.Encoder()
    for text in ("a <|endoftext|> b", "<|endoftext|>", "plain é中\U0001f600 text\n\n  x", "  ", "don't we'll 123"):
        assert e(text).tolist() == t.encode(text, add_special_tokens=False).ids


def test_differencing():
    rng = np.random.default_rng(0)
    for n, k in ((1, 1), (2, 5), (50, 7), (300, 40)):
        sizes = rng.integers(1, 200, n).tolist()
        sets = packing.differencing(sizes, k)
        assert sorted(i for s in sets for i in s) == list(range(n)) and len(sets) <= k
        if n >= 5 * k:
            sums = [sum(sizes[i] for i in s) for s in sets]
            assert max(sums) - min(sums) < 30
    assert [sorted(s) for s in packing.differencing([8, 7, 6, 5, 4], 2)] and packing.differencing([], 3) == []
    # One window more when the fullest is too full.
    assert len(packing.windows([600, 600, 600], 1024)) == 3
