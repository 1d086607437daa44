import re

import numpy as np
import pytest

from sablework.llm import minhash

SF = "/root/testdata/sf0.001"

WORD = re.compile(r"[^\x20\x09-\x0D]+")
FOLD = {c: c + 32 for c in range(65, 91)}


def shingles(text):
    w = WORD.findall((text or "").translate(FOLD))
    return frozenset(zip(w, w[1:], strict=False)) if len(w) > 1 else frozenset(w)


def brute(rows):
    sets = {i: shingles(t) for i, t in rows}
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(i for i in sets if sets[i])
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            k = len(sets[a] & sets[b])
            if k and 100 * k >= 80 * (len(sets[a]) + len(sets[b]) - k):
                p, q = sorted((root(a), root(b)))
                parent[q] = p
    return {i: (len(sets[i]), root(i)) for i in sets}


def got(df):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in df.collect()}


def test_against_brute_force(unique_docs):
    rows = [(r.doc_id, r.text) for r in unique_docs.collect()]
    want = brute(rows)
    assert got(minhash.near_duplicates(unique_docs)) == want
    assert want[65][1] == want[67][1] == 65 and want[62] == (0, 62) and len({c for _, c in want.values()}) < len(want) - 10


def test_query(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    out = minhash.op7_minhash(spark, SF)
    assert got(out) == brute(rows)
    assert all(r.kept == (r.doc_id == r.component_id) for r in out.collect())


def test_chains_and_split_groups(spark, monkeypatch):
    # Each text has lost one word more of a long one: neighbours are near, the ends are not. Blocks and parts are tiny.
    words = [f"w{i}" for i in range(400)]
    rows = [(i, " ".join(words[3 * i : 3 * i + 200])) for i in range(40)] + [(100 + i, " ".join(words[3 * i : 3 * i + 200]) + f" z{i}") for i in range(40)]
    monkeypatch.setattr(minhash, "BLOCK", 7)
    monkeypatch.setattr(minhash, "PART", 3)
    out = got(minhash.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")))
    assert out == brute(rows) and {c for _, c in out.values()} == {0}


def test_edges(spark, edge_docs, no_docs):
    assert minhash.near_duplicates(no_docs).count() == 0
    assert minhash.near_duplicates(edge_docs).count() == edge_docs.count()
    kept = minhash.keep_one_of_each(spark, edge_docs, "")
    assert kept.columns == edge_docs.columns
    assert not {30, 60, 61, 66, 67} & {r.doc_id for r in kept.collect()}


def test_components(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(50)] + [(100, 101), (103, 101)], "a bigint, b bigint")
    assert {r.component for r in minhash.components(links).where("id < 60").collect()} == {0}
    assert {r.component for r in minhash.components(links).where("id >= 100").collect()} == {100}
    assert minhash.components(links.where("false")).count() == 0


def test_sequential_test_keeps_similar_pairs():
    rng = np.random.default_rng(0)
    least = minhash.least_matches()
    equal = rng.random((20_000, minhash.HASHES)) < 0.8
    assert minhash.agree(equal.astype(np.uint16), np.ones_like(equal, np.uint16), least).mean() > 0.9995
    far = rng.random((2000, minhash.HASHES)) < 0.3
    assert minhash.agree(far.astype(np.uint16), np.ones_like(far, np.uint16), least).mean() < 0.001


@pytest.mark.parametrize("text", ["", "a", "a b", "a b a b", "A b a B"])
def test_shingle_sets(text):
    value, at = minhash.shingle_sets([b"x y", text.encode(), b"z"])
    assert at[2] - at[1] == len(shingles(text)) and len(value) == at[-1]


def test_stage_keeps_one_row_of_each_component(spark, edge_docs, no_docs):
    """Repeated and null ids, one id on different texts: one row of every group of linked texts stays, with the least id."""
    words = [f"w{i}" for i in range(90)]
    near = " ".join([*words[:-1], "other"])
    extra = [(1000, " ".join(words)), (1000, "quite another text of some words"), (999, near), (None, near), (None, "n o id a b c"), (None, "n o id a b c"), (1001, "r e p"), (1001, "r e p")]
    docs = edge_docs.unionByName(spark.createDataFrame([(i, t, "aa", "s1", 1, 7, "k", 0.5, "t") for i, t in extra], edge_docs.schema))
    rows = list(enumerate(docs.collect()))
    comp = brute([(n, r.text) for n, r in rows])
    key = lambda r: (r.doc_id is None, r.doc_id or 0)
    groups = {}
    for n, r in rows:
        groups.setdefault(comp[n][1], []).append(r)
    want = sorted((key(r)[0], key(r)[1]) for g in groups.values() for r in [min(g, key=key)])
    kept = minhash.keep_one_of_each(spark, docs, "")
    assert kept.columns == docs.columns and sorted(key(r) for r in kept.collect()) == want
    assert {r.text for r in kept.where("doc_id = 1000").collect()} == {"quite another text of some words"}
    assert minhash.keep_one_of_each(spark, no_docs, "").count() == 0


def test_words_with_one_polynomial_hash_are_two_words(spark):
    """The two words of Thue and Morse have equal polynomial hashes, whatever the base, modulo a power of two."""
    t = "a"
    for _ in range(11):
        t += t.translate(str.maketrans("ab", "ba"))
    u = t.translate(str.maketrans("ab", "ba"))
    rows = [(1, f"{t} x"), (2, f"{u} x"), (3, t), (4, u), (5, f"{t} x {t}"), (6, f"{t.upper()} X"), (7, f"x {t} x")]
    assert got(minhash.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string"))) == brute(rows)
    values, at = minhash.shingle_sets([f"{t} x".encode(), f"{u} x".encode()])
    assert len(set(values.tolist())) == 2
    _, _, keys = minhash.hashed_sets([b"a b c", b"b c a b", b"a b c a b", b"a", b"a a"])
    assert len(set(keys)) == 4 and keys[1] == keys[2] and minhash.hashed_sets([b"a b a", b"B a b"])[2][0] == minhash.hashed_sets([b"A b a", b"b a b"])[2][1]
