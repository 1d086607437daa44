import hashlib
import re

import pytest
from pyspark.sql import functions as F

from sablework.llm import syncmers

SF = "/root/testdata/sf0.001"

SPLIT = re.compile(r"[^\x20\x09-\x0D]+")


def test_choice_of_kmers(spark):
    """Closed syncmers by brute force, from the same hashes of s-mers."""
    text = " ".join(f"w{i % 23}" for i in range(120))
    words = SPLIT.findall(text)
    k, s = syncmers.K, syncmers.S
    df = spark.createDataFrame([(words[i : i + s],) for i in range(len(words) - s + 1)], "w array<string>")
    m = [r.h for r in df.select(F.hash(*[F.col("w")[j] for j in range(s)]).alias("h")).collect()]
    span = k - s + 1
    chosen = [i for i in range(len(words) - k + 1) if min(m[i : i + span]) in (m[i], m[i + span - 1])]
    keys = spark.createDataFrame([(m[i], m[i + span // 3], m[i + 2 * span // 3], m[i + span - 1]) for i in chosen], "a int, b int, c int, d int")
    want = sorted({r.h for r in keys.select(F.hash("a", "b", "c", "d").alias("h")).collect()})
    got = spark.createDataFrame([(text,)], "t string").select(syncmers.closed_syncmers(F.col("t"), k, s).alias("a")).first().a
    assert got == want and 0 < len(want)


def expected_edits(rows):
    rows = sorted(rows, reverse=True)
    out = {}
    for n, (i, t) in enumerate(rows):
        m, following = len(t) // 3, rows[(n + 1) % len(rows)][1]
        out[i] = (len(t), hashlib.sha256((t[: len(t) - m] + following[:m]).encode()).hexdigest())
    return out


def test_query(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    out = syncmers.op9_syncmers(spark, SF).collect()
    assert {r.doc_id: (r.n_chars, r.edited_sha256) for r in out} == expected_edits(rows)
    prints = {}
    texts = dict(rows)
    for r in out:
        assert prints.setdefault(texts[r.doc_id], r.fingerprint) == r.fingerprint
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
    assert sum(r.near_edited for r in out) / len(out) > 0.4 > 0.05 > sum(r.near_next for r in out) / len(out)


def places_of(text, hashed):
    """A fingerprint by brute force: (anchor, distance) in the order of the text. ``hashed``: Spark's hash of strings or numbers."""
    words = SPLIT.findall(text)
    if not words:
        return [(hashed(text), 0)] if text else []
    if len(words) == 1 or any(len(w) > syncmers.LONG_WORD for w in words):
        words = [u for w in words for u in (w if len(w) > syncmers.LONG_WORD or len(words) == 1 else [w])]
    words = ["", "", *words, "", ""]
    m = [hashed(a, b) for a, b in zip(words, words[1:], strict=False)]
    at = [i for i in range(len(m) - 3) if min(m[i], m[i + 3]) <= min(m[i + 1], m[i + 2])]
    own = m[1:-1]
    if not at:
        return [(h, 0) for h in own]
    gaps = [min(b - a, syncmers.FAR - 1) for a, b in zip(at, at[1:], strict=False)] + [0]
    return [(hashed(*m[i : i + 4]), g) for i, g in zip(at, gaps, strict=True)] + [(h, 0) for h in sorted(set(own))[: syncmers.LEAST]]


def test_query_against_brute_force(spark):
    """Fingerprints and likeness of every document of the smallest tables, with Spark's hash in plain Python."""
    rows = sorted(((r.doc_id, r.text or "") for r in spark.read.parquet(f"{SF}/documents.parquet").collect()), reverse=True)
    string = lambda places: " ".join(f"{a % 2**32:08x}{g:02x}" for a, g in places)
    prints, edits = {}, {}
    for n, (i, t) in enumerate(rows):
        m, following = len(t) // 3, rows[(n + 1) % len(rows)][1]
        prints[i], edits[i] = places_of(t, murmur), places_of(t[: len(t) - m] + following[:m], murmur)

    def like(p, q):
        a, b, c, d = set(p), set(q), {x for x, _ in p}, {x for x, _ in q}
        return (len(a & b) + len(c & d)) / (len(a | b) + len(c | d)) if p or q else 1.0

    after = {i: rows[(n + 1) % len(rows)][0] for n, (i, _) in enumerate(rows)}
    for r in syncmers.op9_syncmers(spark, SF).collect():
        p = prints[r.doc_id]
        assert (r.fingerprint, r.edited_fingerprint) == (string(p), string(edits[r.doc_id]))
        assert abs(r.near_edited - like(p, edits[r.doc_id])) < 1e-12 and abs(r.near_next - like(p, prints[after[r.doc_id]])) < 1e-12


def murmur(*values):
    """Spark's hash(): MurmurHash3 of 32 bits, seed 42, each value seeded with the one before; the last bytes of a string
    count one by one, as signed numbers."""
    u = lambda x: x & 0xFFFFFFFF
    rotl = lambda x, r: u(x << r | x >> 32 - r)

    def mixed(h, k):
        return u(rotl(h ^ u(rotl(u(k * 0xCC9E2D51), 15) * 0x1B873593), 13) * 5 + 0xE6546B64)

    def final(h, n):
        h ^= n
        h = u((h ^ h >> 16) * 0x85EBCA6B)
        h = u((h ^ h >> 13) * 0xC2B2AE35)
        return h ^ h >> 16

    h = 42
    for v in values:
        if isinstance(v, int):
            h = final(mixed(h, u(v)), 4)
        else:
            raw = v.encode()
            whole = len(raw) // 4 * 4
            for i in range(0, whole, 4):
                h = mixed(h, int.from_bytes(raw[i : i + 4], "little"))
            for c in raw[whole:]:
                h = mixed(h, u(c - 256 if c > 127 else c))
            h = final(h, len(raw))
    return h - 2**32 if h >= 2**31 else h


def test_edges(unique_docs, edge_docs, no_docs, as_dir, spark):
    out = syncmers.op9_syncmers(spark, as_dir(unique_docs)).collect()
    rows = [(r.doc_id, r.text or "") for r in unique_docs.collect()]
    assert {r.doc_id: (r.n_chars, r.edited_sha256) for r in out} == expected_edits(rows)
    by = {r.doc_id: r for r in out}
    assert by[62].fingerprint == by[63].fingerprint == "" and by[65].fingerprint == by[66].fingerprint != ""
    assert syncmers.edited_fingerprints(edge_docs).count() == edge_docs.count()
    assert syncmers.edited_fingerprints(no_docs).count() == 0


def test_next_ids_over_several_ranges(spark, monkeypatch):
    monkeypatch.setattr(syncmers, "IDS_PER_BUCKET", 7)
    ids = [i * i for i in range(60)]
    got = {r.doc_id: r.next_id for r in syncmers.next_ids(spark.createDataFrame([(i,) for i in ids], "doc_id bigint")).collect()}
    ids = sorted(ids, reverse=True)
    assert got == {a: b for a, b in zip(ids, [*ids[1:], ids[0]], strict=True)}


IDS = {
    "dense": list(range(-20, 40)),
    "even gaps": [i * 1000 - 7 for i in range(60)],
    "clumps": [*range(25), *range(10**15, 10**15 + 25), -(2**63), 2**63 - 1],
    "one": [5],
}


@pytest.mark.parametrize("ids", IDS.values(), ids=IDS)
def test_next_documents_over_groups(spark, monkeypatch, ids):
    """Texts and places of the next document, where groups hold a few ids, and where few rows may be broadcast."""
    monkeypatch.setattr(syncmers, "GROUP", 4)
    rows = [(i, f"{n} " * (n % 7) + "a b c d e f g"[: n % 14]) for n, i in enumerate(ids)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    order = sorted(rows, reverse=True)
    after = {i: order[(n + 1) % len(order)][1] for n, (i, _) in enumerate(order)}
    prints = {r.text: r.a for r in docs.select("text", syncmers.syncmers(F.col("text")).alias("a")).collect()}
    for few in (syncmers.FEW, 0):
        monkeypatch.setattr(syncmers, "FEW", few)
        out = syncmers.edited_fingerprints(docs).collect()
        cut = {i: len(t) // 3 for i, t in rows}
        assert {r.doc_id: (r.text, r.edited) for r in out} == {i: (t, t[: len(t) - cut[i]] + after[i][: cut[i]]) for i, t in rows}
        assert len(out) == len(rows) and all(r.anchors == prints[r.text] and r.next_anchors == prints[after[r.doc_id]] for r in out)


def test_texts_are_dealt_out_and_read_for_anchors_once(spark, unique_docs, as_dir):
    """No join sorts texts, and anchors are taken of a text and of its edited text only: an executor's memory held two
    sorted copies of a task's texts beside the fingerprints."""
    docs = spark.read.parquet(f"{as_dir(unique_docs)}/documents.parquet")
    name = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(name)
    spark.conf.set(name, "-1")
    try:
        plan = syncmers.edited_fingerprints(docs)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set(name, before)
    assert "SortMergeJoin" not in plan and plan.count("Exchange hashpartitioning") == 1


def likeness_of(spark, *pairs):
    df = spark.createDataFrame(list(pairs), "a string, b string").coalesce(1)
    return [r[0] for r in df.select(syncmers.likeness(syncmers.syncmers(F.col("a")), syncmers.syncmers(F.col("b")))).collect()]


def test_versions_of_any_lengths_meet(spark):
    text = " ".join(f"w{i:02d}" for i in range(150))
    pairs = [(text[:n], text[: n + 8]) for n in (99, 199, 391, 395, 399)]
    assert all(x > 0.6 for x in likeness_of(spark, *pairs))


def test_every_text_has_anchors_that_meet(spark):
    texts = [" ".join(f"{c}{i}" for i in range(n)) for n in range(1, 12) for c in "abcdefgh"] + ["x", "xy", " ", "\n"]
    prints = [set(r.a) for r in spark.createDataFrame([(t,) for t in texts], "t string").select(syncmers.syncmers(F.col("t")).alias("a")).collect()]
    assert all(prints)
    short = [" ".join(f"{c}{i}" for i in range(n)) for n in range(4, 12) for c in "abcdefgh"]
    assert likeness_of(spark, *[(a, b) for a, b in zip(short, short[1:], strict=False)]).count(1.0) == 0
    near = likeness_of(spark, *[(t, t.rsplit(" ", 1)[0] + " changed") for t in short])
    assert sum(x > 0 for x in near) >= 0.9 * len(near) and sum(near) / len(near) > 0.3
    assert likeness_of(spark, ("", ""), ("", " "), (" ", "\n")) == [1.0, 0.0, 0.0]


def test_texts_without_white_space(spark):
    text = "".join(chr(0x4E00 + i * 37 % 5000) for i in range(300))
    near, mixed, other = likeness_of(spark, (text, text[:200] + text[:100][::-1]), (text, text[:200] + " and other words"), (text, text[::-1]))
    assert near > 0.3 and mixed > 0.3 and other < 0.1


def test_every_word_of_a_kmer_counts(spark):
    k = syncmers.K
    texts = [[f"{c}{i}" for i in range(k)] for c in "abcdefghijkl"]
    rows = [(" ".join(t), " ".join([*t[:i], "other", *t[i + 1 :]])) for t in texts for i in range(k)]
    df = spark.createDataFrame(rows, "a string, b string").select(*[syncmers.closed_syncmers(F.col(c), k, syncmers.S).alias(c) for c in "ab"])
    found = df.collect()
    assert any(r.a and r.b for r in found) and not any(set(r.a) & set(r.b) for r in found)
