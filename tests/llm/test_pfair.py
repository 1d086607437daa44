import bisect
import math

import pytest
from pyspark.sql import functions as F

from sablework.llm import pfair

SF = "/root/testdata/sf0.001"


def brute(weights, blocks):
    """Earliest deadline first, slot by slot: source, block, slot, release, deadline."""

    def flow(x):
        k = max(bisect.bisect_right(f.at, x) - 1, 0)
        return f.slot[k] + (x - f.at[k]) * f.rate[k]

    def window(i, j):
        return math.floor(flow(j / weights[i]) + pfair.NEAR), math.ceil(flow((j + 1) / weights[i]) - pfair.NEAR)

    f, out = pfair.Flow.of(weights, blocks), []
    heads = {i: (0, *window(i, 0)) for i in range(len(blocks)) if blocks[i]}
    for t in range(sum(blocks)):
        deadline, i = min((d, i) for i, (_, r, d) in heads.items() if r <= t)
        j, release, _ = heads[i]
        out.append((i, j, t, release, deadline))
        if j + 1 < blocks[i]:
            heads[i] = (j + 1, *window(i, j + 1))
        else:
            del heads[i]
    return out


def planned(spark, weights, blocks, **sizes):
    rows = pfair.plan_table(spark, weights, blocks, **sizes).collect()
    return sorted(((r.i, r.k, r.place, r.release, r.deadline) for r in rows), key=lambda r: r[2])


CASES = [([1.0], [5]), ([0.5, 0.5], [3, 9]), ([0.5, 0.3, 0.2], [50, 30, 20]), ([0.37, 0.01, 0.01, 0.61], [100, 1, 7, 140]), ([0.06283, 0.43717, 0.5], [900, 10, 2000])]


@pytest.mark.parametrize("weights, blocks", CASES)
def test_schedule_is_earliest_deadline_first(spark, weights, blocks):
    want = brute(weights, blocks)
    assert planned(spark, weights, blocks) == want
    # Stretches that start from wrong states run again until all fit.
    assert planned(spark, weights, blocks, stretch=7, warm_up=0) == want
    had = [0] * len(weights)
    horizon = min(n / w for n, w in zip(blocks, weights, strict=True))
    for i, _, t, release, deadline in want:
        assert release <= t < deadline
        had[i] += 1
        if t + 1 <= horizon:
            assert all(abs(h - (t + 1) * w) < 1 for h, w in zip(had, weights, strict=True))


def test_wrong_states_are_mended(spark, monkeypatch):
    """Even where every stretch but the first starts from nothing at all."""
    monkeypatch.setattr(pfair, "likely_state", lambda df: df.withColumn("had", F.expr("transform(w, v -> 0L)")))
    weights, blocks = CASES[3]
    assert planned(spark, weights, blocks, stretch=40, warm_up=0) == brute(weights, blocks)


def test_mixture_on_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = pfair.pfair_mix(docs, block_bytes=512).collect()
    assert len(rows) == docs.count() and any(r.selected for r in rows)
    total = sum(r.weight for r in {r.source: r for r in rows}.values())
    assert abs(total - 1) < 1e-9
    by = {}
    for r in rows:
        assert r.release <= r.slot < r.deadline and r.last_slot >= r.slot
        by.setdefault(r.source, []).append(r)
    for rs in by.values():
        rs.sort(key=lambda r: (r.block, r.slot))
        assert [r.slot for r in rs] == sorted(r.slot for r in rs)
    horizon = max(r.last_slot for r in rows if r.selected)
    weights = {s: rs[0].weight for s, rs in by.items()}
    for s, rs in by.items():
        # Bytes up to the horizon follow the weights, but for a block.
        mine = sum(r.n_bytes for r in rs if r.selected)
        assert mine <= (horizon + 1) * 512 * weights[s] + 512


def test_given_weights_and_edges(spark, edge_docs, no_docs):
    weights = spark.createDataFrame([("s1", 3.0), ("s2", 1.0)], "source string, weight double")
    rows = pfair.pfair_mix(edge_docs, weights, block_bytes=64).collect()
    assert len(rows) == edge_docs.count()
    assert all((r.slot is None) == (r.source not in ("s1", "s2")) for r in rows)
    assert not any(r.selected for r in rows if r.source not in ("s1", "s2"))
    assert pfair.pfair_mix(no_docs).count() == 0
    kept = pfair.mix_sources(spark, edge_docs, "")
    assert kept.columns == edge_docs.columns and kept.count() == edge_docs.count()
    assert pfair.mix_sources(spark, no_docs, "").count() == 0


@pytest.mark.parametrize("n, blocks", [(20, 5000), (1500, 6)])
def test_exact_weights_over_many_stretches(spark, n, blocks):
    """Irrational weights, 100,000 slots, more than a thousand sources: never a block off, and every block has its slot."""
    total = sum(math.sqrt(k + 2) for k in range(n))
    weights = [math.sqrt(k + 2) / total for k in range(n)]
    had = [0] * n
    horizon = min(blocks / w for w in weights)
    for t, (i, j, place, release, deadline) in enumerate(planned(spark, weights, [blocks] * n)):
        assert j == had[i] and place == t and release <= t < deadline
        had[i] += 1
        if t + 1 <= horizon and t % (1 if n < 100 else 50) == 0:
            assert all(abs(h - w * (t + 1)) < 1 for h, w in zip(had, weights, strict=True))
    assert had == [blocks] * n


def test_query_against_brute_force(spark):
    """Offsets, weights, blocks and slots of every document of the smallest tables, worked out in plain Python."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    keys = docs.select("doc_id", F.coalesce("source", F.lit("")).alias("s"), F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("b"))
    rows = keys.withColumn("h", F.xxhash64("doc_id", "s", "b")).collect()
    size = {}
    for r in rows:
        size[r.s] = size.get(r.s, 0) + r.b
    weight = {s: b**pfair.TEMPER for s, b in size.items()}
    total = math.fsum(weight[s] for s in sorted(weight))
    names = sorted(size)
    blocks = [-(-size[s] // pfair.BLOCK_BYTES) for s in names]
    place = {(names[i], j): t for i, j, t, _, _ in brute([weight[s] / total for s in names], blocks)}
    want, upto = {}, dict.fromkeys(names, 0)
    # So few rows are one range.
    for r in sorted(rows, key=lambda r: (r.h, r.doc_id)):
        n, end = blocks[names.index(r.s)] - 1, max(upto[r.s] + r.b - 1, upto[r.s])
        want[r.doc_id] = (place[r.s, min(upto[r.s] // pfair.BLOCK_BYTES, n)], place[r.s, min(end // pfair.BLOCK_BYTES, n)])
        upto[r.s] += r.b
    got = {r.doc_id: (r.slot, r.last_slot) for r in pfair.op4_pfair_mix(spark, SF).collect()}
    assert got == want


def test_more_sources_than_slots_in_a_cycle(spark):
    docs = spark.range(2600).selectExpr("id as doc_id", "repeat('x', 64) as text", "concat('s', id % 1300) as source")
    rows = pfair.pfair_mix(docs, block_bytes=64).collect()
    assert sorted(r.slot for r in rows) == list(range(2600))
    assert all(r.release <= r.slot < r.deadline for r in rows)


def test_weights_are_not_rounded(spark):
    docs = spark.range(3000).selectExpr("id as doc_id", "repeat('x', 64) as text", "if(id < 1500, 'a', 'b') as source")
    weights = spark.createDataFrame([("a", 0.5004), ("b", 0.4996)], "source string, weight double")
    rows = pfair.pfair_mix(docs, weights, block_bytes=64).collect()
    for r in rows:
        if r.selected:
            assert r.release == math.floor(r.block / r.weight) and r.deadline == math.ceil((r.block + 1) / r.weight)


def test_a_tiny_source_ends_nothing(spark, edge_docs):
    docs = spark.range(2000).selectExpr("id as doc_id", "repeat('x', 5000) as text", "if(id = 7, 'tiny', concat('s', id % 2)) as source")
    assert pfair.mix_sources(spark, docs, "").count() == 2000
    slots = {r.doc_id: r.slot for r in pfair.pfair_mix(docs).collect()}
    mixed = [slots[r.doc_id] for r in pfair.mix_sources(spark, docs, "").collect()]
    assert mixed == sorted(mixed)
    assert pfair.mix_sources(spark, edge_docs, "").count() == edge_docs.count()
