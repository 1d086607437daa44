import hashlib
import math
import re
import zlib
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sablework.llm import resampling

SF = "/root/testdata/sf0.001"
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def grams(text, orders, buckets):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(FOLD))
    return [zlib.crc32(" ".join(words[i : i + n]).encode()) % buckets for n in range(1, orders + 1) for i in range(len(words) - n + 1)], len(words)


def brute_force(rows, target, orders=1, buckets=10_000, percent=10, min_words=20):
    found = [(i, *grams(t, orders, buckets)) for i, t in rows]
    s = Counter(b for _, g, _ in found for b in g)
    t = Counter(b for x in target for b in grams(x, orders, buckets)[0])
    big_s, big_t = sum(s.values()), sum(t.values())
    out = []
    for i, g, n in found:
        weight = sum(math.floor(1000 * math.log((t[b] + 1) * (big_s + buckets) / ((s[b] + 1) * (big_t + buckets)))) for b in g)
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append((i, len(g), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n))
    able = sorted((r for r in out if r[4] >= min_words), key=lambda r: (-r[3], r[0] is None, r[0]))
    drawn = able[: percent * len(able) // 100]
    return Counter([(*r[:4], k) for k, r in enumerate(drawn, 1)] + [(*r[:4], None) for r in able[len(drawn) :]] + [(*r[:4], None) for r in out if r[4] < min_words])


def test_query_equals_brute_force(spark):
    docs, bench = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "benchmark"))
    want = brute_force([(r.doc_id, r.text) for r in docs.collect()], [r.text for r in bench.collect()])
    assert Counter(map(tuple, resampling.op11_resampling(spark, SF).collect())) == want


def test_query_equals_sql(spark, duck):
    got = sorted(tuple(r) for r in resampling.op11_resampling(spark, SF).select("doc_id", "n_features", "weight", "score", "rank").collect())
    assert got == sorted(duck.sql(f"SELECT doc_id, n_features, weight, score, rank FROM ({resampling.OP11_SQL})").fetchall())


@pytest.mark.parametrize("orders, buckets, percent", [(1, 10_000, 10), (2, 97, 50), (3, 5000, 100)])
def test_edges(spark, edge_docs, orders, buckets, percent):
    target = spark.createDataFrame([("ka lo mi nu",), (None,), ("",)], "text string")
    out = resampling.resample(edge_docs, target, orders, buckets, percent)
    assert out.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    want = brute_force([(r.doc_id, r.text) for r in edge_docs.collect()], ["ka lo mi nu"], orders, buckets, percent)
    assert Counter(map(tuple, out.collect())) == want


def test_empty_tables(spark, edge_docs, no_docs):
    target = edge_docs.select("text").where("false")
    assert resampling.resample(no_docs, target).count() == 0
    rows = [(r.doc_id, r.text) for r in edge_docs.collect()]
    assert Counter(map(tuple, resampling.resample(edge_docs, target).collect())) == brute_force(rows, [])
    assert resampling.resample(edge_docs, target, min_words=10**9).where("rank is not null").count() == 0


def test_ties_and_hot_ids(spark):
    rows = [(7, "same words " * 15)] * 300 + [(8, "same words " * 15)] * 5
    out = resampling.resample(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5), spark.createDataFrame([("same",)], "text string"), percent=100)
    assert sorted(r["rank"] for r in out.collect()) == list(range(1, 306))


def test_pieces():
    texts = pa.array(["a b", None, "c " * 100, "", "d"])
    for most in (1, 3, 50, 10**6):
        cut = list(resampling.pieces(texts, most))
        assert [i for a, b in cut for i in range(a, b)] == list(range(5))
    words = resampling.lower_words(pa.array(["Éa B!b", None, "\x00x\x7fy 9"]))
    assert words.ends.tolist() == [0, 3, 3, 6] and words.distinct.take(pa.array(words.codes)).to_pylist() == ["Éa", "b", "b", "x", "y", "9"]


def test_draws(spark):
    out = spark.range(1000).select(resampling.noise(F.col("id")).alias("g")).agg(F.avg("g")).first()[0]
    assert abs(out - 577) < 150  # the mean of Gumbel noise is Euler's constant
