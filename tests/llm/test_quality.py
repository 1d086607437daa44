import time

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from sablework.llm import quality

SF = "/root/testdata/sf0.001"
BIG = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    out = quality.op12_quality(spark, BIG)
    labels = spark.read.parquet(f"{BIG}/labels.parquet").select("doc_id", "quality")
    rows = out.join(labels, "doc_id").where("held_out").collect()
    good, junk = ([r for r in rows if r.quality == k] for k in (1, 0))
    assert sum(r.predicted for r in good) >= 0.97 * len(good) and sum(r.predicted for r in junk) <= 0.1 * len(junk)
    assert out.count() == spark.read.parquet(f"{BIG}/documents.parquet").count()
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)
    assert out.columns[:4] == ["doc_id", "held_out", "score", "predicted"]


def test_context_vectors_equal_brute_force(spark):
    docs = spark.createDataFrame([(0, "a b, c"), (1, "b b"), (2, None), (3, ""), (4, "x")], "doc_id int, text string").repartition(2)
    places, signs = quality.index_vectors()
    bucket = lambda w: int(quality.buckets_of(pa.array([w]))[0])
    want = np.zeros((quality.BUCKETS, quality.DIM), int)
    for words in (["a", "b", ",", "c"], ["b", "b"], ["x"]):
        for i, w in enumerate(words):
            for j, u in enumerate(words):
                if 0 < abs(i - j) <= quality.WINDOW:
                    want[bucket(w), places[bucket(u)]] += signs[bucket(u)]
    got = np.zeros_like(want)
    for r in quality.context_vectors(docs).collect():
        got[r.bucket] = [r[f"d{i}"] for i in range(quality.DIM)]
    assert (got == want).all()
    assert all(len(set(p)) == quality.NONZERO for p in places[:50])


def test_pooling():
    rng = np.random.default_rng(0)
    vectors = rng.normal(size=(quality.BUCKETS, quality.DIM))
    vectors = np.round(quality.UNIT * vectors / np.linalg.norm(vectors, axis=1, keepdims=True)).astype(np.int16)
    texts = pa.array(["one two ***  two", None, "", "one", " \n", "a a a"])
    x = quality.of_texts(texts, vectors)
    v = lambda w: vectors[quality.buckets_of(pa.array([w]))[0]] / quality.UNIT
    rows = np.array([v("one"), v("two"), v("***"), v("two")])
    assert np.allclose(x[0], [*rows.mean(axis=0), *rows.std(axis=0), (rows[1:] * rows[:-1]).sum() / 3, np.linalg.norm(rows.mean(axis=0)), np.log1p(4)], atol=2e-5)
    assert not x[[1, 2, 4]].any() and np.isclose(x[5, -3], 1, atol=1e-3) and np.allclose(x[5, quality.DIM : 2 * quality.DIM], 0, atol=1e-3)


def test_network_and_temperature():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(800, 3))
    y = (x[:, 0] * x[:, 1] > 0).astype(float)  # no single layer can tell
    net = quality.train_network(x, y, np.arange(800) % 4 == 0)
    fresh = rng.normal(size=(500, 3))
    assert ((net.score(fresh) >= 0.5) == (fresh[:, 0] * fresh[:, 1] > 0)).mean() > 0.9
    z = rng.normal(size=20_000) * 2
    labels = (rng.random(20_000) < quality.sigmoid(z)).astype(float)
    assert abs(quality.best_temperature(3 * z, labels) - 3) < 0.2 and abs(quality.best_temperature(z / 2, labels) - 0.5) < 0.05


def test_edges(spark, edge_docs, no_docs):
    labels = edge_docs.where("doc_id is not null").select("doc_id", (F.col("doc_id") % 5 > 0).cast("int").alias("quality"), F.lit(1).alias("text"))
    out = quality.score(edge_docs, labels, F.lit(True)).collect()
    assert len(out) == edge_docs.count() and all(0 <= r.score <= 1 for r in out)
    by = {r.doc_id: r.score for r in out}
    assert by[62] == by[63] == by[64] and by[60] == by[61] == by[0] and by[65] == by[66]
    assert quality.score(no_docs, labels, F.lit(True)).count() == 0
    assert {r.score for r in quality.score(edge_docs, labels.where("false"), F.lit(True)).collect()} == {0.0}
    assert {r.score for r in quality.score(edge_docs, labels.withColumn("quality", F.lit(1)), F.lit(True)).collect()} == {1.0}
    assert {r.score for r in quality.score(edge_docs, labels.withColumn("quality", F.lit(None).cast("int")), F.lit(True)).collect()} == {0.0}
    # One labelled row of each kind: nothing may be left apart.
    two = labels.where("doc_id in (0, 1)")
    assert all(0 <= r.score <= 1 for r in quality.score(edge_docs, two, F.lit(True)).collect())


def test_only_training_rows_are_learned_from(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    usable = ~quality.held_out()
    flipped = labels.withColumn("quality", F.when(quality.held_out(), 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = ({r.doc_id: r.score for r in quality.score(docs, x, usable).collect()} for x in (labels, flipped))
    assert a == b


def test_long_texts():
    began = time.process_time()
    vectors = np.zeros((quality.BUCKETS, quality.DIM), np.int16)
    x = quality.of_texts(pa.array(["lo mi *** " * 200_000, "lo"]), vectors)
    assert x[0, -1] == round(float(np.log1p(600_000)), 5) and time.process_time() - began < 30


def test_equal_texts_have_equal_scores_whatever_is_beside_them():
    rng = np.random.default_rng(2)
    vectors = rng.integers(-4000, 4000, (quality.BUCKETS, quality.DIM)).astype(np.int16)
    texts = [" ".join(f"w{i}" for i in rng.integers(0, 500, n)) for n in (3, 40, 700)]
    net = quality.train_network(rng.normal(size=(100, quality.FEATURES)), rng.integers(0, 2, 100).astype(float), np.arange(100) % 4 == 0)
    many = net.score(quality.of_texts(pa.array([t for i in range(37) for t in (*texts, f"other {i} " * i)]), vectors))
    for i, t in enumerate(texts):
        assert set(many[i::4]) == set(net.score(quality.of_texts(pa.array([t]), vectors)))
