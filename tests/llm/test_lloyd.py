import hashlib
import random

import numpy as np
import pytest

from sablework.llm import lloyd

SF = "/root/testdata/sf0.001"


def brute_force(rows, dims=64, clusters=16, rounds=3, scale=64):
    import math

    kept = [(i, [max(-lloyd.MOST, min(lloyd.MOST, math.floor(scale * v))) for v in x]) for i, x in rows if x is not None and len(x) == dims and all(v is not None and math.isfinite(v) for v in x)]
    h = lambda i: hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest()
    c = [x for _, x in sorted((h(i), x) for i, x in kept)[:clusters]]
    near = lambda x: min((sum((a - b) ** 2 for a, b in zip(x, y, strict=True)), k) for k, y in enumerate(c))
    for _ in range(rounds):
        groups = {}
        for _, x in kept:
            groups.setdefault(near(x)[1], []).append(x)
        c = [[sum(v) // len(groups[k]) for v in zip(*groups[k], strict=True)] if k in groups else y for k, y in enumerate(c)]
    found = [(i, *near(x)[::-1]) for i, x in kept]
    each = {k: sum(d for _, j, d in found if j == k) for k in range(len(c))}
    top = 2**63 - 1
    digest = [hashlib.sha256(",".join(map(str, y)).encode()).hexdigest() for y in c]
    return sorted(((i, k, d, min(top, each[k]), min(top, sum(each.values())), digest[k]) for i, k, d in found), key=str)


def got(df):
    assert df.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_query_equals_brute_force(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    assert got(lloyd.op13_lloyd(spark, SF)) == brute_force(rows)


def test_query_equals_sql(spark, duck):
    want = duck.sql(f"SELECT vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 FROM ({lloyd.OP13_SQL})").fetchall()
    assert got(lloyd.op13_lloyd(spark, SF)) == sorted(want, key=str)


@pytest.fixture(scope="module")
def odd_vectors(spark):
    rng = random.Random(3)
    rows = [(i, [rng.uniform(-1, 1) for _ in range(5)], 1, 2) for i in range(60)]
    rows += [(i, rows[4][1], 1, 2) for i in range(60, 100)] + [(100, rows[4][1], 1, 2)] * 30
    nan, inf = float("nan"), float("inf")
    rows += [(200, None, 1, 2), (201, [], 1, 2), (202, [0.1] * 4, 1, 2), (203, [0.1] * 6, 1, 2), (204, [0.1, None, 0.1, 0.1, 0.1], 1, 2)]
    rows += [(205, [nan] * 5, 1, 2), (206, [0.0, inf, 0.0, 0.0, 0.0], 1, 2), (207, [-inf] * 5, 1, 2), (None, [0.5] * 5, 1, 2), (None, [0.25] * 5, 1, 2)]
    return spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, cluster int, x int").repartition(4)


@pytest.mark.parametrize("width, clusters, rounds", [(2, 4, 3), (5, 1, 2), (3, 16, 5), (1, 16, 0)])
def test_edges(spark, odd_vectors, width, clusters, rounds):
    rows = [(r.vec_id, r.embedding) for r in odd_vectors.collect()]
    out = lloyd.lloyd(odd_vectors, dims=5, clusters=clusters, rounds=rounds, width=width)
    assert got(out) == brute_force(rows, 5, clusters, rounds)


def test_few_none_and_huge(spark, odd_vectors):
    few = odd_vectors.where("vec_id < 3")
    assert got(lloyd.lloyd(few, dims=5, width=2)) == brute_force([(r.vec_id, r.embedding) for r in few.collect()], 5)
    assert got(lloyd.lloyd(odd_vectors.where("false"), dims=5)) == [] and got(lloyd.lloyd(odd_vectors, dims=7)) == []
    rows = [(1, [1e30] * 3), (2, [-1e30] * 3), (3, [1e6] * 3), (4, [0.0] * 3), (5, [-3e5, 1e300, 2.0])] * 4
    out = lloyd.lloyd(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>"), dims=3, clusters=2, width=2)
    assert got(out) == brute_force(rows, 3, 2)


def test_blocks_add_up():
    rng = np.random.default_rng(1)
    a, c = rng.integers(-70, 70, (50, 9)), rng.integers(-70, 70, (4, 9))
    parts = [lloyd.narrow(lloyd.distances(lloyd.narrow(a[:, i : i + 2]), c[:, i : i + 2])) for i in range(0, 9, 2)]
    total = parts[0]
    for p in parts[1:]:
        total = lloyd.add(total, p)
    assert (total == ((a[:, None] - c[None]) ** 2).sum(axis=2)).all() and parts[0].dtype.itemsize < 8
    assert lloyd.nearest(np.array([[3, 1, 1], [2, 2, 5]]))[0].tolist() == [1, 0]
