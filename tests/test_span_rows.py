import random
import time

import pytest

from sablework.operators.span_rows import Frontier, drop_contained_rows


def brute_force(rows):
    return sorted(x for x in rows if not any(y[0] == x[0] and y[1] < x[1] and y[2] <= x[2] and y[3] >= x[3] for y in rows))


@pytest.mark.parametrize("seed, width", [(1, 5), (2, 40), (3, 1000)])
def test_equals_brute_force(spark, seed, width):
    rng = random.Random(seed)
    rows = []
    for doc, n in (("a", 300), ("b", 5), ("c", 1), ("", 60)):
        ranks = rng.sample(range(10_000), n)
        rows += [(doc, r, at, at + rng.randint(0, width)) for r in ranks for at in [rng.randint(0, 200)]]
    df = spark.createDataFrame([(*r, "more") for r in rows], "doc_id string, n int, start int, end int, __d string").repartition(5)
    out = drop_contained_rows(df)
    assert out.columns == df.columns
    assert sorted(tuple(r)[:4] for r in out.collect()) == brute_force(rows)


def test_nulls_and_no_rows(spark):
    df = spark.createDataFrame([("a", 1, 0, 9), (None, 2, 3, 4), ("a", None, 3, 4), ("a", 3, None, 4), ("a", 4, 3, 4), ("a", 5, 0, 10)], "doc_id string, n int, start int, end int")
    assert sorted(r.n for r in drop_contained_rows(df).collect()) == [1, 5]
    assert drop_contained_rows(df.where("false")).count() == 0


def test_frontier():
    rng = random.Random(9)
    for _ in range(50):
        front, seen = Frontier(), []
        for rank in rng.sample(range(1000), 60):
            end = rng.randint(0, 40)
            assert front.holds(end, rank) == any(e >= end and r < rank for e, r in seen)
            seen.append((end, rank))


def test_one_document_with_a_million_spans(spark):
    n = 1_000_000
    # Ranks at random; every span is ten wide, but each thousandth covers the 500 places after it and comes first of all.
    df = spark.range(n).selectExpr("1 as doc_id", "if(id % 1000 = 0, -id, cast(xxhash64(id) & 0xFFFFFFFFFF as bigint) * 1000000 + id) as n".replace("0xFFFFFFFFFF", "1099511627775"), "id * 2 as start", "id * 2 + if(id % 1000 = 0, 500, 10) as end")
    began = time.time()
    out = drop_contained_rows(df).selectExpr("count(*) c", "sum(cast(start % 2000 between 2 and 490 as int)) as inside").first()
    assert out.inside == 0 and 700_000 < out.c < n and time.time() - began < 120
