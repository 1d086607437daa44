from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from sablework.llm import exact_dedup as e

SF = "/root/testdata/sf0.001"


def brute(rows):
    groups = defaultdict(list)
    for r in rows:
        groups[r.text or ""].append(r.doc_id)
    key = lambda i: -1 if i is None else i
    return sorted((key(i), key(max(ids, key=key)), len(ids)) for ids in groups.values() for i in ids)


@pytest.mark.parametrize("digest", [e.sha256_of, lambda t: F.substring(F.sha2(t, 256), 1, 1)], ids=["sha256", "colliding"])
def test_against_brute_force(edge_docs, digest):
    got = e.exact_dedup(edge_docs, digest).collect()
    key = lambda i: -1 if i is None else i
    assert sorted((key(r.doc_id), key(r.keep_id), r.group_size) for r in got) == brute(edge_docs.collect())
    assert all(r.kept == (r.doc_id == r.keep_id) for r in got)


def test_query_equals_sql(spark, duck):
    columns = ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    got = sorted(tuple(r) for r in e.op2_exact_dedup(spark, SF).select(*columns).collect())
    assert got == sorted(duck.sql(e.OP2_SQL).select(*columns).fetchall())


def test_state_goes_on(spark, tmp_path):
    home, arrivals = str(tmp_path / "home"), str(tmp_path / "in")
    rows = lambda ids: spark.createDataFrame([(i, d, "f") for i, d in ids], e.ARRIVAL)
    rows([(1, "x"), (2, "y")]).write.parquet(arrivals)
    assert {r.digest: (r.keep_id, r.n_rows) for r in e.stream_state(spark, arrivals, home).collect()} == {"x": (1, 1), "y": (2, 1)}
    rows([(5, "x"), (0, "y"), (9, "z")]).write.mode("append").parquet(arrivals)
    spark.createDataFrame([], e.CHANGE)
    assert {r.digest: (r.keep_id, r.n_rows) for r in e.stream_state(spark, arrivals, home).collect()} == {"x": (5, 2), "y": (2, 2), "z": (9, 1)}


def test_empty_and_stage(spark, no_docs, unique_docs):
    assert e.exact_dedup(no_docs).count() == 0
    kept = e.keep_first_copies(spark, unique_docs, "")
    assert kept.columns == unique_docs.columns
    ids = {r.doc_id for r in kept.collect()}
    assert {60, 0} & ids == set() and {61, 66, 67, 63, 64} <= ids and 65 not in ids and 62 not in ids


def test_stage_keeps_one_row_of_each_text(spark, edge_docs, no_docs, tmp_path):
    """Repeated and null ids, one id on different texts, from memory and from files; other columns as they were."""
    extra = [(1, "A"), (1, "B"), (2, "C"), (3, "A"), (None, "N"), (None, "N"), (None, "M"), (4, "R"), (4, "R"), (5, None), (6, "")]
    rows = [(i, t, "aa", "s1", 1, 7, "k", 0.5, "t") for i, t in extra]
    docs = edge_docs.unionByName(spark.createDataFrame(rows, edge_docs.schema))
    docs.write.parquet(str(tmp_path / "docs"))
    key = lambda i: -1 if i is None else i
    want = {}
    for r in docs.collect():
        want[r.text or ""] = max(want.get(r.text or "", -1), key(r.doc_id))
    for given in (docs, spark.read.parquet(str(tmp_path / "docs"))):
        kept = e.keep_first_copies(spark, given, "")
        assert kept.columns == docs.columns
        got = kept.collect()
        assert len(got) == len(want) and {r.text or "": key(r.doc_id) for r in got} == want
    assert e.keep_first_copies(spark, no_docs, "").count() == 0


def test_several_batches_share_one_state(spark, unique_docs, monkeypatch):
    monkeypatch.setattr(e, "FILES_PER_BATCH", 1)
    got = e.exact_dedup(unique_docs.repartition(3)).collect()
    assert sorted((r.doc_id, r.keep_id, r.group_size) for r in got) == brute(unique_docs.collect())
