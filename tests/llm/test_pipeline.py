import corpus_pipeline

import __spark_entry__ as entry
from sablework.llm import exact_dedup, langid, minhash, packing, pfair

SF = "/root/testdata/sf0.001"


def test_run_against_stages_by_brute_force(spark):
    from test_minhash import brute
    from test_packing import check, encoded

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = {r.doc_id: r.text for r in docs.collect()}
    # No document of the tables is junk, so the first stage keeps all.
    latest = {}
    for i in sorted(rows):
        latest[rows[i]] = i
    unique = {i: rows[i] for i in latest.values()}
    near = {i for i, (_, c) in brute(list(unique.items())).items() if i == c}
    second = exact_dedup.keep_first_copies(spark, langid.keep_known_languages(spark, docs, SF), SF)
    assert {r.doc_id for r in second.collect()} == set(unique)
    third = minhash.keep_one_of_each(spark, second, SF)
    assert {r.doc_id for r in third.collect()} == near
    out = corpus_pipeline.run(spark, SF).collect()
    # Mixing drops nothing, and packing has every id of every document that is left, once.
    assert {r.doc_id for r in out} == near
    assert check(out, encoded(third)) < 0.02


def test_contract(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "exact_dedup", "near_dedup", "mixing", "packing"]
    assert "pipeline" in entry.queries()
    assert {f"op{n}" for n in range(1, 14)} == {q.split("_")[0] for q in entry.queries() if q.startswith("op")}
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SF).columns == docs.columns


def test_run_with_edge_rows(spark, edge_docs, no_docs, as_dir):
    """Null and repeated ids and texts, one id on different texts, clashing names; and an empty table."""
    extra = [(500, "A quite short text about ka lo"), (500, "Another text, mi nu pe ro sa"), (501, "Third one ti vu wa xe"), (502, "A quite short text about ka lo")]
    docs = edge_docs.unionByName(spark.createDataFrame([(i, t, "aa", "s1", 1, 7, "k", 0.5, "t") for i, t in extra], edge_docs.schema))
    rows = corpus_pipeline.run(spark, as_dir(docs)).collect()
    # Of (500, A), (502, A) the larger id stays; (500, B) is another document.
    assert {500, 501, 502} <= {r.doc_id for r in rows}
    assert sum(r.doc_id == 500 for r in rows if r.start == 0) == 1
    assert corpus_pipeline.run(spark, as_dir(no_docs)).count() == 0


def test_packed_sequences_are_in_the_order_of_the_mixture(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    mixed = pfair.mix_sources(spark, docs, "")
    mixed.write.parquet(str(tmp_path / "mixed"))
    slots = {}
    for r in pfair.pfair_mix(docs).collect():
        slots[r.doc_id] = r.slot
    out = packing.pack_documents(spark, spark.read.parquet(str(tmp_path / "mixed")), "").where("start = 0")
    tasks = {}
    for r in out.collect():
        if slots[r.doc_id] is not None:
            tasks.setdefault(r.sequence_id >> 40, []).append(slots[r.doc_id])
    assert len(tasks) > 1
    ranges = [(min(x), max(x)) for _, x in sorted(tasks.items())]
    # A range of slots for each task; documents of one slot may be on both sides of a border.
    assert all(a[1] <= b[0] for a, b in zip(ranges, ranges[1:], strict=False))
