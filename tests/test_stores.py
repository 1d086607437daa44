import time

import pytest
from pyspark.sql import functions as F

from sablework.operators.metrics import metrics, token_count
from sablework.plans.engine import Engine
from sablework.sources.ledger import ENTRY, Ledger
from sablework.sources.stores import AlreadyExists, ContextStore, NotFound, PolicyStore, context_entries, scratch_dir, token_hash
from sablework.streaming.redaction import redact_stream, start, token_rate, with_stores

SSN = {"identifiers": {"ssn": {"ssnFilterStrategies": [{"strategy": "RANDOM_REPLACE"}]}}}


def test_policies(spark, tmp_path):
    store = PolicyStore(spark, str(tmp_path / "p"))
    assert store.list() == [] and store.find("a") is None
    store.create("a", SSN)
    store.create("b", "{}")
    with pytest.raises(AlreadyExists):
        store.create("a", "{}")
    with pytest.raises(NotFound):
        store.update("c", "{}")
    with pytest.raises(ValueError):
        store.create("bad", "{")
    store.update("a", "{}")
    assert store.get("a") == "{}" and store.list() == ["a", "b"]
    store.delete("a")
    store.delete("a")
    assert store.as_dict() == {"b": "{}"}
    with pytest.raises(NotFound):
        store.get("a")


def docs(spark):
    rows = [("d1", "ctx1", "f", "SSN 123-45-6789 and 321-45-6789"), ("d2", "ctx2", "f", "SSN 123-45-6789"), ("d3", "", None, "SSN 111-45-6789"), ("d4", "ctx1", "f", "none")]
    return spark.createDataFrame(rows, "document_id string, context string, file_name string, text string")


def test_contexts(spark, tmp_path):
    store = ContextStore(spark, str(tmp_path / "c"))
    explained = Engine(SSN).explain(docs(spark), context="context")
    store.put(context_entries(explained, "document_id"))
    assert store.count("ctx1") == 2 and store.count("ctx2") == 1 and store.count("none") == 0
    assert sorted(r.context for r in store.list().collect()) == ["ctx1", "ctx2"]
    kept = store.get("ctx1", "123-45-6789")
    assert kept and store.get("ctx1", "999") is None
    again = Engine({"identifiers": {"ssn": {}}}).explain(docs(spark), context="context")
    store.put(context_entries(again, "document_id"))
    assert store.get("ctx1", "123-45-6789") == "{{{REDACTED-ssn}}}" and store.count("ctx1") == 2
    found = store.lookup(spark.createDataFrame([("ctx2", "123-45-6789"), ("ctx2", "x")], "context string, token string"))
    assert {r.token: r.replacement for r in found.collect()} == {"123-45-6789": "{{{REDACTED-ssn}}}", "x": None}
    store.delete("ctx1")
    store.delete("ctx1")
    assert [r.context for r in store.list().collect()] == ["ctx2"]


@pytest.mark.parametrize("key", [None, b"0123456789abcdef"])
def test_ledger(spark, tmp_path, key):
    ledger = Ledger(key)
    explained = Engine(SSN).explain(docs(spark), context="context")
    at = F.lit("2024-01-02 03:04:05.678").cast("timestamp")
    path = str(tmp_path / "ledger")
    ledger.record(explained, at).write.parquet(path)
    entries = spark.read.parquet(path)
    rows = sorted(entries.collect(), key=lambda r: (r.document_id, r["index"]))
    assert [(r.document_id, r["index"]) for r in rows] == [("d1", 0), ("d1", 1), ("d2", 0), ("d3", 0)]
    assert rows[0].previous_hash == bytes(32) != rows[1].previous_hash and rows[3].file_name == ""
    assert (rows[0].text == "123-45-6789") == (key is None)
    assert [r.text for r in ledger.get(entries, "d1").collect()] == ["123-45-6789", "321-45-6789"]
    assert ledger.verify(entries, "d1") and ledger.verify(entries, "d2")
    with pytest.raises(NotFound):
        ledger.verify(entries, "d9")
    assert ledger.get(entries, "d9").collect() == []
    change = lambda i: entries.withColumn("replacement", F.when((F.col("document_id") == "d1") & (F.col("index") == i), "x").otherwise(F.col("replacement")))
    assert not ledger.verify(change(0), "d1") and ledger.verify(change(0), "d2")
    assert ledger.verify(change(1), "d1")  # nothing covers the last entry
    more = entries.unionByName(ledger.record(explained, at, entries))
    assert ledger.verify(more, "d1") and [r["index"] for r in ledger.get(more, "d1").collect()] == [0, 1, 2, 3]


def test_bad_key_leaves_texts_in_clear():
    with pytest.warns(UserWarning):
        assert Ledger(b"short").key is None


def test_metrics(spark):
    df = spark.createDataFrame([(" a b c　d ",), ("",), (None,)], "text string")
    assert [r.n for r in df.select(token_count(F.col("text")).alias("n")).collect()] == [4, 0, 0]
    row = metrics(Engine(SSN).explain(docs(spark)), spark.createDataFrame([("a", "h"), ("a", "i")], "context string, token_hash string")).first()
    assert (row.documents, row.tokens_received, row.redactions_total, row.contexts, row.healthy) == (4, 9, 4, 1, 1)


def test_streams(spark, tmp_path):
    source, home = str(tmp_path / "in"), str(tmp_path)
    base = docs(spark).withColumn("ts", F.lit("2024-01-01 00:00:10").cast("timestamp"))
    base.where("document_id = 'd1'").write.parquet(source)
    contexts, ledger = ContextStore(spark, home + "/contexts"), Ledger()
    stream = lambda: redact_stream(spark.readStream.schema(base.schema).parquet(source), Engine(SSN), context="context")
    keep = with_stores(contexts, ledger, home + "/ledger")
    start(stream(), keep, home + "/cp").awaitTermination()
    base.where("document_id <> 'd1'").write.mode("append").parquet(source)
    start(stream(), keep, home + "/cp").awaitTermination()
    assert contexts.count("ctx1") == 2 and contexts.count("ctx2") == 1
    again = base.where("document_id = 'd1'").withColumn("text", F.lit("SSN 222-45-6789 and 223-45-6789"))
    again.write.mode("append").parquet(source)
    start(stream(), keep, home + "/cp").awaitTermination()
    assert contexts.count("ctx1") == 4
    entries = spark.read.schema(ENTRY).parquet(home + "/ledger")
    assert sorted(r["index"] for r in entries.where("document_id = 'd1'").collect()) == [0, 1, 2, 3]
    assert entries.count() == 6 and all(r.valid for r in ledger.verify_all(entries).collect())
    windows = token_rate(stream(), "ts", "1 minute", "1 minute").writeStream.outputMode("complete").format("memory").queryName("rate").trigger(availableNow=True).start()
    windows.awaitTermination()
    row = spark.table("rate").first()
    assert (row.documents, row.redactions) == (5, 6)


def test_several_rows_of_one_document_make_one_chain(spark):
    explained = Engine(SSN).explain(docs(spark).union(docs(spark)), context="context")
    entries = Ledger().record(explained, F.lit("2024-01-02 03:04:05").cast("timestamp"))
    rows = sorted((r.document_id, r["index"]) for r in entries.collect())
    assert rows == [("d1", 0), ("d1", 1), ("d1", 2), ("d1", 3), ("d2", 0), ("d2", 1), ("d3", 0), ("d3", 1)]
    assert all(r.valid for r in Ledger().verify_all(entries).collect())


def test_clashing_names_of_the_input(spark):
    df = docs(spark).withColumns({c: F.lit(c) for c in ("__digit", "__m0", "confidence", "position", "token")})
    out = Engine(SSN).redact(df, context="context")
    assert out.columns == [*df.columns, "spans", "filtered_text"] and out.first()["__digit"] == "__digit" and out.first()["__m0"] == "__m0"
    rows = Engine(SSN).explain_rows(df, context="context")
    assert len(set(rows.columns)) == len(rows.columns) and {"input_confidence", "input_position", "input_token"} < set(rows.columns)
    assert {r.input_token for r in rows.collect()} == {"token"} and {r.token for r in rows.collect()} != {"token"}


def test_batches_go_on_from_the_ends_of_chains(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("sablework.streaming.redaction.MERGE_EVERY", 2)
    ledger, path = Ledger(), str(tmp_path / "ledger")
    keep = with_stores(None, ledger, path)
    explained = Engine(SSN).explain(docs(spark), context="context")
    for epoch, ids in enumerate((["d1"], ["d2"], ["d3"], ["d1", "d2"], ["d1"])):
        keep(explained.where(F.col("document_id").isin(ids)), epoch)
    keep(explained.where("document_id = 'd1'"), 4)  # a batch that is run again
    entries = spark.read.schema(ENTRY).parquet(path)
    assert sorted((r.document_id, r["index"]) for r in entries.collect()) == [*(("d1", i) for i in range(6)), ("d2", 0), ("d2", 1), ("d3", 0)]
    assert all(r.valid for r in ledger.verify_all(entries).collect())
    assert spark.read.parquet(f"{path}_tails/epoch=2").count() == 3 and spark.read.parquet(f"{path}_tails/epoch=3").count() == 2


def test_a_new_checkpoint_goes_on_from_the_ledger(spark, tmp_path):
    source, home = str(tmp_path / "in"), str(tmp_path)
    docs(spark).write.parquet(source)
    ledger, keep = Ledger(), with_stores(None, Ledger(), home + "/ledger")
    for checkpoint in ("/one", "/two"):
        stream = redact_stream(spark.readStream.schema(docs(spark).schema).parquet(source), Engine(SSN), context="context")
        start(stream, keep, home + checkpoint).awaitTermination()
    entries = spark.read.schema(ENTRY).parquet(home + "/ledger")
    assert sorted(r["index"] for r in entries.where("document_id = 'd1'").collect()) == [0, 1, 2, 3]
    assert entries.count() == 8 and all(r.valid for r in ledger.verify_all(entries).collect())
    explained = Engine(SSN).explain(docs(spark), context="context")
    with pytest.raises(ValueError):
        keep(explained, 0)


def test_a_million_entries_of_one_document(spark):
    span = F.struct(
        F.lit(0).alias("character_start"), F.lit(1).alias("character_end"), F.lit("ssn").alias("filter_type"), F.lit("").alias("context"), F.lit(1.0).alias("confidence"),
        F.col("id").cast("string").alias("text"), F.lit("x").alias("replacement"), F.lit(False).alias("ignored"), F.lit(True).alias("applied"),
    )
    rows = spark.range(1_000_000).select(F.lit("d").alias("document_id"), F.format_string("%07d", "id").alias("file_name"), F.array(span).alias("spans"))
    began = time.time()
    entries = Ledger().record(rows, F.lit("2024-01-02 03:04:05").cast("timestamp"))
    entries.write.parquet(f"{scratch_dir(spark)}/ledger")
    assert time.time() - began < 120
    held = Ledger().record(rows.limit(0).unionByName(rows.where("file_name < '0000100'")), F.lit("2024-01-02 03:04:05").cast("timestamp"))
    first = held.orderBy("index").collect()
    assert [(r["index"], r.text) for r in first] == [(i, str(i)) for i in range(100)] and Ledger().verify(held, "d")


def test_puts_rewrite_the_buckets_that_they_touch(spark, tmp_path):
    store = ContextStore(spark, str(tmp_path / "c"), buckets=32)
    rows = lambda low, high, r: spark.range(low, high).select(F.lit("k").alias("context"), token_hash(F.col("id").cast("string")).alias("token_hash"), F.lit(r).alias("replacement"), F.lit(0).alias("seq"))
    store.put(rows(0, 500, "a"))
    number, before = store.table.manifest()
    assert number == 0 and len(before) == 32
    store.put(rows(498, 503, "b"))
    number, after = store.table.manifest()
    moved = {b for b in after if after[b] != before[b]}
    assert number == 1 and 1 <= len(moved) <= 5 and store.count("k") == 503
    assert [store.get("k", str(i)) for i in (497, 498, 502, 503)] == ["a", "b", "b", None]
    # The number of buckets is the store's own, whatever a later caller says.
    other = ContextStore(spark, str(tmp_path / "c"), buckets=8)
    assert other.get("k", "499") == "b" and other.table.buckets == 32
    files = store.table.read([next(iter(moved))]).inputFiles()
    assert all("bucket=" in f for f in files) and len({f.rsplit("/", 2)[1] for f in files}) == 1
    store.delete("k")
    assert store.count("k") == 0 and store.table.manifest()[1] == {} and store.get("k", "1") is None
    store.put(rows(0, 0, "c"))
    assert store.table.manifest()[0] == 2


def test_two_writers_can_not_make_the_same_change(spark, tmp_path):
    store = ContextStore(spark, str(tmp_path / "c"))
    store.table._claim(0, {})
    with pytest.raises(AlreadyExists):
        store.table._claim(0, {})
