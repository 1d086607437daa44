import time

from sablework.operators.metrics import RedactionMetrics, StreamMetrics, metrics, watch_stream
from sablework.plans.engine import Engine
from sablework.sources.stores import scratch_dir
from sablework.streaming.redaction import redact_stream

SSN = {"identifiers": {"ssn": {}}}


def docs(spark):
    return spark.createDataFrame([(i, "a b 123-45-6789" if i % 3 else None) for i in range(30)], "id int, text string").repartition(3)


def test_the_writing_job_counts(spark):
    counts, contexts = RedactionMetrics(), spark.createDataFrame([("a",), ("a",), ("b",)], "context string")
    for _ in range(2):
        counts.watch(Engine(SSN).redact(docs(spark))).write.parquet(f"{scratch_dir(spark)}/out")
    assert counts.totals() == {"documents": 60, "tokens_received": 120, "redactions_total": 40}
    row = counts.row(spark, contexts).first()
    assert (row.contexts, row.healthy) == (2, 1)
    assert counts.row(spark).columns == metrics(Engine(SSN).explain(docs(spark)), contexts).columns
    none = RedactionMetrics()
    none.watch(Engine(SSN).redact(docs(spark).where("false"))).write.parquet(f"{scratch_dir(spark)}/out")
    assert set(none.totals().values()) == {0}


def test_one_search_and_no_early_job(spark):
    contexts = spark.createDataFrame([("a",)], "context string").selectExpr("if(raise_error('early') is null, context, 'b') as context")
    df = metrics(Engine(SSN).explain(docs(spark)), contexts)
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate") >= 1  # made without running anything


def test_streams_count_by_batch(spark, tmp_path):
    docs(spark).write.parquet(str(tmp_path / "in"))
    listener = StreamMetrics()
    spark.streams.addListener(listener)
    try:
        stream = watch_stream(redact_stream(spark.readStream.schema("id int, text string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")), Engine(SSN)))
        query = stream.writeStream.format("noop").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        query.awaitTermination()
        for _ in range(100):
            if listener.totals["documents"] == 30:
                break
            time.sleep(0.2)
        assert listener.totals == {"documents": 30, "tokens_received": 60, "redactions_total": 20}
    finally:
        spark.streams.removeListener(listener)
