import time

from pyspark.sql import functions as F

from sablework.llm import toxicity

SF = "/root/testdata/sf0.001"

BIG = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    out = toxicity.op10_toxicity(spark, BIG)
    labels = spark.read.parquet(f"{BIG}/labels.parquet").select("doc_id", "toxic")
    rows = out.join(labels, "doc_id").where("held_out").collect()
    caught = [r for r in rows if r.toxic == 1]
    clean = [r for r in rows if r.toxic == 0]
    assert sum(r.predicted for r in clean) <= 0.05 * len(clean)
    assert sum(r.predicted for r in caught) >= 0.5 * len(caught)
    assert out.count() == spark.read.parquet(f"{BIG}/documents.parquet").count()
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)


def test_features():
    lexicon = frozenset(toxicity.INSULTS.split())
    f = lambda t: dict(zip(toxicity.FEATURES, toxicity.features(t, lexicon), strict=True))
    assert set(f(None).values()) == set(f("").values()) == {0.0}
    assert f("You IDIOT, really")["lexicon_hits"] == 1 and f("You IDIOT, really")["near_second_person"] == 1
    assert f("what an 1d10t!")["obfuscated_hits"] == 1 and f("an i d i o t here")["obfuscated_hits"] == 1
    assert f("A nice day.")["lexicon_hits"] == 0
    far = "word " * 20
    # A word pulled apart stands where it is written, not at the text's start.
    assert f("you " + far + "i d i o t")["near_second_person"] == 0 and f(far + "i d i o t , you")["near_second_person"] == 1
    assert f("you " + far + "idiot " + far + "you idiot " + far + "idiot")["near_second_person"] == 1


def test_long_texts_take_linear_time():
    began = time.process_time()
    out = dict(zip(toxicity.FEATURES, toxicity.features("you idiot i d i o t " * 60_000, frozenset(["idiot"])), strict=True))
    assert out["lexicon_hits"] == out["near_second_person"] == 120_000 and time.process_time() - began < 20


def test_edges(spark, edge_docs, no_docs):
    labels = edge_docs.where("doc_id is not null").select("doc_id", (F.col("doc_id") % 5 == 0).cast("int").alias("toxic"), F.lit(1).alias("text"))
    out = toxicity.score(edge_docs, labels, F.lit(True)).collect()
    assert len(out) == edge_docs.count() and all(0 <= r.score <= 1 for r in out)
    by = {r.doc_id: r.score for r in out}
    assert by[62] == by[63] == by[64]
    assert toxicity.score(no_docs, labels, F.lit(True)).count() == 0
    nothing = toxicity.score(edge_docs, labels.where("false"), F.lit(True)).collect()
    assert {r.score for r in nothing} == {0.0}
    one_kind = toxicity.score(edge_docs, labels.withColumn("toxic", F.lit(1)), F.lit(True)).collect()
    assert {r.score for r in one_kind} == {1.0}


def test_only_training_rows_are_learned_from(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    usable = ~toxicity.held_out()
    flipped = labels.withColumn("toxic", F.when(toxicity.held_out(), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = ({r.doc_id: r.score for r in toxicity.score(docs, x, usable).collect()} for x in (labels, flipped))
    assert a == b
