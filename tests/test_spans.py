import random
import time

from pyspark.sql import functions as F

from sablework.functions.spans import MATCH, drop_contained, drop_contained_sql, sorted_spans, splice
from sablework.operators.patterns import KINDS
from sablework.plans.engine import Engine

SMALL = "array<struct<start:int,end:int>>"


def drop(spark, spans):
    df = spark.createDataFrame([(spans,)], "s " + SMALL)
    return [tuple(x) for x in df.select(drop_contained(F.col("s"), SMALL).alias("o")).first().o]


def test_containment(spark):
    held = [(10, 20), (30, 40)]
    for span, inside in [((10, 20), True), ((12, 18), True), ((10, 15), True), ((15, 20), True), ((9, 20), False), ((10, 21), False), ((5, 25), False),
                         ((15, 25), False), ((20, 30), False), ((30, 40), True), ((35, 36), True), ((0, 5), False)]:
        assert (span not in drop(spark, [*held, span]) or span in held) == inside


def test_drop(spark):
    assert drop(spark, []) == []
    assert drop(spark, [(10, 20), (12, 18)]) == [(10, 20)]
    assert drop(spark, [(12, 18), (10, 20)]) == [(12, 18), (10, 20)]
    assert drop(spark, [(10, 20), (15, 25), (30, 40), (35, 38)]) == [(10, 20), (15, 25), (30, 40)]
    assert drop(spark, [(1, 5), (1, 5)]) == [(1, 5)]


SPANS = "array<struct<character_start:int,character_end:int,text:string,replacement:string,ignored:boolean,applied:boolean>>"


def spliced(spark, text, spans):
    rows = [(text, [(a, b, text.encode()[a:b].decode() if a < b else "", r, i, not i) for a, b, r, i in spans])]
    return spark.createDataFrame(rows, f"text string, s {SPANS}").select(splice(F.col("text"), F.col("s")).alias("o")).first().o


def test_splice(spark):
    t = "0123456789ABC"
    assert spliced(spark, t, []) == t
    assert spliced(spark, t, [(2, 4, "<A>", False)]) == "01<A>456789ABC"
    assert spliced(spark, t, [(2, 6, "<A>", False), (4, 9, "<C>", False)]) == "01<A><C>9ABC"
    # Reading goes on at the last span's end, even further left.
    assert spliced(spark, t, [(0, 10, "<X>", False), (2, 5, "<Y>", False)]) == "<X><Y>56789ABC"
    assert spliced(spark, t, [(2, 4, "", False), (5, 6, "z", True)]) == t
    assert spliced(spark, "é中x", [(2, 5, "*", False)]) == "é*x"


def test_sort_is_stable(spark):
    kind = "array<struct<character_start:int,n:int>>"
    df = spark.createDataFrame([([(5, 1), (3, 2), (5, 3), (3, 4)],)], "s " + kind)
    assert [x.n for x in df.select(sorted_spans(F.col("s")).alias("o")).first().o] == [2, 4, 1, 3]


def test_detectors_overlap_in_their_order(spark):
    df = spark.createDataFrame([("n 123456789 x",)], "text string")
    policy = {"identifiers": {k: {} for k in ("zipCode", "ssn", "driversLicense", "bankRoutingNumber")}}
    row = Engine(policy).redact(df).first()
    assert [s.filter_type for s in row.spans] == ["bank-routing-number", "drivers-license-number", "ssn", "zip-code"]
    assert row.filtered_text == "n {{{REDACTED-bank-routing-number}}}{{{REDACTED-drivers-license-number}}}{{{REDACTED-ssn}}}{{{REDACTED-zip-code}}} x"
    assert Engine(policy, overlap="drop").redact(df).first().filtered_text == "n {{{REDACTED-bank-routing-number}}} x"


def test_rejected_matches_still_hide_what_they_contain(spark):
    # The Luhn test fails after the longer match has hidden the shorter one.
    df = spark.createDataFrame([("4111111111111112",)], "text string")
    assert Engine({"identifiers": {"creditCard": {"onlyValidCreditCardNumbers": True}}}).explain(df).first().spans == []


def test_plan_has_no_shuffle_and_searches_once(spark):
    df = spark.createDataFrame([("x",)], "text string")
    out = Engine({"identifiers": {k.key: {} for k in KINDS}}).redact(df)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan
    assert plan.count("[13][a-km-zA-HJ-NP-Z1-9]{25,34}") <= 4  # both constructions of one search


def test_many_matches_of_several_lists(spark):
    rng = random.Random(5)

    def disjoint(longest):
        out, at = [], 0
        while at < 2000:
            n = rng.randint(1, longest)
            out.append((at, at + n, "x", 1.0))
            at += n + rng.randint(0, 4)
        return out

    rows = [tuple(disjoint(n) for n in sizes) for sizes in ((3, 40, 9), (300, 2, 7), (8, 8, 8))] + [([], [(0, 4, "x", 1.0)], [])]
    got = spark.createDataFrame(rows, f"a {MATCH}, b {MATCH}, c {MATCH}").select(F.expr(drop_contained_sql(["a", "b", "c"])).alias("o")).collect()
    for lists, row in zip(rows, got, strict=True):
        kept = []
        for m in (m for ms in lists for m in ms):
            if not any(k[0] <= m[0] and m[1] <= k[1] for k in kept):
                kept.append(m)
        assert [tuple(x) for x in row.o] == kept


def test_a_long_text_takes_linear_time(spark):
    engine = Engine({"identifiers": {"zipCode": {}, "ipAddress": {}, "emailAddress": {}}})

    def seconds(n):
        text = " ".join(f"{10000 + i % 80000} 10.0.{i % 200}.7" for i in range(n // 2))
        df = spark.createDataFrame([(text,)], "text string")
        began = time.time()
        row = engine.redact(df).select(F.size("spans").alias("n"), F.length("filtered_text").alias("chars")).first()
        assert row.n >= n and row.chars > len(text)
        return time.time() - began

    seconds(100)
    assert seconds(100_000) < 30
