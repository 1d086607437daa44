import re

import pytest
from pyspark.sql import functions as F

from sablework.functions.random_values import random_value
from sablework.functions.replacements import replacement, shift_date
from sablework.plans.engine import Engine
from sablework.plans.policy import Strategy

FORMATS = {
    "ssn": r"\d{3}-\d{2}-\d{4}", "email-address": r"[a-z]{4,8}\d{1,4}@(example\.com|test\.org|sample\.net)", "phone-number": r"\(555\) \d{3}-\d{4}",
    "credit-card": r"4\d{3}-\d{4}-\d{4}-\d{4}", "ip-address": r"192\.168\.\d{1,3}\.\d{1,3}", "date": r"\d{2}/\d{2}/19\d{2}", "zip-code": r"\d{5}",
    "mac-address": r"02(:[0-9a-f]{2}){5}", "vin": r"[A-HJ-NPR-Z0-9]{17}", "bank-routing-number": r"\d{9}", "bitcoin-address": r"1[1-9A-HJ-NP-Za-km-z]{25,32}",
    "age": r"\d{1,2} years old", "url": r"https://example\.com/(page|article|post|item|doc)\d+", "iban-code": r"GB\d{2}[A-Z]{4}\d{14}",
    "passport-number": r"[A-Z]\d{8}", "drivers-license-number": r"[A-Z]\d{7}", "tracking-number": r"1Z\d{9}", "phone-number-extension": r"\(555\) \d{3}-\d{4}",
    "custom-dictionary": r"\{\{\{REDACTED-custom-dictionary\}\}\}",
}


def luhn(number):
    digits = [int(c) for c in re.sub(r"\D", "", number)][::-1]
    return sum(d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d) for i, d in enumerate(digits)) % 10 == 0


def test_random_values(spark):
    df = spark.range(300).select(F.concat(F.lit("value"), "id").alias("t"), F.lit("ctx").alias("c"))
    out = df.select("t", *[random_value(k, F.col("t"), F.col("c")).alias(k) for k in FORMATS]).collect()
    again = df.select("t", *[random_value(k, F.col("t"), F.col("c")).alias(k) for k in FORMATS]).collect()
    other = df.select("t", *[random_value(k, F.col("t"), F.lit("other")).alias(k) for k in FORMATS]).collect()
    assert out == again and out != other
    for row in out:
        for k, shape in FORMATS.items():
            assert re.fullmatch(shape, row[k]), (k, row[k])
        assert luhn(row["credit-card"])
        assert row["ssn"][:3] not in ("000", "666") and row["ssn"][0] != "9"
    assert len({r["ssn"] for r in out}) > 290


DATES = [
    ("January 31, 2024", (0, 1, 0), "March 2, 2024"), ("Jan 31, 2023", (0, 1, 0), "Mar 3, 2023"), ("JANUARY 15 2020", (1, 0, 0), "January 16 2020"),
    ("may 5, 2020", (1, 0, 0), "May 6, 2020"), ("15 January 2020", (0, 0, 1), "15 January 2021"), ("15 jan 2020", (0, 0, 1), "15 Jan 2021"),
    ("2020-02-29", (0, 0, 1), "2021-03-01"), ("01/31/2020", (1, 0, 0), "02/01/2020"), ("01.31.2020", (-31, 0, 0), "12.31.2019"), ("01-31-2020", (0, -1, 0), "12-31-2019"),
    ("1/5/2020", (1, 0, 0), "1/5/2020"), ("02/30/2020", (1, 0, 0), "02/30/2020"), ("01/05-2020", (1, 0, 0), "01/05-2020"), ("January 15,  2020", (1, 0, 0), "January 16, 2020"),
    ("2020-01-15", (0, 0, 0), "2020-01-15"), ("not a date", (1, 1, 1), "not a date"),
]


def test_shift_date(spark):
    for shift in {s for _, s, _ in DATES}:
        rows = [(t, w) for t, s, w in DATES if s == shift]
        got = spark.createDataFrame(rows, "t string, w string").select("w", shift_date(F.col("t"), *shift).alias("o")).collect()
        assert [r.o for r in got] == [r.w for r in got]


CASES = [
    (None, "ssn", "{{{REDACTED-ssn}}}"), (Strategy(), "ssn", "{{{REDACTED-ssn}}}"), (Strategy("REDACT", format="[%t: %v]"), "ssn", "[ssn: tök]"),
    (Strategy("STATIC_REPLACE", static="S"), "ssn", "S"), (Strategy("MASK"), "ssn", "****"), (Strategy("MASK", mask="ab"), "ssn", "abababab"),
    (Strategy("LAST_4", format="<%t%v>"), "ssn", "<ssn%v>"), (Strategy("HASH_SHA256_REPLACE"), "ssn", "{{{REDACTED-ssn}}}"), (Strategy("CRYPTO_REPLACE"), "ssn", "{{{REDACTED-ssn}}}"),
    (Strategy("SHIFT_DATE", days=1), "ssn", "{{{REDACTED-ssn}}}"), (Strategy("nonsense"), "ssn", "{{{REDACTED-ssn}}}"),
]


def test_strategies(spark):
    row = spark.range(1).select(*[replacement(s, t, F.lit("tök"), F.lit("c")).alias(f"c{i}") for i, (s, t, _) in enumerate(CASES)]).first()
    assert list(row) == [w for *_, w in CASES]


def test_only_the_first_strategy_counts(spark):
    df = spark.createDataFrame([("123-45-6789",)], "text string")
    policy = {"identifiers": {"ssn": {"ssnFilterStrategies": [{"strategy": "STATIC_REPLACE", "staticReplacement": "A"}, {"strategy": "MASK"}]}}}
    assert Engine(policy).redact(df).first().filtered_text == "A"


@pytest.mark.parametrize("ignored", [{"ignored": ["45 YEARS OLD"]}, {"ignoredPatterns": [{"pattern": "^45.*$"}]}])
def test_ignored(spark, ignored):
    df = spark.createDataFrame([("He is 45 years old.",)], "text string")
    row = Engine({"identifiers": {"age": ignored}}).redact(df).first()
    assert row.spans[0].ignored and not row.spans[0].applied and row.filtered_text == row.text
