"""Detectors on inputs with known matches, all in one job per detector."""

from collections import defaultdict

import pytest

from sablework.operators.patterns import FILTER_TYPES, KINDS
from sablework.plans.engine import Engine

# policy key, options, input, matches
CASES = [
    ("age", {}, "The patient is 45 years old.", ["45 years old"]),
    ("age", {}, "The patient is aged 30.", ["aged 30"]),
    ("age", {}, "The patient is 61 y/o.", ["61 y/o"]),
    ("age", {}, "The patient is 25yo.", ["25yo"]),
    ("age", {}, "A 50-year-old patient.", ["50-year-old"]),
    ("age", {}, "The child is 1.5 years old.", ["1.5 years old"]),
    ("age", {}, "There are 100 cars in the lot.", []),
    ("bankRoutingNumber", {}, "My routing number is 011000015.", ["011000015"]),
    ("bankRoutingNumber", {}, "01100001 0110000151", []),
    ("bitcoinAddress", {}, "1A1zP1eP5QGefi2DMPTfTL5SLmv7DivfNa", ["1A1zP1eP5QGefi2DMPTfTL5SLmv7DivfNa"]),
    ("bitcoinAddress", {}, "bc1qar0srrr7xfkvy5l643lydnw9re59gtzzwf5mdq", ["bc1qar0srrr7xfkvy5l643lydnw9re59gtzzwf5mdq"]),
    ("bitcoinAddress", {}, "1234567890", []),
    ("creditCard", {"onlyValidCreditCardNumbers": True}, "4111111111111111 4111111111111112", ["4111111111111111"]),
    ("creditCard", {}, "4111111111111112 5105105105105100 378282246310005", ["4111111111111112", "5105105105105100", "378282246310005"]),
    ("creditCard", {"onlyValidCreditCardNumbers": True}, "30569309025904 6011111111111117 3530111333300000", ["30569309025904", "6011111111111117", "3530111333300000"]),
    ("date", {}, "January 15, 2020; Jan 15, 2020; 01/15/2020; 01-15-2020; 01.15.2020; 2020-01-15; 15 January 2020",
     ["January 15, 2020", "Jan 15, 2020", "01/15/2020", "01-15-2020", "01.15.2020", "2020-01-15", "15 January 2020"]),
    ("date", {}, "In 2024 it happened.", []),
    ("driversLicense", {}, "S1234567 12345678 AB123456 123456", ["S1234567", "12345678", "AB123456"]),
    ("emailAddress", {}, "test@example.com, test+alias@example.com", ["test@example.com", "test+alias@example.com"]),
    ("emailAddress", {}, "Contact me @example.com", []),
    ("ibanCode", {}, "DE89370400440532013000 GB29NWBK60161331926819", ["DE89370400440532013000", "GB29NWBK60161331926819"]),
    ("ipAddress", {}, "127.0.0.1 and 8.8.8.8", ["127.0.0.1", "8.8.8.8"]),
    ("ipAddress", {}, "2001:0db8:85a3:0000:0000:8a2e:0370:7334", ["2001:0db8:85a3:0000:0000:8a2e:0370:7334"]),
    ("ipAddress", {}, "2001:db8:85a3::8a2e:370:7334", ["::8a2e:370:7334"]),
    ("ipAddress", {}, "Version 1.2.3.4.5", ["1.2.3.4"]),
    ("macAddress", {}, "00:1A:2B:3C:4D:5E 00-1A-2B-3C-4D-5E 001A.2B3C.4D5E 00:1A:2B", ["00:1A:2B:3C:4D:5E", "00-1A-2B-3C-4D-5E", "001A.2B3C.4D5E"]),
    ("passportNumber", {}, "A12345678 A1234567 123456789", ["A12345678"]),
    ("phoneNumber", {}, "555-555-5555 555.555.5555 (555) 555-5555", ["555-555-5555", "555.555.5555", "(555) 555-5555"]),
    ("phoneNumber", {}, "+1-555-555-5555", ["+1-555-555-5555"]),
    ("phoneNumber", {}, "+44 20 7946 0958", ["+44 20 7946 0958"]),
    ("phoneNumber", {}, "555-5555", []),
    ("ssn", {}, "123-45-6789, 123 45 6789, 12-3456789", ["123-45-6789", "123 45 6789", "12-3456789"]),
    ("ssn", {}, "000-45-6789 666-45-6789 900-45-6789", []),
    ("trackingNumber", {}, "1Z12345E0291980793 123456789012 9400100000000000000000 EA12345678US",
     ["1Z12345E0291980793", "123456789012", "9400100000000000000000", "EA12345678US"]),
    ("url", {"requireHttpWwwPrefix": True}, "https://www.example.com\nwww.example.com\nexample.com", ["https://www.example.com", "www.example.com"]),
    ("url", {}, "Visit example.com now", ["example.com"]),
    ("url", {}, "Go to http://localhost:8080/api/test.", []),
    ("vin", {}, "1HGCP2684BR03975A", ["1HGCP2684BR03975A"]),
    ("vin", {}, "1HGCP2684BR03975 1HGCP2684BR03975AB 1HGCP2684BI03975A", []),
    ("zipCode", {"requireDelimiter": True}, "12345 12345-6789 123456789", ["12345", "12345-6789"]),
    ("zipCode", {}, "123456789 12345 6789", ["123456789", "12345"]),
    ("ssn", {}, "é123-45-6789", ["123-45-6789"]),
]


@pytest.fixture(scope="module")
def found(spark):
    out = {}
    groups = defaultdict(list)
    for i, (key, options, text, _) in enumerate(CASES):
        groups[key, tuple(options.items())].append((i, text))
    for (key, options), texts in groups.items():
        engine = Engine({"identifiers": {key: dict(options)}})
        df = spark.createDataFrame(texts, "doc_id int, text string")
        for r in engine.explain(df).collect():
            out[r.doc_id] = r.spans
    return out


@pytest.mark.parametrize("i", range(len(CASES)), ids=[f"{c[0]}-{n}" for n, c in enumerate(CASES)])
def test_matches(found, i):
    key, _, text, expected = CASES[i]
    spans = found[i]
    assert sorted(s.text for s in spans) == sorted(expected)
    raw = text.encode()
    for s in spans:
        assert raw[s.character_start : s.character_end].decode() == s.text
        assert s.filter_type == next(k.filter_type for k in KINDS if k.key == key)


def test_absent_or_disabled_blocks_find_nothing(spark):
    df = spark.createDataFrame([("SSN 123-45-6789, a@b.org",)], "text string")
    for policy in ({}, {"identifiers": {}}, {"identifiers": {"ssn": {"enabled": False}}}, {"identifiers": {"currency": {}, "streetAddress": {}}}):
        row = Engine(policy).redact(df).first()
        assert row.spans == [] and row.filtered_text == row.text


def test_null_and_empty_text(spark):
    df = spark.createDataFrame([(None,), ("",)], "text string")
    rows = Engine({"identifiers": {k.key: {} for k in KINDS}}).redact(df).collect()
    assert [(r.filtered_text, r.spans) for r in rows] == [(None, []), ("", [])]


def test_filter_types_are_all_known():
    assert len(set(FILTER_TYPES)) == len(FILTER_TYPES) == 32
