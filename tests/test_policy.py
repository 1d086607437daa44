import pytest

from sablework.plans.engine import Engine, redact, redact_requests
from sablework.plans.policy import Policy, PolicyError, Strategy, is_valid_json, is_valid_yaml, parse_policy, parse_policy_yaml, valid_policies


def test_fields_and_defaults():
    p = parse_policy(
        '{"identifiers": {"age": {"enabled": null, "ignored": ["x"], "ignoredPatterns": [{"pattern": "a", "caseSensitive": true}],'
        ' "ageFilterStrategies": [{"strategy": "MASK", "maskCharacter": "#"}, {"strategy": "REDACT"}], "nonsense": 1}, "currency": {}}, "crypto": {"key": "k"}}'
    )
    age = p.blocks["age"]
    assert age.enabled and age.ignored == ("x",) and age.ignored_patterns[0].case_sensitive
    assert age.strategy == Strategy("MASK", mask="#")
    assert "currency" in p.blocks and p.models == () == p.dictionaries
    assert parse_policy({}) == Policy()


def test_shift_fields():
    s = parse_policy({"identifiers": {"date": {"dateFilterStrategies": [{"strategy": "SHIFT_DATE", "shiftDays": -1, "shiftMonths": 2, "shiftYears": 3}]}}}).blocks["date"].strategy
    assert (s.days, s.months, s.years) == (-1, 2, 3)


@pytest.mark.parametrize(
    "bad", ["{", "[]", '{"identifiers": []}', '{"identifiers": {"ssn": {"enabled": "yes"}}}', '{"identifiers": {"ssn": {"ignored": [1]}}}', '{"identifiers": {"dictionaries": {}}}']
)
def test_wrong_json(bad):
    assert not is_valid_json(bad)
    with pytest.raises(PolicyError):
        parse_policy(bad)


def test_yaml():
    pytest.importorskip("yaml")
    text = "identifiers:\n  ssn: {}\n  dictionaries:\n    - terms: [a, b]\n"
    assert parse_policy_yaml(text) == parse_policy({"identifiers": {"ssn": {}, "dictionaries": [{"terms": ["a", "b"]}]}})
    assert is_valid_yaml(text) and not is_valid_yaml("a: [") and is_valid_json("{}")


def test_one_shot_redaction(spark):
    df = spark.createDataFrame([("His SSN is 123-45-6789.",)], "text string")
    assert redact(df, '{"identifiers": {"ssn": {}}}').first().filtered_text == "His SSN is {{{REDACTED-ssn}}}."
    pytest.importorskip("yaml")
    row = redact(df, policy_yaml="identifiers: {ssn: {}}").first()
    assert row.filtered_text == "His SSN is {{{REDACTED-ssn}}}." and (row.spans[0].character_start, row.spans[0].character_end) == (11, 22)
    with pytest.raises(ValueError):
        Engine({}, overlap="merge")


def test_requests(spark):
    rows = [("SSN 123-45-6789", "c", "ids", "d1", "f"), ("", "c", "ids", "d2", "f"), ("x", "c", "nope", "", "f"), ("x", "c", None, None, None)]
    df = spark.createDataFrame(rows, "text string, context string, policy string, document_id string, file_name string")
    out = {(r.policy, r.text): r for r in redact_requests(df, {"ids": {"identifiers": {"ssn": {}}}}).collect()}
    assert out["ids", "SSN 123-45-6789"].filtered_text == "SSN {{{REDACTED-ssn}}}" and out["ids", "SSN 123-45-6789"].error is None
    assert out["ids", ""].error == "text is required" and out["nope", "x"].error == "no policy nope" and out[None, "x"].error == "policy is required"
    assert len(out["nope", "x"].document_id) == 36


def test_validation_of_a_column(spark):
    df = spark.createDataFrame([("{}",), ("{",), (None,), ("",), ("{}",)], "p string")
    assert [r.v for r in df.select(valid_policies("p").alias("v")).collect()] == [True, False, False, False, True]
