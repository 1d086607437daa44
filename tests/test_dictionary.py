import pytest

from sablework.operators.detectors import collect_words
from sablework.operators.model import Entity, split_labels
from sablework.plans.engine import Engine
from sablework.plans.policy import Block, PolicyError


def spans(spark, text, **options):
    df = spark.createDataFrame([(text,)], "text string")
    return Engine({"identifiers": {"dictionaries": [options]}}).explain(df).first().spans


FRUIT = ["apple", "banana", "Cherry"]


def test_exact(spark):
    assert [(s.character_start, s.character_end) for s in spans(spark, "I like apple and banana.", terms=FRUIT)] == [(7, 12), (17, 23)]
    assert [(s.character_start, s.character_end) for s in spans(spark, "Apple and Banana are fruits.", terms=FRUIT)] == [(0, 5), (10, 16)]
    assert spans(spark, "pineapple and bananarama", terms=FRUIT) == []
    assert spans(spark, "anything", terms=[]) == []
    assert spans(spark, "Apple and banana", terms=["apple", "Banana"], caseSensitive=True) == []
    assert [s.text for s in spans(spark, "c++ a.b axb", terms=["a.b"])] == ["a.b"]


def test_fuzzy(spark):
    found = {s.text: s.confidence for s in spans(spark, "aple applee appl apple orange", terms=["apple"], fuzzy="medium")}
    assert found == {"aple": 0.6, "applee": 0.6, "appl": 0.6, "apple": 1.0}
    assert {s.confidence for s in spans(spark, "aple", terms=["apple"], fuzzy="low")} == {0.8}
    assert {s.confidence for s in spans(spark, "xple", terms=["apple"], fuzzy="high")} == {0.4}
    assert {s.confidence for s in spans(spark, "aple", terms=["apple"], fuzzy="odd")} == {0.8}
    # A token that equals a word is no fuzzy find, even where boundaries (of ASCII words) keep it from being an exact one.
    assert [s.text for s in spans(spark, "Äpple äppl", terms=["äpple"], fuzzy="low")] == ["äppl"]


def test_ignored_and_strategies(spark):
    both = spans(spark, "apple banana", terms=FRUIT, ignored=["Apple"], ignoredPatterns=[{"pattern": "^ban.*$"}])
    assert [s.ignored for s in both] == [True, True]
    for strategy, want in [
        ({}, "{{{REDACTED-custom-dictionary}}}"), ({"strategy": "REDACT", "redactionFormat": "[%t: %v]"}, "[custom-dictionary: apple]"),
        ({"strategy": "STATIC_REPLACE", "staticReplacement": "FRUIT"}, "FRUIT"), ({"strategy": "MASK"}, "*****"),
        ({"strategy": "RANDOM_REPLACE", "redactionFormat": "x"}, "{{{REDACTED-custom-dictionary}}}"),
    ]:
        assert spans(spark, "apple", terms=["apple"], dictionaryFilterStrategies=[strategy])[0].replacement == want


def test_words_from_files(tmp_path):
    path = tmp_path / "words.txt"
    path.write_text(" pear \n\nAPPLE\nplum\n")
    assert collect_words(Block("dictionaries", options={"terms": ["apple", " "], "files": [str(path)]})) == ["apple", "pear", "plum"]
    with pytest.raises(PolicyError):
        collect_words(Block("dictionaries", options={"files": ["/no/such/file"]}))


def test_model(spark):
    # Inside the test, so that it travels to the workers by value.
    class George:
        def load(self):
            pass

        def predict(self, text, labels, threshold):
            at = text.find("George")
            return [Entity(at, at + 17, labels[0], 0.9, "George Washington"), Entity(at, at + 6, labels[0], 0.8, "George")] if at >= 0 else []

    df = spark.createDataFrame([("George Washington was president.",), ("Nobody",), (None,)], "text string")
    policy = {"identifiers": {"pheye": [{"ignored": ["nobody"], "pheyeConfiguration": {"labels": " Person, Place ,"}}]}}
    rows = [r.spans for r in Engine(policy, models=[George()]).explain(df).collect()]
    assert [(s.character_start, s.character_end, s.filter_type, s.confidence) for s in rows[0]] == [(0, 17, "pheye", 0.9)] and rows[1:] == [[], []]
    assert [r.spans for r in Engine(policy).explain(df).collect()] == [[], [], []]
    assert split_labels(" a, ,b ") == ["a", "b"]
