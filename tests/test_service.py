import pytest

from sablework.plans.service import RedactionService
from sablework.sources.stores import NotFound

COLUMNS = "text string, context string, policy string, document_id string, file_name string"


def test_one_call_keeps_everything(spark, tmp_path):
    service = RedactionService(spark, str(tmp_path))
    service.policies.create("ids", {"identifiers": {"ssn": {"ssnFilterStrategies": [{"strategy": "STATIC_REPLACE", "staticReplacement": "X"}]}}})
    service.policies.create("words", {"identifiers": {"dictionaries": [{"terms": ["secret"]}]}})
    rows = [("a 123-45-6789, 321-45-6789", "k", "ids", "d1", "f"), ("a secret", "", "words", "d2", None), ("x", "k", "none", "d3", None), ("123-45-6789", "k", "ids", "d1", "g")]
    requests = spark.createDataFrame(rows, COLUMNS)
    first = service.redact(requests)
    assert first.columns == [*requests.columns, "error", "spans", "filtered_text"]
    assert sorted((r.document_id, r.filtered_text or r.error) for r in first.collect()) == [("d1", "X"), ("d1", "a X, X"), ("d2", "a {{{REDACTED-custom-dictionary}}}"), ("d3", "no policy none")]
    assert service.contexts.get("k", "123-45-6789") == "X" and service.contexts.count("k") == 2 and service.entries().count() == 0
    recorded = requests.selectExpr("*", "document_id = 'd1' as ledger")
    for n in (1, 2):
        service.redact(recorded)
        assert [r["index"] for r in service.history("d1").collect()] == list(range(3 * n)) and service.verify("d1")
    assert service.history("d2").count() == 0
    with pytest.raises(NotFound):
        service.verify("d2")
    service.explain(requests).collect()
    row = service.metrics().first()
    assert (row.documents, row.redactions_total, row.contexts, row.healthy) == (16, 16, 1, 1)
    assert service.explain(requests).columns == [*requests.columns, "error", "spans"]
