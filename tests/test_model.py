import os

from sablework.operators import model
from sablework.operators.model import Entity, predict_all
from sablework.plans.engine import Engine


class Numbers:
    """Finds digits, at most ``span_limit`` a call."""

    def __init__(self, span_limit=None):
        self.span_limit, self.calls = span_limit, 0

    def predict(self, text, labels, threshold):
        self.calls += 1
        found = [Entity(len(text[:i].encode()), len(text[:i].encode()) + 1, labels[0], 0.9, c) for i, c in enumerate(text) if c.isdigit()]
        return found[: self.span_limit] if self.span_limit else found


def test_a_full_buffer_loses_nothing():
    text = "é1 2 33 4  5 6é 7 89 " * 40
    want = predict_all(Numbers(), text, ["n"], 0.5)
    for limit in (3, 10, 100):
        client = Numbers(limit)
        assert predict_all(client, text, ["n"], 0.5) == want and client.calls > 400 / limit
    exact = Numbers(len(want) + 1)
    assert predict_all(exact, text, ["n"], 0.5) == want and exact.calls == 1
    # No place to cut at: what the buffer holds is all there is.
    assert len(predict_all(Numbers(4), "1" * 50, ["n"], 0.5)) == 4 and predict_all(Numbers(4), "", ["n"], 0.5) == []
    assert len(predict_all(Numbers(4), " 1111 ", ["n"], 0.5)) == 4
    assert model.SPAN_LIMIT == 1024


def test_a_model_is_loaded_once_per_process(spark, tmp_path):
    class Counted:
        def load(self):
            with open(f"{folder}/{os.getpid()}-{len(os.listdir(folder))}", "w"):
                pass

        def predict(self, text, labels, threshold):
            return [Entity(0, 1, labels[0], 0.9, text[:1])]

    folder = str(tmp_path)
    engine = Engine({"identifiers": {"pheye": [{}]}}, models=[Counted()])
    df = spark.createDataFrame([(f"text {i}",) for i in range(64)], "text string").repartition(16)
    for _ in range(3):
        assert all(len(r.spans) == 1 for r in engine.explain(df).collect())
    loads = [name.split("-")[0] for name in os.listdir(folder)]
    # 48 tasks, but a load for each worker process only.
    assert len(loads) == len(set(loads)) <= 16
