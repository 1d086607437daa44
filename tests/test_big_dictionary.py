import random
import time
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from sablework.functions.runs import ascii_word, cut, letters
from sablework.operators import big_dictionary as big
from sablework.operators import detectors
from sablework.plans.engine import Engine
from sablework.plans.policy import Block, PolicyError


def engine(words, spark, list_bytes=big.LIST_BYTES, **options):
    """An engine whose dictionary takes the way of large lists."""
    out = Engine({"identifiers": {}})
    block = Block("dictionaries", options={"terms": words} | options)
    out.detectors = [big.LargeDictionaryDetector(block, big.word_table(spark, block), list_bytes)]
    return out


def random_text(rng, n):
    pieces = "a b ab ba aba bab c++ ä äb σς . , - ' _".split() + [" "] * 6
    return "".join(rng.choice(pieces) for _ in range(n))


@pytest.mark.parametrize("case_sensitive, fuzzy", [(False, ""), (True, ""), (False, "low"), (True, "medium"), (False, "high")])
def test_equals_the_patterns_of_small_lists(spark, case_sensitive, fuzzy):
    rng = random.Random(5)
    texts = [random_text(rng, rng.randint(0, 60)) for _ in range(150)] + [None, "", "a", "Äb A B", "a b a b a b a"]
    terms = sorted({random_text(rng, rng.randint(1, 7)).strip() for _ in range(80)} - {""})
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string").repartition(3)
    options = {"caseSensitive": case_sensitive, "fuzzy": fuzzy}
    small = Engine({"identifiers": {"dictionaries": [{"terms": terms} | options]}})
    assert isinstance(small.detectors[0], detectors.DictionaryDetector)
    want = {r.id: r.spans for r in small.explain(df).collect()}
    for limit in (big.LIST_BYTES, 0):
        out = engine(terms, spark, limit, **options).explain(df)
        assert out.columns == ["id", "text", "spans"]
        assert {r.id: r.spans for r in out.collect()} == want


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


@pytest.mark.parametrize("most", [1, 2, 3])
def test_near_tokens_equal_brute_force(spark, most):
    rng = random.Random(most)
    word = lambda n: "".join(rng.choice("abcé") for _ in range(n))
    words = [word(rng.randint(1, 20)) for _ in range(250)] + ["Two words", "x" * 40]

    def changed(w):
        for _ in range(rng.randint(0, 5)):
            i, kind = rng.randrange(len(w) + 1), rng.randrange(3)
            w = w[:i] + (rng.choice("abcé") if kind else "") + w[i + (kind < 2) :]
        return w

    tokens = sorted({changed(rng.choice(words)) for _ in range(600)} | {word(rng.randint(1, 13)) for _ in range(100)} | {"", "TWO WORDZ"})
    got = big.near_tokens(spark.createDataFrame([(t,) for t in tokens], "token string"), spark.createDataFrame([(w,) for w in words], "word string"), most)
    distance = {t: [edits(t.lower(), w.lower()) for w in words] for t in tokens}
    want = {t for t in tokens if 0 < min(distance[t]) <= most}
    assert {r.token for r in got.collect()} == want and len(want) > 100


def test_first_spelling_wins(spark, tmp_path):
    one, two = tmp_path / "one.txt", tmp_path / "two.txt"
    one.write_text("  pear\t\nAPPLE\r\n\nplum \n")
    two.write_text("PLUM\nbanana\n" + "".join(f"w{i}\n" for i in range(300)) + "Banana\n")
    block = Block("dictionaries", options={"terms": ["apple", " "], "files": [str(one), str(two)], "caseSensitive": True})
    words = [r.word for r in big.word_table(spark, block).orderBy("place").collect()]
    assert words == ["apple", "pear", "plum", "banana", *[f"w{i}" for i in range(300)]]
    policy = {"identifiers": {"dictionaries": [{"files": [str(one), str(two)], "caseSensitive": True}]}}
    df = spark.createDataFrame([("apple APPLE plum PLUM banana Banana w7",)], "text string")
    large = Engine(policy)
    assert isinstance(large.detectors[0], big.LargeDictionaryDetector)
    assert [s.text for s in large.explain(df).first().spans] == ["APPLE", "plum", "banana", "w7"]
    policy["identifiers"]["dictionaries"][0]["files"].pop()
    assert isinstance(Engine(policy).detectors[0], detectors.DictionaryDetector)
    with pytest.raises(PolicyError):
        Engine({"identifiers": {"dictionaries": [{"files": ["/no/such/file"]}]}})


def test_words_of_many_partitions_keep_their_order(spark):
    words = [f"{'W' if i % 2 else 'w'}{i % 500}" for i in range(3000)]
    table = spark.createDataFrame(list(enumerate(words)), "position int, word string").repartition(7)
    out = big.word_table(spark, Block("dictionaries", options={"files": ["t"]}), {"t": table})
    assert [r.word for r in out.orderBy("place").collect()] == words[:500]
    assert {r.key: r.word for r in big.distinct_words(table, "word", True).collect()} == {w: w for w in words[:500]}
    # Without positions, files have an order of their own.
    path = f"{big.scratch_dir(spark)}/list"
    spark.createDataFrame([("banana",), ("Banana",), ("Apple",), ("apple",)], "word string").coalesce(1).write.parquet(path)
    assert sorted(r.word for r in big.distinct_words(spark.read.parquet(path)).collect()) == ["Apple", "banana"]


def big_found(texts, rows, found):
    """The lists of ``found`` in the order of the rows."""
    by = dict(zip(texts, found, strict=True))
    return [by[r.text] for r in rows]


def test_hundred_thousand_terms(spark):
    rng = random.Random(1)
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6))) for _ in range(3000)]
    terms = list({" ".join(rng.choice(vocabulary) for _ in range(1 + i % 5)) for i in range(100_000)})
    began = time.time()
    index = big.TermIndex(terms, False)
    assert time.time() - began < 30
    texts = [" ".join(rng.choice(terms) for _ in range(2000)) for _ in range(5)]
    found = big.exact_matches(pa.array(texts), index).to_pylist()
    keys = {t: i for i, t in enumerate(terms)}
    for text, spans in zip(texts, found, strict=True):
        assert all(text[s["start"] : s["end"]] == s["token"] and s["token"] in keys for s in spans)
        order = [keys[s["token"]] for s in spans]
        assert order == sorted(order) and len(spans) >= 2000
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    policy = {"identifiers": {"dictionaries": [{"terms": terms, "dictionaryFilterStrategies": [{"strategy": "MASK"}]}]}}
    rows = Engine(policy).explain(df).collect()
    assert [[(s.character_start, s.replacement) for s in r.spans] for r in rows] == [
        [(s["start"], "*" * len(s["token"])) for s in sorted(spans, key=lambda s: s["start"])] for spans in big_found(texts, rows, found)
    ]


def test_long_texts_take_linear_time():
    index = big.TermIndex(["na na", "na", "b c", "na na na na"], False)
    began = time.process_time()
    spans = big.exact_matches(pa.array(["na " * 300_000, "na na"]), index).to_pylist()
    # A longer term that is later in the list contains those before it, and stays.
    assert len(spans[0]) == 225_000 and spans[1][0]["token"] == "na na" and time.process_time() - began < 30


def test_streams(spark, tmp_path):
    spark.createDataFrame([(1, "an apple and two pears"), (2, None)], "id int, text string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id int, text string").parquet(str(tmp_path / "in"))
    out = engine(["apple", "two pears"], spark).redact(stream)
    query = out.writeStream.format("memory").queryName("redacted").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    query.awaitTermination()
    assert {r.id: r.filtered_text for r in spark.table("redacted").collect()} == {1: "an {{{REDACTED-custom-dictionary}}} and {{{REDACTED-custom-dictionary}}}", 2: None}
    for options, limit in (({"fuzzy": "low"}, big.LIST_BYTES), ({}, 0)):
        with pytest.raises(ValueError):
            engine(["apple"], spark, limit, **options).explain(stream)


def test_beside_other_detectors(spark):
    df = spark.createDataFrame([("mail bob@x.org or Bob Stone, 78-05-1120", "k", 1)], "text string, context string, __m0 int")
    policy = {"identifiers": {"emailAddress": {}, "dictionaries": [{"files": ["names"], "fuzzy": "low"}]}}
    names = spark.createDataFrame([(i, w) for i, w in enumerate(["Bob Stone", "bob", *[f"name{i}" for i in range(300)]])], "position int, word string")
    for limit in (big.LIST_BYTES, 0):
        both = Engine(policy, word_lists={"names": names})
        both.detectors[-1].list_bytes, both.detectors[-1].travels = limit, limit > 0
        row = both.redact(df, context="context").first()
        assert [(s.filter_type, s.text) for s in row.spans] == [("email-address", "bob@x.org"), ("custom-dictionary", "bob"), ("custom-dictionary", "Bob Stone")]
        assert row["__m0"] == 1 and row.spans[0].context == "k"


def test_cut():
    texts = pa.array(["ab, éc\U0001f600d", None, "", "x", " "])
    runs = cut(texts, ascii_word())
    assert runs.texts.to_pylist() == ["ab", ", é", "c", "\U0001f600", "d", "x", " "]
    assert runs.row.tolist() == [0, 0, 0, 0, 0, 3, 4] and runs.member.tolist() == [True, False, True, False, True, True, False]
    assert cut(texts.slice(3), ascii_word()).texts.to_pylist() == ["x", " "]
    assert cut(texts, letters()).texts.to_pylist() == ["ab", ", ", "éc", "\U0001f600", "d", "x", " "]
    assert len(cut(pa.array([], pa.string()), letters()).lo) == 0
    assert big.exact_matches(texts, big.TermIndex([], False)).to_pylist() == [[], [], [], [], []]


def test_settled():
    lo, hi = np.array([0, 4, 2, 0, 8]), np.array([6, 10, 4, 6, 9])
    term, row = np.array([1, 1, 2, 0, 0]), np.array([0, 0, 0, 0, 0])
    assert [(int(lo[i]), int(hi[i]), int(term[i])) for i in big.settled(lo, hi, term, row)] == [(0, 6, 0), (8, 9, 0)]


def test_folding(spark):
    assert big.fold("ÄẞΣς") == "äßσσ" and big.fold("ABC") == "abc" and big.fold("İ") == "İ"
    out = engine(["x ς y"], spark).explain(spark.createDataFrame([("X Σ Y",)], "text string")).first().spans
    assert [s.text for s in out] == ["X Σ Y"]


def test_memory_does_not_follow_the_batch():
    rng = random.Random(3)
    texts = pa.array([" ".join(rng.choice(["alpha", "beta", "gamma", "a b"]) for _ in range(2000)) for _ in range(1000)])
    index = big.TermIndex(["alpha beta", "gamma", "a"], False)
    tracemalloc.start()
    found = big.exact_matches(texts, index)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    # 10 MB of text: the arrays of one slice at a time.
    assert len(found) == len(texts) and len(found.flatten()) > 900_000 and peak < 250 << 20


@pytest.mark.parametrize("fuzzy, case_sensitive", [("", False), ("", True), ("medium", False)])
def test_lists_that_stay_tables(spark, monkeypatch, fuzzy, case_sensitive):
    """Many groups of texts and many filters, and a letter whose folded form is a word character while it is none."""
    rng = random.Random(8)
    texts = [random_text(rng, rng.randint(0, 200)) for _ in range(120)] + [None, "", "ſa Sa", "a\x00b ab", "é é"]
    terms = sorted({random_text(rng, rng.randint(1, 9)).strip() for _ in range(400)} - {""}) + ["ſa", "AB ba"]
    df = spark.createDataFrame([(i, t, [i], {"k": t}) for i, t in enumerate(texts)], "id int, text string, more array<int>, map map<string,string>").repartition(3)
    want = {r.id: r for r in engine(terms, spark, fuzzy=fuzzy, caseSensitive=case_sensitive).explain(df).collect()}
    monkeypatch.setattr(big, "GROUP_BYTES", 700)
    monkeypatch.setattr(big, "FILTER_BYTES", 300)
    got = engine(terms, spark, 0, fuzzy=fuzzy, caseSensitive=case_sensitive).explain(df)
    assert {r.id: r for r in got.collect()} == want and sum(len(r.spans) for r in want.values()) > 500
    assert big.group_starts(spark.range(1000).selectExpr("id", "repeat('x', 70) as text").coalesce(1), "id", "text").tolist() == [0, *range(9, 1000, 10)]


def test_the_driver_holds_a_list_as_one_array(spark):
    words = spark.range(200_000).selectExpr("substring(sha2(string(id), 256), 1, 12) as word", "id as place")
    detector = big.LargeDictionaryDetector(Block("dictionaries"), words)
    df = spark.createDataFrame([("x 5feceb66ffc8 y",)], "text string")
    tracemalloc.start()
    found = detector.attach(df, "text", "m")
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    # 2.4 MB of words; a row for each takes a multiple of what their tree does.
    assert detector.travels and peak < 75 << 20
    assert [m.token for m in found.first().m] == ["5feceb66ffc8"]


def test_few_candidates_enter_the_join(spark):
    """Of texts with a million stretches that have the shape of some term, only those that may be terms, once a group."""
    rng = random.Random(2)
    words = ["".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(2000)]
    terms = [" ".join(rng.choice(words) for _ in range(1 + i % 9)) for i in range(2000)]
    texts = [" ".join(rng.choice(words) for _ in range(1000)) for _ in range(100)]
    out = engine(terms, spark, 0)
    rows = spark.createDataFrame(list(enumerate(texts)), "row long, text string").coalesce(1)
    lists = out.detectors[0].words.selectExpr("false as near", "word", "place")
    (one,) = out.detectors[0]._filters(lists)
    asked = [r.key for r in out.detectors[0]._candidates(rows, one, big.group_starts(rows, "row", "text")).collect()]
    present = {t.lower() for t in terms if any(f" {t.lower()} " in f" {x} " for x in texts)}
    assert present <= set(asked) and len(asked) == len(set(asked)) < len(present) + 10_000


def test_near_tokens_reach_the_driver_as_one_array(spark):
    detector = big.LargeDictionaryDetector(Block("dictionaries", options={"fuzzy": "medium"}), spark.createDataFrame([("a", 0)], "word string, place bigint"))
    near = spark.range(300_000).selectExpr("substring(sha2(string(id), 256), 1, 12) as token")
    tracemalloc.start()
    held = detector._held(near, "token")
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(held) == 300_000 and held.type == pa.string() and peak < 30 << 20
