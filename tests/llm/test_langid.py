import math
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from sablework.llm import langid

SF = "/root/testdata/sf0.001"


def greedy_phrases(text, model):
    """Brute force: longest matches in the training text, by substring search."""
    n, i = 0, 0
    while i < len(text):
        j = i + 1
        while j <= len(text) and text[i:j] in model:
            j += 1
        i = max(i + 1, j - 1)
        n += 1
    return n


def test_automaton_parses_into_longest_matches(monkeypatch):
    """Dense and sparse moves alike, and in short lanes, which are joined exactly."""
    rng = np.random.default_rng(0)
    train = rng.integers(0, 4, 500)
    model = "".join(map(str, train))
    texts = [rng.integers(0, 5, n) for n in (1, 2, 50, 700)] + [train[100:400], np.zeros(0, np.int64)]
    starts = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    want = [greedy_phrases("".join(map(str, t)), model) for t in texts]
    for lane in (1024, 64, 7, 1):
        monkeypatch.setattr(langid, "LANE", lane)
        for width in (6, 3, 2):
            auto = langid.Automaton(langid.suffix_automaton(train.tolist()), width, 6)
            assert langid.phrases(np.concatenate(texts), starts, auto).tolist() == want


def test_query_against_brute_force(spark):
    """Every document of the smallest tables, parsed by substring search in the same sample."""
    model = langid.fit(spark.read.parquet(f"{SF}/documents.parquet"), ~langid.held_out())
    picked = {}
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumn("h", F.xxhash64("doc_id", F.xxhash64("text"))).collect()
    for lang in {r.lang for r in docs if r.lang}:
        rows = [r for r in docs if r.lang == lang and r.text is not None and zlib.crc32(str(r.doc_id).encode()) % 3 != 1]
        rows.sort(key=lambda r: r.h)
        room, texts = langid.TRAIN_CHARS // 4, []
        for r in rows[: min(langid.TRAIN_DOCS, langid.TRAIN_ROWS // 4)]:
            if room > 0:
                texts.append(r.text[:room])
            room -= len(r.text)
        picked[lang] = texts
    assert model.langs == sorted(picked)
    plain = lambda t: re.sub(r" +", " ", "".join(c.lower()[0] if c.isalpha() else " " for c in t))
    trained = {lang: "".join(" " + plain(t).lstrip() for t in parts) for lang, parts in picked.items()}
    got = {r.doc_id: r for r in langid.op1_langid(spark, SF).collect()}
    for r in [r for r in docs if r.text][:40]:
        text = plain(r.text).lstrip()[:3000]
        if len(plain(r.text).lstrip()) > 3000:
            continue
        bits = {lang: greedy_phrases(text, t) * math.log2(len(t)) for lang, t in trained.items()}
        best = min(sorted(bits), key=lambda k: round(bits[k], 6))
        assert got[r.doc_id].lang_pred == best and abs(got[r.doc_id].bits - bits[best] / len(text)) < 1e-9


def test_scripts_of_thousands_of_letters():
    rng = np.random.default_rng(1)
    words = {lang: ["".join(chr(base + int(k)) for k in rng.integers(0, 3000, 2)) for _ in range(400)] for lang, base in (("a", 0x4E00), ("b", 0x5A00))}
    text = lambda lang, n: " ".join(words[lang][int(i)] for i in rng.integers(0, 400, n))
    model = langid.Model({lang: [text(lang, 1000)] for lang in words})
    assert len(model.letters) > 1000
    best, _, bits, _ = langid.score_texts(pa.array([text(lang, 100) for lang in "abab"]), model, langid.Alphabet(model.letters))
    assert list(best) == [0, 1, 0, 1] and bits.max() < 8


def test_held_out_accuracy(spark):
    out = langid.op1_langid(spark, SF).collect()
    langs = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert len(out) == len(langs)
    held = [r for r in out if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in out)
    assert sum(r.lang_pred == langs[r.doc_id] for r in held) / len(held) > 0.98
    assert all(0 <= r.score <= 1 for r in out)


def test_edge_cases(edge_docs, no_docs):
    model = langid.fit(edge_docs)
    assert model.langs == ["aa", "bb"]
    rows = langid.identify(edge_docs, model).collect()
    assert len(rows) == edge_docs.count()
    by = {r.doc_id: r for r in rows}
    for i in (62, 63, 64, 69):
        assert (by[i].lang_pred, by[i].score) == ("und", 0)
    assert by[0].lang_pred == "aa" and by[65].lang_pred == by[66].lang_pred == by[67].lang_pred
    assert (by[0].score, by[0].bits) == (by[60].score, by[60].bits)
    assert langid.identify(no_docs, model).count() == 0
    nothing = langid.fit(no_docs)
    assert {(r.lang_pred, r.score) for r in langid.identify(edge_docs, nothing).collect()} == {("und", 0.0)}


def test_long_texts_are_read_piece_by_piece(monkeypatch):
    model = langid.Model({"a": ["the cat sat on the mat " * 40], "b": ["lorem ipsum dolor sit amet " * 40]})
    alphabet = langid.Alphabet(model.letters)
    text = "the cat sat on the mat " * 3000
    whole = langid.score_texts(pa.array([text, "x", text]), model, alphabet)
    monkeypatch.setattr(langid, "CODE_POINTS", 5000)
    pieces = langid.score_texts(pa.array([text, "x", text]), model, alphabet)
    assert list(whole[0]) == list(pieces[0]) and abs(whole[3][0] - pieces[3][0]) < 20 and pieces[2][0] == pieces[2][2]


def test_pipeline_stage_keeps_clean_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    junk = spark.createDataFrame([(10**6, "123 456", "en", "s", 7), (10**6 + 1, None, None, None, None), (10**6 + 2, "zqxj vkwq " * 60, None, "s", 600)], docs.schema)
    kept = langid.keep_known_languages(spark, docs.unionByName(junk), SF)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(r.doc_id for r in docs.collect())


def test_stage_without_any_language_keeps_what_has_letters(spark, edge_docs):
    docs = edge_docs.withColumn("lang", F.lit(None).cast("string"))
    kept = langid.keep_known_languages(spark, docs, "").collect()
    assert len(kept) == sum(any(c.isalpha() for c in r.text or "") for r in docs.collect()) > 0


def test_the_sample_is_bounded_whatever_the_lengths(spark, monkeypatch):
    monkeypatch.setattr(langid, "TRAIN_CHARS", 1000)
    rows = [(i, "ab cd " * 2000, "x") for i in range(20)] + [(100 + i, "ef gh " * 10, "y") for i in range(20)] + [(200 + i, "ab" * 40_000, "z") for i in range(3)]
    seen = {}
    monkeypatch.setattr(langid, "Model", lambda texts: seen.update(texts))
    langid.fit(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"))
    assert {lang: sum(map(len, texts)) for lang, texts in seen.items()} == {"x": 333, "y": 333, "z": 333}
    assert [len(t) for t in seen["y"]] == [60, 60, 60, 60, 60, 33]
