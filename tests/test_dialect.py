"""Translated patterns find on Spark what the originals find in DuckDB, whose engine is of the linear-time dialect."""

import random

import pytest
from pyspark.sql import functions as F

from sablework.functions.dialect import BOUNDARY, quote, to_java
from sablework.functions.spans import find_all
from sablework.operators.patterns import KINDS, STRICT_EMAIL
from sablework.plans.policy import PolicyError

SEEDS = [
    "45 years old", "aged 30", "61 y/o", "011000015", "1A1zP1eP5QGefi2DMPTfTL5SLmv7DivfNa", "4111111111111111", "30569309025904", "6011111111111117",
    "3530111333300000", "January 15, 2020", "01/15/2020", "2020-01-15", "15 Jan 2020", "S1234567", "a.b+c@x-y.org", "GB29NWBK60161331926819", "8.8.8.8",
    "2001:db8::1", "00:1A:2B:3C:4D:5E", "A12345678", "(555) 555-5555", "+44 20 7946 0958", "123-45-6789", "1Z12345E0291980793", "EA12345678US",
    "https://www.example.com/a?b", "example.net:80", "1HGCP2684BR03975A", "12345-6789",
]
GLUE = [" ", "\r", "\x0b", " ", " ", "K", "ſ", "é", "中", "😀", "\n", "_", "-", ".", "", "\x01", "K", "S"]


def texts(n=400):
    rng = random.Random(3)
    out = []
    for _ in range(n):
        s = "".join(rng.choice(GLUE) + rng.choice(SEEDS) for _ in range(rng.randint(1, 4))) + rng.choice(GLUE)
        if rng.random() < 0.5:
            i = rng.randrange(len(s))
            s = s[:i] + rng.choice(GLUE) + s[i + rng.randint(0, 2) :]
        out.append(s)
    return out


def test_same_matches_as_the_original_dialect(spark):
    import duckdb

    rows = list(enumerate(texts()))
    df = spark.createDataFrame(rows, "i int, text string")
    con = duckdb.connect()
    con.execute("CREATE TABLE t (i INT, text VARCHAR)")
    con.executemany("INSERT INTO t VALUES (?, ?)", rows)
    patterns = [p for k in KINDS for p in (*k.patterns, *[x for o in k.options.values() for x in o])] + [STRICT_EMAIL]
    total = 0
    columns = {f"p{n}": find_all("text", to_java(p.regex), p.confidence, p.guard) for n, p in enumerate(patterns)}
    got = {r.i: r for r in df.select("i", *[c.alias(n) for n, c in columns.items()]).collect()}
    for n, p in enumerate(patterns):
        want = dict(con.execute("SELECT i, list_transform(regexp_extract_all(text, ?, 0), lambda x: x) FROM t", [p.regex]).fetchall())
        for i, text in rows:
            matches = got[i][f"p{n}"]
            assert [m.token for m in matches] == want[i], (p.regex, text)
            assert all(text.encode()[m.start : m.end].decode() == m.token for m in matches)
            total += len(matches)
    assert total > 1000


@pytest.mark.parametrize("pattern", ["(", "*a", "(?=a)", "(?<=a)b", "a++", "[a", r"(a)\1", "a)", r"\C", "(?U)a", "[[:nope:]]"])
def test_patterns_without_a_counterpart_are_refused(pattern):
    with pytest.raises(PolicyError):
        to_java(pattern)


def test_user_patterns(spark):
    df = spark.range(1)
    cases = [
        ("^ban.*$", "banana", True), ("(?i)BAN", "banana", True), ("BAN", "banana", False), ("[[:digit:]]{2}", "a12", True),
        ("(?P<x_y>a)b", "ab", True), (r"\s", "a\x0bb", False), (r"a$", "a\n", False), (r"[\s]b", "a b", True), (r"\Qa.b\E", "axb", False), ("[a[]x", "[x", True),
    ]
    row = df.select(*[F.rlike(F.lit(t), F.lit(to_java(p))).alias(f"c{n}") for n, (p, t, _) in enumerate(cases)]).first()
    assert list(row) == [want for *_, want in cases]


def test_quote(spark):
    words = ["a.b", "c++", "x|y", "(z)", "$1", "é中", "a b", "[q]", "^", "\\", "-", "#&~"]
    row = spark.range(1).select(*[F.rlike(F.lit(w), F.lit("^" + quote(w) + r"\z")).alias(f"c{n}") for n, w in enumerate(words)]).first()
    assert all(row)


def test_a_leading_boundary_tells_places_by_the_next_character(spark):
    """What begins a pattern is looked at first, and finds stay those of the general boundary, beside folded letters beyond ASCII too."""
    cases = [r"\b4[0-9]+\b", r"(?i)\bs[a-z]*\b", r"(?i)\b(?:k|1)a?\b", r"\b[0-9.]+a?", r"\b(?:ab|[c-e])?s\b", r"(?i)\b[.s]+", r"\bs?k?1"]
    assert all(to_java(p).split("(?iu)")[-1].removeprefix("(?d)").startswith("(?-iu:(?=[") for p in cases)
    leads = [p.regex for k in KINDS for p in k.patterns if p.regex.removeprefix("(?i)").startswith(r"\b")]
    assert len(leads) > 30 and not any(BOUNDARY == to_java(p).split("(?iu)")[-1].removeprefix("(?d)")[: len(BOUNDARY)] for p in leads)
    other = [r"\ba|s\b", r"\b\W", r"\b[^a]s", r"\bé", r"\b(?:)s", r"\ba*", STRICT_EMAIL.regex]
    general = lambda p: to_java(p.replace(r"\b", r"(?:)\b", 1)) if p.startswith(r"\b") else to_java("(?i)(?:)" + p[4:])
    rng = random.Random(4)
    texts = ["".join(rng.choice("aAsSkK14.. -_écdbſKıİ") for _ in range(rng.randint(0, 25))) for _ in range(3000)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    finds = lambda p, java: F.regexp_extract_all("t", F.lit(f"({java(p)})"), F.lit(1))
    row = df.select(*[F.sum((finds(p, to_java) != finds(p, general)).cast("int")) for p in cases + other], *[F.sum(F.size(finds(p, to_java))) for p in cases]).first()
    assert not any(row[: len(cases + other)]) and all(n > 0 for n in row[len(cases + other) :])


def test_redaction_is_that_of_general_boundaries(spark, monkeypatch):
    from sablework.functions import dialect
    from sablework.plans.engine import Engine

    rng = random.Random(6)
    texts = ["".join(rng.choice(SEEDS) + rng.choice(GLUE) for _ in range(8)) for _ in range(300)]
    df = spark.createDataFrame([(t,) for t in texts], "text string").repartition(4)
    policy = {"identifiers": {k.key: {} for k in KINDS}}
    got = Engine(policy).redact(df).select("text", "filtered_text")
    monkeypatch.setattr(dialect, "_boundary", lambda *a: BOUNDARY)
    general = Engine(policy).redact(df).select("text", "filtered_text")
    assert got.exceptAll(general).isEmpty() and not got.where("text <> filtered_text").isEmpty()
