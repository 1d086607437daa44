import random
import re

import pytest

from sablework.functions.dialect import with_prefixes
from sablework.operators.detectors import RegexDetector
from sablework.operators.patterns import Kind, Pattern
from sablework.plans.engine import Engine
from sablework.plans.policy import Block, PolicyError


def found(spark, texts, *patterns):
    detector = RegexDetector(Kind("user", "user", ()), Block("user"), tuple(Pattern(r, 0.5, "", g) for r, g in patterns))
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    rows = sorted(Engine({}, detectors=[detector]).explain(df).collect(), key=lambda r: r.id)
    return [[(s.character_start, s.character_end, s.text) for s in r.spans] for r in rows]


def by_re(text, regex, group):
    out = []
    for m in re.finditer(regex, text or "", re.ASCII):
        lo, hi = m.span(group)
        if lo >= 0:
            out.append((len(text[:lo].encode()), len(text[:hi].encode()), m[group]))
    return out


@pytest.mark.parametrize("regex, group", [
    (r"\bid: ([a-z]+)", 1), (r"(a|ab)(c|bcd)(d*)", 2), (r"(?:x(y)?)?z", 1), (r"\b(\w)(\w*)\b", 2), (r"(a)|(b)", 2), (r"([(\]])(a)", 2),
    (r"(?P<n>é+)(b?)", 1), (r"a(\(b\))?", 1), (r"(?:b|a(x|(y)a?))z?", 2), (r"^(a)b", 1), (r"b(a)$", 1), (r"a+$|(a)b", 1), (r"[a(]+(b[)\]]?)", 1),
])
def test_equals_a_direct_search(spark, regex, group):
    rng = random.Random(3)
    texts = ["".join(rng.choice(["a", "b", "c", "d", "x", "y", "z", "é", " ", "(", ")", "]", "id: ", "_"]) for _ in range(rng.randint(0, 25))) for _ in range(120)]
    texts += ["", None, "aab", "id: abc", "xyz xz", "abab", "ba", "aaa"]
    got = found(spark, texts, (regex, group))
    for text, spans in zip(texts, got, strict=True):
        # An empty group has no part, as stated.
        want = [s for s in by_re(text, regex, group) if s[2]]
        inside = lambda s: any(t[0] <= s[0] and s[1] <= t[1] for t in want[: want.index(s)])  # noqa: B023, E731
        assert spans == sorted((s for s in want if not inside(s)), key=lambda s: s[0]), (text, regex)


def test_groups_of_several_patterns_contain_each_other(spark):
    texts = ["key=abc123 key=zz", None]
    assert found(spark, texts, (r"key=(\w+)", 1), (r"[a-z]+([0-9]+)", 1), (r"(key)=", 1)) == [[(0, 3, "key"), (4, 10, "abc123"), (11, 14, "key"), (15, 17, "zz")], []]
    # A pattern without such a group keeps its whole matches.
    assert found(spark, ["key=abc"], (r"key=(\w+)", 2)) == [[(0, 7, "key=abc")]]


def test_places_of_groups():
    assert with_prefixes("a(b)c", 1) == ("(a)(b)c", [1], 2) and with_prefixes("a(?:b)c", 1) is None and with_prefixes(r"\([(](b)", 2) is None
    assert with_prefixes("(?i)a(?:p|q(r))", 1) == ("(?i)(a)(?:p|(q)(r))", [1, 2], 3)
    for regex in ("(a)+", "(?:x(y)?)+", "a(?i)b(c)", "(?=(a))a", "(a){2}"):
        with pytest.raises(PolicyError):
            with_prefixes(regex, 1)
