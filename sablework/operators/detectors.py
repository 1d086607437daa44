"""Detectors: from a text column to an array of spans."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import replace
from typing import Protocol

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sablework.functions.dialect import quote, to_java
from sablework.functions.replacements import replacement
from sablework.functions.spans import NONE, drop_contained, drop_contained_sql, find_all, find_all_sql, let, no_matches, of_group
from sablework.operators.patterns import KINDS, Kind, Pattern
from sablework.plans.policy import Block, Policy, PolicyError


class Detector(Protocol):
    """What a policy block compiles to; any object of this shape may be added to an engine."""

    filter_type: str

    def matches(self, text: str) -> Column:
        """array<struct<start,end,token,confidence>> in the order of discovery; offsets are bytes. ``text`` is an SQL
        expression, mostly a column's quoted name."""

    def spans(self, matches: Column, context: Column) -> Column:
        """The matches as spans with replacements."""


def is_ignored(token: Column, block: Block) -> Column:
    """The token is one of the ignored terms (whatever its case), or an ignored pattern is found in it."""
    test = F.lit(False)
    if block.ignored:
        test = F.lower(token).isin(sorted({t.lower() for t in block.ignored}))
    for p in block.ignored_patterns:
        test = test | F.rlike(token, F.lit(to_java(p.pattern, not p.case_sensitive)))
    return test


def span_structs(matches: Column, filter_type: str, context: Column, ignored: Callable[[Column], Column], instead: Callable[[Column], Column]) -> Column:
    """The matches as spans; ``ignored`` and ``instead`` (the replacement) are of a token."""

    def span(m: Column) -> Column:
        skip = ignored(m["token"])
        return F.struct(
            m["start"].alias("character_start"), m["end"].alias("character_end"), F.lit(filter_type).alias("filter_type"),
            context.alias("context"), m["confidence"].alias("confidence"), m["token"].alias("text"),
            instead(m["token"]).alias("replacement"), skip.alias("ignored"), (~skip).alias("applied"),
        )

    return F.transform(matches, span)


def as_spans(matches: Column, block: Block, filter_type: str, context: Column, kinds: tuple[str, ...] = ()) -> Column:
    instead = lambda t: replacement(block.strategy, filter_type, t, context, kinds)
    return span_structs(matches, filter_type, context, lambda t: is_ignored(t, block), instead)


def passes_luhn(token: Column) -> Column:
    digits = F.transform(F.split(F.reverse(F.regexp_replace(token, "[^0-9]", "")), ""), lambda d: d.cast("int"))
    digits = F.filter(digits, lambda d: d.isNotNull())
    doubled = F.transform(digits, lambda d, i: F.when(i % 2 == 0, d).when(d > 4, 2 * d - 9).otherwise(2 * d))
    return F.aggregate(doubled, F.lit(0), lambda a, d: a + d) % 10 == 0


def names_an_age(token: Column) -> Column:
    low = F.lower(token)
    return F.contains(low, F.lit("age")) | F.contains(low, F.lit("old")) | F.contains(low, F.lit("y/o")) | F.contains(low, F.lit("yo"))


def plausible_ssn(token: Column) -> Column:
    prefix = F.substring(F.regexp_replace(token, "[- ]", ""), 1, 3)
    return F.rlike(token, F.lit("^[0-9]{2}-")) | ~(prefix.isin("000", "666") | F.startswith(prefix, F.lit("9")))


#: Tests that a match must pass after contained matches were dropped (a match that fails has dropped its inner ones).
POST: dict[str, Callable[[Column], Column]] = {"age": names_an_age, "ssn": plausible_ssn}


class RegexDetector:
    def __init__(self, kind: Kind, block: Block, patterns: tuple[Pattern, ...] | None = None) -> None:
        self.block, self.filter_type = block, kind.filter_type
        chosen = next((p for option, p in kind.options.items() if block.options.get(option)), kind.patterns)
        self.patterns = patterns or chosen
        self.java = [to_java(p.regex) for p in self.patterns]
        self.post = POST.get(kind.key)
        if kind.key == "creditCard" and block.options.get("onlyValidCreditCardNumbers"):
            self.post = passes_luhn

    def matches(self, text: str, digit: str | None = None) -> Column:
        """``digit``: a column that tells whether the text has one, if that is known; most patterns need no look at a
        text without."""
        found = [find_all_sql(text, j, p.confidence, p.guard) for j, p in zip(self.java, self.patterns, strict=True)]
        if digit:
            found = [f"if({digit}, {m}, {NONE})" if p.needs_digit else m for m, p in zip(found, self.patterns, strict=True)]
        if any(p.group for p in self.patterns):
            kept = self._of_groups(text, found)
        else:
            kept = F.expr(drop_contained_sql(found))
        post = self.post
        return F.filter(kept, lambda m: post(m["token"])) if post else kept

    def _of_groups(self, text: str, found: list[str]) -> Column:
        """The finds where patterns choose a capturing group: groups are taken before contained finds are dropped."""
        whole = lambda j, p, m: of_group(F.expr(text), F.expr(m), j, p.group) if p.group else F.expr(m)
        lists = F.struct(*[whole(*x).alias(f"l{i}") for i, x in enumerate(zip(self.java, self.patterns, found, strict=True))])
        return F.transform(F.array(lists), lambda x: drop_contained(F.concat(*[x[f"l{i}"] for i in range(len(found))])))[0]

    def spans(self, matches: Column, context: Column) -> Column:
        return as_spans(matches, self.block, self.filter_type, context)


# How far a token may be from a word, and how sure such a find is.
FUZZY = {"low": (1, 0.8), "medium": (2, 0.6), "high": (3, 0.4)}
DICTIONARY_STRATEGIES = ("REDACT", "STATIC_REPLACE", "MASK")
TOKEN = r"[\p{L}\p{Nd}']+"
#: Lists of more words than that are searched as big_dictionary does, not by a pattern for each word.
LARGE_LIST = 200


def collect_words(block: Block, read_lines: Callable[[str], list[str]] | None = None) -> list[str]:
    """Terms, then the lines of files: trimmed, without empty ones, the first spelling of each (whatever its case)."""
    lines = list(block.options.get("terms", ()))
    for path in block.options.get("files", ()):
        try:
            lines += read_lines(path) if read_lines else open(path, encoding="utf-8").read().split("\n")
        except OSError as e:
            raise PolicyError(f"dictionary file {path}: {e}") from e
    words: dict[str, str] = {}
    for line in lines:
        if w := line.strip():
            words.setdefault(w.lower(), w)
    return list(words.values())


class DictionaryDetector:
    """Words of a list, and with ``fuzzy`` tokens that are nearly one of them."""

    filter_type = "custom-dictionary"

    def __init__(self, block: Block, words: list[str]) -> None:
        self.block, self.words = block, words
        self.exact_case = bool(block.options.get("caseSensitive"))
        self.java = [to_java(rf"\b{quote(w)}\b", not self.exact_case) for w in words]
        self.fuzzy = block.options.get("fuzzy") or ""

    def matches(self, text: str) -> Column:
        if not self.words:
            return no_matches()
        # One test of all words first: most texts have none of them.
        some = "|".join(f"(?:{j})" for j in self.java)
        found = F.expr(drop_contained_sql([find_all_sql(text, j, 1.0) for j in self.java]))
        exact = F.when(F.rlike(F.expr(text), F.lit(some)), found).otherwise(no_matches())
        return let(exact, lambda e: F.concat(e, self.near(text, e))) if self.fuzzy else exact

    def near(self, text: str, exact: Column) -> Column:
        most, confidence = FUZZY.get(self.fuzzy, FUZZY["low"])
        fold = (lambda c: c) if self.exact_case else F.lower
        words = F.array(*[F.lit(w if self.exact_case else w.lower()) for w in self.words])
        outside = lambda t: ~F.exists(exact, lambda e: (t["start"] >= e["start"]) & (t["end"] <= e["end"]))
        # Beyond the threshold, levenshtein stops counting and gives -1.
        within = lambda t: F.filter(F.transform(words, lambda w: F.levenshtein(fold(t["token"]), w, most)), lambda d: d >= 0)
        tokens = F.filter(find_all(text, TOKEN, confidence), outside)
        return F.filter(tokens, lambda t: F.array_min(within(t)) > 0)

    def spans(self, matches: Column, context: Column) -> Column:
        return as_spans(matches, self.block, self.filter_type, context, DICTIONARY_STRATEGIES)


def dictionary_detector(block: Block, read_lines: Callable[[str], list[str]] | None = None, word_lists: Mapping[str, DataFrame] | None = None) -> Detector:
    """``files`` are tables of ``word_lists``, or what ``read_lines`` gives, or else text files that the active session reads."""
    from sablework.operators.big_dictionary import LargeDictionaryDetector, word_table

    files, spark = block.options.get("files", ()), SparkSession.getActiveSession()
    tables = any(f in (word_lists or {}) for f in files) or bool(files and spark and not read_lines)
    if not tables:
        words = collect_words(block, read_lines)
        if len(words) <= LARGE_LIST or not spark:
            return DictionaryDetector(block, words)
        return LargeDictionaryDetector(block, word_table(spark, replace(block, options={"terms": words})))
    words = word_table(spark, block, word_lists)
    if words.limit(LARGE_LIST + 1).count() > LARGE_LIST:
        return LargeDictionaryDetector(block, words)
    return DictionaryDetector(block, [r.word for r in words.orderBy("place").collect()])


def compile_detectors(
    policy: Policy, models: list | None = None, read_lines: Callable[[str], list[str]] | None = None, word_lists: Mapping[str, DataFrame] | None = None
) -> list[Detector]:
    """The enabled blocks of a policy as detectors in their fixed order: patterns, models, dictionaries."""
    from sablework.operators.model import ModelDetector

    out: list[Detector] = [RegexDetector(k, b) for k in KINDS if (b := policy.blocks.get(k.key)) and b.enabled]
    clients = list(models or [])
    for i, b in enumerate(policy.models):
        if b.enabled:
            out.append(ModelDetector(b, clients[i] if i < len(clients) else None))
    return out + [dictionary_detector(b, read_lines, word_lists) for b in policy.dictionaries if b.enabled]
