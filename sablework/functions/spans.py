"""Spans as arrays of structs: finding them, dropping contained ones, sorting and splicing. Offsets are bytes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from sablework.functions.dialect import with_prefixes

MATCH = "array<struct<start:int,end:int,token:string,confidence:double>>"
SPAN = (
    "struct<character_start:int,character_end:int,filter_type:string,context:string,confidence:double,text:string,"
    "replacement:string,ignored:boolean,applied:boolean>"
)


def no_matches() -> Column:
    return F.array().cast(MATCH)


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


#: Pieces that one fold goes over; an even number. Each step copies what it has so far, so folds had better be short.
CHUNK = 128
NONE = f"cast(array() as {MATCH})"


def sql_text(value: str) -> str:
    """A string literal of Spark's SQL."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def sql_name(column: str) -> str:
    return "`" + column.replace("`", "``") + "`"


def _fold(pieces: str, at: str, confidence: float) -> str:
    """From text and matches by turns (text first) to matches with byte offsets, from an offset on."""
    hit = f"named_struct('start', a.pos, 'end', a.pos + octet_length(x), 'token', x, 'confidence', {confidence!r}D)"
    step = f"named_struct('pos', a.pos + octet_length(x), 'hit', not a.hit, 'out', if(a.hit, concat(a.out, array({hit})), a.out))"
    return f"aggregate({pieces}, named_struct('pos', {at}, 'hit', false, 'out', {NONE}), (a, x) -> {step}, a -> a.out)"


def _fold_chunks(pieces: str, confidence: float) -> str:
    """The same in chunks of pieces, each from its own offset, so that the work grows with the number of matches."""
    chunks = f"transform(sequence(0, cast((size({pieces}) - 1) div {CHUNK} as int)), b -> slice({pieces}, b * {CHUNK} + 1, {CHUNK}))"
    sizes = "transform(c, q -> aggregate(q, 0, (n, y) -> n + octet_length(y)))"
    starts = (
        f"aggregate({sizes}, named_struct('pos', 0, 'out', cast(array() as array<int>)), "
        "(s, n) -> named_struct('pos', s.pos + n, 'out', concat(s.out, array(s.pos))), s -> s.out)"
    )
    return f"transform(array({chunks}), c -> flatten(zip_with(c, {starts}, (q, o) -> {_fold('q', 'o', confidence)})))[0]"


def find_all(text: str, java_regex: str, confidence: float, guard: str = "") -> Column:
    return F.expr(find_all_sql(text, java_regex, confidence, guard))


def find_all_sql(text: str, java_regex: str, confidence: float, guard: str = "") -> str:
    """All non-overlapping matches from left to right in a text (an SQL expression). One scan marks them; a text that
    has the mark takes two scans.

    Written as SQL text, as a policy has dozens of these and building columns one call at a time takes seconds.
    """
    whole = sql_text(f"({java_regex})")
    marked = f"split(regexp_replace(t, {whole}, '\\u0001$1\\u0001'), '\\u0001', -1)"
    turns = (
        f"flatten(zip_with(split(t, {sql_text(java_regex)}, -1), regexp_extract_all(t, {whole}, 1), "
        "(g, h) -> if(h is null, array(g), array(g, h))))"
    )
    fold = f"if(size(p) <= {CHUNK}, {_fold('p', '0', confidence)}, {_fold_chunks('p', confidence)})"
    found = f"transform(array(if(contains(t, '\\u0001'), {turns}, {marked})), p -> if(size(p) < 2, {NONE}, {fold}))[0]"
    found = f"coalesce(transform(array({text}), t -> {found})[0], {NONE})"
    return f"if(rlike({text}, {sql_text(guard)}), {found}, {NONE})" if guard else found


def of_group(text: Column, matches: Column, java_regex: str, group: int) -> Column:
    """Of the matches of a pattern in a text, what a capturing group took, with its own offsets. Matches that the group has no part in, or
    an empty one, go; a pattern without that group keeps whole matches.

    Each match is looked at again by itself, with the characters beside it (which boundaries look at), from its start to its end.
    """
    if (marked := with_prefixes(java_regex, group)) is None:
        return matches
    regex, prefixes, own = marked
    raw = text.cast("binary")

    def beside(m: Column) -> Column:
        before = F.right(F.substring(raw, F.greatest(m["start"] - 3, F.lit(1)), F.least(m["start"], F.lit(4))).cast("string"), F.lit(1))
        after = F.left(F.substring(raw, m["end"] + 1, F.lit(4)).cast("string"), F.lit(1))
        return F.struct(m.alias("m"), before.alias("before"), after.alias("after"), F.concat(before, m["token"], after).alias("whole"))

    def look(x: Column, number: int) -> Column:
        of = lambda left, right: F.regexp_extract(x["whole"], rf"\A(?s:.{{{left}}})(?:{regex})(?=(?s:.{{{right}}})\z)", number)
        first = F.when(x["after"] == "", of(0, 0)).otherwise(of(0, 1))
        return F.when(x["before"] == "", first).when(x["after"] == "", of(1, 0)).otherwise(of(1, 1))

    def found(x: Column) -> Column:
        token = look(x, own)
        start = reduce(lambda at, n: at + F.octet_length(look(x, n)), prefixes, x["m"]["start"])
        return F.struct(start.alias("start"), (start + F.octet_length(token)).alias("end"), token.alias("token"), x["m"]["confidence"].alias("confidence"))

    return F.filter(F.transform(F.transform(matches, beside), found), lambda f: f["token"] != "").cast(MATCH)


def drop_contained_sql(lists: list[str]) -> str:
    """drop_contained() of several lists of matches one after the other, as SQL text. No match of a list contains
    another one of that list.

    A match goes if one of an earlier list contains it, dropped or not: what dropped that one contains both. So matches
    are put in the order of their starts and cut into chunks. What a chunk needs to know of those before it is how far
    each list has reached.
    """
    if len(lists) == 1:
        return lists[0]
    key = "named_struct('start', m.start, 'stop', -m.end, 'p', p, 'i', i, 'm', m)"
    keyed = f"array_sort(flatten(transform(ls, (l, p) -> transform(l, (m, i) -> {key}))))"
    chunks = f"transform(sequence(0, cast((size(k) - 1) div {CHUNK} as int)), b -> slice(k, b * {CHUNK} + 1, {CHUNK}))"
    reach = f"transform(sequence(0, {len(lists) - 1}), q -> coalesce(array_max(transform(filter(c, x -> x.p = q), x -> x.m.end)), -1))"
    nowhere = f"array_repeat(-1, {len(lists)})"
    before = (
        f"aggregate(transform(cs, c -> {reach}), named_struct('now', {nowhere}, 'out', cast(array() as array<array<int>>)), "
        "(a, r) -> named_struct('now', zip_with(a.now, r, (u, v) -> greatest(u, v)), 'out', concat(a.out, array(a.now))), a -> a.out)"
    )
    held = "exists(c, y -> y.p < x.p and y.start <= x.start and y.m.end >= x.m.end) or exists(slice(r, 1, x.p), e -> e >= x.m.end)"
    kept = f"flatten(zip_with(cs, {before}, (c, r) -> transform(filter(c, x -> not ({held})), x -> named_struct('p', x.p, 'i', x.i, 'm', x.m))))"
    swept = f"transform(array({keyed}), k -> transform(array({chunks}), cs -> transform(array_sort({kept}), x -> x.m))[0])[0]"
    few = f"aggregate(flatten(ls), {NONE}, (a, x) -> if(exists(a, y -> x.start >= y.start and x.end <= y.end), a, concat(a, array(x))))"
    number = "aggregate(ls, 0, (n, l) -> n + size(l))"
    return f"transform(array(array({', '.join(lists)})), ls -> if({number} < 2, flatten(ls), if({number} <= {CHUNK}, {few}, {swept})))[0]"


def drop_contained(matches: Column, kind: str = MATCH, start: str = "start", end: str = "end") -> Column:
    """Keeps the first of any spans of which one contains the other; partial overlaps and supersets stay."""
    held = lambda acc, x: F.exists(acc, lambda y: (x[start] >= y[start]) & (x[end] <= y[end]))
    fold = F.aggregate(matches, F.array().cast(kind), lambda acc, x: F.when(held(acc, x), acc).otherwise(F.concat(acc, F.array(x))))
    return fold


def sorted_spans(spans: Column, kind: str = SPAN) -> Column:
    """By start; ties in the order of detectors and then of discovery, which is the order of the array."""
    keyed = F.transform(spans, lambda x, i: F.struct(x["character_start"].alias("at"), i.alias("i"), x.alias("x")))
    return F.transform(F.array_sort(keyed), lambda k: k["x"])


def splice(text: Column, spans: Column) -> Column:
    """The text with the replacements of all applied spans. After each span, reading goes on at its end, even where
    that is further left; an empty replacement leaves the span's own text."""
    raw = text.cast("binary")
    part = lambda lo, hi: F.substring(raw, lo + 1, F.greatest(hi - lo, F.lit(0))).cast("string")

    def pieces(used: Column) -> Column:
        ends = lambda i: F.coalesce(F.get(used, i - 1)["character_end"], F.lit(0))
        own = lambda s: F.when(s["replacement"] != "", s["replacement"]).otherwise(s["text"])
        each = F.transform(used, lambda s, i: F.concat(part(ends(i), s["character_start"]), own(s)))
        return F.concat(F.array_join(each, ""), part(ends(F.size(used)), F.length(raw)))

    applied = F.filter(spans, lambda s: s["applied"] & ~s["ignored"])
    return F.when(F.size(spans) == 0, text).otherwise(let(applied, pieces))
