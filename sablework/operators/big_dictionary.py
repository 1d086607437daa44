"""Dictionaries of any size inside the engine: exact terms of several words, and tokens that are nearly one of many words.

A term matches between two ASCII word boundaries, so it is a sequence of whole runs of word and other characters. Terms
make a tree of runs (TermIndex), which travels to the workers once, if the list's measured size is below LIST_BYTES; texts
then walk the tree together, a slice at a time, run by run. A longer list stays a table. Texts are cut into groups of
GROUP_BYTES; what may be a term of the list by filters of its hashes (TermFilter, made of FILTER_BYTES each, one after the other)
is looked up in a join, once a group, and each group then walks a tree of the terms that the join has found for it.

Near tokens come from a join too: tokens and words that are at most ``most`` edits apart share a signature, what is left
of them (or of one of their halves) after deletions. Only the distinct tokens of the texts take part, and a token only needs one
word that is near, which a semi-join finds. What is near then goes back to the texts as a set, or by their groups where it is large.

Folding is one character to one (as in case-insensitive patterns), but U+017F and U+212A don't count as word characters.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Mapping
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sablework.functions.dialect import WORD, to_java
from sablework.functions.runs import Runs, ascii_word, cut, letters
from sablework.functions.spans import MATCH, find_all, no_matches, sql_name
from sablework.operators.detectors import DICTIONARY_STRATEGIES, FUZZY, TOKEN, as_spans
from sablework.operators.metrics import UNICODE_SPACE
from sablework.plans.policy import Block, PolicyError
from sablework.sources.stores import scratch_dir

#: Maximal runs of ASCII word characters: the words between boundaries.
ASCII_WORD = f"[{WORD}]+"
#: Lists (of terms, or of near tokens) of at most so many bytes travel to the workers; longer ones are joined.
LIST_BYTES = 64 << 20
#: What an entry of such a list costs beside its text, in its tree and on the way to it.
ENTRY_BYTES = 64
#: Texts are cut and searched in slices of about so many bytes, whatever a batch holds.
SLICE_BYTES = 1 << 20
#: What goes to a Python worker at a time, at most: texts may be long, and a worker's memory is small.
BATCH_BYTES = 4 << 20
#: Texts that are searched with one tree of the terms that they have, where the list doesn't travel.
GROUP_BYTES = 4 << 20
#: A filter of hashes, of a byte for each; longer lists take several filters, each over all texts.
FILTER_BYTES = 32 << 20
#: Words of up to so many characters are signed whole, longer ones by halves.
SHORT = 8

# --- lists of words ---------------------------------------------------------------------------------------------------


def trimmed(word: Column) -> Column:
    return F.regexp_replace(word, rf"^{UNICODE_SPACE}|{UNICODE_SPACE}\z", "")


def file_lines(spark: SparkSession, path: str) -> DataFrame:
    """word, position: the lines of a text file (or folder of these) in their order."""
    try:
        lines = spark.read.text(path, lineSep="\n")
    except AnalysisException as e:
        raise PolicyError(f"dictionary file {path}: {e}") from e
    # Within a block, the rows of a file are numbered in their order.
    at = F.struct("_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id().alias("row"))
    return lines.select(F.col("value").alias("word"), at.alias("position"))


def first_spellings(words: DataFrame) -> DataFrame:
    """word, position: trimmed, without empty ones; of spellings that differ in case only, the first by position."""
    kept = words.select(trimmed(F.col("word")).alias("word"), "position").where("word <> ''")
    first = kept.groupBy(F.lower("word").alias("folded")).agg(F.min(F.struct("position", "word")).alias("f"))
    return first.select("f.word", "f.position")


def word_table(spark: SparkSession, block: Block, word_lists: Mapping[str, DataFrame] | None = None) -> DataFrame:
    """word, place (a long): the words of a block, its terms first, then its files in their order. A file is the table of that
    name in ``word_lists`` (word, position), or a text file that Spark reads."""
    terms = list(block.options.get("terms", ()))
    given = word_lists or {}
    parts = [given[f] if f in given else file_lines(spark, f) for f in block.options.get("files", ())]
    if terms or not parts:
        parts.insert(0, spark.createDataFrame(list(enumerate(terms)), "position bigint, word string"))
    # Several lists are put in order each by itself, as positions differ in type.
    place = lambda i: F.struct(F.lit(i).alias("list"), F.monotonically_increasing_id().alias("row")).alias("position")
    out = reduce(DataFrame.unionByName, [p.orderBy("position").select("word", place(i)) for i, p in enumerate(parts)]) if parts[1:] else parts[0]
    path = f"{scratch_dir(spark)}/words"
    first_spellings(out).orderBy("position").select("word", F.monotonically_increasing_id().alias("place")).write.parquet(path)
    return spark.read.schema("word string, place bigint").parquet(path)


def distinct_words(words: DataFrame, column: str = "word", case_sensitive: bool = False) -> DataFrame:
    """key, word: the first spelling of each word, by ``position`` where the table has one, else by file and row; a derived
    table without positions has no order, and there the smallest spelling counts as the first."""
    if "position" in words.columns:
        placed = words.select(F.col(column).alias("word"), "position")
    else:
        try:
            placed = words.select(F.col(column).alias("word"), F.struct("_metadata.file_path", "_metadata.row_index").alias("position"))
        except AnalysisException:
            placed = words.select(F.col(column).alias("word"), F.lit(0).alias("position"))
    first = first_spellings(placed)
    return first.select((F.col("word") if case_sensitive else F.lower("word")).alias("key"), "word")


def dictionary_rows(df: DataFrame, words: DataFrame, doc_id: str = "doc_id", text: str = "text", case_sensitive: bool = False) -> DataFrame:
    """One row per find of words that are one token each: doc_id, character_start, character_end (bytes), token, word."""
    fold = (lambda c: c) if case_sensitive else F.lower
    tokens = df.select(F.col(doc_id).alias("doc_id"), F.explode_outer(find_all(sql_name(text), to_java(ASCII_WORD), 1.0)).alias("t")).where("t is not null")
    keyed = tokens.select("doc_id", F.col("t.start").alias("character_start"), F.col("t.end").alias("character_end"), F.col("t.token").alias("token"))
    found = keyed.withColumn("key", fold(F.col("token"))).join(distinct_words(words, "word", case_sensitive), "key")
    return found.select("doc_id", "character_start", "character_end", "token", "word")


# --- exact terms ------------------------------------------------------------------------------------------------------


class Folds(dict):
    """By code point, what a character is folded to."""

    def __missing__(self, point: int) -> str:
        one = lambda new, c: new if len(new) == 1 else c
        up = one((c := chr(point)).upper(), c)
        self[point] = out = one(up.lower(), up)
        return out


FOLDS = Folds()


def fold(text: str) -> str:
    """Case folded, one character to one."""
    return text.lower() if text.isascii() else text.translate(FOLDS)


def small_batches(spark: SparkSession) -> None:
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if not 0 < spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(name)) <= BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))


def folded(words: pa.Array, exact_case: bool) -> pa.Array:
    return words if exact_case else pa.array([fold(w) for w in words.to_pylist()], pa.string())


def slices(texts: pa.Array) -> Iterator[pa.Array]:
    """Neighbouring texts, of about SLICE_BYTES together; a longer one by itself."""
    share = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)) // SLICE_BYTES
    at = np.concatenate([[0], 1 + np.flatnonzero(np.diff(share)), [len(texts)]])
    for i, j in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        yield texts.slice(i, j - i)


class TermIndex:
    """A tree of runs: ``edges`` (sorted) are pairs of a node and a run's number, ``ends`` says which term ends at a node."""

    def __init__(self, words: list[str] | pa.Array, exact_case: bool) -> None:
        self.exact_case = exact_case
        self.runs: dict[str, int] = {}
        coded, sizes = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for some in slices(words if isinstance(words, pa.Array) else pa.array(words, pa.string())):
            runs = cut(folded(some, exact_case), ascii_word())
            encoded = runs.texts.dictionary_encode()
            number = np.array([self.runs.setdefault(t, len(self.runs)) for t in encoded.dictionary.to_pylist()], np.int64)
            coded.append(number[encoded.indices.to_numpy(zero_copy_only=False)])
            sizes.append(np.bincount(runs.row, minlength=len(some)))
        codes, size = np.concatenate(coded), np.concatenate(sizes)
        first = np.concatenate([[0], np.cumsum(size)])[:-1]
        node, nodes, edges, targets, ends = np.zeros(len(words), np.int64), 1, [], [], []
        for depth in range(int(size.max(initial=0))):
            going = np.flatnonzero(size > depth)
            keys, inverse = np.unique(node[going] * len(self.runs) + codes[first[going] + depth], return_inverse=True)
            node[going] = nodes + inverse
            edges.append(keys)
            targets.append(np.arange(nodes, nodes + len(keys)))
            nodes += len(keys)
        order = np.argsort(np.concatenate([[], *edges]).astype(np.int64), kind="stable")
        self.edges = np.concatenate([np.zeros(0, np.int64), *edges])[order]
        self.targets = np.concatenate([np.zeros(0, np.int64), *targets])[order]
        self.ends = np.full(nodes, -1, np.int64)
        self.ends[node[::-1]] = np.arange(len(words))[::-1]

    def find(self, runs: Runs) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First and last run and term of every place where a term stands between boundaries, whatever else is there."""
        encoded = runs.texts.dictionary_encode()
        known = [self.runs.get(t if self.exact_case else fold(t), -1) for t in encoded.dictionary.to_pylist()]
        code = np.array(known, np.int64)[encoded.indices.to_numpy(zero_copy_only=False)]
        # A text's edge is a boundary only beside a word character.
        edge = np.ones(len(code) + 1, bool)
        edge[1:-1] = runs.row[1:] != runs.row[:-1]
        begin = np.flatnonzero((code >= 0) & (runs.member | ~edge[:-1])) if len(code) else np.zeros(0, np.int64)
        may_end = runs.member | ~edge[1:]
        node, depth, found = np.zeros(len(begin), np.int64), 0, []
        while len(begin) and len(self.edges):
            at = begin + depth
            inside = at < len(code)
            inside[inside] = (runs.row[at[inside]] == runs.row[begin[inside]]) & (code[at[inside]] >= 0)
            begin, node, at = begin[inside], node[inside], at[inside]
            key = node * len(self.runs) + code[at]
            place = np.minimum(np.searchsorted(self.edges, key), len(self.edges) - 1)
            hit = self.edges[place] == key
            begin, node, at = begin[hit], self.targets[place[hit]], at[hit]
            whole = (self.ends[node] >= 0) & may_end[at]
            found.append((begin[whole], at[whole], self.ends[node[whole]]))
            depth += 1
        return tuple(np.concatenate([np.zeros(0, np.int64), *[f[i] for f in found]]) for i in range(3))


def settled(lo: np.ndarray, hi: np.ndarray, term: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Which matches stay, in the order of discovery: each term's from left to right without overlap, term by term, but
    none that one of an earlier term contains. Places count over all rows, so rows never overlap."""
    order = np.lexsort((lo, term, row))
    l, h, same = lo[order], hi[order], np.zeros(len(order), bool)
    same[1:] = (term[order][1:] == term[order][:-1]) & (row[order][1:] == row[order][:-1]) & (l[1:] < h[:-1])
    stay, end, before = np.ones(len(order), bool), 0, -1
    for i in np.flatnonzero(same):
        # In a chain of overlaps, each is judged by the last that stays.
        end = end if before == i - 1 else h[i - 1]
        before, stay[i] = i, l[i] >= end
        end = h[i] if stay[i] else end
    order = order[stay]
    by_start = order[np.lexsort((term[order], -hi[order], lo[order]))]
    l, h, t = lo[by_start], hi[by_start], term[by_start]
    reach = np.concatenate([[-1], np.maximum.accumulate(h)[:-1]]) if len(h) else h
    longest, drop = int((h - l).max(initial=0)), np.zeros(len(h), bool)
    i = j = np.flatnonzero(reach >= h)
    while len(i):
        # Each is compared with the one before, then with the one before that, as far back as the longest reaches.
        j = j - 1
        near = j >= 0
        near[near] = l[j[near]] >= h[i[near]] - longest
        i, j = i[near], j[near]
        held = (h[j] >= h[i]) & (t[j] < t[i])
        drop[i[held]] = True
        i, j = i[~held], j[~held]
    gone = by_start[drop]
    return order[~np.isin(order, gone)] if len(gone) else order


ARROW_MATCH = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("token", pa.string()), ("confidence", pa.float64())]))


def match_lists(rows: int, row: np.ndarray, start: np.ndarray, end: np.ndarray, tokens: pa.Array, confidence: float) -> pa.Array:
    """One list of matches per row, of matches that are sorted by row."""
    fields = [pa.array(start.astype(np.int32)), pa.array(end.astype(np.int32)), tokens, pa.array(np.full(len(row), confidence))]
    items = pa.StructArray.from_arrays(fields, fields=list(ARROW_MATCH.value_type))
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(row, np.arange(rows + 1)).astype(np.int32)), items, type=ARROW_MATCH)


def exact_matches(texts: pa.Array, index: TermIndex) -> pa.Array:
    return joined([_exact_matches(t, index) for t in slices(texts)])


def joined(lists: list[pa.Array]) -> pa.Array:
    return lists[0] if len(lists) == 1 else pa.concat_arrays(lists)


def _exact_matches(texts: pa.Array, index: TermIndex) -> pa.Array:
    runs = cut(texts, ascii_word())
    begin, last, term = index.find(runs)
    row, lo, hi = runs.row[begin], runs.lo[begin], runs.hi[last]
    kept = settled(lo, hi, term, row)
    row, lo, hi = row[kept], lo[kept], hi[kept]
    return match_lists(len(texts), row, lo - runs.base[row], hi - runs.base[row], runs.tokens(lo, hi), 1.0)


# --- near tokens ------------------------------------------------------------------------------------------------------


def _with_deletions(value: str, most: int) -> str:
    """SQL: a string and all that is left of it after deleting up to ``most`` characters, as an array."""
    fewer = "if(length(x) = 0, cast(array() as array<string>), transform(sequence(1, length(x)), i -> concat(substring(x, 1, i - 1), substring(x, i + 1))))"
    level, every = f"array({value})", [f"array({value})"]
    for _ in range(most):
        level = f"array_distinct(flatten(transform({level}, x -> {fewer})))"
        every.append(level)
    return f"array_distinct(concat({', '.join(every)}))"


def _signed(parts: list[str]) -> Column:
    return F.expr(f"array_distinct(transform(concat({', '.join(parts)}), s -> xxhash64(s)))")


def _tagged(tag: str, values: str) -> str:
    return f"transform({values}, s -> concat('{tag}', s))"


def word_signatures(words: DataFrame, most: int) -> DataFrame:
    """word, sig of a table of folded words."""
    none, half = "cast(array() as array<string>)", most // 2
    whole = f"if(length(word) <= {SHORT}, {_tagged('w', _with_deletions('word', most))}, {none})"
    halves = [("l", "substring(word, 1, length(word) div 2)"), ("r", "substring(word, length(word) div 2 + 1)")]
    parts = [f"if(length(word) > {SHORT}, {_tagged(t, _with_deletions(h, half))}, {none})" for t, h in halves]
    return words.select("word", F.explode(_signed([whole, *parts])).alias("sig"))


def token_signatures(tokens: DataFrame, most: int) -> DataFrame:
    """token, folded, sig: signatures of which it shares one with every word at most ``most`` edits away.

    Of two texts that far apart, some left parts and the right parts that go with them are, one or the other, at most half as many edits apart.
    """
    none, half, n = "cast(array() as array<string>)", most // 2, "length(folded)"
    whole = f"if({n} <= {SHORT + most}, {_tagged('w', _with_deletions('folded', most))}, {none})"
    low, high = f"greatest({SHORT + 1}, {n} - {most})", f"({n} + {most})"
    lefts = f"sequence(greatest(0, {low} div 2 - {half}), least({n}, {high} div 2 + {half}))"
    rights = f"sequence(greatest(0, ({low} + 1) div 2 - {half}), least({n}, ({high} + 1) div 2 + {half}))"
    cuts = [("l", lefts, "substring(folded, 1, cast(k as int))"), ("r", rights, "right(folded, cast(k as int))")]
    parts = [f"if({n} + {most} > {SHORT}, flatten(transform({ks}, k -> {_tagged(t, _with_deletions(piece, half))})), {none})" for t, ks, piece in cuts]
    return tokens.select("token", "folded", F.explode(_signed([whole, *parts])).alias("sig"))


def near_tokens(tokens: DataFrame, words: DataFrame, most: int, case_sensitive: bool = False) -> DataFrame:
    """Of distinct tokens (token) those that are 1 to ``most`` edits from some word (word), and equal to none."""
    folded = (lambda c: F.col(c)) if case_sensitive else F.lower
    keys = words.select(folded("word").alias("word")).distinct()
    longest = F.coalesce(F.max(F.length("word")), F.lit(-1)) + most
    limit = keys.agg(longest.alias("n")).first().n
    given = tokens.select("token", folded("token").alias("folded")).where(F.length("folded") <= limit)
    signed = token_signatures(given.join(keys, F.col("folded") == F.col("word"), "left_anti"), most).alias("t")
    other = word_signatures(keys, most).alias("w")
    near = (F.col("t.sig") == F.col("w.sig")) & (F.levenshtein(F.col("t.folded"), F.col("w.word"), most) >= 0)
    return signed.join(other, near, "left_semi").select("token").distinct()


def near_matches(texts: pa.Array, exact: pa.Array, near: frozenset[str], confidence: float) -> pa.Array:
    """The tokens of ``near`` that no exact match contains."""
    at, out = 0, []
    for t in slices(texts):
        out.append(_near_matches(t, exact.slice(at, len(t)), near, confidence))
        at += len(t)
    return joined(out)


def _near_matches(texts: pa.Array, exact: pa.Array, near: frozenset[str], confidence: float) -> pa.Array:
    runs = cut(texts, letters())
    encoded = runs.texts.dictionary_encode()
    some = np.array([*(t in near for t in encoded.dictionary.to_pylist()), False], bool)
    at = np.flatnonzero(runs.member & some[encoded.indices.to_numpy(zero_copy_only=False)]) if len(runs.lo) else np.zeros(0, np.int64)
    row, lo, hi = runs.row[at], runs.lo[at], runs.hi[at]
    # Ends of exact matches, as far as any of those that begin before.
    owner = np.repeat(np.arange(len(texts)), exact.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
    held = exact.flatten()
    start, end = (held.field(f).to_numpy(zero_copy_only=False) + runs.base[owner] for f in ("start", "end"))
    order = np.argsort(start, kind="stable")
    reach = np.concatenate([[-1], np.maximum.accumulate(end[order])]) if len(end) else np.array([-1])
    free = reach[np.searchsorted(start[order], lo, side="right")] < hi
    row, lo, hi = row[free], lo[free], hi[free]
    return match_lists(len(texts), row, lo - runs.base[row], hi - runs.base[row], runs.tokens(lo, hi), confidence)


# --- lists that stay tables -------------------------------------------------------------------------------------------

#: Of prefixes' hashes (numbers of 64 bits that wrap around): what they are multiplied by, and what marks the end of a term.
STEP, END, SPREAD = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xBF58476D1CE4E5B9))
#: The same for near tokens.
NEAR = np.uint64(0x94D049BB133111EB)
#: Words of 64 bits of a filter that are made together.
PIECE = 1 << 16


def hashed(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode(), digest_size=8).digest(), "little")


@dataclass
class RunHashes:
    """A hash of each run, folded; of runs that are often asked for it is kept."""

    exact_case: bool
    known: dict[str, int] = field(default_factory=dict)

    def of(self, runs: Runs) -> tuple[np.ndarray, np.ndarray]:
        """Of each run its hash, and a number that it shares with equal ones alone (not folded)."""
        encoded = runs.texts.dictionary_encode()
        if len(self.known) > 200_000:
            self.known.clear()
        out = np.empty(len(encoded.dictionary), np.uint64)
        for i, t in enumerate(encoded.dictionary.to_pylist()):
            if (h := self.known.get(t)) is None:
                h = self.known[t] = hashed(t if self.exact_case else fold(t))
            out[i] = h
        number = encoded.indices.to_numpy(zero_copy_only=False)
        return out[number], number


def spread(state: np.ndarray) -> np.ndarray:
    x = state * SPREAD
    return (x ^ (x >> np.uint64(29))) * STEP


def bits(h: np.ndarray) -> np.ndarray:
    """Three of 64 bits by the lower half of a hash; the upper half chooses the word."""
    one, six = np.uint64(1), np.uint64(63)
    return one << (h & six) | one << ((h >> np.uint64(6)) & six) | one << ((h >> np.uint64(12)) & six)


class TermFilter:
    """What may be the beginning of a term, or a term. It says yes to each that is one, and to few others."""

    def __init__(self, words: np.ndarray) -> None:
        self.words = words

    @staticmethod
    def word(h: np.ndarray, words: int) -> np.ndarray:
        return (h >> np.uint64(32)) * np.uint64(words) >> np.uint64(32)

    def has(self, state: np.ndarray) -> np.ndarray:
        h = spread(state)
        mask = bits(h)
        return self.words[self.word(h, len(self.words))] & mask == mask

    @staticmethod
    def states(terms: pa.Array, hashes: RunHashes) -> np.ndarray:
        """What a filter of these (folded) terms has to know: beginnings of one run, or that end in a run of word characters, and whole terms."""
        runs = cut(terms, ascii_word())
        code, size = hashes.of(runs)[0], np.bincount(runs.row, minlength=len(terms))
        first = np.concatenate([[0], np.cumsum(size)])[:-1]
        state, out = np.zeros(len(terms), np.uint64), []
        for depth in range(int(size.max(initial=0))):
            going = np.flatnonzero(size > depth)
            state[going] = state[going] * STEP + code[first[going] + depth]
            out.append(state[going] if depth == 0 else state[going[runs.member[first[going] + depth]]])
        return np.unique(np.concatenate([*out, state[size > 0] ^ END]))

    def find(self, runs: Runs, code: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First and last run of every stretch between boundaries that may be a term, and the hash of its folded runs."""
        edge = np.ones(len(code) + 1, bool)
        edge[1:-1] = runs.row[1:] != runs.row[:-1]
        begin = np.flatnonzero(runs.member | ~edge[:-1]) if len(code) else np.zeros(0, np.int64)
        may_end = runs.member | ~edge[1:]
        state, depth, found = np.zeros(len(begin), np.uint64), 0, []
        while len(begin):
            at = begin + depth
            inside = at < len(code)
            inside[inside] = runs.row[at[inside]] == runs.row[begin[inside]]
            begin, state, at = begin[inside], state[inside] * STEP + code[at[inside]], at[inside]
            asked = np.ones(len(at), bool) if depth == 0 else runs.member[at]
            going = ~asked
            going[asked] = self.has(state[asked])
            begin, state, at = begin[going], state[going], at[going]
            whole = np.flatnonzero(may_end[at])
            whole = whole[self.has(state[whole] ^ END)]
            found.append((begin[whole], at[whole], state[whole]))
            depth += 1
        kinds = (np.int64, np.int64, np.uint64)
        return tuple(np.concatenate([np.zeros(0, k), *[f[i] for f in found]]) for i, k in enumerate(kinds))


def one_of_each(begin: np.ndarray, last: np.ndarray, state: np.ndarray, number: np.ndarray) -> np.ndarray:
    """Of stretches with the same hash, the first, and those that have other runs than the first."""
    first, inverse = np.unique(state, return_index=True, return_inverse=True)[1:]
    given, size = first[inverse], last - begin
    same = size == size[given]
    for depth in range(int(size.max(initial=-1)) + 1):
        i = np.flatnonzero(same & (size >= depth))
        same[i] = number[begin[i] + depth] == number[begin[given[i]] + depth]
    return np.concatenate([first, np.flatnonzero(~same)])


def term_filter(states: DataFrame, n: int) -> TermFilter:
    """A filter of ``n`` hashes (state, a long), made in pieces; only its bytes come to the driver."""
    words = max(1, -(-n // 8))

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            h = spread(b.column(0).to_numpy().view(np.uint64))
            piece = (TermFilter.word(h, words) // np.uint64(PIECE)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(piece), pa.array(h.view(np.int64))], names=["piece", "h"])

    def made(key: tuple, given: pa.Table) -> pa.Table:
        h, first = given.column("h").to_numpy().view(np.uint64), key[0].as_py() * PIECE
        out = np.zeros(min(PIECE, words - first), np.uint64)
        np.bitwise_or.at(out, (TermFilter.word(h, words) - np.uint64(first)).astype(np.int64), bits(h))
        return pa.table({"piece": [key[0]], "words": pa.array([out.tobytes()], pa.binary())})

    out = np.zeros(words, np.uint64)
    for r in states.mapInArrow(pieces, "piece int, h bigint").groupBy("piece").applyInArrow(made, "piece int, words binary").collect():
        part = np.frombuffer(r.words, np.uint64)
        out[r.piece * PIECE : r.piece * PIECE + len(part)] = part
    return TermFilter(out)


def group_starts(rows: DataFrame, row: str, text: str) -> np.ndarray:
    """The first row of each group: neighbouring rows, of about GROUP_BYTES of text together. Rows are numbered by their partitions."""
    narrow = rows.select(F.col(row).alias("row"), F.coalesce(F.octet_length(text), F.lit(0)).alias("n")).withColumn("p", F.shiftright("row", 33))
    so_far = F.sum("n").over(Window.partitionBy("p").orderBy("row").rowsBetween(Window.unboundedPreceding, 0))
    starts = narrow.withColumn("g", F.floor(so_far / GROUP_BYTES)).groupBy("p", "g").agg(F.min("row").alias("row"))
    return np.array(sorted(r.row for r in starts.select("row").collect()), np.int64)


# --- the detector -----------------------------------------------------------------------------------------------------


class LargeDictionaryDetector:
    """As DictionaryDetector, for lists of any size: ``words`` is a table as word_table() makes it."""

    filter_type = "custom-dictionary"

    def __init__(self, block: Block, words: DataFrame, list_bytes: int = LIST_BYTES) -> None:
        self.block, self.words, self.list_bytes = block, words, list_bytes
        self.exact_case = bool(block.options.get("caseSensitive"))
        self.fuzzy = block.options.get("fuzzy") or ""
        self.spark = words.sparkSession
        self.travels = self._bytes(words, "word") <= list_bytes

    def _bytes(self, table: DataFrame, column: str) -> int:
        return table.agg(F.coalesce(F.sum(F.octet_length(column) + ENTRY_BYTES), F.lit(0)).alias("n")).first().n

    def attach(self, df: DataFrame, text: str, name: str) -> DataFrame:
        """``df`` with a column of matches. Rows are numbered and written first where something has to be joined to them."""
        if df.isStreaming and (self.fuzzy or not self.travels):
            raise ValueError("a stream can search a large list only for exact terms, and only if the list travels; use foreachBatch for others")
        small_batches(self.spark)
        near = self._near(df, text) if self.fuzzy else None
        if not self.travels or (near and self._bytes(near, "token") > self.list_bytes):
            return self._by_groups(df, near, text, name)
        index = self.spark.sparkContext.broadcast(TermIndex(self._held(self.words.orderBy("place"), "word"), self.exact_case))

        @F.arrow_udf(MATCH)
        def exact(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            for b in batches:
                for texts in slices(b):
                    yield _exact_matches(texts, index.value)

        found = df.withColumn(name, exact(F.col(text)))
        if not near:
            return found
        confidence = self._fuzziness()[1]
        held = self.spark.sparkContext.broadcast(frozenset(self._held(near, "token").to_pylist()))

        @F.arrow_udf(MATCH)
        def add(texts: pa.Array, exact: pa.Array) -> pa.Array:
            return near_matches(texts, exact, held.value, confidence)

        return found.withColumn(name, F.concat(F.col(name), add(F.col(text), F.col(name))))

    def _held(self, table: DataFrame, column: str) -> pa.Array:
        """A list that travels, on the driver: as one array, which takes a small part of what rows would."""
        return table.select(column).toArrow().column(0).cast(pa.string()).combine_chunks()

    def _fuzziness(self) -> tuple[int, float]:
        return FUZZY.get(self.fuzzy, FUZZY["low"])

    def _near(self, df: DataFrame, text: str) -> DataFrame:
        tokens = df.select(F.explode(F.regexp_extract_all(F.col(text), F.lit(f"({TOKEN})"), 1)).alias("token")).distinct()
        path = f"{scratch_dir(self.spark)}/near"
        near_tokens(tokens, self.words, self._fuzziness()[0], self.exact_case).write.parquet(path)
        return self.spark.read.schema("token string").parquet(path)

    def _numbered(self, df: DataFrame, row: str) -> DataFrame:
        path = f"{scratch_dir(self.spark)}/rows"
        df.withColumn(row, F.monotonically_increasing_id()).write.parquet(path)
        return self.spark.read.parquet(path)

    def _by_groups(self, df: DataFrame, near: DataFrame | None, text: str, name: str) -> DataFrame:
        row, group, extra = f"{name}_row", f"{name}_group", f"{name}_near"
        exact_case, confidence = self.exact_case, self._fuzziness()[1]
        rows = self._numbered(df, row)
        starts = group_starts(rows, row, text)

        @F.arrow_udf("string")
        def key(words: pa.Array) -> pa.Array:
            return folded(words, exact_case)

        @F.arrow_udf("int")
        def group_of(row: pa.Array) -> pa.Array:
            return pa.array((np.searchsorted(starts, row.to_numpy(), side="right") - 1).astype(np.int32))

        lists = self.words.select(F.lit(False).alias("near"), "word", "place")
        if near:
            lists = lists.unionByName(near.select(F.lit(True).alias("near"), F.col("token").alias("word"), F.lit(0).cast("long").alias("place")))
        asked = reduce(DataFrame.unionByName, [self._candidates(rows.select(row, text), f, starts) for f in self._filters(lists)])
        keyed = lists.withColumn("key", F.when(F.col("near"), F.col("word")).otherwise(key("word")))
        given = asked.join(keyed, ["near", "key"]).select("group", "near", "key", "place")
        kinds = rows.withColumns({name: no_matches(), extra: no_matches()}).schema

        def search(texts: pa.Table, given: pa.Table) -> pa.Table:
            is_near, texts = given.column("near").combine_chunks(), texts.drop_columns([group])
            terms = given.filter(pc.invert(is_near)).sort_by("place").column("key").combine_chunks()
            body = texts.column(text).combine_chunks()
            exact = exact_matches(body, TermIndex(terms, exact_case))
            near = near_matches(body, exact, frozenset(given.filter(is_near).column("key").to_pylist()), confidence)
            return texts.append_column(name, exact).append_column(extra, near)

        by = rows.withColumn(group, group_of(row)).groupBy(group).cogroup(given.groupBy("group"))
        return by.applyInArrow(search, kinds).withColumn(name, F.concat(name, extra)).drop(row, extra)

    def _filters(self, lists: DataFrame) -> Iterator[TermFilter]:
        """Filters of which one or the other knows each entry of ``lists`` (near, word), all of limited size."""
        exact_case, runs = self.exact_case, F.when(F.col("near"), F.lit(1)).otherwise(F.regexp_count("word", F.lit(ASCII_WORD)) + 2)
        n = lists.agg(F.coalesce(F.sum(runs), F.lit(0)).alias("n")).first().n
        shares = max(1, -(-n // FILTER_BYTES))

        def states(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            hashes = RunHashes(True)
            for b in batches:
                near, words = b.column(0), b.column(1)
                found = [TermFilter.states(folded(words.filter(pc.invert(near)), exact_case), hashes), np.array([hashed(t) for t in words.filter(near).to_pylist()], np.uint64) ^ NEAR]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found).view(np.int64))], names=["state"])

        for i in range(shares):
            share = lists.where(F.pmod(F.xxhash64("word"), F.lit(shares)) == i)
            yield term_filter(share.select("near", "word").mapInArrow(states, "state bigint"), -(-n // shares))

    def _candidates(self, rows: DataFrame, terms: TermFilter, starts: np.ndarray) -> DataFrame:
        """group, near, key of what may be in the list: each once, or few times, for a group."""
        held, exact_case, fuzzy = self.spark.sparkContext.broadcast(terms), self.exact_case, bool(self.fuzzy)

        def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            folded_hash, plain_hash, seen, last_group = RunHashes(exact_case), RunHashes(True), (set(), set()), None
            for b in batches:
                groups, at = np.searchsorted(starts, b.column(0).to_numpy(), side="right") - 1, 0
                for texts in slices(b.column(1)):
                    group, at = groups[at : at + len(texts)], at + len(texts)
                    runs = cut(texts, ascii_word())
                    code, number = folded_hash.of(runs)
                    begin, last, state = held.value.find(runs, code)
                    found = [(runs, False, begin, last, state, number)]
                    if fuzzy:
                        runs = cut(texts, letters())
                        code, number = plain_hash.of(runs)
                        i = np.flatnonzero(runs.member)
                        i = i[held.value.has(code[i] ^ NEAR)]
                        found.append((runs, True, i, i, code[i], number))
                    for g in np.unique(group).tolist():
                        if g != last_group:
                            seen, last_group = (set(), set()), g
                        for runs, near, begin, last, state, number in found:
                            own = np.flatnonzero(group[runs.row[begin]] == g)
                            own = own[one_of_each(begin[own], last[own], state[own], number)]
                            tokens = runs.tokens(runs.lo[begin[own]], runs.hi[last[own]])
                            new = set((tokens if near else folded(tokens, exact_case)).to_pylist()) - seen[near]
                            seen[near].update(new)
                            columns = [pa.array([g] * len(new), pa.int32()), pa.array([near] * len(new), pa.bool_()), pa.array(list(new), pa.string())]
                            yield pa.RecordBatch.from_arrays(columns, names=["group", "near", "key"])

        return rows.mapInArrow(candidates, "group int, near boolean, key string")

    def spans(self, matches: Column, context: Column) -> Column:
        return as_spans(matches, self.block, self.filter_type, context, DICTIONARY_STRATEGIES)
