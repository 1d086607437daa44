"""Operator 1: language identification by cross-parsing entropy.

Per language a suffix automaton of labelled text is built. A document is parsed
against it into phrases, each the longest match in the language's text; c
phrases over n letters of training text and L symbols of document estimate the
cross entropy c * log2(n) / L in bits a symbol. The language that needs the
fewest bits wins.

The classifier is fitted on a bounded sample of labelled rows: TRAIN_ROWS in
all, dealt evenly to the languages (TRAIN_DOCS each at most, one at least), those with
the smallest hashes, whatever their length. They are learned from in that order until the
language has its even part of TRAIN_CHARS code points, where the last text is cut. Every letter of
the sample is a symbol of its own, whatever their number. Scoring reads whole texts, and phrases
never end for any reason but a missing match. Text is lower-cased; runs of other
characters than letters become one separator.

Null text or text without letters gives ``und`` and score 0, also where no
language could be learned; ties go to the language whose name sorts first;
equal texts get equal results, very long ones are parsed in lanes that are
joined exactly; repeated rows are learned from once; an empty table gives an
empty result. Other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, long_id, small_batches, written

TRAIN_ROWS, TRAIN_DOCS, TRAIN_CHARS = 64, 16, 512_000
#: Entries that the automata's dense tables have in all; they serve the most frequent symbols, sorted lists the rest.
DENSE = 12_000_000
#: Symbols in a lane of a long text. Lanes are parsed side by side and then joined where they agree.
LANE = 1024
CODE_POINTS = 4_000_000
#: A document is rejected when even the best language needs more bits a symbol. The rate is that of the document and of
#: PRIOR_SYMBOLS more at PRIOR_BITS, so the less there is to go by, the stranger a text must be.
REJECT_BITS, PRIOR_BITS, PRIOR_SYMBOLS = 6.0, 3.0, 100


class Alphabet:
    """Code point to symbol: 0 separator, 1 any letter that training doesn't know, then its letters, most frequent first."""

    def __init__(self, letters: str) -> None:
        self.letters = letters
        self.known = {c: i + 2 for i, c in enumerate(letters)}
        self.table = np.array([self.symbol(cp) for cp in range(0x10000)], np.int32)

    def symbol(self, cp: int) -> int:
        c = chr(cp)
        return self.known.get(c.lower(), 1) if c.isalpha() else 0

    def symbols(self, text: str | bytes) -> np.ndarray:
        """Symbols of a text, separators not yet merged."""
        raw = text if isinstance(text, bytes) else text.encode()
        cps = np.frombuffer(raw.decode().encode("utf-32-le"), np.uint32)
        out = self.table[np.minimum(cps, 0xFFFF)]
        high = np.flatnonzero(cps > 0xFFFF)
        if len(high):
            kinds, which = np.unique(cps[high], return_inverse=True)
            out[high] = np.array([self.symbol(int(cp)) for cp in kinds], np.int32)[which]
        return out


def suffix_automaton(symbols: list[int]) -> list[dict[int, int]]:
    """The moves of each state; state 0 is the root."""
    nxt: list[dict[int, int]] = [{}]
    link, length = [-1], [0]
    last = 0
    for c in symbols:
        cur = len(nxt)
        nxt.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if p >= 0:
            q = nxt[p][c]
            if length[p] + 1 == length[q]:
                link[cur] = q
            else:
                copy = len(nxt)
                nxt.append(dict(nxt[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and nxt[p].get(c) == q:
                    nxt[p][c] = copy
                    p = link[p]
                link[q] = link[cur] = copy
        last = cur
    return nxt


class Automaton:
    """Greedy parsing steps: where a longest match ends, the symbol begins the next phrase at the root.

    ``dense`` has, at [state * width + symbol], the next state * width * 2, plus 1 if the match ended, for symbols
    below ``width``. Moves on other symbols are in ``rare``, sorted by state and symbol.
    """

    def __init__(self, moves: list[dict[int, int]], width: int, n_symbols: int) -> None:
        self.width, self.n_symbols = width, n_symbols
        # No symbol goes on from the last state, the first one of all: there a phrase has just ended. A symbol unknown
        # even at the root is a phrase of its own.
        moves = [*moves, {}]
        self.first = (len(moves) - 1) * width
        root = np.full(n_symbols, len(moves) - 1, np.int64)
        for c, t in moves[0].items():
            root[c] = t
        table = np.full((len(moves), width), -1, np.int64)
        far = []
        for s, out in enumerate(moves):
            for c, t in out.items():
                if c < width:
                    table[s, c] = t
                else:
                    far.append((s * n_symbols + c, t))
        known = table >= 0
        dense = np.where(known, table, root[None, :width]) * width * 2 + ~known
        self.dense = dense.astype(np.int32 if dense.max(initial=0) < 2**31 else np.int64).ravel()
        self.root = root * width * 2 + 1
        far.sort()
        self.rare = np.array([k for k, _ in far], np.int64)
        self.rare_to = np.array([t for _, t in far], np.int64) * width * 2

    def step(self, state: np.ndarray, symbol: np.ndarray, any_rare: bool) -> np.ndarray:
        """``state`` counts in widths; the result is twice the next one, plus 1 if a phrase ended."""
        if not any_rare:
            return self.dense[state + symbol]
        out = self.dense[state + np.minimum(symbol, self.width - 1)].astype(np.int64)
        at = np.flatnonzero(symbol >= self.width)
        key = state[at].astype(np.int64) // self.width * self.n_symbols + symbol[at]
        place = np.searchsorted(self.rare, key)
        found = place < len(self.rare)
        found[found] = self.rare[place[found]] == key[found]
        move = self.root[symbol[at]]
        move[found] = self.rare_to[place[found]]
        out[at] = move
        return out


class Model:
    """Automata of all languages and what parsing needs."""

    def __init__(self, texts: dict[str, list[str]]) -> None:
        count: dict[str, int] = {}
        for parts in texts.values():
            for c in "".join(parts).lower():
                if c.isalpha():
                    count[c] = count.get(c, 0) + 1
        self.letters = "".join(sorted(count, key=lambda c: (-count[c], c)))
        alphabet = Alphabet(self.letters)
        self.langs, self.bits, moves = [], [], []
        for lang in sorted(texts):
            seq: list[int] = []
            for part in texts[lang]:
                s = merged(alphabet.symbols(part), np.zeros(1, np.int64))[0]
                seq += [0, *s.tolist()]
            if any(seq):
                self.langs.append(lang)
                self.bits.append(math.log2(len(seq)))
                moves.append(suffix_automaton(seq))
        n_symbols = len(self.letters) + 2
        width = max(2, min(n_symbols, DENSE // max(1, sum(map(len, moves)))))
        self.automata = [Automaton(m, width, n_symbols) for m in moves]


def merged(symbols: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs of separators become one; none at the start of a text. Returns the symbols and the new starts."""
    before = np.empty_like(symbols)
    before[1:] = symbols[:-1]
    if len(symbols):
        before[0] = 0
        inner = starts[starts < len(symbols)]
        before[inner] = 0
    keep = (symbols != 0) | (before != 0)
    upto = np.concatenate([[0], np.cumsum(keep)])
    return symbols[keep], upto[starts]


def phrases(symbols: np.ndarray, starts: np.ndarray, auto: Automaton) -> np.ndarray:
    """Phrases that each text needs; text i is symbols[starts[i]:starts[i + 1]].

    Texts are cut into lanes, all parsed side by side from the first state. Then each lane but a text's first is entered
    again in the state in which the lane before it ends, up to where it is in the state that it had there before: from
    then on both agree. A lane that never agrees ends in another state, so the next one is entered once more.
    """
    n_docs = len(starts) - 1
    lengths = np.diff(starts)
    lanes = -(-lengths // LANE)
    doc = np.repeat(np.arange(n_docs), lanes)
    nth = np.arange(len(doc)) - np.repeat(np.cumsum(lanes) - lanes, lanes)
    at = starts[:-1][doc] + nth * LANE
    size = np.minimum(lengths[doc] - nth * LANE, LANE)
    rare = bool((symbols >= auto.width).any())
    steps = int(size.max(initial=0))
    # Lanes of more than one to a text remember all their states and how many phrases began by then.
    keep = lanes[doc] > 1
    slot = np.cumsum(keep) - 1
    states = np.zeros((steps if keep.any() else 0, int(keep.sum())), auto.dense.dtype)
    begun_by = np.zeros(states.shape, np.int16)
    order = np.argsort(-size, kind="stable")
    active = np.searchsorted(-size[order], -np.arange(1, steps + 1), side="right")
    at_o, state, begun = at[order], np.full(len(doc), auto.first, auto.dense.dtype), np.zeros(len(doc), np.int32)
    kept_o = np.flatnonzero(keep[order])
    slot_o = slot[order][kept_o]
    for t in range(steps):
        a = active[t]
        move = auto.step(state[:a], symbols[at_o[:a] + t], rare)
        begun[:a] += move & 1
        state[:a] = move >> 1
        if len(kept_o):
            k = np.searchsorted(kept_o, a)
            states[t, slot_o[:k]], begun_by[t, slot_o[:k]] = state[kept_o[:k]], begun[kept_o[:k]]
    end, count = np.empty_like(state), np.empty_like(begun)
    end[order], count[order] = state, begun
    enter = np.full_like(end, auto.first)
    todo = np.flatnonzero(nth > 0)
    while len(todo):
        todo = todo[end[todo - 1] != enter[todo]]
        enter[todo] = end[todo - 1]
        live, now, fresh = todo, enter[todo].copy(), np.zeros(len(todo), np.int32)
        changed = []
        for t in range(steps):
            over = size[live] == t
            if over.any():
                # Never in a state of before: the lane's end is a new one.
                count[live[over]] = fresh[over]
                changed.append(live[over][end[live[over]] != now[over]])
                end[live[over]] = now[over]
                live, now, fresh = live[~over], now[~over], fresh[~over]
            if not len(live):
                break
            move = auto.step(now, symbols[at[live] + t], rare)
            fresh, now = fresh + (move & 1), move >> 1
            # A lane that was entered before agrees with its first run only, so its end is that of the first run again.
            same = states[t, slot[live]] == now
            if same.any():
                met, last = live[same], states[size[live[same]] - 1, slot[live[same]]]
                count[met] = fresh[same] + begun_by[size[met] - 1, slot[met]] - begun_by[t, slot[met]]
                changed.append(met[end[met] != last])
                end[met] = last
                live, now, fresh = live[~same], now[~same], fresh[~same]
        if len(live):
            count[live] = fresh
            changed.append(live[end[live] != now])
            end[live] = now
        moved = np.concatenate([*changed, np.zeros(0, np.int64)]).astype(np.int64) + 1
        moved = moved[moved < len(doc)]
        todo = np.unique(moved[nth[moved] > 0])
    return np.bincount(doc, weights=count, minlength=n_docs)


def score_texts(texts: pa.Array, model: Model, alphabet: Alphabet) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each text: index of the best language (-1: und), score, bits a symbol, symbols."""
    n = len(texts)
    best, score, rate, size = np.full(n, -1), np.zeros(n), np.zeros(n), np.zeros(n, np.int64)
    lengths = pc.fill_null(pc.utf8_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    upto = np.cumsum(lengths)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(upto, (upto[lo - 1] if lo else 0) + CODE_POINTS, side="right")))
        raw = "".join(x or "" for x in texts[lo:hi].to_pylist())
        bits = np.zeros((max(1, len(model.langs)), hi - lo))
        starts = np.concatenate([[0], np.cumsum(lengths[lo:hi])])
        symbols = np.zeros(hi - lo, np.int64)
        letters = np.zeros(hi - lo, np.int64)
        # Only a single text is longer than CODE_POINTS; it is read piece by piece from its start.
        for p in range(0, max(1, len(raw)), CODE_POINTS):
            part = alphabet.symbols(raw[p : p + CODE_POINTS])
            s, new = merged(part, np.minimum(np.maximum(starts - p, 0), len(part)))
            symbols += np.diff(new)
            letters += np.diff(np.concatenate([[0], np.cumsum(s != 0)])[new])
            for i, auto in enumerate(model.automata):
                bits[i] += phrases(s, new, auto) * model.bits[i]
        if model.langs:
            win = bits.argmin(axis=0)
            top = bits.min(axis=0)
            share = 1 / (2.0 ** (-np.minimum(bits - top, 800) / 8)).sum(axis=0)
            ok = letters > 0
            best[lo:hi] = np.where(ok, win, -1)
            score[lo:hi] = np.where(ok, share, 0)
            rate[lo:hi] = top / np.maximum(symbols, 1)
        size[lo:hi] = symbols
        lo = hi
    return best, score, rate, size


def fit(docs: DataFrame, usable: Column | None = None) -> Model:
    """Learns from text and non-null lang of the rows that ``usable`` admits. The driver gets TRAIN_ROWS texts, or one
    a language where there are more languages, of TRAIN_CHARS code points in all."""
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    rows = rows.where(usable) if usable is not None else rows
    rows = rows.select(long_id(rows), "lang", "text").withColumn("digest", F.xxhash64("text"))
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id", "digest"), "doc_id", "digest")
    keys = rows.select("doc_id", "lang", "digest", F.length("text").cast("long").alias("n"))
    some = keys.select("doc_id", "lang", "digest", "n", F.dense_rank().over(order).alias("rank")).where(F.col("rank") <= TRAIN_DOCS)
    # TRAIN_DOCS ids a language
    some = written(some.distinct(), "sample")
    n_langs = some.select("lang").distinct().count()
    some = some.where(F.col("rank") <= max(1, TRAIN_ROWS // max(1, n_langs)))
    part = max(1, TRAIN_CHARS // max(1, n_langs))
    before = F.sum("n").over(Window.partitionBy("lang").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1))
    some = some.withColumn("room", F.lit(part) - F.coalesce(before, F.lit(0))).where("room > 0")
    same = rows["doc_id"].eqNullSafe(some["doc_id"]) & (rows["lang"] == some["lang"]) & (rows["digest"] == some["digest"])
    picked = rows.join(F.broadcast(some), same).groupBy(some["lang"], "rank").agg(F.min(F.substring(F.col("text"), F.lit(1), F.col("room").cast("int"))).alias("text"))
    texts: dict[str, list[tuple]] = {}
    for r in picked.collect():
        texts.setdefault(r.lang, []).append((r["rank"], r.text))
    return Model({lang: [t for _, t in sorted(parts)] for lang, parts in texts.items()})


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score, bits (a symbol, of the best language), n_symbols for every document."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = "doc_id bigint, lang_pred string, score double, bits double, n_symbols bigint"

    def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        alphabet = None
        for b in batches:
            m = shared.value
            alphabet = alphabet or Alphabet(m.letters)
            best, score, bits, size = score_texts(b.column("text"), m, alphabet)
            names = np.array([*m.langs, "und"], dtype=object)
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(names[best], pa.string()), pa.array(score), pa.array(bits), pa.array(size)],
                names=["doc_id", "lang_pred", "score", "bits", "n_symbols"],
            )

    return docs.select(long_id(docs), "text").mapInArrow(of_batches, schema)


def held_out() -> Column:
    return F.crc32(F.col("doc_id").cast("string")) % 3 == 1


def op1_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = fit(docs, ~held_out())
    return identify(docs, model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "bits", "n_symbols")


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents in none of the languages learned go (no letters, or explained by no language).

    Where no language could be learned, only documents without letters go. Rows
    are judged one by one, so null and repeated ids make no difference; an empty
    table stays empty; other columns pass through, whatever their names.
    """
    small_batches(spark)
    model = fit(docs, ~held_out())
    shared = spark.sparkContext.broadcast(model)

    def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        alphabet = None
        for b in batches:
            alphabet = alphabet or Alphabet(shared.value.letters)
            best, _, bits, size = score_texts(b.column("text"), shared.value, alphabet)
            # A text without letters has no symbols.
            rate = (bits * size + PRIOR_BITS * PRIOR_SYMBOLS) / (size + PRIOR_SYMBOLS)
            known = (best >= 0) & (rate <= REJECT_BITS) if shared.value.langs else size > 0
            yield b.filter(pa.array(known))

    return docs.mapInArrow(of_batches, docs.schema)
