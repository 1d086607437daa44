"""Operator 7: near-duplicates by MinHash with sequential Bayesian verification.

A document's set holds its distinct two-word shingles. Documents
with equal sets (by a SHA-256 of their content) form one class, which its row with the smallest id stands for. Classes that
share one of BANDS bands of ROWS minhashes (of hashed shingles) are candidates: first every member of
a bucket with the bucket's smallest one; after the components of those links are
known, the pairs of a bucket whose components still differ. Candidates compare
their signatures BATCH hashes at a time and fall out once the posterior
probability of a similarity of THRESHOLD or more, from a uniform prior, is below
MISS. All survivors are confirmed on the full sets, whose words are numbered
by their bytes; only confirmed links count.

A pair at the threshold shares no band with probability (1 - 0.8^4)^32 = 5e-8.

Large buckets are split into blocks of BLOCK members and BLOCK_BYTES of text, a
pair of blocks being one unit of work; members of a large star are split into parts of PART. Nothing is
capped. Null text, empty text and white space give an empty set, linked with
nothing; repeated rows share a component; one id on different texts stands for
several documents; a row without doc_id comes after all others, and a component
of such rows alone has a null id; long texts are read whole; ties in a bucket go
by the class's number; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ROW, documents, left_join_groups, located, long_id, small_batches, written
from .rolling import LOWER, U64, mix, slices

BANDS, ROWS = 32, 4
HASHES = BANDS * ROWS
THRESHOLD = (80, 100)
MISS, BATCH = 1e-6, 16
BLOCK, BLOCK_BYTES, PART = 4000, 16_000_000, 500
_rng = np.random.default_rng(7)
_XOR = _rng.integers(0, 2**64, HASHES, dtype=U64)
_MUL = _rng.integers(0, 2**63, HASHES, dtype=U64) * U64(2) + U64(1)
_BAND = _rng.integers(0, 2**64, BANDS, dtype=U64)


def words_of(text: bytes) -> list[bytes]:
    return text.translate(LOWER).split()


def pair_codes(words: list[bytes], number: Callable[[bytes], int]) -> np.ndarray:
    """The distinct shingles of a text as integers, ascending: pairs of its words' numbers, or of a single word -1 - number."""
    codes = np.fromiter(map(number, words), np.int64, len(words))
    return np.unique(codes[:-1] << 32 | codes[1:]) if len(codes) > 1 else -1 - codes


def shingle_sets(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The sets of texts one after the other, and where each starts; equal integers are equal shingles in all of them."""
    numbers: dict[bytes, int] = {}
    sets = [pair_codes(words_of(t), lambda w: numbers.setdefault(w, len(numbers))) for t in texts]
    return np.concatenate([np.zeros(0, np.int64), *sets]), np.concatenate([[0], np.cumsum([len(x) for x in sets])]).astype(np.int64)


def hashed_sets(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """The sets with a 64-bit hash for each shingle, where each set starts, and a SHA-256 of each set's content."""
    hashes: dict[bytes, int] = {}
    sets, keys = [], []
    for t in texts:
        words = words_of(t)
        distinct = sorted(set(words))
        codes = pair_codes(words, {w: i for i, w in enumerate(distinct)}.__getitem__)
        # Words in order and pairs of their ranks: what the set is, whatever the order of the text.
        keys.append(hashlib.sha256(b" ".join(distinct) + b"\n" + codes.tobytes()).digest())
        for w in distinct:
            if w not in hashes:
                hashes[w] = xxhash.xxh3_64_intdigest(w)
        h = np.array([hashes[w] for w in distinct], U64)
        pairs = h[codes >> 32] * U64(0xD6E8FEB86659FD93) + h[codes & 0xFFFFFFFF] if len(words) > 1 else h + U64(1)
        sets.append(mix(pairs))
    return np.concatenate([np.zeros(0, U64), *sets]), np.concatenate([[0], np.cumsum([len(x) for x in sets])]).astype(np.int64), keys


def signatures(value: np.ndarray, at: np.ndarray) -> np.ndarray:
    """HASHES minhashes of 16 bits of each set (rows of zeros for empty sets)."""
    out = np.zeros((len(at) - 1, HASHES), np.uint16)
    full = np.flatnonzero(np.diff(at) > 0)
    if len(full):
        for j in range(HASHES):
            low = np.minimum.reduceat((value ^ _XOR[j]) * _MUL[j], at[full])
            out[full, j] = (mix(low) >> U64(48)).astype(np.uint16)
    return out


def band_keys(signature: np.ndarray) -> np.ndarray:
    """One 64-bit key per band."""
    return mix(np.ascontiguousarray(signature).view(U64) ^ _BAND).view(np.int64)


@cache
def least_matches() -> list[int]:
    """For each batch: how many of the hashes so far must agree for a pair to go on."""
    t = THRESHOLD[0] / THRESHOLD[1]
    grid = (np.arange(20_000) + 0.5) / 20_000
    out = []
    for n in range(BATCH, HASHES + 1, BATCH):
        for m in range(n + 1):
            log = m * np.log(grid) + (n - m) * np.log1p(-grid)
            density = np.exp(log - log.max())
            if density[grid >= t].sum() / density.sum() >= MISS:
                break
        out.append(m)
    return out


def agree(a: np.ndarray, b: np.ndarray, least: list[int]) -> np.ndarray:
    """Whether each pair of signatures (rows) survives the sequential test."""
    alive = np.arange(len(a))
    count = np.zeros(len(a), np.int32)
    for i, need in enumerate(least):
        cols = slice(i * BATCH, (i + 1) * BATCH)
        count[alive] += (a[alive, cols] == b[alive, cols]).sum(axis=1, dtype=np.int32)
        alive = alive[count[alive] >= need]
    out = np.zeros(len(a), bool)
    out[alive] = True
    return out


def sketch(docs: DataFrame) -> DataFrame:
    """doc_id, __file, __row, n_shingles, n_bytes, set_key (SHA-256 of the set's content) and sig (binary) of every document."""
    schema = "doc_id bigint, __file bigint, __row bigint, n_shingles bigint, n_bytes bigint, set_key binary, sig binary"

    def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [(t or "").encode() for t in b.column("text").to_pylist()]
            for lo, hi in slices(texts):
                value, at, key = hashed_sets(texts[lo:hi])
                sig = signatures(value, at)
                n = np.diff(at)
                yield pa.RecordBatch.from_arrays(
                    [
                        *[b.column(c)[lo:hi] for c in ("doc_id", "__file", "__row")],
                        pa.array(n, pa.int64()),
                        pa.array([len(t) for t in texts[lo:hi]], pa.int64()),
                        pa.array([k if m else None for k, m in zip(key, n, strict=True)], pa.binary()),
                        pa.array([s.tobytes() if m else None for s, m in zip(sig, n, strict=True)], pa.binary()),
                    ],
                    names=["doc_id", "__file", "__row", "n_shingles", "n_bytes", "set_key", "sig"],
                )

    return docs.select(long_id(docs), "__file", "__row", "text").mapInArrow(of_batches, schema)


def buckets(classes: DataFrame) -> DataFrame:
    """key, id, n_bytes: members of the buckets with more than one member."""

    def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                sig = np.frombuffer(b"".join(b.column("sig").to_pylist()), np.uint16).reshape(-1, HASHES)
                ids, size = (np.repeat(b.column(c).to_numpy(), BANDS) for c in ("id", "n_bytes"))
                yield pa.RecordBatch.from_arrays([pa.array(band_keys(sig).ravel()), pa.array(ids), pa.array(size)], names=["key", "id", "n_bytes"])

    rows = classes.select("id", "n_bytes", "sig").mapInArrow(of_batches, "key bigint, id bigint, n_bytes bigint")
    shared = rows.groupBy("key").count().where("count > 1").select("key")
    return rows.join(shared, "key", "left_semi")


def survivors(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """The pairs (a, b) whose signatures survive the sequential test."""
    sigs = classes.select(F.col("id"), "sig")
    both = pairs.join(sigs.withColumnsRenamed({"id": "b", "sig": "sig_b"}), "b").join(sigs.withColumnsRenamed({"id": "a", "sig": "sig_a"}), "a")

    least = least_matches()

    def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, y = (np.frombuffer(b"".join(b.column(c).to_pylist()), np.uint16).reshape(-1, HASHES) for c in ("sig_a", "sig_b"))
            yield b.select(["a", "b"]).filter(pa.array(agree(x, y, least)))

    return both.select("a", "b", "sig_a", "sig_b").mapInArrow(of_batches, "a bigint, b bigint")


def confirmed(pairs: DataFrame, bodies: DataFrame) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough. Each set travels once per pair, those of ``a`` once per
    PART pairs of it."""
    # Part numbers come from counts: a star of a million members is a thousand units of work and more.
    heads = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / PART).cast("long").alias("parts"))
    members = pairs.join(heads, "a").select("a", F.pmod(F.xxhash64("b"), F.col("parts")).alias("part"), "b")
    members = members.join(bodies.select(F.col("id").alias("b"), "text"), "b").select("a", "part", "b", "text")
    heads = heads.select("a", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"))
    heads = heads.join(bodies.select(F.col("id").alias("a"), "text"), "a").select("a", "part", F.lit(None).cast("long").alias("b"), "text")
    rows = heads.unionByName(members).repartition("a", "part").sortWithinPartitions("a", "part", F.col("b").asc_nulls_first())
    num, den = THRESHOLD

    def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, numbers = np.zeros(0, np.int64), {}
        for b in batches:
            out = []
            for a, other, text in zip(*(b.column(c).to_pylist() for c in ("a", "b", "text")), strict=True):
                words = words_of((text or "").encode())
                if other is None:
                    numbers = {w: i for i, w in enumerate(dict.fromkeys(words))}
                    head = pair_codes(words, numbers.__getitem__)
                    continue
                # Words that the head hasn't get numbers of this text's own.
                new: dict[bytes, int] = {}
                own = pair_codes(words, lambda w: numbers[w] if w in numbers else new.setdefault(w, len(numbers) + len(new)))  # noqa: B023
                n = len(np.intersect1d(head, own, assume_unique=True))
                if den * n >= num * (len(head) + len(own) - n):
                    out.append((a, other))
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64())], names=["a", "b"])

    return rows.mapInArrow(of_batches, "a bigint, b bigint")


def components(links: DataFrame) -> DataFrame:
    """id, component (its smallest id) of every linked id: labels spread over links and jump to their label's label."""
    both = written(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    labels = written(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("id"), F.least("a", "m").alias("component")), "labels")
    while True:
        of_b = labels.select(F.col("id").alias("b"), F.col("component").alias("c"))
        near = both.join(of_b, "b").groupBy("a").agg(F.min("c").alias("c"))
        step = labels.join(near, labels["id"] == near["a"]).select("id", F.col("component").alias("old"), F.least("component", "c").alias("c"))
        over = labels.select(F.col("id").alias("c"), F.col("component").alias("cc"))
        step = step.join(over, "c").select("id", "old", F.least("c", "cc").alias("component"))
        step = written(step, "labels")
        labels = step.select("id", "component")
        if step.where("component <> old").isEmpty():
            return labels


def overlaps(value: np.ndarray, at: np.ndarray, left: np.ndarray, right: list[np.ndarray]) -> list[np.ndarray]:
    """For each set of ``left`` the sizes of its intersections with its sets of ``right`` (all numbers of sets)."""
    ids = np.unique(value, return_inverse=True)[1]
    size = np.diff(at)
    seen = np.zeros(int(ids.max(initial=0)) + 1, bool)
    out = []
    for x, ys in zip(left, right, strict=True):
        seen[ids[at[x] : at[x + 1]]] = True
        inside = np.concatenate([ids[at[y] : at[y + 1]] for y in ys]) if len(ys) else np.zeros(0, np.int64)
        hits = np.concatenate([[0], np.cumsum(seen[inside])])
        upto = np.concatenate([[0], np.cumsum(size[ys])]).astype(np.int64)
        out.append(np.diff(hits[upto]))
        seen[ids[at[x] : at[x + 1]]] = False
    return out


def cross_links(members: DataFrame, classes: DataFrame, bodies: DataFrame) -> DataFrame:
    """Confirmed links (a, b) between different components of a bucket, a spanning forest of them per unit of work.

    ``members``: key, id, n_bytes, component. Pairs are compared where they stand, so a group of near copies makes no more rows
    than it has members. Each pair belongs to the first band that it shares.
    """
    sizes = members.groupBy("key").agg(
        F.min("component").alias("lo"), F.max("component").alias("hi"), F.count(F.lit(1)).alias("n"), F.min("id").alias("pivot"),
        F.sum("n_bytes").alias("n_bytes"),
    )
    # A bucket's smallest id has met all others already.
    open_ = sizes.where("lo <> hi and n > 2").select(
        "key", "pivot", F.ceil(F.greatest(F.col("n") / BLOCK, F.col("n_bytes") / BLOCK_BYTES)).cast("long").alias("blocks")
    )
    rows = members.drop("n_bytes").join(open_, "key").where("id <> pivot").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")))
    rows = rows.withColumn("with", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    rows = rows.select("key", F.least("block", "with").alias("i"), F.greatest("block", "with").alias("j"), "block", "id", "component")
    rows = rows.join(classes.select("id", "sig"), "id").join(bodies, "id")
    least = least_matches()
    num, den = THRESHOLD

    def of_group(table: pa.Table) -> pa.Table:
        sig = np.frombuffer(b"".join(table.column("sig").to_pylist()), np.uint16).reshape(-1, HASHES)
        ids, comp, block = (table.column(c).to_numpy() for c in ("id", "component", "block"))
        i, j, key = (table.column(c)[0].as_py() for c in ("i", "j", "key"))
        keys = band_keys(sig)
        left, right = np.flatnonzero(block == i), np.flatnonzero(block == j)
        ask, met = [], []
        for x in left:
            y = right[(comp[right] != comp[x]) & (ids[right] > ids[x] if i == j else True)]
            y = y[agree(np.broadcast_to(sig[x], (len(y), HASHES)), sig[y], least)]
            if len(y):
                y = y[keys[x][(keys[y] == keys[x]).argmax(axis=1)] == key]
            if len(y):
                ask.append(x)
                met.append(y)
        links = []
        if ask:
            need = np.unique(np.concatenate([ask, *met]))
            text = table.column("text")
            value, at = shingle_sets([(text[int(x)].as_py() or "").encode() for x in need])
            size = np.diff(at)
            place = {int(x): n for n, x in enumerate(need)}
            spot = [np.searchsorted(need, y) for y in met]
            parent: dict[int, int] = {}

            def root(c: int) -> int:
                while parent.setdefault(c, c) != c:
                    parent[c] = c = parent[parent[c]]
                return c

            for x, y, ys, n in zip(ask, met, spot, overlaps(value, at, np.array([place[int(x)] for x in ask]), spot), strict=True):
                near = den * n >= num * (size[place[int(x)]] + size[ys] - n)
                for z in y[near]:
                    p, q = root(int(comp[x])), root(int(comp[z]))
                    if p != q:
                        parent[p] = q
                        links.append((min(ids[x], ids[z]), max(ids[x], ids[z])))
        return pa.table({"a": pa.array([a for a, _ in links], pa.int64()), "b": pa.array([b for _, b in links], pa.int64())})

    return rows.groupBy("key", "i", "j").applyInArrow(of_group, "a bigint, b bigint")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (the smallest doc_id reachable), kept."""
    return near_duplicates_located(located(docs, **ROW)).select("doc_id", "n_shingles", "component_id", "kept")


def near_duplicates_located(docs: DataFrame) -> DataFrame:
    """The same for documents with ROW, which is kept, and ``stays``: true for one row of each component and for rows
    with empty sets."""
    small_batches(docs.sparkSession)
    sketches = written(sketch(docs), "sketches")
    total = sketches.count()
    # A class goes by a number of its own, as ids may be null or repeated.
    first = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "__file", "__row")
    groups = sketches.where("set_key is not null").groupBy("set_key").agg(F.min(F.struct(first.alias("row"), "n_bytes", "sig")).alias("f"), F.count(F.lit(1)).alias("size"))
    classes = written(
        groups.select("set_key", "size", F.monotonically_increasing_id().alias("id"), F.col("f.row").alias("row"), "f.n_bytes", F.col("f.sig").alias("sig")), "classes"
    )
    members = written(buckets(classes), "buckets")
    wanted = classes.join(members.select("id").distinct(), "id").select("id", F.col("row.__file").alias("__file"), F.col("row.__row").alias("__row"))
    bodies = written(docs.select("__file", "__row", "text").join(wanted, ["__file", "__row"]).select("id", "text"), "bodies")

    stars = members.groupBy("key").agg(F.min("id").alias("a"))
    stars = members.join(stars, "key").where("a < id").select("a", F.col("id").alias("b")).distinct()
    tried = written(survivors(stars, classes), "stars")
    links = written(confirmed(tried, bodies), "star_links")
    labels = components(links)

    known = members.join(labels, "id", "left").withColumn("component", F.coalesce("component", "id"))
    more = written(cross_links(known, classes, bodies), "cross_links")
    if not more.isEmpty():
        labels = components(links.unionByName(more))

    linked = labels.join(classes.select("id", "row"), "id")
    tops = linked.groupBy("component").agg(F.min("row").alias("top"))
    of_linked = linked.join(tops, "component").select("id", "top")
    of_set = classes.join(of_linked, "id", "left").select("set_key", "size", F.coalesce("top", "row").alias("top"))
    out = left_join_groups(sketches.select("doc_id", "__file", "__row", "n_shingles", "set_key"), of_set, "set_key", "size", total)
    out = out.withColumn("component_id", F.when(F.col("top").isNull(), F.col("doc_id")).otherwise(F.col("top.doc_id")))
    stays = F.col("top").isNull() | ((F.col("__file") == F.col("top.__file")) & (F.col("__row") == F.col("top.__row")))
    kept = F.col("doc_id").eqNullSafe(F.col("component_id"))
    return out.select("doc_id", "__file", "__row", "n_shingles", "component_id", kept.alias("kept"), stays.alias("stays"))


def op7_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir))


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of each group of near-duplicates one row stays, with the smallest doc_id.

    Rows are told apart by file and row, so one id on different texts loses none
    of them, and rows without id or repeated rows are grouped like others; those
    with empty sets all stay. An empty table stays empty; other columns pass
    through, whatever their names.
    """
    docs = located(docs, **ROW)
    gone = near_duplicates_located(docs).where(~F.col("stays")).select(*ROW)
    return docs.join(gone, [*ROW], "left_anti").drop(*ROW)
