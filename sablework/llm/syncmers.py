"""Operator 9: document fingerprints from closed syncmers.

A k-mer (of words) is chosen when the smallest of its inner s-mers, by hash, is
its first or its last one. The choice depends on the k-mer alone, so a text's
anchors survive edits elsewhere and match by position between versions: a
fingerprint lists, in the order of the text, each anchor and the distance to the
next one. Likeness is the Jaccard similarity of anchors and of anchors with their
distances, taken together; 1 for two empty fingerprints.

K and S are the same for all lengths, so versions of any lengths can meet. Two
empty words stand before and after a text, so a text of one word has a k-mer.
The LEAST smallest s-mers by hash are anchors too (distance 0, at the end); a text
of which no k-mer is chosen has all its s-mers, and so meets a version that has chosen ones.

A text that is one word, and any word of more than LONG_WORD code points, is
read as words of one code point. Null text counts as empty and gives the empty
fingerprint, which no other text has (white space alone is one anchor); equal texts
have equal fingerprints; very long texts are read whole. Repeated ids: the next
document is the one with the next smaller distinct id, of its texts the
smallest. An empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, long_id, text_or_empty, written

#: Words in a k-mer and in an inner s-mer: K - S + 1 = 4 s-mers a k-mer, so about half of all k-mers are chosen.
K, S = 5, 2
LEAST, LONG_WORD = 3, 24
IDS_PER_BUCKET = 50_000
#: Ids in a group whose texts meet in one window; with gaps of any size a group has at most CROWD times as many.
GROUP, CROWD = 128, 8
#: So many narrow rows are broadcast at most.
FEW = 200_000
#: A place is an anchor times FAR plus the distance, which counts up to FAR - 1.
FAR = 1 << 7
#: The white space that parts words.
SPACE = " \t\n\x0b\x0c\r"


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def words_of(text: Column) -> Column:
    nothing = F.array().cast("array<string>")
    return let(F.btrim(text, F.lit(SPACE)), lambda t: F.when(t == "", nothing).otherwise(F.split(t, r"[\x20\x09-\x0D]+")))


def smers(words: Column, s: int) -> Column:
    return F.transform(F.slice(words, 1, F.size(words) - (s - 1)), lambda w, i: F.hash(w, *[words[i + j] for j in range(1, s)]))


def starts(m: Column, span: int) -> Column:
    """Where the closed syncmers among k-mers of ``span`` s-mers begin, from the hashes of all s-mers."""
    edges = lambda i: F.least(m[i], m[i + (span - 1)])
    inner = lambda i: F.least(*[m[i + j] for j in range(1, span - 1)])
    return F.filter(F.sequence(F.lit(0), F.size(m) - span), lambda i: edges(i) <= inner(i))


def anchor(m: Column, i: Column, span: int) -> Column:
    # With K and S these four are all s-mers of the k-mer, so every word counts.
    return F.hash(m[i], m[i + span // 3], m[i + 2 * span // 3], m[i + (span - 1)])


def closed_syncmers(text: Column, k: int, s: int) -> Column:
    """Sorted distinct 32-bit anchors of the closed syncmers of a text (array<int>), by SQL functions only."""
    span, nothing = k - s + 1, F.array().cast("array<int>")
    chosen = lambda m: F.transform(starts(m, span), lambda i: anchor(m, i, span))
    of_words = lambda w: F.when(F.size(w) >= k, let(smers(w, s), chosen)).otherwise(nothing)
    return F.array_sort(F.array_distinct(let(words_of(text), of_words)))


def syncmers(text: Column) -> Column:
    """The fingerprint of a text as places (array<bigint>): in the order of the text, anchors with distances."""
    pad = F.array(*[F.lit("")] * (K // 2))
    span = K - S + 1

    def units(w: Column) -> Column:
        long = lambda x: F.length(x) > LONG_WORD
        parts = F.flatten(F.transform(w, lambda x: F.when(long(x) | (F.size(w) == 1), F.split(x, "")).otherwise(F.array(x))))
        return F.concat(pad, F.when((F.size(w) == 1) | F.exists(w, long), parts).otherwise(w), pad)

    def places(m: Column, at: Column) -> Column:
        gap = lambda i, j: F.when(j + 1 < F.size(at), F.least(at[j + 1] - i, F.lit(FAR - 1))).otherwise(0)
        return F.transform(at, lambda i, j: anchor(m, i, span).cast("long") * FAR + gap(i, j))

    def of_smers(m: Column) -> Column:
        # Without the s-mers of empty words alone.
        own = F.slice(m, K // 2 - S + 2, F.size(m) - 2 * (K // 2 - S + 1))
        bare = lambda some: F.transform(some, lambda x: x.cast("long") * FAR)
        # sort_array() compares plain values; array_sort() would call an interpreted comparison for each pair.
        least = F.slice(F.sort_array(F.array_distinct(own)), 1, LEAST)
        return let(starts(m, span), lambda at: F.when(F.size(at) > 0, F.concat(places(m, at), bare(least))).otherwise(bare(own)))

    def of_words(w: Column) -> Column:
        found = let(units(w), lambda u: let(smers(u, S), of_smers))
        nothing = F.when(text == "", F.array().cast("array<bigint>")).otherwise(F.array(F.hash(text).cast("long") * FAR))
        return F.when(F.size(w) > 0, found).otherwise(nothing)

    return let(words_of(text), of_words)


def anchors(places: Column) -> Column:
    return F.transform(places, lambda x: F.shiftright(x, 7))


def likeness(a: Column, b: Column) -> Column:
    """Of two fingerprints: the share of anchors, and of anchors with distances, that both have."""
    p, q = anchors(a), anchors(b)
    both = F.size(F.array_intersect(a, b)) + F.size(F.array_intersect(p, q))
    either = F.size(F.array_union(a, b)) + F.size(F.array_union(p, q))
    return F.when(either == 0, F.lit(1.0)).otherwise(both / either)


def as_text(places: Column) -> Column:
    """Each place as eight hexadecimal digits of the anchor and two of the distance."""
    digits = lambda x: F.shiftleft(F.shiftright(x, 7), 8) + x.bitwiseAND(FAR - 1)
    return F.array_join(F.transform(places, lambda x: F.right(F.concat(F.lit("0" * 10), F.lower(F.hex(digits(x)))), F.lit(10))), " ")


def next_ids(ids: DataFrame) -> DataFrame:
    """doc_id and next_id, the next smaller distinct id (after the smallest: the largest).

    Ids fall into ranges of about IDS_PER_BUCKET ids; inside a range a window
    finds the next one, between ranges the (small) table of ranges does.
    """
    ids = ids.select("doc_id").where(F.col("doc_id").isNotNull()).distinct()
    n = ids.count()
    parts = max(1, -(-n // IDS_PER_BUCKET))
    # Ranges are dealt once and written: the two uses below must see the same ones.
    dealt = written(ids.repartitionByRange(parts, "doc_id").withColumn("bucket", F.spark_partition_id()), "ranges")
    ends = dealt.groupBy("bucket").agg(F.max("doc_id").alias("top"))
    order = Window.orderBy(F.col("top").desc())
    everywhere = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    after = ends.select("bucket", F.coalesce(F.lead("top").over(order), F.max("top").over(everywhere)).alias("next_top"))
    inside = Window.partitionBy("bucket").orderBy(F.col("doc_id").desc())
    return dealt.withColumn("inner_next", F.lead("doc_id").over(inside)).join(after, "bucket").select(
        "doc_id", F.coalesce("inner_next", "next_top").alias("next_id")
    )


def in_group(span: int) -> Column:
    """Neighbouring ids share a group, of fewer than 2 * span different ones."""
    return F.expr(f"doc_id div {span}L")


def beside_next(known: DataFrame, n: int, least: int, most: int) -> DataFrame:
    """doc_id, text, places, next (text and places of the next document), for ``n`` rows with different ids.

    Texts are dealt out once, by group of ids; behind that exchange anchors are taken, once a text, and a window finds
    the next document. The first document of each group is a guest in the group whose last one comes before it.
    """
    span = GROUP * max(1, (most - least + 1) // n)
    # Where ids lie in clumps, a width that fits the whole range would put a clump into one group.
    if span > GROUP and known.groupBy(in_group(span).alias("group")).count().agg(F.max("count")).first()[0] > CROWD * GROUP:
        span = GROUP
    tops = known.groupBy(in_group(span).alias("group")).agg(F.max("doc_id").alias("doc_id"))
    visits = written(next_ids(tops).select(F.col("next_id").alias("doc_id"), in_group(span).alias("host")), "visits")
    visits = F.broadcast(visits) if visits.count() <= FEW else visits
    place = lambda group, guest: F.struct(group.alias("group"), F.lit(guest).alias("guest"))
    own, visit = place(in_group(span), False), place(F.col("host"), True)
    both = F.when(F.col("host").isNull(), F.array(own)).otherwise(F.array(own, visit))
    rows = known.join(visits, "doc_id", "left").select("doc_id", "text", F.explode(both).alias("at"))
    order = "guest", F.col("doc_id").desc()
    # Sorted before anchors are taken, so a task's sort holds texts alone.
    rows = rows.select("doc_id", "text", "at.*").repartition("group").sortWithinPartitions("group", *order)
    beside = F.lead(F.struct("text", "places")).over(Window.partitionBy("group").orderBy(*order))
    return rows.withColumn("places", syncmers(F.col("text"))).withColumn("next", beside).where("not guest").select("doc_id", "text", "places", "next")


def beside_next_by_join(known: DataFrame, share: int) -> DataFrame:
    """The same where ids repeat, so any number of rows may share one: the next text is the smallest of its id, as far as it is needed."""
    asks = known.groupBy("doc_id").agg(F.max((F.length("text") / share).cast("int")).alias("want"))
    asks = next_ids(known).join(asks, "doc_id").select(F.col("doc_id").alias("asker"), F.col("next_id").alias("doc_id"), "want")
    given = known.join(asks, "doc_id").select(
        F.col("asker").alias("doc_id"), F.struct(F.expr("left(text, want)").alias("text"), syncmers(F.col("text")).alias("places")).alias("next")
    )
    given = given.groupBy("doc_id").agg(F.min("next").alias("next"))
    return known.join(given, "doc_id").select("doc_id", "text", syncmers(F.col("text")).alias("places"), "next")


def edited_fingerprints(docs: DataFrame, share: int = 3) -> DataFrame:
    """Every document beside its edited text: the last floor(n / share) code points give way to as many first ones of
    the next document (descending doc_id). Columns: doc_id, text, edited, anchors, edited_anchors, next_anchors.
    """
    base = docs.select(long_id(docs), text_or_empty().alias("text"))
    known = base.where(F.col("doc_id").isNotNull())
    n, ids, least, most = known.agg(F.count("doc_id"), F.countDistinct("doc_id"), F.min("doc_id"), F.max("doc_id")).first()
    pairs = beside_next(known, n, least, most) if n and n == ids else beside_next_by_join(known, share)
    nothing = F.struct(F.lit("").alias("text"), F.array().cast("array<bigint>").alias("places"))
    alone = base.where(F.col("doc_id").isNull()).withColumn("places", syncmers(F.col("text"))).withColumn("next", nothing)
    n_cut = (F.length("text") / share).cast("int")
    edited = F.concat(F.left("text", F.length("text") - n_cut), F.left(F.col("next.text"), n_cut))
    return pairs.unionByName(alone).withColumn("edited", edited).select(
        "doc_id", "text", "edited", F.col("places").alias("anchors"), syncmers(F.col("edited")).alias("edited_anchors"), F.col("next.places").alias("next_anchors")
    )


def op9_syncmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = edited_fingerprints(documents(spark, sf_dir))
    return out.select(
        "doc_id",
        F.length("text").cast("long").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        as_text(F.col("anchors")).alias("fingerprint"),
        as_text(F.col("edited_anchors")).alias("edited_fingerprint"),
        likeness(F.col("anchors"), F.col("edited_anchors")).alias("near_edited"),
        likeness(F.col("anchors"), F.col("next_anchors")).alias("near_next"),
    )
