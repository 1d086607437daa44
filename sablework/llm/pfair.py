"""Operator 4: mixing sources to target weights by Pfair scheduling.

Every source is a stream of blocks of BLOCK_BYTES bytes of text. With a target
weight w, block j (from 0) may run from slot floor(j / w) on and is due before
slot ceil((j + 1) / w). One block runs per slot; of the released blocks the one
with the earliest deadline goes first (ties: the smaller source name). In each
prefix of t slots a source then has w * t blocks, give or take less than one.

Weights are taken as they are, for any number of sources. When a source runs
out, the others go on with their weights rescaled to one in all: windows are
those of the even flow in which every source gets its share of each slot until
it is used up, so a source is always less than one block off that flow, and
every block has a slot.

The schedule is a table of stretches of STRETCH_SLOTS slots, each one SQL
expression; all of them run at once, and those that don't fit the one before run
again (see plan_table). The driver only holds one row per source.

Documents keep their text whole: a document belongs to the blocks that its
bytes fall into, in the order of a hash of its id. ``slot`` is the place of its
first block, ``selected`` tells whether its last block lies before the horizon,
the slot at which the first source runs out: up to there the mixture has the
target weights. Null source is a source of its own (''), null text has no
bytes; very long texts span many blocks; ties in the order go by id; repeated
rows are rows of their own; an empty table gives an empty result; other columns
are ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, text_or_empty, written

BLOCK_BYTES = 4096
#: Default target weights: a source's share of all bytes to this power, scaled to one in all.
TEMPER = 0.9
ROWS_PER_RANGE, RANGES_PER_GROUP = 2000, 1000
#: Slots that one row of the plan's table runs through, and slots ahead of them from which it starts.
STRETCH_SLOTS, WARM_UP_SLOTS = 512, 256
#: Ends of the flow this near a whole slot count as there; far above the error of doubles.
NEAR = 1e-6


def natural_weights(sizes: DataFrame, temper: float = TEMPER) -> DataFrame:
    """source, weight: shares of bytes, flattened so that small sources weigh a little more than they have."""
    return sizes.where("n_bytes > 0").select("source", F.pow(F.col("n_bytes").cast("double"), F.lit(temper)).alias("weight"))


def source_offsets(docs: DataFrame) -> DataFrame:
    """doc_id, source, n_bytes, before: the bytes of the source ahead of this document, in hash order.

    A source may hold a third of all rows, so the running sum has three levels: inside ranges of hashes of about
    ROWS_PER_RANGE rows, over the RANGES_PER_GROUP ranges of a group, and over the groups.
    """
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source"),
        F.octet_length(text_or_empty()).cast("long").alias("n_bytes"),
    )
    rows = rows.withColumn("h", F.xxhash64("doc_id", "source", "n_bytes"))
    ranges = max(1, -(-docs.count() // ROWS_PER_RANGE))
    rows = rows.withColumn("range", F.floor((F.shiftrightunsigned("h", 1) / float(2**63)) * ranges).cast("long"))
    ahead = lambda *by: Window.partitionBy(*by[:-1]).orderBy(by[-1]).rowsBetween(Window.unboundedPreceding, -1)
    upto = lambda column, window: F.coalesce(F.sum(column).over(window), F.lit(0))
    sums = rows.groupBy("source", "range").agg(F.sum("n_bytes").alias("sum_bytes")).withColumn("group", F.floor(F.col("range") / RANGES_PER_GROUP).cast("long"))
    groups = sums.groupBy("source", "group").agg(F.sum("sum_bytes").alias("group_bytes"))
    groups = groups.select("source", "group", upto("group_bytes", ahead("source", "group")).alias("group_base"))
    sums = sums.withColumn("range_base", upto("sum_bytes", ahead("source", "group", "range"))).join(groups, ["source", "group"])
    sums = sums.select("source", "range", (F.col("group_base") + F.col("range_base")).alias("base"))
    inner = Window.partitionBy("source", "range").orderBy("h", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("inner_bytes", upto("n_bytes", inner))
    return rows.join(sums, ["source", "range"]).select("doc_id", "source", "n_bytes", (F.col("base") + F.col("inner_bytes")).alias("before"))


@dataclass(frozen=True)
class Flow:
    """The even flow: each source gets its share of every slot until it is used up, then the others share its part.

    Time is that of an endless source of weight one. Between two ends ``at[k]`` is ``slot[k]``, and slots go by at ``rate[k]``.
    """

    weights: list[float]
    blocks: list[int]
    at: list[float]
    slot: list[float]
    rate: list[float]

    @staticmethod
    def of(weights: list[float], blocks: list[int]) -> Flow:
        order = sorted(range(len(weights)), key=lambda i: blocks[i] / weights[i])
        left = [0.0] * (len(order) + 1)  # weights still flowing, summed from the end
        for k in range(len(order) - 1, -1, -1):
            left[k] = left[k + 1] + weights[order[k]]
        at, slot = [0.0], [0.0]
        for k, i in enumerate(order):
            end = blocks[i] / weights[i]
            slot.append(slot[-1] + (end - at[-1]) * left[k])
            at.append(end)
        return Flow(weights, blocks, at, slot, left)

    def with_columns(self, df: DataFrame) -> DataFrame:
        return df.withColumns({"w": F.lit(self.weights), "n": F.lit(self.blocks).cast("array<bigint>"), "at": F.lit(self.at), "slot": F.lit(self.slot), "rate": F.lit(self.rate)})


def let(name: str, value: str, body: str) -> str:
    """SQL of ``body`` with ``name`` for a value that is computed once."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def slot_of(time: str) -> str:
    """SQL: the slot (with a fraction) that the flow reaches at a time."""
    return let("x", time, let("k", "greatest(size(filter(at, a -> a <= x)) - 1, 0)", "slot[k] + (x - at[k]) * rate[k]"))


#: SQL of block ``j`` of source ``i``: its window, null where the source has no such block.
WINDOW_OF = f"""named_struct('j', j, 'release', if(j < n[i], cast(floor({slot_of("j / w[i]")} + {NEAR}) as bigint), null),
  'deadline', if(j < n[i], cast(ceil({slot_of("(j + 1) / w[i]")} - {NEAR}) as bigint), null))"""
#: SQL of the next block of every source, from ``had``: how many blocks each of them has had.
HEADS = f"transform(had, (h, i) -> {let('j', 'h', WINDOW_OF)})"


def steps(heads: str, slots: str, log: bool) -> str:
    """SQL: earliest deadline first over ``slots`` (an array), from the sources' next blocks; ties: the smaller source.
    A block that isn't released waits, unless rounding leaves no other. Gives q (next blocks) and, on demand, the log."""
    ready = """array_min(filter(transform(s.q, (x, i) -> if(x.deadline is null, null, named_struct(
        'early', x.release > t, 'deadline', x.deadline, 'i', i, 'j', x.j, 'release', x.release))), c -> c is not null))"""
    after = let("i", "p.i", let("j", "p.j + 1", WINDOW_OF))
    kind = "array<struct<i:int,k:bigint,release:bigint,deadline:bigint>>"
    entry = f"concat(s.log, cast(array(named_struct('i', p.i, 'k', p.j, 'release', p.release, 'deadline', p.deadline)) as {kind}))" if log else "s.log"
    step = let("p", ready, f"named_struct('q', transform(s.q, (x, y) -> if(y = p.i, {after}, x)), 'log', {entry})")
    q = "array<struct<j:bigint,release:bigint,deadline:bigint>>"
    cast = f"struct<q:{q},log:{kind}>"
    return f"aggregate({slots}, cast(named_struct('q', {heads}, 'log', array()) as {cast}), (s, t) -> cast({step} as {cast}))"


def likely_state(df: DataFrame) -> DataFrame:
    """``had`` at slot ``t``: what is due by then, and of what is released the blocks with the earliest deadlines, as
    many as there were slots for. Any valid schedule has had one of these two numbers of each source."""
    now = f"(at[k] + (t - slot[k]) / if(rate[k] > 0, rate[k], 1D))"
    # What a lambda uses is bound outside of it by let(): the optimizer would move a plain column into the lambda.
    now = let("k", "greatest(size(filter(slot, a -> a <= t)) - 1, 0)", now)
    df = df.withColumn("had", F.expr(let("now", now, f"transform(w, (v, i) -> least(n[i], cast(floor(v * now + {NEAR}) as bigint)))")))
    df = df.withColumn("open", F.expr(f"transform({HEADS}, (x, i) -> named_struct('deadline', x.deadline, 'i', i, 'release', x.release))"))
    df = df.withColumn("open", F.expr("filter(open, x -> x.deadline is not null and x.release < t)"))
    ahead = "transform(slice(array_sort(open), 1, greatest(0, cast(t - aggregate(had, 0L, (a, h) -> a + h) as int))), x -> x.i)"
    return df.withColumn("had", F.expr(let("ahead", ahead, "transform(had, (h, i) -> if(array_contains(ahead, i), h + 1, h))")))


STRETCH = "c bigint, start array<bigint>, stop array<bigint>, log array<struct<i:int,k:bigint,release:bigint,deadline:bigint>>"


def run_stretches(df: DataFrame, total: int, stretch: int) -> DataFrame:
    """The schedule of stretches ``c`` of slots, from ``had`` at their first slot."""
    df = df.withColumn("t0", F.col("c") * stretch).withColumn("t1", F.least(F.col("t0") + stretch, F.lit(total)))
    df = df.withColumn("start", F.col("had")).withColumn("run", F.expr(steps(HEADS, "sequence(t0, t1 - 1)", log=True)))
    return df.select("c", "start", F.expr("transform(run.q, x -> x.j)").alias("stop"), F.col("run.log").alias("log"))


def plan_table(spark: SparkSession, weights: list[float], blocks: list[int], stretch: int = STRETCH_SLOTS, warm_up: int = WARM_UP_SLOTS) -> DataFrame:
    """i, k, place, release, deadline: one row per slot.

    All stretches of slots run at once, each from a likely state some slots ahead of it. A stretch that doesn't begin
    where the one before it ends runs again from there, until all fit: then they are the one schedule that a run slot
    by slot would give. The first r stretches are final after round r at the latest; in fact two or three rounds do.
    """
    total = sum(blocks)
    if not total:
        return spark.createDataFrame([], "i int, k bigint, place bigint, release bigint, deadline bigint")
    flow = Flow.of(weights, blocks)
    n = -(-total // stretch)
    first = flow.with_columns(spark.range(n).select(F.col("id").alias("c")).repartition(max(1, min(n // 8, 2000)), "c"))
    first = first.withColumn("t0", F.col("c") * stretch).withColumn("t", F.greatest(F.col("t0") - warm_up, F.lit(0).cast("bigint")))
    first = likely_state(first)
    warm = F.expr(f"if(t < t0, transform({steps(HEADS, 'sequence(t, t0 - 1)', log=False)}.q, x -> x.j), had)")
    done = written(run_stretches(first.withColumn("had", warm), total, stretch), "stretches")
    while True:
        ends = done.select((F.col("c") + 1).alias("c"), F.col("stop").alias("had"))
        again = written(done.select("c", "start").join(ends, "c").where("start <> had").select("c", "had"), "again")
        if again.isEmpty():
            break
        more = run_stretches(flow.with_columns(again), total, stretch)
        done = written(done.join(again, "c", "left_anti").unionByName(more), "stretches")
    rows = done.select("c", F.posexplode("log").alias("p", "e"))
    return rows.select("e.i", "e.k", (F.col("c") * stretch + F.col("p")).alias("place"), "e.release", "e.deadline")


def pfair_mix(docs: DataFrame, weights: DataFrame | None = None, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per document: doc_id, source, n_bytes, weight, block, release, deadline, slot, last_slot, selected.

    ``weights`` has source and weight (above 0, any scale) for the sources to
    mix; a source without a weight gets no slot (null) and isn't selected.
    Default: natural_weights().
    """
    spark = docs.sparkSession
    placed = written(source_offsets(docs), "offsets")
    sizes = placed.groupBy("source").agg(F.sum("n_bytes").alias("n_bytes"))
    weights = (natural_weights(sizes) if weights is None else weights).where("weight > 0")
    # One row per source.
    found = sorted((r.source, float(r.weight), r.n_bytes) for r in weights.join(sizes, "source", "left").collect())
    total = math.fsum(w for _, w, _ in found)
    # A source of empty texts only has one (empty) block.
    blocks = [0 if n is None else max(1, -(-n // block_bytes)) for _, _, n in found]
    quota = [(i, name, w / total) for i, (name, w, _) in enumerate(found)]
    present = [i for i, n in enumerate(blocks) if n]
    horizon = min((math.floor(n / w + NEAR) for (_, _, w), n in zip(quota, blocks, strict=True)), default=0)
    # A given source without documents has run out before the first slot; the others share its part.
    share = math.fsum(quota[i][2] for i in present)
    plan = plan_table(spark, [quota[i][2] / share for i in present], [blocks[i] for i in present])
    known = spark.createDataFrame(
        [(quota[i][1], quota[i][2], at, blocks[i]) for at, i in enumerate(present)], "source string, weight double, i int, n_blocks bigint"
    )

    last = F.greatest(F.col("before") + F.col("n_bytes") - 1, F.col("before"))
    rows = placed.join(known, "source", "left")
    # Empty texts after the end of a source's bytes belong to its last block.
    of = lambda byte: F.least(F.expr(f"({byte}) div {block_bytes}"), F.col("n_blocks") - 1)
    rows = rows.withColumn("last_byte", last).withColumns({"block": of("before"), "last_block": of("last_byte")})
    first = plan.select("i", F.col("k").alias("block"), "release", "deadline", F.col("place").alias("slot"))
    rows = rows.join(first, ["i", "block"], "left")
    rows = rows.join(plan.select("i", F.col("k").alias("last_block"), F.col("place").alias("last_slot")), ["i", "last_block"], "left")
    inside = F.col("last_slot") < F.lit(horizon)
    return rows.select(
        "doc_id", "source", "n_bytes", "weight", "block", "release", "deadline", "slot", "last_slot",
        F.coalesce(inside, F.lit(False)).alias("selected"),
    )


def op4_pfair_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pfair_mix(documents(spark, sf_dir))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: all documents in schedule order, none dropped.

    Rows of one id, source and length go by the first slot among them; null ids
    are ids like others; where no source has a slot (an empty table), nothing
    comes out; other columns pass through, whatever their names.
    """
    slots = pfair_mix(docs).groupBy("doc_id", "source", "n_bytes").agg(F.min("slot").alias("__mix_slot"))
    slots = slots.withColumnsRenamed({"doc_id": "__mix_id", "source": "__mix_source", "n_bytes": "__mix_bytes"})
    own = F.coalesce(docs["source"].cast("string"), F.lit("")), F.octet_length(F.coalesce(docs["text"], F.lit(""))).cast("long")
    same = docs["doc_id"].cast("long").eqNullSafe(F.col("__mix_id")) & (own[0] == F.col("__mix_source")) & (own[1] == F.col("__mix_bytes"))
    return docs.join(slots, same, "left").orderBy(F.col("__mix_slot").asc_nulls_last(), "doc_id").select(*docs.columns)
