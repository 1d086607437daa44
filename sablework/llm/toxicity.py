"""Operator 10: toxicity by gradient-boosted trees over dense features, with isotonic calibration.

Features of a whole text: density and number of lexicon words, of lexicon words
within NEAR words of a second-person pronoun, of obfuscated lexicon words
(letters spelled with digits or signs, or pulled apart), and the rates of
pronouns, capitals, punctuation, digits and non-ASCII letters. The lexicon is a
short fixed list and what training adds: words that are much more frequent in
documents labelled toxic than in the others.

Lexicon, trees and isotonic step are fitted on a bounded sample of labelled
rows (TRAIN_ROWS, those with the smallest hashes), the isotonic step on a fold
of it that the trees haven't seen. Only text and labels.toxic of training rows
are learned from.

Null or empty text has all features 0 and gets the score of such texts;
repeated rows get equal scores; labels of unknown documents are ignored, of
several labels of a document the highest holds; where the labels hold one class
only, every score is that class's share. An empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, long_id, small_batches, written

TRAIN_ROWS = 20_000
LEXICON_WORDS = 100
#: A learned word is in at least MIN_TOXIC toxic training documents, with log odds of LOG_ODDS at least, MIN_SURE standard errors above 0.
MIN_TOXIC, LOG_ODDS, MIN_SURE = 4, 2.0, 3.0
TREES = 15
NEAR = 6
# Insults, and second-person pronouns of the languages at hand.
INSULTS = "idiot moron stupid dumb worthless pathetic disgusting loser clown trash scum imbecile fool garbage filthy"
SECOND_PERSON = "you your yours yourself u ur tu te toi vous votre vos tú usted ustedes du dich dir dein deine ihr euch"
# Signs that stand for letters.
LEET = str.maketrans("0134578@$!|+", "oieastbasiit")
FEATURES = (
    "lexicon_hits", "lexicon_density", "distinct_hits", "near_second_person", "obfuscated_hits", "second_person_rate",
    "capital_rate", "shout_rate", "punctuation_rate", "mark_rate", "digit_rate", "non_ascii_rate", "log_words",
)
WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: Letters that are pulled apart: "w o r d", "w.o.r.d", "w-o-r-d".
APART = re.compile(r"(?<![^\W_])(?:[^\W\d_][ .\-_*]){3,}[^\W\d_](?![^\W_])")
EDGE = ".,;:!?\"'()[]{}<>*#%&$|~^_=+-/\\"


def features(text: str | None, lexicon: frozenset[str]) -> list[float]:
    """The FEATURES of one text."""
    text = text or ""
    words = WORD.findall(text)
    if not words:
        return [0.0] * len(FEATURES)
    n, chars = len(words), len(text)
    hits, second, distinct, hidden = [], [], set(), 0
    for i, w in enumerate(words):
        bare = w.strip(EDGE).lower()
        if bare in lexicon:
            hits.append(i)
            distinct.add(bare)
        elif bare in PRONOUNS:
            second.append(i)
        elif not bare.isalpha():
            spelled = {"".join(c for c in x.lower().translate(LEET) if c.isalpha()) for x in (w, bare)} & lexicon
            if spelled:
                hits.append(i)
                distinct |= spelled
                hidden += 1
    seen = end = 0
    for m in APART.finditer(text):
        if "".join(c for c in m[0].lower() if c.isalpha()) in lexicon:
            # It stands where its first letter's word does.
            seen, end = seen + len(WORD.findall(text, end, m.start())), m.start()
            hidden += 1
            hits.append(seen)
    near = 0
    if hits and second:
        at, h = np.array(second), np.array(hits)
        after = np.searchsorted(at, h)
        ahead, behind = at[np.minimum(after, len(at) - 1)] - h, h - at[np.maximum(after - 1, 0)]
        near = int((np.minimum(np.abs(ahead), np.abs(behind)) <= NEAR).sum())
    upper = sum(map(str.isupper, text))
    shout = sum(1 for w in words if len(w) > 2 and w.isupper())
    raw = text.encode()
    marks = text.count("!") + text.count("?")
    kinds = np.bincount(CLASS[np.frombuffer(raw, np.uint8)], minlength=4)
    return [
        float(len(hits)), 100.0 * len(hits) / n, float(len(distinct)), float(near), float(hidden), 100.0 * len(second) / n,
        upper / chars, shout / n, kinds[1] / chars, marks / chars, kinds[2] / chars, kinds[3] / chars, float(np.log1p(n)),
    ]


PRONOUNS = frozenset(SECOND_PERSON.split())
#: Classes of bytes: 1 punctuation, 2 digit, 3 beyond ASCII.
CLASS = np.array([3 if b > 127 else 2 if chr(b).isdigit() else 1 if 32 < b < 127 and not chr(b).isalnum() else 0 for b in range(256)], np.uint8)


def with_features(docs: DataFrame, lexicon: frozenset[str], keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns of ``keep`` and one column per feature."""
    kinds = dict(docs.dtypes)
    schema = ", ".join([f"{c} {kinds[c]}" for c in keep] + [f"{c} double" for c in FEATURES])

    def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            table = np.array([features(t, lexicon) for t in b.column("text").to_pylist()], np.float64).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays(
                [*[b.column(c) for c in keep], *[pa.array(table[:, i]) for i in range(len(FEATURES))]], names=[*keep, *FEATURES]
            )

    return docs.select(*keep, "text").mapInArrow(of_batches, schema)


def learn_lexicon(train: DataFrame) -> frozenset[str]:
    """INSULTS and the words whose share of toxic documents stands out, at most LEXICON_WORDS of them."""
    n = {r["toxic"]: r["count"] for r in train.groupBy("toxic").count().collect()}
    split = F.split(F.lower("text"), r"[\x20\x09-\x0D]+")
    words = F.array_distinct(F.transform(split, lambda w: F.regexp_replace(w, r"^[^\p{L}]+|[^\p{L}]+$", "")))
    seen = train.select("toxic", F.explode(words).alias("word")).where(F.length("word") > 2)
    stats = seen.groupBy("word").agg(F.sum(F.col("toxic").cast("long")).alias("t"), F.count(F.lit(1)).alias("n"))
    t, rest = F.col("t") + 0.5, F.col("n") - F.col("t") + 0.5
    odds = F.log(t / (n.get(1, 0) + 1)) - F.log(rest / (n.get(0, 0) + 1))
    # Ranked by how sure the difference is, so that chance words of small counts come last.
    sure = odds / F.sqrt(1 / t + 1 / rest)
    best = stats.where(F.col("t") >= MIN_TOXIC).where((odds >= LOG_ODDS) & (sure >= MIN_SURE))
    return frozenset(INSULTS.split()) | {r.word for r in best.orderBy(sure.desc(), "word").limit(LEXICON_WORDS).collect()}


def score(docs: DataFrame, labels: DataFrame, usable: Column) -> DataFrame:
    """doc_id, score for every document; learns from the labelled rows that ``usable`` (of doc_id) admits."""
    small_batches(docs.sparkSession)
    base = docs.select(long_id(docs), "text")
    marks = labels.where(F.col("toxic").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id"))
    marks = marks.agg(F.max("toxic").cast("int").alias("toxic")).where(usable)
    # TRAIN_ROWS rows of two numbers, whatever the corpus: so the texts needn't be shuffled to find them.
    marks = written(marks.orderBy(F.xxhash64("doc_id"), "doc_id").limit(TRAIN_ROWS), "marks")
    train = written(base.join(F.broadcast(marks), "doc_id").withColumn("text", F.coalesce("text", F.lit(""))), "train")
    share = train.agg(F.avg("toxic")).first()[0]
    if share in (None, 0.0, 1.0):
        return base.select("doc_id", F.lit(float(share or 0.0)).alias("score"))
    lexicon = learn_lexicon(train)
    pack = VectorAssembler(inputCols=list(FEATURES), outputCol="features", handleInvalid="keep")
    # Few partitions: the trees pass over the sample again and again.
    sample = written(with_features(train, lexicon, ("doc_id", "toxic")), "sample").coalesce(2)
    sample = pack.transform(sample).withColumn("fold", F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(4))).cache()
    grown = sample.where("fold > 0")
    if grown.agg(F.countDistinct("toxic")).first()[0] < 2:
        grown = sample
    trees = GBTClassifier(labelCol="toxic", featuresCol="features", maxIter=TREES, maxDepth=3, stepSize=0.3, seed=7).fit(grown)
    p = vector_to_array("probability")[1]
    unseen = trees.transform(sample.where("fold = 0")).select(F.col("toxic").cast("double").alias("toxic"), p.alias("p"))
    calibrated = IsotonicRegression(labelCol="toxic", featuresCol="p").fit(unseen) if not unseen.isEmpty() else None
    sample.unpersist()
    scored = trees.transform(pack.transform(with_features(base, lexicon))).withColumn("p", p).select("doc_id", "p")
    if calibrated is None:
        return scored.select("doc_id", F.col("p").alias("score"))
    # An isotonic step ties many texts; the trees' own order tells them apart within a step.
    mixed = F.col("prediction") * 0.98 + F.col("p") * 0.02
    return calibrated.transform(scored).select("doc_id", F.least(F.lit(1.0), F.greatest(F.lit(0.0), mixed)).alias("score"))


def held_out() -> Column:
    return F.crc32(F.col("doc_id").cast("string")) % 5 == 0


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = score(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"), ~held_out())
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
