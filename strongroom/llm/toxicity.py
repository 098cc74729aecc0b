"""Toxicity by the set of a text's words: two class-conditional discounted models of order 1, not Kneser-Ney.

No word pairs and no continuation counts: a combination of ordinary words is ordinary.

Counts are of documents that use a word, near copies once, as a word's repetitions within a text say nothing new about
it. Each class discounts its counts absolutely; what it takes away goes to a backoff model of the counts that the two
classes share: the lesser of a word's two rates. A word too rare for a class thus has the same likelihood in both and
speaks for neither, and one that a single class uses gets nothing from the backoff in the other. The discount of the
larger class is larger in proportion, so that both ask for the same evidence.

A text's score compares its two log-likelihoods, over its different words and divided by the square root of their number
(as chance differences grow with that), through a logistic curve. Curve and discount are chosen on labelled texts that
the counts haven't seen.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass, fields, replace

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strongroom.llm.common import map_texts, whole_text

# Bound of the labelled sample: rows, taken in the order of a hash of their identifier.
TRAIN_ROWS = 40_000
# Of 4 labelled rows one is for the curve and the discount, the rest are for the counts.
FIT_SHARE = 4
# Discounts tried, in documents of the smaller class.
DISCOUNTS = (2.0, 4.0, 8.0)
WORD = re.compile(r"\w+")


@dataclass(frozen=True)
class Model:
    """counts: word -> (toxic, ordinary) documents, for words that the least discount doesn't take away in both classes;
    totals and kinds: the sums over all words; rest: (words, documents) of the others, for the shared model; weights:
    the share of the backoff model in each class; discounts, slope and middle as chosen."""

    counts: dict[str, tuple[int, int]]
    totals: tuple[float, float]
    rest: tuple[int, int]
    weights: tuple[float, float]
    discounts: tuple[float, float]
    slope: float = 0.0
    middle: float = 0.0


def class_discounts(discount: float, totals: tuple[float, float]) -> tuple[float, float]:
    """The discount of each class in proportion to its size; the smaller class has the one given."""
    least = min(totals)
    return (discount * totals[0] / least, discount * totals[1] / least)


def likelihoods(model: Model, word: str) -> tuple[float, float]:
    """The natural logarithms of a word's probability in toxic and in ordinary text, over its class's backoff share, so
    that words left to the backoff model weigh the same in both."""
    half = 0.5 / sum(model.totals)
    pair = model.counts.get(word)
    if pair is None:
        # The words not listed share their part of the backoff model evenly, with one more for those never seen.
        shared = math.log(max(model.rest[1], 1) / (model.rest[0] + 1) / sum(model.totals))
        return shared, shared
    shared = min(n / total for n, total in zip(pair, model.totals)) + half
    return tuple(
        math.log(max(n - d, 0) / total / w + shared)
        for n, d, total, w in zip(pair, model.discounts, model.totals, model.weights)
    )


def _sent(spark: SparkSession, model: Model) -> Broadcast:
    """The model's values as a broadcast of plain ones, which workers read without this package."""
    return spark.sparkContext.broadcast(tuple(getattr(model, f.name) for f in fields(model)))


def _scorer(sent: Broadcast):
    """Per text: different words, and the two length-normalised log-likelihoods (0 for texts without words)."""

    def make():
        model = Model(*sent.value)
        # Listed words only: the others all have the same values, so the table is bounded by the model.
        at = {word: i + 1 for i, word in enumerate(model.counts)}
        table = np.array([likelihoods(model, ""), *(likelihoods(model, word) for word in model.counts)])

        def work(texts: list[str]) -> list[pa.Array]:
            places, bounds = [], [0]
            for text in texts:
                places += [at.get(word, 0) for word in sorted(set(WORD.findall(text.lower())))]
                bounds.append(len(places))
            sums = np.zeros((len(places) + 1, 2))
            np.cumsum(table[places] if places else table[:0], axis=0, out=sums[1:])
            n = np.diff(bounds)
            each = np.diff(sums[bounds], axis=0) / np.sqrt(np.maximum(n, 1))[:, None]
            return [pa.array(n, pa.int64()), pa.array(each[:, 0]), pa.array(each[:, 1])]

        return work

    return make


LIKELIHOODS = [
    T.StructField("n_scored", T.LongType(), False),
    T.StructField("toxic_likelihood", T.DoubleType(), False),
    T.StructField("ordinary_likelihood", T.DoubleType(), False),
]


def _least_shingle(words: list[str]) -> int:
    """The least hash of the text's five-word shingles: near copies mostly agree on it."""
    return min(
        (xxhash.xxh64_intdigest(" ".join(words[i : i + 5])) for i in range(max(1, len(words) - 4))), default=0
    ) >> 1


def _used_words(texts: DataFrame) -> DataFrame:
    """word, toxic and ordinary documents over rows of (text, toxic), of near copies one, summed before the shuffle."""
    marked = map_texts(
        texts.withColumn("_text", F.col("text")),
        lambda: lambda batch: [pa.array([_least_shingle(WORD.findall(t.lower())) for t in batch], pa.int64())],
        [T.StructField("_least", T.LongType())],
    )
    one = marked.groupBy("toxic", "_least").agg(F.min("_text").alias("text")).select("text", "toxic")

    def count(batches):
        for batch in batches:
            sums = (Counter(), Counter())
            for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist()):
                sums[0 if toxic else 1].update(set(WORD.findall(text.lower())))
            words = list(sums[0].keys() | sums[1].keys())
            yield pa.RecordBatch.from_pydict(
                {
                    "word": pa.array(words, pa.string()),
                    "toxic": pa.array([sums[0][w] for w in words], pa.int64()),
                    "ordinary": pa.array([sums[1][w] for w in words], pa.int64()),
                }
            )

    return (
        one.mapInArrow(count, "word string, toxic long, ordinary long")
        .groupBy("word")
        .agg(F.sum("toxic").alias("toxic"), F.sum("ordinary").alias("ordinary"))
    )


def _fit_curve(x: np.ndarray, y: np.ndarray) -> tuple[float, float, float]:
    """Slope, middle and mean loss of the logistic curve, by damped Newton steps on the standardised value."""
    mean, spread = x.mean(), x.std() or 1.0
    design = np.stack([(x - mean) / spread, np.ones(len(x))], 1)
    w = np.zeros(2)

    def loss(v: np.ndarray) -> float:
        z = design @ v
        return float(np.mean(np.logaddexp(0, z) - y * z)) + 0.5e-4 * float(v @ v)

    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        gradient = design.T @ (p - y) / len(x) + 1e-4 * w
        hessian = (design * (p * (1 - p))[:, None]).T @ design / len(x) + 1e-4 * np.eye(2)
        step, size = np.linalg.solve(hessian, gradient), 1.0
        while loss(w - size * step) > loss(w) and size > 1e-6:
            size /= 2
        w = w - size * step
        if np.abs(size * step).max() < 1e-8:
            break
    slope = float(w[0] / spread)
    return slope, float(mean - w[1] / slope) if slope else 0.0, loss(w)


def fit(labelled: DataFrame, discounts: tuple[float, ...] = DISCOUNTS) -> Model:
    """A model of rows of (doc_id, text, toxic), a bounded sample as labelled_rows gives.

    Null labels are left out, null texts are empty. The driver gets the words that some discount leaves a count, at most
    the words of the sample. Without a usable row of either class every score is 0.5.
    """
    spark = labelled.sparkSession
    sample = (
        labelled.where(F.col("toxic").isNotNull())
        .select(
            whole_text().alias("text"),
            (F.col("toxic") != 0).alias("toxic"),
            (F.pmod(F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.lit(FIT_SHARE)) == 0).alias("_fit"),
        )
        .persist()
    )
    words = _used_words(sample.where(~F.col("_fit")).select("text", "toxic")).persist()
    totals = words.agg(F.sum("toxic"), F.sum("ordinary")).first()
    if not totals[0] or not totals[1]:
        return Model({}, (1.0, 1.0), (0, 0), (1.0, 1.0), (0.0, 0.0))
    totals = (float(totals[0]), float(totals[1]))
    least = class_discounts(min(discounts), totals)
    kept = (F.col("toxic") > least[0]) | (F.col("ordinary") > least[1])
    listed = words.where(kept).toPandas()
    counts = dict(zip(listed["word"], zip(listed["toxic"].tolist(), listed["ordinary"].tolist())))
    taken = [class_discounts(d, totals) for d in discounts]
    sums = words.agg(
        *(F.sum(F.least(c, F.lit(d))) for pair in taken for c, d in zip(("toxic", "ordinary"), pair)),
        F.count(F.when(~kept, 1)),
        F.sum(F.when(~kept, F.col("toxic") + F.col("ordinary"))),
    ).first()
    best = None
    for i, pair in enumerate(taken):
        weights = tuple(sums[2 * i + c] / totals[c] for c in (0, 1))
        model = Model(counts, totals, (sums[-2] or 0, sums[-1] or 0), weights, pair)
        sent = _sent(spark, model)
        points = map_texts(sample.where("_fit").select("text", "toxic"), _scorer(sent), LIKELIHOODS).toPandas()
        y = points["toxic"].to_numpy(float)
        if not len(y) or y.min() == y.max():
            best = (0.0, model)
            break
        slope, middle, loss = _fit_curve((points["toxic_likelihood"] - points["ordinary_likelihood"]).to_numpy(float), y)
        if best is None or loss < best[0]:
            best = (loss, replace(model, slope=slope, middle=middle))
        sent.unpersist()
    words.unpersist()
    sample.unpersist()
    return best[1]


def score(docs: DataFrame, model: Model, keep_text: bool = False) -> DataFrame:
    """The columns of docs but the text (with it where it is to be kept), n_scored, the two log-likelihoods, score and
    predicted.

    A text without words (empty, null, signs only) has likelihoods of 0 and the curve's value there. One row for each
    row of docs; whole texts. Columns of docs named as one of these give way to it.
    """
    scored = map_texts(docs, _scorer(_sent(docs.sparkSession, model)), LIKELIHOODS, keep_text=keep_text)
    slope, middle = float(model.slope), float(model.middle)
    apart = F.col("toxic_likelihood") - F.col("ordinary_likelihood")
    value = 1 / (1 + F.exp(-F.lit(slope) * (apart - F.lit(middle))))
    return scored.withColumn("score", value).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def labelled_rows(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    """(doc_id, text, toxic) of the first ``rows`` labels in hash order.

    The labels are bounded before the join, so they are the side that is broadcast and no text is shuffled.
    """
    chosen = (
        labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull())
        .select("doc_id", "toxic")
        .orderBy(F.xxhash64(F.col("doc_id").cast("string")), "doc_id", "toxic")
        .limit(rows)
    )
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
