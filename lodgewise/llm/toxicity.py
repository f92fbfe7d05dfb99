"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic texts are the positives; unlabelled texts stand for the mixture of both. With the class prior p the
risk of calling texts clean is that on the unlabelled minus p times that on the positives; where a batch makes this
difference negative, the model has begun to learn single texts by heart, and the step goes the other way. The
classifier is logistic over the presence of hashed words and word beginnings.

Which features there are is decided by counts over all texts and all positives, equal texts once, summed in Spark.
Only the steps of the fit use bounded samples. Scoring reads every whole text in a projection, without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodgewise.llm.common import SMALL_SLICE_BYTES, Words, as_long, slices
from lodgewise.session import stored

#: Hashed features, and lengths in bytes of the word beginnings among them.
BUCKETS = 1 << 20
BEGINNINGS = (4, 5, 6, 7)
#: Rows of a batch of counts.
_COUNT_ROWS = 1 << 16

_LETTER = np.zeros(256, bool)
_LETTER[97:123] = True
_LETTER[128:] = True


@dataclass(frozen=True)
class Settings:
    """Bounds of the samples that the steps use, and of the model; the prior is measured unless given."""

    positives: int = 10_000
    unlabelled: int = 20_000
    features: int = 4_096
    prior: float | None = None
    steps: int = 800
    rate: float = 0.1
    decay: float = 1e-5
    seed: int = 7


@dataclass(frozen=True)
class Model:
    buckets: np.ndarray
    weights: np.ndarray
    bias: float

    def table(self) -> np.ndarray:
        """A weight for each bucket; NaN where the model has none."""
        out = np.full(BUCKETS, np.nan, np.float32)
        out[self.buckets] = self.weights
        return out


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Text number and bucket of each word and word beginning, repeats included; words are runs of letters."""
    words = Words(texts, lower=True, inside=_LETTER)
    size = words.end - words.start
    text = words.text.astype(np.int32)
    buckets, owner = [(words.hashes() >> np.uint64(44)).astype(np.int32)], [text]
    for n in BEGINNINGS:
        longer = size > n
        begin = words.start[longer]
        buckets.append(((words.span_hash(begin, begin + n) + np.uint64(1)) >> np.uint64(44)).astype(np.int32))
        owner.append(text[longer])
    return np.concatenate(owner), np.concatenate(buckets)


def _distinct(owner: np.ndarray, bucket: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    pairs = owner.astype(np.int64)
    pairs *= BUCKETS
    pairs += bucket
    pairs.sort()
    pairs = pairs[np.concatenate([[True], pairs[1:] != pairs[:-1]])] if len(pairs) else pairs
    return (pairs // BUCKETS).astype(np.int32), (pairs % BUCKETS).astype(np.int32)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many texts, and how many positives, contain each bucket: one row per bucket and task. Bucket -1 is in all."""
    counts, n = np.zeros((2, BUCKETS), np.int64), np.zeros((2, 1), np.int64)
    for batch in slices(batches, "text", SMALL_SLICE_BYTES):
        owner, bucket = _distinct(*features(batch.column(1)))
        positive = np.asarray(batch.column(0)) == 1
        counts[0] += np.bincount(bucket, minlength=BUCKETS)
        counts[1] += np.bincount(bucket[positive[owner]], minlength=BUCKETS)
        n += [[len(positive)], [positive.sum()]]
    buckets = np.concatenate([[-1], np.flatnonzero(counts[0])])
    for low in range(0, len(buckets), _COUNT_ROWS):
        some = buckets[low : low + _COUNT_ROWS]
        told = (np.where(some < 0, n[k], counts[k][some]) for k in (0, 1))
        yield pa.record_batch([as_long(some), *(as_long(x) for x in told)], names=["bucket", "u", "p"])


def _chosen(rows: DataFrame, buckets: np.ndarray) -> DataFrame:
    """For each text of the samples, which of the chosen buckets it contains."""
    at = np.full(BUCKETS, -1, np.int32)
    at[buckets] = np.arange(len(buckets))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", SMALL_SLICE_BYTES):
            owner, bucket = features(batch.column(1))
            known = at[bucket] >= 0
            owner, bucket = _distinct(owner[known], bucket[known])
            cuts = np.searchsorted(owner, np.arange(batch.num_rows + 1)).astype(np.int32)
            held = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(at[bucket], pa.int32()))
            yield pa.record_batch([batch.column(0), held], names=["positive", "held"])

    return rows.mapInArrow(run, "positive int, held array<int>")


def learnt(held: list[np.ndarray], positive: np.ndarray, size: int, prior: float, settings: Settings) -> tuple[np.ndarray, float]:
    """Weights and bias after full-batch steps of Adam down the non-negative risk with the logistic loss."""
    owner = np.repeat(np.arange(len(held)), [len(h) for h in held])
    bucket = np.concatenate([*held, np.empty(0, np.int64)]).astype(np.int64)
    n_p, n_u = max(1, positive.sum()), max(1, (~positive).sum())
    w = np.zeros(size + 1)  # the last is the bias
    w[-1] = np.log(prior / (1 - prior))
    first, second = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, settings.steps + 1):
        z = np.bincount(owner, w[bucket], minlength=len(held)) + w[-1]
        s = 1 / (1 + np.exp(-np.clip(z, -60, 60)))
        clean_loss = np.logaddexp(0, z)  # the loss of calling a text toxic when it is clean
        rest = clean_loss[~positive].mean() - prior * clean_loss[positive].mean() if n_u else 0.0
        as_toxic = np.where(positive, prior * (s - 1) / n_p, 0.0)
        as_clean = np.where(positive, -prior * s / n_p, s / n_u)
        slope = as_toxic + as_clean if rest >= 0 else -as_clean
        grad = np.append(np.bincount(bucket, slope[owner], minlength=size), slope.sum()) + settings.decay * w
        first = 0.9 * first + 0.1 * grad
        second = 0.999 * second + 0.001 * grad * grad
        w -= settings.rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    return w[:-1], float(w[-1])


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows that no label is learnt from: the CRC-32 of the id as text is a multiple of 5 (null ids are)."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(True))


def fit(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> Model | None:
    """Learns from ``labels`` (``doc_id``, ``toxic``) and the texts of ``docs``, rows held out left aside.

    Positives are the texts that some label calls toxic; unlabelled stand all texts. Features are chosen by counts over
    all of both. The steps use up to ``settings.positives`` and about ``settings.unlabelled`` of them, by the order of
    hashes. The prior is the share of toxic among the labels. Null labels are no labels. Without any confirmed positive,
    or any feature that tells positives from the rest, there is no model.
    """
    known = labels.select("doc_id", "toxic").filter(F.col("toxic").isNotNull() & ~held_out())
    toxic = known.filter("toxic = 1").select("doc_id").distinct()
    place = F.xxhash64(F.col("doc_id"), F.lit(settings.seed))
    chosen = toxic.orderBy(place, "doc_id").limit(settings.positives)  # bounded sample of labelled rows
    shares = known.agg(F.avg((F.col("toxic") == 1).cast("double")).alias("p"), F.count("*").alias("n")).first()
    if not shares["n"] or not shares["p"]:
        return None
    prior = min(0.5, settings.prior or shares["p"])
    texts = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text")).filter(~held_out())
    share = min(1.0, settings.unlabelled / max(1, texts.select("doc_id").count()))
    some = F.pmod(F.xxhash64("text", F.lit(settings.seed)), F.lit(1_000_000)) < int(share * 1_000_000)
    positive = texts.join(F.broadcast(chosen), "doc_id").select(F.lit(1).alias("positive"), "text")
    # equal texts count once: a text that was copied often would make its words look telling
    rows = positive.distinct().unionByName(texts.filter(some).select(F.lit(0).alias("positive"), "text").distinct())
    rows = stored(rows, "toxicity-sample")  # bounded by the settings
    flagged = texts.join(stored(toxic, "toxic-ids").withColumn("_toxic", F.lit(1)), "doc_id", "left")
    once = flagged.groupBy("text").agg(F.max(F.coalesce("_toxic", F.lit(0))).alias("positive")).select("positive", "text")
    counts = once.mapInArrow(_counted, "bucket bigint, u bigint, p bigint").groupBy("bucket").agg(F.sum("u").alias("u"), F.sum("p").alias("p"))
    counts = stored(counts, "toxicity-counts")  # a row per bucket
    sizes = counts.filter("bucket < 0").first()
    n_p, n_u = (float(sizes["p"]), float(sizes["u"])) if sizes else (0.0, 0.0)
    if not n_p:
        return None
    counts = counts.filter("bucket >= 0")
    # how much oftener positives have a feature than all texts do, in standard deviations
    rate = (F.col("u") + F.col("p") + 1) / (n_u + n_p + 2)
    score = (F.col("p") / n_p - F.col("u") / n_u) / F.sqrt(rate * (1 - rate) * (1 / n_p + 1 / n_u))
    # and which share of the texts that have it is toxic, at the prior
    share_toxic = prior * (F.col("p") / n_p) / ((F.col("u") + 1) / n_u)
    best = counts.withColumn("score", score).filter((F.col("score") > 4) & (share_toxic > 0.3)).orderBy(F.desc("score"), "bucket").limit(settings.features)
    buckets = np.array(sorted(r["bucket"] for r in best.select("bucket").collect()), np.int64)
    if not len(buckets):
        return None
    sample = _chosen(rows, buckets).toPandas()  # at most the two samples, a few features each
    held = [np.asarray(h, np.int64) for h in sample["held"]]
    weights, bias = learnt(held, sample["positive"].to_numpy() == 1, len(buckets), prior, settings)
    return Model(buckets, weights.astype(np.float32), bias)


def _scores(texts: pa.Array, model: Model | None, weight: np.ndarray | None) -> np.ndarray:
    if model is None:
        return np.zeros(len(texts))
    owner, bucket = features(texts)
    known = ~np.isnan(weight[bucket])
    owner, bucket = _distinct(owner[known], bucket[known])
    z = np.bincount(owner, weight[bucket], minlength=len(texts)) + model.bias
    return 1 / (1 + np.exp(-np.clip(z, -700, 700)))


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """``doc_id`` and ``score``, the chance that a text is toxic, for every whole text.

    Null and empty texts get the score of a text without features; without a model every score is 0. Only texts are
    read, so equal texts have equal scores; rows are neither dropped nor joined; an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight = model.table() if model else None
        for batch in slices(batches, "text", SMALL_SLICE_BYTES):
            scores = _scores(batch.column(1), model, weight)
            yield pa.record_batch([batch.column(0), pa.array(scores)], names=["doc_id", "score"])

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(run, "doc_id bigint, score double")


def keep(docs: DataFrame, model: Model | None, threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that score below the threshold, unchanged and with all columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight = model.table() if model else None
        for batch in slices(batches, "text", SMALL_SLICE_BYTES):
            clean = _scores(batch.column(batch.schema.get_field_index("text")), model, weight) < threshold
            yield batch.filter(pa.array(clean))

    return docs.mapInArrow(run, docs.schema)
