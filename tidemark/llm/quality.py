"""Operator 7: a quality classifier by importance resampling.

Two generative models share one bag of hashed word unigrams and bigrams (a
word that repeats its neighbour gives one common bigram): the *target* model
counts labelled good documents, the *raw* model counts every document. A
document's weight is the mean log ratio of its n-grams under the two models.
Documents are sampled without replacement by Gumbel top-k: each one's key is
``weight / TEMPERATURE`` plus keyed Gumbel noise, and the ``k`` largest keys
stay. ``k`` is the number of documents whose weight reaches a line: the weight
that ``KEEP_TARGET`` of the held-out good rows reach, lowered half way to
where ``DROP_BAD`` of the bad ones end, if that is further down. So the
classifier drops what looks unlike the target, leaves a margin for good
documents, and the noise only decides near the line.

* Counting is one pass that adds up per task and sends each bucket once, so
  the shuffle is at most ``BUCKETS`` rows per task.
* At most ``LABELS`` labelled rows (those with the least hashes) are used; this
  bounded sample is broadcast, everything else covers all documents. Half of it
  fits the target model, half calibrates.
* The models are ``BUCKETS`` numbers each; nothing else reaches the driver but
  histograms of at most ``BINS`` rows that find the exact k-th largest key.
* Noise is a hash of the document, so a retried task gives the same sample.

Defined results: an empty text has weight 0 (no evidence); without good labels
all documents stay; ties at the line all stay; labels with nulls are ignored;
of several labels for one doc_id the worst counts; repeated rows are judged
alike.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.byte_hash import join, mix
from tidemark.llm.common import keep_columns, text_of
from tidemark.llm.shingles import word_hashes
from tidemark.session import stage_table

#: Buckets of the hashed n-grams; most labelled rows used; share of held-out
#: good rows that the line keeps, and of bad ones that it aims to drop;
#: sharpness of sampling; seed of the noise.
BUCKETS, LABELS, KEEP_TARGET, DROP_BAD, TEMPERATURE, SEED = 1 << 16, 20_000, 0.999, 0.95, 0.002, 7
#: Bins per pass of the selection, and keys that one last pass may sort.
BINS, LAST = 4096, 10_000


class Model(NamedTuple):
    """Log ratio of each bucket, and the least weight that counts as good."""
    ratio: np.ndarray
    line: float


def ngrams(text: str) -> np.ndarray:
    """The buckets of a text's n-grams, repeats included."""
    words, _ = word_hashes(np.frombuffer(text.encode(), np.uint8))
    pairs = join(words[:-1], words[1:])
    pairs[words[:-1] == words[1:]] = np.uint64(1)
    every = np.concatenate((mix(words + np.uint64(1)), mix(pairs + np.uint64(2))))
    return (every % np.uint64(BUCKETS)).astype(np.int64)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    raw, target = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
    for batch in batches:
        for text, fit in zip(batch.column("text"), batch.column("fit"), strict=True):
            found = ngrams(text.as_py())
            np.add.at(raw, found, 1)
            if fit.as_py():
                np.add.at(target, found, 1)
    seen = np.flatnonzero(raw)
    yield pa.record_batch([pa.array(seen), pa.array(raw[seen]), pa.array(target[seen])], ["bucket", "raw", "target"])


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))


def _labelled(labels: DataFrame) -> DataFrame:
    """doc_id, good, fit: the bounded sample of labels."""
    one = (labels.select(F.col("doc_id").cast("long").alias("doc_id"), (F.col("quality") == 1).alias("good"))
           .where("doc_id is not null and good is not null").groupBy("doc_id").agg(F.min("good").alias("good")))
    order = F.xxhash64(F.lit(SEED), "doc_id")
    return (one.orderBy(order, "doc_id").limit(LABELS)
            .select("doc_id", "good", (F.col("good") & (F.pmod(order, F.lit(2)) == 0)).alias("fit")))


def _weigh(ratio: np.ndarray, keep: list[str]):
    """The columns ``keep`` of batches and the weight of their ``text``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = (ngrams(t.as_py() or "") for t in batch.column("text"))
            weight = [float(ratio[x].mean()) if len(x) else 0.0 for x in found]
            yield pa.record_batch([*(batch.column(n) for n in keep), pa.array(weight, pa.float64())], [*keep, "__weight"])

    return run


def weighed(docs: DataFrame, ratio: np.ndarray, *drop: str) -> DataFrame:
    """``docs`` without the columns ``drop``, with ``__weight`` and the Gumbel
    ``__key``; each text goes to Python once."""
    noised = docs.withColumn("__u", F.xxhash64(F.lit(SEED), F.col("doc_id"), text_of()))
    fields = [f for f in noised.schema if f.name not in drop]
    out = noised.mapInArrow(_weigh(ratio, [f.name for f in fields]),
                            ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in fields), "__weight double"]))
    uniform = (F.shiftrightunsigned("__u", 11) + 0.5) / float(1 << 53)
    return out.withColumn("__key", F.col("__weight") / TEMPERATURE - F.log(-F.log(uniform))).drop("__u")


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """The model of ``docs`` (doc_id, text) and ``labels`` (doc_id, quality)."""
    sample = stage_table(_labelled(labels), "labels")
    texts = _texts(docs)
    marked = texts.join(F.broadcast(sample.select("doc_id", "fit")), "doc_id", "left").select(
        "text", F.coalesce("fit", F.lit(False)).alias("fit"))
    counts = (marked.mapInArrow(_count, "bucket long, raw long, target long").groupBy("bucket")
              .agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).toArrow())
    raw, target = np.ones(BUCKETS), np.ones(BUCKETS)
    bucket = counts["bucket"].to_numpy()
    raw[bucket] += counts["raw"].to_numpy()
    target[bucket] += counts["target"].to_numpy()
    if target.sum() == BUCKETS:
        return Model(np.zeros(BUCKETS), -np.inf)
    ratio = np.log(target / target.sum()) - np.log(raw / raw.sum())
    held = texts.join(F.broadcast(sample.where("not fit").select("doc_id", "good")), "doc_id")
    weights = weighed(held, ratio, "text").select("good", "__weight").toArrow()  # at most LABELS distinct ids
    marks, weight = weights["good"].to_numpy(), weights["__weight"].to_numpy()
    good, bad = weight[marks], weight[~marks]
    if not len(good):
        return Model(ratio, -np.inf)
    line = np.quantile(good, 1 - KEEP_TARGET, method="lower")
    if len(bad):  # half way down to the bad rows, where they leave a gap
        line = min(line, (line + np.quantile(bad, DROP_BAD, method="higher")) / 2)
    return Model(ratio, float(line))


def kth_largest(keys: DataFrame, name: str, k: int) -> float:
    """The exact k-th largest value of a double column without nulls, found by
    histograms that narrow down; infinite if there are fewer values."""
    if k <= 0:
        return np.inf
    low, high, n = keys.agg(F.min(name), F.max(name), F.count(name)).first()
    if n < k:
        return -np.inf
    while low < high:
        inside = keys.where((F.col(name) >= low) & (F.col(name) <= high))
        if n <= LAST:
            return inside.orderBy(F.desc(name)).limit(k).agg(F.min(name)).first()[0]
        width = (high - low) / BINS
        bins = (inside.groupBy(F.least(F.floor((F.col(name) - low) / width), F.lit(BINS - 1)).alias("bin"))
                .agg(F.count(F.lit(1)).alias("n"), F.min(name).alias("low"), F.max(name).alias("high"))
                .orderBy(F.desc("bin")).collect())  # at most BINS rows
        for b in bins:
            if k <= b["n"]:
                low, high, n = b["low"], b["high"], b["n"]
                break
            k -= b["n"]
    return low


def _sample(docs: DataFrame, labels: DataFrame) -> tuple[DataFrame, Model, float]:
    model = fit(docs, labels)
    scores = stage_table(weighed(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), model.ratio, "text"), "weights")
    k = scores.where(F.col("__weight") >= model.line).count()
    return scores, model, kth_largest(scores, "__key", k)


def resample(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, weight, sample_key, kept."""
    scores, _, cut = _sample(docs, labels)
    return scores.select("doc_id", F.col("__weight").alias("weight"), F.col("__key").alias("sample_key"),
                         (F.col("__key") >= cut).alias("kept"))


def keep_sampled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The sampled rows of ``docs``, all columns as they are. Weights are taken
    again from the texts, so no row is looked up by an id."""
    _, model, cut = _sample(docs, labels)
    same = docs.withColumn("doc_id", F.col("doc_id").cast("long"))
    out = weighed(same, model.ratio).where(F.col("__key") >= cut)
    return keep_columns(docs, out.withColumn("doc_id", F.col("doc_id").cast(docs.schema["doc_id"].dataType)))
