"""Operator 2: document fingerprints by consistent weighted sampling.

A document is a multiset of lower-cased words; a word's weight is how often
it occurs. For each of ``SAMPLES`` samples every word draws, from hashes of
the word alone, ``r`` and ``c`` from Gamma(2, 1) and ``b`` from (0, 1). With
weight ``w`` it takes the level ``t = floor(ln w / r + b)`` and the value
``ln c - r (t + 1 - b)``; the word with the least value, with its level, is
the sample. Two documents agree in a sample with probability equal to their
generalised Jaccard similarity (sum of least over sum of greatest weights).

Built-in functions only. Texts are shuffled once, by doc_id, and all counting
and sampling stays in that partitioning: words are counted per document, each
sample is one ``min`` over a 64-bit code (value above, 24 bits that name word
and level below), so no row is ever sorted or listed. The text that follows a
document is found from ids alone: ranges of ids are windowed separately, and
one row per range carries over the seams. Only as much of a text as its
predecessor takes is sent to it.

Defined results: null text is empty; a text without words has the empty
fingerprint, alike to itself and to nothing else; a null doc_id counts as the
smallest; where a doc_id carries several texts, one of them (least prefix,
least fingerprint) stands for it as the next document; repeated rows are
returned as often as they come; a single document is its own next.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.llm.common import text_of
from tidemark.session import stage_table

#: Samples of a fingerprint; the sample of a text without words.
SAMPLES, EMPTY = 32, 0xFFFFFF
_NULL_ID = -(1 << 63)


def words(text: Column) -> Column:
    """The words of a text, with empty ones at its ends."""
    return F.split(F.lower(text), r"[\x20\x09-\x0D]+")


def _sample(k: int) -> Column:
    """The code of one word (``term``, ``ln_w``) in sample ``k``."""
    first, second = F.xxhash64("term", F.lit(2 * k)), F.xxhash64("term", F.lit(2 * k + 1))
    part = lambda h, shift, bits: (F.shiftrightunsigned(h, shift).bitwiseAND(F.lit((1 << bits) - 1)) + 0.5) / float(1 << bits)
    r = -F.log(part(first, 43, 21) * part(first, 22, 21))
    b = part(first, 0, 22)
    ln_c = F.log(-F.log(part(second, 32, 32) * part(second, 0, 32)))
    t = F.floor(F.col("ln_w") / r + b)
    value = F.floor((ln_c - r * (t + 1 - b) + 64) * float(1 << 32))  # in (0, 2^39)
    name = F.col("term").bitwiseXOR(t * 2654435761).bitwiseAND(F.lit(EMPTY))
    return F.shiftleft(value, 24).bitwiseOR(name)


def fingerprints(texts: DataFrame, keys: list[str]) -> DataFrame:
    """``texts`` (keys, text) as keys and ``samples``, an array of SAMPLES
    24-bit numbers. Texts without words have no row. Where ``texts`` is
    partitioned by some of ``keys``, nothing is shuffled."""
    each = texts.select(*keys, F.explode(words(F.col("text"))).alias("word")).where("word <> ''")
    counted = each.select(*keys, F.xxhash64("word").alias("term")).groupBy(*keys, "term").agg(F.count(F.lit(1)).alias("w"))
    codes = counted.select(*keys, "term", F.log(F.col("w")).alias("ln_w")).groupBy(*keys).agg(
        *[F.min(_sample(k)).alias(f"s{k}") for k in range(SAMPLES)])
    return codes.select(*keys, F.array(*[F.col(f"s{k}").bitwiseAND(F.lit(EMPTY)) for k in range(SAMPLES)]).alias("samples"))


def likeness(a: Column, b: Column) -> Column:
    """The share of samples in which two fingerprints agree."""
    return F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda same: same)) / float(SAMPLES)


def as_text(samples: Column) -> Column:
    """A fingerprint as lowercase hex."""
    return F.lower(F.array_join(F.transform(samples, lambda s: F.lpad(F.hex(s), 6, "0")), ""))


def predecessors(ids: DataFrame) -> DataFrame:
    """``ids`` (doc_id, half) in ascending order, as doc_id, prev_id and
    prev_half; the first follows the last."""
    ranged = stage_table(ids.repartitionByRange("doc_id").select("doc_id", "half", F.spark_partition_id().alias("part")), "ids")
    ends = ranged.groupBy("part").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"),
                                      F.max_by("half", "doc_id").alias("last_half"))  # one row per range
    order, everything = W.orderBy("first"), W.orderBy("first").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    seams = ends.select("part", F.coalesce(F.lag("last").over(order), F.last("last").over(everything)).alias("seam_id"),
                        F.coalesce(F.lag("last_half").over(order), F.last("last_half").over(everything)).alias("seam_half"))
    inside = W.partitionBy("part").orderBy("doc_id")
    return (ranged.select("*", F.lag("doc_id").over(inside).alias("lag_id"), F.lag("half").over(inside).alias("lag_half"))
            .join(F.broadcast(seams), "part")
            .select("doc_id", F.coalesce("lag_id", "seam_id").alias("prev_id"), F.coalesce("lag_half", "seam_half").alias("prev_half")))


def compare_edited(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_chars, edited_sha256, samples,
    edited_samples, near_edited, near_next; the edited text has the last half
    replaced by the beginning of the next document."""
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_NULL_ID)).alias("doc_id"), text_of().alias("text"))
    half = F.floor(F.length("text") / 2)
    ids = stage_table(rows.groupBy("doc_id").agg(F.max(half).alias("half"), F.count(F.lit(1)).alias("rows")), "lengths")
    repeated = not ids.where("rows > 1").isEmpty()
    before = predecessors(ids.select("doc_id", "half"))
    heads = rows.join(before, "doc_id").select(
        F.col("prev_id").alias("doc_id"), F.col("doc_id").alias("next_id"), F.substr("text", F.lit(1), F.col("prev_half").cast("int")).alias("head"))
    own, times = rows, F.lit(1)  # the same columns as above, so that both joins share one shuffle of the texts
    if repeated:
        heads = heads.groupBy("doc_id").agg(F.min("next_id").alias("next_id"), F.min("head").alias("head"))
        own = own.groupBy("doc_id", F.xxhash64("text")).agg(F.first("text").alias("text"), F.count(F.lit(1)).alias("times"))
        times = F.col("times")
    both = own.join(heads, "doc_id").select(
        "doc_id", F.xxhash64("text").alias("row"), "next_id", times.alias("times"), F.length("text").cast("long").alias("n_chars"), "text",
        F.concat(F.substr("text", F.lit(1), (F.length("text") - half).cast("int")),
                 F.substr("head", F.lit(1), half.cast("int"))).alias("edited"))
    facts = both.select("doc_id", "row", "next_id", "times", "n_chars", F.sha2("edited", 256).alias("edited_sha256"))
    versions = both.select("doc_id", "row", F.explode(F.array(F.struct(F.lit(0).alias("v"), F.col("text").alias("text")),
                                                              F.struct(F.lit(1).alias("v"), F.col("edited").alias("text")))).alias("x"))
    prints = fingerprints(versions.select("doc_id", "row", "x.v", "x.text"), ["doc_id", "row", "v"])
    pair = prints.groupBy("doc_id", "row").agg(F.max(F.when(F.col("v") == 0, F.col("samples"))).alias("samples"),
                                               F.max(F.when(F.col("v") == 1, F.col("samples"))).alias("edited_samples"))
    none = F.array_repeat(F.lit(EMPTY).cast("long"), SAMPLES)
    made = facts.join(pair, ["doc_id", "row"], "left").withColumns(
        {c: F.coalesce(c, none) for c in ("samples", "edited_samples")})
    made = stage_table(made, "prints")
    following = made.groupBy("doc_id").agg(F.min("samples").alias("next_samples")) if repeated else made.select(
        "doc_id", F.col("samples").alias("next_samples"))
    out = made.join(following.withColumnRenamed("doc_id", "next_id"), "next_id")
    if repeated:
        out = out.withColumn("again", F.explode(F.sequence(F.lit(1), F.col("times").cast("int"))))
    return out.select(F.when(F.col("doc_id") != _NULL_ID, F.col("doc_id")).alias("doc_id"), "n_chars", "edited_sha256", "samples", "edited_samples",
                      likeness(F.col("samples"), F.col("edited_samples")).alias("near_edited"),
                      likeness(F.col("samples"), F.col("next_samples")).alias("near_next"))
