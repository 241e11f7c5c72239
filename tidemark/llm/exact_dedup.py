"""Operator 9: exact deduplication by progressive refinement.

Texts are equal when they agree after every white-space character is deleted.
Candidates are refined in three steps, each reading more of a text than the
one before, and only for the rows that are still ambiguous:

1. length of the normalised text;
2. hash of its first ``PREFIX`` characters;
3. SHA-256 of the whole normalised text, only for rows whose
   (length, prefix hash) occurs at least twice.

Steps 1 and 2 are one aggregation over 16-byte keys, combined on the map side,
so a group with a third of all rows reaches the reducer as one row per task.
Step 3 joins the surviving keys (unique) back to the texts: small key tables
are broadcast by the planner after measuring them, larger ones are a
sort-merge join whose hot keys AQE splits. Only digests, never texts, are
grouped.

Defined results: null text equals empty text, which equals a text of white
space only. Rows with the same text and doc_id tie; ``row_rank`` breaks the
tie, so exactly one row of a group has ``kept``. A null doc_id sorts last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import keep_columns, text_of, without_white_space
from tidemark.session import stage_table

#: Characters of the normalised text that step 2 hashes.
PREFIX = 64
#: Characters of the raw text in which step 2 first looks for them.
HEAD = 256


def _keyed(docs: DataFrame) -> DataFrame:
    """Rows with the keys of steps 1 and 2."""
    text = text_of()
    head = without_white_space(F.substring(text, 1, HEAD))
    whole = without_white_space(text)
    prefix = F.when(F.length(head) >= PREFIX, F.substring(head, 1, PREFIX)).otherwise(F.substring(whole, 1, PREFIX))
    return docs.select("*", F.length(whole).cast("long").alias("__len"), F.xxhash64(prefix).alias("__head"))


def refine(docs: DataFrame, digest_all: bool = False) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_chars, digest, ambiguous.

    ``digest`` is the SHA-256 of the normalised text. It is taken only for
    rows that survive steps 1 and 2, or for all rows with ``digest_all``.
    The result is staged, so every later read sees the same row ranks.
    """
    narrow = docs.select("doc_id", "text")
    # staged, so that the join knows its size, and where it is large splits its hot keys
    keys = stage_table(_keyed(narrow).groupBy("__len", "__head").agg(F.count(F.lit(1)).alias("__n"))
                       .where("__n > 1").select("__len", "__head", F.lit(True).alias("ambiguous")), "keys")
    rows = _keyed(narrow).join(keys, ["__len", "__head"], "left")
    full = F.sha2(without_white_space(text_of()), 256)
    ambiguous = F.coalesce("ambiguous", F.lit(False))
    out = rows.select("doc_id", F.length(text_of()).cast("long").alias("n_chars"),
                      (full if digest_all else F.when(ambiguous, full)).alias("digest"),
                      ambiguous.alias("ambiguous"), F.monotonically_increasing_id().alias("row_rank"))
    return stage_table(out, "exact")


def exact_groups(docs: DataFrame, digest_all: bool = False) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_chars, digest, keep_id,
    group_size, kept. Of equal texts the row with the most characters, then
    the smallest doc_id, then the smallest row_rank stays."""
    rows = refine(docs, digest_all)
    rank = F.struct("n_chars", F.col("doc_id").isNotNull().alias("has_id"), (-F.col("doc_id")).alias("neg_id"),
                    (-F.col("row_rank")).alias("neg_rank"))
    found = (rows.where("ambiguous").groupBy("digest")
              .agg(F.max(rank).alias("best"), F.count(F.lit(1)).alias("n"))
              .where("n > 1")
              .select(F.col("digest").alias("__digest"), (-F.col("best.neg_id")).alias("__keep"),
                      (-F.col("best.neg_rank")).alias("__rank"), F.col("n").alias("__n")))
    groups = stage_table(found, "groups")
    joined = rows.join(groups, F.col("ambiguous") & (F.col("digest") == F.col("__digest")), "left")
    alone = F.col("__n").isNull()
    return joined.select(
        "doc_id", "n_chars", "digest",
        F.when(alone, F.col("doc_id")).otherwise(F.col("__keep")).alias("keep_id"),
        F.coalesce("__n", F.lit(1)).cast("long").alias("group_size"),
        (alone | (F.col("row_rank") == F.col("__rank"))).alias("kept"))


def drop_exact_copies(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, all columns as they are. A row is known
    by (doc_id, length, digest); of rows that agree in all three, one stays."""
    groups = stage_table(exact_groups(docs).where("group_size > 1"), "copies")
    marks = (groups.groupBy("doc_id", "n_chars", "digest")
             .agg(F.max("kept").alias("__kept"), F.count(F.lit(1)).alias("__times"))
             .where("not __kept or __times > 1")
             .select(F.col("doc_id").alias("__id"), F.col("n_chars").alias("__n"), F.col("digest").alias("__digest"),
                     "__kept", "__times"))
    marked = (docs.withColumn("__d", F.sha2(without_white_space(text_of()), 256))
              .join(marks, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.length(text_of()) == F.col("__n"))
                    & (F.col("__d") == F.col("__digest")), "left"))
    once = keep_columns(docs, marked.where("__times is null or (__kept and __times = 1)"))
    if marks.where("__kept and __times > 1").isEmpty():
        return once
    whole_row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    again = (marked.where("__kept and __times > 1").groupBy("__id", "__d").agg(F.max(whole_row).alias("__row"))
             .select(*[F.col(f"__row.`{c}`").alias(c) for c in docs.columns]))
    return once.unionByName(again)
