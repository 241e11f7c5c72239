"""J1/J2/J4/J5/W1 + P9/P12: cache-first enrichment as set operations.

The per-message loop "probe cache -> call model -> validate -> write cache"
becomes one decision per *fingerprint*:

1. pre-aggregate the batch to one row per fingerprint (partial aggregation,
   so a fingerprint shared by a third of the batch is still one small row per
   map task), keeping the first copy (the leader, which pays the call) and
   the last copy (the writer under force-reprocess);
2. join that per-fingerprint table to the cache and to the model answers;
   both sides are keyed by fingerprint, so no key repeats and nothing skews;
3. join the decisions back to the batch on the fingerprint. The decision
   table is as large as the number of distinct fingerprints; AQE broadcasts
   it when its measured size is under the threshold, else it is a shuffle
   join whose hot partitions AQE splits.

Outcomes: ``hit`` (from the cache, or a copy of a leader that just wrote it),
``fresh`` (this row's call), ``quarantined`` (answer failed validation; each
copy fails on its own because a failure is never cached), ``pending`` (no
answer yet), ``skipped`` and ``dry`` (the two non-calling modes).
"""

from __future__ import annotations

from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import results as R
from ..functions.text import clipped_body, request_text
from .joins import broadcast_if_small, join_hot_split

if TYPE_CHECKING:
    from ..sinks.cache import CacheTable

RESULT_DDL = ("struct<original_uid:bigint,priority:string,summary:string,"
              "key_entities:array<string>,action_required:boolean,is_truncated:boolean>")


def per_fingerprint(batch: DataFrame) -> DataFrame:
    """One row per content_hash with its first and last copy."""
    k = F.struct("account_id", "uid", "is_truncated")
    return batch.groupBy("content_hash").agg(F.min(k).alias("leader"), F.max(k).alias("last"),
                                             F.count(F.lit(1)).alias("copies"))


def probe_cache(keys: DataFrame, cache: DataFrame | CacheTable, model: str | None) -> DataFrame:
    """Attach the cached result when (hash[, model]) matches. A cache on
    disk probes itself (its base stays in its buckets).

    ``model`` None/'' ignores the model, as the original lookup did.
    """
    if not isinstance(cache, DataFrame):
        return cache.probe(keys, model)
    c = cache.filter(F.col("model_version") == model) if model else cache
    return keys.join(c.select("content_hash", F.col("result").alias("cached")), "content_hash", "left")


def one_answer(responses: DataFrame, model: str | None) -> DataFrame:
    """One answer per fingerprint: of the given model, or of the last model by
    name; of several answers (every copy is asked under force) the last
    copy's where the answers carry it, else the greatest. ``error`` tells of a
    call that failed."""
    r = responses.filter(F.col("model_version") == model) if model else responses
    error = F.col("error") if "error" in r.columns else F.lit(None).cast("string")
    place = [c for c in ("model_version", "account_id", "uid", "raw_json") if c in r.columns]
    return (r.groupBy("content_hash").agg(F.max_by(F.struct("raw_json", error.alias("error")), F.struct(*place)).alias("a"))
             .select("content_hash", "a.raw_json", F.col("a.error").alias("call_error")))


def decide(batch: DataFrame, cache: DataFrame | CacheTable | None, responses: DataFrame | None,
           model: str | None, force: bool = False, normalize_case: bool = False) -> DataFrame:
    """Per-fingerprint decision table for the normal (calling) mode."""
    keys = per_fingerprint(batch)
    if force or cache is None:
        keys = keys.withColumn("cached", F.lit(None).cast(RESULT_DDL))
    else:
        keys = probe_cache(keys, cache, model)
    if responses is not None:
        keys = keys.join(one_answer(responses, model), "content_hash", "left")
    else:
        null = F.lit(None).cast("string")
        keys = keys.withColumns({"raw_json": null, "call_error": null})
    failed = F.col("call_error").isNotNull()
    keys = keys.withColumn("raw_json", F.when(failed, F.lit("")).otherwise(F.col("raw_json")))
    answer = F.when(F.col("cached").isNull() & F.col("raw_json").isNotNull(), R.validate_answer("raw_json", normalize_case))
    answer = answer.withField("ok", answer["ok"] & ~failed).withField("error", F.coalesce("call_error", answer["error"]))
    return keys.withColumn("answer", answer).drop("raw_json", "call_error")


def attach(batch: DataFrame, decisions: DataFrame, force: bool = False, hot_rows: int | None = None) -> DataFrame:
    """J5 fan-out: every row gets its outcome and result from its fingerprint.

    Fingerprints with at least ``hot_rows`` copies are attached by a checked
    broadcast of their decisions; the rest by a shuffle join (join_hot_split).
    """
    j = join_hot_split(batch, decisions, "content_hash", "copies", hot_rows).drop("copies")
    ans, cached, leader = F.col("answer"), F.col("cached"), F.col("leader")
    is_leader = (F.col("account_id") == leader["account_id"]) & (F.col("uid") == leader["uid"])
    outcome = (F.when(cached.isNotNull(), F.lit("hit"))
                .when(ans.isNull(), F.lit("pending"))
                .when(~ans["ok"], F.lit("quarantined"))
                .when(F.lit(force) | is_leader, F.lit("fresh"))
                .otherwise(F.lit("hit")))
    j = j.withColumn("outcome", outcome)          # computed once, referenced below
    o = F.col("outcome")
    restamped = cached.withField("original_uid", F.col("uid"))           # C7: own uid
    result = (F.when(o == "pending", F.lit(None))
               .when(cached.isNotNull(), restamped)
               .when(o == "quarantined", R.quarantine_result("uid", ans["error"]))
               .when(o == "fresh", R.answer_result(ans, "uid", "is_truncated"))
               .otherwise(R.answer_result(ans, "uid", leader["is_truncated"])))
    return (j.withColumn("result", result)
             .withColumn("error", F.when(o == "quarantined", ans["error"]))
             .withColumn("called", (o == "fresh") | (o == "quarantined"))
             .drop("cached", "answer", "leader", "last"))


def cache_writes(decisions: DataFrame, model: str, created_at: Column, force: bool = False) -> DataFrame:
    """K4 input: one row per fingerprint whose call succeeded in this batch.

    The writer is the leader, or the last copy under force-reprocess (every
    copy is called and the last write wins).
    """
    w = F.col("last") if force else F.col("leader")
    ok = decisions.filter(F.col("answer").isNotNull() & F.col("answer")["ok"])
    return ok.select(
        "content_hash", w["account_id"].alias("account_id"), w["uid"].alias("uid"),
        R.answer_result("answer", w["uid"], w["is_truncated"]).alias("result"),
        F.lit(model).alias("model_version"), created_at.alias("created_at"),
    )


def non_calling(batch: DataFrame, mode: str) -> DataFrame:
    """Results for skip-enrichment and dry-run modes."""
    if mode == "skip":
        res, out = R.skip_result("uid", "subject"), "skipped"
    elif mode == "dry":
        res, out = R.dry_run_result("uid", "subject", "is_truncated"), "dry"
    else:
        raise ValueError(mode)
    return (batch.withColumn("outcome", F.lit(out)).withColumn("result", res)
                 .withColumn("error", F.lit(None).cast("string")).withColumn("called", F.lit(False)))


def requests(batch: DataFrame, decisions: DataFrame, model: str, max_len: int, force: bool = False) -> DataFrame:
    """The model requests this batch needs, one per fingerprint to call
    (every copy under force), with the clipped body and the prompt text."""
    need = decisions.filter(F.col("cached").isNull())
    if force:
        j = join_hot_split(batch, need.select("content_hash", "copies"), "content_hash", "copies")
    else:
        # only the leader row calls: join on its full key, unique on both sides
        leaders = need.select("content_hash", F.col("leader")["account_id"].alias("account_id"),
                              F.col("leader")["uid"].alias("uid"))
        j = batch.join(leaders, ["content_hash", "account_id", "uid"])
    clipped = clipped_body("body", max_len)
    return j.select(
        "content_hash", F.lit(model).alias("model_version"), "account_id", "uid",
        request_text("subject", "sender", "date", clipped).alias("prompt"),
    )


def hold_back_pending(out: DataFrame) -> DataFrame:
    """Rows at or above an account's first pending uid wait for the next run,
    so the cursor never passes an undecided message and a later replay does
    not append a row twice. Adds ``held BOOLEAN``."""
    floor = (out.filter(F.col("outcome") == "pending")
                .groupBy("account_id").agg(F.min("uid").alias("_pending_floor")))
    j = out.join(broadcast_if_small(floor), "account_id", "left")   # one row per account
    held = F.coalesce(F.col("uid") >= F.col("_pending_floor"), F.lit(False))
    return j.withColumn("held", held).drop("_pending_floor")
