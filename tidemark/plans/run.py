"""O2 ingest run with one commit point.

Order of effects for one batch:

1. plan and decisions are computed; model answers (when produced by an
   enrichment callable) and the batch outcome are staged once, so every later
   step sees the same rows and a lost executor reads them again;
2. cache writes (a memo: writing it early only makes a replay cheaper);
3. sink delivery; accounts whose delivery failed are left out of what follows,
   and a sink that raises ends the batch with FAIL audit rows;
4. the batch's store rows, backlog, cursor moves and audit rows, each in its
   own (run, batch) partition, which a replay replaces;
5. the commit row: from here on all of it is visible, before it nothing is.

A crash before 5 leaves nothing that a reader sees; the cursors did not move,
so the next run fetches the messages again, with their answers in the cache.
"""

from __future__ import annotations

import time
import uuid
from dataclasses import replace
from typing import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import enrich as E
from ..operators.joins import broadcast_if_small
from ..session import ensure_checkpoint_dir, stage_table, staging_scope
from ..sinks import tables as T
from ..sinks.emit import Sink, null_sink
from . import ingest as I

Enricher = Callable[[DataFrame], DataFrame]


def new_run_id() -> str:
    """The 8-hex-char id stamped on every row of a run."""
    return uuid.uuid4().hex[:8]


def _stage(df: DataFrame, name: str = "run") -> DataFrame:
    return stage_table(df, name)


def emitted_results(out: DataFrame, run_id: str) -> DataFrame:
    return out.filter(~F.col("held") & (F.col("outcome") != "pending")).select(
        F.lit(run_id).alias("run_id"), "account_id", "uid", "result")


def run_ingest(spark: SparkSession, layout: T.Layout, messages: DataFrame, accounts: DataFrame,
               opts: I.IngestOptions, responses: DataFrame | None = None, enricher: Enricher | None = None,
               sink: Sink = null_sink, keep_backlog: bool = False) -> dict:
    """Run one batch end to end; returns the run summary as a dict.
    The run's staged tables are removed when it returns (or fails).

    Without a ``batch_id`` the batch takes the run's next free number; a given
    (run, batch) that is already committed is left as it is (``replayed``).
    ``keep_backlog`` (streaming): rows that cannot be stored yet go to a
    backlog for the next micro-batch, since a file source never re-delivers
    them, and rows below a cursor are stored if they were not before."""
    ensure_checkpoint_dir(spark)
    with staging_scope(spark):
        return _run(spark, layout, messages, accounts, opts, responses, enricher, sink, keep_backlog)


def _stream_batch(spark, layout, messages, plan, opts) -> DataFrame:
    """What a stream still has to store: every row of its files above the
    cursor that its account had when streams began. Only rows at or below the
    present cursor can be stored already; where there are any, they are looked
    up among the stored rows of their uids. Where the start is overridden (T2),
    only this run's own rows count as stored."""
    override = opts.force_from_uid is not None or opts.reset_cursor
    if override:
        wide = plan
    else:
        floors = T.stream_floors(spark, layout, plan)
        wide = plan.withColumnRenamed("start_uid", "cursor_uid").join(floors, "account_id", "left").withColumn(
            "start_uid", F.coalesce(F.col("floor_uid") + 1, "cursor_uid")).drop("floor_uid", "cursor_uid")
    batch = _stage(I.fetch(messages, wide.drop("from_date"), opts), "arrived")
    cursors = T.read_cursors(spark, layout).select("account_id", "last_uid")
    late = batch.join(broadcast_if_small(cursors), "account_id").filter("uid <= last_uid")
    low, high = late.agg(F.min("uid"), F.max("uid")).first()
    if low is None:
        return batch
    stored = T.read_store(spark, layout).filter(F.col("uid").between(low, high))
    stored = stored.filter(F.col("run_id") == opts.run_id) if override else stored
    return batch.join(stored.select("account_id", "uid"), ["account_id", "uid"], "left_anti")


def _unplaced(messages, plan, out, failed) -> DataFrame:
    """Rows that a stream must see again: of accounts that the plan leaves out
    or whose delivery failed, and rows held behind a pending answer."""
    live = plan.filter("guard_ok").select("account_id")
    held = out.filter(F.col("held") | (F.col("outcome") == "pending") | F.col("account_id").isin(failed)).select("account_id", "uid")
    return messages.join(live, "account_id", "left_anti").select(messages.columns).unionByName(
        messages.join(held, ["account_id", "uid"], "left_semi").select(messages.columns))


def _run(spark, layout, messages, accounts, opts, responses, enricher, sink, keep_backlog=False) -> dict:
    t0 = time.monotonic()
    dry = opts.dry_run
    if opts.batch_id is None:
        opts = replace(opts, batch_id=T.next_batch_id(spark, layout, opts.run_id))
    elif not dry and T.is_committed(spark, layout, opts.run_id, opts.batch_id):
        none = dict.fromkeys(["accounts", "rejected", "fetched", "llm_calls", "cache_hits", "errors", "pending", "held_back", "emitted"], 0)
        return none | {"emit_ok": True, "emit_error": None, "replayed": True, "run_id": opts.run_id, "batch_id": opts.batch_id,
                       "elapsed_sec": 0.0}
    key = (opts.run_id, opts.batch_id)
    if opts.reset_cursor and not dry and opts.batch_id == 0:
        sel = I.select_accounts(accounts, opts)
        T.upsert_cursors(spark, layout, sel.select(
            "account_id", F.lit(0).cast("bigint").alias("last_uid"), F.current_timestamp().alias("updated_at")))
    cache = T.open_cache(spark, layout)

    plan = _stage(I.run_plan(accounts, T.read_cursors(spark, layout), opts))
    batch = _stream_batch(spark, layout, messages, plan, opts) if keep_backlog else I.fetch(messages, plan, opts)

    if opts.mode == "normal" and responses is None and enricher is not None:
        dec = E.decide(batch, cache, None, opts.model, opts.force_reprocess)
        req = E.requests(batch, dec, opts.model or "", opts.max_content_length, opts.force_reprocess)
        responses = _stage(enricher(req))

    out, writes = I.outcomes(batch, cache, responses, opts)
    out, seen = I.observed(out)
    out = _stage(out)
    counted = seen.get                         # counted by the write
    if not dry and writes is not None:
        T.upsert_cache(spark, layout, writes)

    emit_error, failed = None, []
    results = emitted_results(out, opts.run_id)
    if not dry:                                # a dry run delivers nothing
        try:
            if counted["emitted"]:             # K6: an empty batch is delivered trivially
                failed = sorted(sink(results, opts.batch_id) or [])
        except Exception as exc:  # noqa: BLE001 - any sink failure holds the cursors
            emit_error = f"{type(exc).__name__}: {exc}"
    emit_ok = emit_error is None

    stats = _stage(I.account_stats(plan, out), "stats")
    if not dry:
        bad = F.col("account_id").isin(failed)
        T.append_audit(I.audit_rows(stats.filter(~bad), opts, emit_ok).unionByName(
            I.audit_rows(stats.filter(bad), opts, False)), layout, *key)
        if emit_ok:
            T.append_store(I.with_ids(I.store_rows(out.filter(~bad), opts)), layout, *key)
            if keep_backlog:
                T.write_backlog(_unplaced(messages, plan, out, failed), layout, *key)
            T.write_moves(I.cursor_moves(stats.filter(~bad), opts), layout, *key)
            lost = stats.filter(bad).agg(F.coalesce(F.sum("emitted"), F.lit(0))).first()[0] if failed else 0
            T.commit(spark, layout, *key, rows=counted["emitted"] - lost, backlog=keep_backlog)

    summary = I.account_counts(plan) | counted
    summary.update(emit_ok=emit_ok, emit_error=emit_error, failed_accounts=failed, run_id=opts.run_id, batch_id=opts.batch_id,
                   elapsed_sec=round(time.monotonic() - t0, 3))
    return summary
