"""Registered queries: each builds the fixture world from the driver tables
and runs one operator (or the whole ingest) over all of it.

Every callable takes ``(spark, sf_dir)`` and returns a DataFrame whose
column names match the oracle SQL in ``__spark_entry__.py``.
"""

from __future__ import annotations

from dataclasses import replace
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import constants as K
from ..functions.dates import parse_sent_at
from ..functions.fingerprint import fingerprint
from ..functions.html import html_to_text, select_body
from ..functions.render import report_text
from ..functions.results import validate_answer
from ..functions.text import body_preview, clipped_body, is_truncated, request_text
from ..operators import enrich as E
from ..operators.ids import assign_dense_ids
from ..operators.pacing import pacing_plan
from ..sinks.tables import merge_cache
from ..sources import tables as TB
from . import ingest as I
from . import query as Q
from . import status as ST

RUN = TB.FIXTURE_RUN_ID
MODEL = TB.FIXTURE_MODEL
INIT_DATE = "2024-01-01"
STORE_PATH = "/data/triage"


def ts_text(col):
    return F.date_format(col, "yyyy-MM-dd HH:mm:ss")


class World:
    """The fixture world at one scale factor (all views lazy)."""

    def __init__(self, spark: SparkSession, sf_dir: str, **opts):
        self.spark, self.sf_dir = spark, sf_dir
        base = dict(run_id=RUN, model=MODEL, init_start_date=INIT_DATE, created_at=TB.FIXTURE_CREATED_AT)
        base.update(opts)
        self.opts = I.IngestOptions(**base)

    def opts_of(self, **changes) -> I.IngestOptions:
        """This world's options with some changed."""
        return replace(self.opts, **changes)

    @cached_property
    def messages(self) -> DataFrame:
        return TB.messages(self.spark, self.sf_dir)

    @cached_property
    def accounts(self) -> DataFrame:
        return TB.accounts(self.messages)

    @cached_property
    def cursors(self) -> DataFrame:
        return TB.cursors(self.messages)

    @cached_property
    def cache(self) -> DataFrame:
        return TB.cache(self.messages, self.cursors)

    @cached_property
    def responses(self) -> DataFrame:
        return TB.responses(self.spark, self.sf_dir, self.messages)

    @cached_property
    def plan(self) -> DataFrame:
        return I.run_plan(self.accounts, self.cursors, self.opts)

    @cached_property
    def batch(self) -> DataFrame:
        return I.fetch(self.messages, self.plan, self.opts)

    @cached_property
    def decisions(self) -> DataFrame:
        return E.decide(self.batch, self.cache, self.responses, self.opts.model, self.opts.force_reprocess)

    @cached_property
    def outcome(self):
        return I.outcomes(self.batch, self.cache, self.responses, self.opts)

    @cached_property
    def store(self) -> DataFrame:
        return I.with_ids(I.store_rows(self.outcome[0], self.opts), 0)


def _outcome_cols(out: DataFrame) -> DataFrame:
    r = F.col("result")
    return out.select(
        "account_id", "uid", "content_hash", "outcome", "held",
        r["original_uid"].alias("original_uid"), r["priority"].alias("priority"),
        r["summary"].alias("summary"), r["key_entities"].alias("key_entities"),
        r["action_required"].alias("action_required"), r["is_truncated"].alias("is_truncated"),
    )


# --- projections ---------------------------------------------------------------

def q_fingerprint(spark, sf):
    m = World(spark, sf).messages
    return m.select("account_id", "uid", fingerprint().alias("content_hash"))


def q_preview_truncate(spark, sf):
    m = World(spark, sf).messages
    return m.select(
        "uid",
        F.length(body_preview("body")).cast("bigint").alias("preview_len"),
        F.length(clipped_body("body")).cast("bigint").alias("clipped_len"),
        is_truncated("body").alias("is_truncated"),
        F.substring(body_preview("body"), -40, 40).alias("preview_tail"),
    )


def q_sent_at(spark, sf):
    m = World(spark, sf).messages
    return m.select("uid", "date", ts_text(parse_sent_at("date")).alias("sent_at"))


def q_request_build(spark, sf):
    m = World(spark, sf).messages
    return m.select("uid", request_text("subject", "sender", "date", clipped_body("body")).alias("prompt"))


def q_response_validate(spark, sf):
    r = World(spark, sf).responses
    a = validate_answer("raw_json")
    return r.select("content_hash", a["ok"].alias("ok"), a["priority"].alias("priority"),
                    a["summary"].alias("summary"), a["key_entities"].alias("key_entities"),
                    a["action_required"].alias("action_required"), a["error"].alias("error"))


def q_html_to_text(spark, sf):
    p = TB.table(spark, sf, "pages", "page_id", "html")
    return p.select("page_id", html_to_text("html").alias("text"))


def q_html_tangled(spark, sf):
    """P5: every page between markup that stands within other markup, and an
    anchor that never closes."""
    p = TB.table(spark, sf, "pages", "page_id", "html")
    no = F.col("page_id").cast("string")
    odd = F.concat(F.lit("<script>var s='<!--';</script><p title=\"<style>\">"), no, F.lit("</p><head-foo>k</head-foo>"), F.col("html"),
                   F.lit("<!-- <script> --><a href=/p/"), no, F.lit(">open<p>v</p>"))
    return p.select("page_id", html_to_text(odd).alias("text"))


def q_body_select(spark, sf):
    p = TB.table(spark, sf, "pages", "page_id", "html")
    d = TB.table(spark, sf, "documents", "doc_id", "text")
    j = p.join(d, p.page_id == d.doc_id, "left")
    plain = (F.when(F.col("page_id") % 4 == 0, F.col("text"))
              .when(F.col("page_id") % 4 == 1, F.lit(" \n\t ")))
    return j.select("page_id", select_body(plain, F.col("html")).alias("body"))


def q_eml_roundtrip(spark, sf):
    """Every message rendered to RFC 822 bytes and parsed back by
    the MIME job (RFC 2047 subject, base64 UTF-8 body)."""
    from ..sources.mime import parse_raw, render_plain
    m = World(spark, sf).messages
    raw = m.select("uid", render_plain().alias("content"))
    return parse_raw(raw, keep=["uid"]).select("uid", "subject", "sender", "date", "body")


def q_eml_html(spark, sf):
    """Every page as a multipart message whose plain part is blank and
    whose attachment is skipped, so the body comes from the HTML part."""
    from ..sources.mime import parse_raw, render_html_only
    p = TB.table(spark, sf, "pages", "page_id", "url", "html")
    raw = p.select("page_id", render_html_only("url", "html").alias("content"))
    return parse_raw(raw, keep=["page_id"]).select("page_id", "subject", "body")


# --- plan / source ---------------------------------------------------------------

def q_run_plan(spark, sf):
    w = World(spark, sf, init_start_date=None)
    return w.plan.drop("from_date")


def q_incremental_source(spark, sf):
    b = World(spark, sf).batch
    return b.select("account_id", "uid", "content_hash", ts_text("sent_at").alias("sent_at"), "is_truncated")


def q_high_water(spark, sf):
    w = World(spark, sf)
    return I.account_stats(w.plan, w.outcome[0]).drop("landed_date")


def q_events_incremental(spark, sf):
    """S1/S2 on the events stream: rows above each user's cursor, on or
    after the date floor."""
    m = TB.event_messages(spark, sf)
    opts = I.IngestOptions(run_id=RUN, model=MODEL, init_start_date="2024-01-10")
    plan = I.run_plan(TB.accounts(m), TB.cursors(m), opts)
    b = I.fetch(m, plan, opts)
    return b.select("account_id", "uid", "content_hash", ts_text("sent_at").alias("sent_at"))


def q_fetch_stats(spark, sf):
    """A1/A2 on the events stream: per-account count, min and max uid fetched."""
    m = TB.event_messages(spark, sf)
    opts = I.IngestOptions(run_id=RUN, model=MODEL, init_start_date="2024-01-10")
    b = I.fetch(m, I.run_plan(TB.accounts(m), TB.cursors(m), opts), opts)
    return b.groupBy("account_id").agg(F.count(F.lit(1)).alias("fetched"), F.min("uid").alias("min_uid"),
                                       F.max("uid").alias("max_uid"))


def q_conversation_latest(spark, sf):
    """W2 on conversations: the latest turn of every conversation."""
    from ..operators.latest import latest_per_key
    c = TB.table(spark, sf, "conversations", "conv_id", "turn", "role", "text")
    return latest_per_key(c, ["conv_id"], "turn").select(
        "conv_id", "turn", "role", F.length("text").cast("bigint").alias("text_len"))


def q_conversation_requests(spark, sf):
    """P8 on conversations: a request for the latest user turn of each one."""
    from ..operators.latest import latest_per_key
    c = TB.table(spark, sf, "conversations", "conv_id", "turn", "role", "text").filter(F.col("role") == "user")
    last = latest_per_key(c, ["conv_id"], "turn")
    subj = F.concat(F.lit("conversation "), F.col("conv_id").cast("string"))
    return last.select("conv_id", "turn", request_text(subj, F.col("role"), F.lit(None).cast("string"),
                                                       clipped_body("text")).alias("prompt"))


# --- cache / enrichment -------------------------------------------------------

def q_cache_probe(spark, sf):
    w = World(spark, sf)
    keys = w.batch.select("account_id", "uid", "content_hash")
    p = E.probe_cache(keys, w.cache, MODEL)
    return p.select("account_id", "uid", "content_hash", F.col("cached").isNotNull().alias("hit"),
                    F.col("cached")["priority"].alias("cached_priority"),
                    F.col("cached")["original_uid"].alias("cached_uid"))


def q_cache_miss_leaders(spark, sf):
    w = World(spark, sf)
    d = w.decisions.filter(F.col("cached").isNull())
    return d.select("content_hash", F.col("leader")["account_id"].alias("leader_account"),
                    F.col("leader")["uid"].alias("leader_uid"), F.col("copies").cast("bigint").alias("copies"))


def q_outcome_fanout(spark, sf):
    return _outcome_cols(World(spark, sf).outcome[0])


def q_replay_outcome(spark, sf):
    return _outcome_cols(World(spark, sf, force_from_uid=1).outcome[0])


def q_force_reprocess(spark, sf):
    return _outcome_cols(World(spark, sf, force_reprocess=True).outcome[0])


def q_quarantine_rows(spark, sf):
    o = _outcome_cols(World(spark, sf).outcome[0])
    return o.filter(F.col("outcome") == "quarantined").drop("outcome", "held")


def q_skip_rows(spark, sf):
    return _outcome_cols(World(spark, sf, mode="skip").outcome[0])


def q_dry_run_rows(spark, sf):
    return _outcome_cols(World(spark, sf, mode="dry").outcome[0])


def q_cache_upsert(spark, sf):
    w = World(spark, sf)
    merged = merge_cache(w.cache, w.outcome[1])
    r = F.col("result")
    return merged.select("content_hash", "account_id", "uid", "model_version",
                         r["original_uid"].alias("original_uid"), r["priority"].alias("priority"),
                         r["summary"].alias("summary"), r["key_entities"].alias("key_entities"),
                         r["action_required"].alias("action_required"), r["is_truncated"].alias("is_truncated"),
                         ts_text("created_at").alias("created_at"))


def q_cache_invalidate_count(spark, sf):
    """What the table's own invalidation reports (one account, then the rest)."""
    from ..sinks import tables as T
    lay = _fresh_layout(spark, World(spark, sf))
    one = T.invalidate_cache(spark, lay, "acct_src3")
    return spark.range(1).select(F.lit(one).cast("long").alias("removed_account"),
                                 F.lit(one + T.invalidate_cache(spark, lay)).cast("long").alias("removed_all"))


def _fresh_layout(spark, w):
    """A store in the checkpoint folder, with the fixture cursors and cache
    written by the table writers."""
    import os
    from ..session import scratch_path
    from ..sinks import tables as T
    lay = T.Layout(os.path.join(scratch_path(spark, "world"), "store"), 8)
    T.upsert_cursors(spark, lay, w.cursors)
    T.upsert_cache(spark, lay, w.cache)
    return lay


def q_cursor_listing(spark, sf):
    """The cursor table ordered by account."""
    return ST.cursor_listing(World(spark, sf).cursors).select(
        "account_id", "last_uid", ts_text("updated_at").alias("updated_at"))


def q_pacing_summary(spark, sf):
    """Calls this run makes and the minimum wall time pacing imposes."""
    from ..operators.pacing import min_run_seconds
    w = World(spark, sf)
    req = E.requests(w.batch, w.decisions, MODEL, w.opts.max_content_length)
    return min_run_seconds(req, K.DEFAULT_RATE_LIMIT_RPM)


def q_cache_invalidate(spark, sf):
    """K5 on the written table."""
    from ..sinks import tables as T
    lay = _fresh_layout(spark, World(spark, sf))
    T.invalidate_cache(spark, lay, "acct_src3")
    return T.read_cache(spark, lay).select("content_hash", "account_id", "uid", "model_version")


def q_pacing_plan(spark, sf):
    w = World(spark, sf)
    req = E.requests(w.batch, w.decisions, MODEL, w.opts.max_content_length)
    return pacing_plan(req, K.DEFAULT_RATE_LIMIT_RPM).select(
        "content_hash", "account_id", "uid", "call_seq", "slot_offset_ms")


# --- store writes -------------------------------------------------------------------

def q_emails_append(spark, sf):
    return _store_cols(World(spark, sf).store)


def _store_cols(s):
    return s.select("id", "run_id", "batch_id", "account_id", "uid", "content_hash", "subject", "sender",
                    "date", ts_text("sent_at").alias("sent_at"),
                    F.length("body_preview").cast("bigint").alias("preview_len"),
                    "priority", "summary", "key_entities", "action_required", "is_truncated",
                    "model_version", ts_text("created_at").alias("created_at"))


def q_cursor_upsert(spark, sf):
    from ..sinks.tables import merge_cursors
    w = World(spark, sf)
    stats = I.account_stats(w.plan, w.outcome[0])
    new = merge_cursors(w.cursors, I.cursor_moves(stats, w.opts))
    return new.select("account_id", "last_uid", ts_text("updated_at").alias("updated_at"))


def q_audit_rows(spark, sf):
    w = World(spark, sf)
    stats = I.account_stats(w.plan, w.outcome[0])
    a = I.audit_rows(stats, w.opts)
    return a.select("audit_id", "run_id", "account_id", ts_text("timestamp").alias("timestamp"),
                    "before_uid", "after_uid", "emails_processed", "status", "error_msg")


def q_run_summary(spark, sf):
    w = World(spark, sf)
    return I.run_summary(w.plan, w.outcome[0])


def q_stream_once(spark, sf):
    """The flagship run as a run-once stream over the landed documents
    file, committing through foreachBatch into a fresh store seeded with the
    fixture cursors and cache; returns what the store then holds."""
    import os
    from ..session import scratch_path
    from ..sinks import tables as T
    from ..streaming.stream import ingest_stream
    w = World(spark, sf)
    root = scratch_path(spark, "stream")
    lay = T.Layout(os.path.join(root, "store"), 8)
    T.upsert_cursors(spark, lay, w.cursors)
    T.upsert_cache(spark, lay, w.cache)
    docs_schema = spark.read.parquet(os.path.join(sf, "documents.parquet")).schema
    src = spark.readStream.schema(docs_schema).parquet(os.path.join(sf, "documents*.parquet"))
    ingest_stream(spark, src, lay, w.accounts, w.opts, os.path.join(root, "checkpoint"),
                  responses=w.responses, to_messages=TB.messages_from_documents)
    return _store_cols(T.read_store(spark, lay))


def q_stream_two_batches(spark, sf):
    """The same stream over two files, one per micro-batch."""
    import os
    from ..session import scratch_path
    from ..sinks import tables as T
    from ..streaming.stream import ingest_stream, landed_messages
    w = World(spark, sf)
    lay, land = _fresh_layout(spark, w), scratch_path(spark, "landed")
    middle = w.messages.agg(F.expr("percentile_approx(uid, 0.5)")).first()[0]
    halves = 8
    w.messages.filter(F.col("uid") <= middle).repartition(halves).write.parquet(os.path.join(land, "first"))
    w.messages.filter(F.col("uid") > middle).repartition(halves).write.parquet(os.path.join(land, "second"))
    ingest_stream(spark, landed_messages(spark, os.path.join(land, "*"), max_files=halves), lay, w.accounts, w.opts,
                  scratch_path(spark, "stream"), responses=w.responses)
    return T.read_store(spark, lay).select("account_id", "uid", "content_hash", "priority")


def q_replay_partial(spark, sf):
    """T4/K1: a committed batch, replayed with the same ids, changes nothing."""
    from ..sinks import tables as T
    from . import run as R
    w = World(spark, sf)
    lay, opts = _fresh_layout(spark, w), w.opts_of(batch_id=0)
    for _ in range(2):
        R.run_ingest(spark, lay, w.messages, w.accounts, opts, responses=w.responses)
    return _store_cols(T.read_store(spark, lay))


def q_delivery_failure(spark, sf):
    """One account's delivery fails: only it is held, with a FAIL row."""
    from ..sinks import tables as T
    from . import run as R
    w = World(spark, sf)
    lay = _fresh_layout(spark, w)
    R.run_ingest(spark, lay, w.messages, w.accounts, w.opts, responses=w.responses, sink=lambda df, b: ["acct_src0"])
    stored = T.read_store(spark, lay).groupBy("account_id").agg(F.count(F.lit(1)).alias("stored"))
    return (T.read_audit(spark, lay).join(stored, "account_id", "left")
            .select("account_id", "status", "emails_processed", F.coalesce("stored", F.lit(0)).alias("stored")))


def q_json_sink(spark, sf):
    """K7: the JSON files of a delivered batch, read back."""
    from ..session import scratch_path
    from ..sinks.emit import json_file_sink
    from . import run as R
    w, path = World(spark, sf), scratch_path(spark, "json")
    json_file_sink(path)(R.emitted_results(w.outcome[0], RUN), 0)
    return spark.read.text(path).select("account_id", F.col("value").alias("json"))


def q_date_floor(spark, sf):
    """Messages with zoned, undatable, missing and ISO dates against the floor."""
    k = F.col("uid") % 5
    day = F.format_string("%02d", (F.col("uid") % 28 + 1).cast("int"))
    date = (F.when(k == 0, F.concat(day, F.lit(" Dec 2023 23:30:00 EST"))).when(k == 1, F.lit("soon"))
            .when(k == 2, F.concat(F.lit("Thu, "), day, F.lit(" Feb 2024 08:15 PDT"))).when(k == 3, F.concat(F.lit("2024-01-"), day)))
    w = World(spark, sf, init_start_date="2023-12-20")
    batch = I.fetch(w.messages.withColumn("date", date), w.plan, w.opts)
    return batch.select("account_id", "uid", ts_text("sent_at").alias("sent_at"))


def q_target_account(spark, sf):
    """F8: the plan of one account's run."""
    return World(spark, sf, target_account="acct_src3").plan.drop("from_date")


def q_store_by_run(spark, sf):
    """the rows of one run, by id."""
    return _page_cols(Q.query_page(World(spark, sf).store, 0, -1, run_id=RUN))


# --- query layer -------------------------------------------------------------------

PAGE_FILTERS = dict(account_id="acct_src7", priority="High", since="2024-01-15")


def _page_cols(df):
    return df.select("id", "account_id", "uid", "priority", "date", ts_text("sent_at").alias("sent_at"))


def q_query_page(spark, sf):
    s = World(spark, sf).store
    return _page_cols(Q.query_page(s, 0, 1000, **PAGE_FILTERS))


def q_query_meta(spark, sf):
    s = World(spark, sf).store
    page = Q.query_page(s, 5, 3, account_id="acct_src7")
    return Q.page_meta(page, 5, 3)


def q_query_date_legacy(spark, sf):
    s = World(spark, sf).store
    return _page_cols(Q.query_page(s, 0, -1, since="2024-01-20", until="2024-02-10", legacy_text_dates=True))


def q_query_date_parsed(spark, sf):
    s = World(spark, sf).store
    return _page_cols(Q.query_page(s, 0, -1, since="2024-01-20", until="2024-02-10"))


def q_page_export(spark, sf):
    s = World(spark, sf).store
    return Q.export_pages(s, 25, priority="Low").select("id", "rn", "page_no")


def q_latest_per_hash(spark, sf):
    s = World(spark, sf).store
    return Q.latest_per_hash(s).select("content_hash", "id", "account_id", "uid", "priority")


def q_priority_by_run(spark, sf):
    return Q.priority_by_run(World(spark, sf).store)


def q_status(spark, sf):
    return ST.status_json(World(spark, sf).cursors, STORE_PATH)


def q_report_text(spark, sf):
    out = World(spark, sf).outcome[0]
    emitted = out.filter(~F.col("held") & (F.col("outcome") != "pending"))
    return emitted.select("account_id", "uid", report_text("result").alias("report"))


def q_json_results(spark, sf):
    """K9: every emitted result as a JSON object (the fallback rendering)."""
    from ..functions.render import json_text
    out = World(spark, sf).outcome[0]
    emitted = out.filter(~F.col("held") & (F.col("outcome") != "pending"))
    return emitted.select("account_id", "uid", json_text("result").alias("json"))


def q_table_lines(spark, sf):
    s = World(spark, sf).store
    page = Q.query_page(s, 0, 40, priority="Low")
    return Q.table_lines(page, Q.page_meta(page, 0, 40))


QUERIES = {
    "fingerprint": q_fingerprint,
    "preview_truncate": q_preview_truncate,
    "sent_at_parse": q_sent_at,
    "request_build": q_request_build,
    "response_validate": q_response_validate,
    "html_to_text": q_html_to_text,
    "html_tangled": q_html_tangled,
    "body_select": q_body_select,
    "eml_roundtrip": q_eml_roundtrip,
    "eml_html": q_eml_html,
    "events_incremental": q_events_incremental,
    "fetch_stats": q_fetch_stats,
    "conversation_latest": q_conversation_latest,
    "conversation_requests": q_conversation_requests,
    "run_plan": q_run_plan,
    "incremental_source": q_incremental_source,
    "high_water": q_high_water,
    "cache_probe": q_cache_probe,
    "cache_miss_leaders": q_cache_miss_leaders,
    "outcome_fanout": q_outcome_fanout,
    "replay_outcome": q_replay_outcome,
    "force_reprocess": q_force_reprocess,
    "quarantine_rows": q_quarantine_rows,
    "skip_rows": q_skip_rows,
    "dry_run_rows": q_dry_run_rows,
    "cache_upsert": q_cache_upsert,
    "cache_invalidate": q_cache_invalidate,
    "cache_invalidate_count": q_cache_invalidate_count,
    "cursor_listing": q_cursor_listing,
    "pacing_summary": q_pacing_summary,
    "pacing_plan": q_pacing_plan,
    "emails_append": q_emails_append,
    "stream_once": q_stream_once,
    "cursor_upsert": q_cursor_upsert,
    "audit_rows": q_audit_rows,
    "run_summary": q_run_summary,
    "query_page": q_query_page,
    "query_meta": q_query_meta,
    "query_date_legacy": q_query_date_legacy,
    "query_date_parsed": q_query_date_parsed,
    "page_export": q_page_export,
    "latest_per_hash": q_latest_per_hash,
    "priority_by_run": q_priority_by_run,
    "status": q_status,
    "report_text": q_report_text,
    "table_lines": q_table_lines,
    "json_results": q_json_results,
    "stream_two_batches": q_stream_two_batches,
    "replay_partial": q_replay_partial,
    "delivery_failure": q_delivery_failure,
    "json_sink": q_json_sink,
    "date_floor": q_date_floor,
    "target_account": q_target_account,
    "store_by_run": q_store_by_run,
}
