"""O1 run plan, S1/S2 incremental source, O2 ingest outcome and its
per-account bookkeeping (A1/A2/A6/A7) and run summary (A3).

Everything here is lazy and write-free; ``tidemark.plans.run`` performs
the writes in replay-safe order.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from .. import constants as K
from ..functions.dates import check_day, day_start, parse_sent_at
from ..functions.fingerprint import fingerprint
from ..functions.results import flatten_result
from ..functions.text import body_preview, is_truncated
from ..operators import enrich as E
from ..operators.ids import assign_dense_ids
from ..operators.joins import broadcast_limit
from ..session import stage_table


#: Days that a message may land out of the order of its account's uids.
LANDING_SLACK = 2


@dataclass
class IngestOptions:
    run_id: str
    model: str | None = None
    batch_id: int | None = None        # None: the run's next free one (0 in plans that write nothing)
    mode: str = "normal"               # normal | skip | dry
    force_reprocess: bool = False
    max_content_length: int = K.MAX_CONTENT_LENGTH
    init_start_date: str | None = None
    force_from_uid: int | None = None
    reset_cursor: bool = False
    target_account: str | None = None
    created_at: str | None = None      # fixed timestamp text; None -> current_timestamp()
    hold_pending: bool = True
    normalize_case: bool = False       # take a priority in any letter case (C21)
    hot_rows: int | None = None        # copies that make a fingerprint "hot" (skew split)

    def __post_init__(self):
        check_day(self.init_start_date)   # C12: a bad date fails before any work
        if self.mode not in ("normal", "skip", "dry"):
            raise ValueError(f"unknown mode {self.mode!r}")

    @property
    def dry_run(self) -> bool:
        return self.mode == "dry"

    def created_at_col(self) -> Column:
        if self.created_at:
            return F.lit(self.created_at).cast("timestamp")
        return F.current_timestamp()


def select_accounts(accounts: DataFrame, opts: IngestOptions) -> DataFrame:
    """F8: the accounts of this run; an unknown target account is an error."""
    if not opts.target_account:
        return accounts
    sel = accounts.filter(F.col("account_id") == opts.target_account)
    if not sel.limit(1).count():
        raise ValueError(f"Account {opts.target_account} not found")
    return sel


def run_plan(accounts: DataFrame, cursors: DataFrame, opts: IngestOptions) -> DataFrame:
    """O1 (+F11, T2, S5): one row per selected account.

    stored_uid    cursor before the run (0 after reset, 0 when absent)
    start_uid     first uid to read (force_from_uid overrides the cursor)
    before_uid    start_uid - 1 (what the audit reports)
    guard_ok      False on a first run without force/init date (not processed)
    from_date     the day on which the cursor's message landed, where the cursor
                  tells it and is not overridden; older days hold nothing new
    """
    sel = select_accounts(accounts, opts)
    landed = F.col("landed_date") if "landed_date" in cursors.columns else F.lit(None).cast("date")
    p = sel.join(cursors.select("account_id", "last_uid", landed.alias("landed_date")), "account_id", "left")
    stored = F.lit(0).cast("bigint") if opts.reset_cursor else F.coalesce(F.col("last_uid"), F.lit(0)).cast("bigint")
    start = F.lit(opts.force_from_uid).cast("bigint") if opts.force_from_uid is not None else stored + 1
    guard = ~((start == 1) & F.lit(not opts.force_from_uid) & F.lit(not opts.init_start_date))
    return p.select(
        "account_id",
        stored.alias("stored_uid"),
        start.alias("start_uid"),
        (start - 1).alias("before_uid"),
        guard.alias("guard_ok"),
        (F.lit(None).cast("date") if opts.reset_cursor or opts.force_from_uid is not None else F.col("landed_date")).alias("from_date"),
    )


def _landed(src: DataFrame, go: DataFrame, max_rows: int) -> DataFrame:
    """S1/S2 on a table partitioned by ``received_date``: ``src`` with each
    row's ``start_uid``. Accounts whose cursor tells its landing day read the
    days from ``LANDING_SLACK`` before it on: their (account, day) pairs join
    on the partition column, so the scan is pruned while it is planned to run.
    New accounts, and messages without a day, are branches of their own."""
    last = src.agg(F.max("received_date")).first()[0]
    known = go.filter("from_date IS NOT NULL")
    first = F.date_sub("from_date", LANDING_SLACK)
    days = known.filter(first <= F.lit(last)).select("account_id", "start_uid", F.explode(F.sequence(first, F.lit(last))).alias("received_date"))
    # pairs are bounded by accounts times days, and counted
    days = F.broadcast(days) if days.limit(max_rows + 1).count() <= max_rows else days
    rows = [src.join(days, ["account_id", "received_date"]).select(*src.columns, "start_uid"),
            src.filter("received_date IS NULL").join(F.broadcast(known.select("account_id", "start_uid")), "account_id").select(*src.columns, "start_uid")]
    new = go.filter("from_date IS NULL").select("account_id", "start_uid")
    if not new.isEmpty():
        rows.append(src.join(F.broadcast(new), "account_id").select(*src.columns, "start_uid"))
    return reduce(DataFrame.unionByName, rows)


def fetch(messages: DataFrame, plan: DataFrame, opts: IngestOptions) -> DataFrame:
    """Messages above each account's start uid (and on/after the
    init date), with fingerprint, clip flag and parsed send time.

    After the fingerprint and the clip flag are taken, ``body`` keeps only
    the characters any later step reads (the stored preview and the model
    request clip), so full bodies never enter a shuffle.

    The smallest start uid over all accounts (one number from the small
    plan) is also applied as a literal ``uid >=`` filter: it reaches the
    Parquet scan as a pushed filter, so row groups holding only uids below
    every cursor are skipped instead of read and joined away."""
    go = plan.filter("guard_ok").select("account_id", "start_uid", *(c for c in ["from_date"] if c in plan.columns))
    # one small job on the per-account plan: its size (checked bound for the
    # broadcast) and the lowest start uid
    n, lo = go.agg(F.count(F.lit(1)), F.min("start_uid")).first()
    go = F.broadcast(go) if n <= broadcast_limit(go) else go
    src = messages.filter(F.col("uid") >= F.lit(int(lo))) if lo is not None else messages.filter(F.lit(False))
    if "received_date" in src.columns and "from_date" in go.columns:
        b = _landed(src, go, broadcast_limit(go))
    else:
        b = src.join(go.drop("from_date"), "account_id")
    b = b.filter(F.col("uid") >= F.col("start_uid")).drop("start_uid")
    b = b.withColumn("sent_at", parse_sent_at("date"))
    if opts.init_start_date:
        # the landed receive date decides where there is one, else the header's; an undatable message is kept
        at = F.coalesce(F.col("received_date").cast("timestamp_ntz"), F.col("sent_at")) if "received_date" in b.columns else F.col("sent_at")
        b = b.filter(F.coalesce(at >= day_start(opts.init_start_date), F.lit(True)))   # names ``at`` once: it is parsed where it stands
    keep = max(K.BODY_PREVIEW_CHARS, opts.max_content_length)
    return (b.withColumn("content_hash", fingerprint())
             .withColumn("is_truncated", is_truncated("body", opts.max_content_length))
             .withColumn("body", F.substring(F.coalesce(F.col("body"), F.lit("")), 1, keep)))


def stage(df: DataFrame, name: str = "stage") -> DataFrame:
    """Materialise once as a table in the shared checkpoint folder (named by
    ``spark.checkpoint.dir``): later steps that read the frame several times
    see one snapshot, read only the columns they need, and a lost executor
    re-reads the table instead of recomputing the plan."""
    return stage_table(df, name)


def outcomes(batch: DataFrame, cache: DataFrame | None, responses: DataFrame | None,
             opts: IngestOptions, staged: bool = True) -> tuple[DataFrame, DataFrame | None]:
    """O2 enrichment: (rows with outcome/result/held, cache writes or None).

    The batch feeds the per-fingerprint aggregate, the fan-out join and the
    hold-back step, so with ``staged`` it is materialised once first (and the
    fanned-out rows once more before the per-account hold-back)."""
    if opts.mode in ("skip", "dry"):
        out = E.non_calling(batch, opts.mode).withColumn("held", F.lit(False))
        return out, None
    if staged:
        batch = stage(batch, "batch")
    dec = E.decide(batch, cache, responses, opts.model, opts.force_reprocess, opts.normalize_case)
    if staged:
        dec = stage(dec, "decisions")   # read by the hot-key check, the fan-out and the cache writes
    out = E.attach(batch, dec, opts.force_reprocess, opts.hot_rows)
    if opts.hold_pending:
        out = E.hold_back_pending(stage(out, "fanout") if staged else out)
    else:
        out = out.withColumn("held", F.lit(False))
    writes = E.cache_writes(dec, opts.model or "", opts.created_at_col(), opts.force_reprocess)
    return out, writes


def store_rows(out: DataFrame, opts: IngestOptions) -> DataFrame:
    """K1 content (without ids): the emitted rows in store layout."""
    emitted = out.filter(~F.col("held") & (F.col("outcome") != "pending"))
    model = F.lit(None).cast("string") if opts.mode == "skip" else F.lit(opts.model).cast("string")
    return emitted.select(
        F.lit(opts.run_id).alias("run_id"), F.lit(opts.batch_id or 0).cast("bigint").alias("batch_id"),
        "account_id", "uid", "content_hash", "subject", "sender", "date", "sent_at",
        body_preview("body").alias("body_preview"),
        *flatten_result("result"),
        model.alias("model_version"), opts.created_at_col().alias("created_at"),
    )


def with_ids(rows: DataFrame, base: int | Column = 0) -> DataFrame:
    """L4: ids in processing order (accounts in config order, then uid)."""
    return assign_dense_ids(rows, ["account_id", "uid"], base, "id")


def account_stats(plan: DataFrame, out: DataFrame) -> DataFrame:
    """A1/A2/A7 per processed account: fetched count/min/max, emitted count,
    the new high-water mark and whether the cursor moves (``out`` has one
    row per fetched message)."""
    fetched = out.groupBy("account_id").agg(
        F.count(F.lit(1)).alias("fetched"), F.min("uid").alias("min_uid"), F.max("uid").alias("max_uid"))
    em = out.filter(~F.col("held") & (F.col("outcome") != "pending"))
    landed = F.col("received_date") if "received_date" in out.columns else F.lit(None).cast("date")
    emitted = em.groupBy("account_id").agg(F.count(F.lit(1)).alias("emitted"), F.max("uid").alias("max_emitted"),
                                           F.max_by(landed, "uid").alias("landed_date"))
    p = plan.filter("guard_ok").select("account_id", "before_uid", "start_uid")
    j = p.join(fetched, "account_id", "left").join(emitted, "account_id", "left")
    fetched_n = F.coalesce(F.col("fetched"), F.lit(0)).cast("bigint")
    emitted_n = F.coalesce(F.col("emitted"), F.lit(0)).cast("bigint")
    after = F.greatest(F.coalesce(F.col("max_emitted"), F.col("before_uid")), F.col("before_uid"))
    return j.select(
        "account_id", "before_uid", "start_uid",
        fetched_n.alias("fetched"), F.col("min_uid"), F.col("max_uid"),
        emitted_n.alias("emitted"), after.alias("after_uid"), "landed_date",
        (after >= F.col("start_uid")).alias("advances"),
        F.concat(F.col("before_uid").cast("string"), F.lit(K.MOVEMENT[0]), after.cast("string"),
                 F.lit(K.MOVEMENT[1]), (after - F.col("start_uid") + 1).cast("string"), F.lit(K.MOVEMENT[2])).alias("movement"),
    )


def audit_rows(stats: DataFrame, opts: IngestOptions, emit_ok: bool = True) -> DataFrame:
    """A6/K3 content: one audit row per processed account with work or with
    nothing new; accounts whose rows were all held back write none."""
    ts = opts.created_at_col()
    nothing = F.col("fetched") == 0
    s = stats.filter(nothing | (F.col("emitted") > 0))
    if emit_ok:
        after = F.when(nothing, F.col("before_uid")).otherwise(F.col("after_uid"))
        n = F.when(nothing, F.lit(0)).otherwise(F.col("emitted"))
        status, msg = F.lit(K.AUDIT_SUCCESS), F.when(nothing, F.lit(K.AUDIT_NO_NEW)).otherwise(F.lit(""))
    else:
        after = F.col("before_uid")
        n = F.lit(0)
        status = F.when(nothing, F.lit(K.AUDIT_SUCCESS)).otherwise(F.lit(K.AUDIT_FAIL))
        msg = F.when(nothing, F.lit(K.AUDIT_NO_NEW)).otherwise(F.lit(K.AUDIT_EMIT_FAILED))
    return s.select(
        F.concat(F.lit(opts.run_id + ":" + str(opts.batch_id or 0) + ":"), F.col("account_id")).alias("audit_id"),
        F.lit(opts.run_id).alias("run_id"), F.lit(opts.batch_id or 0).cast("bigint").alias("batch_id"),
        "account_id", ts.alias("timestamp"),
        F.col("before_uid").cast("bigint").alias("before_uid"), after.cast("bigint").alias("after_uid"),
        n.cast("bigint").alias("emails_processed"), status.alias("status"), msg.alias("error_msg"),
    )


def cursor_moves(stats: DataFrame, opts: IngestOptions) -> DataFrame:
    """K2 input: accounts whose cursor advances (after a successful emit)."""
    return stats.filter(F.col("advances") & (F.col("emitted") > 0)).select(
        "account_id", F.col("after_uid").cast("bigint").alias("last_uid"),
        opts.created_at_col().alias("updated_at"), "landed_date")


def batch_counters() -> dict[str, Column]:
    """A3: what a batch's rows (with outcome and held) are counted for."""
    live = ~F.col("held")
    return {
        "fetched": F.count(F.lit(1)),
        "llm_calls": F.count_if((F.col("outcome") == "fresh") & live),
        "cache_hits": F.count_if((F.col("outcome") == "hit") & live),
        "errors": F.count_if((F.col("outcome") == "quarantined") & live),
        "pending": F.count_if(F.col("outcome") == "pending"),
        "held_back": F.count_if(F.col("held")),
        "emitted": F.count_if(live & (F.col("outcome") != "pending")),
    }


def observed(out: DataFrame) -> tuple[DataFrame, Observation]:
    """``out`` and its counters, which are there once it has been written: the
    write itself counts, so that no pass over the rows is spent on them."""
    seen = Observation()
    return out.observe(seen, *[c.alias(name) for name, c in batch_counters().items()]), seen


def account_counts(plan: DataFrame) -> dict[str, int]:
    """The accounts of the plan, and those that the first-run guard rejected."""
    return plan.agg(F.count(F.lit(1)).alias("accounts"), F.count_if(~F.col("guard_ok")).alias("rejected")).first().asDict()


def run_summary(plan: DataFrame, out: DataFrame) -> DataFrame:
    """A3: one row of run counters (accounts counts every selected account,
    including ones the first-run guard rejected). Counted per account first,
    then folded over the plan with an equi-join."""
    per = out.groupBy("account_id").agg(*[c.alias(name) for name, c in batch_counters().items()])
    j = plan.select("account_id", "guard_ok").join(per, "account_id", "left")
    return j.agg(
        F.count(F.lit(1)).alias("accounts"), F.count_if(~F.col("guard_ok")).alias("rejected"),
        *[F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias(c) for c in batch_counters()],
    )
