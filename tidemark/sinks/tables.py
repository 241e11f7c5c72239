"""The store, cursors, audit and backlog on Parquet.

Every batch writes its own ``run_id=../batch_id=..`` partition of each table,
replacing whatever an earlier try left there, and then appends one row to
``commits``. That row is the only commit point: rows, cursor moves and backlog
of a batch exist for readers once it is there, and never before. A crash
before it leaves a partition that nobody sees and that the next try replaces;
there is nothing to roll forward or back.

  emails/   append-only store; a row holds its position in its batch
  moves/    cursor moves; a cursor is the last committed move (K2, T1)
  backlog/  what a stream's batch could not place yet, as a whole
  audit/    audit rows, of failed batches too
  commits/  one row per batch: its number, and how many positions it uses
  floors/   where streams began

Ids (L4) come from the commits: a batch's ids follow those of all batches
committed before it, by (number, run, batch). They are dense, never given
twice, and need no reservation. Runs that commit at the same moment share a
number and are told apart by name. Commits hold a row per batch; the offsets
that follow are broadcast to the store's partitions.
"""

from __future__ import annotations

import os
import uuid
from itertools import accumulate

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schemas as S
from ..operators.joins import broadcast_if_small
from .cache import CacheTable, invalidate_cache, merge_cache, open_cache, read_cache, remaining_after_invalidate, upsert_cache  # noqa: F401
from .files import append_parquet, delete, exists, make_folder, read_parquet

CACHE_BUCKETS = 64
KEY = ["run_id", "batch_id"]
COMMITS = T.StructType([T.StructField("run_id", T.StringType(), False), T.StructField("batch_id", T.LongType(), False),
                        T.StructField("seq", T.LongType(), False), T.StructField("rows", T.LongType(), False),
                        T.StructField("backlog", T.BooleanType(), False)])
POSITIONED = T.StructType([T.StructField("position", T.LongType(), False), *S.EMAILS.fields[1:]])
MOVES = T.StructType([*S.CURSORS.fields, T.StructField("landed_date", T.DateType()), *COMMITS.fields[:2]])


class Layout:
    """The folders of a store under ``root``."""

    def __init__(self, root: str, cache_buckets: int = CACHE_BUCKETS):
        self.root, self.cache_buckets = root, cache_buckets
        for name in ("emails", "moves", "backlog", "audit", "commits", "floors", "cache"):
            setattr(self, name, os.path.join(root, name))


def _write_batch(rows: DataFrame, base: str, run_id: str, batch_id: int) -> None:
    """``rows`` as the whole of one batch's partition, also where they are none."""
    name = rows.sparkSession._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName(run_id)
    rows.drop(*KEY).write.mode("overwrite").parquet(os.path.join(base, f"run_id={name}", f"batch_id={int(batch_id)}"))


# --- commits (T1, L4) --------------------------------------------------------

def commits(spark: SparkSession, layout: Layout) -> DataFrame:
    """One row per committed batch."""
    rows = read_parquet(spark, layout.commits, COMMITS)
    return rows.groupBy(*KEY).agg(F.min("seq").alias("seq"), F.max("rows").alias("rows"), F.max("backlog").alias("backlog"))


def commit(spark: SparkSession, layout: Layout, run_id: str, batch_id: int, rows: int = 0, backlog: bool = False) -> None:
    """The last step of a batch; ``rows`` positions of the store are its own."""
    seq = commits(spark, layout).agg(F.coalesce(F.max("seq"), F.lit(0))).first()[0] + 1
    row = spark.createDataFrame([(run_id, int(batch_id), seq, int(rows), backlog)], COMMITS)
    append_parquet(row.coalesce(1), layout.commits)


def is_committed(spark: SparkSession, layout: Layout, run_id: str, batch_id: int) -> bool:
    return not commits(spark, layout).filter((F.col("run_id") == run_id) & (F.col("batch_id") == batch_id)).isEmpty()


def next_batch_id(spark: SparkSession, layout: Layout, run_id: str) -> int:
    """The first batch number that no committed or audited batch of the run has."""
    used = commits(spark, layout).select(*KEY).unionByName(read_audit(spark, layout).select(*KEY))
    last = used.filter(F.col("run_id") == run_id).agg(F.max("batch_id")).first()[0]
    return 0 if last is None else int(last) + 1


def offsets(spark: SparkSession, layout: Layout, after_id: int = 0) -> DataFrame:
    """run_id, batch_id, and the id before the batch's first, of the batches
    with ids above ``after_id``; the driver adds up a number per batch."""
    done = commits(spark, layout).orderBy("seq", *KEY).collect()
    ends = accumulate(r["rows"] for r in done)
    rows = [(r["run_id"], r["batch_id"], end - r["rows"]) for r, end in zip(done, ends, strict=True) if end > after_id]
    return spark.createDataFrame(rows, "run_id string, batch_id long, before long")


# --- the store (K1, S4) ------------------------------------------------------

def append_store(numbered: DataFrame, layout: Layout, run_id: str, batch_id: int) -> None:
    """A batch's rows, whose ``id`` counts from 1 within it. Range-partitioned,
    so that every task writes one file of positions of its own."""
    rows = numbered.withColumnRenamed("id", "position").select(*POSITIONED.fieldNames())
    _write_batch(rows.repartitionByRange("position").sortWithinPartitions("position"), layout.emails, run_id, batch_id)


def read_store(spark: SparkSession, layout: Layout, after_id: int = 0) -> DataFrame:
    """The rows of committed batches, with their ids. Batches whose ids all
    lie at or below ``after_id`` drop out in a join on the partition columns."""
    rows = read_parquet(spark, layout.emails, POSITIONED)
    joined = rows.join(broadcast_if_small(offsets(spark, layout, after_id)), KEY)
    out = joined.withColumn("id", F.col("before") + F.col("position")).select(*S.EMAILS.fieldNames())
    return out.filter(F.col("id") > after_id) if after_id else out


# --- cursors (K2, S5, S6) ----------------------------------------------------

def write_moves(moves: DataFrame, layout: Layout, run_id: str, batch_id: int) -> None:
    """The cursor moves that take effect when the batch is committed."""
    if "landed_date" not in moves.columns:
        moves = moves.withColumn("landed_date", F.lit(None).cast("date"))
    _write_batch(moves.select(*MOVES.fieldNames()[:4]), layout.moves, run_id, batch_id)


def read_cursors(spark: SparkSession, layout: Layout) -> DataFrame:
    """The last committed move of each account (which may go backwards)."""
    rows = read_parquet(spark, layout.moves, MOVES).join(broadcast_if_small(commits(spark, layout).select(*KEY, "seq")), KEY)
    last = rows.groupBy("account_id").agg(
        F.max_by(F.struct("last_uid", "updated_at", "landed_date"), F.struct("seq", *KEY)).alias("r"))
    return last.select("account_id", "r.last_uid", "r.updated_at", "r.landed_date")


def merge_cursors(current: DataFrame, moves: DataFrame) -> DataFrame:
    """K2 as a function of two tables: the move wins over the cursor."""
    tagged = (current.select("account_id", "last_uid", "updated_at", F.lit(0).alias("_w"))
                     .unionByName(moves.select("account_id", "last_uid", "updated_at", F.lit(1).alias("_w"))))
    latest = tagged.groupBy("account_id").agg(F.max_by(F.struct("last_uid", "updated_at"), F.col("_w")).alias("r"))
    return latest.select("account_id", "r.last_uid", "r.updated_at")


def upsert_cursors(spark: SparkSession, layout: Layout, moves: DataFrame) -> None:
    """K2 on its own (a reset, an import): a commit without rows."""
    run_id = f"cursors-{uuid.uuid4().hex[:12]}"
    write_moves(moves, layout, run_id, 0)
    commit(spark, layout, run_id, 0)


# --- audit (K3) --------------------------------------------------------------

def read_audit(spark: SparkSession, layout: Layout) -> DataFrame:
    return read_parquet(spark, layout.audit, S.AUDIT).select(*S.AUDIT.fieldNames())


def append_audit(rows: DataFrame, layout: Layout, run_id: str, batch_id: int) -> None:
    """Keyed by audit_id (run:batch:account); a replay replaces its own rows."""
    _write_batch(rows.select(*S.AUDIT.fieldNames()), layout.audit, run_id, batch_id)


# --- what streams keep -------------------------------------------------------

BACKLOG = T.StructType([*S.MESSAGE.fields, *COMMITS.fields[:2]])
FLOORS = T.StructType([T.StructField("account_id", T.StringType()), T.StructField("floor_uid", T.LongType())])


def read_backlog(spark: SparkSession, layout: Layout) -> DataFrame:
    """Messages that the last committed stream batch could not place."""
    last = commits(spark, layout).filter("backlog").orderBy(F.desc("seq"), F.desc("run_id"), F.desc("batch_id")).first()
    if last is None:
        return spark.createDataFrame([], S.MESSAGE)
    rows = read_parquet(spark, layout.backlog, BACKLOG)
    return rows.filter((F.col("run_id") == last["run_id"]) & (F.col("batch_id") == last["batch_id"])).drop(*KEY)


def write_backlog(rows: DataFrame, layout: Layout, run_id: str, batch_id: int) -> None:
    """All that waits after this batch, with whole bodies."""
    _write_batch(rows.select(*S.MESSAGE.fieldNames()), layout.backlog, run_id, batch_id)


def stream_floors(spark: SparkSession, layout: Layout, plan: DataFrame) -> DataFrame:
    """Each account's cursor as streams first saw it (kept for good): all
    later uids are theirs to store, in whatever order files bring them."""
    known = read_parquet(spark, layout.floors, FLOORS)
    new = (plan.filter("guard_ok").select("account_id", F.col("before_uid").alias("floor_uid"))
           .join(known, "account_id", "left_anti"))
    if not new.isEmpty():
        append_parquet(new, layout.floors)
    return read_parquet(spark, layout.floors, FLOORS).groupBy("account_id").agg(F.min("floor_uid").alias("floor_uid"))


def commit_log(spark: SparkSession, layout: Layout) -> DataFrame:
    """T5: the commits as a stream, for consumers."""
    if not exists(spark, layout.commits):
        make_folder(spark, layout.commits)
    return spark.readStream.schema(COMMITS).parquet(layout.commits)


def vacuum(spark: SparkSession, layout: Layout, run_id: str) -> None:
    """Delete what uncommitted batches of a run that has ended left behind."""
    for base in (layout.emails, layout.moves, layout.backlog):
        rows = read_parquet(spark, base, T.StructType(COMMITS.fields[:2])).filter(F.col("run_id") == run_id).distinct()
        for r in rows.join(commits(spark, layout), KEY, "left_anti").collect():  # batches of one run
            delete(spark, os.path.join(base, f"run_id={r['run_id']}", f"batch_id={r['batch_id']}"))
