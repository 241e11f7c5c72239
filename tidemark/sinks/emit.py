"""K6 batch sink contract and the built-in sinks (K7 JSON files, K8 report
text, K9 JSON fallback, K10 user partition sinks with retries).

A sink is ``callable(results: DataFrame, batch_id: int)``. ``results`` holds
``run_id, account_id, uid, result``. Returning nothing means that the whole
batch was delivered; returning account ids means that these were not (their
cursors stay); raising means that nothing was. Dry runs call no sink, and an
empty batch is delivered trivially.
"""

from __future__ import annotations

import time
from itertools import groupby, islice
from typing import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.render import json_text, report_text
from ..session import stage_table

Sink = Callable[[DataFrame, int], Iterable[str] | None]


def null_sink(results: DataFrame, batch_id: int) -> None:
    """Delivers nothing (for benchmarks that time the rest)."""


#: Tasks that write one account's results.
SPREAD = 16


def _write_text(rows: DataFrame, batch_id: int, path: str) -> None:
    """``rows`` (run_id, account_id, uid, value) under run, batch and account;
    a replayed batch replaces its own folders, another batch adds to them. A
    large account is spread over several tasks and files."""
    (rows.withColumn("batch_id", F.lit(int(batch_id)))
        .repartition("account_id", F.pmod(F.xxhash64("uid"), F.lit(SPREAD))).sortWithinPartitions("account_id", "uid")
        .select("run_id", "batch_id", "account_id", "value").write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic").partitionBy("run_id", "batch_id", "account_id").text(path))


def json_file_sink(path: str) -> Sink:
    """K7: one JSON object per result."""
    def sink(results: DataFrame, batch_id: int) -> None:
        _write_text(results.select("run_id", "account_id", "uid", json_text("result").alias("value")), batch_id, path)
    return sink


def report_sink(path: str) -> Sink:
    """K8: the console report blocks, in uid order within a file."""
    def sink(results: DataFrame, batch_id: int) -> None:
        _write_text(results.select("run_id", "account_id", "uid", report_text("result").alias("value")), batch_id, path)
    return sink


def partition_sink(deliver: Callable[[list], None], retries: int = 3, backoff_s: float = 1.0, chunk: int = 1000) -> Sink:
    """Run a user delivery function on the executors (e.g. an HTTP post),
    on at most ``chunk`` rows of one account at a time. Each chunk is tried up
    to ``retries`` times. An account with a chunk that still fails is reported
    as not delivered, so that its cursor alone stays; the others go on. A lost
    task runs again, so ``deliver`` may see rows twice: they carry run, account
    and uid for it to tell."""
    def attempt(rows: list) -> str | None:
        for n in range(retries):
            try:
                return deliver(rows)
            except Exception as exc:  # noqa: BLE001 - whatever the user's function raises
                error = f"{type(exc).__name__}: {exc}"
                time.sleep(backoff_s * (n + 1) if n + 1 < retries else 0)
        return error

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for batch in batches for row in batch.to_pylist())
        for account, group in groupby(rows, lambda r: r["account_id"]):
            failed = None
            while part := list(islice(group, chunk)):
                failed = failed or attempt(part)
            if failed:
                yield pa.record_batch([pa.array([account]), pa.array([failed])], ["account_id", "error"])

    def sink(results: DataFrame, batch_id: int) -> list[str]:
        rows = results.select("run_id", "account_id", "uid", F.to_json("result").alias("result_json"))
        dealt = rows.repartition("account_id", F.pmod(F.xxhash64("uid"), F.lit(SPREAD))).sortWithinPartitions("account_id", "uid")
        failed = stage_table(dealt.mapInArrow(run, "account_id string, error string"), "undelivered")
        return [r[0] for r in failed.select("account_id").distinct().collect()]  # at most the accounts
    return sink
