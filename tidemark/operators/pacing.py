"""W3 request pacing as data: a schedule column instead of a sleeping loop.

Calls are serial and at least 60/rpm seconds apart, so the k-th call of a
run (1-based, in processing order) may start no earlier than
(k-1) * 60000 / rpm milliseconds after the first. ``rpm <= 0`` disables
pacing (all offsets 0). Numbering uses the dense-id operator, so no
single-partition window is involved.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ids import assign_dense_ids


def pacing_plan(requests: DataFrame, rpm: int, order=("account_id", "uid")) -> DataFrame:
    numbered = assign_dense_ids(requests, list(order), 0, "call_seq")
    if rpm and rpm > 0:
        off = F.expr(f"(call_seq - 1) * 60000 div {int(rpm)}")
    else:
        off = F.lit(0)
    return numbered.withColumn("slot_offset_ms", off.cast("bigint"))


def min_run_seconds(requests: DataFrame, rpm: int) -> DataFrame:
    """Lower bound of a run's wall time imposed by pacing alone."""
    n = F.count(F.lit(1))
    est = F.when(n > 0, (n - 1) * F.lit(60.0 / rpm if rpm and rpm > 0 else 0.0)).otherwise(F.lit(0.0))
    return requests.agg(n.alias("calls"), est.alias("min_seconds"))
