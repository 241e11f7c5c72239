"""O4 status (S6 + A5) and K8 report blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.render import report_text


def cursor_listing(cursors: DataFrame) -> DataFrame:
    """All cursors ordered by account."""
    return cursors.select("account_id", "last_uid", "updated_at").orderBy("account_id")


def status_payload(cursors: DataFrame, db_path: str) -> DataFrame:
    """A5: one row ``initialized, accounts ARRAY<STRUCT>, db_path``.

    The account list is bounded by the configured accounts (a dimension, not
    data), so collecting it into one array is safe. ``updated_at`` is the
    ISO text the cursor table reports.
    """
    acc = F.struct(
        "account_id", "last_uid",
        F.date_format("updated_at", "yyyy-MM-dd'T'HH:mm:ss").alias("updated_at"),
    )
    return cursors.agg(
        (F.count(F.lit(1)) > 0).alias("initialized"),
        F.coalesce(F.array_sort(F.collect_list(acc)), F.array()).alias("accounts"),
    ).withColumn("db_path", F.lit(db_path))


def status_json(cursors: DataFrame, db_path: str) -> DataFrame:
    """The status document as one JSON text column ``status``."""
    p = status_payload(cursors, db_path)
    return p.select(F.to_json(F.struct("initialized", "accounts", "db_path")).alias("status"))
