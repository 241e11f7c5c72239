"""Join helpers that keep a hot key from landing on one task.

* ``broadcast_if_small``: broadcast a per-key side only after counting it
  (a checked bound), otherwise leave the choice to the planner / AQE. Used
  for per-account tables (bounded by the configured accounts, not by data)
  joined to message-sized frames, so a mailbox holding a third of all rows
  is never shuffled onto one task.
* ``join_hot_split``: attach a one-row-per-key table to a many-rows-per-key
  frame when some keys are hot (a mail blast copied to a third of all
  mailboxes). Keys whose row count (known from the pre-aggregation) is at
  least ``hot_rows`` are joined by broadcasting just those keys' rows (their
  number is at most total_rows / hot_rows, and is checked); all other rows
  take a normal shuffle join in which no key is heavy.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DEFAULT_BROADCAST_ROWS = 1_000_000
DEFAULT_BROADCAST_BYTES = 256 << 20
DEFAULT_HOT_ROWS = 1_000_000


def _conf_int(df: DataFrame, key: str, default: int) -> int:
    try:
        return int(df.sparkSession.conf.get(key, str(default)))
    except Exception:  # noqa: BLE001
        return default


def broadcast_limit(df: DataFrame) -> int:
    """Row bound under which a per-key side may be broadcast."""
    return _conf_int(df, "tidemark.broadcast.maxRows", DEFAULT_BROADCAST_ROWS)


def _measure(df: DataFrame) -> tuple[int, int]:
    """Rows and bytes (as JSON) of a small side."""
    n, size = df.agg(F.count(F.lit(1)), F.sum(F.octet_length(F.to_json(F.struct(*df.columns))))).first()
    return n, size or 0


def broadcast_if_small(small: DataFrame, max_rows: int | None = None) -> DataFrame:
    """``small`` with a broadcast hint if its rows and bytes are within bounds."""
    limit = max_rows or broadcast_limit(small)
    if small.limit(limit + 1).count() > limit:
        return small
    _, size = _measure(small)
    return F.broadcast(small) if size <= _conf_int(small, "tidemark.broadcast.maxBytes", DEFAULT_BROADCAST_BYTES) else small


def join_hot_split(big: DataFrame, per_key: DataFrame, key: str, count_col: str,
                   hot_rows: int | None = None, how: str = "inner", max_hot_keys: int | None = None) -> DataFrame:
    """``big ⋈ per_key`` on ``key``; ``per_key`` has one row per key and a
    ``count_col`` telling how many rows of ``big`` carry that key. Where the
    hot keys are more, or larger, than may be broadcast, the hottest of them
    that fit are split off all the same."""
    hot_rows = hot_rows or _conf_int(big, "tidemark.skew.hotRows", DEFAULT_HOT_ROWS)
    max_hot = max_hot_keys or _conf_int(big, "tidemark.broadcast.maxRows", DEFAULT_BROADCAST_ROWS)
    max_bytes = _conf_int(big, "tidemark.broadcast.maxBytes", DEFAULT_BROADCAST_BYTES)
    hot = per_key.filter(F.col(count_col) >= hot_rows)
    n_hot, size = _measure(hot)
    if n_hot == 0:
        return big.join(per_key, key, how)
    fit = min(max_hot, n_hot, int(n_hot * max_bytes / max(size, 1)))
    if fit < n_hot:
        hot = hot.orderBy(F.desc(count_col), key).limit(max(1, fit // 2))
    hot_keys = F.broadcast(hot.select(key))
    big_hot = big.join(hot_keys, key, "left_semi")
    big_cold = big.join(hot_keys, key, "left_anti")
    cold = per_key.join(hot_keys, key, "left_anti")
    return big_hot.join(F.broadcast(hot), key, how).unionByName(big_cold.join(cold, key, how))
