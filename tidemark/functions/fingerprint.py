"""P1 content fingerprint as one JVM-side expression."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .common import col as _c
from ..constants import FINGERPRINT_BODY_CHARS, FINGERPRINT_HEX_CHARS


def fingerprint(sender="sender", date="date", subject="subject", body="body") -> Column:
    """First 16 hex chars of sha256("sender|date|subject|body[:2000]").

    Null fields contribute the empty string. ``concat`` (not ``concat_ws``)
    keeps the separator for null fields. sha2 hashes the UTF-8 bytes.
    """
    canonical = F.concat(
        F.coalesce(_c(sender), F.lit("")), F.lit("|"),
        F.coalesce(_c(date), F.lit("")), F.lit("|"),
        F.coalesce(_c(subject), F.lit("")), F.lit("|"),
        F.substring(F.coalesce(_c(body), F.lit("")), 1, FINGERPRINT_BODY_CHARS),
    )
    return F.substring(F.sha2(canonical, 256), 1, FINGERPRINT_HEX_CHARS)
