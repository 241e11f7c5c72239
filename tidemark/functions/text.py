"""P2 truncation, P3 preview, P8 request text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .common import col as _c
from .. import constants as K
from ..constants import BODY_PREVIEW_CHARS, MAX_CONTENT_LENGTH


def clipped_body(body="body", limit: int = MAX_CONTENT_LENGTH) -> Column:
    """Body cut to ``limit`` characters; null body -> ''."""
    b = _c(body)
    return F.when(F.length(b) > limit, F.substring(b, 1, limit)).otherwise(F.coalesce(b, F.lit("")))


def is_truncated(body="body", limit: int = MAX_CONTENT_LENGTH) -> Column:
    """True when the body is longer than ``limit``; null body -> False."""
    return F.coalesce(F.length(_c(body)) > limit, F.lit(False))


def body_preview(body="body", limit: int = BODY_PREVIEW_CHARS) -> Column:
    return F.substring(F.coalesce(_c(body), F.lit("")), 1, limit)


def request_text(subject="subject", sender="sender", date="date", clipped="clipped_body") -> Column:
    """User prompt sent with a model request; a null field renders as 'None'."""
    def val(x):
        return F.coalesce(_c(x), F.lit("None"))

    ind, (on, by, at, what) = K.REQUEST_INDENT, K.REQUEST_LABELS
    return F.concat(
        F.lit(ind + on), val(subject), F.lit(ind + by), val(sender), F.lit(ind + at), val(date),
        F.lit(ind + ind + what + ind), F.coalesce(_c(clipped), F.lit("")), F.lit(ind),
    )
