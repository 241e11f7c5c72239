"""K8 report block, K9 JSON fallback and P15 fixed-width table lines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .common import col as _c
from .. import constants as K


def report_text(result="result") -> Column:
    """One console block per result (same text the console template renders).

    ``Error`` and ``Unprocessed`` fall into the LOW banner, as in the template.
    """
    r = _c(result)
    banner = (F.when(r["priority"] == "High", F.lit(K.REPORT_BANNER_HIGH))
               .when(r["priority"] == "Medium", F.lit(K.REPORT_BANNER_MEDIUM))
               .when(r["priority"] == "Spam", F.lit(K.REPORT_BANNER_SPAM))
               .otherwise(F.lit(K.REPORT_BANNER_OTHER)))
    action = F.when(F.coalesce(r["action_required"], F.lit(False)),
                    F.lit("\n" + K.REPORT_ACTION + "\n")).otherwise(F.lit("\n" + K.REPORT_NO_ACTION + "\n"))
    ents = F.coalesce(r["key_entities"], F.array().cast("array<string>"))
    bullets = F.when(F.size(ents) > 0,
                     F.array_join(F.transform(ents, lambda t: F.concat(F.lit("\n" + K.REPORT_ENTITY_BULLET),
                                                                       F.coalesce(t, F.lit("None")), F.lit("\n"))), ""))
    bullets = F.coalesce(bullets, F.lit("\n" + K.REPORT_NO_ENTITIES + "\n"))
    return F.concat(
        F.lit(K.REPORT_RULE + "\n" + K.REPORT_TITLE), banner, F.lit("]\n" + K.REPORT_RULE + "\n" + K.REPORT_UID),
        F.coalesce(r["original_uid"].cast("string"), F.lit("None")),
        F.lit("\n" + K.REPORT_TRUNCATED),
        F.when(F.coalesce(r["is_truncated"], F.lit(False)), F.lit("Yes")).otherwise(F.lit("No")),
        F.lit("\n\n" + K.REPORT_SUMMARY + "\n"), F.coalesce(r["summary"], F.lit("None")),
        F.lit("\n\n"), action, F.lit("\n\n" + K.REPORT_ENTITIES + "\n"), bullets,
        F.lit("\n" + K.REPORT_RULE),
    )


def json_text(result="result") -> Column:
    """K9: the result serialised as JSON (used when no template is wanted)."""
    return F.to_json(_c(result))


def _rjust(s: Column, width: int) -> Column:
    # Python's format never truncates; lpad does, so pad only short values.
    return F.when(F.length(s) >= width, s).otherwise(F.lpad(s, width, " "))


def _ljust(s: Column, width: int) -> Column:
    return F.when(F.length(s) >= width, s).otherwise(F.rpad(s, width, " "))


def table_line(id_col="id", priority="priority", date="date", sender="sender", subject="subject") -> Column:
    """``[id:>5] pri:>6 | date[:16]:16 | sender[:30]:30 | subject[:50]``.

    Null priority renders ``?`` and null date ``''`` (the original raised).
    """
    return F.concat(
        F.lit("["), _rjust(_c(id_col).cast("string"), 5), F.lit("] "),
        _rjust(F.coalesce(_c(priority), F.lit("?")), 6), F.lit(" | "),
        _ljust(F.substring(F.coalesce(_c(date), F.lit("")), 1, 16), 16), F.lit(" | "),
        _ljust(F.substring(F.coalesce(_c(sender), F.lit("")), 1, 30), 30), F.lit(" | "),
        F.substring(F.coalesce(_c(subject), F.lit("")), 1, 50),
    )


TABLE_HEADER, TABLE_RULE = K.TABLE_HEADER, K.TABLE_RULE


def table_footer(count="count", max_id="max_id", has_more="has_more") -> Column:
    return F.concat(
        _c(count).cast("string"), F.lit(" results | max_id="), _c(max_id).cast("string"),
        F.lit(" | has_more="), F.when(_c(has_more), F.lit("True")).otherwise(F.lit("False")),
    )
