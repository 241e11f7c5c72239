"""Date header parsing (fixes the text-compare defect of the stored ``date``).

``sent_at`` is a TIMESTAMP_NTZ holding the UTC wall clock of the header, so
it does not depend on the session time zone. Two forms are read:

* mail form: ``[Wkd, ]d Mon yyyy HH:mm[:ss] [+hhmm|-hhmm|GMT|UT|UTC|Z|EST..PDT] [(comment)]``
  (no zone means UTC; an obsolete two-digit year yy is 20yy below 50, else 19yy);
* ISO form: ``yyyy-mm-dd[( |T)HH:mm[:ss]]``.

Anything else, or an impossible calendar value, gives null.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .common import col as _c
from .common import let

# fixed values: English month abbreviations used by mail date headers
MONTHS = ["Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec"]

MAIL_RE = (r"^\s*(?:[A-Za-z]{3},\s*)?(\d{1,2})\s+([A-Za-z]{3})\s+(\d{4}|\d{2})\s+(\d{1,2}):(\d{2})"
           r"(?::(\d{2}))?\s*(?:([+-])(\d{2})(\d{2})|GMT|UTC|UT|Z|([ECMP])([SD])T)?\s*(?:\([^)]*\))?\s*$")
# fixed values: hours west of UTC of the obsolete North American zones, standard time
ZONES = {"E": 5, "C": 6, "M": 7, "P": 8}
ISO_RE = r"^\s*(\d{4})-(\d{2})-(\d{2})(?:[T ](\d{2}):(\d{2})(?::(\d{2}))?)?\s*$"


def _int(s: Column) -> Column:
    return F.when(s == "", F.lit(None)).otherwise(s).try_cast("int")


_SEP = "\u0001"


def _groups(d: Column, pattern: str, n: int) -> Column:
    """One regex pass: a full match becomes SEP g1 SEP g2 ... (unmatched
    optional groups are empty); no match leaves the text unchanged."""
    return F.regexp_replace(d, pattern, _SEP + _SEP.join(f"${k}" for k in range(1, n + 1)))


def parse_sent_at(date="date") -> Column:
    d = _c(date)
    return let(F.struct(_groups(d, MAIL_RE, 11).alias("m"), _groups(d, ISO_RE, 6).alias("i")), _assemble)


def _assemble(s: Column) -> Column:
    return let(F.struct(
        s["m"].startswith(_SEP).alias("mm"), F.split(s["m"], _SEP).alias("mg"),
        s["i"].startswith(_SEP).alias("im"), F.split(s["i"], _SEP).alias("ig"),
    ), _timestamp)


def _timestamp(p: Column) -> Column:
    g, h = p["mg"], p["ig"]
    months = F.array(*[F.lit(m) for m in MONTHS])
    mon = F.array_position(months, F.initcap(g[2])).cast("int")
    y = _int(g[3])
    year = F.when(F.length(g[3]) == 2, F.when(y < 50, y + 2000).otherwise(y + 1900)).otherwise(y)
    mail_local = F.try_make_timestamp_ntz(
        year, F.when(mon > 0, mon), _int(g[1]), _int(g[4]), _int(g[5]), F.coalesce(_int(g[6]), F.lit(0)))
    sign = F.when(g[7] == "-", F.lit(-1)).otherwise(F.lit(1))
    off_min = sign * (F.coalesce(_int(g[8]), F.lit(0)) * 60 + F.coalesce(_int(g[9]), F.lit(0)))
    west = F.coalesce(*[F.when(g[10] == z, F.lit(h)) for z, h in ZONES.items()], F.lit(0))
    off_min = off_min - 60 * (west - F.when(g[11] == "D", F.lit(1)).otherwise(F.lit(0)))
    mail_utc = mail_local - F.make_dt_interval(F.lit(0), F.lit(0), off_min, F.lit(0))
    iso = F.try_make_timestamp_ntz(
        _int(h[1]), _int(h[2]), _int(h[3]), F.coalesce(_int(h[4]), F.lit(0)),
        F.coalesce(_int(h[5]), F.lit(0)), F.coalesce(_int(h[6]), F.lit(0)))
    return F.when(p["mm"], mail_utc).when(p["im"], iso)


def day_start(day: str) -> Column:
    """``YYYY-MM-DD`` -> TIMESTAMP_NTZ at 00:00 (raises early on a bad value)."""
    return F.to_timestamp_ntz(F.lit(day), F.lit("yyyy-MM-dd"))


def check_day(day: str | None) -> str | None:
    """Validate a ``YYYY-MM-DD`` parameter on the driver before any work."""
    if not day:
        return None
    import datetime as _dt
    _dt.datetime.strptime(day, "%Y-%m-%d")
    return day
