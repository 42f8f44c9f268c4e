"""Time keys built on civil (zone-free) time.

All helpers avoid the session time zone, so the same rows give the same keys
on every cluster: ``TIMESTAMP_NTZ`` columns are split by field or cast to text.
``clock`` means civil seconds since 1970-01-01 00:00:00 as BIGINT.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_ORIGIN = "timestamp_ntz'1970-01-01 00:00:00'"
_SECOND = "interval '1' second"


def text_clock(text: Column) -> Column:
    """Civil seconds of a ``yyyy-MM-dd HH:mm:ss`` text. Hours of 24 and more roll into the
    following days, malformed text gives NULL. Every piece of the text is read once."""
    day = F.unix_date(F.substring(text, 1, 10).try_cast("date")).cast("bigint")
    hour, minute, second = (F.substring(text, at, 2).try_cast("int") for at in (12, 15, 18))
    return day * 86400 + hour * 3600 + minute * 60 + second


def clock_time(seconds: Column) -> Column:
    """Civil seconds to TIMESTAMP_NTZ."""
    return F.expr(_ORIGIN) + F.expr(_SECOND) * seconds


def parse_time(text: Column) -> Column:
    """Time text to TIMESTAMP_NTZ, with the rules of ``text_clock``."""
    return clock_time(text_clock(text))


def time_text(ts: Column) -> Column:
    """TIMESTAMP_NTZ to ``yyyy-MM-dd HH:mm:ss``."""
    return F.substring(ts.cast("string"), 1, 19)


def date_text(ts: Column) -> Column:
    return F.substring(ts.cast("string"), 1, 10)


def clock(ts: Column) -> Column:
    """TIMESTAMP_NTZ to civil seconds."""
    return (
        F.unix_date(ts.cast("date")).cast("bigint") * 86400
        + F.hour(ts) * 3600
        + F.minute(ts) * 60
        + F.second(ts)
    )


def clock_text(seconds: Column) -> Column:
    """Civil seconds back to ``yyyy-MM-dd HH:mm:ss``."""
    return time_text(clock_time(seconds))


def date_hour(time: Column) -> Column:
    """``yyyy-MM-dd_HH`` of a time text."""
    return F.concat(F.substring(time, 1, 10), F.lit("_"), F.substring(time, 12, 2))


def range_start(seconds: Column, width: int = 300) -> Column:
    """First civil second of the fixed range that holds ``seconds``."""
    return seconds - F.pmod(seconds, F.lit(width))


def range_label(start: Column, width: int = 300) -> Column:
    """``date HH:mm~date HH:mm`` for a range start; the end rolls over midnight."""
    lo = F.substring(clock_text(start), 1, 16)
    hi = F.substring(clock_text(start + width), 1, 16)
    return F.concat(lo, F.lit("~"), hi)


def day_key(time: Column) -> Column:
    """``yyyyMMdd`` of a time text."""
    return F.replace(F.substring(time, 1, 10), F.lit("-"), F.lit(""))


def minute_key(time: Column) -> Column:
    """``HHmm`` of a time text."""
    return F.concat(F.substring(time, 12, 2), F.substring(time, 15, 2))


def minute_index(day: Column, hhmm: Column) -> Column:
    """Absolute minute number of a (``yyyyMMdd``, ``HHmm``) pair."""
    iso = F.concat_ws("-", F.substring(day, 1, 4), F.substring(day, 5, 2), F.substring(day, 7, 2))
    return (
        F.unix_date(iso.cast("date")).cast("bigint") * 1440
        + F.substring(hhmm, 1, 2).cast("bigint") * 60
        + F.substring(hhmm, 3, 2).cast("bigint")
    )


def is_before(a: Column, b: Column) -> Column:
    return text_clock(a) < text_clock(b)


def is_after(a: Column, b: Column) -> Column:
    return text_clock(a) > text_clock(b)


def seconds_between(a: Column, b: Column) -> Column:
    """Seconds from ``b`` to ``a``."""
    return text_clock(a) - text_clock(b)
