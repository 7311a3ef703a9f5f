"""Date and period Column builders (all JVM-side, codegen-friendly).

None of these read the session time zone: epoch seconds are turned into a
wall clock through an explicit zone, and NTZ timestamps are read as UTC.
"""

from __future__ import annotations

import datetime as _dt
from calendar import monthrange

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..constants import PERIOD_LABELS

_EPOCH_NTZ = "TIMESTAMP_NTZ'1970-01-01 00:00:00'"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def epoch_seconds(ts_ntz) -> Column:
    """Whole epoch seconds of a TIMESTAMP_NTZ, read as UTC (floor)."""
    return F.unix_timestamp(_col(ts_ntz)).cast("long")


def wall_clock(ts_seconds, tz: str = "UTC") -> Column:
    """Epoch seconds -> TIMESTAMP_NTZ wall clock in ``tz``."""
    utc_wall = F.timestamp_add("SECOND", _col(ts_seconds), F.expr(_EPOCH_NTZ))
    if tz.upper() == "UTC":
        return utc_wall
    return F.convert_timezone(F.lit("UTC"), F.lit(tz), utc_wall)


def event_date(ts_seconds, tz: str = "UTC") -> Column:
    """Calendar date of epoch seconds in zone ``tz``."""
    return F.to_date(wall_clock(ts_seconds, tz))


def week_label(d) -> Column:
    """Monday-first week label ``YYYY-WW`` (weeks 00-53, days before the
    first Monday of the year are week 00)."""
    d = _col(d)
    week = F.floor((F.dayofyear(d) + 6 - F.weekday(d)) / 7).cast("int")
    return F.concat(F.year(d).cast("string"), F.lit("-"), F.lpad(week.cast("string"), 2, "0"))


def period_label(d, period: str) -> Column:
    """Bucket label of a date for the day / week / month trend."""
    check_period(period)
    d = _col(d)
    if period == "day":
        return F.date_format(d, "yyyy-MM-dd")
    if period == "month":
        return F.date_format(d, "yyyy-MM")
    return week_label(d)


def period_key(d, period: str) -> Column:
    """Compact grouping key of a period bucket (a date or an int), so that a
    trend groups on 4-byte values and formats the label only once per bucket.
    Ordering by the key equals ordering by the label."""
    check_period(period)
    d = _col(d)
    if period == "day":
        return d
    if period == "month":
        return F.trunc(d, "MM")
    return F.year(d) * 100 + F.floor((F.dayofyear(d) + 6 - F.weekday(d)) / 7).cast("int")


def key_label(key, period: str) -> Column:
    """Label of a ``period_key`` value (same text as ``period_label``)."""
    check_period(period)
    key = _col(key)
    if period == "day":
        return F.date_format(key, "yyyy-MM-dd")
    if period == "month":
        return F.date_format(key, "yyyy-MM")
    return F.concat((key / 100).cast("int").cast("string"), F.lit("-"),
                    F.lpad((key % 100).cast("string"), 2, "0"))


def check_period(period: str) -> str:
    """Reject a period outside the day / week / month whitelist."""
    if period not in PERIOD_LABELS:
        raise ValueError(f"period must be one of {sorted(PERIOD_LABELS)}, got {period!r}")
    return period


def parse_date(value) -> _dt.date:
    """Strict ``YYYY-MM-DD`` parameter check (format and calendar)."""
    if isinstance(value, _dt.datetime):
        return value.date()
    if isinstance(value, _dt.date):
        return value
    text = str(value)
    if len(text) != 10 or text[4] != "-" or text[7] != "-":
        raise ValueError(f"date must be YYYY-MM-DD, got {value!r}")
    return _dt.date.fromisoformat(text)


def check_range(start, end) -> tuple:
    """Both bounds as dates; a range that ends before it starts is refused.
    Bounds that are Columns (dates known only at run time) stay as they are."""
    if isinstance(start, Column) or isinstance(end, Column):
        return tuple(b if isinstance(b, Column) else F.lit(parse_date(b)) for b in (start, end))
    s, e = parse_date(start), parse_date(end)
    if s > e:
        raise ValueError(f"the range starts after its end: {s} > {e}")
    return s, e


def shift_months(d: _dt.date, months: int) -> _dt.date:
    """Calendar month shift with end-of-month clamping (like add_months)."""
    total = d.year * 12 + (d.month - 1) + months
    year, month = divmod(total, 12)
    month += 1
    return _dt.date(year, month, min(d.day, monthrange(year, month)[1]))


def comparison_windows(start, end, period: str) -> dict:
    """The current window and the two it is compared with. Each of those is
    the current window moved back as a whole: the previous one by its own
    length (day), seven days (week) or a calendar month (month), the last-year
    one by twelve calendar months. Calendar moves clamp at month ends."""
    check_period(period)
    current = check_range(start, end)
    if isinstance(current[0], Column):
        length = F.datediff(current[1], current[0]) + 1
        back = {"day": lambda d: F.date_sub(d, length), "week": lambda d: F.date_sub(d, 7),
                "month": lambda d: F.add_months(d, -1)}[period]
        return {"current": current, "previous": tuple(map(back, current)),
                "last_year": tuple(F.add_months(d, -12) for d in current)}
    length = (current[1] - current[0]).days + 1
    back = {"day": {"days": length}, "week": {"days": 7}, "month": {"months": 1}}

    def moved(days: int = 0, months: int = 0) -> tuple:
        return tuple(shift_months(d, -months) - _dt.timedelta(days=days) for d in current)
    return {"current": current, "previous": moved(**back[period]), "last_year": moved(months=12)}
