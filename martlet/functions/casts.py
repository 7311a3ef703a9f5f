"""Lenient numeric casts as Column expressions.

``safe_double``: numeric text or number -> double, anything else -> default.
``safe_int``: integral text -> int, a fractional number is truncated
(3.7 -> 3), anything else (including the text "3.7") -> default.
Both use ``try_cast`` so that ANSI mode never fails a task on bad text.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType, StringType


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def safe_double(c, default: float | None = 0.0) -> Column:
    """Numeric text or number -> double; anything else -> ``default``."""
    parsed = _col(c).try_cast("double")
    return parsed if default is None else F.coalesce(parsed, F.lit(float(default)))


def safe_int(c, default: int | None = 0, numeric: bool = False) -> Column:
    """``numeric=True`` for a numeric column (truncate), else text."""
    c = _col(c)
    parsed = c.cast("int") if numeric else c.try_cast("int")
    return parsed if default is None else F.coalesce(parsed, F.lit(int(default)))


def safe_int_for(df, name: str, default: int | None = 0) -> Column:
    """``safe_int`` picking the text or numeric path from the column type."""
    dtype = df.schema[name].dataType
    if isinstance(dtype, StringType):
        return safe_int(name, default)
    if isinstance(dtype, NumericType):
        return safe_int(name, default, numeric=True)
    raise TypeError(f"safe_int needs a text or numeric column, {name} is {dtype}")
