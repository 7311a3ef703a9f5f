"""Customer-segment rule and centre score as Column expressions.

The rule reads standardised (z-score) recency, frequency and monetary values
and is checked in this order (strict ``>`` where written):

1. R > high_r                        -> churned / dormant
2. M > high_m and R < 0              -> core high value
3. F > high_f and M <= high_m        -> high-frequency loyal
4. R <= 0 and (F > 0 or M > 0)       -> potential
5. otherwise                         -> regular

The same expression labels a cluster centre (one row per cluster) or a user.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..constants import (DEFAULT_THRESHOLDS, DEFAULT_WEIGHTS, LABEL_CHURNED,
                         LABEL_CORE_VALUE, LABEL_LOYAL, LABEL_POTENTIAL,
                         LABEL_REGULAR)


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _rules(th: dict) -> list:
    """Ordered (predicate, label) pairs. Predicates use ``&``/``|`` so the
    same table evaluates plain floats (a centre) and Columns (every user)."""
    return [
        (lambda r, f, m: r > th["high_r"], LABEL_CHURNED),
        (lambda r, f, m: (m > th["high_m"]) & (r < 0), LABEL_CORE_VALUE),
        (lambda r, f, m: (f > th["high_f"]) & (m <= th["high_m"]), LABEL_LOYAL),
        (lambda r, f, m: (r <= 0) & ((f > 0) | (m > 0)), LABEL_POTENTIAL),
    ]


def segment_label(r="R", f="F", m="M", thresholds: dict | None = None) -> Column:
    """Segment label Column from standardised R, F, M (ordered rule table)."""
    th = {**DEFAULT_THRESHOLDS, **(thresholds or {})}
    r, f, m = _col(r), _col(f), _col(m)
    expr = None
    for predicate, label in _rules(th):
        cond = predicate(r, f, m)
        expr = F.when(cond, label) if expr is None else expr.when(cond, label)
    return expr.otherwise(LABEL_REGULAR)


def segment_label_py(center, thresholds: dict | None = None) -> str:
    """Same rule table for a centre held on the driver (at most k <= 5)."""
    th = {**DEFAULT_THRESHOLDS, **(thresholds or {})}
    r, f, m = (float(v) for v in center[:3])
    return next((label for predicate, label in _rules(th) if predicate(r, f, m)), LABEL_REGULAR)


def weighted_score(r="R", f="F", m="M", weights: dict | None = None) -> Column:
    """Weighted centre score wR*R + wF*F + wM*M as a Column."""
    w = {**DEFAULT_WEIGHTS, **(weights or {})}
    return F.lit(w["R"]) * _col(r) + F.lit(w["F"]) * _col(f) + F.lit(w["M"]) * _col(m)
