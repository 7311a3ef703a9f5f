"""Column builders: dates and periods, safe casts, segment rule."""

from .casts import safe_double, safe_int, safe_int_for
from .dates import (check_period, check_range, comparison_windows, epoch_seconds, event_date,
                    key_label, parse_date, period_key, period_label, shift_months,
                    wall_clock, week_label)
from .segments import segment_label, segment_label_py, weighted_score

__all__ = [
    "safe_double", "safe_int", "safe_int_for", "check_period", "check_range", "comparison_windows",
    "epoch_seconds", "event_date", "key_label", "parse_date", "period_key", "period_label",
    "shift_months",
    "wall_clock", "week_label", "segment_label",
    "segment_label_py", "weighted_score",
]
