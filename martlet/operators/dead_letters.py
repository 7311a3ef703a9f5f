"""Dead letters: log rows that did not parse leave the clean path with their
raw line and the reason.

A text log is parsed line by line into fields first and into types second, so
that a rejected row keeps its line as it was and names what was wrong with it:
``fields`` (not five of them), or the columns that hold no usable value. The
clean path gets the rest; every non-blank line is in exactly one of the two.
Blank lines are no rows. Columns that must hold a value are the user, the item,
the type and the time: without them an order key is not unique. A missing
category is allowed, one that is no number is not.

For logs that come typed (Parquet, streams) ``set_aside`` applies the same rule
to the columns and writes the row as a CSV line.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schemas import BEHAVIOR

REQUIRED = ("user_id", "item_id", "type", "ts")
_BAD = "_unparsed"
_TEXT = ", ".join(f"{f.name} string" for f in BEHAVIOR.fields) + f", {_BAD} string"
_WHOLE = r"^[+-]?[0-9]+$"


def _value(field) -> Column:
    """A field's text as its type; NULL if it does not parse."""
    text = F.trim(F.col(f"_f.{field.name}"))
    if field.name == "type":
        return F.nullif(text, F.lit(""))
    return F.when(text.rlike(_WHOLE), text.try_cast(field.dataType))


def _reason(broken: Column, bad: list[tuple[str, Column]]) -> Column:
    """'fields', the bad columns in order, or NULL."""
    named = F.concat_ws(",", *[F.when(c, F.lit(name)) for name, c in bad])
    return F.when(broken, F.lit("fields")).otherwise(F.nullif(named, F.lit("")))


def parse_lines(lines: DataFrame, line: str = "value") -> DataFrame:
    """(line, reason, log columns) of every non-blank CSV line."""
    fields = F.from_csv(F.col(line), _TEXT, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _BAD})
    typed = (lines.where(F.trim(F.col(line)) != "").select(F.col(line).alias("line"), fields.alias("_f"))
             .select("line", F.col(f"_f.{_BAD}").isNotNull().alias("_broken"),
                     (F.trim(F.coalesce("_f.category_id", F.lit(""))) != "").alias("_category"),
                     *[_value(f).alias(f.name) for f in BEHAVIOR.fields]))
    empty = {f.name: F.col(f.name).isNull() for f in BEHAVIOR.fields}
    empty["category_id"] = empty["category_id"] & F.col("_category")
    reason = _reason(F.col("_broken"), list(empty.items()))
    return typed.select("line", reason.alias("reason"), *BEHAVIOR.fieldNames())


def clean_rows(parsed: DataFrame) -> DataFrame:
    """The log rows of the lines that parsed."""
    return parsed.where("reason IS NULL").select(*BEHAVIOR.fieldNames())


def rejected_lines(parsed: DataFrame) -> DataFrame:
    """(line, reason) of the lines that did not."""
    return parsed.where("reason IS NOT NULL").select("line", "reason")


def well_formed(log: DataFrame) -> DataFrame:
    """Rows of a typed log with all required columns."""
    return log.where(" AND ".join(f"{c} IS NOT NULL" for c in REQUIRED))


def set_aside(log: DataFrame) -> DataFrame:
    """(line, reason) of the rows of a typed log without a required column."""
    reason = _reason(F.lit(False), [(c, F.col(c).isNull()) for c in REQUIRED])
    return (log.where(" OR ".join(f"{c} IS NULL" for c in REQUIRED))
            .select(F.to_csv(F.struct(*BEHAVIOR.fieldNames())).alias("line"), reason.alias("reason")))
