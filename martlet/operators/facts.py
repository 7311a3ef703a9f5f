"""Purchase facts."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import TYPE_BUY

BUY_FACT_COLUMNS = ("date", "user_id", "order_id", "item_id", "category_id",
                    "price", "channel", "age_group")


def is_purchase() -> Column:
    return F.col("type") == TYPE_BUY


def buy_fact(wide: DataFrame) -> DataFrame:
    """Purchase rows of the cleaned table in the eight-column fact shape."""
    return wide.filter(is_purchase()).select(*BUY_FACT_COLUMNS)
