"""As-of lookup without an inequality join."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def latest(left: DataFrame, right: DataFrame, key: str, left_at: str, right_at: str, value: str) -> DataFrame:
    """(key, left_at, value) of each left row's last right row of the same key at or before it; ties to the greatest value.

    Both sides are stacked and sorted once per key; a running last value fills the left rows. Left rows without one go.
    """
    rows = right.select(key, F.col(right_at).alias("_at"), F.lit(0).alias("_side"), F.col(value).alias(value)).unionByName(
        left.select(key, F.col(left_at).alias("_at"), F.lit(1).alias("_side"), F.lit(None).cast(right.schema[value].dataType).alias(value))
    )
    order = Window.partitionBy(key).orderBy("_at", "_side", F.col(value).asc_nulls_last()).rowsBetween(Window.unboundedPreceding, 0)
    filled = rows.withColumn("_last", F.last(value, ignorenulls=True).over(order)).where("_side = 1 and _last is not null")
    return filled.select(key, F.col("_at").alias(left_at), F.col("_last").alias(value))
