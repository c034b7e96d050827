"""Row order as a column: rows have a place only where an operator needs one."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ORD = "__ord"


def with_order(df: DataFrame) -> DataFrame:
    """``df`` with its rows' place, unless it has it; right after the scan this is the order of files and rows."""
    return df if ORD in df.columns else df.withColumn(ORD, F.monotonically_increasing_id())


def without_order(df: DataFrame) -> DataFrame:
    return df.drop(ORD)
