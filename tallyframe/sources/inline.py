"""Tables given as rows in the configuration."""

from __future__ import annotations

from datetime import date, datetime
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def _kind(values: list[Any]) -> T.DataType:
    some = [v for v in values if v is not None and v == v]
    if not some:
        return T.StringType()
    if all(isinstance(v, bool) for v in some):
        return T.BooleanType()
    if all(isinstance(v, int) and not isinstance(v, bool) for v in some):
        return T.LongType()
    if all(isinstance(v, int | float) and not isinstance(v, bool) for v in some):
        return T.DoubleType()
    if all(isinstance(v, date | datetime) for v in some):
        return T.TimestampNTZType()
    return T.StringType()


def _as(v: Any, kind: T.DataType) -> Any:
    if v is None or v != v:
        return None
    if isinstance(kind, T.DoubleType):
        return float(v)
    if isinstance(kind, T.StringType):
        return v if isinstance(v, str) else str(v)
    if isinstance(kind, T.TimestampNTZType) and not isinstance(v, datetime):
        return datetime(v.year, v.month, v.day)
    return v


def inline_frame(spark: SparkSession, rows: list[dict[str, Any]], header: list[str] | None = None) -> DataFrame:
    """Columns in the order they are first seen; whole numbers and fractions together are numbers, any other mixture is text."""
    columns = list(dict.fromkeys([*(header or []), *[k for r in rows for k in r]]))
    kinds = [_kind([r.get(c) for r in rows]) for c in columns]
    schema = T.StructType([T.StructField(c, k) for c, k in zip(columns, kinds, strict=True)])
    return spark.createDataFrame([tuple(_as(r.get(c), k) for c, k in zip(columns, kinds, strict=True)) for r in rows], schema)
