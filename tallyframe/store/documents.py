"""Documents: named tables that are edited by replacing one immutable frame by the next."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.dtypes import DATE, kinds, named
from ..functions.predicates import compare, literal, literal_kind
from ..sources.inline import inline_frame

ROW = "__row"


def frame_of(spark: SparkSession, data: Any) -> DataFrame:
    """A DataFrame as it is, a list of rows, or lists by column."""
    if isinstance(data, DataFrame):
        return data
    if isinstance(data, Mapping):
        sizes = {len(v) for v in data.values()}
        if len(sizes) > 1:
            raise ValueError("columns of different lengths")
        return inline_frame(spark, [dict(zip(data, row, strict=True)) for row in zip(*data.values(), strict=True)], list(data))
    if isinstance(data, list) and all(isinstance(r, Mapping) for r in data):
        return inline_frame(spark, [dict(r) for r in data])
    raise ValueError(f"no table: {type(data).__name__}")


def numbered(df: DataFrame) -> DataFrame:
    """Rows numbered 0, 1 .. in their order, without gaps.

    Counts by partition come first, so that no task sees more than its own rows.
    """
    if ROW in df.columns:
        order = F.col(ROW)
        parts = df.withColumn("__at", order)
    else:
        parts = df.withColumn("__at", F.monotonically_increasing_id())
    parts = parts.withColumn("__part", F.floor(F.col("__at") / F.lit(1 << 33)) if ROW not in df.columns else F.floor(F.col("__at") / F.lit(100_000)))
    counts = parts.groupBy("__part").count()
    before = counts.withColumn("__before", F.coalesce(F.sum("count").over(Window.partitionBy(F.lit(0)).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("__part", "__before")
    own = F.row_number().over(Window.partitionBy("__part").orderBy("__at")) - 1
    return parts.withColumn("__own", own).join(before, "__part").withColumn(ROW, (F.col("__own") + F.col("__before")).cast("long")).drop("__at", "__part", "__own", "__before")


class Document:
    def __init__(self, spark: SparkSession, name: str, data: Any, on_change: Callable[[], None] | None = None):
        self.spark, self.name, self._on_change = spark, name, on_change
        self._rows = numbered(frame_of(spark, data))

    def _set(self, rows: DataFrame) -> None:
        self._rows = rows
        if self._on_change:
            self._on_change()

    @property
    def df(self) -> DataFrame:
        """The rows as they are now."""
        return self._rows.drop(ROW)

    @property
    def columns(self) -> list[str]:
        return self.df.columns

    def ordered(self) -> DataFrame:
        return self._rows.orderBy(ROW).drop(ROW)

    def _check(self, i: int) -> None:
        if i < 0 or self._rows.filter(F.col(ROW) == i).isEmpty():
            raise IndexError(i)

    def update_row(self, i: int, values: Mapping[str, Any]) -> None:
        """Set some columns of one row; an unknown column changes nothing at all."""
        unknown = [c for c in values if c not in self.columns]
        if unknown:
            raise KeyError(unknown[0])
        self._check(i)
        types = dict(self._rows.dtypes)
        self._set(self._rows.withColumns({c: F.when(F.col(ROW) == i, F.lit(v).cast(types[c])).otherwise(named(c)) for c, v in values.items()}))

    def append_rows(self, rows: Any) -> None:
        """Add rows at the end; columns that either side lacks are null there."""
        if isinstance(rows, Sequence) and not rows:
            return
        more = numbered(frame_of(self.spark, rows))
        last = self._rows.agg(F.max(ROW)).first()[0]
        more = more.withColumn(ROW, F.col(ROW) + (0 if last is None else last + 1))
        types = dict(self._rows.dtypes)
        more = more.select(*[named(c).cast(types[c]).alias(c) if c in types else named(c) for c in more.columns])
        self._set(self._rows.unionByName(more, allowMissingColumns=True))

    def delete_row(self, i: int) -> None:
        """Drop one row; those after it move up."""
        self._check(i)
        self._set(self._rows.filter(F.col(ROW) != i).withColumn(ROW, F.when(F.col(ROW) > i, F.col(ROW) - 1).otherwise(F.col(ROW))))

    def match(
        self,
        query: Mapping[str, Any],
        keys: Sequence[str] | None = None,
        threshold: float = 0.6,
        include_score: bool = True,
        nulls_match: bool = False,
        best_only: bool = False,
        candidates: DataFrame | None = None,
    ) -> DataFrame:
        """Rows that agree with ``query`` in at least ``threshold`` of its keys.

        At 1 or more all keys must agree, and null agrees with nothing. A value of
        another kind than its column agrees with nothing either. With the score, the
        best come first. No query or no keys: no rows.
        """
        rows = self._rows if candidates is None else numbered(candidates)
        keys = [k for k in (keys or query) if k in query and k in rows.columns]
        if not keys:
            return rows.drop(ROW).limit(0)
        exact, have = threshold >= 1, kinds(rows)

        def equal(k: str) -> Column:
            v = query[k]
            if v is None:
                return named(k).isNull() if nulls_match and not exact else F.lit(False)
            kind = have[k]
            return F.coalesce(compare(named(k), kind, "==", literal(v, kind), kind if isinstance(v, str) and kind == DATE else literal_kind(v), True), F.lit(False))

        if exact:
            found = rows.filter(reduce(lambda a, b: a & b, [equal(k) for k in keys])).withColumn("__score__", F.lit(1.0))
        else:
            score = reduce(lambda a, b: a + b, [equal(k).cast("int") for k in keys]) / F.lit(len(keys))
            found = rows.withColumn("__score__", score).filter(F.col("__score__") >= threshold)
        order = [F.col("__score__").desc(), F.col(ROW)] if include_score else [F.col(ROW)]
        found = found.orderBy(*order)
        if best_only:
            found = found.limit(1)
        return found.drop(ROW) if include_score else found.drop(ROW, "__score__")


class Collection:
    """Documents by name; deleted names are remembered until they are made again."""

    def __init__(self, spark: SparkSession | None = None):
        self.spark = spark or SparkSession.builder.getOrCreate()
        self.documents: dict[str, Document] = {}
        self.deleted: set[str] = set()
        self.dirty = False

    def _changed(self) -> None:
        self.dirty = True

    def _make(self, name: str, data: Any) -> Document:
        return Document(self.spark, name, data, self._changed)

    def create_document(self, name: str, data: Any) -> Document:
        self.documents[name] = self._make(name, data)
        self.deleted.discard(name)
        self._changed()
        return self.documents[name]

    def get_document(self, name: str) -> Document:
        return self.documents[name]

    def delete_document(self, name: str) -> None:
        del self.documents[name]
        self.deleted.add(name)
        self._changed()

    def list_documents(self) -> list[str]:
        return list(self.documents)
