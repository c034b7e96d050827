"""Row-level reconciliation of two tables: added, removed, changed and unchanged rows."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dtypes import BOOLEAN, DATE, STRING, kinds, named, text, to_number
from .combine import as_list
from .ordering import ORD, with_order

STATUS, CHANGED = "__status__", "__changed_cols__"


def _numbered(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of one key get the numbers 0, 1 .. in their order, so that they pair off."""
    place = Window.partitionBy(*[named(k) for k in keys]).orderBy(ORD)
    return with_order(df).withColumn("__row__", F.row_number().over(place) - 1)


def _differs(a: Column, a_kind: str, b: Column, b_kind: str, precision: int) -> Column:
    """Numbers by so many decimals, dates with null as a value, the rest as text; null against a value is no change."""
    if a_kind == b_kind == DATE:
        return ~a.cast("timestamp_ntz").eqNullSafe(b.cast("timestamp_ntz"))
    x, y = (to_number(c, k) if k != BOOLEAN else c.cast("double") for c, k in ((a, a_kind), (b, b_kind)))
    scale = float(10**precision)
    numeric = F.rint(x * scale) != F.rint(y * scale)
    if STRING not in (a_kind, b_kind) and DATE not in (a_kind, b_kind):
        return F.coalesce(numeric, F.lit(False))
    return F.coalesce(F.when(x.isNotNull() & y.isNotNull(), numeric).otherwise(text(a, a_kind) != text(b, b_kind)), F.lit(False))


def compare(baseline: DataFrame, current: DataFrame, key: Sequence[str] | str, columns: Sequence[str] | None = None, id_label: str = "Baseline", new_label: str = "Current", null_changes: bool = False, precision: int = 6, show_delta: bool = True) -> DataFrame:
    """Keys, status, changed columns, and of each compared column before, after and delta.

    Rows of the same key pair off in order. The delta is new less old, for numbers.
    ``null_changes`` also reports a value that comes or goes. Numbers are equal if they
    are to ``precision`` decimals; without ``show_delta`` there are no deltas.
    """
    keys = as_list(key)
    for df in (baseline, current):
        missing = [k for k in keys if k not in df.columns]
        if missing:
            raise KeyError(f"no key column {missing}")
    columns = [c for c in (columns or [c for c in baseline.columns if c != ORD]) if c not in keys]
    a_kinds, b_kinds = kinds(baseline), kinds(current)
    a = _numbered(baseline, keys).select(*[named(k) for k in keys], "__row__", *[named(c).alias(f"__a_{c}") for c in columns if c in a_kinds], F.lit(True).alias("__in_a"))
    b = _numbered(current, keys).select(*[named(k).alias(f"__k{i}") for i, k in enumerate(keys)], F.col("__row__").alias("__row_b"), *[named(c).alias(f"__b_{c}") for c in columns if c in b_kinds], F.lit(True).alias("__in_b"))
    on = reduce(lambda x, y: x & y, [named(k).eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(keys)]) & (F.col("__row__") == F.col("__row_b"))
    both = a.join(b, on, "full")
    in_a, in_b = F.col("__in_a").isNotNull(), F.col("__in_b").isNotNull()

    changes, shown = {}, []
    for c in columns:
        old = named(f"__a_{c}") if c in a_kinds else F.lit(None).cast("string")
        new = named(f"__b_{c}") if c in b_kinds else F.lit(None).cast("string")
        a_kind, b_kind = a_kinds.get(c, b_kinds.get(c, STRING)), b_kinds.get(c, a_kinds.get(c, STRING))
        differs = _differs(old, a_kind, new, b_kind, precision)
        changes[c] = differs | (old.isNull() != new.isNull()) if null_changes else differs
        delta = F.lit(None).cast("double") if {a_kind, b_kind} & {DATE, BOOLEAN} else to_number(new, b_kind) - to_number(old, a_kind)
        shown += [old.alias(f"{c} ({id_label})"), new.alias(f"{c} ({new_label})"), *[delta.alias(f"{c} Δ")] * show_delta]
    named_changes = F.array_compact(F.array(*[F.when(in_a & in_b & d, F.lit(c)) for c, d in changes.items()])) if changes else F.array().cast("array<string>")
    status = F.when(~in_a, "added").when(~in_b, "removed").when(F.size(CHANGED) > 0, "changed").otherwise("unchanged")
    key_columns = [F.when(in_a, named(k)).otherwise(F.col(f"__k{i}")).alias(k) for i, k in enumerate(keys)]
    return both.withColumn(CHANGED, named_changes).select(*key_columns, F.coalesce("__row__", "__row_b").alias("__row__"), status.alias(STATUS), CHANGED, *shown)


def counts(report: DataFrame) -> DataFrame:
    """One row: total, added, removed, changed."""
    of = lambda s: F.count_if(F.col(STATUS) == s)
    return report.agg(F.count(F.lit(1)).alias("total"), of("added").alias("added"), of("removed").alias("removed"), of("changed").alias("changed"))


def views(report: DataFrame) -> dict[str, DataFrame]:
    return {title: report.filter(F.col(STATUS) == s) for title, s in (("Changes", "changed"), ("New Rows", "added"), ("Missing Rows", "removed"))}


def by_column(report: DataFrame, keys: Sequence[str], columns: Sequence[str], id_label: str = "Baseline", new_label: str = "Current", include_unchanged: bool = False) -> dict[str, DataFrame]:
    """A narrow view for each column: of the rows that changed anywhere, or that are on both sides."""
    some = ["changed", "unchanged"] if include_unchanged else ["changed"]
    rows, out = report.filter(F.col(STATUS).isin(some)), {}
    for c in columns:
        title = f"Changed — {c}"[:31]
        n = 2
        while title in out:
            title = f"{f'Changed — {c}'[:28]}~{n}"
            n += 1
        out[title] = rows.select(*[named(k) for k in as_list(keys)], STATUS, *[named(x) for x in (f"{c} ({id_label})", f"{c} ({new_label})", f"{c} Δ") if x in report.columns])
    return out
