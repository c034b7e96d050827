"""Row filters: AND / OR trees over single-column conditions."""

from __future__ import annotations

from datetime import date, datetime
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .dtypes import BOOLEAN, DATE, INTEGER, NUMBER, STRING, kinds, named

ORDER = {"==": "eq", "!=": "ne", ">": "gt", ">=": "ge", "<": "lt", "<=": "le"}


def literal_kind(v: Any) -> str:
    if isinstance(v, bool):
        return BOOLEAN
    if isinstance(v, int):
        return INTEGER
    if isinstance(v, float):
        return NUMBER
    if isinstance(v, date | datetime):
        return DATE
    return STRING


def comparable(kind: str, other: str) -> bool:
    numeric = (INTEGER, NUMBER, BOOLEAN)
    return kind == other or (kind in numeric and other in numeric) or {kind, other} == {DATE, STRING}


def literal(v: Any, kind: str) -> Column:
    """``v`` to be held against a column of ``kind``; a date may be given as text."""
    if kind == DATE and isinstance(v, str):
        return F.try_to_timestamp(F.lit(v)).cast("timestamp_ntz")
    if isinstance(v, bool) and kind in (INTEGER, NUMBER):
        return F.lit(int(v))
    return F.lit(v)


def compare(c: Column, kind: str, op: str, v: Column, v_kind: str, keeps_null: bool) -> Column:
    """A comparison that is never an implicit cast: unlike kinds are unequal and can't be ordered.

    ``keeps_null``: whether null is unequal to everything, rather than unknown.
    """
    if not comparable(kind, v_kind):
        if op in ("==", "!="):
            return F.lit(op == "!=") if op == "==" or keeps_null else F.when(c.isNotNull() & v.isNotNull(), True)
        raise TypeError(f"can't order {kind} and {v_kind}")
    if kind == BOOLEAN and v_kind != BOOLEAN:
        c = c.cast("int")
    if v_kind == BOOLEAN and kind != BOOLEAN:
        v = v.cast("int")
    if kind == DATE and v_kind == STRING:
        v = F.try_to_timestamp(v).cast("timestamp_ntz")
    if op == "==":
        return c == v
    if op == "!=":
        return F.coalesce(c != v, F.lit(True)) if keeps_null else c != v
    return {">": c > v, ">=": c >= v, "<": c < v, "<=": c <= v}[op]


def null_is_unequal(declared: str | None) -> bool:
    """Undeclared, number and date columns keep null rows under !=; the others drop them."""
    return declared not in (INTEGER, STRING, BOOLEAN)


def member(c: Column, kind: str, values: list) -> Column:
    """Whether ``c`` is one of ``values``; null is, if it is listed."""
    some = [v for v in values if v is not None and comparable(kind, literal_kind(v))]
    out = c.isin([literal(v, kind) for v in some]) if some else F.lit(False)
    if any(v is None for v in values):
        out = out | c.isNull()
    return F.coalesce(out, F.lit(False))


def _leaf(df_kinds: dict[str, str], declared: dict[str, dict], field: str, spec: dict) -> Column:
    if field not in df_kinds:
        raise KeyError(field)
    op = spec.get("op")
    if not op:
        raise ValueError(f"the condition on {field} has no op")
    c, kind = named(field), df_kinds[field]
    if op == "is_null":
        return c.isNull()
    if op == "not_null":
        return c.isNotNull()
    if op == "between":
        low, high = spec["start"], spec["end"]
        return compare(c, kind, ">=", literal(low, kind), literal_kind(low), False) & compare(c, kind, "<=", literal(high, kind), literal_kind(high), False)
    value = spec.get("value")
    if op in ("in", "not_in"):
        found = member(c, kind, list(value))
        return found if op == "in" else ~found
    if op not in ORDER:
        raise ValueError(f"unsupported op: {op}")
    v_kind = kind if value is None else literal_kind(value)
    return compare(c, kind, op, literal(value, kind), v_kind, null_is_unequal(declared.get(field, {}).get("type")))


def mask(df: DataFrame, expr: dict | None, declared: dict[str, dict] | None = None) -> Column:
    """The filter as a column; no filter keeps every row.

    ``declared``: the schema's aliases, which decide how null compares. AND is looked
    at before OR; a condition names exactly one column.
    """
    have, declared = kinds(df), declared or {}

    def build(node: dict) -> Column:
        if not node:
            return F.lit(True)
        for word, join in (("AND", lambda a, b: a & b), ("OR", lambda a, b: a | b)):
            if word in node:
                return reduce(join, [build(x) for x in node[word]]) if node[word] else _empty(word)
        if len(node) != 1:
            raise ValueError("a condition names exactly one column")
        ((field, spec),) = node.items()
        return _leaf(have, declared, field, spec)

    return build(expr or {})


def _empty(word: str) -> Column:
    raise IndexError(f"{word} of nothing")


def keep(df: DataFrame, expr: dict | None, declared: dict[str, dict] | None = None) -> DataFrame:
    return df.filter(mask(df, expr, declared)) if expr else df
