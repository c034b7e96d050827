"""The expression language of ``compute``: a JSON tree compiled to one Column.

A node is ["op", a, b], {"op": .., "args": [..]}, {"col": name} or a literal. The
compiler carries each part's kind, so that the right Spark operator is chosen and
nothing is cast behind the reader's back.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import ExprError
from .dtypes import BOOLEAN, DATE, INTEGER, NUMBER, STRING, java_format, kinds, named, text, to_date, to_number
from .predicates import compare, literal_kind, member, null_is_unequal
from .registry import plugins


@dataclass
class Part:
    column: Column
    kind: str
    literal: Any = None
    is_literal: bool = False
    declared: str | None = None


MICROS = {"day": 86_400_000_000, "hour": 3_600_000_000, "minute": 60_000_000}


def half_even(c: Column, digits: int, kind: str) -> Column:
    """Rounding of ties to even, by the scaled double as numpy does it; whole numbers stay whole."""
    if kind == INTEGER:
        return c if digits >= 0 else F.bround(c, digits)
    scale = 10.0**digits
    return F.rint(c.cast("double") * F.lit(scale)) / F.lit(scale)


def divide(a: Column, b: Column) -> Column:
    """True division; x / 0 is infinite and 0 / 0 is NaN."""
    a, b = a.cast("double"), b.cast("double")
    zero = F.when(a > 0, float("inf")).when(a < 0, float("-inf")).when(a == 0, float("nan"))
    return F.when(b == 0, zero).otherwise(a / F.nullif(b, F.lit(0.0)))


class Compiler:
    def __init__(self, df: DataFrame, declared: dict[str, dict] | None = None):
        self.df, self.kinds, self.declared = df, kinds(df), declared or {}

    def part(self, node: Any) -> Part:
        if isinstance(node, dict) and set(node) == {"col"}:
            name = node["col"]
            if name not in self.kinds:
                raise ExprError(f"unknown column: {name}")
            return Part(named(name), self.kinds[name], declared=self.declared.get(name, {}).get("type"))
        if isinstance(node, dict) and "op" in node:
            return self.call(node["op"], node.get("args", []))
        if isinstance(node, list):
            if not node:
                raise ExprError("empty expression")
            return self.call(node[0], node[1:])
        if isinstance(node, dict):
            raise ExprError(f"not an expression: {node}")
        return Part(F.lit(node), STRING if node is None else literal_kind(node), node, True)

    def call(self, op: str, args: list) -> Part:
        if op in ("in", "not_in"):
            return self._in(op, args)
        special = getattr(self, f"_{op}", None) if isinstance(op, str) else None
        if special is None and op not in plugins("expressions"):
            raise ExprError(f"unknown operator: {op}")
        parts = [self.part(a) for a in args]
        if op in plugins("expressions"):
            made = plugins("expressions")[op](self.df, *[p.column for p in parts])
            return Part(made, kinds(self.df.select(made.alias("x")))["x"])
        try:
            return special(*parts)
        except TypeError as e:
            raise ExprError(f"{op}: {e}") from e

    # literals and choice
    def _lit(self, a: Part) -> Part:
        return a

    def _if(self, condition: Part, a: Part, b: Part | None = None) -> Part:
        yes, no = a.column, F.lit(None) if b is None else b.column
        kind = a.kind
        if b is not None and a.kind != b.kind and not (b.is_literal and b.literal is None):
            numeric = {a.kind, b.kind} <= {INTEGER, NUMBER}
            kind = NUMBER if numeric else STRING if not (a.is_literal and a.literal is None) else b.kind
            if kind == STRING:
                yes, no = text(yes, a.kind), text(no, b.kind)
        return Part(F.when(condition.column, yes).otherwise(no), kind)

    def _in(self, op: str, args: list) -> Part:
        values = args[1]
        if isinstance(values, dict):
            values = values.get("list", values.get("set"))
        if not isinstance(values, list):
            raise ExprError(f"{op} needs a list")
        a = self.part(args[0])
        found = member(a.column, a.kind, values)
        return Part(found if op == "in" else ~found, BOOLEAN)

    # arithmetic
    def _numeric(self, op, parts) -> Part:
        kind = INTEGER if all(p.kind in (INTEGER, BOOLEAN) for p in parts) else NUMBER
        columns = [p.column.cast("long") if p.kind in (BOOLEAN, INTEGER) else p.column for p in parts]
        if kind == NUMBER:
            columns = [c.cast("double") for c in columns]
        return Part(reduce(op, columns), kind)

    def _add(self, *parts: Part) -> Part:
        if all(p.kind == STRING for p in parts):
            return Part(F.concat(*[p.column for p in parts]), STRING)
        return self._numeric(lambda a, b: a + b, parts)

    def _sub(self, a: Part, b: Part) -> Part:
        if a.kind == b.kind == DATE:
            return Part(a.column.cast("timestamp_ntz") - b.column.cast("timestamp_ntz"), "other")
        return self._numeric(lambda x, y: x - y, (a, b))

    def _mul(self, *parts: Part) -> Part:
        return self._numeric(lambda a, b: a * b, parts)

    def _percent(self, a: Part, b: Part) -> Part:
        return self._mul(a, b)

    def _div(self, a: Part, b: Part) -> Part:
        return Part(divide(a.column, b.column), NUMBER)

    def _pow(self, a: Part, b: Part) -> Part:
        whole = a.kind == b.kind == INTEGER
        out = F.pow(a.column.cast("double"), b.column.cast("double"))
        if whole:
            out = F.when(b.column < 0, F.raise_error(F.lit("whole numbers have no negative powers")).cast("long")).otherwise(out.cast("long"))
        return Part(out, INTEGER if whole else NUMBER)

    def _neg(self, a: Part) -> Part:
        return Part(-a.column, a.kind)

    def _abs(self, a: Part) -> Part:
        return Part(F.abs(a.column), a.kind)

    def _round(self, a: Part, digits: Part | None = None) -> Part:
        n = int(digits.literal) if digits is not None and digits.is_literal and digits.literal is not None else 0
        return Part(half_even(a.column, n, a.kind), a.kind)

    def _clip(self, a: Part, low: Part | None = None, high: Part | None = None) -> Part:
        out = a.column
        chain = None
        for bound, beyond in ((low, lambda b: out < b), (high, lambda b: out > b)):
            if bound is not None and not (bound.is_literal and bound.literal is None):
                chain = (F if chain is None else chain).when(beyond(bound.column), bound.column)
        return Part(out if chain is None else chain.otherwise(out), a.kind)

    # comparison and logic
    def _compare(self, op: str, a: Part, b: Part) -> Part:
        keeps = null_is_unequal(a.declared)
        out = compare(a.column, a.kind, op, b.column, b.kind, keeps) if a.kind != STRING or b.kind != DATE else compare(b.column, b.kind, {"<": ">", "<=": ">=", ">": "<", ">=": "<="}.get(op, op), a.column, a.kind, keeps)
        return Part(F.coalesce(out, F.lit(False)) if keeps and op != "!=" else out, BOOLEAN)

    def _eq(self, a: Part, b: Part) -> Part:
        return self._compare("==", a, b)

    def _neq(self, a: Part, b: Part) -> Part:
        return self._compare("!=", a, b)

    def _gt(self, a: Part, b: Part) -> Part:
        return self._compare(">", a, b)

    def _gte(self, a: Part, b: Part) -> Part:
        return self._compare(">=", a, b)

    def _lt(self, a: Part, b: Part) -> Part:
        return self._compare("<", a, b)

    def _lte(self, a: Part, b: Part) -> Part:
        return self._compare("<=", a, b)

    def _and(self, *parts: Part) -> Part:
        return Part(reduce(lambda a, b: a & b, [p.column.cast("boolean") for p in parts]), BOOLEAN)

    def _or(self, *parts: Part) -> Part:
        return Part(reduce(lambda a, b: a | b, [p.column.cast("boolean") for p in parts]), BOOLEAN)

    def _not(self, a: Part) -> Part:
        return Part(~a.column.cast("boolean"), BOOLEAN)

    # nulls
    def _coalesce(self, *parts: Part) -> Part:
        kind = next((p.kind for p in parts if not (p.is_literal and p.literal is None)), STRING)
        mixed = len({p.kind for p in parts if not (p.is_literal and p.literal is None)} - {kind}) > 0
        if mixed and not {p.kind for p in parts} <= {INTEGER, NUMBER}:
            return Part(F.coalesce(*[text(p.column, p.kind) for p in parts]), STRING)
        return Part(F.coalesce(*[p.column for p in parts]), NUMBER if mixed else kind)

    def _fillna(self, a: Part, b: Part) -> Part:
        return self._coalesce(a, b)

    def _is_null(self, a: Part) -> Part:
        return Part(a.column.isNull(), BOOLEAN)

    def _not_null(self, a: Part) -> Part:
        return Part(a.column.isNotNull(), BOOLEAN)

    # text
    def _concat(self, *parts: Part) -> Part:
        columns = [text(p.column, p.kind) for p in parts]
        return Part(columns[0] if len(columns) == 1 else F.concat_ws("", *columns), STRING)

    def _len(self, a: Part) -> Part:
        return Part(F.length(text(a.column, a.kind)).cast("long"), INTEGER)

    def _regex_replace(self, a: Part, pattern: Part, repl: Part) -> Part:
        from .transforms import java_pattern, java_replacement

        return Part(F.regexp_replace(text(a.column, a.kind), java_pattern(pattern.literal), java_replacement(repl.literal)), STRING)

    # dates
    def _strftime(self, *parts: Part) -> Part:
        fmt, a = (parts[0].literal, parts[1]) if len(parts) > 1 and parts[0].is_literal and isinstance(parts[0].literal, str) else ("%Y-%m-%d", parts[-1])
        return Part(F.date_format(to_date(a.column, a.kind).cast("timestamp"), java_format(fmt)), STRING)

    def _datediff(self, unit: Part, end: Part, start: Part) -> Part:
        if unit.literal not in MICROS:
            raise ExprError(f"unknown unit: {unit.literal}")
        end_at, start_at = (F.unix_micros(to_date(p.column, p.kind).cast("timestamp")) for p in (end, start))
        passed = (end_at - start_at) / F.lit(float(MICROS[unit.literal]))
        return Part(F.floor(passed), INTEGER) if unit.literal == "day" else Part(passed, NUMBER)


def compute(df: DataFrame, node: Any, declared: dict[str, dict] | None = None) -> Column:
    """The expression over ``df`` as a column."""
    return Compiler(df, declared).part(node).column
