"""Union, merge and diff of tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import ConfigError
from ..functions.dtypes import coerce, named
from .ordering import ORD, with_order


def visible(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c != ORD]


def need(columns: Sequence[str], df: DataFrame, what: str) -> None:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"{what} lacks {missing}")


def as_list(x: Any) -> list:
    return [] if x is None else [x] if isinstance(x, str) else list(x)


# --- union --------------------------------------------------------------------


def union(inputs: Mapping[str, DataFrame], columns: Sequence[str] | None = None, aliases: dict[str, dict] | None = None, add_source: bool = False) -> DataFrame:
    """All rows of all inputs, in their order; without ``columns`` those that every input has, by name."""
    frames = dict(inputs)
    if not columns:
        columns = sorted(set.intersection(*[set(visible(f)) for f in frames.values()]))
        if not columns:
            raise ValueError("the inputs have no column in common")
    parts = []
    for i, (name, df) in enumerate(frames.items()):
        need(columns, df, name)
        df = coerce(with_order(df).select(*[named(c) for c in columns], ORD), {k: v for k, v in (aliases or {}).items() if k in columns})
        if add_source:
            df = df.withColumn("_source", F.lit(name))
        parts.append(df.withColumn("__input", F.lit(i)))
    out = reduce(lambda a, b: a.unionByName(b), parts)
    return out.withColumn(ORD, F.struct("__input", ORD)).drop("__input")


def dedupe(df: DataFrame, on: Sequence[str], keep: str | bool = "first") -> DataFrame:
    """One row for each key (null is a key): the first or the last; with False only rows whose key is single."""
    need(on, df, "the target")
    df = with_order(df)
    keys = [named(c) for c in on]
    if keep is False:
        mark = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    else:
        mark = F.row_number().over(Window.partitionBy(*keys).orderBy(F.col(ORD).desc() if keep == "last" else F.col(ORD).asc()))
    return df.withColumn("__mark", mark).filter("__mark = 1").drop("__mark")


# --- merge --------------------------------------------------------------------


def full_join(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Full outer join in which null keys meet; the keys of either side, then the rest of both."""
    right = b.select(*[named(c).alias(f"__k{i}") if c in keys else named(c) for i, c in sorted(((list(keys).index(c) if c in keys else -1), c) for c in b.columns)])
    on = reduce(lambda x, y: x & y, [named(k).eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(keys)])
    joined = a.withColumn("__in_a", F.lit(True)).join(right.withColumn("__in_b", F.lit(True)), on, "full")
    key = [F.when(F.col("__in_a"), named(k)).otherwise(F.col(f"__k{i}")).alias(k) for i, k in enumerate(keys)]
    return joined.select(*key, *[named(c) for c in a.columns if c not in keys], *[named(c) for c in b.columns if c not in keys], "__in_a", "__in_b")


def _rule(columns: list[str], field: str, rule: Any, inputs: Sequence[str], strict: bool) -> Column:
    versions = [c for c in columns if c == field or c.startswith(f"{field}__")]
    if not versions:
        raise KeyError(field)
    if rule == "first_non_null":
        return F.coalesce(*[named(c) for c in versions])
    strategy = rule.get("strategy", "first_non_null")
    at = lambda name: field if name == inputs[0] else f"{field}__{list(inputs).index(name)}"
    if strategy == "first_non_null":
        order = rule.get("priority") or (inputs if strict else [])
        if strict:
            picked = [at(n) for n in order if n in inputs and at(n) in columns]
        else:  # the base column first, then the listed inputs' in the order of the inputs; none listed: the base column
            picked = [field] * (field in columns) + [at(n) for n in inputs if n in order and at(n) != field and at(n) in columns]
        return F.coalesce(*[named(c) for c in dict.fromkeys(picked or versions)])
    if strategy == "prefer_source":
        source = rule["prefer_source"]
        if strict and source in inputs and at(source) in columns:
            return named(at(source))
        return named(next((c for c in versions if source in c), field))
    raise ConfigError(f"unknown merge strategy: {strategy}")


def merge(inputs: Mapping[str, DataFrame], key: Sequence[str] | None, rules: Mapping[str, Any] | None = None, strict_source: bool = False) -> DataFrame:
    """Full outer joins from left to right; a name that is taken gets the suffix __<position> of its input.

    With rules the suffixed columns are settled by them and dropped, and with them
    every column with __ in its name.
    """
    names = list(inputs)
    key = as_list(key)
    if len(names) > 1 and not key:
        raise ConfigError("a merge of several inputs needs a key")
    frames = [inputs[n].drop(ORD) for n in names]
    out = frames[0]
    for i, df in enumerate(frames[1:], 1):
        need(key, df, names[i])
        need(key, out, names[0])
        renamed = df.select(*[named(c).alias(f"{c}__{i}") if c not in key and c in out.columns else named(c) for c in df.columns])
        out = full_join(out, renamed, key).drop("__in_a", "__in_b")
    if rules:
        made = {field: _rule(out.columns, field, rule, names, strict_source) for field, rule in rules.items()}
        out = out.withColumns(made)
        out = out.select(*[named(c) for c in out.columns if "__" not in c])
    return out


# --- diff ---------------------------------------------------------------------


def diff(
    left: DataFrame,
    right: DataFrame,
    on: Sequence[str],
    side: str = "left_only",
    columns_left: Sequence[str] | None = None,
    columns_right: Sequence[str] | None = None,
    project: str | None = None,
    add_source: bool | None = None,
    project_all: bool = False,
) -> DataFrame:
    """Rows by where their key is: left_only, right_only, symmetric_diff or both.

    ``project``: keys; left or right - of that side the columns the other has too
    (all of them with ``project_all``), by their own names; both - the columns that
    both have with _left and then _right (with ``project_all`` those of one side too,
    by their own names), and _merge.
    """
    on = as_list(on)
    need(on, left, "left")
    need(on, right, "right")
    pick = lambda df, some: df.select(*[named(c) for c in dict.fromkeys([*on, *(some or [c for c in visible(df) if c not in on])])])
    a, b = pick(left, columns_left), pick(right, columns_right)
    project = project or {"left_only": "left", "right_only": "right"}.get(side, "both")
    shared = [c for c in a.columns if c not in on and c in b.columns]
    suffixed = lambda df, s: df.select(*[named(c).alias(f"{c}{s}") if c in shared else named(c) for c in df.columns])
    joined = full_join(suffixed(a, "_left"), suffixed(b, "_right"), on)
    in_a, in_b = F.coalesce("__in_a", F.lit(False)), F.coalesce("__in_b", F.lit(False))
    wanted = {"left_only": in_a & ~in_b, "right_only": in_b & ~in_a, "symmetric_diff": in_a != in_b, "both": in_a & in_b}
    if side not in wanted:
        raise ValueError(f"unknown side: {side}")
    rows = joined.filter(wanted[side])
    where = F.when(in_a & in_b, "both").when(in_a, "left_only").otherwise("right_only")
    extra = [F.when(in_a & in_b, "both").when(in_a, "left").otherwise("right").alias("_source")] if (side == "symmetric_diff" if add_source is None else add_source) else []
    keys = [named(k) for k in on]
    if project == "keys":
        return rows.select(*keys, *extra)
    if project in ("left", "right"):
        own, suffix = (a, "_left") if project == "left" else (b, "_right")
        rest = [c for c in own.columns if c not in on and (c in shared or project_all)]
        return rows.select(*keys, *[named(f"{c}{suffix}" if c in shared else c).alias(c) for c in rest], *extra)
    rest = [c for c in rows.columns if c not in (*on, "__in_a", "__in_b")]
    if not project_all:
        rest = [c for end in ("_left", "_right") for c in rest if c.endswith(end)]
    return rows.select(*keys, *[named(c) for c in rest], *extra, where.alias("_merge"))
