"""Column transforms: each step takes a column and its kind and gives both back."""

from __future__ import annotations

import re
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import TransformError
from .dtypes import BOOLEAN, DATE, INTEGER, NUMBER, STRING, cast, java_format, text, to_date
from .registry import plugins


def java_pattern(pattern: str, flags: str = "") -> str:
    r"""A Python pattern for Java's engine, with Unicode classes as Python has them; (?P<n>..) and \Z differ."""
    return "(?U)" + ("(?i)" if "i" in flags else "") + pattern.replace("(?P<", "(?<").replace(r"\Z", r"\z")


def java_replacement(repl: str) -> str:
    r"""\1 and \g<1> as $1; a literal $ is escaped."""
    out = repl.replace("$", r"\$")
    return re.sub(r"\\g<(\w+)>", lambda m: f"${m[1]}" if m[1].isdigit() else f"${{{m[1]}}}", re.sub(r"\\(\d)", r"$\1", out))


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def title(c: Column) -> Column:
    """Each run of letters with a capital first letter, as Python's str.title()."""
    runs = F.regexp_extract_all(c, F.lit(r"(\p{L}+|[^\p{L}]+)"), F.lit(1))
    return F.array_join(F.transform(runs, lambda r: F.concat(F.upper(F.substring(r, 1, 1)), F.lower(F.substring(r, F.lit(2), F.length(r))))), "")


STEPS = {"strip": strip, "lower": F.lower, "upper": F.upper, "title": title, "collapse_ws": lambda c: F.regexp_replace(c, r"(?U)\s+", " ")}


def _cast(c: Column, kind: str, params: dict) -> tuple[Column, str]:
    to, policy, fmt = params.get("to", STRING), params.get("on_cast_error", "fail"), params.get("format")
    if to == STRING:
        return text(c, kind), STRING
    if to not in (INTEGER, NUMBER, BOOLEAN, DATE):
        raise TransformError(f"cast to {to} is unknown")
    if to == BOOLEAN and kind == STRING and policy == "fail":
        return F.when(c.isNotNull(), F.raise_error(F.lit("text can't be cast to boolean")).cast("boolean")), BOOLEAN
    out = cast(c, kind, to, fmt)
    if policy == "fail" and (to != DATE or "on_cast_error" in params):
        out = F.when(c.isNotNull() & out.isNull(), F.raise_error(F.concat(F.lit(f"can't be cast to {to}: "), text(c, kind))).cast(out_type(to))).otherwise(out)
    return out, to


def out_type(kind: str) -> str:
    return {INTEGER: "long", NUMBER: "double", BOOLEAN: "boolean", DATE: "timestamp_ntz"}.get(kind, "string")


def _map(c: Column, kind: str, table: dict) -> tuple[Column, str]:
    if not table:
        return c, kind
    pairs = F.create_map(*[F.lit(str(x)) for kv in table.items() for x in kv])
    return F.coalesce(F.try_element_at(pairs, text(c, kind)), text(c, kind)), STRING


def apply_step(c: Column, kind: str, name: str, params: Any) -> tuple[Column, str]:
    """One transform by name; plug-ins come before the built-in ones."""
    params = {} if params is None else params
    if name in plugins("transforms"):
        return plugins("transforms")[name](c, params), kind
    if name == "regex_replace":
        return F.regexp_replace(text(c, kind), java_pattern(params["pattern"], params.get("flags", "")), java_replacement(params.get("repl", ""))), STRING
    if name == "cast":
        return _cast(c, kind, params)
    if name in ("normalize", "titlecase"):
        out = text(c, kind)
        for step in ["title"] if name == "titlecase" else params:
            if step not in STEPS:
                raise ValueError(f"unknown normalize step: {step}")
            out = STEPS[step](out)
        return out, STRING
    if name == "map":
        return _map(c, kind, params.get("map", {}))
    if name == "affix":
        filled, fix = F.coalesce(text(c, kind), F.lit("")), F.lit(params.get("text", ""))
        return (F.concat(fix, filled) if params.get("position", "suffix") == "prefix" else F.concat(filled, fix)), STRING
    if name == "strftime":
        return F.date_format(to_date(c, kind).cast("timestamp"), java_format(params.get("format", "%Y-%m-%d"))), STRING
    raise TransformError(f"unknown transform: {name}")


def flatten(steps: Any) -> list[tuple[str, Any]]:
    """(name, parameters) of a step, a list of steps or lists within lists; of a step with several keys the first counts."""
    if not steps:
        return []
    if isinstance(steps, dict):
        return [next(iter(steps.items()))]
    return [x for s in steps for x in flatten(s)]


def apply_steps(c: Column, kind: str, steps: Any) -> tuple[Column, str]:
    for name, params in flatten(steps):
        c, kind = apply_step(c, kind, name, params)
    return c, kind


def drops_rows(steps: Any) -> bool:
    """Whether a cast among the steps asks for rows to be dropped."""
    return any(name == "cast" and (params or {}).get("on_cast_error") == "drop_row" for name, params in flatten(steps))
