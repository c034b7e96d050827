"""Workbook export: sheets of compiled tables, and comparison reports."""

from __future__ import annotations

import logging
import os
from pathlib import Path
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import ExportError
from ..functions.dtypes import STRING, kind_of, kinds, named
from ..functions.expressions import compute
from ..functions.predicates import keep
from ..functions.transforms import apply_steps
from ..operators import compare as cmp
from ..operators.combine import as_list
from ..operators.ordering import ORD
from ..sources.xlsx import Sheet, column_name, sheet_of, write_workbook

log = logging.getLogger(__name__)
CELL = 32_767


def clean(c: Column) -> Column:
    """Control characters a workbook can't hold become spaces, line ends \\n, and the text is cut to a cell's length."""
    return F.substring(F.regexp_replace(F.regexp_replace(c, r"[\x00-\x08\x0B\x0C\x0E-\x1F]", " "), r"\r\n?", "\n"), 1, CELL)


def sanitise(df: DataFrame) -> DataFrame:
    return df.select(*[clean(named(f.name)).alias(f.name) if kind_of(f.dataType) == STRING else named(f.name) for f in df.schema.fields])


def output_dir(where: str | None) -> Path:
    path = Path(os.path.expandvars(where)) if where else Path("out")
    path.mkdir(parents=True, exist_ok=True)
    return path


def sheet_frame(df: DataFrame, spec: dict[str, Any], aliases: dict[str, dict] | None = None) -> DataFrame:
    """One sheet's rows and columns: filter, then of each column its value, expression or alias, and transforms."""
    df = keep(df.drop(ORD), spec.get("filter"), aliases)
    have, out = kinds(df), []
    for title, c in (spec.get("columns") or {}).items():
        c = {"alias": c} if isinstance(c, str) else c
        if "value" in c:
            made = F.lit(c["value"])
        elif "compute" in c:
            made = compute(df, c["compute"], aliases)
        else:
            name = c.get("alias", title)
            made = named(name) if name in have else F.lit(None).cast("string")
        if c.get("transforms"):
            made, _ = apply_steps(made, kinds(df.select(made.alias("x")))["x"], c["transforms"])
        out.append(made.alias(title))
    return sanitise(df.select(*out))


class Exporter:
    def __init__(self, output: str | None = None, aliases: dict[str, dict] | None = None):
        self.output, self.aliases = output, aliases or {}

    def frames(self, workbook: dict, compiled: dict[str, DataFrame]) -> dict[str, DataFrame]:
        """Sheet name -> its rows; a sheet is left out if its table is unknown, if it lists no columns, or if it can't be made."""
        out = {}
        for i, spec in enumerate(workbook.get("sheets", []), 1):
            source = spec.get("from") or next(iter(compiled), None)
            if source not in compiled:
                log.warning("sheet %s: no table %s", spec.get("name"), source)
                continue
            if not spec.get("columns"):
                log.warning("sheet %s: no columns", spec.get("name"))
                continue
            try:
                out[spec.get("name", f"Sheet{i}")] = sheet_frame(compiled[source], spec, self.aliases)
            except Exception as e:  # one sheet must not stop the others
                log.error("sheet %s: %s", spec.get("name"), e)
        return out

    def export_workbook(self, workbook: dict, compiled: dict[str, DataFrame]) -> str:
        sheets = []
        for name, df in self.frames(workbook, compiled).items():
            try:
                if df.columns and not df.isEmpty():
                    made = sheet_of(name[:31], df)
                    made.rows = list(made.rows) if df.count() <= 10_000 else made.rows
                    sheets.append(made)
            except Exception as e:
                log.error("sheet %s: %s", name, e)
        if not sheets:
            sheets = [Sheet("README", ["info"], [["no data exported"]])]
        path = output_dir(self.output) / f"{workbook.get('save_name', 'export')}.xlsx"
        try:
            return write_workbook(path, sheets)
        except OSError as e:
            raise ExportError(str(e)) from e

    def export_tables(self, workbook: dict, compiled: dict[str, DataFrame], fmt: str = "parquet") -> list[str]:
        """The same sheets as distributed files, one folder each, for tables too long for a workbook."""
        base = output_dir(self.output) / workbook.get("save_name", "export")
        paths = []
        for name, df in self.frames(workbook, compiled).items():
            df.write.mode("overwrite").format(fmt).save(str(base / name))
            paths.append(str(base / name))
        return paths


def write_comparison(baseline: DataFrame, current: DataFrame, key: Any, path: str, columns: list[str] | None = None, id_label: str = "Baseline", new_label: str = "Current", include_unchanged: bool = False, precision: int = 6, show_delta: bool = True) -> str:
    """The comparison as a workbook: legend, summary with links, the three views and a sheet for each column."""
    keys = as_list(key)
    columns = [c for c in (columns or [c for c in baseline.columns if c != ORD]) if c not in keys]
    report = cmp.compare(baseline, current, keys, columns, id_label, new_label, precision=precision, show_delta=show_delta).persist()
    try:
        totals = cmp.counts(report).first()
        views = {k: v.drop("__row__").withColumn(cmp.CHANGED, F.array_join(cmp.CHANGED, ", ")) for k, v in cmp.views(report).items()}
        views |= cmp.by_column(report, keys, columns, id_label, new_label, include_unchanged)
        sheets = [
            Sheet("README", ["what", "meaning"], [["added", f"only in {new_label}"], ["removed", f"only in {id_label}"], ["changed", "in both, with other values"], ["Δ", f"{new_label} less {id_label}"]]),
            Sheet("Summary", ["view", "rows"], [[k, totals[k]] for k in ("total", "added", "removed", "changed")] + [[name, None] for name in views], links={(5 + i, 0): f"'{name}'!A1" for i, name in enumerate(views)}),
        ]
        for name, df in views.items():
            sheet = sheet_of(name, sanitise(df))
            last = column_name(max(0, len(df.columns) - 1))
            status = column_name(df.columns.index(cmp.STATUS))
            sheet.shading = [(f"A2:{last}1048576", f'${status}2="{s}"', colour) for s, colour in (("added", "C6EFCE"), ("removed", "FFC7CE"), ("changed", "FFEB9C"))]
            sheet.arrows = [f"{column_name(i)}2:{column_name(i)}1048576" for i, c in enumerate(df.columns) if c.endswith(" Δ")]
            sample = [tuple(r) for r in df.limit(500).collect()]
            sheet.widths = [min(60, max([len(c), *[len(str(r[i])) for r in sample]]) + 2) for i, c in enumerate(df.columns)]
            sheets.append(sheet)
        return write_workbook(path, sheets)
    finally:
        report.unpersist()
