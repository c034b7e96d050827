"""Planning and running of a configuration: load, compile, compare, export."""

from __future__ import annotations

import logging
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from ..functions.predicates import keep
from ..operators.combine import as_list, dedupe, diff, merge, union
from ..operators.enrich import enrich
from ..operators.ordering import ORD, with_order
from ..sources.readers import load_source
from .config import Config
from .export import Exporter, output_dir, write_comparison

log = logging.getLogger(__name__)


def compile_target(target: dict[str, Any], raw: dict[str, DataFrame], compiled: dict[str, DataFrame], aliases: dict[str, dict]) -> DataFrame:
    """The plan of one target; nothing is run but the checks that enrich steps ask for."""
    mode = target.get("mode", "merge")
    ends = [target[s] for s in ("left", "right") if s in target] if mode == "diff" else []
    inputs = as_list(target.get("inputs")) or ends
    missing = [i for i in [*inputs, *ends] if i not in raw]
    if missing:
        raise ValueError(f"target {target.get('name')}: no tables {missing}")
    filters = target.get("pre_filter") or {}
    tables = {i: keep(raw[i], filters.get(i), aliases) for i in dict.fromkeys([*inputs, *ends])}
    steps = target.get("enrich") or []
    frames = raw | compiled
    if mode == "diff":
        out = diff(tables[target["left"]], tables[target["right"]], target["on"], target.get("side", "left_only"), target.get("columns_left"), target.get("columns_right"), target.get("project"), target.get("add_source"), target.get("project_all", False))
        return keep(enrich(out, steps, frames).drop(ORD) if steps else out, target.get("post_filter"), aliases)
    tables = {i: tables[i] for i in inputs}
    if mode == "union":
        out = union(tables, target.get("columns"), aliases, target.get("add_source", False))
        early = target.get("enrich_at", "post_dedupe") == "pre_dedupe"
        if early:
            out = enrich(out, steps, frames)
        if target.get("dedupe_on"):
            out = dedupe(out, as_list(target["dedupe_on"]), target.get("keep", "first"))
        if not early:
            out = enrich(out, steps, frames)
    else:
        out = enrich(with_order(merge(tables, target.get("key"), target.get("merge_rules"), target.get("strict_source", False))), steps, frames)
    return keep(out, target.get("post_filter"), aliases)


class Pipeline:
    """A configuration with its tables: ``raw`` by table id, ``compiled`` by target."""

    def __init__(self, config: Config | dict, spark: SparkSession | None = None):
        self.config = config if isinstance(config, Config) else Config(config)
        self.spark = spark or SparkSession.builder.getOrCreate()
        self.raw: dict[str, DataFrame] = {}
        self.compiled: dict[str, DataFrame] = {}
        self.written: list[str] = []

    def load(self) -> None:
        for src in self.config.sources:
            self.raw |= load_source(self.spark, src, self.config.schema_aliases)
        for name, df in self.raw.items():
            if name.isidentifier():
                df.drop(ORD).createOrReplaceTempView(name)

    def compile(self) -> None:
        for target in self.config.compile_targets:
            self.compiled[target["name"]] = compile_target(target, self.raw, self.compiled, self.config.schema_aliases)

    def table(self, name: str) -> DataFrame:
        """A compiled or raw table without its order column."""
        return (self.raw | self.compiled)[name].drop(ORD)

    def run(self) -> list[str]:
        self.load()
        self.compile()
        for pair in self.config.compare_pairs:
            left, right = pair["left"], pair["right"]
            if left not in self.compiled or right not in self.compiled:
                log.error("%s and %s can't be compared: both must be compiled targets", left, right)
                continue
            path = pair.get("path") or str(Path(output_dir(self.config.output)) / f"{pair.get('save_name', f'{left}_vs_{right}')}.xlsx")
            self.written.append(write_comparison(self.compiled[left], self.compiled[right], pair.get("on"), path, pair.get("compare_cols"), pair.get("id_label", "Baseline"), pair.get("new_label", "Current"), pair.get("include_unchanged_in_bycol", False), pair.get("number_precision", 6), pair.get("show_delta_cols", True)))
        exporter = Exporter(self.config.output, self.config.schema_aliases)
        for workbook in self.config.export_workbooks:
            self.written.append(exporter.export_workbook(workbook, self.compiled))
        return self.written
