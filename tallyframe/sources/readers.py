"""Sources by kind, and what every loaded table goes through: projection, types, constraints."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import SourceError
from ..functions.dtypes import enforce, kinds, named
from ..functions.transforms import apply_steps, drops_rows
from ..operators.ordering import with_order
from .inline import inline_frame
from .xlsx import read_sheet

Table = tuple[str, dict, DataFrame]


def _inline(spark: SparkSession, src: dict) -> list[Table]:
    return [(t["table_id"], t, inline_frame(spark, t["rows"])) for t in src["data"]]


def _tables(src: dict) -> list[dict]:
    return src.get("tables") or [{"name": Path(src["path"]).stem}]


def _workbook(spark: SparkSession, src: dict) -> list[Table]:
    return [(t.get("table_id") or t["name"], t, read_sheet(spark, src["path"], t["name"])) for t in _tables(src)]


def _database(spark: SparkSession, src: dict) -> list[Table]:
    """Through JDBC: ``url`` and ``driver`` (and ``options``) name the database of a source that is one."""
    if not src.get("url"):
        raise RuntimeError(f"{src['path']}: give a JDBC url and driver for this database")
    reader = spark.read.format("jdbc").option("url", src["url"]).options(**src.get("options", {}))
    reader = reader.option("driver", src["driver"]) if src.get("driver") else reader
    return [(t.get("table_id") or t["name"], t, reader.option("dbtable", f"[{t['name']}]" if "." not in t["name"] else t["name"]).load()) for t in _tables(src)]


def _files(fmt: str, **options: Any) -> Callable[[SparkSession, dict], list[Table]]:
    def read(spark: SparkSession, src: dict) -> list[Table]:
        df = spark.read.format(fmt).options(**options, **src.get("options", {})).load(src["path"])
        return [(t.get("table_id") or t["name"], t, df) for t in _tables(src)]

    return read


READERS = {
    ".xlsx": _workbook,
    ".xlsm": _workbook,
    ".xls": _workbook,
    ".xlsb": _workbook,
    ".accdb": _database,
    ".mdb": _database,
    ".parquet": _files("parquet"),
    ".orc": _files("orc"),
    ".csv": _files("csv", header=True),
    ".json": _files("json"),
}


def reader(src: dict) -> Callable[[SparkSession, dict], list[Table]]:
    """Inline rows if there are any, else by the path's ending."""
    if "data" in src:
        return _inline
    ending = Path(str(src.get("path", "")).rstrip("/")).suffix.lower()
    if ending not in READERS:
        raise ValueError(f"no reader for {src.get('path')!r}")
    return READERS[ending]


def project(df: DataFrame, columns: Mapping[str, Any] | None) -> DataFrame:
    """The mapped columns under their aliases, transformed; a column that isn't there is null, others go.

    A plain-text spec names nothing: the column keeps its name. Without a map the
    table stays as it is.
    """
    df = with_order(df)
    if not columns:
        return df
    have, out, keep = kinds(df), [], F.lit(True)
    for source, spec in columns.items():
        spec = spec if isinstance(spec, dict) else {}
        alias, steps = spec.get("alias", source), spec.get("transforms")
        if source not in have:
            out.append(F.lit(None).cast("string").alias(alias))
            continue
        c, kind = apply_steps(named(source), have[source], steps)
        if drops_rows(steps):
            keep = keep & (c.isNotNull() | named(source).isNull())
        out.append(c.alias(alias))
    return df.filter(keep).select(*out, "__ord")


def outside(df: DataFrame, name: str, enum: Sequence[Any], samples: int) -> list[str]:
    """The first few values, in order, that are not in ``enum``; partial aggregates and a bounded top, whatever their number."""
    value = named(name).cast("string")
    bad = df.select(value.alias("v")).filter(~F.col("v").isin([str(x) for x in enum])).groupBy("v").agg(F.lit(1))
    return [r["v"] for r in bad.select("v").orderBy("v").limit(samples).collect()]


def problems(df: DataFrame, aliases: Mapping[str, dict], samples: int = 5) -> list[str]:
    """What breaks not_null, enum and identifier, found by one aggregate over the table; samples are looked up only where there are any."""
    ask, told = {}, {}
    for i, (name, spec) in enumerate((n, s) for n, s in aliases.items() if n in df.columns):
        c = named(name)
        if spec.get("not_null"):
            ask[f"n{i}"] = F.count_if(c.isNull())
            told[f"n{i}"] = lambda v, name=name: f"{name}: {v} null values" if v else None
        if spec.get("enum"):
            ask[f"e{i}"] = F.count_if(~c.cast("string").isin([str(x) for x in spec["enum"]]))
            told[f"e{i}"] = lambda v, name=name, spec=spec: f"{name}: values outside enum such as {outside(df, name, spec['enum'], samples)}" if v else None
        if spec.get("identifier"):
            ask[f"i{i}"] = F.struct(F.count_if(c.isNull()).alias("nulls"), (F.count(c) - F.count_distinct(c)).alias("twice"))
            told[f"i{i}"] = lambda v, name=name: f"{name}: identifier with {v['nulls']} nulls and {v['twice']} repeated values" if v["nulls"] or v["twice"] else None
    if not ask:
        return []
    row = df.agg(*[c.alias(k) for k, c in ask.items()]).first()
    return [x for k in ask if (x := told[k](row[k]))]


def validate(df: DataFrame, aliases: Mapping[str, dict], table: str = "table") -> None:
    found = problems(df, aliases)
    if found:
        raise SourceError(f"{table}: " + "; ".join(found))


def load_source(spark: SparkSession, src: dict, aliases: dict[str, dict]) -> dict[str, DataFrame]:
    """table_id -> table, projected, typed and checked."""
    out = {}
    for table_id, spec, df in reader(src)(spark, src):
        df = enforce(project(df, spec.get("columns")), aliases)
        validate(df, aliases, table_id)
        out[table_id] = df
    return out


