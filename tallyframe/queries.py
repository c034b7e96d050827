"""The engine's registered queries over the sample tables, and their SQL."""

from __future__ import annotations

import tempfile
from collections.abc import Callable
from functools import reduce
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.dtypes import enforce, kinds
from .functions.expressions import compute
from .functions.predicates import keep
from .functions.registry import register
from .functions.transforms import apply_steps
from .operators import combine
from .operators.compare import CHANGED, STATUS, by_column, compare, counts
from .operators.enrich import enrich, lookup
from .operators.ordering import ORD
from .plans.export import Exporter, clean, sheet_frame
from .plans.pipeline import compile_target
from .sources.readers import problems, project
from .sources.xlsx import read_sheet, sheet_of, write_workbook
from .store import Document, WorkbookStore

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    def add(f: Query) -> Query:
        key = name or f.__name__
        QUERIES[key] = f
        if sql:
            ORACLE_SQL[key] = sql
        return f

    return add


def t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def parties(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    c = t(spark, d, "customer").selectExpr("c_custkey id", "c_name name", "c_nationkey nation", "c_acctbal bal", "c_mktsegment seg")
    s = t(spark, d, "supplier").selectExpr("s_suppkey id", "s_name name", "s_nationkey nation", "s_acctbal bal")
    return {"customer": c, "supplier": s}


ALIASES = {"id": {"type": "integer"}, "name": {"type": "string"}, "nation": {"type": "integer"}, "bal": {"type": "number"}}
PARTIES = """c AS (SELECT c_custkey id, c_name AS name, c_nationkey::BIGINT nation, c_acctbal bal FROM customer),
 s AS (SELECT s_suppkey id, s_name AS name, s_nationkey::BIGINT nation, s_acctbal bal FROM supplier)"""

# --- union, dedupe ---------------------------------------------------------------


@query(f"WITH {PARTIES} SELECT id, name, nation, bal FROM c UNION ALL SELECT id, name, nation, bal FROM s")
def union_basic(spark, d):
    return combine.union(parties(spark, d), ["id", "name", "nation", "bal"], ALIASES).drop(ORD)


@query(f"WITH {PARTIES} SELECT bal, id, name, nation FROM c UNION ALL SELECT bal, id, name, nation FROM s")
def union_intersection_cols(spark, d):
    return combine.union(parties(spark, d), None, ALIASES).drop(ORD)


@query(f"WITH {PARTIES} SELECT id, bal, 'customer' AS _source FROM c UNION ALL SELECT id, bal, 'supplier' FROM s")
def union_add_source(spark, d):
    return combine.union(parties(spark, d), ["id", "bal"], ALIASES, add_source=True).drop(ORD)


def _dedupe(keep_rows):
    def run(spark, d):
        x = t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
        x = x.withColumn(ORD, F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity"))
        return combine.dedupe(x, ["l_orderkey"], keep_rows).drop(ORD)

    return run


_FIRST = "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY {}) = 1"
query(_FIRST.format("l_linenumber, l_partkey, l_suppkey, l_quantity"), "union_dedupe_first")(_dedupe("first"))
query(_FIRST.format("l_linenumber DESC, l_partkey DESC, l_suppkey DESC, l_quantity DESC"), "union_dedupe_last")(_dedupe("last"))
query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity FROM lineitem QUALIFY count(*) OVER (PARTITION BY l_orderkey) = 1", "union_dedupe_none")(_dedupe(False))


def _enriched_union(at):
    def run(spark, d):
        raw = parties(spark, d) | {"nations": t(spark, d, "nation")}
        target = {"name": "x", "mode": "union", "inputs": ["customer", "supplier"], "columns": ["id", "nation"], "dedupe_on": ["nation"], "enrich_at": at, "enrich": [{"from": "nations", "left_on": "nation", "right_on": "n_nationkey", "add": {"nation_name": "n_name"}}]}
        return compile_target(target, raw, {}, ALIASES).select("nation", "nation_name")

    return run


_NATIONS = f"WITH {PARTIES}, u AS (SELECT nation FROM c UNION SELECT nation FROM s) SELECT nation, n_name AS nation_name FROM u LEFT JOIN nation ON n_nationkey = nation"
query(_NATIONS, "union_enrich_pre_dedupe")(_enriched_union("pre_dedupe"))
query(_NATIONS, "union_enrich_post_dedupe")(_enriched_union("post_dedupe"))

# --- merge -----------------------------------------------------------------------


def halves(spark, d):
    c = t(spark, d, "customer")
    a = c.filter("c_custkey % 3 <> 0").selectExpr("c_custkey id", "CASE WHEN c_custkey % 4 <> 0 THEN c_name END name", "c_acctbal bal")
    b = c.filter("c_custkey % 3 <> 1").selectExpr("c_custkey id", "concat('b', c_name) name", "CASE WHEN c_custkey % 5 <> 0 THEN c_acctbal + 1 END bal")
    e = c.filter("c_custkey % 2 = 0").selectExpr("c_custkey id", "concat('e', c_name) name", "c_acctbal + 2 bal")
    return {"a": a, "b": b, "e": e}


HALVES = """a AS (SELECT c_custkey id, CASE WHEN c_custkey % 4 <> 0 THEN c_name END AS name, c_acctbal bal FROM customer WHERE c_custkey % 3 <> 0),
 b AS (SELECT c_custkey id, 'b' || c_name AS name, CASE WHEN c_custkey % 5 <> 0 THEN c_acctbal + 1 END bal FROM customer WHERE c_custkey % 3 <> 1),
 e AS (SELECT c_custkey id, 'e' || c_name AS name, c_acctbal + 2 bal FROM customer WHERE c_custkey % 2 = 0)"""
THREE = f"WITH {HALVES}, ab AS (SELECT coalesce(a.id, b.id) id, a.name, a.bal, b.name name__1, b.bal bal__1 FROM a FULL JOIN b ON a.id IS NOT DISTINCT FROM b.id), abe AS (SELECT coalesce(ab.id, e.id) id, ab.name, ab.bal, name__1, bal__1, e.name name__2, e.bal bal__2 FROM ab FULL JOIN e ON ab.id IS NOT DISTINCT FROM e.id) "


@query(f"WITH {HALVES} SELECT coalesce(a.id, b.id) id, a.name, a.bal, b.name name__1, b.bal bal__1 FROM a FULL JOIN b ON a.id IS NOT DISTINCT FROM b.id")
def merge_two(spark, d):
    h = halves(spark, d)
    return combine.merge({k: h[k] for k in "ab"}, ["id"])


@query(THREE + "SELECT * FROM abe")
def merge_three_collisions(spark, d):
    return combine.merge(halves(spark, d), ["id"])


@query(THREE + "SELECT id, coalesce(name, name__1, name__2) AS name, coalesce(bal, bal__1, bal__2) bal FROM abe")
def merge_first_non_null(spark, d):
    return combine.merge(halves(spark, d), ["id"], {"name": "first_non_null", "bal": "first_non_null"})


@query(THREE + "SELECT id, coalesce(name, name__2) AS name, coalesce(bal, bal__1) bal FROM abe")
def merge_priority(spark, d):
    rules = {"name": {"strategy": "first_non_null", "priority": ["e"]}, "bal": {"strategy": "first_non_null", "priority": ["b", "a"]}}
    return combine.merge(halves(spark, d), ["id"], rules)


@query(THREE + "SELECT id, name, coalesce(bal, bal__2) bal FROM abe")
def merge_first_non_null_base(spark, d):
    """Without a priority the base column stays as it is."""
    rules = {"name": {"strategy": "first_non_null"}, "bal": {"strategy": "first_non_null", "priority": ["e"]}}
    return combine.merge(halves(spark, d), ["id"], rules)


@query(THREE + "SELECT id, name, bal FROM abe")
def merge_prefer_source(spark, d):
    return combine.merge(halves(spark, d), ["id"], {"name": {"strategy": "prefer_source", "prefer_source": "b"}, "bal": {"strategy": "prefer_source", "prefer_source": "a"}} | {"name": {"strategy": "prefer_source", "prefer_source": "zz"}, "bal": {"strategy": "prefer_source", "prefer_source": "zz"}})


@query(THREE + "SELECT id, name__1 AS name, bal__2 AS bal FROM abe")
def merge_strict_source(spark, d):
    return combine.merge(halves(spark, d), ["id"], {"name": {"strategy": "prefer_source", "prefer_source": "b"}, "bal": {"strategy": "prefer_source", "prefer_source": "e"}}, strict_source=True)


# --- diff ------------------------------------------------------------------------


def snapshots(spark, d):
    o = t(spark, d, "orders").selectExpr("o_orderkey k", "o_custkey cust", "o_orderstatus st", "o_totalprice price")
    a = o.filter("k % 7 <> 0").withColumn("only_a", F.lit(1).cast("long"))
    b = o.filter("k % 5 <> 0").withColumn("price", F.when(F.col("k") % 3 == 0, F.col("price") + 1).otherwise(F.col("price"))).drop("st")
    return a, b


SNAPS = "a AS (SELECT o_orderkey k, o_custkey cust, o_orderstatus st, o_totalprice price, 1::BIGINT only_a FROM orders WHERE o_orderkey % 7 <> 0), b AS (SELECT o_orderkey k, o_custkey cust, CASE WHEN o_orderkey % 3 = 0 THEN o_totalprice + 1 ELSE o_totalprice END price FROM orders WHERE o_orderkey % 5 <> 0)"


def _diff(**options):
    return lambda spark, d: combine.diff(*snapshots(spark, d), ["k"], **options)


query(f"WITH {SNAPS} SELECT k, cust, price FROM a WHERE k NOT IN (SELECT k FROM b)", "diff_left_only")(_diff(side="left_only"))
query(f"WITH {SNAPS} SELECT k, cust, price FROM b WHERE k NOT IN (SELECT k FROM a)", "diff_right_only")(_diff(side="right_only"))
query(f"WITH {SNAPS} SELECT k, cust, st, price, only_a FROM a WHERE k NOT IN (SELECT k FROM b)", "diff_project_all")(_diff(side="left_only", project_all=True))
query(f"WITH {SNAPS} SELECT k FROM a JOIN b USING (k)", "diff_keys")(_diff(side="both", project="keys"))
query(f"WITH {SNAPS} SELECT k, cust, price FROM a WHERE k NOT IN (SELECT k FROM b)", "diff_default_side")(_diff())
COLLIDED = "a.cust cust_left, a.price price_left, b.cust cust_right, b.price price_right"
query(f"WITH {SNAPS} SELECT k, {COLLIDED}, 'both' AS _merge FROM a JOIN b USING (k)", "diff_both")(_diff(side="both"))
query(f"WITH {SNAPS} SELECT k, {COLLIDED}, a.st, a.only_a, 'both' AS _merge FROM a JOIN b USING (k)", "diff_both_all")(_diff(side="both", project_all=True))
query(
    f"WITH {SNAPS} SELECT coalesce(a.k, b.k) AS k, {COLLIDED}, CASE WHEN b.k IS NULL THEN 'left' ELSE 'right' END AS _source, CASE WHEN b.k IS NULL THEN 'left_only' ELSE 'right_only' END AS _merge FROM a FULL JOIN b ON a.k = b.k WHERE a.k IS NULL OR b.k IS NULL",
    "diff_symmetric",
)(_diff(side="symmetric_diff"))
query(f"WITH {SNAPS} SELECT k, a.price price_left, b.price price_right, 'both' AS _merge FROM a JOIN b USING (k)", "diff_columns")(_diff(side="both", columns_left=["price"], columns_right=["price"]))

# --- filters -----------------------------------------------------------------------

HOLES = "SELECT o_orderkey k, CASE WHEN o_orderkey % 11 <> 0 THEN o_totalprice END price, CASE WHEN o_orderkey % 13 <> 0 THEN o_orderstatus END st, o_orderdate od FROM orders"


def holes(spark, d):
    return t(spark, d, "orders").selectExpr("o_orderkey k", "CASE WHEN o_orderkey % 11 <> 0 THEN o_totalprice END price", "CASE WHEN o_orderkey % 13 <> 0 THEN o_orderstatus END st", "o_orderdate od")


FILTERS = {
    "eq": ({"st": {"op": "==", "value": "O"}}, "st = 'O'"),
    "neq_declared": ({"st": {"op": "!=", "value": "O"}}, "st <> 'O'"),
    "neq_number": ({"price": {"op": "!=", "value": 5}}, "coalesce(price <> 5, true)"),
    "gt": ({"price": {"op": ">", "value": 100000}}, "price > 100000"),
    "gte": ({"price": {"op": ">=", "value": 100000.5}}, "price >= 100000.5::DOUBLE"),
    "lt": ({"price": {"op": "<", "value": 50000}}, "price < 50000"),
    "lte": ({"price": {"op": "<=", "value": 50000}}, "price <= 50000"),
    "in": ({"st": {"op": "in", "value": ["O", None]}}, "st = 'O' OR st IS NULL"),
    "not_in": ({"st": {"op": "not_in", "value": ["O", "F"]}}, "st NOT IN ('O', 'F') OR st IS NULL"),
    "is_null": ({"st": {"op": "is_null"}}, "st IS NULL"),
    "not_null": ({"price": {"op": "not_null"}}, "price IS NOT NULL"),
    "between": ({"price": {"op": "between", "start": 1000, "end": 90000}}, "price BETWEEN 1000 AND 90000"),
    "date": ({"od": {"op": ">=", "value": "1996-01-01"}}, "od >= TIMESTAMP '1996-01-01'"),
    "unlike_kinds": ({"st": {"op": "==", "value": 1}}, "false"),
    "and_or": ({"AND": [{"price": {"op": ">", "value": 1000}}, {"OR": [{"st": {"op": "==", "value": "O"}}, {"st": {"op": "is_null"}}]}]}, "price > 1000 AND (st = 'O' OR st IS NULL)"),
}


def _filter(expr):
    return lambda spark, d: keep(holes(spark, d), expr, {"st": {"type": "string"}, "price": {"type": "number"}}).select("k", "price", "st")


for _name, (_expr, _sql) in FILTERS.items():
    query(f"WITH h AS ({HOLES}) SELECT k, price, st FROM h WHERE {_sql}", f"prefilter_{_name}")(_filter(_expr))

# --- expressions -------------------------------------------------------------------


def _computed(base: Callable, key: list[str], exprs: dict, declared: dict | None = None):
    def run(spark, d):
        df = base(spark, d)
        return df.select(*key, *[compute(df, e, declared).alias(n) for n, e in exprs.items()])

    return run


def items(spark, d):
    return t(spark, d, "lineitem").selectExpr("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity q", "l_extendedprice p", "l_discount disc", "l_shipdate sd")


KEYS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"]
ITEMS = "SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, {} FROM (SELECT *, l_quantity q, l_extendedprice p, l_discount disc, l_shipdate sd FROM lineitem)"
col = lambda c: {"col": c}

query(ITEMS.format("p * disc AS m, p + q + 1.5::DOUBLE AS a, p - q AS s, p * disc AS pc, (l_linenumber + 2)::BIGINT AS i"), "expr_math")(
    _computed(items, KEYS, {"m": ["mul", col("p"), col("disc")], "a": ["add", col("p"), col("q"), 1.5], "s": {"op": "sub", "args": [col("p"), col("q")]}, "pc": ["percent", col("p"), col("disc")], "i": ["add", col("l_linenumber"), 2]})
)
query(ITEMS.format("round_even(p * disc, 0)::DOUBLE r0, round_even(p * disc, 1)::DOUBLE r1, round_even(p * disc, 2)::DOUBLE r2"), "expr_round_even")(
    _computed(items, KEYS, {f"r{n}": ["round", ["mul", col("p"), col("disc")], n] for n in (0, 1, 2)})
)
query(ITEMS.format("CASE WHEN disc = 0 THEN 'infinity'::DOUBLE ELSE p / disc END AS dv, CASE WHEN disc = 0 THEN '-infinity'::DOUBLE ELSE -p / disc END AS dn"), "expr_div_zero")(
    _computed(items, KEYS, {"dv": ["div", col("p"), col("disc")], "dn": ["div", ["neg", col("p")], col("disc")]})
)
query(ITEMS.format("(l_linenumber * l_linenumber)::BIGINT AS sq, -q AS n, abs(q - 25) AS ab"), "expr_pow_neg_abs")(
    _computed(items, KEYS, {"sq": ["pow", col("l_linenumber"), 2], "n": ["neg", col("q")], "ab": ["abs", ["sub", col("q"), 25]]})
)
query(ITEMS.format("CASE WHEN q < 10 THEN 10.0::DOUBLE WHEN q > 40 THEN 40.0::DOUBLE ELSE q END AS c1, CASE WHEN q < disc * 100 THEN disc * 100 ELSE q END AS c2"), "expr_clip")(
    _computed(items, KEYS, {"c1": ["clip", col("q"), 10.0, 40.0], "c2": ["clip", col("q"), ["mul", col("disc"), 100], None]})
)
query(f"WITH h AS ({HOLES}) SELECT k, st = 'O' AS eq, st <> 'O' AS ne, coalesce(price > 1000, false) AS gt, coalesce(price > 1000, false) AND coalesce(st = 'O', NULL) AS an, NOT (k > 5) AS nt FROM h", "expr_compare_logic")(
    _computed(holes, ["k"], {"eq": ["eq", col("st"), "O"], "ne": ["neq", col("st"), "O"], "gt": ["gt", col("price"), 1000], "an": ["and", ["gt", col("price"), 1000], ["eq", col("st"), "O"]], "nt": ["not", ["gt", col("k"), 5]]}, {"st": {"type": "string"}, "k": {"type": "integer"}})
)
query(f"WITH h AS ({HOLES}) SELECT k, coalesce(price >= 1000, false) AS ge, coalesce(price < 1000, false) AS lt, coalesce(price <= 1000, false) AS le, k > 5 OR st = 'O' AS o FROM h", "expr_order_or")(
    _computed(holes, ["k"], {"ge": ["gte", col("price"), 1000], "lt": ["lt", col("price"), 1000], "le": ["lte", col("price"), 1000], "o": ["or", ["gt", col("k"), 5], ["eq", col("st"), "O"]]}, {"st": {"type": "string"}, "k": {"type": "integer"}})
)
query(f"WITH h AS ({HOLES}) SELECT k, st || '!' AS s, regexp_replace(st, '[OF]', '<0>', 'g') AS r FROM h", "expr_text_add_replace")(
    _computed(holes, ["k"], {"s": ["add", col("st"), "!"], "r": ["regex_replace", col("st"), "[OF]", "<0>"]})
)
query(f"WITH h AS ({HOLES}) SELECT k, CASE WHEN st = 'O' THEN price ELSE k END AS a, CASE WHEN price > 1000 THEN 'x' END AS b FROM h", "expr_if")(
    _computed(holes, ["k"], {"a": ["if", ["eq", col("st"), "O"], col("price"), col("k")], "b": ["if", ["gt", col("price"), 1000], "x"]})
)
query(f"WITH h AS ({HOLES}) SELECT k, coalesce(st IN ('O', 'P'), false) AS i, coalesce(st NOT IN ('O', 'P'), true) AS n, st IS NULL AS z FROM h", "expr_in_notin_null")(
    _computed(holes, ["k"], {"i": ["in", col("st"), ["O", "P"]], "n": ["not_in", col("st"), {"list": ["O", "P"]}], "z": ["in", col("st"), {"set": [None]}]})
)
query(f"WITH h AS ({HOLES}) SELECT k, coalesce(price, 0)::DOUBLE AS f, coalesce(st, 'none') AS c, st IS NULL AS n, price IS NOT NULL AS nn FROM h", "expr_nulls")(
    _computed(holes, ["k"], {"f": ["fillna", col("price"), 0.0], "c": ["coalesce", col("st"), "none"], "n": ["is_null", col("st")], "nn": ["not_null", col("price")]})
)
query(f"WITH h AS ({HOLES}) SELECT k, coalesce(st, '') || '-' || k AS c2, st AS c1, length(k::VARCHAR) AS n FROM h", "expr_concat_len")(
    _computed(holes, ["k"], {"c2": ["concat", col("st"), "-", col("k")], "c1": ["concat", col("st")], "n": ["len", col("k")]})
)
query("SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS a, strftime(o_orderdate, '%d/%m/%Y %H:%M') AS b FROM orders", "expr_strftime")(
    lambda spark, d: _computed(lambda s, x: t(s, x, "orders"), ["o_orderkey"], {"a": ["strftime", col("o_orderdate")], "b": ["strftime", "%d/%m/%Y %H:%M", col("o_orderdate")]})(spark, d)
)


def shipped(spark, d):
    return t(spark, d, "lineitem").join(t(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).select(*KEYS, "l_shipdate", "o_orderdate")


query(
    "SELECT event_id, floor((epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-15 12:00:00')) / 86400000000.0)::BIGINT AS dd, (epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-15 12:00:00')) / 3600000000.0::DOUBLE AS dh, (epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-15 12:00:00')) / 60000000.0::DOUBLE AS dm FROM events",
    "expr_datediff",
)(_computed(lambda s, x: t(s, x, "events"), ["event_id"], {f"d{u[0]}": ["datediff", u, col("ts"), "2024-01-15 12:00:00"] for u in ("day", "hour", "minute")}))
query("SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, floor((epoch_us(l_shipdate) - epoch_us(o_orderdate)) / 86400000000.0)::BIGINT AS days FROM lineitem JOIN orders ON l_orderkey = o_orderkey", "expr_datediff_columns")(
    _computed(shipped, KEYS, {"days": ["datediff", "day", col("l_shipdate"), col("o_orderdate")]})
)

# --- transforms --------------------------------------------------------------------


def _transformed(table: str, key: str, column: str, steps, expr: str | None = None):
    def run(spark, d):
        df = t(spark, d, table).select(key, F.expr(expr or column).alias("x"))
        c, _ = apply_steps(F.col("x"), kinds(df)["x"], steps)
        return df.select(key, c.alias("y"))

    return run


TRANSFORMS = {
    "tf_regex": ("part", "p_partkey", "p_name", [{"regex_replace": {"pattern": "([aeiou])", "repl": r"<\1>"}}], None, "regexp_replace(p_name, '([aeiou])', '<\\1>', 'g')"),
    "tf_regex_flag": ("part", "p_partkey", "p_name", {"regex_replace": {"pattern": "A", "repl": "$", "flags": "i"}}, None, "regexp_replace(p_name, 'A', '$', 'gi')"),
    "tf_cast_integer": ("orders", "o_orderkey", "k", [{"cast": {"to": "integer"}}], "concat(o_custkey, '.0')", "o_custkey"),
    "tf_cast_number": ("orders", "o_orderkey", "k", [{"cast": {"to": "number"}}], "cast(o_custkey AS string)", "o_custkey::DOUBLE"),
    "tf_cast_string": ("orders", "o_orderkey", "o_custkey", [{"cast": {"to": "string"}}], None, "o_custkey::VARCHAR"),
    "tf_cast_boolean": ("orders", "o_orderkey", "k", [{"cast": {"to": "boolean"}}], "o_custkey % 2", "o_custkey % 2 = 1"),
    "tf_cast_date": ("orders", "o_orderkey", "k", [{"cast": {"to": "date", "format": "%m/%d/%Y"}}], "date_format(o_orderdate, 'M/d/yyyy')", "date_trunc('day', o_orderdate)::TIMESTAMP"),
    "tf_cast_coerce_null": ("orders", "o_orderkey", "k", [{"cast": {"to": "number", "on_cast_error": "coerce_null"}}], "CASE WHEN o_custkey % 3 = 0 THEN 'bad' ELSE '2.5' END", "CASE WHEN o_custkey % 3 = 0 THEN NULL ELSE 2.5::DOUBLE END"),
    "tf_normalize_strip": ("part", "p_partkey", "k", [{"normalize": ["strip"]}], "concat(' \t', p_name, ' \n')", "p_name"),
    "tf_normalize_lower": ("part", "p_partkey", "k", [{"normalize": ["lower"]}], "upper(p_name)", "lower(p_name)"),
    "tf_normalize_upper": ("part", "p_partkey", "p_name", [{"normalize": ["upper"]}], None, "upper(p_name)"),
    "tf_normalize_collapse": ("part", "p_partkey", "k", [{"normalize": ["collapse_ws"]}], "replace(p_name, ' ', ' \t ')", "p_name"),
    "tf_title": ("part", "p_partkey", "k", [{"titlecase": {}}], "concat(p_name, \" o'neil a-b c1d\")", None),
    "tf_map": ("orders", "o_orderkey", "o_orderstatus", [{"map": {"map": {"O": "open", "F": "filled"}}}], None, "CASE o_orderstatus WHEN 'O' THEN 'open' WHEN 'F' THEN 'filled' ELSE o_orderstatus END"),
    "tf_affix": ("orders", "o_orderkey", "k", [{"affix": {"text": "#", "position": "prefix"}}, {"affix": {"text": "!"}}], "CASE WHEN o_orderkey % 2 = 0 THEN o_orderstatus END", "'#' || CASE WHEN o_orderkey % 2 = 0 THEN o_orderstatus ELSE '' END || '!'"),
    "tf_strftime": ("orders", "o_orderkey", "o_orderdate", [{"strftime": {"format": "%Y/%m"}}], None, "strftime(o_orderdate, '%Y/%m')"),
    "tf_chain": ("part", "p_partkey", "k", [[{"regex_replace": {"pattern": "Part: ", "repl": ""}}], {"normalize": ["strip", "upper"]}, {"affix": {"text": "+1-", "position": "prefix"}}], "concat('  Part: ', p_name, '  ')", "'+1-' || upper(p_name)"),
}
for _name, (_table, _key, _column, _steps, _expr, _sql) in TRANSFORMS.items():
    query(None if _sql is None else f"SELECT {_key}, {_sql} AS y FROM {_table}", _name)(_transformed(_table, _key, _column, _steps, _expr))

# --- sources ------------------------------------------------------------------------


@query("SELECT event_id, CASE WHEN event_id % 4 = 3 THEN NULL ELSE event_id END AS i, CASE WHEN event_id % 4 = 3 THEN NULL ELSE value END AS n, date_trunc('day', ts)::TIMESTAMP AS dt FROM events")
def types_enforce(spark, d):
    e = t(spark, d, "events").selectExpr("event_id", "CASE WHEN event_id % 4 = 3 THEN 'bad' ELSE concat(event_id, '.0') END i", "CASE WHEN event_id % 4 = 3 THEN '1d' ELSE cast(value AS string) END n", "date_format(ts, 'yyyy-MM-dd') dt")
    return enforce(e, {"i": {"type": "integer"}, "n": {"type": "number"}, "dt": {"type": "date", "date": {"format": "%Y-%m-%d"}}, "absent": {"type": "string"}})


@query("SELECT event_id, CASE event_id % 6 WHEN 0 THEN true WHEN 1 THEN false WHEN 2 THEN true WHEN 3 THEN false ELSE NULL END AS b FROM events")
def types_safe_bool(spark, d):
    return enforce(t(spark, d, "events").selectExpr("event_id", "element_at(array('Yes', 'off', ' ON ', '0', 'maybe', null), cast(event_id % 6 + 1 AS int)) b"), {"b": {"type": "boolean"}})


@query("SELECT * FROM (VALUES ('k: identifier with 0 nulls and 1 repeated values'), ('price: 3 null values')) v(problem) WHERE (SELECT count(*) FROM orders WHERE o_orderkey < 33) >= 0 AND false UNION ALL SELECT 'price: ' || count(*) || ' null values' FROM orders WHERE o_orderkey % 11 = 0 UNION ALL SELECT 'st: values outside enum such as [''P'']' FROM (SELECT 1 FROM orders WHERE o_orderstatus = 'P' AND o_orderkey % 13 <> 0 LIMIT 1)")
def validate_report(spark, d):
    found = problems(holes(spark, d), {"k": {"identifier": True}, "price": {"not_null": True}, "st": {"enum": ["O", "F"]}})
    return spark.createDataFrame([(x,) for x in found], "problem string")


@query("SELECT c_custkey AS id, upper(c_name) AS name, NULL::VARCHAR AS gone FROM customer")
def load_projection(spark, d):
    return project(t(spark, d, "customer"), {"c_custkey": {"alias": "id"}, "c_name": {"alias": "name", "transforms": [{"normalize": ["upper"]}]}, "nope": {"alias": "gone"}}).drop(ORD)


# --- enrich --------------------------------------------------------------------------


def _lookup(left: str, right: str, left_on: str, right_on: str, add: dict, select: list[str], prepare=None, **options):
    def run(spark, d):
        a, b = t(spark, d, left), t(spark, d, right)
        if prepare:
            a, b = prepare(a, b)
        return lookup(a, b, left_on, right_on, add, **options)[0].select(*select)

    return run


query("SELECT s_suppkey, n_name AS nm FROM supplier LEFT JOIN nation ON n_nationkey = s_nationkey AND n_nationkey < 20", "enrich_exact_left")(_lookup("supplier", "nation", "s_nationkey", "n_nationkey", {"nm": "n_name"}, ["s_suppkey", "nm"], lambda a, b: (a, b.filter("n_nationkey < 20"))))
query("SELECT s_suppkey, n_name AS nm FROM supplier JOIN nation ON n_nationkey = s_nationkey AND n_nationkey < 20", "enrich_inner")(_lookup("supplier", "nation", "s_nationkey", "n_nationkey", {"nm": "n_name"}, ["s_suppkey", "nm"], lambda a, b: (a, b.filter("n_nationkey < 20")), how="inner"))
query("SELECT r_regionkey, max(n_name) AS nm FROM region LEFT JOIN nation ON n_regionkey = r_regionkey GROUP BY 1", "enrich_right_keep_last")(
    _lookup("region", "nation", "r_regionkey", "n_regionkey", {"nm": "n_name"}, ["r_regionkey", "nm"], lambda a, b: (a, b.withColumn(ORD, F.col("n_name"))), match={"right_keep": "last"})
)
query("SELECT s_suppkey, n_name AS nm FROM supplier LEFT JOIN nation ON n_nationkey = s_nationkey", "enrich_typed_keys")(_lookup("supplier", "nation", "s_nationkey", "n_nationkey", {"nm": "n_name"}, ["s_suppkey", "nm"], match={"left_kind": "integer", "right_kind": "integer"}))
query("SELECT c_custkey, c_name, n_name AS c_name_r1 FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey", "enrich_conflict_suffix")(_lookup("customer", "nation", "c_nationkey", "n_nationkey", {"c_name": "n_name"}, ["c_custkey", "c_name", "c_name_r1"], on_conflict="suffix"))
_SOME = lambda a, b: (a.withColumn("nm", F.when(F.col("c_custkey") % 2 == 0, F.lit("given"))), b.filter("n_nationkey < 20"))
query("SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'given' ELSE n_name END AS nm FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey AND n_nationkey < 20", "enrich_conflict_fillna")(_lookup("customer", "nation", "c_nationkey", "n_nationkey", {"nm": "n_name"}, ["c_custkey", "nm"], _SOME, on_conflict="overwrite"))
query("SELECT c_custkey, n_name AS nm FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey AND n_nationkey < 20", "enrich_conflict_overwrite")(_lookup("customer", "nation", "c_nationkey", "n_nationkey", {"nm": "n_name"}, ["c_custkey", "nm"], _SOME, on_conflict="overwrite", match={"write_policy": "overwrite"}))

NAMES = "(SELECT p_name AS r, min(p_partkey) AS id FROM part GROUP BY 1)"


def _names(mess: str):
    return lambda a, b: (a.selectExpr("p_partkey", f"{mess} AS x"), b.groupBy(F.col("p_name").alias("r")).agg(F.min("p_partkey").alias("id")).withColumn(ORD, F.col("id")))


_STEPS = ["strip", "lower", "collapse_ws", "strip_punct"]
query(f"SELECT p_partkey, id AS found FROM part JOIN {NAMES} ON r = p_name", "enrich_normalized")(
    _lookup("part", "part", "x", "r", {"found": "id"}, ["p_partkey", "found"], _names("concat('  ', upper(replace(p_name, ' ', '  ')), '!')"), match={"strategy": ["exact", "normalized"], "normalize": _STEPS})
)

LCS = """WITH RECURSIVE names AS (SELECT DISTINCT p_name AS n, p_name AS r FROM part), keys AS (SELECT DISTINCT {mess} AS k FROM part),
ids AS (SELECT p_name AS r, min(p_partkey) AS id FROM part GROUP BY 1),
pairs AS (SELECT k, r, {a} AS a, {b} AS b FROM keys, names WHERE {block}),
dp AS (SELECT k, r, a, b, 0 AS i, list_transform(range(0, length(b) + 1), lambda x: 0::BIGINT) AS c FROM pairs
 UNION ALL SELECT k, r, a, b, i + 1, list_transform(range(0, length(b) + 1), lambda j: coalesce(list_max(list_transform(range(0, j + 1), lambda q: CASE WHEN q > 0 AND substr(a, i + 1, 1) = substr(b, q, 1) THEN c[q] + 1 ELSE c[q + 1] END)), 0::BIGINT)) FROM dp WHERE i < length(a)),
best AS (SELECT k, r, 200.0::DOUBLE * c[length(b) + 1] / (length(a) + length(b)) AS score FROM dp WHERE i = length(a)),
top AS (SELECT k, id FROM best JOIN ids USING (r) WHERE score >= {threshold} QUALIFY row_number() OVER (PARTITION BY k ORDER BY score DESC, id) = 1)
SELECT p_partkey, id AS found FROM part LEFT JOIN top ON k = {mess}"""


def _fuzzy(name: str, mess: str, sql_mess: str, scorer: str, block: str | None, threshold: int, a: str = "k", b: str = "n", where: str = "left(k, 1) = left(n, 1)", oracle: bool = True):
    sql = LCS.format(mess=sql_mess, a=a, b=b, block=where, threshold=threshold) if oracle else None
    match = {"strategy": ["exact", "normalized", "fuzzy"], "normalize": _STEPS, "fuzzy": {"scorer": scorer, "threshold": threshold, "block": block}}
    query(sql, name)(_lookup("part", "part", "x", "r", {"found": "id"}, ["p_partkey", "found"], _names(mess), match=match))


_MESS, _SQL_MESS = "concat(substring(p_name, 1, length(p_name) - 2), 'x')", "left(p_name, length(p_name) - 2) || 'x'"
_SORT = "array_to_string(list_sort(string_split({}, ' ')), ' ')"
_fuzzy("enrich_fuzzy_ratio", _MESS, _SQL_MESS, "ratio", "first_char", 80)
_fuzzy("enrich_block_first2", _MESS, _SQL_MESS, "ratio", "first2", 80, where="left(k, 2) = left(n, 2)")
_fuzzy("enrich_block_none", _MESS, _SQL_MESS, "ratio", None, 85, where="true")
_fuzzy("enrich_fuzzy_token_sort", _MESS, _SQL_MESS, "token_sort_ratio", "first_char", 80, _SORT.format("k"), _SORT.format("n"))
_fuzzy("enrich_fuzzy_token_set", _MESS, _SQL_MESS, "token_set_ratio", "first_char", 80, oracle=False)
_fuzzy("enrich_fuzzy_partial", _MESS, _SQL_MESS, "partial_ratio", "first_char", 80, oracle=False)


@query("SELECT s_suppkey, n_name AS matched_val, 100::BIGINT AS score, 'exact' AS method FROM supplier JOIN nation ON n_nationkey = s_nationkey".replace("n_name AS", "n_nationkey::VARCHAR AS"))
def enrich_audit(spark, d):
    s = t(spark, d, "supplier").withColumn(ORD, F.col("s_suppkey"))
    audit = lookup(s, t(spark, d, "nation"), "s_nationkey", "n_nationkey", {"nm": "n_name"}, match={"audit": True})[1]
    return audit.select(F.col("left_idx").alias("s_suppkey"), "matched_val", "score", "method")


# --- compare -------------------------------------------------------------------------


def perturbed(spark, d):
    o = t(spark, d, "orders").selectExpr("o_orderkey k", "o_orderstatus st", "o_totalprice price")
    a = o.filter("k % 17 <> 0")
    b = o.filter("k % 19 <> 0").selectExpr("k", "CASE WHEN k % 23 = 0 THEN 'Z' WHEN k % 29 = 0 THEN NULL ELSE st END st", "CASE WHEN k % 31 = 0 THEN price * 1.1D ELSE price END price")
    return a, b


PERTURBED = """a AS (SELECT o_orderkey k, o_orderstatus st, o_totalprice price FROM orders WHERE o_orderkey % 17 <> 0),
 b AS (SELECT o_orderkey k, CASE WHEN o_orderkey % 23 = 0 THEN 'Z' WHEN o_orderkey % 29 = 0 THEN NULL ELSE o_orderstatus END st, CASE WHEN o_orderkey % 31 = 0 THEN o_totalprice * 1.1::DOUBLE ELSE o_totalprice END price FROM orders WHERE o_orderkey % 19 <> 0),
 m AS (SELECT coalesce(a.k, b.k) k, a.k ka, b.k kb, a.st sa, b.st sb, a.price pa, b.price pb, a.k IS NOT NULL AND b.k IS NOT NULL AND coalesce(a.st <> b.st, false) AS ds, a.k IS NOT NULL AND b.k IS NOT NULL AND round_even(a.price * 1e6, 0) <> round_even(b.price * 1e6, 0) AS dp FROM a FULL JOIN b ON a.k = b.k),
 r AS (SELECT *, CASE WHEN ka IS NULL THEN 'added' WHEN kb IS NULL THEN 'removed' WHEN ds OR dp THEN 'changed' ELSE 'unchanged' END AS status FROM m)"""


@query(f"WITH {PERTURBED} SELECT k, status, concat_ws(',', CASE WHEN ds THEN 'st' END, CASE WHEN dp THEN 'price' END) AS changed, sa AS st_before, sb AS st_after, pa AS price_before, pb AS price_after, pb - pa AS price_delta FROM r")
def compare_master(spark, d):
    r = compare(*perturbed(spark, d), ["k"], ["st", "price"])
    return r.select("k", F.col(STATUS).alias("status"), F.array_join(CHANGED, ",").alias("changed"), F.col("st (Baseline)").alias("st_before"), F.col("st (Current)").alias("st_after"), F.col("price (Baseline)").alias("price_before"), F.col("price (Current)").alias("price_after"), F.col("price Δ").alias("price_delta"))


@query(f"WITH {PERTURBED} SELECT count(*) AS total, count(*) FILTER (status = 'added') AS added, count(*) FILTER (status = 'removed') AS removed, count(*) FILTER (status = 'changed') AS changed FROM r")
def compare_counts(spark, d):
    return counts(compare(*perturbed(spark, d), ["k"], ["st", "price"]))


@query(f"WITH {PERTURBED} SELECT k, sa AS before, sb AS after FROM r WHERE status = 'changed'")
def compare_bycol(spark, d):
    r = compare(*perturbed(spark, d), ["k"], ["st", "price"])
    return by_column(r, ["k"], ["st"])["Changed — st"].select("k", F.col("st (Baseline)").alias("before"), F.col("st (Current)").alias("after"))


@query("WITH a AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS n FROM orders), b AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS n FROM orders WHERE o_orderkey % 2 = 0) SELECT coalesce(a.o_custkey, b.o_custkey) cust, coalesce(a.n, b.n)::INT AS n, CASE WHEN b.n IS NULL THEN 'removed' ELSE CASE WHEN a.o_orderstatus <> b.o_orderstatus THEN 'changed' ELSE 'unchanged' END END AS status FROM a LEFT JOIN b ON a.o_custkey = b.o_custkey AND a.n = b.n")
def compare_duplicate_keys(spark, d):
    o = t(spark, d, "orders").selectExpr("o_custkey cust", "o_orderstatus st", f"o_orderkey {ORD}")
    return compare(o, o.filter(f"{ORD} % 2 = 0"), ["cust"], ["st"]).select("cust", F.col("__row__").alias("n"), F.col(STATUS).alias("status"))


# --- export, workbooks, documents ---------------------------------------------------------


@query("SELECT c_custkey AS \"ID\", 'fix' AS \"Kind\", upper(c_name) AS \"Name\", round_even(c_acctbal / 3, 1)::DOUBLE AS \"Third\", NULL::VARCHAR AS \"Gone\" FROM customer WHERE c_acctbal > 0")
def export_sheet(spark, d):
    spec = {"filter": {"c_acctbal": {"op": ">", "value": 0}}, "columns": {"ID": "c_custkey", "Kind": {"value": "fix"}, "Name": {"alias": "c_name", "transforms": [{"normalize": ["upper"]}]}, "Third": {"compute": ["round", ["div", col("c_acctbal"), 3], 1]}, "Gone": {"alias": "nope"}}}
    return sheet_frame(t(spark, d, "customer"), spec)


@query("SELECT doc_id, left(regexp_replace(regexp_replace('\r\n' || chr(7) || text, '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F]', ' ', 'g'), '\\r\\n?', chr(10), 'g'), 32767) AS y FROM documents".replace("'\r\n'", "chr(13) || chr(10)"))
def export_sanitize(spark, d):
    return t(spark, d, "documents").select("doc_id", clean(F.concat(F.lit("\r\n\x07"), "text")).alias("y"))


@query("SELECT r_regionkey::BIGINT AS r_regionkey, r_name FROM region")
def xlsx_roundtrip(spark, d):
    with tempfile.TemporaryDirectory() as where:
        path = write_workbook(Path(where) / "region.xlsx", [sheet_of("region", t(spark, d, "region"))])
        return read_sheet(spark, path, "region")


@query("SELECT n_nationkey::BIGINT AS n_nationkey, n_name FROM nation")
def workbook_roundtrip(spark, d):
    with tempfile.TemporaryDirectory() as where:
        path = f"{where}/nation.xlsx"
        with WorkbookStore(path, spark=spark) as w:
            w.create_document("nation", t(spark, d, "nation").select("n_nationkey", "n_name"))
        return WorkbookStore(path, spark=spark).open().get_document("nation").df


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation WHERE n_regionkey = 1 AND n_nationkey > -1 AND n_name = (SELECT min(n_name) FROM nation WHERE n_regionkey = 1)")
def doc_match_exact(spark, d):
    n = t(spark, d, "nation")
    first = n.filter("n_regionkey = 1").agg(F.min("n_name")).first()[0]
    return Document(spark, "n", n).match({"n_name": first, "n_regionkey": 1}, threshold=1, include_score=False)


@query("SELECT n_nationkey, n_name, n_regionkey, 0.5::DOUBLE + CASE WHEN n_nationkey = 3 THEN 0.5 ELSE 0 END::DOUBLE AS __score__ FROM nation WHERE n_regionkey = 1 AND n_nationkey <> 3 OR n_nationkey = 3 AND n_regionkey = 1".replace("__score__", '"__score__"'))
def doc_match_fractional(spark, d):
    return Document(spark, "n", t(spark, d, "nation")).match({"n_nationkey": 3, "n_regionkey": 1}, threshold=0.5).filter("n_regionkey = 1")


@query("SELECT n_nationkey, CASE WHEN n_nationkey = 2 THEN 'two' ELSE n_name END AS n_name FROM nation WHERE n_nationkey <> 5 UNION ALL SELECT 99, 'more'")
def doc_edit(spark, d):
    n = Document(spark, "n", t(spark, d, "nation").select("n_nationkey", "n_name").coalesce(1).sortWithinPartitions("n_nationkey"))
    n.update_row(2, {"n_name": "two"})
    n.delete_row(5)
    n.append_rows([{"n_nationkey": 99, "n_name": "more"}])
    return n.df


@query("SELECT n_nationkey, n_name, 0.5::DOUBLE AS __score__ FROM nation WHERE n_nationkey = 3".replace("__score__", '"__score__"'))
def doc_match_other_kind(spark, d):
    """A value of another kind than its column agrees with nothing, and doesn't fail."""
    return Document(spark, "n", t(spark, d, "nation").select("n_nationkey", "n_name")).match({"n_nationkey": 3, "n_name": 3}, threshold=0.5)


@query("SELECT o_orderkey, o_totalprice, n FROM orders JOIN (SELECT o_custkey, count(*) n FROM orders GROUP BY o_custkey) USING (o_custkey)")
def enrich_plugin(spark, d):
    """A user's step, registered by name and called by ``fn``."""
    register("enrich", "orders_of", lambda df, params, frames: df.join(frames["orders"].groupBy(params["by"]).agg(F.count(F.lit(1)).alias("n")), params["by"]))
    o = t(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    return enrich(o, [{"fn": "orders_of", "params": {"by": "o_custkey"}}], {"orders": o}).select("o_orderkey", "o_totalprice", "n")


@query("SELECT 'listed' AS sheet, count(*) AS n FROM region")
def export_no_columns(spark, d):
    """Of two sheets only the one that lists columns is exported."""
    sheets = [{"name": "bare", "from": "region"}, {"name": "listed", "from": "region", "columns": {"Key": "r_regionkey"}}]
    made = Exporter().frames({"sheets": sheets}, {"region": t(spark, d, "region")})
    return reduce(lambda a, b: a.unionByName(b), [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("sheet"), "n") for name, df in made.items()])


@query("SELECT o_orderkey k, CASE WHEN round_even(o_totalprice, 0) <> round_even(o_totalprice + 0.4, 0) THEN 'changed' ELSE 'unchanged' END AS status FROM orders")
def compare_precision(spark, d):
    o = t(spark, d, "orders").selectExpr("o_orderkey k", "o_totalprice p")
    return compare(o, o.withColumn("p", F.col("p") + 0.4), ["k"], precision=0, show_delta=False).select("k", F.col(STATUS).alias("status"))


#: The flagship: two sources, filtered, united, deduplicated, looked up and exported as one sheet.
FLAGSHIP = {
    "name": "roster",
    "mode": "union",
    "inputs": ["customer", "supplier"],
    "columns": ["id", "name", "nation", "bal"],
    "pre_filter": {"customer": {"bal": {"op": ">", "value": 0}}},
    "dedupe_on": ["name"],
    "add_source": True,
    "enrich": [{"from": "nations", "left_on": "nation", "right_on": "n_nationkey", "add": {"nation_name": "n_name"}}],
    "post_filter": {"bal": {"op": "not_null"}},
}


@query(f"WITH {PARTIES} SELECT id AS \"ID\", name AS \"Name\", n_name AS \"Nation\", CASE WHEN bal > 5000 THEN 'high' ELSE 'low' END AS \"Band\" FROM (SELECT * FROM c WHERE bal > 0 UNION ALL SELECT * FROM s) LEFT JOIN nation ON n_nationkey = nation")
def flagship(spark, d):
    raw = parties(spark, d) | {"nations": t(spark, d, "nation")}
    out = compile_target(FLAGSHIP, raw, {}, ALIASES)
    return sheet_frame(out, {"columns": {"ID": "id", "Name": "name", "Nation": "nation_name", "Band": {"compute": ["if", ["gt", col("bal"), 5000], "high", "low"]}}})


