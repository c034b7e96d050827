"""Lookup joins: exact, normalised and fuzzy.

Only the distinct keys of the left side are matched, level by level, and the result
is joined back, so that no score is computed twice and neither side is collected.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..errors import TransformError
from ..functions.dtypes import DATE, INTEGER, NUMBER, kinds, named, text
from ..functions.predicates import comparable
from ..functions.similarity import COMPARED, SCORERS, bag, characters, known, may_reach, normalise, prepared, ratio_of, words_of
from .ordering import ORD, with_order

DEFAULT_STEPS = ["nfkc", "strip", "lower", "collapse_ws", "strip_punct", "strip_accents"]


@dataclass
class Match:
    """How keys are matched; a given ``fuzzy`` or ``normalize`` replaces the default as a whole."""

    strategy: list[str] = field(default_factory=lambda: ["exact"])
    normalize: list[str] = field(default_factory=lambda: list(DEFAULT_STEPS))
    scorer: str = "token_set_ratio"
    threshold: float = 90
    block: str | None = "first_char"
    cardinality: str = "m:1"
    right_keep: str = "first"
    on_miss: str = "leave_null"
    write_policy: str = "fillna"
    left_kind: str | None = None
    right_kind: str | None = None
    audit: bool = False

    @classmethod
    def of(cls, spec: dict[str, Any] | None) -> Match:
        spec = dict(spec or {})
        fuzzy = spec.get("fuzzy") or {}
        known = {k: spec[k] for k in cls.__dataclass_fields__ if k in spec and k not in ("scorer", "threshold", "block")}
        if isinstance(known.get("strategy"), str):
            known["strategy"] = [known["strategy"]]
        block = {"block": fuzzy.get("block")} if fuzzy else {}
        if "fuzzy" in spec and "block" not in fuzzy:
            block = {"block": "first_char"}
        return cls(**known, **{k: fuzzy[k] for k in ("scorer", "threshold") if k in fuzzy}, **block)


def _block_size(block: str | None) -> int:
    return {"first_char": 1, "first2": 2}.get(block or "", 0)


def _signs(rows: DataFrame, key: str, text_col: str, name: str, threshold: float) -> DataFrame:
    """key, length, bits (their bitmap), first, sign: the characters of each compared text, numbered where they repeat.

    A text of n characters shares at least o = t n / (200 - t) of them, as a
    multiset, with any other it scores t with, so that in any one order of the signs
    one of its ``first`` = n - o + 1 is among the other's as well.
    """
    compared = rows.select(key, COMPARED[name](F.col(text_col)).alias("c"))
    length, bits = F.length("c"), bag(characters(F.col("c")))
    least = F.ceil(F.lit(float(threshold)) * length / (200.0 - threshold) - 1e-9)
    chars = compared.select(key, length.alias("length"), bits.alias("bits"), (length - least + 1).alias("first"), F.explode(F.split("c", "")).alias("ch"))
    counted = chars.groupBy(key, "length", "bits", "first", "ch").agg(F.count(F.lit(1)).alias("times"))
    return counted.select(key, "length", "bits", "first", F.explode(F.transform(F.sequence(F.lit(1).cast("long"), "times"), lambda i: F.concat("ch", i.cast("string")))).alias("sign"))


def _meeting(left: DataFrame, right: DataFrame, name: str, threshold: float) -> DataFrame:
    """k, r of all pairs that may reach the threshold: by shared signs, and no pair of keys that share none.

    Signs are ordered from rare to frequent among ``right``, so that the first
    ones of a key meet few others. For partial_ratio the shorter text's first signs
    must meet any of the longer's; for token_set_ratio a shared word will do too.
    """
    if threshold <= 0:  # everything matches
        return left.crossJoin(right)
    if threshold > 100:
        return left.join(right.limit(0), F.col("k") == F.col("r")).select("k", "r")
    signs = {key: _signs(rows, key, text_col, name, threshold) for key, text_col, rows in (("k", "n", left), ("r", "rn", right))}
    often = signs["r"].groupBy("sign").agg(F.count(F.lit(1)).alias("often"))
    sides = {}
    for key, side in signs.items():
        order = Window.partitionBy(key).orderBy(F.coalesce("often", F.lit(0)), "sign")
        ranked = side.join(often, "sign", "left").withColumn("at", F.row_number().over(order))
        sides[key] = ranked.withColumn("early", F.col("at") <= F.col("first")).select(key, "sign", "early", F.col("length").alias(f"{key}_length"), F.col("bits").alias(f"{key}_bits"))
    ks, rs = sides["k"].withColumnRenamed("early", "k_early"), sides["r"].withColumnRenamed("early", "r_early")
    if name == "partial_ratio":
        met = ks.filter("k_early").join(rs, "sign").filter("k_length <= r_length").select("k", "r")
        met = met.unionByName(ks.join(rs.filter("r_early"), "sign").filter("k_length > r_length").select("k", "r"))
    else:
        enough = may_reach(threshold, *map(F.col, ("k_length", "r_length", "k_bits", "r_bits")))
        met = ks.filter("k_early").join(rs.filter("r_early"), "sign").filter(enough).select("k", "r")
    if name == "token_set_ratio":
        words = lambda rows, key, n: rows.select(key, F.explode(words_of(F.col(n))).alias("word"))
        met = met.unionByName(words(left, "k", "n").join(words(right, "r", "rn"), "word").select("k", "r"))
    return met.distinct()


def match_keys(keys: DataFrame, right: DataFrame, m: Match) -> DataFrame:
    """k, match, score, method for each row of ``keys`` (k, distinct, not null).

    ``right`` has r (distinct) and its order. The first level that hits decides: equal,
    equal when normalised, or of the candidates in the key's block the one of the
    highest score (the first of those) that reaches the threshold. A key whose block
    has no candidates is held against all of them.
    """
    exact = keys.join(right.select(F.col("r").alias("k"), F.col("r").alias("match")), "k", "left")
    hit = exact.filter("match is not null").select("k", "match", F.lit(100).cast("long").alias("score"), F.lit("exact").alias("method"))
    left = exact.filter("match is null").select("k")
    if m.strategy == ["exact"]:
        return hit
    right = right.withColumn("n", normalise(text(F.col("r"), "string"), m.normalize))
    firsts = right.groupBy("n").agg(F.min_by("r", ORD).alias("match"))
    left = left.withColumn("n", normalise(F.col("k"), m.normalize))
    same = left.join(firsts, "n", "left")
    hit = hit.unionByName(same.filter("match is not null").select("k", "match", F.lit(100).cast("long").alias("score"), F.lit("normalized").alias("method")))
    if "fuzzy" not in m.strategy:
        return hit
    left = same.filter("match is null").select("k", "n")
    name, size = known(m.scorer), _block_size(m.block)
    bits = name in ("ratio", "token_sort_ratio")

    def ready(rows: DataFrame, n: str) -> DataFrame:
        # once a key, not once a pair
        if not bits:
            return rows
        rows = rows.withColumn(f"{n}_p", prepared(COMPARED[name](F.col(n))))
        return rows.withColumn(f"{n}_b", bag(F.col(f"{n}_p.chars")))

    candidates = right.select("r", F.col("n").alias("rn"), ORD)
    free, blocked = left, None
    if size:
        left, candidates = left.withColumn("block", F.substring("n", 1, size)), candidates.withColumn("block", F.substring("rn", 1, size))
        blocks = candidates.select("block").distinct()
        blocked = ready(left, "n").join(ready(candidates, "rn"), "block").drop("block")
        free, candidates = left.join(blocks, "block", "left_anti").drop("block"), candidates.drop("block")
    pairs = _meeting(free, candidates, name, m.threshold)
    pairs = ready(ready(pairs, "n"), "rn") if m.threshold <= 0 else pairs.join(ready(free, "n"), "k").join(ready(candidates, "rn"), "r")
    blocked = pairs if blocked is None else blocked.unionByName(pairs)
    if bits:
        x, y = F.col("n_p"), F.col("rn_p")
        blocked = blocked.filter(may_reach(m.threshold, x["n"], y["n"], F.col("n_b"), F.col("rn_b")))
        score = ratio_of(x, y)
    else:
        score = SCORERS[name](F.col("n"), F.col("rn"))
    scored = blocked.select("k", "r", ORD, score.alias("score")).filter(F.col("score") >= m.threshold)
    best = scored.groupBy("k").agg(F.min_by(F.struct("r", "score"), F.struct(-F.col("score"), ORD)).alias("b"))
    return hit.unionByName(best.select("k", F.col("b.r").alias("match"), F.col("b.score").cast("long").alias("score"), F.lit("fuzzy").alias("method")))


def lookup(
    left: DataFrame,
    right: DataFrame,
    left_on: str,
    right_on: str,
    add: dict[str, str],
    how: str = "left",
    match: dict[str, Any] | Match | None = None,
    on_conflict: str = "error",
) -> tuple[DataFrame, DataFrame | None]:
    """(``left`` with the columns of ``add`` (target: column of ``right``), audit rows if asked for).

    Null keys match nothing. Of several right rows of a key the first, or the last,
    counts. ``on_conflict``: a target that ``left`` has raises, is skipped, is written
    to, or goes under a new name; written to, only its nulls are filled unless the
    write policy is overwrite.
    """
    m = match if isinstance(match, Match) else Match.of(match)
    if left_on not in left.columns or right_on not in right.columns:
        raise ValueError(f"the keys {left_on} and {right_on} must be columns of the two sides")
    for source in add.values():
        if source not in right.columns:
            raise ValueError(f"the looked-up table has no column {source}")
    left = with_order(left)
    lk, rk = kinds(left)[left_on], kinds(right)[right_on]
    typed = m.strategy == ["exact"] and {m.left_kind, m.right_kind} & {INTEGER, NUMBER, DATE} and comparable(lk, rk)
    key = (lambda c, kind: c) if typed else text
    rows = with_order(right.filter(named(right_on).isNotNull())).withColumn("__r", key(named(right_on), rk))
    if m.cardinality == "1:1":
        twice = [r[0] for r in rows.groupBy("__r").count().filter("count > 1").select("__r").limit(3).collect()]
        if twice:
            raise ValueError(f"keys of the looked-up table are not unique, such as {twice}")
    order = F.col(ORD).desc() if m.right_keep == "last" else F.col(ORD).asc()
    rows = rows.withColumn("__n", F.row_number().over(Window.partitionBy("__r").orderBy(order))).filter("__n = 1").drop("__n")
    left = left.withColumn("__k", key(named(left_on), lk))
    keys = left.select(F.col("__k").alias("k")).filter("k is not null").distinct()
    found = match_keys(keys, rows.select(F.col("__r").alias("r"), ORD), m)
    found = found.filter(F.col("method").isin(["exact", *m.strategy]))  # a level that isn't listed is a miss
    values = rows.select(F.col("__r").alias("match"), *[named(s).alias(f"__add_{t}") for t, s in add.items()])
    table = found.join(values, "match").withColumnRenamed("k", "__k")
    out = left.join(table, "__k", "inner" if how == "inner" else "left")
    if m.on_miss == "fail" and how != "inner":
        blank = F.trim(F.col("__k").cast("string")) == ""
        missed = [r[0] for r in out.filter(F.col("method").isNull() & F.col("__k").isNotNull() & ~blank).select("__k").distinct().limit(5).collect()]
        if missed:
            raise ValueError(f"no match for {missed}")
    have = [c for c in left.columns if c != "__k"]
    written: dict[str, Any] = {}
    for target in add:
        value, name = F.col(f"`__add_{target}`"), target
        if target in have:
            if on_conflict == "error":
                raise ValueError(f"column {target} is there already")
            if on_conflict == "skip":
                continue
            if on_conflict == "suffix":
                n = 1
                while f"{target}_r{n}" in have:
                    n += 1
                name = f"{target}_r{n}"
            elif m.write_policy != "overwrite":
                value = F.coalesce(named(target), value)
        written[name] = value
        have.append(name)
    audit = None
    if m.audit:
        audit = out.select(F.col(ORD).alias("left_idx"), named(left_on).alias("left_key_raw"), F.col("match").alias("matched_val"), "score", F.coalesce("method", F.lit("miss")).alias("method"))
    return out.withColumns(written).select(*[named(c) for c in dict.fromkeys(have)]), audit


def enrich(df: DataFrame, steps: list[dict], frames: dict[str, DataFrame]) -> DataFrame:
    """Enrich steps in order: lookups in ``frames``, or plug-ins by ``fn``; an error names its step."""
    from ..functions.registry import plugins

    for i, step in enumerate(steps or []):
        try:
            if not {"from", "left_on", "right_on"} <= step.keys():
                if "fn" not in step:
                    raise ValueError(f"neither a lookup (from, left_on, right_on) nor a plug-in (fn): {step}")
                if step["fn"] not in plugins("enrich"):
                    raise ValueError(f"no plug-in {step['fn']}")
                df = plugins("enrich")[step["fn"]](df, step.get("params", {}), frames=frames)
                continue
            if step["from"] not in frames:
                raise ValueError(f"no table {step['from']}")
            right = frames[step["from"]]
            df, _ = lookup(df, right, step["left_on"], step["right_on"], step.get("add", {}), step.get("how", "left"), step.get("match"), step.get("on_conflict", "error"))
        except Exception as e:
            raise TransformError(f"enrich step {i}: {e}") from e
    return df
