"""Mixing sources to target weights through a tree of domains, languages and sources.

DataFrame functions only. The budget is handed down the tree: at each node the
children share it by weight, and what one cannot fill goes to its siblings, so
that a shortage reaches an ancestor's other branches only where the whole branch
is short. All amounts are whole tokens (shares are rounded down), so that the
result doesn't depend on the order of sums. Each leaf then takes whole epochs,
and of its last epoch the longest prefix, in seeded order, that fits.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored
from .graph import small

WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def _weight(level: str, weights: Mapping[str, int], default: int) -> Column:
    if not weights:
        return F.lit(default).cast("long")
    known = F.create_map(*[F.lit(x) for pair in weights.items() for x in pair])
    return F.coalesce(F.try_element_at(known, F.col(level)), F.lit(default)).cast("long")


def share(children: DataFrame, parent: Sequence[str], name: str) -> DataFrame:
    """Adds ``target``: each child's share of ``budget`` by ``weight``, at most its ``cap``.

    In ascending order of cap / weight a child is full if its part of what is left
    reaches its cap; the first that isn't full ends the full ones, and those after
    it share the rest by weight.
    """
    siblings = Window.partitionBy(*parent) if parent else Window.partitionBy(F.lit(0))
    ordered = siblings.orderBy("fill", name)
    before = ordered.rowsBetween(Window.unboundedPreceding, -1)
    after = ordered.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    t = children.withColumn("fill", F.when(F.col("weight") > 0, F.col("cap").cast("double") / F.col("weight")).otherwise(F.lit(0.0)))
    t = t.withColumn("left", F.greatest(F.lit(0), F.col("budget") - F.coalesce(F.sum("cap").over(before), F.lit(0))))
    t = t.withColumn("full", F.col("cap") * F.sum("weight").over(after) <= F.col("left") * F.col("weight"))
    t = t.withColumn("rest", F.col("budget") - F.coalesce(F.sum(F.when(F.col("full"), F.col("cap"))).over(siblings), F.lit(0)))
    t = t.withColumn("open", F.coalesce(F.sum(F.when(~F.col("full"), F.col("weight"))).over(siblings), F.lit(0)))
    return t.withColumn("target", F.when(F.col("full"), F.col("cap")).otherwise(F.expr("weight * rest div open"))).drop("fill", "left", "full", "rest", "open")


def allocate(leaves: DataFrame, levels: Sequence[str], weights: Mapping[str, Mapping[str, int]], budget_percent: int, max_epochs: int, default_weight: int = 1) -> DataFrame:
    """Adds ``target`` tokens to ``leaves`` (the level columns, ``supply`` and more).

    A branch of weight 0 gets nothing, and its supply fills no shortage.
    """
    weigh = {level: _weight(level, weights.get(level, {}), default_weight) for level in levels}
    alive = F.greatest(*[w * 0 + F.when(w > 0, 0).otherwise(1) for w in weigh.values()]) == 0 if len(levels) > 1 else weigh[levels[0]] > 0
    nodes = leaves.withColumn("cap", F.when(alive, F.col("supply") * max_epochs).otherwise(F.lit(0)).cast("long"))
    top = Window.partitionBy(F.lit(0))
    above: DataFrame | None = None
    for depth, level in enumerate(levels):
        path, parent = levels[: depth + 1], levels[:depth]
        t = nodes.groupBy(*path).agg(F.sum("cap").alias("cap"), F.sum("supply").alias("all_supply")).withColumn("weight", weigh[level])
        if above is None:
            t = t.withColumn("everything", F.sum("all_supply").over(top))
            t = t.withColumn("budget", F.least(F.expr(f"everything * {int(budget_percent)} div 100"), F.sum("cap").over(top)))
        else:
            t = t.join(above, list(parent))
        above = share(t, parent, level).select(*path, F.col("target").alias("budget"))
    assert above is not None
    return leaves.join(above.withColumnRenamed("budget", "target"), list(levels))


def mix(
    docs: DataFrame,
    domain: Column,
    weights: Mapping[str, Mapping[str, int]],
    budget_percent: int,
    max_epochs: int,
    seed: int = 0,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    source_col: str = "source",
    ranges: int | None = None,
) -> DataFrame:
    """One row per chosen copy: doc_id, domain, lang, source, tokens, epoch.

    ``weights`` gives whole-number weights by level name ("domain", "lang",
    "source"); an unlisted name weighs 1. ``budget_percent`` is the budget in
    hundredths of all tokens; a leaf gives at most ``max_epochs`` copies of itself.
    Documents without words (null or empty text too) hold no tokens and are never
    chosen; a null language, source or domain is the empty name. Repeated rows are
    rows of their own. An empty table gives no rows. The order of a leaf of n documents
    is cut into the root of n ranges (or so many as given), so that a source that holds a third of all rows
    is ranked by many tasks, and the ranges' sums are few.
    """
    levels = ["domain", "lang", "source"]
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.coalesce(domain.cast("string"), F.lit("")).alias("domain"),
        F.coalesce(F.col(lang_col).cast("string"), F.lit("")).alias("lang"),
        F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("source"),
        word_count(F.col(text_col)).alias("tokens"),
    ).filter("tokens > 0")
    rows = stored(rows, "mix")
    leaves = rows.groupBy(*levels).agg(F.sum("tokens").alias("supply"), F.count(F.lit(1)).alias("n"))
    chosen = allocate(leaves, levels, weights, budget_percent, max_epochs).select(
        *levels,
        F.expr("target div supply").alias("whole"),
        F.expr("target % supply").alias("rest"),
        F.expr("cast(floor(sqrt(n)) as long)" if ranges is None else f"{int(ranges)}L").alias("buckets"),
    )
    # a row a leaf: broadcast, so that the rows are dealt by leaf and bucket together and a large leaf is split
    chosen = small(stored(chosen, "chosen"))
    order = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("whole").cast("string"), F.col("doc_id").cast("string")))
    dealt = (
        rows.join(chosen, levels)
        .withColumn("order", order)
        .withColumn("bucket", F.expr("(cast(conv(substring(order, 1, 10), 16, 10) as bigint) * buckets) div 1099511627776"))
    )
    sums = dealt.groupBy(*levels, "bucket").agg(F.sum("tokens").alias("sum"))
    earlier = Window.partitionBy(*levels).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(*levels, "bucket", F.coalesce(F.sum("sum").over(earlier), F.lit(0)).alias("start"))
    within = Window.partitionBy(*levels, "bucket").orderBy("order", "doc_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = dealt.withColumn("upto", F.sum("tokens").over(within)).join(small(stored(starts, "starts")), [*levels, "bucket"])
    copies = F.col("whole") + F.when(F.col("start") + F.col("upto") <= F.col("rest"), 1).otherwise(0)
    return (
        placed.withColumn("copies", copies.cast("int"))
        .filter("copies > 0")
        .select("doc_id", *levels, "tokens", F.explode(F.expr("sequence(0, copies - 1)")).alias("epoch"))
    )


#: The registered mix: the first ten sources are "web", the next five "books", the others "other".
DOMAINS = {"web": [f"src{i}" for i in range(10)], "books": [f"src{i}" for i in range(10, 15)]}
WEIGHTS = {"domain": {"web": 50, "books": 35, "other": 15}, "lang": {"en": 60, "de": 15, "fr": 15, "es": 10}}
BUDGET_PERCENT, MAX_EPOCHS = 80, 2


def source_domain(source: Column) -> Column:
    out = F.when(source.isin(DOMAINS["web"]), "web").when(source.isin(DOMAINS["books"]), "books")
    return out.otherwise("other")


def registered_mix(docs: DataFrame) -> DataFrame:
    return mix(docs, source_domain(F.col("source")), WEIGHTS, BUDGET_PERCENT, MAX_EPOCHS)


def mixed_documents(docs: DataFrame, budget_percent: int = BUDGET_PERCENT, id_col: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` that the registered mix takes, each once, with all their columns.

    Rows that share an id, or have none, are taken together if the mix takes one of
    them. Documents without words are not taken.
    """
    chosen = mix(docs, source_domain(F.col("source")), WEIGHTS, budget_percent, max_epochs=1, id_col=id_col)
    taken = stored(chosen.select(F.col("doc_id").alias("__id")).distinct(), "chosen")
    worded = docs.filter(F.col("text").rlike(WORD))
    return worded.join(small(taken), worded[id_col].eqNullSafe(F.col("__id")), "left_semi").select(*docs.columns)


def _level_sql(depth: int, table: str, above: str | None) -> str:
    levels = ["domain", "lang", "source"]
    path, parent = ", ".join(levels[: depth + 1]), ", ".join(f"n.{x}" for x in levels[:depth])
    part = f"PARTITION BY {parent} " if parent else ""
    weight = {
        0: "CASE domain WHEN 'web' THEN 50 WHEN 'books' THEN 35 WHEN 'other' THEN 15 ELSE 1 END",
        1: "CASE lang WHEN 'en' THEN 60 WHEN 'de' THEN 15 WHEN 'fr' THEN 15 WHEN 'es' THEN 10 ELSE 1 END",
        2: "1",
    }[depth]
    source = f"(SELECT {path}, sum(supply)::BIGINT * 2 AS cap, sum(supply)::BIGINT AS all_supply, {weight}::BIGINT AS weight FROM leaves GROUP BY {path}) n"
    budget = "least(sum(all_supply) OVER () * 80 // 100, sum(cap) OVER ())" if above is None else "above.budget"
    join = "" if above is None else f" JOIN {above} above USING ({', '.join(levels[:depth])})"
    return f"""
{table}_a AS (SELECT n.*, {budget} AS b FROM {source}{join}),
{table}_b AS (SELECT n.*, greatest(0, b - coalesce(sum(cap) OVER ({part}ORDER BY cap / weight, {levels[depth]} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS remains,
  sum(weight) OVER ({part}ORDER BY cap / weight, {levels[depth]} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS later FROM {table}_a n),
{table}_c AS (SELECT *, cap * later <= remains * weight AS is_full FROM {table}_b),
{table} AS (SELECT {path}, CASE WHEN is_full THEN cap ELSE weight * (b - coalesce(sum(cap) FILTER (is_full) OVER w, 0)) // sum(weight) FILTER (NOT is_full) OVER w END AS budget
  FROM {table}_c n WINDOW w AS ({part.strip()}))"""


ORACLE = rf"""
WITH docs AS (
  SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, len(regexp_extract_all(coalesce(text, ''), '{WORD}'))::BIGINT AS tokens,
    CASE WHEN regexp_matches(source, '^src[0-9]$') THEN 'web' WHEN regexp_matches(source, '^src1[0-4]$') THEN 'books' ELSE 'other' END AS domain
  FROM documents),
words AS (SELECT * FROM docs WHERE tokens > 0),
leaves AS (SELECT domain, lang, source, sum(tokens)::BIGINT AS supply FROM words GROUP BY ALL),
{_level_sql(0, "d1", None)},
{_level_sql(1, "d2", "d1")},
{_level_sql(2, "d3", "d2")},
dealt AS (SELECT w.*, budget // supply AS whole, budget % supply AS rest FROM words w JOIN leaves USING (domain, lang, source) JOIN d3 USING (domain, lang, source)),
placed AS (SELECT *, sum(tokens) OVER (PARTITION BY domain, lang, source ORDER BY md5('0:' || whole::BIGINT || ':' || doc_id), doc_id ROWS UNBOUNDED PRECEDING) AS upto FROM dealt),
copied AS (SELECT *, whole + CASE WHEN upto <= rest THEN 1 ELSE 0 END AS copies FROM placed)
SELECT doc_id, domain, lang, source, tokens, unnest(range(copies::BIGINT))::INT AS epoch FROM copied WHERE copies > 0
"""
