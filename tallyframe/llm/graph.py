"""Connected components and joins that leave the large side where it is."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, settled, stored

#: A side of at most so many bytes, as counted, is broadcast; beyond it both sides are shuffled.
SMALL_BYTES = 24 << 20


def counted_bytes(side: DataFrame) -> int:
    """Bytes of all rows of ``side`` as a join holds them: 8 for a row, a column and a number, 48 for a digest in an array, and the lengths of strings."""
    width = F.lit(16 + 8 * len(side.columns))
    for field in side.schema:
        kind = field.dataType
        if kind.typeName() in ("string", "binary"):
            width = width + F.coalesce(F.octet_length(field.name), F.lit(0))
        elif kind.typeName() == "array":
            each = 48 if kind.elementType.typeName() == "binary" else 8 + 8 * len(getattr(kind.elementType, "fields", ()))
            width = width + each * F.greatest(F.size(field.name), F.lit(0)) + 16
    return side.agg(F.sum(width.cast("long"))).first()[0] or 0


def small(side: DataFrame, most: int = SMALL_BYTES) -> DataFrame:
    """``side``, which is a stored table of numbers, strings and arrays of numbers, marked for broadcast if its counted bytes are few enough."""
    return F.broadcast(side) if counted_bytes(side) <= most else side


def without(docs: DataFrame, gone: DataFrame, id_col: str) -> DataFrame:
    """The rows of ``docs`` whose id is not in ``gone`` (one column of that name); a null id stays."""
    return docs.join(small(stored(gone.distinct(), "gone")), id_col, "left_anti").select(*docs.columns)


def without_texts(docs: DataFrame, gone: DataFrame, id_col: str, digest: Column) -> DataFrame:
    """The rows of ``docs`` whose id and text digest are not in ``gone`` (__id, __of; an id may be null)."""
    keyed = docs.withColumn("__digest", digest)
    same = keyed[id_col].eqNullSafe(F.col("__id")) & (F.col("__digest") == F.col("__of"))
    return keyed.join(small(stored(gone.distinct(), "gone")), same, "left_anti").select(*docs.columns)


def components(edges: DataFrame, most_rounds: int = 100) -> DataFrame:
    """node, component (the smallest node reachable) of every node of ``edges`` (a, b).

    Alternating large-star and small-star steps: each keeps a node's edges to its
    smallest neighbour only, so the edges never grow in number, and a node with very
    many neighbours is met by an aggregate and a join that Spark can split.
    """
    now = stored(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    mark = None
    for _ in range(most_rounds):
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.least("m", "a").alias("b"))
        large = large.filter("a <> b").distinct()
        # small star: a is the larger end
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        joined = large.join(least, "a")
        before = now
        now = stored(joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b"))).filter("a <> b").distinct(), "edges")
        discard(before)
        new = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if new == mark:
            break
        mark = new
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


def nearer(labels: DataFrame | None, links: DataFrame, hops: int = 2) -> DataFrame:
    """node, c of every node of ``links`` (a, b): c is a node it is connected with, the smallest seen in so many hops from ``labels``.

    Equal labels mean one component, but one component may still have several
    labels. The members of a star all get one in two hops.
    """
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    for hop in range(hops):
        if hop == 0 and labels is None:
            seen = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m"))
        else:
            seen = both.join(labels.withColumnRenamed("node", "b"), "b", "left").groupBy(F.col("a").alias("node")).agg(F.min(F.coalesce("c", "b")).alias("m"))
        if labels is None:
            labels = seen.select("node", F.least("node", "m").alias("c"))
        else:
            labels = labels.join(seen, "node", "full").select("node", F.least(F.coalesce("c", "node"), F.coalesce("m", "node")).alias("c"))
    return labels


def star_links(members: DataFrame, verify: Callable[[DataFrame], DataFrame], rounds: int, more_than: int = 1, linked_first: bool = False, alike: str = "true", seed: int = 5) -> tuple[DataFrame | None, DataFrame | None]:
    """(links found, labels node, c): in groups of more than ``more_than`` nodes each round holds every node against one leader.

    ``members`` is a stored table of (g, node) and perhaps a ``rank``. Nodes with the
    leader's label are not held against it again. The leader is the node of the
    lowest ``rank``, at first of all and then of those without a link - or with one,
    so that the nodes left over are held against one linked node after another.
    ``alike`` is a condition on further columns x of ``members`` and on the leader's,
    other_x, that a pair must meet to be verified.
    """
    links = labels = None
    traits = [x for x in members.columns if x not in ("g", "node", "rank")]
    members = members if "rank" in members.columns else members.withColumn("rank", F.lit(0).cast("long"))
    for r in range(rounds):
        known = members.withColumn("c", F.col("node")) if labels is None else members.join(small(labels), "node", "left").withColumn("c", F.coalesce("c", "node"))
        linked = F.col("c") != F.col("node")
        turn = F.lit(False) if r == 0 else ~linked if linked_first else linked
        # the first leader is the same in all groups that two nodes share
        order = F.struct(turn.alias("turn"), "rank", F.xxhash64(F.lit(seed + r), "node").alias("h"))
        leaders = known.groupBy("g").agg(F.min_by(F.struct("node", "c", *traits), order).alias("lead"), F.min("c").alias("c0"), F.max("c").alias("c1"), F.count(F.lit(1)).alias("m"))
        leaders = leaders.filter(f"c0 <> c1 and m > {more_than}").select("g", F.col("lead.node").alias("leader"), F.col("lead.c").alias("leader_c"), *[F.col(f"lead.{x}").alias(f"other_{x}") for x in traits])
        leaders = stored(leaders, "leaders")
        pairs = known.join(small(leaders), "g").filter(f"c <> leader_c AND {alike}").select(F.least("node", "leader").alias("a"), F.greatest("node", "leader").alias("b")).distinct()
        found = settled(lambda: verify(pairs), "links")  # noqa: B023
        discard(leaders)
        if found.isEmpty():
            break
        links = found if links is None else links.unionByName(found)
        before = labels
        labels = stored(nearer(before, links), "labels")
        if before is not None:
            discard(before)
    return links, labels


def labelled(members: DataFrame, labels: DataFrame | None) -> DataFrame:
    """``members`` with c, the label of each node: itself where there is none."""
    if labels is None:
        return members.withColumn("c", F.col("node"))
    return members.join(small(labels), "node", "left").withColumn("c", F.coalesce("c", "node"))


def spread_pairs(rows: DataFrame, alike: str = "true") -> DataFrame:
    """(a, b), a < b, once for each group both are in, of nodes with different labels; ``rows`` has g, node, c.

    ``alike`` is a condition on further columns x of ``rows`` and on other_x.
    """
    spread = rows.groupBy("g").agg(F.min("c").alias("c0"), F.max("c").alias("c1")).filter("c0 <> c1").select("g")
    # stored, so that the join deals both sides itself and can split a large group
    rest = stored(rows.join(spread, "g", "left_semi"), "spread")
    other = rest.withColumnsRenamed({"node": "b", "c": "cb"} | {x: f"other_{x}" for x in rest.columns if x not in ("g", "node", "c")})
    return rest.join(other, "g").filter(f"node < b and c <> cb and {alike}").select(F.col("node").alias("a"), "b")
