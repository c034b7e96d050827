"""Fuzzy line deduplication by MinHash, in DataFrame functions only.

Signatures are minima of all five-character shingles of a line under XOR orders (the
minimum of ``h ^ c`` is the hash nearest to c, another uniform draw for each c). All
orders begin with the shingles of even hash, so that in a line long enough to have
some only those can be a minimum. Lines that share a band, and agree in 17 of 32
minima by their last four bits, are candidates. Each is held against the most alike of them first, by the exact
Jaccard similarity of the same sets; of pairs that this leaves unjoined those that differ in too many bits
of a bitmap of their shingles cannot be similar, and the others are held against each other in the same way.
Similar lines join components, and of each component one line stays.
"""

from __future__ import annotations

import functools
import random
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, settings, settled, stored
from .graph import components, labelled, nearer, small, spread_pairs, star_links

BREAK = r"\r?\n"
BLANKS = " \t\n\x0b\f\r"
SIZE = 5
#: Of a line of ``ALL`` characters or more the minima are taken over the shingles of even hash, and the ``FIRST`` ones.
ALL, FIRST = 64, 32
WORDS = 16
#: A minimum is kept as its last ``LANE`` bits, ``LANES`` to a long. Of 32 a candidate pair agrees in ``LEAST``, by their last four bits.
LANE, LANES, LEAST = 16, 4, 17
FOURTH_BITS = 0x1111111111111111
#: Groups of at most so many lines are paired at once; larger ones by leaders first.
FEW = 16
#: Shuffled files go with the query that wrote them; of many aggregates one hash map is faster than two.
CONF = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.codegen.aggregate.map.twolevel.enabled": "false"}


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def places(wide: Column) -> Column:
    """Where the shingles of a line in UTF-32 begin, from 0; a line of fewer than five characters is one shingle."""
    return F.sequence(F.lit(0), F.greatest(F.lit(0), (F.octet_length(wide) / 4).cast("int") - SIZE))


def shingle(wide: Column, place: Column) -> Column:
    """The 64-bit name of the shingle there."""
    return F.xxhash64(F.substring(wide, place * 4 + 1, F.lit(4 * SIZE)))


def shingle_set(line: Column) -> Column:
    """Names of all distinct five-character shingles; of the line itself where it is shorter."""
    return let(F.encode(line, "UTF-32"), lambda wide: F.array_distinct(F.transform(places(wide), lambda p: shingle(wide, p))))


def split_lines(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """row, doc_id, no, line, h1, h2 of every line; the last two are null for a blank line."""
    texts = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    # as BREAK would split, without a regular expression
    plain = F.when(F.contains("text", F.lit("\r\n")), F.replace("text", F.lit("\r\n"), F.lit("\n"))).otherwise(F.col("text"))
    lines = texts.select("row", "doc_id", F.posexplode(F.split(plain, "\n")).alias("no", "line"))
    filled = F.length(F.ltrim("line", F.lit(BLANKS))) > 0
    return lines.withColumns({"h1": F.when(filled, F.xxhash64("line")), "h2": F.when(filled, F.xxhash64(F.lit(1), "line"))})


def dealt_bands(pool: int, bands: int, rows: int, seed: int) -> list[list[int]]:
    """Which minima each band holds: ``rows`` different ones, each of the pool about as often."""
    draw, left, out = random.Random(seed), [], []
    for _ in range(bands):
        if len(left) < rows:
            left += draw.sample(range(pool), pool)
        band = list(dict.fromkeys(left))[:rows]
        for i in band:
            left.remove(i)
        out.append(sorted(band))
    return out


def lanes(pool: int) -> list[Column]:
    """The last ``LANE`` bits of each of the minima m0.., as longs p0.. of ``LANES`` lanes."""
    out = []
    for i in range(0, pool, LANES):
        total = F.lit(0).cast("long")
        for j in range(i, min(pool, i + LANES)):
            total = total.bitwiseOR(F.shiftleft(F.col(f"m{j}").bitwiseAND(F.lit((1 << LANE) - 1)).cast("long"), LANE * (j - i)))
        out.append(total.alias(f"p{i // LANES}"))
    return out


def lane(j: int, bits: int = LANE) -> Column:
    """The last ``bits`` bits of minimum j, out of p0..."""
    return F.shiftrightunsigned(f"p{j // LANES}", LANE * (j % LANES)).bitwiseAND(F.lit((1 << bits) - 1).cast("long"))


def sketch(pool: int, part: int) -> Column:
    """The last four bits of 16 minima from 16 * ``part`` on, out of p0.., as one long."""
    total = F.lit(0).cast("long")
    for j in range(16 * part, min(pool, 16 * part + 16)):
        total = total.bitwiseOR(F.shiftleft(lane(j, 4), 4 * (j % 16)))
    return total


def differ(x: str = "(q ^ other_q)", y: str = "(r ^ other_r)") -> str:
    """In how many lanes two sketches q, r differ, given their XORs."""
    return " + ".join(f"bit_count(({z} | shiftrightunsigned({z}, 1) | shiftrightunsigned({z}, 2) | shiftrightunsigned({z}, 3)) & {FOURTH_BITS}L)" for z in (x, y))


def agree(pool: int, d: str = differ()) -> str:
    """Whether two sketches that differ in ``d`` lanes agree in enough."""
    n = min(pool, 32)
    return f"{d} <= {n - n * LEAST // 32}"


def orders(pool: int, seed: int) -> list[int]:
    """The constants of the XOR orders: no two have the same leading bits, so that few orders have the same shingle for their minimum."""
    draw, lead = random.Random(seed), (pool - 1).bit_length()
    return [first << 28 - lead | draw.getrandbits(28 - lead) for first in draw.sample(range(1 << lead), pool)]


def signed(lines: DataFrame, pool: int, seed: int) -> DataFrame:
    """h1, h2, n (occurrences) and p0.. (``LANE`` bits of each minimum) of the distinct lines that are not blank."""
    wide = lines.filter("h1 is not null").select("h1", "h2", F.encode("line", "UTF-32").alias("wide"))
    at = wide.select("h1", "h2", "wide", F.explode(places(F.col("wide"))).alias("at"))
    long_enough = F.expr(f"octet_length(wide) div 4 >= {ALL}")
    # a filter is not moved below what isn't deterministic, where it would hash each shingle again
    once = F.when(F.monotonically_increasing_id() >= 0, shingle(F.col("wide"), F.col("at"))).otherwise(F.lit(0).cast("long"))
    hashed = at.select("h1", "h2", "at", long_enough.alias("long_enough"), once.alias("h"))
    odd = F.expr("h & 1").cast("int")
    hashed = hashed.filter((F.col("at") < FIRST) | ~F.col("long_enough") | (odd == 0))
    order = (F.shiftleft(odd, 28) + F.shiftrightunsigned("h", 36).cast("int")).alias("order")
    first = hashed.select("h1", "h2", F.when(F.col("at") == 0, 1).otherwise(0).alias("first"), order)
    minima = [F.min(F.col("order").bitwiseXOR(F.lit(c))).alias(f"m{i}") for i, c in enumerate(orders(pool, seed))]
    return first.groupBy("h1", "h2").agg(F.sum("first").alias("n"), *minima).select("h1", "h2", "n", *lanes(pool))


def band_name(i: int, band: list[int]) -> Column:
    """The name of the minima in ``band``, out of p0..: of each long its lanes are hashed at once."""
    masks: dict[int, int] = {}
    for j in band:
        masks[j // LANES] = masks.get(j // LANES, 0) | ((1 << LANE) - 1) << LANE * (j % LANES)
    signed_masks = {k: m - (1 << 64 if m >> 63 else 0) for k, m in masks.items()}
    return F.xxhash64(F.lit(i), *[F.col(f"p{k}").bitwiseAND(F.lit(m).cast("long")) for k, m in sorted(signed_masks.items())])


def keyed(distinct: DataFrame, pool: int, bands: int, rows: int, seed: int) -> DataFrame:
    """g, node, q, r of each band of the rows node, q, r, p0.."""
    names = [band_name(i, band) for i, band in enumerate(dealt_bands(pool, bands, rows, seed))]
    # a few bands at a time: the code of all is longer than what the JVM compiles
    parts = [distinct.select("node", "q", "r", F.explode(F.array(*names[i : i + 6])).alias("g")) for i in range(0, bands, 6)]
    return functools.reduce(DataFrame.unionAll, parts)


def bitmaps(lines: DataFrame) -> DataFrame:
    """node, q, r, n (shingles with repeats) and the bitmap w0..w15 of the shingles, of rows node, q, r, line."""
    at = lines.select("node", "q", "r", F.encode("line", "UTF-32").alias("wide")).select("node", "q", "r", "wide", F.explode(places(F.col("wide"))).alias("at"))
    h = at.select("node", "q", "r", shingle(F.col("wide"), F.col("at")).alias("h"))
    bit = F.expr("shiftleft(1L, cast(h & 63 as int))")
    h = h.select("node", "q", "r", bit.alias("bit"), F.expr(f"cast(shiftrightunsigned(h, 6) & {WORDS - 1} as int)").alias("word"))
    return h.groupBy("node", "q", "r").agg(F.count(F.lit(1)).alias("n"), *[F.bit_or(F.when(F.col("word") == i, F.col("bit")).otherwise(F.lit(0).cast("long"))).alias(f"w{i}") for i in range(WORDS)])


def may_link(num: int, den: int) -> str:
    """Necessary for Jaccard num/den between lines n, w0.. and other_n, other_w0..: each bit that differs is a shingle that differs."""
    bits = " + ".join(f"bit_count(w{i} ^ other_w{i})" for i in range(WORDS))
    return f"{num + den} * ({bits}) <= {den - num} * (n + other_n)"


def unjoined(pairs: DataFrame, labels: DataFrame | None) -> DataFrame:
    """The ``pairs`` (a, b, ..) whose ends do not have one label yet."""
    if labels is None:
        return pairs
    for end in ("a", "b"):
        pairs = pairs.join(small(labels.select(F.col("node").alias(end), F.col("c").alias(f"c{end}"))), end, "left")
    return pairs.filter("coalesce(ca, a) <> coalesce(cb, b)").drop("ca", "cb")


def similar_lines(docs: DataFrame, threshold: float = 0.8, id_col: str = "doc_id", text_col: str = "text", pool: int = 32, bands: int = 20, rows: int = 5, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """(row, doc_id, no, occ, h1, h2 of all lines; h1, h2, class of the lines that occur more than once or are like another)."""
    num, den = round(threshold * 1000), 1000
    every = stored(split_lines(docs, id_col, text_col).select("row", "doc_id", "no", F.monotonically_increasing_id().alias("occ"), "h1", "h2"), "lines")
    distinct = signed(split_lines(docs, id_col, text_col), pool, seed).withColumns({"q": sketch(pool, 0), "r": sketch(pool, 1)})
    distinct = stored(distinct.withColumn("node", F.monotonically_increasing_id()), "distinct")

    keys = keyed(distinct, pool, bands, rows, seed)
    groups = keys.groupBy("g").agg(F.count(F.lit(1)).alias("m"), F.min("node").alias("a"), F.max("node").alias("b"), F.bit_xor("q").alias("x"), F.bit_xor("r").alias("y"))
    groups = groups.select("g", "m", "a", "b", F.expr(differ("x", "y")).alias("d"))
    groups = stored(groups.filter(f"a <> b AND (m > 2 OR {agree(pool, 'd')})"), "bands")
    # a group of two is its two ends, and the XOR of their sketches gives the lanes that differ; larger ones get their members from the lines again, a few are paired at once
    twos = groups.filter("m = 2").select("a", "b", "d")
    larger = stored(groups.filter("m > 2").select("g", "m"), "larger")
    named = stored(keys.join(small(larger), "g").select("g", "m", "node", "q", "r"), "named")
    few = named.filter(f"m <= {FEW}").drop("m")
    few = few.withColumnRenamed("node", "a").join(few.select("g", F.col("node").alias("b"), F.col("q").alias("other_q"), F.col("r").alias("other_r")), "g").filter(f"a < b AND {agree(pool)}")
    pairs = stored(twos.unionByName(few.select("a", "b", F.expr(differ()).alias("d"))).distinct(), "pairs")
    members = stored(named.filter(f"m > {FEW}").select("g", "node"), "members")
    discard(named, groups, larger)

    nodes = pairs.select(F.explode(F.array("a", "b")).alias("node")).unionByName(members.select("node"))
    nodes = stored(nodes.distinct(), "nodes")
    wanted = stored(distinct.select("h1", "h2", "node", "q", "r").join(small(nodes), "node", "left_semi"), "wanted")
    texts = split_lines(docs, id_col, text_col).select("h1", "h2", "line").join(small(wanted), ["h1", "h2"])
    lines = stored(texts.select("node", "q", "r", "line").dropDuplicates(["node"]), "texts")
    discard(wanted, nodes)

    def bits_of(nodes: DataFrame) -> DataFrame:
        return stored(bitmaps(lines.join(small(stored(nodes.distinct(), "nodes")), "node", "left_semi")), "bitmaps")

    def exact(pairs: DataFrame) -> DataFrame:
        t = pairs.join(lines.select(F.col("node").alias("a"), F.col("line").alias("x")), "a").join(lines.select(F.col("node").alias("b"), F.col("line").alias("y")), "b")
        enough = lambda both: F.size(F.array_intersect(both["x"], both["y"])) * (num + den) >= num * (F.size(both["x"]) + F.size(both["y"]))
        return t.filter(let(F.struct(shingle_set(F.col("x")).alias("x"), shingle_set(F.col("y")).alias("y")), enough)).select("a", "b")

    # every line against the most alike of its candidates, so that most of the other pairs are joined by then
    links = labels = None
    for _ in range(2):
        nearest = lambda: unjoined(pairs, labels).groupBy("b").agg(F.min_by("a", F.struct("d", "a")).alias("a"))  # noqa: B023, E731
        found = settled(lambda: exact(stored(nearest(), "nearest")), "links")  # noqa: B023
        links = found if links is None else links.unionByName(found)
        before, labels = labels, stored(nearer(labels, found, hops=3), "labels")
        if before is not None:
            discard(before)

    def rest() -> DataFrame:
        open_pairs = stored(unjoined(pairs, labels), "open")
        bits = bits_of(open_pairs.select(F.explode(F.array("a", "b")).alias("node")))
        columns = [x for x in bits.columns if x not in ("node", "q", "r")]
        ends = open_pairs.join(small(bits.select(F.col("node").alias("a"), *columns)), "a")
        ends = ends.join(small(bits.select(F.col("node").alias("b"), *[F.col(x).alias(f"other_{x}") for x in columns])), "b")
        return exact(stored(ends.filter(may_link(num, den)).select("a", "b"), "held"))

    links = links.unionByName(settled(rest, "links"))
    limit = f"{agree(pool)} AND {may_link(num, den)}"
    bits = bits_of(members.select("node"))
    bare, members = members, stored(members.join(small(bits), "node"), "members")
    discard(bare, bits)
    found, labels = star_links(members, exact, rounds=4, linked_first=True, alike=limit)
    links = links if found is None else links.unionByName(found)
    apart = labelled(members, labels)
    links = links.unionByName(settled(lambda: exact(stored(spread_pairs(apart, limit).distinct(), "pairs")), "links"))
    component = components(links)
    repeated = distinct.select("h1", "h2", "n", "node").join(component, "node", "left").filter("n > 1 or component is not null")
    return every, stored(repeated.select("h1", "h2", F.coalesce("component", "node").alias("class")), "classes")


def line_report(docs: DataFrame, threshold: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_lines, n_dropped, dropped (line numbers from 0, ascending).

    Of each component of similar lines the one with the smallest (doc_id, number)
    stays, over all documents; equal lines are similar. Blank lines stay. A null or
    empty text is one blank line. Repeated rows are rows of their own, so that a
    second copy loses its lines; an empty table gives no rows. Only the two named
    columns are read.
    """
    with settings(docs.sparkSession, CONF):
        every, classes = similar_lines(docs, threshold, id_col, text_col)
    found = stored(every.join(small(classes), ["h1", "h2"]).select("row", "doc_id", "no", "occ", "class"), "found")
    keepers = found.groupBy("class").agg(F.min(F.struct("doc_id", "no", "occ")).alias("first")).select(F.col("first.occ").alias("occ"))
    dropped = found.join(keepers, "occ", "left_anti").groupBy("row").agg(F.sort_array(F.collect_list("no")).alias("dropped"))
    counts = every.groupBy("row").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("n_lines"))
    return counts.join(dropped, "row", "left").select("doc_id", "n_lines", F.coalesce(F.size("dropped"), F.lit(0)).cast("long").alias("n_dropped"), F.coalesce("dropped", F.array().cast("array<int>")).alias("dropped"))


def without_lines(docs: DataFrame, report: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the report's dropped lines taken out of the text (breaks become \\n); ids are taken to be unique."""
    gone = report.select(F.col("doc_id").alias("__id"), F.col("dropped").alias("__dropped"))
    lines = F.split(text_col, BREAK)
    kept = F.array_join(F.filter(lines, lambda _, i: ~F.array_contains("__dropped", i)), "\n")
    joined = docs.join(gone, docs[id_col] == gone["__id"], "left")
    return joined.withColumn(text_col, F.when(F.size("__dropped") > 0, kept).otherwise(F.col(text_col))).select(*docs.columns)
