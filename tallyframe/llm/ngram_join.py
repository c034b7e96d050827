"""N-gram Jaccard join by adaptive multi-match prefixes.

A document is the set of its word shingles. Sets are put in one global order,
rare shingles first, by a count of hash buckets that has a fixed size. If two sets
have Jaccard similarity t or more, each shares at least ceil(t n) of its n shingles
with the other, so that their prefixes of n - ceil(t n) + l shingles share at least
l. Each document chooses its own l, by the postings and verifications it is
estimated to cost; a pair is verified only if it shares as many prefix shingles as
its two sizes and l ask for. Equal sets are one node throughout, and large groups are
first brought into components by leaders, so that copies don't meet pair by pair.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, map_arrow, mix64, settled, shingles, stored, text_chunks, word_hashes, words
from .graph import components, labelled, small, spread_pairs, star_links, without

RANGES = 64


def _sets(column: pa.Array, k: int):
    """(first row, shingle names, offsets) by chunk of texts."""
    for a, _, data, offsets in text_chunks(column):
        starts, ends, first = words(data, offsets)
        names, bounds = shingles(word_hashes(data, starts, ends), first, k)
        yield a, names, bounds


def _sketches(names: np.ndarray, bounds: np.ndarray, size: int = 16) -> list[bytes]:
    """One byte of each of 16 minima: a cheap guess at similarity, for choosing pairs that are worth a look first."""
    filled = np.flatnonzero(np.diff(bounds))
    out = np.zeros((len(bounds) - 1, size), np.uint8)
    for j in range(size):
        if len(filled):
            mixed = names * np.uint64(2 * (j * 0x9E3779B97F4A7C15 % (1 << 62)) + 1)
            out[filled, j] = (mix64(np.minimum.reduceat(mixed, bounds[filled])) & np.uint64(255)).astype(np.uint8)
    return [x.tobytes() for x in out]


def _describe(k: int, bits: int):
    """Rows of a document's set (part null) and, at the end, of this task's bucket counts (part not null)."""
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("s1", pa.int64()), ("s2", pa.int64()), ("sketch", pa.binary()), ("part", pa.int32()), ("counts", pa.binary())])

    def run(batches):
        counts = np.zeros(1 << bits, np.uint32)
        for batch in batches:
            n, s1, s2, sketch = [], [], [], []
            for _, names, bounds in _sets(batch.column(1), k):
                bucket, times = np.unique((names >> np.uint64(64 - bits)).astype(np.int32), return_counts=True)
                counts[bucket] += times.astype(np.uint32)
                sums = [np.concatenate([[np.uint64(0)], np.cumsum(mix64(names ^ np.uint64(c)))]) for c in (0x1234567, 0x9876543)]
                n.append(np.diff(bounds))
                sketch += _sketches(names, bounds)
                for out, total in zip((s1, s2), sums, strict=True):
                    out.append((total[bounds[1:]] - total[bounds[:-1]]).view(np.int64))
            m = len(batch)
            join = lambda x: pa.array(np.concatenate(x) if x else np.zeros(0, np.int64), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), join(n), join(s1), join(s2), pa.array(sketch, pa.binary()), pa.nulls(m, pa.int32()), pa.nulls(m, pa.binary())], schema=schema)
        each = np.minimum(counts, 255).astype(np.uint8).reshape(RANGES, -1)
        none = pa.nulls(RANGES, pa.int64())
        yield pa.RecordBatch.from_arrays([none] * 4 + [pa.nulls(RANGES, pa.binary()), pa.array(np.arange(RANGES), pa.int32()), pa.array([x.tobytes() for x in each], pa.binary())], schema=schema)

    return run


def _add_counts(batches):
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for part, counts in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            own = np.frombuffer(counts.as_py(), np.uint8).astype(np.uint32)
            total[part] = total[part] + own if part in total else own
    yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([np.minimum(x, 32767).astype(np.uint16).tobytes() for x in total.values()], pa.binary())], names=["part", "counts"])


def _tenths(threshold: float) -> tuple[int, int]:
    return round(threshold * 1000), 1000


def choose_matches(load: np.ndarray, n: int, least: int, usual: float, most: int, chance: float = 0.05, verify_cost: float = 30.0) -> int:
    """The l in 1..most of least estimated cost for a set of n shingles whose buckets, in order, hold ``load``.

    A shingle's partners are its bucket's load beyond the usual, and a few by chance;
    a candidate takes l of the prefix's partners.
    """
    top = max(1, min(most, least))
    prefix = n - least + np.arange(1, top + 1)
    partners = np.cumsum(chance + np.maximum(0.0, load[: prefix[-1]] - usual))[prefix - 1]
    return int(np.argmin(prefix + partners + verify_cost * partners / np.arange(1, top + 1))) + 1


def _prefixes(shared, k: int, num: int, den: int, bits: int, most: int):
    def run(batches):
        table = shared.value
        usual = float(table.mean())
        for batch in batches:
            for a, names, bounds in _sets(batch.column(1), k):  # a batch out for a chunk in
                token, rows, matches, total, ends = [], [], [], [], []
                load = table[(names >> np.uint64(64 - bits)).astype(np.int64)]
                for i, (x, y) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)):
                    n = y - x
                    if not n:
                        continue
                    own = load[x:y]
                    order = np.argsort(own, kind="stable")  # names ascend already, so ties go by name
                    least = -(-num * n // den)
                    many = choose_matches(own[order], n, least, usual, most)
                    size = min(n, n - least + many)
                    token.append(names[x:y][order[:size]])
                    last = order[size - 1]
                    rows.append(a + i)
                    matches.append(many)
                    total.append(n)
                    ends.append(int(own[last]) << 47 | int(names[x + last]) >> 17)
                if not token:
                    continue
                sizes = [len(x) for x in token]
                spread = lambda values, kind: pa.array(np.repeat(np.array(values, kind), sizes))  # noqa: E731, B023
                ids = batch.column(0).take(spread(rows, np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(token).view(np.int64)), ids, spread(matches, np.int8), spread(total, np.int64), spread(ends, np.int64)], names=["token", "node", "l", "n", "last"])

    return run


def _named_sets(k: int):
    def run(batches):
        for batch in batches:
            for a, names, bounds in _sets(batch.column(1), k):
                out = [names[x:y].tobytes() for x, y in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, len(out)), pa.array(out, pa.binary())], names=["node", "shingles"])

    return run


def _similar(num: int, den: int):
    def run(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                if den * min(len(x), len(y)) < num * max(len(x), len(y)):
                    keep.append(False)
                    continue
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(den * both >= num * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def jaccard_components(docs: DataFrame, k: int = 3, threshold: float = 0.9, id_col: str = "doc_id", text_col: str = "text", most_matches: int = 8, star_size: int = 8, rare_size: int = 32, bits: int | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id.

    Words are ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased; a set holds the distinct
    shingles of ``k`` words, or the one sequence of fewer. Documents link at a Jaccard
    similarity of ``threshold`` (in thousandths) or more; component_id is the smallest
    id reachable. A null, empty or blank text has no shingles and links with nothing.
    Rows of one id count as one node, linked with whatever any of them links with. A
    null id takes part in no link and is its own null component. An empty table gives
    no rows. ``bits`` sizes the bucket counts: by default as many as the rows ask for,
    between 2**20 and 2**26.
    """
    spark = docs.sparkSession
    num, den = _tenths(threshold)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    if bits is None:
        bits = min(26, max(20, math.ceil(math.log2(max(1, docs.count()))) + 4))
    kinds = "doc_id long, n long, s1 long, s2 long, sketch binary, part int, counts binary"
    described = stored(map_arrow(texts, _describe(k, bits), kinds), "sets")
    sets = described.filter("part is null").select("doc_id", "n", "s1", "s2", "sketch")
    totals = map_arrow(described.filter("part is not null").select("part", "counts").repartition(RANGES, "part"), _add_counts, "part int, counts binary")
    table = np.zeros((RANGES, (1 << bits) // RANGES), np.uint16)
    for r in totals.collect():  # 2**bits numbers in all
        table[r["part"]] = np.frombuffer(r["counts"], np.uint16)
    shared = spark.sparkContext.broadcast(table.ravel())

    classes = sets.filter("n > 0 and doc_id is not null").groupBy("n", "s1", "s2").agg(F.min("doc_id").alias("rep"), F.max("doc_id").alias("last"))
    copied = stored(classes.filter("rep <> last").select("n", "s1", "s2", "rep"), "copied")
    copies = stored(sets.join(small(copied), ["n", "s1", "s2"]).filter("doc_id <> rep").select("doc_id", "rep").distinct(), "copies")

    gone = stored(copies.select("doc_id").distinct(), "gone")
    singles = texts.filter("doc_id is not null").join(small(gone), "doc_id", "left_anti")
    postings = stored(map_arrow(singles, _prefixes(shared, k, num, den, bits, most_matches), "token long, node long, l byte, n long, last long"), "postings")
    shared.unpersist()
    groups = stored(postings.groupBy("token").agg(F.count(F.lit(1)).alias("m"), F.min("node").alias("lo"), F.max("node").alias("hi")).filter("lo <> hi"), "groups")
    twos = groups.filter("m = 2").groupBy(F.col("lo").alias("a"), F.col("hi").alias("b")).agg(F.count(F.lit(1)).alias("shared"))
    larger = stored(groups.filter("m > 2").select("token", "m"), "larger")
    members = stored(postings.join(small(larger), "token").select("token", "m", "node").distinct(), "members")
    one = F.lit(1).cast("long")
    ends = twos.select(F.explode(F.array("a", "b")).alias("node"), "shared", F.lit(0).cast("long").alias("big")).unionByName(members.select("node", one.alias("shared"), F.when(F.col("m") > rare_size, one).otherwise(0).alias("big")))
    met = ends.groupBy("node").agg(F.sum("shared").alias("met"), F.sum("big").alias("big"))
    # lone: shingles of the prefix that no other document's prefix has; big: those of large groups
    sizes = postings.select("token", "node", "n", "last").distinct().groupBy("node").agg(F.min("n").alias("n"), F.min("last").alias("last"), F.count(F.lit(1)).alias("p"))
    nodes = stored(sizes.join(met, "node").select("node", "n", "last", "p", (F.col("p") - F.col("met")).alias("lone"), "big"), "nodes")
    bare, members = members, stored(members.join(nodes, "node"), "members")
    discard(bare, postings, larger)
    # up to where the first of two prefixes ends, what one lacks the other lacks for certain; last: where it ends, to 64 bits
    first = lambda x: f"CASE WHEN last < other_last THEN {x.replace('?', '')} WHEN last > other_last THEN {x.replace('?', 'other_')} ELSE greatest({x.replace('?', '')}, {x.replace('?', 'other_')}) END"
    alike = f"{den} * least(n, other_n) >= {num} * greatest(n, other_n) AND {num + den} * ({first('?n - ?lone')}) >= {num} * (n + other_n)"
    # a pair that shares no shingle of a smaller group lacks them all
    alike_big = f"{den} * least(n, other_n) >= {num} * greatest(n, other_n) AND {num + den} * ({first('?n - ?p + ?big')}) >= {num} * (n + other_n)"

    def verify(pairs: DataFrame) -> DataFrame:
        pairs = stored(pairs, "pairs")
        nodes = stored(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), "nodes")
        named = stored(map_arrow(texts.join(small(nodes), "doc_id", "left_semi"), _named_sets(k), "node long, shingles binary"), "named")
        full = pairs.join(named.select(F.col("node").alias("a"), F.col("shingles").alias("x")), "a").join(named.select(F.col("node").alias("b"), F.col("shingles").alias("y")), "b")
        return map_arrow(full.select("a", "b", "x", "y"), _similar(num, den), "a long, b long")

    def verify_likely(pairs: DataFrame) -> DataFrame:
        sketches = sets.select("doc_id", F.transform(F.split(F.hex("sketch"), "(?<=\\G..)"), lambda x: x).alias("sketch")).dropDuplicates(["doc_id"])
        t = pairs.join(sketches.select(F.col("doc_id").alias("a"), F.col("sketch").alias("x")), "a").join(sketches.select(F.col("doc_id").alias("b"), F.col("sketch").alias("y")), "b")
        return verify(t.filter(F.size(F.filter(F.zip_with("x", "y", lambda x, y: x == y), lambda same: same)) >= round(16 * (threshold - 0.15))).select("a", "b"))

    sized = members.select(F.xxhash64("token", F.floor(F.log(F.col("n").cast("double")) / -math.log(threshold))).alias("g"), "node", F.col("lone").alias("rank")) if threshold < 1 else members.select(F.col("token").alias("g"), "node", F.col("lone").alias("rank"))
    links, labels = star_links(sized, verify_likely, rounds=3, more_than=star_size)
    apart = labelled(members.withColumn("g", F.col("token")), labels).select("g", "m", "node", "c", "n", "p", "lone", "big", "last")
    apart = stored(apart, "labelled")
    labels = labels if labels is not None else copies.limit(0).select(F.col("doc_id").alias("node"), F.col("rep").alias("c"))
    far = twos.join(labels.withColumnsRenamed({"node": "a", "c": "ca"}), "a", "left").join(labels.withColumnsRenamed({"node": "b", "c": "cb"}), "b", "left")
    far = far.filter("coalesce(ca, a) <> coalesce(cb, b)").select("a", "b", "shared")
    # pairs come from groups of up to rare_size, and from larger ones if they need no shingle of those
    in_small = far.unionByName(spread_pairs(apart.filter(F.col("m") <= rare_size), alike).withColumn("shared", one)).withColumn("in_big", F.lit(0).cast("long"))
    in_big = spread_pairs(apart.filter(F.col("m") > rare_size), alike_big).select("a", "b", F.lit(0).cast("long").alias("shared"), one.alias("in_big"))
    counted = in_small.unionByName(in_big).groupBy("a", "b").agg(F.sum("shared").alias("shared"), F.sum("in_big").alias("in_big"))
    known = ["n", "p", "lone", "big", "last"]
    counted = counted.join(nodes.withColumnsRenamed({"node": "a"}), "a").join(nodes.withColumnsRenamed({"node": "b"} | {x: f"other_{x}" for x in known}), "b")
    # the overlap that this pair needs, less what the prefix that ends first leaves open
    needed = f"greatest(1, ceil({num} * (n + other_n) / {num + den}) - ({first('?n - ?p')}))"
    likely = counted.filter(f"{alike} AND shared + CASE WHEN in_big > 0 THEN in_big ELSE least(big, other_big) END >= {needed}").select("a", "b")
    found = settled(lambda: verify(likely), "links")
    every = copies.select(F.col("doc_id").alias("a"), F.col("rep").alias("b")).unionByName(found)
    if links is not None:
        every = every.unionByName(links)
    component = components(every)
    joined = sets.join(component.withColumnRenamed("node", "doc_id"), "doc_id", "left")
    return joined.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))


def keep_one(docs: DataFrame, k: int = 5, threshold: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose id is their component's smallest, with all their columns.

    Of rows that share id and text one stays, unless the text has no words; another
    text under that id stays too. Rows without an id stay.
    """
    report = settled(lambda: jaccard_components(docs, k, threshold, id_col, text_col), "report")
    gone = report.filter("component_id <> doc_id").select(F.col("doc_id").alias(id_col))
    rest = without(docs, gone, id_col)
    repeated = report.filter("n_shingles > 0 and doc_id is not null").groupBy("doc_id").count().filter("count > 1")
    repeated = stored(repeated.select(F.col("doc_id").alias(id_col)), "repeated")
    if repeated.isEmpty():
        return rest
    few = small(repeated)
    once = rest.join(few, id_col, "left_semi").dropDuplicates([id_col, text_col])
    return rest.join(few, id_col, "left_anti").select(*docs.columns).unionByName(once.select(*docs.columns))
