"""Removal of repeated substrings by anchored hashing, in place of distributed prefix doubling.

Rank pairs at growing offsets name ever longer substrings: the name of the 2h bytes
at a position pairs the names of the h bytes there and h further on. Up to 64 bytes
the pairs are formed within a task, from exact 8-byte values. Spark then groups the
positions by name, lets the unique ones go, and goes on with the rest until the
length asked for is passed.

So as not to shuffle every position, a window of ``length`` bytes is followed
through the smallest of its 64-byte names, its anchor: equal windows have equal
anchors at equal offsets. The windows of one anchor are a run of positions, and
their union, the anchor's span, is named from pairs as well. Of anchors whose name
repeats, equal spans repeat as a whole. Where one anchor name has several spans,
each different one goes on to the next round, in pieces of eight windows named by
the bytes that all eight share, and then as single windows of the full length.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import _BASE, _BASE_INV, _BYTE, _power, discard, map_arrow, mix64, stored, text_chunks

GRAM = 64
PIECE = 8
PLACE_BITS = 21
PLACE = np.uint64((1 << PLACE_BITS) - 1)
NO_ID = -(1 << 63)

ANCHORS = "gram long, sa long, sb long, doc_id long, th binary, start long, windows int, lead int"


def doubled(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Names of the 64 and of the 128 bytes at each position; shorter at the end than ``data``."""
    name = data.astype(np.uint64)
    for h in (1, 2, 4):  # exact
        name = name[:-h] | name[h:] << np.uint64(8 * h)
    for h in (8, 16, 32):
        name = mix64(name[:-h] * np.uint64(0x9E3779B97F4A7C15) + name[h:] + np.uint64(h))
    longer = mix64(name[:-GRAM] * np.uint64(0x9E3779B97F4A7C15) + name[GRAM:] + np.uint64(GRAM)) if len(name) > GRAM else name[:0]
    return name, longer


def summed(data: np.ndarray) -> np.ndarray:
    """Prefix sums for ``range_name``."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * _power(_BASE, len(data)), out=out[1:])
    return out


def range_name(sums: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A second name, of the bytes from a to b."""
    return mix64((sums[b] - sums[a]) * _power(_BASE_INV, len(sums))[a] + (b - a).astype(np.uint64))


def anchors(data: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """(first window, windows, gram, span name, second span name, anchor less first) of each anchor; ``data`` has at most 2**21 bytes."""
    wide = length - GRAM + 1
    valid = np.zeros(len(data) + 1, np.int8)
    long = np.flatnonzero(np.diff(offsets) >= length)
    if not len(long):
        return tuple(np.zeros(0, np.int64) for _ in range(6))
    valid[offsets[long]] += 1
    np.add.at(valid, offsets[long + 1] - length + 1, -1)
    starts = np.flatnonzero(np.cumsum(valid, dtype=np.int8))
    gram, longer = doubled(data)
    n = len(gram)
    key = np.full(-(-n // wide) * wide, ~np.uint64(0))
    key[:n] = (gram & ~PLACE) | np.arange(n, dtype=np.uint64)
    blocks = key.reshape(-1, wide)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    place = (np.minimum(behind[starts], ahead[starts + wide - 1]) & PLACE).astype(np.int64)
    new = np.ones(len(starts), bool)
    new[1:] = (place[1:] != place[:-1]) | (starts[1:] != starts[:-1] + 1)
    at = np.flatnonzero(new)
    first, p = starts[at], place[at]
    count = np.diff(np.append(at, len(starts)))
    end = first + count - 1 + length
    half = 2 * GRAM
    span = longer[first]
    for x in (first + (end - first - half) // 2, end - half):  # three names of 128 bytes cover the span
        span = mix64(span * np.uint64(0x9E3779B97F4A7C15) + longer[x])
    span = mix64(span + (end - first).astype(np.uint64) + ((p - first).astype(np.uint64) << np.uint64(32)))
    return first, count, gram[p], span, range_name(summed(data), first, end), p - first


def _pieces(data: np.ndarray, offsets: np.ndarray, length: int, most: int = 1 << 20):
    """(row, place in its text, bytes, offsets): chunks as they are, a text over ``most`` bytes in overlapping parts."""
    if len(data) <= most:
        yield None, 0, data, offsets
        return
    for i, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
        for x in range(a, max(a + 1, b - length + 1), most):
            part = data[x : min(b, x + most + length - 1)]
            yield i, x - a, part, np.array([0, len(part)])


def _find(length: int):
    def run(batches):
        for batch in batches:
            for a, _, data, offsets in text_chunks(batch.column(2), 1 << 19):
                for row, shift, part, bounds in _pieces(data, offsets, length):
                    first, count, gram, span, second, lead = anchors(part, bounds, length)
                    own = np.searchsorted(bounds, first, "right") - 1
                    rows = pa.array(a + (own if row is None else np.full(len(first), row)), pa.int64())
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(gram.view(np.int64)), pa.array(span.view(np.int64)), pa.array(second.view(np.int64)), batch.column(0).take(rows), batch.column(1).take(rows), pa.array(first - bounds[own] + shift), pa.array(count, pa.int32()), pa.array(lead, pa.int32())],
                        names=["gram", "sa", "sb", "doc_id", "th", "start", "windows", "lead"],
                    )

    return run


def _asked(batch, columns: int):
    """(text, columns of its requests) of each row, 512 requests at a time; column 3 has the requests."""
    for i in range(len(batch)):
        data = np.frombuffer(batch.column(2)[i].as_buffer(), np.uint8)
        values = batch.column(3)[i].values
        fields = [np.asarray(values.field(c), np.int64) for c in range(columns)]
        for low in range(0, len(fields[0]), 512):
            yield data, [f[low : low + 512] for f in fields]


def _within(sizes: np.ndarray) -> np.ndarray:
    """0, 1 .. size - 1 for each of ``sizes``."""
    return np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def _gathered(data: np.ndarray, start: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(the bytes of the ranges one after another, where each begins there)."""
    return data[np.repeat(start, sizes) + _within(sizes)], np.cumsum(sizes) - sizes


def _pair(names: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The name of the bytes from a to b, at most 256 of them, from the names of its first and last 128."""
    return mix64(names[a] * np.uint64(0x9E3779B97F4A7C15) + names[b - 2 * GRAM] + (b - a).astype(np.uint64))


def _emit(columns: list[list[np.ndarray]], names: list[str]):
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x) if x else np.zeros(0, np.int64)) for x in columns], names=names)


def _name_pieces(length: int):
    """A run's windows, cut into pieces of 8 by their distance from the anchor: the bytes common to a whole piece, and the piece's span."""

    def run(batches):
        for batch in batches:
            out: list[list[np.ndarray]] = [[] for _ in range(6)]
            for data, (ids, start, windows, lead) in _asked(batch, 4):
                text, begin = _gathered(data, start, windows + length - 1)
                low = (lead - windows + 1) // PIECE  # distances run from lead down
                count = lead // PIECE - low + 1
                row = np.repeat(np.arange(len(ids)), count)
                piece = low[row] + _within(count)
                core = begin[row] + lead[row] - PIECE * piece
                first = np.maximum(begin[row], core - PIECE + 1)
                last = np.minimum(begin[row] + windows[row] - 1, core)
                _, longer = doubled(text)
                sums = summed(text)
                out[0].append(_pair(longer, core, core + length - PIECE + 1).view(np.int64))
                out[1].append(_pair(longer, first, last + length).view(np.int64))
                out[2].append(range_name(sums, first, last + length).view(np.int64))
                out[3].append(ids[row])
                out[4].append(first - begin[row] + start[row])
                out[5].append(last - first + 1)
            yield _emit(out, ["gram", "sa", "sb", "id", "start", "windows"])

    return run


def _name_windows(length: int):
    def run(batches):
        for batch in batches:
            out: list[list[np.ndarray]] = [[], [], []]
            for data, (ids, start, windows) in _asked(batch, 3):
                text, begin = _gathered(data, start, windows + length - 1)
                offset = _within(windows)
                at = np.repeat(begin, windows) + offset
                _, longer = doubled(text)
                out[0].append(_pair(longer, at, at + length).view(np.int64))
                out[1].append(range_name(summed(text), at, at + length).view(np.int64))
                out[2].append(np.repeat(ids, windows) * PIECE + offset)
            yield _emit(out, ["na", "nb", "window"])

    return run


def _merge(batches):
    """Maximal runs of overlapping or touching (start, end) pairs, as a flat list."""
    for batch in batches:
        merged = []
        for i in range(len(batch)):
            pairs = batch.column(2)[i].values
            a, b = np.asarray(pairs.field(0), np.int64), np.asarray(pairs.field(1), np.int64)
            order = np.argsort(a, kind="stable")
            a, b = a[order], np.maximum.accumulate(b[order])
            new = np.flatnonzero(np.append(True, a[1:] > b[:-1]))
            merged.append(np.stack([a[new], b[np.append(new[1:], len(a)) - 1]], 1).ravel())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(merged, pa.list_(pa.int64()))], names=["doc_id", "th", "runs"])


def _cut(batches):
    for batch in batches:
        rows = []
        for i in range(len(batch)):
            text = batch.column(1)[i].as_py()
            runs = batch.column(2)[i].as_py() or []
            kept, at = hashlib.sha256(), 0
            for a, b in zip(runs[::2], runs[1::2], strict=True):
                kept.update(text[at:a])
                at = b
            kept.update(text[at:])
            rows.append((len(text), sum(runs[1::2]) - sum(runs[::2]), len(runs) // 2, kept.hexdigest()))
        columns = list(zip(*rows, strict=True)) or [[]] * 4
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string()]
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(columns, kinds, strict=True))], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    # th, 128 bits of SHA-256, tells apart rows of one id, or without an id, that have different texts
    digest = F.unhex(F.substring(F.sha2(text.cast("binary"), 256), 1, 32))
    return docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("doc_id"), digest.alias("th"), text.alias("text"))


def _met(rows: DataFrame, side: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """``rows`` joined with ``side`` by a shuffle at every size: all sides here grow with the input."""
    return rows.join(side.hint("merge"), keys, how)


def _rerank(rows: DataFrame, place: list[str]) -> tuple[DataFrame, DataFrame]:
    """One round over rows of gram, sa, sb and ``place``: (places of spans that repeat as a whole, what goes on).

    Unique grams go. Of the others, spans that occur again are settled; of grams with
    several different spans one place of each goes on, with m, how often it occurs.
    """
    again = stored(rows.groupBy("gram").count().filter("count > 1").select("gram"), "again")
    left = stored(_met(rows, again, ["gram"]), "left")
    discard(rows)
    spans = stored(left.groupBy("gram", "sa", "sb").agg(F.count(F.lit(1)).alias("m"), F.min(F.struct(*place)).alias("r")).select("gram", "sa", "sb", "m", "r.*"), "spans")
    same = stored(spans.filter("m > 1").select("gram", "sa", "sb"), "same")
    differ = stored(spans.groupBy("gram").count().filter("count > 1").select("gram"), "differ")
    return _met(left, same, ["gram", "sa", "sb"]).select(*place), _met(spans, differ, ["gram"]).select(*place, "m")


def _with_texts(texts: DataFrame, asked: DataFrame, *columns: str) -> DataFrame:
    """doc_id, th, the text's bytes and its requests; of equal rows any one would do."""
    requests = stored(asked.groupBy("doc_id", "th").agg(F.collect_list(F.struct(*columns)).alias("asked")), "requests")
    return _met(texts, requests, ["doc_id", "th"]).select("doc_id", "th", F.col("text").cast("binary").alias("text"), "asked")


def repeated_runs(docs: DataFrame, length: int = 200, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, th and the maximal runs (start, end, start, end ...) of bytes in repeated substrings."""
    if not 2 * GRAM + PIECE <= length <= 4 * GRAM - PIECE:
        raise ValueError(f"length must be from {2 * GRAM + PIECE} to {4 * GRAM - PIECE}")
    texts = _keyed(docs, id_col, text_col)
    interval = ["doc_id", "th", "start", (F.col("start") + F.col("windows") - 1 + length).alias("end")]

    every = stored(map_arrow(texts.filter(F.octet_length("text") >= length), _find(length), ANCHORS), "anchors")
    whole, rest = _rerank(every, ["doc_id", "th", "start", "windows", "lead"])
    runs = stored(rest.withColumn("id", F.monotonically_increasing_id()), "asked")
    alone = runs.filter("m = 1").select("id", "doc_id", "th")

    pieces = map_arrow(_with_texts(texts, runs, "id", "start", "windows", "lead"), _name_pieces(length), "gram long, sa long, sb long, id long, start long, windows long")
    settled, rest = _rerank(stored(pieces, "pieces"), ["id", "start", "windows"])
    parts = stored(rest.withColumnRenamed("id", "run").withColumn("id", F.monotonically_increasing_id()), "asked")

    asked = _met(parts, runs.select(F.col("id").alias("run"), "doc_id", "th"), ["run"])
    named = stored(map_arrow(_with_texts(texts, asked, "id", "start", "windows"), _name_windows(length), "na long, nb long, window long"), "windows")
    groups = stored(named.groupBy("na", "nb").agg(F.min("window").alias("lo"), F.max("window").alias("hi"), F.count(F.lit(1)).alias("m")).filter("lo <> hi"), "groups")
    two = groups.select(F.explode(F.array("lo", "hi")).alias("window"))
    more = _met(named, stored(groups.filter("m > 2").select("na", "nb"), "more"), ["na", "nb"]).select("window")
    found = two.unionByName(more).distinct().select(F.expr(f"window div {PIECE}").alias("id"), F.expr(f"window % {PIECE}").alias("offset"))
    single = _met(found, parts.filter("m = 1").select("id", "run", "start"), ["id"]).select(F.col("run").alias("id"), (F.col("start") + F.col("offset")).alias("start"), F.lit(1).cast("long").alias("windows"))

    inside = _met(settled.unionByName(single), alone, ["id"])
    # a document's intervals are at most as many as its bytes
    pairs = whole.select(*interval).unionByName(inside.select(*interval)).distinct().groupBy("doc_id", "th").agg(F.collect_list(F.struct("start", "end")).alias("pairs"))
    return map_arrow(pairs, _merge, "doc_id long, th binary, runs array<long>")


def remove_repeats(docs: DataFrame, length: int = 200, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes, n_removed, n_spans, kept_sha256.

    Texts are UTF-8 bytes; a byte goes if a string of ``length`` bytes that covers it
    also starts anywhere else, in the same text too. Strings never cross texts. A
    null text is empty; a repeated row repeats its text's strings; a null id stays
    null. An empty table gives no rows.
    """
    runs = stored(repeated_runs(docs, length, id_col, text_col), "runs")
    texts = _met(_keyed(docs, id_col, text_col), runs, ["doc_id", "th"], "left")
    cut = map_arrow(texts.select("doc_id", F.col("text").cast("binary").alias("text"), "runs"), _cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
    return cut.withColumn("doc_id", F.nullif("doc_id", F.lit(NO_ID)))
