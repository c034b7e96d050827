"""Quality by importance resampling of hashed n-gram models, Gumbel top-k.

Two bags of hashed word 1- and 2-grams are counted: over the target texts and over
all raw texts. A document's log importance weight is the sum, over its n-grams, of the
log ratio of the two models; with Gumbel noise of its own added, the documents with
the k largest sums are a sample without replacement by those weights. The k-th
largest sum is found by counting within ever narrower ranges, so no task sorts all
rows.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import map_arrow, mix64, stored, text_chunks, word_hashes, words


def _grams(data: np.ndarray, offsets: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, bucket) of every 1- and 2-gram."""
    starts, ends, first = words(data, offsets)
    h = word_hashes(data, starts, ends)
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    two = np.flatnonzero(text[1:] == text[:-1])
    names = np.concatenate([h, mix64(h[two] * np.uint64(3) + h[two + 1])])
    return np.concatenate([text, text[two]]), (names % np.uint64(buckets)).astype(np.int64)


PARTS, SALTS = 16, 64


def _added(batches):
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for part, counts in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            own = np.frombuffer(counts.as_buffer(), np.int64)
            total[part] = total[part] + own if part in total else own
    yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([x.tobytes() for x in total.values()], pa.binary())], names=["part", "counts"])


def counts(texts: DataFrame, buckets: int) -> np.ndarray:
    """2 x buckets: n-gram counts of the rows marked ``target`` and of all rows.

    Each task adds up its rows and gives ``PARTS`` arrays; those meet in ``PARTS`` x
    ``SALTS`` tasks, so the driver gets at most so many arrays, at any size of input.
    """

    def run(batches):
        total = np.zeros((2, buckets), np.int64)
        salt = 0
        for batch in batches:
            target = np.asarray(batch.column(1).to_pylist(), bool)
            salt += len(batch)
            for a, b, data, offsets in text_chunks(batch.column(0)):
                text, gram = _grams(data, offsets, buckets)
                total[1] += np.bincount(gram, minlength=buckets)
                total[0] += np.bincount(gram[target[a:b][text]], minlength=buckets)
        salt = int(mix64(np.array([salt + int(total[1].sum())], np.uint64))[0] % np.uint64(SALTS))
        each = np.array_split(total, PARTS, axis=1)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(PARTS), pa.int32()), pa.array([x.tobytes() for x in each], pa.binary()), pa.array([salt] * PARTS, pa.int32())], names=["part", "counts", "salt"])

    met = map_arrow(texts, run, "part int, counts binary, salt int").repartition(PARTS * SALTS, "part", "salt").select("part", "counts")
    out = np.array_split(np.zeros((2, buckets), np.int64), PARTS, axis=1)
    for r in map_arrow(met, _added, "part int, counts binary").collect():
        out[r["part"]] = out[r["part"]] + np.frombuffer(r["counts"], np.int64).reshape(2, -1)
    return np.concatenate(out, axis=1)


def log_weights(texts: DataFrame, ratio: np.ndarray) -> DataFrame:
    """doc_id and log_weight; a text without words weighs as one of the least likely n-gram."""
    buckets, lowest = len(ratio), float(ratio.min())
    shared = texts.sparkSession.sparkContext.broadcast(ratio)  # one number a bucket

    def run(batches):
        ratio = shared.value
        for batch in batches:
            parts = [np.zeros(0)]
            for a, b, data, offsets in text_chunks(batch.column(1)):
                text, gram = _grams(data, offsets, buckets)
                n = np.bincount(text, minlength=b - a)
                parts.append(np.where(n > 0, np.bincount(text, ratio[gram], b - a), lowest))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(parts))], names=["doc_id", "log_weight"])

    return map_arrow(texts, run, "doc_id long, log_weight double")


def gumbel(seed: int, key: str) -> Column:
    """Standard Gumbel noise that depends on the seed and the key alone."""
    u = (F.pmod(F.xxhash64(F.lit(seed), key), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    return -F.log(-F.log(u))


def mark_largest(rows: DataFrame, keys: Sequence[str], k: int, at_most: int = 5_000, ranges: int = 1024) -> DataFrame:
    """Adds ``kept``: whether the row is among the k with the largest ``keys``, numbers that are not null, the first counting first.

    The range that holds the k-th is cut into ``ranges`` parts again and again, until
    it has ``at_most`` rows or one value; only so few rows are ranked together, and
    more of one value are told apart by the next key in the same way. Of more than
    ``at_most`` rows equal in all keys, those of the first partitions are taken.
    """
    key = keys[0]
    low, high = rows.agg(F.min(key), F.max(key)).first()
    need, size = k, None
    if low is None:
        return rows.withColumn("kept", F.lit(False))
    while low < high:
        step = (high - low) / ranges
        part = F.least(F.lit(ranges - 1), F.floor((F.col(key) - low) / step)) if step > 0 else F.lit(0)
        inside = rows.filter((F.col(key) >= low) & (F.col(key) <= high)).withColumn("part", part)
        found = sorted(((r["part"], r["n"], r["low"], r["high"]) for r in inside.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.min(key).alias("low"), F.max(key).alias("high")).collect()), reverse=True)
        before = (low, high)
        for p, n, part_low, part_high in found:
            if n >= need or p == found[-1][0]:
                size, low, high = n, part_low, part_high
                break
            need -= n
        if size <= at_most or (low, high) == before:
            break
    edge = (F.col(key) >= low) & (F.col(key) <= high)
    outside = rows.filter(~edge).withColumn("kept", F.col(key) > high)
    inside = rows.filter(edge)
    if (size if size is not None else inside.count()) <= at_most:
        best = Window.partitionBy(F.lit(0)).orderBy(*[F.col(c).desc() for c in keys])
        ranked = inside.withColumn("kept", F.row_number().over(best) <= need)
    elif len(keys) > 1:
        ranked = mark_largest(inside, keys[1:], need, at_most, ranges)
    else:
        ranked = mark_largest(inside.withColumn("__row", -F.monotonically_increasing_id()), ["__row"], need, at_most, ranges).drop("__row")
    return ranked.unionByName(outside)


def resample(
    docs: DataFrame,
    target_ids: DataFrame,
    keep_percent: int = 85,
    max_target: int = 20_000,
    buckets: int = 10_000,
    seed: int = 0,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per row of ``docs``: doc_id, log_weight, sampling_key, kept.

    ``target_ids`` (one column) names the target texts, of which at most
    ``max_target``, drawn by a hash of their ids, are fitted; raw counts cover all
    rows. ``keep_percent`` hundredths of all rows, rounded down, are kept; of equal
    keys the smaller id. A null text is empty. Repeated rows are rows of their own; without targets all weights
    rest on the smoothing alone. An empty table gives no rows.
    """
    name = target_ids.columns[0]
    drawn = target_ids.select(F.col(name).cast("long").alias("doc_id")).filter("doc_id is not null").distinct()
    drawn = drawn.orderBy(F.xxhash64(F.lit(seed), "doc_id"), "doc_id").limit(max_target).withColumn("target", F.lit(True))
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    marked = texts.join(F.broadcast(drawn), "doc_id", "left")  # at most max_target ids
    both = counts(marked.select("text", F.coalesce("target", F.lit(False)).alias("target")), buckets) + 0.5
    ratio = np.log(both[0] / both[0].sum()) - np.log(both[1] / both[1].sum())
    scored = log_weights(texts, ratio).withColumn("sampling_key", F.col("log_weight") + gumbel(seed, "doc_id"))
    scored = stored(scored.withColumns({"__low": -F.coalesce("doc_id", F.lit(0)), "__row": -F.monotonically_increasing_id()}), "weights")
    return mark_largest(scored, ["sampling_key", "__low", "__row"], scored.count() * keep_percent // 100).drop("__low", "__row")
