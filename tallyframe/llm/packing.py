"""Packing token sequences by non-negative least squares over a length histogram.

Documents are tokenised once. Whole windows are cut off the front; the tails are
packed as they are. The tails' length histogram (at most ``capacity`` numbers)
goes to the driver, where repeat counts of shallow length combinations that fill
a window exactly are fitted to it by non-negative least squares, rounded, and the
residual tails are packed best-fit decreasing by count. Pieces then take their
slots by their rank within their length, found in two levels, so that a length
that holds a third of all rows is ranked by many tasks.
"""

from __future__ import annotations

import json
import math
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import map_arrow, stored

#: Fixed value: the published pre-token pattern of byte-level BPE with this vocabulary layout.
BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def _byte_of_char() -> dict[str, int]:
    """Byte-level BPE writes byte b as chr(b) if printable, else as the next free character from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {chr(b): b for b in shown}
    out |= {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in out.values())}
    return out


@lru_cache(maxsize=2)
def encoder(path: str):
    """text -> uint32 ids, equal to those of ``tokenizers`` for the file at ``path``.

    A plain byte-level BPE is run by tiktoken's faster merge loop over the file's own
    vocabulary; whatever else the file holds, and each text with a special token's
    string, goes to ``tokenizers`` itself.
    """
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    slow = lambda text: np.array(tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, pre = spec["model"], spec["pre_tokenizer"] or {}
    vocab = model.get("vocab", {})
    pairs = [m.split(" ") if isinstance(m, str) else m for m in model.get("merges", [])]
    plain = (
        model["type"] == "BPE"
        and (pre.get("type"), pre.get("add_prefix_space"), pre.get("use_regex")) == ("ByteLevel", False, True)
        and spec["normalizer"] is None
        and not model.get("dropout")
        and all(vocab.get("".join(m)) == 256 + i for i, m in enumerate(pairs))
    )
    if not plain:
        return slow
    import tiktoken

    byte = _byte_of_char()
    ranks = {bytes(byte[c] for c in token): i for token, i in vocab.items()}
    fast = tiktoken.Encoding("file", pat_str=BYTE_LEVEL, mergeable_ranks=ranks, special_tokens={})
    special = [t["content"] for t in spec["added_tokens"]]

    def encode(text: str) -> np.ndarray:
        if any(s in text for s in special):
            return slow(text)
        return np.array(fast.encode_ordinary(text), np.uint32)

    return encode


def _cut(path: str, capacity: int, end_id: int):
    def run(batches):
        encode = encoder(path)
        for batch in batches:
            rows: list[tuple] = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = np.append(encode(text.as_py() or ""), np.uint32(end_id)).astype("<u4")
                n, raw = len(ids), memoryview(ids).cast("B")
                rows += [(doc, a, min(capacity, n - a), zlib.crc32(raw[4 * a : 4 * (a + capacity)]), n) for a in range(0, n, capacity)]
            kinds = [pa.int64()] * 5
            columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)] if rows else [pa.array([], t) for t in kinds]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return run


def combinations(lengths: np.ndarray, capacity: int) -> np.ndarray:
    """Rows of two or three of ``lengths``, descending and padded by 0, that fill ``capacity`` exactly."""
    have = np.zeros(capacity + 1, bool)
    have[lengths[lengths < capacity]] = True
    have[0] = True
    a, b = np.meshgrid(np.arange(1, capacity), np.arange(1, capacity), indexing="ij")
    c = capacity - a - b
    keep = (a >= b) & (b >= c) & (c >= 0)
    keep[keep] &= have[a[keep]] & have[b[keep]] & have[c[keep]]
    return np.stack([a[keep], b[keep], c[keep]], 1)


def repeat_counts(combos: np.ndarray, histogram: np.ndarray, steps: int = 400) -> np.ndarray:
    """x >= 0 minimising |A x - histogram|, A[l, j] = how often combination j has length l."""
    if not len(combos):
        return np.zeros(0)
    used = (combos > 0).astype(float)
    target = histogram.astype(float).copy()
    target[0] = 0

    def forward(x):
        return np.bincount(combos.ravel(), (used * x[:, None]).ravel(), len(target))

    def back(r):
        return (r[combos] * used).sum(1)

    v = np.ones(len(combos))
    for _ in range(20):  # the largest singular value squared, for the step
        v = back(forward(v))
        scale = np.linalg.norm(v)
        v /= scale
    x = z = np.zeros(len(combos))
    t = 1.0
    for _ in range(steps):  # accelerated projected gradient
        nx = np.maximum(0, z - back(forward(z) - target) / (1.05 * scale))
        nt = (1 + (1 + 4 * t * t) ** 0.5) / 2
        z = nx + (t - 1) / nt * (nx - x)
        x, t = nx, nt
    return x


def plan(histogram: np.ndarray, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """(lengths in one sequence, how many such sequences); uses each length exactly histogram[length] times."""
    left = histogram.astype(np.int64).copy()
    out: list[tuple[tuple[int, ...], int]] = []
    if left[capacity]:
        out.append(((capacity,), int(left[capacity])))
        left[capacity] = 0
    combos = combinations(np.flatnonzero(left), capacity)
    x = repeat_counts(combos, left)
    order = np.argsort(-x, kind="stable")
    for j in order[: int((x >= 0.5).sum())]:
        parts = [int(p) for p in combos[j] if p]
        n = min(int(round(x[j])), *(int(left[p]) // parts.count(p) for p in parts))
        if n > 0:
            out.append((tuple(parts), n))
            for p in parts:
                left[p] -= n
    room: dict[int, list[list]] = {}  # free tokens -> [parts, count]
    for length in range(capacity - 1, 0, -1):
        n = int(left[length])
        while n:
            fit = min((r for r in room if r >= length and room[r]), default=None)
            if fit is None:
                each = min(n, capacity // length)
                made = n // each
                room.setdefault(capacity - each * length, []).append([(length,) * each, made])
                n -= made * each
                continue
            parts, count = room[fit].pop()
            took = min(n, count)
            if took < count:
                room[fit].append([parts, count - took])
            room.setdefault(fit - length, []).append([(*parts, length), took])
            n -= took
    out += [(parts, count) for _, bins in sorted(room.items()) for parts, count in bins]
    return out


def slots(made: list[tuple[tuple[int, ...], int]]) -> tuple[np.ndarray, ...]:
    """(length, first rank, first sequence, offset) of each slot, by length and rank."""
    rows, taken, sequence = [], {}, 0
    for parts, count in made:
        at = 0
        for p in parts:
            rows.append((p, taken.get(p, 0), sequence, at))
            taken[p] = taken.get(p, 0) + count
            at += p
        sequence += count
    table = np.array(sorted(rows), np.int64).reshape(-1, 4)
    return tuple(table.T)


def _place(shared):
    def run(batches):
        length, first, sequence, offset = shared.value
        key = length << 44 | first  # a rank is below 2**44
        for batch in batches:
            ln, rank = (batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            at = np.searchsorted(key, ln << 44 | rank, "right") - 1
            kept = [batch.column(i) for i in range(5)]
            yield pa.RecordBatch.from_arrays(
                [*kept, pa.array(sequence[at] + rank - first[at]), pa.array(offset[at])],
                names=[*batch.schema.names[:5], "sequence_id", "offset"],
            )

    return run


def pack_documents(
    docs: DataFrame,
    tokenizer_path: str,
    capacity: int = 1024,
    id_col: str = "doc_id",
    text_col: str = "text",
    end_id: int = 0,
) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A null or empty text is the end id alone. Repeated rows are packed each on their
    own; a null id is kept as null. An empty table gives no rows. Only the two named
    columns are read, so further columns may have any names. The driver holds the
    histogram and the slots, whose numbers depend on ``capacity`` and not on the data.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    pieces = stored(map_arrow(rows, _cut(tokenizer_path, capacity, end_id), PIECES), "pieces")
    counts = np.zeros(capacity + 1, np.int64)
    for r in pieces.groupBy("length").count().collect():
        counts[r["length"]] = r["count"]
    shared = spark.sparkContext.broadcast(slots(plan(counts, capacity)))
    buckets = max(1, math.isqrt(int(counts.max())))  # a length of n pieces: root of n ranges of root of n pieces
    dealt = pieces.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "start"), F.lit(buckets)))
    before = (
        dealt.groupBy("length", "bucket")
        .count()
        .withColumn("before", F.sum("count").over(Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)))
        .select("length", "bucket", F.coalesce("before", F.lit(0)).alias("before"))
    )
    within = Window.partitionBy("length", "bucket").orderBy("doc_id", "start", "ids_crc32")
    ranked = (
        dealt.withColumn("within", F.row_number().over(within) - 1)
        .join(before, ["length", "bucket"])
        .select("doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("within") + F.col("before")).cast("long").alias("rank"))
    )
    return map_arrow(ranked, _place(shared), PIECES + ", sequence_id long, offset long")
