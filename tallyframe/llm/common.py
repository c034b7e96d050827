"""Shared pieces: stored intermediate tables and vectorised text hashing."""

from __future__ import annotations

import atexit
import contextlib
import re
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..shipping import ship

_local_root: str | None = None
_open: list[list[DataFrame]] = []
BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; where none is named, a folder of our own, which only a local master can use."""
    global _local_root
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    master = spark.sparkContext.master
    if not re.match(r"local(\[|$)", master):
        raise ValueError(f"spark.checkpoint.dir must name a folder that the driver and all executors of {master} share")
    if _local_root is None:
        _local_root = tempfile.mkdtemp(prefix="tallyframe-")
        atexit.register(shutil.rmtree, _local_root, ignore_errors=True)
    return f"file://{_local_root}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once into the shared folder and read it back.

    Cuts the lineage: a lost executor costs a re-read, not a re-computation.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    if _open:
        _open[-1].append(out)
    return out


def settled(make: Callable[[], DataFrame], name: str) -> DataFrame:
    """``stored(make())``; the tables that ``make`` stored on its way are deleted once the result is written."""
    made: list[DataFrame] = []
    _open.append(made)
    try:
        out = stored(make(), name)
    finally:
        _open.pop()
    discard(*[t for t in made if t is not out])
    if _open:
        _open[-1].append(out)
    return out


@contextlib.contextmanager
def settings(spark: SparkSession, conf: dict[str, str]) -> Iterator[None]:
    """The session's settings are those of ``conf`` meanwhile: for tables that are stored, as other plans are lazy."""
    before = {k: spark.conf.get(k, None) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def discard(*tables: DataFrame) -> None:
    """Delete tables of ``stored`` that no later plan reads; one that is gone already is passed over."""
    for df in tables:
        context = df.sparkSession.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(df.stored_at)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def map_arrow(df: DataFrame, function, schema: str) -> DataFrame:
    """``mapInArrow`` whose workers can import this package wherever the driver found it.

    The session's Arrow batches are held to 1,000 rows, from the first call on: plans
    are lazy and read the setting when they run.
    """
    spark = df.sparkSession
    ship(spark)
    # texts are long: the usual batch of 10,000 rows would be held several times over
    if int(spark.conf.get(BATCH_ROWS)) > 1_000:
        spark.conf.set(BATCH_ROWS, "1000")

    def run(batches):
        yield from function(batches)
        pa.default_memory_pool().release_unused()

    return df.mapInArrow(run, schema)


# --- texts as one byte buffer ------------------------------------------------


def text_chunks(column: pa.Array, max_bytes: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of rows; a null text is empty.

    A chunk holds whole texts and at most ``max_bytes``, unless one text alone
    is longer.
    """
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    if not n:
        return
    _, offs, data = column.buffers()
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    offsets = np.frombuffer(offs, kind, column.offset + n + 1)[column.offset :].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    row = 0
    while row < n:
        end = int(np.searchsorted(offsets, offsets[row] + max_bytes, "right")) - 1
        end = min(n, max(end, row + 1))
        yield row, end, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over the 64 output bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BYTE_LOWER = _BYTE[_LOWER]
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_BASE = np.uint64(0xD6E8FEB86659FD93)
_BASE_INV = np.uint64(pow(0xD6E8FEB86659FD93, -1, 1 << 64))
_powers: dict[int, np.ndarray] = {}


def _power(base: np.uint64, n: int) -> np.ndarray:
    have = _powers.get(int(base))
    if have is None or len(have) < n:
        have = np.full(max(n, 1 << 20), base, np.uint64)
        have[0] = 1
        have = np.multiply.accumulate(have)
        _powers[int(base)] = have
    return have[:n]


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, first word of each text) of ``[^\\x20\\x09-\\x0D]+``; words end with their text."""
    n = len(data)
    inside = ~_SPACE[data]
    starts = inside.copy()
    ends = inside.copy()
    if n:
        starts[1:] &= ~inside[:-1]
        ends[:-1] &= ~inside[1:]
        cut = offsets[(offsets > 0) & (offsets < n)]
        starts[cut] = inside[cut]
        ends[cut - 1] = inside[cut - 1]
    first = np.flatnonzero(starts)
    return first, np.flatnonzero(ends) + 1, np.searchsorted(first, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit names of the words, A-Z lower-cased."""
    n = len(data)
    prefix = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE_LOWER[data] * _power(_BASE, n), out=prefix[1:])
    raw = (prefix[ends] - prefix[starts]) * _power(_BASE_INV, n + 1)[starts]
    return mix64(raw ^ ((ends - starts).astype(np.uint64) << np.uint64(40)))


def shingles(hashes: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(names, offsets by text) of the distinct ``k``-word shingles, ascending in each text.

    A text of 1 to k-1 words has its whole word sequence as its one shingle; a
    text without words has none.
    """
    n = len(hashes)
    seed = np.uint64(0x632BE59BD9B4E019)
    full = np.zeros(0, np.uint64)
    if n >= k:
        full = np.full(n - k + 1, seed)
        for i in range(k):
            full = mix64(full * np.uint64(3) + hashes[i : n - k + 1 + i])
    out, sizes = [], np.zeros(len(first), np.int64)
    for i, (a, b) in enumerate(zip(first[:-1].tolist(), first[1:].tolist(), strict=True)):
        if b - a >= k:
            own = np.unique(full[a : b - k + 1])
        elif b > a:
            own = np.array([seed]) + np.uint64(b - a)
            for w in hashes[a:b]:
                own = mix64(own * np.uint64(3) + w)
        else:
            continue
        sizes[i + 1] = len(own)
        out.append(own)
    return (np.concatenate(out) if out else np.zeros(0, np.uint64)), np.cumsum(sizes)
