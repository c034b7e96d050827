"""AVI motion-JPEG columns: write, index, decode and cut into timed clips.

A payload is stored as the luma samples of grey baseline-JPEG frames of 24 x 24
blocks: a block of 8 x 8 equal pixels carries one sample, its DC coefficient is
the sample itself (quantiser 8), so every decoder gets the samples back exactly.
The Huffman table gives the DC category c a code of 15 - c bits and the end of
block 1 bit, so that each block takes 16 bits and a frame is coded and decoded
by one table lookup per block. Frames of other writers go through a plain
baseline decoder.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, text_chunks

SIDE = 24
FRAME = SIDE * SIDE
MICROS = 40_000

#: Fixed values of the JPEG standard: zigzag order of the 64 coefficients.
ZIGZAG = [r * 8 + c for s in range(15) for r, c in sorted(((i, s - i) for i in range(8) if 0 <= s - i < 8), reverse=s % 2 == 0)]


# --- JPEG ---------------------------------------------------------------------


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _header() -> bytes:
    lengths = [0] * 16
    for category in range(9):
        lengths[14 - category] = 1
    return b"".join(
        [
            b"\xff\xd8",
            _segment(0xDB, b"\x00" + bytes([8] * 64)),
            _segment(0xC0, struct.pack(">BHHBBBB", 8, SIDE * 8, SIDE * 8, 1, 1, 0x11, 0)),
            _segment(0xC4, b"\x00" + bytes(lengths) + bytes(range(8, -1, -1))),
            _segment(0xC4, b"\x10" + bytes([1] + [0] * 15) + b"\x00"),
            _segment(0xDA, bytes([1, 1, 0x00, 0, 63, 0])),
        ]
    )


def codes(counts: bytes, symbols: bytes) -> dict[tuple[int, int], int]:
    """(length, code) -> symbol of a Huffman table."""
    out, code, k = {}, 0, 0
    for length in range(1, 17):
        for _ in range(counts[length - 1]):
            out[length, code] = symbols[k]
            code, k = code + 1, k + 1
        code <<= 1
    return out


def _signed(bits: int, size: int) -> int:
    return bits if not size or bits >> (size - 1) else bits - (1 << size) + 1


def block_table(dc: dict, ac: dict) -> np.ndarray | None:
    """16-bit word -> DC difference, where each block is one word; None for tables that don't work so. 32767: no such word."""
    ends = [n for (n, _), s in ac.items() if s == 0]
    out = np.full(1 << 16, 32767, np.int16)
    for (n, code), size in dc.items():
        if not ends or n + size + ends[0] != 16:
            return None
        end = next(c for (m, c), s in ac.items() if s == 0 and m == ends[0])
        for bits in range(1 << size):
            out[(((code << size) | bits) << ends[0]) | end] = _signed(bits, size)
    return out


def _word_of_difference() -> np.ndarray:
    dc = codes(bytes([0] * 6 + [1] * 9 + [0]), bytes(range(8, -1, -1)))
    table = block_table(dc, {(1, 0): 0})
    words = np.flatnonzero(table != 32767)
    out = np.zeros(511, ">u2")
    out[table[words].astype(int) + 255] = words
    return out


HEADER = _header()
_WORD = _word_of_difference()


def parse_jpeg(data: bytes) -> dict:
    """Sizes, tables and the place of the entropy-coded bytes of a grey baseline JPEG."""
    out: dict = {"quant": {}, "huff": {}, "restart": 0}
    at = 2
    if data[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG")
    while at + 4 <= len(data):
        marker, size = data[at + 1], struct.unpack_from(">H", data, at + 2)[0]
        body, at = data[at + 4 : at + 2 + size], at + 2 + size
        if marker == 0xDB:
            while body:
                wide = 1 + (body[0] >> 4)
                out["quant"][body[0] & 15] = np.frombuffer(body[1 : 1 + 64 * wide], np.uint8 if wide == 1 else ">u2").astype(np.int32)
                body = body[1 + 64 * wide :]
        elif marker == 0xC4:
            while body:
                n = sum(body[1:17])
                out["huff"][body[0] >> 4, body[0] & 15] = codes(body[1:17], body[17 : 17 + n])
                body = body[17 + n :]
        elif marker == 0xC0:
            _, out["height"], out["width"], parts = struct.unpack_from(">BHHB", body)
            if parts != 1:
                raise ValueError("only grey frames are decoded")
            out["table"] = body[8]
        elif 0xC1 <= marker <= 0xCF:
            raise ValueError("only baseline JPEG is decoded")
        elif marker == 0xDD:
            out["restart"] = struct.unpack(">H", body)[0]
        elif marker == 0xDA:
            return out | {"dc": body[2] >> 4, "ac": body[2] & 15, "scan": at}
    raise ValueError("JPEG without a scan")


def _bits(data: bytes):
    n = acc = 0
    at = 0

    def take(k: int) -> int:
        nonlocal n, acc, at
        while n < k:
            byte = data[at] if at < len(data) else 0xFF
            at += 2 if byte == 0xFF else 1  # a stuffed zero follows
            acc, n = (acc << 8) | byte, n + 8
        n -= k
        got = acc >> n
        acc &= (1 << n) - 1
        return got

    return take


def decode_jpeg(data: bytes) -> np.ndarray:
    """Pixels of a grey baseline JPEG, height x width."""
    p = parse_jpeg(data)
    high, wide = -(-p["height"] // 8), -(-p["width"] // 8)
    dc, ac, quant = p["huff"][0, p["dc"]], p["huff"][1, p["ac"]], p["quant"][p["table"]]
    body = data[p["scan"] :]
    k = np.arange(8)
    basis = np.cos((2 * k[None] + 1) * k[:, None] * np.pi / 16) / 2
    basis[0] /= 2**0.5
    out = np.zeros((high * 8, wide * 8))
    take, level = _bits(body), 0
    runs = 0

    def symbol(table: dict) -> int:
        code = 0
        for n in range(1, 17):
            code = code << 1 | take(1)
            if (n, code) in table:
                return table[n, code]
        raise ValueError("bad Huffman code")

    for b in range(high * wide):
        if p["restart"] and b and b % p["restart"] == 0:
            cut = body.index(bytes([0xFF, 0xD0 + runs % 8]))
            body, level, runs = body[cut + 2 :], 0, runs + 1
            take = _bits(body)
        cell = np.zeros(64)
        size = symbol(dc)
        level += _signed(take(size), size)
        cell[0], i = level, 1
        while i < 64:
            s = symbol(ac)
            if s == 0:
                break
            i += s >> 4
            if s & 15:
                cell[i] = _signed(take(s & 15), s & 15)
            i += 1
        flat = np.zeros(64)
        flat[ZIGZAG] = cell * quant
        out[b // wide * 8 :][:8, b % wide * 8 :][:, :8] = basis.T @ flat.reshape(8, 8) @ basis
    return np.clip(np.rint(out + 128), 0, 255).astype(np.uint8)[: p["height"], : p["width"]]


# --- RIFF ---------------------------------------------------------------------


def _chunk(kind: bytes, body: bytes) -> bytes:
    return kind + struct.pack("<I", len(body)) + body + b"\0" * (len(body) % 2)


def _stored_size() -> int:
    return (len(HEADER) + 2 * FRAME + 2 + 1) // 2 * 2


def write_avi(payload: np.ndarray) -> bytes:
    """An AVI of one grey frame per 576 samples."""
    n, size = len(payload) // FRAME, _stored_size()
    samples = payload.reshape(n, FRAME).astype(np.int16)
    steps = np.diff(samples, axis=1, prepend=np.int16(128))
    movi = np.zeros((n, 8 + size), np.uint8)
    movi[:, :8] = np.frombuffer(b"00dc" + struct.pack("<I", size), np.uint8)
    head = 8 + len(HEADER)
    movi[:, 8:head] = np.frombuffer(HEADER, np.uint8)
    movi[:, head : head + 2 * FRAME] = _WORD[steps + 255].view(np.uint8).reshape(n, 2 * FRAME)
    movi[:, head + 2 * FRAME : head + 2 * FRAME + 2] = (0xFF, 0xD9)
    index = np.zeros((n, 4), "<u4")
    index[:, 0] = int.from_bytes(b"00dc", "little")
    index[:, 1] = 0x10
    index[:, 2] = 4 + np.arange(n, dtype=np.int64) * (8 + size)
    index[:, 3] = size
    px = SIDE * 8
    avih = struct.pack("<14I", MICROS, size * 1_000_000 // MICROS, 0, 0x10, n, 0, 1, size, px, px, 0, 0, 0, 0)
    strh = struct.pack("<4s4sIHHIIIIIIIIhhhh", b"vids", b"MJPG", 0, 0, 0, 0, MICROS, 1_000_000, 0, n, size, 0xFFFFFFFF, 0, 0, 0, px, px)
    strf = struct.pack("<IiiHH4sIiiII", 40, px, px, 1, 24, b"MJPG", px * px * 3, 0, 0, 0, 0)
    hdrl = _chunk(b"LIST", b"hdrl" + _chunk(b"avih", avih) + _chunk(b"LIST", b"strl" + _chunk(b"strh", strh) + _chunk(b"strf", strf)))
    body = b"AVI " + hdrl + _chunk(b"LIST", b"movi" + movi.tobytes()) + _chunk(b"idx1", index.tobytes())
    return _chunk(b"RIFF", body)


def read_index(data: bytes) -> tuple[int, list[tuple[int, int]]]:
    """(microseconds a frame, [(place, size) of each video frame]) from the RIFF headers and idx1."""
    if data[:4] != b"RIFF" or data[8:12] != b"AVI ":
        raise ValueError("not an AVI")
    micros, movi, entries, at = MICROS, None, None, 12
    while at + 8 <= len(data):
        kind, size = data[at : at + 4], struct.unpack_from("<I", data, at + 4)[0]
        if kind == b"LIST" and data[at + 8 : at + 12] == b"hdrl":
            micros = struct.unpack_from("<I", data, at + 20)[0]
        elif kind == b"LIST" and data[at + 8 : at + 12] == b"movi":
            movi = at + 8
        elif kind == b"idx1":
            entries = np.frombuffer(data, "<u4", size // 16 * 4, at + 8).reshape(-1, 4)
        at += 8 + size + size % 2
    if movi is None or entries is None:
        raise ValueError("AVI without movi or idx1")
    video = entries[(entries[:, 0] >> 16 & 0xFFFF) == int.from_bytes(b"dc", "little")]
    base = movi
    if len(video) and data[movi + int(video[0, 2]) : movi + int(video[0, 2]) + 2] != b"00":
        base = 0  # some writers count from the file's start
    return micros, [(base + int(o) + 8, int(s)) for o, s in video[:, 2:]]


def read_avi(data: bytes) -> tuple[int, np.ndarray]:
    """(microseconds a frame, samples by frame): one sample per block of one-word frames, else per pixel."""
    micros, places = read_index(data)
    if not places:
        return micros, np.zeros((0, 0), np.uint8)
    at, size = places[0]
    first = data[at : at + size]
    head = parse_jpeg(first)
    blocks = -(-head["height"] // 8) * -(-head["width"] // 8)
    table = block_table(head["huff"][0, head["dc"]], head["huff"][1, head["ac"]])
    if table is not None and head["quant"][head["table"]][0] == 8 and all(s == size for _, s in places):
        raw = np.frombuffer(data, np.uint8)
        starts = np.array([p for p, _ in places])
        frames = np.lib.stride_tricks.sliding_window_view(raw, size)[starts]
        scan = head["scan"]
        words = frames[:, scan : scan + 2 * blocks]
        if (frames[:, :scan] == frames[0, :scan]).all() and words.shape[1] == 2 * blocks and not (words == 255).any():
            steps = table[np.ascontiguousarray(words).view(">u2")]
            if not (steps == 32767).any():
                return micros, (np.cumsum(steps, axis=1, dtype=np.int32) + 128).astype(np.uint8)
    return micros, np.stack([decode_jpeg(data[p : p + s]).ravel() for p, s in places])


def shots(frames: np.ndarray, window: int = 8, factor: float = 3.0, least: float = 0.05) -> tuple[np.ndarray, np.ndarray]:
    """(first frame of each clip, histogram difference at each frame but the first).

    A clip begins where the difference of 32-bin histograms exceeds ``least`` and
    the mean of the ``window`` differences before it by ``factor`` deviations.
    """
    n = len(frames)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0)
    bins = np.bincount((np.arange(n)[:, None] * 32 + (frames >> 3)).ravel(), minlength=32 * n).reshape(n, 32)
    jump = np.abs(np.diff(bins, axis=0)).sum(1) / (2 * frames.shape[1])
    sums = np.concatenate([[0.0], np.cumsum(jump)])
    squares = np.concatenate([[0.0], np.cumsum(jump * jump)])
    at = np.arange(n - 1)
    low = np.maximum(0, at - window)
    seen = np.maximum(1, at - low)
    mean = (sums[at] - sums[low]) / seen
    spread = np.sqrt(np.maximum(0, (squares[at] - squares[low]) / seen - mean * mean))
    cuts = at[(at > 0) & (jump > least) & (jump > mean + factor * spread)] + 1
    return np.concatenate([[0], cuts]), jump


def payload_of(text: np.ndarray) -> np.ndarray:
    """The bytes, filled up by 255 to a positive multiple of 576."""
    out = np.full(max(1, -(-len(text) // FRAME)) * FRAME, 255, np.uint8)
    out[: len(text)] = text
    return out


# --- columns ------------------------------------------------------------------

MEDIA = "doc_id long, n_bytes long, avi binary"
CLIPS = "doc_id long, clip int, first_frame long, frames long, start_s double, end_s double, peak double"
DIGEST = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, clips long"


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def _each_text(batch):
    for a, _, data, offsets in text_chunks(batch.column(1)):
        for i in range(len(offsets) - 1):
            yield batch.column(0)[a + i].as_py(), data[offsets[i] : offsets[i + 1]]


def text_to_avi(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes and the AVI file of each text; a null text is empty (one frame of filling)."""

    def run(batches):
        for batch in batches:
            for doc, text in _each_text(batch):
                yield pa.RecordBatch.from_arrays([pa.array([doc], pa.int64()), pa.array([len(text)], pa.int64()), pa.array([write_avi(payload_of(text))], pa.binary())], names=["doc_id", "n_bytes", "avi"])

    return map_arrow(_texts(docs, id_col, text_col), run, MEDIA)


def avi_clips(media: DataFrame, id_col: str = "doc_id", avi_col: str = "avi") -> DataFrame:
    """Timed clip rows of a column of AVI files; a null or frameless file gives none."""

    def run(batches):
        for batch in batches:
            rows = []
            for doc, avi in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                data = avi.as_py()
                if not data:
                    continue
                micros, frames = read_avi(data)
                starts, jump = shots(frames)
                ends = np.append(starts[1:], len(frames)) if len(starts) else starts
                for k, (a, b) in enumerate(zip(starts.tolist(), ends.tolist(), strict=True)):
                    rows.append((doc, k, a, b - a, a * micros / 1e6, b * micros / 1e6, float(jump[a : b - 1].max(initial=0.0))))
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64()]
            columns = list(zip(*rows, strict=True)) or [[]] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["doc_id", "clip", "first_frame", "frames", "start_s", "end_s", "peak"])

    return map_arrow(media.select(F.col(id_col).cast("long").alias("doc_id"), F.col(avi_col).alias("avi")), run, CLIPS)


def media_digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Store each text as an AVI, read it back and describe both, one row per document.

    A null or empty text is one frame of filling. Repeated rows give repeated rows;
    a null id stays null. The work on a row needs about eight times its text in
    memory; no rows meet, so there is no shuffle.
    """

    def run(batches):
        for batch in batches:
            rows = []
            for doc, text in _each_text(batch):
                avi = write_avi(payload_of(text))
                _, frames = read_avi(avi)
                back = frames.tobytes()
                starts, jump = shots(frames)
                feature = f"frames={len(frames)};clips={len(starts)};longest={int(np.diff(np.append(starts, len(frames))).max())};peak={jump.max(initial=0.0):.4f};luma={frames.mean():.4f}"
                rows.append((doc, len(text), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-32:]), len(avi), hashlib.sha256(avi).hexdigest(), feature, len(starts)))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
            columns = list(zip(*rows, strict=True)) or [[]] * 9
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=[c.split()[0] for c in DIGEST.split(", ")])

    return map_arrow(_texts(docs, id_col, text_col), run, DIGEST)
