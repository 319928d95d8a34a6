"""Media columns: bytes kept as AVI motion-JPEG of losslessly coded intra frames, and shots found in them.

Frames are lossless JPEG (process 14, left predictor) of 24 x 24 8-bit samples, so a payload of n * 576
bytes is n frames and comes back bit for bit. The Huffman table gives difference category c a code of
9 - c bits, hence each sample takes nine bits in all and whole frames are coded with array arithmetic.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuelake.llm.common import values

SIDE = 24
FRAME = SIDE * SIDE
FPS = 25
PAD = b"\xff"
#: Bytes of a frame's code before stuffing: nine bits a sample.
CODED = FRAME * 9 // 8
BINS = 16
#: Frames whose histograms are taken at once.
HISTOGRAMS = 1024
WINDOW = 24
SENSITIVITY = 3.0
LEAST_JUMP = 0.35


def _tables() -> tuple[np.ndarray, np.ndarray, bytes]:
    """Code of each difference + 255, difference of each code, and the DHT segment."""
    code_of, diff_of = np.zeros(511, dtype=np.uint16), np.full(512, 9999, dtype=np.int16)
    for diff in range(-255, 256):
        c = abs(diff).bit_length()
        prefix = (1 << (9 - c)) - 2  # 8 - c ones and a zero
        code = prefix << c | (diff if diff >= 0 else diff + (1 << c) - 1)
        code_of[diff + 255], diff_of[code] = code, diff
    counts = bytes([1] * 9 + [0] * 7)
    values = bytes(range(8, -1, -1))
    return code_of, diff_of, b"\xff\xc4" + struct.pack(">HB", 3 + 16 + 9, 0) + counts + values


CODE_OF, DIFF_OF, DHT = _tables()
SOF = b"\xff\xc3" + struct.pack(">HBHHBBBB", 11, 8, SIDE, SIDE, 1, 1, 0x11, 0)
SOS = b"\xff\xda" + struct.pack(">HBBBBBB", 8, 1, 1, 0, 1, 0, 0)
HEAD, EOI = b"\xff\xd8" + SOF + DHT + SOS, b"\xff\xd9"


def _code(samples: np.ndarray) -> np.ndarray:
    """(n, 24, 24) samples to (n, CODED) bytes."""
    wide = samples.astype(np.int16)
    diff = np.empty_like(wide)
    diff[:, 0, 0] = wide[:, 0, 0] - 128
    diff[:, 1:, 0] = wide[:, 1:, 0] - wide[:, :-1, 0]
    diff[:, :, 1:] = wide[:, :, 1:] - wide[:, :, :-1]
    codes = CODE_OF[diff.reshape(len(samples), -1, 8) + 255]
    out = np.empty((*codes.shape[:2], 9), dtype=np.uint8)
    out[..., 0] = codes[..., 0] >> 1
    for k in range(1, 8):
        out[..., k] = (codes[..., k - 1] << (8 - k) & 0xFF) | codes[..., k] >> (k + 1)
    out[..., 8] = codes[..., 7] & 0xFF
    return out.reshape(len(samples), CODED)


def _decode(coded: np.ndarray) -> np.ndarray:
    """(n, CODED) bytes to (n, 24, 24) samples."""
    units = coded.reshape(len(coded), -1, 9).astype(np.uint16)
    codes = np.empty((*units.shape[:2], 8), dtype=np.uint16)
    for k in range(8):
        codes[..., k] = (units[..., k] << 8 | units[..., k + 1]) >> (7 - k) & 0x1FF
    diff = DIFF_OF[codes]
    if (diff == 9999).any():
        raise ValueError("a code that is not in the Huffman table")
    diff = diff.reshape(-1, SIDE, SIDE).astype(np.uint8)  # modulo 256 from here on
    diff[:, :, 0] = np.cumsum(diff[:, :, 0], axis=1, dtype=np.uint8) + np.uint8(128)
    return np.cumsum(diff, axis=2, dtype=np.uint8)


def _chunk(name: bytes, body: bytes) -> bytes:
    return name + struct.pack("<I", len(body)) + body + b"\0" * (len(body) & 1)


def pad(data: bytes) -> bytes:
    """data with 0xFF appended up to a positive multiple of 576."""
    return data + PAD * (-len(data) % FRAME if data else FRAME)


def write_avi(payload: bytes) -> bytes:
    """An AVI file whose frames hold the payload, a positive multiple of 576 bytes."""
    frames = np.frombuffer(payload, dtype=np.uint8).reshape(-1, SIDE, SIDE)
    coded = _code(frames).tobytes()
    body, index, at = [b"movi"], [], 4
    for k in range(len(frames)):
        jpeg = HEAD + coded[k * CODED : (k + 1) * CODED].replace(b"\xff", b"\xff\0") + EOI
        chunk = _chunk(b"00dc", jpeg)
        index.append(struct.pack("<4sIII", b"00dc", 0x10, at, len(jpeg)))
        body.append(chunk)
        at += len(chunk)
    n = len(frames)
    avih = struct.pack("<14I", 1_000_000 // FPS, 0, 0, 0x10, n, 0, 1, 0, SIDE, SIDE, 0, 0, 0, 0)
    strh = struct.pack("<4s4sIHHIIIIIIIIHHHH", b"vids", b"MJPG", 0, 0, 0, 0, 1, FPS, 0, n, 0, 0xFFFFFFFF, 0, 0, 0, SIDE, SIDE)
    strf = struct.pack("<IiiHH4sIiiII", 40, SIDE, SIDE, 1, 8, b"MJPG", FRAME, 0, 0, 0, 0)
    strl = _chunk(b"LIST", b"strl" + _chunk(b"strh", strh) + _chunk(b"strf", strf))
    hdrl = _chunk(b"LIST", b"hdrl" + _chunk(b"avih", avih) + strl)
    return _chunk(b"RIFF", b"AVI " + hdrl + _chunk(b"LIST", b"".join(body)) + _chunk(b"idx1", b"".join(index)))


def _walk(data: bytes, at: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    """(name, start, size) of the chunks between two places; lists give their own type as name."""
    while at + 8 <= end:
        name, size = struct.unpack_from("<4sI", data, at)
        if at + 8 + size > end:
            raise ValueError("a RIFF chunk is longer than its parent")
        if name in (b"RIFF", b"LIST"):
            yield data[at + 8 : at + 12], at + 8, size
        else:
            yield name, at + 8, size
        at += 8 + size + (size & 1)


def _entropy(jpeg: bytes) -> bytes:
    """The unstuffed code of one frame; other tables, sizes or predictors than ours are refused."""
    if jpeg.startswith(HEAD) and jpeg.endswith(EOI):
        return jpeg[len(HEAD) : -2].replace(b"\xff\0", b"\xff")
    raise ValueError("not a lossless 24 x 24 frame of this module's table")


def read_avi(media: bytes) -> tuple[bytes, float]:
    """(payload, frames a second), the frames taken in the order of the index."""
    top = dict((n, (a, s)) for n, a, s in _walk(media, 0, len(media)))
    if b"AVI " not in top:
        raise ValueError("no AVI file")
    start, size = top[b"AVI "]
    parts = {n: (a, s) for n, a, s in _walk(media, start + 4, start + size)}
    if b"movi" not in parts or b"idx1" not in parts or b"hdrl" not in parts:
        raise ValueError("no index or no frames")
    head = {n: (a, s) for n, a, s in _walk(media, parts[b"hdrl"][0] + 4, sum(parts[b"hdrl"]))}
    fps = 1e6 / struct.unpack_from("<I", media, head[b"avih"][0])[0]
    movi, (at, length) = parts[b"movi"][0], parts[b"idx1"]
    coded = []
    for k in range(at, at + length, 16):
        name, _, where, size = struct.unpack_from("<4sIII", media, k)
        if media[movi + where : movi + where + 4] != name:
            raise ValueError("the index points at no chunk")
        if name == b"00dc":
            begin = movi + where + 8
            coded.append(_entropy(media[begin : begin + size]))
    flat = np.frombuffer(b"".join(coded), dtype=np.uint8).reshape(-1, CODED)
    return _decode(flat).tobytes(), fps


def shots(payload: bytes, fps: float) -> list[dict]:
    """Clips between cuts. A cut is a jump of the 16-bin histogram over the mean of the last WINDOW jumps
    by SENSITIVITY deviations, and LEAST_JUMP at least. Clips cover all frames in order."""
    frames = np.frombuffer(payload, dtype=np.uint8).reshape(-1, FRAME)
    n = len(frames)
    hist = np.empty((n, BINS), dtype=np.int64)
    for lo in range(0, n, HISTOGRAMS):
        part = frames[lo : lo + HISTOGRAMS]
        m = len(part)
        hist[lo : lo + m] = np.bincount((np.arange(m)[:, None] * BINS + (part >> 4)).ravel(), minlength=m * BINS).reshape(m, BINS)
    jump = np.abs(np.diff(hist, axis=0)).sum(axis=1) / (2 * FRAME)
    ones = np.concatenate([[0.0], np.cumsum(jump)])
    squares = np.concatenate([[0.0], np.cumsum(jump * jump)])
    hi = np.arange(len(jump))
    lo = np.maximum(0, hi - WINDOW)
    seen = np.maximum(1, hi - lo)
    mean = (ones[hi] - ones[lo]) / seen
    spread = np.sqrt(np.maximum(0, (squares[hi] - squares[lo]) / seen - mean * mean))
    cuts = np.flatnonzero(jump > np.maximum(LEAST_JUMP, mean + SENSITIVITY * spread)) + 1
    edges = [0, *cuts.tolist(), n]
    light = np.concatenate([[0], np.cumsum(frames.sum(axis=1, dtype=np.int64))])
    return [{"clip": k, "start_s": a / fps, "end_s": b / fps, "frames": b - a, "luma": float(light[b] - light[a]) / ((b - a) * FRAME)} for k, (a, b) in enumerate(zip(edges, edges[1:]))]


CLIPS = "array<struct<clip:int,start_s:double,end_s:double,frames:int,luma:double>>"


def store(data: Column) -> Column:
    """Binary column of AVI files that hold ``data`` (binary), padded. Null gives null."""

    @F.arrow_udf("binary")
    def avi(rows: pa.Array) -> pa.Array:
        return pa.array([None if r is None else write_avi(pad(r)) for r in values(rows)], type=pa.binary())

    return avi(data)


def load(media: Column) -> Column:
    """struct(payload binary, fps double, clips) read from AVI files; a broken file raises ValueError."""
    clip = pa.struct([("clip", pa.int32()), ("start_s", pa.float64()), ("end_s", pa.float64()), ("frames", pa.int32()), ("luma", pa.float64())])
    kind = pa.struct([("payload", pa.binary()), ("fps", pa.float64()), ("clips", pa.list_(clip))])

    @F.arrow_udf(f"struct<payload:binary,fps:double,clips:{CLIPS}>")
    def read(rows: pa.Array) -> pa.Array:
        out = []
        for media in values(rows):
            if media is None:
                out.append(None)
                continue
            payload, fps = read_avi(media)
            out.append({"payload": payload, "fps": fps, "clips": shots(payload, fps)})
        return pa.array(out, type=kind)

    return read(media)


def media_column(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_bytes, media, payload, clips), a row for each row of docs.

    Whole texts in UTF-8 (null: empty), padded, are stored as AVI and read back. Equal texts give equal
    values; repeated rows stay; an empty table stays empty. One pass without a shuffle.
    """
    raw = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    rows = docs.select(F.col(id_col), F.octet_length(raw).cast("long").alias("n_bytes"), store(raw).alias("media"))
    rows = rows.withColumn("_read", load(F.col("media")))
    return rows.select(id_col, "n_bytes", "media", F.col("_read.payload").alias("payload"), F.col("_read.clips").alias("clips"))


def clip_rows(media: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """A row for each clip of ``media_column``: id_col, clip, start_s, end_s, frames, luma."""
    return media.select(id_col, F.inline("clips"))
