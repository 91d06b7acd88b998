"""Media columns: motion-JPEG in AVI, written, parsed, decoded and cut into shots.

Frames are lossless JPEG (process SOF3: 8-bit samples, one component, left predictor), so bytes
stored as samples come back unchanged.  An AVI file holds them as ``00dc`` chunks with an
``idx1`` index, which is what the reader goes by.  All frames of a slice are coded together:
the encoder packs the bits of all samples at once, the decoder takes one sample of every frame
per step.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from pricetide.llm.common import slices, tidy

WIDTH = HEIGHT = 24
FRAME = WIDTH * HEIGHT
RATE = 25  # frames a second
#: Code lengths of the difference categories 0-8 (differences of bytes mod 256, as -128..127).
_CATEGORIES = 9
_CODE_BITS = 4

# fixed values of the file formats
_SOI, _EOI = b"\xff\xd8", b"\xff\xd9"
#: One Huffman table: nine codes of four bits, for the categories in order.
_DHT = b"\xff\xc4" + struct.pack(">HB16s", 19 + _CATEGORIES, 0, bytes([0, 0, 0, _CATEGORIES] + [0] * 12)) + bytes(range(_CATEGORIES))
_SOF3 = b"\xff\xc3" + struct.pack(">HBHHBBBB", 11, 8, HEIGHT, WIDTH, 1, 1, 0x11, 0)
_SOS = b"\xff\xda" + struct.pack(">HBBBBBB", 8, 1, 1, 0x00, 1, 0, 0)
_HEAD = _SOI + _DHT + _SOF3 + _SOS


def _predictions(frames: np.ndarray) -> np.ndarray:
    """Left neighbour; in the first column the one above; 128 for the first sample."""
    out = np.empty_like(frames)
    out[:, :, 1:] = frames[:, :, :-1]
    out[:, 1:, 0] = frames[:, :-1, 0]
    out[:, 0, 0] = 128
    return out


def encode_frames(samples: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entropy-coded data of frames (n x 576 bytes): all bytes in a row, and the end of each frame's."""
    n = len(samples)
    frames = samples.reshape(n, HEIGHT, WIDTH)
    diff = (frames - _predictions(frames)).view(np.int8).astype(np.int32).ravel()
    category = np.frexp(np.abs(diff).astype(np.float32))[1].astype(np.int32)  # bits of the magnitude
    extra = np.where(diff < 0, diff + (1 << category) - 1, diff)
    code = (category << category) | extra
    bits = (category + _CODE_BITS).reshape(n, FRAME)
    ends = np.cumsum(bits, axis=1)
    size = -(-ends[:, -1] // 8)
    base = np.cumsum(size) - size
    at = (base[:, None] * 8 + ends - bits).ravel()
    # each code lies within three bytes; disjoint bits, so sums are unions
    shifted = code << (24 - bits.ravel() - (at & 7))
    where, total = at >> 3, int(size.sum())
    raw = sum(np.bincount(where + k, (shifted >> (16 - 8 * k)) & 255, total + 3)[:total] for k in range(3)).astype(np.uint8)
    spare = 8 * size - ends[:, -1]
    raw[base + size - 1] |= ((1 << spare) - 1).astype(np.uint8)  # the last byte is filled with ones
    full = np.flatnonzero(raw == 255)
    stuffed = np.insert(raw, full + 1, 0)
    stop = base + size
    return stuffed, stop + np.searchsorted(full, stop)


def decode_frames(scans: list[bytes]) -> np.ndarray:
    """Samples (n x 576) from the frames' entropy-coded data."""
    n = len(scans)
    plain = [x.replace(b"\xff\x00", b"\xff") for x in scans]
    size = np.fromiter(map(len, plain), np.int64, n)
    raw = np.frombuffer(b"".join(plain) + b"\xff\xff\xff", np.uint8).astype(np.int32)
    # 24 bits from each byte on
    window = (raw[:-2] << 16) | (raw[1:-1] << 8) | raw[2:]
    at = (np.cumsum(size) - size) * 8
    out = np.empty((FRAME, n), np.uint8)
    for k in range(FRAME):
        have = window[at >> 3] << (at & 7)
        category = (have >> 20) & 15
        value = ((have & 0xFFFFF) >> (20 - category)).astype(np.int32)
        diff = np.where((category > 0) & (value < (1 << category >> 1)), value - (1 << category) + 1, value)
        before = 128 if k == 0 else out[k - WIDTH] if k % WIDTH == 0 else out[k - 1]
        out[k] = (before + diff) & 255
        at = at + _CODE_BITS + category
    return np.ascontiguousarray(out.T)


def _chunk(name: bytes, body: bytes) -> bytes:
    return name + struct.pack("<I", len(body)) + body + b"\0" * (len(body) & 1)


def avi(frames: list[bytes]) -> bytes:
    """An AVI file of JPEG frames with its index."""
    largest = max(map(len, frames))
    avih = struct.pack("<14I", 1_000_000 // RATE, largest * RATE, 0, 0x10, len(frames), 0, 1, largest, WIDTH, HEIGHT, 0, 0, 0, 0)
    strh = struct.pack("<4s4sI2H8I4H", b"vids", b"MJPG", 0, 0, 0, 0, 1, RATE, 0, len(frames), largest, 0xFFFFFFFF, 0, 0, 0, WIDTH, HEIGHT)
    strf = struct.pack("<IiiHH4sIiiII", 40, WIDTH, HEIGHT, 1, 8, b"MJPG", FRAME, 0, 0, 0, 0)
    hdrl = _chunk(b"LIST", b"hdrl" + _chunk(b"avih", avih) + _chunk(b"LIST", b"strl" + _chunk(b"strh", strh) + _chunk(b"strf", strf)))
    movi, index, at = [b"movi"], [], 4
    for f in frames:
        piece = _chunk(b"00dc", f)
        index.append(struct.pack("<4s3I", b"00dc", 0x10, at, len(f)))
        movi.append(piece)
        at += len(piece)
    body = b"AVI " + hdrl + _chunk(b"LIST", b"".join(movi)) + _chunk(b"idx1", b"".join(index))
    return _chunk(b"RIFF", body)


def read_avi(data: bytes) -> list[bytes]:
    """The frames that the index lists, in its order."""
    if data[:4] != b"RIFF" or data[8:12] != b"AVI ":
        raise ValueError("not an AVI file")
    at, movi, index = 12, None, None
    while at + 8 <= len(data):
        name, size = data[at : at + 4], struct.unpack_from("<I", data, at + 4)[0]
        if name == b"LIST" and data[at + 8 : at + 12] == b"movi":
            movi = at + 8
        elif name == b"idx1":
            index = (at + 8, size // 16)
        at += 8 + size + (size & 1)
    if movi is None or index is None:
        raise ValueError("an AVI file without frames or index")
    out = []
    for k in range(index[1]):
        name, _, offset, size = struct.unpack_from("<4s3I", data, index[0] + 16 * k)
        if name[2:] in (b"dc", b"db"):
            begin = movi + offset + 8
            out.append(data[begin : begin + size])
    return out


def scan_of(frame: bytes) -> bytes:
    """The entropy-coded data of a frame: markers are walked to the start of scan."""
    at = 2
    while frame[at + 1] != 0xDA:
        at += 2 + struct.unpack_from(">H", frame, at + 2)[0]
    return frame[at + 2 + struct.unpack_from(">H", frame, at + 2)[0] : -2]


def shots_of(frames: np.ndarray, bins: int = 16, reach: int = 8, factor: float = 2.0, floor: float = 0.15) -> list[tuple[int, int]]:
    """Shots as (first, last + 1) frame.  A cut lies where the histogram differs from the last frame's
    by more than ``floor`` and more than ``factor`` times the mean difference of the ``reach`` frames
    around on each side."""
    n = len(frames)
    level = frames // (256 // bins)
    counts = np.bincount((np.arange(n)[:, None] * bins + level).ravel(), minlength=n * bins).reshape(n, bins)
    change = np.abs(np.diff(counts, axis=0)).sum(axis=1) / (2 * FRAME)
    total = np.concatenate(([0.0], np.cumsum(change)))
    at = np.arange(len(change))
    low, high = np.maximum(0, at - reach), np.minimum(len(change), at + reach + 1)
    around = (total[high] - total[low] - change) / np.maximum(1, high - low - 1)
    cuts = (np.flatnonzero((change > floor) & (change > factor * around)) + 1).tolist()
    return list(zip([0, *cuts], [*cuts, n], strict=True))


_CLIP = T.StructType().add("shot", T.IntegerType()).add("first_frame", T.IntegerType()).add("n_frames", T.IntegerType()).add("start_ms", T.LongType()).add("end_ms", T.LongType()).add("mean_level", T.DoubleType())


def store(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", media_col: str = "media") -> DataFrame:
    """(id, n_bytes, media): each text's UTF-8 bytes, filled with 255 to a positive multiple of 576, as
    the frames of an AVI file.  Null counts as empty; every row stays; other columns are not read."""
    id_type = df.schema[id_col].dataType
    out = T.StructType([T.StructField(id_col, id_type), T.StructField("n_bytes", T.LongType()), T.StructField(media_col, T.BinaryType())])
    kind = to_arrow_type(id_type)

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, text_col, 1 << 21):
            raw = [x or b"" for x in part.column(text_col).cast(pa.binary()).to_pylist()]
            counts = [max(1, -(-len(x) // FRAME)) for x in raw]
            payload = b"".join(x.ljust(c * FRAME, b"\xff") for x, c in zip(raw, counts, strict=True))
            data, ends = encode_frames(np.frombuffer(payload, np.uint8).reshape(-1, FRAME))
            data, ends = data.tobytes(), [0, *ends.tolist()]
            media, k = [], 0
            for c in counts:
                media.append(avi([_HEAD + data[ends[j] : ends[j + 1]] + _EOI for j in range(k, k + c)]))
                k += c
            yield pa.RecordBatch.from_arrays([part.column(id_col).cast(kind), pa.array([len(x) for x in raw], pa.int64()), pa.array(media, pa.binary())], names=out.names)

    return df.select(id_col, text_col).mapInArrow(run, out)


def load(df: DataFrame, media_col: str = "media") -> DataFrame:
    """``df`` with ``payload`` (all samples read back, in order) and ``clips`` (timed shots) added.
    Null media give null; columns named like an added one are replaced."""
    df = df.drop("payload", "clips")
    added = [T.StructField("payload", T.BinaryType()), T.StructField("clips", T.ArrayType(_CLIP))]
    out = T.StructType([*df.schema.fields, *added])
    clip_kind = to_arrow_type(T.ArrayType(_CLIP))

    def clips_of(frames: np.ndarray) -> list[dict]:
        return [{"shot": s, "first_frame": a, "n_frames": b - a, "start_ms": a * 1000 // RATE, "end_ms": b * 1000 // RATE, "mean_level": round(float(frames[a:b].mean()), 3)} for s, (a, b) in enumerate(shots_of(frames))]

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, media_col, 1 << 22):
            files = [None if x is None else read_avi(x) for x in part.column(media_col).to_pylist()]
            scans = [scan_of(f) for x in files if x for f in x]
            samples = decode_frames(scans) if scans else np.zeros((0, FRAME), np.uint8)
            payload, clips, k = [], [], 0
            for x in files:
                frames = samples[k : k + len(x)] if x else samples[:0]
                k += len(frames)
                payload.append(None if x is None else frames.tobytes())
                clips.append(None if x is None else clips_of(frames) if len(frames) else [])
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(payload, pa.binary()), pa.array(clips, clip_kind)], names=out.names)

    return df.mapInArrow(run, out)
