"""AVI motion-JPEG columns: writing, reading by index, decoding frames, finding shots.

A payload of bytes is stored as grey frames of 24 x 24 samples, each a lossless
JPEG image (process 14, first predictor: a sample is predicted by its left
neighbour, in the first column by the one above, at the start by 128), in the
``movi`` list of a RIFF/AVI file with an ``idx1`` index.  The Huffman table is
such that code and extra bits of every sample take 16 bits together, so that
whole frames decode by one table look-up; images with any other table of one
scan and one component are decoded code by code.

Shots: histograms of ``LEVELS`` grey levels of neighbouring frames differ by
the sum of absolute differences; a shot begins where the difference exceeds the
mean by ``STEEP`` standard deviations of the ``AROUND`` frames on either side
and ``LEAST`` of the samples.

Defined results: a null text is an empty one; an empty payload is one frame of
padding; bytes that are no such AVI file raise ``ValueError``; an index entry
that points outside the file raises too; equal payloads give equal files.
"""

from __future__ import annotations

import functools
import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import small_batches

SIDE = 24
FRAME = SIDE * SIDE
FPS = 25
LEVELS, AROUND, STEEP, LEAST = 32, 8, 2.0, 0.15
#: Lengths of the codes of the categories 8, 7, ... 0: with the category's extra bits always 16.
LENGTHS = {8 - i: 8 + i for i in range(9)}


def _huffman(counts, categories):
    """(code, length) of each category, in the canonical order of a JPEG table."""
    code, codes, at = 0, {}, 0
    for length, n in enumerate(counts, 1):
        for _ in range(n):
            codes[categories[at]] = (code, length)
            code, at = code + 1, at + 1
        code <<= 1
    return codes


def _own_table():
    categories = sorted(LENGTHS, key=LENGTHS.get)
    return [sum(v == i for v in LENGTHS.values()) for i in range(1, 17)], categories


@functools.cache
def _words() -> np.ndarray:
    """The 16 bits of each difference from -255 to 255."""
    codes = _huffman(*_own_table())
    table = np.zeros(511, np.uint16)
    for d in range(-255, 256):
        size = abs(d).bit_length()
        code, _ = codes[size]
        table[d + 255] = code << size | (d if d >= 0 else d + (1 << size) - 1)
    return table


@functools.cache
def _head() -> bytes:
    counts, categories = _own_table()
    part = lambda mark, body: b"\xff" + bytes([mark]) + struct.pack(">H", len(body) + 2) + body
    return b"\xff\xd8" + part(0xC4, bytes([0, *counts, *categories])) + part(0xC3, struct.pack(">BHHB3B", 8, SIDE, SIDE, 1, 1, 0x11, 0)) + part(0xDA, bytes([1, 1, 0, 1, 0, 0]))


def encode_frames(payload: bytes) -> list[bytes]:
    """A JPEG image for every ``FRAME`` bytes."""
    x = np.frombuffer(payload, np.uint8).reshape(-1, SIDE, SIDE).astype(np.int16)
    d = np.empty_like(x)
    d[:, :, 1:] = x[:, :, 1:] - x[:, :, :-1]
    d[:, 1:, 0] = x[:, 1:, 0] - x[:, :-1, 0]
    d[:, 0, 0] = x[:, 0, 0] - 128
    scans = _words()[d.reshape(len(x), -1) + 255].astype(">u2").tobytes()
    size = 2 * FRAME
    return [_head() + scans[i : i + size].replace(b"\xff", b"\xff\x00") + b"\xff\xd9" for i in range(0, len(scans), size)]


@functools.lru_cache(maxsize=64)
def _image(head: bytes):
    """Height, width and look-up tables (difference, bits) over 16 bits of an image's head."""
    at, shape, codes = 2, None, None
    while at < len(head):
        mark, size = head[at + 1], struct.unpack(">H", head[at + 2 : at + 4])[0]
        body = head[at + 4 : at + 2 + size]
        if mark == 0xC4:
            counts = list(body[1:17])
            codes = _huffman(counts, list(body[17 : 17 + sum(counts)]))
        elif mark == 0xC3:
            _, height, width, n = struct.unpack(">BHHB", body[:6])
            shape = (height, width) if n == 1 else None
        at += 2 + size
    if not shape or not codes:
        raise ValueError("not a lossless grey JPEG image")
    value, bits = np.zeros(1 << 16, np.int32), np.zeros(1 << 16, np.int32)
    for size, (code, length) in codes.items():
        if length + size > 16:
            raise ValueError("codes of more than 16 bits with their extra bits")
        span = 1 << (16 - length)
        extra = np.arange(span) >> (16 - length - size)
        low = (1 << size) >> 1
        begin = code << (16 - length)
        value[begin : begin + span] = np.where(extra >= low, extra, extra - (1 << size) + 1) if size else 0
        bits[begin : begin + span] = length + size
    return shape, value, bits


def _differences(scan: bytes, n: int, value, bits) -> np.ndarray:
    if len(scan) >= 2 * n:
        words = np.frombuffer(scan, ">u2", n)
        if (bits[words] == 16).all():
            return value[words]
    number, left, out = int.from_bytes(scan + b"\0\0", "big"), 8 * len(scan), []
    for _ in range(n):
        word = number >> left & 0xFFFF if left >= 0 else 0
        if left < 0 or not bits[word]:
            raise ValueError("broken scan")
        out.append(value[word])
        left -= int(bits[word])
    return np.array(out)


def decode_frames(images: list[bytes]) -> np.ndarray:
    """The samples of images of one size, as frames x height x width."""
    heads, ds = [], []
    for image in images:
        start = image.find(b"\xff\xda")
        start += 2 + struct.unpack(">H", image[start + 2 : start + 4])[0] if start >= 0 else 0
        shape, value, bits = _image(image[:start])
        heads.append(shape)
        ds.append(_differences(image[start : image.rindex(b"\xff\xd9")].replace(b"\xff\x00", b"\xff"), shape[0] * shape[1], value, bits))
    d = np.array(ds, np.int64).reshape(len(images), *heads[0])
    d[:, 0, 0] += 128
    d[:, :, 0] = np.cumsum(d[:, :, 0], 1)
    return np.cumsum(d, 2).astype(np.uint8)


def write_avi(images: list[bytes], fps: int = FPS, side: int = SIDE) -> bytes:
    chunk = lambda name, body: name + struct.pack("<I", len(body)) + body + b"\0" * (len(body) & 1)
    movi, index = [b"movi"], []
    at = 4
    for image in images:
        made = chunk(b"00dc", image)
        index.append(struct.pack("<4sIII", b"00dc", 0x10, at, len(image)))
        movi.append(made)
        at += len(made)
    n, largest = len(images), max(map(len, images), default=0)
    avih = struct.pack("<14I", 1_000_000 // fps, largest * fps, 0, 0x10, n, 0, 1, largest, side, side, 0, 0, 0, 0)
    strh = struct.pack("<4s4sIHHIIIIIIII4H", b"vids", b"MJPG", 0, 0, 0, 0, 1, fps, 0, n, largest, 0xFFFFFFFF, 0, 0, 0, side, side)
    strf = struct.pack("<IiiHH4sIiiII", 40, side, side, 1, 8, b"MJPG", FRAME, 0, 0, 0, 0)
    hdrl = b"hdrl" + chunk(b"avih", avih) + chunk(b"LIST", b"strl" + chunk(b"strh", strh) + chunk(b"strf", strf))
    return chunk(b"RIFF", b"AVI " + chunk(b"LIST", hdrl) + chunk(b"LIST", b"".join(movi)) + chunk(b"idx1", b"".join(index)))


def read_avi(data: bytes) -> tuple[list[bytes], float]:
    """The images that the index names, in its order, and frames a second."""
    if data[:4] != b"RIFF" or data[8:12] != b"AVI ":
        raise ValueError("not an AVI file")
    at, fps, movi, index = 12, float(FPS), None, None
    while at + 8 <= len(data):
        name, size = data[at : at + 4], struct.unpack("<I", data[at + 4 : at + 8])[0]
        body = at + 8
        if name == b"LIST" and data[body : body + 4] == b"hdrl":
            found = data.find(b"strh", body, body + size)
            if found >= 0:
                scale, rate = struct.unpack("<II", data[found + 28 : found + 36])
                fps = rate / scale if scale else fps
        elif name == b"LIST" and data[body : body + 4] == b"movi":
            movi = body
        elif name == b"idx1":
            index = data[body : body + size]
        at = body + size + (size & 1)
    if movi is None or index is None or len(index) % 16:
        raise ValueError("an AVI file without frames or whole index")
    images = []
    for name, _, offset, size in struct.iter_unpack("<4sIII", index):
        if name[2:] in (b"dc", b"db"):
            begin = movi + offset + 8
            if begin + size > len(data):
                raise ValueError("an index entry outside the file")
            images.append(data[begin : begin + size])
    return images, fps


def shot_starts(frames: np.ndarray) -> list[int]:
    """Numbers of the frames that begin a shot."""
    n = len(frames)
    if n < 2:
        return list(range(n))
    flat = frames.reshape(n, -1)
    bins = (flat.astype(np.int64) * LEVELS >> 8) + np.arange(n)[:, None] * LEVELS
    histogram = np.bincount(bins.ravel(), minlength=n * LEVELS).reshape(n, LEVELS)
    d = np.abs(np.diff(histogram, axis=0)).sum(1) / (2 * flat.shape[1])
    sums = lambda x: np.r_[0.0, np.cumsum(x)]
    low, high = np.maximum(0, np.arange(n - 1) - AROUND), np.minimum(n - 1, np.arange(n - 1) + AROUND + 1)
    many = high - low
    mean = (sums(d)[high] - sums(d)[low]) / many
    spread = np.sqrt(np.maximum(0, (sums(d * d)[high] - sums(d * d)[low]) / many - mean**2))
    return [0, *(np.flatnonzero((d > mean + STEEP * spread + 1e-12) & (d > LEAST)) + 1).tolist()]


def pack(body: bytes) -> bytes:
    """A text's bytes padded by 255 to whole frames, as an AVI file."""
    return write_avi(encode_frames(body + b"\xff" * (FRAME * max(1, -(-len(body) // FRAME)) - len(body))))


def clips(df: DataFrame, key: str = "doc_id", media: str = "media") -> DataFrame:
    """A row for each shot of each AVI file: ``clip, first_frame, n_frames, start_s, end_s``; null files have none."""
    kind = df.schema[key].dataType.simpleString()

    def mapper(batches):
        for batch in batches:
            rows = []
            for k, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if data is None:
                    continue
                images, fps = read_avi(data)
                starts = shot_starts(decode_frames(images)) if images else []
                for i, (a, b) in enumerate(zip(starts, [*starts[1:], len(images)], strict=True)):
                    rows.append((k, i, a, b - a, a / fps, b / fps))
            columns = list(zip(*rows, strict=True)) or [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, (batch.schema.types[0], pa.int32(), pa.int32(), pa.int32(), pa.float64(), pa.float64()), strict=True)], names=[key, "clip", "first_frame", "n_frames", "start_s", "end_s"])

    return small_batches(df).select(key, media).mapInArrow(mapper, f"`{key}` {kind}, clip int, first_frame int, n_frames int, start_s double, end_s double")


def stored(docs: DataFrame) -> DataFrame:
    """``doc_id, n_bytes, media``: each text as an AVI file."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def mapper(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                part = batch.slice(start, 500)
                bodies = [(t or "").encode() for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(list(map(len, bodies)), pa.int64()), pa.array(list(map(pack, bodies)), pa.binary())], names=["doc_id", "n_bytes", "media"])

    return small_batches(docs).select("doc_id", "text").mapInArrow(mapper, f"doc_id {kind}, n_bytes long, media binary")


def digests(media: DataFrame) -> DataFrame:
    """What the stored bytes of ``media`` say when they are read back, with a summary of their shots as ``feature``."""
    kind = media.schema["doc_id"].dataType.simpleString()
    names = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]

    def mapper(batches):
        for batch in batches:
            rows = []
            for data in batch.column(2).to_pylist():
                images, fps = read_avi(data)
                frames = decode_frames(images)
                payload = frames.tobytes()
                starts = shot_starts(frames)
                seconds = ",".join(f"{s / fps:.2f}" for s in starts)
                rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(data), hashlib.sha256(data).hexdigest(), f"frames={len(images)};shots={len(starts)};mean={frames.mean():.4f};starts={seconds}"))
            columns = list(zip(*rows, strict=True)) or [[]] * 6
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(list(c), t) for c, t in zip(columns, kinds, strict=True))], names=["doc_id", "n_bytes", *names])

    return small_batches(media).select("doc_id", "n_bytes", "media").mapInArrow(mapper, f"doc_id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
