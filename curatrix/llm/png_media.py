"""Media columns: texts stored as 8-bit greyscale PNG, read back chunk by chunk, and hashed by low cosine frequencies.

A payload of a positive multiple of 192 bytes is an image 192 pixels wide. Each row takes filter none, left or up,
whichever has the smallest sum of absolute differences; the reader understands all five filters. Every chunk's
checksum is tested on reading.

Defined cases: null and empty texts give a payload of 192 spaces; a very long text is one tall image; where filters cost
the same the first counts; repeated rows give repeated results; null ids are kept; an empty table gives an empty result;
other columns, of whatever names, are ignored. Tasks hold a few rows or PART bytes at a time, and one image at least.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from curatrix.llm.common import texts

#: Columns of an image; rows, and bytes, that a task works on at a time.
WIDTH, ROWS, PART = 192, 256, 8 << 20
#: Fixed values of the PNG format.
SIGNATURE = b"\x89PNG\r\n\x1a\n"
MEDIA = "doc_id long, n_bytes long, media binary"
FEATURES = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(data, zlib.crc32(kind)))


def payload_of(data: bytes) -> bytes:
    return data + b" " * ((-len(data)) % WIDTH if data else WIDTH)


def encode_png(payload: bytes, level: int = 4) -> bytes:
    """A greyscale image of WIDTH columns."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    options = np.zeros((3, *rows.shape), np.uint8)
    options[0] = rows
    options[1] = rows
    options[1, :, 1:] -= rows[:, :-1]
    options[2] = rows
    options[2, 1:] -= rows[:-1]
    cost = np.abs(options.view(np.int8).astype(np.int16)).sum(axis=2, dtype=np.int32)
    kinds = cost.argmin(axis=0)
    lines = np.empty((len(rows), WIDTH + 1), np.uint8)
    lines[:, 0] = kinds
    lines[:, 1:] = options[kinds, np.arange(len(rows))]
    header = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", header) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), level)) + _chunk(b"IEND", b"")


def unfilter(lines: np.ndarray, bpp: int = 1) -> np.ndarray:
    """Samples of filtered scan lines (first column: filter kind); rows that don't look up are undone at once, runs
    of rows filtered by the row above by one running sum."""
    kinds, out = lines[:, 0], lines[:, 1:].copy()
    if kinds.size and kinds.max() > 4:
        raise ValueError("unknown PNG filter")
    left = kinds == 1
    if left.any():
        part = out[left].reshape(left.sum(), -1, bpp)
        out[left] = np.cumsum(part, axis=1, dtype=np.uint8).reshape(part.shape[0], -1)
    i, n = 0, len(out)
    todo = np.flatnonzero(kinds >= 2)
    k = 0
    while k < len(todo):
        i = todo[k]
        above = out[i - 1] if i else np.zeros(out.shape[1], np.uint8)
        if kinds[i] == 2:
            j = i
            while j + 1 < n and kinds[j + 1] == 2:
                j += 1
            out[i] += above
            out[i : j + 1] = np.cumsum(out[i : j + 1], axis=0, dtype=np.uint8)
            k += j - i + 1
            continue
        row = out[i].astype(int)
        for x in range(out.shape[1]):
            a, b, c = (row[x - bpp] if x >= bpp else 0), int(above[x]), (int(above[x - bpp]) if x >= bpp else 0)
            if kinds[i] == 3:
                guess = (a + b) // 2
            else:
                p = a + b - c
                guess = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
            row[x] = (row[x] + guess) & 255
        out[i] = row
        k += 1
    return out


def decode_png(media: bytes) -> np.ndarray:
    """Rows of 8-bit greyscale samples; raises ValueError on a bad signature, checksum or layout."""
    if media[:8] != SIGNATURE:
        raise ValueError("no PNG signature")
    at, parts, size = 8, [], None
    while at < len(media):
        (length,) = struct.unpack_from(">I", media, at)
        kind, data = media[at + 4 : at + 8], media[at + 8 : at + 8 + length]
        if len(data) != length or struct.unpack_from(">I", media, at + 8 + length)[0] != zlib.crc32(data, zlib.crc32(kind)):
            raise ValueError("bad PNG checksum")
        if kind == b"IHDR":
            size = struct.unpack(">IIBBBBB", data)
            if size[2:] != (8, 0, 0, 0, 0):
                raise ValueError("only 8-bit greyscale without interlace")
        elif kind == b"IDAT":
            parts.append(data)
        elif kind == b"IEND":
            break
        at += 12 + length
    if size is None:
        raise ValueError("no PNG header")
    lines = np.frombuffer(zlib.decompress(b"".join(parts)), np.uint8).reshape(size[1], size[0] + 1)
    return unfilter(lines)


_SIDE, _LOW = 32, 8
_k = np.arange(_SIDE)
_COSINE = np.cos(np.pi * np.outer(np.arange(_LOW), 2 * _k + 1) / (2 * _SIDE))


def cosine_hash(samples: np.ndarray) -> str:
    """64 bits: the image as 32 x 32 block means, the lowest 8 x 8 cosine frequencies, each against their median."""

    def means(x: np.ndarray) -> np.ndarray:
        n = x.shape[0]
        edge = np.arange(_SIDE + 1) * n / _SIDE
        total = np.vstack([np.zeros((1, x.shape[1])), np.cumsum(x, axis=0)])
        low = np.minimum(edge.astype(int), n)
        part = edge - low
        upto = total[low] + part[:, None] * (total[np.minimum(low + 1, n)] - total[low])
        return np.diff(upto, axis=0) * _SIDE / n

    small = means(means(samples.astype(np.float64)).T).T
    low = np.round((_COSINE @ small @ _COSINE.T).ravel(), 6)
    bits = low > np.median(low[1:])
    return np.packbits(bits).tobytes().hex()


def _parts(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[pa.RecordBatch]:
    """Slices of few rows and, by the sizes in the column, not many bytes."""
    for batch in batches:
        sizes = pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False)
        start = 0
        while start < batch.num_rows:
            upto = np.cumsum(sizes[start : start + ROWS], dtype=np.int64)
            n = max(1, int(np.searchsorted(upto, PART, side="right")))
            yield batch.slice(start, n)
            start += n


def _store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in _parts(batches, 1):
        data = part.column(1).cast(pa.binary()).to_pylist()
        yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(x) for x in data], pa.int64()), pa.array([encode_png(payload_of(x)) for x in data], pa.binary())], names=["doc_id", "n_bytes", "media"])


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in _parts(batches, 2):
        rows: list[tuple] = []
        for media in part.column(2):
            media = media.as_py()
            samples = decode_png(media)
            payload = samples.tobytes()
            rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(media), hashlib.sha256(media).hexdigest(), cosine_hash(samples)))
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
        yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *[pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]], names=["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])


def media_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes and the PNG in a binary column; writes losslessly to any binary-capable table."""
    return texts(docs, id_col, text_col).mapInArrow(_store, MEDIA)


def media_features(media: DataFrame) -> DataFrame:
    """What reading the stored images gives: checks, digests and the cosine hash."""
    return media.mapInArrow(_read, FEATURES)
