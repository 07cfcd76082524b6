"""Blocks of documents as word codes, and the shuffle of their distinct words.

A block holds the documents of one task, up to a number of text bytes. Its row of kind DOCS keeps, for each document
in order, the codes of its words; a code is the word's rank by frequency in the block. Its rows of kind WORDS hold the
distinct words, one row per shard of a hash over all words, so that a word meets its like from all other blocks in
one shard. What a shard finds out about its words goes back to the blocks as arrays in the same order. A very
frequent word costs one entry per block, a document one code per word; arrays travel compressed.

The number of shards follows the bytes of text, and a shard's rows stream through its task, which keeps no more than the
shard's distinct words.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curatrix.llm.common import written

DOCS, WORDS = 0, 1
BLOCK_BYTES = 48 << 20
ROW = "kind int, block long, shard int, ids array<long>, flags binary, sizes binary, codes binary, shards binary, marks binary, words binary, marked binary"
_ARROW = pa.schema([("kind", pa.int32()), ("block", pa.int64()), ("shard", pa.int32()), ("ids", pa.list_(pa.int64())), *[(n, pa.binary()) for n in ("flags", "sizes", "codes", "shards", "marks", "words", "marked")]])


def pack(values: np.ndarray, level: int = 3) -> bytes:
    """Integers as compressed byte planes."""
    values = np.ascontiguousarray(values)
    width = values.dtype.itemsize
    planes = np.ascontiguousarray(values.view(np.uint8).reshape(-1, width).T)
    return values.dtype.str.encode().ljust(8) + zstandard.ZstdCompressor(level=level).compress(planes.tobytes())


def unpack(data: bytes) -> np.ndarray:
    kind = np.dtype(data[:8].decode().strip())
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data[8:]), np.uint8)
    return np.ascontiguousarray(raw.reshape(kind.itemsize, -1).T).view(kind).ravel()


def pack_words(words: list[bytes]) -> bytes:
    sizes = pack(np.array([len(w) for w in words], np.uint32))
    return len(sizes).to_bytes(8, "little") + sizes + zstandard.ZstdCompressor(level=3).compress(b"".join(words))


def unpack_words(data: bytes) -> list[bytes]:
    n = int.from_bytes(data[:8], "little")
    ends = np.cumsum(unpack(data[8 : 8 + n]), dtype=np.int64)
    text = zstandard.ZstdDecompressor().decompress(data[8 + n :])
    return [text[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)] if len(ends) else []


def gather(starts: np.ndarray, sizes: np.ndarray, flat: np.ndarray) -> np.ndarray:
    """The pieces flat[start : start + size], one after the other."""
    total = int(sizes.sum())
    at = np.cumsum(sizes) - sizes
    return flat[np.repeat(starts - at, sizes) + np.arange(total)]


class Codes(dict):
    """Word to code; a new word gets the next one."""

    def __missing__(self, word: bytes) -> int:
        code = self[word] = len(self)
        return code


def _block_rows(block: int, codes: Codes, docs: list[tuple], shards: int, mark, level: int) -> Iterator[pa.RecordBatch]:
    words = list(codes)
    parts = [d[2] for d in docs]
    every = np.concatenate(parts) if parts else np.empty(0, np.uint32)
    freq = np.bincount(every, minlength=len(words))
    of_marked = [d[2] for d in docs if d[1]]
    marked = np.bincount(np.concatenate(of_marked), minlength=len(words)) if of_marked else np.zeros(len(words), np.int64)
    order = np.argsort(-freq, kind="stable")
    rank = np.empty(len(words), np.uint32)
    rank[order] = np.arange(len(words), dtype=np.uint32)
    words, marked = [words[i] for i in order.tolist()], marked[order].astype(np.uint32)
    shard = np.array([zlib.crc32(w) % shards for w in words], np.uint32)
    by_shard = np.argsort(shard, kind="stable")
    found, first = np.unique(shard[by_shard], return_index=True)
    rows = [{"kind": DOCS, "block": block, "shard": -1, "ids": [d[0] for d in docs], "flags": pack(np.array([d[1] for d in docs], np.uint8)), "sizes": pack(np.array([len(p) for p in parts], np.uint32)), "codes": pack(rank[every], level), "shards": pack(shard), "marks": pack(mark(words)) if mark else None}]
    yield pa.RecordBatch.from_pylist(rows, _ARROW)
    rows = []
    edges = [*first.tolist(), len(words)]
    for s, a, b in zip(found.tolist(), edges[:-1], edges[1:], strict=True):
        at = by_shard[a:b]
        rows.append({"kind": WORDS, "block": block, "shard": s, "words": pack_words([words[i] for i in at.tolist()]), "marked": pack(marked[at])})
    if rows:
        yield pa.RecordBatch.from_pylist(rows, _ARROW)


def _builder(split: Callable[[], Callable[[bytes], list[bytes]]], shards: int, block_bytes: int, mark, level: int):
    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut = split()
        block, codes, docs, size = TaskContext.get().partitionId() << 24, Codes(), [], 0
        for batch in batches:
            ids, flags, data = batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).cast(pa.binary())
            for i, flag, text in zip(ids, flags, data, strict=True):
                text = text.as_py()
                words = cut(text)
                docs.append((i, flag, np.fromiter(map(codes.__getitem__, words), np.uint32, len(words))))
                size += len(text)
                if size >= block_bytes:
                    yield from _block_rows(block, codes, docs, shards, mark, level)
                    block, codes, docs, size = block + 1, Codes(), [], 0
        if docs:
            yield from _block_rows(block, codes, docs, shards, mark, level)

    return build


#: Bytes of text per shard, bounds of the number of shards, and shards per task, so that tasks are alike. More shards than
#: the upper bound would leave hardly a word of a block to each; a shard's rows stream, so that then only its reading
#: takes longer.
SHARD_BYTES, SHARDS, TASK = 2 << 20, (32, 1 << 16), 4


def shard_count(docs: DataFrame) -> int:
    """Shards for the texts of ``docs``, by one scan of their sizes."""
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    return min(max(-(-size // SHARD_BYTES), SHARDS[0]), SHARDS[1])


def by_shard(rows: DataFrame, shards: int, *order: str) -> DataFrame:
    """Rows of a shard in one task, shards one after the other."""
    return rows.repartition(shards // TASK, "shard").sortWithinPartitions("shard", *order)


def grouped(rows: DataFrame, shards: int):
    """Rows by block; as many tasks as the texts need."""
    return rows.repartition(shards // TASK, "block").groupBy("block")


def blocks(docs: DataFrame, split: Callable[[], Callable[[bytes], list[bytes]]], shards: int, block_bytes: int = BLOCK_BYTES, mark: Callable[[list[bytes]], np.ndarray] | None = None, level: int = 3) -> DataFrame:
    """Rows of kinds DOCS and WORDS, written once to the shared folder. ``docs`` has doc_id, flag and text; ``marked``
    counts each word in the documents whose flag is set. ``split`` makes the function that cuts a text's bytes; ``mark``
    gives numbers for a block's words, which its DOCS row keeps by code; ``level`` is the compression of codes."""
    return written(docs.select("doc_id", F.col("flag").cast("int"), "text").mapInArrow(_builder(split, shards, block_bytes, mark, level), ROW))


def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """The rows of sorted batches, one at a time."""
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.slice(i, 1).to_pylist()[0]


class Block:
    """A DOCS row with what came back about its words: ``spread`` puts arrays of all shards into the order of codes."""

    def __init__(self, row: dict):
        self.ids, self.flags = row["ids"], unpack(row["flags"]).astype(bool)
        self.sizes, self.codes = unpack(row["sizes"]).astype(np.int64), unpack(row["codes"])
        self.by_shard = np.argsort(unpack(row["shards"]), kind="stable")

    def spread(self, parts: list[np.ndarray]) -> np.ndarray:
        joined = np.concatenate(parts)
        out = np.empty(len(self.by_shard), joined.dtype)
        out[self.by_shard] = joined
        return out

    def documents(self) -> Iterator[tuple[int | None, bool, np.ndarray]]:
        ends = np.cumsum(self.sizes)
        for i, flag, a, b in zip(self.ids, self.flags.tolist(), (ends - self.sizes).tolist(), ends.tolist(), strict=True):
            yield i, flag, self.codes[a:b]
