"""Byte-level BPE encoding and decoding by a global shuffle of distinct words.

Texts are cut into pre-tokens by the published pattern; the positions of a document's words are kept as arrays of codes.
Each block's distinct words go to shards by a hash, where each distinct word of the corpus is encoded once; the ids
join the blocks again and are put together by position. Decoding is a map-side join of every id with the token-byte table,
which is sent out; its size is that of the vocabulary file. Rows of one position each would be several times the input on
disk (README), so positions and ids travel as arrays.

Defined cases: null text counts as empty and gives no ids; a very long text is part of one block; repeated rows give
repeated results; rows with a null id are kept; an empty table gives an empty result; other columns, of whatever names,
are ignored. Special tokens' strings are ordinary text.
"""

from __future__ import annotations

import base64
import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curatrix.llm.common import texts
from curatrix.llm.word_blocks import DOCS, WORDS, Block, blocks, by_shard, gather, grouped, pack, runs, shard_count, unpack, unpack_words

#: Characters of Unicode property White_Space, as the tokenizer's pattern language understands \s.
_SPACE = r"\t-\r \x85\xa0  -     　"


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def default_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


@functools.lru_cache(maxsize=4)
def ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


def spaced(pattern: str) -> str:
    """The pattern with \\s and \\S written out as characters of White_Space."""
    return pattern.replace(r"[^\s", f"[^{_SPACE}").replace(r"\S", f"[^{_SPACE}]").replace(r"\s", f"[{_SPACE}]")


def splitter(pattern: str):
    """Cuts a text's bytes into pre-tokens."""

    def make():
        find = regex.compile(spaced(pattern)).findall
        return lambda data: [w.encode() for w in find(data.decode("utf-8", "replace"))] if not data.isascii() else [w.encode("ascii") for w in find(data.decode("ascii"))]

    return make


@functools.lru_cache(maxsize=4)
def _encoder(path: str, pattern: str):
    import tiktoken

    return tiktoken.Encoding("vocabulary", pat_str=pattern, mergeable_ranks=ranks(path), special_tokens={})


def _encode_shards(path: str, pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, shard, known = _encoder(path, pattern).encode_ordinary, None, {}
        for row in runs(batches):
            if row["shard"] != shard:
                shard, known = row["shard"], {}
            ids = []
            for w in unpack_words(row["words"]):
                got = known.get(w)
                if got is None:
                    got = known[w] = encode(w.decode())
                ids.append(got)
            sizes = pack(np.array([len(x) for x in ids], np.uint32))
            flat = pack(np.array([y for x in ids for y in x], np.uint32))
            yield pa.RecordBatch.from_arrays([pa.array([row["block"]], pa.int64()), pa.array([shard], pa.int32()), pa.array([sizes], pa.binary()), pa.array([flat], pa.binary())], names=["block", "shard", "sizes", "flat"])

    return run


def token_bytes(path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The token-byte table: start and size of each id's bytes, and all bytes."""
    table = ranks(path)
    tokens = [b""] * (max(table.values()) + 1)
    for token, rank in table.items():
        tokens[rank] = token
    sizes = np.array([len(t) for t in tokens], np.int64)
    return np.cumsum(sizes) - sizes, sizes, np.frombuffer(b"".join(tokens), np.uint8)


def decode(ids: np.ndarray, table: tuple[np.ndarray, np.ndarray, np.ndarray]) -> bytes:
    starts, sizes, flat = table
    return gather(starts[ids], sizes[ids], flat).tobytes()


def _reassemble(tokens, result, kinds: dict[str, pa.DataType]):
    """One row of a document's id and ``result`` for each document of a block."""

    def run(docs: pa.Table, words: pa.Table) -> pa.Table:
        rows, table = [], tokens.value
        for row in docs.to_pylist():
            block = Block(row)
            parts = sorted(zip(words.column("shard").to_pylist(), words.column("sizes").to_pylist(), words.column("flat").to_pylist(), strict=True))
            sizes = [unpack(p[1]).astype(np.int64) for p in parts]
            if sizes:
                joined = np.concatenate(sizes)
                size_of, start_of = block.spread(sizes), block.spread([np.cumsum(joined) - joined])
                flat = np.concatenate([unpack(p[2]) for p in parts])
            for i, _, codes in block.documents():
                ids = gather(start_of[codes], size_of[codes], flat) if len(codes) else np.empty(0, np.uint32)
                rows.append((i, *result(ids, decode(ids, table))))
        return pa.table({n: pa.array([r[k] for r in rows], t) for k, (n, t) in enumerate(kinds.items())})

    return run


def _run(docs: DataFrame, path: str | None, pattern: str | None, id_col: str, text_col: str, result, schema: str, kinds: dict[str, pa.DataType]) -> DataFrame:
    path, pattern = path or default_path(), pattern or default_pattern()
    plain = texts(docs, id_col, text_col)
    shards = shard_count(plain)
    parts = blocks(plain.withColumn("flag", F.lit(True)), splitter(pattern), shards, level=9)
    # the vocabulary bounds the table
    tokens = docs.sparkSession.sparkContext.broadcast(token_bytes(path))
    encoded = by_shard(parts.where(F.col("kind") == WORDS).select("block", "shard", "words"), shards).mapInArrow(_encode_shards(path, pattern), "block long, shard int, sizes binary, flat binary")
    kept = parts.where(F.col("kind") == DOCS).select("block", "ids", "flags", "sizes", "codes", "shards")
    return grouped(kept, shards).cogroup(grouped(encoded, shards)).applyInArrow(_reassemble(tokens, result, kinds), schema)


def _digest(ids: np.ndarray, decoded: bytes) -> tuple:
    return len(ids), hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest(), hashlib.sha256(decoded).hexdigest()


def encoded(docs: DataFrame, path: str | None = None, pattern: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids, and the bytes that decoding the ids gives."""
    kinds = {"doc_id": pa.int64(), "ids": pa.list_(pa.int32()), "decoded": pa.binary()}
    return _run(docs, path, pattern, id_col, text_col, lambda ids, decoded: (ids.tolist(), decoded), "doc_id long, ids array<int>, decoded binary", kinds)


def digests(docs: DataFrame, path: str | None = None, pattern: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, number of ids, and digests of the ids and of the decoded bytes, without moving either."""
    kinds = {"doc_id": pa.int64(), "n_tokens": pa.int64(), "ids_sha256": pa.string(), "decoded_sha256": pa.string()}
    return _run(docs, path, pattern, id_col, text_col, _digest, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", kinds)
