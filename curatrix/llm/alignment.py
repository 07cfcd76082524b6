"""Alignment of two tokenizers over a corpus: DuckDB joins token intervals inside a block, Spark merges counts of id pairs.

A text is cut into pieces at the spaces where both tokenizers always cut (``speculative_bpe.pieces``). A block of documents
encodes each of its distinct pieces once by both and lays the tokens on one byte axis, as two tables of intervals. In
DuckDB, joins find the tokens that end together (links), window sums over these ends number the groups, and ASOF joins
find the first and the last token that overlap another. A block's counts of linked id pairs, each piece as often as it
occurs, go to Spark, which adds them up over the corpus, finds each B id's highest, and sends them back to the blocks.

Defined cases: null or empty texts, and texts whose tokens don't spell space + text in both tokenizers (such as those with
U+2581, which stands for a space), have no tokens: zeros and an empty digest; bytes that are not UTF-8 count as replacement
characters; a very long text is in one block; repeated rows count repeatedly; rows with a null id are kept; all ids that
share the highest count are best; an empty table gives an empty result; other columns, of whatever names, are ignored.
Strings of special tokens are plain text.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
import os
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curatrix.llm import speculative_bpe
from curatrix.llm.common import strings, texts, written
from curatrix.llm.word_blocks import gather, pack, unpack

BLOCK_BYTES = 12 << 20
#: Pieces that the libraries get at once; an encoding of theirs is much larger than its ids.
AT_ONCE = 1 << 14
SPACE = "▁"
DOCS, PAIRS = 0, 1
ROW = "kind int, block long, ids array<long>, totals binary, groups array<string>, codes binary, sizes binary, links binary, code int, a int, b int, n long"
_ARROW = pa.schema([("kind", pa.int32()), ("block", pa.int64()), ("ids", pa.list_(pa.int64())), ("totals", pa.binary()), ("groups", pa.list_(pa.string())), *[(c, pa.binary()) for c in ("codes", "sizes", "links")], *[(c, pa.int32()) for c in ("code", "a", "b")], ("n", pa.int64())])
OUT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string, n_overlaps long"
#: What ``joined`` gives for each piece, in this order.
TOTALS = ("n_a", "n_b", "n_groups", "n_links", "n_overlaps")


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


@functools.lru_cache(maxsize=2)
def _first(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    t.encode_special_tokens = True
    v = speculative_bpe.vocabulary(path)
    return t, (v.starts, v.sizes, v.flat)


@functools.lru_cache(maxsize=2)
def _second(path: str):
    """The model, its token bytes, and whether pieces may be encoded apart: no token goes on behind a space."""
    import sentencepiece

    s = sentencepiece.SentencePieceProcessor(model_file=path)
    names = [s.id_to_piece(i) for i in range(s.vocab_size())]
    spelt = [bytes([int(p[3:5], 16)]) if s.is_byte(i) else p.replace(SPACE, " ").encode() for i, p in enumerate(names)]
    sizes = np.array([len(t) for t in spelt], np.int64)
    return s, (np.cumsum(sizes) - sizes, sizes, np.frombuffer(b"".join(spelt), np.uint8)), not any(SPACE in p.lstrip(SPACE) for p in names)


def _ragged(pieces: list[str], encode: Callable[[list[str]], list[list[int]]]) -> tuple[np.ndarray, np.ndarray]:
    """Number of ids of each piece, and all ids."""
    sizes, flat = [np.empty(0, np.int64)], [np.empty(0, np.int32)]
    for k in range(0, len(pieces), AT_ONCE):
        found = encode(pieces[k : k + AT_ONCE])
        sizes.append(np.fromiter(map(len, found), np.int64, len(found)))
        flat.append(np.fromiter(itertools.chain.from_iterable(found), np.int32, int(sizes[-1].sum())))
    return np.concatenate(sizes), np.concatenate(flat)


def _spells(sizes: np.ndarray, ids: np.ndarray, table: tuple, wanted: list[bytes]) -> np.ndarray:
    """For each piece whether its tokens' bytes are its own."""
    lengths = np.bincount(np.repeat(np.arange(len(sizes)), sizes), table[1][ids], len(sizes)).astype(np.int64)
    own = np.fromiter(map(len, wanted), np.int64, len(wanted))
    spelt = gather(table[0][ids], table[1][ids], table[2]).tobytes()
    if (lengths == own).all() and spelt == b"".join(wanted):
        return np.ones(len(wanted), bool)
    ends = np.cumsum(lengths).tolist()
    return np.array([spelt[a:b] == w for a, b, w in zip([0, *ends[:-1]], ends, wanted, strict=True)], bool)


def _intervals(sizes: np.ndarray, ids: np.ndarray, table: tuple) -> pa.Table:
    stop = np.cumsum(table[1][ids])
    kind = np.int32 if len(ids) and stop[-1] < 1 << 31 else np.int64
    return pa.table({"pos": np.arange(len(ids), dtype=kind), "piece": np.repeat(np.arange(len(sizes), dtype=np.int32), sizes), "id": ids, "start": (stop - table[1][ids]).astype(kind), "stop": stop.astype(kind)})


#: Links are pairs of tokens that end together; ``part`` numbers the groups that such ends cut.
_LINKS = "CREATE TEMP TABLE link AS SELECT a.pos, a.piece, a.id AS a, b.id AS b, a.stop FROM a JOIN b ON a.stop = b.stop"
_GROUPED = """
SELECT t.pos, t.piece, t.id, coalesce(sum(cut) OVER (ORDER BY t.pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS part
FROM (SELECT t.*, (e.stop IS NOT NULL)::BIGINT AS cut FROM {side} t LEFT JOIN (SELECT DISTINCT stop FROM link) e ON t.stop = e.stop) t ORDER BY t.pos"""
_OVERLAPS = """
SELECT f.piece, sum(l.pos - f.pos + 1)::BIGINT AS n
FROM (SELECT a.pos AS token, a.piece, b.pos FROM a ASOF JOIN b ON a.start >= b.start) f
JOIN (SELECT a.pos AS token, b.pos FROM a ASOF JOIN b ON a.stop > b.start) l USING (token) GROUP BY f.piece"""
_PAIRS = "CREATE TEMP TABLE pair AS SELECT (row_number() OVER () - 1)::INTEGER AS code, a, b, n FROM (SELECT a, b, sum(p.n)::BIGINT AS n FROM link JOIN p USING (piece) GROUP BY a, b)"


def joined(a: pa.Table, b: pa.Table, often: np.ndarray) -> dict:
    """What DuckDB finds for the pieces of one block: link codes in order of their ends with their pieces, pairs with counts,
    groups of both sides' tokens, and overlaps. ``often``: how often each piece occurs."""
    import duckdb

    con = duckdb.connect(config={"threads": 1, "memory_limit": "400MB"})
    try:
        con.execute("SET enable_progress_bar = false")
        con.register("a", a)
        con.register("b", b)
        con.register("p", pa.table({"piece": np.arange(len(often), dtype=np.int32), "n": often.astype(np.int64)}))
        con.execute(_LINKS)
        con.execute(_PAIRS)
        return {
            "pairs": con.sql("SELECT code, a, b, n FROM pair ORDER BY code").to_arrow_table(),
            "links": con.sql("SELECT piece, code FROM link JOIN pair USING (a, b) ORDER BY pos, code").to_arrow_table(),
            "a": con.sql(_GROUPED.format(side="a")).to_arrow_table(),
            "b": con.sql(_GROUPED.format(side="b")).to_arrow_table(),
            "overlaps": con.sql(_OVERLAPS).to_arrow_table(),
        }
    finally:
        con.close()


def _shown(a: pa.Table, b: pa.Table, pieces: int, vocabulary: int) -> tuple[np.ndarray, bytes]:
    """Groups as `a1,a2|b1;`: where each piece's part ends, and all parts."""
    part = np.concatenate([a["part"].to_numpy() * 2, b["part"].to_numpy() * 2 + 1])
    order = np.argsort(part, kind="stable")
    part = part[order]
    ids = np.concatenate([a["id"].to_numpy(), b["id"].to_numpy()])[order]
    piece = np.concatenate([a["piece"].to_numpy(), b["piece"].to_numpy()])[order]
    starts, sizes, flat = speculative_bpe._decimals(vocabulary)
    text = gather(starts[ids], sizes[ids], flat).copy()
    ends = np.cumsum(sizes[ids])
    step = np.diff(part, append=part[-1:] + 1)
    text[ends - 1] = np.where(step == 0, ord(","), np.where(part % 2 == 0, ord("|"), ord(";")))
    return np.cumsum(np.bincount(piece, sizes[ids], pieces).astype(np.int64)), text.tobytes()


def _block(block: int, docs: list[tuple], codes: speculative_bpe._New, path: str, model: str) -> Iterator[pa.RecordBatch]:
    first, table_a = _first(path)
    second, table_b, _ = _second(model)
    pieces = list(codes)
    wanted = [p.encode() for p in pieces]
    size_a, ids_a = _ragged(pieces, lambda some: [e.ids for e in first.encode_batch_fast(some, add_special_tokens=False)])
    size_b, ids_b = _ragged(pieces, lambda some: second.encode([p[1:] for p in some], num_threads=1))
    good = _spells(size_a, ids_a, table_a, wanted) & _spells(size_b, ids_b, table_b, wanted)
    docs = [(i, c if good[c].all() else c[:0]) for i, c in docs]
    every = np.concatenate([c for _, c in docs])
    often = np.bincount(every, minlength=len(pieces))
    # pieces that no valid document holds leave no intervals
    size_a, ids_a, size_b, ids_b = (x for s, t in ((size_a, ids_a), (size_b, ids_b)) for x in (np.where(often > 0, s, 0), t[np.repeat(often > 0, s)]))
    n = len(pieces)
    totals, shown, link_sizes, link_codes, pairs = np.zeros((n, 5), np.int64), [b""] * n, np.zeros(n, np.int64), np.empty(0, np.int32), None
    if len(ids_a):
        found = joined(_intervals(size_a, ids_a, table_a), _intervals(size_b, ids_b, table_b), often)
        ends, text = _shown(found["a"], found["b"], n, max(len(table_a[1]), len(table_b[1])))
        shown = [text[x:y] for x, y in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]
        last = np.flatnonzero(np.diff(found["a"]["part"].to_numpy(), append=-1))
        link_sizes = np.bincount(found["links"]["piece"].to_numpy(), minlength=n)
        link_codes = found["links"]["code"].to_numpy()
        overlaps = np.zeros(n, np.int64)
        overlaps[found["overlaps"]["piece"].to_numpy()] = found["overlaps"]["n"].to_numpy()
        totals = np.stack([size_a, size_b, np.bincount(found["a"]["piece"].to_numpy()[last], minlength=n), link_sizes, overlaps], axis=1)
        pairs = found["pairs"]
    per_doc = np.stack([totals[c].sum(axis=0) for _, c in docs])
    groups = [hashlib.sha256(b"".join([shown[k] for k in c.tolist()])[:-1]).hexdigest() if len(c) else "" for _, c in docs]
    sizes = np.array([len(c) for _, c in docs], np.uint32)
    row = {"kind": DOCS, "block": block, "ids": [i for i, _ in docs], "totals": pack(per_doc.ravel()), "groups": groups, "codes": pack(np.concatenate([sizes, every.astype(np.uint32)])), "sizes": pack(link_sizes.astype(np.uint32)), "links": pack(link_codes.astype(np.uint32))}
    yield pa.RecordBatch.from_pylist([row], _ARROW)
    if pairs is not None:
        m = pairs.num_rows
        known = {"kind": pa.array(np.full(m, PAIRS, np.int32)), "block": pa.array(np.full(m, block, np.int64))} | {c: pairs[c].combine_chunks() for c in ("code", "a", "b", "n")}
        yield from pa.table([known.get(f.name, pa.nulls(m, f.type)) for f in _ARROW], _ARROW).to_batches()


def _blocks(path: str, model: str, block_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, docs, codes, size = TaskContext.get().partitionId() << 24, [], speculative_bpe._New(), 0
        apart = _second(model)[2]
        for batch in batches:
            for i, text in zip(batch.column("doc_id").to_pylist(), strings(batch.column("text")), strict=True):
                cut = (speculative_bpe.pieces(f" {text}") if apart else [f" {text}"]) if text else []
                docs.append((i, np.fromiter(map(codes.__getitem__, cut), np.int64, len(cut))))
                size += len(text)
                if size >= block_bytes:
                    yield from _block(block, docs, codes, path, model)
                    block, docs, codes, size = block + 1, [], speculative_bpe._New(), 0
        if docs:
            yield from _block(block, docs, codes, path, model)

    return run


def _sums(docs: pa.Table, back: pa.Table) -> pa.Table:
    """Adds the corpus-wide counts up over each document's links."""
    kinds = [("doc_id", pa.int64()), *[(c, pa.int64()) for c in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")], ("groups_sha256", pa.string()), ("n_overlaps", pa.int64())]
    code = back["code"].to_numpy()
    count, best = np.zeros(len(code), np.int64), np.zeros(len(code), np.int64)
    count[code], best[code] = back["count"].to_numpy(), back["best"].to_numpy()
    columns: dict[str, list] = {c: [] for c, _ in kinds}
    for row in docs.to_pylist():
        links, link_sizes = unpack(row["links"]), unpack(row["sizes"]).astype(np.int64)
        piece = np.repeat(np.arange(len(link_sizes)), link_sizes)
        of_piece = np.zeros((len(link_sizes), 2), np.int64)
        np.add.at(of_piece, piece, np.stack([best[links], count[links]], axis=1))
        n = len(row["ids"])
        codes = unpack(row["codes"])
        sizes, codes = codes[:n].astype(np.int64), codes[n:]
        of_doc = np.zeros((n, 2), np.int64)
        np.add.at(of_doc, np.repeat(np.arange(n), sizes), of_piece[codes])
        totals = unpack(row["totals"]).reshape(n, len(TOTALS))
        columns["doc_id"] += row["ids"]
        columns["groups_sha256"] += row["groups"]
        for k, c in enumerate(TOTALS):
            columns[c] += totals[:, k].tolist()
        columns["n_best"] += of_doc[:, 0].tolist()
        columns["count_sum"] += of_doc[:, 1].tolist()
    return pa.table({c: pa.array(columns[c], t) for c, t in kinds})


def blocks(docs: DataFrame, path: str | None = None, model: str | None = None, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Documents and pair counts of each block, written once to the shared folder."""
    run = _blocks(path or speculative_bpe.default_path(), model or default_model(), block_bytes)
    return written(texts(docs, id_col, text_col).mapInArrow(run, ROW))


def pair_counts(parts: DataFrame) -> DataFrame:
    """a, b, count (links over all documents that hold the two ids linked) and best (1: no A id has more links with b)."""
    counts = parts.where(F.col("kind") == PAIRS).groupBy("a", "b").agg(F.sum("n").alias("count"))
    most = counts.groupBy("b").agg(F.max("count").alias("most"))
    return counts.join(most, "b").select("a", "b", "count", (F.col("count") == F.col("most")).cast("int").alias("best"))


def aligned(docs: DataFrame, path: str | None = None, model: str | None = None, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Per document: tokens of both, groups, links, links with their B id's highest count, the sum of counts, a digest of the
    groups, and pairs of tokens that overlap."""
    parts = blocks(docs, path, model, id_col, text_col, block_bytes)
    back = parts.where(F.col("kind") == PAIRS).select("block", "code", "a", "b").join(written(pair_counts(parts)), ["a", "b"]).select(F.col("block").alias("of"), "code", "count", "best")
    kept = parts.where(F.col("kind") == DOCS).select("block", "ids", "totals", "groups", "codes", "sizes", "links")
    return kept.groupBy("block").cogroup(back.groupBy("of")).applyInArrow(_sums, OUT)
