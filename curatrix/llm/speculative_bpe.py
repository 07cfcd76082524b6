"""Byte-level BPE by speculation: greedy longest matches are proposed, and adjacent tokens are checked for compatibility.

A word's bytes are cut greedily into the longest tokens. The merges would give the same tokens exactly if no two neighbours
could have been merged across their border: going back in time along the right edge of the left token and the left edge of
the right one, no two pieces that lay side by side may have a merge that comes before both pieces' own next merges. That
test runs over all pairs of a batch at once as array look-ups. Only words with a failing pair undergo the merges themselves.

Texts never leave their task. A text is cut at the spaces where every tokenizer of this family cuts, and each distinct
piece of a task is encoded once, in a memo that is emptied when it's full.

Defined cases: null text counts as empty and gives no ids; bytes that are not UTF-8 count as replacement characters; a very
long text is encoded whole in its task; repeated rows give repeated results; rows with a null id are kept; an empty table
gives an empty result; other columns, of whatever names, are ignored. The strings of the file's added tokens are those
tokens. A file must hold all 256 bytes, and merges must come after those that make their parts, else ValueError.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import itertools
import json
import re
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from curatrix.llm.bpe_words import default_pattern, spaced
from curatrix.llm.common import strings, texts
from curatrix.llm.word_blocks import gather

NEVER = np.int64(1 << 40)
#: Bytes of text that are encoded at once, and bytes of distinct pieces that a memo keeps. Neither changes a result.
STEP, MEMO = 8 << 20, 48 << 20
#: Words of up to so many bytes are merged many at once, longer ones one by one in n log n steps.
SHORT = 48
#: A space between two characters of which the first is no space and the second no white space.
_CUT = re.compile(r"(?<! ) (?=\S)")


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def pieces(text: str) -> list[str]:
    """The text cut before each single space that begins a word; each piece but the first keeps its space."""
    head, *rest = _CUT.split(text)
    return [head, *[f" {p}" for p in rest]] if head else [f" {p}" for p in rest]


def byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in such files: printable Latin-1 for itself, the others from U+0100 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(others)}


class Vocabulary(NamedTuple):
    """Arrays by id: ``left`` and ``right`` are the parts of a token, ``made`` the rank of its merge (-1: a byte)."""

    tokens: dict[bytes, int]  # tokens that the merges give for their own bytes
    prefixes: dict[bytes, int]  # beginnings of these tokens, with the id of those that are tokens, else -1
    added: dict[str, int]
    merges: dict[tuple[int, int], tuple[int, int]]  # parts to rank and id
    keys: np.ndarray
    ranks: np.ndarray
    left: np.ndarray
    right: np.ndarray
    made: np.ndarray
    result: np.ndarray  # id by rank
    of_byte: list[int]
    starts: np.ndarray
    sizes: np.ndarray
    flat: np.ndarray


@functools.lru_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    with open(path, encoding="utf-8") as f:
        file = json.load(f)
    letters = byte_letters()
    as_bytes = {t: bytes(map(letters.__getitem__, t)) for t in file["model"]["vocab"]}
    ids = {as_bytes[t]: i for t, i in file["model"]["vocab"].items()}
    added = {t["content"]: t["id"] for t in file["added_tokens"]}
    if any(t[k] for t in file["added_tokens"] for k in ("single_word", "lstrip", "rstrip", "normalized")) or len({b for b in ids if len(b) == 1}) < 256:
        raise ValueError(f"{path}: added tokens must be plain, and all bytes must be tokens")
    n = max([*ids.values(), *added.values()]) + 1
    left, right, made = np.full(n, -1, np.int64), np.full(n, -1, np.int64), np.full(n, -1, np.int64)
    merges = {}
    for rank, pair in enumerate(file["model"]["merges"]):
        a, b = (as_bytes[t] for t in (pair.split(" ") if isinstance(pair, str) else pair))
        x, y, z = ids[a], ids[b], ids[a + b]
        if any(len(t) > 1 and made[i] < 0 for t, i in ((a, x), (b, y))):
            raise ValueError(f"{path}: merge {rank} comes before its parts")
        if (x, y) in merges:
            raise ValueError(f"{path}: merge {rank} is there twice")
        merges[x, y] = rank, z
        if made[z] < 0:
            left[z], right[z], made[z] = x, y, rank
    keys = np.array([x << 32 | y for x, y in merges], np.int64)
    order = np.argsort(keys)
    ranks = np.array([r for r, _ in merges.values()], np.int64)[order]
    spelt = [b""] * n
    for t, i in [*ids.items(), *((c.encode(), i) for c, i in added.items())]:
        spelt[i] = t
    sizes = np.array([len(t) for t in spelt], np.int64)
    v = Vocabulary({}, {}, added, merges, keys[order], ranks, left, right, made, np.array([z for _, z in sorted(merges.values())], np.int64), [ids[bytes([b])] for b in range(256)], np.cumsum(sizes) - sizes, sizes, np.frombuffer(b"".join(spelt), np.uint8))
    # a token that a merge across its own halves would break up is never proposed
    whole = np.flatnonzero(made >= 0)
    broken = set(whole[_clashes(v, left[whole], right[whole], whole=False)].tolist())
    good = {t: i for t, i in ids.items() if len(t) == 1 or (made[i] >= 0 and i not in broken)}
    return v._replace(tokens=good, prefixes={t[:k]: -1 for t in good for k in range(1, len(t) + 1)} | good)


def _ranks(v: Vocabulary, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    if not len(v.keys):
        return np.full(len(a), NEVER)
    key = a << 32 | b
    at = np.minimum(np.searchsorted(v.keys, key), len(v.keys) - 1)
    return np.where(v.keys[at] == key, v.ranks[at], NEVER)


def _clashes(v: Vocabulary, a: np.ndarray, b: np.ndarray, whole: bool = True) -> np.ndarray:
    """For each pair of tokens, whether the merges of their joined bytes cross the border. ``whole=False`` leaves out the
    merge of the two tokens themselves. Equal ranks are the same merge, of which the leftmost comes first."""
    bad, at = np.zeros(len(a), bool), np.arange(len(a))
    a, b = a.astype(np.int64), b.astype(np.int64)
    until_a = until_b = np.full(len(a), NEVER)
    while len(at):
        hit = np.zeros(len(at), bool)
        if whole:
            rank = _ranks(v, a, b)
            hit = (rank < until_a) & (rank <= until_b)
            bad[at[hit]] = True
        whole = True
        on = ~hit & ((v.made[a] >= 0) | (v.made[b] >= 0))
        at, a, b, until_a, until_b = at[on], a[on], b[on], until_a[on], until_b[on]
        # the later of the two last merges is undone
        on_right = v.made[b] >= v.made[a]
        until_a, until_b = np.where(on_right, until_a, v.made[a]), np.where(on_right, v.made[b], until_b)
        a, b = np.where(on_right, a, v.right[a]), np.where(on_right, v.left[b], b)
    return bad


def proposed(v: Vocabulary, word: bytes) -> list[int]:
    """Greedy longest matches."""
    got = v.tokens.get(word)
    if got is not None:
        return [got]
    prefixes, out, at, n = v.prefixes, [], 0, len(word)
    while at < n:
        best = end = -1
        for stop in range(at + 1, n + 1):
            t = prefixes.get(word[at:stop])
            if t is None:
                break
            if t >= 0:
                best, end = t, stop
        out.append(best)
        at = end
    return out


def merged(v: Vocabulary, word: bytes) -> list[int]:
    """The merges themselves, by rank and then from the left."""
    ids, n = [v.of_byte[b] for b in word], len(word)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(*v.merges[p], k, *p) for k, p in enumerate(zip(ids, ids[1:], strict=False)) if p in v.merges]
    heap = [(rank, k, a, b, z) for rank, z, k, a, b in heap]
    heapq.heapify(heap)
    while heap:
        _, k, a, b, z = heapq.heappop(heap)
        j = after[k]
        if ids[k] != a or j >= n or ids[j] != b:
            continue
        ids[k], ids[j] = z, -1
        after[k] = after[j]
        if after[j] < n:
            before[after[j]] = k
        for i in (before[k], k):
            if i >= 0 and after[i] < n and (p := (ids[i], ids[after[i]])) in v.merges:
                rank, z = v.merges[p]
                heapq.heappush(heap, (rank, i, *p, z))
    return [i for i in ids if i >= 0]


def _merged_short(v: Vocabulary, words: list[bytes]) -> list[list[int]]:
    """The same for many short words at once: in each round every word does its next merge, at its leftmost place."""
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ids = np.array(v.of_byte, np.int64)[np.frombuffer(b"".join(words), np.uint8)]
    of, out = np.repeat(np.arange(len(words)), sizes), [[]] * len(words)
    rank = np.full(len(ids), NEVER)  # of the pair that begins here

    def pair_ranks(at: np.ndarray) -> np.ndarray:
        inside = at[(at >= 0) & (at + 1 < len(ids))]
        inside = inside[of[inside] == of[inside + 1]]
        rank[at[at >= 0]] = NEVER
        rank[inside] = _ranks(v, ids[inside], ids[inside + 1])

    pair_ranks(np.arange(len(ids)))
    while len(ids):
        begins = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
        least = np.minimum.reduceat(rank, begins)
        spread = np.repeat(least, np.diff(np.r_[begins, len(ids)]))
        on = spread < NEVER
        if not on.all():
            for k, a, b in zip(of[begins[least == NEVER]].tolist(), begins[least == NEVER].tolist(), np.r_[begins[1:], len(ids)][least == NEVER].tolist(), strict=True):
                out[k] = ids[a:b].tolist()
            ids, of, rank, spread = ids[on], of[on], rank[on], spread[on]
            if not len(ids):
                break
        hits = np.flatnonzero(rank == spread)
        hits = hits[np.r_[True, of[hits][1:] != of[hits][:-1]]]
        ids[hits] = v.result[rank[hits]]
        keep = np.ones(len(ids), bool)
        keep[hits + 1] = False
        at = (np.cumsum(keep) - 1)[hits]
        ids, of, rank = ids[keep], of[keep], rank[keep]
        pair_ranks(np.r_[at, at - 1])
    return out


def encode_words(v: Vocabulary, words: list[bytes]) -> tuple[list[list[int]], int]:
    """The ids of each word, and how many words the check sent to the merges."""
    found = [proposed(v, w) for w in words]
    sizes = np.fromiter(map(len, found), np.int64, len(found))
    flat = np.fromiter(itertools.chain.from_iterable(found), np.int64, int(sizes.sum()))
    of = np.repeat(np.arange(len(words)), sizes)
    inner = np.flatnonzero(of[1:] == of[:-1])
    pairs, back = np.unique(flat[inner] << 32 | flat[inner + 1], return_inverse=True)
    clash = _clashes(v, pairs >> 32, pairs & 0xFFFFFFFF)[back]
    failed = np.unique(of[inner[clash]]).tolist()
    short = [k for k in failed if len(words[k]) <= SHORT]
    for k, ids in zip(short, _merged_short(v, [words[k] for k in short]), strict=True):
        found[k] = ids
    for k in failed:
        if len(words[k]) > SHORT:
            found[k] = merged(v, words[k])
    return found, len(failed)


class _New(dict):
    """Piece to code; new pieces are noted with the next code."""

    def __init__(self):
        self.new: list[str] = []

    def __missing__(self, piece: str) -> int:
        code = self[piece] = len(self)
        self.new.append(piece)
        return code


class Encoder:
    """Encodes texts, each distinct piece once per memo."""

    def __init__(self, path: str, pattern: str):
        self.v = vocabulary(path)
        self.find = regex.compile(spaced(pattern)).findall
        names = sorted(self.v.added, key=len, reverse=True)
        self.split = re.compile("(" + "|".join(map(re.escape, names)) + ")").split if names else lambda text: [text]
        self._empty()

    def _empty(self) -> None:
        self.codes, self.size = _New(), 0
        self.sizes, self.flat = np.empty(0, np.int64), np.empty(0, np.uint32)

    def _codes(self, text: str) -> np.ndarray:
        codes, out = self.codes, []
        for k, part in enumerate(self.split(text)):
            out += [codes[part]] if k % 2 else map(codes.__getitem__, pieces(part))
        return np.array(out, np.int64)

    def _learn(self) -> None:
        """Encodes the noted pieces, each of their distinct words once."""
        added, known, words, counts = self.v.added, {}, [], []
        for p in self.codes.new:
            found = (p,) if p in added else self.find(p)
            words += found
            counts.append(len(found))
        for w in words:
            known[w] = None
        plain = [w for w in known if w not in added]
        known = dict(zip(plain, encode_words(self.v, [w.encode() for w in plain])[0], strict=True)) | {w: [i] for w, i in added.items()}
        ids = [known[w] for w in words]
        count = np.concatenate([[0], np.cumsum(np.fromiter(map(len, ids), np.int64, len(ids)))])
        self.sizes = np.concatenate([self.sizes, np.diff(count[np.concatenate([[0], np.cumsum(counts)])])])
        self.flat = np.concatenate([self.flat, np.fromiter(itertools.chain.from_iterable(ids), np.uint32, int(count[-1]))])
        self.size += sum(map(len, self.codes.new))
        self.codes.new = []

    def encode(self, some: list[str]) -> list[np.ndarray]:
        if self.size > MEMO:
            self._empty()
        codes = [self._codes(t) for t in some]
        if self.codes.new:
            self._learn()
        starts = np.cumsum(self.sizes) - self.sizes
        return [gather(starts[c], self.sizes[c], self.flat) if len(c) else np.empty(0, np.uint32) for c in codes]


def decode(v: Vocabulary, ids: np.ndarray) -> str:
    return gather(v.starts[ids], v.sizes[ids], v.flat).tobytes().decode("utf-8", "replace")


def steps(rows: list, size: Callable = len, limit: int = STEP) -> Iterator[slice]:
    """Runs of rows whose sizes add up to the limit at most, longer single rows for themselves."""
    begin, total = 0, 0
    for k, row in enumerate(rows):
        if total and total + size(row) > limit:
            yield slice(begin, k)
            begin, total = k, 0
        total += size(row)
    if rows:
        yield slice(begin, len(rows))


def _run(docs: DataFrame, path: str | None, pattern: str | None, id_col: str, text_col: str, result, schema: str, kinds: dict[str, pa.DataType]) -> DataFrame:
    path, pattern = path or default_path(), pattern or default_pattern()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(path, pattern)
        for batch in batches:
            ids, whole = batch.column("doc_id").to_pylist(), strings(batch.column("text"))
            for part in steps(whole):
                rows = [(i, *result(encoder.v, x)) for i, x in zip(ids[part], encoder.encode(whole[part]), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds.values())], names=list(kinds))

    return texts(docs, id_col, text_col).mapInArrow(run, schema)


@functools.lru_cache(maxsize=2)
def _decimals(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each id as decimal digits and a comma."""
    shown = [b"%d," % i for i in range(n)]
    sizes = np.array([len(x) for x in shown], np.int64)
    return np.cumsum(sizes) - sizes, sizes, np.frombuffer(b"".join(shown), np.uint8)


def joined(ids: np.ndarray, n: int) -> bytes:
    """Decimal ids below n, joined by commas."""
    starts, sizes, flat = _decimals(n)
    return gather(starts[ids], sizes[ids], flat)[:-1].tobytes()


def _digest(v: Vocabulary, ids: np.ndarray) -> tuple:
    return len(ids), hashlib.sha256(joined(ids, len(v.sizes))).hexdigest(), hashlib.sha256(decode(v, ids).encode()).hexdigest()


def encoded(docs: DataFrame, path: str | None = None, pattern: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids, and the text that decoding the ids gives."""
    kinds = {"doc_id": pa.int64(), "ids": pa.list_(pa.int32()), "decoded": pa.string()}
    return _run(docs, path, pattern, id_col, text_col, lambda v, ids: (ids.tolist(), decode(v, ids)), "doc_id long, ids array<int>, decoded string", kinds)


def digests(docs: DataFrame, path: str | None = None, pattern: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, number of ids, and digests of the ids and of the decoded text, without moving either."""
    kinds = {"doc_id": pa.int64(), "n_tokens": pa.int64(), "ids_sha256": pa.string(), "decoded_sha256": pa.string()}
    return _run(docs, path, pattern, id_col, text_col, _digest, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", kinds)
