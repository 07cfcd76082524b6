"""Packing documents into windows by minimum bin slack.

A document's ids are cut into full windows and one rest. Rests are packed whole: as there are fewer than ``size``
different lengths, the counts by length are a bounded histogram. Bitset subset sums over the remaining multiset, seeded
with the longest length left, find the filling closest to the capacity; backtracking gives how many of each
length it takes, and the filling is repeated while the counts last. Each rest finds its place by its rank among
rests of equal length; ranks come from counts per (length, salt), so that a length that very many documents share
doesn't meet in one task.

A tokenizer that is not known to drop white space (``plain_parts``) gets whole texts, all others get words.

Defined cases: null text counts as empty and is one piece of the end id alone; a very long text is cut into as many full
windows as it fills, and a rest; of fillings equally close the one that backtracking meets first is taken, and rests of
equal length take their places in the order of doc_id and ids; repeated rows are pieces of their own; rows with a null
id are kept; an empty table gives an empty result; other columns, of whatever names, are ignored.
"""

from __future__ import annotations

import functools
import itertools
import json
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from curatrix.llm.common import sliced, texts, written
from curatrix.llm.word_blocks import Codes, gather

SIZE, END_ID, CACHED_WORDS = 2048, 1, 500_000
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@functools.lru_cache(maxsize=2)
def tokenizer(path: str):
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks are the parallelism
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def _byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte in byte-level vocabularies: printable Latin-1 bytes are their
    own, the rest follow from code point 256 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in set(own)]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


@functools.lru_cache(maxsize=2)
def plain_parts(path: str):
    """The tokenizer's splitting pattern, its bare model and which ids end a word, if its steps are: NFC, white space, lower case; splitting;
    byte letters. Otherwise None, and every text takes the whole tokenizer."""
    from tokenizers import Tokenizer

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    before = [x["type"] for x in (spec.get("normalizer") or {}).get("normalizers", [])]
    cut = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
    if before != ["NFC", "Replace", "Lowercase"] or [x["type"] for x in cut] != ["Split", "ByteLevel"] or cut[1].get("add_prefix_space") or not cut[0].get("invert"):
        return None
    bare, suffix = Tokenizer(tokenizer(path).model), tokenizer(path).model.end_of_word_suffix
    if not suffix:
        return None
    ends = np.zeros(bare.get_vocab_size(), bool)
    ends[[i for token, i in bare.get_vocab().items() if token.endswith(suffix)]] = True
    return regex.compile(cut[0]["pattern"]["Regex"]).findall, bare, ends


#: Words for which lower case and normal form are plain: printable ASCII and Latin-1 letters.
_PLAIN = re.compile("[!-~À-ÖØ-öø-ÿ]+").fullmatch
_LETTERS = str.maketrans({chr(b): c for b, c in _byte_letters().items()})


class _Ids:
    """Growing pieces of ids by code."""

    def __init__(self):
        self.n = self.used = 0
        self.sizes, self.starts, self.flat = np.zeros(1 << 10, np.int64), np.zeros(1 << 10, np.int64), np.zeros(1 << 12, np.uint32)

    def add(self, sizes: np.ndarray, flat: np.ndarray) -> None:
        n, total = self.n + len(sizes), self.used + len(flat)
        if n > len(self.sizes):
            self.sizes, self.starts = np.resize(self.sizes, 2 * n), np.resize(self.starts, 2 * n)
        if total > len(self.flat):
            self.flat = np.resize(self.flat, 2 * total)
        self.sizes[self.n : n], self.starts[self.n : n] = sizes, self.used + np.cumsum(sizes) - sizes
        self.flat[self.used : total] = flat
        self.n, self.used = n, total

    def of(self, codes: np.ndarray) -> np.ndarray:
        return gather(self.starts[codes], self.sizes[codes], self.flat)


class WordIds:
    """Ids of texts, word by word. The tokenizer drops white space and never joins over it, so a text's ids are those
    of its parts between ASCII white space; each is encoded once while it is kept. Plain words are split and put in
    lower case here, so that words differing in case and punctuation share the model's work; all others take the
    whole tokenizer. Up to ``most`` words are kept."""

    def __init__(self, path: str, most: int = CACHED_WORDS):
        self.tokenizer, self.most, self.plain = tokenizer(path), most, plain_parts(path)
        self.clear()

    def clear(self) -> None:
        self.codes, self.ids = Codes(), _Ids()
        self.part_codes, self.part_ids = Codes(), _Ids()

    def _learn_parts(self) -> None:
        new = list(itertools.islice(self.part_codes, self.part_ids.n, None))
        for k in range(0, len(new), 1000):
            chunk = [p.encode().decode("latin-1").translate(_LETTERS) for p in new[k : k + 1000]]
            ids = np.array(self.plain[1].encode_batch_fast([chunk], is_pretokenized=True, add_special_tokens=False)[0].ids, np.uint32)
            # each part's last id, and no other, is one of a word's end
            sizes = np.diff(np.flatnonzero(self.plain[2][ids]), prepend=-1)
            if len(sizes) != len(chunk):
                raise ValueError("the vocabulary doesn't mark the ends of words")
            self.part_ids.add(sizes, ids)

    def _learn(self) -> None:
        words = [w.decode("utf-8", "replace") for w in itertools.islice(self.codes, self.ids.n, None)]
        parts: list[int] = []
        counts = np.zeros(len(words), np.int64)
        whole: dict[int, list[int]] = {}
        find, code = self.plain[0], self.part_codes
        for i, w in enumerate(words):
            if _PLAIN(w) and "<|" not in w:
                found = find(w.lower())
                parts += [code[p] for p in found]
                counts[i] = len(found)
            else:
                whole[i] = self.tokenizer.encode(w, add_special_tokens=False).ids
        if len(self.part_codes) > self.part_ids.n:
            self._learn_parts()
        codes = np.array(parts, np.int64)
        ends = np.cumsum(self.part_ids.sizes[codes])
        upto = np.concatenate([[0], ends])
        last = np.cumsum(counts)
        sizes = upto[last] - upto[last - counts]
        flat = self.part_ids.of(codes)
        if whole:
            pieces_ = np.split(flat, np.cumsum(sizes)[:-1])
            for i, ids in whole.items():
                pieces_[i], sizes[i] = np.array(ids, np.uint32), len(ids)
            flat = np.concatenate(pieces_)
        self.ids.add(sizes, flat)

    def __call__(self, texts_: list[bytes]) -> Iterator[np.ndarray]:
        """Ids of each text. Texts are taken together up to a size, so that new words are encoded in bulk."""
        if self.plain is None:
            for text in texts_:
                yield np.array(self.tokenizer.encode(text.decode("utf-8", "replace"), add_special_tokens=False).ids, np.uint32)
            return
        at = 0
        while at < len(texts_):
            if len(self.codes) > self.most:
                self.clear()
            upto, size, coded = at, 0, []
            while upto < len(texts_) and (upto == at or size < 1 << 21):
                words = texts_[upto].split()
                coded.append(np.fromiter(map(self.codes.__getitem__, words), np.int64, len(words)))
                size += len(texts_[upto])
                upto += 1
            if len(self.codes) > self.ids.n:
                self._learn()
            for codes in coded:
                yield self.ids.of(codes)
            at = upto


def _cutter(path: str, size: int, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = WordIds(path)
        for batch in sliced(batches):
            rows = []
            for doc, ids in zip(batch.column(0).to_pylist(), ids_of(batch.column(1).cast(pa.binary()).to_pylist()), strict=True):
                ids = np.append(ids, np.uint32(end_id)).astype("<u4")
                for start in range(0, len(ids), size):
                    piece = ids[start : start + size]
                    rows.append((doc, start, len(piece), zlib.crc32(piece.tobytes()), len(ids)))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in range(5)], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return run


def best_filling(left: dict[int, int], capacity: int, seed: int) -> dict[int, int]:
    """Counts by length of a filling of one window that holds ``seed`` and comes closest to the capacity: subset sums
    as bitsets, lengths from long to short, backtracked through the sums reached before each step."""
    room = capacity - seed
    full, sums = (1 << room + 1) - 1, 1
    steps: list[tuple[int, int, int]] = []
    for length in sorted((x for x in left if x <= room), reverse=True):
        many, take = min(left[length] - (length == seed), room // length), 1
        while many > 0:
            take = min(take, many)
            steps.append((length, take, sums))
            sums |= (sums << length * take) & full
            many, take = many - take, take * 2
        if sums >> room & 1:
            break
    at = sums.bit_length() - 1
    used = {seed: 1}
    for length, take, before in reversed(steps):
        if not before >> at & 1:
            at -= length * take
            used[length] = used.get(length, 0) + take
    return used


def fillings(histogram: dict[int, int], capacity: int = SIZE) -> list[tuple[dict[int, int], int]]:
    """Fillings and how many windows take each; every item of the histogram (length to count) is used."""
    left, out = {k: v for k, v in histogram.items() if v > 0}, []
    while left:
        used = best_filling(left, capacity, max(left))
        times = min(left[k] // n for k, n in used.items())
        for k, n in used.items():
            left[k] -= n * times
            if not left[k]:
                del left[k]
        out.append((used, times))
    return out


def slots(patterns: list[tuple[dict[int, int], int]]) -> tuple[list[tuple[int, int, int, int, int, int]], int]:
    """length, first and end rank, copies in a window, first window, first offset; and the number of windows."""
    rows, dealt, window = [], {}, 0
    for used, times in patterns:
        offset = 0
        for length, n in used.items():
            first = dealt.get(length, 0)
            dealt[length] = first + n * times
            rows.append((length, first, dealt[length], n, window, offset))
            offset += length * n
        window += times
    return rows, window


def pieces(docs: DataFrame, path: str | None = None, size: int = SIZE, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The pieces of every document: full windows and one rest."""
    return texts(docs, id_col, text_col).mapInArrow(_cutter(path or default_path(), size, end_id), PIECES)


def pack(docs: DataFrame, path: str | None = None, size: int = SIZE, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id and offset of every piece. Brought to the driver: the
    histogram, of fewer than ``size`` rows; sent out: the slots that follow from it alone."""
    spark = docs.sparkSession
    cut = written(pieces(docs, path, size, end_id, id_col, text_col))
    salts = max(32, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rests = cut.where(F.col("length") < size).withColumn("salt", F.pmod(F.xxhash64("doc_id", "ids_crc32"), F.lit(salts)).cast("int"))
    counts = rests.groupBy("length", "salt").agg(F.count("*").alias("n"))
    histogram = {r["length"]: r["n"] for r in rests.groupBy("length").agg(F.count("*").alias("n")).collect()}
    places, windows = slots(fillings(histogram, size))
    before = counts.select("length", "salt", (F.sum("n").over(W.partitionBy("length").orderBy("salt").rowsBetween(W.unboundedPreceding, 0)) - F.col("n")).alias("before"))
    local = rests.withColumn("rank", F.row_number().over(W.partitionBy("length", "salt").orderBy("doc_id", "ids_crc32")) - 1)
    ranked = local.join(before, ["length", "salt"]).withColumn("rank", F.col("rank") + F.col("before"))
    table = spark.createDataFrame(places, "slot_length long, first long, stop long, copies long, window long, offset0 long")
    placed = ranked.join(F.broadcast(table), (F.col("length") == F.col("slot_length")) & (F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("stop")))
    j = F.col("rank") - F.col("first")
    rest_rows = placed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("window") + F.floor(j / F.col("copies"))).cast("long").alias("sequence_id"), (F.col("offset0") + (j % F.col("copies")) * F.col("length")).cast("long").alias("offset"))
    full_rows = cut.where(F.col("length") == size).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.lit(windows) + F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return full_rows.unionByName(rest_rows)
