"""Scoring texts by a Brown class-based n-gram model.

Words are clustered by exchange: a word moves to the class that gains most likelihood of the class bigrams. First the
``UNITS`` most frequent words move, each on its own, while all other words share units by their last characters; a round
moves half of the units at once against the counts of the round before, so rounds are plain aggregations: contexts of
units are gathered from all blocks of the corpus, summed by unit, and judged against the small class bigram table. Then
every other training word is exchanged on its own against the table so fixed: its contexts meet in the shard of its
hash, and it takes the class that gains most. A word that no training text has takes the class of its last characters.

The model: P(class | two classes before), smoothed by the class bigram and unigram, times the word's share of its
class with absolute discounting; what a discount takes goes to one unknown word, whose probability sums over classes.
So probabilities of all known words, the end and the unknown word sum to one in every context.

Counts come from every training text. Words meet their counts in shards by hash (see word_blocks), and words' classes
are a table in those shards; only tables of units, classes and class n-grams, all of fixed size, are brought to the
driver or sent out. Rounds end when nothing moves, or after ``rounds``, a parameter of the optimiser.

Defined cases: null text counts as empty, whose only token is the end; a very long text is part of one block and worked on
in one run; of words equally frequent the lesser becomes a unit, of classes that gain the same the lesser counts, and a
word stays where none gains; without training texts, every score is that of the unknown word with probability one;
repeated rows get equal scores; rows with a null id are kept (their id counts as empty text for the fold); an empty
table gives an empty result; other columns, of whatever names, are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curatrix.llm.common import fold, texts, written
from curatrix.llm.word_blocks import DOCS, WORDS, Block, blocks, by_shard, grouped, pack, pack_words, runs, shard_count, unpack, unpack_words

#: Frequent words with units of their own, units by ending, characters of an ending, classes, rounds of exchange.
UNITS, ENDINGS, ENDING, CLASSES, ROUNDS = 1 << 14, 1 << 12, 3, 64, 8
#: Weights of the lower order in the class bigram and trigram, units per group of the exchange step, groups that add up a
#: range first.
MU2, MU3, RANGE, SALTS = 20.0, 50.0, 256, 32
#: Tokens worked on at once inside a task, sparse counts added up at once, words of a row of the vocabulary, levels of counts.
TOKENS, CELLS, LISTED, LEVELS = 1 << 20, 1 << 22, 1 << 16, 4096
END = b""
FOLDS, HELD = 7, 2


def _split():
    def cut(data: bytes) -> list[bytes]:
        words = data.lower().split()
        words.append(END)
        return words

    return cut


def ending(word: bytes) -> int:
    """The unit of a word by its last characters."""
    return 1 + UNITS + zlib.crc32(word.decode("utf-8", "replace")[-ENDING:].encode()) % ENDINGS


def _key(word: bytes) -> int:
    return xxhash.xxh64_intdigest(word)


def _marks(words: list[bytes]) -> np.ndarray:
    """Hash of each word, and unit by its ending: what a word's unit follows from."""
    return np.array([[_key(w) for w in words], [ending(w) if w else 0 for w in words]], np.uint64).ravel()


class Frequent:
    """Units of frequent words: 1 and up, by their hashes."""

    def __init__(self, words: list[bytes]):
        keys = np.array([_key(w) for w in words], np.uint64)
        order = np.argsort(keys)
        self.keys, self.units = keys[order], (1 + order).astype(np.int64)

    def of(self, keys: np.ndarray, otherwise: np.ndarray) -> np.ndarray:
        """Unit of each word; 0 for the end, whose ``otherwise`` is 0."""
        if not len(self.keys):
            return otherwise
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where((self.keys[at] == keys) & (otherwise > 0), self.units[at], otherwise)

    def of_words(self, words: list[bytes]) -> np.ndarray:
        both = _marks(words).reshape(2, -1)
        return self.of(both[0], both[1].astype(np.int64))


N_UNITS = 1 + UNITS + ENDINGS
#: Class 0 is the end's own; its unit never moves.
N_CLASSES = CLASSES + 1
SIDES = 2 * N_CLASSES

VOCABULARY = "shard int, words binary, n binary, tokens long, types long, once long, twice long"


def _vocabulary_rows(shard: int, total: dict[bytes, int]) -> Iterator[pa.RecordBatch]:
    words, n = list(total), np.fromiter(total.values(), np.uint64, len(total))
    for k in range(0, len(words), LISTED):
        part = n[k : k + LISTED]
        row = {"shard": shard, "words": pack_words(words[k : k + LISTED]), "n": pack(part), "tokens": int(part.sum()), "types": len(part), "once": int((part == 1).sum()), "twice": int((part == 2).sum())}
        yield pa.RecordBatch.from_pylist([row], pa.schema([("shard", pa.int32()), ("words", pa.binary()), ("n", pa.binary()), *[(c, pa.int64()) for c in ("tokens", "types", "once", "twice")]]))


def _count_shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Training count of each distinct word of a shard that has any."""
    shard, total = None, {}
    for row in runs(batches):
        if row["shard"] != shard:
            if total:
                yield from _vocabulary_rows(shard, total)
            shard, total = row["shard"], {}
        for w, n in zip(unpack_words(row["words"]), unpack(row["marked"]).tolist(), strict=True):
            if n:
                total[w] = total.get(w, 0) + n
    if total:
        yield from _vocabulary_rows(shard, total)


def _level(n: np.ndarray) -> np.ndarray:
    """Counts in steps of about one percent."""
    return np.minimum(np.floor(np.log2(n.astype(np.float64)) * 64).astype(np.int64), LEVELS - 1)


def _levels(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen = np.zeros(LEVELS, np.int64)
    for row in runs(batches):
        seen += np.bincount(_level(unpack(row["n"])), minlength=LEVELS)
    at, n = _sparse(seen)
    yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(n, pa.int64())], names=["cell", "n"])


def _from_level(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in runs(batches):
            words, n = unpack_words(row["words"]), unpack(row["n"]).astype(np.int64)
            at = [i for i in np.flatnonzero(_level(n) >= least).tolist() if words[i] != END]
            yield pa.RecordBatch.from_arrays([pa.array([words[i] for i in at], pa.binary()), pa.array(n[at], pa.int64())], names=["word", "n"])

    return run


def most_frequent(vocabulary: DataFrame) -> list[bytes]:
    """The UNITS most frequent words, ties to the lesser. How many words there are of each level of counts tells which
    levels to look at, so tasks send no more than the words of these, whatever their number."""
    words = _collected(vocabulary.select("n").mapInArrow(_levels, "cell int, n long"), LEVELS)
    upto = np.cumsum(words[::-1])
    least = LEVELS - 1 - int(np.searchsorted(upto, UNITS + 1))
    rows = vocabulary.select("words", "n").mapInArrow(_from_level(max(least, 0)), "word binary, n long")
    return [bytes(r["word"]) for r in rows.orderBy(F.desc("n"), "word").limit(UNITS).select("word").collect()]


def _parts(row: dict) -> Iterator[tuple[list, np.ndarray, np.ndarray, np.ndarray]]:
    """ids, training flag of each token, sizes and codes of a block in runs of whole documents of about TOKENS tokens, so
    that what is computed for each token stays small."""
    sizes, flags, codes = unpack(row["sizes"]).astype(np.int64), unpack(row["flags"]).astype(bool), unpack(row["codes"])
    ends, first = np.cumsum(sizes), 0
    while first < len(sizes):
        start = int(ends[first] - sizes[first])
        stop = max(first + 1, int(np.searchsorted(ends, start + TOKENS, side="right")))
        yield row["ids"][first:stop], np.repeat(flags[first:stop], sizes[first:stop]), sizes[first:stop], codes[start : ends[stop - 1]]
        first = stop


def _units(row: dict, frequent: Frequent) -> np.ndarray:
    marks = unpack(row["marks"]).reshape(2, -1)
    return frequent.of(marks[0], marks[1].astype(np.int64))


def _before(classes: np.ndarray, sizes: np.ndarray, steps: int) -> np.ndarray:
    """The class ``steps`` before each token; before a text's start stands the end."""
    out = np.zeros_like(classes)
    out[steps:] = classes[:-steps] if len(classes) > steps else classes[:0]
    starts = np.cumsum(sizes) - sizes
    for k in range(steps):
        at = starts + k
        out[at[k < sizes]] = 0
    return out


def _after(classes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    out = np.zeros_like(classes)
    out[:-1] = classes[1:]
    out[np.cumsum(sizes) - 1] = 0
    return out


def _sparse(cells: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.flatnonzero(cells)
    return at, cells[at]


def _contexts(shared):
    """part, salt, cells, n: per range of units, sparse counts of (unit, side, neighbouring class) over training texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent, class_of = shared.value
        cells = np.zeros(N_UNITS * SIDES, np.int64)
        for row in runs(batches):
            units = _units(row, frequent)
            for _, training, sizes, codes in _parts(row):
                unit = units[codes]
                cls = class_of[unit].astype(np.int64)
                base = (unit * SIDES)[training]
                cells += np.bincount(base + _before(cls, sizes, 1)[training], minlength=len(cells))
                # the end has no right neighbour of its own
                cells += np.bincount((base + N_CLASSES + _after(cls, sizes)[training])[unit[training] > 0], minlength=len(cells))
        at, n = _sparse(cells)
        part = at // (RANGE * SIDES)
        edges = [*np.flatnonzero(np.diff(part, prepend=-1)).tolist(), len(at)]
        salt = TaskContext.get().partitionId() % SALTS
        rows = [(int(part[a]), salt, pack((at[a:b] % (RANGE * SIDES)).astype(np.uint32)), pack(n[a:b].astype(np.uint64))) for a, b in zip(edges[:-1], edges[1:], strict=True)]
        yield _part_rows(rows)

    return run


PART = "part int, salt int, cells binary, n binary"


def _part_rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (("part", pa.int32()), ("salt", pa.int32()), ("cells", pa.binary()), ("n", pa.binary()))
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, (_, t) in enumerate(kinds)], names=[n for n, _ in kinds])


def _sum_part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of one group, one row at a time."""
    total, row = np.zeros(RANGE * SIDES, np.uint64), None
    for row in runs(batches):
        total[unpack(row["cells"])] += unpack(row["n"])
    if row:
        at, n = _sparse(total)
        yield _part_rows([(row["part"], 0, pack(at.astype(np.uint32)), pack(n))])


def _dense(row: dict) -> np.ndarray:
    """unit of the range x (left, right) x class."""
    out = np.zeros(RANGE * SIDES)
    out[unpack(row["cells"])] = unpack(row["n"])
    return out.reshape(RANGE, 2, N_CLASSES)


def _class_pairs(class_of: np.ndarray):
    """Counts of class pairs, from the left contexts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = np.zeros((N_CLASSES, N_CLASSES))
            for row in batch.to_pylist():
                mine = class_of[row["part"] * RANGE : (row["part"] + 1) * RANGE]
                np.add.at(pairs.T, mine, _dense(row)[: len(mine), 0])
            at, n = _sparse(pairs.ravel())
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(n.astype(np.int64), pa.int64())], names=["cell", "n"])

    return run


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1e-12))


def best_classes(owner: np.ndarray, cell: np.ndarray, n: np.ndarray, mine: np.ndarray, pairs: np.ndarray, held: bool = False, step: int = 1 << 14) -> np.ndarray:
    """The class with the largest gain for each item. ``owner`` (ascending), ``cell`` (side x class) and ``n`` are the
    items' sparse contexts, ``mine`` their classes, ``pairs`` the class pair counts. An item counts in ``pairs`` already:
    for its own class the gain is what leaving it would lose. With ``held`` only classes that have words are open: an
    empty one would look best to all items at once."""
    table = np.concatenate([pairs, pairs.T])  # neighbour on the left, on the right
    known, sums = _xlogx(table), np.stack([pairs.sum(axis=0), pairs.sum(axis=1)])
    gain = np.zeros((len(mine), N_CLASSES))
    for k in range(0, len(owner), step):
        o, c, x = owner[k : k + step], cell[k : k + step], n[k : k + step, None].astype(float)
        part = _xlogx(table[c] + x) - known[c]
        own, row = mine[o], np.arange(len(o))
        part[row, own] = known[c, own] - _xlogx(np.maximum(table[c, own] - x[:, 0], 0))
        first = np.flatnonzero(np.diff(o, prepend=-1))
        gain[o[first]] += np.add.reduceat(part, first)
    row = np.arange(len(mine))
    for side in (0, 1):
        on = cell // N_CLASSES == side
        size = np.bincount(owner[on], weights=n[on], minlength=len(mine))[:, None]
        cost = _xlogx(sums[side] + size) - _xlogx(sums[side])
        cost[row, mine] = _xlogx(sums[side])[mine] - _xlogx(np.maximum(sums[side][mine] - size[:, 0], 0))
        gain -= cost
    gain[:, 0] = -np.inf
    if held:
        gain[:, sums[0] == 0] = -np.inf
    best = gain.argmax(axis=1)
    return np.where((mine > 0) & (gain[row, best] > gain[row, mine] + 1e-9), best, mine)


def _moves(class_of: np.ndarray, pairs: np.ndarray, turn: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in runs(batches):
            first = row["part"] * RANGE
            mine = class_of[first : first + RANGE]
            contexts = _dense(row)[: len(mine)].reshape(len(mine), -1)
            # half of the units stay in each round, so that neighbours don't swap places for ever
            contexts[(np.arange(first, first + len(mine)) * 2654435761 >> 7) % 2 != turn % 2] = 0
            owner, cell = np.nonzero(contexts)
            new = best_classes(owner, cell, contexts[owner, cell], mine, pairs)
            at = np.flatnonzero(new != mine)
            yield pa.RecordBatch.from_arrays([pa.array(at + first, pa.int32()), pa.array(new[at], pa.int32())], names=["unit", "class"])

    return run


def _collected(rows: DataFrame, size: int) -> np.ndarray:
    """Sums by cell, of fixed size."""
    out = np.zeros(size)
    for r in rows.groupBy("cell").agg(F.sum("n").alias("n")).collect():
        out[r["cell"]] = r["n"]
    return out


def clustered(docs: DataFrame, frequent: Frequent, rounds: int = ROUNDS) -> np.ndarray:
    """Class of each unit after rounds of exchange."""
    sc = docs.sparkSession.sparkContext
    class_of = np.zeros(N_UNITS, np.int32)
    class_of[1:] = 1 + np.arange(N_UNITS - 1) % CLASSES
    for turn in range(rounds):
        shared = sc.broadcast((frequent, class_of))
        once = docs.mapInArrow(_contexts(shared), PART).groupBy("part", "salt").applyInArrow(_sum_part, PART)
        sums = written(once.groupBy("part").applyInArrow(_sum_part, PART))
        pairs = _collected(sums.mapInArrow(_class_pairs(class_of), "cell int, n long"), N_CLASSES**2)
        moves = sums.repartition(64, "part").mapInArrow(_moves(class_of, pairs.reshape(N_CLASSES, N_CLASSES), turn), "unit int, class int").collect()
        class_of = class_of.copy()
        for r in moves:
            class_of[r["unit"]] = r["class"]
        shared.unpersist()
        if not moves:
            break
    return class_of


def _bigrams(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (frequent, class_of), cells = shared.value, np.zeros(N_CLASSES**2, np.int64)
        for row in runs(batches):
            units = _units(row, frequent)
            for _, training, sizes, codes in _parts(row):
                cls = class_of[units[codes]].astype(np.int64)
                cells += np.bincount((_before(cls, sizes, 1) * N_CLASSES + cls)[training], minlength=len(cells))
        at, n = _sparse(cells)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(n, pa.int64())], names=["cell", "n"])

    return run


def _added(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Sums by key, keys ascending."""
    key, n = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(key, kind="stable")
    key, n = key[order], n[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.empty(0, np.int64)
    return key[first], np.add.reduceat(n, first) if len(key) else n


#: What meets in a shard: vocabulary (block -1), a block's words, and contexts of its words by their place among them.
MEETING = "shard int, block long, kind int, words binary, a binary, b binary, c binary"
_VOCABULARY, _WORDS, _CONTEXTS = 0, 1, 2


def _word_contexts(shared):
    """Contexts of a block's words that have no unit of their own, per shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent, class_of = shared.value
        for row in runs(batches):
            units, shards = _units(row, frequent), unpack(row["shards"])
            keys, counts = [], []
            for _, training, sizes, codes in _parts(row):
                cls = class_of[units[codes]].astype(np.int64)
                on = training & (units[codes] > UNITS)
                base = codes[on].astype(np.int64) * SIDES
                both = np.concatenate([base + _before(cls, sizes, 1)[on], base + N_CLASSES + _after(cls, sizes)[on]])
                key, n = np.unique(both, return_counts=True)
                keys.append(key)
                counts.append(n)
            if not keys:
                continue
            key, n = _added(keys, counts)
            order = np.argsort(shards, kind="stable")
            place = np.empty(len(shards), np.int64)
            place[order] = np.arange(len(shards)) - np.searchsorted(shards[order], shards[order])
            code = key // SIDES
            by = np.lexsort((place[code], shards[code]))
            code, cell, n = code[by], (key % SIDES)[by], n[by]
            found, first = np.unique(shards[code], return_index=True)
            edges = [*first.tolist(), len(code)]
            for s, a, b in zip(found.tolist(), edges[:-1], edges[1:], strict=True):
                yield _meeting([(s, row["block"], _CONTEXTS, None, pack(place[code[a:b]].astype(np.uint32)), pack(cell[a:b].astype(np.uint16)), pack(n[a:b].astype(np.uint32)))])

    return run


def _meeting(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [("shard", pa.int32()), ("block", pa.int64()), ("kind", pa.int32()), *[(c, pa.binary()) for c in ("words", "a", "b", "c")]]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, (_, t) in enumerate(kinds)], names=[n for n, _ in kinds])


class _Shard:
    """The words of one shard with what is known of them, while its rows pass."""

    def __init__(self, shard: int):
        self.shard, self.words, self.n, self.index = shard, [], [], {}
        self.keys, self.counts, self.size = [], [], 0

    def add(self, words: list[bytes], n: np.ndarray) -> None:
        for w in words:
            self.index[w] = len(self.index)
        self.words += words
        self.n.append(n)

    def see(self, place: np.ndarray, cell: np.ndarray, n: np.ndarray, listed: list[bytes]) -> None:
        at = np.array([self.index[w] for w in listed], np.int64)
        self.keys.append(at[place] * SIDES + cell)
        self.counts.append(n.astype(np.int64))
        self.size += len(place)
        if self.size > CELLS:
            key, n = _added(self.keys, self.counts)
            self.keys, self.counts, self.size = [key], [n], 0

    def classes(self, frequent: Frequent, class_of: np.ndarray, pairs: np.ndarray) -> np.ndarray:
        mine = class_of[frequent.of_words(self.words)].astype(np.int64)
        if self.keys:
            key, n = _added(self.keys, self.counts)
            mine = best_classes(key // SIDES, key % SIDES, n, mine, pairs, held=True)
        return mine


CLASSED = "shard int, words binary, n binary, classes binary"


def _exchange_words(shared):
    """The vocabulary with the class of each word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent, class_of, pairs = shared.value

        def done(s: _Shard) -> Iterator[pa.RecordBatch]:
            if s.words:
                classes, n = s.classes(frequent, class_of, pairs).astype(np.uint8), np.concatenate(s.n)
                for k in range(0, len(s.words), LISTED):
                    part = slice(k, k + LISTED)
                    row = {"shard": s.shard, "words": pack_words(s.words[part]), "n": pack(n[part]), "classes": pack(classes[part])}
                    yield pa.RecordBatch.from_pylist([row], pa.schema([("shard", pa.int32()), *[(c, pa.binary()) for c in ("words", "n", "classes")]]))

        state, listed = None, None
        for row in runs(batches):
            if state is None or row["shard"] != state.shard:
                if state:
                    yield from done(state)
                state = _Shard(row["shard"])
            if row["kind"] == _VOCABULARY:
                state.add(unpack_words(row["words"]), unpack(row["a"]))
            elif row["kind"] == _WORDS:
                listed = row["words"]
            else:
                place = unpack(row["a"])
                words = unpack_words(listed)
                used, place = np.unique(place, return_inverse=True)
                state.see(place, unpack(row["b"]).astype(np.int64), unpack(row["c"]), [words[i] for i in used.tolist()])
        if state:
            yield from done(state)

    return run


def _known(shared):
    """block, shard, and for its words in order: corpus count and class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent, class_of = shared.value
        shard, known = None, {}
        for row in runs(batches):
            if row["shard"] != shard:
                shard, known = row["shard"], {}
            words = unpack_words(row["words"])
            if row["kind"] == _VOCABULARY:
                known.update(zip(words, zip(unpack(row["a"]).tolist(), unpack(row["b"]).tolist(), strict=True), strict=True))
                continue
            got = [known.get(w, (0, -1)) for w in words]
            classes = np.array([g[1] for g in got], np.int64)
            new = np.flatnonzero(classes < 0)
            if len(new):
                classes[new] = class_of[frequent.of_words([words[i] for i in new.tolist()])]
            yield pa.RecordBatch.from_arrays([pa.array([row["block"]], pa.int64()), pa.array([shard], pa.int32()), pa.array([pack(np.array([g[0] for g in got], np.uint64))], pa.binary()), pa.array([pack(classes.astype(np.uint8))], pa.binary())], names=["block", "shard", "n", "classes"])

    return run


STATE = "block long, ids array<long>, flags binary, sizes binary, codes binary, n binary, classes binary"


def _joined(docs: pa.Table, words: pa.Table) -> pa.Table:
    """A block's documents with counts and classes of its words, by code."""
    out = []
    for row in docs.to_pylist():
        block = Block(row)
        parts = sorted(zip(words.column("shard").to_pylist(), words.column("n").to_pylist(), words.column("classes").to_pylist(), strict=True))
        n, classes = (block.spread([unpack(p[k]) for p in parts]) for k in (1, 2))
        out.append({"block": row["block"], "ids": row["ids"], "flags": row["flags"], "sizes": row["sizes"], "codes": row["codes"], "n": pack(n), "classes": pack(classes)})
    kinds = [("block", pa.int64()), ("ids", pa.list_(pa.int64())), *[(k, pa.binary()) for k in ("flags", "sizes", "codes", "n", "classes")]]
    return pa.Table.from_pylist(out, pa.schema(kinds))


def _trigrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    cells = np.zeros(N_CLASSES**3, np.int64)
    for row in runs(batches):
        classes = unpack(row["classes"]).astype(np.int64)
        for _, training, sizes, codes in _parts(row):
            cls = classes[codes]
            one, two = _before(cls, sizes, 1), _before(cls, sizes, 2)
            cells += np.bincount(((two * N_CLASSES + one) * N_CLASSES + cls)[training], minlength=len(cells))
    at, n = _sparse(cells)
    yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(n, pa.int64())], names=["cell", "n"])


def _types(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many known words a class has."""
    seen = np.zeros(N_CLASSES, np.int64)
    for row in runs(batches):
        seen += np.bincount(unpack(row["classes"]), minlength=N_CLASSES)
    yield pa.RecordBatch.from_arrays([pa.array(range(N_CLASSES), pa.int32()), pa.array(seen, pa.int64())], names=["cell", "n"])


class Model:
    """Class n-gram tables, as logarithms, and what the words' shares need."""

    def __init__(self, trigrams: np.ndarray, types: np.ndarray, once: int, twice: int, train_tokens: int, train_types: int):
        self.train_tokens, self.train_types = train_tokens, train_types
        k = N_CLASSES
        three = trigrams.reshape(k, k, k).astype(np.float64)
        size = three.sum(axis=(0, 1))
        used = size > 0
        if not used[1:].any():
            used[1] = True  # no word is known: one class stands for the unknown word
        two = three.sum(axis=0)
        unigram = np.where(used, size + 1, 0.0)
        unigram = unigram / unigram.sum() if unigram.sum() else unigram
        bigram = (two + MU2 * unigram) / (two.sum(axis=1, keepdims=True) + MU2)
        trigram = (three + MU3 * bigram[None]) / (three.sum(axis=2, keepdims=True) + MU3)
        self.discount = min(max(once / (once + 2 * twice), 0.05), 0.95) if once else 0.5
        held_back = np.where(size > 0, self.discount * types / np.maximum(size, 1), used.astype(float))
        # the end is one word that is always known
        held_back[0] = 0.0
        with np.errstate(divide="ignore"):
            self.classes = np.log10(trigram)
            self.unknown = np.log10((trigram * held_back).sum(axis=2))
            self.size = np.log10(np.maximum(size, 1))

    def score(self, sizes: np.ndarray, codes: np.ndarray, counts: np.ndarray, classes: np.ndarray) -> np.ndarray:
        """log10 probability of each token."""
        cls = classes[codes]
        one, two = _before(cls, sizes, 1), _before(cls, sizes, 2)
        n = counts[codes].astype(np.float64)
        with np.errstate(divide="ignore", invalid="ignore"):
            known = self.classes[two, one, cls] + np.log10(n - np.where(cls == 0, 0.0, self.discount)) - self.size[cls]
        return np.where(n > 0, known, self.unknown[two, one])


SCORES = "doc_id long, n_tokens long, n_known long, base_score double, score double"


def _scores(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for row in runs(batches):
            counts, classes = unpack(row["n"]), unpack(row["classes"]).astype(np.int64)
            for ids, _, sizes, codes in _parts(row):
                starts = np.cumsum(sizes) - sizes
                n = counts[codes].astype(np.float64)
                total = max(model.train_tokens + model.train_types + 1, 1)
                base = np.log10((n + 1) / total)
                score = model.score(sizes, codes, counts, classes) if model.train_tokens else np.zeros(len(codes))
                sums = [np.add.reduceat(x, starts) for x in ((n > 0).astype(np.int64), base, score)]
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sizes), pa.array(sums[0]), pa.array(sums[1]), pa.array(sums[2])], names=["doc_id", "n_tokens", "n_known", "base_score", "score"])

    return run


def word_classes(word_rows: DataFrame, vocabulary: DataFrame, docs: DataFrame, frequent: Frequent, class_of: np.ndarray, shards: int) -> DataFrame:
    """shard, words, n, classes: the vocabulary with a class of each word's own, found by its own contexts."""
    sc = docs.sparkSession.sparkContext
    shared = sc.broadcast((frequent, class_of))
    pairs = _collected(docs.mapInArrow(_bigrams(shared), "cell int, n long"), N_CLASSES**2).reshape(N_CLASSES, N_CLASSES)
    none = F.lit(None).cast("binary")
    listed = vocabulary.select("shard", F.lit(-1).cast("long").alias("block"), F.lit(_VOCABULARY).alias("kind"), "words", F.col("n").alias("a"), none.alias("b"), none.alias("c"))
    words = word_rows.select("shard", "block", F.lit(_WORDS).alias("kind"), "words", none.alias("a"), none.alias("b"), none.alias("c"))
    met = listed.unionByName(words).unionByName(docs.mapInArrow(_word_contexts(shared), MEETING))
    return by_shard(met, shards, "block", "kind").mapInArrow(_exchange_words(sc.broadcast((frequent, class_of, pairs))), CLASSED)


class Trained(NamedTuple):
    """Blocks of documents with counts and classes of their words, the vocabulary with its classes, the model, and what
    gives a word that is not in the vocabulary its class."""

    state: DataFrame
    classed: DataFrame
    model: Model
    frequent: Frequent
    class_of: np.ndarray


def trained(docs: DataFrame, rounds: int = ROUNDS, id_col: str = "doc_id", text_col: str = "text") -> Trained:
    """Counts, classes and model from all documents outside the held-out fold; the blocks hold every document."""
    sc = docs.sparkSession.sparkContext
    plain = texts(docs, id_col, text_col)
    shards = shard_count(plain)
    parts = blocks(plain.withColumn("flag", fold(F.col("doc_id"), FOLDS) != HELD), _split, shards, mark=_marks)
    word_rows, kept = parts.where(F.col("kind") == WORDS), parts.where(F.col("kind") == DOCS)
    vocabulary = written(by_shard(word_rows.select("shard", "words", "marked"), shards).mapInArrow(_count_shards, VOCABULARY))
    total = vocabulary.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("tokens", "types", "once", "twice")]).first()
    frequent = Frequent(most_frequent(vocabulary))
    coded = kept.select("block", "ids", "flags", "sizes", "codes", "shards", "marks")
    class_of = clustered(coded, frequent, rounds)
    classed = written(word_classes(word_rows, vocabulary, coded, frequent, class_of, shards))
    listed = classed.select("shard", F.lit(-1).cast("long").alias("block"), F.lit(_VOCABULARY).alias("kind"), "words", F.col("n").alias("a"), F.col("classes").alias("b"))
    words = word_rows.select("shard", "block", F.lit(_WORDS).alias("kind"), "words", F.lit(None).cast("binary").alias("a"), F.lit(None).cast("binary").alias("b"))
    known = by_shard(listed.unionByName(words), shards, "block").mapInArrow(_known(sc.broadcast((frequent, class_of))), "block long, shard int, n binary, classes binary")
    state = written(grouped(kept.select("block", "ids", "flags", "sizes", "codes", "shards"), shards).cogroup(grouped(known, shards)).applyInArrow(_joined, STATE))
    cells = _collected(state.mapInArrow(_trigrams, "cell int, n long"), N_CLASSES**3)
    types = _collected(classed.mapInArrow(_types, "cell int, n long"), N_CLASSES)
    return Trained(state, classed, Model(cells, types, total["once"], total["twice"], total["tokens"], total["types"]), frequent, class_of)


def scored(docs: DataFrame, rounds: int = ROUNDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score and perplexity of every document."""
    got = trained(docs, rounds, id_col, text_col)
    rows = got.state.mapInArrow(_scores(docs.sparkSession.sparkContext.broadcast(got.model)), SCORES)
    perplexity = F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens"))
    return rows.select("doc_id", (fold(F.col("doc_id"), FOLDS) == HELD).alias("held_out"), "n_tokens", "n_known", F.lit(got.model.train_tokens).cast("long").alias("train_tokens"), "base_score", "score", perplexity.alias("perplexity"))
