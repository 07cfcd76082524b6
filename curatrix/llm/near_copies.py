"""Near copies by covering SimHash and exact shingle overlap: every pair of texts whose sets of five-word shingles have a
Jaccard similarity of at least 0.8 is found, and verified.

The covering tables of covering_simhash, over fingerprints of five-word shingles, bring the closest texts together. They
can't find all: at 0.8 about ten of 64 bits differ on average, more for half of the pairs, and a covering for radius r
takes 2^(r + 1) - 1 keys a text. Prefix filtering finds the rest: with all shingles in one order, two texts
that similar share one among the first n - ceil(0.8 n) + 1 of each. The order goes by counts in a table of fixed size,
rarest first, so common lines and passages are hardly ever keys; any order gives the same pairs. A sketch of 256 parities
of a text's shingles bounds from below how many shingles two texts don't share; a pair that it shows to be apart is no
candidate. At some 500 shingles that bound is weak, so texts that share a shingle with many others carry one of 1024.

Texts first fall together by their words; only distinct ones are searched. The first round verifies the covering's links.
What these connect is not paired again: of the texts that share a prefix shingle and are still apart, the next rounds verify
each with one before it, as a tree, in another order each time; the last round takes all pairs left, so no pair is lost, and
large groups of copies don't give all their pairs. Groups that are too large for a task are parted (``_split``).

Defined cases: words are as in covering_simhash; a text of fewer words than a shingle is one shingle; a very long text
counts whole; null text counts as empty, and texts without words are copies of each other; repeated rows are copies; rows
with a null id stay; an empty table gives an empty result; other columns, of whatever names, are ignored, and ``keep_one``
keeps them.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curatrix.llm.common import forget, one_of_each, sliced, texts, written
from curatrix.llm.covering_simhash import fingerprint, links, signed
from curatrix.llm.graph import components

#: Words of a shingle, least similarity, counts of shingles and parts they are sent in, members per link, tree rounds, most
#: rows of a group.
SHINGLE, SIMILARITY, COUNTS, PARTS, BRANCH, TREES, MOST = 5, 0.8, 1 << 20, 256, 32, 2, 1 << 14
#: Texts that share a shingle, from which on they carry the wide sketch, of so many words.
MANY, WIDE = 24, 16
#: Sketches have four words of 64 parities.
SKETCH = ("s0", "s1", "s2", "s3")
_SLACK = 1e-9


def words_key(text: bytes) -> int:
    """A text's words, as one signed number."""
    return int(np.uint64(xxhash.xxh64_intdigest(b" ".join(text.lower().split()), 7)).view(np.int64))


def shingles(text: bytes, width: int = SHINGLE) -> np.ndarray:
    """Hashes of the text's distinct shingles, ascending."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= width:
        return np.array([digest(joined, 42)], np.uint64)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = np.concatenate([[0], ends[:-width]]).tolist()
    return np.unique(np.fromiter((digest(joined[a:b], 42) for a, b in zip(starts, (ends[width - 1 :] - 1).tolist(), strict=True)), np.uint64, len(starts)))


def _keys(width: int, most: int = 200_000):
    """Key of each text's words, and SimHash of its shingles; copies within a task are hashed once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, int] = {}
        for batch in sliced(batches):
            keys, prints = [], []
            for x in batch.column(2).cast(pa.binary()):
                text = x.as_py()
                key = words_key(text)
                if key not in known:
                    if len(known) >= most:
                        known.clear()
                    known[key] = signed(fingerprint(text, width))
                keys.append(key)
                prints.append(known[key])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(keys, pa.int64()), pa.array(prints, pa.int64())], names=["doc_id", "raw", "key", "fp"])

    return run


def covered(distinct: DataFrame) -> DataFrame:
    """u, v: of distinct texts (key, fp), links that connect those of equal fingerprints, and those within the covering's
    radius."""
    leads = written(distinct.groupBy("fp").agg(F.min("key").alias("lead")))
    same = distinct.join(leads, "fp").where("key <> lead").select(F.least("key", "lead").alias("u"), F.greatest("key", "lead").alias("v"))
    ends = links(leads.select("fp")).join(leads.select(F.col("fp").alias("u"), F.col("lead").alias("a")), "u").join(leads.select(F.col("fp").alias("v"), F.col("lead").alias("b")), "v")
    return same.unionByName(ends.select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")))


def _distinct(batches: Iterator[pa.RecordBatch], width: int, most: int = 1_000_000) -> Iterator[tuple[int, np.ndarray]]:
    """Key and shingles of a task's texts; copies within a task come once."""
    seen: set[int] = set()
    for batch in sliced(batches):
        for x in batch.column(0).cast(pa.binary()):
            text = x.as_py()
            key = words_key(text)
            if key not in seen:
                if len(seen) >= most:
                    seen.clear()
                seen.add(key)
                yield key, shingles(text, width)


def _counts(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(COUNTS, np.uint32)
        for _, found in _distinct(batches, width):
            np.add.at(total, (found % COUNTS).astype(np.int64), 1)
        parts = total.reshape(PARTS, -1)
        used = np.flatnonzero(parts.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array([parts[p].tobytes() for p in used], pa.binary())], names=["part", "n"])

    return run


def _sum_counts(rows: pa.Table) -> pa.Table:
    total = np.zeros(COUNTS // PARTS, np.uint64)
    for n in rows.column("n"):
        total += np.frombuffer(n.as_py(), np.uint32)
    return pa.table({"part": rows.column("part").slice(0, 1), "n": pa.array([np.minimum(total, (1 << 32) - 1).astype(np.uint32).tobytes()], pa.binary())})


def shingle_counts(plain: DataFrame, width: int = SHINGLE) -> np.ndarray:
    """How many texts have a shingle of each remainder by COUNTS: a table of fixed size."""
    out = np.zeros((PARTS, COUNTS // PARTS), np.uint32)
    for r in plain.select("text").mapInArrow(_counts(width), "part int, n binary").groupBy("part").applyInArrow(_sum_counts, "part int, n binary").toLocalIterator():
        out[r["part"]] = np.frombuffer(bytes(r["n"]), np.uint32)
    return out.ravel()


def sketch(found: np.ndarray, words: int = 4) -> np.ndarray:
    """64 parities a word of a set of shingles: how many of those two sets differ by is at least how many of theirs differ."""
    bits = 64 * words
    parity = np.bincount((found >> np.uint64(20) & np.uint64(bits - 1)).astype(np.int64), minlength=bits) % 2
    return np.packbits(parity.astype(np.uint8), bitorder="little").view(np.int64)


KIND = "token long, key long, n int, at int, s0 long, s1 long, s2 long, s3 long, wide binary"
#: Place of the row that carries a text's sketch; its token is its key.
_OWN = -1


def _prefixes(shared, width: int, similarity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, out, size = shared.value, [], 0
        for key, found in _distinct(batches, width):
            n = len(found)
            first = n - math.ceil(similarity * n - _SLACK) + 1 if n else 0
            order = np.lexsort((found, counts[(found % COUNTS).astype(np.int64)]))[:first]
            out.append((found[order].view(np.int64), key, n, sketch(found), sketch(found, WIDE).tobytes()))
            size += len(order) + 1
            if size >= 100_000:
                yield _prefix_rows(out)
                out, size = [], 0
        if out:
            yield _prefix_rows(out)

    return run


def _prefix_rows(out: list[tuple[np.ndarray, int, int, np.ndarray, bytes]]) -> pa.RecordBatch:
    sizes = [len(x[0]) + 1 for x in out]
    spread = lambda values, kind: np.repeat(np.array(values, kind), sizes)
    columns = [np.concatenate([np.append(x[0], x[1]) for x in out]), spread([x[1] for x in out], np.int64), spread([x[2] for x in out], np.int32), np.concatenate([np.append(np.arange(len(x[0]), dtype=np.int32), np.int32(_OWN)) for x in out])]
    plain = np.concatenate([np.arange(s) < s - 1 for s in sizes])
    marks = [pa.array(spread([x[3][k] for x in out], np.int64), mask=plain) for k in range(4)]
    wide = pa.array([w for x, size in zip(out, sizes, strict=True) for w in (*[None] * (size - 1), x[4])], pa.binary())
    return pa.RecordBatch.from_arrays([*map(pa.array, columns), *marks, wide], names=["token", "key", "n", "at", *SKETCH, "wide"])


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows, whole tokens at a time: the rows of a token that may go on wait for the next batch."""
    rest: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        token = batch.column(0).to_numpy()
        cut = int(np.searchsorted(token, token[-1]))
        if cut or (rest and rest[-1].column(0)[-1].as_py() != token[0]):
            yield pa.Table.from_batches([*rest, batch.slice(0, cut)]).combine_chunks()
            rest = []
        rest.append(batch.slice(cut))
    if rest:
        yield pa.Table.from_batches(rest).combine_chunks()


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows whose token several texts have, and each text's own one."""
    for rows in _runs(batches):
        token, key, at = (rows.column(c).to_numpy() for c in ("token", "key", "at"))
        order = np.lexsort((at, key, token))
        token, key, at = token[order], key[order], at[order]
        own = at == _OWN
        new = np.concatenate([[True], (token[1:] != token[:-1]) | (key[1:] != key[:-1]) | (own[1:] != own[:-1])])
        order, token, own = order[new], token[new], own[new]
        other = np.flatnonzero(~own)
        same = token[other][1:] == token[other][:-1]
        many = own.copy()
        many[other] = np.concatenate([[False], same]) | np.concatenate([same, [False]]) if len(other) else False
        yield from rows.take(pa.array(order[many])).to_batches()


def _near_enough(i, j, n: np.ndarray, held: np.ndarray, wide: np.ndarray, similarity: float) -> np.ndarray:
    """The same by the wide sketches; ``held`` is each row's place among them, -1 without one."""
    both = (held[i] >= 0) & (held[j] >= 0)
    good = np.ones(len(i), bool)
    for at in np.array_split(np.flatnonzero(both), max(1, both.sum() // 50_000)):
        apart = np.bitwise_count(wide[held[i[at]]] ^ wide[held[j[at]]]).sum(axis=-1)
        good[at] = apart <= (1 - similarity) / (1 + similarity) * (n[i[at]] + n[j[at]]) + _SLACK
    return good


def _possible(i, j, n: np.ndarray, at: np.ndarray, marks: np.ndarray, similarity: float) -> np.ndarray:
    """Whether the texts can be similar enough if this token is the first they share, as one of theirs is, and by their
    sketches."""
    total = n[i] + n[j]
    good = np.minimum(n[i] - at[i], n[j] - at[j]) >= similarity / (1 + similarity) * total - _SLACK
    good &= np.bitwise_count(marks[i] ^ marks[j]).sum(axis=-1) <= (1 - similarity) / (1 + similarity) * total + _SLACK
    return good


def _candidates(turn: int, similarity: float):
    def pairs(key: np.ndarray, n: np.ndarray, root: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        if turn < TREES:
            # in each round others come before a member: by size, then by a hash of the round
            mixed = (key.view(np.uint64) ^ np.uint64(turn)) * np.uint64(0x9E3779B97F4A7C15)
            order = np.lexsort((key, n)) if turn == 0 else np.argsort(mixed ^ mixed >> np.uint64(29), kind="stable")
            i = np.arange(1, len(key))
            yield order[(i - 1) // BRANCH], order[i]
            return
        # members of the largest part meet only those of others
        parts, of, size = np.unique(root, return_inverse=True, return_counts=True)
        order = np.argsort(of == size.argmax(), kind="stable")
        for k in range(len(key) - int(size.max())):
            yield np.full(len(key) - k - 1, order[k]), order[k + 1 :]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _runs(batches):
            token, key, n, at, root = (rows.column(c).to_numpy() for c in ("token", "key", "n", "at", "root"))
            marks = np.stack([rows.column(c).to_numpy() for c in SKETCH], axis=1).view(np.uint64)  # bits of signed numbers would be those of their absolute values
            n, at = n.astype(np.int64), at.astype(np.int64)
            told = rows.column("wide")
            has = told.is_valid().to_numpy(zero_copy_only=False)
            held = np.where(has, np.cumsum(has) - 1, -1)
            wide = np.frombuffer(b"".join(told.drop_null().to_pylist()), np.uint64).reshape(-1, WIDE)
            edges = [*np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]])).tolist(), len(token)]
            out, size = [], 0
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                if (root[a:b] == root[a]).all():
                    continue
                for i, j in pairs(key[a:b], n[a:b], root[a:b]):
                    i, j = i + a, j + a
                    apart = root[i] != root[j]
                    i, j = i[apart], j[apart]
                    good = _possible(i, j, n, at, marks, similarity)
                    if good.any():
                        some = np.flatnonzero(good)
                        good[some] = _near_enough(i[some], j[some], n, held, wide, similarity)
                    if good.any():
                        u, v = key[i[good]], key[j[good]]
                        out.append((np.minimum(u, v), np.maximum(u, v)))
                        size += len(u)
                    if size >= 100_000:
                        yield _pair_rows(out)
                        out, size = [], 0
            if out:
                yield _pair_rows(out)

    return run


def _pair_rows(out: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    both = np.unique(np.stack([np.concatenate([x[0] for x in out]), np.concatenate([x[1] for x in out])], axis=1), axis=0)
    return pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], names=["u", "v"])


def _sets(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            found = [shingles(x.as_py(), width).tobytes() for x in batch.column(1).cast(pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary())], names=["key", "found"])

    return run


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    common = len(np.intersect1d(a, b, assume_unique=True))
    return common / max(len(a) + len(b) - common, 1)


def _verified(similarity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            good = [jaccard(np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)) >= similarity - _SLACK for x, y in zip(batch.column(2), batch.column(3), strict=True)]
            yield batch.select(["u", "v"]).filter(pa.array(good, pa.bool_()))

    return run


def _split(placed: DataFrame, hot: DataFrame, turn: int, most: int) -> DataFrame:
    """Rows dealt so that no group is much larger than ``most``: the groups of tokens in ``hot`` (token, size) are parted, and
    a new number takes the token's place (were two to agree, pairs would only be tried in vain).

    For the tree, parts are groups of their own, and their first members one more. For all pairs, the rows of a token's most
    frequent root need no pairs among themselves: each part of the other rows meets each other one and each part of these."""
    columns, rows = placed.columns, placed.join(hot, "token")
    cold = placed.join(hot.select("token"), "token", "left_anti")
    part = lambda n: F.pmod(F.xxhash64("key"), F.ceil(n / most)).cast("int")
    if turn < TREES:
        dealt = rows.withColumn("part", part(F.col("size")))
        leads = dealt.groupBy("token", "part").agg(F.min(F.struct("n", "key", *[c for c in columns if c not in ("token", "n", "key")])).alias("r")).select("token", "r.*").withColumn("part", F.lit(-1))
        both = dealt.select(*columns, "part").unionByName(leads.select(*columns, "part"))
        return cold.unionByName(both.withColumn("token", F.xxhash64("token", "part")).select(columns))
    counts = rows.groupBy("token", "root").agg(F.count("*").alias("c"))
    main = counts.groupBy("token").agg(F.max_by("root", F.struct("c", "root")).alias("main"), F.max("c").alias("c"))
    dealt = rows.join(main, "token").withColumn("others", F.ceil((F.col("size") - F.col("c")) / most).cast("int")).withColumn("mains", F.ceil(F.col("c") / most).cast("int")).where("others > 0")
    upto = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    group = lambda side, i, j: F.xxhash64("token", F.lit(side), i, j)
    apart = dealt.where("root <> main").withColumn("part", F.pmod(F.xxhash64("key"), F.col("others")).cast("int"))
    places = F.concat(F.transform(upto("others"), lambda j: group("o", F.least("part", j), F.greatest("part", j))), F.transform(upto("mains"), lambda j: group("m", F.col("part"), j)))
    core = dealt.where("root = main").withColumn("part", F.pmod(F.xxhash64("key"), F.col("mains")).cast("int"))
    out = [df.withColumn("token", F.explode(p)).select(columns) for df, p in ((apart, places), (core, F.transform(upto("others"), lambda i: group("m", i, F.col("part")))))]
    return cold.unionByName(out[0]).unionByName(out[1])


def near_copies(docs: DataFrame, similarity: float = SIMILARITY, width: int = SHINGLE, most: int = MOST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, raw (hash of the text as it is) and component_id (smallest doc_id of the component) of every row with
    an id; texts are linked exactly if their similarity is at least ``similarity``."""
    plain = texts(docs, id_col, text_col).where("doc_id IS NOT NULL")
    rows = written(plain.select("doc_id", F.xxhash64("text").alias("raw"), "text").mapInArrow(_keys(width), "doc_id long, raw long, key long, fp long"))
    counts = docs.sparkSession.sparkContext.broadcast(shingle_counts(plain, width))
    prefixes = plain.select("text").mapInArrow(_prefixes(counts, width, similarity), KIND)
    shared = written(prefixes.repartition("token").sortWithinPartitions("token").mapInArrow(_shared, KIND))
    places = shared.where(F.col("at") != _OWN).select("token", "key", "n", "at")
    marks = shared.where(F.col("at") == _OWN).select("key", *SKETCH, "wide")
    sizes = written(places.groupBy("token").agg(F.count("*").alias("size")).where(F.col("size") >= min(MANY, most + 1)))
    flagged = written(places.join(sizes.select("token", F.lit(True).alias("big")), "token", "left"))
    # one row holds each text that is to be compared
    holder = rows.groupBy("key").agg(F.min(F.struct("doc_id", "raw")).alias("row")).select("key", "row.*")
    hot = sizes.where(F.col("size") > most)
    hot = None if hot.isEmpty() else hot

    def good_links(fresh: DataFrame) -> DataFrame:
        # only texts of candidates are read again and moved
        asked = fresh.select(F.col("u").alias("key")).unionByName(fresh.select(F.col("v").alias("key"))).distinct()
        held = plain.withColumn("raw", F.xxhash64("text")).join(written(holder.join(asked, "key")), ["doc_id", "raw"]).select("key", "text")
        sets = written(held.mapInArrow(_sets(width), "key long, found binary").groupBy("key").agg(F.first("found").alias("found")))
        ready = fresh.join(sets.select(F.col("key").alias("u"), F.col("found").alias("x")), "u").join(sets.select(F.col("key").alias("v"), F.col("found").alias("y")), "v")
        good = written(ready.select("u", "v", "x", "y").mapInArrow(_verified(similarity), "u long, v long"))
        # shingles are the bulk of what a round writes, and only its verification reads them
        forget(sets)
        return good

    tested = written(covered(written(rows.groupBy("key").agg(F.min("fp").alias("fp")))).distinct())
    linked = good_links(tested)
    roots = written(components(linked).withColumnRenamed("node", "key"))
    for turn in range(TREES + 1):
        known = marks.join(roots, "key", "left").withColumn("root", F.coalesce("root", "key"))
        placed = flagged.join(known, "key").select("token", "key", "n", "at", "root", *SKETCH, F.when(F.col("big"), F.col("wide")).alias("wide"))
        if hot is not None:
            placed = _split(placed, hot, turn, most)
        found = placed.repartition("token").sortWithinPartitions("token").mapInArrow(_candidates(turn, similarity), "u long, v long").distinct()
        fresh = written(found.join(tested, ["u", "v"], "left_anti"))
        tested = written(tested.unionByName(fresh))
        linked = linked.unionByName(good_links(fresh))
        roots = written(components(linked).withColumnRenamed("node", "key"))
    classes = rows.join(roots, "key", "left").select("doc_id", "raw", F.coalesce("root", "key").alias("root"))
    firsts = classes.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    return classes.join(firsts, "root").select("doc_id", "raw", "component_id")


def keep_one(docs: DataFrame, similarity: float = SIMILARITY, width: int = SHINGLE, most: int = MOST) -> DataFrame:
    """The documents without near copies: of each component the rows of its smallest doc_id stay (all texts of that id
    that belong to it), and of rows repeated in all columns one. Rows without an id stay."""
    return one_of_each(docs, near_copies(docs, similarity, width, most).where("doc_id <> component_id").select("doc_id", "raw").distinct())
