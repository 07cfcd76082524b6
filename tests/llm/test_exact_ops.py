"""Operators whose results are exact, against brute force."""

import hashlib
import math
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from conftest_data import SF, read

from curatrix.llm import blob_ledger, bpe_words, covering_simhash, norm_topk, png_media, queries, slack_packing

BASE = {
    "assign": (re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), lambda m: len(m[2]) >= 6),
    "access": (re.compile(r"AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 20),
    "hex": (re.compile(r"[0-9a-f]+"), lambda m: len(m[0]) >= 24),
}


def base_spans(text):
    order = list(BASE)
    found = [(m.start(), order.index(k), m.end()) for k, (p, ok) in BASE.items() for m in p.finditer(text) if ok(m)]
    return [(order[k], a, b) for a, k, b in sorted(found)]


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_same_rows_as_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for table in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    want = con.execute(queries.ORACLE_SQL[name])
    names = sorted(c[0] for c in want.description)
    got = queries.QUERIES[name](spark, SF)
    assert sorted(got.columns) == names
    want = want.df()[names].values.tolist()
    assert sorted(tuple(map(str, r)) for r in got.select(*names).collect()) == sorted(tuple(map(str, r)) for r in want)


def check_secrets(rows, docs):
    texts = defaultdict(list)
    for i, t in docs:
        texts[i].append(t or "")
    assert sorted(str(r.doc_id) for r in rows) == sorted(str(i) for i, _ in docs)
    for r in rows:
        spans = base_spans(texts[r.doc_id][0])
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(s[0] == k for s in spans) for k in BASE)
        shown = ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
        assert r.base_sha256 == hashlib.sha256(shown.encode()).hexdigest()
        assert [x for x in r.spans.split(",") if x.split(":")[0] in BASE] == [x for x in shown.split(",") if x]


def test_secrets_against_brute_force(spark):
    check_secrets(queries.op2_blob_ledger(spark, SF).collect(), read("documents", "doc_id", "text"))


def test_secrets_odd_rows(spark):
    rows = [(1, 'API_KEY = "abcdef1" token:short secret="x"'), (2, "AKIA" + "A" * 16 + " AKIA1"), (3, "0" * 23 + " " + "a" * 24 + "😀" + "b" * 30), (4, None), (5, ""), (6, "paſſword = abcdefgh toKen=abcdefgh"), (7, "token = 'ghp_" + "a1" * 20 + "'"), (None, "passwd=abcdefgh")]
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, blob string, found int")
    check_secrets(blob_ledger.digest(blob_ledger.findings(df)).collect(), rows)
    assert blob_ledger.digest(blob_ledger.findings(df.limit(0))).count() == 0


def test_ledger_scans_only_unseen_pairs(spark, tmp_path):
    docs = spark.createDataFrame([(1, "token = abcdefgh"), (2, "token = abcdefgh"), (3, "AKIA" + "Z" * 16)], "doc_id long, text string")
    path, pairs = f"{tmp_path}/ledger", len(blob_ledger.RULES)

    def run(rows, rules=blob_ledger.RULES):
        return {r.doc_id: (r.spans, r.scanned, r.reused) for r in blob_ledger.digest(blob_ledger.findings(rows, path, rules)).collect()}

    want = {1: "assign:0:16", 2: "assign:0:16", 3: "access:0:20"}
    assert run(docs) == {i: (s, pairs, 0) for i, s in want.items()}
    assert blob_ledger.ledger(spark, path).count() == 2  # copies are one blob
    assert run(docs) == {i: (s, 0, pairs) for i, s in want.items()}
    assert blob_ledger.scan_unseen(docs, blob_ledger.ledger(spark, path)).count() == 0
    newer = tuple(r._replace(version=2) if r.kind == "assign" else r for r in blob_ledger.RULES)
    assert run(docs, newer) == {i: (s, 1, pairs - 1) for i, s in want.items()}
    more = docs.union(spark.createDataFrame([(4, "new"), (1, None)], "doc_id long, text string"))
    assert run(more, newer)[4] == ("", pairs, 0) and run(more, newer)[3] == ("access:0:20", 0, pairs)
    # a ledger's spans are taken over, not found again
    moved = blob_ledger.ledger(spark, path).withColumn("found", F.transform("found", lambda f: f.withField("spans", F.transform(f["spans"], lambda x: x.withField("end", x["end"] + 1000)))))
    moved.write.parquet(f"{tmp_path}/other/scan-1")
    assert [r.spans for r in blob_ledger.digest(blob_ledger.findings(docs.where("doc_id = 3"), f"{tmp_path}/other")).collect()] == ["access:0:1020"]


def test_redaction_keeps_the_rest(spark, odd_docs):
    text = "a token = abcdefgh0 b " + "f" * 40
    docs = spark.createDataFrame([(1, text, 5, "y", 1), (2, "clean", 5, "y", 2), (3, None, None, None, None), (1, text, 5, "y", 1)], "doc_id long, text string, n_chars long, found string, blob int")
    out = blob_ledger.redact(docs)
    assert out.schema == docs.schema
    assert sorted(out.collect(), key=lambda r: (r.doc_id, str(r.text))) == [(1, "a [SECRET] b [SECRET]", 21, "y", 1)] * 2 + [(2, "clean", 5, "y", 2), (3, None, None, None, None)]
    assert sorted(map(str, blob_ledger.redact(odd_docs).collect())) == sorted(map(str, odd_docs.collect()))
    assert blob_ledger.redact(odd_docs.limit(0)).count() == 0
    plan = blob_ledger.redact(docs)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1  # one pass; blobs were scanned before


def check_packing(rows, docs):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(slack_packing.default_path())
    want = sorted(((str(i), [*t.encode(x or "", add_special_tokens=False).ids, 1]) for i, x in docs), key=lambda x: (x[0], len(x[1])))
    by_doc = defaultdict(list)
    for r in rows:
        by_doc[str(r.doc_id)].append(r)
    for i, ids in want:
        mine = [r for r in by_doc[i] if r.doc_tokens == len(ids)]
        copies = len(mine) * 2048 // max(2048, len(ids) + (-len(ids)) % 2048)
        got = sorted({(r.start, r.length, r.ids_crc32) for r in mine})
        assert got == [(s, len(ids[s : s + 2048]), zlib.crc32(np.array(ids[s : s + 2048], "<u4").tobytes())) for s in range(0, len(ids), 2048)]
        assert copies >= 1
    assert len(rows) == sum(math.ceil(len(ids) / 2048) for _, ids in want)
    windows = defaultdict(list)
    for r in rows:
        windows[r.sequence_id].append((r.offset, r.length))
    for parts in windows.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    return len(windows), sum(len(ids) for _, ids in want)


def test_packing_against_brute_force(spark):
    windows, total = check_packing(queries.op3_slack_packing(spark, SF).collect(), read("documents", "doc_id", "text"))
    assert windows <= math.ceil(total / 2048) + 2


def test_packing_odd_rows(spark, odd_docs):
    extra = spark.createDataFrame([(20, "a<|endoftext|>B ’s ǅ İ é  x y\x1cz"), (21, "don't DON'T 12,5%")], "doc_id long, text string")
    docs = odd_docs.select("doc_id", "text", "word", "fp").unionByName(extra, allowMissingColumns=True)
    check_packing(slack_packing.pack(docs).collect(), [(r.doc_id, r.text) for r in docs.collect()])
    assert slack_packing.pack(docs.limit(0)).count() == 0


def test_fillings_use_everything_once():
    rng = np.random.default_rng(1)
    histogram = {int(k): int(n) for k, n in zip(*np.unique(rng.integers(1, 2048, 3000), return_counts=True), strict=True)}
    used = defaultdict(int)
    patterns = slack_packing.fillings(histogram)
    for counts, times in patterns:
        assert sum(k * n for k, n in counts.items()) <= 2048
        for k, n in counts.items():
            used[k] += n * times
    assert dict(used) == histogram
    assert sum(t for _, t in patterns) <= 1.01 * sum(k * n for k, n in histogram.items()) / 2048 + 2


def brute_topk(vectors):
    """A candidate row each, equal query rows once; products clipped to a long."""
    good = [(i, tuple(math.floor(1024 * float(x)) for x in v)) for i, v in vectors if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    found = defaultdict(list)
    for q, x in {(i, v) for i, v in good if i % 100 == 0}:
        found[q] += [(-min(max(sum(a * b for a, b in zip(x, v, strict=True)), -(2**63)), 2**63 - 1), i) for i, v in good if i != q and len(v) == len(x)]
    return sorted((q, k + 1, i, -s) for q, scores in found.items() for k, (s, i) in enumerate(sorted(scores)[:10]))


def topk_rows(df):
    return sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in df.collect())


def test_topk_against_brute_force(spark):
    assert topk_rows(queries.op5_norm_topk(spark, SF)) == brute_topk(read("embeddings", "vec_id", "embedding"))


def test_topk_odd_vectors(spark):
    rng = np.random.default_rng(0)
    rows = [(i, rng.normal(size=8).tolist()) for i in range(0, 600)] + [(i, [0.5] * 8) for i in range(700, 760)] + [(800, None), (900, [float("nan")] * 8), (1000, [None] * 8), (1100, []), (1200, [1.0] * 5), (1300, [0.0] * 8), (None, [1.0] * 8), (1401, [-2.0] * 8), (300, [0.25] * 8), (300, [0.25] * 8)]
    df = spark.createDataFrame([(i, v, 1, "z", 2.0, 3) for i, v in rows], "vec_id long, embedding array<float>, score int, block string, x double, at int")
    want = brute_topk([(r.vec_id, r.embedding) for r in df.collect()])
    for shard_rows, block_rows in ((None, None), (100, 2)):
        assert topk_rows(norm_topk.top_products(df, shard_rows=shard_rows, block_rows=block_rows)) == want
    assert norm_topk.top_products(df.limit(0)).count() == 0


def test_topk_takes_components_of_any_size(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=4).tolist()) for i in range(0, 300)] + [(400, [3.0e6, 1.0, 2.0, 0.5]), (401, [3.0e6, -1.0, 0.0, 7.0]), (402, [3.0e12] * 4), (500, [1e38, -1e38, 3.0, 0.0]), (501, [1e300, 0.1, 0.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    for shard_rows in (None, 40):
        assert topk_rows(norm_topk.top_products(df, shard_rows=shard_rows, block_rows=shard_rows)) == brute_topk(rows)


def test_topk_leaves_out_buckets_that_are_too_short(spark, monkeypatch):
    # queries and 40 candidates point one way, all others are short: the later buckets can't reach the thresholds
    rows = [(100 * i, [1.0, 0.1 * i]) for i in range(4)] + [(1000 + i, [50.0, 1.0 + 0.001 * i]) for i in range(1, 41)] + [(2000 + i, [0.001 * (i % 7), 0.002]) for i in range(1, 400)]
    rows = [(i, v) for i, v in rows if i < 400 or i % 100]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    met = []
    plain = norm_topk._met
    monkeypatch.setattr(norm_topk, "_met", lambda q, c, k: met.append(c.count()) or plain(q, c, k))
    assert topk_rows(norm_topk.top_products(df, shard_rows=40, block_rows=10)) == brute_topk(rows)
    assert len(met) == 2 and met[1] == 0


def check_media(rows, docs):
    texts = {i: (t or "").encode() for i, t in docs}
    assert len(rows) == len(docs)
    for r in rows:
        data = texts[r.doc_id]
        payload = data + b" " * ((-len(data)) % 192 if data else 192)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
        assert len(r.feature) == 16 and r.media_bytes > 0


def test_media_against_brute_force(spark, odd_docs):
    check_media(queries.op6_png_media(spark, SF).collect(), read("documents", "doc_id", "text"))
    check_media(png_media.media_features(png_media.media_table(odd_docs)).collect(), [(r.doc_id, r.text) for r in odd_docs.collect()])
    assert png_media.media_features(png_media.media_table(odd_docs.limit(0))).count() == 0


def test_png_reader_understands_all_filters():
    rng = np.random.default_rng(2)
    image = rng.integers(0, 256, (12, 192)).astype(np.uint8)
    kinds = np.array([0, 1, 2, 2, 3, 4, 2, 1, 4, 3, 2, 0], np.uint8)
    lines = np.zeros((12, 193), np.uint8)
    lines[:, 0] = kinds
    for y in range(12):
        for x in range(192):
            a = int(image[y, x - 1]) if x else 0
            b = int(image[y - 1, x]) if y else 0
            c = int(image[y - 1, x - 1]) if x and y else 0
            p = a + b - c
            paeth = a if abs(p - a) <= abs(p - b) and abs(p - a) <= abs(p - c) else b if abs(p - b) <= abs(p - c) else c
            lines[y, x + 1] = (int(image[y, x]) - (0, a, b, (a + b) // 2, paeth)[kinds[y]]) % 256
    assert (png_media.unfilter(lines) == image).all()
    media = bytearray(png_media.encode_png(b"x" * 384))
    assert (png_media.decode_png(bytes(media)) == ord("x")).all()
    media[45] ^= 1
    with pytest.raises(ValueError):
        png_media.decode_png(bytes(media))


def brute_print(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    shingles = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def brute_components(prints):
    """prints: list of (doc_id, fingerprint)."""
    parent = {f: f for _, f in prints}

    def root(f):
        while parent[f] != f:
            f = parent[f]
        return f

    distinct = list(parent)
    for i, a in enumerate(distinct):
        for b in distinct[:i]:
            if (a ^ b).bit_count() <= 2:
                parent[root(a)] = root(b)
    least = {}
    for d, f in prints:
        if d is not None:
            least[root(f)] = min(d, least.get(root(f), d))
    return [(d, f"{f:016x}", least.get(root(f))) for d, f in prints]


def test_simhash_against_brute_force(spark, odd_docs):
    got = queries.op8_covering_simhash(spark, SF).collect()
    want = brute_components([(i, brute_print(t)) for i, t in read("documents", "doc_id", "text")])
    assert sorted((r.doc_id, r.fingerprint, r.component_id) for r in got) == sorted(want)
    got = covering_simhash.near_duplicates(odd_docs).collect()
    want = brute_components([(r.doc_id, brute_print(r.text)) for r in odd_docs.collect()])
    key = lambda x: tuple(map(str, x))
    assert sorted(((r.doc_id, f"{r.fp % 2**64:016x}", r.component_id) for r in got), key=key) == sorted(want, key=key)
    assert covering_simhash.near_duplicates(odd_docs.limit(0)).count() == 0


@pytest.mark.parametrize("radius,block", [(2, 256), (2, 1), (1, 1), (1, 256), (0, 1)])
def test_every_pair_within_the_radius_is_linked(spark, radius, block):
    rng = np.random.default_rng(radius)
    fps = set()
    for _ in range(40):
        f = int(rng.integers(0, 2**63))
        for _ in range(6):
            fps.add(f)
            for b in rng.choice(64, 2, replace=False)[: int(rng.integers(1, 3))]:
                f ^= 1 << int(b)
    fps = sorted(covering_simhash.signed(f) for f in fps)
    got = covering_simhash.links(spark.createDataFrame([(f,) for f in fps], "fp long"), radius, block).collect()

    def parts(pairs):
        label = {f: f for f in fps}
        for _ in range(len(fps)):
            before = dict(label)
            for a, b in pairs:
                label[a] = label[b] = min(label[a], label[b])
            if label == before:
                return label

    near = [(a, b) for i, a in enumerate(fps) for b in fps[:i] if ((a ^ b) % 2**64).bit_count() <= radius]
    assert parts([(r.u, r.v) for r in got]) == parts(near)


@pytest.mark.parametrize("radius", [0, 1, 2])
def test_masks_cover(radius):
    import itertools

    masks = covering_simhash.masks(radius)
    for n in range(radius + 1):
        for bits in itertools.combinations(range(64), n):
            change = sum(1 << b for b in bits)
            assert any(not change & m for m in masks)


def test_keep_one(spark):
    text = "some words that repeat here in all of the rows of this table"
    docs = spark.createDataFrame([(3, text), (2, text), (2, text), (5, "another text that has nothing in common with it"), (None, text), (9, None), (10, "")], "doc_id long, text string")
    assert sorted((r.doc_id for r in covering_simhash.keep_one(docs).collect()), key=str) == [2, 5, 9, None]


def check_bpe(rows, docs):
    import tiktoken

    enc = tiktoken.Encoding("own", pat_str=bpe_words.default_pattern(), mergeable_ranks=bpe_words.ranks(bpe_words.default_path()), special_tokens={})
    texts = {i: t or "" for i, t in docs}
    assert len(rows) == len(docs)
    for r in rows:
        ids = enc.encode_ordinary(texts[r.doc_id])
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def test_bpe_against_library(spark, odd_docs):
    check_bpe(queries.op10_bpe_words(spark, SF).collect(), read("documents", "doc_id", "text"))
    extra = spark.createDataFrame([(20, "a<|endoftext|>  B ’s  don't\n\n x　　y \x1c z\x85\x85 ٣٤ ½ ​ ᠎"), (21, "   "), (22, "\n"), (23, "I'll  we've   'S")], "doc_id long, text string")
    docs = odd_docs.select("doc_id", "text", "word", "fp").unionByName(extra, allowMissingColumns=True)
    check_bpe(bpe_words.digests(docs).collect(), [(r.doc_id, r.text) for r in docs.collect()])
    for r in bpe_words.encoded(extra).collect():
        assert r.decoded == {x.doc_id: x.text for x in extra.collect()}[r.doc_id].encode() and r.ids
    assert bpe_words.digests(docs.limit(0)).count() == 0
