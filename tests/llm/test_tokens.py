"""The tokenizer operators against the tokenizers' own libraries and against brute force."""

import hashlib
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from conftest_data import SF, read

from curatrix.llm import alignment, queries, speculative_bpe

ODD = ["a<|endoftext|>B  <|endoftext|>", "<|endoftext|>", "  lead", "\n b  c \t d \x1c e", "x" * 5000, "aaaaaaa " * 9, "I'll don't 'S", "漢字かな" * 400, " \xa0 　 x", "😀" * 30, "﻿ a\x00b", "1234567 89", "trail  ", "▁a <0x0A>"]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(speculative_bpe.default_path())


def speculative_want(library, text):
    ids = library.encode(text or "", add_special_tokens=False).ids
    return len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_speculative_bpe_as_the_library(spark, library):
    got = sorted(queries.op11_speculative_bpe(spark, SF).collect())
    assert [tuple(r) for r in got] == sorted((i, *speculative_want(library, t)) for i, t in read("documents", "doc_id", "text"))


def test_speculative_bpe_odd_rows(spark, library, odd_docs):
    more = spark.createDataFrame([(50 + k, t, k) for k, t in enumerate(ODD)], "doc_id long, text string, `a.b` int")
    docs = odd_docs.unionByName(more, allowMissingColumns=True)
    want = sorted(((r.doc_id, *speculative_want(library, r.text)) for r in docs.collect()), key=str)
    assert sorted((tuple(r) for r in speculative_bpe.digests(docs).collect()), key=str) == want
    rows = speculative_bpe.encoded(more).collect()
    assert all(r.ids == library.encode(ODD[r.doc_id - 50], add_special_tokens=False).ids and r.decoded == ODD[r.doc_id - 50] for r in rows)
    assert speculative_bpe.digests(docs.limit(0)).count() == 0


def test_speculative_bpe_takes_bytes_that_are_not_utf8(spark, library):
    docs = spark.sql("SELECT 1L AS doc_id, CAST(X'61FF62' AS STRING) AS text")
    assert tuple(speculative_bpe.digests(docs).first())[1:] == speculative_want(library, "a�b")


def test_memo_and_steps_change_nothing(monkeypatch, library):
    whole = [t for _, t in read("documents", "doc_id", "text") if t][:60]
    monkeypatch.setattr(speculative_bpe, "MEMO", 1)
    encoder = speculative_bpe.Encoder(speculative_bpe.default_path(), speculative_bpe.default_pattern())
    got = [x.tolist() for part in speculative_bpe.steps(whole, limit=10_000) for x in encoder.encode(whole[part])]
    assert got == [library.encode(t, add_special_tokens=False).ids for t in whole]
    assert [len(whole[p]) for p in speculative_bpe.steps(whole, limit=1)] == [1] * 60


def naive(v, word):
    """All merges in order of rank, from the left, one at a time."""
    ids = [v.of_byte[b] for b in word]
    while len(ids) > 1:
        rank, k = min((v.merges.get(p, (1 << 40,))[0], k) for k, p in enumerate(zip(ids, ids[1:], strict=False)))
        if rank == 1 << 40:
            break
        ids[k : k + 2] = [v.merges[ids[k], ids[k + 1]][1]]
    return ids


def test_check_fails_exactly_where_greedy_is_wrong():
    v = speculative_bpe.vocabulary(speculative_bpe.default_path())
    rng = random.Random(5)
    tokens = [t for t in v.tokens if len(t) < 9]
    words = [b"".join(rng.choice(tokens) for _ in range(rng.randint(1, 4))) for _ in range(4000)] + [b"a" * n for n in range(1, 60)] + [bytes(rng.choices(b"aeinst", k=rng.randint(2, 70))) for _ in range(300)]
    want = [naive(v, w) for w in words]
    found, failed = speculative_bpe.encode_words(v, words)
    assert found == want
    assert failed == sum(speculative_bpe.proposed(v, w) != x for w, x in zip(words, want, strict=True)) > 0
    assert [speculative_bpe.merged(v, w) for w in words] == want
    assert all(naive(v, t) == [i] for t, i in v.tokens.items() if len(t) < 5)


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=40))
def test_any_text(text):
    from tokenizers import Tokenizer

    encoder = speculative_bpe.Encoder(speculative_bpe.default_path(), speculative_bpe.default_pattern())
    library = _library.setdefault("t", Tokenizer.from_file(speculative_bpe.default_path()))
    assert encoder.encode([text])[0].tolist() == library.encode(text, add_special_tokens=False).ids


_library = {}


def alignment_want(docs):
    """Rows by whole texts and dictionaries."""
    import base64
    from collections import Counter

    import public_tokenizers
    import sentencepiece
    import tiktoken

    ranks = {base64.b64decode(t): int(r) for t, r in map(bytes.split, open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb"))}
    first = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    second = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    all_links, rows = [], []
    for i, text in docs:
        a, b = first.encode_ordinary(f" {text or ''}"), second.encode(text or "")
        bytes_a = [first.decode_single_token_bytes(t) for t in a]
        bytes_b = [bytes([int(second.id_to_piece(t)[3:5], 16)]) if second.is_byte(t) else second.id_to_piece(t).replace("▁", " ").encode() for t in b]
        whole = f" {text}".encode()
        if not text or b"".join(bytes_a) != whole or b"".join(bytes_b) != whole:
            a = b = bytes_a = bytes_b = []
        ends = []
        for spelt in (bytes_a, bytes_b):
            at, stops = 0, []
            for t in spelt:
                at += len(t)
                stops.append(at)
            ends.append(stops)
        common = sorted(set(ends[0]) & set(ends[1]))
        of = [dict(zip(e, ids, strict=True)) for e, ids in zip(ends, (a, b), strict=True)]
        links = [(of[0][e], of[1][e]) for e in common]
        groups = [tuple([t for e, t in zip(stops, ids, strict=True) if begin < e <= end] for stops, ids in zip(ends, (a, b), strict=True)) for begin, end in zip([0, *common], common, strict=False)]
        shown = ";".join("|".join(",".join(map(str, side)) for side in g) for g in groups)
        spans = [list(zip([0, *e], e, strict=False)) for e in ends]
        overlaps = len(spans[0]) + len(spans[1]) - len(common) if links else 0
        all_links.append(links)
        rows.append([i, len(a), len(b), len(groups), len(links), hashlib.sha256(shown.encode()).hexdigest() if links else "", overlaps])
    counts = Counter(x for links in all_links for x in links)
    most = {}
    for (_, b), n in counts.items():
        most[b] = max(most.get(b, 0), n)
    return [(*r[:5], sum(counts[x] == most[x[1]] for x in links), sum(counts[x] for x in links), *r[5:]) for r, links in zip(rows, all_links, strict=True)]


def test_alignment_against_brute_force(spark):
    got = sorted(map(tuple, queries.op13_token_alignment(spark, SF).collect()))
    assert got == sorted(alignment_want(read("documents", "doc_id", "text")))


def test_alignment_odd_rows(spark, odd_docs):
    more = spark.createDataFrame([(50 + k, t, k) for k, t in enumerate([*ODD, "▁", "a ▁ b", "same words", "same words here"])], "doc_id long, text string, `a.b` int")
    docs = odd_docs.unionByName(more, allowMissingColumns=True)
    want = sorted(alignment_want([(r.doc_id, r.text) for r in docs.collect()]), key=str)
    assert sorted(map(tuple, alignment.aligned(docs).collect()), key=str) == want
    assert sorted(map(tuple, alignment.aligned(docs.repartition(3), block_bytes=9).collect()), key=str) == want
    assert alignment.aligned(docs.limit(0)).count() == 0
