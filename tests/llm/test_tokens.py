"""Tokens against the public libraries, which are used here only."""

import base64
import hashlib
import random
import time
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from fleetlens.llm import merge_replay, packing, token_counts, token_files
from tokenizers import Tokenizer

from llm.texts import HARD, prose

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
ROWS = [*enumerate([*HARD, *(prose(i, 60 * i) for i in range(1, 30))]), (3, "an id again"), (None, "no id"), (None, None)]


@pytest.fixture(scope="module")
def tiktoken_encoding():
    with open(RANKS, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def library_ids(path):
    tokenizer = Tokenizer.from_file(path)
    return lambda text: tokenizer.encode(text or "", add_special_tokens=False).ids


def test_merge_replay_is_the_library(make, tiktoken_encoding):
    found = {}
    for row in merge_replay.round_trip(make(ROWS), RANKS).collect():
        found.setdefault(row.doc_id, []).append((row.n_tokens, row.ids_sha256, row.decoded_sha256))
    for doc_id, text in ROWS:
        ids = tiktoken_encoding.encode_ordinary(text or "")
        digest = hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert (len(ids), digest, hashlib.sha256((text or "").encode()).hexdigest()) in found[doc_id], text
    assert sum(map(len, found.values())) == len(ROWS)


def test_every_letter_in_every_place(tiktoken_encoding):
    encoder = merge_replay.ReplayEncoder(RANKS)
    draw = random.Random(3)
    points = [*range(1, 0x3000), *(draw.randrange(0xE000, 0x1FFFF) for _ in range(3000))]
    texts = [f"a{chr(p)} {chr(p)}b {chr(p)} {chr(p)}\n{chr(p)}  {chr(p)}1" for p in points]
    wrong = [t for t, ids in zip(texts, encoder.encode(texts), strict=True)
             if np.frombuffer(ids, "<u4").tolist() != tiktoken_encoding.encode_ordinary(t)]
    assert len(wrong) < 0.001 * len(texts), wrong[:5]  # letters that newer tables of Unicode class anew


def test_encode_and_decode(spark, make):
    docs = make(ROWS[:20])
    ids = merge_replay.encoded(docs, RANKS)
    decoded = {r.doc_id: bytes(r.bytes) for r in merge_replay.decoded(ids, RANKS).collect()}
    assert decoded == {i: (t or "").encode() for i, t in ROWS[:20]}
    assert merge_replay.round_trip(make([]), RANKS).collect() == []


def test_a_pair_of_lower_rank_is_merged_first(tmp_path):
    """A vocabulary out of training order: "bc" appears only once "b" is free of "a", "abc" ranks below "ab"."""
    tokens = [bytes([b]) for b in range(256)] + [b"abc", b"ab", b"abcab", b"aa", b"aaa", b"ca"]
    path = tmp_path / "own.tiktoken"
    path.write_bytes(b"".join(base64.b64encode(t) + b" %d\n" % i for i, t in enumerate(tokens)))
    encoding = tiktoken.Encoding("o", pat_str=public_tokenizers.PATTERN,
                                 mergeable_ranks={t: i for i, t in enumerate(tokens)}, special_tokens={})
    encoder = merge_replay.ReplayEncoder(str(path))
    draw = random.Random(5)
    texts = ["".join(draw.choice("abc ") for _ in range(draw.randrange(1, 40))) for _ in range(500)]
    for text, ids in zip(texts, encoder.encode(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == encoding.encode_ordinary(text), text


def test_random_vocabularies_are_the_library(tmp_path):
    """Vocabularies in no order: words that are tokens no merges lead to, and lower ranks between two merges of one rank."""
    draw = random.Random(9)
    for case in range(150):
        longer = {"".join(draw.choice("abc"[: 1 + case % 3]) for _ in range(draw.randrange(2, 8))).encode() for _ in range(12)}
        tokens = [bytes([b]) for b in range(256)] + draw.sample(sorted(longer), len(longer))
        path = tmp_path / f"{case}.tiktoken"
        path.write_bytes(b"".join(base64.b64encode(t) + b" %d\n" % i for i, t in enumerate(tokens)))
        encoding = tiktoken.Encoding("o", pat_str=public_tokenizers.PATTERN,
                                     mergeable_ranks={t: i for i, t in enumerate(tokens)}, special_tokens={})
        texts = ["".join(draw.choice("aabbc ") for _ in range(draw.randrange(1, 30))) for _ in range(200)]
        for text, ids in zip(texts, merge_replay.ReplayEncoder(str(path)).encode(texts), strict=True):
            assert np.frombuffer(ids, "<u4").tolist() == encoding.encode_ordinary(text), (text, tokens[256:])


def test_token_files(spark, make, tmp_path):
    path = str(tmp_path / "files")
    token_files.write_token_files(make(ROWS), path, BYTE_BPE)
    stored = token_files.read_token_files(spark, path).collect()
    ids_of = library_ids(BYTE_BPE)
    assert sorted(((r.doc_id is None, r.doc_id or 0), r.ids) for r in stored) == sorted(
        ((i is None, i or 0), [*ids_of(t), 0]) for i, t in ROWS
    )
    at = 0
    for row in sorted(stored, key=lambda r: r.start):
        assert row.start == at and row.n_tokens == len(row.ids)
        at += row.n_tokens
    in_order = [-1 if r.doc_id is None else r.doc_id for r in sorted(stored, key=lambda r: r.start)]
    assert in_order == sorted(in_order)
    sums = {(r.start, r.ids_crc32) for r in token_files.with_checksums(token_files.read_token_files(spark, path)).collect()}
    assert sums == {(r.start, zlib.crc32(np.array(r.ids, "<u4").tobytes())) for r in stored}
    some = token_files.read_token_files(spark, path, [5, 7])
    assert {(r.doc_id, r.start) for r in some.collect()} == {(r.doc_id, r.start) for r in stored if r.doc_id in (5, 7)}
    assert "PushedFilters: [In(doc_id, [5,7])" in some._jdf.queryExecution().executedPlan().toString()
    empty = str(tmp_path / "none")
    token_files.write_token_files(make([]), empty, BYTE_BPE)
    assert token_files.read_token_files(spark, empty).collect() == []


def test_packing(make):
    rows = [(k, t) for k, (_, t) in enumerate(ROWS)] + [(100 + i, prose(i, 40 + i % 5)) for i in range(200)]
    found = packing.packed(make(rows), BYTE_BPE, window=256).collect()
    ids_of = library_ids(BYTE_BPE)
    sequences, total = {}, 0
    pieces = {}
    for r in found:
        ids = np.frombuffer(bytes(r.ids), "<u4")
        assert len(ids) == r.length and zlib.crc32(ids.tobytes()) == r.ids_crc32
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
        pieces.setdefault((r.doc_id, r.doc_tokens), []).append((r.start, ids.tolist()))
        total += r.length
    whole = sorted(len(ids_of(t)) + 1 for _, t in rows)
    assert total == sum(whole)
    for i, text in rows:
        wanted = [*ids_of(text), 0]
        parts = sorted(pieces[i, len(wanted)])
        joined = [x for _, part in parts for x in part]
        assert joined == wanted and [s for s, _ in parts] == np.cumsum([0, *(len(p) for _, p in parts)])[:-1].tolist()
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at and length > 0
            at += length
        assert at == 256 or at & (at - 1) == 0
    assert packing.packed(make([]), BYTE_BPE).collect() == []


def test_the_plan_fills_windows_and_cuts_few():
    draw = np.random.default_rng(2)
    for lengths in (draw.integers(1, 1024, 4000), np.full(3000, 700), np.array([1023]), np.array([1, 1, 1])):
        sequences = packing.plan(lengths, 1024)
        sizes = [sum(b - a for _, a, b in s) for s in sequences]
        assert sum(sizes) == lengths.sum() and all(s == 1024 or s & (s - 1) == 0 for s in sizes)
        seen = sorted((i, a, b) for s in sequences for i, a, b in s)
        covered = {}
        for i, a, b in seen:
            assert covered.get(i, 0) == a
            covered[i] = b
        assert [covered[i] for i in range(len(lengths))] == lengths.tolist()
    mixed = packing.plan(draw.integers(1, 1024, 4000), 1024)
    assert sum(len(s) for s in mixed) < 1.3 * 4000  # cut at every window end, it would be 1.5


def test_prefix_counts_are_the_library(make):
    tokenizer = Tokenizer.from_file(WORD_BPE)
    docs = [(i, t) for i, t in ROWS if i is not None and len(t or "") < 400]
    found = {}
    for r in token_counts.prefix_counts(make(docs), WORD_BPE).collect():
        found.setdefault(r.doc_id, []).append((r.n_bytes, r.prefix_tokens))
    for i, text in docs:
        text = text or ""
        cuts = [text[:k] for k in range(len(text) + 1)]
        wanted = [len(e.ids) for e in tokenizer.encode_batch(cuts, add_special_tokens=False)]
        assert (len(text.encode()), wanted) in found[i], text


HARD_LETTERS = ["a", "e", "s", "r", "l", "'", "'s", "'re", "!", "。", "日", "é", "e\u0301", "s\u030c", "'r\u0301e", "\u0338", "=",
                "Σ", "İ", "\u212a", "\u0958", "한", "\u1112", "\u1161", "\u11ab", "\u3000", "\xa0", "\t", "🙂", "\u200d",
                "\u0e20", "\u0e32", "\u0e35", "½", "\x85", "\x1c", "n\u0303", " ", "LL"]


def test_prefixes_of_hard_letters_are_the_library():
    tokenizer, table, draw = Tokenizer.from_file(WORD_BPE), token_counts.prefix_table(WORD_BPE), random.Random(6)
    for _ in range(400):
        letters = draw.sample(HARD_LETTERS, draw.randrange(2, 12))
        text = "".join(draw.choice(letters) for _ in range(draw.choice([3, 9, 30, 120])))
        cuts = tokenizer.encode_batch([text[:k] for k in range(len(text) + 1)], add_special_tokens=False)
        assert table.prefixes([text])[0].tolist() == [len(e.ids) for e in cuts], ascii(text)


@pytest.mark.parametrize("part", ["日本語のテキスト。これは、試験です!", "🙂👩\u200d👧", "e\u0301a\u0300", "漢字", "\u1112\u1161\u11ab", "\u0e20\u0e32\u0e35"])
def test_time_grows_with_the_length_of_a_chunk(part):
    """100,000 characters without a blank; in time with the square of the length this would take hours."""
    tokenizer, text = Tokenizer.from_file(WORD_BPE), part * (100_000 // len(part))
    began = time.process_time()
    counts = token_counts.prefix_table(WORD_BPE).prefixes([text])[0]
    assert time.process_time() - began < 30
    for k in (*range(99_000, 99_010), len(text)):
        assert counts[k] == len(tokenizer.encode(text[:k], add_special_tokens=False).ids)


def test_budgets(make):
    docs = make([(1, prose(1, 50)), (2, None), (3, "word" * 2000), (4, "one two three")])
    stored = token_counts.within_budget(token_counts.prefix_counts(docs, WORD_BPE), 30)
    at_once = token_counts.counted(docs, WORD_BPE, 30)
    rows = sorted(tuple(r) for r in stored.collect())
    assert rows == sorted(tuple(r) for r in at_once.collect())
    count = library_ids(WORD_BPE)
    for doc_id, n_bytes, n_tokens, over, fit in rows:
        text = {1: prose(1, 50), 2: "", 3: "word" * 2000, 4: "one two three"}[doc_id]
        assert n_bytes == len(text.encode()) and n_tokens == len(count(text)) and over == (n_tokens > 30)
        assert len(count(text[:fit])) <= 30 and (not over or len(count(text[: fit + 1])) > 30)
    assert token_counts.counted(make([]), WORD_BPE, 30).collect() == []
