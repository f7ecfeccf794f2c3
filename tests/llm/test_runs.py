"""Periodic runs against a scan of all lags."""

import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest
from fleetlens.llm import periodic_runs, queries
from fleetlens.llm.periodic_runs import Periodic, runs_of

from llm.texts import HARD, prose

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_runs(words):
    """(start, length, smallest period) of every maximal run, lag by lag and word by word."""
    found = {}
    for q in range(1, len(words) // 4 + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j > i and j - i + q >= max(6, 4 * q):
                found.setdefault((i, j - i + q), q)
            i = max(j, i + 1)
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda run: (run[0], run[2]))


def made(draw):
    words = [draw.randrange(draw.choice([1, 2, 3, 5, 20])) for _ in range(draw.randrange(draw.choice([1, 10, 60, 200])))]
    for _ in range(draw.randrange(4)):
        block = [draw.randrange(draw.choice([1, 2, 3, 30])) for _ in range(draw.randrange(1, 10))]
        at = draw.randrange(len(words) + 1)
        words[at:at] = [block[i % len(block)] for i in range(draw.randrange(9 * len(block)))]
    return words


@pytest.mark.parametrize("rounds", [0, 1, 6])
def test_runs_of_made_up_words(rounds, monkeypatch):
    monkeypatch.setattr(periodic_runs, "ROUNDS", rounds)
    draw = random.Random(rounds)
    for _ in range(600):
        texts = [made(draw) for _ in range(4)]
        codes = np.array([w for t in texts for w in t], np.int64)
        owner = np.repeat(np.arange(4), [len(t) for t in texts])
        first = np.cumsum([0, *map(len, texts)])
        wanted = [(int(first[i]) + s, n, q) for i, t in enumerate(texts) for s, n, q in plain_runs(t)]
        assert runs_of(codes, owner) == sorted(wanted, key=lambda run: (run[0], run[2]))


def test_splitting_ends_in_stable_segments_by_either_way(monkeypatch):
    draw = random.Random(5)
    for _ in range(100):
        codes = np.array([draw.randrange(draw.choice([3, 12, 40])) for _ in range(300)], np.int64)
        owner = np.zeros(len(codes), np.int64)
        found = periodic_runs.split(codes, owner, Periodic())
        assert all(np.unique(codes[a:b], return_counts=True)[1].min() >= 4 for a, b in found)
        for rounds in (0, 1, 50):
            monkeypatch.setattr(periodic_runs, "ROUNDS", rounds)
            assert periodic_runs.split(codes, owner, Periodic()) == found


@pytest.mark.parametrize("kind", ["one word", "long period", "chain of splits"])
def test_long_texts_take_little_longer_than_their_length(kind):
    n = 200_000
    codes = {
        "one word": np.zeros(n, np.int64),
        "long period": np.tile(np.arange(1000), n // 1000),
        "chain of splits": np.array([x for i in range(n // 4) for x in (i, i, i, i + 1)]),
    }[kind]
    wanted = {"one word": [(0, n, 1)], "long period": [(0, n, 1000)], "chain of splits": []}
    assert runs_of(codes, np.zeros(len(codes), np.int64)) == wanted[kind]


def test_other_limits():
    assert runs_of(np.zeros(6, np.int64), np.zeros(6, np.int64), Periodic(least=7)) == []
    assert runs_of(np.tile([1, 2], 5), np.zeros(10, np.int64), Periodic(times=5)) == [(0, 10, 2)]
    with pytest.raises(ValueError):
        Periodic(times=3)


def texts():
    draw = random.Random(2)
    rows = list(enumerate(HARD))
    for i in range(80):
        words = prose(i, draw.randrange(0, 120)).split()
        for _ in range(draw.randrange(3)):
            block = words[: draw.randrange(1, 6)] or ["x"]
            at = draw.randrange(len(words) + 1)
            words[at:at] = block * draw.randrange(3, 8)
        rows.append((100 + i, draw.choice([" ", "\n", "  "]).join(words)))
    return rows + [(100, "a b " * 9), (100, "a b " * 9), (None, "c " * 30), (None, None), (900, "word " * 50_000)]


def test_runs_and_collapsed_texts(make):
    rows = texts()
    found = periodic_runs.found(make(rows)).collect()
    wanted = []
    for doc_id, text in rows:
        words = WORD.findall(text or "")
        runs = plain_runs(words) if len(words) < 10_000 else [(0, len(words), 1)]
        gone = {i for s, n, q in runs for i in range(s + q, s + n)}
        wanted.append((doc_id, len(words), runs, " ".join(w for i, w in enumerate(words) if i not in gone)))
    assert sorted(((r.doc_id, r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in found), key=repr) == sorted(wanted, key=repr)
    assert periodic_runs.found(make([])).collect() == []
    row = periodic_runs.found(make([(1, "a")]), carry=True).first()
    assert row.n_words == 1 and row["rest"].n_words == "x" and row["rest"]["rest"] == 1


def test_the_query(spark, tmp_path):
    rows = [(i, t) for i, t in texts() if t is None or len(t) < 5000] + [(1000 + i, prose(i, 60)) for i in range(150)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    wanted = []
    for doc_id, text in rows:
        words = WORD.findall(text or "")
        n, h = len(words), zlib.crc32(str(doc_id).encode())
        if doc_id is not None and h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
        runs = plain_runs(words)
        best = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=(None,) * 3)
        gone = {i for s, m, q in runs for i in range(s + q, s + m)}
        every = "".join(f"{s},{m},{q}\n" for s, m, q in runs)
        kept = " ".join(w for i, w in enumerate(words) if i not in gone)
        milli = 1000 * best[1] // best[2] if runs else None
        wanted.append((doc_id, len(runs), *best, milli, *(hashlib.sha256(x.encode()).hexdigest() for x in (every, kept))))
    found = queries.op11_periodic_runs(spark, str(tmp_path)).collect()
    assert sorted(map(tuple, found), key=repr) == sorted(wanted, key=repr)
    assert any(doc_id and zlib.crc32(str(doc_id).encode()) % 10 == 0 for doc_id, _ in rows)
