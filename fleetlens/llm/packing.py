"""Sequences of a fixed length from whole documents, filled by length combinations.

A document longer than a window gives full windows and a rest. The rests of a block of documents form a
histogram of lengths. All pairs and triples of lengths that fill a window exactly are the columns of a
non-negative least squares problem against it; the solution, rounded down, says how often each combination is
used. What no combination takes is packed greedily, longest first, and cut where a window is full.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from fleetlens.llm.common import id_and_text, steps
from fleetlens.llm.library_tokens import library_encoder

SCHEMA = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, `offset` long, ids binary"
)
# Tokens that one plan covers: a task holds so many ids (4 bytes each) and plans the next block after them.
BLOCK_TOKENS = 8_000_000


@lru_cache(maxsize=2)
def combinations(window: int) -> np.ndarray:
    """All pairs and triples (a <= b <= c, 0 for none) of lengths that sum to ``window``."""
    a = np.arange(1, window // 2 + 1)
    pairs = np.stack([np.zeros_like(a), a, window - a], axis=1)
    first, second = np.meshgrid(np.arange(1, window // 3 + 1), np.arange(1, window), indexing="ij")
    first, second = first.ravel(), second.ravel()
    third = window - first - second
    held = (first <= second) & (second <= third)
    return np.concatenate([pairs, np.stack([first, second, third], axis=1)[held]]).astype(np.int64)


def solve(combos: np.ndarray, counts: np.ndarray, rounds: int = 60) -> np.ndarray:
    """Non-negative least squares: repeats x of each combination, so that their lengths come near ``counts``.

    Accelerated projected gradient; the step is one over the largest row and column sum of the normal matrix.
    """
    size, parts = len(counts), combos.shape[1]
    uses = np.bincount(combos.ravel(), minlength=size)[:size]
    rate = 1.0 / max(1, parts * int(uses[1:].max(initial=1)))
    x = np.zeros(len(combos))
    y, t = x, 1.0
    for _ in range(rounds):
        made = sum(np.bincount(combos[:, k], weights=y, minlength=size)[:size] for k in range(parts))
        miss = made - counts
        miss[0] = 0.0
        step = np.maximum(0.0, y - rate * sum(miss[combos[:, k]] for k in range(parts)))
        following = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y = step + (t - 1) / following * (step - x)
        x, t = step, following
    return x


def plan(lengths: np.ndarray, window: int) -> list[list[tuple[int, int, int]]]:
    """Sequences as lists of pieces (item, from, to) that cover every item of ``lengths`` (1 to window - 1) once.

    The last, unfilled window is cut into sequences whose lengths are powers of two, which need no padding.
    """
    counts = np.bincount(lengths, minlength=window + 1).astype(np.int64)
    order = np.argsort(lengths, kind="stable")
    used = np.concatenate(([0], np.cumsum(counts)))[:-1].copy()  # next item of each length, in order
    left = counts.copy()
    sequences: list[list[tuple[int, int, int]]] = []

    def take(combo: tuple[int, ...], repeats: int) -> None:
        for length in set(combo):
            repeats = min(repeats, int(left[length]) // combo.count(length))
        for _ in range(repeats):
            pieces = []
            for length in combo:
                pieces.append((int(order[used[length]]), 0, length))
                used[length] += 1
                left[length] -= 1
            sequences.append(pieces)

    combos = combinations(window)
    present = counts > 0
    present[0] = True
    combos = combos[present[combos].all(axis=1)]
    if len(combos):
        repeats = solve(combos, counts.astype(float))
        best = np.argsort(-repeats, kind="stable")
        for k in best[repeats[best] >= 1]:
            take(tuple(int(v) for v in combos[k] if v), int(repeats[k]))
        for k in best[repeats[best] > 1e-3]:  # what rounding down left over, once more each
            take(tuple(int(v) for v in combos[k] if v), 1)
    rest, room = [], window
    for length in np.flatnonzero(left)[::-1]:
        for item in order[used[length] : used[length] + left[length]]:
            at = 0
            while at < length:
                size = min(room, int(length) - at)
                rest.append((int(item), at, at + size))
                at, room = at + size, room - size
                if not room:
                    sequences.append(rest)
                    rest, room = [], window
    total = window - room
    while total:
        size = 1 << (total.bit_length() - 1)
        total -= size
        pieces, need = [], size
        while need:
            item, a, b = rest.pop(0)
            if b - a > need:
                rest.insert(0, (item, a + need, b))
                b = a + need
            pieces.append((item, a, b))
            need -= b - a
        sequences.append(pieces)
    return sequences


def packed(docs: DataFrame, vocabulary: str, *, window: int = 1024, end_id: int = 0) -> DataFrame:
    """Pieces of all documents in sequences of at most ``window`` tokens, each id in exactly one piece.

    One row per piece: its document, place there, ids (32-bit little-endian), their checksum, its sequence and
    place in it. A null text is an empty one (the end id alone); repeated ids are documents of their own; an
    empty table gives no piece; other columns are not read. Each task packs the documents it reads, block by
    block, without a shuffle; ``sequence_id`` holds the task's number in its upper bits.
    """

    def block_rows(ids: list, numbers: list[bytes], first: int) -> tuple[pa.RecordBatch, int]:
        sizes = np.array([len(x) // 4 for x in numbers], np.int64)
        rests = sizes % window
        rows = []
        sequence = first
        for i in np.flatnonzero(sizes >= window):
            for at in range(0, int(sizes[i] - rests[i]), window):
                rows.append((i, at, window, sequence, 0))
                sequence += 1
        items = np.flatnonzero(rests)
        for pieces in plan(rests[items], window):
            place = 0
            for item, a, b in pieces:
                i = items[item]
                rows.append((i, int(sizes[i] - rests[i]) + a, b - a, sequence, place))
                place += b - a
            sequence += 1
        cuts = [numbers[i][4 * start : 4 * (start + length)] for i, start, length, _, _ in rows]
        table = np.array(rows, np.int64).reshape(-1, 5)
        batch = pa.RecordBatch.from_arrays(
            [
                pa.array([ids[i] for i in table[:, 0]], pa.int64()),
                pa.array(table[:, 1]),
                pa.array(table[:, 2]),
                pa.array([zlib.crc32(x) for x in cuts], pa.int64()),
                pa.array(sizes[table[:, 0]]),
                pa.array(table[:, 3]),
                pa.array(table[:, 4]),
                pa.array(cuts, pa.binary()),
            ],
            ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"],
        )
        return batch, sequence

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end = library_encoder(vocabulary), np.array([end_id], "<u4").tobytes()
        sequence = TaskContext.get().partitionId() << 40
        ids, numbers, held = [], [], 0
        for batch in steps(batches):
            ids += batch.column("doc_id").to_pylist()
            new = [x + end for x in encoder.encode(batch.column("text").to_pylist())]
            numbers += new
            held += sum(map(len, new)) // 4
            if held >= BLOCK_TOKENS:
                rows, sequence = block_rows(ids, numbers, sequence)
                yield rows
                ids, numbers, held = [], [], 0
        if ids:
            yield block_rows(ids, numbers, sequence)[0]

    return id_and_text(docs).mapInArrow(pack, SCHEMA)
