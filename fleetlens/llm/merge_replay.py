"""Byte-level BPE by replaying the merges over all words of a block at once.

The distinct words of many documents are laid out as one array of symbols. An inverted index leads from each
token that a neighbouring pair would make to the positions of such pairs. Merges are applied in rank order, each
to all its positions at once, and only the two neighbours of a merged pair are looked at again.
"""

from __future__ import annotations

import base64
import hashlib
from functools import lru_cache
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from fleetlens.llm.chunks import ChunkCache, encode_texts, led
from fleetlens.llm.common import id_and_text, map_steps

# The pattern of the vocabulary files; fixed value.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
# Text whose new words are replayed together, in bytes: bounds the index to some tens of MB.
BLOCK_BYTES = 8_000_000
BORDER = 0xFF  # stands between words; no byte of UTF-8
GONE = -1  # a symbol that was merged into the one before it, or a border


class MergeTable:
    """Ranks of a vocabulary file: token bytes by rank, and the token that a pair of tokens makes."""

    def __init__(self, path: str) -> None:
        with open(path, "rb") as file:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}
        self.tokens = [b""] * (max(ranks.values()) + 1)
        made: dict[int, int] = {}
        for token, rank in ranks.items():
            self.tokens[rank] = token
            for i in range(1, len(token)):
                left, right = ranks.get(token[:i]), ranks.get(token[i:])
                if left is not None and right is not None:
                    made[left << 32 | right] = rank
        self.made = made
        self.pairs = np.array(sorted(made), np.int64)
        self.ranks_of_pairs = np.array([made[p] for p in self.pairs.tolist()] or [0], np.int64)
        self.single = np.array([ranks.get(bytes([b]), GONE) for b in range(256)], np.int64)
        lefts = self.pairs >> 32
        # Tokens that make one of a lower rank with what follows them.
        self.early = set(lefts[self.ranks_of_pairs[: len(lefts)] < lefts].tolist())
        # A word that is a token is that token, even if no merges lead to it (none in vocabularies in training order).
        single = self.single.tolist()
        self.whole = {
            token: rank
            for token, rank in ranks.items()
            if len(token) > 1 and BORDER not in token and merged_alone([single[b] for b in token], made) != [rank]
        }

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The token each pair makes, or -1."""
        if not len(self.pairs):
            return np.full(len(left), GONE)
        keys = left << 32 | right
        at = np.searchsorted(self.pairs, keys)
        at[at == len(self.pairs)] = 0
        found = self.ranks_of_pairs[at]
        found[(self.pairs[at] != keys) | (left < 0) | (right < 0)] = GONE
        return found


def merged_alone(word: list[int], made: dict[int, int]) -> list[int]:
    """Ids of one word from its bytes' ids: the lowest rank first and, of equal ranks, the leftmost."""
    symbols = list(word)
    while len(symbols) > 1:
        ranks = [made.get(a << 32 | b, 1 << 60) for a, b in zip(symbols, symbols[1:], strict=False)]
        best = min(ranks)
        if best == 1 << 60:
            break
        at = ranks.index(best)
        symbols[at : at + 2] = [best]
    return symbols


def replay(text: bytes, table: MergeTable) -> np.ndarray:
    """Ids at their places for words with ``BORDER`` between them; -1 where a byte was merged and at borders.

    ``text`` ends with a border. All places of a rank are merged at once, leftmost first where two overlap. If a
    merge makes a pair of a lower rank than its own, with what stands at its left then or stood at its right before
    the next place was merged, its word needs that pair first; such a word (none in vocabularies in training order)
    is encoded again on its own.
    """
    raw = np.frombuffer(text, np.uint8)
    n = len(raw)
    symbols = np.where(raw == BORDER, GONE, table.single[raw])
    following, before = np.arange(1, n + 1), np.arange(-1, n - 1)
    again: list[np.ndarray] = []
    index: dict[int, list[np.ndarray]] = {}
    waiting: list[int] = []

    def add(ranks: np.ndarray, places: np.ndarray) -> None:
        order = np.argsort(ranks, kind="stable")
        ranks, places = ranks[order], places[order]
        cuts = np.flatnonzero(ranks[1:] != ranks[:-1]) + 1
        firsts = [0, *cuts.tolist()]
        for first, last, rank in zip(firsts, [*firsts[1:], len(ranks)], ranks[firsts].tolist(), strict=True):
            held = index.get(rank)
            if held is None:
                index[rank] = [places[first:last]]
                heappush(waiting, rank)
            else:
                held.append(places[first:last])

    if n > 1:
        ranks = table.rank(symbols[:-1], symbols[1:])
        places = np.flatnonzero(ranks >= 0)
        if len(places):
            add(ranks[places], places)
    while waiting:
        rank = heappop(waiting)
        held = index.pop(rank)
        at = held[0] if len(held) == 1 else np.unique(np.concatenate(held))
        right = following[at]
        at = at[table.rank(symbols[at], symbols[right]) == rank]
        if not len(at):
            continue
        right = following[at]
        if len(at) > 1 and (right[:-1] == at[1:]).any():
            kept, taken = [], -1
            for i, r in zip(at.tolist(), right.tolist(), strict=True):
                if i != taken:
                    kept.append(i)
                    taken = r
            at = np.array(kept)
            right = following[at]
        after = following[right]
        if rank in table.early:
            sooner = table.rank(np.full(len(at), rank), symbols[after])
            sooner = (sooner >= 0) & (sooner < rank)
            if sooner.any():
                again.append(at[sooner])
        symbols[at], symbols[right] = rank, GONE
        following[at], before[after] = after, at
        left = before[at]
        inner = left >= 0
        places = np.concatenate([left[inner], at])
        new = table.rank(symbols[places], symbols[following[places]])
        made = new >= 0
        if made.any():
            new, places = new[made], places[made]
            if (new < rank).any():
                again.append(places[new < rank])
            add(new, places)
    if again:
        borders = np.flatnonzero(raw == BORDER)
        for k in np.unique(np.searchsorted(borders, np.concatenate(again))).tolist():
            first, last = int(borders[k - 1]) + 1 if k else 0, int(borders[k])
            ids = merged_alone(table.single[raw[first:last]].tolist(), table.made)
            symbols[first:last] = GONE
            symbols[first : first + len(ids)] = ids
    if table.whole:
        at = 0
        for word in text.split(b"\xff"):
            rank = table.whole.get(word)
            if rank is not None:
                symbols[at : at + len(word)] = GONE
                symbols[at] = rank
            at += len(word) + 1
    return symbols


class ReplayEncoder:
    def __init__(self, path: str) -> None:
        self.table = MergeTable(path)
        self.words = regex.compile(PATTERN).findall
        self.cache = ChunkCache(self.chunks)

    def laid_out(self, text: str) -> bytes:
        if text[1:].isalpha() and text[0] == " ":
            return text.encode("utf-8", "surrogatepass") + b"\xff"
        return b"".join([word.encode("utf-8", "surrogatepass") + b"\xff" for word in self.words(text)])

    def replayed(self, texts: list[str]) -> list[bytes]:
        """Ids of texts that are encoded alone."""
        found: list[bytes] = []
        block, sizes, held = [], [], 0

        def flush() -> None:
            symbols = replay(b"".join(block), self.table)
            kept = np.concatenate(([0], np.cumsum(symbols >= 0)))
            ids = symbols[symbols >= 0].astype("<u4").tobytes()
            ends = (4 * kept[np.cumsum(sizes)]).tolist()
            found.extend(ids[a:b] for a, b in zip([0, *ends], ends, strict=False))

        for text in texts:
            words = self.laid_out(text)
            block.append(words)
            sizes.append(len(words))
            held += len(words)
            if held >= BLOCK_BYTES:
                flush()
                block, sizes, held = [], [], 0
        if block:
            flush()
        return found

    def chunks(self, chunks: list[str]) -> list[bytes]:
        return self.replayed([led(chunk) for chunk in chunks])

    def encode(self, texts: list[str]) -> list[bytes]:
        return encode_texts(texts, self.cache, self.replayed)

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.table.tokens.__getitem__, ids.tolist()))


@lru_cache(maxsize=2)
def replay_encoder(path: str) -> ReplayEncoder:
    return ReplayEncoder(path)


def encoded(docs: DataFrame, vocabulary: str) -> DataFrame:
    """``doc_id, ids`` (array of int) of each whole text by the ranks of ``vocabulary``, special strings as plain text.

    A null or empty text has no ids. Rows are kept as they are, with repeated and null ids; other columns are not
    read. The words of a task's texts are its corpus: they are replayed in blocks of bounded size, without a shuffle.
    """

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids = replay_encoder(vocabulary).encode(batch.column("text").to_pylist())
        bounds = np.concatenate(([0], np.cumsum([len(x) // 4 for x in ids]))).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(bounds), pa.array(np.frombuffer(b"".join(ids), "<i4")))
        return pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), lists], ["doc_id", "ids"])

    return map_steps(id_and_text(docs), work, "doc_id long, ids array<int>", BLOCK_BYTES, caches=True)


def decoded(tokens: DataFrame, vocabulary: str) -> DataFrame:
    """``doc_id, bytes`` from ``doc_id, ids``: the bytes of each id in order."""

    def run(batches):
        for batch in batches:
            encoder, lists = replay_encoder(vocabulary), batch.column("ids")
            bounds, values = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False)
            texts = [encoder.decode(values[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.binary())], ["doc_id", "bytes"])

    return tokens.mapInArrow(run, "doc_id long, bytes binary")


def round_trip(docs: DataFrame, vocabulary: str) -> DataFrame:
    """Encodes and decodes in the same task: ``doc_id, n_tokens`` and hashes of the ids and of the decoded bytes.

    A null text is an empty one: no tokens, hashes of nothing. Rows are kept as they are, with repeated and null ids;
    an empty table gives no rows; other columns are not read.
    """

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        encoder = replay_encoder(vocabulary)
        rows = []
        for ids in encoder.encode(batch.column("text").to_pylist()):
            numbers = np.frombuffer(ids, "<u4")
            written = ",".join(map(str, numbers.tolist())).encode()
            decoded_bytes = encoder.decode(numbers)
            rows.append((len(numbers), hashlib.sha256(written).hexdigest(), hashlib.sha256(decoded_bytes).hexdigest()))
        columns = zip(*rows, strict=True) if rows else ([], [], [])
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id").cast(pa.int64()), *(pa.array(list(c), t) for c, t in zip(columns, (pa.int64(), pa.string(), pa.string()), strict=True))],
            ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
        )

    return map_steps(id_and_text(docs), work, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", BLOCK_BYTES, caches=True)
