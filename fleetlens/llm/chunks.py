"""Texts cut before each space that starts a word, and a cache of what each chunk gives.

A byte-level pattern of the form `` ?letters| ?digits| ?other|spaces`` never looks across a space that stands
before a visible character, nor across a line end between two of them, so the chunks between can be encoded
alone. Words repeat, so a task encodes each distinct chunk about once.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from weakref import WeakSet

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CUT = re.compile(r" (?=\S)")
UNEVEN = re.compile(r" (?:\s|\Z)")  # a space that starts no word


def even(text: str) -> bool:
    """Whether spaces and line ends stand alone between visible characters, so that each begins a chunk."""
    if UNEVEN.search(text):
        return False
    return "\n" not in text or all(line and not line[0].isspace() and not line[-1].isspace() for line in text.split("\n"))


def cut(text: str) -> list[str]:
    """The head and then each chunk: without the space it began with, or with the line end."""
    lines = text.split("\n")
    if len(lines) == 1 or not all(line and not line[0].isspace() and not line[-1].isspace() for line in lines):
        return cut_line(text)
    parts = cut_line(lines[0])
    for line in lines[1:]:
        more = cut_line(line)
        more[0] = "\n" + more[0]
        parts += more
    return parts


def cut_line(text: str) -> list[str]:
    parts = text.split(" ")
    for part in parts[1:]:
        if not part or part[0].isspace():
            return CUT.split(text)
    return parts


def led(chunk: str) -> str:
    """A chunk with the space it began with, if it did not begin with a line end."""
    return chunk if chunk[0] == "\n" else " " + chunk


_KNOWN: WeakSet = WeakSet()


def forget_chunks() -> None:
    """Empties the caches of this worker process, for tasks of other operators."""
    for cache in _KNOWN:
        cache.young, cache.old = {}, {}


class ChunkCache:
    """Chunk to bytes, in two generations: when the young one is full, what was not used since the last time goes."""

    def __init__(self, encode: Callable[[list[str]], list[bytes]], most: int = 250_000) -> None:
        _KNOWN.add(self)
        self.encode, self.most = encode, most
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def bytes_of(self, wanted: list[str]) -> list[bytes]:
        """The bytes of distinct chunks."""
        young, old = self.young, self.old
        if len(young) > self.most:
            self.old = old = young
            self.young = young = {}
        missing = []
        for chunk in wanted:
            if chunk not in young:
                value = old.get(chunk)
                if value is None:
                    missing.append(chunk)
                else:
                    young[chunk] = value
        young.update(zip(missing, self.encode(missing), strict=True))
        return [young[chunk] for chunk in wanted]

    def join(self, parts: list[list[str]]) -> list[bytes]:
        """For each list of chunks, their bytes in order."""
        wanted = list(set().union(*parts))
        get = dict(zip(wanted, self.bytes_of(wanted), strict=True)).__getitem__
        return [b"".join(map(get, part)) for part in parts]


def encode_even(texts: list[str], cache: ChunkCache, heads: Callable[[list[str]], list[bytes]]) -> list[bytes]:
    """``encode_texts`` for even texts: Arrow cuts them, finds the distinct chunks and lays out their bytes."""
    lists = pc.split_pattern(pa.array([text.replace("\n", " \n") for text in texts], pa.large_string()), " ")
    flat, bounds = lists.flatten(), lists.offsets.to_numpy() - lists.offsets[0].as_py()
    coded = flat.dictionary_encode()
    codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    first = bounds[:-1]
    inner = np.ones(len(codes), bool)
    inner[first] = False
    used = np.flatnonzero(np.bincount(codes[inner], minlength=len(coded.dictionary)))
    begun, of_text = np.unique(codes[first], return_inverse=True)
    names = coded.dictionary
    places = np.zeros(len(names), np.int64)
    places[used] = np.arange(len(used))
    rows = places[codes]
    rows[first] = len(used) + of_text
    opening = names.take(pa.array(begun)).to_pylist()
    new = iter(heads([head for head in opening if head]))
    values = cache.bytes_of(names.take(pa.array(used)).to_pylist()) + [next(new) if head else b"" for head in opening]
    laid = pa.array(values, pa.large_binary()).take(pa.array(rows))
    ends = np.frombuffer(laid.buffers()[1], np.int64)[laid.offset : laid.offset + len(laid) + 1][bounds].tolist()
    data = memoryview(laid.buffers()[2] or b"")
    return [bytes(data[a:b]) for a, b in zip(ends, ends[1:], strict=False)]


def encode_texts(texts: list[str], cache: ChunkCache, heads: Callable[[list[str]], list[bytes]]) -> list[bytes]:
    """Each text's bytes: those of its head (no space before it), then those of its chunks."""
    plain = [even(text) for text in texts]
    laid = iter(encode_even([t for t, p in zip(texts, plain, strict=True) if p], cache, heads) if any(plain) else ())
    parts = [cut(text) for text, p in zip(texts, plain, strict=True) if not p]
    first = list({part[0] for part in parts if part[0]})
    of = dict(zip(first, heads(first), strict=True)) | {"": b""}
    tails = cache.join([part[1:] for part in parts])
    uneven = iter([of[part[0]] + tail for part, tail in zip(parts, tails, strict=True)])
    return [next(laid) if p else next(uneven) for p in plain]
