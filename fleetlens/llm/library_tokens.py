"""Token ids of the tokenizers library for byte-level vocabularies, each distinct chunk encoded once."""

from __future__ import annotations

from array import array
from functools import lru_cache

import numpy as np

from fleetlens.llm.chunks import ChunkCache, encode_texts, led

MARKS = ".,;:!?"


def byte_letters() -> dict[int, str]:
    """The letter that byte-level vocabularies write for each byte (fixed by their format)."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class LibraryEncoder:
    """Encodes whole texts as ``Tokenizer.encode(text, add_special_tokens=False)`` does; ids as 32-bit little-endian.

    Texts that hold one of the vocabulary's special strings go to the library whole, as those cut a text
    before its words are found.
    """

    def __init__(self, path: str) -> None:
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.words = self.tokenizer.pre_tokenizer.pre_tokenize_str
        self.model = self.tokenizer.model
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.letters = byte_letters()
        self.cache = ChunkCache(self.chunks)
        self.marks: dict[str, bytes] = {}

    def piece(self, text: str) -> list[int]:
        tokenize = self.model.tokenize
        return [token.id for word, _ in self.words(text) for token in tokenize(word)]

    def chunks(self, chunks: list[str]) -> list[bytes]:
        tokenize, letters, space = self.model.tokenize, self.letters, self.letters[0x20]
        known, marks = self.cache.young, self.marks

        def letters_only(chunk: str, before: str) -> bytes:  # one word of the pattern
            word = before + (chunk if chunk.isascii() else chunk.encode().decode("latin-1").translate(letters))
            return array("I", [token.id for token in tokenize(word)]).tobytes()

        found = []
        for chunk in chunks:
            if chunk.isalpha():
                found.append(letters_only(chunk, space))
                continue
            stem = chunk.rstrip(MARKS)
            line_end = chunk[0] == "\n" and stem[1:].isalpha()
            if line_end or stem.isalpha():  # a line end, letters and marks are words of their own
                tail = chunk[len(stem) :]
                if line_end:
                    ids = (marks.get("\n") or marks.setdefault("\n", self.ids("\n"))) + letters_only(stem[1:], "")
                else:
                    ids = known.get(stem) or known.setdefault(stem, letters_only(stem, space))
                found.append(ids + (marks.get(tail) or marks.setdefault(tail, self.ids(tail))) if tail else ids)
            else:
                found.append(self.ids(led(chunk)))
        return found

    def ids(self, text: str) -> bytes:
        return np.array(self.piece(text), "<u4").tobytes()

    def heads(self, texts: list[str]) -> list[bytes]:
        return [self.ids(text) for text in texts]

    def encode(self, texts: list[str]) -> list[bytes]:
        if not any(s in text for s in self.special for text in texts):
            return encode_texts(texts, self.cache, self.heads)
        whole = {i for i, text in enumerate(texts) if any(s in text for s in self.special)}
        plain = iter(encode_texts([t for i, t in enumerate(texts) if i not in whole], self.cache, self.heads))
        return [self.whole(text) if i in whole else next(plain) for i, text in enumerate(texts)]

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


@lru_cache(maxsize=2)
def library_encoder(path: str) -> LibraryEncoder:
    """One encoder per worker process, with what it has cached."""
    return LibraryEncoder(path)
