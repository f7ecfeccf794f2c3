"""Exact token counts of every prefix of a text, by dynamic programming over its words.

The last token of a BPE encoding of a prefix is the one token that ends there and fits the last token of the
prefix before it. So one pass over a word gives the last token and the count at each of its prefixes. A second
pass over the same table gives the counts with the end-of-word mark on the last letter, which is what the
vocabulary does when a text is cut inside a word. Counts of words add up to counts of texts.
"""

from __future__ import annotations

import json
import re
import unicodedata
from array import array
from collections.abc import Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.llm.chunks import ChunkCache, encode_texts, led
from fleetlens.llm.common import id_and_text, map_steps
from fleetlens.llm.library_tokens import byte_letters

# The word pattern of the vocabulary for texts of letters and visible ASCII characters; fixed value.
SIMPLE = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|[0-9]|(?:[^\s\w]|_)+")
LONG_ENDINGS = ("'re", "'ve", "'ll")
PLAIN = re.compile(r"(?:[\n\x21-\x7e]|[^\W\d_])*")
PAIRS_KEPT = 500_000
PREFIXES_KEPT = 400_000
LONG_WORD = 40
START = -2  # stands for the last token where a word begins
FIRST = (START, 0, ())  # the entry of the empty prefix


def endings(opened: dict[str, int], closed: dict[str, int]) -> dict[str, tuple[int, int] | None]:
    """Every ending of a token: its numbers without and with the mark (-1 for none), or None if it is no token itself."""
    found = dict.fromkeys(token[i:] for tokens in (opened, closed) for token in tokens for i in range(1, len(token)))
    return found | {token: (opened.get(token, -1), closed.get(token, -1)) for token in opened.keys() | closed.keys()}


@lru_cache(maxsize=1)
def joining() -> frozenset[str]:
    """Characters that can become one with the character before them when a text is composed."""
    found = {chr(c) for c in (*range(0x1161, 0x1176), *range(0x11A8, 0x11C3))}  # second and third parts of Hangul
    for c in map(chr, range(0x20000)):
        parts = unicodedata.decomposition(c).split()
        if len(parts) == 2 and not parts[0].startswith("<"):
            found.add(chr(int(parts[1], 16)))
    return frozenset(found)


def clusters(text: str) -> list[str]:
    """The text cut where composing one side never changes the other: before characters that do not join."""
    joins, found, at = joining(), [], 0
    for i in range(1, len(text)):
        c = text[i]
        if c < "\u0300" or (c not in joins and not unicodedata.combining(c)):
            found.append(text[at:i])
            at = i
    return [*found, text[at:]]


class PrefixTable:
    """Counts at every prefix of a word, for a BPE vocabulary with a mark on the last letter of words."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            model = json.load(file)["model"]
        self.mark = model.get("end_of_word_suffix") or ""
        vocabulary = model["vocab"]
        # Symbols, ranks and parts: a token of one symbol has no parts; others are made by one merge.
        self.rank: dict[int, int] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        self.made: dict[tuple[int, int], int] = {}
        for rank, merge in enumerate(model["merges"]):
            left, right = merge if isinstance(merge, list) else merge.split(" ", 1)
            pair, token = (vocabulary[left], vocabulary[right]), vocabulary[left + right]
            if pair not in self.made:
                self.made[pair] = token
            if token not in self.parts:
                self.parts[token], self.rank[token] = pair, rank
        self.pair_rank = {pair: rank for rank, pair in reversed([*enumerate(self._pairs(model, vocabulary))])}
        self.opened: dict[str, int] = {}
        self.closed: dict[str, int] = {}
        for token, number in vocabulary.items():
            if number not in self.parts and len(token.removesuffix(self.mark) if self.mark else token) != 1:
                continue  # not reached by merges
            if self.mark and token.endswith(self.mark):
                self.closed[token.removesuffix(self.mark)] = number
            else:
                self.opened[token] = number
        if not self.mark:
            self.closed = dict(self.opened)
        self.ends = endings(self.opened, self.closed)
        self.longest = max(map(len, [*self.opened, *self.closed]))
        self.table: dict[str, tuple[int, int, tuple[int, ...]]] = {}
        self.fits_memo: dict[tuple[int, int], bool] = {}
        self.letters = byte_letters()
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.normal = lru_cache(maxsize=PAIRS_KEPT // 10)(self._normal)
        self.cache = ChunkCache(lambda chunks: [self.chunk(led(c)) for c in chunks])

    @staticmethod
    def _pairs(model: dict, vocabulary: dict[str, int]) -> list[tuple[int, int]]:
        merges = (m if isinstance(m, list) else m.split(" ", 1) for m in model["merges"])
        return [(vocabulary[a], vocabulary[b]) for a, b in merges]

    def fits(self, left: int, right: int) -> bool:
        """Whether BPE keeps these two tokens side by side when their texts meet.

        The merges of both sides happen in rank order. At each moment the border shows one part of either
        side; if the pair of these could merge earlier than the side's own next merge, it would.
        """
        key = (left, right)
        found = self.fits_memo.get(key)
        if found is None:
            if len(self.fits_memo) > PAIRS_KEPT:
                self.fits_memo.clear()
            found = self.fits_memo[key] = self._fits(left, right)
        return found

    def _fits(self, left: int, right: int) -> bool:
        pair_rank, rank, parts = self.pair_rank, self.rank, self.parts
        # When each side's border part changes next: the rank of the merge that ends it (none for the token itself).
        left_until = right_until = 1 << 60
        while True:
            joined = pair_rank.get((left, right))
            # A tie of equal ranks is decided by place: the pair on the left of the border comes first.
            if joined is not None and joined < left_until and joined <= right_until:
                if joined < right_until or joined < left_until:
                    return False
            left_rank, right_rank = rank.get(left, -1), rank.get(right, -1)
            if left_rank < 0 and right_rank < 0:
                return True
            if left_rank >= right_rank and left_rank >= 0:
                left_until, left = left_rank, parts[left][1]
            else:
                right_until, right = right_rank, parts[right][0]

    def word(self, word: str) -> Sequence[int]:
        """Counts of tokens of the word's prefixes of 1, 2, ... letters (byte-level), each as a word of its own.

        The table is kept by prefix, so words with a common beginning share it. Of each prefix it has the last
        token and the count without the mark, and the counts with the mark of all its prefixes.
        """
        if len(word) > LONG_WORD:
            return self.long_word(word)
        table = self.table
        found = table.get(word)
        if found is None:
            if len(table) > PREFIXES_KEPT:
                table.clear()
            known = len(word) - 1
            while known and word[:known] not in table:
                known -= 1
            closed = table[word[:known]][2] if known else ()
            for end in range(known + 1, len(word) + 1):
                prefix = word[:end]
                last, count, final = self.last(prefix, table)
                closed = (*closed, final)
                found = table[prefix] = (last, count, closed)
        return found[2]

    def first_ending(self, text: str, start: int, end: int) -> int:
        """Where the longest ending of a token that ends at ``end`` begins: every ending of an ending is one, too."""
        ends, first, last = self.ends, start, end - 1
        while first < last:
            if text[start:end] in ends:
                last = start
            else:
                first = start + 1
            start = (first + last) // 2
        return first

    def last(self, prefix: str, table: dict[str, tuple]) -> tuple[int, int, int]:
        """The last token of a prefix, the count of its tokens, and the count with the mark on its last letter.

        Of the tokens that end there, the last one is the one that fits.
        """
        ends, memo, fits = self.ends, self.fits_memo, self.fits
        n = len(prefix)
        start = self.first_ending(prefix, max(0, n - self.longest), n)
        last, count, closed = -1, 0, 0
        while start < n:
            tokens = ends.get(prefix[start:])
            if tokens:
                inner, final = tokens
                before, counted, _ = table[prefix[:start]] if start else FIRST
                if before != -1:
                    if last < 0 and inner >= 0:
                        fit = not start or memo.get((before, inner))
                        if fit or (fit is None and fits(before, inner)):
                            last, count = inner, counted + 1
                    if not closed and final >= 0:
                        fit = not start or memo.get((before, final))
                        if fit or (fit is None and fits(before, final)):
                            closed = counted + 1
                    if closed and last >= 0:
                        break
            start += 1
        return last, count, closed

    def long_word(self, word: str) -> list[int]:
        """``word`` with the table in arrays, for words too long to keep by prefix."""
        return self.grown(word, [START], [0], 0)[2]

    def grown(self, word: str, lasts: list[int], counts: list[int], known: int) -> tuple[list[int], list[int], list[int]]:
        """Last tokens, counts, and counts with the mark, of prefixes; those up to ``known`` letters are given."""
        ends, memo, fits, closed = self.ends, self.fits_memo, self.fits, []
        for end in range(known + 1, len(word) + 1):
            last, count, final_count = -1, 0, 0
            for start in range(self.first_ending(word, max(0, end - self.longest), end), end):
                tokens, before = ends.get(word[start:end]), lasts[start]
                if not tokens or before == -1:
                    continue
                inner, final = tokens
                if last < 0 and inner >= 0:
                    fit = before == START or memo.get((before, inner))
                    if fit or (fit is None and fits(before, inner)):
                        last, count = inner, counts[start] + 1
                if not final_count and final >= 0:
                    fit = before == START or memo.get((before, final))
                    if fit or (fit is None and fits(before, final)):
                        final_count = counts[start] + 1
                if final_count and last >= 0:
                    break
            if not final_count:
                raise ValueError("the vocabulary lacks a byte")
            lasts.append(last)
            counts.append(count)
            closed.append(final_count)
        return lasts, counts, closed

    def piece(self, text: str) -> list[int]:
        """Counts at the prefixes of one word of the pattern, by character of ``text``."""
        if text in LONG_ENDINGS:  # cut after two letters, these are two words
            mark = self.word("'")[-1]
            return [mark, mark + self.word(text[1])[-1], self.word(text)[-1]]
        if text.isascii() and text.isprintable():
            return list(self.word(text))
        counts = self.word(text.encode().decode("latin-1").translate(self.letters))
        found, end = [], -1
        for c in text:
            end += 1 if c < "\x80" else 2 if c < "\u0800" else 3 if c < "\U00010000" else 4
            found.append(counts[end])
        return found

    def total(self, text: str) -> int:
        """Tokens of a normalised text without special strings, words found by the library."""
        return sum(self.word(w)[-1] for w, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(text) if w)

    def _normal(self, text: str) -> str:
        return self.tokenizer.normalizer.normalize_str(text) if self.tokenizer.normalizer else text

    def hard(self, chunk: str) -> list[int]:
        """Counts at the prefixes of any chunk, by character of ``chunk``.

        The chunk is normalised cluster by cluster, the library finds the words of the whole, and the table gives the
        counts at their prefixes. A cut inside a cluster can leave other letters than the whole cluster has; only the
        word it stands in is then worked out again, and of a long word only the end.
        """
        parts = clusters(chunk)
        forms = [self.normal(part) for part in parts]
        text = "".join(forms)
        counts, begins, stops = [0], [0], {}  # of each normalised prefix: tokens, and where its last word begins
        for _, (a, b) in self.tokenizer.pre_tokenizer.pre_tokenize_str(text):
            base = counts[-1]
            for at in range(len(counts), a + 1):
                counts.append(base)
                begins.append(at)
            counts += [base + c for c in self.piece(text[a:b])]
            begins += [a] * (b - a)
            stops[a] = b
        for at in range(len(counts), len(text) + 1):
            counts.append(counts[-1])
            begins.append(at)
        found, at, known, table = [], 0, -1, ()
        for part, form in zip(parts, forms, strict=True):
            for k in range(1, len(part)):
                cut = self.normal(part[:k])
                if form.startswith(cut):
                    found.append(counts[at + len(cut)])
                    continue
                first = begins[at]
                ending = False  # whether what is left may be an ending such as 's
                if first and text[first - 1] == "'":
                    first, ending = begins[first], True
                elif at and text[at - 1] == "'":
                    ending = True
                if ending or at - first <= LONG_WORD:
                    found.append(counts[first] + self.total(text[first:at] + cut))
                    continue
                if known != first:
                    known, table = first, self.long_table(text[first : stops[first]])
                found.append(counts[first] + self.end_count(table, text[first:at], cut, counts[at] - counts[first]))
            at += len(form)
            found.append(counts[at])
        return found

    def long_table(self, word: str) -> tuple[str, list[int], list[int], list[int]]:
        """A word in byte letters, where its characters end there, and last token and count of its prefixes."""
        letters = word.encode().decode("latin-1").translate(self.letters)
        lasts, counts, _ = self.grown(letters, [START], [0], 0)
        ends = np.cumsum([0, *(len(c.encode()) for c in word)]).tolist()
        return letters, ends, lasts, counts

    def end_count(self, table: tuple, head: str, cut: str, count: int) -> int:
        """Tokens of ``head + cut``: ``head``, of ``count`` tokens, begins a long word that has this table."""
        letters, ends, lasts, counts = table
        words = [w for w, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(head[-1] + cut) if w]
        more = words[0][len(head[-1].encode()) :]
        if more:
            done = ends[len(head)]
            window = max(0, done - self.longest)
            near = slice(window, done + 1)
            count = self.grown(letters[window:done] + more, lasts[near], counts[near], done - window)[2][-1]
        return count + sum(self.word(w)[-1] for w in words[1:])

    def heads(self, heads: list[str]) -> list[bytes]:
        return [self.chunk(" " + head)[4:] for head in heads]

    def chunk(self, chunk: str) -> bytes:
        """Counts at the prefixes of a space or line end and the chunk after it, as 32-bit numbers."""
        chunk = chunk[1:]
        lower = chunk.lower()
        if chunk.isascii() and chunk.isalpha():
            return array("i", (0, *self.word(lower))).tobytes()
        counts = [0]
        simple = len(lower) == len(chunk) and "Σ" not in chunk and (chunk.isascii() or unicodedata.is_normalized("NFC", chunk))
        if simple and self.plain(chunk) and (chunk.isascii() or self.plain(lower)):
            at = base = 0
            for match in SIMPLE.finditer(lower):
                counts += [base] * (match.start() - at)  # line ends between words
                new = self.piece(match[0])
                counts += [base + c for c in new]
                base, at = counts[-1], match.end()
            counts += [base] * (len(lower) - at)
        else:
            counts += self.hard(chunk)
        return array("i", counts).tobytes()

    @staticmethod
    def plain(text: str) -> bool:
        """Letters, visible ASCII characters and line ends only (digits beyond ASCII count as letters for ``re``)."""
        return PLAIN.fullmatch(text) is not None and (text.isascii() or all(c < "\x7f" or c.isalpha() for c in text))

    def prefixes(self, texts: list[str]) -> list[np.ndarray]:
        """For each text, the tokens of its first 0, 1, 2, ... characters."""
        plain = [t for t in texts if not any(s in t for s in self.special)]
        # A chunk's counts begin at 0 where the chunk's space stands; a head has no space before it.
        tables = iter(encode_texts(plain, self.cache, self.heads))
        return [self.summed(next(tables)) if not any(s in t for s in self.special) else self.cut_by_special(t) for t in texts]

    @staticmethod
    def summed(table: bytes) -> np.ndarray:
        """Adds to each chunk's counts those of the chunks before; a fall to 0 after a count begins a chunk."""
        counts = np.concatenate(([0], np.frombuffer(table, "<i4"))).astype(np.int64)
        falls = np.flatnonzero((counts[1:] == 0) & (counts[:-1] > 0)) + 1
        gains = np.zeros(len(counts), np.int64)
        gains[falls] = counts[falls - 1]
        return counts + np.cumsum(gains)

    def cut_by_special(self, text: str) -> np.ndarray:
        """A special string is one token; up to its last letter it is ordinary text."""
        found = np.zeros(len(text) + 1, np.int64)
        at = base = 0
        pattern = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True))))
        for match in pattern.finditer(text):
            part = self.prefixes_plain(text[at : match.end() - 1])
            found[at : match.end()] = base + part
            base = base + int(part[match.start() - at]) + 1
            found[match.end()] = base
            at = match.end()
        found[at:] = base + self.prefixes_plain(text[at:])
        return found

    def prefixes_plain(self, text: str) -> np.ndarray:
        return self.summed(encode_texts([text], self.cache, self.heads)[0])


@lru_cache(maxsize=2)
def prefix_table(path: str) -> PrefixTable:
    return PrefixTable(path)


def prefix_counts(docs: DataFrame, vocabulary: str) -> DataFrame:
    """``doc_id, n_bytes, prefix_tokens``: element i is the count of tokens of the first i characters (code points).

    A null text is an empty one, with the single count 0. Rows are kept as they are, with repeated and null ids;
    other columns are not read; an empty table gives no rows. Each text is handled alone, so the job has no shuffle.
    """

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = batch.column("text").to_pylist()
        tables = prefix_table(vocabulary).prefixes(texts)
        bounds = np.concatenate(([0], np.cumsum([len(t) for t in tables]))).astype(np.int32)
        values = pa.array(np.concatenate([*tables, np.zeros(0, np.int64)]).astype(np.int32))
        sizes = pa.array([len(t.encode()) for t in texts], pa.int64())
        lists = pa.ListArray.from_arrays(pa.array(bounds), values)
        return pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), sizes, lists], ["doc_id", "n_bytes", "prefix_tokens"])

    return map_steps(id_and_text(docs), work, "doc_id long, n_bytes long, prefix_tokens array<int>", 2_000_000, caches=True)


def within_budget(counts: DataFrame, budget: int) -> DataFrame:
    """From stored prefix counts: ``n_tokens``, ``over_limit`` and ``fit_chars``, the longest prefix within the budget."""
    total = F.element_at("prefix_tokens", -1).cast("long")
    fit = F.when(total <= budget, F.size("prefix_tokens") - 1).otherwise(
        F.array_position(F.reverse(F.transform("prefix_tokens", lambda c: c <= budget)), True)
    )
    longest = F.when(total <= budget, fit).otherwise(F.size("prefix_tokens") - fit)
    return counts.select("doc_id", "n_bytes", total.alias("n_tokens"), (total > budget).alias("over_limit"), longest.cast("long").alias("fit_chars"))


def counted(docs: DataFrame, vocabulary: str, budget: int) -> DataFrame:
    """``within_budget`` answered in the task that makes the prefix table, which is then not written.

    One row per row of ``docs``, with repeated and null ids; a null or empty text has 0 bytes and 0 tokens and is
    within any budget; an empty table gives no rows; other columns are not read. A text of any length takes time in
    proportion to it: its words are counted once, and a cut between letters that compose looks at one word's end.
    """

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = batch.column("text").to_pylist()
        tables = prefix_table(vocabulary).prefixes(texts)
        totals = np.array([t[-1] for t in tables], np.int64)
        fits = [len(t) - 1 if t[-1] <= budget else int(np.flatnonzero(t <= budget)[-1]) for t in tables]
        sizes = pa.array([len(t.encode()) for t in texts], pa.int64())
        columns = [sizes, pa.array(totals), pa.array(totals > budget), pa.array(fits, pa.int64())]
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id").cast(pa.int64()), *columns], ["doc_id", "n_bytes", "n_tokens", "over_limit", "fit_chars"]
        )

    return map_steps(id_and_text(docs), work, "doc_id long, n_bytes long, n_tokens long, over_limit boolean, fit_chars long", 2_000_000, caches=True)
