"""SentencePiece BPE: encoding by a table of prefixes, and decoding.

Merges of this kind leave each prefix of a text with a last token of its own: the encoding of a text begins with the
encoding of the prefix before its last token. So a table holds, for each prefix, that token. An automaton finds the
pieces that end there; the right one is the piece that merging would leave apart from the last token of the prefix
before it. The ids are then read off from the end of the text backwards. The time is proportional to the text.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.llm.chunks import ChunkCache
from fleetlens.llm.common import carried, id_and_text, map_steps, rest

SPACE = "▁"  # how pieces write a space (fixed by the format)
MARKS = ".,;:!?)\"'"
BYTE = re.compile(r"<0x([0-9A-F]{2})>")
NEVER = float("inf")


class MergeRules:
    """Which two symbols merge, and when: a piece's rank is its score negated, lower ranks first, then from the left."""

    def __init__(self, ranks: dict[str, float]) -> None:
        self.ranks = ranks
        self.halves: dict[str, tuple[str, str]] = {}
        self.spines: dict[tuple[str, int], list[tuple[str, float]]] = {}
        for piece in ranks:
            if len(piece) > 1:
                before = self.merged(piece, last=True)
                if len(before) == 2:  # reached by merges; other pieces never occur
                    self.halves[piece] = (before[0], before[1])
        rank = ranks.get
        # Where a piece is made after both of its halves, spines are in the order of time.
        self.in_order = all(rank(half, -NEVER) <= ranks[p] for p, both in self.halves.items() for half in both if len(half) > 1)

    def merged(self, text: str, last: bool = False) -> list[str]:
        """The symbols of a short text, one merge at a time; with ``last``, those before the merge to a single one."""
        symbols = list(text)
        while len(symbols) > 1:
            rank, at = min((self.ranks.get(a + b, NEVER), i) for i, (a, b) in enumerate(zip(symbols, symbols[1:], strict=False)))
            if rank == NEVER or (last and len(symbols) == 2):
                break
            symbols[at : at + 2] = [symbols[at] + symbols[at + 1]]
        return symbols

    def spine(self, piece: str, side: int) -> list[tuple[str, float]]:
        """The symbols at the right (1) or left (0) end of a piece while it grows, each with the rank that ends it."""
        known = self.spines.get((piece, side))
        if known is None:
            grown, until = [], NEVER
            symbol = piece
            while True:
                grown.append((symbol, until))
                if symbol not in self.halves:
                    break
                until = self.ranks[symbol]
                symbol = self.halves[symbol][side]
            known = self.spines[piece, side] = grown[::-1]
        return known

    def apart(self, left: str, right: str) -> bool:
        """Whether two pieces next to each other stay two: no merge across them comes before those that make them."""
        if not self.in_order:
            return self.merged(left + right) == [left, right]
        a, b = self.spine(left, 1), self.spine(right, 0)
        i = j = 0
        ranks = self.ranks
        while True:
            (x, until_x), (y, until_y) = a[i], b[j]
            across = ranks.get(x + y, NEVER)
            if across < until_x and across <= until_y and across < NEVER:
                return False
            if until_x == until_y == NEVER:
                return True
            if until_x <= until_y:
                i += 1
            else:
                j += 1


class PieceCodec:
    """Encodes and decodes as the library does with the model, an end id after each text.

    For models that merge pairs, keep texts as they are, put a space before a text and write what they do not know
    as bytes; others are refused.
    """

    def __init__(self, path: str) -> None:
        import ahocorasick
        from sentencepiece import SentencePieceProcessor
        from sentencepiece.sentencepiece_model_pb2 import ModelProto

        model = ModelProto()
        model.ParseFromString(SentencePieceProcessor(model_file=path).serialized_model_proto())
        spec, norm = model.trainer_spec, model.normalizer_spec
        kinds = {p.type for p in model.pieces}
        plain = norm.add_dummy_prefix and norm.escape_whitespaces and not norm.remove_extra_whitespaces
        if spec.model_type != spec.BPE or norm.precompiled_charsmap or not plain or not spec.byte_fallback or kinds - {1, 2, 3, 6}:
            raise ValueError(f"not a byte-fallback BPE model without normalization: {path}")
        self.end = spec.eos_id
        self.ids = {p.piece: i for i, p in enumerate(model.pieces) if p.type == 1}
        self.bytes = {int(m[1], 16): i for i, p in enumerate(model.pieces) if p.type == 6 and (m := BYTE.fullmatch(p.piece))}
        self.rules = MergeRules({p.piece: -p.score for p in model.pieces if p.type == 1})
        self.names = [p.piece for p in model.pieces]
        self.automaton = ahocorasick.Automaton()
        for piece, i in self.ids.items():
            if len(piece) == 1 or piece in self.rules.halves:
                self.automaton.add_word(piece, (len(piece), i))
        self.automaton.make_automaton()
        self.judged: dict[int, bool] = {}  # by the numbers of two neighbours: whether they stay two
        inside = {pair for piece in self.ids for pair in zip(piece, piece[1:], strict=False)}
        self.inside = inside
        self.letters = {piece for piece in self.ids if len(piece) == 1}
        # No piece has anything but a space before a space, or anything beside a line end: texts can be cut there.
        # Every character of a piece is a piece, so that others are alone.
        cuts = any(b == SPACE != a or "\n" in (a, b) for a, b in inside)
        if cuts or not self.letters.issuperset(c for pair in inside for c in pair):
            raise ValueError(f"pieces of the model reach over spaces or line ends, or hold unknown characters: {path}")
        self.unknown = re.compile(f"([^{re.escape(''.join(sorted(self.letters)))}])")
        self.cut = re.compile(f"{SPACE}+[^{SPACE}\n]*|\n|[^{SPACE}\n]+")
        self.cache = ChunkCache(self.chunks)
        self.sizes = [len(name) for name in self.names]
        self.piece_of = [self.shown(p.piece, p.type) for p in model.pieces]
        self.byte_of = {i: b for b, i in self.bytes.items()}
        self.led = {i for piece, i in self.ids.items() if piece[0] == SPACE}  # the first of a text loses its space

    @staticmethod
    def shown(piece: str, kind: int) -> str:
        """What a piece is decoded to; bytes are put together later."""
        return " ⁇ " if kind == 2 else "" if kind == 3 else piece.replace(SPACE, " ")

    def last_tokens(self, text: str) -> list[int]:
        """For each prefix of each line of a text, the number of its last token; 0 for an empty one.

        The text holds known characters and line ends, which no piece reaches over.
        """
        table = [0] * (len(text) + 1)
        judged, size = self.judged, len(self.names)
        for at, (length, piece) in self.automaton.iter(text):
            if not table[at + 1]:
                before = table[at + 1 - length]
                if before:
                    stays = judged.get(before * size + piece)
                    if not (self.stays(before * size + piece) if stays is None else stays):
                        continue
                table[at + 1] = piece
        return table

    def stays(self, pair: int) -> bool:
        """Whether merging leaves two pieces next to each other as they are; remembered for a bounded number of pairs."""
        if len(self.judged) > 1_000_000:
            self.judged.clear()
        left, right = divmod(pair, len(self.names))
        found = self.judged[pair] = self.rules.apart(self.names[left], self.names[right])
        return found

    def ids_of(self, parts: list[str]) -> list[bytes]:
        """The ids of each part, read backwards from the table; unknown characters as bytes."""
        known = [part for part in parts if self.letters.issuperset(part)]
        table, sizes = self.last_tokens("\n".join(known)), self.sizes
        found, at = {}, 0
        for part in known:
            end, ids = at + len(part), array("I")
            while end > at:
                piece = table[end]
                ids.append(piece)
                end -= sizes[piece]
            ids.reverse()
            found[part] = ids.tobytes()
            at += len(part) + 1
        return [found[part] if part in found else self.with_unknown(part) for part in parts]

    def with_unknown(self, part: str) -> bytes:
        pieces = self.unknown.split(part)  # every second one is an unknown character
        spelled = [array("I", [self.bytes[b] for b in c.encode()]).tobytes() for c in pieces[1::2]]
        return b"".join(known + other for known, other in zip(self.ids_of(pieces[::2]), [*spelled, b""], strict=True))

    def chunks(self, chunks: list[str]) -> list[bytes]:
        """The ids of each chunk; marks that no piece joins to the word before them are looked up by themselves."""
        known, inside = self.cache.young, self.inside
        split, wanted = [], set()
        for chunk in chunks:
            stem = chunk.rstrip(MARKS)
            if not stem or len(stem) == len(chunk) or (stem[-1], chunk[len(stem)]) in inside:
                stem = chunk
            split.append((stem, chunk[len(stem) :]))
        wanted = list({part for both in split for part in both if part and part not in known})
        known.update(zip(wanted, self.ids_of(wanted), strict=True))
        return [known[stem] + known[tail] if tail else known[stem] for stem, tail in split]

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text and the end id, as 32-bit numbers of the machine."""
        find = self.cut.findall
        parts = [find(SPACE + text.replace(" ", SPACE)) if text else [] for text in texts]
        end = array("I", [self.end]).tobytes()
        return [ids + end for ids in self.cache.join(parts)]

    def decode(self, ids: array) -> str:
        """The text of ids: pieces one after the other, runs of bytes as the characters they spell, without the first space."""
        names, spelled = self.piece_of, self.byte_of
        if not spelled.keys().isdisjoint(ids):
            parts, run = [], bytearray()
            for i in ids:
                if i in spelled:
                    run.append(spelled[i])
                else:
                    if run:
                        parts.append(characters(run))
                        run = bytearray()
                    parts.append(names[i])
            text = "".join([*parts, characters(run)])
        else:
            text = "".join([names[i] for i in ids])
        first = next((i for i in ids if names[i]), None)
        return text[1:] if first in self.led else text


def characters(run: bytearray) -> str:
    """UTF-8 bytes as text; each byte that belongs to no character becomes one replacement sign."""
    try:
        return run.decode()
    except UnicodeDecodeError as error:
        return run[: error.start].decode() + "�" + characters(run[error.start + 1 :])


@lru_cache(maxsize=2)
def piece_codec(path: str) -> PieceCodec:
    """One codec per worker process, with what it has cached."""
    return PieceCodec(path)


def encoded(docs: DataFrame, path: str, *, carry: bool = False) -> DataFrame:
    """``doc_id, ids``: the ids of each whole text with the end id, ``array<int>``.

    A null text is an empty one and has the end id alone. Rows are kept as they are, with repeated and null ids; an
    empty table gives no rows; other columns are not read, unless ``carry`` asks for them as ``rest``. Texts are
    handled one by one, without a shuffle, in time proportional to their length; equal merge ranks go from the left.
    """
    names, schema = carried(docs, ["doc_id", "ids"], "doc_id long, ids array<int>", carry)

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = piece_codec(path).encode(batch.column("text").to_pylist())
        bounds = [0]
        for ids in found:
            bounds.append(bounds[-1] + len(ids) // 4)
        values = pa.Array.from_buffers(pa.int32(), bounds[-1], [None, pa.py_buffer(b"".join(found))])
        lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), values)
        more = [batch.column("rest")] if carry else []
        return pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), lists, *more], names)

    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), *rest(docs, carry))
    return map_steps(rows, work, schema, caches=True)


def decoded(rows: DataFrame, path: str) -> DataFrame:
    """``doc_id, text`` of rows ``doc_id, ids``. Null ids are none and give an empty text; special ids give nothing."""

    def run(batches):
        for batch in batches:
            codec = piece_codec(path)
            texts = [codec.decode(array("I", ids or ())) for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return rows.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """``doc_id, n_tokens`` (end id included), ``ids_sha256`` and ``decoded_sha256``, encoded and decoded in one pass.

    Nulls, repeated rows and empty tables as in ``encoded``.
    """
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        codec = piece_codec(path)
        counts, marks, texts = [], [], []
        for data in codec.encode(batch.column("text").to_pylist()):
            ids = array("I", data)
            counts.append(len(ids))
            marks.append(hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
            texts.append(hashlib.sha256(codec.decode(ids).encode()).hexdigest())
        columns = [pa.array(counts, pa.int64()), pa.array(marks, pa.string()), pa.array(texts, pa.string())]
        return pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), *columns], names)

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return map_steps(id_and_text(docs), work, schema, caches=True)
