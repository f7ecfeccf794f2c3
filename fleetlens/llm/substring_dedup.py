"""Passages that occur again anywhere, found by seeds and grown to maximal repeats.

Seeds: of the short word runs (grams) in a window of ``length`` words, the one with the least hash is the
window's anchor. Equal windows have equal anchors at equal places, so only windows whose anchor occurs twice can
repeat, and documents need to meet only on these. Extension: the windows of one anchor reach from it both ways and
form a block, which is compared whole first; where a block is the only one of its kind (the ends of repeats) its
windows are compared one by one, with one representative of each repeated block. Repeated windows that overlap
are one maximal repeat of at least ``length`` words.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.llm.common import carried, hashed_words, map_steps, mixed, rest, run_hashes

KEY = ["k1", "k2"]
GRAM = 8


def keyed(docs: DataFrame, carry: bool = False) -> DataFrame:
    """Texts under a key of 96 bits made from id and text, dealt out by it.

    Rows with equal id and text share a key and get equal results; each still counts as an occurrence.
    """
    text = F.coalesce("text", F.lit("")).alias("text")
    rows = docs.select("doc_id", text, *rest(docs, carry))
    rows = rows.withColumns({"k1": F.xxhash64("text", "doc_id"), "k2": F.hash("text", "doc_id")})
    return rows.repartition(*KEY)


def windows_of(texts: pa.Array, length: int, gram: int, whole: bool = True):
    """Hash of each window of each text (if ``whole``), the text it is in, its place there and its anchor's.

    The anchor is the leftmost least gram of the window; the last item is the hash of each anchor.
    """
    words, starts = hashed_words(texts)
    grams = run_hashes(words, gram)
    n = max(0, len(words) - length + 1)
    hashes = run_hashes(words, length) if whole else np.zeros(n, np.uint64)
    owner = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    least = np.arange(len(grams))
    size, width = 1, length - gram + 1

    def lesser(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.where(grams[b] < grams[a], b, a)

    while 2 * size <= width:
        least = lesser(least[:-size], least[size:])
        size *= 2
    anchors = lesser(least[:n], least[width - size : width - size + n]) if n else least[:0]
    inside = np.flatnonzero(owner[:n] == owner[length - 1 :]) if n else np.zeros(0, np.int64)
    first = starts[owner[inside]]
    return hashes[inside], owner[inside], inside - first, anchors[inside] - first, grams[anchors[inside]]


def blocks_of(owner: np.ndarray, anchors: np.ndarray) -> np.ndarray:
    """Where, among windows in order, a new block (text and anchor) begins."""
    if not len(owner):
        return np.zeros(0, np.int64)
    new = np.append(True, (owner[1:] != owner[:-1]) | (anchors[1:] != anchors[:-1]))
    return np.flatnonzero(new)


def keys_of(batch: pa.RecordBatch, rows: np.ndarray) -> list[pa.Array]:
    return [batch.column(k).take(pa.array(rows)) for k in KEY]


def flattened(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The values of a list column and the row of each."""
    sizes = np.diff(lists.offsets.to_numpy())
    return lists.flatten().to_numpy(zero_copy_only=False), np.repeat(np.arange(len(lists)), sizes)


def among(rows: np.ndarray, places: np.ndarray, wanted_rows: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Whether each (row, place) is one of the wanted ones."""
    base = 1 << 32
    return np.isin(rows.astype(np.int64) * base + places, wanted_rows.astype(np.int64) * base + wanted)


def anchor_rows(length: int, gram: int) -> Callable[[pa.RecordBatch], pa.RecordBatch]:
    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        _, owner, _, anchors, hashes = windows_of(batch.column("text"), length, gram, whole=False)
        first = blocks_of(owner, anchors)
        columns = [pa.array(anchors[first].astype(np.int32)), pa.array(hashes[first].view(np.int64))]
        return pa.RecordBatch.from_arrays([*keys_of(batch, owner[first]), *columns], [*KEY, "place", "anchor"])

    return work


def block_rows(length: int, gram: int) -> Callable[[pa.RecordBatch], pa.RecordBatch]:
    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        hashes, owner, places, anchors, _ = windows_of(batch.column("text"), length, gram)
        first = blocks_of(owner, anchors)
        sizes = np.diff(np.append(first, len(owner)))
        wanted, rows = flattened(batch.column("places"))
        chosen = among(owner[first], anchors[first], rows, wanted)
        if len(first):
            order = np.arange(len(owner)) - np.repeat(first, sizes)
            parts = mixed(hashes + mixed(order.astype(np.uint64)))
            whole = mixed(np.add.reduceat(parts, first) + sizes.astype(np.uint64))
        else:
            whole = hashes
        first, sizes, whole = first[chosen], sizes[chosen], whole[chosen]
        columns = [places[first].astype(np.int32), sizes.astype(np.int32), whole.view(np.int64)]
        return pa.RecordBatch.from_arrays(
            [*keys_of(batch, owner[first]), *map(pa.array, columns)], [*KEY, "start", "n", "block"]
        )

    return work


def window_rows(length: int, gram: int) -> Callable[[pa.RecordBatch], pa.RecordBatch]:
    """Windows of the chosen blocks; ``open`` where it is not known yet whether they repeat."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        hashes, owner, places, anchors, _ = windows_of(batch.column("text"), length, gram)
        first = blocks_of(owner, anchors)
        sizes = np.diff(np.append(first, len(owner)))
        chosen = np.zeros(len(owner), bool)
        undecided = np.zeros(len(owner), bool)
        for column, mark in (("known", False), ("open", True)):
            wanted, rows = flattened(batch.column(column))
            hit = np.repeat(among(owner[first], places[first], rows, wanted), sizes)
            chosen |= hit
            if mark:
                undecided |= hit
        columns = [places[chosen].astype(np.int32), hashes[chosen].view(np.int64), undecided[chosen]]
        return pa.RecordBatch.from_arrays(
            [*keys_of(batch, owner[chosen]), *map(pa.array, columns)], [*KEY, "start", "window", "open"]
        )

    return work


def repeats(texts: DataFrame, length: int, gram: int) -> tuple[DataFrame, DataFrame]:
    """By key: repeated blocks (``done``: start and number of windows), and repeated windows of other blocks (``single``).

    The first frame also has what is still ``open`` and the representatives ``known`` to repeat. Whoever reads
    it takes all its columns: so both uses share one exchange, and blocks are worked out once for each shuffle.
    """
    key = "k1 long, k2 int"
    anchors = map_steps(texts, anchor_rows(length, gram), f"{key}, place int, anchor long")
    common = anchors.groupBy("anchor").count().where("count > 1").select("anchor")
    places = anchors.join(common, "anchor").groupBy(*KEY).agg(F.collect_set("place").alias("places"))

    # All columns of the texts go along, as a join with fewer would shuffle the texts a second time.
    seeded = texts.join(places, KEY)
    blocks = map_steps(seeded, block_rows(length, gram), f"{key}, start int, n int, block long")
    least = F.min(F.struct(*KEY, "start"))
    kinds = blocks.groupBy("block").agg(F.count("*").alias("times"), least.alias("least"))
    single, first = F.col("times") == 1, F.struct(*KEY, "start") == F.col("least")
    judged = blocks.join(kinds, "block").groupBy(*KEY)
    judged = judged.agg(
        F.collect_set(F.when(~single, F.struct("start", "n"))).alias("done"),
        F.collect_set(F.when(~single & first, F.col("start"))).alias("known"),
        F.collect_set(F.when(single, F.col("start"))).alias("open"),
    )
    grown = texts.join(judged, KEY)
    windows = map_steps(grown, window_rows(length, gram), f"{key}, start int, window long, open boolean")
    again = windows.groupBy("window").count().where("count > 1").select("window")
    found = windows.where("open").join(again, "window").groupBy(*KEY).agg(F.collect_set("start").alias("single"))
    return judged, found


def kept_words(text: bytes, done: list[dict] | None, single: list[int] | None, length: int) -> tuple[int, list[bytes]]:
    """How many words a text has, and those that no repeated window covers."""
    words = text.split()  # of bytes, this splits at the six blanks of the definition and no others
    if not done and not single:
        return len(words), words
    covered = bytearray(len(words))
    spans = [(d["start"], d["n"]) for d in done or ()] + [(start, 1) for start in single or ()]
    for start, n in spans:
        end = min(len(words), start + n + length - 1)
        covered[start:end] = b"\x01" * (end - start)
    return len(words), [w for w, gone in zip(words, covered, strict=True) if not gone]


def deduplicated(docs: DataFrame, *, length: int = 35, gram: int = GRAM, carry: bool = False) -> DataFrame:
    """One row per document: ``doc_id, n_words, n_removed, kept_sha256`` (of the words left, one space between), ``kept``.

    ``kept`` is the text as it is where nothing goes, else the words left with one space between.

    Every word is removed that a window of ``length`` words covers whose words also begin elsewhere, in another or
    the same document; windows are judged on the input. A null text has no words; texts of fewer words than a
    window lose none. Rows are kept as they are: equal rows are copies of each other and lose their windows, null
    ids are as good as others. An empty table gives no rows; other columns are not read, unless ``carry`` asks for them as ``rest``.

    Equality is by 64-bit hashes of windows, whose anchors of another hash are equal too. What repeats is counted
    before it is shuffled, and joins on anchors, blocks and windows are plain joins that Spark splits where a key is hot.
    """
    texts = keyed(docs, carry)
    names = ["doc_id", "n_words", "n_removed", "kept_sha256", "kept"]
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string"
    names, schema = carried(docs, names, schema, carry)
    judged, found = repeats(texts, length, gram)

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        lists = (batch.column(c).to_pylist() for c in ("text", "done", "single"))
        for text, done, single in zip(*lists, strict=True):
            n, words = kept_words(text.encode(), done, single, length)
            kept = b" ".join(words)
            digest = hashlib.sha256(kept).hexdigest()
            rows.append((n, n - len(words), digest, text if n == len(words) else kept.decode()))
        columns = list(zip(*rows, strict=True)) or [[]] * 4
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.string())
        arrays = [pa.array(list(c), t) for c, t in zip(columns, kinds, strict=True)]
        more = [batch.column("rest")] if carry else []
        return pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), *arrays, *more], names)

    joined = texts.join(judged, KEY, "left").join(found, KEY, "left")
    joined = joined.select("doc_id", "text", "known", "open", "done", "single", *["rest"] * carry)
    return map_steps(joined, work, schema)
