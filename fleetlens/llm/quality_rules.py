"""Quality rules: base counts, and how far a document is from its language.

Each language has two references, taken from all documents that name it: the shares of character classes, and
the shares of its most common words. A document is compared with both by Jensen-Shannon distance (the square
root of the divergence, base 2, from 0 to 1). Short documents are not judged by distance.
"""

from __future__ import annotations

import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fleetlens.llm.chunks import forget_chunks
from fleetlens.llm.common import carried, map_steps, rest, steps, stored, word_offsets

CLASSES = ("space", "lower", "upper", "letter", "digit", "symbol", "mark", "other")
SPACE, LOWER, UPPER, LETTER, DIGIT, SYMBOL, MARK, OTHER = range(len(CLASSES))
SYMBOLS = "#*$%&|<>"
TABLE_SIZE = 0x3000  # code points with a class of their own entry; later ones count as letters
POOLED = None  # no language: a null one is the language ""


@dataclass(frozen=True)
class Limits:
    """Thresholds of the verdict. ``languages`` is how many have their references on the driver; others are joined."""

    min_words: int = 50
    max_repeat_percent: int = 50
    distance_min_words: int = 50
    class_distance: float = 0.30
    # The word distance of n words drawn from the language itself falls with the root of n; so does the limit.
    word_distance: float = 0.45
    word_distance_root: float = 3.3
    common_words: int = 64
    languages: int = 256
    reference_min_words: int = 1000


@dataclass(frozen=True)
class References:
    """By language: class counts and common words with their counts and the sum of these.

    ``others`` has the same of every further language, a row each: ``lang, classes, words, counts, total``. No document
    is judged by the sums of the first under ``POOLED``.
    """

    classes: dict[str | None, np.ndarray] = field(default_factory=dict)
    words: dict[str | None, dict[str, int]] = field(default_factory=dict)
    totals: dict[str | None, int] = field(default_factory=dict)
    others: DataFrame | None = None


@lru_cache(maxsize=1)
def class_table() -> np.ndarray:
    table = np.full(TABLE_SIZE + 1, LETTER, np.uint8)
    kinds = {"Ll": LOWER, "Lu": UPPER, "Nd": DIGIT}
    for point in range(TABLE_SIZE):
        char = chr(point)
        if char in " \t\n\v\f\r":
            table[point] = SPACE
        elif char in SYMBOLS:
            table[point] = SYMBOL
        else:
            kind = unicodedata.category(char)
            groups = {"L": LETTER, "M": LETTER, "P": MARK, "S": MARK}
            table[point] = kinds.get(kind, groups.get(kind[0], OTHER))
    return table


def class_counts(texts: list[str]) -> np.ndarray:
    """Code points of each class in each text."""
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4")
    kinds = class_table()[np.minimum(points, TABLE_SIZE)].astype(np.int64)
    kinds += np.repeat(np.arange(len(texts)) * len(CLASSES), [len(t) for t in texts])
    return np.bincount(kinds, minlength=len(texts) * len(CLASSES)).reshape(len(texts), len(CLASSES))


def numbered(values: np.ndarray) -> np.ndarray:
    """Equal values get equal numbers from 0 on, fewer than there are values."""
    return np.unique(values, return_inverse=True)[1]


def repeated_words(codes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Words of each text in windows of three that its text has twice or more."""
    texts, n = len(starts) - 1, len(codes)
    if n < 3:
        return np.zeros(texts, np.int64)
    owner = np.repeat(np.arange(texts), np.diff(starts))
    inside = np.flatnonzero(owner[:-2] == owner[2:])
    pairs = numbered(codes[inside] * (n + 1) + codes[inside + 1])
    triples = numbered(pairs * (n + 1) + codes[inside + 2])
    keys = owner[inside] * (n + 1) + triples
    _, place, sizes = np.unique(keys, return_inverse=True, return_counts=True)
    twice = inside[sizes[place] > 1]
    covered = np.zeros(n, bool)
    for k in range(3):
        covered[twice + k] = True
    return np.bincount(owner[covered], minlength=texts)


def repeated_lines(text: str) -> int:
    lines = [line for line in text.split("\n") if line.strip(" \t\v\f\r")]
    return len(lines) - len(set(lines))


def distance(counts: np.ndarray, reference: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance of each row of counts to a reference; rows without counts have distance 0."""
    sums = counts.sum(axis=1, keepdims=True)
    p = counts / np.maximum(sums, 1)
    q = reference / max(reference.sum(), 1)
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        left = np.where(p > 0, p * np.log2(p / m), 0.0).sum(axis=1)
        right = np.where(q > 0, q * np.log2(q / m), 0.0).sum(axis=1)
    return np.where(sums[:, 0] > 0, np.sqrt(np.maximum(0.0, (left + right) / 2)), 0.0)


def coded_words(texts: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Words of all texts as numbers into a list of distinct words, and where each text's words begin."""
    flat, starts = word_offsets(texts)
    coded = flat.dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary, starts


def by_language(batch: pa.RecordBatch) -> Iterator[tuple[str, np.ndarray]]:
    """Each language of a batch with its rows, in order."""
    coded = batch.column("lang").dictionary_encode()
    codes = coded.indices.to_numpy(zero_copy_only=False)
    order = np.argsort(codes, kind="stable")
    bounds = np.searchsorted(codes[order], np.arange(len(coded.dictionary) + 1))
    for k, lang in enumerate(coded.dictionary.to_pylist()):
        yield lang, order[bounds[k] : bounds[k + 1]]


def words_of(rows: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Places of all words of these rows, in the order of the rows."""
    sizes = starts[rows + 1] - starts[rows]
    ends = np.cumsum(sizes)
    return np.repeat(starts[rows] - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)


def with_language(docs: DataFrame, carry: bool = False) -> DataFrame:
    lang = F.coalesce("lang", F.lit("")) if "lang" in docs.columns else F.lit("")
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), lang.alias("lang"), *rest(docs, carry))


def language_references(docs: DataFrame, limits: Limits = Limits()) -> References:
    """References from all documents. Counts are added up in each task, then by language and word.

    What comes to the driver is, for each of the ``limits.languages`` languages with most characters, the class
    counts and the most common words. Those of all other languages are written as a table.
    """

    def count(batches):
        forget_chunks()
        classes: dict[str, np.ndarray] = {}
        words: dict[str, Counter] = {}

        def rows():
            table = [(lang, None, int(c), n) for lang, v in classes.items() for c, n in enumerate(v.tolist())]
            table += [(lang, word, -1, n) for lang, counter in words.items() for word, n in counter.items()]
            columns = list(zip(*table, strict=True)) or [[], [], [], []]
            kinds = (pa.string(), pa.string(), pa.int32(), pa.int64())
            arrays = [pa.array(c, t) for c, t in zip(columns, kinds, strict=True)]
            return pa.RecordBatch.from_arrays(arrays, ["lang", "word", "class", "n"])

        for batch in steps(batches):
            texts = batch.column("text")
            counts = class_counts(texts.to_pylist())
            codes, names, starts = coded_words(texts)
            names = names.to_pylist()
            for lang, mine in by_language(batch):
                classes[lang] = classes.get(lang, 0) + counts[mine].sum(axis=0)
                own, times = np.unique(codes[words_of(mine, starts)], return_counts=True)
                found = zip(own.tolist(), times.tolist(), strict=True)
                words.setdefault(lang, Counter()).update({names[i]: n for i, n in found})
            if len(CLASSES) * len(classes) + sum(map(len, words.values())) > 150_000:
                yield rows()
                classes, words = {}, {}
        yield rows()

    parts = with_language(docs).mapInArrow(count, "lang string, word string, class int, n long")
    sums = stored(parts.groupBy("lang", "word", "class").agg(F.sum("n").alias("n")), "words")
    sizes = sums.where(F.col("word").isNull()).groupBy("lang").agg(F.sum("n").alias("size"))
    largest = [r["lang"] for r in sizes.orderBy(F.desc("size"), "lang").limit(limits.languages + 1).collect()]
    more, largest = len(largest) > limits.languages, largest[: limits.languages]
    order = Window.partitionBy("lang", "class").orderBy(F.desc("n"), "word")
    ranked = sums.where(F.col("lang").isin(largest)).withColumn("rank", F.row_number().over(order))
    classes = {POOLED: np.zeros(len(CLASSES), np.int64)}
    counters: dict[str, Counter] = {POOLED: Counter()}
    for row in ranked.where(F.col("rank") <= limits.common_words).collect():
        for lang in (row["lang"], POOLED):
            if row["word"] is None:
                classes.setdefault(lang, np.zeros(len(CLASSES), np.int64))[row["class"]] += row["n"]
            else:
                counters.setdefault(lang, Counter())[row["word"]] += row["n"]
    words = {}
    for lang, counter in counters.items():
        words[lang] = dict(sorted(counter.items(), key=lambda x: (-x[1], x[0]))[: limits.common_words])
    totals = {lang: sum(words[lang].values()) for lang in words}
    others = other_references(sums.where(~F.col("lang").isin(largest)), limits) if more else None
    return References(classes, words, totals, others)


def other_references(sums: DataFrame, limits: Limits) -> DataFrame:
    """``lang, classes, words, counts, total`` of each language of the sums, written once."""
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "word")
    words = sums.where(F.col("word").isNotNull()).withColumn("rank", F.row_number().over(order))
    words = words.where(F.col("rank") <= limits.common_words).groupBy("lang")
    words = words.agg(F.array_sort(F.collect_list(F.struct("rank", "word", "n"))).alias("best"), F.sum("n").alias("total"))
    classes = sums.where(F.col("word").isNull()).groupBy("lang")
    classes = classes.agg(F.array_sort(F.collect_list(F.struct("class", "n"))).alias("all"))
    best = F.col("best.word").alias("words"), F.col("best.n").alias("counts")
    return stored(classes.join(words, "lang").select("lang", F.col("all.n").alias("classes"), *best, "total"), "languages")


def rated(docs: DataFrame, references: References, limits: Limits = Limits(), *, carry: bool = False) -> DataFrame:
    """Base counts, both distances and the verdict ``kept`` of each whole text.

    A null text has no words and fails; a null language is the language ``""``; a language without a reference
    of enough words is not judged by distance. Rows are kept as they are, repeated ids too; an empty table gives
    no rows; other columns are not read, unless ``carry`` asks for the text and, as ``rest``, all others.
    """
    out, schema = carried(docs, NAMES, SCHEMA, carry)
    held = {x: (references.classes[x], references.words[x], references.totals[x]) for x in references.words if x is not POOLED}

    def joined_reference(batch: pa.RecordBatch, row: int):
        found = batch.column("reference")[row].as_py()
        if found is None:
            return None
        return np.array(found["classes"]), dict(zip(found["words"], found["counts"], strict=True)), found["total"]

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = batch.column("text")
        whole = texts.to_pylist()
        classes = class_counts(whole)
        codes, names, starts = coded_words(texts)
        n_words = np.diff(starts)
        repeats = repeated_words(codes, starts)
        far_class, far_word = np.zeros(len(whole)), np.zeros(len(whole))
        for lang, mine in by_language(batch):
            known = joined_reference(batch, int(mine[0])) if "reference" in batch.schema.names else held.get(lang)
            if known is None or known[2] < limits.reference_min_words:
                continue
            far_class[mine] = distance(classes[mine], known[0].astype(float))
            common = known[1]
            own, place = np.unique(codes[words_of(mine, starts)], return_inverse=True)
            column = pc.index_in(names.take(pa.array(own)), pa.array(list(common), names.type))
            column = pc.fill_null(column, -1).to_numpy(zero_copy_only=False).astype(np.int64)[place]
            owner, of = np.repeat(np.arange(len(mine)), n_words[mine]), column >= 0
            counts = np.bincount(owner[of] * len(common) + column[of], minlength=len(mine) * len(common))
            counts = counts.reshape(-1, len(common))
            far_word[mine] = distance(counts, np.array(list(common.values()), float))
            none = mine[counts.sum(axis=1) == 0]
            far_word[none] = np.where(n_words[none] > 0, 1.0, 0.0)  # no common word at all
        failed = (n_words < limits.min_words) | (100 * repeats > limits.max_repeat_percent * n_words)
        judged = n_words >= limits.distance_min_words
        allowed = limits.word_distance + limits.word_distance_root / np.sqrt(np.maximum(n_words, 1))
        odd = judged & ((far_class > limits.class_distance) | (far_word > allowed))
        columns = [
            n_words,
            classes.sum(axis=1) - classes[:, SPACE],
            classes[:, SYMBOL],
            np.array([repeated_lines(t) for t in whole], np.int64),
            repeats,
            failed,
            ~failed & ~odd,
            far_class,
            far_word,
        ]
        more = [batch.column("rest"), texts] if carry else []
        arrays = [batch.column("doc_id").cast(pa.int64()), *map(pa.array, columns), *more]
        return pa.RecordBatch.from_arrays(arrays, [*out, "text"] if carry else out)

    schema = schema + ", text string" if carry else schema
    rows = with_language(docs, carry)
    if references.others is None:
        return map_steps(rows, work, schema)
    # Only texts of the smaller languages are shuffled, and none of these has a large share of all.
    large = F.col("lang").isin([x for x in references.words if x is not POOLED])
    table = references.others.where(F.col("total") >= limits.reference_min_words)
    table = table.select("lang", F.struct("classes", "words", "counts", "total").alias("reference"))
    joined = rows.where(~large).join(table, "lang", "left")
    return map_steps(rows.where(large), work, schema).unionByName(map_steps(joined, work, schema))


SCHEMA = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "base_failed boolean, kept boolean, class_distance double, word_distance double"
)
NAMES = [part.split()[0] for part in SCHEMA.split(", ")]
