"""Personal data in texts: strict patterns, and what boosted trees find beyond them.

Generators of high recall propose spans that may overlap: anything that looks a little like an address or a
number of one of the kinds. Boosted trees rate a span by its format and its surroundings. They learn from the
spans that the strict patterns confirm, also rewritten the ways people write them (without the plus, with other
separators, with "at" and "dot" spelled out), against the proposals that no strict pattern touches, save those
that may well be such spans (``unsure``). A threshold per kind is calibrated on held-out spans; spans above it join those of the strict patterns, which always stay.
"""

from __future__ import annotations

import hashlib
import random
import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fleetlens.llm import boosting
from fleetlens.llm.common import carried, id_and_text, map_steps, rest

KINDS = ("email", "ip", "card", "phone")
Span = tuple[str, int, int]

# The strict patterns; each is written so that it takes time in proportion to the text. Fixed by the contract.
LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
DOTTED = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
CHAIN = re.compile(r"[0-9](?:[ -]?[0-9])+")
PLUS = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")
NOT_DIGIT = re.compile(r"[^0-9]")

# Generators: spelled-out addresses, and runs of digits with anything that may separate them.
SPELLED = re.compile(
    r"[\[(<]?(?:@|(?<![A-Za-z0-9])(?:at|AT)(?![A-Za-z0-9]))[\])>]? ?[A-Za-z0-9-]{1,63}"
    r"(?:(?: ?[\[(<](?:dot|DOT|\.)[\])>] ?| (?:dot|DOT) |\.)[A-Za-z0-9-]{1,63}){1,5}"
)
BEFORE_AT = re.compile(r"[A-Za-z0-9._%+-]{1,64} ?\Z")
RUN = re.compile(r"[+(]?[0-9](?:[ ().\[\]/_-]{0,3}[0-9])+")
HINTS = {
    "email": ("mail", "contact", "write", "@"),
    "ip": ("ip", "host", "server", "addr"),
    "card": ("card", "visa", "credit", "pay"),
    "phone": ("phone", "tel", "call", "fax", "mobile"),
}
# Words that name a kind when they stand alone, and signs of an address written out.
NAMED = {
    "ip": re.compile(r"(?i)\b(?:ip|ipv4|host|address)\b"),
    "card": re.compile(r"(?i)\b(?:card|visa|mastercard|credit)\b"),
    "phone": re.compile(r"(?i)\b(?:phone|tel|telephone|call|fax|mobile)\b"),
}
BRACKETS = re.compile(r"[\[(<](?:at|AT|@|dot|DOT|\.)[\])>]")
AGAINST = ("password", "token", "key", "sha", "isbn", "order", "id", "http", "version")
RATED_AT_ONCE = 20_000  # candidates of a kind whose features are held at a time
SIDES = {" ": 1, "\n": 1, "\t": 1, "": 1, ",": 2, ".": 2, ";": 2, ":": 3, "=": 4, '"': 5, "'": 5, "(": 6, ")": 6}


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 3 or (len(part) == 3 and part <= "255")


def base_spans(text: str) -> list[Span]:
    """Matches of the strict patterns by kind, then start."""
    found: list[Span] = []
    end = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > end and LOCAL.match(text[start - 1]):
            start -= 1
        match = DOMAIN.match(text, at + 1) if start < at else None
        if match:
            end = match.end()
            found.append(("email", start, end))
        at = text.find("@", max(at + 1, end))
    if not DIGIT.search(text):
        return found
    for match in DOTTED.finditer(text):
        if all(map(small, match.groups())):
            found.append(("ip", *match.span()))
    for match in CHAIN.finditer(text):
        if 16 <= match.end() - match.start() <= 37:
            digits = NOT_DIGIT.sub("", match[0])
            if 16 <= len(digits) <= 19 and luhn(digits):
                found.append(("card", *match.span()))
    for match in PLUS.finditer(text):
        if 8 <= len(NOT_DIGIT.sub("", match[0])) <= 15:
            found.append(("phone", *match.span()))
    return found


def candidates(text: str) -> Iterator[Span]:
    """Spans that may be of a kind; one place can be proposed for several kinds."""
    for match in SPELLED.finditer(text):
        at = match.start()
        local = BEFORE_AT.search(text[max(0, at - 65) : at])
        if local:
            yield ("email", at - len(local[0]), match.end())
    if DIGIT.search(text):
        for match in RUN.finditer(text):
            length = match.end() - match.start()
            if not 7 <= length <= 60:
                continue
            n = len(NOT_DIGIT.sub("", match[0]))
            if n < length <= 21 and 4 <= n <= 12:
                yield ("ip", *match.span())
            if 13 <= n <= 19:
                yield ("card", *match.span())
            if 7 <= n <= 15:
                yield ("phone", *match.span())


class Cover:
    """Places taken by spans; those that overlap or touch are one, so that a question is one binary search."""

    def __init__(self, spans: list[Span]) -> None:
        self.starts: list[int] = []
        self.ends: list[int] = []
        for _, start, end in sorted(spans, key=lambda s: s[1]):
            if self.ends and start <= self.ends[-1]:
                self.ends[-1] = max(self.ends[-1], end)
            else:
                self.starts.append(start)
                self.ends.append(end)

    def overlaps(self, start: int, end: int) -> bool:
        at = bisect_left(self.starts, end) - 1
        return at >= 0 and self.ends[at] > start

    def add(self, start: int, end: int) -> None:
        """Takes a place that overlaps none before."""
        at = bisect_left(self.starts, start)
        self.starts.insert(at, start)
        self.ends.insert(at, end)


def features(kind: str, span: str, before: str, after: str) -> list[float]:
    """Numbers about the format of a span and the characters around it."""
    digits = NOT_DIGIT.sub("", span)
    groups = re.findall(r"[0-9]+", span) or [""]
    sizes = [len(g) for g in groups]
    words = before.lower()
    letter = sum(c.isalpha() for c in span)
    return [
        len(span), len(digits), letter, len(groups), sizes[0], sizes[-1], max(sizes), min(sizes),
        span.count(" "), span.count("-"), span.count("."), span.count("(") + span.count("["),
        span.count("/") + span.count("_"), float(span[:1] == "+"), float(span[:2] in ("00", "(0")),
        float(luhn(digits)) if digits else 0.0, float(len(groups) == 4 and all(map(small, groups))),
        float(digits[:1] or 0), float(len(set(digits))), float(len(set(sizes))),
        float(before[-1:].isalnum()), float(after[:1].isalnum()), SIDES.get(before[-1:], 0), SIDES.get(after[:1], 0),
        float(any(h in words for h in HINTS[kind])), float(any(h in words for h in AGAINST)),
        sum(c.isdigit() for c in before[-8:]), sum(c.isdigit() for c in after[:8]),
        float(" at " in span or "at]" in span or "at)" in span or "@" in span), float("dot" in span.lower()),
    ]


def rewritten(kind: str, span: str, draw: random.Random) -> str:
    """A confirmed span in another way of writing."""
    digits = NOT_DIGIT.sub("", span)
    if kind == "email":
        at, dot = draw.choice(((" at ", " dot "), (" [at] ", " [dot] "), (" (at) ", " dot "), ("[at]", ".")))
        local, domain = span.split("@", 1)
        return local + at + domain.replace(".", dot)
    if kind == "ip":
        return draw.choice(("[.]", " . ", "(.)")).join(span.split("."))
    if kind == "card":
        step = draw.choice(("-", " ", ".", "  ", "_"))
        return step.join(digits[i : i + 4] for i in range(0, len(digits), 4))
    rest = digits[1:] if len(digits) > 10 else digits
    style = draw.choice(("({}) {}-{}", "{}-{}-{}", "{}.{}.{}", "{} {} {}"))
    return draw.choice(("", "00" + digits[:1] + " ")) + style.format(rest[:3], rest[3:6], rest[6:])


def unsure(kind: str, span: str, before: str) -> bool:
    """Whether a proposal may well be of its kind, written in another way; it is then no example of either label.

    So is an address with "at" or "dot" in brackets or " dot " spelled out, and a number shortly after a word that
    names its kind. Trees that learned these as wrong would reject the very spans they are to find.
    """
    if kind == "email":
        return BRACKETS.search(span) is not None or " dot " in span.lower()
    return NAMED[kind].search(before) is not None


@dataclass(frozen=True)
class Training:
    """Bounds of the sample the trees learn from, and what they have to reach.

    ``documents`` is the number of texts, ``per_document`` that of spans taken from one text, ``spans`` that of each
    kind and label, those with the smallest hashes. ``precision`` is the share of right spans that a threshold has to
    reach on the held-out quarter of the texts.
    """

    documents: int = 40_000
    per_document: int = 50
    spans: int = 20_000
    precision: float = 0.98
    seed: int = 11


@dataclass(frozen=True)
class Rater:
    trees: dict[str, boosting.Trees]
    thresholds: dict[str, float]

    def added(self, text: str, base: list[Span]) -> list[Span]:
        """Candidates above their threshold that overlap no strict span and no better candidate."""
        taken, found = Cover(base), []
        waiting: dict[str, list[Span]] = {kind: [] for kind in self.trees}

        def rate(kind: str) -> None:
            mine = waiting[kind]
            rows = np.array([features(k, text[a:b], text[max(0, a - 32) : a], text[b : b + 8]) for k, a, b in mine])
            scores = self.trees[kind].scores(rows).tolist()
            found.extend((s, *span) for s, span in zip(scores, mine, strict=True) if s >= self.thresholds[kind])
            mine.clear()

        for span in candidates(text):
            kind = span[0]
            if kind in waiting and not taken.overlaps(span[1], span[2]):
                waiting[kind].append(span)
                if len(waiting[kind]) == RATED_AT_ONCE:
                    rate(kind)
        for kind, mine in waiting.items():
            if mine:
                rate(kind)
        chosen, places = [], Cover([])
        for _, kind, start, end in sorted(found, key=lambda x: (-x[0], KINDS.index(x[1]), x[2])):
            if not places.overlaps(start, end):
                places.add(start, end)
                chosen.append((kind, start, end))
        return chosen


def training_rows(docs: DataFrame, training: Training) -> DataFrame:
    """``kind, features, label, held`` of spans of a bounded sample of documents, chosen by a hash of their id."""
    total = docs.count()
    parts = 1_000_000
    share = min(parts, int(parts * training.documents / max(total, 1)))
    chosen = id_and_text(docs).where(F.pmod(F.xxhash64("doc_id", F.lit(training.seed)), F.lit(parts)) < share)

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
            base = base_spans(text)
            draw = random.Random(f"{training.seed}:{doc_id}")
            spans, taken = [(k, a, b, True) for k, a, b in base], Cover(base)
            for kind, a, b in candidates(text):
                if not taken.overlaps(a, b) and not unsure(kind, text[a:b], text[max(0, a - 32) : a]):
                    spans.append((kind, a, b, False))
            draw.shuffle(spans)
            held = draw.random() < 0.25
            for kind, a, b, label in spans[: training.per_document]:
                around = text[max(0, a - 32) : a], text[b : b + 8]
                rows.append((kind, features(kind, text[a:b], *around), label, held))
                if label:
                    rows.append((kind, features(kind, rewritten(kind, text[a:b], draw), *around), True, held))
        columns = list(zip(*rows, strict=True)) or [[], [], [], []]
        kinds = (pa.string(), pa.list_(pa.float64()), pa.bool_(), pa.bool_())
        arrays = [pa.array(list(c), t) for c, t in zip(columns, kinds, strict=True)]
        return pa.RecordBatch.from_arrays(arrays, ["kind", "features", "label", "held"])

    rows = map_steps(chosen, work, "kind string, features array<double>, label boolean, held boolean")
    first = Window.partitionBy("kind", "label").orderBy(F.xxhash64("features", F.lit(training.seed)), "features", "held")
    return rows.withColumn("place", F.row_number().over(first)).where(F.col("place") <= training.spans).drop("place")


def trained(docs: DataFrame, training: Training = Training()) -> Rater:
    """Trees and thresholds by kind; a kind with too few examples of either label has none and adds no spans."""
    rows = training_rows(docs, training).toArrow()
    if not rows.num_rows:
        return Rater({}, {})
    every = np.array(rows.column("features").combine_chunks().flatten()).reshape(rows.num_rows, -1)
    kinds, marks, sides = (np.array(rows.column(c).to_pylist()) for c in ("kind", "label", "held"))
    trees, thresholds = {}, {}
    for kind in KINDS:
        mine = np.flatnonzero(kinds == kind)
        if not len(mine):
            continue
        order = np.lexsort((sides[mine], marks[mine], *every[mine].T))  # the same on any partitioning
        table, labels, held = every[mine][order], marks[mine][order].astype(bool), sides[mine][order].astype(bool)
        if min(labels[~held].sum(), (~labels[~held]).sum(), held.sum()) < 20:
            continue
        model = boosting.fit(table[~held], labels[~held])
        limit = boosting.threshold(model.scores(table[held]), labels[held], training.precision)
        if np.isfinite(limit):
            trees[kind], thresholds[kind] = model, max(limit, 0.5)
    return Rater(trees, thresholds)


def written(spans: list[Span]) -> str:
    ordered = sorted(spans, key=lambda s: (KINDS.index(s[0]), s[1]))
    return ",".join(f"{kind}:{start}:{end}" for kind, start, end in ordered)


def redacted(text: str, spans: list[Span]) -> str:
    """The text with a label in place of each span; spans that overlap become one."""
    parts, at = [], 0
    for kind, start, end in sorted(spans, key=lambda s: (s[1], -s[2])):
        if start >= at:
            parts += [text[at:start], f"[{kind.upper()}]"]
        at = max(at, end)
    return "".join([*parts, text[at:]])


def found(docs: DataFrame, rater: Rater, *, carry: bool = False) -> DataFrame:
    """One row per document: counts of strict spans, ``base_sha256``, ``spans`` of both sources and the redacted text.

    A null text is an empty one and has no spans. Rows are kept as they are, with repeated and null ids; an empty
    table gives no rows; other columns are not read, unless ``carry`` asks for them as ``rest``. Texts are handled
    one by one, without a shuffle.
    """
    names, schema = carried(docs, NAMES, SCHEMA, carry)

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for text in batch.column("text").to_pylist():
            base = base_spans(text)
            more = rater.added(text, base) if rater.trees else []
            counts = [sum(s[0] == kind for s in base) for kind in KINDS]
            digest = hashlib.sha256(written(base).encode()).hexdigest()
            every = base + more
            rows.append((*counts, digest, written(every), len(more), redacted(text, every) if every else text))
        columns = list(zip(*rows, strict=True)) or [[]] * 8
        kinds = (*[pa.int64()] * 4, pa.string(), pa.string(), pa.int64(), pa.string())
        arrays = [pa.array(list(c), t) for c, t in zip(columns, kinds, strict=True)]
        more = [batch.column("rest")] if carry else []
        return pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), *arrays, *more], names)

    return map_steps(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), *rest(docs, carry)), work, schema)


SCHEMA = (
    "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, "
    "n_added long, redacted string"
)
NAMES = [part.split()[0] for part in SCHEMA.split(", ")]
