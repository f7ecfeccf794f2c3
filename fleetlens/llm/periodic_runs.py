"""Periodic runs of words: stretches that repeat a block of words at least four times.

A word of a qualifying run occurs in it once per period, so at least four times. Words that occur less often within
the current segment cannot be in a run: they split it, and the rest is counted again by segment until nothing
splits. What survives is scanned lag by lag. A run of period q covers four multiples of q in a row, so lag q is
looked at only at every q-th word; three equal pairs in a row there are extended word by word to both sides. All
lags together look at m log m places of a segment of m words.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.llm.common import carried, map_steps, rest, word_offsets

Run = tuple[int, int, int]  # start, length, period
ROUNDS = 6
BLANK = pa.scalar(" ", pa.large_string())


@dataclass(frozen=True)
class Periodic:
    """A run repeats its period ``times`` times or more and has ``least`` words or more."""

    times: int = 4
    least: int = 6

    def __post_init__(self) -> None:
        if self.times < 4 or self.least < 1:
            raise ValueError("the lag scan needs runs of four periods or more")


def frequent(codes: np.ndarray, segments: np.ndarray, times: int) -> np.ndarray:
    """Which places hold a word that occurs ``times`` times or more in its segment."""
    _, place, count = np.unique(segments * (int(codes.max(initial=0)) + 1) + codes, return_inverse=True, return_counts=True)
    return count[place] >= times


def renumbered(places: np.ndarray, segments: np.ndarray) -> np.ndarray:
    """Segments of places in order: a new one where the segment changes or places between are gone."""
    new = np.ones(len(places), bool)
    new[1:] = (np.diff(places) > 1) | (np.diff(segments) != 0)
    return np.cumsum(new) - 1


def split(codes: np.ndarray, texts: np.ndarray, how: Periodic) -> list[tuple[int, int]]:
    """The segments, as (start, end) of places, that no rare word splits any more.

    Rounds over all places that are left; what still changes after some rounds is split segment by segment, where
    only the smaller parts of a segment are counted anew, so that long chains of splits stay cheap.
    """
    places, segments = np.arange(len(codes)), texts
    settled: list[tuple[int, int]] = []
    for _ in range(ROUNDS):
        keep = frequent(codes[places], segments, how.times)
        broken = np.zeros(int(segments.max(initial=-1)) + 1, bool)
        broken[segments[~keep]] = True
        whole = ~broken[segments]  # nothing splits these any more
        settled += bounds(places[whole], segments[whole])
        left = keep & ~whole
        places, segments = places[left], renumbered(places[left], segments[left])
        long = np.bincount(segments, minlength=1) >= how.least
        places, segments = places[long[segments]], segments[long[segments]]
        if not len(places):
            break
    for start, end in bounds(places, segments):
        settled += worked_off(codes, start, end, how)
    return sorted((a, b) for a, b in settled if b - a >= how.least)


def bounds(places: np.ndarray, segments: np.ndarray) -> list[tuple[int, int]]:
    if not len(places):
        return []
    first = np.flatnonzero(np.concatenate(([True], np.diff(segments) != 0)))
    last = np.concatenate((first[1:], [len(places)])) - 1
    return list(zip(places[first].tolist(), (places[last] + 1).tolist(), strict=True))


def worked_off(codes: np.ndarray, start: int, end: int, how: Periodic) -> list[tuple[int, int]]:
    """``split`` of one segment from a list of parts with counts; the largest part keeps the counts of the whole."""

    def counts_of(a: int, b: int) -> dict[int, int]:
        values, numbers = np.unique(codes[a:b], return_counts=True)
        return dict(zip(values.tolist(), numbers.tolist(), strict=True))

    def rare_in(counts: dict[int, int]) -> set[int]:
        return {word for word, n in counts.items() if n < how.times}

    found = []
    open_parts = [(start, end, counts := counts_of(start, end), rare_in(counts))]
    where: dict[int, list[int]] = {}
    for place, word in enumerate(codes[start:end].tolist(), start):
        where.setdefault(word, []).append(place)
    from bisect import bisect_left

    while open_parts:
        a, b, counts, rare = open_parts.pop()
        if b - a < how.least:
            continue
        cuts = []
        for word in rare:
            at = where[word]
            cuts += at[bisect_left(at, a) : bisect_left(at, b)]
        if not cuts:
            found.append((a, b))
            continue
        edges = [a - 1, *sorted(cuts), b]
        parts = [(x + 1, y) for x, y in zip(edges, edges[1:], strict=False) if y > x + 1]
        if not parts:
            continue
        main = max(parts, key=lambda part: part[1] - part[0])
        touched = set()
        for x, y in parts:
            if (x, y) != main:
                own = counts_of(x, y)
                open_parts.append((x, y, own, rare_in(own)))
                for word, n in own.items():
                    counts[word] -= n
                    touched.add(word)
        for word in rare:
            counts.pop(word, None)
        open_parts.append((*main, counts, {w for w in touched if 0 < counts.get(w, 0) < how.times}))
    return found


class Scan:
    """The runs in segments of words, each found once, under its smallest period."""

    def __init__(self, codes: np.ndarray, segments: list[tuple[int, int]], how: Periodic) -> None:
        self.how = how
        order = sorted(segments, key=lambda s: (s[0] - s[1], s[0]))  # longest first: long lags need a part in front
        sizes = np.array([b - a for a, b in order], np.int64)
        self.at = np.concatenate(([0], np.cumsum(sizes + 1)))
        self.origin = np.array([a for a, _ in order], np.int64)
        self.words = np.empty(int(self.at[-1]), np.int64)
        for i, (a, b) in enumerate(order):
            self.words[self.at[i] : self.at[i + 1] - 1] = codes[a:b]
            self.words[self.at[i + 1] - 1] = -1 - i  # equal to nothing
        self.sizes = sizes
        self.owner = np.full(len(self.words), -1, np.int64)  # the longest run known at a place
        self.found: list[Run] = []

    def runs(self) -> list[Run]:
        """All runs as (start, length, period), with the places of the whole text."""
        longest = int(self.sizes.max(initial=0))
        for lag in range(1, longest // self.how.times + 1):
            many = int(np.searchsorted(-self.sizes, -max(self.how.least, self.how.times * lag), side="right"))
            self.scan(lag, int(self.at[many]))
        result = []
        for start, length, period in self.found:
            i = int(np.searchsorted(self.at, start, side="right")) - 1
            result.append((int(self.origin[i]) + start - int(self.at[i]), length, period))
        return sorted(result, key=lambda run: (run[0], run[2]))

    def scan(self, lag: int, end: int) -> None:
        sampled = self.words[:end:lag]
        equal = sampled[1:] == sampled[:-1]
        if len(equal) < 3:
            return
        three = equal[:-2] & equal[1:-1] & equal[2:]
        if not three.any():
            return
        places = np.flatnonzero(three) * lag
        at = 0
        while at < len(places):
            place = int(places[at])
            until = self.known(place, lag) or self.extend(place, lag)  # where this stretch of equal pairs ends
            at = int(np.searchsorted(places, until)) if until > place + lag else at + 1

    def known(self, place: int, lag: int) -> int:
        """Where the pairs end that a run found before covers, if its period divides the lag and it has these three."""
        for near in (place, place + lag, place + 2 * lag):
            own = self.owner[near]
            if own >= 0:
                start, length, period = self.found[own]
                if lag % period == 0 and start <= place and place + 3 * lag < start + length:
                    return start + length - lag
        return 0

    def extend(self, place: int, lag: int) -> int:
        """The end of the stretch of equal pairs around a place; it is noted as a run if it is long enough."""
        words = self.words
        right, step = place, 16
        while True:  # the first place from here on that differs from the one a lag later
            top = min(right + step, len(words) - lag)
            differs = words[right:top] != words[right + lag : top + lag]
            if differs.any():
                right += int(differs.argmax())
                break
            right = top
            if right == len(words) - lag:
                break
            step *= 2
        left, step = place, 16
        while left > 0:
            low = max(0, left - step)
            differs = words[low:left] != words[low + lag : left + lag]
            if differs.any():
                left -= int(differs[::-1].argmax())
                break
            left = low
            step *= 2
        length = right + lag - left
        if length < max(self.how.least, self.how.times * lag):
            return right
        if any(run[:2] == (left, length) for run in {self.found[k] for k in np.unique(self.owner[[left, place, right]]) if k >= 0}):
            return right  # the same stretch under a smaller period
        self.found.append((left, length, lag))
        number = len(self.found) - 1
        own = self.owner[left : left + length]
        for k in np.unique(own).tolist():
            if k < 0 or self.found[k][1] < length:
                own[own == k] = number
        return right


def runs_of(codes: np.ndarray, texts: np.ndarray, how: Periodic = Periodic()) -> list[Run]:
    """The runs of all texts of a batch: ``codes`` are numbers of words, ``texts`` the number of each word's text."""
    segments = split(codes, texts, how)
    return Scan(codes, segments, how).runs() if segments else []


RUN = "struct<start:bigint,length:bigint,period:bigint>"


def found(docs: DataFrame, how: Periodic = Periodic(), *, carry: bool = False) -> DataFrame:
    """``doc_id, n_words, runs, collapsed`` of each whole text, read as words ``[^\\x20\\x09-\\x0D]+``.

    ``runs`` holds each maximal stretch of words with smallest period q and length ``max(least, times * q)`` or more
    as ``start, length, period`` (numbers of words, from 0), ordered by start, then period. ``collapsed`` has the words
    that are in no run after its first period, joined by one space. A null or empty text has no words, no runs and an
    empty ``collapsed``. Rows are kept as they are, with repeated and null ids; an empty table gives no rows; other
    columns are not read, unless ``carry`` asks for them as ``rest``. Texts are handled one by one, without a
    shuffle, in time that grows little faster than their length.
    """
    names, schema = carried(
        docs, ["doc_id", "n_words", "runs", "collapsed"], f"doc_id long, n_words long, runs array<{RUN}>, collapsed string", carry
    )

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        words, starts = word_offsets(batch.column("text"))
        sizes = np.diff(starts)
        coded = words.dictionary_encode()
        codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        texts = np.repeat(np.arange(len(sizes)), sizes)
        runs = np.array(runs_of(codes, texts, how), np.int64).reshape(-1, 3)
        kept = np.ones(len(codes), bool)
        for start, length, period in runs.tolist():
            kept[start + period : start + length] = False
        owner = texts[runs[:, 0]] if len(runs) else np.zeros(0, np.int64)
        bounds = np.concatenate(([0], np.cumsum(np.bincount(owner, minlength=len(sizes)))))
        fields = [pa.array(runs[:, 0] - starts[owner]), pa.array(runs[:, 1]), pa.array(runs[:, 2])]
        lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.StructArray.from_arrays(fields, ["start", "length", "period"]))
        left = np.concatenate(([0], np.cumsum(kept)))[starts]
        joined = pc.binary_join(pa.LargeListArray.from_arrays(pa.array(left, pa.int64()), words.filter(pa.array(kept))), BLANK)
        more = [batch.column("rest")] if carry else []
        columns = [batch.column("doc_id").cast(pa.int64()), pa.array(sizes, pa.int64()), lists, joined.cast(pa.string()), *more]
        return pa.RecordBatch.from_arrays(columns, names)

    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), *rest(docs, carry))
    return map_steps(rows, work, schema)


def planted(docs: DataFrame) -> DataFrame:
    """``doc_id, text`` with a periodic end in the texts of a tenth of the ids, as the contract of the query states it.

    With h the crc32 of the id's digits, g = floor(h / 10) and n words: where h % 10 = 0 and n > 0, word i of the
    words from a = g % n on becomes word a + (i - a) % p, p = 1 + floor((n - a) / (3 + g % 8)). Texts without an id stay.
    """
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.filter(F.split("text", "[\\x20\\x09-\\x0D]+"), lambda w: w != "")
    chosen = docs.select("doc_id", "text", F.when(h % 10 == 0, F.floor(h / 10)).alias("g"))
    chosen = chosen.withColumn("words", F.when(F.col("g").isNotNull(), words)).withColumn("n", F.size("words"))
    chosen = chosen.withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")).cast("int"))
    period = (1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8))).cast("int")
    chosen = chosen.withColumn("p", period)
    tail = F.transform(
        F.sequence(F.lit(0), F.col("n") - F.col("a") - 1), lambda k: F.get("words", F.col("a") + k % F.col("p"))
    )
    whole = F.array_join(F.concat(F.slice("words", F.lit(1), F.col("a")), tail), " ")
    return chosen.select("doc_id", F.when(F.col("a").isNotNull(), whole).otherwise(F.col("text")).alias("text"))


def digests(rows: DataFrame) -> DataFrame:
    """``doc_id, n_runs``, the run of greatest exponent, and digests of all runs and of the collapsed text."""

    def better(best: Column, run: Column) -> Column:
        left, right = run["length"] * best["period"], best["length"] * run["period"]
        return F.when(best.isNull() | (left > right), run).otherwise(best)  # ties: the earlier in order of start, period

    best = F.aggregate("runs", F.lit(None).cast(RUN), better).alias("best")
    line = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    every = F.array_join(F.transform(line, lambda x: F.concat(x, F.lit("\n"))), "")
    found = rows.select("doc_id", "runs", "collapsed", best)
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        F.col("best.start").alias("start"),
        F.col("best.length").alias("length"),
        F.col("best.period").alias("period"),
        F.floor(F.lit(1000) * F.col("best.length") / F.col("best.period")).cast("long").alias("exponent_milli"),
        F.sha2(every, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
