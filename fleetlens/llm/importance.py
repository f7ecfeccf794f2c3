"""Importance resampling: which documents read like the target, sampled without replacement.

Two generative models count hashed n-grams (words and pairs of words): one over the target's texts, one over
all texts. A document's log weight is the log ratio of both models over its n-grams. Gumbel noise added to the
log weights turns the k largest into a sample without replacement in proportion to the weights.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.llm.common import hashed_words, joined_hash, map_steps, mixed, steps, stored


@dataclass(frozen=True)
class Sampling:
    """``target_rows`` bounds the labelled rows the target model is fitted on (those with the smallest hash of their id).

    ``effective`` tempers the weights: the ratio of a longer text counts as that of so many n-grams, as the
    n-grams of one text are not independent. ``share`` of all documents is sampled; None takes the share of
    the target among the labelled rows.
    """

    buckets: int = 10_000
    target_rows: int = 20_000
    effective: float = 64.0
    smoothing: float = 1.0
    share: float | None = None
    seed: int = 7


def gram_buckets(texts: pa.Array, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of each word and each pair of neighbouring words, with the text it is from."""
    words, starts = hashed_words(texts)
    owner = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    pairs = joined_hash(words[:-1], words[1:])[owner[:-1] == owner[1:]] if len(words) > 1 else words[:0]
    pair_owner = owner[:-1][owner[:-1] == owner[1:]] if len(words) > 1 else owner[:0]
    grams = np.concatenate([mixed(words), pairs]) % np.uint64(buckets)
    return grams.astype(np.int64), np.concatenate([owner, pair_owner])


def gram_models(docs: DataFrame, target: DataFrame, sampling: Sampling) -> tuple[np.ndarray, np.ndarray]:
    """Counts of each bucket in the target's texts and in all texts: one pass, ``buckets`` rows from each task."""
    ids = target.select(F.col("doc_id").alias("target_id")).distinct()
    ids = ids.orderBy(F.xxhash64("target_id", F.lit(sampling.seed)), "target_id").limit(sampling.target_rows)
    # The broadcast side holds at most target_rows numbers.
    marked = plain(docs).join(F.broadcast(ids), F.col("doc_id") == F.col("target_id"), "left")
    marked = marked.select("text", F.col("target_id").isNotNull().alias("wanted"))

    def count(batches):
        counts = np.zeros((2, sampling.buckets), np.int64)
        for batch in steps(batches):
            grams, owner = gram_buckets(batch.column("text"), sampling.buckets)
            wanted = batch.column("wanted").to_numpy(zero_copy_only=False).astype(bool)
            counts[0] += np.bincount(grams[wanted[owner]], minlength=sampling.buckets)
            counts[1] += np.bincount(grams, minlength=sampling.buckets)
        columns = [np.arange(sampling.buckets), counts[0], counts[1]]
        yield pa.RecordBatch.from_arrays([*map(pa.array, columns)], ["bucket", "target", "raw"])

    parts = marked.mapInArrow(count, "bucket long, target long, raw long")
    found = np.zeros((2, sampling.buckets), np.int64)
    for row in parts.groupBy("bucket").agg(F.sum("target").alias("target"), F.sum("raw").alias("raw")).collect():
        found[:, row["bucket"]] = row["target"], row["raw"]
    return found[0], found[1]


def plain(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))


def log_ratios(target: np.ndarray, raw: np.ndarray, smoothing: float) -> np.ndarray:
    """Log ratio of both models in each bucket; all 0 if the target has no text."""
    if not target.sum():
        return np.zeros(len(raw))
    p = (target + smoothing) / (target.sum() + smoothing * len(target))
    q = (raw + smoothing) / (raw.sum() + smoothing * len(raw))
    return np.log(p) - np.log(q)


def weighed(docs: DataFrame, ratios: np.ndarray, sampling: Sampling) -> DataFrame:
    """``doc_id, log_weight, sample_key`` and ``place``, a number in the order of the keys."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        grams, owner = gram_buckets(batch.column("text"), sampling.buckets)
        rows = batch.num_rows
        sums, sizes = np.bincount(owner, weights=ratios[grams], minlength=rows), np.bincount(owner, minlength=rows)
        weights = sums * np.minimum(1.0, sampling.effective / np.maximum(sizes, 1))
        ids = batch.column("doc_id").fill_null(-1).to_numpy(zero_copy_only=False).astype(np.uint64)
        noise = mixed(mixed(ids + np.uint64(sampling.seed)) ^ np.uint64(0x5851F42D4C957F2D))
        uniform = (noise >> np.uint64(11)).astype(float) / 2.0**53 + 2.0**-54
        keys = weights - np.log(-np.log(uniform)) + 0.0
        bits = keys.view(np.int64)
        place = np.where(bits >= 0, bits, bits ^ np.int64(0x7FFFFFFFFFFFFFFF))
        columns = [batch.column("doc_id").cast(pa.int64()), *map(pa.array, (weights, keys, place))]
        return pa.RecordBatch.from_arrays(columns, ["doc_id", "log_weight", "sample_key", "place"])

    return map_steps(plain(docs), work, "doc_id long, log_weight double, sample_key double, place long")


def kth_largest(df: DataFrame, column: str, k: int) -> int | None:
    """The k-th largest value of a long column (None if there are fewer), by counting 16 bits at a time.

    Each of the four passes is one aggregate of at most 65,536 groups.
    """
    prefix = None
    for shift in (48, 32, 16, 0):
        part = F.shiftright(column, shift)
        rows = df if prefix is None else df.where(F.shiftright(column, shift + 16) == prefix)
        counts = rows.groupBy(part.alias("part")).count().collect()
        for row in sorted(counts, key=lambda r: -r["part"]):
            if k <= row["count"]:
                prefix = row["part"]
                break
            k -= row["count"]
        else:
            return None
    return prefix


def sampled(docs: DataFrame, labels: DataFrame, sampling: Sampling = Sampling()) -> DataFrame:
    """One row per document: ``doc_id, log_weight, sample_key, kept``.

    ``labels`` (doc_id, quality) names the target by ``quality = 1``. A null or empty text has weight 0. Rows with
    equal ids and texts have equal keys; keys equal to the k-th are all kept. Without target rows all weights are 0,
    without labels all documents are kept. Null ids share one draw of noise; other columns are not read.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull())
    target = known.where(F.col("quality") == 1)
    share = sampling.share
    if share is None:
        n, hits = known.agg(F.count("*"), F.count(F.when(F.col("quality") == 1, 1))).first()
        share = hits / n if n else 1.0
    ratios = log_ratios(*gram_models(docs, target, sampling), sampling.smoothing)
    scored = stored(weighed(docs, ratios, sampling), "weights")
    k = round(share * scored.count())
    least = kth_largest(scored, "place", k) if k else None
    kept = F.lit(False) if not k else F.lit(True) if least is None else F.col("place") >= least
    return scored.select("doc_id", "log_weight", "sample_key", kept.alias("kept"))
