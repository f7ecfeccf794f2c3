"""What the operators share: reading text columns in Python tasks, the shared folder, whitespace words."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlens.llm.chunks import forget_chunks

# Text that one step of a task holds at a time, in bytes; a longer single text is a step of its own.
STEP_BYTES = 4_000_000


@lru_cache(maxsize=1)
def own_folder() -> str:
    return tempfile.mkdtemp(prefix="fleetlens-llm-")


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``.

    Where it is unset, a folder of this process in local mode; on a cluster, whose executors could not read that, an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return folder or own_folder()


def work_path(spark: SparkSession, name: str) -> str:
    """A new path for an intermediate table, in a folder per application that may go when the job is over."""
    return f"{shared_folder(spark)}/llm-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes a frame to the shared folder and reads it back: lost executors repeat nothing before it."""
    path = work_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def id_and_text(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``text`` alone, a null text as an empty one."""
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))


def rest(docs: DataFrame, carry: bool) -> list[Column]:
    """With ``carry``, all columns but the text as one struct ``rest``, so that no name can clash."""
    return [F.struct(*[c for c in docs.columns if c != "text"]).alias("rest")] if carry else []


def carried(docs: DataFrame, names: list[str], schema: str, carry: bool) -> tuple[list[str], str]:
    """Names and schema of a result, with ``rest`` after its own columns where it is carried."""
    if not carry:
        return names, schema
    return [*names, "rest"], f"{schema}, rest {docs.select(*rest(docs, True)).schema['rest'].dataType.simpleString()}"


def as_documents(rows: DataFrame, docs: DataFrame, text: str) -> DataFrame:
    """The columns of ``docs`` again from a result that carried them, with the text (and its length) in ``text``."""
    changed = {"text": F.col(text), "n_chars": F.length(text).cast("long")}
    return rows.select(*[changed.get(c, F.col("rest").getField(c)).alias(c) for c in docs.columns])


def steps(batches: Iterator[pa.RecordBatch], limit: int = STEP_BYTES, column: str = "text") -> Iterator[pa.RecordBatch]:
    """Cuts Arrow batches into slices of about ``limit`` bytes of text."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        at, n = 0, batch.num_rows
        total = np.cumsum(sizes)
        while at < n:
            base = total[at - 1] if at else 0
            end = max(at + 1, int(np.searchsorted(total, base + limit, side="right")))
            yield batch.slice(at, end - at)
            at = end


def map_steps(
    df: DataFrame,
    work: Callable[[pa.RecordBatch], pa.RecordBatch],
    schema: str,
    limit: int = STEP_BYTES,
    *,
    caches: bool = False,
) -> DataFrame:
    """``mapInArrow`` over slices of bounded text. Without ``caches``, a worker first forgets what encoders left in it."""

    def run(batches):
        if not caches:
            forget_chunks()
        for part in steps(batches, limit):
            yield work(part)

    return df.mapInArrow(run, schema)


def word_offsets(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words ``[^\\x20\\x09-\\x0D]+`` of the texts in order, and where each text's words begin in them."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    lists = pc.ascii_split_whitespace(texts)
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.combine_chunks()
    flat, bounds = lists.flatten(), lists.offsets.to_numpy()
    bounds = bounds - bounds[0]
    full = pc.greater(pc.binary_length(flat), 0)
    kept = np.concatenate(([0], np.cumsum(full.to_numpy(zero_copy_only=False).astype(np.int64))))
    return flat.filter(full), kept[bounds]


def mixed(h: np.ndarray) -> np.ndarray:
    """Spreads the bits of 64-bit numbers (the finaliser of a public hash; fixed multipliers)."""
    h = h.astype(np.uint64, copy=True)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


def joined_hash(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Hash of two sequences one after the other, from the hashes of both."""
    return mixed(left * np.uint64(0x9E3779B97F4A7C15) + (right ^ (right >> np.uint64(29))))


def run_hashes(words: np.ndarray, length: int) -> np.ndarray:
    """Hashes of every ``length`` consecutive words, by doubling; equal runs have equal hashes."""
    n = len(words) - length + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    hashes, size = words, 1
    while 2 * size <= length:
        hashes = joined_hash(hashes[:-size], hashes[size:])
        size *= 2
    return hashes if size == length else joined_hash(hashes[:n], hashes[length - size : length - size + n])


def hashed_words(texts: pa.Array, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of the texts, each distinct word hashed once, and where each text's begin.

    ``lower`` turns A to Z into lower case first, and no other letter.
    """
    import xxhash

    flat, starts = word_offsets(texts)
    coded = flat.dictionary_encode()
    names = coded.dictionary.to_pylist()
    if lower:
        table = {c: c + 32 for c in range(0x41, 0x5B)}
        names = [w.lower() if w.isascii() else w.translate(table) for w in names]
    digest = xxhash.xxh3_64_intdigest
    hashes = np.array([digest(w.encode("utf-8", "surrogatepass")) for w in names], np.uint64)
    codes = coded.indices.to_numpy(zero_copy_only=False)
    return (hashes[codes] if len(codes) else np.zeros(0, np.uint64)), starts
