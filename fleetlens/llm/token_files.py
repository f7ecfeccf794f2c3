"""Token ids in ORC files: documents in order of their id, Bloom filters on it, offsets of the whole corpus.

ORC packs the ids with its integer run-length encoding, in stripes that tasks read in parallel. Row indexes
and Bloom filters on ``doc_id`` let a reader of few documents skip the other stripes.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fleetlens.llm.common import id_and_text, steps
from fleetlens.llm.library_tokens import library_encoder

SCHEMA = "doc_id long, part int, start_in_part long, n_tokens long, ids array<int>"


def write_token_files(docs: DataFrame, path: str, vocabulary: str, *, end_id: int = 0) -> None:
    """Encodes whole texts, appends ``end_id`` to each and writes ORC files under ``path``.

    A null text is an empty one: its row holds the end id alone. Rows are kept as they are, repeated ids too;
    equal ids stand in order of a hash of their texts, null ids come first. Other columns are not read. Texts
    are dealt by range of their id, so no task holds more than its range, and each task numbers its tokens from 0.
    """

    def encode(batches):
        encoder, part, at = library_encoder(vocabulary), TaskContext.get().partitionId(), 0
        end = np.array([end_id], "<i4").tobytes()
        for batch in steps(batches):
            ids = [x + end for x in encoder.encode(batch.column("text").to_pylist())]
            sizes = np.array([len(x) // 4 for x in ids], np.int64)
            ends = np.cumsum(sizes)
            values = pa.array(np.frombuffer(b"".join(ids), "<i4"))
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], ends)).astype(np.int32)), values)
            parts = pa.array(np.full(len(ids), part, np.int32))
            starts = pa.array(at + ends - sizes)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").cast(pa.int64()), parts, starts, pa.array(sizes), lists],
                ["doc_id", "part", "start_in_part", "n_tokens", "ids"],
            )
            at += int(ends[-1])

    tie = F.xxhash64("text")
    ordered = id_and_text(docs).repartitionByRange("doc_id", tie).sortWithinPartitions("doc_id", tie)
    writer = ordered.mapInArrow(encode, SCHEMA).write.option("compression", "zstd")
    writer.option("orc.bloom.filter.columns", "doc_id").option("orc.row.index.stride", "5000").orc(path)


def read_token_files(spark: SparkSession, path: str, doc_ids: list[int] | None = None) -> DataFrame:
    """``doc_id, start, n_tokens, ids`` from the files; with ``doc_ids`` only the stripes that can hold them are read.

    ``start`` counts the ids of all documents before. What is broadcast is one number for each task of the
    writing job, so its size is that of the list of files.
    """
    files = spark.read.schema(SCHEMA).orc(path)
    totals = files.groupBy("part").agg(F.sum("n_tokens").alias("tokens"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select("part", F.coalesce(F.sum("tokens").over(before), F.lit(0)).alias("base"))
    wanted = files if doc_ids is None else files.where(F.col("doc_id").isin([int(i) for i in doc_ids]))
    joined = wanted.join(F.broadcast(bases), "part")
    return joined.select("doc_id", (F.col("base") + F.col("start_in_part")).alias("start"), "n_tokens", "ids")


def with_checksums(tokens: DataFrame) -> DataFrame:
    """Adds ``ids_crc32`` of the ids as little-endian unsigned 32-bit numbers, in place of ``ids``."""

    def checksums(batches):
        for batch in batches:
            lists = batch.column("ids")
            bounds = lists.offsets.to_numpy()
            data = memoryview(np.ascontiguousarray(lists.values.to_numpy(zero_copy_only=False), "<i4")).cast("B")
            sums = [zlib.crc32(data[4 * a : 4 * b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
            columns = [batch.column(c) for c in ("doc_id", "start", "n_tokens")]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(sums, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"]
            )

    return tokens.mapInArrow(checksums, "doc_id long, start long, n_tokens long, ids_crc32 long")
