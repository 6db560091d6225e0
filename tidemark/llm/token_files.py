"""Token-id output: documents as Simple-8b segments in files, in ascending doc_id order.

A file is a Parquet file whose rows are segments: whole documents of together about SEGMENT_IDS ids
(one longer document is a segment by itself). A row holds the segment's place in its shard, the
documents' ids and lengths, and the Simple-8b bytes of the ids. Spark's writer commits the files, so
lost tasks are run again and leave nothing half-written. Shards are ranges of doc_id, numbered in its
order; the manifest, one row per shard, turns places in a shard into places among all ids.

Defined results: a null or empty text is just the end id; null doc_ids come first; rows of one
doc_id lie side by side, ordered by their text's hash; an empty table gives no rows; other columns
are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import simple8b
from .common import Scratch, ship, table
from .token_ids import TOKENIZER_FILE, encoder

END_ID = 2
SEGMENT_IDS = 1 << 16
_SEGMENTS = pa.schema([("shard", pa.int32()), ("segment", pa.int32()), ("start", pa.int64()), ("n_ids", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())), ("payload", pa.binary())])
_SEGMENTS_DDL = "shard int, segment int, start long, n_ids long, doc_ids array<long>, lengths array<long>, payload binary"


def segments(docs: DataFrame, tokenizer: str = TOKENIZER_FILE, end_id: int = END_ID) -> DataFrame:
    """The rows of the file format."""
    ship(docs.sparkSession)

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, shard = encoder(tokenizer).each, TaskContext.get().partitionId()
        held: list[np.ndarray] = []  # ids of whole documents that are in no segment yet
        doc_ids: list[pa.Array] = []
        lengths: list[np.ndarray] = []
        size = start = segment = 0

        def row() -> pa.RecordBatch:
            ids = pa.concat_arrays(doc_ids)
            n = np.concatenate(lengths)
            lists = [pa.ListArray.from_arrays(pa.array([0, len(n)], pa.int32()), x) for x in (ids, pa.array(n))]
            payload = pa.array([simple8b.encode(np.concatenate(held))], pa.binary())
            return pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([segment], pa.int32()), pa.array([start]), pa.array([size]), *lists, payload], schema=_SEGMENTS)

        for b in batches:
            first = 0
            for ids, ends in encode(b.column(1), end_id):
                names = b.column(0).slice(first, len(ends))
                first += len(ends)
                n = np.diff(ends, prepend=0)
                at = 0  # documents before this one are held
                while at < len(ends):
                    done = int(ends[at - 1]) if at else 0
                    to = int(np.searchsorted(ends, done + SEGMENT_IDS - size, side="right"))
                    if to <= at and size:  # the next document is too long for what is held
                        yield row()
                        start, segment, size = start + size, segment + 1, 0
                        held, doc_ids, lengths = [], [], []
                        continue
                    to = max(to, at + 1)
                    held.append(ids[done : ends[to - 1]])
                    doc_ids.append(names.slice(at, to - at))
                    lengths.append(n[at:to])
                    size += int(ends[to - 1]) - done
                    at = to
        if size:
            yield row()

    rows = docs.select(F.col("doc_id").cast("long"), "text")
    # the order needs the texts' hashes only where ids repeat, and ranges are cut without reading a text otherwise
    repeats = not rows.groupBy("doc_id").count().where("count > 1").isEmpty()
    order = ["doc_id", "tie"] if repeats else ["doc_id"]
    tied = rows.withColumn("tie", F.xxhash64("text")) if repeats else rows
    return tied.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text").mapInArrow(packed, _SEGMENTS_DDL)


def documents(files: DataFrame) -> DataFrame:
    """Each document of the files: doc_id, start, n_tokens, and ids as little-endian unsigned 32-bit numbers."""
    return _read(files, "ids")


def _read(files: DataFrame, what: str) -> DataFrame:
    ship(files.sparkSession)

    def unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                shard, start = b.column(0)[k].as_py(), b.column(1)[k].as_py()
                doc_ids, lengths = b.column(2)[k].values, b.column(3)[k].values
                ids = simple8b.decode(b.column(4)[k].as_buffer()).astype("<u4")
                n = lengths.to_numpy()
                ends = np.append(0, np.cumsum(n))
                columns = [pa.array(np.full(len(n), shard, np.int32)), doc_ids, pa.array(start + ends[:-1]), lengths]
                if what == "ids":
                    last = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(n), [None, pa.py_buffer(4 * ends.astype(np.int64)), pa.py_buffer(ids)]).cast(pa.binary())
                else:
                    data, at = memoryview(ids).cast("B"), (4 * ends).tolist()
                    last = pa.array([zlib.crc32(data[x:y]) for x, y in zip(at[:-1], at[1:], strict=True)], pa.int64())
                yield pa.RecordBatch.from_arrays([*columns, last], ["shard", "doc_id", "place", "n_tokens", what])

    # one row per shard, that is at most one per shuffle partition of the writing job
    manifest = files.groupBy("shard").agg(F.sum("n_ids").alias("total"))
    first = manifest.select("shard", (F.sum("total").over(Window.orderBy("shard")) - F.col("total")).alias("first"))
    found = files.select("shard", "start", "doc_ids", "lengths", "payload").mapInArrow(unpacked, f"shard int, doc_id long, place long, n_tokens long, {'ids binary' if what == 'ids' else 'ids_crc32 long'}")
    return found.join(F.broadcast(first), "shard").select("doc_id", (F.col("first") + F.col("place")).alias("start"), "n_tokens", what)


def digests(files: DataFrame) -> DataFrame:
    """Like `documents`, with ids_crc32 in place of the ids, which then need not leave the task that reads them."""
    return _read(files, "ids_crc32")


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "tokens")
    files = scratch.write(segments(table(spark, sf_dir, "documents")), "files")
    return digests(files).select("doc_id", "start", "n_tokens", "ids_crc32")
