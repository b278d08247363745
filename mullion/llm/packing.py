"""Packing by power-of-two decomposition: every training sequence holds one binary-length piece of one document."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from mullion.llm.common import chunks, picked, plain
from mullion.llm.encoding import encoder

PIECE_SCHEMA = "doc_id bigint, start bigint, length bigint, doc_tokens bigint, bucket int, ids binary"
BATCH_IDS = 1 << 24  # ids of one record batch of pieces


def piece_lengths(sizes: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray]:
    """(document, length) of every piece: full pieces of ``longest``, then the rest's powers of two, largest first."""
    powers = longest >> np.arange(longest.bit_length())
    times = (sizes[:, None] & powers) > 0
    times = np.concatenate((sizes[:, None] // longest, times[:, 1:]), axis=1)
    return np.repeat(np.arange(len(sizes)), times.sum(axis=1)), np.repeat(np.tile(powers, len(sizes)), times.ravel())


def _groups(stop: np.ndarray, limit: int):
    """Index ranges of pieces, one after another in a buffer, of at most ``limit`` ids together."""
    at = 0
    while at < len(stop):
        begun = stop[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(stop, begun + limit, "right")))
        yield at, to
        at = to


def decompose(docs: DataFrame, tokenizer: str, longest: int = 2048, end_id: int = 1,
              id_col: str = "doc_id", text_col: str = "text", part: int = 1 << 22) -> DataFrame:
    """One row per piece: doc_id, start, length, doc_tokens, bucket, ids, sequence_id, offset.

    A document's ids, with ``end_id`` after them, are cut where the binary digits of their number say, so each piece is
    a power of two of at most ``longest`` (itself a power of two) and fills a sequence of its own length: nothing is
    padded, nothing is dropped and no sequence crosses documents. ``bucket`` is the length's exponent; ``sequence_id``
    numbers sequences of one bucket next to each other. ``ids`` are unsigned 32-bit little-endian.

    Null and empty texts give the end id alone. Rows that repeat a doc_id are packed as documents of their own; a null
    doc_id stays null. Other columns are not looked at. Memory: texts of about ``part`` characters at a time.
    """
    if longest & (longest - 1):
        raise ValueError("longest must be a power of two")

    def cut(batches):
        coder = encoder(tokenizer)
        for batch in batches:
            names, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for lo, hi in chunks(texts, part):
                ids, ends = coder.flat(texts[lo:hi], end_id)
                sizes = np.diff(ends, prepend=0)
                doc, length = piece_lengths(sizes, longest)
                stop = np.cumsum(length)
                start = stop - length
                columns = {"doc_id": pa.array(names[lo:hi], pa.int64()).take(pa.array(doc)), "start": start - (ends - sizes)[doc], "length": length,
                           "doc_tokens": sizes[doc], "bucket": np.log2(length).astype(np.int32)}
                whole = pa.table(columns)
                for a, z in _groups(stop, BATCH_IDS):
                    own = ids[start[a]:stop[z - 1]].astype("<u4")
                    offsets = (4 * np.append(start[a:z] - start[a], stop[z - 1] - start[a])).astype(np.int32)
                    raw = pa.Array.from_buffers(pa.binary(), z - a, [None, pa.py_buffer(offsets), pa.py_buffer(own)])
                    yield whole.slice(a, z - a).append_column("ids", raw).to_batches()[0]

    source = picked(docs, doc_id=id_col, text=text_col).select(F.col("doc_id").cast("bigint"), plain(F.col("text")).alias("text"))
    pieces = source.mapInArrow(cut, PIECE_SCHEMA)
    # Longest bucket first; within a bucket the running number of Spark's partitions, which a rerun of a task repeats.
    rank = F.lit(longest.bit_length() - 1) - F.col("bucket")
    return pieces.withColumn("sequence_id", F.shiftleft(rank.cast("bigint"), 56) + F.monotonically_increasing_id()).withColumn(
        "offset", F.lit(0).cast("bigint"))


def write_buckets(pieces: DataFrame, path: str) -> None:
    """Equal lengths next to each other: one folder per bucket, each row a sequence ready to batch with its neighbours."""
    pieces.write.partitionBy("bucket").parquet(path)
