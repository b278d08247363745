"""Shared folder, written intermediate tables and hashing of words and word windows."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from mullion.runtime import checkpoint_dir

SPACE = r"[\x20\x09-\x0D]+"  # the white space of the word contracts, as a regular expression


def folder(spark: SparkSession, name: str) -> str:
    """A new path in the shared checkpoint folder, for a table or an archive an operator writes."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def plain(text: Column) -> Column:
    """Text as the operators read it: null is empty."""
    return F.coalesce(text.cast("string"), F.lit(""))


def picked(docs: DataFrame, **columns: str) -> DataFrame:
    """The named columns under the operator's own names; all others, clashing ones too, are left behind."""
    return docs.select(*[F.col(f"`{source}`").alias(name) for name, source in columns.items()])


def fold_of(doc_id: Column, folds: int) -> Column:
    """crc32 of the id's decimal text, modulo ``folds``; null ids are in fold 0."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds, F.lit(0))


# Hashing. A word is a polynomial over its bytes modulo 2^64, then scrambled; a window combines five of them.
_BASE = np.uint64(0x9E3779B97F4A7C15)
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint64) + np.uint64(1)
_LOWER[65:91] += np.uint64(32)
_AS_IS = np.arange(256, dtype=np.uint64) + np.uint64(1)


def scramble(x: np.ndarray) -> np.ndarray:
    """Bijective mixing of 64-bit values, so that every bit depends on all others."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _powers(n: int) -> np.ndarray:
    out = np.full(n, _BASE, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = True) -> np.ndarray:
    """64-bit hash of each byte span ``[start, end)``; spans are in order, non-empty and do not overlap."""
    if not len(starts):
        return np.empty(0, np.uint64)
    size = ends - starts
    first = np.cumsum(size) - size
    inner = np.arange(int(size.sum())) - np.repeat(first, size)
    at = inner + np.repeat(starts, size)
    value = (_LOWER if lower else _AS_IS)[data[at]] * _powers(int(size.max()))[inner]
    return scramble(np.add.reduceat(value, first))


def word_spans(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of all texts in a row, starts and ends of their white-space-separated words, and words before each text."""
    data = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    inside = ~_IS_SPACE[data]
    edge = np.flatnonzero(np.diff(np.concatenate(([False], inside)).view(np.int8)))
    starts, ends = edge[0::2], edge[1::2]
    begin = np.cumsum([0] + [len(t) + 1 for t in texts])
    return data, starts, ends, np.searchsorted(starts, begin)


_STEP = scramble(np.arange(1, 65, dtype=np.uint64)) | np.uint64(1)


def windows(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of every run of ``k`` words; of all words as one run when there are fewer; none of no words."""
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    size = min(n, k)
    out = np.full(n - size + 1, np.uint64(size), np.uint64)
    for j in range(size):
        out += words[j:n - size + 1 + j] * _STEP[j % 64]
    return scramble(out)


def chunks(texts: list[bytes], limit: int = 1 << 18):
    """Index ranges of texts whose sizes add up to about ``limit`` bytes; a longer text stands alone."""
    start, held = 0, 0
    for i, t in enumerate(texts):
        if held and held + len(t) > limit:
            yield start, i
            start, held = i, 0
        held += len(t)
    if start < len(texts):
        yield start, len(texts)


def shingle_sets(texts: list[bytes], k: int = 5):
    """Per text, the sorted distinct hashes of its word windows."""
    for lo, hi in chunks(texts):
        data, starts, ends, before = word_spans(texts[lo:hi])
        words = span_hashes(data, starts, ends)
        for a, b in zip(before[:-1], before[1:]):
            yield np.unique(windows(words[a:b], k))
