"""Minimal perfect hashing of the keys of one block: hash, displace, and a stored fingerprint per slot."""

from __future__ import annotations

import numpy as np

from mullion.llm.common import scramble

PER_BUCKET = 4
_TRIES = 64


def key_hash(doc_id: int | None, turn: int = 0) -> int:
    """64-bit hash of a document key; ``turn`` counts the rows of a block that repeat the key."""
    low = np.array([0 if doc_id is None else doc_id & 0xFFFFFFFFFFFFFFFF], np.uint64)
    salt = np.array([2 * turn + (doc_id is None)], np.uint64)
    return int(scramble(scramble(low) ^ scramble(salt + np.uint64(0x51ED27)))[0])


def key_hashes(ids: np.ndarray, nulls: np.ndarray, turns: np.ndarray) -> np.ndarray:
    """``key_hash`` of many keys."""
    salt = (2 * turns + nulls).astype(np.uint64)
    return scramble(scramble(np.where(nulls, 0, ids).astype(np.int64).view(np.uint64)) ^ scramble(salt + np.uint64(0x51ED27)))


def fingerprints(hashes: np.ndarray) -> np.ndarray:
    return (scramble(hashes ^ np.uint64(0xF1A9E7)) >> np.uint64(32)).astype(np.uint32)


def _slots(hashes: np.ndarray, shift: np.ndarray, n: int) -> np.ndarray:
    return (scramble(hashes[:, None] + scramble(shift.astype(np.uint64))[None, :]) % np.uint64(n)).astype(np.int64)


def build(hashes: np.ndarray) -> np.ndarray:
    """Displacement per bucket, so that ``slots`` maps the n distinct hashes onto 0..n-1 one to one.

    Buckets are placed largest first; a displacement is searched in groups of candidates. A bucket of one key that
    remains at the end is given its free slot outright, as -(slot + 1).
    """
    n = len(hashes)
    buckets = max(1, -(-n // PER_BUCKET))
    of = (hashes >> np.uint64(20)) % np.uint64(buckets)
    order = np.argsort(of, kind="stable")
    bounds = np.searchsorted(of[order], np.arange(buckets + 1, dtype=np.uint64))
    size = np.diff(bounds)
    taken, shift = np.zeros(n, bool), np.zeros(buckets, np.int32)
    for b in np.argsort(-size, kind="stable"):
        k = size[b]
        if not k:
            break
        if k == 1:
            break
        keys, base = hashes[order[bounds[b]:bounds[b + 1]]], 0
        while True:
            at = _slots(keys, np.arange(base, base + _TRIES), n)
            line = np.sort(at, axis=0)
            good = ~taken[at].any(axis=0) & (line[1:] != line[:-1]).all(axis=0)
            if good.any():
                pick = int(np.argmax(good))
                taken[at[:, pick]] = True
                shift[b] = base + pick
                break
            base += _TRIES
            if base > 1 << 24:
                raise ValueError("two keys share a 64-bit hash")
    shift[np.flatnonzero(size == 1)] = -1 - np.flatnonzero(~taken)
    return shift


def slots(hashes: np.ndarray, shift: np.ndarray, n: int) -> np.ndarray:
    """The slot of each hash; for a hash that was not built in, some slot, told apart by the fingerprint."""
    if not n:
        return np.full(len(hashes), -1)
    d = shift[((hashes >> np.uint64(20)) % np.uint64(len(shift))).astype(np.int64)].astype(np.int64)
    mixed = scramble(hashes + scramble(np.maximum(d, 0).astype(np.uint64))) % np.uint64(n)
    return np.where(d < 0, -1 - d, mixed.astype(np.int64))
