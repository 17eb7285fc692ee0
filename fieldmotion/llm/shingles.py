"""Whole-array hashing of word shingles: the words of many texts at once in numpy."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

_RNG = np.random.Generator(np.random.Philox(key=20_011))
_BYTES = _RNG.integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True
_P = 0x9E3779B97F4A7C15 | 1
_P_INV = pow(_P, -1, 2**64)


@lru_cache(2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """P ** i and P ** -i modulo 2 ** 64 for i < n."""
    up, down = np.full(n, _P, np.uint64), np.full(n, _P_INV, np.uint64)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads every bit over all."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _spans(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A polynomial hash of values[start:end] for every span."""
    size = 1 << max(12, int(len(values)).bit_length())
    up, down = _powers(size)
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[: len(values)], out=sums[1:])
    return mixed((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every word of all texts in order, number of words of each text)."""
    raw = np.frombuffer(b"\n".join([*(t.lower() for t in texts), b""]), np.uint8)
    if not len(raw):
        return np.zeros(0, np.uint64), np.zeros(len(texts), np.int64)
    blank = _BLANK[raw]
    edge = np.diff(np.concatenate([[True], blank]).astype(np.int8))
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    bounds = np.cumsum([len(t) + 1 for t in texts])
    return _spans(_BYTES[raw], starts, ends), np.diff(np.searchsorted(starts, np.concatenate([[0], bounds])))


def shingle_sets(texts: list[bytes], k: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """(signature of each text's word sequence, its sorted distinct shingle hashes)."""
    signature, sets, _ = counted_shingle_sets(texts, k)
    return signature, sets


def counted_shingle_sets(texts: list[bytes], k: int) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """(signature of each text's word sequence, its sorted distinct shingle hashes, its words).

    A text with fewer than k words has its whole sequence as one shingle, one without
    words has none. Hashes have 56 bits. Texts with equal word sequences, and in practice
    no others, have equal signatures.
    """
    words, n = word_hashes(texts)
    ends = np.cumsum(n)
    starts = ends - n
    signature = _spans(words, starts, ends) if len(words) else mixed(np.zeros(len(texts), np.uint64))
    windows = np.arange(max(0, len(words) - k + 1))
    rolled = _spans(words, windows, windows + k) >> np.uint64(8) if len(windows) else np.zeros(0, np.uint64)
    sets = []
    for i, (s, e) in enumerate(zip(starts, ends, strict=True)):
        if e - s >= k:
            sets.append(np.unique(rolled[s : e - k + 1]))
        else:
            sets.append(signature[i : i + 1] >> np.uint64(8) if e > s else rolled[:0])
    return signature, sets, n


def shingle_hashes(texts: list[bytes], k: int) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray]:
    """(128-bit signature of each text's words, all shingle hashes, each text's first, distinct ones).

    Hashes have 64 bits. Repeats of a shingle within a text are still there.
    """
    words, n = word_hashes(texts)
    ends = np.cumsum(n)
    begins = ends - n
    if not len(words):
        return [bytes(16)] * len(texts), words, np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
    whole, other = _spans(words, begins, ends), _spans(mixed(words ^ np.uint64(_P)), begins, ends)
    count = np.where(n >= k, n - k + 1, np.minimum(n, 1))
    starts = np.cumsum(count) - count
    owner = np.repeat(np.arange(len(texts)), count)
    at = begins[owner] + np.arange(len(owner)) - starts[owner]
    shingles = _spans(words, at, np.minimum(at + k, ends[owner]))
    order = np.lexsort((shingles, owner))
    new = np.ones(len(order), bool)
    new[1:] = (shingles[order][1:] != shingles[order][:-1]) | (owner[order][1:] != owner[order][:-1])
    distinct = np.bincount(owner[order][new], minlength=len(texts))
    return [r.tobytes() for r in np.stack([whole, other], axis=1)], shingles, starts, distinct


def word_tails(texts: list[bytes], kinds: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash of every word, its kind by its last three bytes, words of each text)."""
    raw = np.frombuffer(b"\n".join([*(t.lower() for t in texts), b""]), np.uint8)
    if not len(raw):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(len(texts), np.int64)
    blank = _BLANK[raw]
    edge = np.diff(np.concatenate([[True], blank]).astype(np.int8))
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    bounds = np.cumsum([len(t) + 1 for t in texts])
    tail = np.zeros(len(starts), np.uint64)
    for k in (1, 2, 3):
        at = np.maximum(ends - k, starts)
        tail = tail * np.uint64(256) + raw[at].astype(np.uint64)
    kind = (mixed(tail) % np.uint64(kinds)).astype(np.int64)
    return _spans(_BYTES[raw], starts, ends), kind, np.diff(np.searchsorted(starts, np.concatenate([[0], bounds])))
