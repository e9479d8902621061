"""Word shingles as 64-bit hashes, one-permutation signatures and band keys, in numpy inside Spark tasks."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import xxhash

_ODD = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: bytes | None) -> list[bytes]:
    """Lower-cased (A-Z) words ``[^\\x20\\x09-\\x0D]+``; bytes methods know exactly these letters and separators."""
    return text.lower().split() if text else []


def mixed(values: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every input bit over the result."""
    values = (values ^ (values >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    values = (values ^ (values >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return values ^ (values >> np.uint64(33))


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def shingle_hashes(words: list[bytes], size: int) -> np.ndarray:
    """A hash for each run of ``size`` words, in text order; a shorter text is one shingle of all its words."""
    if not words:
        return np.empty(0, np.uint64)
    hashes = word_hashes(words)
    length = min(size, len(words))
    runs = np.full(len(words) - length + 1, length, np.uint64)
    for offset in range(length):
        runs = runs * _ODD + hashes[offset : offset + len(runs)]
    return mixed(runs)


def distinct(values: np.ndarray) -> np.ndarray:
    values = np.sort(values)
    return values[np.concatenate(([True], values[1:] != values[:-1]))] if len(values) else values


def shingle_set(text: bytes | None, size: int) -> np.ndarray:
    """Sorted distinct shingle hashes of a whole text."""
    return distinct(shingle_hashes(words_of(text), size))


@lru_cache(maxsize=4)
def probes(bins: int) -> tuple[np.ndarray, np.ndarray]:
    """Every bin's own random order of all bins: order[t, i] is where bin i, if empty, looks at its t-th try,
    and rank[i, j] is the try at which bin i would look into bin j."""
    generator = np.random.Generator(np.random.PCG64(20_251))
    order = np.argsort(generator.random((bins, bins)), axis=1)
    return np.ascontiguousarray(order.T.astype(np.intp)), order.argsort(axis=1).astype(np.uint16)


def signature(shingles: np.ndarray, bins: int) -> np.ndarray:
    """One-permutation minima of a sorted set: the smallest hash in each of ``bins`` equal ranges. An empty bin
    takes the minimum of the first filled bin in its own random order (optimal densification)."""
    bin_of = ((shingles >> np.uint64(32)) * np.uint64(bins)) >> np.uint64(32)
    first = np.flatnonzero(np.concatenate(([True], bin_of[1:] != bin_of[:-1])))
    filled = bin_of[first].astype(np.intp)
    found = np.zeros(bins, np.uint64)
    found[filled] = shingles[first]
    full = np.zeros(bins, bool)
    full[filled] = True
    empty = np.flatnonzero(~full)
    order, rank = probes(bins)
    if 8 * len(filled) < bins:
        found[empty] = found[filled[rank[np.ix_(empty, filled)].argmin(axis=1)]]
    else:
        attempt = 0
        while len(empty):
            donor = order[attempt, empty]
            usable = full[donor]
            found[empty[usable]] = found[donor[usable]]
            empty = empty[~usable]
            attempt += 1
    return found


def band_keys(found: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """For signatures stacked as rows: one 64-bit key per band of ``rows`` values; the band's number is part of it."""
    table = found.reshape(len(found), bands, rows)
    keys = np.tile(np.arange(1, bands + 1, dtype=np.uint64), (len(found), 1))
    for row in range(rows):
        keys = keys * _ODD + table[:, :, row]
    return mixed(keys)


def set_digest(shingles: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(shingles.tobytes())
