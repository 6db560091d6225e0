"""Word shingles of a text as 64-bit hashes, and their minwise signature."""

from __future__ import annotations

import numpy as np
import xxhash

from .common import HashCache, mix64, takes_turn

#: Words in a shingle.
WIDTH = 5
#: Coordinates of a signature.
COORDINATES = 128
_BASE = np.uint64(0x9E3779B97F4A7C15)
_SEEDS = np.random.default_rng(20240607).integers(1, 2**64, (2, COORDINATES), dtype=np.uint64)
_FLIP, _FACTOR = _SEEDS[0], _SEEDS[1] | np.uint64(1)
#: Shingles that one step of `signature` hashes with all coordinates.
_ROWS = 2048

_WORDS = HashCache()


def begin() -> None:
    """A task that takes shingles begins."""
    takes_turn("shingles", _WORDS.clear)


def shingles(text: bytes | None) -> np.ndarray:
    """Sorted distinct hashes of the 5-word shingles; a text of fewer words is one shingle, none without words.

    A-Z are lowered; nothing else is.
    """
    words = text.lower().split() if text else []
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(_WORDS.__getitem__, words), np.uint64, n)
    width = min(WIDTH, n)
    out = np.full(n - width + 1, width, np.uint64)
    for k in range(width):
        out = out * _BASE + h[k : n - width + 1 + k]
    return np.unique(mix64(out))


def identity(found: np.ndarray) -> bytes:
    """16 bytes that tell sets of shingles apart."""
    return xxhash.xxh3_128_digest(found.tobytes())


def signature(found: np.ndarray) -> np.ndarray:
    """16 bits of the minimum of each coordinate's hash over a non-empty set."""
    low = np.full(COORDINATES, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(found), _ROWS):
        low = np.minimum(low, ((found[at : at + _ROWS, None] ^ _FLIP) * _FACTOR).min(axis=0))
    return (mix64(low) >> np.uint64(48)).astype(np.uint16)
