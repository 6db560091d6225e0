"""Simple-8b: as many numbers as fit go into each 64-bit word, whose top 4 bits tell how many.

Numbers are cut into blocks of BLOCK; each block begins a new word, and a table of offsets tells
which, so that blocks can be decoded apart or all at once. Layout of a segment, little-endian:

    4 bytes "TS8B" | u32 numbers | u32 blocks | u32 words | blocks x u32 first word | words x u64

Selector k < 14 holds COUNTS[k] numbers of BITS[k] bits, the first in the lowest bits; missing
numbers at a block's end are zeros. Selector 15 is the escape: the next word is one number as it is.
"""

from __future__ import annotations

import numpy as np

MAGIC = b"TS8B"
BLOCK = 4096
#: Numbers per word and bits per number, by selector (fixed values of the published scheme).
COUNTS = (60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1)
BITS = (1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60)
ESCAPE = 15


def _choose(values: np.ndarray) -> np.ndarray:
    """For each position of (blocks, BLOCK + 60) values, zero past a block's end: the selector that packs most from there on."""
    width = values.shape[1] - max(COUNTS)
    best = np.full((len(values), width), ESCAPE, np.uint8)
    # the least selector with bits enough for each value, in one byte
    limits = np.asarray([1 << b for b in BITS[:-1]], np.uint64)
    alone = np.searchsorted(limits, values, side="right").astype(np.uint8)
    alone[values >= np.uint64(1) << np.uint64(BITS[-1])] = len(BITS)
    high, low = alone.max(initial=0), alone.min(initial=len(BITS))
    for k in range(len(COUNTS) - 1, -1, -1):
        count = COUNTS[k]
        if high <= k:
            best[:] = k
            continue
        if k < low:
            break
        fits, have = alone <= k, 1
        while have < count:  # windows of 1, 2, 4, ... positions, then of count
            more = min(have, count - have)
            fits = fits[:, :-more] & fits[:, more:]
            have += more
        fits = fits[:, :width]
        if not fits.any():
            continue
        best[fits] = k
    return best


def _visited(steps: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """Where words begin: the positions that jumps by `steps` reach from the blocks' firsts.

    All jumps are followed at once: the set reached so far doubles its number of jumps every round.
    """
    n = len(steps)
    at = np.arange(n, dtype=np.int32)
    jump = np.append(np.minimum(at + steps, (at // BLOCK + 1) * BLOCK), n).clip(max=n)
    seen = np.zeros(n + 1, bool)
    seen[firsts] = True
    count = len(firsts)
    while True:
        seen[jump[np.flatnonzero(seen)]] = True
        new = np.count_nonzero(seen)
        if new == count:
            return np.flatnonzero(seen[:n])
        count, jump = new, jump[jump]


def encode(numbers: np.ndarray) -> bytes:
    n = len(numbers)
    blocks = -(-n // BLOCK)
    kind = np.uint32 if numbers.dtype == np.uint32 else np.uint64
    padded = np.zeros((blocks, BLOCK + max(COUNTS)), kind)
    whole = np.zeros(blocks * BLOCK, kind)
    whole[:n] = numbers
    padded[:, :BLOCK] = whole.reshape(blocks, BLOCK)
    chosen = _choose(padded)
    steps = np.asarray([*COUNTS, 0, 1], np.int32)[chosen].ravel()[:n]
    firsts = np.arange(0, n, BLOCK)
    starts = _visited(steps, firsts)
    row, col = np.divmod(starts, BLOCK)
    places = row * (BLOCK + max(COUNTS)) + col
    selector = chosen[row, col]
    escaped = selector == ESCAPE
    slot = np.arange(len(places)) + np.cumsum(escaped) - escaped  # an escape takes two words
    words = np.zeros(len(places) + int(escaped.sum()), np.uint64)
    flat = padded.ravel()
    for k in np.unique(selector):
        mine = selector == k
        if k == ESCAPE:
            words[slot[mine]] = np.uint64(ESCAPE) << np.uint64(60)
            words[slot[mine] + 1] = flat[places[mine]]
            continue
        at = places[mine]
        packed = np.full(len(at), np.uint64(k) << np.uint64(60))
        for j in range(COUNTS[k]):
            packed |= flat[at + j].astype(np.uint64) << np.uint64(j * BITS[k])
        words[slot[mine]] = packed
    offsets = slot[np.searchsorted(starts, firsts)].astype("<u4")
    head = np.asarray([n, blocks, len(words)], "<u4")
    return MAGIC + head.tobytes() + offsets.tobytes() + words.astype("<u8").tobytes()


def decode(segment: bytes, blocks: range | None = None) -> np.ndarray:
    """All numbers of a segment, or those of a range of its blocks."""
    if segment[:4] != MAGIC:
        raise ValueError("not a Simple-8b segment")
    n, have, size = (int(x) for x in np.frombuffer(segment, "<u4", 3, 4))
    offsets = np.append(np.frombuffer(segment, "<u4", have, 16).astype(np.int64), size)
    words = np.frombuffer(segment, "<u8", size, 16 + 4 * have)
    blocks = range(have) if blocks is None else range(*blocks.indices(have)) if isinstance(blocks, slice) else blocks
    if not len(blocks):
        return np.zeros(0, np.uint64)
    start = int(offsets[blocks[0]])
    words = words[start : int(offsets[blocks[-1] + 1])]
    n = min(n, (blocks[-1] + 1) * BLOCK) - blocks[0] * BLOCK
    selector = (words >> np.uint64(60)).astype(np.int64)
    raw = _after_escapes(selector)
    counts = np.asarray([*COUNTS, 0, 1], np.int64)[selector]
    counts[raw] = 0
    local = np.zeros(len(words), np.int64)
    firsts = offsets[blocks[0] : blocks[-1] + 1] - start
    local[firsts[1:]] = 1
    block = np.cumsum(local)
    ends = np.cumsum(counts)
    before = ends - counts - np.concatenate([[0], (ends - counts)[firsts[1:]]])[block]
    # a block's last word may have room for more numbers than the block; they go past its end
    row = BLOCK + max(COUNTS)
    out = np.zeros(len(firsts) * row, np.uint64)
    place = block * row + before
    for k in np.unique(selector[~raw]):
        mine = np.flatnonzero((selector == k) & ~raw)
        at = place[mine]
        if k == ESCAPE:
            out[at] = words[mine + 1]
            continue
        own = words[mine]
        mask = (np.uint64(1) << np.uint64(BITS[k])) - np.uint64(1)
        for j in range(COUNTS[k]):
            out[at + j] = (own >> np.uint64(j * BITS[k])) & mask
    return out.reshape(-1, row)[:, :BLOCK].ravel()[:n]


def _after_escapes(selector: np.ndarray) -> np.ndarray:
    """Which words are the raw numbers that follow an escape; a raw number may look like an escape itself."""
    raw = np.zeros(len(selector), bool)
    for at in np.flatnonzero(selector == ESCAPE).tolist():
        if not raw[at]:
            raw[at + 1] = True
    return raw
