"""Statistics of one text, from its UTF-8 bytes and words."""

from __future__ import annotations

from collections import Counter

import numpy as np

#: Characters that the symbol rule counts (fixed values).
SYMBOLS = b"#*$%&|<>"
_SYMBOL_CODES = np.frombuffer(SYMBOLS, np.uint8)
_STOP_CODES = np.frombuffer(b".!?", np.uint8)
_SPACE_CODES = np.frombuffer(b" \t\n\x0b\x0c\r", np.uint8)


def byte_counts(text: bytes) -> np.ndarray:
    return np.bincount(np.frombuffer(text, np.uint8), minlength=256)


def code_points(counts: np.ndarray) -> int:
    """UTF-8 continuation bytes are 0x80 to 0xBF; all others begin a character."""
    return int(counts.sum() - counts[0x80:0xC0].sum())


def duplicate_lines(text: bytes) -> int:
    """Lines that hold a word and equal an earlier line."""
    lines = [x for x in text.split(b"\n") if x.strip(b" \t\x0b\x0c\r")]
    return len(lines) - len(set(lines))


def numbered(words: list[bytes]) -> np.ndarray:
    """Each word's number, in order of first appearance."""
    seen: dict[bytes, int] = {}
    return np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, len(words))


def repeated_window_words(ids: np.ndarray, width: int = 3) -> int:
    """Words that lie in a window of `width` words which occurs twice or more in the text."""
    n = len(ids) - width + 1
    if n < 2:
        return 0
    key = ids[:n]
    for k in range(1, width):
        base = int(ids.max()) + 1
        if int(key.max()) >= 2**62 // base:  # renumber, so that keys stay exact in 64 bits
            key = np.unique(key, return_inverse=True)[1]
        key = key * base + ids[k : k + n]
    _, inverse, count = np.unique(key, return_inverse=True, return_counts=True)
    hit = count[inverse] > 1
    covered = np.zeros(len(ids), bool)
    for k in range(width):
        covered[k : k + n] |= hit
    return int(covered.sum())


#: Names of what `rule_counts` returns, in order.
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_short_words", "n_top_word", "n_distinct", "n_stops", "n_digits")


def rule_counts(text: bytes) -> tuple[int, ...]:
    """COUNTS of a whole text. Lines hold a word; short words have at most three bytes; n_top_word counts the commonest word."""
    words, counts = text.split(), byte_counts(text)
    ids = numbered(words)
    tally = np.bincount(ids, minlength=1)
    lines = [x for x in text.split(b"\n") if x.strip(b" \t\x0b\x0c\r")]
    return (
        len(words),
        code_points(counts) - int(counts[_SPACE_CODES].sum()),
        int(counts[_SYMBOL_CODES].sum()),
        len(lines) - len(set(lines)),
        repeated_window_words(ids),
        len(lines),
        sum(n <= 3 for n in map(len, words)),
        int(tally.max()),
        len(tally) if words else 0,
        int(counts[_STOP_CODES].sum()),
        int(counts[48:58].sum()),
    )


#: Names of what `features` returns, in order.
FEATURES = (
    "log_words", "log_bytes", "word_bytes", "word_bytes_sd", "distinct", "top_word", "adjacent_equal", "repeat3",
    "dup_lines", "line_words", "upper", "digits", "non_ascii", "space", "hash_star", "dollar_percent_amp", "pipe",
    "angle", "exclamation", "question", "comma", "full_stop", "quote", "bracket", "slash_colon_at", "short_words",
    "long_words", "log_distinct",
)


def features(text: bytes) -> list[float]:
    """Document statistics; the empty text has zeros only."""
    words = text.split()
    if not words:
        return [0.0] * len(FEATURES)
    c, n, size = byte_counts(text), len(words), len(text)
    ids = numbered(words)
    tally = np.bincount(ids)
    lengths = np.fromiter(map(len, words), np.int64, n)
    share = lambda chars: float(c[np.frombuffer(chars, np.uint8)].sum()) / size
    per_word = lambda chars: float(c[np.frombuffer(chars, np.uint8)].sum()) / n
    lines = int(c[10]) + 1
    return [
        float(np.log1p(n)), float(np.log1p(size)), float(lengths.mean()), float(lengths.std()), len(tally) / n,
        float(tally.max()) / n, float((ids[1:] == ids[:-1]).sum()) / n, repeated_window_words(ids) / n,
        duplicate_lines(text) / lines, n / lines, float(c[65:91].sum()) / size, float(c[48:58].sum()) / size,
        float(c[128:].sum()) / size, share(b" \t\n\r"), per_word(b"#*"), per_word(b"$%&"), per_word(b"|"),
        per_word(b"<>"), per_word(b"!"), per_word(b"?"), per_word(b","), per_word(b"."), per_word(b"\"'"),
        per_word(b"()[]{}"), per_word(b"/:@"), float((lengths <= 3).mean()), float((lengths >= 12).mean()),
        float(np.log1p(len(tally))),
    ]


def most_common_share(words: list[bytes]) -> float:
    return Counter(words).most_common(1)[0][1] / len(words) if words else 0.0
