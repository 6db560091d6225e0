"""Subword lattice of words: all ways to cut a word into pieces of a vocabulary, summed in log space.

A batch of words is one array of code points. Edges (pieces that match somewhere) are found by
rolling hashes, for all words and starts at once; the forward and backward recursions go position by
position, for all words at once. A character that is no piece by itself may be spelt in its UTF-8
bytes, so every word has a positive probability.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: Marks a word's beginning in the vocabulary.
MARK = "▁"
_BASE = np.uint64(0x9E3779B97F4A7C15)


def _hashes(text: np.ndarray, length: int) -> np.ndarray:
    """Hash of rows of `length` code points."""
    h = np.zeros(len(text), np.uint64)
    for k in range(length):
        h = h * _BASE + text[:, k] + np.uint64(1)
    return h


@dataclass
class Edges:
    start: np.ndarray  # node before the piece; a word of n characters has n + 1 nodes
    end: np.ndarray
    piece: np.ndarray  # number of the piece, or -1 - the spelt character's place in `spelt`
    at: np.ndarray  # place in the word where the piece begins
    stop: np.ndarray  # and ends
    first: np.ndarray  # each word's first node
    last: np.ndarray
    spelt: list[bytes]


class Lattice:
    """Pieces are numbered 0 to n - 1, then the 256 bytes, then the text's end."""

    def __init__(self, pieces: list[str]):
        self.n = len(pieces)
        self.size = self.n + 257
        self.end = self.n + 256
        self.longest = max(map(len, pieces), default=1)
        points = [np.frombuffer(p.encode("utf-32-le"), "<u4").astype(np.uint64) for p in pieces]
        size = np.asarray([len(p) for p in points])
        self.whole: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.uint64), np.zeros(0, np.int64))]
        self.prefix: list[np.ndarray] = [np.zeros(0, np.uint64)]
        for k in range(1, self.longest + 1):
            ids = np.flatnonzero(size == k)
            h = _hashes(np.stack([points[i] for i in ids]), k) if len(ids) else np.zeros(0, np.uint64)
            order = np.argsort(h)
            self.whole.append((h[order], ids[order]))
            longer = [points[i][:k] for i in np.flatnonzero(size > k)]
            self.prefix.append(np.unique(_hashes(np.stack(longer), k)) if longer else np.zeros(0, np.uint64))

    def edges(self, words: list[str]) -> Edges:
        text = np.frombuffer("".join(MARK + w for w in words).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
        size = np.fromiter((len(w) + 1 for w in words), np.int64, len(words))
        word = np.repeat(np.arange(len(words)), size)
        begin = np.cumsum(size) - size
        place = np.arange(len(text)) - begin[word]
        room = size[word] - place
        node = np.arange(len(text)) + word
        live, h = np.arange(len(text)), np.zeros(len(text), np.uint64)
        at, piece, length = [], [], []
        single = np.zeros(len(text), bool)
        for k in range(1, self.longest + 1):
            fits = room[live] >= k
            live, h = live[fits], h[fits]
            if not len(live):
                break
            h = h * _BASE + text[live + k - 1] + np.uint64(1)
            known, ids = self.whole[k]
            if len(known):
                slot = np.minimum(np.searchsorted(known, h), len(known) - 1)
                hit = known[slot] == h
                at.append(live[hit])
                piece.append(ids[slot[hit]])
                length.append(np.full(int(hit.sum()), k))
                if k == 1:
                    single[live[hit]] = True
            known = self.prefix[k]
            if not len(known):
                break
            more = known[np.minimum(np.searchsorted(known, h), len(known) - 1)] == h
            live, h = live[more], h[more]
        lone = np.flatnonzero(~single)
        chars, which = np.unique(text[lone], return_inverse=True)
        at.append(lone)
        piece.append(-1 - which.astype(np.int64))
        length.append(np.ones(len(lone), np.int64))
        i, piece_, k = np.concatenate(at), np.concatenate(piece), np.concatenate(length)
        spelt = [chr(int(c)).encode("utf-8", "surrogatepass") for c in chars]
        return Edges(node[i], node[i] + k, piece_, place[i], place[i] + k, begin + np.arange(len(words)), begin + np.arange(len(words)) + size, spelt)

    def _weights(self, e: Edges, logp: np.ndarray) -> np.ndarray:
        spelt = np.asarray([logp[self.n + np.frombuffer(c, np.uint8).astype(np.int64)].sum() for c in e.spelt] or [0.0])
        return np.where(e.piece >= 0, logp[np.maximum(e.piece, 0)], spelt[np.maximum(-1 - e.piece, 0)])

    @staticmethod
    def _recur(level: np.ndarray, to: np.ndarray, source: np.ndarray, w: np.ndarray, score: np.ndarray, down: bool) -> None:
        """score[to] = log sum of score[source] + w over the edges into `to`, level by level."""
        order = np.lexsort((to, -level if down else level))
        level, to, source, w = level[order], to[order], source[order], w[order]
        cuts = np.append(np.flatnonzero(np.diff(level, prepend=-1)), len(level))
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            t = to[a:b]
            heads = np.flatnonzero(np.diff(t, prepend=-1))
            score[t[heads]] = np.logaddexp.reduceat(score[source[a:b]] + w[a:b], heads)

    def log_probability(self, words: list[str], logp: np.ndarray) -> np.ndarray:
        """Natural logarithm of each word's probability, summed over all its segmentations."""
        return self.log_probabilities(words, [logp])[0]

    def log_probabilities(self, words: list[str], weights: list[np.ndarray]) -> list[np.ndarray]:
        """The same by several weights of the pieces."""
        if not words:
            return [np.zeros(0) for _ in weights]
        e, out = self.edges(words), []
        for logp in weights:
            alpha = np.zeros(int(e.last[-1]) + 1)
            self._recur(e.stop, e.end, e.start, self._weights(e, logp), alpha, False)
            out.append(alpha[e.last])
        return out

    def expected_counts(self, words: list[str], times: np.ndarray, logp: np.ndarray) -> np.ndarray:
        """How often each piece is used in expectation, when each word occurs `times` times."""
        total = np.zeros(self.size)
        if not words:
            return total
        e = self.edges(words)
        w = self._weights(e, logp)
        alpha, beta = np.zeros(int(e.last[-1]) + 1), np.zeros(int(e.last[-1]) + 1)
        self._recur(e.stop, e.end, e.start, w, alpha, False)
        self._recur(e.at, e.start, e.end, w, beta, True)
        word = np.searchsorted(e.first, e.start, side="right") - 1
        share = times[word] * np.exp(alpha[e.start] + w + beta[e.end] - alpha[e.last[word]])
        own = e.piece >= 0
        total[: self.n] = np.bincount(e.piece[own], share[own], self.n)
        spelt = np.bincount(-1 - e.piece[~own], share[~own], max(1, len(e.spelt)))
        for c, x in zip(e.spelt, spelt, strict=False):
            np.add.at(total, self.n + np.frombuffer(c, np.uint8).astype(np.int64), x)
        return total
