"""Token ids of whole texts by a public tokenizer, a word at a time.

The tokenizer drops white space and never joins what white space separates, so a text's ids are its
words' ids in a row. A word is encoded once per worker; later texts look it up. Two more of the
tokenizer's rules make fewer words distinct: it ignores case, and it parts letters from the
signs after them. Tests hold the result against encoding whole texts.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from typing import NamedTuple

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core

import numpy as np  # noqa: E402
import public_tokenizers  # noqa: E402
import pyarrow as pa  # noqa: E402
import pyarrow.compute as pc  # noqa: E402
from tokenizers import Tokenizer, normalizers, pre_tokenizers  # noqa: E402
from xxhash import xxh3_128_digest  # noqa: E402

from .common import takes_turn  # noqa: E402

TOKENIZER_FILE = "word_bpe_49k.json"
#: Words that a worker remembers at most, by 128 bits of their hash; then it begins anew.
CACHED_WORDS = 700_000
#: Words that the tokenizer gets as one text, joined by a special token.
_JOINED = 64
#: Such texts that the tokenizer gets at once.
_ENCODED = 64
#: Bytes of text that are looked up together, at least, unless there are no more.
_TOGETHER = 3 << 20
#: A line each: small Latin letters (a-z and, in UTF-8, those of U+00DF to U+00FF) or a digit, then signs
#: without an apostrophe, which the tokenizer parts and takes as they are; or any other word.
_LINES = re.compile(rb"^(?:((?:[a-z]|\xc3[\x9f-\xb6\xb8-\xbf])++|[0-9])?([]!\"#$%&()*+,./:;=>?@[^_`{}~|-]++)?|(.+))$", re.MULTILINE)


def _folded(text: bytes) -> bytes:
    """The text with A-Z lowered where that changes no id: not beside combining marks or special tokens."""
    return text if b"<|" in text or b"\xcc" in text or b"\xcd" in text else text.lower()


def _all_folded(texts: pa.Array) -> pa.Array:
    """_folded of every text."""
    size = texts.offset + len(texts)
    offsets = np.frombuffer(texts.buffers()[1], np.int32, size + 1)
    data = bytes(texts.buffers()[2][offsets[texts.offset] : offsets[size]]) if len(texts) and texts.buffers()[2] else b""
    if _folded(data) is data:
        return pa.array([_folded(t) for t in texts.cast(pa.binary()).to_pylist()], pa.binary()).cast(pa.string())
    return pc.ascii_lower(texts)


class Encoded(NamedTuple):
    """The ids of some texts one after another, each text's end id last, and the places where the texts end."""

    ids: np.ndarray
    ends: np.ndarray


class WordEncoder:
    def __init__(self, file: str = TOKENIZER_FILE):
        self.tokenizer = Tokenizer.from_file(public_tokenizers.path(file))
        # for words that need neither normalising nor splitting: the same model, and the same ids of added tokens, which follow its own
        self.simple = Tokenizer(self.tokenizer.model)
        self.simple.add_special_tokens([str(token) for _, token in sorted(self.tokenizer.get_added_tokens_decoder().items())])
        self.simple.normalizer = normalizers.Sequence([])
        self.simple.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.joint = self.tokenizer.token_to_id("<|endoftext|>")
        if self.simple.token_to_id("<|endoftext|>") != self.joint:
            raise ValueError(f"{file} numbers its added tokens otherwise")
        self._forget()

    def _forget(self) -> None:
        self.given = 0  # words have numbers
        self.keys = [np.zeros(0, np.uint64), np.zeros(0, np.uint64)]  # 128 bits of each word's hash, in the order of the first 64
        self.number = np.zeros(0, np.int32)
        self.first = np.zeros(1024, np.int32)  # of each number's ids in `flat`
        self.length = np.zeros(1024, np.int32)
        self.flat = np.zeros(4096, np.uint32)
        self.used = 0

    def __call__(self, text: bytes) -> np.ndarray:
        """The ids of a text, as unsigned 32-bit numbers, without special tokens added."""
        return next(self.each(pa.array([text], pa.binary()).cast(pa.string()))).ids[:-1]

    def each(self, texts: pa.Array, end_id: int = 0) -> Iterator[Encoded]:
        """The ids of all texts, in order, a group of texts at a time; null is the empty text."""
        texts = pc.fill_null(texts.cast(pa.string()), "")
        size = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False), dtype=np.int64)
        begin = 0
        while begin < len(texts):
            before = size[begin - 1] if begin else 0
            end = min(len(texts), int(np.searchsorted(size, before + _TOGETHER)) + 1)
            yield self._looked_up(texts.slice(begin, end - begin), end_id)
            begin = end

    def _looked_up(self, texts: pa.Array, end_id: int) -> Encoded:
        if self.given > CACHED_WORDS or self.used > 8 * CACHED_WORDS:
            self._forget()
        words = pc.ascii_split_whitespace(_all_folded(texts))
        counts = pc.list_value_length(words).to_numpy(zero_copy_only=False)
        coded = words.flatten().dictionary_encode()
        at = self._numbers(coded.dictionary.cast(pa.binary()).to_pylist())[coded.indices.to_numpy()]
        length = self.length[at]
        of_words = np.append(0, np.cumsum(length, dtype=np.int64))
        of_texts = of_words[np.append(0, np.cumsum(counts))]
        n_ends = len(counts)
        # a text's ids move by one for each end before it
        ids = np.full(int(of_words[-1]) + n_ends, end_id, np.uint32)
        inside = np.ones(len(ids), bool)
        ends = of_texts[1:] + np.arange(1, n_ends + 1)
        inside[ends - 1] = False
        place = np.repeat((self.first[at] - of_words[:-1]).astype(np.int32), length)
        place += np.arange(of_words[-1], dtype=np.int32)
        ids[inside] = self.flat[place]
        return Encoded(ids, ends)

    def _numbers(self, words: list[bytes]) -> np.ndarray:
        """The numbers of distinct words; those that are new get one, and their ids."""
        hashes = np.frombuffer(b"".join(map(xxh3_128_digest, words)), np.uint64).reshape(-1, 2)
        found = np.full(len(words), -1, np.int32)
        if self.given:
            slot = np.minimum(np.searchsorted(self.keys[0], hashes[:, 0]), len(self.number) - 1)
            hit = (self.keys[0][slot] == hashes[:, 0]) & (self.keys[1][slot] == hashes[:, 1])
            found[hit] = self.number[slot[hit]]
        missing = np.flatnonzero(found < 0)
        if len(missing):
            first = self.given
            self.given += len(missing)
            found[missing] = np.arange(first, self.given, dtype=np.int32)
            order = missing[np.argsort(hashes[missing, 0])]
            at = np.searchsorted(self.keys[0], hashes[order, 0])
            self.keys = [np.insert(x, at, hashes[order, k]) for k, x in enumerate(self.keys)]
            self.number = np.insert(self.number, at, found[order])
            self._learn([words[k] for k in missing.tolist()], first)
        return found

    def _learn(self, new: list[bytes], first: int) -> None:
        """Gives the words that are numbered from `first` on, and the parts that they are made of, their ids."""
        plain, other, signed, pairs = [], [], [], []
        parts: dict[bytes, int] = {}
        for k, (letters, signs, rest) in enumerate(_LINES.findall(b"\n".join(new))):
            if rest:
                other.append(k)
            elif letters and signs:
                signed.append(k)
                pairs += parts.setdefault(letters, len(parts)), parts.setdefault(signs, len(parts))
            else:
                plain.append(k)
        of_parts = self._numbers(list(parts)) if parts else None
        if self.given > len(self.first):
            self.first, self.length = (np.resize(x, 2 * self.given) for x in (self.first, self.length))
        self._encode(plain, new, first, self.simple)
        odd = [k for k in other if b"<|" in new[k]]  # it may hold the joint itself
        self._encode([k for k in other if b"<|" not in new[k]] if odd else other, new, first, self.tokenizer)
        for k in odd:
            ids = np.asarray(self.tokenizer.encode(new[k].decode(), add_special_tokens=False).ids, np.uint32)
            self._add([first + k], ids, np.zeros(1, np.int64), np.asarray([len(ids)]))
        if signed:
            of_pairs = of_parts[pairs]
            length = self.length[of_pairs]
            ends = np.cumsum(length)
            ids = self.flat[np.repeat(self.first[of_pairs] - (ends - length), length) + np.arange(ends[-1])]
            both = length.reshape(-1, 2).sum(axis=1)
            self._add(np.asarray(signed) + first, ids, np.cumsum(both) - both, both)

    def _encode(self, at: list[int], new: list[bytes], first: int, tokenizer: Tokenizer) -> None:
        text = b"<|endoftext|>"
        joined = [(text.join([new[k] for k in at[i : i + _JOINED]]) + text).decode() for i in range(0, len(at), _JOINED)]
        found = []
        for i in range(0, len(joined), _ENCODED):  # what the tokenizer returns is much larger than the ids
            found += [np.asarray(e.ids, np.uint32) for e in tokenizer.encode_batch_fast(joined[i : i + _ENCODED], add_special_tokens=False)]
        if found:
            ids = np.concatenate(found)
            ends = np.flatnonzero(ids == self.joint)
            begins = np.append(0, ends[:-1] + 1)
            self._add(np.asarray(at) + first, ids, begins, ends - begins)

    def _add(self, numbers: np.ndarray | list[int], ids: np.ndarray, first: np.ndarray, length: np.ndarray) -> None:
        if self.used + len(ids) > len(self.flat):
            self.flat = np.resize(self.flat, 2 * (self.used + len(ids)))
        self.first[numbers] = self.used + first
        self.length[numbers] = length
        self.flat[self.used : self.used + len(ids)] = ids
        self.used += len(ids)


_ENCODERS: dict[str, WordEncoder] = {}


def encoder(file: str = TOKENIZER_FILE) -> WordEncoder:
    """This worker's encoder."""
    takes_turn("token_ids", _ENCODERS.clear)
    if file not in _ENCODERS:
        _ENCODERS[file] = WordEncoder(file)
    return _ENCODERS[file]
