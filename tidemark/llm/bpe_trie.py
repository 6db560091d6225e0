"""Byte-level BPE encoding and decoding: words that begin alike are encoded together.

BPE has a property that a trie can use: cut an encoding after any of its tokens, and what stands before
the cut is the encoding of its own bytes. So the encoding of a prefix is known from its last token alone
(the tokens before it are the encoding of a shorter prefix), and the last token is the one that ends the
prefix and fits the last token before it. Two tokens fit if no merge would join bytes across their border.

The distinct words of a group of texts are walked in the order of a depth-first traversal of their trie:
sorted, each going on from where it leaves the one before. Of every prefix on the way from the root the last
token is held, and the vocabulary tokens that have begun before it and may still go on; a prefix that many
words share is worked out once. A word's ids are read off backwards, from last token to last token.

Texts become words as the tokenizer's byte-level splitter makes them. What lies between two single spaces
does not depend on its surroundings, so its ids are looked up as a whole once they are known.

Everything happens in the task that holds the text: no shuffle, no state but a bounded cache per worker.

Defined results: a null text is the empty text, which has no ids; the strings of added tokens in a text are
these tokens; rows are told apart by nothing, so repeated rows and ids (also null ids) stay as they are; an
empty table gives an empty table; texts and words may be of any length; other columns are not read. Decoding
null ids gives the empty text; bytes that are no UTF-8 become U+FFFD.
"""

from __future__ import annotations

import gc
import json
import re
import sys
import unicodedata
from array import array
from collections import ChainMap
from collections.abc import Iterable, Iterator

import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import pre_tokenizers

from .common import ship, table, takes_turn

TOKENIZER_FILE = "byte_bpe_50k.json"
#: Words, and stretches between spaces, that a worker remembers at most; then it begins anew.
CACHED = 350_000
#: Longer ones (in characters) are worked out each time.
LONGEST_CACHED = 100
#: Characters of texts that are worked on together, at least, unless there are no more.
_TOGETHER = 3 << 20
#: Prefixes of more bytes are not held for the next word.
_HELD = 512
_ALONE = 1 << 62
END = 256


class ByteBPE:
    """A tokenizer file of the byte-level BPE kind."""

    def __init__(self, file: str = TOKENIZER_FILE):
        with open(public_tokenizers.path(file), encoding="utf-8") as f:
            given = json.load(f)
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in given["added_tokens"]) or given["normalizer"]:
            raise ValueError(f"{file} normalises texts or has added tokens that take their surroundings")
        self.added = {t["content"]: t["id"] for t in given["added_tokens"]}
        self._added = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        vocabulary, merges = given["model"]["vocab"], given["model"]["merges"]
        self.token = _tokens(given)
        self.length = list(map(len, self.token))
        self.parts: dict[int, tuple[int, int]] = {}
        self.rank: dict[int, int] = {}  # of a token, when it is made
        self.merge: dict[int, int] = {}  # of a pair of tokens
        for n, pair in enumerate(merges):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            left, right, made = vocabulary[a], vocabulary[b], vocabulary[a + b]
            self.merge[left << 32 | right] = n
            if made not in self.rank:
                self.rank[made], self.parts[made] = n, (left, right)
        # the vocabulary's own trie: a node is a map of bytes to nodes, and under END the token that ends there, or -1
        self.root: dict = {END: -1}
        for number in vocabulary.values():
            node = self.root
            for byte in self.token[number]:
                node = node.setdefault(byte, {END: -1})
            node[END] = number
        self._fits: dict[int, bool] = {}
        self._edges: tuple[dict, dict] = ({}, {})
        self._words = regex.compile(public_tokenizers.PATTERN)
        self._usual: set[str] = set()
        self._splitter = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=True)
        self._forget()

    def _forget(self) -> None:
        self._of_word: dict[str, bytes] = {}
        self._of_unit: dict[str, bytes] = {}  # whatever begins a text, or follows a run of white space that it holds
        self._of_spaced: dict[str, bytes] = {}  # the same after a single space, which is not in the key

    # tokens

    def _edge(self, token: int, side: int) -> list[tuple[int, int]]:
        """The tokens that stand at a token's right (1) or left (0) border while it is made, each with the rank that ends it."""
        found = self._edges[side].get(token)
        if found is None:
            found = [(token, _ALONE)]
            while (at := found[-1][0]) in self.parts:
                found.append((self.parts[at][side], self.rank[at]))
            self._edges[side][token] = found
        return found

    def fits(self, a: int, b: int) -> bool:
        """Whether the bytes of tokens a and b, one after the other, are encoded as a and b."""
        key = a << 32 | b
        known = self._fits.get(key)
        if known is None:
            known = self._fits[key] = not any(
                (rank := self.merge.get(x << 32 | y)) is not None and rank < until_x and rank <= until_y  # of equal merges the left one comes first
                for x, until_x in self._edge(a, 1) for y, until_y in self._edge(b, 0)
            )
            if len(self._fits) > 4 * CACHED:
                self._fits.clear()
        return known

    # words

    def words(self, found: Iterable[bytes]) -> Iterator[tuple[bytes, bytes]]:
        """Each of the distinct words with its ids, little-endian unsigned 32-bit numbers, in sorted order."""
        root, fits, known, length = self.root, self.fits, self._fits, self.length
        last: list[int] = [-1]  # of the prefix of each length, its last token
        open_: list[list[tuple[int, dict]]] = [[]]  # where the tokens began that go on beyond it, and how far they are in the vocabulary's trie
        before = b""
        for word in sorted(found):
            shared, most = 0, min(len(word), len(before), _HELD)
            while shared < most and word[shared] == before[shared]:
                shared += 1
            del last[shared + 1 :], open_[shared + 1 :]
            running, at = open_[shared], shared
            for byte in word[shared:]:
                token, on = -1, []
                for step in running:
                    node = step[1].get(byte)
                    if node is not None:
                        began = step[0]
                        on.append((began, node))
                        if token < 0 and (ending := node[END]) >= 0:
                            if not began:
                                token = ending
                            else:
                                fit = known.get(last[began] << 32 | ending)
                                if fit or (fit is None and fits(last[began], ending)):
                                    token = ending
                node = root[byte]
                on.append((at, node))
                last.append(token if token >= 0 else node[END])  # a single byte is the last token where no longer one is
                running = on
                at += 1
                if at <= _HELD:
                    open_.append(on)
            ids = []
            while at:
                ids.append(last[at])
                at -= length[last[at]]
            ids.reverse()
            yield word, _little(ids)
            before = word

    # texts

    def _odd(self, text: str) -> bool:
        """Whether a text has characters that Python's tables do not know: splitters of other Unicode versions may differ on them."""
        if text.isascii():
            return False
        new = set(text) - self._usual
        odd = any(unicodedata.category(c) == "Cn" for c in new)
        if not odd:
            self._usual |= new
        return odd

    def _learn(self, first: set[str], spaced: set[str], single: set[str]) -> tuple[ChainMap, ChainMap]:
        """The ids of stretches by themselves, and after a space; what is in `single` is a word that is split no further."""
        if len(self._of_word) + len(self._of_unit) + len(self._of_spaced) > CACHED:
            self._forget()
        kinds = ((single, self._of_unit, lambda u: [u]), (first, self._of_unit, self._words.findall), (spaced, self._of_spaced, lambda u: self._words.findall(" " + u)))
        split = [(u, words(u), side) for side, (units, known, words) in enumerate(kinds) for u in units if u not in known]
        new = {w for _, words, _ in split for w in words if w not in self._of_word}
        found = {word.decode(): ids for word, ids in self.words(w.encode() for w in new)}
        ids = ChainMap(found, self._of_word)
        long: tuple[dict[str, bytes], ...] = ({}, {}, {})
        for unit, words, side in split:
            (kinds[side][1] if len(unit) <= LONGEST_CACHED else long[side])[unit] = ids[words[0]] if len(words) == 1 else b"".join([ids[w] for w in words])
        self._of_word.update(found if max(map(len, new), default=0) <= LONGEST_CACHED else {w: x for w, x in found.items() if len(w) <= LONGEST_CACHED})
        return ChainMap(self._of_unit, long[0], long[1]), ChainMap(self._of_spaced, long[2])

    def encode(self, texts: Iterable[str | None]) -> Iterator[bytes]:
        """Each text's ids, little-endian unsigned 32-bit numbers."""
        held: list[str] = []
        size = 0
        for text in texts:
            held.append(text or "")
            size += len(held[-1])
            if size >= _TOGETHER:
                yield from self._group(held)
                held, size = [], 0
        yield from self._group(held)

    def _group(self, texts: list[str]) -> Iterator[bytes]:
        plans: list[list] = []
        first: set[str] = set()
        spaced: set[str] = set()
        single: set[str] = set()
        for text in texts:
            plan = []
            for k, piece in enumerate(self._added.split(text) if self._added and any(a in text for a in self.added) else [text]):
                if k % 2:
                    plan.append(self.added[piece])
                elif self._odd(piece):
                    words = [piece[a:b] for _, (a, b) in self._splitter.pre_tokenize_str(piece)]
                    single.update(words)
                    plan.append((words, []))
                elif _UNEVEN.search(piece):
                    units = _UNITS.findall(piece)
                    first.update(units)
                    plan.append((units, []))
                elif piece:
                    head, *rest = piece.split(" ")
                    heads = [head] if head else []
                    first.update(heads)
                    spaced.update(rest)
                    plan.append((heads, rest))
            plans.append(plan)
        alone, after_space = self._learn(first, spaced, single)
        for plan in plans:
            yield b"".join([_little([p]) if isinstance(p, int) else _looked_up(alone, p[0]) + _looked_up(after_space, p[1]) for p in plan])


#: Stretches that do not depend on what is before and after: white space and what follows it.
_UNITS = re.compile(r"\s*\S+|\s+")
#: A space that does not stand by itself before a character that is none.
_UNEVEN = re.compile(r" (?:\s|\Z)")


def _looked_up(ids: ChainMap, units: list[str]) -> bytes:
    try:
        return b"".join(map(ids.maps[0].__getitem__, units))
    except KeyError:  # one of them is too long to be remembered
        return b"".join(map(ids.__getitem__, units))


def _little(ids: list[int]) -> bytes:
    out = array("I", ids)
    if sys.byteorder != "little":
        out.byteswap()
    return out.tobytes()


def _numbers(ids: bytes) -> array:
    out = array("I")
    out.frombytes(ids)
    if sys.byteorder != "little":
        out.byteswap()
    return out


def _bytes_of_signs() -> dict[str, int]:
    """The printable signs by which files of this kind write bytes: Latin-1 signs for themselves, the others from U+0100 on in order."""
    shown = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + n): b for n, b in enumerate(hidden)}


def _tokens(given: dict) -> list[bytes]:
    """The bytes of each token of a tokenizer file, by its id."""
    byte_of = _bytes_of_signs()
    vocabulary, added = given["model"]["vocab"], {t["content"]: t["id"] for t in given["added_tokens"]}
    token = [b""] * (1 + max([*vocabulary.values(), *added.values()]))
    for word, number in vocabulary.items():
        token[number] = bytes(byte_of[c] for c in word)
    for word, number in added.items():
        token[number] = word.encode()
    return token


class Decoder:
    """Of a tokenizer file only what decoding takes."""

    def __init__(self, file: str = TOKENIZER_FILE):
        with open(public_tokenizers.path(file), encoding="utf-8") as f:
            self.token = _tokens(json.load(f))

    def __call__(self, ids: bytes | None) -> str:
        """The text of ids, given as little-endian unsigned 32-bit numbers."""
        return b"".join(map(self.token.__getitem__, _numbers(ids))).decode("utf-8", "replace") if ids else ""


_TOKENIZERS: dict[str, ByteBPE] = {}
_DECODERS: dict[str, Decoder] = {}


def tokenizer(file: str = TOKENIZER_FILE) -> ByteBPE:
    """This worker's tokenizer."""
    takes_turn("bpe_trie", _TOKENIZERS.clear)
    if file not in _TOKENIZERS:
        _TOKENIZERS[file] = ByteBPE(file)
        gc.freeze()  # the vocabulary stays; the collector need not go through it again
    return _TOKENIZERS[file]


def decoder(file: str = TOKENIZER_FILE) -> Decoder:
    """This worker's decoder."""
    if file not in _DECODERS:
        _DECODERS[file] = Decoder(file)
    return _DECODERS[file]


def encoded(docs: DataFrame, file: str = TOKENIZER_FILE) -> DataFrame:
    """doc_id, n_tokens, ids (little-endian unsigned 32-bit numbers) of every row."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(file)
        for b in batches:
            names, texts = b.column(0), b.column(1)
            done, found, size = 0, [], 0
            for ids in bpe.encode(t.as_py() for t in texts):
                found.append(ids)
                size += len(ids)
                if size >= _TOGETHER:  # the batches handed on are bounded by bytes, too
                    yield batch(names.slice(done, len(found)), found)
                    done, found, size = done + len(found), [], 0
            if found:
                yield batch(names.slice(done, len(found)), found)

    def batch(names: pa.Array, found: list[bytes]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([names, pa.array([len(x) // 4 for x in found], pa.int64()), pa.array(found, pa.binary())], ["doc_id", "n_tokens", "ids"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, n_tokens long, ids binary")


def decoded(rows: DataFrame, file: str = TOKENIZER_FILE) -> DataFrame:
    """doc_id, n_tokens, ids and the text that the ids stand for."""
    ship(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decode = decoder(file)
        for b in batches:
            size = pc.fill_null(pc.binary_length(b.column(2)), 0).to_numpy(zero_copy_only=False).cumsum()
            at = 0
            while at < b.num_rows:
                to = max(at + 1, int(size.searchsorted((size[at - 1] if at else 0) + 4 * _TOGETHER, "right")))
                part = b.slice(at, to - at)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array([decode(x.as_py()) for x in part.column(2)], pa.string())], ["doc_id", "n_tokens", "ids", "text"])
                at = to

    return rows.select("doc_id", "n_tokens", "ids").mapInArrow(run, "doc_id long, n_tokens long, ids binary, text string")


def op13_bpe_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = decoded(encoded(table(spark, sf_dir, "documents")))
    return rows.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"))
