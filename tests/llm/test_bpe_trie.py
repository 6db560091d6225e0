"""Trie encoding against the tokenizer itself, the two tokens' border against plain merging, and odd rows."""

from __future__ import annotations

import hashlib
import unicodedata

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tidemark.llm import bpe_trie
from tidemark.llm.bpe_trie import decoded, decoder, encoded, op13_bpe_roundtrip, tokenizer

ODD = [
    "", " ", "  ", "\n", "a  b", " a \n b ", "trailing ", "\ttab", "x<|endoftext|>y", "<|endoftext|><|endoftext|>", " <|endoftext|> ", "<|endoftext", "it's WE'LL they're 'sx",
    "a" * 3000, "aaa aaaa aaaaa " * 5, "-" * 1000, "ÃÂ" * 300, "= = ==" * 50, "\x1c \x1f x\x00y", "é 日本語 テスト 안녕 🙂🙂", "a  b   c", "x 　　y",
    "՘ \U00011de0\U0001e6c0a ͸", "½ ² Ⅷ 12 ٣", "�﻿", "a" + "́" * 200, "9" * 500 + "z" * 500, "don't\n\n\n  stop  \n",
]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def ids_of(library, text):
    return np.asarray(library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def test_odd_texts_and_cleared_caches(library, monkeypatch):
    bpe = bpe_trie.ByteBPE()
    assert list(bpe.encode(ODD)) == [ids_of(library, t) for t in ODD]
    monkeypatch.setattr(bpe_trie, "CACHED", 20)
    monkeypatch.setattr(bpe_trie, "LONGEST_CACHED", 3)
    monkeypatch.setattr(bpe_trie, "_TOGETHER", 50)
    monkeypatch.setattr(bpe_trie, "_HELD", 4)
    assert list(bpe.encode([*ODD, None, *ODD])) == [ids_of(library, t) for t in [*ODD, "", *ODD]]


@settings(max_examples=400, deadline=None)
@given(st.text(st.one_of(st.sampled_from("abeinrstE' .,\n\t019-é日"), st.characters(exclude_categories=["Cs"])), max_size=60))
def test_any_text(text):
    library = test_any_text.__dict__.setdefault("library", Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")))
    found = next(tokenizer().encode([text]))
    assert found == ids_of(library, text)
    assert decoder()(found) == text


MADE: dict[int, int] = {}


def plain_merging(bpe, data):
    """Merges the pair of least rank, the leftmost first, until none is left."""
    tokens = [bpe.root[b][bpe_trie.END] for b in data]
    made = MADE or MADE.update({(a << 32 | b): token for token, (a, b) in bpe.parts.items()}) or MADE
    while True:
        ranked = [(bpe.merge[key], i) for i in range(len(tokens) - 1) if (key := tokens[i] << 32 | tokens[i + 1]) in bpe.merge]
        if not ranked:
            return tokens
        i = min(ranked)[1]
        tokens[i : i + 2] = [made[tokens[i] << 32 | tokens[i + 1]]]


def test_borders_and_tokens_like_plain_merging():
    bpe = tokenizer()
    rng = np.random.default_rng(5)
    for t in [*rng.integers(0, 50256, 1500).tolist(), *range(0, 300)]:
        assert plain_merging(bpe, bpe.token[t]) == [t]  # so a prefix that is a token is its own last token
    short = [t for t in range(50256) if bpe.length[t] <= 3]
    for a, b in rng.choice(short, (4000, 2)).tolist():
        assert bpe.fits(a, b) == (plain_merging(bpe, bpe.token[a] + bpe.token[b]) == [a, b])


def test_shared_prefixes_are_worked_out_once(monkeypatch):
    bpe = bpe_trie.ByteBPE()
    asked = []
    monkeypatch.setattr(bpe, "fits", lambda a, b, own=bpe.fits: asked.append((a, b)) or own(a, b))
    list(bpe.words([b"xqzjkvwpy" + bytes([97 + k]) for k in range(26)]))
    prefix = len(asked)
    list(bpe_trie.ByteBPE().words([b"xqzjkvwpy"]))
    assert prefix < 26 * 12
    words = [b"interna", b"international", b"internationalism", b"internet", b"in"]
    assert dict(bpe.words(words)) == {w: np.asarray(plain_merging(bpe, w), "<u4").tobytes() for w in words}


def test_unknown_characters_are_all_that_splitters_differ_in(library):
    """Characters that Python's tables know are split alike by both splitters."""
    bpe = tokenizer()
    chars = [c for c in map(chr, [*range(0x3000), *range(0xA000, 0xB000), *range(0x10000, 0x12000), *range(0x1D000, 0x1F000)]) if unicodedata.category(c) not in ("Cn", "Cs")]
    texts = ["a" + c + "a 1" + c + "1 !" + c + "! " + c for c in chars]
    for text in texts:
        assert bpe._words.findall(text) == [text[a:b] for _, (a, b) in bpe._splitter.pre_tokenize_str(text)]


def test_query_on_the_table(spark, sf, library):
    rows = spark.read.parquet(f"{sf}/documents.parquet").collect()
    want = {}
    for r in rows:
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        text = library.decode(ids, skip_special_tokens=False)
        want[r.doc_id] = (len(ids), hashlib.sha256(np.asarray(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in op13_bpe_roundtrip(spark, sf).collect()}
    assert got == want


def test_odd_rows_and_columns(spark, library):
    rows = [(1, "some text", "x", 7), (1, "some text", "x", 7), (None, None, "y", 8), (None, "", None, 9), (2, "word " * 60_000, "z", 1), (3, "y" * 100_000, "z", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string, n_tokens long")
    found = decoded(encoded(docs)).collect()
    assert sorted((r.doc_id or 0, r.text, bytes(r.ids)) for r in found) == sorted((r[0] or 0, r[1] or "", ids_of(library, r[1] or "")) for r in rows)
    assert all(r.n_tokens * 4 == len(r.ids) for r in found)
    assert encoded(docs.limit(0)).count() == 0 and decoded(encoded(docs.limit(0))).count() == 0


@pytest.mark.parametrize("ids", [[159], [50256, 0, 65], [198, 3419, 250], list(range(180, 256))])
def test_decoding_any_ids(library, ids):
    assert decoder()(np.asarray(ids, "<u4").tobytes()) == library.decode(ids, skip_special_tokens=False)
    assert decoder()(None) == ""
