"""Token files and packing against whole-text encoding and the definition."""

from __future__ import annotations

import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tidemark.llm import packing, simple8b, token_files
from tidemark.llm.token_ids import WordEncoder

SCHEMA = "doc_id long, text string, ids string, `start` long, open boolean"
TOKENIZER = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
ODD = ["The the THE, tHe. A\u030a a\u030a. H\u0331, h\u0331 don't DON'T, x., 9. ,", "<|ENDOFTEXT|> A, b.", "", None, " \t\n", "a", "İx ſ ́e é \x1c  x y", "it's <|endoftext|> x<|startoftext|>y it'S", "漢字 ééé\x0bz", "w" * 700 + " end " + "w" * 700, "rep " * 9000]


def whole(text, end):
    return [*TOKENIZER.encode(text or "", add_special_tokens=False).ids, end]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 70000), st.integers(0, 3), st.integers(0, 2**64 - 1)), max_size=300), st.integers(1, 40))
def test_simple8b_round_trip(values, times):
    numbers = np.asarray(values * times, np.uint64)
    segment = simple8b.encode(numbers)
    assert (simple8b.decode(segment) == numbers).all()
    blocks = -(-len(numbers) // simple8b.BLOCK)
    for b in range(blocks):
        part = simple8b.decode(segment, range(b, b + 1))
        assert (part == numbers[b * simple8b.BLOCK : (b + 1) * simple8b.BLOCK]).all()


def test_simple8b_packs_small_numbers():
    assert len(simple8b.encode(np.ones(6000, np.uint64))) < 16 + 8 + 8 * 105
    assert len(simple8b.encode(np.full(4096, 2**15 - 1, np.uint64))) == 16 + 4 + 8 * 1024


def test_simple8b_rejects_other_bytes():
    with pytest.raises(ValueError):
        simple8b.decode(b"nope" + bytes(20))


@settings(max_examples=200, deadline=None)
@given(st.one_of(st.text(max_size=80), st.lists(st.sampled_from(["A", "a", "b.", ",", "1", "é", "ab###", "x'.", "9%", "!!", "|", "12.", "É", "ß.", "ö,", "»", "ÿ", "÷", "µ", "ñ", "\u0331", "H", "'S", " ", ".", "<|", "|>", "\u00a0"]), max_size=30).map("".join)))
def test_words_encode_like_whole_texts(text):
    text = text.encode("utf-8", "ignore").decode()
    assert ENCODE(text.encode()).tolist() == whole(text, 0)[:-1]


ENCODE = WordEncoder()


def test_odd_texts_encode_like_whole_texts():
    for _ in range(2):
        for text in ODD:
            assert ENCODE((text or "").encode()).tolist() == whole(text, 0)[:-1]


def odd_docs(spark):
    rows = [(i * 3 % 7, t, "x", 5, True) for i, t in enumerate(ODD)] + [(None, "null id", None, None, None), (4, "a", "x", 5, True), (4, "a", "x", 5, True)]
    return rows, spark.createDataFrame(rows, SCHEMA).repartition(3)


def check_files(rows, got, end=2):
    expected = sorted((x for x in rows), key=lambda x: (x[0] is not None, x[0] or 0))
    assert [x["doc_id"] for x in got] == [x[0] for x in expected]
    at = 0
    for x in got:
        assert x["start"] == at
        at += x["n_tokens"]
    want = sorted(((x[0] is not None, x[0] or 0, zlib.crc32(np.asarray(whole(x[1], end), "<u4").tobytes())) for x in rows))
    assert want == sorted((x["doc_id"] is not None, x["doc_id"] or 0, x["ids_crc32"]) for x in got)


def test_token_files_of_odd_rows(spark, tmp_path):
    rows, docs = odd_docs(spark)
    token_files.segments(docs).write.parquet(str(tmp_path / "f"))
    found = token_files.documents(spark.read.parquet(str(tmp_path / "f"))).selectExpr("doc_id", "start", "n_tokens", "crc32(ids) ids_crc32")
    check_files(rows, sorted(found.collect(), key=lambda r: r["start"]))


def test_token_files_query(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    check_files(rows, sorted(token_files.op5_token_files(spark, sf).collect(), key=lambda r: r["start"]))


def check_packing(rows, got, capacity=4096):
    for x in got:
        assert 0 < x["length"] <= capacity
    by_sequence = {}
    for x in got:
        by_sequence.setdefault(x["sequence_id"], []).append((x["offset"], x["length"]))
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    want = []
    for doc_id, text, *_ in rows:
        ids = np.asarray(whole(text, 1), "<u4")
        want += [(str(doc_id), p, s, min(capacity, len(ids) - s), zlib.crc32(ids[s : s + capacity].tobytes())) for p, s in enumerate(range(0, len(ids), capacity))]
    assert sorted(want) == sorted((str(x["doc_id"]), x["piece"], x["start"], x["length"], x["ids_crc32"]) for x in got)
    return len(by_sequence), sum(x[3] for x in want)


def test_packing_of_odd_rows(spark):
    rows, docs = odd_docs(spark)
    got = packing.pack(docs).selectExpr("doc_id", "piece", "start", "length", "crc32(ids) ids_crc32", "sequence_id", "offset").collect()
    n, total = check_packing(rows, got)
    assert n <= -(-total // 4096) + 1


def test_packing_query_is_tight(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    n, total = check_packing(rows, packing.op6_packing(spark, sf).collect())
    assert n <= total / 4096 * 1.03 + 1


def test_few_bins_still_place_everything():
    bins, sizes = packing.OpenBins(100, 3), [60, 70, 80, 30, 40, 20, 50, 100, 10, 10]
    used = {}
    for s in sizes:
        k, offset, _ = bins.place(s)
        assert used.get(k, 0) == offset
        used[k] = offset + s
        assert bins.open <= 3 and used[k] <= 100
    assert sum(used.values()) == sum(sizes)


def test_every_evicted_bin_is_reported_as_closed():
    bins, out = packing.OpenBins(100, 3), set()
    for s in [60, 70, 80, 100, 100, 90, 95, 100, 5, 99, 100] * 5:
        closed = bins.place(s)[2]
        out |= set() if closed is None else {closed}
        assert bins.made - bins.open == len(out)
    bins = packing.OpenBins(100, 3)
    assert [bins.place(s)[2] for s in (60, 70, 80, 100)] == [None, None, None, 3]
    assert bins.open == 3


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert packing.pack(none).count() == 0
    assert token_files.documents(token_files.segments(none)).count() == 0
