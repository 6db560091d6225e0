"""The pipeline's stages, each against its definition on what the stage before kept."""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline as C
from tests.llm.test_mixing import plain_targets
from tests.llm.test_near_dedup import brute
from tests.llm.test_secret_scan import plain
from tidemark.llm import quality_classifier, secret_scan

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def kept(spark, sf, tmp_path_factory):
    """What each stage returned, by name, documents first."""
    at = tmp_path_factory.mktemp("stages")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = {"documents": docs}
    for name, stage in C.STAGES:
        stage(spark, docs, sf).write.parquet(str(at / name))
        out[name] = docs = spark.read.parquet(str(at / name))
    return out


def rows(frame):
    return sorted(map(tuple, frame.select(*COLUMNS).collect()))


def test_columns(kept):
    for name, _ in C.STAGES[:-1]:
        assert kept[name].columns == COLUMNS


def test_quality_keeps_what_it_predicts_good(spark, sf, kept):
    good = {r.doc_id for r in quality_classifier.op1_quality_classifier(spark, sf).collect() if r.predicted}
    assert rows(kept["quality_classifier"]) == [r for r in rows(kept["documents"]) if r[0] in good]


def test_one_of_each_group_stays(kept):
    before = rows(kept["quality_classifier"])
    stay = {doc_id for doc_id, _, _, keeps in brute([r[:2] for r in before], C.SIMILARITY) if keeps}
    assert rows(kept["near_dedup"]) == [r for r in before if str(r[0]) in stay]


def test_secrets_go_and_documents_stay(kept):
    before, after = rows(kept["near_dedup"]), rows(kept["secret_scan"])
    assert [r[0] for r in before] == [r[0] for r in after]
    for a, b in zip(before, after, strict=True):
        assert plain(b[1]) == "" and b[4] == len(b[1]) and a[2:4] == b[2:4]
        assert a == b or secret_scan.scan(a[1])[1]


def test_mixing_repeats_towards_targets(kept):
    before = rows(kept["secret_scan"])
    taken = Counter(r[0] for r in rows(kept["mixing"]))
    size = {r[0]: len(r[1].encode().split()) for r in before}
    sizes, got = defaultdict(int), defaultdict(int)
    for r in before:
        sizes[r[3]] += size[r[0]]
        got[r[3]] += size[r[0]] * taken[r[0]]
        assert taken[r[0]] <= 3
    want = plain_targets(sizes)
    for s in sizes:
        assert abs(got[s] - want[s]) <= max(size[r[0]] for r in before if r[3] == s) / 2 + 1
    assert set(rows(kept["mixing"])) <= set(before)


def test_packing_holds_every_row_once(kept):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = Counter()
    for r in rows(kept["mixing"]):
        ids = np.asarray([*tokenizer.encode(r[1], add_special_tokens=False).ids, 1], "<u4")
        want.update((r[0], k, zlib.crc32(ids[s : s + 4096].tobytes())) for k, s in enumerate(range(0, len(ids), 4096)))
    got = kept["packing"].collect()
    assert want == Counter((r.doc_id, r.piece, r.ids_crc32) for r in got)


def test_run_gives_the_last_stages_rows(spark, sf, kept):
    key = lambda f: sorted(map(tuple, f.select("doc_id", "piece", "start", "length", "ids_crc32").collect()))
    assert key(C.run(spark, sf)) == key(kept["packing"])


def test_odd_and_empty_tables(spark, sf):
    schema = "doc_id long, text string, lang string, source string, n_chars long, score double, kept string, _kept string, _text long, id string, row int, digest string"
    odd = [(1, None, None, None, None, None, None), (2, "", "", "", 0, 0.5, ""), (None, "a b " * 60, "en", "s", 1, 0.1, "x"), (3, "A b " * 60, "en", "s", 1, 0.1, "x"), (3, "A b " * 60, "en", "s", 1, 0.1, "x")]
    odd = [(*r, "k", 7, "i", 3, "t") for r in odd]
    for some in (odd, []):
        docs = spark.createDataFrame(some, schema)
        for _, stage in C.STAGES[:-1]:
            out = stage(spark, docs, sf)
            assert out.dtypes == docs.dtypes
            out.collect()
        C.pack_sequences(spark, docs, sf).collect()
