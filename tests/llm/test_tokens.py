import random
import zlib

import numpy as np
import public_tokenizers
import pytest

from storelens.llm import token_files as TF
from storelens.llm import tokens as T
from tests.llm.conftest import as_rows

PATH = public_tokenizers.path("word_bpe_49k.json")


def reference(text):
    return T.tokenizer(PATH).encode(text or "", add_special_tokens=False).ids


def test_encoder_equals_the_library_on_odd_signs():
    draw = random.Random(3)
    parts = ["a", "É", "ß", "'s", "'RE", "'LL", "'", "\"", "1", "²", "Ⅷ", " ", "\n", "\x1c", "\x85", "​", "　",
             "İ", "Σ", "漢", "😀", "é", "<|endoftext|>", "<|", "don't", "''s", "'d've", "_", "͸", "﻿", "٣"]
    texts = ["".join(draw.choice(parts) for _ in range(draw.randint(0, 12))) for _ in range(3000)]
    encoder = T.Encoder(PATH, True, 300)
    for a in range(0, len(texts), 250):
        for text, got in zip(texts[a:a + 250], encoder.ids(texts[a:a + 250])):
            assert list(got) == reference(text), text


def test_counts_equal_the_library(odd, clashing, empty):
    want = {(r.doc_id, r.text): len(reference(r.text)) for r in odd.collect()}
    got = T.token_counts(odd, PATH, limit=20)
    assert sorted(r.n_tokens for r in got.collect()) == sorted(
        n for r in odd.collect() for n in [want[r.doc_id, r.text]])
    by_id = {r.doc_id: r for r in got.collect()}
    assert by_id[3].n_tokens == 0 and by_id[3].n_bytes == 0 and not by_id[3].over_limit
    assert by_id[8].over_limit
    assert as_rows(T.token_counts(clashing, PATH, limit=20)) == as_rows(got)
    assert T.token_counts(empty, PATH).count() == 0


def test_files_round_trip(spark, odd, clashing, empty):
    out = TF.shared_folder(spark, "test-tokens")
    manifest = TF.write_token_files(odd, out, PATH, end_id=2)
    assert manifest.agg({"n_docs": "sum"}).first()[0] == odd.count()
    got = TF.read_token_files(spark, out, with_ids=True).collect()
    rows = sorted(odd.collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.text or ""))
    start = 0
    for want, have in zip(rows, sorted(got, key=lambda r: r.start)):
        ids = reference(want.text) + [2]
        assert (have.doc_id, have.start, have.n_tokens, list(have.ids)) == (want.doc_id, start, len(ids), ids)
        assert have.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
        start += len(ids)
    other = TF.shared_folder(spark, "test-tokens")
    TF.write_token_files(clashing, other, PATH, end_id=2)
    assert as_rows(TF.read_token_files(spark, other)) == as_rows(TF.read_token_files(spark, out))
    none = TF.shared_folder(spark, "test-tokens")
    TF.write_token_files(empty, none, PATH)
    assert TF.read_token_files(spark, none).count() == 0


def test_reading_refuses_files_that_do_not_match(spark, odd):
    out = TF.shared_folder(spark, "test-tokens")
    TF.write_token_files(odd, out, PATH)
    folder = TF._local(out)
    import glob

    path = glob.glob(f"{folder}/part-*.off")[0]
    with open(path, "ab") as f:
        f.write(b"\0" * 8)
    with pytest.raises(Exception, match="manifest"):
        TF.read_token_files(spark, out).collect()


def test_summary_keeps_what_is_frequent():
    draw = np.random.default_rng(5)
    summary, true, seen = T.Summary(50), np.zeros(5000, np.int64), 0
    for _ in range(40):
        some, n = np.unique(np.minimum(draw.zipf(1.3, 2000), 4999), return_counts=True)
        true[some] += n
        seen += n.sum()
        summary.add(some.astype(np.uint64), n)
        assert len(summary.hashes) <= 50
    have = dict(zip(summary.hashes.tolist(), summary.n.tolist()))
    for i, n in enumerate(true):
        assert n - seen / 51 <= have.get(i, 0) <= n


def test_frequent_table_counts_all_texts(spark):
    long = "x" * 300
    rows = [(i, f"common words {i}" if i < 400 else f"{long} {long} {long}") for i in range(450)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    points = np.frombuffer(f"common{long}".encode("utf-32-le"), "<u4")
    wanted = T.span_hashes(points, np.array([0, 6]), np.array([6, 306]))
    for parts in (1, 7):
        table = T.frequent_lengths(docs.repartition(parts), PATH, table_size=10)
        assert len(table.hashes) == 10
        assert table.lengths[table.find(wanted)].tolist() == [len(reference("common")), len(reference(long))]
    # tables too small for the vocabulary never change a count
    got = T.token_counts(docs.repartition(3), PATH, table_size=5, summary_size=3, cache_size=4)
    assert {r.doc_id: r.n_tokens for r in got.collect()} == {i: len(reference(t)) for i, t in rows}
