import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from storelens.llm import packing as P
from storelens.llm import queries as Q
from storelens.llm.base import table
from tests.llm.conftest import SCHEMA, as_rows

PATH = public_tokenizers.path("word_bpe_49k.json")
SF = "/root/testdata/sf0.001"


def library_ids(texts):
    found = Tokenizer.from_file(PATH).encode_batch([t or "" for t in texts], add_special_tokens=False)
    return [e.ids + [2] for e in found]


def power(n):
    return n & (n - 1) == 0


def check_sequences(rows, context=4096):
    """Gapless, at most ``context``, no padding; returns the number of sequences."""
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append(r)
    for own in by.values():
        own.sort(key=lambda r: r.offset)
        assert [r.offset for r in own] == np.cumsum([0] + [r.length for r in own])[:-1].tolist()
        total = sum(r.length for r in own)
        assert total == own[0].sequence_tokens <= context and power(total)
        assert len({r.step_id for r in own}) == 1
    return len(by)


@pytest.mark.parametrize("seed", range(6))
def test_pack_places_every_id_once(seed):
    rng = random.Random(seed)
    lengths = [rng.choice([1, 2, 3, 17, 255, 256, 257, 700, 2049, 4095, 4096, rng.randrange(1, 4097)])
               for _ in range(rng.choice([1, 2, 5, 300]))]
    sequences = P.pack(lengths)
    seen = [np.zeros(n, int) for n in lengths]
    for s in sequences:
        assert power(sum(n for _, _, n in s)) and sum(n for _, _, n in s) <= 4096
        for i, a, n in s:
            assert n > 0
            seen[i][a:a + n] += 1
    assert all((x == 1).all() for x in seen)
    assert sum(sum(n for _, _, n in s) < 256 for s in sequences) <= 8
    assert P.pack(lengths) == sequences


def test_pieces_that_fit_are_not_cut():
    assert sorted(map(len, P.pack([3000, 1096, 2000, 48]))) == [2, 2]
    assert P.pack([4096, 1024]) == [[(0, 0, 4096)], [(1, 0, 1024)]]
    assert P.pack([]) == []


def test_steps_have_about_the_same_ids_and_cost():
    rng = random.Random(3)
    sequences = P.pack([min(4096, int(rng.expovariate(1 / 500)) + 1) for _ in range(6000)])
    of = P.steps(sequences, 1 << 18)
    tokens, cost = np.zeros(max(of) + 1), np.zeros(max(of) + 1)
    for k, s in zip(of, sequences):
        tokens[k] += sum(n for _, _, n in s)
        cost[k] += sum(n * n for _, _, n in s)
    assert len(tokens) > 5 and tokens.max() - tokens.min() <= 4096 and cost.max() < 1.1 * cost.min()


def test_query_equals_the_library(spark):
    rows = Q.QUERIES["op11_pack_sequences"](spark, SF).collect()
    docs = table(spark, SF, "documents").select("doc_id", "text").collect()
    ids = dict(zip([d.doc_id for d in docs], library_ids([d.text for d in docs])))
    check_sequences(rows)
    done = {}
    for r in rows:
        own = ids[r.doc_id][r.start:r.start + r.length]
        assert r.doc_tokens == len(ids[r.doc_id]) and len(own) == r.length > 0
        assert r.ids_crc32 == zlib.crc32(np.array(own, "<u4").tobytes())
        done.setdefault(r.doc_id, []).append((r.start, r.length))
    assert set(done) == set(ids)
    for k, pieces in done.items():
        pieces.sort()
        assert pieces[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(pieces, pieces[1:] + [(len(ids[k]), 0)]))


def test_many_groups_and_ids(spark):
    docs = table(spark, SF, "documents")
    rows = P.pack_documents(docs, PATH, tiers=(64, 128, 512), group_tokens=4096, step_tokens=1024).collect()
    check_sequences(rows, 512)
    assert len({r.sequence_id >> 24 for r in rows}) > 10
    assert all(zlib.crc32(r.ids) == r.ids_crc32 and len(r.ids) == 4 * r.length for r in rows)
    by = {}
    for r in sorted(rows, key=lambda r: r.start):
        by[r.doc_id] = by.get(r.doc_id, b"") + r.ids
    some = docs.select("doc_id", "text").limit(40).collect()
    for d, ids in zip(some, library_ids([d.text for d in some])):
        assert by[d.doc_id] == np.array(ids, "<u4").tobytes()


def test_odd_rows(spark, odd, empty, clashing):
    rows = P.pack_documents(odd, PATH).collect()
    check_sequences(rows)
    per_doc = {}
    for r in rows:
        per_doc[r.doc_id] = per_doc.get(r.doc_id, 0) + r.length
    docs = odd.select("doc_id", "text").collect()
    want = {}
    for d, ids in zip(docs, library_ids([d.text for d in docs])):
        want[d.doc_id] = want.get(d.doc_id, 0) + len(ids)
    assert per_doc == want and per_doc[3] == 1 and None in per_doc
    assert P.pack_documents(empty, PATH).count() == 0
    assert as_rows(P.pack_documents(clashing, PATH).select("doc_id", "doc_tokens").distinct()) == as_rows(
        P.pack_documents(odd, PATH).select("doc_id", "doc_tokens").distinct())
    big = spark.createDataFrame([((1 << 60) + 1, "one", None, None, 1), (None, None, None, None, 1)], SCHEMA)
    assert {r.doc_id for r in P.pack_documents(big, PATH).collect()} == {(1 << 60) + 1, None}
    assert P.pack_documents(big.where("text is null"), PATH, end_id=None).count() == 0
    with pytest.raises(ValueError):
        P.pack_documents(odd, PATH, tiers=(100, 512))
