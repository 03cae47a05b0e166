import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from storelens.llm import alignment as A
from storelens.llm import queries as Q
from storelens.llm.base import table
from tests.llm.conftest import SCHEMA, as_rows

PATHS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def libraries():
    a = Tokenizer.from_file(PATHS[0])
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=PATHS[1])
    of = A.byte_characters()
    tokens_a = {i: bytes(of[c] for c in t) for t, i in a.get_vocab().items() if all(c in of for c in t)}
    return a, b, tokens_a


def brute(text, libraries):
    """Groups and links by comparing every two byte ranges, on the whole text."""
    a, b, tokens_a = libraries
    if not text:
        return [], []
    ids_a, ids_b = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
    bytes_a = [tokens_a[i] for i in ids_a]
    bytes_b = [bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode()
               for i, p in ((i, b.id_to_piece(i)) for i in ids_b)]
    if b"".join(bytes_a) != (" " + text).encode() or b"".join(bytes_b) != (" " + text).encode():
        return [], []
    ends_a, ends_b = np.cumsum([len(x) for x in bytes_a]), np.cumsum([len(x) for x in bytes_b])
    starts_a, starts_b = ends_a - [len(x) for x in bytes_a], ends_b - [len(x) for x in bytes_b]
    links = []
    for j in range(len(ids_b)):
        i = int(np.searchsorted(ends_a, starts_b[j], side="right"))
        while i < len(ids_a) and starts_a[i] < ends_b[j]:
            links.append((ids_b[j], ids_a[i]))
            i += 1
    groups, i, j = [], 0, 0
    for end in sorted(set(ends_a.tolist()) & set(ends_b.tolist())):
        to_a, to_b = int(np.searchsorted(ends_a, end)) + 1, int(np.searchsorted(ends_b, end)) + 1
        groups.append((ids_a[i:to_a], ids_b[j:to_b]))
        i, j = to_a, to_b
    return groups, links


def expected(rows, libraries):
    """Of (id, text): the digest columns by brute force over all of them."""
    each = [(k, *brute(t, libraries)) for k, t in rows]
    count = Counter(x for _, _, links in each for x in links)
    highest = {}
    for (b, _), n in count.items():
        highest[b] = max(n, highest.get(b, 0))
    out = []
    for k, groups, links in each:
        text = ";".join(f"{','.join(map(str, a))}|{','.join(map(str, b))}" for a, b in groups)
        out.append((k, sum(len(a) for a, _ in groups), sum(len(b) for _, b in groups), len(groups), len(links),
                    sum(count[x] == highest[x[0]] for x in links), sum(count[x] for x in links),
                    hashlib.sha256(text.encode()).hexdigest() if groups else ""))
    return sorted(out, key=str), count, highest


def got(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum",
                                               "groups_sha256").collect()), key=str)


def test_query_equals_brute_force(spark, libraries):
    rows = [tuple(r) for r in table(spark, SF, "documents").select("doc_id", "text").collect()]
    assert got(Q.QUERIES["op13_align_tokenizers"](spark, SF)) == expected(rows, libraries)[0]


@pytest.mark.parametrize("run_records,radices,fan_in", [(500, 4, 2), (5_000, 32, 3), (1 << 30, 1, 64)])
def test_any_runs_radices_and_rounds(spark, libraries, run_records, radices, fan_in):
    docs = table(spark, SF, "documents").where("length(text) < 3000").repartition(6)
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    parameters = dict(run_records=run_records, radices=radices, fan_in=fan_in)
    want, count, highest = expected(rows, libraries)
    assert got(A.align_tokens(docs, *PATHS, **parameters)) == want
    pairs = A.pair_counts(docs, *PATHS, **parameters).collect()
    assert {(r.b, r.a): r.n for r in pairs} == count and len(pairs) == len(count)
    assert all(r.best == (r.n == highest[r.b]) for r in pairs)


def test_blocks_of_the_merge(monkeypatch):
    monkeypatch.setattr(A, "_BLOCK", 3)
    rng = random.Random(4)
    total, blobs = Counter(), []
    for _ in range(9):
        own = Counter({(min(rng.randrange(12), 7) << 16) | rng.randrange(40): rng.randrange(1, 9) for _ in range(60)})
        total.update(own)
        pairs = np.zeros(len(own), A._PAIR)
        keys = np.array(sorted(own), np.uint64)
        pairs["step"], pairs["n"] = A._steps(keys), [own[int(k)] for k in keys]
        blobs.append(A._packed(pairs))
    found, sides = Counter(), []
    for keys, n in A.merge_runs(blobs, 16):
        sides.append({int(k) >> 16 for k in keys})
        found.update(dict(zip(keys.tolist(), n.tolist())))
    assert found == total and sum(map(len, sides)) == len(set().union(*sides))


def test_words_are_aligned_as_in_the_whole_text(libraries):
    rng = random.Random(7)
    pieces = ["the", " ", "  ", "\n", "\t", "don't", "12345", "naïve", "漢字", "😀", "...", " ", "a" * 40, " ",
              "<|endoftext|>", "</s>", "<0x41>", "é", "\x1c", "​", "ß", "x_y", "\x85", " \n ", "!", "▁", "word.", "word,\nNext", "x.y", "a\n", "\nb", "¿qué?", "3.5", "²."]
    texts = ["".join(rng.choice(pieces) + rng.choice(["", " "]) for _ in range(rng.randrange(1, 30))) for _ in range(600)]
    aligner = A.Aligner(*PATHS, cache_size=150)
    sizes, digests, groups, row, key = aligner.align(texts, True)
    for i, t in enumerate(texts):
        want_groups, want_links = brute(t, libraries)
        assert groups[i] == ";".join(f"{','.join(map(str, a))}|{','.join(map(str, b))}" for a, b in want_groups)
        mine = Counter((int(k) >> aligner.shift, int(k) & ((1 << aligner.shift) - 1)) for k in key[row == i])
        assert mine == Counter(want_links) and sizes[i, 3] == len(want_links)
    assert any(s[3] == 0 for s in sizes)  # the piece mark as a character


def test_odd_rows(spark, odd, empty, clashing, libraries):
    rows = [tuple(r) for r in odd.select("doc_id", "text").collect()]
    assert got(A.align_tokens(odd, *PATHS)) == expected(rows, libraries)[0]
    assert A.align_tokens(empty, *PATHS).count() == 0 and A.pair_counts(empty, *PATHS).count() == 0
    assert as_rows(A.align_tokens(clashing, *PATHS)) == as_rows(A.align_tokens(odd, *PATHS))
    blank = spark.createDataFrame([(1, None, None, None, 1), (2, "", None, None, 1), (3, "a▁b", None, None, 1)], SCHEMA)
    assert got(A.align_tokens(blank, *PATHS)) == [(i, 0, 0, 0, 0, 0, 0, "") for i in (1, 2, 3)]
    texts = A.align_tokens(odd.where(F.col("doc_id") == 1), *PATHS, with_groups=True).first()
    assert hashlib.sha256(texts.groups.encode()).hexdigest() == texts.groups_sha256
