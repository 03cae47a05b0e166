import random
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from storelens.llm import near_copies as N
from tests.llm.conftest import PROSE

SPACES = " \t\n\x0b\x0c\r"


def shingles(text):
    for c in SPACES[1:]:
        text = text.replace(c, " ")
    w = [x for x in (text or "").split(" ") if x]
    return Counter(tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter()


def similar(a, b):
    least = sum(min(n, b[k]) for k, n in a.items())
    most = sum(a.values()) + sum(b.values()) - least
    return bool(most) and 5 * least >= 4 * most


def brute(rows):
    """Classes by all pairs."""
    ids = [r[0] for r in rows]
    sets = [shingles(r[1] or "") for r in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (rows[i][1] or "") == (rows[j][1] or "") or similar(sets[i], sets[j]):
                a, b = find(i), find(j)
                lo, hi = (a, b) if ids[a] < ids[b] else (b, a)
                root[hi] = lo
    return {ids[i]: ids[find(i)] for i in range(len(rows))}


@pytest.mark.parametrize("paired, block", [(N.PAIRED, N.BLOCK), (1, 16)])
def test_chains_copies_and_hot_groups(spark, monkeypatch, paired, block):
    monkeypatch.setattr(N, "PAIRED", paired)
    monkeypatch.setattr(N, "BLOCK", block)
    draw = random.Random(1)
    words = ["".join(draw.choice("abcdefgh") for _ in range(5)) for _ in range(4000)]
    base = [draw.choice(words) for _ in range(120)]
    rows, at = [], 0
    chain = list(base)
    for _ in range(25):  # each link changes two more words: only neighbours are similar in the end
        rows.append((at, " ".join(chain)))
        at += 1
        i = draw.randrange(len(chain))
        chain[i] = draw.choice(words)
    for _ in range(60):  # a hot group around one text
        other = list(base)
        other[draw.randrange(120)] = draw.choice(words)
        rows.append((at, " ".join(other)))
        at += 1
    for _ in range(40):
        rows.append((at, "copy of this text again and again"))
        at += 1
    for _ in range(30):
        rows.append((at, " ".join(draw.choice(words) for _ in range(80))))
        at += 1
    got = N.near_duplicate_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.class_id for r in got} == brute(rows)
    assert sum(r.kept for r in got) == len(set(brute(rows).values()))


@settings(max_examples=25, deadline=None)
@given(st.integers(0, 10 ** 6), st.floats(0.3, 0.95))
def test_signatures_estimate_the_weighted_index(seed, share):
    draw = np.random.default_rng(seed)
    n = 200
    a = draw.integers(0, 1 << 63, n).astype(np.uint64)
    b = np.where(draw.random(n) < share, a, draw.integers(0, 1 << 63, n).astype(np.uint64))
    wa, wb = draw.uniform(0.2, 9, n), draw.uniform(0.2, 9, n)
    k = 512
    sig = N.dart_signatures(np.concatenate([a, b]), np.repeat([0, 1], n), np.concatenate([wa, wb]), 2, k)
    same = a == b
    least = np.minimum(wa, wb)[same].sum()
    true = least / (wa.sum() + wb.sum() - least)
    assert abs((sig[0] == sig[1]).mean() - true) < 5 * np.sqrt(max(true * (1 - true), 0.01) / k)
    alone = N.dart_signatures(a, np.zeros(n, int), wa, 1, k)
    assert (alone[0] == sig[0]).all()


def test_odd_rows(spark, odd, clashing, empty):
    got = N.near_duplicate_classes(clashing)
    by = {r.doc_id: r.class_id for r in got.collect()}
    assert got.count() == odd.count()
    assert by[1] == by[2] == 1 and by[3] == by[4] == 3 and by[5] == 5 and by[7] == 7 and by[None] is None
    assert N.near_duplicate_classes(empty).count() == 0
    left = N.drop_near_duplicates(clashing)
    assert left.columns == clashing.columns
    ids = [r.doc_id for r in left.collect()]
    assert sorted(i for i in ids if i) == [1, 3, 5, 7, 8, 9, 10, 11] and ids.count(None) == 1
    repeated = spark.createDataFrame([(1, PROSE, 1), (1, PROSE, 2), (1, "other", 3)], "doc_id long, text string, n int")
    assert [tuple(r) for r in N.drop_near_duplicates(repeated).collect()] == [(1, "other", 3)]


def test_rows_are_told_apart_by_text(spark):
    rows = [(None, "lone words here", 1), (None, PROSE, 2), (None, "quite another text of some words", 3),
            (None, "lone words here", 4), (3, "a third text that stands under this id", 5), (9, "one text under nine", 6),
            (9, "a third text that stands under this id", 7), (9, PROSE + " indeed", 8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n int")
    assert sorted(r.n for r in N.drop_near_duplicates(docs).collect()) == [1, 2, 3, 5, 6]
    got = N.near_duplicate_classes(docs).collect()
    assert len(got) == len(rows)
    assert sorted((r.doc_id or 0, r.class_id or 0, r.kept) for r in got) == [
        (0, 0, True)] * 4 + [(3, 3, True), (9, 0, False), (9, 3, False), (9, 9, True)]
