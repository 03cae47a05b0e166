import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from storelens.llm import periodic as P
from storelens.llm import queries as Q
from storelens.llm.base import table, utf8
from tests.llm.conftest import as_rows

SF = "/root/testdata/sf0.001"


def brute(w: list, least: int = 24) -> list[tuple[int, int, int]]:
    """All runs of a sequence by comparing it with every shift of itself."""
    found, n = {}, len(w)
    for q in range(1, n // 3 + 1):
        s = 0
        while s + q < n:
            e = s
            while e + q < n and w[e] == w[e + q]:
                e += 1
            if e + q - s >= max(least, 3 * q):
                found.setdefault((s, e + q), q)
            s = max(e, s) + 1
    return sorted((s, e - s, q) for (s, e), q in found.items())


def words_of(text):
    return [w.decode() for w in (text or "").encode().split()]


def repeat(doc_id, text):
    w = words_of(text)
    h = None if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h is not None and h % 10 == 0 and w:
        n, g = len(w), h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [x if i < a else w[a + (i - a) % p] for i, x in enumerate(w)]
    return w


def kept(w, found):
    gone = {i for s, length, q in found for i in range(s + q, s + length)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


def of(texts):
    counts, found = P.text_runs(*utf8(pa.array(texts, pa.string())))
    return [sorted(tuple(r[1:]) for r in found if r[0] == i) for i in range(len(texts))], counts


def made(rng: random.Random) -> list[str]:
    """Words with planted powers of plain, nested and highly periodic roots."""
    letters = "ab" if rng.random() < 0.4 else "abcdefghijklmnopqrstuvwxyz"
    out = [rng.choice(letters) for _ in range(rng.randrange(40))]
    for _ in range(rng.randrange(1, 5)):
        q = rng.choice([1, 2, 3, 7, 12, 15, 16, 17, 20, 31, 32, 33, 40, 63, 64, 65, 100, 130])
        root = [rng.choice(letters) for _ in range(q)]
        kind = rng.randrange(4)
        if kind == 1:  # nearly all of the root is one letter
            root = ["a"] * (q - 1) + ["b"]
        elif kind == 2:  # a power within the root
            inner = [rng.choice(letters) for _ in range(max(1, q // 5))]
            root = (inner * 4 + root)[:q]
        length = rng.choice([3 * q, 3 * q + 1, 3 * q - 1, 4 * q, 5 * q + q // 2])
        out += (root * 6)[:length]
        out += [rng.choice(letters) for _ in range(rng.randrange(12))]
    return out


@pytest.mark.parametrize("seed", range(12))
def test_runs_equal_brute_force(seed):
    rng = random.Random(seed)
    texts = [made(rng) for _ in range(25)]
    got, counts = of([" ".join(t) for t in texts])
    assert counts.tolist() == [len(t) for t in texts]
    for t, g in zip(texts, got):
        assert g == brute(t)


def test_structured_words():
    fibonacci, thue = ["a"], [0]
    x, y = ["a", "b"], ["a"]
    while len(x) < 900:
        x, y = x + y, x
    fibonacci = x
    for _ in range(9):
        thue += [1 - b for b in thue]
    texts = [fibonacci, [str(b) for b in thue], ["w"] * 700, ["a", "b"] * 301, (["a"] * 40 + ["b"]) * 9,
             ((["a"] * 9 + ["b"]) * 4 + ["c"]) * 7, []]
    got, _ = of([" ".join(t) for t in texts])
    for t, g in zip(texts, got):
        assert g == brute(t)


def test_equal_texts_side_by_side_make_no_run():
    text = " ".join(f"w{i}" for i in range(30))
    got, _ = of([text] * 8)
    assert got == [[]] * 8


def test_long_run_and_short_neighbours():
    rng = np.random.default_rng(1)
    root = [f"w{i}" for i in rng.integers(0, 50, 1000)]
    long = (root * 40)[:38_500]
    got, _ = of(["x y z", " ".join(long), "", "q " * 24])
    assert got[0] == [] and got[2] == [] and got[3] == [(0, 24, 1)]
    assert (0, 38_500, 1000) in got[1]


def test_query_equals_brute_force(spark):
    rows = {r.doc_id: r for r in Q.QUERIES["op12_periodic_runs"](spark, SF).collect()}
    docs = table(spark, SF, "documents").select("doc_id", "text").collect()
    assert len(rows) == len(docs)
    planted = 0
    for d in docs:
        w = repeat(d.doc_id, d.text)
        if len(w) > 1500:  # the brute force is quadratic; runs() is tested above
            continue
        r, found = rows[d.doc_id], brute(w)
        planted += len(found) > 0
        assert r.n_runs == len(found)
        line = "".join(f"{a},{b},{c}\n" for a, b, c in found)
        assert r.runs_sha256 == hashlib.sha256(line.encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(kept(w, found).encode()).hexdigest()
        if found:
            best = max(found, key=lambda x: (x[1] / x[2], -x[0], -x[2]))
            assert (r.start, r.length, r.period, r.exponent_milli) == (*best, 1000 * best[1] // best[2])
        else:
            assert r.start is r.length is r.period is r.exponent_milli is None
    assert planted > 5


def test_odd_rows(spark, odd, empty, clashing):
    got = P.periodic_runs(odd).orderBy("doc_id").collect()
    assert len(got) == odd.count()
    by_id = {r.doc_id: r for r in got}
    assert by_id[3].runs == [] and by_id[3].collapsed == "" and by_id[4].n_words == by_id[5].n_words == 0
    assert [tuple(x) for x in by_id[8].runs] == [(0, 60_000, 1)] and by_id[8].collapsed == "word"
    assert by_id[7].n_words == 1 and by_id[None].collapsed == "lone words here"
    assert P.periodic_runs(empty).count() == 0
    assert as_rows(P.periodic_runs(clashing)) == as_rows(P.periodic_runs(odd))
    changed = odd.withColumn("text", P.planted(F.col("text"), F.col("doc_id"))).select("doc_id", "text")
    for r in changed.collect():
        before = [x.text for x in odd.where(F.col("doc_id").eqNullSafe(r.doc_id)).collect()]
        assert words_of(r.text) in [repeat(r.doc_id, b) for b in before]
