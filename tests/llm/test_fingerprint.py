import hashlib

import xxhash
from pyspark.sql import functions as F

from storelens.llm import fingerprint as B
from storelens.llm.base import table
from tests.llm.conftest import as_rows

MASK = (1 << 64) - 1
#: The primes of the 64-bit hash function.
P1, P2, P3 = 0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9
P4, P5 = 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5


def turn(x, r):
    return ((x << r) | (x >> (64 - r))) & MASK


def hash_long(v, seed):
    h = (seed + P5 + 8) & MASK
    h ^= turn(v * P2 & MASK, 31) * P1 & MASK
    h = (turn(h, 27) * P1 + P4) & MASK
    h = (h ^ h >> 33) * P2 & MASK
    h = (h ^ h >> 29) * P3 & MASK
    return h ^ h >> 32


def sketch(text, k=B.K):
    for c in "\t\n\x0b\x0c\r":
        text = text.replace(c, " ")
    words = [xxhash.xxh64(w.encode(), seed=42).intdigest() for w in text.split(" ") if w]
    runs = [words[i:i + 5] for i in range(max(1, len(words) - 4))] if words else []
    out = set()
    for run in runs:
        h = 42
        for v in run:
            h = hash_long(v, h)
        out.add(h >> 16)
    return sorted(out)[:k]


def near(a, b, k=B.K):
    both = sorted(set(a) | set(b))[:k]
    return len(set(both) & set(a) & set(b)) / len(both) if both else 1.0


def hexes(a):
    return "".join(f"{x:012x}" for x in a)


def check(got, rows):
    """``rows``: (id, text) ascending, unique ids."""
    got = {r.doc_id: r for r in got}
    assert len(got) == len(rows)
    for (i, text), (_, after) in zip(rows, rows[1:] + rows[:1]):
        half = len(text) // 2
        edited = text[:len(text) - half] + after[:half]
        a, e, n, r = sketch(text), sketch(edited), sketch(after), got[i]
        assert (r.n_chars, r.fingerprint, r.edited_fingerprint) == (len(text), hexes(a), hexes(e))
        assert r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert abs(r.near_edited - near(a, e)) < 1e-12 and abs(r.near_next - near(a, n)) < 1e-12


def test_equals_brute_force(spark):
    docs = table(spark, "/root/testdata/sf0.001", "documents")
    check(B.edited_fingerprints(docs).collect(), sorted((r.doc_id, r.text) for r in docs.collect()))


def test_no_python_in_the_plan(spark):
    plan = B.edited_fingerprints(table(spark, "/root/testdata/sf0.001", "documents"))._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow", "MapIn"))


def test_odd_rows(odd, clashing, empty, spark):
    got = B.edited_fingerprints(odd).collect()
    texts = {}
    for r in odd.collect():
        texts[r.doc_id] = min(r.text or "", texts.get(r.doc_id, r.text or ""))
    check(got, sorted(texts.items(), key=lambda x: (x[0] is not None, x[0] or 0)))
    assert as_rows(B.edited_fingerprints(clashing)) == sorted(tuple(str(v) for v in r) for r in got)
    assert B.edited_fingerprints(empty).count() == 0
    one = spark.createDataFrame([(5, "😀 a b c d e f")], "doc_id long, text string")
    check(B.edited_fingerprints(one).collect(), [(5, "😀 a b c d e f")])


def test_merge_and_estimates(spark):
    draw = spark.range(3000).selectExpr("id AS doc_id", "id % 2 AS part",
                                        "concat_ws(' ', id, id + 1, id + 2, id + 3, id + 4, id + 5) AS text")
    each = B.fingerprints(draw).join(draw.select("doc_id", "part"), "doc_id")
    parts = {r.part: r.sketch for r in B.merge_rows(each, ["part"]).collect()}
    every = sorted({h for r in each.collect() for h in r.sketch})
    assert sorted(set(parts[0]) | set(parts[1]))[:B.K] == every[:B.K]
    one = spark.createDataFrame([(parts[0], parts[1], every[:B.K])], "a array<long>, b array<long>, c array<long>")
    r = one.select(B.merge(F.col("a"), F.col("b")).alias("m"), B.distinct_count(F.col("c")).alias("n"),
                   B.resemblance(F.col("a"), F.col("c")).alias("r"), B.containment(F.col("a"), F.col("c")).alias("k")).first()
    assert list(r.m) == every[:B.K] and abs(r.n / len(every) - 1) < 0.4 and r.r > 0.8 and r.k > 0.7
