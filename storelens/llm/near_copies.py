"""Near-duplicate classes by DartMinHash (operator 3).

A text is the weighted set of its shingles (five words; a text of one to four
words has one shingle), weighted by their counts; similarity is the weighted
Jaccard index.  Signatures: every element's region (weight by rank) is hit by
hashed darts - a Poisson stream in rank for each dyadic slab of weight, the
same in every text that holds the element -, each dart falls on one of
``bands * rows`` coordinates, and the earliest dart of a coordinate is its
value.  A text throws about k ln k + 2k darts; while a coordinate is empty its
ranks are doubled.  So the work is about elements + darts, whatever k.

Classes: exact copies are folded first (digest of the text).  Bands of
signature values are joined by bucket.  Each bucket's pivot (its text with the smallest
id, which a group of near copies shares over most buckets) is compared with the
others of the bucket; the links that hold (exact similarity >= ``threshold``) give components; then all
pairs of a bucket that still lie in different components are compared too, so
that no candidate link between classes stays untested: as rows in small
buckets, block against block in large ones, where only links are emitted.  A
bucket that is one component after the first pass gives no second work.  At 0.8
and 20 bands of 4 a pair of similar texts misses all buckets with probability
0.00003.

Null or empty texts and texts without words have no shingles: each distinct
one is a class of its own (equal ones are copies).  Repeated rows: each gets the
same class.  Rows that share an id, or have none, but differ in text are told
apart by their text: they are in one class only if their texts are alike.  The
null id counts as the smallest one.  Ids are integers.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from storelens.functions.sizing import cut_lineage
from storelens.llm.base import id_text, mix, shingles, slices, utf8
from storelens.operators.components import connected_components

_NULL = -(1 << 63)
#: Largest bucket whose pairs between components become rows; larger ones are compared in blocks.
PAIRED = 24
BLOCK = 256
_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)


def weighted_elements(hashes: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (row, hash) with their counts, by row then hash."""
    if not len(hashes):
        return hashes, rows, np.zeros(0)
    order = np.lexsort((hashes, rows))
    h, r = hashes[order], rows[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (r[1:] != r[:-1])
    at = np.flatnonzero(new)
    return h[at], r[at], np.diff(np.append(at, len(h))).astype(float)


def _uniform(h: np.ndarray) -> np.ndarray:
    return ((h >> np.uint64(11)).astype(np.float64) + 0.5) / float(1 << 53)


def dart_signatures(elements: np.ndarray, rows: np.ndarray, weights: np.ndarray, n: int, k: int) -> np.ndarray:
    """(n, k) signature values of n weighted sets given as (element hash, row,
    weight > 0); a row without elements keeps the value of no dart throughout."""
    best = np.full(n * k, _NONE)
    if not len(elements):
        return best.reshape(n, k)
    total = np.bincount(rows, weights=weights, minlength=n)
    # slabs of weight: [0, 1), [1, 2), [2, 4), [4, 8), ...
    many = np.where(weights <= 1, 1, np.ceil(np.log2(np.maximum(weights, 1))).astype(np.int64) + 1)
    own = np.repeat(np.arange(len(elements)), many)
    slab = np.arange(len(own)) - np.repeat(np.cumsum(many) - many, many)
    low = np.where(slab == 0, 0.0, np.exp2(slab - 1.0))
    length = np.where(slab == 0, 1.0, low)
    seed = mix(elements[own] ^ mix(slab.astype(np.uint64) + np.uint64(0x51ED)))
    row, limit = rows[own], weights[own]
    limits = np.where(total > 0, (k * math.log(k) + 2 * k) / np.maximum(total, 1e-300), 0.0)
    # the next dart of each slab: its rank, from a stream of exponential gaps
    throw = np.zeros(len(own), np.uint64)
    rank = -np.log(_uniform(mix(seed))) / length
    going = np.arange(len(own))
    while len(going):
        now = going[rank[going] < limits[row[going]]]
        while len(now):
            dart = mix(seed[now] + throw[now] * np.uint64(0x9E3779B97F4A7C15) + np.uint64(0xDA27))
            inside = low[now] + length[now] * _uniform(mix(dart)) < limit[now]
            hit, d = now[inside], dart[inside]
            value = (rank[hit].astype(np.float32).view(np.uint32).astype(np.uint64) << np.uint64(32)) | (d >> np.uint64(32))
            np.minimum.at(best, row[hit] * k + (d & np.uint64(0xFFFFFFFF)).astype(np.int64) % k, value)
            throw[now] += np.uint64(1)
            rank[now] += -np.log(_uniform(mix(seed[now] + throw[now] * np.uint64(0xD1B54A32D192ED03)))) / length[now]
            now = now[rank[now] < limits[row[now]]]
        empty = (best.reshape(n, k) == _NONE).any(axis=1) & (total > 0)
        limits = np.where(empty, 2 * limits, limits)
        going = going[empty[row[going]]]
    return best.reshape(n, k)


def band_keys(signatures: np.ndarray, bands: int) -> np.ndarray:
    """(n, bands) 64-bit keys of each band of signature values."""
    n, k = signatures.shape
    each = signatures.reshape(n, bands, k // bands)
    key = np.broadcast_to(np.arange(bands, dtype=np.uint64) + np.uint64(1), (n, bands)).copy()
    for i in range(each.shape[2]):
        key = mix(key ^ mix(each[:, :, i]))
    return key


def similarities(left: pa.Array, right: pa.Array, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Sums of the smaller and of the larger counts of each pair of texts."""
    n = len(left)
    parts = []
    for side in (left, right):
        h, r = shingles(*utf8(side), size)
        parts.append(weighted_elements(h, r))
    (ha, ra, wa), (hb, rb, wb) = parts
    hashes, rows = np.concatenate([ha, hb]), np.concatenate([ra, rb])
    weights = np.concatenate([wa, wb])
    order = np.lexsort((hashes, rows))
    h, r, w = hashes[order], rows[order], weights[order]
    shared = np.flatnonzero((h[1:] == h[:-1]) & (r[1:] == r[:-1])) if len(h) else np.zeros(0, int)
    least = np.bincount(r[shared], weights=np.minimum(w[shared], w[shared + 1]), minlength=n)
    return least, np.bincount(r, weights=w, minlength=n) - least


def digest(text):
    """128 bits that stand for a text."""
    return F.unhex(F.substring(F.sha2(text.cast("binary"), 256), 1, 32))


def signatures(docs: DataFrame, bands: int, rows: int, size: int) -> DataFrame:
    """key, digest, keys (band keys; empty for a text without shingles) of every row."""
    def sign(batches):
        for batch in batches:
            for part in slices(batch):
                data, offsets = utf8(part.column(1))
                n = part.num_rows
                h, r, w = weighted_elements(*shingles(data, offsets, size))
                found = band_keys(dart_signatures(h, r, w, n, bands * rows), bands).view(np.int64)
                some = np.bincount(r, minlength=n) > 0
                ends = np.concatenate([[0], np.cumsum(np.where(some, bands, 0))])
                keys = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(found[some].ravel()))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), keys],
                                                 names=["key", "digest", "keys"])

    return docs.select("key", "text", "digest").mapInArrow(sign, "key long, digest binary, keys array<long>")


def similar(pairs: DataFrame, texts: DataFrame, threshold: float, size: int) -> DataFrame:
    """The pairs (a, b) whose texts' weighted Jaccard index reaches the threshold."""
    low = math.floor(threshold * 1_000_000 + 0.5)

    def keep(batches):
        for batch in batches:
            for part in slices(batch, "left_text"):
                for piece in slices(part, "right_text"):
                    least, most = similarities(piece.column(2), piece.column(3), size)
                    good = (least * 1_000_000 >= low * most) & (most > 0)
                    yield piece.select(["a", "b"]).filter(pa.array(good))

    left = texts.select(F.col("key").alias("a"), F.col("text").alias("left_text"))
    right = texts.select(F.col("key").alias("b"), F.col("text").alias("right_text"))
    return pairs.join(right, "b").join(left, "a").select("a", "b", "left_text", "right_text").mapInArrow(
        keep, "a binary, b binary")


def _binary(texts: list[str], size: int) -> list[np.ndarray]:
    """Each text's set of (shingle, how often it occurred before): the Jaccard
    index of these sets is the weighted one of the shingles."""
    h, r = shingles(*utf8(pa.array(texts, pa.large_string())), size)
    elements, rows, weights = weighted_elements(h, r)
    times = weights.astype(np.int64)
    nth = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
    copies = mix(np.repeat(elements, times) ^ mix(nth.astype(np.uint64)))
    return np.split(copies, np.cumsum(np.bincount(np.repeat(rows, times), minlength=len(texts)))[:-1])


def _compare(rows, threshold: float, size: int):
    """Links between the two blocks of one group (or within its one block)."""
    import pandas as pd

    left = rows[rows["block"] == rows["i"]].reset_index(drop=True)
    right = rows[rows["block"] == rows["j"]].reset_index(drop=True)
    out = pd.DataFrame({"a": pd.Series(dtype=object), "b": pd.Series(dtype=object)})
    if not len(left) or not len(right):
        return out
    sets = [_binary(list(side["text"]), size) for side in (left, right)]
    both = np.intersect1d(np.concatenate(sets[0]), np.concatenate(sets[1]))
    table = []
    for side in sets:
        m = np.zeros((len(side), len(both)), np.float32)
        for i, s in enumerate(side):
            at = np.minimum(np.searchsorted(both, s), max(len(both) - 1, 0))
            if len(both):
                m[i, at[both[at] == s]] = 1.0
        table.append(m)
    least = (table[0] @ table[1].T).astype(np.float64)
    sizes = [np.array([len(s) for s in side], float) for side in sets]
    good = least * 1_000_000 >= math.floor(threshold * 1_000_000 + 0.5) * (sizes[0][:, None] + sizes[1][None, :] - least)
    keys, roots = (left["key"].to_numpy(), right["key"].to_numpy()), (left["root"].to_numpy(), right["root"].to_numpy())
    good &= roots[0][:, None] != roots[1][None, :]
    a, b = np.nonzero(good & (least > 0))
    return pd.DataFrame({"a": keys[0][a], "b": keys[1][b]})


def similar_in_blocks(members: DataFrame, texts: DataFrame, threshold: float, size: int) -> DataFrame:
    """Links between different components of large buckets (bucket, key, root,
    n).  A bucket's texts are dealt into blocks of about ``BLOCK`` and every two
    blocks meet in one group, which emits its links only: no task holds more
    than two blocks and no pair becomes a row."""
    blocks = F.ceil(F.col("n") / BLOCK)
    dealt = members.withColumn("block", F.pmod(F.xxhash64("key"), blocks)).withColumn(
        "other", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)))
    dealt = dealt.select("bucket", "key", "root", "block", F.least("block", "other").alias("i"),
                         F.greatest("block", "other").alias("j"))
    return dealt.join(texts, "key").groupBy("bucket", "i", "j").applyInPandas(
        lambda rows: _compare(rows, threshold, size), "a binary, b binary").distinct()


def node_of(key, digest):
    """A text's name: its smallest id (8 bytes, in the ids' order) and its digest."""
    return F.concat(F.unhex(F.lpad(F.hex(key.bitwiseXOR(F.lit(_NULL))), 16, "0")), digest)


def key_of(node):
    """The id in a name."""
    return F.conv(F.hex(F.substring(node, 1, 8)), 16, -10).cast("long").bitwiseXOR(F.lit(_NULL))


def _classes(df: DataFrame, id_col: str, text_col: str, threshold: float, bands: int, rows: int, size: int) -> DataFrame:
    """key, digest, class, kept of every row; keys and classes are ids (null: ``_NULL``)."""
    docs = id_text(df, id_col, text_col).select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(_NULL)).alias("key"), "text",
        digest(F.col("text")).alias("digest"))
    signed = cut_lineage(signatures(docs, bands, rows, size))
    folded = signed.groupBy("digest").agg(F.min("key").alias("first"), F.min_by("keys", "key").alias("keys"))
    folded = cut_lineage(folded.select("digest", node_of(F.col("first"), F.col("digest")).alias("key"), "keys"))
    placed = folded.select("key", F.explode("keys").alias("bucket"))
    # a bucket's pivot is its smallest name, which most buckets of a group of near copies share
    shared = placed.groupBy("bucket").agg(F.count("*").alias("n"), F.min("key").alias("pivot")).where("n > 1")
    shared = cut_lineage(placed.join(shared, "bucket"))
    first = cut_lineage(shared.where("key != pivot").select(F.col("key").alias("a"), F.col("pivot").alias("b")).distinct())
    own = docs.select(node_of(F.col("key"), F.col("digest")).alias("key"), "text")
    texts = cut_lineage(own.join(shared.select("key"), "key", "left_semi").dropDuplicates(["key"]))
    roots = cut_lineage(connected_components(similar(first, texts, threshold, size)))
    # pairs of a bucket that lie in different components and weren't compared
    labelled = shared.select("key", "bucket").join(roots.withColumnRenamed("node", "key"), "key", "left").withColumn(
        "root", F.coalesce("root", "key"))
    labelled = cut_lineage(labelled)
    mixed = labelled.groupBy("bucket").agg(F.count("*").alias("n"), F.min("root").alias("least"),
                                           F.max("root").alias("most")).where("least != most").select("bucket", "n")
    rest = cut_lineage(labelled.join(mixed, "bucket"))
    few, many = rest.where(F.col("n") <= PAIRED), rest.where(F.col("n") > PAIRED)
    other = few.select("bucket", F.col("key").alias("other"), F.col("root").alias("other_root"))
    crossed = few.join(other, "bucket").where("root < other_root").select(
        F.least("key", "other").alias("a"), F.greatest("key", "other").alias("b"))
    # without the pairs that were compared, as (larger, smaller)
    second = crossed.distinct().join(first.select(F.col("b").alias("a"), F.col("a").alias("b")), ["a", "b"], "left_anti")
    more = cut_lineage(similar(second, texts, threshold, size).unionByName(
        similar_in_blocks(many, texts, threshold, size)))
    if more.agg(F.count("*")).first()[0]:
        stars = roots.select(F.col("node").alias("a"), F.col("root").alias("b"))
        roots = cut_lineage(connected_components(stars.unionByName(more)))
    classes = folded.select("digest", F.col("key").alias("node")).join(roots, "node", "left")
    classes = classes.select("digest", key_of(F.coalesce("root", "node")).alias("class"),
                             F.coalesce(F.col("root") == F.col("node"), F.lit(True)).alias("leads"))
    return signed.select("key", "digest").join(classes, "digest").select(
        "key", "digest", "class", (F.col("leads") & (F.col("key") == F.col("class"))).alias("kept"))


def near_duplicate_classes(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.8,
                           bands: int = 20, rows: int = 4, size: int = 5) -> DataFrame:
    """doc_id, class_id (the smallest doc_id of its class), kept (whether it is
    the one of its class) of every row."""
    null = lambda c: F.when(F.col(c) != _NULL, F.col(c))
    return _classes(df, id_col, text_col, threshold, bands, rows, size).select(
        null("key").alias("doc_id"), null("class").alias("class_id"), "kept")


def drop_near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.8,
                         bands: int = 20, rows: int = 4, size: int = 5) -> DataFrame:
    """The rows of ``df``, all columns, that stand for their class: those of its
    smallest id and its text; of several such rows with one id the one with the
    smallest text, of rows without an id one for each text."""
    chosen = cut_lineage(_classes(df, id_col, text_col, threshold, bands, rows, size).where("kept").select(
        F.col("key").alias("_key"), F.col("digest").alias("_digest")))
    own = df.withColumns({"_key": F.coalesce(F.col(id_col).cast("long"), F.lit(_NULL)),
                          "_digest": digest(F.coalesce(F.col(text_col), F.lit("")))})
    left = own.join(chosen, ["_key", "_digest"], "left_semi")
    unit = F.when(F.col("_key") == _NULL, F.col("_digest"))
    if not chosen.groupBy("_key", unit).count().where("count > 1").agg(F.count("*")).first()[0]:
        return left.drop("_key", "_digest")
    order = Window.partitionBy("_key", unit).orderBy(
        F.col(text_col), *[F.col(c) for c, t in df.dtypes if c != text_col and "map" not in t])
    return left.withColumn("_row", F.row_number().over(order)).where("_row = 1").drop(
        "_row", "_key", "_digest")
