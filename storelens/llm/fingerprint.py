"""Document fingerprints: bottom-k sketches of word shingles (operator 10).

Native: DataFrame functions only.  A sketch is the ascending array of the k
smallest 48-bit hashes of a text's distinct shingles (five words; a text of one
to four words has one shingle, all of them; a text without words none).  Two
sketches of parts merge into the sketch of the whole; a pair estimates
resemblance and containment, one the number of distinct shingles.

Null text: the empty text, an empty sketch; two empty sketches resemble 1, an
empty and another 0.  Rows that share a doc_id: the smallest text counts.
Null doc_id: a document before all others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from storelens.functions.sizing import cut_lineage
from storelens.llm.base import id_text

K = 128
SIZE = 5
SPACES = r"[\x20\x09-\x0D]+"
BITS = 48


def let(value: Column, use) -> Column:
    """``use`` of a value that is computed once (bound by a lambda)."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def shingle_hashes(text: Column, size: int = SIZE) -> Column:
    """The 48-bit hashes of a text's shingles, in order."""
    def fold(hashed: Column) -> Column:
        many = F.transform(F.sequence(F.lit(0), F.size(hashed) - size),
                           lambda i: F.xxhash64(*[F.get(hashed, i + j) for j in range(size)]))
        return F.when(F.size(hashed) >= size, many).when(F.size(hashed) > 0, F.array(F.xxhash64(hashed))).otherwise(
            F.array().cast("array<bigint>"))

    words = F.filter(F.split(text, SPACES), lambda w: w != F.lit(""))
    every = let(F.transform(words, lambda w: F.xxhash64(w)), fold)
    return F.transform(every, lambda h: F.shiftrightunsigned(h, 64 - BITS))


def bottom_k(hashes: Column, k: int = K) -> Column:
    return F.slice(F.sort_array(F.array_distinct(hashes)), 1, k)


def merge(a: Column, b: Column, k: int = K) -> Column:
    """The sketch of the union of two parts."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def merge_rows(sketches: DataFrame, keys: list[str], sketch: str = "sketch", k: int = K) -> DataFrame:
    """The sketch of all rows of each key.  Rows are folded into at most k
    hashes by random part first, so that a hot key never meets in one task."""
    each = sketches.select(*keys, F.explode(sketch).alias("_h")).distinct()
    part = F.pmod(F.xxhash64("_h"), F.lit(64))
    first = each.withColumn("_part", part).withColumn(
        "_r", F.row_number().over(Window.partitionBy(*keys, "_part").orderBy("_h"))).where(F.col("_r") <= k)
    return first.groupBy(*keys).agg(F.slice(F.sort_array(F.collect_list("_h")), 1, k).alias(sketch))


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Share of the smallest k hashes of the union that both sketches hold."""
    return let(merge(a, b, k), lambda both: F.when(F.size(both) == 0, 1.0).otherwise(
        F.size(F.array_intersect(both, F.array_intersect(a, b))) / F.size(both)))


def distinct_count(a: Column, k: int = K) -> Column:
    """Estimated number of distinct shingles (exact below k)."""
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise(
        (k - 1) * F.lit(float(1 << BITS)) / F.element_at(a, -1))


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of a's distinct shingles that b holds."""
    shared = resemblance(a, b, k) * distinct_count(merge(a, b, k), k)
    return F.when(F.size(a) == 0, 1.0).otherwise(F.least(F.lit(1.0), shared / distinct_count(a, k)))


def as_text(a: Column) -> Column:
    """A sketch as a string: 12 hexadecimal digits a hash, in order."""
    return F.lower(F.array_join(F.transform(a, lambda h: F.lpad(F.hex(h), BITS // 4, "0")), ""))


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K) -> DataFrame:
    """doc_id, sketch, fingerprint, n_shingles of every text."""
    return id_text(df, id_col, text_col).select("doc_id", bottom_k(shingle_hashes(F.col("text")), k).alias("sketch")).select(
        "doc_id", "sketch", as_text(F.col("sketch")).alias("fingerprint"),
        distinct_count(F.col("sketch"), k).alias("n_shingles"))


_NULL = -(1 << 63)


def _followers(ids: DataFrame) -> DataFrame:
    """``key`` (unique) and ``n`` -> key, prev_key, prev_n: the document before
    each in ascending order; before the first comes the last.  Range partitions,
    kept in a table, are lagged within; only their last rows are lagged together."""
    parts = cut_lineage(ids.repartitionByRange("key").withColumn("part", F.spark_partition_id()))
    inner = Window.partitionBy("part").orderBy("key")
    ends = parts.groupBy("part").agg(F.max(F.struct("key", "n")).alias("end"))
    order = Window.orderBy("part")
    ends = ends.select("part", F.coalesce(F.lag("end").over(order),
                                          F.max("end").over(Window.partitionBy())).alias("before"))
    lagged = parts.select("part", "key", F.lag("key").over(inner).alias("prev_key"), F.lag("n").over(inner).alias("prev_n"))
    return lagged.join(ends, "part").select("key", F.coalesce("prev_key", "before.key").alias("prev_key"),
                                            F.coalesce("prev_n", "before.n").alias("prev_n"))


def edited_fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K) -> DataFrame:
    """Fingerprints of every text and of its edited text: the last half (rounded
    down) of its code points replaced by the first as many of the next document.

    Texts are shuffled once by their id; a text's first part then goes on to the
    document before it, together with its sketch.
    """
    docs = id_text(df, id_col, text_col).select(F.coalesce("doc_id", F.lit(_NULL)).alias("key"), "text")
    ids = cut_lineage(docs.groupBy("key").agg(F.max(F.char_length("text")).alias("n"), F.count("*").alias("rows")))
    if ids.where("rows > 1").limit(1).count():
        docs = docs.groupBy("key").agg(F.min("text").alias("text"))
        ids = cut_lineage(docs.select("key", F.char_length("text").alias("n")))
    dealt = docs.repartition("key")
    n, half = F.char_length("text"), F.floor(F.char_length("text") / 2)
    sketch = bottom_k(shingle_hashes(F.col("text")), k)
    left = dealt.select("key", n.alias("n_chars"), F.expr("left(text, cast(char_length(text) - floor(char_length(text) / 2) as int))")
                        .alias("head"), sketch.alias("sketch"))
    right = dealt.join(_followers(ids.select("key", "n")), "key").select(
        F.col("prev_key").alias("key"), F.expr("left(text, cast(floor(prev_n / 2) as int))").alias("start"),
        sketch.alias("next_sketch"))
    both = left.join(right, "key").select(
        F.when(F.col("key") != _NULL, F.col("key")).alias("doc_id"), "n_chars", "sketch", "next_sketch",
        F.concat("head", "start").alias("edited"))
    both = both.select("*", bottom_k(shingle_hashes(F.col("edited")), k).alias("edited_sketch"))
    return both.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), as_text(F.col("sketch")).alias("fingerprint"),
        as_text(F.col("edited_sketch")).alias("edited_fingerprint"),
        resemblance(F.col("sketch"), F.col("edited_sketch"), k).alias("near_edited"),
        resemblance(F.col("sketch"), F.col("next_sketch"), k).alias("near_next"))
