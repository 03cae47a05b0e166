"""Shared helpers of the training-data operators.

Every operator takes a DataFrame, keeps only the columns it names (so extra
or clashing columns of the input cannot interfere) and returns the id column
with its own outputs.  A null text counts as the empty text unless an
operator says otherwise; repeated rows give repeated results.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of raw text that one array pass handles at a time (bounds a worker's memory).
CHUNK_BYTES = 2_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables, by a path that only Spark's readers open."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def id_text(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Just the id and the text (null: empty), under the names doc_id and text."""
    return df.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def crc_fold(id_col: str, n: int):
    """crc32 of the id written as text, modulo ``n``."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % F.lit(n)


def slices(batch: pa.RecordBatch, text: str = "text", limit: int = CHUNK_BYTES):
    """Cut a record batch by rows so that each piece holds about ``limit`` bytes
    of text; one longer text is a piece of its own."""
    col = batch.column(batch.schema.get_field_index(text))
    sizes = np.asarray(pa.compute.fill_null(pa.compute.binary_length(col), 0), dtype=np.int64)
    start, total = 0, 0
    for i, s in enumerate(sizes):
        if i > start and total + s > limit:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += int(s)
    if batch.num_rows > start:
        yield batch.slice(start)


def utf8(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column laid end to end, and each row's offsets (n + 1)."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type):
        kind = np.int64
    else:
        kind = np.int32
    n = len(col)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    if col.null_count:
        col = pa.compute.fill_null(col, "")
    buffers = col.buffers()
    offsets = np.frombuffer(buffers[1], dtype=kind)[col.offset:col.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(buffers[2], dtype=np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    data = raw[offsets[0]:offsets[-1]]
    return data, offsets - offsets[0]


_GOLD = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64): spreads each input over all bits."""
    x = x + _GOLD
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_POWERS = {"odd": 0xD6E8FEB86659FD93, "inv": pow(0xD6E8FEB86659FD93, -1, 1 << 64)}


def _powers(base: int, n: int) -> np.ndarray:
    out = np.empty(max(n, 1), np.uint64)
    out[0] = 1
    done = 1
    while done < n:
        step = min(done, n - done)
        out[done:done + step] = out[:step] * np.uint64(pow(base, done, 1 << 64))
        done += step
    return out


_CACHE: dict[str, np.ndarray] = {}


def powers(which: str, n: int) -> np.ndarray:
    """The first ``n`` powers of the hash base (or of its inverse) modulo 2^64."""
    have = _CACHE.get(which)
    if have is None or len(have) < n:
        have = _CACHE[which] = _powers(_POWERS[which], max(n, 1 << 16))
    return have[:n]


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of values[start:end] for many spans at once: polynomial
    prefix sums modulo 2^64, brought to a common origin and mixed with the length."""
    if len(starts) == 0:
        return np.zeros(0, np.uint64)
    n = len(values)
    v = values.astype(np.uint64) + np.uint64(1)
    acc = np.empty(n + 1, np.uint64)
    acc[0] = 0
    np.cumsum(v * powers("odd", n), out=acc[1:])
    h = (acc[ends] - acc[starts]) * powers("inv", n + 1)[starts]
    return mix(h ^ mix((ends - starts).astype(np.uint64)))


_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words are maximal runs of bytes other than ASCII white space.  Returns each
    word's start and end byte and its row (words never cross a row's end)."""
    n = len(data)
    if n == 0:
        z = np.zeros(0, np.int64)
        return z, z, z
    inside = ~_SPACE[data]
    begin = inside.copy()
    begin[1:] &= ~inside[:-1]
    stop = np.zeros(n + 1, bool)
    stop[1:n] = inside[:-1] & ~inside[1:]
    stop[n] = inside[-1]
    cuts = offsets[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < n)]
    cuts = cuts[inside[cuts] & inside[cuts - 1]]  # a row begins in the middle of a run
    begin[cuts] = True
    stop[cuts] = True
    starts, ends = np.flatnonzero(begin), np.flatnonzero(stop)
    rows = np.searchsorted(offsets, starts, side="right") - 1
    return starts, ends, rows


def shingles(data: np.ndarray, offsets: np.ndarray, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each row's word shingles, in order, with their rows.  A row of
    1 to size - 1 words has one shingle, all its words; a row without words none."""
    starts, ends, rows = words(data, offsets)
    if len(starts) == 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    hashed = span_hashes(data, starts, ends)
    n_rows = len(offsets) - 1
    counts = np.bincount(rows, minlength=n_rows)
    first = np.concatenate([[0], np.cumsum(counts)[:-1]])
    many = np.where(counts == 0, 0, np.maximum(counts - size + 1, 1))
    out_rows = np.repeat(np.arange(n_rows), many)
    at = np.arange(len(out_rows)) - np.repeat(np.cumsum(many) - many, many) + np.repeat(first, many)
    stop = np.minimum(at + size, np.repeat(first + counts, many))
    return span_hashes(hashed, at, stop), out_rows


def log_prefix(n: int) -> int:
    """Bits needed for ``n`` values."""
    return max(1, math.ceil(math.log2(max(2, n))))
