"""Hierarchical packing into sequences of several lengths (operator 11).

1. Texts are encoded once (an end id after each) and cut into pieces of at most
   the longest context; the pieces with their ids are a table in the shared
   folder, each with a number of its own; ids take two bytes where they fit.
2. Pieces are dealt by a hash of that number into groups of about
   ``group_tokens`` ids (the counts come from the table), so that one task holds
   one bounded group whatever a document's or a source's size.
3. Within a group each piece is routed to the smallest context size (tier) that
   holds it.  Tiers are packed from the longest down: a piece opens a sequence
   of its tier, and the rest of the sequence is filled with the longest pieces
   that fit, which shorter tiers (and its own, if they fit) supply.  When none
   fits, the shortest longer piece is cut to fill the rest, and what is left of
   it is routed again.  So every sequence is full, until the group runs out of
   pieces: the last ones make sequences of powers of two down to 1.
4. A group's sequences are dealt into steps of about ``step_tokens`` ids each:
   from the longest and costliest (sum of squared piece lengths) down, each goes to
   the step with the fewest ids and, of those, the least cost so far.

Every sequence's length is a power of two, so none needs padding.  At most
log2(context) sequences of a group are shorter than the smallest tier.  Numbers
of sequences and steps are unique over all groups: group * 2^24 + place.

Null text: the empty text, its end id only (without an end id: no piece).
Repeated rows and rows without an id: each is a document of its own.
"""

from __future__ import annotations

import bisect
import heapq
import math
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storelens.llm.base import id_text, slices
from storelens.llm.token_files import shared_folder
from storelens.llm.tokens import id_width, worker_encoder

TIERS = (256, 512, 1024, 2048, 4096)
#: Most pieces of a group on average, so that very short texts make no large group.
GROUP_PIECES = 16_384
_GROUP_BITS = 24


def encode_pieces(df: DataFrame, path: str, context: int, end_id: int | None = 2, id_col: str = "doc_id",
                  text_col: str = "text", cache_size: int = 1_000_000) -> DataFrame:
    """doc_id, start, doc_tokens and ids (little-endian unsigned integers of
    ``id_width`` bytes) of each document's pieces of at most ``context`` ids."""
    docs = id_text(df, id_col, text_col)
    kind_of_id = f"<u{id_width(path, end_id)}"

    def encode(batches):
        encoder = worker_encoder(path, True, cache_size)
        tail = np.array([] if end_id is None else [end_id], kind_of_id)
        for batch in batches:
            for part in slices(batch):
                row, start, total, ids = [], [], [], []
                for i, found in enumerate(encoder.ids(part.column(1).to_pylist())):
                    own = np.concatenate([found.astype(kind_of_id), tail])
                    for a in range(0, len(own), context):
                        row.append(i)
                        start.append(a)
                        total.append(len(own))
                        ids.append(own[a:a + context].tobytes())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(row, pa.int64())), pa.array(start, pa.int64()),
                     pa.array(total, pa.int64()), pa.array(ids, pa.binary())], names=["doc_id", "start", "doc_tokens", "ids"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(encode, f"doc_id {kind}, start long, doc_tokens long, ids binary")


def pack(lengths: list[int], tiers: tuple[int, ...] = TIERS) -> list[list[tuple[int, int, int]]]:
    """Full sequences of pieces (index, start within it, length) for pieces of the
    given lengths (1 to the longest tier); every sequence's length is a power of two."""
    tiers = sorted(tiers)
    # pieces not yet packed, ascending by length: (length, -index, start)
    waiting = sorted((n, -i, 0) for i, n in enumerate(lengths))
    out: list[list[tuple[int, int, int]]] = []

    def take(at: int, room: int, into: list) -> int:
        """Put piece ``at`` into a sequence, cut to ``room`` if it is longer."""
        n, i, start = waiting.pop(at)
        used = min(n, room)
        into.append((-i, start, used))
        if used < n:
            bisect.insort(waiting, (n - used, i, start + used))
        return used

    while waiting:
        longest = waiting[-1][0]
        if sum_at_most(waiting, context := tiers[bisect.bisect_left(tiers, longest)]):
            break
        sequence: list[tuple[int, int, int]] = []
        room = context - take(len(waiting) - 1, context, sequence)
        while room:
            at = bisect.bisect_right(waiting, room, key=lambda x: x[0]) - 1
            # the longest that fits, else the shortest there is, cut
            room -= take(max(at, 0), room, sequence)
        out.append(sequence)
    # too few ids are left for a sequence of that tier: powers of two
    rest = sum(n for n, _, _ in waiting)
    while rest:
        room = size = 1 << (rest.bit_length() - 1)
        sequence = []
        while room:
            room -= take(len(waiting) - 1, room, sequence)
        out.append(sequence)
        rest -= size
    return out


def sum_at_most(waiting: list[tuple[int, int, int]], limit: int) -> bool:
    """Whether the waiting pieces hold fewer ids than ``limit`` (stops early)."""
    total = 0
    for n, _, _ in reversed(waiting):
        total += n
        if total >= limit:
            return False
    return True


def steps(sequences: list[list[tuple[int, int, int]]], step_tokens: int) -> list[int]:
    """The step of each sequence: as many ids, and about as much cost, in each."""
    size = [sum(n for _, _, n in s) for s in sequences]
    cost = [sum(n * n for _, _, n in s) for s in sequences]
    many = max(1, round(sum(size) / step_tokens))
    load = [(0, 0, k) for k in range(many)]
    out = [0] * len(sequences)
    for i in sorted(range(len(sequences)), key=lambda i: (-size[i], -cost[i], i)):
        tokens, work, k = heapq.heappop(load)
        out[i] = k
        heapq.heappush(load, (tokens + size[i], work + cost[i], k))
    return out


def _group(rows: pa.Table, width: int, tiers: tuple[int, ...], step_tokens: int, with_ids: bool) -> pa.Table:
    rows = rows.sort_by("piece")
    ids, start = rows["ids"].to_pylist(), rows["start"].to_pylist()
    sequences = pack([len(x) // width for x in ids], tiers)
    base = rows["group"][0].as_py() << _GROUP_BITS
    row: list[int] = []
    found: dict[str, list] = {c: [] for c in ("start", "length", "ids_crc32", "sequence_id", "offset", "sequence_tokens",
                                              "step_id", "ids")}
    for k, (sequence, step) in enumerate(zip(sequences, steps(sequences, step_tokens))):
        offset, total = 0, sum(n for _, _, n in sequence)
        for i, a, n in sequence:
            raw = np.frombuffer(ids[i], f"<u{width}", n, a * width).astype("<u4").tobytes()
            row.append(i)
            for c, value in zip(found, (start[i] + a, n, zlib.crc32(raw), base + k, offset, total, base + step,
                                        raw if with_ids else None)):
                found[c].append(value)
            offset += n
    at = pa.array(row, pa.int64())
    whole = {c: rows[c].take(at) for c in ("doc_id", "doc_tokens")}
    kinds = {"ids": pa.binary()}
    made = {c: pa.array(v, kinds.get(c, pa.int64())) for c, v in found.items()}
    return pa.table({c: {**whole, **made}[c] for c in COLUMNS})


COLUMNS = ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "sequence_tokens", "step_id",
           "ids")


def pack_documents(df: DataFrame, path: str, end_id: int | None = 2, id_col: str = "doc_id", text_col: str = "text",
                   tiers: tuple[int, ...] = TIERS, group_tokens: int = 1 << 21, step_tokens: int = 1 << 18,
                   with_ids: bool = True) -> DataFrame:
    """One row per piece: doc_id, start (ids of its document before it), length,
    ids_crc32 (of its ids as little-endian unsigned 32-bit integers), doc_tokens,
    sequence_id, offset (ids before it in the sequence), sequence_tokens (the
    sequence's length), step_id and ids (those bytes; null unless ``with_ids``)."""
    if any(t < 1 or t & (t - 1) for t in tiers):
        raise ValueError("tiers are powers of two")
    spark = df.sparkSession
    width = id_width(path, end_id)
    folder = shared_folder(spark, "pieces")
    encoded = encode_pieces(df, path, max(tiers), end_id, id_col, text_col)
    encoded.withColumn("piece", F.monotonically_increasing_id()).write.parquet(folder)
    pieces = spark.read.parquet(folder)
    total = pieces.agg(F.sum(F.octet_length("ids")).alias("n"), F.count("*").alias("rows")).first()
    groups = max(1, math.ceil((total["n"] or 0) / width / group_tokens), math.ceil(total["rows"] / GROUP_PIECES))
    dealt = pieces.withColumn("group", F.pmod(F.xxhash64("piece"), F.lit(groups)))
    kind = pieces.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, " + ", ".join(f"{c} long" for c in COLUMNS[1:-1]) + ", ids binary"
    return dealt.groupBy("group").applyInArrow(lambda rows: _group(rows, width, tiers, step_tokens, with_ids), schema)
