"""Cross-tokenizer alignment with external spill counting (operator 13).

Tokenizer A (a byte-level file of the tokenizers library) reads a space and the
text, tokenizer B (a sentencepiece model, which adds that space) the text.  Byte
offsets where tokens of both end cut a text into groups; an A and a B token are
linked if their byte ranges overlap.  A pair's count is the number of links in
the whole corpus that join its two ids.

Counting never shuffles or holds links:

1. Each task aligns its texts and gathers a record (B id, A id, document) per
   link.  Every ``run_records`` of them are sorted, side B first, folded, and
   written as one run: per radix of the B id a segment of its distinct pairs with
   their counts, and one of the documents that hold them, both zstd-compressed
   rows of a Parquet table in the shared folder.
2. Per radix a k-way heap merge over the runs' pair segments, read block by
   block, sums the counts; as a B id's pairs come together, its highest count is
   known when they are through.  More than ``fan_in`` runs are merged in rounds.
3. Per radix and bunch of ``fan_in`` runs, counts and maxima stream back over the runs'
   documents; a run's documents get the sums of its radices.

A hot token adds at most one pair row per run and A id to a merge, and its documents are
spread over the bunches, so no step holds all of its links.

Texts are cut where both tokenizers end a token in any case, so that equal words
are aligned once: before a single space or line end between other characters, and
before a sign after a letter, as far as no piece of B holds the two characters on
the cut's sides (else whole texts are encoded).

Null or empty texts, and texts whose tokens' bytes differ from a space and the
text (as those that hold U+2581): no tokens, zeros and an empty groups digest.
Repeated rows and rows without an id: each is a document of its own.
"""

from __future__ import annotations

import hashlib
import heapq
import math
import os
import re
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storelens.llm.base import id_text, slices
from storelens.llm.token_files import shared_folder

SPACE_MARK = "▁"
#: Radices (a power of two) that the B ids' low bits deal the pairs to.
RADICES = 32
_LETTER = re.compile(r"[^\W\d_]")
_PAIR = np.dtype([("step", "<u8"), ("n", "<i8")])
_TOTAL = np.dtype([("key", "<u8"), ("n", "<i8"), ("best", "<u1")])
_RECORD = np.dtype([("row", "<u4"), ("n", "<u4")])
_BLOCK = 1 << 14
_STATE: dict = {}


def byte_characters() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for:
    printable Latin-1 characters for themselves, the others, in order, from U+0100 on."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Aligner:
    """Both tokenizers of a worker and its table of aligned words."""

    def __init__(self, path_a: str, path_b: str, cache_size: int = 400_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.no_padding()
        self.a.no_truncation()
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        of = byte_characters()
        vocabulary = self.a.get_vocab(with_added_tokens=True)
        self.bytes_a = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            self.bytes_a[i] = bytes(of[c] for c in token) if all(c in of for c in token) else token.encode()
        size = self.b.get_piece_size()
        pieces = [self.b.id_to_piece(i) for i in range(size)]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(SPACE_MARK, " ").encode()
                        for i, p in enumerate(pieces)]
        self.length_a, self.length_b = (np.array(list(map(len, x)), np.int64) for x in (self.bytes_a, self.bytes_b))
        # a token's text by what follows it: another of its side, the other side or group, the next word
        self.text_a = np.array([[f"{i}{c}" for i in range(len(self.bytes_a))] for c in ",|"], object)
        self.text_b = np.array([[f"{i}{c}" for i in range(size)] for c in (",", ";", "\n")], object)
        self.shift = len(self.bytes_a).bit_length()  # a pair's key is b << shift | a
        self.cut = self._safe_cuts(p for i, p in enumerate(pieces) if not self.b.is_byte(i) and not self.b.is_control(i))
        self.cache_size = cache_size
        self._clear()

    @staticmethod
    def _safe_cuts(pieces) -> re.Pattern | None:
        """Where texts can be cut: no piece of B holds the characters on both sides."""
        after: dict[str, set[str]] = {}
        for p in pieces:
            for x, y in zip(p, p[1:]):
                after.setdefault(y, set()).add(x)
        if after.get(SPACE_MARK, set()) - {SPACE_MARK}:
            return None
        signs = [y for y in ".,;:!?" if not any(_LETTER.match(x) for x in after.get(y, ()))]
        ends = " " if after.get("\n") else " \n"
        cuts = [rf"(?<=\S)(?=[{ends}]\S)"] + [rf"(?<=[^\W\d_])(?=[{re.escape(''.join(signs))}])"] * bool(signs)
        return re.compile("|".join(cuts))

    def _clear(self) -> None:
        self.place: dict[str, int] = {}
        self.groups: list[str] = []
        self.sizes = np.zeros((0, 5), np.int64)  # ids of A, of B, groups, links, 1 if the bytes are the text's
        self.starts = np.zeros(1, np.int64)
        self.keys = np.zeros(0, np.uint64)

    def _spells(self, ids: list[int], table: list[bytes], text: bytes) -> bool:
        return b"".join(map(table.__getitem__, ids)) == text

    @staticmethod
    def _flat(found: list[list[int]], bare: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids end to end, without the first one of ``bare`` words, and each word's number of them."""
        n = np.fromiter(map(len, found), np.int64, len(found))
        ids = np.fromiter(chain.from_iterable(found), np.int64, int(n.sum()))
        return np.delete(ids, (np.cumsum(n) - n)[bare]), n - bare

    def _learn(self, words: list[str]) -> None:
        """Align new words, all in one pass: their bytes lie end to end, so that ends
        of tokens are prefix sums and links are ranges between them."""
        # a word without a space of its own is read behind a letter, whose token is then taken off
        bare = np.array([w[0] != " " for w in words])
        found_a = [e.ids for e in self.a.encode_batch_fast(
            [" a" + w if w[0] != " " else w for w in words], add_special_tokens=False)]
        found_b = self.b.encode(["a" + w if w[0] != " " else w[1:] for w in words], num_threads=1)
        # what the tokens must spell, word by word
        raw = [w.encode() if w[0] == " " else b" a" + w.encode() for w in words]
        bad = np.zeros(len(words), bool)
        if not (self._spells(list(chain.from_iterable(found_a)), self.bytes_a, text := b"".join(raw))
                and self._spells(list(chain.from_iterable(found_b)), self.bytes_b, text)):
            bad = np.array([not (self._spells(a, self.bytes_a, w) and self._spells(b, self.bytes_b, w))
                            for a, b, w in zip(found_a, found_b, raw)])
            found_a, found_b = ([[] if no else x for x, no in zip(y, bad)] for y in (found_a, found_b))
        (a, n_a), (b, n_b) = self._flat(found_a, bare & ~bad), self._flat(found_b, bare & ~bad)
        end_a, end_b = np.cumsum(self.length_a[a]), np.cumsum(self.length_b[b])
        # each B token is linked to the A tokens from the one that holds its first byte to the one that holds its last
        low = np.searchsorted(end_a, end_b - self.length_b[b], side="right")
        many = np.searchsorted(end_a, end_b, side="left") - low + 1
        links = np.cumsum(many)
        at = np.repeat(low - (links - many), many) + np.arange(links[-1] if len(links) else 0)
        keys = np.repeat(b.astype(np.uint64) << np.uint64(self.shift), many) | a[at].astype(np.uint64)
        both = np.intersect1d(end_a, end_b, assume_unique=True)
        group_a, group_b = np.searchsorted(both, end_a), np.searchsorted(both, end_b)
        last_a, last_b = both[group_a] == end_a, both[group_b] == end_b
        word_end = np.zeros(len(b), np.int64)
        word_end[np.cumsum(n_b)[n_b > 0] - 1] = 1
        # a group's A tokens come before its B tokens
        pieces = np.empty(len(a) + len(b), object)
        in_group_a, in_group_b = (np.bincount(g, minlength=len(both)) for g in (group_a, group_b))
        pieces[np.arange(len(a)) + (np.cumsum(in_group_b) - in_group_b)[group_a]] = self.text_a[last_a.astype(np.int64), a]
        pieces[np.arange(len(b)) + np.cumsum(in_group_a)[group_b]] = self.text_b[last_b + word_end, b]
        texts = iter("".join(pieces.tolist()).split("\n"))
        word = np.repeat(np.arange(len(words)), n_b)
        sizes = np.stack([n_a, n_b, np.bincount(word[last_b], minlength=len(words)),
                          np.bincount(word, weights=many, minlength=len(words)).astype(np.int64), ~bad], axis=1)
        self.place.update(zip(words, range(len(self.groups), len(self.groups) + len(words))))
        self.groups.extend("" if no else next(texts) for no in bad)
        self.sizes = np.concatenate([self.sizes, sizes])
        self.starts = np.concatenate([self.starts, self.starts[-1] + np.cumsum(sizes[:, 3])])
        self.keys = np.concatenate([self.keys, keys])

    def align(self, texts: list[str], with_groups: bool = False):
        """Per text: ids of A, of B, groups, links (n x 4) and the groups digest (with
        ``with_groups`` also the groups); and all links as (text, key)."""
        cut = [(self.cut.split(" " + t) if self.cut else [" " + t]) if t else [] for t in texts]
        new = set().union(*cut) - self.place.keys()
        if new and len(self.place) + len(new) > self.cache_size:
            self._clear()
            new = set().union(*cut)
        if new:
            self._learn(sorted(new))
        place = self.place.__getitem__
        codes = [np.fromiter(map(place, words), np.int64, len(words)) for words in cut]
        row = np.repeat(np.arange(len(texts)), [len(c) for c in codes])
        code = np.concatenate([*codes, np.zeros(0, np.int64)])
        sizes = np.zeros((len(texts), 5), np.int64)
        for k in range(5):
            sizes[:, k] = np.bincount(row, weights=self.sizes[code, k], minlength=len(texts))
        good = (sizes[:, 4] == [len(c) for c in codes]) & (sizes[:, 4] > 0)
        sizes[~good] = 0
        digests, groups = [], []
        for ok, c in zip(good, codes):
            text = ";".join(map(self.groups.__getitem__, c.tolist())) if ok else ""
            digests.append(hashlib.sha256(text.encode()).hexdigest() if ok else "")
            groups.append(text if with_groups else None)
        use = good[row]
        row, code = row[use], code[use]
        many = self.starts[code + 1] - self.starts[code]
        total = np.cumsum(many)
        at = np.repeat(self.starts[code] - (total - many), many) + np.arange(total[-1] if len(total) else 0)
        return sizes[:, :4], digests, groups, np.repeat(row, many), self.keys[at]


def worker_aligner(path_a: str, path_b: str) -> Aligner:
    if (path_a, path_b) not in _STATE:
        _STATE[path_a, path_b] = Aligner(path_a, path_b)
    return _STATE[path_a, path_b]


def _packed(a: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(a.tobytes())


def _unpacked(blob: bytes, kind: np.dtype) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().stream_reader(blob).readall(), kind)


def _steps(keys: np.ndarray) -> np.ndarray:
    return np.diff(keys, prepend=np.uint64(0))


def segments(keys: np.ndarray, rows: np.ndarray, shift: int, radices: int):
    """A run's (radix, pairs, records): ``keys`` and ``rows`` of all its links."""
    bits = np.uint64(int(rows.max()).bit_length() if len(rows) else 0)
    if int(keys.max() if len(keys) else 0).bit_length() + int(bits) <= 64:
        links = np.sort(keys << bits | rows.astype(np.uint64))
        key, row = links >> bits, (links & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.uint32)
    else:
        order = np.lexsort((rows, keys))
        key, row = keys[order], rows[order].astype(np.uint32)
    radix = ((key >> np.uint64(shift)) & np.uint64(radices - 1)).astype(np.int64)
    for r in np.unique(radix):
        k, w = key[radix == r], row[radix == r]
        new = np.ones(len(k), bool)
        new[1:] = (k[1:] != k[:-1]) | (w[1:] != w[:-1])
        at = np.flatnonzero(new)
        records = np.zeros(len(at), _RECORD)
        records["row"], records["n"] = w[at], np.diff(np.append(at, len(k)))
        first = np.flatnonzero(np.append(True, k[at][1:] != k[at][:-1]))
        pairs = np.zeros(len(first), _PAIR)
        pairs["step"] = _steps(k[at][first])
        pairs["n"] = np.add.reduceat(records["n"].astype(np.int64), first)
        many = np.diff(np.append(first, len(at))).astype("<u4")
        yield int(r), _packed(pairs), _packed(many), _packed(records)


class _Blocks:
    """A pair segment that is read block by block: keys and counts not yet taken."""

    def __init__(self, blob: bytes):
        self.stream = zstandard.ZstdDecompressor().stream_reader(blob)
        self.last = np.uint64(0)
        self.keys, self.n, self.done = np.zeros(0, np.uint64), np.zeros(0, np.int64), False
        self.more()

    def more(self) -> None:
        raw = self.stream.read(_BLOCK * _PAIR.itemsize)
        if not raw:
            self.done = True
            return
        got = np.frombuffer(raw, _PAIR)
        keys = self.last + np.cumsum(got["step"], dtype=np.uint64)
        self.last = keys[-1]
        self.keys, self.n = np.concatenate([self.keys, keys]), np.concatenate([self.n, got["n"]])

    def until(self, key: np.uint64 | None):
        """Take what lies below ``key`` (None: all)."""
        at = len(self.keys) if key is None else int(np.searchsorted(self.keys, key))
        out = self.keys[:at], self.n[:at]
        self.keys, self.n = self.keys[at:], self.n[at:]
        return out


def merge_runs(blobs: list[bytes], shift: int):
    """(keys, counts) of all pairs of the segments, ascending, in parts that never
    split a B id.  The heap holds, per run, the B id that its read blocks end with:
    all ids below the smallest of them are complete."""
    runs = [_Blocks(b) for b in blobs]
    heap = [(int(r.last) >> shift, i) for i, r in enumerate(runs) if len(r.keys)]
    heapq.heapify(heap)
    while heap:
        side, i = heapq.heappop(heap)
        before = runs[i].last
        runs[i].more()
        if not runs[i].done:
            heapq.heappush(heap, (int(runs[i].last) >> shift, i))
            if int(before) >> shift == int(runs[i].last) >> shift:
                continue  # still within the same B id
        bound = np.uint64(heap[0][0] << shift) if heap else None
        taken = [r.until(bound) for r in runs]
        keys = np.concatenate([k for k, _ in taken])
        if not len(keys):
            continue
        order = np.argsort(keys, kind="stable")
        keys, n = keys[order], np.concatenate([n for _, n in taken])[order]
        first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
        yield keys[first], np.add.reduceat(n, first)


def _merged(rows: pa.Table, shift: int) -> pa.Table:
    """One round: the runs of a bunch become one."""
    squeeze, out, last = zstandard.ZstdCompressor(level=1).compressobj(), [], np.uint64(0)
    for keys, n in merge_runs(rows["pairs"].to_pylist(), shift):
        part = np.zeros(len(keys), _PAIR)
        part["step"], part["n"] = np.diff(keys, prepend=last), n
        last = keys[-1]
        out.append(squeeze.compress(part.tobytes()))
    out.append(squeeze.flush())
    return pa.table({"radix": rows["radix"][:1], "run": rows["bunch"][:1].cast(pa.int64()),
                     "pairs": pa.array([b"".join(out)], pa.binary())})


def _totals(rows: pa.Table, shift: int) -> pa.Table:
    """The last round: each pair's count, and whether it is its B id's highest."""
    squeeze, out = zstandard.ZstdCompressor(level=1).compressobj(), []
    for keys, n in merge_runs(rows["pairs"].to_pylist(), shift):
        side = keys >> np.uint64(shift)
        first = np.flatnonzero(np.append(True, side[1:] != side[:-1]))
        highest = np.repeat(np.maximum.reduceat(n, first), np.diff(np.append(first, len(n))))
        part = np.zeros(len(keys), _TOTAL)
        part["key"], part["n"], part["best"] = keys, n, n == highest
        out.append(squeeze.compress(part.tobytes()))
    out.append(squeeze.flush())
    return pa.table({"radix": rows["radix"][:1], "totals": pa.array([b"".join(out)], pa.binary())})


def _contributions(runs: pa.Table, totals: pa.Table) -> pa.Table:
    """Per run and radix: its documents' links with a highest count and sums of counts."""
    found: dict[str, list] = {"run": [], "rows": [], "best": [], "counts": []}
    if runs.num_rows:
        total = _unpacked(totals["totals"][0].as_py(), _TOTAL)
        keys, n, best = (np.ascontiguousarray(total[c]) for c in ("key", "n", "best"))
        for i in range(runs.num_rows):
            pairs = _unpacked(runs["pairs"][i].as_py(), _PAIR)
            records = _unpacked(runs["records"][i].as_py(), _RECORD)
            at = np.repeat(np.searchsorted(keys, np.cumsum(pairs["step"], dtype=np.uint64)),
                           _unpacked(runs["many"][i].as_py(), np.dtype("<u4")))
            order = np.argsort(records["row"], kind="stable")
            row, links, at = records["row"][order], records["n"][order].astype(np.int64), at[order]
            first = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
            found["run"].append(runs["run"][i].as_py())
            found["rows"].append(row[first].astype("<u4").tobytes())
            found["best"].append(np.add.reduceat(links * best[at], first).astype("<i8").tobytes())
            found["counts"].append(np.add.reduceat(links * n[at], first).astype("<i8").tobytes())
    return pa.table({"run": pa.array(found["run"], pa.int64())} | {
        c: pa.array(found[c], pa.binary()) for c in ("rows", "best", "counts")})


def _finished(docs: pa.Table, sums: pa.Table) -> pa.Table:
    """A run's documents with what its radices add up to."""
    row = np.asarray(docs["row"], dtype=np.int64)
    best, counts = (np.zeros(int(row.max()) + 1 if len(row) else 0, np.int64) for _ in range(2))
    for i in range(sums.num_rows):  # a document occurs once in each of them
        at = np.frombuffer(sums["rows"][i].as_py(), "<u4").astype(np.int64)
        best[at] += np.frombuffer(sums["best"][i].as_py(), "<i8")
        counts[at] += np.frombuffer(sums["counts"][i].as_py(), "<i8")
    out = {c: docs[c] for c in ("doc_id", *SIZES)}
    return pa.table(out | {"n_best": pa.array(best[row]), "count_sum": pa.array(counts[row])} | {
        c: docs[c] for c in ("groups_sha256", "groups")})


SIZES = ("n_a", "n_b", "n_groups", "n_links")


def spill(df: DataFrame, path_a: str, path_b: str, folder: str, id_col: str = "doc_id", text_col: str = "text",
          run_records: int = 1 << 22, radices: int = RADICES, with_groups: bool = False) -> DataFrame:
    """Align all texts, write the runs (kind 1) and the documents (kind 0), and
    return that table."""
    docs = id_text(df, id_col, text_col)
    kind = docs.schema["doc_id"].dataType.simpleString()
    columns = {"kind": pa.int32(), "run": pa.int64(), "radix": pa.int32(), "pairs": pa.binary(), "many": pa.binary(),
               "records": pa.binary(), "doc_id": None, "row": pa.int64(), **{c: pa.int64() for c in SIZES},
               "groups_sha256": pa.string(), "groups": pa.string()}

    def batch_of(id_type: pa.DataType, **given) -> pa.RecordBatch:
        n = len(next(iter(given.values())))
        return pa.RecordBatch.from_arrays([given[c] if isinstance(given.get(c), pa.Array) else pa.array(
            given.get(c, [None] * n), k or id_type) for c, k in columns.items()], names=list(columns))

    def write(batches):
        aligner = worker_aligner(path_a, path_b)
        keys, rows, n_docs, held = [], [], 0, 0
        run = TaskContext.get().partitionId() << 32

        def flush():
            for radix, pairs, many, records in segments(np.concatenate(keys), np.concatenate(rows), aligner.shift, radices):
                yield batch_of(id_type, kind=[1], run=[run], radix=[radix], pairs=[pairs], many=[many], records=[records])

        for batch in batches:
            id_type = batch.schema.field(0).type
            for part in slices(batch):
                sizes, digests, groups, row, key = aligner.align(part.column(1).to_pylist(), with_groups)
                n = part.num_rows
                for a in range(0, n, 10_000):
                    b = min(n, a + 10_000)
                    yield batch_of(id_type, kind=[0] * (b - a), run=[run] * (b - a), doc_id=part.column(0).slice(a, b - a),
                                   row=np.arange(n_docs + a, n_docs + b),
                                   **{c: sizes[a:b, k] for k, c in enumerate(SIZES)}, groups_sha256=digests[a:b],
                                   groups=groups[a:b])
                keys.append(key)
                rows.append(row + n_docs)
                n_docs, held = n_docs + n, held + len(key)
                if held >= run_records:
                    yield from flush()
                    keys, rows, n_docs, held, run = [], [], 0, 0, run + 1
        if held:
            yield from flush()

    schema = (f"kind int, run long, radix int, pairs binary, many binary, records binary, doc_id {kind}, row long, "
              + ", ".join(f"{c} long" for c in SIZES) + ", groups_sha256 string, groups string")
    docs.mapInArrow(write, schema).write.partitionBy("kind").parquet(folder)
    return docs.sparkSession.read.schema(schema).parquet(folder)


def _bunched(df: DataFrame, bunches: int) -> DataFrame:
    return df.withColumn("bunch", F.pmod(F.xxhash64("run"), F.lit(bunches)).cast("int"))


def _pair_totals(runs: DataFrame, shift: int, n_runs: int, fan_in: int) -> DataFrame:
    """radix and its totals, merged in as many rounds as the runs ask for."""
    level = runs.select("radix", "run", "pairs")
    while n_runs > fan_in:
        n_runs = math.ceil(n_runs / fan_in)
        level = _bunched(level, n_runs).groupBy("radix", "bunch").applyInArrow(
            lambda rows: _merged(rows, shift), "radix int, run long, pairs binary")
    return level.groupBy("radix").applyInArrow(lambda rows: _totals(rows, shift), "radix int, totals binary")


def _spilled(df: DataFrame, path_a: str, path_b: str, **parameters):
    """The runs, the documents, the number of runs and the keys' shift."""
    table = spill(df, path_a, path_b, shared_folder(df.sparkSession, "alignment"), **parameters)
    runs = table.where("kind = 1").select("run", "radix", "pairs", "many", "records")
    docs = table.where("kind = 0").select("run", "row", "doc_id", *SIZES, "groups_sha256", "groups")
    return runs, docs, runs.select("run").distinct().count(), worker_aligner(path_a, path_b).shift


def align_tokens(df: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text",
                 run_records: int = 1 << 22, radices: int = RADICES, fan_in: int = 64,
                 with_groups: bool = False) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best (links whose pair has its B id's
    highest count, ties included), count_sum (of the links' pair counts),
    groups_sha256 ('' without tokens) and groups (null unless ``with_groups``; ids of a
    group's A and B tokens as ``a1,a2|b1``, groups joined by ``;``) of every text."""
    runs, docs, n_runs, shift = _spilled(df, path_a, path_b, id_col=id_col, text_col=text_col, run_records=run_records,
                                         radices=radices, with_groups=with_groups)
    bunches = max(1, math.ceil(n_runs / fan_in))
    totals = _pair_totals(runs, shift, n_runs, fan_in).withColumn(
        "bunch", F.explode(F.sequence(F.lit(0), F.lit(bunches - 1))))
    sums = _bunched(runs, bunches).groupBy("radix", "bunch").cogroup(totals.groupBy("radix", "bunch")).applyInArrow(
        _contributions, "run long, rows binary, best binary, counts binary")
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = (f"doc_id {kind}, " + ", ".join(f"{c} long" for c in (*SIZES, "n_best", "count_sum"))
              + ", groups_sha256 string, groups string")
    return docs.groupBy("run").cogroup(sums.groupBy("run")).applyInArrow(_finished, schema)


def pair_counts(df: DataFrame, path_a: str, path_b: str, fan_in: int = 64, **parameters) -> DataFrame:
    """b, a, n (links of the whole corpus) and best (whether n is the highest of b)
    of every pair of linked ids."""
    runs, _, n_runs, shift = _spilled(df, path_a, path_b, **parameters)

    def rows(batches):
        for batch in batches:
            for blob in batch.column(0).to_pylist():
                t = _unpacked(blob, _TOTAL)
                for i in range(0, len(t), 1 << 16):
                    part = t[i:i + (1 << 16)]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array((part["key"] >> np.uint64(shift)).astype(np.int64)),
                         pa.array((part["key"] & np.uint64((1 << shift) - 1)).astype(np.int64)), pa.array(part["n"]),
                         pa.array(part["best"].astype(bool))], names=["b", "a", "n", "best"])

    return _pair_totals(runs, shift, n_runs, fan_in).select("totals").mapInArrow(rows, "b long, a long, n long, best boolean")
