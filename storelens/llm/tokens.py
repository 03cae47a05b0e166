"""Token counts by a two-tier lookup on the map side (operator 8), and the
pre-token encoder that the token files share.

Texts are cut into the tokenizer's pre-tokens with array operations (lower
case; runs of letters, single digits, runs of other signs, contractions), and
each pre-token is looked up by its 64-bit hash.  Tier 1 is a broadcast table of
frequent pre-tokens' lengths (at most ``table_size`` entries of 12 bytes, counted
over all texts by bounded summaries, one a task);
tier 2 is each worker's own table: what tier 1 lacks is encoded by the library,
all new pre-tokens of a slice in one call, and kept (two generations of at most
``cache_size`` entries).  Nothing is shuffled by pre-token.  Texts with special
tokens' strings or with signs whose rules differ between Unicode versions are
encoded whole by the library.

Null text: the empty text, 0 tokens.  Repeated rows: a result each.
"""

from __future__ import annotations

import os
import unicodedata

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storelens.llm.base import id_text, slices, span_hashes

SPACE, LETTER, DIGIT, SIGN, ODD = range(5)
#: The characters that the tokenizer takes as white space.
WHITE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
#: The letters that make a contraction after a single apostrophe.
SHORT_TAILS, LONG_TAILS = "stmd", ("re", "ve", "ll")

_STATE: dict = {}


def tokenizer(path: str):
    """The tokenizer in ``path``, loaded once by each worker."""
    if path not in _STATE:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        t.no_padding()
        t.no_truncation()
        _STATE[path] = t
    return _STATE[path]


def id_width(path: str, end_id: int | None) -> int:
    """Bytes of an unsigned integer that holds every id of the tokenizer."""
    return 2 if max(tokenizer(path).get_vocab_size(True) - 1, end_id or 0) < 1 << 16 else 4


def _characters() -> tuple[np.ndarray, np.ndarray]:
    """Class and lower case of each character of the first two planes."""
    if "characters" not in _STATE:
        n = 0x20000
        kind, lower = np.full(n + 1, ODD, np.uint8), np.arange(n + 1, dtype=np.uint32)
        for c in range(n):
            ch = chr(c)
            cat = unicodedata.category(ch)
            kind[c] = {"L": LETTER, "N": DIGIT, "C": ODD}.get(cat[0], SIGN)
            if cat in ("Cc", "Cf"):
                kind[c] = SIGN
            if len(low := ch.lower()) == 1:
                lower[c] = ord(low)
            else:
                kind[c] = ODD
        kind[ord("Σ")] = ODD  # its lower case depends on its place in the word
        kind[WHITE] = SPACE
        _STATE["characters"] = kind, lower
    return _STATE["characters"]


def pre_tokens(texts: list[str], special: tuple[str, ...]):
    """(lower-cased code points, starts, ends, rows) of all pre-tokens, and the
    rows that the library must encode whole."""
    kind_of, lower_of = _characters()
    texts = [t if t.isascii() or unicodedata.is_normalized("NFC", t) else unicodedata.normalize("NFC", t) for t in texts]
    points = np.frombuffer(" ".join(texts).encode("utf-32-le"), "<u4")
    if not len(points):
        z = np.zeros(0, np.int64)
        return points, z, z, z, []
    points = np.minimum(points, 0x20000)
    lengths = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    row_ends = np.cumsum(lengths)
    kind, points = kind_of[points], lower_of[points]
    odd = {i for i, t in enumerate(texts) if "<" in t and any(s in t for s in special)}
    odd |= set(np.searchsorted(row_ends, np.flatnonzero(kind == ODD), side="right").tolist())
    for i in odd:
        kind[row_ends[i] - lengths[i]:row_ends[i] - 1] = SPACE
    n = len(kind)
    begin = np.empty(n + 1, bool)
    begin[0], begin[n] = True, True
    np.not_equal(kind[1:], kind[:-1], out=begin[1:n])
    begin[:n] |= kind == DIGIT
    # contractions: a run of one apostrophe and the letters after it
    quotes = np.flatnonzero(points[:-1] == ord("'"))
    quotes = quotes[begin[quotes] & begin[quotes + 1] & (kind[quotes + 1] == LETTER)]
    if len(quotes):
        one, two = points[quotes + 1], points[np.minimum(quotes + 2, n - 1)]
        short = np.isin(one, [ord(c) for c in SHORT_TAILS])
        long = np.zeros(len(quotes), bool)
        for a, b in LONG_TAILS:
            long |= (one == ord(a)) & (two == ord(b)) & (quotes + 2 < n)
        size = np.where(short, 2, np.where(long, 3, 0))
        quotes, size = quotes[size > 0], size[size > 0]
        begin[quotes + 1] = False
        after = quotes + size
        begin[after[(after < n)]] = True
    at = np.flatnonzero(begin)
    starts, ends = at[:-1], at[1:]
    keep = kind[starts] != SPACE
    starts, ends = starts[keep], ends[keep]
    return points, starts, ends, np.searchsorted(row_ends, starts, side="right"), sorted(odd)


class Table:
    """Sorted 64-bit hashes of pre-tokens with the place of their ids in a pool
    (or, without ``keep_ids``, with their number of ids only)."""

    def __init__(self, keep_ids: bool):
        self.hashes, self.lengths = np.zeros(0, np.uint64), np.zeros(0, np.int32)
        self.starts = np.zeros(0, np.int64)
        self.pool = np.zeros(0, np.uint32) if keep_ids else None
        self.used = 0

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Position of each hash, or -1."""
        if not len(self.hashes):
            return np.full(len(hashes), -1)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where(self.hashes[at] == hashes, at, -1)

    def add(self, hashes: np.ndarray, lengths: np.ndarray, ids: np.ndarray) -> None:
        """``hashes`` ascending and not in the table; ``ids`` end to end."""
        at = np.searchsorted(self.hashes, hashes)
        self.hashes = np.insert(self.hashes, at, hashes)
        self.lengths = np.insert(self.lengths, at, lengths)
        if self.pool is not None:
            self.starts = np.insert(self.starts, at, self.used + np.cumsum(lengths) - lengths)
            if self.used + len(ids) > len(self.pool):
                self.pool = np.concatenate([self.pool, np.zeros(max(len(self.pool), len(ids), 1 << 16), np.uint32)])
            self.pool[self.used:self.used + len(ids)] = ids
            self.used += len(ids)


class Encoder:
    """A worker's encoder: tier 1 (``frequent``: hashes and lengths) if only
    counts are wanted, and the worker's own table."""

    def __init__(self, path: str, keep_ids: bool, cache_size: int, frequent: Table | None = None):
        self.tokenizer, self.cache_size, self.frequent = tokenizer(path), cache_size, frequent
        self.keep_ids, self.own, self.old = keep_ids, Table(keep_ids), Table(keep_ids)
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.word_end = np.zeros(max(vocabulary.values()) + 1, bool)
        self.word_end[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.special = tuple(t.content for t in self.tokenizer.get_added_tokens_decoder().values())

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)

    def encode_all(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Lengths and ids of single pre-tokens: joined by spaces, cut at word ends."""
        lengths, ids = [np.zeros(0, np.int64)], [np.zeros(0, np.uint32)]
        for a in range(0, len(pieces), 8_192):
            some = pieces[a:a + 8_192]
            lines = [" ".join(some[i:i + 64]) for i in range(0, len(some), 64)]
            got = np.concatenate([np.array(e.ids, np.uint32)
                                  for e in self.tokenizer.encode_batch_fast(lines, add_special_tokens=False)])
            cut = np.flatnonzero(self.word_end[got]) + 1
            if len(cut) == len(some) and cut[-1] == len(got):
                lengths.append(np.diff(cut, prepend=0))
                ids.append(got)
            else:  # a vocabulary without word ends: one call a piece
                each = [self.whole(p) for p in some]
                lengths.append(np.array([len(x) for x in each]))
                ids.extend(each)
        return np.concatenate(lengths), np.concatenate(ids)

    def resolve(self, points: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray,
                first: np.ndarray) -> None:
        """Bring the distinct ``hashes`` (``first``: where one occurs) into the own table."""
        if self.frequent is not None:
            rest = self.frequent.find(hashes) < 0
            hashes, first = hashes[rest], first[rest]
        if len(self.own.hashes) > self.cache_size:
            self.old, self.own = self.own, Table(self.keep_ids)
        missing = self.own.find(hashes) < 0
        hashes, first = hashes[missing], first[missing]
        at = self.old.find(hashes)
        if (known := at >= 0).any():
            ids = self._gather(self.old, at[known]) if self.keep_ids else np.zeros(0, np.uint32)
            self.own.add(hashes[known], self.old.lengths[at[known]], ids)
        if not known.all():
            raw = points.astype("<u4").tobytes()
            pieces = [raw[4 * i:4 * j].decode("utf-32-le") for i, j in zip(starts[first[~known]], ends[first[~known]])]
            self.own.add(hashes[~known], *self.encode_all(pieces))

    def own_lengths(self, hashes: np.ndarray) -> np.ndarray:
        """Number of ids by the own table (0 where it lacks a hash)."""
        at = self.own.find(hashes)
        return np.where(at >= 0, self.own.lengths[at] if len(self.own.lengths) else 0, 0)

    @staticmethod
    def _gather(table: Table, at: np.ndarray) -> np.ndarray:
        lengths = table.lengths[at].astype(np.int64)
        total = np.cumsum(lengths)
        if not len(total):
            return np.zeros(0, np.uint32)
        return table.pool[np.repeat(table.starts[at] - (total - lengths), lengths) + np.arange(total[-1])]

    def _lookup(self, texts: list[str]):
        points, starts, ends, rows, odd = pre_tokens(texts, self.special)
        hashes, first, inverse = np.unique(span_hashes(points, starts, ends), return_index=True, return_inverse=True)
        self.resolve(points, starts, ends, hashes, first)
        return hashes, inverse, rows, odd

    def counts(self, texts: list[str]) -> np.ndarray:
        """Number of tokens of each text."""
        hashes, inverse, rows, odd = self._lookup(texts)
        lengths = self.own_lengths(hashes)
        if self.frequent is not None:
            tier1 = self.frequent.find(hashes)
            lengths = np.where(tier1 >= 0, self.frequent.lengths[tier1] if len(self.frequent.lengths) else 0, lengths)
        out = np.bincount(rows, weights=lengths[inverse], minlength=len(texts)).astype(np.int64)
        for i in odd:
            out[i] = len(self.whole(texts[i]))
        return out

    def ids(self, texts: list[str]) -> list[np.ndarray]:
        """The token ids of each text."""
        hashes, inverse, rows, odd = self._lookup(texts)
        at = self.own.find(hashes)[inverse]
        counts = np.bincount(rows, weights=self.own.lengths[at], minlength=len(texts)).astype(np.int64)
        out = np.split(self._gather(self.own, at), np.cumsum(counts)[:-1]) if texts else []
        for i in odd:
            out[i] = self.whole(texts[i])
        return out


def worker_encoder(path: str, keep_ids: bool, cache_size: int, frequent: Table | None = None) -> Encoder:
    """The worker's encoder of that kind; its own table outlives a change of tier 1."""
    key = ("encoder", path, keep_ids)
    if key not in _STATE:
        _STATE[key] = Encoder(path, keep_ids, cache_size)
    _STATE[key].frequent, _STATE[key].cache_size = frequent, cache_size
    return _STATE[key]


class Summary:
    """The most frequent of all hashes seen, at most ``size`` of them (a mergeable
    Misra-Gries summary): counts are too low by at most seen / (size + 1), so
    whatever makes up more than that share is in it."""

    def __init__(self, size: int):
        self.size, self.hashes, self.n = size, np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def add(self, hashes: np.ndarray, n: np.ndarray) -> None:
        """``hashes`` are distinct."""
        both, at = np.unique(np.concatenate([self.hashes, hashes]), return_inverse=True)
        total = np.zeros(len(both), np.int64)
        np.add.at(total, at, np.concatenate([self.n, n]))
        if len(both) > self.size:
            total -= np.partition(total, len(total) - self.size - 1)[len(total) - self.size - 1]
            both, total = both[total > 0], total[total > 0]
        self.hashes, self.n = both, total


def frequent_lengths(df: DataFrame, path: str, table_size: int = 65_536, summary_size: int = 16_384,
                     cache_size: int = 1_000_000) -> Table:
    """Tier 1: token counts of the most frequent pre-tokens of all texts.

    Each task sums up its pre-tokens in a :class:`Summary` and returns hash,
    count and number of ids of what is left in it, at most ``summary_size`` rows
    of 20 bytes whatever the texts; no pre-token moves.  Over all tasks a
    pre-token's count is too low by at most its N / (summary_size + 1) of N
    pre-tokens.  The table only saves work: counts are the same with any table."""

    def count(batches):
        encoder = worker_encoder(path, False, cache_size)
        summary, known = Summary(summary_size), Table(False)
        for batch in batches:
            for part in slices(batch):
                points, starts, ends, _, _ = pre_tokens(part.column(0).to_pylist(), encoder.special)
                hashes, first, n = np.unique(span_hashes(points, starts, ends), return_index=True, return_counts=True)
                summary.add(hashes, n)
                # lengths while the slice is at hand, for those that stay in the summary
                new = np.isin(hashes, summary.hashes) & (known.find(hashes) < 0)
                encoder.resolve(points, starts, ends, hashes[new], first[new])
                at = known.find(summary.hashes)
                lengths = np.where(at >= 0, known.lengths[at] if len(known.lengths) else 0,
                                   encoder.own_lengths(summary.hashes))
                known.hashes, known.lengths = summary.hashes, lengths.astype(np.int32)
        yield pa.RecordBatch.from_pydict({"hash": pa.array(summary.hashes.view(np.int64)), "n": pa.array(summary.n),
                                          "length": pa.array(known.lengths, pa.int32())})

    top = (df.select("text").mapInArrow(count, "hash long, n long, length int")
           .groupBy("hash").agg(F.sum("n").alias("n"), F.first("length").alias("length"))
           .orderBy(F.desc("n"), "hash").limit(table_size))
    rows = top.select("hash", "length").collect()  # at most table_size pairs
    table = Table(False)
    if rows:
        hashes = np.array([r["hash"] for r in rows], np.int64).view(np.uint64)
        order = np.argsort(hashes)
        table.add(hashes[order], np.array([r["length"] for r in rows], np.int32)[order], np.zeros(0, np.uint32))
    return table


def token_counts(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 2048,
                 table_size: int = 65_536, summary_size: int = 16_384, cache_size: int = 1_000_000) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (n_tokens > ``limit``) of every text."""
    docs = id_text(df, id_col, text_col)
    tier1 = frequent_lengths(docs, path, table_size, summary_size, cache_size)
    frequent = docs.sparkSession.sparkContext.broadcast(tier1)

    def count(batches):
        encoder = worker_encoder(path, False, cache_size, frequent.value)
        for batch in batches:
            for part in slices(batch):
                col = part.column(1)
                size = np.asarray(pa.compute.binary_length(col), dtype=np.int64)
                n_tokens = encoder.counts(col.to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(size), pa.array(n_tokens), pa.array(n_tokens > limit)],
                    names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(count, f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean")
