"""Benchmark decontamination (operator 1): an inverted BM25 index of the test
items with block maxima, queried with every training passage.

Index: an item's terms are its lower-cased runs of letters and digits; impacts
are BM25 contributions divided by the item's score against itself, so that a
passage that holds the whole item scores 1.  Items are laid out in blocks of
``block`` and every term keeps its largest impact in each block (block maxima).

Search (WAND in batches): passages are windows of twice the longest item's
words, each overlapping half of the next, so every item-long stretch lies in
one.  The most common terms - chosen so that no item gets more than half of
``threshold`` from them - only count through each block's largest sum of them.
A block is opened for a passage if its maxima for the passage's other terms and
that sum reach the threshold; items of opened blocks are scored in full, and
all that reach the threshold are retrieved: the bounds never drop one.

Verification: a word of an item is covered if one of its five-word shingles that
hold it occurs in the passage.  A passage leaks an item if the covered share of
the question's words and that of the answer's both reach ``overlap``.  Where the
benchmark has one text, its first two thirds of words are the question.

The index is broadcast in shards of at most ``shard_bytes`` of benchmark text,
one pass over the documents per shard; document frequencies, lengths and the window
are those of the whole benchmark, so scores don't depend on the shards.  Null or empty texts, items without
words and an empty benchmark give no rows.  Repeated rows: each is reported.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storelens.functions.sizing import cut_lineage
from storelens.llm.base import id_text, slices, span_hashes, utf8

SHINGLE = 5
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_TERM = np.zeros(256, bool)
_TERM[48:58] = _TERM[97:123] = _TERM[128:] = True


def terms(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the terms of each row, in order, and their rows.  Upper case is
    folded for ASCII and for the two-byte Latin letters."""
    low = _FOLD[data]
    second = np.flatnonzero((low[1:] >= 0x80) & (low[1:] <= 0x9E) & (low[:-1] == 0xC3)) + 1
    low[second] += 0x20
    n = len(low)
    if n == 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    inside = _TERM[low]
    begin, stop = inside.copy(), np.zeros(n + 1, bool)
    begin[1:] &= ~inside[:-1]
    stop[1:n] = inside[:-1] & ~inside[1:]
    stop[n] = inside[-1]
    cuts = offsets[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < n)]
    cuts = cuts[inside[cuts] & inside[cuts - 1]]
    begin[cuts] = True
    stop[cuts] = True
    starts, ends = np.flatnonzero(begin), np.flatnonzero(stop)
    return span_hashes(low, starts, ends), np.searchsorted(offsets, starts, side="right") - 1


def _ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The indices of many ranges, end to end."""
    total = np.cumsum(counts)
    return np.arange(total[-1] if len(total) else 0) + np.repeat(starts - (total - counts), counts)


def _run_shingles(words: np.ndarray) -> np.ndarray:
    """Hashes of the five-word shingles of one run of words (of all, if fewer)."""
    if len(words) < SHINGLE:
        return span_hashes(words, np.array([0]), np.array([len(words)])) if len(words) else np.zeros(0, np.uint64)
    at = np.arange(len(words) - SHINGLE + 1)
    return span_hashes(words, at, at + SHINGLE)


@dataclass
class Statistics:
    """Of the whole benchmark, whatever its shards: items with words, their mean
    and largest number of words, and the items that hold each of a shard's terms."""

    items: int
    mean: float
    longest: int
    terms: np.ndarray  # ascending
    df: np.ndarray


class Index:
    """The benchmark's index, or one shard of it with the statistics of the whole;
    see the module text."""

    def __init__(self, items: list[tuple[object, str, str]], threshold: float = 0.6, block: int = 8,
                 k1: float = 1.2, b: float = 0.75, whole: Statistics | None = None):
        self.threshold, self.block = threshold, block
        words = []
        self.names, self.split = [], []
        for name, question, answer in items:
            pair = [terms(*utf8(pa.array([s or ""])))[0] for s in (question, answer)]
            if len(pair[0]) + len(pair[1]):
                self.names.append(name)
                self.split.append(len(pair[0]))
                words.append(np.concatenate(pair))
        n = len(words)
        self.words = words
        self.grams = [_run_shingles(w) for w in words]
        self.window = 2 * (whole.longest if whole else max([len(w) for w in words], default=32))
        every = np.concatenate(words) if n else np.zeros(0, np.uint64)
        owner = np.repeat(np.arange(n), [len(w) for w in words])
        self.terms, code = np.unique(every, return_inverse=True)
        pairs, tf = np.unique(code * max(n, 1) + owner, return_counts=True)
        term, item = pairs // max(n, 1), pairs % max(n, 1)
        df = np.bincount(term, minlength=len(self.terms))
        size = np.array([len(w) for w in words], float)
        total, mean, held = (n, size.mean() if n else 1.0, df) if whole is None else (
            whole.items, whole.mean, whole.df[np.searchsorted(whole.terms, self.terms)])
        idf = np.log(1 + (total - held + 0.5) / (held + 0.5))
        impact = idf[term] * tf * (k1 + 1) / (tf + k1 * (1 - b + b * size[item] / mean)) if n else np.zeros(0)
        own = np.bincount(item, weights=impact, minlength=n)
        self.impact = impact / np.maximum(own[item], 1e-12) if n else impact
        self.item, self.start = item, np.searchsorted(term, np.arange(len(self.terms) + 1))
        # common terms: from the most frequent on, while no item gets over half the threshold from them
        self.common = np.zeros(len(self.terms), bool)
        mass = np.zeros(n)
        for t in np.argsort(-df, kind="stable"):
            rows = slice(self.start[t], self.start[t + 1])
            if df[t] < 2 or (mass[self.item[rows]] + self.impact[rows] > threshold / 2).any():
                break
            mass[self.item[rows]] += self.impact[rows]
            self.common[t] = True
        self.blocks = -(-n // block)
        self.common_most = np.zeros(self.blocks)
        np.maximum.at(self.common_most, np.arange(n) // block, mass)
        # block maxima of the other terms
        rare = ~self.common[term]
        key, inverse = np.unique(term[rare] * max(self.blocks, 1) + item[rare] // block, return_inverse=True)
        most = np.zeros(len(key))
        np.maximum.at(most, inverse, self.impact[rare])
        self.block_id, self.block_most = key % max(self.blocks, 1), most
        self.block_start = np.searchsorted(key // max(self.blocks, 1), np.arange(len(self.terms) + 1))

    def _expand(self, start: np.ndarray, term: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        counts = start[term + 1] - start[term]
        return _ranges(start[term], counts), np.repeat(np.arange(len(term)), counts)

    def search(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """All (row, item, score, question overlap, answer overlap) over the threshold."""
        none = (np.zeros(0, int), np.zeros(0, int), np.zeros(0), np.zeros(0), np.zeros(0))
        if not len(self.words):
            return none
        words, rows = terms(*utf8(texts))
        n = len(texts)
        first = np.searchsorted(rows, np.arange(n + 1))
        counts, stride = np.diff(first), self.window // 2
        windows = np.maximum(1, -(-counts // stride) - 1)  # of stride * 2 words, the last one shorter
        base = np.cumsum(windows) - windows
        at = np.minimum(np.searchsorted(self.terms, words), len(self.terms) - 1)
        known = np.flatnonzero(self.terms[at] == words)
        term, row = at[known], rows[known]
        half = (known - first[row]) // stride
        # each word lies in the window that begins in its half and in the one before
        late = half < windows[row]
        window = np.concatenate([base[row[late]] + half[late], base[row[half > 0]] + half[half > 0] - 1])
        term = np.concatenate([term[late], term[half > 0]])
        rare = ~self.common[term]
        keys = np.unique(window[rare] * len(self.terms) + term[rare])
        seen_window, seen_term = keys // len(self.terms), keys % len(self.terms)
        post, of = self._expand(self.block_start, seen_term)
        cell = seen_window[of] * self.blocks + self.block_id[post]
        cells, inverse = np.unique(cell, return_inverse=True)
        bound = np.bincount(inverse, weights=self.block_most[post], minlength=len(cells))
        opened = cells[bound + self.common_most[cells % self.blocks] >= self.threshold - 1e-9]
        if not len(opened):
            return none
        # items of the opened blocks in full
        live = np.unique(opened // self.blocks)
        place = np.minimum(np.searchsorted(live, window), len(live) - 1)
        mine = live[place] == window
        keys = np.unique(place[mine] * len(self.terms) + term[mine])
        post, of = self._expand(self.start, keys % len(self.terms))
        pair = (keys // len(self.terms))[of] * len(self.words) + self.item[post]
        inside = np.isin(live[pair // len(self.words)] * self.blocks + pair % len(self.words) // self.block, opened)
        pairs, inverse = np.unique(pair[inside], return_inverse=True)
        score = np.bincount(inverse, weights=self.impact[post[inside]], minlength=len(pairs))
        good = score >= self.threshold - 1e-9
        pairs, score = pairs[good], score[good]
        w, item = live[pairs // len(self.words)], pairs % len(self.words)
        row = np.searchsorted(base, w, side="right") - 1
        found: dict[tuple[int, int], tuple[float, float, float]] = {}
        for r, i, s, win in zip(row, item, score, w):
            a = first[r] + (win - base[r]) * stride
            q, ans = self.overlaps(i, words[a:min(a + 2 * stride, first[r + 1])])
            old = found.get((r, i), (-1.0, -1.0, -1.0))
            if (min(q, ans), s) > (min(old[1:]), old[0]):
                found[r, i] = (s, q, ans)
        keys_ = sorted(found)
        values = [found[k] for k in keys_]
        return (np.array([k[0] for k in keys_], int), np.array([k[1] for k in keys_], int),
                *(np.array([v[j] for v in values], float) for j in range(3)))

    def overlaps(self, i: int, passage: np.ndarray) -> tuple[float, float]:
        """Covered shares of the item's question and answer words."""
        n, size = len(self.words[i]), min(SHINGLE, len(self.words[i]))
        if len(passage) < size:
            return 0.0, 0.0
        at = np.arange(len(passage) - size + 1)
        hit = np.isin(self.grams[i], span_hashes(passage, at, at + size))
        covered = np.zeros(n, bool)
        for j in range(size):
            covered[np.flatnonzero(hit) + j] = True
        cut = self.split[i]
        q = covered[:cut].mean() if cut else 1.0
        return float(q), float(covered[cut:].mean() if cut < n else 1.0)


def _halves(text: str) -> tuple[str, str]:
    """The first two thirds of a text's words, and the rest."""
    words = (text or "").split()
    cut = -(-2 * len(words) // 3)
    return " ".join(words[:cut]), " ".join(words[cut:])


def _item_terms(items: DataFrame, shards: int, pairs: bool) -> DataFrame:
    """shard, n_words and terms (distinct hashes) of every item with words."""
    def find(batches):
        for batch in batches:
            for part in slices(batch, "q"):
                n = part.num_rows
                # as the index reads them: the halves of a text are its words, joined by spaces
                texts = part.column(1) if pairs else pa.array([" ".join(t.split()) for t in part.column(1).to_pylist()],
                                                              pa.string())
                words, rows = terms(*utf8(texts))
                more, more_rows = terms(*utf8(part.column(2)))
                words, rows = np.concatenate([words, more]), np.concatenate([rows, more_rows])
                counts = np.bincount(rows, minlength=n)
                each = [np.unique(words[rows == i]).view(np.int64) for i in range(n)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(counts, pa.int64()), pa.array(
                    each, pa.list_(pa.int64()))], names=["shard", "n_words", "terms"]).filter(pa.array(counts > 0))

    rows = items.select(_shard(shards).alias("shard"), "q", F.coalesce("a", F.lit("")).alias("a"))
    return cut_lineage(rows.mapInArrow(find, "shard long, n_words long, terms array<long>"))


def _shard(shards: int):
    return F.pmod(F.xxhash64("i", "q"), F.lit(shards))


def indexes(benchmark: DataFrame, item_col: str = "item_id", **parameters) -> list[Index]:
    """All shards of :func:`index_shards` at once."""
    return list(index_shards(benchmark, item_col, **parameters))


def index_shards(benchmark: DataFrame, item_col: str = "item_id", text_col: str = "text", question_col: str | None = None,
            answer_col: str | None = None, threshold: float = 0.6, shard_bytes: int = 8 << 20) -> Iterator[Index]:
    """The index, or its shards one after another, of about ``shard_bytes`` / 2 of text
    each (an item at least).  Document frequencies, lengths and the window are those of
    the whole benchmark, counted on Spark, so that no score depends on the shards; a
    shard gets the frequencies of its own terms."""
    if question_col:
        items = benchmark.select(F.col(item_col).alias("i"), F.coalesce(question_col, F.lit("")).alias("q"),
                                 F.coalesce(F.col(answer_col) if answer_col else F.lit(""), F.lit("")).alias("a"))
    else:
        items = benchmark.select(F.col(item_col).alias("i"), F.coalesce(text_col, F.lit("")).alias("q"),
                                 F.lit(None).cast("string").alias("a"))
    total = items.select(F.sum(F.octet_length("q") + F.coalesce(F.octet_length("a"), F.lit(0)))).first()[0] or 0
    shards = max(1, -(-2 * total // shard_bytes) if total > shard_bytes else 1)
    if shards > 1:
        held = _item_terms(items, shards, bool(question_col))
        n, mean, longest = held.agg(F.count("*"), F.avg("n_words"), F.max("n_words")).first()
        each = held.select("shard", F.explode("terms").alias("term"))
        df = each.groupBy("term").agg(F.count("*").alias("df"))
        of = cut_lineage(each.distinct().join(df, "term"))
    for s in range(shards):
        rows = items.where(_shard(shards) == s).orderBy("i", "q").collect()
        whole = None
        if shards > 1 and n:
            own = of.where(F.col("shard") == s).select("term", "df").toArrow()
            known = own["term"].to_numpy().view(np.uint64)
            order = np.argsort(known)
            whole = Statistics(n, mean, longest, known[order], own["df"].to_numpy()[order])
        yield Index([(r.i, *((r.q, r.a) if question_col else _halves(r.q))) for r in rows], threshold, whole=whole)


def find_leaks(df: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
               item_col: str = "item_id", overlap: float = 0.8, **index) -> DataFrame:
    """doc_id, item_id, score, question_overlap, answer_overlap of every
    document and test item that it leaks."""
    docs = id_text(df, id_col, text_col)
    id_kind = docs.schema["doc_id"].dataType.simpleString()
    item_kind = benchmark.schema[item_col].dataType.simpleString()
    schema = f"doc_id {id_kind}, item_id {item_kind}, score double, question_overlap double, answer_overlap double"
    out = None
    for shard in index_shards(benchmark, item_col, **index):
        shared = docs.sparkSession.sparkContext.broadcast(shard)

        def search(batches, shared=shared):
            for batch in batches:
                for part in slices(batch):
                    row, item, score, q, a = shared.value.search(part.column(1))
                    good = np.minimum(q, a) >= overlap - 1e-9
                    names = shared.value.names
                    yield pa.RecordBatch.from_arrays(
                        [part.column(0).take(pa.array(row[good])), pa.array([names[i] for i in item[good]]).cast(
                            _arrow(item_kind)), pa.array(score[good]), pa.array(q[good]), pa.array(a[good])],
                        names=["doc_id", "item_id", "score", "question_overlap", "answer_overlap"])

        found = docs.mapInArrow(search, schema)
        out = found if out is None else out.unionByName(found)
    return out


def _arrow(kind: str) -> pa.DataType:
    return {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[kind]


def drop_leaks(df: DataFrame, benchmark: DataFrame, text_col: str = "text", overlap: float = 0.8, **index) -> DataFrame:
    """The rows of ``df``, all columns, whose text leaks no test item."""
    out, at = df, df.columns.index(text_col)
    for shard in index_shards(benchmark, **index):
        shared = df.sparkSession.sparkContext.broadcast(shard)

        def keep(batches, shared=shared):
            for batch in batches:
                for part in slices(batch, text_col):
                    row, _, _, q, a = shared.value.search(part.column(at))
                    clean = np.ones(part.num_rows, bool)
                    clean[row[np.minimum(q, a) >= overlap - 1e-9]] = False
                    yield part.filter(pa.array(clean))

        out = out.mapInArrow(keep, df.schema)
    return out
