"""Periodic runs of words by string synchronising sets (operator 12).

A run is a stretch of consecutive words with smallest period q and length at
least max(``min_length``, 3 q) that no neighbouring word extends with period q.

The words of a slice of texts are one sequence of 64-bit word names, with a name
of its own after each text, so that nothing equal crosses a text's end.

* Small periods (below 16) come from highly periodic regions, found by comparing
  the sequence with itself shifted by each of them.
* For each dyadic scale t = 8, 16, 32, ... the synchronising set holds the
  positions i where, of the hashed names of the length-t windows at i .. i + t,
  the smallest is the first or the last one; windows with a period up to t / 3
  take no part (they lie in runs of smaller scales).  Whether i is in the set
  depends on the 2 t words from i on only, and any t consecutive positions outside
  highly periodic regions hold one.
* So a run of period 2 t <= q < 4 t holds two positions of the set at distance q
  with the same 2 t words: the run leaves 2 q - 2 t >= q places for the first one,
  and they can't all be highly periodic, else q were not its smallest period.
  Equal-context pairs at such distances (at most 12 a position, as equal contexts
  are over t / 3 apart) propose q.
* Each proposal is extended to both sides by comparing names; of runs over the
  same stretch the smallest period stays.

Work is about words x scales^2, memory a few arrays of a slice's words; one very
long text is a slice of its own.  No text, period or pair is capped.

Null text: the empty text, no runs.  Texts without words: no runs, empty
collapsed text.  Repeated rows: a result each.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storelens.llm.base import id_text, mix, slices, span_hashes, utf8, words
from storelens.llm.fingerprint import SPACES, let

#: The smallest scale; periods below twice of it are found by shifts.
SCALE = 8
_LAST = np.uint64(0xFFFFFFFFFFFFFFFF)


def _stretches(v: np.ndarray, q: int, least: int) -> list[tuple[int, int]]:
    """Maximal [s, e) of at least ``least`` names with period q."""
    at = np.flatnonzero(v[q:] == v[:-q])
    if len(at) < least - q:
        return []
    cut = np.flatnonzero(np.diff(at) != 1) + 1
    begin, stop = np.append(0, cut), np.append(cut, len(at))
    long = stop - begin >= least - q
    return [(int(at[b]), int(at[e - 1]) + 1 + q) for b, e in zip(begin[long], stop[long])]


def _extend(v: np.ndarray, i: int, d: int) -> tuple[int, int]:
    """The maximal stretch with period d around i, i + d (which are equal)."""
    x, step, n = i, 64, len(v) - d
    while x < n:
        step = min(step, n - x)
        differ = np.flatnonzero(v[x:x + step] != v[x + d:x + d + step])
        if len(differ):
            x += int(differ[0])
            break
        x, step = x + step, 2 * step
    y, step = i, 64
    while y > 0:
        step = min(step, y)
        differ = np.flatnonzero(v[y - step:y] != v[y - step + d:y + d])
        if len(differ):
            y += int(differ[-1]) + 1 - step
            break
        y, step = y - step, 2 * step
    return y, x + d


def _synchronising(ids: np.ndarray, t: int, periodic: np.ndarray) -> np.ndarray:
    """The synchronising set of scale t.  ``ids``: names of the length-t windows;
    ``periodic``: windows that take no part."""
    ids = np.where(periodic, _LAST, ids)
    least, width = ids, 1
    while width < t:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    least = np.minimum(least[:-1], least[1:])  # of t + 1 windows
    n = len(least)
    return np.flatnonzero(((ids[:n] == least) | (ids[t:t + n] == least)) & (least != _LAST))


def _proposals(where: np.ndarray, context: np.ndarray, t: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of positions with equal contexts at a distance from 2 t to 4 t, as
    (distance, first position) in that order."""
    order = np.lexsort((where, context))
    c, p = context[order], where[order]
    found_d, found_i = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for k in range(1, 13):
        same = c[k:] == c[:-k]
        if not same.any():
            break
        d = p[k:] - p[:-k]
        good = same & (d >= 2 * t) & (d < 4 * t)
        found_d.append(d[good])
        found_i.append(p[:-k][good])
    d, i = np.concatenate(found_d), np.concatenate(found_i)
    order = np.lexsort((i, d))
    return d[order], i[order]


def runs(v: np.ndarray, fits, min_length: int = 24) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of a sequence of names, by start and
    period.  ``fits(m)``: how long the sequence's prefix is that holds all texts
    of at least m words (no run of such a length lies beyond it)."""
    small = 2 * SCALE
    found: dict[tuple[int, int], int] = {}
    short: dict[int, list[tuple[int, int, int]]] = {SCALE: [], 2 * SCALE: []}
    for q in range(1, small):
        for s, e in _stretches(v, q, min(x for x in (max(min_length, 3 * q), *(t for t in short if 3 * q <= t)))):
            if e - s >= max(min_length, 3 * q):
                found.setdefault((s, e), q)
            for t, regions in short.items():
                if 3 * q <= t <= e - s:
                    regions.append((s, e, q))
    t, names = 1, v
    while True:
        n = fits(max(min_length, 6 * t))
        if n == 0 or n < 2 * t:
            break
        names = names[:n - t + 1]
        double = mix(names[:len(names) - t] ^ mix(names[t:] + np.uint64(0x5EED)))  # of windows of 2 t
        if t >= SCALE:
            periodic = np.zeros(len(names), bool)
            regions = short.get(t)
            if regions is None:
                regions = [(s, e, q) for (s, e), q in found.items() if 3 * q <= t <= e - s]
            for s, e, _ in regions:
                periodic[s:max(s, e - t + 1)] = True
            where = _synchronising(names, t, periodic)
            last_d, last_e = 0, 0
            for d, i in zip(*(x.tolist() for x in _proposals(where, double[where], t))):
                if d == last_d and i + d < last_e:
                    continue  # within the stretch just found
                s, e = _extend(v, i, d)
                last_d, last_e = d, e
                if e - s >= max(min_length, 3 * d):
                    found[s, e] = min(d, found.get((s, e), d))
        t, names = 2 * t, double
    return sorted((s, e - s, q) for (s, e), q in found.items())


def text_runs(data: np.ndarray, offsets: np.ndarray, min_length: int = 24):
    """Word counts of each row and all runs as (row, start, length, period)."""
    n_rows = len(offsets) - 1
    starts, ends, rows = words(data, offsets)
    counts = np.bincount(rows, minlength=n_rows)
    if not len(rows):
        return counts, []
    hashed = span_hashes(data, starts, ends)
    # the longest texts first, so that those that matter for a scale are a prefix
    order = np.argsort(-counts, kind="stable")
    sizes = counts[order] + 1
    begin = np.cumsum(sizes) - sizes
    place = np.empty(n_rows, np.int64)
    place[order] = begin
    first = np.cumsum(counts) - counts
    v = mix(np.arange(int(sizes.sum()), dtype=np.uint64) + np.uint64(0xE0D0_0000_0000))  # ends of texts: all differ
    v[place[rows] + np.arange(len(rows)) - first[rows]] = hashed
    down = -counts[order]

    def fits(m: int) -> int:
        k = int(np.searchsorted(down, -m, side="right"))
        return int(begin[k - 1] + sizes[k - 1]) if k else 0

    found = runs(v, fits, min_length)
    at = np.searchsorted(begin, [s for s, _, _ in found], side="right") - 1
    return counts, [(int(order[k]), s - int(begin[k]), length, q) for k, (s, length, q) in zip(at, found)]


def _kept(own: list[tuple[int, int, int]], n: int) -> np.ndarray:
    """Which words stay: a run's first period does, the rest of it goes."""
    change = np.zeros(n + 1, np.int64)
    for s, length, q in own:
        change[s + q] += 1
        change[s + length] -= 1
    return np.cumsum(change[:n]) == 0


def periodic_runs(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = 24) -> DataFrame:
    """doc_id, n_words, runs (an array of start, length, period by start, then
    period), best (the run with the greatest length / period; ties: the smallest
    start, then period; null without runs) and collapsed (the words that no run
    repeats, joined by one space) of every text."""
    docs = id_text(df, id_col, text_col)
    run = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def find(batches):
        for batch in batches:
            for part in slices(batch):
                data, offsets = utf8(part.column(1))
                counts, found = text_runs(data, offsets, min_length)
                own: dict[int, list[tuple[int, int, int]]] = {}
                for row, *r in found:
                    own.setdefault(row, []).append(tuple(r))
                lists, best, collapsed = [], [], []
                for i in range(part.num_rows):
                    pieces, mine = data[offsets[i]:offsets[i + 1]].tobytes().split(), sorted(own.get(i, []))
                    top = None
                    for r in mine:  # in exact integers; the first of equal ones stays
                        if top is None or r[1] * top[2] > top[1] * r[2]:
                            top = r
                    if mine:
                        pieces = [w for w, k in zip(pieces, _kept(mine, len(pieces))) if k]
                    lists.append([dict(zip(("start", "length", "period"), r)) for r in mine])
                    best.append(dict(zip(("start", "length", "period"), top)) if top else None)
                    collapsed.append(b" ".join(pieces))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(counts, pa.int64()), pa.array(lists, pa.list_(run)), pa.array(best, run),
                     pa.array(collapsed, pa.binary()).cast(pa.string())],
                    names=["doc_id", "n_words", "runs", "best", "collapsed"])

    kind, fields = docs.schema["doc_id"].dataType.simpleString(), "struct<start:bigint,length:bigint,period:bigint>"
    return docs.mapInArrow(find, f"doc_id {kind}, n_words long, runs array<{fields}>, best {fields}, collapsed string")


def planted(text: Column, doc_id: Column) -> Column:
    """The text whose words repeat as the id's crc32 says: with h = crc32(id as
    text) and g = floor(h / 10), if h is divisible by 10 each word i >= a = g % n
    becomes word a + (i - a) % p, p = 1 + floor((n - a) / (3 + g % 8)).  Other
    texts, texts without words and those without an id stay as they are."""
    h = F.crc32(doc_id.cast("string").cast("binary"))
    g = F.floor(h / 10)

    def repeated(w: Column) -> Column:
        n = F.size(w).cast("long")
        return let(F.struct((g % n).alias("a"), (F.lit(1) + F.floor((n - g % n) / (3 + g % 8))).alias("p")), lambda x:
                   F.array_join(F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda i: F.get(w, F.when(
                       i < x["a"], i).otherwise(x["a"] + (i - x["a"]) % x["p"]).cast("int"))), " "))

    some = F.filter(F.split(text, SPACES), lambda w: w != F.lit(""))
    return F.when((h % 10 == 0) & F.rlike(text, F.lit(r"[^\x20\x09-\x0D]")), let(some, repeated)).otherwise(text)
