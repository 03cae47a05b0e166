"""Language identification by multilingual mixture inference (operator 2).

Training counts the letter n-grams (hashed into ``buckets`` cells) of all
training texts by language on the map side; smoothed logs of their shares are
the n-gram likelihoods.  A document is cut into segments of about ``segment``
letters; each segment has a likelihood under every language.  Expectation
maximisation, run until a step raises the likelihood by less than 10^-6, estimates
the document's language proportions from them, and the set of languages is
selected by penalised likelihood: starting from all, the language with the
smallest proportion is dropped as long as that does not lower
log likelihood - penalty * languages * log(segments + 1).

Every text is read by itself: its n-grams start as if spaces stood before it, so
equal texts have equal results whatever texts lie beside them.

Predictions read the text only.  Null text or a text without letters: ``und``
with score 0.  Training rows without a language don't count.  Without any
training language every prediction is ``und``.  Repeated rows: a result each.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storelens.llm.base import crc_fold, id_text, mix, slices, utf8

BUCKETS = 1 << 15
UNKNOWN = "und"

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LETTER = np.zeros(256, bool)
_LETTER[97:123] = True
_LETTER[128:] = True


def grams(data: np.ndarray, offsets: np.ndarray, buckets: int = BUCKETS):
    """Cells of the 1- to 4-byte n-grams that end at each letter byte - one
    combined cell per order -, as (orders, letters), and the letters' rows.
    Signs between words count as one space; case is folded for ASCII.  Each row
    is read by itself, as if spaces stood before it."""
    low = _LOWER[data]
    letter = _LETTER[low]
    # upper case of the two-byte Latin letters (C3 80 .. C3 9E) is folded too
    second = np.flatnonzero((low[1:] >= 0x80) & (low[1:] <= 0x9E) & (low[:-1] == 0xC3)) + 1
    low[second] += 0x20
    low[~letter] = 32
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # one space after each word
    starts = offsets[:-1][np.diff(offsets) > 0]
    keep[starts] = letter[starts]  # but not after a word of the row before
    at = np.flatnonzero(keep)
    rows = np.searchsorted(offsets, at, side="right") - 1
    own = np.arange(len(at)) + 3 * (rows + 1)  # three spaces before each row
    v = np.full(len(at) + 3 * len(offsets), 32, np.uint64)
    v[own] = low[at]
    cells = []
    code = v.copy()
    for order in range(2, 5):
        code[order - 1:] |= v[:len(v) - order + 1] << np.uint64(8 * (order - 1))
        cells.append((mix(code[own] + np.uint64(order << 40)) & np.uint64(buckets - 1)).astype(np.int64))
    return cells, rows, low[at] != 32


def count_grams(df: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """lang, order, cell, n over all rows of ``df`` (lang, text)."""
    def count(batches):
        totals: dict[str, np.ndarray] = {}
        for batch in batches:
            for part in slices(batch):
                data, offsets = utf8(part.column(1))
                cells, rows, _ = grams(data, offsets, buckets)
                langs, code = np.unique(np.array(part.column(0).to_pylist(), dtype=object).astype(str), return_inverse=True)
                for order, c in enumerate(cells):
                    found = np.bincount(code[rows] * buckets + c, minlength=len(langs) * buckets).reshape(-1, buckets)
                    for lang, counts in zip(langs, found):
                        totals.setdefault(str(lang), np.zeros((len(cells), buckets), np.int64))[order] += counts
        for lang, t in totals.items():
            order, cell = np.nonzero(t)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(cell), pa.string()), pa.array(order, pa.int32()), pa.array(cell, pa.int32()),
                 pa.array(t[order, cell], pa.int64())], names=["lang", "order", "cell", "n"])

    found = df.mapInArrow(count, "lang string, order int, cell int, n long")
    return found.groupBy("lang", "order", "cell").agg(F.sum("n").alias("n"))


class Model:
    """Languages and the log likelihood of each cell: (orders, buckets, languages)."""

    def __init__(self, langs: list[str], logs: np.ndarray):
        self.langs, self.logs = langs, logs


def train(df: DataFrame, buckets: int = BUCKETS, smoothing: float = 0.5) -> Model:
    """The model of ``df`` (lang, text).  The driver receives the summed counts:
    at most languages * 3 * ``buckets`` numbers, whatever the size of the corpus."""
    rows = count_grams(df, buckets).toPandas()
    langs = sorted(rows["lang"].unique())
    counts = np.full((3, buckets, len(langs)), smoothing)
    for i, lang in enumerate(langs):
        own = rows[rows["lang"] == lang]
        counts[own["order"].to_numpy(), own["cell"].to_numpy(), i] += own["n"].to_numpy()
    return Model(langs, np.log(counts / counts.sum(axis=1, keepdims=True)).astype(np.float32))


def _em(like: np.ndarray, doc: np.ndarray, first: np.ndarray, share: np.ndarray, active: np.ndarray, tolerance: float):
    """Proportions and log likelihood of each document among its active languages,
    when a step no longer raises the likelihood by ``tolerance``.  ``like``:
    (segments, languages), scaled to a maximum of 1."""
    size = np.diff(np.append(first, len(doc)))[:, None]
    share = np.where(active, share, 0.0)
    share /= share.sum(axis=1, keepdims=True)
    fit = np.full(len(first), -np.inf)
    going = np.arange(len(first))  # documents that still move
    while len(going):
        weighted = like * share[going][doc]
        total = weighted.sum(axis=1, keepdims=True)
        now = np.add.reduceat(np.log(np.maximum(total[:, 0], 1e-300)), first)
        moved = now - fit[going] >= tolerance
        fit[going] = np.maximum(now, fit[going])
        if moved.any():
            share[going[moved]] = (np.add.reduceat(weighted / np.maximum(total, 1e-300), first, axis=0) / size)[moved]
        if not moved.all():
            keep = moved[doc]
            like, doc = like[keep], (np.cumsum(moved) - 1)[doc[keep]]
            going, size = going[moved], size[moved]
            first = np.searchsorted(doc, np.arange(len(going)))
    return share, fit


def proportions(logs: np.ndarray, doc: np.ndarray, penalty: float = 1.0, tolerance: float = 1e-6) -> np.ndarray:
    """Language proportions of documents 0, 1, ... from their segments' log
    likelihoods; ``doc`` ascending, every document with a segment."""
    n_docs, n_langs = int(doc[-1]) + 1, logs.shape[1]
    first = np.searchsorted(doc, np.arange(n_docs))
    like = np.exp(np.maximum(logs - logs.max(axis=1, keepdims=True), -60.0).astype(np.float64))
    cost = penalty * np.log(np.diff(np.append(first, len(doc))) + 1.0)
    active = np.ones((n_docs, n_langs), bool)
    share, fit = _em(like, doc, first, np.full((n_docs, n_langs), 1.0 / n_langs), active, tolerance)
    going = np.ones(n_docs, bool)
    for _ in range(n_langs - 1):
        if not going.any():
            break
        pick = going[doc]
        ids = np.flatnonzero(going)
        sub_doc = np.searchsorted(ids, doc[pick])
        sub_first = np.searchsorted(sub_doc, np.arange(len(ids)))
        least = np.argmin(np.where(active[ids], share[ids], np.inf), axis=1)
        fewer = active[ids].copy()
        fewer[np.arange(len(ids)), least] = False
        new_share, new_fit = _em(like[pick], sub_doc, sub_first, np.maximum(share[ids], 1e-6), fewer, tolerance)
        better = new_fit + cost[ids] >= fit[ids]
        win = ids[better]
        active[win], share[win], fit[win] = fewer[better], new_share[better], new_fit[better]
        going[ids[~better]] = False
        going &= active.sum(axis=1) > 1
    return share


def identify(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", segment: int = 48,
             penalty: float = 1.0) -> DataFrame:
    """doc_id, lang_pred (the largest proportion; ties: the first by name),
    score (that proportion), n_langs and shares (language -> proportion)."""
    docs = id_text(df, id_col, text_col)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    buckets = model.logs.shape[1] if model.langs else BUCKETS

    def predict(batches):
        m = shared.value
        for batch in batches:
            for part in slices(batch):
                n = part.num_rows
                pred, score = np.full(n, UNKNOWN, dtype=object), np.zeros(n)
                shares = np.zeros((n, len(m.langs)))
                data, offsets = utf8(part.column(1))
                cells, rows, letter = grams(data, offsets, buckets)
                texts = part.column(1)
                plain = np.bincount(rows[letter], minlength=n) > 0
                ascii_letters = np.bincount(np.searchsorted(offsets, np.flatnonzero(
                    (_LOWER[data] >= 97) & (_LOWER[data] <= 122)), side="right") - 1, minlength=n) > 0
                for i in np.flatnonzero(plain & ~ascii_letters):  # signs beyond ASCII need not be letters
                    plain[i] = any(c.isalpha() for c in texts[int(i)].as_py())
                if m.langs and plain.any():
                    use = plain[rows]
                    rows_used = rows[use]
                    position = np.arange(len(rows_used)) - np.searchsorted(rows_used, rows_used)
                    cut = np.flatnonzero(position % segment == 0)
                    total = np.zeros((len(cut), len(m.langs)), np.float32)
                    for order, c in enumerate(cells):
                        total += np.add.reduceat(m.logs[order][c[use]], cut, axis=0)
                    ids = np.flatnonzero(plain)
                    doc = np.searchsorted(ids, rows_used[cut])
                    # the three orders overlap: their sum counts each letter about three times
                    got = proportions(total / 3.0, doc, penalty)
                    shares[ids] = got
                    best = got.argmax(axis=1)
                    pred[ids] = np.array(m.langs, dtype=object)[best]
                    score[ids] = np.clip(got[np.arange(len(ids)), best], 0.0, 1.0)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(pred, pa.string()), pa.array(score),
                     pa.array((shares > 0.01).sum(axis=1), pa.int32()),
                     pa.array([[(la, float(x)) for la, x in zip(m.langs, row) if x > 0.01] for row in shares],
                              pa.map_(pa.string(), pa.float64()))],
                    names=["doc_id", "lang_pred", "score", "n_langs", "shares"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(predict, f"doc_id {kind}, lang_pred string, score double, n_langs int, "
                                    "shares map<string,double>")


def folded_languages(df: DataFrame, folds: int = 4, held: int = 2) -> DataFrame:
    """Train on the rows outside fold ``held`` and predict all rows."""
    fold = crc_fold("doc_id", folds)
    trained = df.where((fold != held) & F.col("lang").isNotNull()).select(
        F.col("lang").alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    result = identify(df, train(trained))
    return result.select("doc_id", F.coalesce(crc_fold("doc_id", folds) == held, F.lit(False)).alias("held_out"),
                         "lang_pred", "score", "n_langs", "shares")
