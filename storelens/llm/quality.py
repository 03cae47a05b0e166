"""Quality classification by positive-unlabelled learning (operator 7).

A text's features (``features``) are shares: of byte-class pairs (lower and
upper case, digits, spaces, line ends, single signs, letters beyond ASCII), of
repeated words, word pairs and lines, of word lengths, and its size.  A logistic
model is fitted to trusted positives (rows labelled 1) and unlabelled web text
(rows without a label) by minimising the non-negative unbiased risk

    prior * R_p(+) + max(0, R_u(-) - prior * R_p(-))

with mini-batch Adam steps; when the second part falls below zero the step goes
up its gradient, discounted by ``back``, as the method prescribes.  The class prior is estimated from
the same two samples, without negatives: the scores of a first fit are cut at
every level, and the prior is the smallest ratio (with a margin for sampling
error) of unlabelled to positive rows above a level.  The scores are the
fitted model's probabilities.

The fit uses at most ``sample_rows`` positives and as many unlabelled rows,
drawn by a hash of their id; scoring is one pass over all texts.  Labels,
language, source and id are never inputs of a score.  Null or empty text: the
score of the empty text.  Without trusted positives or unlabelled rows every
score is the prior 0.5.  Repeated rows: a result each; a document with several
labels counts once with its smallest.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storelens.llm.base import crc_fold, id_text, slices, span_hashes, utf8, words

_SIGNS = b".,!?|%&*$#=:;-_/\"'()"


def _classes() -> np.ndarray:
    kind = np.full(256, 5, np.uint8)  # any other sign
    kind[97:123], kind[65:91], kind[48:58] = 0, 1, 2
    kind[[9, 11, 12, 13, 32]], kind[10], kind[128:] = 3, 4, 6
    for i, c in enumerate(_SIGNS):
        kind[c] = 7 + i
    return kind


_KIND = _classes()
N_KINDS = 7 + len(_SIGNS)
#: Standardised features are held within this, so that a rare sign alone (a number, an address) decides little.
CLIP = 3.0
N_FEATURES = N_KINDS * N_KINDS + N_KINDS + 14


def _distinct(keys: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """Number of distinct keys of each row (rows ascending)."""
    if not len(keys):
        return np.zeros(n)
    order = np.lexsort((keys, rows))
    k, r = keys[order], rows[order]
    new = np.ones(len(k), bool)
    new[1:] = (k[1:] != k[:-1]) | (r[1:] != r[:-1])
    return np.bincount(r[new], minlength=n).astype(float)


def _share(part: np.ndarray, whole: np.ndarray, empty: float = 0.0) -> np.ndarray:
    return np.where(whole > 0, part / np.maximum(whole, 1), empty)


def features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """(rows, N_FEATURES) float32, all of order 1."""
    n = len(offsets) - 1
    size = np.diff(offsets).astype(float)
    rows = np.repeat(np.arange(n), np.diff(offsets))
    kind = _KIND[data]
    single = np.bincount(rows * N_KINDS + kind, minlength=n * N_KINDS).reshape(n, -1).astype(float)
    pair_rows = rows[1:][rows[1:] == rows[:-1]] if len(rows) else rows
    pairs = (kind[:-1].astype(np.int64) * N_KINDS + kind[1:])[rows[1:] == rows[:-1]] if len(rows) else rows
    double = np.bincount(pair_rows * N_KINDS ** 2 + pairs, minlength=n * N_KINDS ** 2).reshape(n, -1).astype(float)
    starts, ends, wrows = words(data, offsets)
    n_words = np.bincount(wrows, minlength=n).astype(float)
    hashed = span_hashes(data, starts, ends)
    length = (ends - starts).astype(float)
    same = np.zeros(len(hashed), bool)
    if len(hashed) > 1:
        same[1:] = (hashed[1:] == hashed[:-1]) & (wrows[1:] == wrows[:-1])
    two = hashed[1:] * np.uint64(31) ^ hashed[:-1] if len(hashed) else hashed
    two_rows = wrows[1:] if len(wrows) else wrows
    inner = two_rows == wrows[:-1] if len(wrows) else np.zeros(0, bool)
    # lines: runs between line ends
    cut = np.zeros(len(data) + 1, bool)
    cut[offsets[:-1]] = True
    cut[np.flatnonzero(data == 10) + 1] = True
    line_starts = np.flatnonzero(cut[:-1])
    line_ends = np.append(line_starts[1:], len(data))
    line_rows = np.searchsorted(offsets, line_starts, side="right") - 1
    n_lines = np.bincount(line_rows, minlength=n).astype(float)
    line_hash = span_hashes(data, line_starts, line_ends)
    upper_words = _KIND[data[starts]] == 1 if len(starts) else np.zeros(0, bool)
    per = lambda x: np.bincount(wrows, weights=x, minlength=n)
    mean = _share(per(length), n_words)
    other = np.column_stack([
        np.log1p(size) / 10, np.log1p(n_words) / 10, mean / 10,
        np.sqrt(np.maximum(_share(per(length ** 2), n_words) - mean ** 2, 0)) / 10,
        1 - _share(_distinct(hashed, wrows, n), n_words, 1.0), _share(per(same.astype(float)), n_words),
        1 - _share(_distinct(two[inner], two_rows[inner], n), n_words - 1, 1.0).clip(0, 1),
        _share(per(upper_words.astype(float)), n_words), _share(per((length <= 2).astype(float)), n_words),
        _share(per((length >= 12).astype(float)), n_words), np.log1p(n_lines) / 5,
        1 - _share(_distinct(line_hash, line_rows, n), n_lines, 1.0), _share(n_words, n_lines) / 100,
        (size == 0).astype(float)])
    shares = np.sqrt(np.column_stack([_share(double, size[:, None]), _share(single, size[:, None])]))
    return np.column_stack([shares, np.minimum(other, 5)]).astype(np.float32)


class Model:
    """Standardised logistic regression with an offset for the class prior."""

    def __init__(self, mean, scale, weights, bias: float, prior: float):
        self.mean, self.scale, self.weights, self.bias, self.prior = mean, scale, weights, bias, prior

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -CLIP, CLIP) @ self.weights + self.bias
        return 1.0 / (1.0 + np.exp(-np.clip(z, -40, 40)))


def _gradient(slope: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Of weights and bias, from the loss's slope at each row."""
    return np.append(slope.astype(np.float32) @ x, slope.sum())


def non_negative_fit(xp: np.ndarray, xu: np.ndarray, prior: float, epochs: int = 120, batch: int = 1024,
                     rate: float = 0.02, decay: float = 1e-4, back: float = 0.1, seed: int = 7) -> tuple[np.ndarray, float]:
    """Minimise the non-negative risk with the logistic loss; returns weights, bias."""
    draw = np.random.default_rng(seed)
    w = np.zeros(xp.shape[1] + 1)
    m, v, t = np.zeros_like(w), np.zeros_like(w), 0
    batch = min(batch, max(32, len(xu) // 20))
    steps = max(1, -(-len(xu) // batch))
    for epoch in range(epochs):
        op, ou = draw.permutation(len(xp)), draw.permutation(len(xu))
        for i in range(steps):
            p = xp[op[i * len(xp) // steps:max((i + 1) * len(xp) // steps, i * len(xp) // steps + 1)]]
            u = xu[ou[i * len(xu) // steps:(i + 1) * len(xu) // steps]]
            if not len(u) or not len(p):
                continue
            zp, zu = (np.clip(x @ w[:-1].astype(np.float32) + w[-1], -30, 30).astype(np.float64) for x in (p, u))
            up = _gradient(-prior / (1 + np.exp(zp)) / len(p), p)  # of prior * R_p(+)
            down = _gradient(1 / (1 + np.exp(-zu)) / len(u), u) - _gradient(prior / (1 + np.exp(-zp)) / len(p), p)
            risk = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
            g = up + down if risk >= 0 else -back * down
            g[:-1] += decay * w[:-1]
            t += 1
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            w -= rate / (1 + 2 * epoch / epochs) * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.999 ** t)) + 1e-8)
    return w[:-1], float(w[-1])


def estimate_prior(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """The share of positives among the unlabelled, from scores of both: the
    smallest upper bound of P(u >= s) / P(p >= s) over the levels s that at least
    half of the positives reach."""
    if not len(positive) or not len(unlabelled):
        return 0.5
    levels = np.quantile(positive, np.linspace(0.005, 0.5, 100))
    up = np.array([(unlabelled >= s).mean() for s in levels])
    pp = np.array([(positive >= s).mean() for s in levels])
    margin = 1.64 * (np.sqrt(up * (1 - up) / len(unlabelled)) + up / np.maximum(pp, 1e-9) * np.sqrt(
        pp * (1 - pp) / len(positive)))
    return float(np.clip(((up + margin) / np.maximum(pp, 1e-9)).min(), 0.01, 0.99))


def cross_prior(xp: np.ndarray, xu: np.ndarray) -> float:
    """The prior by scores of rows that the scoring fit hasn't seen: each half
    of the samples is scored by a fit to the other."""
    found = []
    for own in (0, 1):
        w, b = non_negative_fit(xp[own::2], xu[own::2], 0.5, epochs=10)
        found.append(estimate_prior(xp[1 - own::2] @ w + b, xu[1 - own::2] @ w + b))
    return float(np.mean(found))


def fit(df: DataFrame, labels: DataFrame, folds: int = 5, held: int | None = 0, sample_rows: int = 12_000) -> Model | None:
    """Fit on trusted positives and unlabelled rows of ``df`` (doc_id, text)
    outside fold ``held`` (of all rows without one).  Ids are drawn first, the
    smallest by a hash, so that only the sampled texts are read further; the
    draw depends on the rows alone.  Labels of one id count once, the smallest."""
    known = labels.where(F.col("quality").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    rows = df.select("doc_id", "text")
    rows = rows if held is None else rows.where(crc_fold("doc_id", folds) != held)
    marked = rows.select("doc_id").dropna().distinct().join(known, "doc_id", "left")

    def sample(ids: DataFrame) -> np.ndarray:
        drawn = ids.orderBy(F.xxhash64("doc_id", F.lit(7)), "doc_id").limit(sample_rows).select("doc_id")

        def measure(batches):
            for batch in batches:
                for part in slices(batch):
                    x = features(*utf8(part.column(1)))
                    yield pa.RecordBatch.from_arrays([part.column(0), pa.array([r.tobytes() for r in x], pa.binary())],
                                                     names=["doc_id", "x"])

        # at most sample_rows ids are broadcast, and as many rows of N_FEATURES floats come back
        chosen = rows.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(drawn), "doc_id", "left_semi")
        kind = rows.schema["doc_id"].dataType.simpleString()
        got = chosen.mapInArrow(measure, f"doc_id {kind}, x binary").groupBy("doc_id").agg(F.min("x").alias("x")).toArrow()
        raw = got.sort_by("doc_id").column("x").combine_chunks()
        if not len(raw):
            return np.zeros((0, N_FEATURES), np.float32)
        return np.frombuffer(utf8(raw)[0].tobytes(), np.float32).reshape(-1, N_FEATURES).copy()

    xp, xu = sample(marked.where("quality = 1")), sample(marked.where("quality IS NULL"))
    if not len(xp) or not len(xu):
        return None
    mean, scale = xu.mean(axis=0), np.maximum(xu.std(axis=0), 1e-3)
    for x in (xp, xu):  # in place: the samples are the driver's largest arrays
        x -= mean
        x /= scale
        np.clip(x, -CLIP, CLIP, out=x)
    prior = cross_prior(xp, xu)
    w, b = non_negative_fit(xp, xu, prior)
    return Model(mean, scale, w, b, prior)


def score_quality(df: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and score (probability of label 1) of every text."""
    docs = id_text(df, id_col, text_col)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def predict(batches):
        for batch in batches:
            for part in slices(batch):
                m = shared.value
                s = np.full(part.num_rows, 0.5) if m is None else m.score(features(*utf8(part.column(1))))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(s.astype(np.float64))], names=["doc_id", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(predict, f"doc_id {kind}, score double")


def folded_quality(df: DataFrame, labels: DataFrame, folds: int = 5, held: int = 0, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of ``df``."""
    scored = score_quality(df, fit(df, labels, folds, held))
    return scored.select("doc_id", F.coalesce(crc_fold("doc_id", folds) == held, F.lit(False)).alias("held_out"), "score",
                         (F.col("score") >= threshold).cast("int").alias("predicted"))


def drop_rejected(df: DataFrame, model: Model | None, text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """The rows of ``df``, all columns, whose text scores at least ``threshold``
    (all rows without a model)."""
    if model is None:
        return df
    shared, at = df.sparkSession.sparkContext.broadcast(model), df.columns.index(text_col)

    def keep(batches):
        for batch in batches:
            for part in slices(batch, text_col):
                yield part.filter(pa.array(shared.value.score(features(*utf8(part.column(at)))) >= threshold))

    return df.mapInArrow(keep, df.schema)
