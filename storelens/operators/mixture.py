"""Gaussian mixtures of several covariance types and starts, fitted together.

Rows are dealt by a hash of their key into chunks of about ``CHUNK_ROWS``, sorted by
key within each and kept as a table of matrices.  One EM step of all models that
still move is one job without a shuffle: each chunk gives the models' stacked
sufficient statistics, a task adds its chunks up, and the driver adds the tasks
(at most ``TASKS`` rows of numbers, whatever the table's size).  Sums are exact:
chunks' statistics are whole multiples of 2^-60 and are added as integers, so the
result is the same for any partitioning of the input and of the chunks.

A start's means are the ``k`` rows with the smallest hash of (seed, start, key), its
covariances those of the whole table, its weights equal.  A model stops when its
mean log-likelihood moves by less than ``tol``, as the reference's library does.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from storelens.functions.sizing import cut_lineage

CHUNK_ROWS = 16_384
TASKS = 256
_SCALE = 60
#: What is added to variances, as in the reference's library.
RIDGE = 1e-6


@dataclass
class Mixture:
    covariance: str
    start: int
    weights: np.ndarray
    means: np.ndarray
    spread: np.ndarray  # full: (k, d, d), tied: (d, d), diag: (k, d), spherical: (k,)
    log_likelihood: float = -math.inf
    steps: int = 0
    done: bool = False
    trace: list[float] = field(default_factory=list)


def log_densities(x: np.ndarray, m: Mixture) -> np.ndarray:
    """log(weight) + log N(x | mean, covariance) of every row and component."""
    return _log_densities(np.ascontiguousarray(x.T), m).T


def _log_densities(xt: np.ndarray, m: Mixture) -> np.ndarray:
    """:func:`log_densities` of the rows' columns, a component a row."""
    d, n = xt.shape
    out = np.empty((len(m.means), n))
    for j, mean in enumerate(m.means):
        diff = xt - mean[:, None]
        if m.covariance in ("full", "tied"):
            sigma = m.spread if m.covariance == "tied" else m.spread[j]
            root = np.linalg.cholesky(sigma)
            for a in range(d):  # forward substitution, column by column
                for b in range(a):
                    diff[a] -= root[a, b] * diff[b]
                diff[a] /= root[a, a]
            logdet = 2.0 * np.log(np.diag(root)).sum()
        else:
            spread = m.spread[j] if m.covariance == "diag" else np.full(d, m.spread[j])
            diff /= np.sqrt(spread)[:, None]
            logdet = np.log(spread).sum()
        diff *= diff
        out[j] = diff.sum(0)
        out[j] *= -0.5
        out[j] += math.log(m.weights[j]) - 0.5 * (d * math.log(2 * math.pi) + logdet)
    return out


#: Rows whose columns and shares stay in a core's cache.
SLICE = 4096


def statistics(x: np.ndarray, m: Mixture) -> np.ndarray:
    """Log-likelihood, then per component weight, sums and sums of products."""
    return all_statistics(x, [m])[0]


def all_statistics(x: np.ndarray, models: Sequence[Mixture]) -> list[np.ndarray]:
    """:func:`statistics` of every model; the rows' products are taken once for all."""
    found = [0.0] * len(models)
    for at in range(0, len(x), SLICE):
        part = x[at:at + SLICE]
        n, d = part.shape
        xt = np.ascontiguousarray(part.T)
        moments = np.concatenate([np.ones((n, 1)), part, (part[:, :, None] * part[:, None, :]).reshape(n, d * d)], axis=1)
        for i, m in enumerate(models):
            share = _log_densities(xt, m)
            top = share.max(0)
            share -= top
            np.exp(share, out=share)
            total = share.sum(0)
            share /= total
            sums = share @ moments  # weight, sums and products of each component
            found[i] = found[i] + np.concatenate([[(top + np.log(total)).sum()], sums[:, 0], sums[:, 1:1 + d].ravel(),
                                                  sums[:, 1 + d:].ravel()])
    return found


def updated(m: Mixture, s: np.ndarray, n: int, tol: float) -> Mixture:
    """The M step, from the table's statistics."""
    k, d = m.means.shape
    mean_ll = s[0] / n
    moved = abs(mean_ll - m.trace[-1]) if m.trace else math.inf
    if moved < tol:
        return Mixture(m.covariance, m.start, m.weights, m.means, m.spread, float(s[0]), m.steps, True, [*m.trace, mean_ll])
    size = s[1:1 + k] + 10 * np.finfo(float).eps
    means = s[1 + k:1 + k + k * d].reshape(k, d) / size[:, None]
    second = s[1 + k + k * d:].reshape(k, d, d) / size[:, None, None]
    cov = second - means[:, :, None] * means[:, None, :]
    ridge = RIDGE * np.eye(d)
    if m.covariance == "full":
        spread = cov + ridge
    elif m.covariance == "tied":
        spread = (cov * size[:, None, None]).sum(0) / size.sum() + ridge
    else:
        variance = np.einsum("jaa->ja", cov) + RIDGE
        spread = variance if m.covariance == "diag" else variance.mean(1)
    return Mixture(m.covariance, m.start, size / size.sum(), means, spread, float(s[0]), m.steps + 1, False,
                   [*m.trace, mean_ll])


def chunked(df: DataFrame, cols: Sequence[str], key: str, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """chunk, keys and x (the rows' columns, a matrix in bytes), rows by key."""
    rows = df.select(F.col(key).cast("long").alias("key"), *[F.col(c).cast("double").alias(f"_{i}")
                                                            for i, c in enumerate(cols)])
    names = [f"_{i}" for i in range(len(cols))]
    chunks = max(1, math.ceil(rows.count() / chunk_rows))

    def gather(t: pa.Table) -> pa.Table:
        t = t.sort_by([(c, "ascending") for c in ("key", *names)])
        x = np.stack([t[c].to_numpy() for c in names], axis=1)
        return pa.table({"chunk": t["chunk"][:1], "keys": [t["key"].to_pylist()], "x": pa.array([x.tobytes()], pa.binary())})

    dealt = rows.withColumn("chunk", F.pmod(F.xxhash64("key"), F.lit(chunks)).cast("int"))
    return cut_lineage(dealt.groupBy("chunk").applyInArrow(gather, "chunk int, keys array<long>, x binary"))


def _first_rows(chunks: DataFrame, d: int, k: int, starts: int, seed: int) -> list[np.ndarray]:
    """Per start the ``k`` rows with the smallest hash of (seed, start, key); rows
    of one key follow each other."""
    rows = chunks.select(F.posexplode("keys").alias("at", "key"), "x").select(
        "key", F.substring(F.col("x"), F.col("at") * (8 * d) + 1, F.lit(8 * d)).alias("x"))
    drawn = rows.withColumn("start", F.explode(F.lit(list(range(starts))))).withColumn(
        "_h", F.xxhash64(F.lit(seed), "start", "key"))
    order = Window.partitionBy("start").orderBy("_h", "key", "x")  # k rows a start leave a task
    top = drawn.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= k).select("start", "_n", "x").collect()
    return [np.array([np.frombuffer(r["x"], float) for r in sorted(top, key=lambda r: r["_n"]) if r["start"] == s])
            for s in range(starts)]


def _sums(chunks: DataFrame, d: int, models: list[Mixture]) -> list[np.ndarray]:
    """All models' statistics over all chunks, in one job."""
    shared = chunks.sparkSession.sparkContext.broadcast(models)

    def step(batches):
        total = None
        for batch in batches:
            for raw in batch.column(0).to_pylist():
                x = np.frombuffer(raw, float).reshape(-1, d)
                own = [[int(math.ldexp(v, _SCALE)) for v in s] for s in all_statistics(x, shared.value)]
                total = own if total is None else [[a + b for a, b in zip(t, o)] for t, o in zip(total, own)]
        if total is not None:
            yield pa.RecordBatch.from_pydict({"sums": pa.array([[str(v) for row in total for v in row]], pa.list_(pa.string()))})

    tasks = [r["sums"] for r in chunks.select("x").coalesce(TASKS).mapInArrow(step, "sums array<string>").collect()]
    shared.unpersist()
    total = [sum(map(int, column)) for column in zip(*tasks)]
    flat = np.array([math.ldexp(float(v), -_SCALE) for v in total])
    return list(flat.reshape(len(models), -1))


def fit_mixtures(df: DataFrame, cols: Sequence[str], k: int = 3, covariances: Sequence[str] = ("full",), n_init: int = 10,
                 seed: int = 42, max_iter: int = 1000, tol: float = 1e-3, key: str = "customer_id",
                 chunk_rows: int = CHUNK_ROWS) -> tuple[list[Mixture], int]:
    """Every (covariance, start) model, and the number of rows.  No row: no models."""
    d, chunks = len(cols), chunked(df, cols, key, chunk_rows)
    n = int(chunks.agg(F.sum(F.size("keys"))).first()[0] or 0)
    if n == 0:
        return [], 0
    one = Mixture("spherical", 0, np.ones(1), np.zeros((1, d)), np.ones(1))
    s = _sums(chunks, d, [one])[0]
    mean = s[2:2 + d] / n
    cov = s[2 + d:].reshape(d, d) / n - np.outer(mean, mean) + RIDGE * np.eye(d)
    variance = np.diag(cov).copy()
    spread = {"full": np.tile(cov, (k, 1, 1)), "tied": cov, "diag": np.tile(variance, (k, 1)),
              "spherical": np.full(k, variance.mean())}
    models = []
    for start, rows in enumerate(_first_rows(chunks, d, k, n_init, seed)):
        means = rows[np.arange(k) % len(rows)]
        models += [Mixture(c, start, np.full(k, 1.0 / k), means, spread[c]) for c in covariances]
    for _ in range(max_iter):
        going = [i for i, m in enumerate(models) if not m.done]
        if not going:
            break
        for i, s in zip(going, _sums(chunks, d, [models[i] for i in going])):
            models[i] = updated(models[i], s, n, tol)
    return models, n


def best_mixtures(models: list[Mixture]) -> list[Mixture]:
    """The start with the highest likelihood of each covariance type, in the given order."""
    best: dict[str, Mixture] = {}
    for m in models:
        if m.covariance not in best or m.log_likelihood > best[m.covariance].log_likelihood:
            best[m.covariance] = m
    return list(best.values())
