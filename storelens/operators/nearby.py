"""Distances to the nearest rows of the whole table, for any number of rows.

Equal vectors are folded to one with its weight.  Planes through a hash sample (which
decides where the blocks lie, not what is found) cut space into blocks of about
``BLOCK_ROWS`` vectors.  A block's vectors find the nearest ones among themselves, by
leaves of a median-split tree and the boxes around them; a vector whose ball of the k-th
distance so far reaches other blocks' boxes asks those too, and the lists are merged.
Vectors that miss a coordinate lie near nothing.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storelens.functions.sizing import cut_lineage
from storelens.operators.grid import NEVER, Boxes, complete, weighted_vectors

BLOCK_ROWS = 32_768
LEAF_ROWS = 64
#: Sampled vectors for each block that the planes cut.
SAMPLE = 64


def leaves(x: np.ndarray, rows: int) -> np.ndarray:
    """A number for each row: its leaf of a tree split at the median of the widest
    coordinate until a leaf has at most ``rows`` rows."""
    out, n, open_ = np.zeros(len(x), int), 0, [np.arange(len(x))]
    while open_:
        own = open_.pop()
        if len(own) > rows:
            v = x[own]
            d = int(np.argmax(v.max(0) - v.min(0)))
            at = np.argpartition(v[:, d], len(own) // 2)
            open_ += [own[at[len(own) // 2:]], own[at[:len(own) // 2]]]
        else:
            out[own], n = n, n + 1
    return out


def near_distances(x: np.ndarray, y: np.ndarray, weights: np.ndarray, k: int,
                   most: np.ndarray | None = None) -> list[np.ndarray]:
    """Sorted distances of each row of ``x`` to its ``k`` nearest rows of ``y``, a row
    counted ``weights`` times; only those up to ``most``, if given."""
    out: list[np.ndarray] = [np.zeros(0)] * len(x)
    h, a = Boxes(x, leaves(x, LEAF_ROWS)), Boxes(y, leaves(y, LEAF_ROWS))
    w = weights[a.order]
    heavy = np.add.reduceat(w, a.starts)
    once = bool((w == 1).all())
    for low, high, start, end in zip(h.low, h.high, h.starts, h.ends):
        gaps, spans = a.gaps(low, high), a.spans(low, high)
        order = np.argsort(spans)
        full = np.searchsorted(np.cumsum(heavy[order]), k)
        reach = spans[order[full]] if full < len(order) else math.inf
        own = h.order[start:end]
        if most is not None:
            reach = min(reach, float(most[own].max()))
        some = a.rows(np.flatnonzero(gaps <= reach * NEVER))
        if not len(some):
            continue
        sq = np.zeros((end - start, len(some)))
        for d in range(x.shape[1]):  # summed coordinate by coordinate in order, as exact_distances
            part = h.v[start:end, d, None] - a.v[some, d]
            part *= part
            sq += part
        first = min(k, len(some))
        if once:
            found = np.sqrt(np.sort(np.partition(sq, first - 1, axis=1)[:, :first], axis=1))
            for i, r in enumerate(own):
                out[r] = found[i]
        else:
            at = np.argpartition(sq, first - 1, axis=1)[:, :first]
            best = np.take_along_axis(sq, at, 1)
            by = np.argsort(best, axis=1)
            best, times = np.sqrt(np.take_along_axis(best, by, 1)), np.minimum(w[some[np.take_along_axis(at, by, 1)]], k)
            for i, r in enumerate(own):
                out[r] = np.repeat(best[i], times[i])[:k]
    return out if most is None else [o[o <= m * NEVER] for o, m in zip(out, most)]


def _planes(x: np.ndarray, blocks: int) -> list[tuple[int, float, int, int]]:
    """(coordinate, value, next below, next not below) of each node; a negative next is block ~next."""
    nodes: list[tuple[int, float, int, int]] = []
    names = iter(range(blocks))

    def cut(own: np.ndarray, many: int) -> int:
        widths = own.max(0) - own.min(0) if len(own) else np.zeros(1)
        if many == 1 or not widths.max(initial=0.0) > 0:
            return ~next(names)
        d = int(widths.argmax())
        value = float(np.quantile(own[:, d], (many // 2) / many))
        if value == own[:, d].min():
            value = float(own[own[:, d] > value, d].min())
        at = len(nodes)
        nodes.append((d, value, 0, 0))
        below = own[:, d] < value
        nodes[at] = (d, value, cut(own[below], many // 2), cut(own[~below], many - many // 2))
        return at

    cut(x, blocks)
    return nodes


def blocked(vectors: DataFrame, n: int, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``vectors`` (v and w) with ``block``, a number for a part of space, as a table."""
    blocks = max(1, math.ceil(n / block_rows))
    nodes = []
    if blocks > 1:
        drawn = vectors.select("v").orderBy(F.xxhash64("v")).limit(blocks * SAMPLE).collect()
        nodes = _planes(np.array([r["v"] for r in drawn], float), blocks)

    def place(batches):
        from storelens.operators.neighbors import vectors as matrix

        for b in batches:
            t = pa.Table.from_batches([b])
            x = matrix(t, "v")
            at = np.zeros(len(x), int) if nodes else np.full(len(x), -1)
            for i, (d, value, low, high) in enumerate(nodes):  # a node comes before those under it
                here = np.flatnonzero(at == i)
                if len(here):
                    at[here] = np.where(x[here, d] < value, low, high)
            yield from t.append_column("block", pa.array((~at).astype(np.int32))).to_batches()

    return cut_lineage(vectors.mapInArrow(place, "v array<double>, w long, block int"))


def _lists(values: list[np.ndarray], kind=pa.float64()) -> pa.Array:
    ends = np.cumsum([0, *map(len, values)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(values) if values else [], kind))


def nearest_distances(points: DataFrame, k: int, id_col: str = "id", vec: str = "features",
                      block_rows: int = BLOCK_ROWS) -> DataFrame:
    """w (rows) and near (the distances to the ``k`` nearest rows, itself and its
    copies included, ascending) of every distinct vector."""
    from storelens.operators.neighbors import vectors as matrix

    whole = weighted_vectors(points, id_col, vec).where(complete("v")).select("v", "w")
    n = whole.count()
    items = blocked(whole, n, block_rows)
    dim = max([r[0] for r in items.select(F.size("v")).distinct().collect()], default=0)
    boxes = sorted((r["block"], *r[1:]) for r in items.groupBy("block").agg(*[
        f(F.col("v")[d]) for f in (F.min, F.max) for d in range(dim)]).collect())
    shared = points.sparkSession.sparkContext.broadcast((
        np.array([r[0] for r in boxes], int), np.array([r[1:1 + dim] for r in boxes], float),
        np.array([r[1 + dim:] for r in boxes], float)))

    def within(t: pa.Table) -> pa.Table:
        x, own = matrix(t, "v"), t["block"][0].as_py()
        near = near_distances(x, x, t["w"].to_numpy(), k)
        reach = np.array([d[-1] if len(d) == k else np.inf for d in near])
        names, low, high = shared.value
        asks: list[list[int]] = [[] for _ in range(len(x))]
        for b, lo, hi in zip(names, low, high):
            if b != own:
                gap = np.sqrt((np.maximum(np.maximum(lo - x, x - hi), 0.0) ** 2).sum(1))
                for i in np.flatnonzero(gap <= reach * NEVER):
                    asks[i].append(int(b))
        return pa.table({"v": t["v"], "w": t["w"], "near": _lists(near), "asks": pa.array(asks, pa.list_(pa.int32()))})

    def beside(t: pa.Table) -> pa.Table:
        asking = t["reach"].is_valid().to_numpy()
        q, i = t.filter(pa.array(asking)), t.filter(pa.array(~asking))
        near = near_distances(matrix(q, "v"), matrix(i, "v"), i["w"].to_numpy(), k, q["reach"].to_numpy()) if len(q) else []
        return pa.table({"v": q["v"], "near": _lists(near)})

    home = cut_lineage(items.groupBy("block").applyInArrow(
        within, "v array<double>, w long, near array<double>, asks array<int>"))
    open_ = home.where(F.size("asks") > 0)
    reach = F.when(F.size("near") == k, F.element_at("near", -1)).otherwise(F.lit(math.inf))
    asked = open_.select("v", reach.alias("reach"), F.explode("asks").alias("block"))
    there = items.select("v", "w", F.lit(None).cast("double").alias("reach"), "block").unionByName(
        asked.select("v", F.lit(None).cast("long").alias("w"), "reach", "block"))
    found = there.groupBy("block").applyInArrow(beside, "v array<double>, near array<double>")
    merged = open_.select("v", "w", "near").unionByName(found.select("v", F.lit(None).cast("long").alias("w"), "near"))
    merged = merged.groupBy("v").agg(F.max("w").alias("w"), F.flatten(F.collect_list("near")).alias("near")).select(
        "w", F.slice(F.sort_array("near"), 1, k).alias("near"))
    return home.where(F.size("asks") == 0).select("w", "near").unionByName(merged)


#: Bits of a number that one pass tells apart.
STEP = 16


def list_quantile(df: DataFrame, p: float, values: str = "near", weight: str = "w") -> float | None:
    """Linear quantile of all numbers (not negative) of the lists, each counted ``weight``
    times; 16 bits of the two wanted numbers are found in a pass, from counts."""
    data = cut_lineage(df.select(F.col(values).alias("values"), F.col(weight).alias("w")))

    def counts(shift: int, known: list[int]):
        def fn(batches):
            total: dict[int, int] = {}
            for b in batches:
                lists, w = b.column(0), b.column(1).to_numpy()
                bits = lists.flatten().to_numpy().view(np.int64)
                times = np.repeat(w, np.diff(lists.offsets.to_numpy()))
                if known:
                    inside = np.isin(bits >> (shift + STEP), known)
                    bits, times = bits[inside], times[inside]
                name, at = np.unique(bits >> shift, return_inverse=True)
                sums = np.zeros(len(name), np.int64)
                np.add.at(sums, at.ravel(), times)
                for a, s in zip(name.tolist(), sums.tolist()):
                    total[a] = total.get(a, 0) + s
            yield pa.RecordBatch.from_pydict({"name": pa.array(list(total), pa.int64()), "n": pa.array(list(total.values()), pa.int64())})

        found = data.mapInArrow(fn, "name long, n long").groupBy("name").agg(F.sum("n").alias("n")).collect()
        return sorted((r["name"], r["n"]) for r in found)

    ranks, pos, known, bits = None, 0.0, [], []
    for shift in (48, 32, 16, 0):
        table = counts(shift, known)
        if ranks is None:
            n = sum(c for _, c in table)
            if not n:
                return None
            pos = float(p) * (n - 1)
            ranks = [math.floor(pos), math.ceil(pos)]
            parents = [None, None]
        else:
            parents = bits
        bits = []
        for i, parent in enumerate(parents):  # ranks[i] counts from the first number of its parent
            for name, c in table:
                if parent is None or name >> STEP == parent:
                    if ranks[i] < c:
                        bits.append(name)
                        break
                    ranks[i] -= c
        known = sorted(set(bits))
    low, high = (float(np.int64(b).view(np.float64)) for b in bits)
    if math.floor(pos) == math.ceil(pos) or low == high:
        return low
    return (math.ceil(pos) - pos) * low + (pos - math.floor(pos)) * high
