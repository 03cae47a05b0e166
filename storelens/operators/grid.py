"""Range joins of vectors on a spatial hash grid.

Equal vectors are folded to one row with their weight.  Space is cut into cells
whose side is the radius (a little more, so that rounding can't put two vectors
within the radius more than one cell apart), on up to ``GRID_COLUMNS`` of the
coordinates, those with the widest spread in cells: a bound on every coordinate
is a bound on these.  One side stays in its own cell, the other one goes to the
3^g cells around it.  For pairs (:func:`near_pairs`) the cell is an equi-join key and
the exact distance, in column arithmetic, decides.  Work grows with the number of
vectors at a fixed density.  Cells with many vectors are split by a salt, to which the
other side's rows are copied.

Where no pair is wanted but a count, a link or a label (:func:`near_blocks`), both sides
of a cell meet as matrices.  A crowded cell is split into a bounded number of blocks, so
that what is shuffled grows with the vectors whatever their density, and boxes around the
vectors of one patch decide most patches as a whole.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storelens.functions.sizing import broadcast_if_bounded, cut_lineage

GRID_COLUMNS = 3
#: Vectors of one side that meet the other side's in one key of the join.
CELL_ROWS = 1024
#: Rows of both sides of the cells that share a task's group.
BUCKET_ROWS = 1 << 18


def weighted_vectors(points: DataFrame, id_col: str = "id", vec: str = "features") -> DataFrame:
    """key (the smallest id), v and w (rows) of every distinct vector, as a table."""
    return cut_lineage(points.groupBy(F.col(vec).cast("array<double>").alias("v")).agg(
        F.min(F.col(id_col).cast("long")).alias("key"), F.count("*").alias("w")).select("key", "v", "w"))


def complete(v: str) -> Column:
    """Whether a vector is there with all its coordinates; others lie near nothing."""
    return F.col(v).isNotNull() & ~F.coalesce(F.exists(v, lambda x: x.isNull()), F.lit(True))


@dataclass
class Grid:
    """Dimension, the grid's coordinates, its side and the largest coordinate."""

    dim: int
    columns: tuple[int, ...]
    side: float
    largest: float

    @classmethod
    def of(cls, vectors: DataFrame, eps: float, vec: str = "v") -> Grid:
        first = vectors.select(F.size(vec)).first()
        if first is None:
            return cls(0, (), 1.0, 0.0)
        dim = first[0]
        span = vectors.agg(*[f(F.col(vec)[i]) for i in range(dim) for f in (F.min, F.max)]).first()
        widths = [span[2 * i + 1] - span[2 * i] for i in range(dim)]
        largest = max((abs(x) for x in span), default=0.0)
        # quotients stay below 2^22, so that their rounding is far below the side's surplus
        side = max(eps * (1 + 1e-6), largest / (1 << 22), 1e-300)
        widest = sorted(range(dim), key=lambda i: (-widths[i], i))[:GRID_COLUMNS]
        return cls(dim, tuple(sorted(widest)), side, largest)

    def cell(self, v: Column) -> Column:
        return F.array(*[F.floor(v[i] / self.side).cast("long") for i in self.columns]) if self.columns else F.array(
            F.lit(0).cast("long"))

    def around(self, v: Column) -> Column:
        """The cell of ``v`` and its neighbours."""
        at = [F.floor(v[i] / self.side).cast("long") for i in self.columns]
        if not at:
            return F.array(self.cell(v))
        return F.array(*[F.array(*[x + s for x, s in zip(at, step)])
                         for step in itertools.product((-1, 0, 1), repeat=len(at))])

    def distance(self, a: Column, b: Column) -> Column:
        """Euclidean distance, summed coordinate by coordinate in order."""
        total = F.lit(0.0)
        for i in range(self.dim):
            total = total + (a[i] - b[i]) * (a[i] - b[i])
        return F.sqrt(total)

    def patch_side(self, eps: float) -> float | None:
        """Side of cells whose diagonal is below the radius; None if they would be
        too fine to tell apart."""
        side = eps / math.sqrt(max(self.dim, 1)) * (1 - 1e-6)
        return None if side <= 0 or self.largest / side > 1 << 30 else side

    def patch(self, v: Column, eps: float) -> Column | None:
        """A name that only vectors within ``eps`` of each other share, or None."""
        side = self.patch_side(eps)
        return None if side is None else F.transform(v, lambda x: F.floor(x / side).cast("long"))


def near_pairs(left: DataFrame, right: DataFrame, grid: Grid, eps: float, lv: str = "v", rv: str = "u",
               cell_rows: int = CELL_ROWS) -> DataFrame:
    """Rows of both sides (disjoint columns) whose vectors lie within ``eps``."""
    home = left.withColumn("_cell", grid.cell(F.col(lv)))
    away = right.withColumn("_cell", F.explode(grid.around(F.col(rv))))
    hot = cut_lineage(home.groupBy("_cell").agg(F.count("*").alias("_n")).where(F.col("_n") > cell_rows).select(
        "_cell", F.ceil(F.col("_n") / cell_rows).cast("int").alias("_salts")))
    on = ["_cell"]
    if hot.agg(F.count("*")).first()[0]:
        hot = broadcast_if_bounded(hot)
        salts = F.coalesce("_salts", F.lit(1))
        home = home.join(hot, "_cell", "left").withColumn(
            "_salt", F.pmod(F.xxhash64(F.col(lv)), salts).cast("int")).drop("_salts")
        away = away.join(hot, "_cell", "left").withColumn(
            "_salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("_salts")
        on.append("_salt")
    return home.join(away, on).where(grid.distance(F.col(lv), F.col(rv)) <= F.lit(float(eps))).drop(*on)


def near_blocks(left: DataFrame, right: DataFrame, grid: Grid, fn: Callable[[pa.Table, pa.Table], pa.Table | None],
                schema: str, cell_rows: int = CELL_ROWS, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Run ``fn(left rows of a cell, right rows in and around it)``; vectors are the
    columns ``v`` and ``u``, the other columns are disjoint.  Every left row meets every right row within
    the grid's radius once; a crowded cell is met in several blocks of either side, whose
    results are the caller's to add up."""
    from storelens.operators.neighbors import BLOCK_NUMBERS, block_size

    left, right = left.where(complete("v")), right.where(complete("u"))
    home = left.withColumn("_cell", grid.cell(F.col("v")))
    away = right.withColumn("_cell", grid.cell(F.col("u")))
    step = F.explode(F.array(*[F.array(*[F.col("_cell")[i] + x for i, x in enumerate(by)])
                               for by in itertools.product((-1, 0, 1), repeat=max(len(grid.columns), 1))]))
    cells = cut_lineage(home.groupBy("_cell").agg(F.count("*").alias("_h")).join(
        away.groupBy("_cell").agg(F.count("*").alias("_a")).select(step.alias("_cell"), "_a").groupBy("_cell").agg(
            F.sum("_a").alias("_a")), "_cell"))
    total, copies = cells.agg(F.coalesce(F.sum("_h"), F.lit(0)), F.coalesce(F.sum("_a"), F.lit(0))).first()
    dim = max(grid.dim, 1)
    home_rows, away_rows = block_size(total, dim, cell_rows), max(cell_rows, BLOCK_NUMBERS // dim)
    buckets = max(1, math.ceil((total + copies) / bucket_rows))
    salts = [F.ceil(F.col("_h") / home_rows).cast("int").alias("_hs"), F.ceil(F.col("_a") / away_rows).cast("int").alias("_as")]
    crowded = (F.col("_h") > home_rows) | (F.col("_a") > away_rows)
    kept = cells.select("_cell", *salts, F.when(crowded, F.xxhash64("_cell")).otherwise(
        F.pmod(F.xxhash64("_cell"), F.lit(buckets))).alias("_bucket"))
    kept = broadcast_if_bounded(kept)
    names = [*left.columns, *right.columns]
    own = {c: F.col(c) for c in left.columns} | {c: F.lit(None).cast(right.schema[c].dataType) for c in right.columns}
    hrows = home.join(kept, "_cell").withColumn("_s", F.pmod(F.xxhash64("v"), F.col("_hs")).cast("int")).withColumn(
        "_t", F.explode(F.sequence(F.lit(0), F.col("_as") - 1))).select(
        "_bucket", "_s", "_t", "_cell", F.lit(0).alias("_side"), *[own[c].alias(c) for c in names])
    other = {c: F.lit(None).cast(left.schema[c].dataType) for c in left.columns} | {c: F.col(c) for c in right.columns}
    arows = right.withColumn("_cell", F.explode(grid.around(F.col("u")))).join(kept, "_cell").withColumn(
        "_t", F.pmod(F.xxhash64("u"), F.col("_as")).cast("int")).withColumn(
        "_s", F.explode(F.sequence(F.lit(0), F.col("_hs") - 1))).select(
        "_bucket", "_s", "_t", "_cell", F.lit(1).alias("_side"), *[other[c].alias(c) for c in names])
    mine, theirs = left.columns, right.columns

    def run(t: pa.Table) -> pa.Table:
        at = t["_cell"].combine_chunks().flatten().to_numpy().reshape(len(t), -1)
        _, cell = np.unique(at, axis=0, return_inverse=True)
        key = cell.ravel() * 2 + t["_side"].to_numpy()
        order = np.argsort(key, kind="stable")
        t, key = t.select(names).take(pa.array(order)), key[order]
        out = []
        for c in np.unique(key // 2):
            low, mid, high = np.searchsorted(key, [2 * c, 2 * c + 1, 2 * c + 2])
            if low < mid < high:
                out.append(fn(t.slice(low, mid - low).select(mine), t.slice(mid, high - mid).select(theirs)))
        out = [o for o in out if o is not None]
        return pa.concat_tables(out) if out else none

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    none = to_arrow_schema(StructType.fromDDL(schema)).empty_table()
    return hrows.unionByName(arows).groupBy("_bucket", "_s", "_t").applyInArrow(run, schema)


def within(x: np.ndarray, y: np.ndarray, eps: float) -> np.ndarray:
    """Which pairs lie within ``eps``: by the Gram expansion, those that rounding
    leaves open by the distance summed coordinate by coordinate in order."""
    from storelens.operators.neighbors import _squares, exact_distances

    sq, error = _squares(x, y)
    slack = 2.0 * error + 1e-12 * eps * eps
    sure = sq <= eps * eps - slack
    maybe = sq <= eps * eps + slack
    if np.count_nonzero(sure) != np.count_nonzero(maybe):
        i, j = np.nonzero(maybe & ~sure)
        sure[i, j] = exact_distances(x[i], y[j]) <= eps
    return sure


class Boxes:
    """Rows sorted by group, and the box around each group's vectors."""

    def __init__(self, v: np.ndarray, group: np.ndarray):
        self.order = np.argsort(group, kind="stable")
        self.v, own = v[self.order], group[self.order]
        self.starts = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
        self.ends = np.r_[self.starts[1:], len(own)]
        self.names = own[self.starts]
        self.low, self.high = (f.reduceat(self.v, self.starts, axis=0) for f in (np.minimum, np.maximum))

    def gaps(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Smallest distance of each box from the box (or point) low .. high."""
        return np.sqrt((np.maximum(np.maximum(self.low - high, low - self.high), 0.0) ** 2).sum(1))

    def spans(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Largest distance of a point of each box from one of low .. high."""
        return np.sqrt((np.maximum(self.high - low, high - self.low) ** 2).sum(1))

    def rows(self, groups: np.ndarray) -> np.ndarray:
        return np.concatenate([np.arange(self.starts[g], self.ends[g]) for g in groups]) if len(groups) else np.zeros(0, int)


#: Factors of the radius beyond which rounding can't change what a box decides.
NEVER, ALWAYS = 1 + 1e-9, 1 - 1e-9


def patches(v: np.ndarray, side: float | None) -> np.ndarray:
    """A number for each patch (each row, if patches are too fine)."""
    if side is None:
        return np.arange(len(v))
    return np.unique(np.floor(v / side), axis=0, return_inverse=True)[1].ravel()


def eps_counts(points: DataFrame, eps: float, id_col: str = "id", vec: str = "features",
               block_rows: int = CELL_ROWS) -> DataFrame:
    """Number of points within ``eps`` (self included) per point."""
    vectors = weighted_vectors(points, id_col, vec)
    counts = vector_counts(vectors, Grid.of(vectors, eps), eps, block_rows)
    own = points.select(F.col(id_col), F.col(vec).cast("array<double>").alias("v"))
    return own.join(counts.select("v", "n_within"), "v").select(id_col, "n_within")


def vector_counts(vectors: DataFrame, grid: Grid, eps: float, cell_rows: int = CELL_ROWS,
                  home: DataFrame | None = None) -> DataFrame:
    """key, v, w and n_within (rows within ``eps``) of every distinct vector (of ``home``)."""
    from storelens.operators.neighbors import TILE, vectors as matrix

    eps, side = float(eps), grid.patch_side(float(eps))

    def count(home: pa.Table, away: pa.Table) -> pa.Table:
        x, y, w = matrix(home, "v"), matrix(away, "u"), away["other_w"].to_numpy()
        h, a = Boxes(x, patches(x, side)), Boxes(y, patches(y, side))
        w = w[a.order]
        weight = np.add.reduceat(w, a.starts)
        n = np.zeros(len(x), np.int64)
        for low, high, start, end in zip(h.low, h.high, h.starts, h.ends):
            whole = a.spans(low, high) <= eps * ALWAYS
            n[start:end] += weight[whole].sum()
            some = a.rows(np.flatnonzero(~whole & (a.gaps(low, high) <= eps * NEVER)))
            near, share = a.v[some], w[some].astype(float)  # whole numbers below 2^53
            for i in range(start, end, TILE[0]):
                last = min(i + TILE[0], end)
                for j in range(0, len(some), TILE[1]):
                    n[i:last] += (within(h.v[i:last], near[j:j + TILE[1]], eps) @ share[j:j + TILE[1]]).astype(np.int64)
        return pa.table({"v": home["v"].take(pa.array(h.order)), "n": n})

    other = vectors.select(F.col("v").alias("u"), F.col("w").alias("other_w"))
    home = vectors if home is None else home
    found = near_blocks(home.select("v"), other, grid, count, "v array<double>, n long", cell_rows)
    return home.join(found.groupBy("v").agg(F.sum("n").alias("n_within")), "v")
