"""DBSCAN on the spatial hash grid.

1. core vectors: at least ``min_samples`` points (self included) within eps,
   equal vectors counted by weight (:func:`grid.vector_counts`); those of a patch (see
   below) with as many points need no count;
2. core vectors of one patch - a cell whose diagonal is below eps - are linked
   by themselves, so they are one node; two patches are linked if any of their
   core vectors are within eps.  A patch has a bounded number of patches within
   reach, so links grow with the patches and not with the pairs; a block of cells
   looks for one close pair of two patches that its links don't connect yet;
3. components of the links (:mod:`components`: logarithmic rounds until nothing
   changes, a reliable checkpoint after each);
4. border points take the smallest component label among their core
   neighbours (deterministic, unlike order-dependent implementations),
   everything else is noise (-1); components are numbered 0.. by their
   smallest core id.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storelens.functions.ordering import numbered
from storelens.functions.sizing import cut_lineage
from storelens.operators.components import connected_components
from storelens.operators.grid import (ALWAYS, BUCKET_ROWS, CELL_ROWS, NEVER, Boxes, Grid, complete, near_blocks, patches,
                                      vector_counts, weighted_vectors, within)
from storelens.operators.nearby import list_quantile, nearest_distances
from storelens.operators.neighbors import TILE, vectors as matrix


def suggest_eps(points: DataFrame, id_col: str = "id", vec: str = "features", k: int | None = None,
                pct: float = 0.9, scale: float = 0.5, adjust: float = 0.7) -> float:
    """eps = percentile_pct(all k-NN distances, self included) * scale + adjust,
    k = min(50, n - 1) - the reference's data-driven choice."""
    k = min(50, points.count() - 1) if k is None else k
    return float(list_quantile(nearest_distances(points, k, id_col, vec), pct)) * scale + adjust


def _any_within(x: np.ndarray, y: np.ndarray, eps: float) -> bool:
    """Whether any pair lies within ``eps``; rows nearest to the other side's box first."""
    a, b = Boxes(x, np.zeros(len(x), int)), Boxes(y, np.zeros(len(y), int))
    sides = []
    for v, box in ((x, b), (y, a)):
        gap = np.sqrt((np.maximum(np.maximum(box.low - v, v - box.high), 0.0) ** 2).sum(1))
        order = np.argsort(gap, kind="stable")
        sides.append(v[order[gap[order] <= eps * NEVER]])
    x, y = sides
    return any(within(x[i:i + TILE[0]], y[j:j + TILE[1]], eps).any()
               for i in range(0, len(x), TILE[0]) for j in range(0, len(y), TILE[1]))


def _links(core: DataFrame, grid: Grid, eps: float, block_rows: int, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """a < b: nodes with core vectors within ``eps`` of each other, enough of them to
    connect all that are."""
    def link(home: pa.Table, away: pa.Table) -> pa.Table:
        h = Boxes(matrix(home, "v"), home["node"].to_numpy())
        a = Boxes(matrix(away, "u"), away["other"].to_numpy())
        root: dict[int, int] = {}

        def find(n: int) -> int:
            while root.get(n, n) != n:
                n = root[n]
            return n

        near = []
        for i, n in enumerate(h.names):
            gap = a.gaps(h.low[i], h.high[i])
            near += [(gap[j], i, j) for j in np.flatnonzero((gap <= eps * NEVER) & (a.names > n))]
        found = []
        for _, i, j in sorted(near):
            n, m = int(h.names[i]), int(a.names[j])
            if find(n) != find(m) and _any_within(h.v[h.starts[i]:h.ends[i]], a.v[a.starts[j]:a.ends[j]], eps):
                root[find(m)] = find(n)
                found.append((n, m))
        return pa.table({"a": pa.array([n for n, _ in found], pa.int64()), "b": pa.array([m for _, m in found], pa.int64())})

    other = core.select(F.col("v").alias("u"), F.col("node").alias("other"))
    return near_blocks(core.select("v", "node"), other, grid, link, "a long, b long", block_rows, bucket_rows).distinct()


def _borders(rest: DataFrame, core: DataFrame, grid: Grid, eps: float, block_rows: int,
             bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """key, v and the smallest root within ``eps`` of the vectors of ``rest`` that have one."""
    side = grid.patch_side(eps)

    def border(home: pa.Table, away: pa.Table) -> pa.Table:
        x, y, root = matrix(home, "v"), matrix(away, "u"), away["root"].to_numpy()
        patch = patches(y, side)
        _, first = np.unique(np.stack([root, patch], 1), axis=0, return_inverse=True)  # by root
        h, a = Boxes(x, patches(x, side)), Boxes(y, first.ravel())
        roots = root[a.order][a.starts]
        label = np.full(len(x), -1, np.int64)
        has = np.zeros(len(x), bool)
        for low, high, start, end in zip(h.low, h.high, h.starts, h.ends):
            spans, gaps = a.spans(low, high), a.gaps(low, high)
            open_, reach = np.arange(start, end), np.flatnonzero(gaps <= eps * NEVER)
            for groups in np.split(reach, np.flatnonzero(np.diff(roots[reach])) + 1):  # those of one root
                if not len(open_) or not len(groups):
                    break
                near = np.full(len(open_), bool((spans[groups] <= eps * ALWAYS).any()))
                some = a.v[a.rows(groups)] if not near.all() else a.v[:0]
                for i in range(0, len(open_), TILE[0]):
                    for j in range(0, len(some), TILE[1]):
                        near[i:i + TILE[0]] |= within(h.v[open_[i:i + TILE[0]]], some[j:j + TILE[1]], eps).any(1)
                label[open_[near]], has[open_[near]] = roots[groups[0]], True
                open_ = open_[~near]
        rows = pa.array(h.order[has])
        return pa.table({"key": home["key"].take(rows), "v": home["v"].take(rows), "root": label[has]})

    found = near_blocks(rest.select("key", "v"), core.select(F.col("v").alias("u"), "root"), grid, border,
                        "key long, v array<double>, root long", block_rows, bucket_rows)
    return found.groupBy("key", "v").agg(F.min("root").alias("root"))


#: A box of a patch's vectors stands for at least so many of them on the average, and there are
#: at most so many boxes (a task's or the driver's few MB); else every vector is looked at.
BOX_VECTORS, MAX_BOXES = 4, 1 << 16
#: Rows of both sides of a task's group where boxes meet: there is more to do for a row.
BOX_ROWS = 1 << 14


def _box_side(named: DataFrame, side: float | None, dim: int, box_vectors: float) -> float | None:
    """Side of the boxes that patches are cut into, or None if they are no fewer than the vectors."""
    if side is None:
        return None
    n = named.count()
    for part in (8, 4, 2):
        boxes = named.select("patch", _box(side / part).alias("box")).distinct().count()
        if boxes <= MAX_BOXES and boxes * box_vectors <= n:
            return side / part
    return None


def _box(side: float):
    return F.transform("v", lambda x: F.floor(x / side).cast("long"))


def _bounds(named: DataFrame, dim: int, eps: float, reach: float, min_samples: int, block_rows: int) -> DataFrame:
    """patch, box and core (null: open) of the boxes of patches that are not full, from the
    boxes that lie wholly, or partly, within ``eps`` of all of a box."""
    corner = [F.array(*[f(F.col("v")[i]) for i in range(dim)]) for f in (F.min, F.max)]
    boxes = cut_lineage(named.groupBy("patch", "box", "full").agg(
        corner[0].alias("v"), corner[1].alias("high"), F.sum("w").alias("w")))

    def bound(home: pa.Table, away: pa.Table) -> pa.Table:
        low, high = matrix(home, "v"), matrix(home, "high")
        a_low, a_high = np.ascontiguousarray(matrix(away, "u").T), np.ascontiguousarray(matrix(away, "other_high").T)
        w = away["other_w"].to_numpy()
        sure, most = np.zeros(len(low), np.int64), np.zeros(len(low), np.int64)
        for r in range(len(low)):
            span, gap = np.zeros(len(w)), np.zeros(len(w))
            for i in range(dim):
                up, down = a_high[i] - low[r, i], high[r, i] - a_low[i]
                span += np.maximum(up, down) ** 2
                gap += np.maximum(np.maximum(-up, -down), 0.0) ** 2
            sure[r] = w[span <= (eps * ALWAYS) ** 2].sum()
            most[r] = w[gap <= (eps * NEVER) ** 2].sum()
        return pa.table({"patch": home["patch"], "box": home["box"], "sure": sure, "most": most})

    other = boxes.select(F.col("v").alias("u"), F.col("high").alias("other_high"), F.col("w").alias("other_w"))
    found = near_blocks(boxes.where("not full").select("v", "high", "patch", "box"), other, Grid.of(boxes, reach), bound,
                        "patch array<long>, box array<long>, sure long, most long", block_rows, BOX_ROWS)
    return cut_lineage(found.groupBy("patch", "box").agg(F.sum("sure").alias("sure"), F.sum("most").alias("most")).select(
        "patch", "box", F.when(F.col("sure") >= min_samples, True).when(F.col("most") < min_samples, False).alias("core")))


def _within_reach(left: DataFrame, right: DataFrame, reach: float, wanted, block_rows: int) -> DataFrame:
    """n of the left rows (n, v, root) and of the right ones (m, u, other_root) that have one of the
    other side within ``reach`` for which ``wanted(root, other roots)`` is true."""
    def meet(home: pa.Table, away: pa.Table) -> pa.Table:
        x, y = matrix(home, "v"), matrix(away, "u")
        root, other = home["root"].to_numpy(), away["other_root"].to_numpy()
        mine, theirs = np.zeros(len(x), bool), np.zeros(len(y), bool)
        for i in range(0, len(x), TILE[0]):
            for j in range(0, len(y), TILE[1]):
                fits = wanted(root[i:i + TILE[0], None], other[None, j:j + TILE[1]])
                if fits.any():
                    fits &= within(x[i:i + TILE[0]], y[j:j + TILE[1]], reach)
                    mine[i:i + TILE[0]] |= fits.any(1)
                    theirs[j:j + TILE[1]] |= fits.any(0)
        return pa.table({"n": pa.concat_arrays([home["n"].combine_chunks().filter(pa.array(mine)),
                                                away["m"].combine_chunks().filter(pa.array(theirs))]),
                         "left": np.r_[np.ones(mine.sum(), bool), np.zeros(theirs.sum(), bool)]})

    grid = Grid.of(right, reach, "u")
    return cut_lineage(near_blocks(left, right, grid, meet, "n long, left boolean", block_rows, BOX_ROWS).distinct())


def _boxes_of(core: DataFrame) -> DataFrame:
    """box_id, node (or root) and v of one core vector of each box, as a table."""
    group = core.columns[-1]
    return cut_lineage(core.groupBy("box", group).agg(F.min("v").alias("v")).withColumn("m", F.monotonically_increasing_id()))


def dbscan(points: DataFrame, eps: float, min_samples: int, id_col: str = "id", vec: str = "features",
           block_rows: int = CELL_ROWS, out: str = "dbscan_cluster", box_vectors: float = BOX_VECTORS) -> DataFrame:
    """(id, cluster) with -1 for noise."""
    vectors = weighted_vectors(points, id_col, vec)
    eps = float(eps)
    grid = Grid.of(vectors, eps)
    patch = grid.patch(F.col("v"), eps)
    named = vectors.where(complete("v")).withColumn("patch", F.col("v") if patch is None else patch)
    side = _box_side(named, None if patch is None else grid.patch_side(eps), grid.dim, box_vectors)
    # how far apart vectors of two boxes can be, where those that stand for them are within the radius
    reach = None if side is None else eps + 2.0 * side * math.sqrt(grid.dim) * (1 + 1e-6)
    named = named.withColumn("box", F.array(F.lit(0).cast("long")) if side is None else _box(side))
    full = named.groupBy("patch").agg((F.sum("w") >= min_samples).alias("full"))
    named = cut_lineage(named.join(full, "patch").select("key", "v", "w", "patch", "box", "full"))
    open_, decided = named.where("not full"), named.where("full").select("key", "v", "patch", "box", F.lit(True).alias("core"))
    if side is not None:
        # at most MAX_BOXES rows
        known = open_.join(F.broadcast(_bounds(named, grid.dim, eps, reach, min_samples, block_rows)), ["patch", "box"])
        decided = decided.unionByName(known.where("core is not null").select(*decided.columns))
        open_ = cut_lineage(known.where("core is null").select(*named.columns))
    counts = vector_counts(vectors, grid, eps, block_rows, open_)
    counted = cut_lineage(decided.unionByName(
        counts.select("key", "v", "patch", "box", (F.col("n_within") >= min_samples).alias("core"))))
    core = counted.where("core").select("key", "v", "patch", "box")
    core = cut_lineage(core.join(core.groupBy("patch").agg(F.min("key").alias("node")), "patch").select("key", "v", "box", "node"))
    if side is None:
        roots = connected_components(cut_lineage(_links(core, grid, eps, block_rows)))
    else:
        roots = _box_roots(core, grid, eps, reach, block_rows)
    core = cut_lineage(core.join(roots, "node", "left").select("key", "v", "box", F.coalesce("root", "node").alias("root")))
    rest = counted.where("not core")
    border = (_borders(rest, core, grid, eps, block_rows) if side is None
              else _box_borders(rest, core, grid, eps, reach, block_rows))
    order = numbered(core.select("root").distinct(), ["root"], out="_cluster")
    labelled = core.select("key", "v", "root").unionByName(border).join(order, "root").select("v", (F.col("_cluster") - 1).alias("_cluster"))
    own = points.select(F.col(id_col), F.col(vec).cast("array<double>").alias("v"))
    return own.join(labelled, "v", "left").select(id_col, F.coalesce("_cluster", F.lit(-1)).cast("int").alias(out))


def _roots(links: list[tuple[int, int]]) -> dict[int, int]:
    """Smallest node of its component for every node of a link."""
    up: dict[int, int] = {}

    def find(n: int) -> int:
        while up.setdefault(n, n) != n:
            up[n] = n = up[up[n]]
        return n

    for a, b in links:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {n: find(n) for n in list(up)}


def _box_roots(core: DataFrame, grid: Grid, eps: float, reach: float, block_rows: int) -> DataFrame:
    """node and root: by the links of one vector of each box, then by all vectors of those
    boxes that may lie within ``eps`` of another component's.  At most MAX_BOXES nodes, whose
    links (a few for each) are joined on the driver."""
    one = _boxes_of(core.select("box", "v", "node"))
    links = [tuple(r) for r in _links(one, grid, eps, block_rows, BOX_ROWS).collect()]
    frame = lambda found: F.broadcast(core.sparkSession.createDataFrame(list(found.items()), "node long, root long"))
    named = cut_lineage(one.join(frame(_roots(links)), "node", "left").select("m", "box", "node", "v", F.coalesce("root", "node").alias("root")))
    if named.agg(F.countDistinct("root")).first()[0] > 1:
        near = _within_reach(named.select(F.col("m").alias("n"), "v", "root"),
                             named.select("m", F.col("v").alias("u"), F.col("root").alias("other_root")), reach,
                             lambda a, b: a != b, block_rows)
        few = named.join(near.select(F.col("n").alias("m")).distinct(), "m").select("box", "node")
        some = cut_lineage(core.join(F.broadcast(few), ["box", "node"]).select("v", "node"))  # at most MAX_BOXES
        links += [tuple(r) for r in _links(some, grid, eps, block_rows).collect()]
    return frame(_roots(links))


def _box_borders(rest: DataFrame, core: DataFrame, grid: Grid, eps: float, reach: float, block_rows: int) -> DataFrame:
    """:func:`_borders` by one core vector of each box, then, where a smaller root may lie within
    ``eps``, by all vectors of those boxes."""
    one = _boxes_of(core.select("box", "v", "root"))
    rest = cut_lineage(rest.select("key", "v").withColumn("n", F.monotonically_increasing_id()))
    first = cut_lineage(_borders(rest, one, grid, eps, block_rows, BOX_ROWS))
    none = F.lit((1 << 63) - 1)
    left = rest.join(first.select("v", "root"), "v", "left").select("n", "v", F.coalesce("root", none).alias("root"))
    # one with the smallest root of all has no smaller one
    left = left.where(F.col("root") > F.lit(core.agg(F.min("root")).first()[0]))
    near = _within_reach(left, one.select("m", F.col("v").alias("u"), F.col("root").alias("other_root")), reach,
                         lambda a, b: b < a, block_rows)
    some = rest.join(near.where("left").select("n"), "n").select("key", "v")
    few = one.join(near.where("not left").select(F.col("n").alias("m")), "m").select("box", "root")
    found = _borders(cut_lineage(some), cut_lineage(core.join(F.broadcast(few), ["box", "root"]).select("v", "root")),
                     grid, eps, block_rows)  # at most MAX_BOXES boxes
    return first.unionByName(found).groupBy("key", "v").agg(F.min("root").alias("root"))
