"""J6, pruned exact strategy: a two-level pivot tree for radii below 1, at every size.

For unit vectors, cosine distance ≤ r ⇔ Euclidean distance ≤ ρ = √(2r).

* Equal vectors are one row (the smallest id stands for its class); pairs are given back to all members
  at the end, so a hot vector is joined once.
* About √N cells where the bounds below keep a row out of most of them, else N / ``block_rows`` cells (judged by
  the sample): copies that nothing prunes cost a block join's shuffle, not N·√N rows. Top pivots, and below each its own sub-pivots, picked from a hash sample by taking the
  farthest point again and again. A vector's home is the nearest sub-pivot below its nearest top pivot. The
  pivots are all that is sent to every task, at most ``PIVOT_BYTES``.
* A vector x meets a vector y within ρ in the cells that x visits. Both levels prune by two bounds: y is
  nearest to its own pivot, so d(x, pivot) ≤ (least distance of x to a pivot of the level) + 2ρ; and y lies
  in the pivot's annulus [lo, hi] of distances, so lo − ρ ≤ d(x, pivot) ≤ hi + ρ.
* x visits only cells with a smaller number than its home: of a pair in two cells one side travels, and
  each pair is found once.
* A cell with many rows is cut into a grid (home sub-blocks × probe chunks) from the cells' counts, so every
  group holds about ``2 · cell_rows`` rows however the data clusters. A task holds one group, one tile of
  products and one slice of copies or pairs at a time.
* Products are taken in single precision first; what may lie within the radius is measured in double.

Zero vectors have distance 1 to everything and join nothing below r = 1; for r ≥ 1 nothing can be pruned and
the block join does the work.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from ..session import materialize
from . import radius as R

BLOCK_BYTES = 32 << 20   # vectors of one side of a group, in double precision
BLOCK_ROWS = 1 << 15
PIVOT_BYTES = 64 << 20
SLICE_BYTES = 8 << 20    # copies sent on at a time
FEW_VISITS = 4           # foreign cells a row, up to which √N cells are worth it
TILE = 2048
SAMPLE_PER_CELL = 4
_SLACK = 1e-7   # √ of the rounding of a dot product


def block_rows(dim: int) -> int:
    """Rows of one side of a group."""
    return max(256, min(BLOCK_ROWS, BLOCK_BYTES // (8 * max(dim, 1))))


def _matrix(col) -> np.ndarray:
    """A list column as unit rows in double precision (a zero vector stays zero)."""
    col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    x = np.asarray(col.flatten(), np.float64).reshape(len(col), -1) if len(col) else np.zeros((0, 0))
    n = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, n, out=np.zeros_like(x), where=n > 0)


def _far(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Euclidean distances of unit rows."""
    return np.sqrt(np.maximum(0.0, 2.0 - 2.0 * (x @ y.T)))


def _farthest_points(x: np.ndarray, k: int) -> np.ndarray:
    """Numbers of k rows: the first, then the one farthest from all rows taken."""
    taken = [0]
    near = _far(x, x[:1])[:, 0]
    while len(taken) < min(k, len(x)) and near.max() > 0:
        taken.append(int(near.argmax()))
        near = np.minimum(near, _far(x, x[taken[-1]:taken[-1] + 1])[:, 0])
    return np.array(taken)


def pivot_tree(sample: np.ndarray, cells: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Top pivots, sub-pivots in order of their top pivot, and the first sub-pivot of each."""
    tops = sample[_farthest_points(sample, math.ceil(math.sqrt(cells)))]
    home = _far(sample, tops).argmin(axis=1)
    subs, first = [], [0]
    for p in range(len(tops)):
        mine = sample[home == p]
        subs.append(mine[_farthest_points(mine, max(1, round(cells * len(mine) / len(sample))))] if len(mine) else tops[p:p + 1])
        first.append(first[-1] + len(subs[-1]))
    return tops, np.concatenate(subs), np.array(first)


def _home(tree):
    def run(batches):
        tops, subs, first = tree.value
        for batch in batches:
            x = _matrix(batch.column(1))
            if not len(x):
                continue
            far = _far(x, tops)
            top = far.argmin(axis=1)
            cell, near = np.zeros(len(x), np.int64), np.zeros(len(x))
            for p in np.unique(top):
                at = np.flatnonzero(top == p)
                d = _far(x[at], subs[first[p]:first[p + 1]])
                cell[at], near[at] = first[p] + d.argmin(axis=1), d.min(axis=1)
            ok = pa.array(np.linalg.norm(x, axis=1) > 0)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(top.astype(np.int32)), pa.array(cell.astype(np.int32)), pa.array(far[np.arange(len(x)), top]),
                 pa.array(near), batch.column(1)], ["id", "top", "cell", "d_top", "d_cell", "vec"]).filter(ok)
    return run


def _open_cells(x: np.ndarray, own: np.ndarray, tree, bounds, rho: float):
    """(row, cell) of the cells with smaller numbers than a row's own that may hold a partner of it."""
    tops, subs, first = tree
    (top_lo, top_hi), (cell_lo, cell_hi) = bounds
    reach = rho + _SLACK
    rows, cells = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    far = _far(x, tops)
    open_ = (far <= far.min(axis=1, keepdims=True) + 2 * reach) & (far <= top_hi + reach) & (far >= top_lo - reach)
    for p in np.flatnonzero(open_.any(axis=0)):
        at = np.flatnonzero(open_[:, p])
        span = slice(first[p], first[p + 1])
        d = _far(x[at], subs[span])
        ok = (d <= d.min(axis=1, keepdims=True) + 2 * reach) & (d <= cell_hi[span] + reach) & (d >= cell_lo[span] - reach)
        ok &= first[p] + np.arange(d.shape[1])[None, :] < own[at][:, None]
        r, c = np.nonzero(ok)
        rows.append(at[r])
        cells.append(first[p] + c)
    return np.concatenate(rows), np.concatenate(cells)


def _visits(tree, bounds, rho: float, schema):
    """Home rows, and copies for the cells with smaller numbers that may hold a partner."""
    arrow = to_arrow_schema(schema)

    def run(batches):
        for batch in batches:
            x = _matrix(batch.column(3))
            if not len(x):
                continue
            step = max(1, SLICE_BYTES // (8 * max(x.shape[1], 1)))
            own = batch.column(2).to_numpy()
            rows, cells = _open_cells(x, own, tree.value, bounds, rho)
            rows, cells = np.concatenate([np.arange(len(x)), rows]), np.concatenate([own, cells]).astype(np.int32)
            home = np.arange(len(rows)) < len(x)
            for lo in range(0, len(rows), step):
                row = pa.array(rows[lo:lo + step])
                yield pa.RecordBatch.from_arrays([batch.column(0).take(row), pa.array(cells[lo:lo + step]), pa.array(home[lo:lo + step]),
                                                  batch.column(3).take(row)], schema=arrow)
    return run


def _sides(batches):
    """Ids, unit rows and is_home of the home rows and of the probe rows of a group."""
    parts = {0: [], 1: []}
    for batch in batches:
        side = batch.column("side").to_numpy()
        for s, out in parts.items():
            t = batch.filter(pa.array(side == s))
            if len(t):
                out.append((t.column("id").to_numpy(), _matrix(t.column("vec")), t.column("is_home").to_numpy(zero_copy_only=False)))
    return [tuple(np.concatenate(c) for c in zip(*out)) if out else None for out in (parts[0], parts[1])]


def _pairs(radius: float):
    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        home, probe = _sides(batches)
        if home is None or probe is None:
            return
        (a, x, _), (b, y, inside) = home, probe
        near, small = x.astype(np.float32), y.astype(np.float32)
        least = np.float32(1.0 - radius - 1e-6 - 2.4e-7 * x.shape[1])  # less by the rounding of a single-precision product
        for lo in range(0, len(a), TILE):
            for to in range(0, len(b), TILE):
                i, j = np.nonzero(near[lo:lo + TILE] @ small[to:to + TILE].T >= least)
                i, j = i + lo, j + to
                # within the cell each pair once; a visitor meets every home row
                once = ~inside[j] | (a[i] < b[j])
                i, j = i[once], j[once]
                for at in range(0, len(i), TILE * 8):
                    k, m = i[at:at + TILE * 8], j[at:at + TILE * 8]
                    d = 1.0 - np.clip(np.einsum("ij,ij->i", x[k], y[m]), -1.0, 1.0)
                    k, m, d = (v[d <= radius] for v in (k, m, d))
                    if len(d):
                        yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a[k], b[m])), pa.array(np.maximum(a[k], b[m])), pa.array(d)],
                                                         ["id_a", "id_b", "distance"])
    return kernel


def _classes(df: DataFrame, id_col: str, vec_col: str) -> tuple[DataFrame, DataFrame]:
    """One row per distinct vector (id: its smallest), and (rep, id, is_zero) for the classes of several rows."""
    named = df.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("vec")).where("vec is not null").withColumn(
        "key", F.struct(F.xxhash64("vec").alias("h1"), F.xxhash64(F.lit(1), "vec").alias("h2")))
    named = materialize(named, "radius-input")
    classes = materialize(named.groupBy("key").agg(F.min("id").alias("id"), F.min_by("vec", "id").alias("vec"), F.count("*").alias("n")), "radius-classes")
    members = named.select("key", "id").join(classes.where("n > 1").select(
        "key", F.col("id").alias("rep"), (~F.exists("vec", lambda v: v != 0)).alias("is_zero")), "key").select("rep", "id", "is_zero")
    return classes.select("id", "vec"), members


def sample_visits(points: np.ndarray, tree, rho: float, rows: int = 2048) -> float:
    """Foreign cells that a row of the sample has to visit, on average."""
    tops, subs, first = tree
    x = points[:rows]
    far = _far(x, tops)
    top = far.argmin(axis=1)
    cell, near = np.zeros(len(x), np.int64), np.zeros(len(x))
    for p in np.unique(top):
        at = np.flatnonzero(top == p)
        d = _far(x[at], subs[first[p]:first[p + 1]])
        cell[at], near[at] = first[p] + d.argmin(axis=1), d.min(axis=1)

    def annuli(at, d, size):
        lo, hi = np.full(size, np.inf), np.full(size, -np.inf)
        np.minimum.at(lo, at, d)
        np.maximum.at(hi, at, d)
        return lo, hi

    bounds = annuli(top, far[np.arange(len(x)), top], len(tops)), annuli(cell, near, len(subs))
    return len(_open_cells(x, cell, tree, bounds, rho)[0]) / len(x)


def cell_copies(df: DataFrame, radius: float, id_col: str = "id", vec_col: str = "embedding", n_cells: int | None = None,
                seed: int = 17) -> tuple[DataFrame, DataFrame] | None:
    """Rows (id, cell, is_home, vec) of the cells that each distinct vector is in, and the class members.
    None if no vector has a direction."""
    spark = df.sparkSession
    base, members = _classes(df, id_col, vec_col)
    n, dim = base.agg(F.count("*"), F.coalesce(F.max(F.size("vec")), F.lit(0))).first()
    cells = n_cells or max(1, min(math.ceil(math.sqrt(n)), PIVOT_BYTES // (8 * max(dim, 1))))
    wanted = min(SAMPLE_PER_CELL * cells + 64, 4 * PIVOT_BYTES // (8 * max(dim, 1)))
    share = min(1.0, 1.2 * wanted / max(n, 1))
    cut = F.lit(min(int(-(2 ** 63) + share * (2 ** 64 - 1)), 2 ** 63 - 1))
    sample = base.where(F.xxhash64("id", F.lit(seed)) <= cut).orderBy(F.xxhash64("id", F.lit(seed))).select("vec").limit(wanted).toArrow()
    points = _matrix(sample.column("vec"))
    points = points[np.linalg.norm(points, axis=1) > 0]
    if not len(points):  # the sample holds zero vectors only: any direction will do
        some = base.where(F.exists("vec", lambda v: v != 0)).limit(1).select("vec").toArrow()
        points = _matrix(some.column("vec"))
    if not len(points):
        return None
    points_tree = pivot_tree(points, cells)
    if n_cells is None and sample_visits(points, points_tree, math.sqrt(2.0 * radius)) > max(FEW_VISITS, n / block_rows(dim) / 2):
        points_tree = pivot_tree(points, min(cells, math.ceil(n / block_rows(dim))))
    tree = spark.sparkContext.broadcast(points_tree)
    kind = base.schema["vec"].dataType.simpleString()
    homes = materialize(base.mapInArrow(_home(tree), f"id long, top int, cell int, d_top double, d_cell double, vec {kind}"), "radius-homes")

    def annuli(by: str, d: str, size: int):
        lo, hi = np.full(size, np.inf), np.full(size, -np.inf)
        for r in homes.groupBy(by).agg(F.min(d).alias("lo"), F.max(d).alias("hi")).collect():  # a row a pivot
            lo[r[by]], hi[r[by]] = r.lo, r.hi
        return lo, hi

    tops, subs, _ = tree.value
    bounds = annuli("top", "d_top", len(tops)), annuli("cell", "d_cell", len(subs))
    out = base.select("id", F.lit(0).alias("cell"), F.lit(True).alias("is_home"), "vec").schema
    copies = homes.select("id", "top", "cell", "vec").mapInArrow(_visits(tree, bounds, math.sqrt(2.0 * radius), out), out)
    return materialize(copies, "radius-cells"), members


def radius_tree_join(df: DataFrame, radius: float, id_col: str = "id", vec_col: str = "embedding", n_cells: int | None = None,
                     cell_rows: int | None = None) -> DataFrame:
    """All pairs ``id_a < id_b`` whose cosine distance is at most ``radius``; same result as the block join."""
    if radius >= 1.0:
        return R.radius_join(df, radius, id_col=id_col, vec_col=vec_col)
    found = cell_copies(df, radius, id_col, vec_col, n_cells)
    if found is None:
        return df.sparkSession.createDataFrame([], R.PAIR_SCHEMA)
    cells, members = found
    cell_rows = cell_rows or block_rows(cells.select(F.size("vec")).first()[0])
    # grid sizes of the cells: a row a pivot
    sizes = cells.groupBy("cell").agg(F.count_if("is_home").alias("h"), F.count(F.lit(1)).alias("p")).select(
        "cell", F.greatest(F.lit(1), F.ceil(F.col("h") / cell_rows)).cast("int").alias("bq"),
        F.greatest(F.lit(1), F.ceil(F.col("p") / cell_rows)).cast("int").alias("pq"))
    c = cells.join(F.broadcast(sizes), "cell")
    h = F.pmod(F.xxhash64("id"), F.lit(1 << 30))
    home = c.where("is_home").select("cell", (h % F.col("bq")).cast("int").alias("sub"), F.explode(F.sequence(F.lit(0), F.col("pq") - 1)).alias("chunk"),
                                     F.lit(0).alias("side"), "is_home", "id", "vec")
    probe = c.select("cell", F.explode(F.sequence(F.lit(0), F.col("bq") - 1)).alias("sub"), (h % F.col("pq")).cast("int").alias("chunk"),
                     F.lit(1).alias("side"), "is_home", "id", "vec")
    pairs = home.unionByName(probe).groupBy("cell", "sub", "chunk").applyInArrow(_pairs(float(radius)), R.PAIR_SCHEMA)
    return _expanded(pairs, members)


def _expanded(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """Pairs of classes as pairs of their rows, and the pairs inside each class."""
    members = materialize(members, "radius-members")
    side = lambda c: members.select(F.col("rep").alias(c), F.col("id").alias(f"m_{c}"))
    a, b = F.coalesce("m_id_a", "id_a"), F.coalesce("m_id_b", "id_b")
    between = pairs.join(side("id_a"), "id_a", "left").join(side("id_b"), "id_b", "left").select(
        F.least(a, b).alias("id_a"), F.greatest(a, b).alias("id_b"), "distance")
    same = members.where("not is_zero")  # zero vectors are at distance 1 from each other
    inside = same.join(same.select("rep", F.col("id").alias("other")), "rep").where("id < other").select(
        F.col("id").alias("id_a"), F.col("other").alias("id_b"), F.lit(0.0).alias("distance"))
    return between.union(inside)
