"""The pivot-tree radius join equals brute force, with and without cell splitting, and prunes."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from dictaudit.operators import radius as R
from dictaudit.operators import radius_tree as RT


def _clustered(n=400, d=12, seed=5):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(8, d))
    x = centres[rng.integers(0, 8, size=n)] + 0.08 * rng.normal(size=(n, d))
    x[::37] = rng.normal(size=(len(x[::37]), d))       # scattered points
    x[3] = x[5] = 0.0                                   # zero vectors
    x[10:60] = x[10] + 0.01 * rng.normal(size=(50, d))  # a hot cluster of near-copies
    x[70:110] = x[70]                                   # copies
    x[110:113] = 2 * x[70]                              # the same direction
    return x.astype(np.float32)


def _brute(x, r):
    u = x.astype(np.float64)
    n = np.linalg.norm(u, axis=1, keepdims=True)
    u = np.divide(u, n, out=np.zeros_like(u), where=n > 0)
    dist = 1.0 - np.clip(u @ u.T, -1, 1)
    i, j = np.nonzero(np.triu(dist <= r, 1))
    return {(int(a), int(b)): float(dist[a, b]) for a, b in zip(i, j)}


def _frame(spark, x):
    pdf = pd.DataFrame({"vec_id": np.arange(len(x), dtype=np.int64), "embedding": [list(map(float, v)) for v in x]})
    return spark.createDataFrame(pdf, "vec_id long, embedding array<float>")


@pytest.fixture(scope="module")
def clustered(spark):
    x = _clustered()
    return x, _frame(spark, x)


@pytest.mark.parametrize("radius, cells, cell_rows", [(0.01, 8, 2048), (0.05, None, 16), (0.2, 4, 32), (0.5, 32, 64), (0.99, 1, 64), (1.2, 8, 64)])
def test_tree_join_equals_brute_force(clustered, radius, cells, cell_rows):
    x, df = clustered
    want = _brute(x, radius)
    rows = RT.radius_tree_join(df, radius, id_col="vec_id", n_cells=cells, cell_rows=cell_rows).collect()
    got = {(r.id_a, r.id_b): r.distance for r in rows}
    assert len(rows) == len(got) and set(got) == set(want)
    assert all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_tree_join_equals_blocks_on_fixture(spark):
    from dictaudit.sources import tables as S

    v = S.vectors(spark, "/root/testdata/sf0.01")
    a = sorted((r.id_a, r.id_b) for r in RT.radius_tree_join(v, 0.6, id_col="vec_id").collect())
    b = sorted((r.id_a, r.id_b) for r in R.radius_join(v, 0.6, id_col="vec_id").collect())
    assert a == b and len(a) == 59


def test_copies_stay_far_below_the_cells(spark):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(60, 16))
    x = np.repeat(centres, 40, axis=0) + 0.05 * rng.normal(size=(2400, 16))
    cells, _ = RT.cell_copies(_frame(spark, x), 0.0025, id_col="vec_id")
    n, copies, used = cells.agg(F.count_if("is_home"), F.count("*"), F.countDistinct("cell")).first()
    assert n == 2400 and used > 40 and copies < 3 * n


def test_no_direction_at_all(spark):
    df = spark.createDataFrame([(1, [0.0, 0.0]), (2, [0.0, 0.0]), (3, None)], "vec_id long, embedding array<float>")
    assert RT.radius_tree_join(df, 0.5, id_col="vec_id").count() == 0
    one = spark.createDataFrame([(1, [0.0, 0.0]), (2, [1.0, 0.0]), (3, [2.0, 0.0])], "vec_id long, embedding array<float>")
    assert [(r.id_a, r.id_b) for r in RT.radius_tree_join(one, 0.1, id_col="vec_id").collect()] == [(2, 3)]
