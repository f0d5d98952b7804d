"""The pivot join stays bounded where its bounds prune nothing."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from dictaudit.operators import radius_tree as RT


def _frame(spark, x):
    return spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "vec_id long, embedding array<double>")


def test_unprunable_rows_are_not_copied_into_every_cell(spark):
    x = np.random.default_rng(2).normal(size=(1500, 32))
    cells, _ = RT.cell_copies(_frame(spark, x), 0.6, id_col="vec_id")
    n, copies = cells.agg(F.count_if("is_home"), F.count("*")).first()
    assert n == 1500 and copies <= (RT.FEW_VISITS + 1) * n


def test_copies_leave_a_task_in_slices(monkeypatch):
    monkeypatch.setattr(RT, "SLICE_BYTES", 8 * 4 * 100)  # 100 rows of 4 numbers
    x = np.random.default_rng(3).normal(size=(1000, 4))
    tree = RT.pivot_tree(RT._matrix(pa.array(list(x))), 25)
    held = type("Held", (), {"value": tree})
    own = np.full(1000, len(tree[1]), np.int32)
    wide = [(np.zeros(len(c)), np.full(len(c), 2.0)) for c in tree[:2]]
    batch = pa.RecordBatch.from_arrays([pa.array(np.arange(1000)), pa.array(own), pa.array(own), pa.array(list(x))], ["id", "top", "cell", "vec"])
    from pyspark.sql import types as T
    schema = T._parse_datatype_string("id long, cell int, is_home boolean, vec array<double>")
    out = list(RT._visits(held, wide, 1.4, schema)([batch]))
    assert max(map(len, out)) <= 100 and sum(map(len, out)) > 10_000
    assert sum(b.column(2).to_numpy(zero_copy_only=False).sum() for b in out) == 1000


def test_close_rows_come_out_in_small_batches():
    x = np.ones((400, 8)) + 0.001 * np.random.default_rng(4).normal(size=(400, 8))
    rows = lambda side: pa.RecordBatch.from_pydict({"id": np.arange(400), "side": np.full(400, side), "is_home": [True] * 400, "vec": list(x)})
    RT_TILE, RT.TILE = RT.TILE, 64
    try:
        out = list(RT._pairs(0.1)(iter([rows(0), rows(1)])))
    finally:
        RT.TILE = RT_TILE
    assert sum(map(len, out)) == 400 * 399 // 2 and max(map(len, out)) <= 512
