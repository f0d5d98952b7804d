"""Exact vector radius self-join — all pairs with cosine distance ≤ r.

Two exact strategies, same output ``(id_a long, id_b long, distance double)`` with ``id_a < id_b``:

* ``blocks`` (default): hash every row into one of B blocks and send it to the B block pairs it takes
  part in (``explode`` over ``(least, greatest)``). Each group ``(bi, bj)`` holds at most two blocks
  (≈ 2·N/B rows, bounded by construction however skewed the data), and computes ``X @ Y.T`` with
  BLAS in Arrow batches. Shuffle = B·N rows; compute = N²/2 multiply-adds over B(B+1)/2 tasks. B is
  chosen from the row count so a block holds about ``block_rows`` vectors.
* ``naive``: a theta join with the native cosine expression; Spark plans it as a broadcast nested
  loop. Only allowed when the row count is under ``naive_max_rows`` (checked before broadcasting),
  used as the brute-force reference in tests.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vector as V
from ..session import materialize

PAIR_SCHEMA = "id_a long, id_b long, distance double"
DEFAULT_BLOCK_ROWS = 2048
NAIVE_MAX_ROWS = 20_000
_CHUNK = 1024


def choose_blocks(n_rows: int, block_rows: int = DEFAULT_BLOCK_ROWS) -> int:
    return max(1, math.ceil(n_rows / max(1, block_rows)))


def _unit_rows(vecs: pd.Series) -> np.ndarray:
    if len(vecs) == 0:
        return np.zeros((0, 0))
    x = np.stack([np.asarray(v, dtype=np.float64) for v in vecs.values])
    n = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, n, out=np.zeros_like(x), where=n > 0)


def _block_pair_kernel(radius: float):
    def kernel(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        bi, bj = int(key[0]), int(key[1])
        left = pdf[pdf["blk"] == bi]
        right = left if bi == bj else pdf[pdf["blk"] == bj]
        if len(left) == 0 or len(right) == 0:
            return pd.DataFrame({"id_a": [], "id_b": [], "distance": []})
        ids_l = left["id"].to_numpy(dtype=np.int64)
        ids_r = right["id"].to_numpy(dtype=np.int64)
        x = _unit_rows(left["vec"])
        y = _unit_rows(right["vec"])
        out_a, out_b, out_d = [], [], []
        for start in range(0, len(x), _CHUNK):
            xs = x[start:start + _CHUNK]
            d = 1.0 - np.clip(xs @ y.T, -1.0, 1.0)
            mask = d <= radius
            if bi == bj:
                mask &= ids_l[start:start + _CHUNK, None] < ids_r[None, :]
            li, ri = np.nonzero(mask)
            if len(li):
                a = ids_l[start + li]
                b = ids_r[ri]
                out_a.append(np.minimum(a, b))
                out_b.append(np.maximum(a, b))
                out_d.append(d[li, ri])
        if not out_a:
            return pd.DataFrame({"id_a": [], "id_b": [], "distance": []})
        return pd.DataFrame({"id_a": np.concatenate(out_a), "id_b": np.concatenate(out_b),
                             "distance": np.concatenate(out_d)})

    return kernel


def radius_join(df: DataFrame, radius: float, id_col: str = "id", vec_col: str = "embedding",
                method: str = "blocks", blocks: int | None = None, block_rows: int = DEFAULT_BLOCK_ROWS,
                naive_max_rows: int = NAIVE_MAX_ROWS, n_rows: int | None = None) -> DataFrame:
    """All pairs ``id_a < id_b`` whose cosine distance is at most ``radius`` (boundary included).

    The block count needs the row count. When neither ``blocks`` nor ``n_rows`` is given, the
    narrow ``(id, vector)`` input is first written with a reliable checkpoint, so counting it and
    joining it read the same materialised rows instead of running the upstream plan twice.
    """
    base = df.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("vec"))
    if method == "naive":
        n = base.count()
        if n > naive_max_rows:
            raise ValueError(f"naive radius join refused: {n} rows > {naive_max_rows}; use method='blocks'")
        a = base.select(F.col("id").alias("id_a"), F.col("vec").alias("va"))
        b = F.broadcast(base.select(F.col("id").alias("id_b"), F.col("vec").alias("vb")))
        dist = V.cosine_distance("va", "vb")
        return (a.join(b, F.col("id_a") < F.col("id_b"))
                .select("id_a", "id_b", dist.alias("distance"))
                .filter(F.col("distance") <= F.lit(radius)))
    if method != "blocks":
        raise ValueError(f"unknown radius join method {method!r}")
    if blocks is None:
        if n_rows is None:
            base = materialize(base, "radius-input")
            n_rows = base.count()
        blocks = choose_blocks(n_rows, block_rows)
    b = int(blocks)
    rep = (base.withColumn("blk", F.pmod(F.xxhash64("id"), F.lit(b)).cast("int"))
           .withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(b - 1))))
           .select(F.least("blk", "k").alias("bi"), F.greatest("blk", "k").alias("bj"), "blk", "id", "vec"))
    return rep.groupBy("bi", "bj").applyInPandas(_block_pair_kernel(float(radius)), PAIR_SCHEMA)


def pair_mean(pairs: DataFrame, a: str = "text_a", b: str = "text_b") -> DataFrame:
    """A10: canonical orientation (a < b) and the mean distance per pair (guards repeated pairs)."""
    lo, hi = F.least(a, b), F.greatest(a, b)
    return (pairs.select(lo.alias(a), hi.alias(b), "distance")
            .groupBy(a, b).agg(F.avg("distance").alias("distance")))


def threshold_fanout(pairs: DataFrame, thresholds: list[float]) -> DataFrame:
    """One radius join at max(thresholds), then keep ``distance ≤ t`` for every t.

    The threshold list is a small literal array exploded per pair: no join, no shuffle.
    """
    ts = F.array(*[F.lit(float(t)) for t in thresholds])
    return (pairs.withColumn("threshold", F.explode(ts))
            .filter(F.col("distance") <= F.col("threshold")))
