"""Vector scalar functions as Spark column expressions.

Elements are widened to double before any arithmetic. ANSI mode makes ``0/0`` throw, so the cosine
uses ``try_divide``: a zero vector yields a null similarity (and distance 1.0, as the usual library
convention treats that similarity as 0).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def as_double(v) -> Column:
    return _col(v).cast("array<double>")


def dot(a, b) -> Column:
    prod = F.zip_with(as_double(a), as_double(b), lambda x, y: x * y)
    return F.aggregate(prod, F.lit(0.0).cast("double"), lambda acc, x: acc + x)


def norm(a) -> Column:
    return F.sqrt(F.aggregate(as_double(a), F.lit(0.0).cast("double"), lambda acc, x: acc + x * x))


def cosine_similarity(a, b) -> Column:
    """a·b / (‖a‖‖b‖), clamped to [-1, 1]; null when either norm is zero.

    The clamp removes rounding excursions such as 1.0000000000000002 for identical vectors, which
    would otherwise fall outside the closed [0, 1] histogram range.
    """
    sim = F.try_divide(dot(a, b), norm(a) * norm(b))
    return F.when(sim.isNotNull(), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), sim)))


def cosine_distance(a, b) -> Column:
    """1 − similarity clipped to [0, 2]; a zero vector gives 1.0."""
    sim = F.coalesce(cosine_similarity(a, b), F.lit(0.0))
    return F.greatest(F.lit(0.0), F.least(F.lit(2.0), F.lit(1.0) - sim))


def masked_distance(d, threshold: float) -> Column:
    """Distances above the threshold become 2.0 (dense form of the mask)."""
    d = _col(d)
    return F.when(d > F.lit(threshold), F.lit(2.0)).otherwise(d)


def l2_normalise(a) -> Column:
    """Unit-length copy of a vector (double elements); a zero vector stays zero."""
    n = norm(a)
    return F.transform(as_double(a), lambda x: F.coalesce(F.try_divide(x, n), F.lit(0.0)))
