"""Small plan helpers shared by the operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def attach_row(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """Attach the columns of a frame that holds exactly one row (a global aggregate) to every row.

    The one-row side is broadcast, so this is a map-side projection, not a pair-producing join.
    Callers pass only ungrouped ``agg(...)`` results, which have one row by construction.
    """
    return df.join(F.broadcast(one_row), how="inner")
