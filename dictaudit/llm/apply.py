"""Apply vectorised slice functions to DataFrames in Arrow batches."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .textscan import text_slices


def ship(spark, value):
    """Broadcast of a value whose classes need not be importable on the executors; see shipped()."""
    return spark.sparkContext.broadcast(cloudpickle.dumps(value))


def shipped(held):
    return pickle.loads(held.value)


def fresh(df: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of df has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def id_text(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The two columns an operator works on; all others (also clashing names) stay out of it."""
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def per_text(df: DataFrame, fields: str, make: Callable[[], Callable], id_col: str = "doc_id",
             text_col: str = "text") -> DataFrame:
    """One output row per input row: the id and the columns (DDL ``fields``) that the slice
    function computes. ``make()`` runs once per task and returns
    ``f(data, offsets, texts) -> list of columns``.
    """
    base = id_text(df, id_col, text_col)
    schema = T.StructType([T.StructField("doc_id", T.LongType())] + T._parse_datatype_string(fields).fields)
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = make()
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            for a, b, data, offsets in text_slices(texts):
                cols = f(data, offsets, texts.slice(a, b - a))
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(a, b - a)] + [pa.array(c, type=t.type) if not isinstance(c, pa.Array) else c
                                             for c, t in zip(cols, list(arrow)[1:], strict=True)], schema=arrow)

    return base.mapInArrow(run, schema)


def per_text_rows(df: DataFrame, schema: str, make: Callable[[], Callable], id_col: str = "doc_id",
                  text_col: str = "text") -> DataFrame:
    """Any number of output rows: the slice function gets ``(ids, data, offsets, texts)`` and
    returns the list of output columns."""
    base = id_text(df, id_col, text_col)
    arrow = to_arrow_schema(T._parse_datatype_string(schema))

    def run(batches):
        f = make()
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            for a, b, data, offsets in text_slices(texts):
                cols = f(ids.slice(a, b - a), data, offsets, texts.slice(a, b - a))
                if len(cols[0]):
                    yield pa.RecordBatch.from_arrays(
                        [c if isinstance(c, pa.Array) else pa.array(c, type=t.type)
                         for c, t in zip(cols, arrow, strict=True)], schema=arrow)

    return base.mapInArrow(run, T._parse_datatype_string(schema))
