"""Registered streaming query: the documents table read as a file stream, flagged row by row with a
stream–static join to the vector map, written by an exactly-once file sink and read back."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

from .. import fixed_values as fv
from ..sources import tables as S
from ..streaming import incremental as INC
from . import sqlfrag as Q
from .registry import register


@register("stream_entry_flags", "P1 P5 P10 P11 P15 J2", f"""
WITH tv AS ({Q.text_vectors()}), d AS (SELECT CAST(doc_id AS VARCHAR) AS id, {Q.strip('text')} AS definition FROM documents)
SELECT id, {Q.has_letter('definition')} AS is_valid, {Q.is_chemical('definition')} AS is_chemical,
       {Q.in_list('definition', fv.STRUCTURAL_DEFINITIONS)} AS is_structural,
       {Q.in_list('definition', fv.CLASS_PLACEHOLDERS)} AS is_placeholder,
       definition IN (SELECT text FROM tv) AS has_vector
FROM d
""")
def stream_entry_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return INC.stream_entry_flags(spark, os.path.join(sf_dir, "documents.parquet"), S.text_vectors(spark, sf_dir))
