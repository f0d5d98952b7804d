"""Readers for the parquet tables and the fixture mappings onto the dictionary data model.

Only the columns an operator needs are selected, so the scan's ``ReadSchema`` stays narrow (the
``documents.text`` column dominates the bytes; it is read only where a query uses it).
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
          "embeddings", "pages", "benchmark", "labels", "conversations")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def entries_from_documents(spark: SparkSession, sf_dir: str, with_lang: bool = False) -> DataFrame:
    """Dictionary entries from ``documents``: id = doc_id as text, name = source, definition = text.

    ``seq`` carries the source order (doc_id), which decides "first occurrence" semantics.
    """
    cols = [F.col("doc_id").cast("string").alias("id"), F.col("source").alias("preferred_name"),
            F.col("text").alias("definition"), F.col("doc_id").alias("seq")]
    if with_lang:
        cols.append(F.col("lang"))
    return table(spark, sf_dir, "documents").select(*cols)


def entries_from_part(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries for pair dedup: id = p_partkey as text, name = p_name, definition = p_type."""
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").cast("string").alias("id"), F.col("p_name").alias("preferred_name"),
        F.col("p_type").alias("definition"), F.col("p_partkey").alias("seq"))


def entries_from_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries with repeated ids: id = user_id, name = event_type, definition = props.

    ``segment`` is the day of month of ``ts`` (the events span one month), ``seq`` the event id, so
    the same id appears in many segments and several times within one.
    """
    return table(spark, sf_dir, "events").select(
        F.col("user_id").cast("string").alias("id"), F.col("event_type").alias("preferred_name"),
        F.col("props").alias("definition"), F.dayofmonth("ts").alias("segment"), F.col("event_id").alias("seq"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vector table: ``(vec_id long, embedding array<float>, label int)``."""
    return table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")


def text_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The embedding map keyed by text (S5): one vector per distinct document text.

    A document has a vector when ``vec_id = doc_id``. Repeated texts take the vector of their
    smallest doc_id, so the map is a function of the text, as a text-keyed map must be.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    vecs = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    return (docs.join(vecs, "doc_id")
            .groupBy("text")
            .agg(F.min_by("embedding", "doc_id").alias("embedding"), F.min("doc_id").alias("vec_key")))


def clean_entries(entries: DataFrame, column: str = "definition") -> DataFrame:
    """S4 + P1 + P5: strip the text column and keep rows with an ASCII letter (null dropped)."""
    return entries.withColumn(column, T.ustrip(column)).filter(T.has_ascii_letter(column))
