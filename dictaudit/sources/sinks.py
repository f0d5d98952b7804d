"""Sinks (S7–S10): partitioned result tables, append with whole-table summary, incremental
embedding store. Parquet by default, CSV on request; an empty result still writes its schema."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialize
from .dictionary import path_exists


def write_table(df: DataFrame, path: str, partition_by: list[str] | None = None, fmt: str = "parquet",
                mode: str = "overwrite") -> str:
    """Write a result (``partitionBy`` e.g. ``segment``, ``threshold`` or ``model``)."""
    w = df.write.mode(mode).format(fmt)
    if fmt == "csv":
        w = w.option("header", True).option("escape", '"')
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.save(path)
    return path


def write_entries(entries: DataFrame, path: str, fmt: str = "parquet") -> None:
    """One table partitioned by segment plus the combined table (``segment=0`` role)."""
    write_table(entries, f"{path}/by_segment", ["segment"], fmt)
    write_table(entries.drop("segment"), f"{path}/combined", None, fmt)


def append_run(new_rows: DataFrame, path: str, run: str, keys: list[str], fmt: str = "parquet") -> None:
    """The rows of one run, in a folder of its own, so that a run that is repeated replaces its
    rows instead of adding them again. Its counts of successful rows by ``keys`` and verdict lie next to
    the table; they are written last and mark the run as complete."""
    write_table(new_rows, f"{path}/rows/run={run}", None, fmt)
    kept = new_rows.sparkSession.read.option("header", fmt == "csv").format(fmt).load(f"{path}/rows/run={run}")
    counts = kept.where(F.col("status") == "success").groupBy(*keys, "verdict").agg(F.count(F.lit(1)).alias("count"))
    write_table(counts, f"{path}/counts/run={run}")


def runs_summary(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """A18 over all runs, from their counts: old rows are not read again."""
    return spark.read.parquet(f"{path}/counts").groupBy(*keys, "verdict").agg(F.sum("count").alias("count"))


def append_and_summarise(spark: SparkSession, new_rows: DataFrame, path: str, keys: list[str],
                         fmt: str = "parquet", run: str | None = None) -> DataFrame:
    """S10 + A18: add the rows as a run and count successful rows of the whole table (old + new) by
    ``keys`` and verdict. ``run`` names the run; without it the call is a new one."""
    append_run(new_rows, path, run or uuid.uuid4().hex, keys, fmt)
    return runs_summary(spark, path, keys)


def store_embeddings(spark: SparkSession, vectors: DataFrame, path: str) -> DataFrame:
    """Add vectors for texts not yet stored (left-anti join on text), so a re-run embeds only
    what is missing. Returns the rows written, read back from shared storage, so that using them
    runs the model no second time."""
    if path_exists(spark, path):
        have = spark.read.parquet(path).select("text")
        vectors = vectors.join(have, "text", "left_anti")
    new = materialize(vectors, "new-vectors")
    write_table(new, path, None, "parquet", mode="append")
    return new


def texts_to_embed(spark: SparkSession, texts: DataFrame, path: str) -> DataFrame:
    """The distinct texts lacking a stored vector (anti-join against the store)."""
    if not path_exists(spark, path):
        return texts
    return texts.join(spark.read.parquet(path).select("text"), "text", "left_anti")


def write_per_model(results: DataFrame, path: str, fmt: str = "parquet") -> str:
    """S9 for the ablation: one partition per model, named with the safe model name."""
    from ..functions.text import safe_model_name

    return write_table(results.withColumn("safe_model", safe_model_name("model")), path, ["safe_model"], fmt)
