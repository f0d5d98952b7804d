"""Incremental (Structured Streaming) use of the row-wise operators.

The audited pipeline is batch-only; nothing in it needs event time, watermarks or state. What does
carry over to streams are the row-wise steps — cleaning (P1, P5), the chemical / structural /
placeholder flags (P10, P11, P15), the vector lookup as a stream–static join (J2) — and the
append-only sinks: embedding new texts (S8) and auditing new candidate pairs (L5) per micro-batch
with ``foreachBatch``, idempotently, so a replayed batch after a failure writes nothing twice.

Checkpoint locations live under the session's ``spark.checkpoint.dir`` (shared storage).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import audit as A
from ..session import scratch_path
from ..sources import sinks as SK

FILES_PER_TRIGGER = 256  # part files of a large table that one micro-batch reads


def entry_flags(entries: DataFrame, text_vectors: DataFrame) -> DataFrame:
    """Per entry: cleaned definition, validity, chemical / structural / placeholder flags, and
    whether the definition has a vector (stream–static left join; works on batch frames too)."""
    clean = entries.withColumn("definition", T.ustrip("definition"))
    tv = text_vectors.select(F.col("text").alias("definition"), F.lit(True).alias("_hit"))
    return (clean.join(tv, "definition", "left")
            .select("id", T.has_ascii_letter("definition").alias("is_valid"),
                    T.is_chemical("definition").alias("is_chemical"),
                    T.is_structural("definition").alias("is_structural"),
                    T.is_placeholder("definition").alias("is_placeholder"),
                    F.coalesce(F.col("_hit"), F.lit(False)).alias("has_vector")))


def run_available_now(stream: DataFrame, path: str, checkpoint: str, fmt: str = "parquet") -> None:
    """Process everything available, append to ``path``, and stop (exactly-once file sink)."""
    q = (stream.writeStream.format(fmt).option("path", path).option("checkpointLocation", checkpoint)
         .outputMode("append").trigger(availableNow=True).start())
    q.awaitTermination()


def audit_sink(results_path: str, backend, model: str | None = None):
    """``foreachBatch`` function: audit the batch's candidate pairs not yet in ``results_path``
    (anti-join on the content-hash pair id) and append them. Replays are no-ops."""

    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        todo = batch.withColumn("pair_id", A.pair_id_expr())
        if SK.path_exists(spark, results_path):
            todo = todo.join(spark.read.parquet(results_path).select("pair_id"), "pair_id", "left_anti")
        res = A.audit_candidates(todo.drop("pair_id"), backend, model=model, keep_pair_id=True)
        res.withColumn("batch_id", F.lit(batch_id)).write.mode("append").parquet(results_path)

    return run


def stream_table(spark: SparkSession, path: str, schema, max_files: int = 1, glob: str | None = None) -> DataFrame:
    """A file stream over a Parquet directory (one file per trigger by default); ``glob`` selects
    the files of one table when several share a directory."""
    r = spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files)
    if glob:
        r = r.option("pathGlobFilter", glob)
    return r.parquet(path)


def stream_entry_flags(spark: SparkSession, documents_path: str, text_vectors: DataFrame) -> DataFrame:
    """Stream the documents table through :func:`entry_flags` into a scratch table; return it."""
    schema = spark.read.parquet(documents_path).schema
    path = spark._jvm.org.apache.hadoop.fs.Path(documents_path)
    if path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path).isDirectory():
        table = stream_table(spark, documents_path, schema, max_files=FILES_PER_TRIGGER)
    else:  # a stream reads folders: the one file of its folder
        folder, name = documents_path.rsplit("/", 1)
        table = stream_table(spark, folder, schema, glob=name)
    docs = table.select(
        F.col("doc_id").cast("string").alias("id"), F.col("text").alias("definition"))
    out, ckpt = scratch_path(spark, "stream-flags"), scratch_path(spark, "stream-flags-ckpt")
    run_available_now(entry_flags(docs, text_vectors), out, ckpt)
    return spark.read.parquet(out)
