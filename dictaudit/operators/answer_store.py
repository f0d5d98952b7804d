"""A durable store of model answers, keyed by prompt.

The store is a folder of Parquet batches in shared storage:

* ``answers/batch=<id>``: ``pkey, model, response, error, attempt``. Task output moves into place when the task
  commits (commit algorithm 2), so what a partition has answered stays when another partition, an executor or
  the driver is lost. A task that ran twice may leave a prompt twice; ``latest`` takes one row a prompt.
* ``commits``: the manifest, a row for each batch that was asked to its end.

``complete`` asks only what the store does not know (``left_anti`` on the prompt key): prompts without an
answer and with fewer than ``max_attempts`` failed attempts. Prompts go out in batches by their hash. Before
anything else a few prompts of each model are tried; a model of which every trial fails is left out of this
run, so it costs a bounded number of calls, and later runs try it again.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import materialize
from ..sources.dictionary import path_exists

ANSWERS = "pkey string, model string, response string, error string, attempt int"
COMMITS = "batch string, asked long, answered long, failed long"
SKIPPED = "model left out: all trial prompts failed"


class AnswerStore:
    def __init__(self, spark: SparkSession, path: str, batch_rows: int = 50_000, max_attempts: int = 3, trials: int = 4):
        self.spark, self.path = spark, path
        self.batch_rows, self.max_attempts, self.trials = batch_rows, max_attempts, trials

    def _read(self, name: str, schema: str) -> DataFrame:
        path = f"{self.path}/{name}"
        if not path_exists(self.spark, path):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(path)

    def latest(self) -> DataFrame:
        """One row a prompt: (pkey, response, error, attempts); an answer wins over failures, then the earliest."""
        rows = self._read("answers", ANSWERS).groupBy("pkey").agg(
            F.min(F.struct(F.col("response").isNull().alias("failed"), "attempt", "response", "error")).alias("best"), F.max("attempt").alias("attempts"))
        return rows.select("pkey", "best.response", F.when(F.col("best.failed"), F.col("best.error")).alias("error"), "attempts")

    def commits(self) -> DataFrame:
        return self._read("commits", COMMITS)

    def missing(self, requests: DataFrame) -> DataFrame:
        """The distinct prompts to ask, with the number of the next attempt."""
        model = F.col("model") if "model" in requests.columns else F.lit("")
        wanted = requests.select("pkey", "system", "user", F.coalesce(model, F.lit("")).alias("model")).dropDuplicates(["pkey"])
        known = self.latest()
        settled = known.where(F.col("response").isNotNull() | (F.col("attempts") >= self.max_attempts)).select("pkey")
        tried = known.where(F.col("response").isNull()).select("pkey", "attempts")
        return (wanted.join(settled, "pkey", "left_anti").join(tried, "pkey", "left")
                .withColumn("attempt", (F.coalesce("attempts", F.lit(0)) + 1).cast("int")).drop("attempts"))

    def _ask(self, prompts: DataFrame, backend) -> DataFrame:
        """Asks the prompts, keeps their answers and commits the batch; returns its rows."""
        batch = uuid.uuid4().hex
        # the written table is the only use of the plan: nothing is asked a second time
        plan = backend.plan(prompts) if hasattr(backend, "plan") else backend.complete(prompts)
        rows = plan.join(prompts.select("pkey", "model", "attempt"), "pkey").select("pkey", "model", "response", "error", "attempt")
        path = f"{self.path}/answers/batch={batch}"
        rows.write.option("mapreduce.fileoutputcommitter.algorithm.version", "2").parquet(path)
        done = self.spark.read.schema(ANSWERS).parquet(path)
        figures = done.agg(F.count("*").alias("asked"), F.count("response").alias("answered"), F.count_if(F.col("response").isNull()).alias("failed"))
        figures.select(F.lit(batch).alias("batch"), "asked", "answered", "failed").coalesce(1).write.mode("append").parquet(f"{self.path}/commits")
        return done

    def complete(self, requests: DataFrame, backend) -> DataFrame:
        """(pkey, response, error) of every distinct prompt of the requests, asking what is missing."""
        todo = materialize(self.missing(requests), "answer-requests")
        trial = F.row_number().over(Window.partitionBy("model", "share").orderBy("pkey"))
        # a trial is taken from some shares of a model, so that no task orders all prompts of one
        first = materialize(todo.withColumn("share", F.pmod(F.xxhash64("pkey"), F.lit(64))).withColumn("trial", trial).where("trial = 1")
                            .withColumn("trial", F.row_number().over(Window.partitionBy("model").orderBy("share"))).where(F.col("trial") <= self.trials)
                            .drop("share", "trial"), "answer-trials")
        bad = []
        if not first.isEmpty():
            tried = self._ask(first, backend)
            bad = [r.model for r in tried.groupBy("model").agg(F.count("response").alias("n")).where("n = 0").collect()]  # a row a model
        rest = materialize(todo.join(first.select("pkey"), "pkey", "left_anti").where(~F.col("model").isin(bad)), "answer-requests")
        batches = -(-rest.count() // self.batch_rows)
        for b in range(batches):
            part = rest if batches == 1 else rest.where(F.pmod(F.xxhash64("pkey"), F.lit(batches)) == b)
            self._ask(part, backend)
        left = F.when(F.col("model").isin(bad), F.lit(SKIPPED))
        return (requests.select("pkey", *([F.coalesce("model", F.lit("")).alias("model")] if "model" in requests.columns else [F.lit("").alias("model")]))
                .dropDuplicates(["pkey"]).join(self.latest(), "pkey", "left").select("pkey", "response", F.coalesce("error", F.when(F.col("response").isNull(), left)).alias("error")))


class StoredBackend:
    """A backend for the audit that asks through a store: a restarted audit asks nothing twice."""

    expression_based = False

    def __init__(self, store: AnswerStore, backend):
        self.store, self.backend = store, backend

    def complete(self, requests: DataFrame) -> DataFrame:
        return materialize(self.store.complete(requests, self.backend), "llm-answers")
