"""Queries of the stores: a durable answer store that is asked twice, runs that are repeated, and entries,
vectors and candidate pairs written to shared storage and read back. Answers are recorded ones: the turn
that follows a user's turn in ``conversations``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import fixed_values as fv
from ..functions import text as T
from ..operators import answer_store as ST
from ..operators import audit as A
from ..operators import radius as R
from ..operators import radius_tree as RT
from ..session import materialize, scratch_path
from ..sources import dictionary as DS
from ..sources import sinks as SK
from ..sources import tables as S
from . import sqlfrag as Q
from .registry import register

SYSTEM = "conversation"


def _prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(conv_id, turn, system, user, model, pkey, reply): user turns and the text that follows each."""
    turns = S.table(spark, sf_dir, "conversations")
    after = F.lead("text").over(Window.partitionBy("conv_id").orderBy("turn"))
    asked = turns.withColumn("reply", after).where("role = 'user'").select(
        "conv_id", "turn", F.lit(SYSTEM).alias("system"), F.col("text").alias("user"), F.lit("recorded").alias("model"), "reply")
    return asked.withColumn("pkey", A.prompt_key(F.col("system"), F.col("user"), F.col("model")))


def recorded_answers(prompts: DataFrame) -> DataFrame:
    """(pkey, response): a prompt that was asked several times has the reply of its first turn."""
    first = F.min(F.struct("conv_id", "turn", "reply"))
    return prompts.groupBy("pkey").agg(first.alias("f")).select("pkey", F.col("f.reply").alias("response"))


_PROMPTS_SQL = """
WITH p AS (SELECT *, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS reply FROM conversations),
q AS (SELECT conv_id, turn, text, arg_min(struct_pack(r := reply), struct_pack(c := conv_id, t := turn)) OVER (PARTITION BY text) AS f,
        bool_or(conv_id % 2 = 0) OVER (PARTITION BY text) AS early FROM p WHERE role = 'user')"""


@register("answer_store", "L1 J12 S10", _PROMPTS_SQL + """
SELECT conv_id, turn, f.r AS response, CASE WHEN f.r IS NULL THEN 'no recorded answer' END AS error,
  CASE WHEN early THEN 1 ELSE 2 END AS asked_in_run, CASE WHEN f.r IS NULL AND early THEN 2 ELSE 1 END AS attempts FROM q
""")
def answer_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half of the conversations are asked, then all: the second run asks what the first has not answered."""
    prompts = materialize(_prompts(spark, sf_dir), "prompts")
    store = ST.AnswerStore(spark, scratch_path(spark, "answer-store"), max_attempts=2, trials=64)
    backend = A.TableBackend(recorded_answers(prompts))
    store.complete(prompts.where("conv_id % 2 = 0"), backend)
    known = materialize(store.latest().select("pkey", F.lit(1).alias("run")), "answered")
    answered = store.complete(prompts, backend)
    attempts = store.latest().select("pkey", "attempts")
    return prompts.select("conv_id", "turn", "pkey").join(answered, "pkey").join(known, "pkey", "left").join(attempts, "pkey").select(
        "conv_id", "turn", "response", "error", F.coalesce("run", F.lit(2)).alias("asked_in_run"), "attempts")


@register("repeated_runs", "S10 U3 A18 S9 P21", f"""
SELECT replace(replace('m:' || role || '/1', ':', '_'), '/', '_') AS safe_model, {Q.extract_verdict('text')} AS verdict, count(*) AS count
FROM conversations GROUP BY ALL
""")
def repeated_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two runs, each written twice; the summary counts every row once."""
    rows = S.table(spark, sf_dir, "conversations").select(
        T.safe_model_name(F.concat(F.lit("m:"), "role", F.lit("/1"))).alias("safe_model"), T.extract_verdict("text").alias("verdict"),
        F.lit("success").alias("status"), (F.col("conv_id") % 2).alias("run"))
    path = scratch_path(spark, "runs")
    for run in (0, 1, 0, 1):
        SK.append_run(rows.where(F.col("run") == run).drop("run"), path, str(run), ["safe_model"])
    return SK.runs_summary(spark, path, ["safe_model"])


@register("stored_entries", "S7 S8 S5 P4 J2", f"""
SELECT CAST(d.doc_id AS VARCHAR) AS id, d.source AS preferred_name, d.text AS definition, len(v.embedding) AS dim
FROM documents d LEFT JOIN ({Q.text_vectors()}) v ON v.text = d.text
""")
def stored_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries and their vectors written, the vectors twice (the second time nothing is new), and read back."""
    entries = S.table(spark, sf_dir, "documents").select(
        F.col("doc_id").cast("string").alias("id"), F.col("source").alias("preferred_name"), F.col("text").alias("definition"),
        F.regexp_extract("source", r"(\d+)$", 1).cast("int").alias("segment"))
    path = scratch_path(spark, "stored")
    SK.write_entries(entries, f"{path}/entries")
    vectors = S.text_vectors(spark, sf_dir).select("text", "embedding")
    for _ in range(2):
        SK.store_embeddings(spark, vectors, f"{path}/vectors")
    stored = spark.read.parquet(f"{path}/entries/by_segment")
    have = DS.read_embedding_map(spark, f"{path}/vectors")
    return stored.join(have, stored.definition == have.text, "left").select("id", "preferred_name", "definition", F.size("embedding").alias("dim"))


@register("stored_pairs", "S6 U2 S9 A10", f"""
SELECT kind, preferred_name_a, preferred_name_b, round(avg(distance), 6) AS distance
FROM (SELECT CASE WHEN a.label % 2 = 0 THEN 'classes' ELSE 'properties' END AS kind, CAST(a.vec_id AS VARCHAR) AS preferred_name_a,
        CAST(b.vec_id AS VARCHAR) AS preferred_name_b, {Q.distance('a.embedding', 'b.embedding')} AS distance
      FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id) WHERE distance <= 0.6 GROUP BY ALL
""")
def stored_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidate pairs written as one CSV table a kind, each pair in both directions, read back by the
    candidate scan (a third kind has no table) and reduced to the mean of each pair."""
    vectors = S.vectors(spark, sf_dir)
    pairs = RT.radius_tree_join(vectors, 0.6, id_col="vec_id")
    kind = F.when(F.col("label") % 2 == 0, "classes").otherwise("properties")
    named = pairs.join(vectors.select(F.col("vec_id").alias("id_a"), kind.alias("kind")), "id_a")
    path = scratch_path(spark, "pairs")
    names = {k: f"{path}/{k}" for k in ("classes", "properties")}
    for k, where in names.items():
        half = materialize(named.where(F.col("kind") == k), "pairs")
        both = half.select("distance", F.col("id_a").alias("a"), F.col("id_b").alias("b")).union(half.select("distance", "id_b", "id_a"))
        SK.write_table(both.select("distance", F.col("a").alias("preferred_names_a"), F.col("a").alias("text_a"),
                                   F.col("b").alias("preferred_names_b"), F.col("b").alias("text_b")), where, fmt="csv")
    read = DS.read_candidate_pairs(spark, {**names, "absent": f"{path}/absent"})
    ids = read.select("kind", F.col("distance").cast("double").alias("distance"), F.col("text_a").cast("long").alias("text_a"), F.col("text_b").cast("long").alias("text_b"))
    found = None
    for k in names:
        mean = R.pair_mean(ids.where(F.col("kind") == k)).withColumn("kind", F.lit(k))
        found = mean if found is None else found.unionByName(mean)
    return found.select("kind", F.col("text_a").cast("string").alias("preferred_name_a"), F.col("text_b").cast("string").alias("preferred_name_b"),
                        F.round("distance", 6).alias("distance"))
