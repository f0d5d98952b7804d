"""The placeholder experiment for every seed count of the class mode ({1, 2, 3, 7, 10}) and of the property
mode ({1, 2, 3}): one sampled seed set per count, the top-100 nearest texts per run, with ``n_seeds``."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import fixed_values as fv
from ..operators import placeholder as PH
from ..session import materialize
from ..sources import tables as S
from . import sqlfrag as Q
from .registry import register
from .vector_queries import N_PLACEHOLDERS, SEED

N_PROPERTY_PLACEHOLDERS = len(fv.PROPERTY_PLACEHOLDERS)


def _runs_sql(counts: list[int], placeholders: int, kind: str, where: str) -> str:
    """The runs of one kind; its texts are those of the vectors that ``where`` names."""
    runs = " UNION ALL ".join(f"SELECT {n} AS n_seeds" for n in counts)
    return f"""
SELECT '{kind}' AS kind, * FROM (
WITH tv AS (SELECT text, embedding FROM ({Q.text_vectors()}) WHERE {where}),
ph AS (SELECT text FROM tv ORDER BY length(text), text LIMIT {placeholders}),
runs AS ({runs}),
ranked AS (SELECT r.n_seeds, ph.text, row_number() OVER (PARTITION BY r.n_seeds ORDER BY md5(ph.text || ':{SEED}'), ph.text) AS k
           FROM runs r, ph),
seeds AS (SELECT n_seeds, text FROM ranked WHERE k <= n_seeds),
sv AS (SELECT s.n_seeds, tv.embedding FROM seeds s JOIN tv USING (text)),
scored AS (SELECT sv.n_seeds, tv.text AS definition, max({Q.cosine('tv.embedding', 'sv.embedding')}) AS similarity_score
           FROM tv JOIN sv ON true
           WHERE tv.text NOT IN (SELECT text FROM seeds s2 WHERE s2.n_seeds = sv.n_seeds)
           GROUP BY sv.n_seeds, tv.text),
top AS (SELECT n_seeds, CAST(row_number() OVER (PARTITION BY n_seeds ORDER BY similarity_score DESC, definition) AS BIGINT) AS rank,
               similarity_score, definition FROM scored QUALIFY rank <= {fv.TOP_K_PLACEHOLDER})
SELECT CAST(n_seeds AS INTEGER) AS n_seeds, rank, round(similarity_score, 6) AS similarity_score, definition FROM top)"""


def _runs(tv: DataFrame, counts: list[int], placeholders: int) -> DataFrame:
    """The top list of each seed count, over the texts and vectors of one kind."""
    tv = materialize(tv.select("text", "embedding"), "text-vectors")
    ph = materialize(tv.select("text").orderBy(F.length("text"), "text").limit(placeholders), "placeholders")
    runs = []
    for n in counts:
        top = PH.closest_to_seeds(tv, PH.sample_seeds(ph, n, SEED))
        runs.append(top.select(F.lit(n).alias("n_seeds"), "rank", F.round("similarity_score", 6).alias("similarity_score"), "definition"))
    return reduce(DataFrame.unionByName, runs)


@register("placeholder_runs", "T6 J3 J4 J5 A9 T1 W1 M3", f"""
SELECT n_seeds, rank, similarity_score, definition FROM ({_runs_sql(fv.CLASS_SEED_COUNTS, N_PLACEHOLDERS, 'classes', 'true')})
""")
def placeholder_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _runs(S.text_vectors(spark, sf_dir), fv.CLASS_SEED_COUNTS, N_PLACEHOLDERS)


@register("placeholder_modes", "M3 U6 T6 J3 J4 J5 A9 T1 W1",
          _runs_sql(fv.CLASS_SEED_COUNTS, N_PLACEHOLDERS, "classes", "vec_key % 2 = 0") + " UNION ALL "
          + _runs_sql(fv.PROPERTY_SEED_COUNTS, N_PROPERTY_PLACEHOLDERS, "properties", "vec_key % 2 = 1"))
def placeholder_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both modes in one result: texts with an even first id stand for classes, the others for properties."""
    vectors = materialize(S.text_vectors(spark, sf_dir), "text-vectors")
    kinds = (("classes", 0, fv.CLASS_SEED_COUNTS, N_PLACEHOLDERS), ("properties", 1, fv.PROPERTY_SEED_COUNTS, N_PROPERTY_PLACEHOLDERS))
    return reduce(DataFrame.unionByName, [
        _runs(vectors.where(F.col("vec_key") % 2 == part), counts, n).withColumn("kind", F.lit(kind)) for kind, part, counts, n in kinds])
