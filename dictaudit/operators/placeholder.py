"""Placeholder discovery (M3 = J3 + J4 + A9 + J5 + T1 + W1, coverage J9 + A21, sampling T6).

The seed set is small by definition (at most ``MAX_SEEDS`` texts, checked), so its vectors are
gathered into a single array row and broadcast; every other text is scored in one pass with
``array_max(transform(seeds, cos))`` — no shuffle of the large side. The top-k is a
``TakeOrderedAndProject`` (each task keeps k rows), and ranks are numbered over those k rows only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import fixed_values as fv
from ..functions import vector as V
from .util import attach_row

MAX_SEEDS = 1000


def sample_seeds(placeholders: DataFrame, n: int, seed: int) -> DataFrame:
    """A repeatable sample of ``n`` placeholder texts: order by ``md5(text || ':' || seed)``."""
    key = F.md5(F.concat(F.col("text"), F.lit(f":{seed}")))
    return placeholders.select("text").orderBy(key, "text").limit(n)


def closest_to_seeds(text_vectors: DataFrame, seeds: DataFrame, k: int = fv.TOP_K_PLACEHOLDER) -> DataFrame:
    """Top-``k`` texts by their best cosine similarity to any seed vector, seeds themselves excluded.

    ``text_vectors``: ``(text, embedding)``; ``seeds``: ``(text)``. Seeds without a vector still
    exclude their text (J5); with no seed vector at all the result is empty (J3).
    Output: ``rank long, similarity_score double, definition string``.
    """
    n_seeds = seeds.count()
    if n_seeds > MAX_SEEDS:
        raise ValueError(f"{n_seeds} seeds > {MAX_SEEDS}: the seed vectors are broadcast as one row")
    seed_vecs = (seeds.select("text").distinct().join(text_vectors, "text")
                 .agg(F.collect_list("embedding").alias("seed_vecs"), F.count(F.lit(1)).alias("_n")))
    seed_vecs = F.broadcast(seed_vecs.filter(F.col("_n") > 0).drop("_n"))
    others = text_vectors.join(F.broadcast(seeds.select("text").distinct()), "text", "left_anti")
    score = F.array_max(F.transform("seed_vecs", lambda s: V.cosine_similarity("embedding", s)))
    scored = attach_row(others, seed_vecs).select(F.col("text").alias("definition"), score.alias("similarity_score"))
    top = scored.orderBy(F.desc("similarity_score"), "definition").limit(k)
    w = Window.orderBy(F.desc("similarity_score"), "definition")
    return top.select(F.row_number().over(w).cast("long").alias("rank"), "similarity_score", "definition")


def placeholder_coverage(top: DataFrame, seeds: DataFrame, placeholders: DataFrame) -> DataFrame:
    """Each placeholder not used as a seed, with its rank and score in the top list, or not found."""
    unused = placeholders.select("text").distinct().join(seeds.select("text"), "text", "left_anti")
    return (unused.join(top.withColumnRenamed("definition", "text"), "text", "left")
            .select(F.col("text").alias("placeholder"), "rank", "similarity_score",
                    F.col("rank").isNotNull().alias("found")))


def coverage_totals(coverage: DataFrame) -> DataFrame:
    """Found / not found counts and the missing placeholders (sorted)."""
    return coverage.agg(F.count_if("found").alias("n_found"), F.count_if(~F.col("found")).alias("n_not_found"),
                        F.array_join(F.array_sort(F.collect_list(F.when(~F.col("found"), F.col("placeholder")))),
                                     " | ").alias("missing"))
