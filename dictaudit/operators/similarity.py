"""Name–definition misfit (M2 = J1 + P12 + T3), distribution summaries (A11–A14) and threshold
calibration (A15).
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import fixed_values as fv
from ..functions import text as T
from ..functions import vector as V
from .util import attach_row


def misfit_scores(entries: DataFrame, name_vectors: DataFrame, definition_vectors: DataFrame) -> DataFrame:
    """M2: cosine similarity between each entry's name vector and definition vector.

    ``name_vectors``/``definition_vectors`` are text-keyed maps ``(text, embedding)``. Inner joins:
    an entry whose name or definition has no vector is skipped (see :func:`misfit_skips`). Rows
    come in no order: a report sorts them (T3), a summary need not.
    """
    nv = name_vectors.select(F.col("text").alias("preferred_name"), F.col("embedding").alias("_nv"))
    dv = definition_vectors.select(F.col("text").alias("definition"), F.col("embedding").alias("_dv"))
    return (entries.select("id", "preferred_name", "definition")
            .join(nv, "preferred_name").join(dv, "definition")
            .select("id", "preferred_name", "definition",
                    V.cosine_similarity("_nv", "_dv").alias("cosine_similarity")))


def misfit_skips(entries: DataFrame, name_vectors: DataFrame, definition_vectors: DataFrame) -> DataFrame:
    """J1 skip count: entries lacking a name vector, else lacking a definition vector (name checked first)."""
    nv = name_vectors.select(F.col("text").alias("preferred_name"), F.lit(True).alias("_n"))
    dv = definition_vectors.select(F.col("text").alias("definition"), F.lit(True).alias("_d"))
    j = entries.join(nv, "preferred_name", "left").join(dv, "definition", "left")
    return j.agg(F.count(F.lit(1)).alias("n_entries"),
                 F.count_if(F.col("_n").isNull()).alias("skipped_no_name_vector"),
                 F.count_if(F.col("_n").isNotNull() & F.col("_d").isNull()).alias("skipped_no_definition_vector"))


def exact_quantiles(df: DataFrame, col: str, probs: list[float], bins: int = 4096) -> DataFrame:
    """Exact linear-interpolated quantiles (numpy's default) by refined histograms.

    A round counts the values of each open bracket in ``bins`` equal bins, with the least and largest value
    of each bin; partial sums leave every task, so a round shuffles a fixed number of rows however many
    values there are. The bin that holds a wanted rank becomes its next bracket; a bin with a single
    distinct value, repeated however often, is the answer. Brackets end at values that occur, so they
    shrink by at least the factor ``bins`` or across a gap.

    Returns one row per quantile: ``qi int, p double, value double`` (null for no values).
    """
    base = df.select(F.col(col).cast("double").alias("x")).na.drop()
    n, least, most = base.agg(F.count(F.lit(1)), F.min("x"), F.max("x")).first()
    at = [p * (n - 1) for p in probs]
    ranks = sorted({k for r in at for k in (math.floor(r), math.ceil(r))}) if n else []
    found: dict[int, float] = {}
    open_ = {k: (least, most, 0) for k in ranks}    # rank: least and largest value, number of values below
    while open_:
        brackets = sorted(set(open_.values()))
        hit = []
        for j, (lo, hi, _) in enumerate(brackets):
            # halves keep the width finite for values of any size
            share = (F.col("x") / 2 - F.lit(lo / 2)) / F.lit((hi / 2 - lo / 2) or 1.0)
            hit.append(F.when(F.col("x").between(lo, hi), F.struct(F.lit(j).alias("j"), F.least(F.lit(bins - 1), F.floor(share * bins)).alias("bin"))))
        rows = base.select("x", F.explode(F.array_compact(F.array(*hit))).alias("h")).groupBy("h.j", "h.bin").agg(
            F.count(F.lit(1)).alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi")).collect()   # at most bins rows a bracket
        bin_rows = [sorted((r for r in rows if r.j == j), key=lambda r: r.bin) for j in range(len(brackets))]
        for k, bracket in list(open_.items()):
            below = bracket[2]
            for r in bin_rows[brackets.index(bracket)]:
                if k < below + r.n:
                    break
                below += r.n
            if r.lo == r.hi:
                found[k] = r.lo
                del open_[k]
            else:
                open_[k] = (r.lo, r.hi, below)
    values = [found[math.floor(r)] + (r - math.floor(r)) * (found[math.ceil(r)] - found[math.floor(r)]) if n else None for r in at]
    return df.sparkSession.createDataFrame([(i, float(p), v) for i, (p, v) in enumerate(zip(probs, values))], "qi int, p double, value double")


def summary_stats(df: DataFrame, col: str) -> DataFrame:
    """Count, mean, median, population std, min, max, p25, p75 (one row).

    The scores are read once for the moments and once a round of the quantiles, so the single score
    column is written once and every pass reads that narrow table.
    """
    from ..session import materialize

    df = materialize(df.select(F.col(col).cast("double").alias(col)), "summary-input")
    x = F.col(col)
    moments = df.agg(F.count(x).alias("count"), F.avg(x).alias("mean"), F.stddev_pop(x).alias("std"),
                     F.min(x).alias("min"), F.max(x).alias("max"))
    q = exact_quantiles(df, col, [0.25, 0.5, 0.75])
    qrow = q.groupBy().agg(F.max(F.when(F.col("qi") == 0, F.col("value"))).alias("p25"),
                           F.max(F.when(F.col("qi") == 1, F.col("value"))).alias("median"),
                           F.max(F.when(F.col("qi") == 2, F.col("value"))).alias("p75"))
    return attach_row(moments, qrow).select("count", "mean", "median", "std", "min", "max", "p25", "p75")


def summary_by_class(scored: DataFrame, placeholders: list[str] | None = None) -> DataFrame:
    """Count, mean and population std of placeholder and regular rows; an empty class gives 0.0."""
    ph = T.is_placeholder("definition", placeholders)
    s = F.col("cosine_similarity")
    return scored.agg(
        F.count_if(ph).alias("n_placeholder"),
        F.coalesce(F.avg(F.when(ph, s)), F.lit(0.0)).alias("mean_placeholder"),
        F.coalesce(F.stddev_pop(F.when(ph, s)), F.lit(0.0)).alias("std_placeholder"),
        F.count_if(~ph).alias("n_regular"),
        F.coalesce(F.avg(F.when(~ph, s)), F.lit(0.0)).alias("mean_regular"),
        F.coalesce(F.stddev_pop(F.when(~ph, s)), F.lit(0.0)).alias("std_regular"))


def bin_labels() -> list[str]:
    e = fv.HISTOGRAM_EDGES
    return [f"{e[i]:.1f}-{e[i + 1]:.1f}" for i in range(len(e) - 1)]


def bin_index(c) -> "F.Column":
    """Bin of a value on the fixed edges, numpy semantics: [e_i, e_i+1), last bin closed;
    values outside [0, 1] (e.g. negative similarities) get null and drop out."""
    x = F.col(c) if isinstance(c, str) else c
    e = fv.HISTOGRAM_EDGES
    expr = F.lit(len(e) - 2)
    for i in range(len(e) - 2, 0, -1):
        expr = F.when(x < F.lit(e[i]), F.lit(i - 1)).otherwise(expr)
    return F.when((x >= F.lit(e[0])) & (x <= F.lit(e[-1])), expr)


def _bins(spark: SparkSession, first: int = 0) -> DataFrame:
    labels = F.array(*[F.lit(v) for v in bin_labels()])
    return spark.range(first, len(fv.HISTOGRAM_EDGES) - 1).select(
        F.col("id").alias("bin"), F.element_at(labels, (F.col("id") + 1).cast("int")).alias("bin_label"))


def histogram(scored: DataFrame, col: str = "cosine_similarity") -> DataFrame:
    """Ten fixed bins, zero-filled, ``bin long, bin_label string, n long``."""
    counts = (scored.select(bin_index(col).cast("long").alias("bin")).na.drop()
              .groupBy("bin").agg(F.count(F.lit(1)).alias("n")))
    return (_bins(scored.sparkSession).join(counts, "bin", "left")
            .select("bin", "bin_label", F.coalesce("n", F.lit(0)).cast("long").alias("n")))


def stacked_histogram(scored: DataFrame, placeholders: list[str] | None = None,
                      col: str = "cosine_similarity") -> DataFrame:
    """Placeholder vs regular counts per bin from the fourth bin (0.3) on, plus totals."""
    ph = T.is_placeholder("definition", placeholders)
    counts = (scored.select(bin_index(col).cast("long").alias("bin"), ph.alias("ph")).na.drop(subset=["bin"])
              .groupBy("bin").agg(F.count_if("ph").alias("n_placeholder"), F.count_if(~F.col("ph")).alias("n_regular")))
    out = _bins(scored.sparkSession, fv.STACKED_FIRST_BIN).join(counts, "bin", "left")
    return out.select("bin", "bin_label",
                      F.coalesce("n_placeholder", F.lit(0)).cast("long").alias("n_placeholder"),
                      F.coalesce("n_regular", F.lit(0)).cast("long").alias("n_regular"),
                      (F.coalesce("n_placeholder", F.lit(0)) + F.coalesce("n_regular", F.lit(0))).cast("long")
                      .alias("n_total"))


def calibration(pair_distances: DataFrame, kind_col: str = "kind") -> DataFrame:
    """Per kind of edit and overall: pairs, mean distance, max (strict threshold), max × 1.10."""
    g = pair_distances.rollup(kind_col).agg(F.count(F.lit(1)).alias("n_pairs"),
                                            F.avg("distance").alias("mean_distance"),
                                            F.max("distance").alias("strict_threshold"))
    return g.select(F.coalesce(F.col(kind_col).cast("string"), F.lit("all")).alias("kind"), "n_pairs",
                    "mean_distance", "strict_threshold",
                    (F.col("strict_threshold") * F.lit(fv.CALIBRATION_BUFFER)).alias("buffered_threshold"))
