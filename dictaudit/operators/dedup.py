"""Deduplication and first-occurrence operators.

All of them are hash aggregates with map-side partial aggregation: a hot key (one definition used by
a third of all rows) is pre-combined inside every map task, so the shuffle carries one partial row
per key per task, never the group itself. Collected lists appear only where the output *is* the
list (duplicate reports); those lists are built from the partial aggregates as well.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from .util import attach_row


def exact_duplicates(entries: DataFrame) -> DataFrame:
    """Definitions used by more than one row.

    ``all_preferred_names`` = distinct ``"name (id)"`` strings, sorted, joined by ``" | "``;
    ``count`` = number of rows (not of distinct names). Ordered by count desc, then definition.
    """
    ref = T.ref_string("preferred_name", "id")
    return (entries.select("definition", ref.alias("ref"))
            .groupBy("definition")
            .agg(F.array_join(F.array_sort(F.collect_set("ref")), " | ").alias("all_preferred_names"),
                 F.count(F.lit(1)).alias("count"))
            .filter(F.col("count") > 1)
            .orderBy(F.desc("count"), "definition"))


def exact_duplicate_refs(entries: DataFrame) -> DataFrame:
    """A7 in long form: one row per (definition, distinct ``"name (id)"``) of every definition used
    by more than one row, with the definition's row count.

    The reference-format report joins all names of a definition into one string; for a definition
    shared by a third of a very large dictionary that single value outgrows any row. Here nothing is
    collected: row counts per definition are a partial aggregate, the distinct references a
    distinct over (definition, ref), and the two meet in an equi-join (AQE splits a skewed key).
    """
    ref = T.ref_string("preferred_name", "id")
    counts = entries.groupBy("definition").agg(F.count(F.lit(1)).alias("count")).filter(F.col("count") > 1)
    refs = entries.select("definition", ref.alias("ref")).distinct()
    return refs.join(counts, "definition").select("definition", "ref", "count")


def first_per_definition(entries: DataFrame) -> DataFrame:
    """The first row (smallest ``seq``) per definition with its ``"name (id)"`` string.

    Output: ``definition, id, preferred_name, ref, seq``.
    """
    first = F.min_by(F.struct("id", "preferred_name", "seq"), "seq")
    return (entries.groupBy("definition").agg(first.alias("f"))
            .select("definition", "f.id", "f.preferred_name", "f.seq",
                    T.ref_string("f.preferred_name", "f.id").alias("ref")))


def dedup_pairs(entries: DataFrame) -> DataFrame:
    """A4: one row per (name, definition), nulls equal, keeping the smallest id in string order."""
    return (entries.groupBy("preferred_name", "definition")
            .agg(F.min("id").alias("id"))
            .select("id", "preferred_name", "definition"))


def dedup_pair_report(entries: DataFrame) -> DataFrame:
    """A5: per duplicated (name, definition): kept id, removed ids (sorted, comma-joined), count."""
    return (entries.groupBy("preferred_name", "definition")
            .agg(F.min("id").alias("kept_id"), F.count(F.lit(1)).alias("n_rows"),
                 F.array_sort(F.collect_list("id")).alias("ids"))
            .filter(F.col("n_rows") > 1)
            .select("preferred_name", "definition", "kept_id",
                    F.array_join(F.array_remove(F.col("ids"), F.col("kept_id")), ",").alias("removed_ids"),
                    (F.col("n_rows") - 1).alias("n_removed")))


def dedup_totals(entries: DataFrame) -> DataFrame:
    """A5 totals: rows before, after, removed (one row)."""
    kept = dedup_pairs(entries).agg(F.count(F.lit(1)).alias("n_after"))
    before = entries.agg(F.count(F.lit(1)).alias("n_before"))
    return attach_row(before, kept).select("n_before", "n_after", (F.col("n_before") - F.col("n_after")).alias("n_removed"))


def first_in_segment(entries: DataFrame) -> DataFrame:
    """A1: the first record per (segment, id) by ``seq``, with the number of later duplicates.

    A group-by with ``min_by`` (partial aggregation), not a ``row_number`` window: a window would
    sort all records of a hot (segment, id) inside one task.
    """
    first = F.min_by(F.struct("preferred_name", "definition", "seq"), "seq")
    return (entries.groupBy("segment", "id")
            .agg(first.alias("p"), (F.count(F.lit(1)) - 1).alias("n_duplicates"))
            .select("id", "p.preferred_name", "p.definition", "segment", "p.seq", "n_duplicates"))


def first_by_key(entries: DataFrame) -> DataFrame:
    """A2: the primary record per id over all segments, in (segment, seq) order, and record count.

    ``min_by`` over a struct key is a partial aggregate: a hot id costs one row per map task.
    """
    first = F.min_by(F.struct("preferred_name", "definition", "segment", "seq"), F.struct("segment", "seq"))
    return (entries.groupBy("id")
            .agg(first.alias("p"), F.count(F.lit(1)).alias("n_records"))
            .select("id", "p.preferred_name", "p.definition", "p.segment", "p.seq", "n_records"))


def id_conflicts(entries: DataFrame) -> DataFrame:
    """A3: per repeated id, the number of duplicates and whether all equal the primary.

    ``all_identical`` compares (name, definition) with nulls equal: the smallest and the largest
    content struct of the id are equal. Both are fixed-size partial aggregates, so an id holding a
    third of all rows never gathers its records in one place.
    """
    content = F.struct("preferred_name", "definition")
    return (entries.groupBy("id")
            .agg((F.count(F.lit(1)) - 1).alias("n_duplicates"),
                 F.min(content).alias("_lo"), F.max(content).alias("_hi"))
            .filter(F.col("n_duplicates") > 0)
            .select("id", "n_duplicates", F.col("_lo").eqNullSafe(F.col("_hi")).alias("all_identical")))


def id_conflict_totals(conflicts: DataFrame) -> DataFrame:
    """A3 totals: ids affected, duplicate occurrences, ids whose duplicates are all identical."""
    return conflicts.agg(F.count(F.lit(1)).alias("ids_affected"),
                         F.coalesce(F.sum("n_duplicates"), F.lit(0)).alias("duplicate_occurrences"),
                         F.count_if("all_identical").alias("ids_all_identical"))


def distinct_texts(entries: DataFrame, column: str = "definition") -> DataFrame:
    """A6 with P5 and P6: distinct non-null texts holding an ASCII letter (the texts to embed)."""
    return (entries.select(F.col(column).alias("text"))
            .na.drop(subset=["text"]).filter(T.has_ascii_letter("text")).distinct())
