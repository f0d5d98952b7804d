"""The registered queries: each maps the driver tables onto the dictionary data model and runs one
operator (or a composition) over the whole tables. Every query has a matching DuckDB SQL oracle
unless noted; column names and integer/double types agree between the two.

Fixture mapping (the tables hold no dictionary): ``documents`` → entries (id = doc_id as text,
name = source, definition = text); ``part`` → entries for pair dedup (p_partkey, p_name, p_type);
``events`` → entries with repeated ids (user_id, event_type, props; segment = day of month);
``embeddings`` → vectors, a document has one when ``vec_id = doc_id``; ``conversations`` → model
answers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import fixed_values as fv
from ..functions import text as T
from ..operators import dedup as D
from ..sources import tables as S
from . import sqlfrag as Q
from .registry import register
from ..operators.util import attach_row

# ------------------------------------------------------------------------------------------------
# Text cleaning and exact duplicates
# ------------------------------------------------------------------------------------------------


@register("exact_duplicates", "S4 P1 P5 P7 A7 T4", f"""
SELECT definition,
       array_to_string(list_sort(list_distinct(list({Q.ref('preferred_name', 'id')}))), ' | ') AS all_preferred_names,
       count(*) AS count
FROM ({Q.clean_entries()}) c
GROUP BY definition HAVING count(*) > 1
ORDER BY count DESC, definition
""")
def exact_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.exact_duplicates(S.clean_entries(S.entries_from_documents(spark, sf_dir)))


@register("exact_duplicate_refs", "P1 P5 P7 A7", f"""
WITH c AS ({Q.clean_entries()}),
n AS (SELECT definition, count(*) AS count FROM c GROUP BY definition HAVING count(*) > 1)
SELECT DISTINCT c.definition, {Q.ref('c.preferred_name', 'c.id')} AS ref, n.count
FROM c JOIN n ON n.definition = c.definition
""")
def exact_duplicate_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.exact_duplicate_refs(S.clean_entries(S.entries_from_documents(spark, sf_dir)))


@register("filter_lineage", "P5 P6 A6 A22 J2", f"""
WITH e AS ({Q.entries_documents()}),
     v AS ({Q.text_vectors()}),
     u AS (SELECT DISTINCT {Q.strip('definition')} AS text FROM e
           WHERE definition IS NOT NULL AND {Q.has_letter(Q.strip('definition'))})
SELECT (SELECT count(*) FROM e) AS n_rows,
       (SELECT count(*) FROM e WHERE definition IS NOT NULL) AS n_non_null,
       (SELECT count(*) FROM e WHERE definition IS NOT NULL AND {Q.has_letter(Q.strip('definition'))}) AS n_valid,
       (SELECT count(*) FROM u) AS n_distinct,
       (SELECT count(*) FROM u WHERE text IN (SELECT text FROM v)) AS n_with_vector,
       (SELECT count(*) FROM u WHERE text NOT IN (SELECT text FROM v)) AS n_missing_vector
""")
def filter_lineage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows surviving each step of the embedding preparation, in one aggregate pass."""
    e = S.entries_from_documents(spark, sf_dir).withColumn("definition", T.ustrip("definition"))
    counts = e.agg(F.count(F.lit(1)).alias("n_rows"),
                   F.count("definition").alias("n_non_null"),
                   F.count_if(T.has_ascii_letter("definition")).alias("n_valid"))
    uniq = D.distinct_texts(e)
    vecs = S.text_vectors(spark, sf_dir).select("text", F.lit(True).alias("_hit"))
    cov = (uniq.join(vecs, "text", "left")
           .agg(F.count(F.lit(1)).alias("n_distinct"),
                F.count("_hit").alias("n_with_vector"),
                F.count_if(F.col("_hit").isNull()).alias("n_missing_vector")))
    return attach_row(counts, cov)


# ------------------------------------------------------------------------------------------------
# Pair dedup, first-by-key, id conflicts
# ------------------------------------------------------------------------------------------------


@register("dedup_pairs", "A4", """
SELECT min(CAST(p_partkey AS VARCHAR)) AS id, p_name AS preferred_name, p_type AS definition
FROM part GROUP BY p_name, p_type
""")
def dedup_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.dedup_pairs(S.entries_from_part(spark, sf_dir))


@register("dedup_pair_report", "A5", """
SELECT p_name AS preferred_name, p_type AS definition, min(CAST(p_partkey AS VARCHAR)) AS kept_id,
       array_to_string(list_sort(list(CAST(p_partkey AS VARCHAR)))[2:], ',') AS removed_ids,
       count(*) - 1 AS n_removed
FROM part GROUP BY p_name, p_type HAVING count(*) > 1
""")
def dedup_pair_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.dedup_pair_report(S.entries_from_part(spark, sf_dir))


@register("dedup_totals", "A5", """
SELECT count(*) AS n_before, (SELECT count(*) FROM (SELECT DISTINCT p_name, p_type FROM part)) AS n_after,
       count(*) - (SELECT count(*) FROM (SELECT DISTINCT p_name, p_type FROM part)) AS n_removed
FROM part
""")
def dedup_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.dedup_totals(S.entries_from_part(spark, sf_dir))


_EVENTS_ENTRIES = ("SELECT CAST(user_id AS VARCHAR) AS id, event_type AS preferred_name, props AS definition, "
                   "CAST(day(ts) AS INTEGER) AS segment, event_id AS seq FROM events")


@register("first_by_key", "S2 U1 A2 W2", f"""
SELECT id, arg_min(preferred_name, (segment, seq)) AS preferred_name, arg_min(definition, (segment, seq)) AS definition,
       CAST(min(segment) AS INTEGER) AS segment, arg_min(seq, (segment, seq)) AS seq, count(*) AS n_records
FROM ({_EVENTS_ENTRIES}) GROUP BY id
""")
def first_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.first_by_key(S.entries_from_events(spark, sf_dir))


@register("first_in_segment", "A1 W2", f"""
SELECT id, preferred_name, definition, segment, seq, n_duplicates FROM (
  SELECT *, row_number() OVER (PARTITION BY segment, id ORDER BY seq) AS rn,
         count(*) OVER (PARTITION BY segment, id) - 1 AS n_duplicates
  FROM ({_EVENTS_ENTRIES})) WHERE rn = 1
""")
def first_in_segment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.first_in_segment(S.entries_from_events(spark, sf_dir)).select(
        "id", "preferred_name", "definition", "segment", "seq", F.col("n_duplicates").cast("long"))


@register("id_conflicts", "A3", f"""
SELECT id, count(*) - 1 AS n_duplicates,
       count(DISTINCT (preferred_name, definition)) = 1 AS all_identical
FROM ({_EVENTS_ENTRIES}) GROUP BY id HAVING count(*) > 1
""")
def id_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.id_conflicts(S.entries_from_events(spark, sf_dir))


@register("id_conflict_totals", "A3", f"""
WITH c AS (SELECT id, count(*) - 1 AS n_duplicates,
                  count(DISTINCT (preferred_name, definition)) = 1 AS all_identical
           FROM ({_EVENTS_ENTRIES}) GROUP BY id HAVING count(*) > 1)
SELECT count(*) AS ids_affected, CAST(coalesce(sum(n_duplicates), 0) AS BIGINT) AS duplicate_occurrences,
       count(*) FILTER (WHERE all_identical) AS ids_all_identical FROM c
""")
def id_conflict_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.id_conflict_totals(D.id_conflicts(S.entries_from_events(spark, sf_dir)))


# ------------------------------------------------------------------------------------------------
# Text predicates
# ------------------------------------------------------------------------------------------------


@register("chemical_filter", "P10", f"""
SELECT doc_id, {Q.is_chemical('text')} AS is_chemical FROM documents
""")
def chemical_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.table(spark, sf_dir, "documents").select("doc_id", T.is_chemical("text").alias("is_chemical"))


@register("structural_filter", "P11 P15 J10", f"""
SELECT doc_id, {Q.in_list('text', fv.STRUCTURAL_DEFINITIONS)} AS is_structural,
       {Q.in_list('text', fv.CLASS_PLACEHOLDERS)} AS is_placeholder,
       coalesce(text IN (SELECT text FROM benchmark), false) AS in_reference_list
FROM documents
""")
def structural_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P11/P15 by literal membership and J10 as a semi-join flag against a reference table."""
    docs = S.table(spark, sf_dir, "documents").select("doc_id", "text")
    ref = S.table(spark, sf_dir, "benchmark").select("text").distinct().withColumn("_hit", F.lit(True))
    return (docs.join(ref, "text", "left")
            .select("doc_id", T.is_structural("text").alias("is_structural"),
                    T.is_placeholder("text").alias("is_placeholder"),
                    F.coalesce(F.col("_hit"), F.lit(False)).alias("in_reference_list")))


@register("text_preview", "P8", """
SELECT doc_id, CASE WHEN length(text) > 50 THEN substr(text, 1, 50) || '...' ELSE text END AS preview
FROM documents
""")
def text_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.table(spark, sf_dir, "documents").select("doc_id", T.preview("text").alias("preview"))
