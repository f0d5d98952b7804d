"""Registered vector queries: misfit scores, distributions, placeholder discovery, radius join,
threshold fan-out, calibration and islands.

Scores are rounded to 6 digits at the output only; every threshold test uses the unrounded value.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import fixed_values as fv
from ..functions import text as T
from ..operators import components as C
from ..operators import dedup as D
from ..operators import pair_entries as PE
from ..operators import placeholder as PH
from ..operators import radius as R
from ..operators import radius_tree as RT
from ..operators import similarity as SIM
from ..session import materialize
from ..sources import tables as S
from . import sqlfrag as Q
from .registry import register

RADIUS = 0.60                       # fixture radius: the vectors' smallest distance is ~0.49 at sf0.01
FANOUT_THRESHOLDS = [0.50, 0.55, 0.60]
N_PLACEHOLDERS = 11                 # as many placeholder texts as the class list holds
N_SEEDS = 3
SEED = 1


def _r6(c):
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


# ------------------------------------------------------------------------------------------------
# Name vectors: the name "src<k>" maps to the vector with the smallest vec_id of label k.
# ------------------------------------------------------------------------------------------------


def name_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (S.vectors(spark, sf_dir).groupBy("label")
            .agg(F.min_by("embedding", "vec_id").alias("embedding"))
            .select(F.concat(F.lit("src"), F.col("label").cast("string")).alias("text"), "embedding"))


_NAME_VECTORS_SQL = ("SELECT 'src' || CAST(label AS VARCHAR) AS text, arg_min(embedding, vec_id) AS embedding "
                     "FROM embeddings GROUP BY label")

_MISFIT_SQL = f"""
SELECT CAST(d.doc_id AS VARCHAR) AS id, d.source AS preferred_name, d.text AS definition,
       {Q.cosine('nv.embedding', 'dv.embedding')} AS cosine_similarity
FROM documents d JOIN ({_NAME_VECTORS_SQL}) nv ON nv.text = d.source
                 JOIN ({Q.text_vectors()}) dv ON dv.text = d.text
"""


def _misfit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return SIM.misfit_scores(S.entries_from_documents(spark, sf_dir), name_vectors(spark, sf_dir),
                             S.text_vectors(spark, sf_dir))


@register("name_definition_misfit", "J1 P12 T3 M2", f"""
SELECT id, preferred_name, definition, round(cosine_similarity, 6) AS cosine_similarity
FROM ({_MISFIT_SQL}) ORDER BY cosine_similarity DESC, id
""")
def name_definition_misfit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _misfit(spark, sf_dir).orderBy(F.desc("cosine_similarity"), "id").withColumn("cosine_similarity", _r6("cosine_similarity"))


@register("misfit_skips", "J1", f"""
WITH j AS (SELECT d.source, d.text, nv.text IS NOT NULL AS has_n, dv.text IS NOT NULL AS has_d
           FROM documents d LEFT JOIN ({_NAME_VECTORS_SQL}) nv ON nv.text = d.source
                            LEFT JOIN ({Q.text_vectors()}) dv ON dv.text = d.text)
SELECT count(*) AS n_entries, count(*) FILTER (WHERE NOT has_n) AS skipped_no_name_vector,
       count(*) FILTER (WHERE has_n AND NOT has_d) AS skipped_no_definition_vector FROM j
""")
def misfit_skips(spark: SparkSession, sf_dir: str) -> DataFrame:
    return SIM.misfit_skips(S.entries_from_documents(spark, sf_dir), name_vectors(spark, sf_dir),
                            S.text_vectors(spark, sf_dir))


@register("similarity_summary", "A11", f"""
SELECT count(*) AS count, round(avg(s), 6) AS mean, round(quantile_cont(s, 0.5), 6) AS median,
       round(stddev_pop(s), 6) AS std, round(min(s), 6) AS min, round(max(s), 6) AS max,
       round(quantile_cont(s, 0.25), 6) AS p25, round(quantile_cont(s, 0.75), 6) AS p75
FROM (SELECT cosine_similarity AS s FROM ({_MISFIT_SQL}))
""")
def similarity_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = SIM.summary_stats(_misfit(spark, sf_dir), "cosine_similarity")
    return s.select("count", *[_r6(c).alias(c) for c in ("mean", "median", "std", "min", "max", "p25", "p75")])


_PH_LIST = ", ".join(Q.q(v) for v in fv.CLASS_PLACEHOLDERS)


@register("summary_by_class", "A12 P15", f"""
WITH m AS (SELECT definition, cosine_similarity AS s, coalesce(definition IN ({_PH_LIST}), false) AS ph
           FROM ({_MISFIT_SQL}))
SELECT count(*) FILTER (WHERE ph) AS n_placeholder,
       round(coalesce(avg(s) FILTER (WHERE ph), 0.0), 6) AS mean_placeholder,
       round(coalesce(stddev_pop(s) FILTER (WHERE ph), 0.0), 6) AS std_placeholder,
       count(*) FILTER (WHERE NOT ph) AS n_regular,
       round(coalesce(avg(s) FILTER (WHERE NOT ph), 0.0), 6) AS mean_regular,
       round(coalesce(stddev_pop(s) FILTER (WHERE NOT ph), 0.0), 6) AS std_regular
FROM m
""")
def summary_by_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = SIM.summary_by_class(_misfit(spark, sf_dir))
    return s.select(*[(_r6(c).alias(c) if c.startswith(("mean", "std")) else F.col(c)) for c in s.columns])


def _bin_sql(x: str) -> str:
    e = fv.HISTOGRAM_EDGES
    whens = " ".join(f"WHEN {x} < CAST({e[i]!r} AS DOUBLE) THEN {i - 1}" for i in range(1, len(e) - 1))
    return (f"CASE WHEN {x} >= CAST({e[0]!r} AS DOUBLE) AND {x} <= CAST({e[-1]!r} AS DOUBLE) THEN "
            f"CASE {whens} ELSE {len(e) - 2} END END")


_BINS_SQL = " UNION ALL ".join(f"SELECT CAST({i} AS BIGINT) AS bin, {Q.q(lbl)} AS bin_label"
                               for i, lbl in enumerate(SIM.bin_labels()))


@register("similarity_histogram", "A13", f"""
WITH c AS (SELECT CAST({_bin_sql('cosine_similarity')} AS BIGINT) AS bin, count(*) AS n
           FROM ({_MISFIT_SQL}) GROUP BY 1)
SELECT b.bin, b.bin_label, CAST(coalesce(c.n, 0) AS BIGINT) AS n FROM ({_BINS_SQL}) b LEFT JOIN c ON c.bin = b.bin
""")
def similarity_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return SIM.histogram(_misfit(spark, sf_dir))


@register("stacked_histogram", "A14 P15", f"""
WITH m AS (SELECT CAST({_bin_sql('cosine_similarity')} AS BIGINT) AS bin,
                  coalesce(definition IN ({_PH_LIST}), false) AS ph FROM ({_MISFIT_SQL})),
     c AS (SELECT bin, count(*) FILTER (WHERE ph) AS n_placeholder, count(*) FILTER (WHERE NOT ph) AS n_regular
           FROM m WHERE bin IS NOT NULL GROUP BY bin)
SELECT b.bin, b.bin_label, CAST(coalesce(n_placeholder, 0) AS BIGINT) AS n_placeholder,
       CAST(coalesce(n_regular, 0) AS BIGINT) AS n_regular,
       CAST(coalesce(n_placeholder, 0) + coalesce(n_regular, 0) AS BIGINT) AS n_total
FROM ({_BINS_SQL}) b LEFT JOIN c ON c.bin = b.bin WHERE b.bin >= {fv.STACKED_FIRST_BIN}
""")
def stacked_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return SIM.stacked_histogram(_misfit(spark, sf_dir))


# ------------------------------------------------------------------------------------------------
# Placeholder discovery. Fixture placeholders: the N_PLACEHOLDERS shortest texts of the
# embedding map (placeholders are the short texts); seeds: a repeatable sample of them.
# ------------------------------------------------------------------------------------------------


def _placeholders(tv: DataFrame) -> DataFrame:
    return tv.select("text").orderBy(F.length("text"), "text").limit(N_PLACEHOLDERS)


_PH_SQL = f"""
WITH tv AS ({Q.text_vectors()}),
ph AS (SELECT text FROM tv ORDER BY length(text), text LIMIT {N_PLACEHOLDERS}),
seeds AS (SELECT text FROM ph ORDER BY md5(text || ':{SEED}'), text LIMIT {N_SEEDS}),
sv AS (SELECT tv.embedding FROM tv JOIN seeds USING (text)),
scored AS (SELECT tv.text AS definition, max({Q.cosine('tv.embedding', 'sv.embedding')}) AS similarity_score
           FROM tv, sv WHERE tv.text NOT IN (SELECT text FROM seeds) GROUP BY tv.text),
top AS (SELECT CAST(row_number() OVER (ORDER BY similarity_score DESC, definition) AS BIGINT) AS rank,
               similarity_score, definition FROM scored QUALIFY rank <= {fv.TOP_K_PLACEHOLDER})
"""


def _top(spark: SparkSession, sf_dir: str):
    # The text-keyed map feeds the placeholder list, the seeds and the scoring: build it once.
    tv = materialize(S.text_vectors(spark, sf_dir).select("text", "embedding"), "text-vectors")
    ph = _placeholders(tv)
    seeds = PH.sample_seeds(ph, N_SEEDS, SEED)
    return ph, seeds, PH.closest_to_seeds(tv, seeds)


@register("placeholder_top100", "J3 J4 J5 A9 T1 W1 T6 M3", _PH_SQL + """
SELECT rank, round(similarity_score, 6) AS similarity_score, definition FROM top
""")
def placeholder_top100(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, _, top = _top(spark, sf_dir)
    return top.withColumn("similarity_score", _r6("similarity_score"))


@register("placeholder_coverage", "J9 U4 A21", _PH_SQL + """
SELECT ph.text AS placeholder, top.rank, round(top.similarity_score, 6) AS similarity_score,
       top.rank IS NOT NULL AS found
FROM ph LEFT JOIN top ON top.definition = ph.text WHERE ph.text NOT IN (SELECT text FROM seeds)
""")
def placeholder_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    ph, seeds, top = _top(spark, sf_dir)
    return PH.placeholder_coverage(top, seeds, ph).withColumn("similarity_score", _r6("similarity_score"))


# ------------------------------------------------------------------------------------------------
# Radius self-join over the vector table, and the full near-duplicate discovery (M4).
# ------------------------------------------------------------------------------------------------

_RADIUS_SQL = f"""
SELECT a.vec_id AS vec_id_a, b.vec_id AS vec_id_b, round({Q.distance('a.embedding', 'b.embedding')}, 6) AS distance
FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id
WHERE {Q.distance('a.embedding', 'b.embedding')} <= {RADIUS}
"""


def radius_pairs_df(spark: SparkSession, sf_dir: str, radius: float = RADIUS) -> DataFrame:
    return RT.radius_tree_join(S.vectors(spark, sf_dir), radius, id_col="vec_id")


@register("radius_pairs", "J6 P13", _RADIUS_SQL)
def radius_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = R.radius_join(S.vectors(spark, sf_dir), RADIUS, id_col="vec_id")
    return p.select(F.col("id_a").alias("vec_id_a"), F.col("id_b").alias("vec_id_b"), _r6("distance").alias("distance"))


@register("radius_pairs_naive", "J6 P12 P13", _RADIUS_SQL)
def radius_pairs_naive(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = radius_pairs_df(spark, sf_dir)  # no nested loop: tests compare that one with this
    return p.select(F.col("id_a").alias("vec_id_a"), F.col("id_b").alias("vec_id_b"), _r6("distance").alias("distance"))


def matched_entries(spark: SparkSession, sf_dir: str, prepare=None, texts: bool = True) -> DataFrame:
    """M4 up to J2: clean → first row per definition → vectors: (seq, ref, embedding, definition). ``prepare`` may drop
    definitions and add columns of a definition or its name, which are kept."""
    # A8 (first row per definition) and J2 (the text-keyed vector lookup) in ONE group-by over documents ⋈ vectors (on
    # doc_id): the vector of a definition is the one of the smallest doc_id whose raw text equals it, exactly what the
    # text-keyed map returns. Definitions are told apart by their SHA-256; their texts are shuffled once, from the row
    # that has the vector, or not at all.
    docs = S.entries_from_documents(spark, sf_dir).withColumnRenamed("definition", "raw")
    clean = S.clean_entries(docs.withColumn("definition", F.col("raw"))).select(
        "seq", T.ref_string("preferred_name", "id").alias("ref"), "definition", (F.col("raw") == F.col("definition")).alias("same"))
    rows = (prepare(clean) if prepare else clean).withColumn("key", F.unhex(F.sha2("definition", 256)))
    own = [c for c in rows.columns if c not in ("definition", "same", "key")]
    vecs = S.vectors(spark, sf_dir).select(F.col("vec_id").alias("seq"), "embedding")
    vec_seq = F.when(F.col("same") & F.col("embedding").isNotNull(), F.col("seq"))
    uniq = (rows.drop("definition").join(vecs, "seq", "left").groupBy("key")
            .agg(F.min_by(F.struct(*own), "seq").alias("f"), F.min_by("embedding", vec_seq).alias("embedding"), F.min(vec_seq).alias("vec_seq"))
            .filter(F.col("embedding").isNotNull()))
    if not texts:
        return uniq.select("f.*", "embedding")
    held = rows.where("same").groupBy(F.col("seq").alias("vec_seq"), "key").agg(F.first("definition").alias("definition"))
    return uniq.join(held, ["vec_seq", "key"]).select("f.*", "embedding", "definition")


def named_pairs(pairs: DataFrame, entries: DataFrame) -> DataFrame:
    """Pairs (id_a, id_b, distance) of ``entries`` (seq, ref, definition, …) as candidate pairs ``distance, preferred_names_a,
    text_a, preferred_names_b, text_b`` with text_a < text_b, and further entry columns as <column>_a and <column>_b.
    The texts meet the pairs by blocks of entries: no exchange holds a text a pair."""
    own = [c for c in entries.columns if c not in ("seq", "ref", "definition", "embedding")]
    j = PE.meet(pairs, entries.select(F.col("seq").alias("id"), F.col("ref").alias("preferred_names"), F.col("definition").alias("text"), *own))
    swap = F.col("text_a") > F.col("text_b")
    sides = [F.when(swap, F.col(f"{c}_{o}")).otherwise(F.col(f"{c}_{s}")).alias(f"{c}_{s}")
             for s, o in (("a", "b"), ("b", "a")) for c in ("preferred_names", "text", *own)]
    return j.select(*[c for c in pairs.columns if c not in ("id_a", "id_b")], *sides)


def candidate_pairs(spark: SparkSession, sf_dir: str, radius: float = RADIUS) -> DataFrame:
    """M4 up to J8: clean → first row per definition → vectors → radius join → names.

    Output: ``distance, preferred_names_a, text_a, preferred_names_b, text_b`` with text_a < text_b.
    """
    # Written once: the radius join, its block sizing and the name enrichment all read it.
    matched = materialize(matched_entries(spark, sf_dir), "matched")
    return named_pairs(RT.radius_tree_join(matched, radius, id_col="seq"), matched)


def candidate_pairs_sql(radius: float = RADIUS) -> str:
    return f"""
WITH c AS ({Q.clean_entries()}),
u AS (SELECT definition, arg_min({Q.ref('preferred_name', 'id')}, seq) AS ref, min(seq) AS seq FROM c GROUP BY definition),
m AS (SELECT u.definition, u.ref, u.seq, tv.embedding FROM u JOIN ({Q.text_vectors()}) tv ON tv.text = u.definition),
p AS (SELECT a.definition AS ta, a.ref AS ra, b.definition AS tb, b.ref AS rb,
             {Q.distance('a.embedding', 'b.embedding')} AS distance
      FROM m a JOIN m b ON a.seq < b.seq WHERE {Q.distance('a.embedding', 'b.embedding')} <= {radius}),
cand AS (SELECT distance,
       CASE WHEN ta > tb THEN rb ELSE ra END AS preferred_names_a, CASE WHEN ta > tb THEN tb ELSE ta END AS text_a,
       CASE WHEN ta > tb THEN ra ELSE rb END AS preferred_names_b, CASE WHEN ta > tb THEN ta ELSE tb END AS text_b
FROM p)"""


_THRESHOLDS_SQL = " UNION ALL ".join(f"SELECT CAST({t!r} AS DOUBLE) AS threshold" for t in FANOUT_THRESHOLDS)


@register("threshold_fanout", "S4 P3 P5 A7 A8 J2 J6 J8 U5 M4", candidate_pairs_sql() + f"""
SELECT t.threshold, round(distance, 6) AS distance, preferred_names_a, text_a, preferred_names_b, text_b
FROM cand JOIN ({_THRESHOLDS_SQL}) t ON cand.distance <= t.threshold
""")
def threshold_fanout(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = R.threshold_fanout(candidate_pairs(spark, sf_dir, max(FANOUT_THRESHOLDS)), FANOUT_THRESHOLDS)
    return out.select("threshold", _r6("distance").alias("distance"), "preferred_names_a", "text_a",
                      "preferred_names_b", "text_b")


@register("vector_join_coverage", "A8 J2", f"""
WITH c AS ({Q.clean_entries()}), u AS (SELECT DISTINCT definition FROM c)
SELECT count(*) AS n_unique, count(tv.text) AS n_matched, count(*) - count(tv.text) AS n_missing
FROM u LEFT JOIN ({Q.text_vectors()}) tv ON tv.text = u.definition
""")
def vector_join_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    uniq = D.first_per_definition(S.clean_entries(S.entries_from_documents(spark, sf_dir)))
    tv = S.text_vectors(spark, sf_dir).select(F.col("text").alias("definition"), F.lit(True).alias("_hit"))
    return (uniq.join(tv, "definition", "left")
            .agg(F.count(F.lit(1)).alias("n_unique"), F.count("_hit").alias("n_matched"),
                 F.count_if(F.col("_hit").isNull()).alias("n_missing")))


# ------------------------------------------------------------------------------------------------
# Calibration: synonym-like pairs = adjacent vec_ids that share a label; kind = the label.
# ------------------------------------------------------------------------------------------------


@register("calibration", "A15 P13", f"""
WITH p AS (SELECT a.label, {Q.distance('a.embedding', 'b.embedding')} AS distance
           FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1 AND b.label = a.label)
SELECT coalesce(CAST(label AS VARCHAR), 'all') AS kind, count(*) AS n_pairs, round(avg(distance), 6) AS mean_distance,
       round(max(distance), 6) AS strict_threshold, round(max(distance) * {fv.CALIBRATION_BUFFER}, 6) AS buffered_threshold
FROM p GROUP BY ROLLUP (label)
""")
def calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..functions import vector as V

    v = S.vectors(spark, sf_dir)
    a = v.select("vec_id", "label", F.col("embedding").alias("ea"))
    b = v.select((F.col("vec_id") - 1).alias("vec_id"), "label", F.col("embedding").alias("eb"))
    pairs = a.join(b, ["vec_id", "label"]).select(F.col("label").alias("kind"),
                                                 V.cosine_distance("ea", "eb").alias("distance"))
    out = SIM.calibration(pairs)
    return out.select("kind", "n_pairs", *[_r6(c).alias(c) for c in
                                           ("mean_distance", "strict_threshold", "buffered_threshold")])


# ------------------------------------------------------------------------------------------------
# Islands: connected components of the radius graph (edges with distance ≤ RADIUS).
# ------------------------------------------------------------------------------------------------


@register("islands", "J7 P14 A16", f"""
WITH RECURSIVE e AS (SELECT vec_id_a AS a, vec_id_b AS b FROM ({_RADIUS_SQL})
                     UNION SELECT vec_id_b, vec_id_a FROM ({_RADIUS_SQL})),
reach(src, dst) AS (SELECT DISTINCT a, a FROM e UNION SELECT r.src, e.b FROM reach r JOIN e ON r.dst = e.a),
lab AS (SELECT src AS node, min(dst) AS component FROM reach GROUP BY src)
SELECT component AS island_id, count(*) AS size,
       array_to_string(list_sort(list(node)), ',') AS members
FROM lab GROUP BY component
""")
def islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    comp = C.connected_components(radius_pairs_df(spark, sf_dir))
    return C.island_rollup(comp)


# ------------------------------------------------------------------------------------------------
# Masked density clustering (M5) per threshold, over the vector table.
# ------------------------------------------------------------------------------------------------

CLUSTER_THRESHOLDS = [0.55, 0.60]


def masked_clusters_sql(pairs: str, thresholds: list[float]) -> str:
    """M5 as recursive SQL over ``pairs`` (a, b, d): the components at every distance level, the clusters
    that are born where two components of two or more points meet, and their excess of mass as a fold.
    A statement of the method by whole components, not by spanning trees."""
    ts = ", ".join(f"{t!r}" for t in thresholds)
    return f"""
WITH RECURSIVE pr AS (SELECT * FROM ({pairs})),
e AS (SELECT t, a, b, greatest(d, 1e-12) AS d FROM pr, (SELECT unnest([{ts}]::DOUBLE[]) AS t) WHERE pr.d <= t),
lv AS (SELECT t, d, row_number() OVER (PARTITION BY t ORDER BY d) AS i FROM (SELECT DISTINCT t, d FROM e)),
u AS (SELECT t, i, a AS x, b AS y, d FROM e JOIN lv USING (t, d) UNION ALL SELECT t, i, b, a, d FROM e JOIN lv USING (t, d)),
nn AS (SELECT t, x, min(i) AS i, min(d) AS d FROM u GROUP BY t, x),
reach(t, i, x, y) AS (SELECT nn.t, lv.i, x, x FROM nn JOIN lv ON lv.t = nn.t AND lv.i >= nn.i
  UNION SELECT r.t, r.i, r.x, u.y FROM reach r JOIN u ON u.t = r.t AND u.i <= r.i AND u.x = r.y),
lab AS (SELECT t, i, x, min(y) AS c FROM reach GROUP BY t, i, x),
comp AS (SELECT l.t, l.i, l.c, count(DISTINCT f.c) AS nb FROM lab l LEFT JOIN lab f ON f.t = l.t AND f.i = l.i - 1 AND f.x = l.x GROUP BY 1, 2, 3),
bot AS (SELECT row_number() OVER (ORDER BY t, i, c) AS k, t, i, c, nb FROM comp WHERE nb <> 1),
above AS (SELECT b.k, min(l.i) AS j FROM bot b JOIN lab l ON l.t = b.t AND l.x = b.c AND l.i > b.i
  JOIN bot o ON o.t = l.t AND o.i = l.i AND o.c = l.c GROUP BY b.k),
par AS (SELECT b.*, j, p.k AS up, coalesce(lj.d, 2.0) AS birth, li.d AS death, coalesce(j - 1, (SELECT max(i) FROM lv WHERE lv.t = b.t)) AS top
  FROM bot b JOIN lv li ON li.t = b.t AND li.i = b.i LEFT JOIN above USING (k) LEFT JOIN lv lj ON lj.t = b.t AND lj.i = j
  LEFT JOIN lab l ON l.t = b.t AND l.i = j AND l.x = b.c LEFT JOIN bot p ON p.t = b.t AND p.i = j AND p.c = l.c),
mem AS (SELECT p.k, p.t, m.x FROM par p JOIN lab l ON l.t = p.t AND l.i = p.top AND l.x = p.c JOIN lab m ON m.t = p.t AND m.i = p.top AND m.c = l.c),
st AS (SELECT p.k, p.t, p.up, sum((CASE WHEN p.nb > 1 AND low.x IS NOT NULL THEN 1 / p.death ELSE 1 / nn.d END) - 1 / p.birth) AS s, count(*) / p.birth AS born
  FROM par p JOIN mem ON mem.k = p.k JOIN nn ON nn.t = p.t AND nn.x = mem.x
  LEFT JOIN lab low ON low.t = p.t AND low.i = p.i AND low.c = p.c AND low.x = mem.x GROUP BY p.k, p.t, p.up, p.birth),
cl AS (SELECT st.k, st.t, st.up, CASE WHEN s > born * 1e-9 THEN s ELSE 0.0 END AS s,
  coalesce((SELECT list(o.k ORDER BY o.k) FROM st o WHERE o.up = st.k), []) AS kids FROM st),
fold AS (SELECT list_reduce(list_prepend({{'s': 0.0::DOUBLE, 'kids': []::BIGINT[], 'v': []::DOUBLE[]}},
    list({{'s': s::DOUBLE, 'kids': kids::BIGINT[], 'v': []::DOUBLE[]}} ORDER BY k)),
  lambda f, n: {{'s': f.s, 'kids': f.kids, 'v': list_append(f.v, greatest(n.s, coalesce(list_sum(list_transform(n.kids, lambda j: f.v[j])), 0.0)))}}).v AS v FROM cl),
kept AS (SELECT cl.*, s > 0 AND s >= coalesce(list_sum(list_transform(kids, lambda j: v[j])), 0.0)
  AND NOT (up IS NULL AND (SELECT count(*) FROM cl r WHERE r.t = cl.t AND r.up IS NULL) = 1) AS ok FROM cl, fold),
path(k, a) AS (SELECT k, up FROM kept WHERE up IS NOT NULL UNION ALL SELECT p.k, o.up FROM path p JOIN kept o ON o.k = p.a WHERE o.up IS NOT NULL),
sel AS (SELECT k FROM kept WHERE ok AND k NOT IN (SELECT p.k FROM path p JOIN kept o ON o.k = p.a WHERE o.ok))
SELECT t AS threshold, min(x) OVER (PARTITION BY t, k) AS cluster_id, count(*) OVER (PARTITION BY t, k) AS size, x AS member FROM mem WHERE k IN (SELECT k FROM sel)
"""


@register("masked_clusters", "M5 J7 P14 U5 A16", masked_clusters_sql(f"""
SELECT a.vec_id AS a, b.vec_id AS b, {Q.distance('a.embedding', 'b.embedding')} AS d FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id""",
                                                                     CLUSTER_THRESHOLDS))
def masked_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators import density as CL

    # One radius join at the largest threshold; its edges are fanned out to the thresholds.
    edges = materialize(radius_pairs_df(spark, sf_dir, radius=max(CLUSTER_THRESHOLDS)), "cluster-edges")
    return CL.cluster_members(CL.masked_clusters_multi(edges, CLUSTER_THRESHOLDS))


@register("placeholder_coverage_totals", "A21", _PH_SQL + """
SELECT count(*) FILTER (WHERE top.rank IS NOT NULL) AS n_found, count(*) FILTER (WHERE top.rank IS NULL) AS n_not_found,
       coalesce(array_to_string(list_sort(list(ph.text) FILTER (WHERE top.rank IS NULL)), ' | '), '') AS missing
FROM ph LEFT JOIN top ON top.definition = ph.text WHERE ph.text NOT IN (SELECT text FROM seeds)
""")
def placeholder_coverage_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    ph, seeds, top = _top(spark, sf_dir)
    return PH.coverage_totals(PH.placeholder_coverage(top, seeds, ph))


@register("top5_preview", "T2 P8", _PH_SQL + """
SELECT rank, round(similarity_score, 3) AS score,
       CASE WHEN length(definition) > 50 THEN substr(definition, 1, 50) || '...' ELSE definition END AS preview
FROM top WHERE rank <= 5
""")
def top5_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..functions import text as T

    _, _, top = _top(spark, sf_dir)
    return top.filter(F.col("rank") <= 5).select("rank", F.round("similarity_score", 3).alias("score"),
                                                 T.preview("definition").alias("preview"))
