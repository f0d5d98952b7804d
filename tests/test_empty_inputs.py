"""Empty inputs give typed empty results (D-10), never errors."""

from pyspark.sql import functions as F

from dictaudit.operators import audit as A
from dictaudit.operators import density as CL
from dictaudit.operators import radius_tree as RT
from dictaudit.operators import radius as R
from dictaudit.operators import similarity as SIM


def test_empty_everywhere(spark):
    vecs = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert R.radius_join(vecs, 0.5, id_col="vec_id").count() == 0
    assert RT.radius_tree_join(vecs, 0.05, id_col="vec_id").count() == 0
    edges = spark.createDataFrame([], "id_a long, id_b long, distance double")
    assert CL.masked_clusters(edges, 0.5).count() == 0
    scores = spark.createDataFrame([], "definition string, cosine_similarity double")
    s = SIM.summary_stats(scores, "cosine_similarity").first()
    assert s["count"] == 0 and s["median"] is None
    assert [r.n for r in SIM.histogram(scores).collect()] == [0] * 10
    cands = spark.createDataFrame([], "distance double, preferred_names_a string, text_a string, "
                                      "preferred_names_b string, text_b string")
    out = A.audit_candidates(cands, A.MockBackend())
    assert out.count() == 0 and "verdict" in out.columns
    assert A.run_counters(out).first().processed == 0
    assert SIM.summary_by_class(scores.withColumn("cosine_similarity", F.col("cosine_similarity"))).first().n_regular == 0
