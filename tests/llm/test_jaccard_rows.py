"""Operator 6 sends tiles only for the first row of each set, packed in byte planes."""

import numpy as np

from dictaudit.llm import jaccard as J


def _base(k, words=60):
    return " ".join(f"w{k}x{i}" for i in range(words))


def test_planes_give_the_numbers_back():
    for kind in (np.int32, np.int64):
        x = np.array([0, 1, -1, 255, 256, np.iinfo(kind).max, np.iinfo(kind).min], kind)
        assert J._from_planes(J._planes(x), kind).tolist() == x.tolist()
        assert J._from_planes(J._planes(x[:0]), kind).tolist() == []


def test_copies_send_no_tiles(spark):
    rows = [(i, _base(i % 3)) for i in range(30)] + [(2, _base(2)), (None, _base(0)), (7, None), (40, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    sized = J._scan_sets(docs, "doc_id", "text", J.N, J.PERCENT).select("doc_id", "n", "fp", "fp2")
    reps = sized.where("n > 0").groupBy("n", "fp", "fp2").agg({"doc_id": "min"}).withColumnRenamed("min(doc_id)", "rep")
    got = J._first_rows(docs, sized, reps, "doc_id", "text", J.N).where("doc is not null and text <> ''").collect()
    assert sorted((r.doc, r.text) for r in got) == [(0, _base(0)), (1, _base(1)), (2, _base(2)), (2, _base(2))]


def test_an_id_with_several_texts_keeps_the_first_of_a_set(spark):
    rows = [(3, _base(1)), (5, _base(1)), (5, _base(2)), (8, _base(2) + " one more"), (9, _base(2))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    sized = J._scan_sets(docs, "doc_id", "text", J.N, J.PERCENT).select("doc_id", "n", "fp", "fp2")
    reps = sized.where("n > 0").groupBy("n", "fp", "fp2").agg({"doc_id": "min"}).withColumnRenamed("min(doc_id)", "rep")
    got = J._first_rows(docs, sized, reps, "doc_id", "text", J.N).collect()
    assert sorted((r.doc, r.text) for r in got) == sorted([(3, _base(1)), (5, _base(2)), (8, _base(2) + " one more")])
    comps = sorted((r.doc_id, r.component_id) for r in J.jaccard_components(docs).collect())
    assert comps == [(3, 3), (5, 3), (5, 5), (8, 5), (9, 5)]
