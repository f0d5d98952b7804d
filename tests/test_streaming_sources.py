"""Streaming flags equal the batch flags; the foreachBatch audit sink is idempotent on replay;
XML / CSV sources and sinks round-trip; hashed embeddings equal a plain-Python statement."""

import hashlib
import math
import os
import re

import pytest
from pyspark.sql import functions as F

from dictaudit.operators import audit as A
from dictaudit.operators import embed as EM
from dictaudit.session import scratch_path
from dictaudit.sources import dictionary as DS
from dictaudit.sources import sinks as SK
from dictaudit.sources import tables as S
from dictaudit.streaming import incremental as INC

from .conftest import SF_SMALL


def test_stream_flags_equal_batch(spark):
    tv = S.text_vectors(spark, SF_SMALL)
    streamed = INC.stream_entry_flags(spark, os.path.join(SF_SMALL, "documents.parquet"), tv)
    docs = S.table(spark, SF_SMALL, "documents").select(F.col("doc_id").cast("string").alias("id"),
                                                         F.col("text").alias("definition"))
    batch = INC.entry_flags(docs, tv)
    assert sorted(map(tuple, streamed.collect())) == sorted(map(tuple, batch.collect()))


def test_audit_sink_idempotent(spark):
    pairs = spark.createDataFrame(
        [(0.1, "Bell (1)", "a bell that rings", "Gong (2)", "a gong that rings"),
         (0.2, "Cup (3)", "a cup for tea", "Mug (4)", "a mug for coffee")],
        "distance double, preferred_names_a string, text_a string, preferred_names_b string, text_b string")
    out = scratch_path(spark, "audit-sink")
    sink = INC.audit_sink(out, A.MockBackend())
    sink(pairs, 0)
    sink(pairs, 0)          # replay of the same batch
    res = spark.read.parquet(out)
    assert res.count() == A.prepare_candidates(pairs).count()
    assert res.select("pair_id").distinct().count() == res.count()


def test_xml_round_trip_and_first_record(spark, tmp_path):
    rows = [("1", "Bell", "  A device  ", 13), ("1", "Bell later", "dup", 14), ("2", None, "x & <y>", 13),
            ("3", "   ", None, 90)]
    e = spark.createDataFrame(rows, "id string, preferred_name string, definition string, segment int")
    path = str(tmp_path / "xml")
    DS.write_dictionary_xml(e, path, files_per_segment=2)
    got = DS.read_dictionary_xml(spark, path)
    recs = sorted((r.id, r.preferred_name, r.definition, r.segment) for r in got.collect())
    assert recs == [("1", "Bell", "A device", 13), ("1", "Bell later", "dup", 14), ("2", None, "x & <y>", 13),
                    ("3", None, None, 90)]
    excl = DS.read_dictionary_xml(spark, path, exclude_segments=[90])
    assert sorted(r.id for r in excl.collect()) == ["1", "1", "2"]
    props = DS.read_dictionary_xml(spark, path, mode="properties")
    assert props.count() == 0


def test_csv_header_rules(spark, tmp_path):
    p = str(tmp_path / "e.csv")
    with open(p, "w") as f:
        f.write(' ID ,Preferred-Name,Definition (en)\n"1","Bell","line one\nline ""two"""\n"2","",""\n')
    got = DS.read_entries_csv(spark, p).collect()
    assert [tuple(r) for r in got] == [("1", "Bell", 'line one\nline "two"'), ("2", None, None)]
    # the id rule is "equals id or contains irde": an IRDI header is not an id column
    assert DS.normalised_columns(["IRDI", "definition"]) == {"definition": "definition"}
    filled = DS.read_entries_csv(spark, p, fill_empty=True).collect()
    assert tuple(filled[1]) == ("2", "", "")
    with pytest.raises(ValueError):
        DS.normalised_columns(["id", "name"])
    with pytest.raises(ValueError):
        DS.normalised_columns(["definition", "Definition "])
    q = str(tmp_path / "noname.csv")
    with open(q, "w") as f:
        f.write("id,definition\n7,text\n")
    assert tuple(DS.read_entries_csv(spark, q).first()) == ("7", "7", "text")


def test_candidate_pair_scan_skips_missing(spark, tmp_path):
    p = str(tmp_path / "classes.csv")
    with open(p, "w") as f:
        f.write("distance,preferred_names_a,text_a,preferred_names_b,text_b\n0.01,A (1),ta,B (2),tb\n")
    df = DS.read_candidate_pairs(spark, {"classes": p, "properties": str(tmp_path / "missing.csv")})
    assert [(r.kind, r.distance) for r in df.collect()] == [("classes", 0.01)]


def test_embedding_store_only_adds_new(spark, tmp_path):
    path = str(tmp_path / "store")
    v1 = spark.createDataFrame([("a", [1.0, 0.0])], "text string, embedding array<float>")
    v2 = spark.createDataFrame([("a", [9.0, 9.0]), ("b", [0.0, 1.0])], "text string, embedding array<float>")
    SK.store_embeddings(spark, v1, path)
    added = SK.store_embeddings(spark, v2, path)
    assert [r.text for r in added.collect()] == ["b"]
    assert sorted((r.text, list(r.embedding)) for r in spark.read.parquet(path).collect()) == [
        ("a", [1.0, 0.0]), ("b", [0.0, 1.0])]


def py_hashed(text, dim):
    toks = [t for t in re.split(EM.TOKEN_SPLIT, text.lower()) if t]
    counts = {}
    for t in toks:
        b = int(hashlib.md5(t.encode()).hexdigest()[:8], 16) % dim
        counts[b] = counts.get(b, 0) + 1
    n = math.sqrt(sum(c * c for c in counts.values()))
    return {b: c / n for b, c in counts.items()}


def test_hashed_embedding_equals_python(spark):
    texts = ["Hello, hello world!", "Ünïcode wörds and 42 numbers", "a b c a"]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    dense = {r.text: list(r.embedding) for r in EM.HashedTokens(32).embed(df).collect()}
    for t in texts:
        want = py_hashed(t, 32)
        got = dense[t]
        assert all(abs(got[i] - want.get(i, 0.0)) < 1e-6 for i in range(32))


def test_callable_model_provider(spark):
    import numpy as np

    def make():
        return lambda texts: np.array([[len(t), 1.0] for t in texts])

    df = spark.createDataFrame([("ab",), ("abcd",)], "text string")
    got = {r.text: list(r.embedding) for r in EM.CallableModel(make).embed(df).collect()}
    assert got == {"ab": [2.0, 1.0], "abcd": [4.0, 1.0]}


def test_append_sink_summarises_old_and_new(spark, tmp_path):
    path = str(tmp_path / "ablation")
    schema = "model string, mode string, verdict string, status string"
    old = spark.createDataFrame([("m1", "test", "MISALIGNMENT", "success"), ("m1", "test", None, "error")], schema)
    new = spark.createDataFrame([("m2", "test", "MISALIGNMENT", "success"), ("m1", "test", "MISALIGNMENT", "success")],
                                schema)
    SK.append_and_summarise(spark, old, path, ["model", "mode"])
    summary = SK.append_and_summarise(spark, new, path, ["model", "mode"])
    got = sorted(tuple(r) for r in summary.collect())
    assert got == [("m1", "test", "MISALIGNMENT", 2), ("m2", "test", "MISALIGNMENT", 1)]


def test_write_entries_partitioned(spark, tmp_path):
    e = spark.createDataFrame([("1", "a", "x", 13), ("2", "b", "y", 14)],
                              "id string, preferred_name string, definition string, segment int")
    SK.write_entries(e, str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out" / "by_segment"))
    assert sorted((r.id, r.segment) for r in back.collect()) == [("1", 13), ("2", 14)]
    assert spark.read.parquet(str(tmp_path / "out" / "combined")).count() == 2
