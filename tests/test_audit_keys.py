"""Backends that answer by key get the same signals without the prompts' texts."""

from pyspark.sql import functions as F

from dictaudit.operators import audit as A


def _pairs(spark):
    return spark.createDataFrame([("p1", "bell", "a hollow body", "gong", "a round plate"), ("p2", "", "x", "name", ""),
                                  ("p1", "bell", "a hollow body", "gong", "a round plate")],
                                 "pair_id string, name_1 string, def_1 string, name_2 string, def_2 string")


def _recorded(spark, pairs):
    asked = A.round1_requests(pairs).select("pkey", "role").unionByName(A.round2_requests(pairs).select("pkey", "role"))
    return asked.distinct().withColumn("response", F.concat(F.when(F.col("role") == "alignment_b", "NO: ").otherwise("YES - "), "role"))


def test_keys_are_those_of_the_requests(spark):
    pairs = A._with_model(_pairs(spark), "m1")
    want = {(r.pair_id, r.role): r.pkey for r in A.round1_requests(pairs).unionByName(A.round2_requests(pairs)).collect()}
    keyed = A.prompt_keys(pairs).select("pair_id", F.explode("keys").alias("k")).select("pair_id", "k.*")
    assert {(r.pair_id, r.role): r.pkey for r in A._keyed_requests(keyed, A.ROLES).collect()} == want


def test_signals_by_key_equal_signals_by_text(spark):
    pairs = A._with_model(_pairs(spark), "m1")
    backend = A.TableBackend(_recorded(spark, pairs))
    by_key = sorted(map(tuple, A.audit_signals(pairs, backend).collect()))
    backend.by_key = False
    by_text = sorted(map(tuple, A.audit_signals(pairs, backend).collect()))
    assert by_key == by_text and len(by_key) == 2


def test_no_prompt_text_is_asked_or_shuffled(spark):
    pairs = A._with_model(_pairs(spark), "m1")
    seen = []

    class Backend(A.TableBackend):
        def complete(self, requests):
            seen.append(requests.columns)
            return super().complete(requests)

    sig = A.audit_signals(pairs, Backend(_recorded(spark, pairs)), detail=False)
    assert seen == [["pkey"], ["pkey"]]
    assert {r.status for r in sig.collect()} == {"success"} and sig.where("alignment_a_justification is not null").count() == 0
