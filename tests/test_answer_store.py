"""The answer store: a restart asks nothing twice, also after a crash; failing models cost a bounded number of calls."""

import pytest
from pyspark.sql import functions as F

from dictaudit.operators import audit as A
from dictaudit.operators.answer_store import SKIPPED, AnswerStore, StoredBackend


def requests(spark, n, model="m"):
    df = spark.range(n).select(F.lit("sys").alias("system"), F.concat(F.lit(f"{model} "), F.col("id").cast("string")).alias("user"), F.lit(model).alias("model"))
    return df.withColumn("pkey", A.prompt_key(F.col("system"), F.col("user"), F.col("model")))


def counting(log, bad=lambda user: False, fatal=lambda user: False):
    """A model that notes each call in a file; a fatal prompt ends the task as a crash would."""
    def ask(system, user, model):
        with open(log, "a") as f:
            f.write(user.replace("\n", " ") + "\n")
        if fatal(user):
            raise SystemExit("crash")
        if bad(user):
            raise RuntimeError("down")
        return f"YES to {user}"
    return ask


def calls(log):
    try:
        return open(log).read().split("\n")[:-1]
    except FileNotFoundError:
        return []


def test_restart_asks_nothing_twice(spark, tmp_path):
    log = str(tmp_path / "log")
    store = AnswerStore(spark, f"{tmp_path}/store", batch_rows=20)
    backend = A.CallableBackend(counting(log), n_clients=2, retries=0)
    store.complete(requests(spark, 30), backend)
    assert sorted(calls(log)) == sorted(f"m {i}" for i in range(30))
    twice = requests(spark, 50).union(requests(spark, 50))
    got = store.complete(twice, backend)
    assert got.count() == 50 and got.where("response is null").count() == 0
    assert sorted(calls(log)) == sorted(f"m {i}" for i in range(50))
    done = AnswerStore(spark, f"{tmp_path}/store").commits().agg(F.sum("asked"), F.sum("failed")).first()
    assert tuple(done) == (50, 0)


def test_answers_of_finished_partitions_survive_a_crash(spark, tmp_path):
    log = str(tmp_path / "log")
    store = AnswerStore(spark, f"{tmp_path}/store", trials=0)
    todo = requests(spark, 40)
    with pytest.raises(Exception):
        store.complete(todo, A.CallableBackend(counting(log, fatal=lambda u: u == "m 7"), n_clients=8, retries=0))
    first = len(calls(log))
    kept = store.latest().count()
    assert kept > 0 and store.commits().count() == 0
    got = store.complete(todo, A.CallableBackend(counting(log), n_clients=8, retries=0))
    assert got.where("response is not null").count() == 40
    # only what had not been written is asked again
    assert len(calls(log)) - first == 40 - kept and store.latest().count() == 40


def test_failures_are_asked_again_up_to_the_limit(spark, tmp_path):
    log = str(tmp_path / "log")
    store = AnswerStore(spark, f"{tmp_path}/store", max_attempts=2)
    for _ in range(4):
        got = store.complete(requests(spark, 12), A.CallableBackend(counting(log, bad=lambda u: u == "m 3"), retries=0))
    assert calls(log).count("m 3") == 2 and len(calls(log)) == 13
    row = got.where("response is null").collect()
    assert len(row) == 1 and "down" in row[0].error
    assert store.latest().where("attempts = 2").count() == 1


def test_a_failing_model_costs_a_bounded_number_of_calls(spark, tmp_path):
    log = str(tmp_path / "log")
    store = AnswerStore(spark, f"{tmp_path}/store", trials=3)
    both = requests(spark, 200, "up").union(requests(spark, 200, "dead"))
    got = store.complete(both, A.CallableBackend(counting(log, bad=lambda u: u.startswith("dead")), retries=0))
    assert sum(c.startswith("dead") for c in calls(log)) == 3
    assert got.where("response is not null").count() == 200 and got.where(F.col("error") == SKIPPED).count() == 197
    back = store.complete(both, A.CallableBackend(counting(log), retries=0))
    assert back.where("response is null").count() == 0


def test_audit_through_the_store(spark, tmp_path):
    pairs = spark.createDataFrame([(0.1, "a (1)", "text a", "b (2)", "text b"), (0.2, "a (1)", "text a", "c (3)", "text c")],
                                  "distance double, preferred_names_a string, text_a string, preferred_names_b string, text_b string")
    log = str(tmp_path / "log")
    backend = StoredBackend(AnswerStore(spark, f"{tmp_path}/store"), A.CallableBackend(counting(log), retries=0))
    first = sorted(map(str, A.audit_candidates(pairs, backend).collect()))
    n = len(calls(log))
    assert n > 0 and len(set(calls(log))) == n
    assert sorted(map(str, A.audit_candidates(pairs, backend).collect())) == first and len(calls(log)) == n
