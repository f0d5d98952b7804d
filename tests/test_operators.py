"""Operator properties: radius join ≡ brute force for any block count, components ≡ BFS, exact
quantiles ≡ numpy, dedup idempotent and partition-invariant, audit backends agree."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from dictaudit import fixed_values as fv
from dictaudit.operators import audit as A
from dictaudit.operators import components as C
from dictaudit.operators import dedup as D
from dictaudit.operators import radius as R
from dictaudit.operators import similarity as SIM

from .conftest import SF_MID, SF_SMALL


def _vectors(n=300, d=16, seed=7):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(n // 3, d))
    x = np.concatenate([base, base + 0.15 * rng.normal(size=base.shape), rng.normal(size=(n - 2 * (n // 3), d))])
    x[5] = 0.0                      # a zero vector: distance 1.0 to everything
    x[7] = x[8]                     # identical vectors: distance 0
    return x.astype(np.float32)


def _brute_pairs(x, r):
    u = x.astype(np.float64)
    n = np.linalg.norm(u, axis=1, keepdims=True)
    u = np.divide(u, n, out=np.zeros_like(u), where=n > 0)
    d = 1.0 - np.clip(u @ u.T, -1, 1)
    i, j = np.nonzero(np.triu(d <= r, k=1))
    return {(int(a), int(b)): float(d[a, b]) for a, b in zip(i, j)}


@pytest.fixture(scope="module")
def vec_df(spark):
    x = _vectors()
    pdf = pd.DataFrame({"vec_id": np.arange(len(x), dtype=np.int64), "embedding": [list(map(float, v)) for v in x]})
    return x, spark.createDataFrame(pdf, "vec_id long, embedding array<float>")


@pytest.mark.parametrize("blocks", [1, 3, 7])
def test_radius_blocks_equal_brute_force(vec_df, blocks):
    x, df = vec_df
    want = _brute_pairs(x, 0.35)
    got = {(r.id_a, r.id_b): r.distance for r in
           R.radius_join(df, 0.35, id_col="vec_id", blocks=blocks).collect()}
    assert set(got) == set(want)
    assert all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_radius_naive_equals_blocks(vec_df):
    _, df = vec_df
    a = {(r.id_a, r.id_b): round(r.distance, 9) for r in R.radius_join(df, 0.35, id_col="vec_id", method="naive").collect()}
    b = {(r.id_a, r.id_b): round(r.distance, 9) for r in R.radius_join(df, 0.35, id_col="vec_id").collect()}
    assert a == b and len(a) > 50


def test_radius_boundary_included(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 0.0])], "vec_id long, embedding array<float>")
    got = sorted((r.id_a, r.id_b, r.distance) for r in R.radius_join(df, 1.0, id_col="vec_id", blocks=2).collect())
    assert got == [(0, 1, 1.0), (0, 2, 0.0), (1, 2, 1.0)]


def test_threshold_fanout_and_pair_mean(spark):
    pairs = spark.createDataFrame([("b", "a", 0.1), ("a", "b", 0.3), ("c", "d", 0.5)], "text_a string, text_b string, distance double")
    m = {(r.text_a, r.text_b): r.distance for r in R.pair_mean(pairs).collect()}
    assert m == {("a", "b"): pytest.approx(0.2), ("c", "d"): 0.5}
    f = sorted((r.threshold, r.text_a) for r in R.threshold_fanout(R.pair_mean(pairs), [0.3, 0.5]).collect())
    assert f == [(0.3, "a"), (0.5, "a"), (0.5, "c")]


def _bfs_components(edges):
    adj = {}
    for a, b in edges:
        adj.setdefault(a, set()).add(b)
        adj.setdefault(b, set()).add(a)
    seen, out = set(), {}
    for s in sorted(adj):
        if s in seen:
            continue
        stack, comp = [s], []
        seen.add(s)
        while stack:
            u = stack.pop()
            comp.append(u)
            for v in adj[u]:
                if v not in seen:
                    seen.add(v)
                    stack.append(v)
        for u in comp:
            out[u] = min(comp)
    return out


def test_components_equal_bfs(spark):
    rng = np.random.default_rng(3)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 400, size=(300, 2)) if a != b]
    edges += [(i, i + 1) for i in range(1000, 1100)]          # a long path: many propagation rounds
    df = spark.createDataFrame(edges, "id_a long, id_b long")
    got = {r.node: r.component for r in C.connected_components(df).collect()}
    assert got == _bfs_components(edges)


def test_components_single_and_no_island(spark):
    one = spark.createDataFrame([(1, 2), (2, 3)], "id_a long, id_b long")
    assert sorted(tuple(r) for r in C.island_rollup(C.connected_components(one)).collect()) == [(1, 3, "1,2,3")]
    none = spark.createDataFrame([], "id_a long, id_b long")
    assert C.connected_components(none).count() == 0


@pytest.mark.parametrize("n", [1, 2, 5, 1000])
def test_exact_quantiles_equal_numpy(spark, n):
    rng = np.random.default_rng(n)
    vals = np.round(rng.normal(size=n), 3)          # rounding creates ties
    df = spark.createDataFrame([(float(v),) for v in vals], "x double")
    got = {r.qi: r.value for r in SIM.exact_quantiles(df, "x", [0.25, 0.5, 0.75], bins=7).collect()}
    for i, p in enumerate([0.25, 0.5, 0.75]):
        assert got[i] == pytest.approx(float(np.percentile(vals, p * 100)), abs=1e-12)


def test_summary_by_class_empty_class(spark):
    df = spark.createDataFrame([("tbd", 0.5), ("x", 0.2), ("y", 0.4)], "definition string, cosine_similarity double")
    r = SIM.summary_by_class(df).first()
    assert (r.n_placeholder, r.mean_placeholder, r.std_placeholder) == (1, 0.5, 0.0)
    r = SIM.summary_by_class(df, ["nothing"]).first()
    assert (r.n_placeholder, r.mean_placeholder, r.std_placeholder, r.n_regular) == (0, 0.0, 0.0, 3)


def test_dedup_rules(spark):
    rows = [("10", "n", "d"), ("9", "n", "d"), ("3", None, None), ("4", None, None), ("5", "n", None), ("6", "m", "d")]
    df = spark.createDataFrame(rows, "id string, preferred_name string, definition string")
    kept = {(r.preferred_name, r.definition): r.id for r in D.dedup_pairs(df).collect()}
    assert kept == {("n", "d"): "10", (None, None): "3", ("n", None): "5", ("m", "d"): "6"}   # '10' < '9'
    rep = {(r.preferred_name, r.definition): (r.kept_id, r.removed_ids, r.n_removed) for r in D.dedup_pair_report(df).collect()}
    assert rep == {("n", "d"): ("10", "9", 1), (None, None): ("3", "4", 1)}
    again = D.dedup_pairs(D.dedup_pairs(df))
    assert sorted(map(tuple, again.collect()), key=str) == sorted(map(tuple, D.dedup_pairs(df).collect()), key=str)


def test_dedup_partition_invariant(spark):
    from dictaudit.sources import tables as S

    e = S.entries_from_part(spark, SF_MID)
    a = sorted(map(tuple, D.dedup_pairs(e).collect()))
    b = sorted(map(tuple, D.dedup_pairs(e.repartition(13).orderBy(F.rand(1))).collect()))
    assert a == b


def test_id_conflicts_null_safe(spark):
    rows = [("a", "n", None, 1, 1), ("a", "n", None, 2, 5), ("b", "x", "d", 1, 2), ("b", "y", "d", 3, 1)]
    df = spark.createDataFrame(rows, "id string, preferred_name string, definition string, segment int, seq long")
    got = {r.id: (r.n_duplicates, r.all_identical) for r in D.id_conflicts(df).collect()}
    assert got == {"a": (1, True), "b": (1, False)}
    first = {r.id: (r.segment, r.seq) for r in D.first_by_key(df).collect()}
    assert first == {"a": (1, 1), "b": (1, 2)}


def test_audit_backends_agree(spark):
    pairs = spark.createDataFrame(
        [("p1", "Hospital bell", "device for a call", "Push button", "device for the call"),
         ("p2", "Concealer stick", "cosmetic stick", "Concealer", "cosmetic cream")],
        "pair_id string, name_1 string, def_1 string, name_2 string, def_2 string")
    mock = A.MockBackend()
    expr_sig = sorted(map(tuple, A.audit_signals(pairs, mock, model="m1").collect()), key=str)

    def answer(system, user, model):
        import hashlib

        h = hashlib.md5("\x1f".join([model or "", system, user]).encode()).hexdigest()
        if system == fv.ISO_SYSTEM_PROMPT:
            return "Mock definition " + h[:12]
        c, tail = h[0], h[1:9]
        if c in "0123456789ab":
            return "YES — mock " + tail
        if c in "cd":
            return "NO — mock " + tail
        return ("Nothing " if c == "e" else "Unclear ") + tail

    call = A.CallableBackend(answer, n_clients=2)
    call_sig = sorted(map(tuple, A.audit_signals(pairs, call, model="m1").collect()), key=str)
    assert expr_sig == call_sig


def test_table_backend_missing_answer_is_error(spark):
    pairs = spark.createDataFrame([("p1", "A", "a def", "B", "b def")],
                                  "pair_id string, name_1 string, def_1 string, name_2 string, def_2 string")
    empty = spark.createDataFrame([], "pkey string, response string")
    sig = A.audit_signals(pairs, A.TableBackend(empty)).first()
    assert sig.status == "error" and sig.verdict is None and "no recorded answer" in sig.error


def test_callable_backend_failure_becomes_column(spark):
    pairs = spark.createDataFrame([("p1", "A", "a def", "B", "b def")],
                                  "pair_id string, name_1 string, def_1 string, name_2 string, def_2 string")

    def boom(system, user, model):
        raise RuntimeError("server down")

    sig = A.audit_signals(pairs, A.CallableBackend(boom, n_clients=1, retries=0, backoff_s=0)).first()
    assert sig.status == "error" and "server down" in sig.error


def test_placeholder_top_equals_numpy(spark):
    from dictaudit.operators import placeholder as PH
    from dictaudit.sources import tables as S

    tv = S.text_vectors(spark, SF_SMALL).select("text", "embedding")
    pdf = tv.toPandas()
    seeds_txt = sorted(pdf.text, key=lambda t: (len(t), t))[:3]
    seeds = spark.createDataFrame([(t,) for t in seeds_txt], "text string")
    got = [(r.rank, r.definition, r.similarity_score) for r in PH.closest_to_seeds(tv, seeds, k=20).collect()]
    m = np.stack([np.asarray(v, dtype=np.float64) for v in pdf.embedding])
    m = m / np.linalg.norm(m, axis=1, keepdims=True)
    sv = m[[list(pdf.text).index(s) for s in seeds_txt]]
    score = (m @ sv.T).max(axis=1)
    cand = sorted([(-score[i], t) for i, t in enumerate(pdf.text) if t not in seeds_txt])[:20]
    assert [g[1] for g in sorted(got)] == [t for _, t in cand]
    assert all(abs(g[2] + c[0]) < 1e-9 for g, c in zip(sorted(got), cand))


def test_naive_radius_query_is_no_nested_loop(spark):
    from dictaudit.plans.vector_queries import radius_pairs_naive

    plan = radius_pairs_naive(spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan
