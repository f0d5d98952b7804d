"""The distributed two-round audit equals a sequential, per-pair statement of the audited logic."""

import hashlib

import pytest

from dictaudit import fixed_values as fv
from dictaudit.operators import audit as A
from dictaudit.plans.vector_queries import candidate_pairs

from .conftest import SF_MID
from .test_text_functions import py_strip_group


def mock(system: str, user: str, model: str = "") -> str:
    h = hashlib.md5("\x1f".join([model, system, user]).encode()).hexdigest()
    if system == fv.ISO_SYSTEM_PROMPT:
        return "Mock definition " + h[:12]
    if h[0] in "0123456789ab":
        return "YES — mock " + h[1:9]
    if h[0] in "cd":
        return "NO — mock " + h[1:9]
    return ("Nothing " if h[0] == "e" else "Unclear ") + h[1:9]


def parse(resp: str):
    s = resp.strip()
    if s.upper().startswith("YES"):
        return True
    if s.upper().startswith("NO"):
        return False
    raise ValueError(s)


def sequential_audit(n1, d1, n2, d2):
    """One pair, in the audited order; any parse failure ends the pair with an error."""
    try:
        a = parse(mock(fv.ALIGNMENT_SYSTEM_PROMPT, fv.ALIGNMENT_USER_PROMPT.format(name=n1, definition=d1)))
        b = parse(mock(fv.ALIGNMENT_SYSTEM_PROMPT, fv.ALIGNMENT_USER_PROMPT.format(name=n2, definition=d2)))
        n = parse(mock(fv.NAMES_DISTINCT_SYSTEM_PROMPT, fv.NAMES_DISTINCT_USER_PROMPT.format(name_1=n1, name_2=n2)))
        s = None
        if n:
            s = parse(mock(fv.DEFS_TOO_SIMILAR_SYSTEM_PROMPT,
                           fv.DEFS_TOO_SIMILAR_USER_PROMPT.format(name_1=n1, def_1=d1, name_2=n2, def_2=d2)))
    except ValueError:
        return fv.UNKNOWN, "", "", "error"
    if not a or not b:
        verdict, terms = fv.MISALIGNMENT, [t for t, ok in (("A", a), ("B", b)) if not ok]
    elif not n:
        verdict, terms = fv.TRUE_REDUNDANCY, []
    elif s:
        verdict, terms = fv.DEFINITION_INSUFFICIENT, ["A", "B"]
    else:
        verdict, terms = fv.VALID_DISTINCTION, []
    fixes = {t: mock(fv.ISO_SYSTEM_PROMPT, fv.ISO_USER_PROMPT.format(term_name=n1 if t == "A" else n2)).strip()
             for t in terms}
    return verdict, fixes.get("A", ""), fixes.get("B", ""), "success"


def is_skipped(ta, tb):
    low = [(t or "").lower() for t in (ta, tb)]
    if any(any(s in x for s in fv.CHEMICAL_STEMS) for x in low):
        return True
    return ta in fv.STRUCTURAL_DEFINITIONS or tb in fv.STRUCTURAL_DEFINITIONS


@pytest.fixture(scope="module")
def candidates(spark):
    real = candidate_pairs(spark, SF_MID).select("distance", "preferred_names_a", "text_a", "preferred_names_b", "text_b")
    extra = spark.createDataFrame(
        [(0.01, "Concealer stick (makeup) (X1)", "a stick that hides spots", "Concealer (BB cream)", "a cream that hides spots"),
         (0.02, "Hospital bell", "device to call", "Push button (door (x) )", "device to call too"),
         (0.03, "Ring", fv.STRUCTURAL_DEFINITIONS[3], "Bolt", "plain words only"),
         (0.04, "Salt", "sodium chloride", "Sand", "grains")],
        real.schema)
    return real.unionByName(extra)


def test_audit_equals_sequential_statement(spark, candidates):
    got = {(r.text_a, r.text_b): (r.verdict, r.llm_definition_a, r.llm_definition_b, r.status)
           for r in A.audit_candidates(candidates, A.MockBackend()).collect()}
    want = {}
    for r in candidates.collect():
        if is_skipped(r.text_a, r.text_b):
            continue
        want[(r.text_a, r.text_b)] = sequential_audit(py_strip_group(r.preferred_names_a), r.text_a,
                                                      py_strip_group(r.preferred_names_b), r.text_b)
    assert got == want
    assert len(want) >= 10
    assert {v[3] for v in want.values()} == {"success", "error"} or len({v[0] for v in want.values()}) >= 2


def test_repeated_pair_and_two_models(spark):
    """A pair that occurs twice and pairs of two models keep every row, each asked once."""
    rows = [(m, "p1", "bolt", "a threaded pin", "screw", "a threaded rod") for m in ("m1", "m1", "m2")]
    pairs = spark.createDataFrame(rows, "model string, pair_id string, name_1 string, def_1 string, name_2 string, def_2 string")
    backend = A.CallableBackend(lambda system, user, model: "NO, it does not.", n_clients=1)
    sig = A.audit_signals(pairs, backend)
    got = sorted((r.model, r.status) for r in sig.collect())
    assert got == [("m1", "success"), ("m2", "success")]
    fixes = A.remediation(pairs, sig, backend)
    assert fixes.groupBy("model", "pair_id", "term").count().where("count > 1").isEmpty()
    assert {r.model for r in fixes.select("model").distinct().collect()} == {"m1", "m2"}


def test_quantiles_of_ties(spark):
    from dictaudit.operators.similarity import exact_quantiles

    df = spark.range(30000).selectExpr("cast(if(id < 29000, 5, id) as double) x")
    got = {round(r.p, 2): r.value for r in exact_quantiles(df, "x", [0.25, 0.5, 0.75], bins=16).collect()}
    assert got == {0.25: 5.0, 0.5: 5.0, 0.75: 5.0}
