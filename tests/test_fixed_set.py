"""L7 fixed-set audit and the per-model ablation sink."""

from dictaudit import fixed_values as fv
from dictaudit.operators import audit as A
from dictaudit.sources import sinks as SK

from .test_audit_semantics import sequential_audit


def test_fixed_set_audit_matches_sequential(spark):
    rows = [("t1", "Hospital bell", "device to call a nurse", "Push button", "device to call"),
            ("t2", "Soldering iron", "tool that melts solder", "Television", "device that shows pictures"),
            ("t3", "Concealer", "cosmetic that hides spots", "Concealer stick", "cosmetic stick that hides spots")]
    tuples = spark.createDataFrame(rows, "tuple_id string, name_1 string, def_1 string, name_2 string, def_2 string")
    res, counters = A.audit_tuple_set(tuples, A.MockBackend(), expected=fv.VALID_DISTINCTION)
    got = {r.tuple_id: (r.verdict or fv.UNKNOWN, (r.proposed or {}).get("A", ""), (r.proposed or {}).get("B", ""),
                        r.status) for r in res.collect()}
    want = {t: sequential_audit(n1, d1, n2, d2) for t, n1, d1, n2, d2 in rows}
    assert got == want
    c = counters.first()
    assert c.processed == 3 and c.success + c.error == 3
    assert c.unexpected == sum(1 for v in want.values() if v[3] == "success" and v[0] != fv.VALID_DISTINCTION)


def test_per_model_sink(spark, tmp_path):
    df = spark.createDataFrame([("qwen2.5:7b", "test", "X", "success"), ("org/m:1", "test", "Y", "success")],
                               "model string, mode string, verdict string, status string")
    SK.write_per_model(df, str(tmp_path / "abl"))
    parts = sorted(p.name for p in (tmp_path / "abl").iterdir() if p.name.startswith("safe_model="))
    assert parts == ["safe_model=org_m_1", "safe_model=qwen2.5_7b"]
