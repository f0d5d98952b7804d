"""The exact duplicates are joined in one way at every size."""

from dictaudit.llm import exact_dedup as ED


def test_small_tables_are_joined_like_large_ones(spark, monkeypatch):
    plans, write = [], ED.materialize

    def kept(df, name):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return write(df, name)

    monkeypatch.setattr(ED, "materialize", kept)
    texts = ["a" * 40, "a" * 40, "b" * 40, "", None, "a" * 39 + "c", "b" * 40]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in ED.exact_groups(docs).collect()}
    assert got == {0: (1, 2, False), 1: (1, 2, True), 2: (6, 2, False), 3: (4, 2, False), 4: (4, 2, True), 5: (5, 1, True), 6: (6, 2, True)}
    joins = [p for p in plans if "Join" in p]
    assert len(joins) >= 2 and not any("BroadcastHashJoin" in p for p in joins)
