"""Operator 11 against a plain grouping of equal texts."""

import hashlib
import random
from collections import defaultdict

import pytest

SCHEMA = "doc_id long, text string, rid long, cell string, rest int, n int"


def rows():
    rnd = random.Random(3)
    long = "".join(rnd.choice("ab é") for _ in range(40_000))
    texts = [None, "", "", " ", "a", "ab", "a", "b\x00", "b\x00", "b", long, long, long[:-1] + "z", long[:-1], "é", "é"]
    texts += ["".join(rnd.choice("xy") for _ in range(rnd.randrange(9))) for _ in range(120)]
    data = [(i * 7 % 151, t, i, "x", 1, 2) for i, t in enumerate(texts)]
    data += [(None, "a", 1, "x", 1, 2), (None, None, 1, "x", 1, 2), (None, "alone", 1, "x", 1, 2), (None, "twice", 1, "x", 1, 2),
             (None, "twice", 1, "x", 1, 2), data[12], data[12], (5000, "copy", 1, "x", 1, 2), (5000, "copy", 2, "y", 1, 2)]
    return data


def check(got, data):
    groups = defaultdict(list)
    for r in data:
        groups[r[1] or ""].append(r[0])
    want = defaultdict(list)
    for text, ids in groups.items():
        ids = sorted(ids, key=lambda i: (i is not None, i or 0))
        for k, i in enumerate(ids):
            want[hashlib.sha256(text.encode()).hexdigest()].append((i, ids[-1], len(ids), k == len(ids) - 1))
    have = defaultdict(list)
    for r in got:
        have[r.text_sha256].append((r.doc_id, r.keep_id, r.group_size, r.kept))
    assert {k: sorted(v, key=str) for k, v in have.items()} == {k: sorted(v, key=str) for k, v in want.items()}


@pytest.mark.parametrize("width,growth", [(32, 128), (1, 2), (3, 1000)])
def test_groups(spark, width, growth):
    from dictaudit.llm.exact_dedup import exact_groups

    data = rows()
    df = spark.createDataFrame(data, SCHEMA).repartition(5)
    check(exact_groups(df, width=width, growth=growth).collect(), data)


def test_hot_group_and_empty_table(spark):
    from dictaudit.llm.exact_dedup import exact_groups

    data = [(i, "same " * 30 if i % 3 else f"own {i}", 0, "", 0, 0) for i in range(3000)]
    check(exact_groups(spark.createDataFrame(data, SCHEMA)).collect(), data)
    empty = exact_groups(spark.createDataFrame([], SCHEMA))
    assert empty.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"] and empty.count() == 0


def test_other_column_names(spark):
    from dictaudit.llm.exact_dedup import exact_groups

    df = spark.createDataFrame([(1, "x", 9), (2, "x", 9)], "key int, body string, doc_id int")
    assert sorted((r.doc_id, r.keep_id, r.kept) for r in exact_groups(df, "key", "body").collect()) == [(1, 2, False), (2, 2, True)]
