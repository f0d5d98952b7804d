"""Quoted CSV over split borders, and quantiles of very many equal values."""

import csv
import random

import numpy as np
import pytest

from dictaudit.sources import dictionary as DS


def rows(n):
    rnd = random.Random(6)
    parts = ["word", 'quote "x"', "line\nbreak", "\n\n", ",", "é漢", '""', "tail\n", " "]
    return [(str(i), rnd.choice(["name", "a,b", 'say "hi"', "two\nlines"]), "".join(rnd.choice(parts) for _ in range(rnd.randrange(1, 30))) + "z") for i in range(n)]


def write(path, data, newline="\n"):
    with open(path, "w", newline="") as f:
        out = csv.writer(f, lineterminator=newline)
        out.writerow(["id", "preferred-name", "Definition"])
        out.writerows(data)


@pytest.mark.parametrize("size, newline", [("700", "\n"), ("5000", "\r\n"), ("128m", "\n")])
def test_records_over_split_borders(spark, tmp_path, size, newline):
    data = rows(400)
    write(tmp_path / "a.csv", data[:300], newline)
    write(tmp_path / "b.csv", data[300:], newline)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    try:
        got = sorted((r.id, r.preferred_name, r.definition) for r in DS.read_entries_csv(spark, str(tmp_path)).collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == sorted(data)


def test_blank_quoted_and_tokens(spark, tmp_path):
    (tmp_path / "x.csv").write_text('id,preferred_name,definition\n1,,NA\n\n2,"n ""q""","a\n\nb"\n3,NA,')
    read = {r.id: (r.preferred_name, r.definition) for r in DS.read_entries_csv(spark, str(tmp_path)).collect()}
    assert read == {"1": (None, "NA"), "2": ('n "q"', "a\n\nb"), "3": ("NA", None)}
    nulled = {r.id: (r.preferred_name, r.definition) for r in DS.read_entries_csv(spark, str(tmp_path), na_tokens=["NA"]).collect()}
    assert nulled == {"1": (None, None), "2": ('n "q"', "a\n\nb"), "3": (None, None)}
    (tmp_path / "y.csv").write_text("id,text definition\n4,x\n")
    with pytest.raises(ValueError):
        DS.read_entries_csv(spark, str(tmp_path))


def test_quantiles_of_300000_equal_values(spark):
    from dictaudit.operators.similarity import exact_quantiles

    df = spark.range(300_100).selectExpr("CASE WHEN id < 300000 THEN 0.25D ELSE id * 1e-9D END AS x")
    assert [r.value for r in exact_quantiles(df, "x", [0.25, 0.5, 0.999]).collect()] == [0.25, 0.25, 0.25]
    # a shuffle of the plan has at most a row a bin and task, whatever the number of values
    x = np.concatenate([np.random.default_rng(0).normal(size=5000), [1e300, -1e300, 1e-300, 0.0, -0.0]])
    got = exact_quantiles(spark.createDataFrame([(float(v),) for v in x] + [(None,)], "x double"), "x", [0.0, 0.1, 0.5, 0.9, 1.0], bins=64).collect()
    assert [r.value for r in got] == pytest.approx(np.quantile(x, [0.0, 0.1, 0.5, 0.9, 1.0]).tolist())
    assert [r.value for r in exact_quantiles(df.limit(0), "x", [0.5]).collect()] == [None]
