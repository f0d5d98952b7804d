"""Results do not depend on the number of shuffle partitions."""

import pytest

import __spark_entry__ as E

from .conftest import SF_SMALL

QUERIES = E.queries()


def _rows(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("name", ["exact_duplicates", "dedup_pair_report", "radius_pairs", "islands",
                                  "placeholder_top100", "audit_pairs", "similarity_summary"])
def test_partition_count_invariance(spark, name):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "3")
        a = _rows(QUERIES[name](spark, SF_SMALL))
        spark.conf.set("spark.sql.shuffle.partitions", "17")
        b = _rows(QUERIES[name](spark, SF_SMALL))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert a == b and len(a) > 0
