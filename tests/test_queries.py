"""Every query with SQL gives the SQL's rows on the smallest tables; the others give rows."""

import pytest

from docfield.plans import queries as q
from tests.oracle import differences

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(q.ORACLE_SQL))
def test_same_rows_as_sql(spark, name):
    assert differences(spark, q.QUERIES[name], q.ORACLE_SQL[name], SF) == []


@pytest.mark.parametrize("name", sorted(set(q.QUERIES) - set(q.ORACLE_SQL)))
def test_rows_without_sql(spark, name):
    assert q.QUERIES[name](spark, SF).count() > 0


def test_entry_has_every_query(spark):
    import __spark_entry__ as e

    assert set(q.QUERIES) <= set(e.queries())
    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() > 0


def test_same_rows_at_any_partitioning(spark):
    old, out = spark.conf.get("spark.sql.shuffle.partitions"), []
    for n in ("1", "8"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        out.append(sorted(map(tuple, q.QUERIES["bm25_topk"](spark, SF).collect())))
    spark.conf.set("spark.sql.shuffle.partitions", old)
    assert out[0] == out[1]
