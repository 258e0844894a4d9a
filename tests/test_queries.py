"""Every query with SQL gives the rows that the SQL gives."""

from collections import Counter

import pytest

from entitystore import queries
from tests.conftest import DATA


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_equals_sql(spark, duck, name):
    got = queries.QUERIES[name](spark, DATA)
    want = duck.sql(queries.SQL[name])
    names = sorted(got.columns)
    assert names == sorted(want.columns)
    rows = Counter(tuple(map(str, r)) for r in got.select(*names).collect())
    assert rows == Counter(tuple(map(str, r)) for r in want.project(", ".join(names)).fetchall())


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_scan_prunes(spark):
    plan = queries.QUERIES["entity_lookup_many"](spark, DATA)._jdf.queryExecution().toString()
    assert "In(entity_id" in plan and "ReadSchema: struct<entity_id:bigint,l_partkey" in plan
    assert len(queries.fixtures.lineitem(spark, DATA).entities([1, 12, 123, 1234]).inputFiles()) < len(queries.fixtures.lineitem(spark, DATA).scan().inputFiles())
