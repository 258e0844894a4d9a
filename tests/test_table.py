import pytest
from pyspark.sql import functions as F

from entitystore.functions.predicates import Predicate
from entitystore.operators import stats
from entitystore.sources.manifest import TransactionError
from entitystore.sources.table import EntityTable, tables, tenants
from entitystore.streaming.ingest import upsert_stream
from entitystore.types import EntityIdTypeError

TS = "2021-01-06 10:00:00"
SCHEMA = "entity_id long, _version long, name string, vuln int"


@pytest.fixture
def table(spark, tmp_path):
    return EntityTable(spark, str(tmp_path), "org1", "vulns", shards=2)


def put(spark, t, *entities, interval="single", ts=TS):
    """entities: (id, version, values)."""
    t.begin()
    for e, v, values in entities:
        t.write(spark.createDataFrame([(e, v, "n", x) for x in values], SCHEMA), interval, ts)
    return t.commit()


def remove(spark, t, e, v):
    t.begin()
    t.delete(spark.createDataFrame([(e, v)], "entity_id long, _version long"), "single", TS)
    return t.commit()


def state(t):
    r = t.scan().agg(F.count("*"), F.count_distinct("entity_id"), F.min("vuln"), F.max("vuln")).first()
    return tuple(r)


def test_worked_example(spark, table):
    put(spark, table, (1, 1, [1] * 6), (1, 2, [1, 2, 3, 4, 2, 1]), (1, 0, [9]), (2, 0, [5, 6, 5, 6, 5, 6]))
    assert state(table) == (12, 2, 1, 6)
    remove(spark, table, 1, 1000)
    assert state(table) == (6, 1, 5, 6)
    put(spark, table, (2, 1, [5, 6, 5, 6, 5, 6]))
    assert state(table) == (6, 1, 5, 6)
    put(spark, table, (2, 3, [None, None, None, None, 6]), (3, 1, [6, -1]))
    assert state(table) == (7, 2, -1, 6)
    put(spark, table, (3, 2, [6, -1, None]))
    assert state(table) == (8, 2, -1, 6)
    put(spark, table, (3, 1, [7]))  # stale
    assert state(table) == (8, 2, -1, 6)
    put(spark, table, (1, 1, [4]))  # a delete is forgotten once committed
    assert table.entity(1).count() == 1 and table.entity(99).count() == 0


def test_new_column_and_catalog(spark, table, tmp_path):
    put(spark, table, (1, 1, [1]))
    table.begin()
    table.write(spark.createDataFrame([(2, 1, "x", 2, "Austin")], SCHEMA + ", city string"), "single", TS)
    table.commit()
    assert {r.entity_id: r.city for r in table.scan().collect()} == {1: None, 2: "Austin"}
    assert "city" in table.columns() and tenants(spark, str(tmp_path)) == ["org1"] and tables(spark, str(tmp_path), "org1") == ["vulns"]


def test_snapshot_copy_drop(spark, table):
    put(spark, table, (1, 1, [1]), (2, 1, [2]))
    n = table.snapshot("weekly", TS)
    assert {s["interval_start"] for s in table.slices(Predicate("=", ("weekly",)))} == {"2021-01-04T00:00:00Z"}
    assert table.snapshot("weekly", TS) == n  # never over what is there
    table.copy_previous("weekly", "2021-01-12 00:00:00")
    later = Predicate(">", ("2021-01-05T00:00:00Z",))
    assert table.scan(Predicate("=", ("weekly",)), later).count() == 2
    assert table.scan(start=later).count() == 4  # single ignores starts
    table.compact("weekly", "2021-01-04T00:00:00Z")
    assert table.scan().count() == 6
    table.drop("weekly", "2021-01-04T00:00:00Z")
    assert table.scan().count() == 4
    assert table.vacuum() == [] and len(table.vacuum(keep=1)) == 1 and table.scan().count() == 4  # copies name files, so only the rewritten slice had files of its own


def test_transactions(spark, table, tmp_path):
    rows = spark.createDataFrame([(1, 1, "a", 1)], SCHEMA)
    with pytest.raises(TransactionError):
        table.write(rows, "single", TS)
    table.begin()
    with pytest.raises(ValueError):
        table.begin()
    other = EntityTable(spark, str(tmp_path), "org1", "vulns", shards=2)
    other.begin()
    table.write(rows, "single", TS)
    other.write(rows, "single", TS)
    table.commit()
    with pytest.raises(TransactionError):
        other.commit()
    assert table.scan().count() == 1
    with pytest.raises(EntityIdTypeError):
        table.begin()
        table.write(spark.createDataFrame([(1.5, 1)], "entity_id double, _version long"), "single", TS)
    table.rollback()


def test_stream(spark, table, tmp_path):
    spark.createDataFrame([(1, 1, "write", 1), (2, 1, "write", 2)], "entity_id long, _version long, op string, vuln int").write.parquet(str(tmp_path / "in"))
    changes = spark.readStream.schema("entity_id long, _version long, op string, vuln int").parquet(str(tmp_path / "in"))
    q = upsert_stream(changes, table, "single", TS, str(tmp_path / "ck"))
    q.processAllAvailable()
    q.stop()
    assert sorted((r.entity_id, r.vuln) for r in table.scan().collect()) == [(1, 1), (2, 2)]


def test_consistency_and_dictionary(spark):
    a = spark.createDataFrame([(1, 2, 1), (2, 1, 1), (3, 1, 1)], "entity_id long, n_rows long, version long")
    b = spark.createDataFrame([(1, 3, 1), (2, 1, 2)], "entity_id long, n_rows long, version long")
    got = {(r.entity_id, r.why) for r in stats.consistency_violations({"a": a, "b": b}, "entity_id").collect()}
    assert got == {(1, "rows"), (2, "version"), (3, "missing")}
    values = spark.createDataFrame([(x,) for x in "c a b a".split()] + [(None,)], "v string")
    assert sorted((r.value, r.surrogate) for r in stats.dictionary(values, "v").collect()) == [("a", 2), ("b", 3), ("c", 4)]
