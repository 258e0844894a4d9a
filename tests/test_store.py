"""The table layer's catalog, write path and transactions, case by case."""

import datetime as dt
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from entitystore.functions import sharding
from entitystore.functions.predicates import Predicate, dictionary_test
from entitystore.functions.sharding import ShardId
from entitystore.operators import analyze, diff, stats
from entitystore.sources import table as store
from entitystore.sources.entities import Entity, frames
from entitystore.sources.manifest import Manifests, Token, TransactionError, check, new_token
from entitystore.sources.shared import shared_dir
from entitystore.sources.table import ConsistencyError, EntityTable
from entitystore.streaming.ingest import upsert_stream
from entitystore.types import ColumnId, EntityIdTypeError

TS = "2021-01-06 10:00:00"
WEEK = "2021-01-04T00:00:00Z"
SCHEMA = "entity_id long, _version long, name string, vuln int"


@pytest.fixture
def table(spark, tmp_path):
    return EntityTable(spark, str(tmp_path), "org1", "vulns", strategy=lambda c: F.pmod(c, F.lit(4)).cast("int"))


def put(spark, t, *rows, interval="single", ts=TS, schema=SCHEMA):
    t.begin()
    t.write(spark.createDataFrame(list(rows), schema), interval, ts)
    return t.commit()


def test_an_upsert_stages_the_shards_it_touches(spark, table):
    put(spark, table, *((i, 1, "n", i) for i in range(8)))
    before = {s["shard"]: s["xact"] for s in table.slices()}
    put(spark, table, (5, 2, "m", 50))
    after = {s["shard"]: s["xact"] for s in table.slices()}
    assert [k for k in range(4) if before[k] != after[k]] == [1]
    assert sorted((r.entity_id, r.vuln) for r in table.scan().collect()) == sorted([(i, i) for i in range(8) if i != 5] + [(5, 50)])
    assert table.manifests.children(f"{table.path}/xact={after[1]}/interval=single/interval_start=1970-01-01T00%3A00%3A00Z") == ["shard=1"]


def test_open_transactions_are_guarded(spark, table):
    put(spark, table, (1, 1, "a", 1))
    table.begin()
    table.write(spark.createDataFrame([(2, 1, "b", 2)], SCHEMA), "single", TS)
    for call in (lambda: table.snapshot("weekly", TS), lambda: table.copy_previous("weekly", TS), lambda: table.compact("single", "1970-01-01T00:00:00Z"), lambda: table.drop("single")):
        with pytest.raises(ValueError, match="under way"):
            call()
    table.commit()
    assert table.scan().count() == 2


def test_deletes_alone(spark, table):
    ids = spark.createDataFrame([(1, 5)], "entity_id long, _version long")
    table.begin()
    table.delete(ids, "single", TS)
    table.commit()
    assert table.scan().count() == 0 and not table.slices()
    put(spark, table, (1, 1, "a", 1), (2, 1, "b", 2))
    table.begin()
    table.delete(ids, "weekly", TS)  # no such bucket
    table.delete(ids, "single", TS)
    table.commit()
    assert [r.entity_id for r in table.scan().collect()] == [2] and {s["shard"] for s in table.slices()} == {2}


def test_entity_id_types(spark, table, tmp_path):
    put(spark, table, (1, 1, "a", 1))
    with pytest.raises(EntityIdTypeError):
        put(spark, table, ("x", 1, "a", 1), schema=SCHEMA.replace("entity_id long", "entity_id string"))
    text = EntityTable(spark, str(tmp_path), "org1", "texts")
    put(spark, text, ("x", 1, "a", 1), schema=SCHEMA.replace("entity_id long", "entity_id string"))
    with pytest.raises(EntityIdTypeError):
        put(spark, text, (1, 1, "a", 1))
    with pytest.raises(EntityIdTypeError):
        text.begin()
        text.delete(spark.createDataFrame([(1, 1)], "entity_id long, _version long"), "single", TS)
        text.commit()
    assert text.scan().count() == 1 and str(text.entity_id_column()) == "entity_id_S" and str(table.entity_id_column()) == "entity_id_L"
    with pytest.raises(TypeError, match="vuln"):
        put(spark, table, (5, 1, "a", "text"), schema=SCHEMA.replace("vuln int", "vuln string"))
    assert table.scan().count() == 1


def test_manifests_are_published_whole_and_once(spark, tmp_path):
    m = Manifests(spark, str(tmp_path / "t"))
    m.publish(1, {"slices": [1]})
    with pytest.raises(TransactionError):
        m.publish(1, {"slices": [2]})
    assert m.read(1) == {"slices": [1]} and m.children(m.path) == ["0000000001.json"]
    token = new_token({"current": "a", "currentTime": 5})
    assert Token.parse(str(token)) == token and token.baseline == "a"
    check(token, {"current": "a"})
    for before in ({"current": "b"}, {"current": "a", "previous": token.target}):
        with pytest.raises(TransactionError):
            check(token, before)


def test_partial_columns_of_a_stored_entity(spark, table):
    put(spark, table, (1, 1, "a", 1), (2, 1, "b", 2))
    short = "entity_id long, _version long, vuln int"
    put(spark, table, (9, 1, 9), schema=short)  # a new entity may lack a column
    assert table.entity(9).first()["name"] is None
    with pytest.raises(ConsistencyError):
        put(spark, table, (1, 2, 7), schema=short)
    report = spark.read.parquet(*table.errors()).collect()
    assert [(r.entity_id, r.shard, r.version) for r in report] == [(1, 1, 2)]
    assert table.entity(1).first()["vuln"] == 1
    put(spark, table, (1, 0, 7), schema=short)  # stale, so it wins nothing
    assert table.entity(1).first()["vuln"] == 1


def test_empty_entities_and_built_ones(spark, table):
    columns = [ColumnId("name", "S"), ColumnId("vuln", "I")]
    entities = [Entity.of(3, 1, columns, ["a", 1, "b", None]), Entity(1, 1, columns), Entity(2, 4, columns).add("c", 5)]
    assert entities[0].value(2, 1) == "b" and entities[0].column("vuln") == [1, None] and entities[1].column("name") == [None]
    for wrong in (lambda: Entity.of(1, 1, columns, [1, 2, 3]), lambda: entities[1].add(1), lambda: frames(spark, [Entity("x", 1, columns), Entity(1, 1, columns)])):
        with pytest.raises((ValueError, EntityIdTypeError)):
            wrong()
    with pytest.raises(IndexError):
        entities[0].value(0, 1)
    rows, empty = frames(spark, entities)
    table.begin()
    table.write(rows, "single", TS, empty=empty)
    table.commit()
    assert sorted(map(str, ((r.entity_id, r["name"], r.vuln) for r in table.scan().collect()))) == sorted(map(str, [(3, "a", 1), (3, "b", None), (1, None, None), (2, "c", 5)]))


def test_catalog(spark, table, tmp_path):
    assert not table.exists() and table.create() == 1 and table.create() == 1 and table.exists()
    rows = spark.createDataFrame([(1, 1, "a", 1, "2021-01-06 10:00:00"), (2, 1, "b", 2, "2021-01-13 00:00:00"), (6, 1, "c", 3, "2021-01-13 00:00:00")], SCHEMA + ", at string")
    table.begin()
    table.write(rows.withColumn("at", F.col("at").cast("timestamp")), "weekly", F.col("at"))
    table.write(rows.select("entity_id", "_version", "vuln").withColumnRenamed("vuln", "other"), "single", TS)
    table.commit()
    assert table.intervals() == ["single", "weekly"] and table.interval_starts("weekly") == [WEEK, "2021-01-11T00:00:00Z"]
    assert table.interval_starts("weekly", Predicate(">", (dt.datetime(2021, 1, 4),))) == ["2021-01-11T00:00:00Z"]
    assert table.interval_starts("weekly", Predicate(">=", (dt.datetime(2021, 1, 4, 1, tzinfo=dt.timezone(dt.timedelta(hours=1))),))) == [WEEK, "2021-01-11T00:00:00Z"]
    assert table.scan(Predicate("=", ("WEEKLY",), ignore_case=True), Predicate("<=", (dt.date(2021, 1, 4),))).count() == 1
    assert table.find_shards("weekly", dt.datetime(2021, 1, 14)) == [2] and table.find_shards("weekly", "2030-01-01") == []
    assert table.find_shards("single", TS, "vul") == [] and table.find_shards("single", TS, "other") == [1, 2]
    assert table.has("weekly", WEEK, 1, "vuln") and not table.has("weekly", WEEK, 2) and not table.has("daily")
    one = ShardId("org1", "vulns", "weekly", WEEK, 1)
    assert table.shard_exists(one) and ShardId.parse(f"/x/{one.path()}") == one and table.find_shard_id("weekly", TS, 5) == one
    assert [str(c) for c in table.column_ids("single", TS)] == ["entity_id_L", "other_I"] and str(table.column_id("NAME")) == "name_S" and table.column_id("nam") is None
    assert table.shard_metadata("weekly", "2021-01-13", ["vuln"]).first().asDict()["max_value"] == 3.0
    assert [r.vuln for r in table.scan_column("vuln", Predicate("=", ("weekly",)), limit=2).collect()] == [1, 2] and table.fixed_column("t", 7).distinct().count() == 3
    assert store.table_exists(spark, str(tmp_path), "org1", "vulns")
    store.drop_table(spark, str(tmp_path), "org1", "vulns")
    assert store.tables(spark, str(tmp_path), "org1") == []
    store.drop_tenant(spark, str(tmp_path), "org1")
    assert store.tenants(spark, str(tmp_path)) == []
    with pytest.raises(ValueError):
        ShardId.parse("a/b")


def test_copies_share_files(spark, table):
    put(spark, table, (1, 1, "a", 1), (2, 1, "b", 2))
    table.snapshot("weekly", TS)
    to = ShardId("org1", "vulns", "weekly", "2021-01-18T00:00:00Z", 3)
    source = table.shard_ids(Predicate("=", ("weekly",)))[0]
    n = table.copy_shard(to, source)
    assert table.copy_shard(to, source) == n and table.copy_shard(source, source) == n
    got = {(r.interval, r.interval_start, r.shard, r.entity_id) for r in table.scan(Predicate("=", ("weekly",))).collect()}
    assert got == {("weekly", WEEK, 1, 1), ("weekly", WEEK, 2, 2), ("weekly", to.start, 3, 1)}
    assert len([d for d in table.manifests.children(table.path) if d.startswith("xact=")]) == 1
    put(spark, table, (1, 2, "z", 9), interval="weekly")  # a copy is written anew, its source stays
    assert table.entity(1, Predicate("=", ("single",))).first()["name"] == "a" and table.entity(1, Predicate("=", ("weekly",)), Predicate("=", (WEEK,))).first()["name"] == "z"
    assert table.vacuum(keep=1) == [] and table.scan().count() == 5
    assert table.compact("weekly", WEEK, trigger=50) == table.manifests.latest()[0]  # a file a slice: nothing to save
    assert table.fragmentation("weekly", WEEK) == {1: 0, 2: 0}


def test_stream_order(spark, table, tmp_path):
    schema = "entity_id long, _version long, op string, name string, vuln int, nth int"
    rows = [(1, 1, "write", "a", 1, 0), (1, 1, "delete", None, None, 1), (1, 1, "write", "b", 2, 2), (2, 1, "write", "c", 3, 3), (2, 1, "delete", None, None, 4), (3, 2, "write", "x", 1, 5), (3, 2, "write", "y", 2, 5)]
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    q = upsert_stream(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), table, "single", TS, str(tmp_path / "ck"), position="nth")
    q.processAllAvailable()
    q.stop()
    assert sorted((r.entity_id, r["name"]) for r in table.scan().collect()) == [(1, "b"), (3, "x"), (3, "y")]


def test_capture(spark, tmp_path):
    t = EntityTable(spark, str(tmp_path), "org1", "logged", capture=F.col("_version") > 1, retain=2)
    for v in (1, 2, 3, 4):
        put(spark, t, (1, v, "a", v))
    assert sorted(r.request[:30] for r in t.captured().collect()) == [f'{{"entity_id":1,"_version":{v},"n' for v in (2, 3, 4)]
    assert len(t.manifests.numbers()) == 2
    assert t.clean_capture(dt.date(2000, 1, 1)) == [] and len(t.clean_capture(dt.date(2999, 1, 1))) == 1
    assert store.tables(spark, str(tmp_path), "org1") == ["logged"]
    r = t.manifests.latest()[1]["record"]
    assert r["previous"] and r["currentTime"] >= r["previousTime"]


def test_compare_tells_values_apart(spark):
    a = spark.createDataFrame([(1, "a,b"), (2, None), (3, "x"), (3, None), (4, "q")], "k long, v string")
    b = spark.createDataFrame([(1, "a"), (1, "b"), (2, "null"), (3, None), (3, "x"), (5, "n")], "k long, v string")
    got = {r.k: (r.change, r.before_values, r.after_values) for r in diff.compare(a, b, "k", "v").collect()}
    assert got == {1: ("changed", "a,b", "a,b"), 2: ("changed", "null", "null"), 4: ("removed", "q", None), 5: ("added", None, "n")}
    seen = diff.traverse(spark.createDataFrame([(1, 1, "x"), (1, 2, None), (1, 3, "y")], "k long, i int, v string"), "k", "v", ["i"]).first()
    assert seen["values"] == ["x", None, "y"] and seen["nulls"] == [2]


def test_string_hash_of_any_text(spark):
    def java(s):
        h, b = 0, s.encode("utf-16-be")
        for i in range(0, len(b), 2):
            h = (h * 31 + int.from_bytes(b[i : i + 2])) & 0xFFFFFFFF
        return h - 2**32 if h >= 2**31 else h

    words = ["", "a", "entity-12345", "ünï", "漢字", "🙂", "a🙂b𝒳", "x" * 50]
    got = spark.createDataFrame([(w,) for w in words], "w string").select(sharding.string_hash(F.col("w"))).collect()
    assert [r[0] for r in got] == [java(w) for w in words]


def test_dictionary_predicate(spark):
    rows = spark.createDataFrame([(1, "x"), (1, "y"), (1, None), (2, "x"), (3, None)], "shard int, v string")

    def passes(p):
        return {r.shard: r.passes for r in stats.dictionary_passes(rows, "v", p).collect()}

    assert passes(Predicate("!=", ("x",))) == {1: True, 2: False, 3: False}
    assert passes(Predicate("!=", ("x",), strict=True)) == {1: False, 2: False, 3: True}
    assert passes(Predicate("not_null")) == {1: True, 2: True, 3: False} and passes(Predicate("is_null")) == {1: None, 2: None, 3: None}
    assert spark.range(1).select(dictionary_test(F.array(F.lit("b")), Predicate(">", ("a",)))).first()[0] is True


def test_dump_and_order(spark):
    rows = spark.createDataFrame([(0, 1, 1, "b", 1), (0, 1, 1, None, 2), (1, 3, 2, "a", 1)], "shard int, entity_id long, _version long, v string, i int")
    got = {(r.shard, r.kind): r.json for r in analyze.dump(rows, "entity_id", "_version", ["v"], ["i"]).collect() if r.kind != "dictionary"}
    assert '"values":["b",null]' in got["0", "entity"] and '"version":2' in got["1", "summary"] and '"type":"S"' in got["0", "metadata"]
    order = spark.createDataFrame([(i % 2, i) for i in range(20) for _ in range(1 + i % 3)], "shard int, e long")
    want = {(s, e): n + 1 for s in (0, 1) for n, e in enumerate(sorted((x for x in range(20) if x % 2 == s), key=lambda x: (x % 3, x)))}
    assert {(r.shard, r.e): r.place for r in stats.entity_order(order, "e").collect()} == want


def test_shared_folder():
    def session(master, d=None):
        return SimpleNamespace(conf=SimpleNamespace(get=lambda *_: d), sparkContext=SimpleNamespace(master=master, getConf=lambda: {}))

    assert shared_dir(session("yarn", "hdfs://x/y/")) == "hdfs://x/y" and shared_dir(session("local[4]"))
    for master in ("yarn", "local-cluster[3,2,1024]", "spark://host:7077"):
        with pytest.raises(ValueError, match="checkpoint"):
            shared_dir(session(master))


def test_a_write_sorts_no_rows(spark, table):
    def plans():
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        ran = spark._jsparkSession.sharedState().statusStore().executionsList()
        return [x for x in (ran.apply(i).physicalPlanDescription() for i in range(ran.size())) if "InsertIntoHadoopFsRelationCommand" in x and table.path in x]

    put(spark, table, *((i, 1, "n", i) for i in range(40)))
    table.compact("single", "1970-01-01T00:00:00Z")
    assert len(plans()) == 2 and not any("Sort" in x for x in plans())
    assert sorted(r.vuln for r in table.scan().collect()) == list(range(40))


def test_a_task_writes_more_slices_than_it_keeps_open(spark, tmp_path, monkeypatch):
    name, opened = "spark.sql.maxConcurrentOutputFileWriters", []
    before, t = spark.conf.get(name), EntityTable(spark, str(tmp_path), "org1", "t", strategy=lambda c: F.pmod(c, F.lit(7)).cast("int"))
    monkeypatch.setattr(store, "WRITERS", 2)
    read = spark.range(70).select(F.col("id").alias("entity_id"), F.lit(1).alias("_version"), F.timestamp_seconds(F.lit(1609459200) + F.col("id") % 5 * 604800).alias("at"))
    t.begin()
    t.write(read, "weekly", F.col("at"))
    put_, t._put = t._put, lambda *a: (put_(*a), opened.append(spark.conf.get(name)))[0]
    t.commit()
    assert opened == [before] == [spark.conf.get(name)]
    got = t.scan().collect()
    assert sorted(r.entity_id for r in got) == list(range(70)) and len(t.slices()) == 35 and all(r.shard == r.entity_id % 7 for r in got)


def folded(spark, monkeypatch, fill, base, shards=4):
    """Rows of a table filled by one commit, whether it was folded, and the plan that was written."""
    t, calls, plans = EntityTable(spark, str(base), "org1", "t", strategy=lambda c: F.pmod(c, F.lit(shards)).cast("int")), [], []
    live, write = store.fold.live, t._write
    monkeypatch.setattr(store.fold, "live", lambda *a: (calls.append(1), live(*a))[1])
    t._write = lambda out, *a: (plans.append(out._jdf.queryExecution().executedPlan().toString()), write(out, *a))[1]
    t.begin()
    fill(t)
    t.commit()
    monkeypatch.setattr(store.fold, "live", live)
    rows = t.scan().drop("_instance_id")
    return sorted(map(str, rows.select(*sorted(rows.columns)).collect())), bool(calls), "".join(plans)


A, B = [(i, 1, "a", i) for i in range(0, 12)], [(i, 1, "b", i) for i in range(12, 24)]
FILLS = {
    "one version": (False, [("single", A), ("weekly", A)]),
    "two calls for other entities": (False, [("single", A), ("single", B)]),
    "a version a shard": (False, [("single", [(i, i % 4, n, v) for i, _, n, v in A])]),
    "a version an entity": (False, [("single", [(i, i, n, v) for i, _, n, v in A + A])]),
    "a null id": (False, [("single", [*A, (None, 1, "n", 1)])]),
    "two versions of an entity": (True, [("single", [*A, (3, 2, "c", 7)])]),
    "two calls for an entity": (True, [("single", A), ("single", [*B, (3, 1, "c", 7)])]),
    "two calls, the first one later": (True, [("single", [(3, 5, "c", 7)]), ("single", A)]),
    "a null version": (True, [("single", [*A, (3, None, "c", 7)])]),
    "null versions only": (True, [("single", [(3, None, "c", 7)])]),
}


@pytest.mark.parametrize("name", FILLS)
def test_only_rivals_are_folded(spark, tmp_path, monkeypatch, name):
    expected, calls = FILLS[name]

    def fill(t):
        for interval, rows in calls:
            t.write(spark.createDataFrame(rows, SCHEMA), interval, TS)

    rows, was, plan = folded(spark, monkeypatch, fill, tmp_path / "a")
    assert was == expected and (was or not any(x in plan for x in ("Join", "Sort")))
    monkeypatch.setattr(EntityTable, "_lone", lambda *a: False)
    assert folded(spark, monkeypatch, fill, tmp_path / "b")[:2] == (rows, True)


def test_changes_and_deletes_are_folded(spark, tmp_path, monkeypatch):
    ops = "entity_id long, _version long, vuln int, op string, position long"

    def of(rows):
        return folded(spark, monkeypatch, lambda t: t.change(spark.createDataFrame(rows, ops), "single", TS), tmp_path / str(len(rows)))[:2]

    assert of([(1, 1, 1, "write", 0)])[1] is False
    assert of([(1, 1, 1, "write", 0), (1, 1, 2, "write", 1)]) == (["Row(_version=1, entity_id=1, interval='single', interval_start='1970-01-01T00:00:00Z', shard=1, vuln=2)"], True)
    assert of([(1, 1, 1, "write", 0), (2, 1, 2, "write", 1), (2, 1, None, "delete", 2)]) == (["Row(_version=1, entity_id=1, interval='single', interval_start='1970-01-01T00:00:00Z', shard=1, vuln=1)"], True)


def test_one_shuffle_without_constants(spark, tmp_path, monkeypatch):
    plans = folded(spark, monkeypatch, lambda t: t.write(spark.createDataFrame(A, SCHEMA), "single", TS), tmp_path)[2]
    assert "Join" not in plans and "_instance_id" not in plans and "xact" not in plans
    monkeypatch.undo()
    t = EntityTable(spark, str(tmp_path), "org1", "t")
    assert [(r["shard"], r["vuln"]) for r in t.scan_column("vuln").orderBy("vuln").collect()] == [(i % 4, i) for i in range(12)]
    assert {r[0] for r in t.scan().select("_instance_id").collect()} == {t.slices()[0]["xact"]}


def test_a_column_that_some_shards_have_needs_no_fold(spark, tmp_path, monkeypatch):
    def fill(t):
        t.write(spark.createDataFrame(A, SCHEMA).drop("name"), "single", TS)
        t.write(spark.createDataFrame([(i, 1, "b", i) for i in range(13, 30, 4)], SCHEMA), "single", TS)

    assert folded(spark, monkeypatch, fill, tmp_path)[1] is False
    monkeypatch.undo()
    t = EntityTable(spark, str(tmp_path), "org1", "t")
    assert t.find_shards("single", TS, "name") == [1] and t.find_shards("single", TS, "vuln") == [0, 1, 2, 3]
    assert sorted(str(r["name"]) for r in t.scan().collect()) == ["None"] * 12 + ["b"] * 5
