"""Every operator of the table layer as a query over the driver's tables, beside equal SQL."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import fixtures
from .functions import intervals, sharding
from .functions import predicates as P
from .functions.predicates import Predicate
from .operators import analyze, diff, stats
from .plans import fold
from .sources import table as store

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
SHARDS = 10


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def shard(c, n: int = SHARDS):
    return sharding.modulo(n)(F.col(c))


def jshard(c: str, n: int = SHARDS) -> str:
    """SQL: the same shard number."""
    h = f"list_reduce(list_transform(string_split(CAST({c} AS VARCHAR), ''), lambda c: CAST(ord(c) AS BIGINT)), lambda a, x: (a * 31 + x) & 4294967295)"
    return f"CAST(abs((CASE WHEN {h} >= 2147483648 THEN {h} - 4294967296 ELSE {h} END) % {n}) AS INTEGER)"


def iso(e: str) -> str:
    return f"strftime({e}, '%Y-%m-%dT%H:%M:%SZ')"


# -- fixtures -----------------------------------------------------------------------------------


def ev(spark, d):
    """Events as a log of changes by user."""
    e = read(spark, d, "events")
    op = F.when(F.col("event_type") == "error", "delete").otherwise("write")
    return e.select(F.col("user_id").alias("entity_id"), F.col("event_id").alias("version"), F.col("event_id").alias("pos"), op.alias("op"), "event_type", "value", "ts")


EV = "ev AS (SELECT user_id AS entity_id, event_id AS version, event_id AS pos, CASE WHEN event_type = 'error' THEN 'delete' ELSE 'write' END AS op, event_type, value, ts FROM events)"


def evd(spark, d):
    """Events as one write of rows per user and day, the day as version."""
    e = read(spark, d, "events")
    return e.select(F.col("user_id").alias("entity_id"), F.datediff(F.col("ts").cast("date"), F.lit("2024-01-01").cast("date")).cast("bigint").alias("version"), "event_id", "event_type", "value")


EVD = "evd AS (SELECT user_id AS entity_id, CAST(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS BIGINT) AS version, event_id, event_type, value FROM events)"


def li(spark, d):
    rows = read(spark, d, "lineitem")
    return rows.withColumnRenamed("l_orderkey", "entity_id").withColumn("shard", F.pmod("entity_id", F.lit(SHARDS)).cast("int"))


LI = "li AS (SELECT l_orderkey AS entity_id, CAST(l_orderkey % 10 AS INTEGER) AS shard, * EXCLUDE (l_orderkey) FROM lineitem)"


WEEKS = ("2024-01-01T00:00:00Z", "2024-01-08T00:00:00Z")


def day(spark, d, n):
    """The events of one day's slices, by user."""
    return fixtures.events(spark, d).scan(Predicate("=", ("daily",)), Predicate("=", (WEEKS[n],))).withColumnRenamed("user_id", "entity_id")


W = f"{EV}, w1 AS (SELECT * FROM ev WHERE {iso("date_trunc('day', ts)")} = '{WEEKS[0]}'), w2 AS (SELECT * FROM ev WHERE {iso("date_trunc('day', ts)")} = '{WEEKS[1]}')"


def buckets(spark, d, interval="weekly"):
    """Slices that the events make: interval, its start, shard."""
    e = read(spark, d, "events")
    return e.select(F.lit(interval).alias("interval"), intervals.start(interval, F.col("ts")).alias("interval_start"), shard("user_id").alias("shard"), "event_id", "user_id", "value")


def sbuckets(interval="weekly", unit="week") -> str:
    return f"b AS (SELECT '{interval}' AS interval, {iso(f"date_trunc('{unit}', ts)")} AS interval_start, {jshard('user_id')} AS shard, event_id, user_id, value FROM events)"


def slices(spark, d):
    """Slices of three intervals: weekly, daily and single."""
    made = [buckets(spark, d, i).select("interval", "interval_start", "shard").distinct() for i in ("weekly", "daily", "single")]
    return made[0].unionByName(made[1]).unionByName(made[2])


SLICES = f"""{sbuckets()}, dd AS (SELECT 'daily' AS interval, {iso("date_trunc('day', ts)")} AS interval_start, {jshard('user_id')} AS shard FROM events),
s AS (SELECT DISTINCT interval, interval_start, shard FROM b UNION ALL SELECT DISTINCT interval, interval_start, shard FROM dd UNION ALL SELECT DISTINCT 'single', '1970-01-01T00:00:00Z', shard FROM b)"""

# -- scans --------------------------------------------------------------------------------------

LI_COLUMNS = ("entity_id", "shard", "l_partkey", "l_quantity", "l_shipdate")
LI_LIST = ", ".join(LI_COLUMNS)


def listed(spark: SparkSession, values: list, name: str, kind: str = "string") -> DataFrame:
    """A catalog's answer as rows."""
    return spark.createDataFrame([(v,) for v in values], f"{name} {kind}")


query("scan_table", f"WITH {LI} SELECT {LI_LIST} FROM li")(lambda s, d: fixtures.lineitem(s, d).scan().select(*LI_COLUMNS))
query("scan_column_shard", f"WITH {LI} SELECT l_partkey FROM li WHERE shard = 3")(lambda s, d: fixtures.lineitem(s, d).scan_column("l_partkey", shard=3).select("l_partkey"))
query("scan_column_limit", "SELECT o_totalprice FROM orders ORDER BY o_orderkey LIMIT 100")(lambda s, d: fixtures.orders(s, d).scan_column("o_totalprice", limit=100).select("o_totalprice"))
query("scan_column_all_shards", f"WITH {LI} SELECT shard, l_suppkey FROM li")(lambda s, d: fixtures.lineitem(s, d).scan_column("l_suppkey"))


@query("scan_batches", f"WITH {LI} SELECT shard, CAST(sum(l_linenumber) AS BIGINT) AS total, count(*) AS n FROM li GROUP BY shard")
def scan_batches(spark, d):
    def run(batches):  # batches as Arrow hands them over
        import pyarrow as pa

        for b in batches:
            t = pa.Table.from_batches([b]).group_by("shard").aggregate([("l_linenumber", "sum"), ("l_linenumber", "count")])
            yield from t.rename_columns(["shard", "total", "n"]).to_batches()

    got = fixtures.lineitem(spark, d).scan().select("shard", "l_linenumber").mapInArrow(run, "shard int, total long, n long")
    return got.groupBy("shard").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))


query("entity_lookup", f"WITH {LI} SELECT {LI_LIST} FROM li WHERE entity_id = 7")(lambda s, d: fixtures.lineitem(s, d).entity(7).select(*LI_COLUMNS))
query("entity_lookup_many", f"WITH {LI} SELECT {LI_LIST} FROM li WHERE entity_id IN (1, 12, 123, 1234)")(lambda s, d: fixtures.lineitem(s, d).entities([1, 12, 123, 1234]).select(*LI_COLUMNS))
HAS = "entity_id % 3 = 0 AND entity_id % 10 < 4"
query("null_fill_missing_column", f"WITH {LI} SELECT entity_id, l_linenumber, CASE WHEN {HAS} THEN 'p' || CAST(l_linenumber AS VARCHAR) END AS priority FROM li")(lambda s, d: fixtures.varied(s, d).scan().select("entity_id", "l_linenumber", "priority"))
query("fixed_value_column", "SELECT o_orderkey, 'org1' AS tenant FROM orders")(lambda s, d: fixtures.orders(s, d).fixed_column("tenant", "org1"))

# -- catalog ------------------------------------------------------------------------------------

query("list_tenants", "SELECT DISTINCT CASE WHEN user_id % 2 = 0 THEN 'org1' ELSE 'org2' END AS tenant FROM events")(lambda s, d: listed(s, store.tenants(s, fixtures.registry(s, d)), "tenant"))
query("list_tables", "SELECT DISTINCT event_type AS table_name FROM events WHERE user_id % 2 = 0")(lambda s, d: listed(s, store.tables(s, fixtures.registry(s, d), "org1"), "table_name"))
query("list_intervals", f"WITH {SLICES} SELECT DISTINCT interval FROM s")(lambda s, d: listed(s, fixtures.events(s, d).intervals(), "interval"))
query("list_interval_starts", f"WITH {SLICES} SELECT DISTINCT interval_start FROM s WHERE interval = 'weekly'")(lambda s, d: listed(s, fixtures.events(s, d).interval_starts("weekly"), "interval_start"))
query("interval_starts_pred", f"WITH {SLICES} SELECT DISTINCT interval_start FROM s WHERE interval = 'weekly' AND interval_start >= '{WEEKS[1]}'")(lambda s, d: listed(s, fixtures.events(s, d).interval_starts("weekly", Predicate(">=", (dt.datetime(2024, 1, 8),))), "interval_start"))
query("find_shards", f"WITH {SLICES} SELECT DISTINCT shard FROM s WHERE interval = 'weekly' AND interval_start = '{WEEKS[0]}'")(lambda s, d: listed(s, fixtures.events(s, d).find_shards("weekly", "2024-01-03 10:00:00"), "shard", "int"))
query("find_shards_with_column", f"WITH {LI} SELECT DISTINCT shard FROM li WHERE {HAS}")(lambda s, d: listed(s, fixtures.varied(s, d).find_shards("single", "2024-01-01", "priority"), "shard", "int"))


def shard_rows(spark: SparkSession, ids: list) -> DataFrame:
    return spark.createDataFrame([(x.interval, x.start, x.shard) for x in ids], "interval string, interval_start string, shard int")


query("find_shards_interval", f"WITH {SLICES} SELECT interval_start, shard FROM s WHERE interval = 'daily'")(lambda s, d: shard_rows(s, fixtures.events(s, d).shard_ids(Predicate("=", ("daily",)))).drop("interval"))
query("find_shards_start_pred", f"WITH {SLICES} SELECT interval, interval_start, shard FROM s WHERE interval = 'single' OR (interval = 'weekly' AND interval_start >= '{WEEKS[1]}')")(
    lambda s, d: shard_rows(s, fixtures.events(s, d).shard_ids(Predicate("in", ("single", "weekly")), Predicate(">=", (dt.datetime(2024, 1, 8),))))
)
query("find_shards_two_preds", f"WITH {SLICES} SELECT interval, interval_start, shard FROM s WHERE interval IN ('weekly', 'daily') AND interval_start BETWEEN '{WEEKS[0]}' AND '{WEEKS[1]}'")(
    lambda s, d: shard_rows(s, fixtures.events(s, d).shard_ids(Predicate("in", ("weekly", "daily")), Predicate("between", WEEKS)))
)
query("list_columns", "SELECT unnest(['event_id', 'event_type', 'props', 'ts', 'user_id', 'value']) AS column_name")(lambda s, d: listed(s, [c.name for c in fixtures.events(s, d).column_ids()], "column_name"))
query("column_by_name", "SELECT 'value_D' AS column_id UNION ALL SELECT 'user_id_L'")(lambda s, d: listed(s, [str(fixtures.events(s, d).column_id("VALUE")), str(fixtures.events(s, d).entity_id_column())], "column_id"))


@query("existence", f"WITH {SLICES} SELECT count(*) FILTER (WHERE interval = 'weekly') > 0 AS has_interval, count(*) FILTER (WHERE interval = 'weekly' AND interval_start = '{WEEKS[1]}') > 0 AS has_start, count(*) FILTER (WHERE interval = 'weekly' AND shard = 99) > 0 AS has_shard, false AS has_column FROM s")
def existence(spark, d):
    t = fixtures.events(spark, d)
    return spark.createDataFrame([(t.has("weekly"), t.has("weekly", WEEKS[1]), t.has("weekly", shard=99), t.has("weekly", column="valu"))], "has_interval boolean, has_start boolean, has_shard boolean, has_column boolean")


@query("find_shard_of_entity", f"SELECT {jshard('50')} AS shard")
def find_shard(spark, d):
    return listed(spark, [fixtures.events(spark, d).find_shard_id("weekly", "2024-01-03", 50).shard], "shard", "int")


query("shard_path", f"WITH {SLICES} SELECT 'org1/events/' || interval || '/' || interval_start || '/' || CAST(shard AS VARCHAR) AS path FROM s")(lambda s, d: slices(s, d).select(sharding.shard_path(F.lit("org1"), F.lit("events"), F.col("interval"), F.col("interval_start"), F.col("shard")).alias("path")))

# -- predicates ---------------------------------------------------------------------------------

T1, T2 = dt.datetime(2024, 1, 5), dt.datetime(2024, 1, 12)
NULLED = "CASE WHEN event_type <> 'view' THEN event_type END"
_num, _str, _ts, _day = "value", "event_type", "ts", "date_trunc('day', ts)"
PREDICATES = {
    "pred_num_eq": ("user_id", ("=", (50,)), "user_id = 50"), "pred_str_eq": (_str, ("=", ("click",)), "event_type = 'click'"), "pred_ts_eq": (_day, ("=", (T1,)), "date_trunc('day', ts) = TIMESTAMP '2024-01-05'"),
    "pred_num_ne": (_num, ("!=", (50.0,)), "value <> 50.0"), "pred_str_ne": (_str, ("!=", ("click",)), "event_type <> 'click'"), "pred_ts_ne": (_ts, ("!=", (T1,)), "ts <> TIMESTAMP '2024-01-05'"),
    "pred_num_ne_set": ("user_id", ("!=", (1, 2, 3)), "user_id NOT IN (1, 2, 3)"),
    "pred_num_gt": (_num, (">", (50,)), "value > 50"), "pred_num_ge": (_num, (">=", (50,)), "value >= 50"), "pred_num_lt": (_num, ("<", (50,)), "value < 50"), "pred_num_le": (_num, ("<=", (50,)), "value <= 50"),
    "pred_str_gt": (_str, (">", ("error",)), "event_type > 'error'"), "pred_str_ge": (_str, (">=", ("error",)), "event_type >= 'error'"), "pred_str_lt": (_str, ("<", ("error",)), "event_type < 'error'"), "pred_str_le": (_str, ("<=", ("error",)), "event_type <= 'error'"),
    "pred_ts_gt": (_ts, (">", (T1,)), "ts > TIMESTAMP '2024-01-05'"), "pred_ts_ge": (_ts, (">=", (T1,)), "ts >= TIMESTAMP '2024-01-05'"), "pred_ts_lt": (_ts, ("<", (T1,)), "ts < TIMESTAMP '2024-01-05'"), "pred_ts_le": (_ts, ("<=", (T1,)), "ts <= TIMESTAMP '2024-01-05'"),
    "pred_num_between": (_num, ("between", (20, 60)), "value BETWEEN 20 AND 60"), "pred_ts_between": (_ts, ("between", (T1, T2)), "ts BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-12'"), "pred_str_between": (_str, ("between", ("d", "q")), "event_type BETWEEN 'd' AND 'q'"),
    "pred_num_in": ("user_id", ("in", (1, 5, 9)), "user_id IN (1, 5, 9)"), "pred_str_in": (_str, ("in", ("click", "view")), "event_type IN ('click', 'view')"), "pred_ts_in": (_day, ("in", (T1, T2)), "date_trunc('day', ts) IN (TIMESTAMP '2024-01-05', TIMESTAMP '2024-01-12')"),
}


def _predicate(name: str, column: str, args: tuple, sql: str) -> None:
    query(name, f"SELECT event_id FROM events WHERE {sql}")(lambda s, d: read(s, d, "events").where(Predicate(*args).column(F.expr(column))).select("event_id"))


for _name, _spec in PREDICATES.items():
    _predicate(_name, *_spec)
query("pred_is_null", f"SELECT event_id FROM events WHERE ({NULLED}) IS NULL")(lambda s, d: read(s, d, "events").where(Predicate("is_null").column(F.expr(NULLED))).select("event_id"))
query("pred_not_null", f"SELECT event_id FROM events WHERE ({NULLED}) IS NOT NULL")(lambda s, d: read(s, d, "events").where(Predicate("not_null").column(F.expr(NULLED))).select("event_id"))
query("pred_str_ci", "SELECT event_id FROM events WHERE lower(event_type) = 'click'")(lambda s, d: read(s, d, "events").where(Predicate("=", ("CLICK",), ignore_case=True).column(F.col("event_type"))).select("event_id"))

ZONES = f"{LI}, z AS (SELECT shard, min(CAST(l_extendedprice AS DOUBLE)) AS min_value, max(CAST(l_extendedprice AS DOUBLE)) AS max_value FROM li GROUP BY shard)"
for _name, _test, _sql in (
    ("zone_may_contain", lambda: P.may_contain(5000.0, F.col("min_value"), F.col("max_value")), "min_value <= 5000 AND max_value >= 5000"),
    ("zone_may_gt", lambda: P.may_exceed(104000.0, F.col("max_value")), "max_value >= 104000"),
    ("zone_may_lt", lambda: P.may_fall_below(905.0, F.col("min_value")), "min_value <= 905"),
):
    query(_name, f"WITH {ZONES} SELECT shard FROM z WHERE {_sql}")(lambda s, d, t=_test: stats.zone_map(li(s, d), "l_extendedprice").where(t()).select("shard"))
for _name, _op, _sql in (
    ("dict_pred_eq", ("=", ("R",)), "l_returnflag = 'R'"), ("dict_pred_ne", ("!=", ("R",)), "l_returnflag <> 'R'"), ("dict_pred_between", ("between", ("B", "P")), "l_returnflag BETWEEN 'B' AND 'P'"), ("dict_pred_gt", (">", ("N",)), "l_returnflag > 'N'"),
):
    query(_name, f"WITH {LI} SELECT shard, bool_or({_sql}) AS passes FROM li GROUP BY shard")(lambda s, d, o=_op: stats.dictionary_passes(li(s, d), "l_returnflag", Predicate(*o)))

# -- intervals and shards -----------------------------------------------------------------------


def _interval(name: str, made: Callable, sql: str) -> None:
    query(name, f"SELECT event_id, {sql} AS interval_start FROM events")(lambda s, d: read(s, d, "events").select("event_id", made(F.col("ts")).alias("interval_start")))


for _name, _unit in intervals.UNITS.items():
    _interval(f"interval_{_name}", lambda c, n=_name: intervals.start(n, c), iso(f"date_trunc('{_unit}', ts)"))
_interval("interval_single", lambda c: intervals.start("single", c), "'1970-01-01T00:00:00Z'")
_interval("interval_fixed_12h", lambda c: intervals.fixed_start(43_200_000, c), iso("make_timestamp((epoch_ms(ts) // 43200000) * 43200000000)"))
_interval("interval_offset_prev", lambda c: intervals.start("monthly", c, -1), iso("date_trunc('month', ts) - INTERVAL 1 MONTH"))
_interval("interval_offset_next", lambda c: intervals.start("weekly", c, 1), iso("date_trunc('week', ts) + INTERVAL 7 DAY"))
query("shard_shift", f"WITH {sbuckets()} SELECT DISTINCT shard, interval_start, {iso('CAST(interval_start AS TIMESTAMP) - INTERVAL 7 DAY')} AS previous FROM b")(lambda s, d: buckets(s, d).select("shard", "interval_start").distinct().withColumn("previous", intervals.shift("weekly", F.col("interval_start"), -1)))
query("shard_assign_int", f"SELECT DISTINCT user_id, {jshard('user_id')} AS shard FROM events")(lambda s, d: read(s, d, "events").select("user_id").distinct().withColumn("shard", shard("user_id")))
query("shard_assign_str", f"SELECT c_name, {jshard('c_name')} AS shard FROM customer")(lambda s, d: read(s, d, "customer").select("c_name", shard("c_name").alias("shard")))
query("shard_partition_counts", f"SELECT shard, count(*) AS n FROM (SELECT {jshard('c_name')} AS shard FROM customer) GROUP BY shard")(lambda s, d: read(s, d, "customer").groupBy(shard("c_name").alias("shard")).agg(F.count("*").alias("n")))

# -- mutation -----------------------------------------------------------------------------------

FOLD = "first_write AS (SELECT entity_id, min(pos) AS p FROM ops WHERE op = 'write' GROUP BY entity_id), heard AS (SELECT ops.* FROM ops JOIN first_write USING (entity_id) WHERE pos >= p), won AS (SELECT entity_id, version, pos, op FROM heard QUALIFY row_number() OVER (PARTITION BY entity_id ORDER BY version DESC, pos DESC) = 1)"
query("upsert_latest_version", f"WITH {EV}, ops AS (SELECT * FROM ev WHERE op = 'write'), {FOLD} SELECT entity_id, version FROM won")(lambda s, d: fold.live(ev(s, d).where("op = 'write'")).select("entity_id", "version"))


def tied(spark, d):
    return ev(spark, d).where("op = 'write'").withColumn("version", F.expr("version div 1000"))


TIED = f"{EV}, ops AS (SELECT * REPLACE (version // 1000 AS version) FROM ev WHERE op = 'write')"
query("upsert_tie_last_wins", f"WITH {TIED}, {FOLD} SELECT entity_id, version, pos FROM won")(lambda s, d: fold.live(tied(s, d)).select("entity_id", "version", "pos"))
STORED = "stored AS (SELECT user_id AS entity_id, max(event_id) AS version FROM events WHERE event_id % 3 = 0 GROUP BY user_id)"


def stored(spark, d):
    return read(spark, d, "events").where("event_id % 3 = 0").groupBy(F.col("user_id").alias("entity_id")).agg(F.max("event_id").alias("version"))


@query("upsert_reject_stale", f"WITH {EV}, {STORED}, n AS (SELECT entity_id, max(version) AS version FROM ev WHERE op = 'write' AND version % 3 = 1 GROUP BY entity_id) SELECT n.entity_id, n.version FROM n LEFT JOIN stored USING (entity_id) WHERE stored.version IS NULL OR stored.version <= n.version")
def reject_stale(spark, d):
    return fold.live(ev(spark, d).where("op = 'write' and version % 3 = 1"), stored(spark, d)).where("pos >= 0").select("entity_id", "version")


@query("upsert_replace_rows", f"WITH {EVD}, old AS (SELECT * FROM evd WHERE version < 15), new AS (SELECT * FROM evd WHERE version >= 15) SELECT entity_id, event_id, value FROM old WHERE entity_id NOT IN (SELECT entity_id FROM new) UNION ALL SELECT entity_id, event_id, value FROM new")
def replace_rows(spark, d):
    rows = evd(spark, d).select("entity_id", "version", "event_id", "value")
    new = rows.where("version >= 15")
    return fold.replace_rows(rows.where("version < 15"), new, new.select("entity_id").distinct()).select("entity_id", "event_id", "value")


query("delete_versioned", f"WITH {EV}, {STORED}, x AS (SELECT entity_id, max(version) AS version FROM ev WHERE op = 'delete' GROUP BY entity_id) SELECT entity_id, stored.version FROM stored LEFT JOIN x USING (entity_id) WHERE x.version IS NULL OR x.version < stored.version")(
    lambda s, d: fold.live(ev(s, d).where("op = 'delete'"), stored(s, d)).select("entity_id", "version")
)
@query("delete_stale_ignored", f"WITH {EV}, {STORED}, x AS (SELECT entity_id, min(version) AS version FROM ev WHERE op = 'delete' GROUP BY entity_id) SELECT entity_id, stored.version FROM stored JOIN x USING (entity_id) WHERE x.version < stored.version")
def stale_delete(spark, d):
    """Of entities with a delete, those whose first one is older than what is stored."""
    first = ev(spark, d).where("op = 'delete'").groupBy("entity_id", "op").agg(F.min("version").alias("version"), F.min("pos").alias("pos"))
    return fold.live(first, stored(spark, d)).join(first.select("entity_id"), "entity_id", "left_semi").select("entity_id", "version")


@query("delete_then_readd", f"WITH {EV} SELECT entity_id, min(version) AS version FROM ev WHERE op = 'write' GROUP BY entity_id")
def readd(spark, d):
    """Deleted at commit, an entity may come back at a lower version: the second transaction knows nothing of it."""
    low = ev(spark, d).where("op = 'write'").groupBy("entity_id").agg(F.min("version").alias("version"))
    gone = low.select("entity_id", F.lit(10**9).alias("version"), F.lit(0).alias("pos"), F.lit("delete").alias("op"))
    left = fold.live(gone, low.select("entity_id", "version"))
    return fold.live(low.select("entity_id", "version", F.lit(0).alias("pos"), F.lit("write").alias("op")), left.select("entity_id", "version")).select("entity_id", "version")


query("empty_entity_null_row", "SELECT o_orderkey AS entity_id, l_linenumber, l_quantity FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey")(lambda s, d: fold.with_empty(read(s, d, "orders").select(F.col("o_orderkey").alias("entity_id")), li(s, d).select("entity_id", "l_linenumber", "l_quantity")))
query("fold_ops", f"WITH {EV}, ops AS (SELECT * FROM ev), {FOLD} SELECT entity_id, version, pos FROM won WHERE op = 'write'")(lambda s, d: fold.live(ev(s, d)))

# -- snapshots ----------------------------------------------------------------------------------


query("snapshot_to_interval", f"WITH {sbuckets()} SELECT event_id, '{WEEKS[1]}' AS interval_start, shard FROM b WHERE shard >= 2 OR interval_start = '{WEEKS[1]}'")(
    lambda s, d: fixtures.destination(s, d, WEEKS[1]).scan(Predicate("=", ("weekly",))).select("event_id", "interval_start", "shard")  # shards 0 and 1 were there already and stay as they were
)
query("copy_previous_interval", f"WITH {sbuckets()} SELECT event_id, '{WEEKS[1]}' AS interval_start, shard FROM b WHERE interval_start = '{WEEKS[0]}'")(
    lambda s, d: fixtures.followed(s, d, WEEKS[0], "2024-01-10").scan(start=Predicate("=", (WEEKS[1],))).select("event_id", "interval_start", "shard")
)
query("drop_interval_start", f"WITH {sbuckets()} SELECT interval_start, count(*) AS n FROM b WHERE interval_start <> '{WEEKS[0]}' GROUP BY interval_start")(lambda s, d: fixtures.dropped(s, d, WEEKS[0]).scan().groupBy("interval_start").agg(F.count("*").alias("n")))

# -- statistics ---------------------------------------------------------------------------------

query("column_zone_map", f"WITH {ZONES} SELECT * FROM z")(lambda s, d: stats.zone_map(li(s, d), "l_extendedprice"))
query("column_cardinality", f"WITH {LI} SELECT shard, count(DISTINCT l_partkey) AS cardinality FROM li GROUP BY shard")(lambda s, d: stats.cardinality(li(s, d), "l_partkey"))
query("shard_counts", f"WITH {LI} SELECT shard, count(*) AS n_rows, count(DISTINCT entity_id) AS n_entities FROM li GROUP BY shard")(lambda s, d: stats.counts(li(s, d), "entity_id"))
_META = " UNION ALL ".join(f"SELECT shard, count(*) AS n_rows, count(DISTINCT entity_id) AS n_entities, '{c}' AS column_name, min(CAST({c} AS DOUBLE)) AS min_value, max(CAST({c} AS DOUBLE)) AS max_value, count(DISTINCT {c}) AS cardinality, count(*) - count({c}) AS n_nulls FROM li GROUP BY shard" for c in ("l_quantity", "l_suppkey"))
query("column_metadata", f"WITH {LI} {_META}")(lambda s, d: stats.column_metadata(li(s, d), ["l_quantity", "l_suppkey"], "entity_id", exact=True))
query("shard_metadata", f"WITH {LI}, m AS ({_META}) SELECT shard, max(n_rows) AS n_rows, count(*) AS n_columns, min(min_value) AS least, max(max_value) AS most, max(n_nulls) AS n_nulls FROM m GROUP BY shard")(
    lambda s, d: fixtures.lineitem(s, d).shard_metadata("single", "2024-01-01", ["l_quantity", "l_suppkey"]).groupBy("shard").agg(F.max("n_rows").alias("n_rows"), F.count("*").alias("n_columns"), F.min("min_value").alias("least"), F.max("max_value").alias("most"), F.max("n_nulls").alias("n_nulls"))
)
query("fragmentation", f"WITH {EVD}, l AS (SELECT entity_id, max(version) AS v FROM evd GROUP BY entity_id) SELECT CAST(entity_id % 10 AS INTEGER) AS shard, count(*) AS n_rows, CAST(floor(100 * sum(CASE WHEN version = v THEN 0 ELSE 1 END) / count(*)) AS BIGINT) AS fragmentation FROM evd JOIN l USING (entity_id) GROUP BY 1")(
    lambda s, d: stats.fragmentation(evd(s, d).withColumn("shard", F.pmod("entity_id", F.lit(10)).cast("int")), evd(s, d).groupBy("entity_id").agg(F.max("version").alias("version")), "entity_id")
)
query("entity_summaries", f"WITH {EVD} SELECT entity_id, count(*) AS n_rows, max(version) AS version FROM evd GROUP BY entity_id")(lambda s, d: stats.entity_summaries(evd(s, d), "entity_id", "version"))


query("entity_order", f"WITH {LI}, e AS (SELECT shard, entity_id, count(*) AS n_rows FROM li GROUP BY shard, entity_id) SELECT shard, entity_id, row_number() OVER (PARTITION BY shard ORDER BY n_rows, entity_id) AS place FROM e")(lambda s, d: stats.entity_order(li(s, d), "entity_id"))
query("dictionary_encode", "SELECT c_mktsegment AS value, CAST(dense_rank() OVER (ORDER BY c_mktsegment) + 1 AS BIGINT) AS surrogate FROM (SELECT DISTINCT c_mktsegment FROM customer)")(lambda s, d: stats.dictionary(read(s, d, "customer"), "c_mktsegment"))
query("dictionary_decode", "SELECT c_custkey, c_mktsegment FROM customer")(
    lambda s, d: read(s, d, "customer").select("c_custkey", F.col("c_mktsegment").alias("value")).join(stats.dictionary(read(s, d, "customer"), "c_mktsegment"), "value").select("c_custkey", "surrogate").join(stats.dictionary(read(s, d, "customer"), "c_mktsegment"), "surrogate").select("c_custkey", F.col("value").alias("c_mktsegment"))
)


@query("dictionary_check", "SELECT 'value' AS kind, p_type AS item, count(DISTINCT p_size) AS times FROM part GROUP BY p_type HAVING count(DISTINCT p_size) > 1 UNION ALL SELECT 'surrogate', CAST(p_size AS VARCHAR), count(DISTINCT p_type) FROM part GROUP BY p_size HAVING count(DISTINCT p_type) > 1")
def dictionary_check(spark, d):
    return stats.dictionary_violations(read(spark, d, "part").select(F.col("p_type").alias("value"), F.col("p_size").alias("surrogate")))


@query("null_positions", f"WITH {EVD}, n AS (SELECT entity_id, CASE WHEN event_type <> 'view' THEN event_type END AS t, row_number() OVER (PARTITION BY entity_id ORDER BY event_id) AS p FROM evd) SELECT entity_id, string_agg(CAST(p AS VARCHAR), ',' ORDER BY p) AS positions FROM n WHERE t IS NULL GROUP BY entity_id")
def null_positions(spark, d):
    return stats.null_positions(evd(spark, d).withColumn("event_type", F.expr(NULLED)), "event_type", "entity_id", ["event_id"])


query("compact", f"WITH {EVD}, l AS (SELECT entity_id, max(version) AS v FROM evd GROUP BY entity_id) SELECT entity_id, version, event_id FROM evd JOIN l USING (entity_id) WHERE version = v")(
    lambda s, d: fixtures.by_day(s, d).scan().select(F.col("user_id").alias("entity_id"), F.col("_version").alias("version"), "event_id")
)
query("resync_new_column", "SELECT o_orderkey AS entity_id, l_tax FROM orders LEFT JOIN (SELECT * FROM lineitem WHERE l_orderkey % 3 = 0) ON o_orderkey = l_orderkey")(lambda s, d: stats.resync(read(s, d, "orders").select(F.col("o_orderkey").alias("entity_id")), li(s, d).where("entity_id % 3 = 0").select("entity_id", "l_tax"), "entity_id"))
query("consistency_violations", f"WITH {EVD}, s AS (SELECT entity_id, count(*) AS n_rows, max(version) AS version FROM evd GROUP BY entity_id) SELECT 'value' AS column_name, entity_id, CASE WHEN entity_id % 5 = 0 THEN 'missing' ELSE 'rows' END AS why FROM s WHERE entity_id % 5 = 0 OR entity_id % 7 = 0")(
    lambda s, d: stats.consistency_violations({"event_type": stats.entity_summaries(evd(s, d), "entity_id", "version"), "value": stats.entity_summaries(evd(s, d), "entity_id", "version").where("entity_id % 5 <> 0").withColumn("n_rows", F.expr("n_rows + if(entity_id % 7 = 0, 1, 0)"))}, "entity_id")
)
query("entity_id_column", "SELECT l_orderkey AS entity_id FROM lineitem")(lambda s, d: stats.entity_id_column(li(s, d).groupBy("entity_id").agg(F.count("*").alias("n_rows")), "entity_id"))

# -- differences --------------------------------------------------------------------------------

VALUES = ", ".join(f"{w}v AS (SELECT entity_id, string_agg(event_type, ',' ORDER BY event_type) AS v FROM {w} GROUP BY entity_id)" for w in ("w1", "w2"))
query("diff_added", f"WITH {W}, {VALUES} SELECT entity_id, w2v.v AS after_values FROM w2v ANTI JOIN w1v USING (entity_id)")(lambda s, d: diff.compare(day(s, d, 0), day(s, d, 1), "entity_id", "event_type").where("change = 'added'").select("entity_id", "after_values"))
query("diff_removed", f"WITH {W}, {VALUES} SELECT entity_id, w1v.v AS before_values FROM w1v ANTI JOIN w2v USING (entity_id)")(lambda s, d: diff.compare(day(s, d, 0), day(s, d, 1), "entity_id", "event_type").where("change = 'removed'").select("entity_id", "before_values"))
query("diff_changed", f"WITH {W}, {VALUES} SELECT entity_id, w1v.v AS before_values, w2v.v AS after_values FROM w1v JOIN w2v USING (entity_id) WHERE w1v.v <> w2v.v")(lambda s, d: diff.compare(day(s, d, 0), day(s, d, 1), "entity_id", "event_type").where("change = 'changed'").drop("change"))
query("table_diff_plus", f"WITH {W} SELECT entity_id, event_type FROM w2 EXCEPT ALL SELECT entity_id, event_type FROM w1")(lambda s, d: diff.plus(day(s, d, 0).select("entity_id", "event_type"), day(s, d, 1).select("entity_id", "event_type")))
query("table_diff_minus", f"WITH {W} SELECT entity_id, event_type FROM w1 EXCEPT ALL SELECT entity_id, event_type FROM w2")(lambda s, d: diff.minus(day(s, d, 0).select("entity_id", "event_type"), day(s, d, 1).select("entity_id", "event_type")))
query("entity_visual", f"WITH {EVD} SELECT entity_id, CAST(entity_id AS VARCHAR) || ' [' || CAST(count(*) AS VARCHAR) || ']: ' || string_agg(event_type, ' ' ORDER BY event_id) AS line FROM evd GROUP BY entity_id")(lambda s, d: diff.visual(evd(s, d), "entity_id", "event_type", ["event_id"]))
query("value_traversal", f"WITH {EVD} SELECT entity_id, CAST(count(*) AS INTEGER) AS n, CAST(count(*) FILTER (WHERE event_type = 'view') AS INTEGER) AS n_nulls, string_agg(CASE WHEN event_type <> 'view' THEN event_type END, ',' ORDER BY event_id) AS line FROM evd GROUP BY entity_id")(
    lambda s, d: diff.traverse(evd(s, d).withColumn("event_type", F.expr(NULLED)), "entity_id", "event_type", ["event_id"]).select("entity_id", F.size("values").alias("n"), F.size("nulls").alias("n_nulls"), F.when(F.exists("values", lambda x: x.isNotNull()), F.array_join("values", ",")).alias("line"))
)
query("capture_log", "SELECT CASE WHEN event_type = 'error' THEN 'delete' ELSE 'write' END AS kind, user_id, event_id AS version, CASE WHEN event_type <> 'error' THEN event_type END AS event_type FROM events WHERE event_id % 2 = 0")(
    lambda s, d: fixtures.requests(s, d).captured().select(F.col("_kind").alias("kind"), F.from_json("request", "user_id bigint, _version bigint, event_type string").alias("r")).select("kind", "r.user_id", F.col("r._version").alias("version"), "r.event_type")
)
query("requests_folded", f"WITH {EV}, ops AS (SELECT entity_id, version, CASE WHEN op = 'write' THEN 0 ELSE 1 END AS pos, op FROM ev), {FOLD} SELECT entity_id, version FROM won WHERE op = 'write'")(lambda s, d: fixtures.requests(s, d).scan().select(F.col("user_id").alias("entity_id"), F.col("_version").alias("version")))
query("analyzer_dump", f"WITH {LI} SELECT CAST(shard AS VARCHAR) AS shard, 'metadata' AS kind, CAST(1 AS BIGINT) AS n FROM li GROUP BY shard UNION ALL SELECT CAST(shard AS VARCHAR), 'entity', count(DISTINCT entity_id) FROM li GROUP BY shard UNION ALL SELECT CAST(shard AS VARCHAR), 'summary', count(DISTINCT entity_id) FROM li GROUP BY shard UNION ALL SELECT NULL, 'dictionary', count(DISTINCT l_returnflag) FROM li")(
    lambda s, d: analyze.dump(li(s, d).withColumn("_version", F.lit(0)), "entity_id", "_version", ["l_returnflag"], ["l_linenumber", "l_partkey"]).groupBy("shard", "kind").agg(F.count("*").alias("n"))
)

# -- SQL over tables (the host engine's own capability) -----------------------------------------


def _sql(name: str, text: str) -> None:
    @query(name, text)
    def run(spark, d):
        for t in ("orders", "customer", "lineitem", "events", "nation"):
            if f" {t}" in text:
                read(spark, d, t).createOrReplaceTempView(t)
        return spark.sql(text)


_sql("sql_join", "SELECT c_mktsegment, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_mktsegment")
_sql("sql_group_by", "SELECT l_returnflag, l_linestatus, count(*) AS n, min(l_quantity) AS least, max(l_extendedprice) AS most FROM lineitem GROUP BY l_returnflag, l_linestatus")
_sql("sql_rollup", "SELECT event_type, user_id, count(*) AS n FROM events GROUP BY ROLLUP (event_type, user_id)")
_sql("sql_window", "SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS nth FROM events")
_sql("sql_topk", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20")
_sql("sql_set_ops", "SELECT c_nationkey AS k FROM customer INTERSECT SELECT n_nationkey FROM nation")


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """Latest version of every user by week and shard, deletes applied: rows, entities, least and greatest value of each slice."""
    rows = ev(spark, d).withColumn("interval_start", intervals.start("weekly", F.col("ts")))
    won = fold.live(rows).select("entity_id", "version")
    left = rows.join(won, ["entity_id", "version"]).withColumn("shard", shard("entity_id"))
    return left.groupBy("interval_start", "shard").agg(F.count("*").alias("n_rows"), F.count_distinct("entity_id").alias("n_entities"), F.min("value").alias("min_value"), F.max("value").alias("max_value"))


query("slice_statistics", f"WITH {EV}, ops AS (SELECT * FROM ev), {FOLD}, l AS (SELECT ev.* FROM ev JOIN won USING (entity_id, version) WHERE won.op = 'write') SELECT {iso("date_trunc('week', ts)")} AS interval_start, {jshard('entity_id')} AS shard, count(*) AS n_rows, count(DISTINCT entity_id) AS n_entities, min(value) AS min_value, max(value) AS max_value FROM l GROUP BY 1, 2")(flagship)
