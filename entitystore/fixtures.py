"""Entity tables made of the driver's tables, written once a session into the shared folder; the queries read and change them."""

from __future__ import annotations

import zlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import sharding
from .sources.shared import shared_dir
from .sources.table import EntityTable

SHARDS = 10
_made: dict[tuple, EntityTable] = {}


def base(spark: SparkSession, d: str) -> str:
    return f"{shared_dir(spark)}/entitystore/{spark.sparkContext.applicationId}/{zlib.crc32(d.encode())}"


def read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _once(name: str, spark: SparkSession, d: str, fill: Callable[[EntityTable], None], **more) -> EntityTable:
    at = (spark.sparkContext.applicationId, d, name)
    if at not in _made:
        table = EntityTable(spark, base(spark, d), "org1", name, **more)
        if not table.exists():
            fill(table)
        _made[at] = table
    return _made[at]


def _events(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "events").withColumns({"_version": F.lit(0), "ts": F.col("ts").cast("timestamp")})


def events(spark: SparkSession, d: str) -> EntityTable:
    """Events by user: one bucket for all, one a week, one a day."""

    def fill(t: EntityTable) -> None:
        t.begin()
        for interval in ("single", "weekly", "daily"):
            t.write(_events(spark, d), interval, F.col("ts"))
        t.commit()

    return _once("events", spark, d, fill, key="user_id", strategy=sharding.modulo(SHARDS))


def lineitem(spark: SparkSession, d: str) -> EntityTable:
    """Line items by order, in shards by the order key's remainder."""

    def fill(t: EntityTable) -> None:
        t.begin()
        t.write(read(spark, d, "lineitem").withColumnRenamed("l_orderkey", "entity_id").withColumn("_version", F.lit(0)), "single", "2024-01-01")
        t.commit()

    return _once("lineitem", spark, d, fill, strategy=lambda c: F.pmod(c, F.lit(SHARDS)).cast("int"))


def varied(spark: SparkSession, d: str) -> EntityTable:
    """Line numbers by order; a later write adds orders that have a priority too, in four of ten shards."""

    def fill(t: EntityTable) -> None:
        rows = read(spark, d, "lineitem").select(F.col("l_orderkey").alias("entity_id"), "l_linenumber", F.lit(0).alias("_version"))
        new = (F.col("entity_id") % 3 == 0) & (F.col("entity_id") % SHARDS < 4)
        t.begin()
        t.write(rows.where(~new), "single", "2024-01-01")
        t.write(rows.where(new).withColumn("priority", F.concat(F.lit("p"), F.col("l_linenumber").cast("string"))), "single", "2024-01-01")
        t.commit()

    return _once("varied", spark, d, fill, strategy=lambda c: F.pmod(c, F.lit(SHARDS)).cast("int"))


def orders(spark: SparkSession, d: str) -> EntityTable:
    """Orders in one shard."""

    def fill(t: EntityTable) -> None:
        t.begin()
        t.write(read(spark, d, "orders").withColumn("_version", F.lit(0)), "single", "2024-01-01")
        t.commit()

    return _once("orders", spark, d, fill, key="o_orderkey", shards=1)


def registry(spark: SparkSession, d: str) -> str:
    """A store with tables by event type, of users with even ids for one tenant and with odd ones for another."""
    at = f"{base(spark, d)}_registry"
    for r in read(spark, d, "events").select(F.when(F.col("user_id") % 2 == 0, "org1").otherwise("org2").alias("t"), "event_type").distinct().collect():  # ten
        EntityTable(spark, at, r.t, r.event_type).create()
    return at


def destination(spark: SparkSession, d: str, start: str) -> EntityTable:
    """All events in one bucket, and shards 0 and 1 of a week there already."""

    def fill(t: EntityTable) -> None:
        t.begin()
        t.write(_events(spark, d), "single", F.col("ts"))
        t.write(_events(spark, d).where((F.date_trunc("week", "ts") == F.lit(start).cast("timestamp")) & (t.strategy(F.col("user_id")) < 2)), "weekly", F.col("ts"))
        t.commit()
        t.snapshot("weekly", start)

    return _once("destination", spark, d, fill, key="user_id", strategy=sharding.modulo(SHARDS))


def followed(spark: SparkSession, d: str, start: str, ts: str) -> EntityTable:
    """A week's events, copied to the next week."""

    def fill(t: EntityTable) -> None:
        t.begin()
        t.write(_events(spark, d).where(F.date_trunc("week", "ts") == F.lit(start).cast("timestamp")), "weekly", F.col("ts"))
        t.commit()
        t.copy_previous("weekly", ts)

    return _once("followed", spark, d, fill, key="user_id", strategy=sharding.modulo(SHARDS))


def dropped(spark: SparkSession, d: str, start: str) -> EntityTable:
    """Events by week without one of the weeks."""

    def fill(t: EntityTable) -> None:
        t.begin()
        t.write(_events(spark, d), "weekly", F.col("ts"))
        t.commit()
        t.drop("weekly", start)

    return _once("dropped", spark, d, fill, key="user_id", strategy=sharding.modulo(SHARDS))


def by_day(spark: SparkSession, d: str) -> EntityTable:
    """Events by user, the days as versions, in two transactions, compacted."""

    def fill(t: EntityTable) -> None:
        rows = read(spark, d, "events").withColumn("_version", F.datediff(F.col("ts").cast("date"), F.lit("2024-01-01").cast("date"))).withColumn("ts", F.col("ts").cast("timestamp"))
        for late in (False, True):
            t.begin()
            t.write(rows.where((F.col("_version") > 10) == late), "single", "2024-01-01")
            t.commit()
        t.compact("single", "1970-01-01T00:00:00Z")

    return _once("by_day", spark, d, fill, key="user_id")


def requests(spark: SparkSession, d: str) -> EntityTable:
    """Writes and deletes of users, in one transaction, and the log of those requests that hold a value over 50 or delete."""

    def fill(t: EntityTable) -> None:
        rows = read(spark, d, "events").select("user_id", F.col("event_id").alias("_version"), "event_id", "event_type", "value")
        t.begin()
        t.write(rows.where("event_type <> 'error'"), "single", "2024-01-01")
        t.delete(rows.where("event_type = 'error'"), "single", "2024-01-01")
        t.commit()

    return _once("requests", spark, d, fill, key="user_id", capture=F.expr("_version % 2 = 0"))
