"""Statistics by shard, dictionaries, summaries, compaction and consistency."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.predicates import Predicate, dictionary_test


def zone_map(rows: DataFrame, column: str, by: tuple[str, ...] = ("shard",)) -> DataFrame:
    """Least and greatest value by shard, numbers as doubles, text in its own order."""
    c = F.col(column) if dict(rows.dtypes)[column] == "string" else F.col(column).cast("double")
    return rows.groupBy(*by).agg(F.min(c).alias("min_value"), F.max(c).alias("max_value"))


def cardinality(rows: DataFrame, column: str, by: tuple[str, ...] = ("shard",), approximate: bool = False) -> DataFrame:
    """Different values by shard; a null counts as a value of text columns."""
    n = F.approx_count_distinct(column) if approximate else F.count_distinct(F.col(column))
    null = F.max(F.when(F.col(column).isNull(), 1).otherwise(0)) if dict(rows.dtypes)[column] == "string" else F.lit(0)
    return rows.groupBy(*by).agg((n + null).cast("bigint").alias("cardinality"))


def counts(rows: DataFrame, key: str, by: tuple[str, ...] = ("shard",)) -> DataFrame:
    return rows.groupBy(*by).agg(F.count("*").alias("n_rows"), F.count_distinct(key).alias("n_entities"))


def column_metadata(rows: DataFrame, columns: list[str], key: str, by: tuple[str, ...] = ("shard",), exact: bool = False) -> DataFrame:
    """Zone map, cardinality and counts of some numeric columns by shard, a row each.

    Cardinality and entities are estimates, in one pass without repeated rows; if exact, values are
    combined by column before they are counted.
    """
    distinct = F.count_distinct if exact else F.approx_count_distinct
    if not exact:
        told = [x for c in columns for x in (F.min(F.col(c).cast("double")).alias(f"{c}_min"), F.max(F.col(c).cast("double")).alias(f"{c}_max"), F.approx_count_distinct(c).alias(f"{c}_card"), F.count(c).alias(f"{c}_n"))]
        wide = rows.groupBy(*by).agg(F.count("*").alias("n_rows"), distinct(F.col(key)).alias("n_entities"), *told)
        each = F.explode(F.array(*(F.struct(F.lit(c).alias("column_name"), F.col(f"{c}_min").alias("min_value"), F.col(f"{c}_max").alias("max_value"), F.col(f"{c}_card").alias("cardinality"), (F.col("n_rows") - F.col(f"{c}_n")).alias("n_nulls")) for c in columns)))
        return wide.select(*by, "n_rows", "n_entities", each.alias("m")).select(*by, "n_rows", "n_entities", "m.*")
    sizes = rows.groupBy(*by).agg(F.count("*").alias("n_rows"), distinct(F.col(key)).alias("n_entities"))
    one = F.explode(F.array(*(F.struct(F.lit(c).alias("column_name"), F.col(c).cast("double").alias("number"), F.col(c).cast("string").alias("text")) for c in columns)))
    values = rows.select(*by, one.alias("x")).groupBy(*by, "x.column_name", "x.text").agg(F.max("x.number").alias("number"), F.count("*").alias("n"))
    told = values.groupBy(*by, "column_name").agg(F.min("number").alias("min_value"), F.max("number").alias("max_value"), F.count("text").alias("cardinality"), F.sum(F.when(F.col("text").isNull(), F.col("n")).otherwise(0)).alias("n_nulls"))
    return sizes.join(told, list(by)).select(*by, "n_rows", "n_entities", "column_name", "min_value", "max_value", "cardinality", "n_nulls")


def entity_order(rows: DataFrame, key: str, by: str = "shard") -> DataFrame:
    """by, key, place (from 1) of each entity among those of its shard, by number of rows, then id.

    Entities are sorted in ranges over the cluster; a place is the number in the whole order less that before the shard.
    """
    sized = rows.groupBy(by, key).agg(F.count("*").alias("n_rows"))
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = sized.repartitionByRange(parts, by, "n_rows", key).withColumn("part", F.spark_partition_id())
    nth = F.row_number().over(Window.partitionBy("part", by).orderBy("n_rows", key))
    sizes = ranged.groupBy("part", by).count()  # a row a range and shard
    before = sizes.select("part", by, (F.sum("count").over(Window.partitionBy(by).orderBy("part")) - F.col("count")).alias("base"))
    return ranged.withColumn("nth", nth).join(F.broadcast(before), ["part", by]).select(by, key, (F.col("base") + F.col("nth")).cast("bigint").alias("place"))


def fragmentation(log: DataFrame, latest: DataFrame, key: str, by: tuple[str, ...] = ("shard",)) -> DataFrame:
    """Share of a log's rows, in whole per cent, that later writes of their entity have superseded.  latest: key and version that counts."""
    told = log.join(latest.select(key, F.col("version").alias("_v")), key, "left")
    dead = F.sum(F.when(F.col("version") == F.col("_v"), 0).otherwise(1))
    return told.groupBy(*by).agg(F.count("*").alias("n_rows"), F.floor(100 * dead / F.count("*")).cast("bigint").alias("fragmentation"))


def entity_summaries(rows: DataFrame, key: str, version: str) -> DataFrame:
    return rows.groupBy(key).agg(F.count("*").alias("n_rows"), F.max(version).alias("version")).where("n_rows > 0")


def dictionary(rows: DataFrame, column: str) -> DataFrame:
    """value, surrogate of a column's values, numbered from 2 in their order.

    Ranges are counted first and numbered from their offsets, so no task sees all values.
    """
    values = rows.where(F.col(column).isNotNull()).select(F.col(column).alias("value")).distinct().repartitionByRange(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "value").withColumn("part", F.spark_partition_id())
    before = values.groupBy("part").count()
    before = before.withColumn("base", F.sum("count").over(Window.orderBy("part")) - F.col("count")).drop("count")  # a row a partition
    ranked = values.withColumn("nth", F.row_number().over(Window.partitionBy("part").orderBy("value")))
    return ranked.join(F.broadcast(before), "part").select("value", (F.col("base") + F.col("nth") + 1).cast("bigint").alias("surrogate"))


def dictionary_passes(rows: DataFrame, column: str, predicate: Predicate, by: str = "shard") -> DataFrame:
    """by, passes: what a predicate says of each shard's dictionary; see dictionary_test."""
    values = rows.select(by, column).distinct().groupBy(by).agg(F.collect_set(column).alias("_values"))
    return values.select(by, dictionary_test(F.col("_values"), predicate).alias("passes"))


def dictionary_violations(pairs: DataFrame) -> DataFrame:
    """Values with two surrogates and surrogates of two values: kind, item, times."""
    a = pairs.groupBy("value").agg(F.count_distinct("surrogate").alias("times")).where("times > 1").select(F.lit("value").alias("kind"), F.col("value").alias("item"), "times")
    b = pairs.groupBy("surrogate").agg(F.count_distinct("value").alias("times")).where("times > 1").select(F.lit("surrogate").alias("kind"), F.col("surrogate").cast("string").alias("item"), "times")
    return a.unionByName(b)


def null_positions(rows: DataFrame, column: str, key: str, order: list[str]) -> DataFrame:
    """Places (from 1) of nulls among an entity's rows, comma-joined."""
    at = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    marked = rows.withColumn("_at", at).where(F.col(column).isNull())
    return marked.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list("_at")), lambda x: x.cast("string")), ",").alias("positions"))


def resync(baseline: DataFrame, column: DataFrame, key: str) -> DataFrame:
    """A column's rows on the baseline's entities: one null row for entities it lacks; others of its own go."""
    return baseline.select(key).distinct().join(column, key, "left")


def consistency_violations(columns: dict[str, DataFrame], key: str) -> DataFrame:
    """column_name, key, why: where a column's summaries (key, n_rows, version) differ from those of the column with most entities.  Sizes are counted in one job."""
    sizes = reduce(DataFrame.unionByName, (d.select(F.lit(n).alias("n")) for n, d in columns.items())).groupBy("n").count().collect()  # a row a column
    base = max(sorted(r.n for r in sizes), key={r.n: r["count"] for r in sizes}.get, default=next(iter(columns)))
    parts = []
    for name, d in columns.items():
        if name == base:
            continue
        b = columns[base].select(key, F.col("n_rows").alias("b_rows"), F.col("version").alias("b_version"))
        why = F.when(F.col("n_rows").isNull(), "missing").when(F.col("b_rows").isNull(), "extra").when(F.col("n_rows") != F.col("b_rows"), "rows").when(F.col("version") != F.col("b_version"), "version")
        parts.append(b.join(d, key, "full").select(F.lit(name).alias("column_name"), key, why.alias("why")).where("why is not null"))
    return reduce(DataFrame.unionByName, parts) if parts else columns[base].select(F.lit("").alias("column_name"), key, F.lit("").alias("why")).limit(0)


def entity_id_column(summaries: DataFrame, key: str) -> DataFrame:
    """Each id as often as its entity has rows."""
    return summaries.select(F.explode(F.array_repeat(key, F.col("n_rows").cast("int"))).alias(key))
