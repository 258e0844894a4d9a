"""Differences between two slices of a table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _values(rows: DataFrame, key: str, column: str, name: str) -> DataFrame:
    """Each entity's values in order, nulls among them, each in a struct of its own."""
    return rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col(column).alias("value")))).alias(name))


def _shown(name: str):
    return F.when(F.col(name).isNotNull(), F.array_join(F.transform(F.col(name), lambda x: F.coalesce(x["value"].cast("string"), F.lit("null"))), ",")).alias(name)


def compare(before: DataFrame, after: DataFrame, key: str, column: str) -> DataFrame:
    """key, change (added, removed, changed), before_values, after_values; entities with equal values, repeats counted, are left out.

    Values are compared as they are and only shown as one comma-joined text.
    """
    met = _values(before, key, column, "before_values").join(_values(after, key, column, "after_values"), key, "full")
    change = F.when(F.col("before_values").isNull(), "added").when(F.col("after_values").isNull(), "removed").when(~F.col("before_values").eqNullSafe(F.col("after_values")), "changed")
    return met.withColumn("change", change).where("change is not null").select(key, "change", _shown("before_values"), _shown("after_values"))


def traverse(rows: DataFrame, key: str, column: str, order: list[str]) -> DataFrame:
    """key, values (of a column, in order, nulls among them), nulls (places of these, from 1), of every entity."""
    listed = rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*order, F.col(column).alias("_v")))).alias("v"))
    values = F.transform("v", lambda x: x["_v"])
    places = F.filter(F.transform("v", lambda x, i: F.when(x["_v"].isNull(), i + 1)), lambda i: i.isNotNull())
    return listed.select(key, values.alias("values"), places.alias("nulls"))


def plus(before: DataFrame, after: DataFrame) -> DataFrame:
    """Rows of after that before lacks, repeats counted."""
    return after.exceptAll(before)


def minus(before: DataFrame, after: DataFrame) -> DataFrame:
    return before.exceptAll(after)


def diff_table(table: str, interval: str, column: str, kind: str) -> str:
    """The name of a table of differences; kind is plus or minus."""
    return f"{table.lower()}_{interval.lower()}_{column.lower()}_{kind}"


def visual(rows: DataFrame, key: str, column: str, order: list[str]) -> DataFrame:
    """A line of text per entity: its id, row count and values in order."""
    text = F.coalesce(F.col(column).cast("string"), F.lit("null"))
    listed = rows.groupBy(key).agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct(*order, text.alias("t")))).alias("v"))
    return listed.select(key, F.concat(F.col(key).cast("string"), F.lit(" ["), F.col("n").cast("string"), F.lit("]: "), F.array_join(F.col("v.t"), " ")).alias("line"))
