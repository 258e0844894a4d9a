"""A table's contents as JSON, for people and for other tools."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..types import code_of
from . import diff, stats


def dump(rows: DataFrame, key: str, version: str, columns: list[str], order: list[str], by: str = "shard") -> DataFrame:
    """by, column_name, kind, json: of each shard and column its metadata, and the values and null places of each entity; of text columns the dictionary with surrogates; of each shard its entities' summaries."""
    types, parts = dict(rows.dtypes), []

    def lines(made: DataFrame, kind: str, column: str | None) -> DataFrame:
        rest = [c for c in made.columns if c != by]
        return made.select(F.col(by).cast("string").alias(by), F.lit(column).cast("string").alias("column_name"), F.lit(kind).alias("kind"), F.to_json(F.struct(*rest), {"ignoreNullFields": "false"}).alias("json"))

    summaries = rows.groupBy(by, key).agg(F.count("*").alias("n_rows"), F.max(version).alias("version"))
    parts.append(lines(summaries, "summary", None))
    for c in columns:
        sized = stats.zone_map(rows, c, (by,)).join(stats.cardinality(rows, c, (by,)), by).join(stats.counts(rows, key, (by,)), by)
        parts.append(lines(sized.withColumn("type", F.lit(code_of(types[c]))), "metadata", c))
        values = diff.traverse(rows, key, c, order).join(rows.select(by, key).distinct(), key)
        parts.append(lines(values, "entity", c))
        if types[c] == "string":
            parts.append(lines(stats.dictionary(rows, c).withColumn(by, F.lit(None).cast("string")), "dictionary", c))
    return reduce(DataFrame.unionByName, parts)
