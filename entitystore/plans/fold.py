"""Folding of upserts and deletes over whole entities.

Operations: key, version, pos (their order, of any type that has one), op ("write" or "delete").  The one
that wins has the greatest version, and of those the last position; it must not be a delete of an entity
not written yet.  Winners' rows replace all rows of their entity.

Writes are combined before the shuffle, however many an entity has; of deletes one a version is shuffled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def winners(ops: DataFrame, stored: DataFrame | None = None, key: str | list[str] = "entity_id") -> DataFrame:
    """The winning operation of each entity: key, version, pos, op.  stored: key and version of entities there already (their pos is null)."""
    by = [key] if isinstance(key, str) else key
    ops = ops.select(*by, F.col("version").cast("bigint").alias("version"), "pos", "op")
    writes = ops.where("op = 'write'").drop("op")
    if stored is not None:
        writes = writes.unionByName(stored.select(*by, F.col("version").cast("bigint").alias("version")), allowMissingColumns=True)
    written = writes.groupBy(*by).agg(F.max(F.struct("version", "pos")).alias("w"), F.min("pos").alias("_first"), F.bool_or(F.col("pos").isNull()).alias("_known"))
    gone = ops.where("op = 'delete'").groupBy(*by, "version").agg(F.max("pos").alias("pos"))
    later = (F.col("version") > F.col("w.version")) | ((F.col("version") == F.col("w.version")) & (F.col("w.pos").isNull() | (F.col("pos") > F.col("w.pos"))))
    beaten = gone.join(written, by).where((F.col("_known") | (F.col("pos") > F.col("_first"))) & later).groupBy(*by).agg(F.max(F.struct("version", "pos")).alias("d"))
    top = F.coalesce("d", "w")
    return written.join(beaten, by, "left").select(*by, top["version"].alias("version"), top["pos"].alias("pos"), F.when(F.col("d").isNull(), "write").otherwise("delete").alias("op"))


def live(ops: DataFrame, stored: DataFrame | None = None, key: str | list[str] = "entity_id") -> DataFrame:
    """Entities left: key, version, pos of the write that won (null: the stored one)."""
    return winners(ops, stored, key).where("op = 'write'").drop("op")


def replace_rows(existing: DataFrame, new: DataFrame, won: DataFrame, gone: DataFrame | None = None, key: str = "entity_id") -> DataFrame:
    """Rows after a transaction: new rows of entities in won take the place of all their rows; those in gone go."""
    touched = won.select(key) if gone is None else won.select(key).unionByName(gone.select(key))
    return existing.join(touched, key, "left_anti").unionByName(new.join(won.select(key), key, "left_semi"), allowMissingColumns=True)


def with_empty(headers: DataFrame, rows: DataFrame, key: str = "entity_id") -> DataFrame:
    """Rows of all headers; an entity without rows has one of nulls."""
    return headers.select(key).join(rows, key, "left")
