"""Micro-batches of changes into an entity table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.table import EntityTable


def upsert_stream(changes: DataFrame, table: EntityTable, interval: str, ts: str, checkpoint: str, position: str | None = None):
    """Starts a query that commits each micro-batch: rows of the table's key, _version, op (write or delete) and values.

    Operations of a batch are folded in the order of the column ``position``; without it, in the order in
    which the batch's rows are read, where rows of an entity that share op and version are one
    operation.  Late data needs no watermark: versions gate it.  A batch that is tried again changes nothing.
    """

    def commit(batch: DataFrame, _: int) -> None:
        if position is None:
            same = Window.partitionBy(table.key, "_version", "op")
            rows = batch.withColumn("_row", F.monotonically_increasing_id()).withColumn("_place", F.min("_row").over(same)).drop("_row")
        else:
            rows = batch.withColumnRenamed(position, "_place")
        table.begin()
        try:
            table.change(rows, interval, ts, position="_place")
        except Exception:
            table.rollback()
            raise
        table.commit()

    return changes.writeStream.foreachBatch(commit).option("checkpointLocation", checkpoint).start()


def tumbling_counts(events: DataFrame, ts: str, width: str, late: str) -> DataFrame:
    """Events by window, those later than ``late`` left out."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, width)).count()
