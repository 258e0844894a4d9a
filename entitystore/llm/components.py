"""Connected components by alternating large and small stars, over written tables."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, join_keyed


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def _least(edges: DataFrame, total: int) -> DataFrame:
    """Each u and v of an edge with the least of u's closed neighbourhood; edges of frequent u stay where they are."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("times")).select("u", F.least("u", "m").alias("m"), "times")
    return join_keyed(edges, least, "u", total).select("u", "v", "m")


#: Ids that a task holds at once.
HELD = 1 << 20


def _contract(edges: DataFrame, held: int = HELD) -> DataFrame:
    """Links that connect the same ids with fewer links: those that a task reads are joined in memory, some ids at a time."""

    def ends(root: dict) -> pa.RecordBatch:
        out = [(x, find(root, x)) for x in list(root)]
        out = [(x, y) for x, y in out if x != y]
        return pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.int64()), pa.array([y for _, y in out], pa.int64())], names=["u", "v"])

    def find(root: dict, x: int) -> int:
        while (y := root.setdefault(x, x)) != x:
            root[x] = x = root[y]
        return x

    def run(batches):
        root: dict[int, int] = {}
        for b in batches:
            for u, v in zip(b.column("u").to_pylist(), b.column("v").to_pylist(), strict=True):
                u, v = find(root, u), find(root, v)
                if u != v:
                    root[max(u, v)] = min(u, v)
            if len(root) > held:
                yield ends(root)
                root = {}
        yield ends(root)

    return edges.select("u", "v").mapInArrow(run, "u long, v long")


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """Of links (u, v): u, root (the least id reachable) for every id that has a link.

    Rounds grow with the logarithm of the longest chain.  Each round is written and the one before
    it deleted, so lost executors cost one round.
    """
    state, path, kept = None, None, None
    now = _contract(edges).distinct()
    while True:
        now, new = scratch.save(now)
        for old in (path, kept):
            if old:
                scratch.drop(old)
        path, before, state = new, state, _state(now)
        if state == before or state[0] == 0:
            break
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _least(both, 2 * state[0]).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        down, kept = scratch.save(large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")))
        small = _least(down, down.count())
        now = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
    return now.select("u", F.col("v").alias("root"))
