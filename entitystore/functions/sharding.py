"""Shard numbers of entity ids."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A strategy is any function from an id column to a shard number column.
ShardStrategy = Callable[[Column], Column]


def string_hash(value: Column) -> Column:
    """The 31-based hash of a string's UTF-16 units as a signed 32-bit number."""
    text = value.cast("string")
    points = F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.ascii(c).cast("bigint"))
    units = F.transform(F.regexp_extract_all(F.hex(F.encode(text, "UTF-16BE")), F.lit("[0-9A-F]{4}"), 0), lambda u: F.conv(u, 16, 10).cast("bigint"))
    each = F.when(F.rlike(text, F.lit(r"[\x{10000}-\x{10FFFF}]")), units).otherwise(points)  # without such characters, code points are units
    h = F.aggregate(each, F.lit(0).cast("bigint"), lambda a, c: (a * 31 + c).bitwiseAND(F.lit(0xFFFFFFFF)))
    return F.when(h >= 2**31, h - 2**32).otherwise(h)


def modulo(n: int) -> ShardStrategy:
    """Compatible strategy: abs(hash of the id's text % n)."""
    return lambda value: F.abs(string_hash(value) % n).cast("int")


def hashed(n: int) -> ShardStrategy:
    """Strategy for new tables: one built-in hash, in whole-stage code."""
    return lambda value: F.pmod(F.xxhash64(value), F.lit(n)).cast("int")


def shard_path(tenant: Column, table: Column, interval: Column, start: Column, shard: Column) -> Column:
    return F.concat_ws("/", tenant, table, interval, start, shard.cast("string"))


@dataclass(frozen=True, order=True)
class ShardId:
    """A shard of a bucket of a table, and its path."""

    tenant: str
    table: str
    interval: str
    start: str
    shard: int

    def path(self) -> str:
        return f"{self.tenant}/{self.table}/{self.interval}/{self.start}/{self.shard}"

    @classmethod
    def parse(cls, path: str) -> ShardId:
        """The id that a path's last five parts name."""
        parts = path.strip("/").split("/")[-5:]
        if len(parts) < 5 or not parts[4].isdigit():
            raise ValueError(f"no shard in {path!r}")
        return cls(*parts[:4], int(parts[4]))
