"""What the corpus operators share: sessions, durable intermediate tables, vectorised words.

Conventions of every operator in this subpackage
  * A null text is an empty text.  A null id is one id below all others.
  * Only the named columns are read, so further columns, whatever their names, do not matter.
  * Rows that repeat an id and a text are one document reported once per row.
"""

from __future__ import annotations

import contextlib
import os
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.shared import shared_dir

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
NULL_ID = -(2**63)
#: Rows that may be broadcast at once.
BLOCK = 500_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package, wherever the driver was started."""
    env = spark.sparkContext.environment
    parts = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if ROOT not in parts:
        env["PYTHONPATH"] = os.pathsep.join([ROOT, *parts])
    return spark


def key(name: str = "doc_id") -> Column:
    """The id as a long that is never null."""
    return F.coalesce(F.col(name).cast("long"), F.lit(NULL_ID))


def text(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


#: Folders of this process's intermediate tables that are not deleted yet.
_FOLDERS: list[str] = []


class Scratch:
    """Tables written to the shared folder, which cut lineage and outlive lost executors.

    Results are lazy, so an operator can't delete the tables that its result reads: see ``temporary``.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.base, self.n = spark, f"{shared_dir(spark)}/{uuid.uuid4().hex}", 0
        _FOLDERS.append(self.base)

    def save(self, df: DataFrame) -> tuple[DataFrame, str]:
        self.n += 1
        path = f"{self.base}/{self.n}"
        df.write.option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path), path

    def drop(self, path: str) -> None:
        _delete(self.spark, path)


def _delete(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    with contextlib.suppress(Exception):  # a leftover table costs space, not results
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


@contextlib.contextmanager
def temporary(spark: SparkSession):
    """Deletes, at the end, the intermediate tables of operators called inside; their results must be written or used up by then."""
    n = len(_FOLDERS)
    try:
        yield
    finally:
        for base in _FOLDERS[n:]:
            _delete(spark, base)
        del _FOLDERS[n:]


# -- vectorised words ---------------------------------------------------------------------------

_MULT = np.uint64(0x9E3779B97F4A7C15)
_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit integers."""
    x = x ^ (x >> np.uint64(30))
    x = x * _MIX1
    x = x ^ (x >> np.uint64(27))
    x = x * _MIX2
    return x ^ (x >> np.uint64(31))


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BYTE = mix64(np.arange(1, 257, dtype=np.uint64) * _MULT)
_PLACE = np.empty(0, np.uint64)


def places(n: int) -> np.ndarray:
    """Odd 64-bit factors for places 0..n-1, the same in every process."""
    global _PLACE
    if len(_PLACE) < n:
        size = 1 << max(10, int(n - 1).bit_length())
        _PLACE = mix64(np.arange(7, size + 7, dtype=np.uint64) * _MULT) | np.uint64(1)
    return _PLACE[:n]


class Words:
    """The words [^\\x20\\x09-\\x0D]+ of several UTF-8 texts, as arrays over one buffer.

    buf: all bytes; start, end: of each word; doc: index of each word's text; hash: 64 bits a word;
    at: bounds of the texts in buf; first: bounds of the texts in the word arrays.
    """

    def __init__(self, texts: list[bytes], lower: bool = False):
        self.at = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts], dtype=np.int64)]) if texts else np.zeros(1, np.int64)
        raw = b"\n".join(texts) + b"\n" if texts else b""
        self.raw = raw.lower() if lower else raw  # bytes.lower() changes A-Z only
        self.buf = np.frombuffer(self.raw, np.uint8)
        edge = np.flatnonzero(np.diff(np.concatenate([[True], _SPACE[self.buf], [True]]).view(np.int8)))
        self.start, self.end = edge[0::2], edge[1::2]
        self.first = np.searchsorted(self.start, self.at)
        self.doc = np.repeat(np.arange(len(texts)), np.diff(self.first))

    @property
    def hash(self) -> np.ndarray:
        if not hasattr(self, "_hash"):
            n = self.end - self.start
            if len(n) == 0:
                self._hash = np.empty(0, np.uint64)
            else:
                total = int(n.sum())
                shift = np.cumsum(n) - n
                place = np.arange(total) - np.repeat(shift, n)
                spot = place + np.repeat(self.start, n)
                value = _BYTE[self.buf[spot]] * places(int(n.max()))[place]
                self._hash = mix64(np.add.reduceat(value, shift) + n.astype(np.uint64))
        return self._hash

    def sums(self, per_word: np.ndarray) -> np.ndarray:
        """Sum of a value over the words of each text."""
        total = np.concatenate([[0], np.cumsum(per_word)])
        return total[self.first[1:]] - total[self.first[:-1]]


def slabs(rows: list, size, limit: int = 1 << 20):
    """Runs of rows whose sizes add up to about limit; a larger row stands alone."""
    out, total = [], 0
    for r in rows:
        n = size(r)
        if out and total + n > limit:
            yield out
            out, total = [], 0
        out.append(r)
        total += n
    if out:
        yield out


def slices(batches, column: str = "text", limit: int = 1 << 20):
    """Arrow batches cut so that a column's strings add up to about limit bytes; a longer string stands alone."""
    import pyarrow.compute as pc

    for b in batches:
        if not b.num_rows:
            continue
        size = np.cumsum(pc.fill_null(pc.binary_length(b.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < b.num_rows:
            before = size[at - 1] if at else 0
            end = max(at + 1, int(np.searchsorted(size, before + limit, side="right")))
            yield b.slice(at, end - at)
            at = end


def once(c: Column) -> Column:
    """The same value, which the optimiser does not copy into the expressions that use it.

    It would move an array's expression into a lambda, and so compute the array anew for each element.
    """
    return F.when(F.monotonically_increasing_id() >= 0, c)


def blocks(rows: DataFrame, by: list[str], size: int = BLOCK) -> list[DataFrame]:
    """Rows in parts of about size rows, so that each can be broadcast whatever the whole's size."""
    n = -(-rows.count() // size)
    if n <= 1:
        return [rows]
    return [rows.where(F.pmod(F.xxhash64(*by), F.lit(n)) == i) for i in range(n)]


#: Keys that may be called frequent, at most.
FREQUENT = 10_000


def frequent(counted: DataFrame, total: int, times: str = "times") -> DataFrame:
    """The keys, one a row, that hold over 1/FREQUENT of all ``total`` rows, and two at least: fewer than FREQUENT, so they may be broadcast."""
    return counted.where(F.col(times) > max(1, total // FREQUENT + 1))


def join_keyed(rows: DataFrame, keyed: DataFrame, on: str | list[str], total: int, times: str = "times", how: str = "inner") -> DataFrame:
    """The inner or left join of rows with a table of one row a key, which counts the key's rows in ``times``.

    Rows of frequent keys meet them by broadcast and are not shuffled; the others are dealt out by key.
    """
    often = F.broadcast(frequent(keyed, total, times))
    by = [on] if isinstance(on, str) else on
    return rows.join(often, by).unionByName(rows.join(often.select(*by), by, "left_anti").join(keyed, by, how))


def numbered(keys: DataFrame, by: list[str], scratch: Scratch, name: str = "rank") -> DataFrame:
    """Rows, different by some columns, numbered from 0 in the order of these: sorted in ranges, and a range's numbers begin after those before it."""
    sorted_, _ = scratch.save(keys.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_part", F.spark_partition_id()))
    sizes = sorted_.groupBy("_part").count()
    base = sizes.select("_part", (F.sum("count").over(Window.orderBy("_part")) - F.col("count")).alias("_base"))  # a row a range
    nth = F.row_number().over(Window.partitionBy("_part").orderBy(*by))
    return sorted_.withColumn("_nth", nth).join(F.broadcast(base), "_part").withColumn(name, F.col("_base") + F.col("_nth") - 1).drop("_part", "_base", "_nth")


def attach(rows: DataFrame, keyed: DataFrame, on: list[str], block: int = BLOCK) -> DataFrame:
    """The left join of rows with a table of one row a key: rows without a key among it are not shuffled if the keys are few enough to be broadcast."""
    if keyed.limit(block + 1).count() > block:
        return rows.join(keyed, on, "left")
    keys = F.broadcast(keyed.select(*on))
    return rows.join(keys, on, "left_semi").join(keyed, on).unionByName(rows.join(keys, on, "left_anti"), allowMissingColumns=True)


def meet(rows: DataFrame, other: DataFrame, on: str, spread: str, block: int = BLOCK, how: str = "inner", salts: int = 16) -> DataFrame:
    """The join of rows with a table of few rows a key: broadcast if that is small, else dealt out by key and a salt from the column ``spread`` of rows."""
    if other.limit(block + 1).count() <= block:
        return rows.join(F.broadcast(other), on, how)
    salted = other.withColumn("_salt", F.explode(F.array(*map(F.lit, range(salts)))))
    return rows.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int")).join(salted, [on, "_salt"], how).drop("_salt")


def having(rows: DataFrame, keys: DataFrame, on: str, spread: str, block: int = BLOCK, salts: int = 16) -> DataFrame:
    """Rows whose key is among some different keys."""
    return meet(rows, keys, on, spread, block, "left_semi", salts)


def stretches(rows: DataFrame) -> DataFrame:
    """k, h, gone: the union of ranges (i to j, both included) of each document, as separate ranges in order."""
    by = Window.partitionBy("k", "h").orderBy("i", "j")
    before = F.max("j").over(by.rowsBetween(Window.unboundedPreceding, -1))
    new = rows.withColumn("new", F.when(F.col("i") <= before + 1, 0).otherwise(1)).withColumn("part", F.sum("new").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    joined = new.groupBy("k", "h", "part").agg(F.min("i").alias("i"), F.max("j").alias("j"))
    return joined.groupBy("k", "h").agg(F.array_sort(F.collect_list(F.struct("i", "j"))).alias("gone"))
