"""Repeated byte strings by blockwise suffix sorting with a cover sample.

A suffix matters by its first ``length`` bytes only.  Sorting goes by buckets, and long ties are
settled by ranks of a cover sample, as in difference-cover construction; the cover is
content-defined: for each start p, the place q in [p, p + length - gram] whose ``gram`` bytes hash
least (leftmost first).  Equal strings at p and p' have their q at the same distance, the covering
property that a difference cover gives for ties, with a thirtieth of the places instead of an eighth.

1. Sample the first copy of every text; the rank of a sample is the hash of its gram.  Samples
   whose rank occurs once settle all their suffixes: none is repeated.  Ranks that repeat within
   a pack of texts are known to be tied there, and send one row to the exchange, with their number, not one each.
2. The context of each tied sample (the bytes that its suffixes span) goes to the bucket of its
   rank.  A task takes its buckets in order, a bounded number of contexts at a time, sorts the
   suffixes of each by their bytes, and marks all but the first of equal ones.  A rank of
   over ``hot`` samples is salted: its contexts go to as many buckets as it fills slabs, and the first
   of each string in a slab are dealt out anew by 128 bits of hashes of their strings.
3. Marked runs of starts, widened to the bytes they cover, meet their texts, and bytes are removed.

Texts are dealt out once, by their hash; the plan reuses that exchange for all three steps.  Copies of
a text that has many rows are told before and stay where they are.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

LENGTH = 100
GRAM = 24
HOT = 1 << 18
#: Samples in a pack; salted ranks that a task may name, which bounds their broadcast to so many a shuffle partition.
PACK, NAMED = 1 << 20, 1000
_C = np.uint64(0x9E3779B97F4A7C15)
_ALL = (1 << 64) - 1


def _grams(buf: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the n bytes from each place on, by doubling."""
    h = common._BYTE[buf]
    have, mult = 1, int(_C)
    power = []  # what n's binary digits need
    while have * 2 <= n:
        if n & have:
            power.append((have, h, np.uint64(mult)))
        h = h[:-have] * np.uint64(mult) + h[have:]
        have, mult = have * 2, mult * mult & _ALL
    for m, g, factor in reversed(power):
        size = len(buf) - have - m + 1
        h = h[:size] * factor
        h += g[have : have + size]
        have += m
    return common.mix64(h)


def samples(t: bytes, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The cover sample of a text: ranks, places q, and the first start of each; the last is where the next one's begin."""
    n = len(t) - length + 1
    if n <= 0:
        return np.empty(0, np.uint64), np.empty(0, np.int64), np.zeros(1, np.int64)
    h = _grams(np.frombuffer(t, np.uint8), gram)
    width = length - gram + 1
    places_ = np.arange(len(h), dtype=np.uint64)
    low = (h & ~np.uint64((1 << 28) - 1)) | places_ if len(h) < 1 << 28 else None
    if low is None:  # texts of over 256 MB: halves that overlap
        cut = n // 2
        a, b = samples(t[: cut + length - 1], length, gram), samples(t[cut:], length, gram)
        return np.concatenate([a[0], b[0]]), np.concatenate([a[1], b[1] + cut]), np.concatenate([a[2][:-1], b[2] + cut])
    have = 1
    while have * 2 <= width:
        low = np.minimum(low[:-have], low[have:])
        have *= 2
    if have < width:
        low = np.minimum(low[: len(low) - (width - have)], low[width - have :])
    q = (low & np.uint64((1 << 28) - 1)).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], q[1:] != q[:-1]]))
    q = q[first]
    return h[q], q, np.append(first, n)


#: Low bits of a rank in flight: alone in its batch, repeated there, or the mark of a repeated one.
ALONE, REPEATED, MARK = 0, 1, 2
_LOW = np.int64(3)


def _sampled(t: bytes, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    rank, q, p = samples(t, length, gram)
    return rank.view(np.int64) & ~_LOW, q, p


def _tied(reps: DataFrame, length: int, gram: int, hot: int, named: int) -> DataFrame:
    """rank, h of the samples whose rank occurs twice or more; ranks of over hot samples once more, marked, with their number as h.

    A task holds 16 bytes a sample of its partition, which the number of shuffle partitions bounds.
    """

    def sample(batches):
        ranks: list[np.ndarray] = []
        hashes: list[np.ndarray] = []
        for b in common.slices(batches):
            got = [_sampled(s.encode(), length, gram)[0] for s in b.column("text").to_pylist()]
            ranks += got
            hashes.append(np.repeat(b.column("h").to_numpy(), [len(x) for x in got]))
            if sum(map(len, hashes)) >= PACK:
                yield pack(ranks, hashes)
        if sum(map(len, hashes)):
            yield pack(ranks, hashes)

    def pack(ranks: list, hashes: list) -> pa.RecordBatch:
        rank, h = np.concatenate(ranks), np.concatenate(hashes)
        ranks.clear()
        hashes.clear()
        order = np.argsort(rank)
        rank, h = rank[order], h[order]
        first = np.flatnonzero(np.concatenate([[True], rank[1:] != rank[:-1]]))
        times = np.diff(np.append(first, len(rank)))
        alone = np.repeat(times == 1, times)
        mark = first[times > 1]
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate([rank | np.where(alone, ALONE, REPEATED), rank[mark] | MARK])), pa.array(np.concatenate([h, times[times > 1]]))], names=["rank", "h"])

    def keep_tied(batches):
        got = [(b.column("rank").to_numpy(), b.column("h").to_numpy()) for b in batches if b.num_rows]
        if not got:
            return
        rank, h = (np.concatenate(x) for x in zip(*got, strict=True))
        del got
        kind = rank & _LOW
        known, rank_, h_ = kind == REPEATED, rank & ~_LOW, h
        yield pa.RecordBatch.from_arrays([pa.array(rank_[known]), pa.array(h_[known])], names=["rank", "h"])
        kind, rank, h = kind[~known], rank_[~known], h_[~known]
        if not len(rank):
            return
        order = np.argsort(rank)
        kind, rank, h = kind[order], rank[order], h[order]
        first = np.flatnonzero(np.concatenate([[True], rank[1:] != rank[:-1]]))
        tied = np.repeat(np.diff(np.append(first, len(rank))) > 1, np.diff(np.append(first, len(rank)))) & (kind == ALONE)
        times = np.add.reduceat(np.where(kind == MARK, h, 1), first)
        many = np.flatnonzero(times > hot)
        many = many[np.argsort(-times[many], kind="stable")[:named]]
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([rank[tied], rank[first[many]] | MARK])), pa.array(np.concatenate([h[tied], times[many]]))], names=["rank", "h"])

    deal = F.when(F.col("rank").bitwiseAND(F.lit(3)) == REPEATED, F.col("h")).otherwise(F.shiftright("rank", 2))
    return reps.mapInArrow(sample, "rank long, h long").repartition(deal).mapInArrow(keep_tied, "rank long, h long")


CONTEXT = "rank long, k long, h long, far int, p int, n int, c binary"


def _contexts(rows: DataFrame, length: int, gram: int) -> DataFrame:
    """Of each text's tied samples: rank, the text's k and h, far (from the first start to the sample), p, n (n starts from p on), and the bytes [p, p + n - 1 + length).

    The bytes are null if another context of the pack is equal and earlier: then all these starts are later ones.
    """

    def run(batches):
        for b in common.slices(batches):
            for i in range(b.num_rows):
                t = b.column("text")[i].as_py().encode()
                rank, q, p = _sampled(t, length, gram)
                tied = np.flatnonzero(np.isin(rank, b.column("tied")[i].values.to_numpy()))
                n, k, h = np.diff(p), b.column("k")[i].as_py(), b.column("h")[i].as_py()
                for z in (tied[x : x + (1 << 13)] for x in range(0, len(tied), 1 << 13)):
                    c = [t[x : x + y - 1 + length] for x, y in zip(p[z].tolist(), n[z].tolist(), strict=True)]
                    m = len(c)
                    parts.append([rank[z], np.full(m, k), np.full(m, h), (q[z] - p[z]).astype(np.int32), p[z].astype(np.int32), n[z].astype(np.int32), c])
                    if sum(len(x[0]) for x in parts) > 1 << 13:
                        yield pack()
        if parts:
            yield pack()

    def pack() -> pa.RecordBatch:
        rank, k, h, far, p, n = (np.concatenate([x[i] for x in parts]) for i in range(6))
        c = [y for x in parts for y in x[6]]
        parts.clear()
        seen: dict[tuple, int] = {}
        for i in np.lexsort((p, h, k)).tolist():
            j = seen.setdefault((rank[i], far[i], n[i], c[i]), i)
            if i != j and (k[i], h[i], p[i]) != (k[j], h[j], p[j]):  # a repeated row is not earlier than itself
                c[i] = None
        return pa.RecordBatch.from_arrays([*map(pa.array, (rank, k, h, far, p, n)), pa.array(c, pa.binary())], names=["rank", "k", "h", "far", "p", "n", "c"])

    parts: list[list] = []
    return rows.mapInArrow(run, CONTEXT)


class Bucket:
    """The starts of some contexts, those of the earliest text first: document, start, and the strings."""

    def __init__(self, t: pa.Table, length: int):
        k, h, p, n = (t.column(c).to_numpy() for c in ("k", "h", "p", "n"))
        c = t.column("c").combine_chunks()
        c = c.chunk(0) if isinstance(c, pa.ChunkedArray) else c
        at = np.frombuffer(c.buffers()[1], np.int32)[c.offset : c.offset + len(c) + 1].astype(np.int64)
        order = np.lexsort((p, h, k))
        n = n[order]
        row = np.repeat(order, n)
        step = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
        self.k, self.h, self.start = k[row], h[row], p[row] + step
        self.length = length
        every = np.lib.stride_tricks.sliding_window_view(np.frombuffer(c.buffers()[2], np.uint8)[at[0] : at[-1]], length)
        self.strings = every[(at - at[0])[row] + step]

    def sort(self) -> tuple[np.ndarray, np.ndarray]:
        """The order of starts by the bytes of their strings, of equal ones the earliest first; and of each, in that order, the first equal one."""
        s = self.strings.view(f"S{self.length}").ravel()
        by = np.argsort(s, kind="stable")
        s = s[by]
        first = np.ones(len(by), bool)
        first[1:] = s[1:] != s[:-1]
        return by, by[np.maximum.accumulate(np.where(first, np.arange(len(by)), 0))]

    def hashes(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Two hashes of the strings of some starts."""
        words = np.zeros((len(i), -(-self.length // 8) * 8), np.uint8)
        words[:, : self.length] = self.strings[i]
        words = words.view("<u8")
        factors = common.places(2 * words.shape[1])
        return tuple(common.mix64((common.mix64(words + x) * f).sum(1, dtype=np.uint64)).view(np.int64) for x, f in ((_C, factors[: words.shape[1]]), (np.uint64(0), factors[words.shape[1] :])))


def _ranges(k: np.ndarray, h: np.ndarray, p: np.ndarray) -> pa.RecordBatch:
    """Starts as runs: k, h, a, b (exclusive); s is null."""
    order = np.lexsort((p, h, k))
    k, h, p = k[order], h[order], p[order]
    new = np.ones(len(p) + 1, bool)  # the last closes the last run
    new[1:-1] = (k[1:] != k[:-1]) | (h[1:] != h[:-1]) | (p[1:] > p[:-1] + 1)
    edge = np.flatnonzero(new)
    a, last = edge[:-1], edge[1:] - 1
    return pa.RecordBatch.from_arrays([pa.nulls(len(a), pa.int64()), pa.nulls(len(a), pa.int64()), pa.array(k[a], pa.int64()), pa.array(h[a], pa.int64()), pa.array(p[a], pa.int32()), pa.array(p[last] + 1, pa.int32())], names=["s", "t", "k", "h", "a", "b"])


FOUND = "s long, t long, k long, h long, a int, b int"


def _buckets(contexts: DataFrame, many: DataFrame, length: int, hot: int, slab: int) -> DataFrame:
    """Runs of starts whose strings also start earlier; of hot buckets, also the first start of each string in a slab, with two hashes s and t of the string.

    many: ranks to salt, and their numbers of samples.  A hot bucket that is not among them is streamed in slabs.
    """

    def judge(t: pa.Table, loose: bool = False):
        """Runs of later starts among some contexts; if loose, also the first start of each string, as other contexts may have it earlier."""
        x = Bucket(t, length)
        by, lead = x.sort()
        later = (x.k[by] != x.k[lead]) | (x.h[by] != x.h[lead]) | (x.start[by] != x.start[lead])  # a repeated row is not earlier than itself
        hit = by[later]
        yield _ranges(x.k[hit], x.h[hit], x.start[hit])
        if loose:
            f = by[lead == by]
            at = x.start[f].astype(np.int32)
            yield pa.RecordBatch.from_arrays([*map(pa.array, x.hashes(f)), pa.array(x.k[f]), pa.array(x.h[f]), pa.array(at), pa.array(at + 1)], names=["s", "t", "k", "h", "a", "b"])

    def run(batches):
        kept: list[pa.RecordBatch] = []
        salted: list[pa.RecordBatch] = []
        rows, running = 0, None  # running: the rank of a hot bucket under way
        for b in batches:
            known = pc.is_null(b.column("c"))
            settled, b = b.filter(known), b.filter(pc.invert(known))
            if settled.num_rows:
                yield pa.RecordBatch.from_arrays([pa.nulls(settled.num_rows, pa.int64()), pa.nulls(settled.num_rows, pa.int64()), settled.column("k"), settled.column("h"), settled.column("p"), pc.add(settled.column("p"), settled.column("n"))], names=["s", "t", "k", "h", "a", "b"])
            dealt = pc.is_valid(b.column("salt"))
            more, b = b.filter(dealt), b.filter(pc.invert(dealt))
            if more.num_rows:
                salted.append(more)
                if sum(x.num_rows for x in salted) >= slab:
                    yield from judge(pa.Table.from_batches(salted).combine_chunks(), loose=True)
                    salted = []
            if not b.num_rows:
                continue
            if running is not None:
                rank = b.column("rank").to_numpy()
                cut = len(rank) if (rank == running).all() else int(np.argmax(rank != running))
                for x in range(0, cut, slab):
                    yield from judge(pa.Table.from_batches([b.slice(x, min(slab, cut - x))]), loose=True)
                b = b.slice(cut)
                if not b.num_rows:
                    continue
                running = None
            kept.append(b)
            rows += b.num_rows
            if rows < slab:
                continue
            t = pa.Table.from_batches(kept).combine_chunks()
            rank = t.column("rank").to_numpy()
            last = int(np.argmax(rank == rank[-1]))  # the bucket that may go on
            if last:
                yield from judge(t.slice(0, last))
            kept, rows = t.slice(last).combine_chunks().to_batches(), len(rank) - last
            if rows > hot:
                for x in range(last, len(rank), slab):
                    yield from judge(t.slice(x, slab), loose=True)
                kept, rows, running = [], 0, rank[-1]
        if rows:
            yield from judge(pa.Table.from_batches(kept).combine_chunks())
        if salted:
            yield from judge(pa.Table.from_batches(salted).combine_chunks(), loose=True)

    salt = F.when(F.col("c").isNotNull(), F.pmod("h", F.ceil(F.col("times") / slab)))
    deal = F.when(F.col("c").isNull(), F.col("h")).when(F.col("salt").isNotNull(), F.xxhash64("rank", "salt")).otherwise(F.col("rank"))
    rows = contexts.join(F.broadcast(many), F.col("rank") == F.col("r"), "left").select(*contexts.columns, salt.alias("salt"))
    return rows.repartition(deal).sortWithinPartitions("rank", "salt").mapInArrow(run, FOUND)


def _later(found: DataFrame) -> DataFrame:
    """k, h, a, b of all runs of starts whose strings also start earlier."""
    def only(settled: bool):
        def run(batches):
            for b in batches:
                null = pc.is_null(b.column("s"))
                yield b.filter(null if settled else pc.invert(null))

        return run

    dealt = found.repartition("h")  # one exchange for both; Python keeps filters above it
    plain, strings = dealt.mapInArrow(only(True), FOUND), dealt.mapInArrow(only(False), FOUND)
    first = strings.groupBy("s", "t").agg(F.min(F.struct("k", "h", "a")).alias("e"), F.count("*").alias("times")).where("times > 1").select("s", "t", "e")
    more = strings.join(first, ["s", "t"]).where(F.struct("k", "h", "a") > F.col("e"))
    return plain.select("k", "h", "a", "b").unionByName(more.select("k", "h", "a", "b"))


def _cover(a: np.ndarray, b: np.ndarray, length: int) -> list[tuple[int, int]]:
    """Union of the bytes covered by strings from starts [a, b)."""
    out: list[tuple[int, int]] = []
    order = np.argsort(a, kind="stable")
    for x, y in zip(a[order].tolist(), (b[order] + length - 1).tolist(), strict=True):
        if out and x <= out[-1][1]:
            out[-1] = (out[-1][0], max(y, out[-1][1]))
        else:
            out.append((x, y))
    return out


def suffix_dedup(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, hot: int = HOT, slab: int = 1 << 13, digest: bool = False, named: int = NAMED) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row, and, unless digest, kept (the bytes that stay).

    A byte goes if a ``length``-byte string over it also starts earlier: in a smaller doc_id (then a
    smaller text hash), or earlier in the same text.  Null or empty or shorter texts lose nothing.
    Rows that repeat an id and a text are one text.  Empty table: no rows.
    """
    common.ship(docs.sparkSession)
    # h deals texts out; g tells apart, all but surely, texts of an equal h.
    shown = docs.select(common.key().alias("k"), common.text().alias("text")).withColumns({"h": F.xxhash64("text"), "g": F.hash("text")})
    first = shown.groupBy("h").agg(F.min(F.struct("k", "g")).alias("f"), F.count("*").alias("times")).select(F.col("h").alias("fh"), "f", "times")
    copy = (F.col("k") != F.col("f.k")) & (F.col("g") == F.col("f.g"))
    often = F.broadcast(common.frequent(first, docs.count()))
    told = shown.join(often, F.col("h") == F.col("fh")).where(copy).select("k", "h", "text", F.lit(True).alias("copy"))
    rest = shown.join(often, F.col("h") == F.col("fh"), "left").where(F.col("f").isNull() | ~copy).select("k", "h", "g", "text")
    texts = rest.join(first, F.col("h") == F.col("fh")).withColumn("copy", copy).select("k", "h", "text", "copy")
    reps = texts.where("not copy")
    tied = _tied(reps.select("h", "text"), length, gram, hot, named)
    marked = F.col("rank").bitwiseAND(F.lit(3)) == MARK
    by_text = tied.where(~marked).groupBy("h").agg(F.collect_list("rank").alias("tied")).select(F.col("h").alias("th"), "tied")  # a text's own samples
    many = tied.where(marked).select((F.col("rank") - MARK).alias("r"), F.col("h").alias("times"))
    contexts = _contexts(reps.join(by_text, F.col("h") == F.col("th")).select("k", "h", "text", "tied"), length, gram)
    spans = _later(_buckets(contexts, many, length, hot, slab)).groupBy("h").agg(F.collect_list(F.struct("k", "a", "b")).alias("s")).select(F.col("h").alias("sh"), "s")

    def run(batches):
        for b in common.slices(batches):
            n, gone, runs, sha, rest = [], [], [], [], []
            for t, k, copy, s in zip(b.column("text").to_pylist(), b.column("k").to_pylist(), b.column("copy").to_pylist(), b.column("s"), strict=True):
                t = t.encode()
                cover = [(0, len(t))] if copy and len(t) >= length else []
                if s.is_valid and not copy:
                    own = s.values.field("k").to_numpy() == k
                    cover = _cover(s.values.field("a").to_numpy()[own], s.values.field("b").to_numpy()[own], length)
                at, parts = 0, []
                for x, y in cover:
                    parts.append(t[at:x])
                    at = y
                kept = b"".join([*parts, t[at:]])
                n.append(len(t))
                gone.append(len(t) - len(kept))
                runs.append(len(cover))
                sha.append(hashlib.sha256(kept).hexdigest())
                rest.append(kept)
            out = {"doc_id": b.column("doc_id"), "n_bytes": pa.array(n, pa.int64()), "n_removed": pa.array(gone, pa.int64()), "n_spans": pa.array(runs, pa.int64()), "kept_sha256": pa.array(sha, pa.string())}
            yield pa.RecordBatch.from_pydict(out if digest else out | {"kept": pa.array(rest, pa.binary())})

    whole = texts.join(spans, (F.col("h") == F.col("sh")) & ~F.col("copy"), "left").select("k", "text", "copy", "s").unionByName(told.select("k", "text", "copy"), allowMissingColumns=True)
    return whole.withColumn("doc_id", F.when(F.col("k") != common.NULL_ID, F.col("k"))).mapInArrow(run, f"doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string{'' if digest else ', kept binary'}")


def op7_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup(common.table(spark, sf_dir, "documents"), digest=True)
