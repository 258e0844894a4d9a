"""SimHash near-duplicates by a segment-popcount embedding and a grid range join.

A 64-bit fingerprint is cut into 32 segments of two bits; its embedding is the vector of their bit
counts (0, 1 or 2), kept in unary so that the Manhattan distance of two embeddings is the number of
differing bits.  That distance is at most the Hamming distance of the fingerprints.

The range join finds all pairs of embeddings at a Manhattan distance of three or less.  Such a pair is at a
distance of one or less in one half of its segments, so there is a grid of unit cells for each half: an
embedding is at home in its own cell and probes the neighbours in which one count is greater by one.
Two that are within one of each other in a half share a cell where one of them is at home.  Pairs in a
cell are kept if their Manhattan distance, then their Hamming distance, is at most three.

Only different fingerprints enter the grid.  A cell gives links that span its linked groups, not all
pairs.  Cells are counted before they are dealt out.  The members of one with more than ``cell`` are
within three of each other in the other half, so they go to finer grids, one for each quarter of that
half, in the same way; a cell of these that is still too large is cut into blocks, and blocks meet two by two.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .components import components

DISTANCE = 3
SHINGLE = 3
SEED = 42
CELL = 1 << 15

_ODD = 0x5555555555555555


def fingerprint(t: bytes, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """The unsigned fingerprint of a UTF-8 text."""
    w = t.lower().split()  # bytes: A-Z and ASCII white space only
    if not w:
        return 0
    if len(w) <= shingle:
        return xxhash.xxh64_intdigest(b" ".join(w), seed)
    line = b" ".join(w)
    size = np.fromiter(map(len, w), np.int64, len(w)) + 1
    end = np.cumsum(size)
    start = (end - size)[: len(w) - shingle + 1].tolist()
    stop = (end - 1)[shingle - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(line[a:b], seed) for a, b in zip(start, stop, strict=True)], np.uint64)
    ones = np.zeros(64, np.int64)
    for k in range(0, len(h), 1 << 15):
        ones += np.unpackbits(h[k : k + (1 << 15)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, hashed: bool = False) -> DataFrame:
    """doc_id and fp (the fingerprint as a signed long) of every row, and h (the text's hash) if hashed."""
    common.ship(docs.sparkSession)
    kept = ["doc_id", "h"] if hashed else ["doc_id"]

    def run(batches):
        for b in common.slices(batches):
            fp = np.array([fingerprint(s.encode()) for s in b.column("text").to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), pa.array(fp, pa.int64())], names=[*kept, "fp"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), common.text().alias("text"))
    rows = rows.withColumn("h", F.xxhash64("text")) if hashed else rows
    return rows.mapInArrow(run, ", ".join(f"{c} long" for c in [*kept, "fp"]))


def embed(fp: np.ndarray) -> np.ndarray:
    """The bit counts of the two-bit segments, in unary."""
    odd, other = np.uint64(_ODD), (fp >> np.uint64(1)) & np.uint64(_ODD)
    low = fp & odd
    return (low | other) | ((low & other) << np.uint64(1))


def near(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether fingerprints a and b link: the embeddings' distance first, then the exact one."""
    out = np.bitwise_count(embed(a) ^ embed(b)) <= DISTANCE
    if out.any():
        out &= np.bitwise_count(a ^ b) <= DISTANCE
    return out


def span(fp: np.ndarray) -> list[tuple[int, int]]:
    """Links (positions) that connect what the links among some different fingerprints connect.

    A pivot takes all that link with it; groups of two pivots are compared only if the pivots are
    near enough for members to link, and only until one link is found.
    """
    n = len(fp)
    out: list[tuple[int, int]] = []
    free, member, pivots = np.ones(n, bool), [], []
    for p in range(n):
        if not free[p]:
            continue
        hit = np.flatnonzero(near(fp, fp[p]))
        own = hit[free[hit]]
        free[own] = False
        pivots.append(p)
        member.append(own)
        out += [(p, int(x)) for x in own if x != p]
    if len(pivots) < 2:
        return out
    root = list(range(len(pivots)))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    at = fp[pivots]
    for k in range(1, len(pivots)):
        for j in np.flatnonzero(np.bitwise_count(at[:k] ^ at[k]) <= 3 * DISTANCE).tolist():
            if find(j) == find(k):
                continue
            for x in member[k]:
                y = np.flatnonzero(near(fp[member[j]], fp[x]))
                if len(y):
                    out.append((int(x), int(member[j][y[0]])))
                    root[find(j)] = find(k)
                    break
    return out


def _runs(batches, names: list[str]):
    """Arrays of some columns by batch, so cut that a run of an equal first column is whole."""
    kept = None
    for b in batches:
        got = [b.column(c).to_numpy() for c in names]
        if kept is not None:
            got = [np.concatenate([x, y]) for x, y in zip(kept, got, strict=True)]
        k = got[0]
        if len(k) == 0:
            continue
        cut = len(k) - int(np.argmax((k != k[-1])[::-1])) if (k != k[-1]).any() else 0
        if cut:
            yield [x[:cut] for x in got]
        kept = [x[cut:] for x in got]
    if kept is not None and len(kept[0]):
        yield kept


def _places(grid: int, at: Column, segments: int) -> list[Column]:
    """cell, home of an embedding in a grid: its own cell, and those where one of its counts (unary, from the lowest bits of ``at``) is greater by one; null where a count is at its most."""

    def place(x: Column, home: bool) -> Column:
        return F.struct(F.xxhash64(F.lit(grid), x).alias("cell"), F.lit(int(home)).alias("home"))

    out = [place(at, True)]
    for s in range(segments):
        more = at.bitwiseOR(F.shiftleft(at, 1).bitwiseOR(F.lit(1 << 2 * s).cast("long")).bitwiseAND(F.lit(3 << 2 * s).cast("long")))
        out.append(F.when(more != at, place(more, False)))
    return out


def _halves(e: Column) -> tuple[Column, Column]:
    low = F.lit((1 << 32) - 1).cast("long")
    return e.bitwiseAND(low), F.shiftrightunsigned(e, 32)


def _coarse(e: Column) -> Column:
    """Places of an embedding in the grids of both halves."""
    a, b = _halves(e)
    return F.array(*_places(0, a, 16), *_places(1, b, 16))


def _fine(e: Column, half: Column, cell: Column) -> Column:
    """Places in the grids of the quarters of the other half, inside a cell of a half (0 or 1)."""
    a, b = _halves(e)
    other = F.when(half == 0, b).otherwise(a)
    quarters = (other.bitwiseAND(F.lit((1 << 16) - 1).cast("long")), F.shiftrightunsigned(other, 16))
    every = F.array(*(x for g, q in enumerate(quarters) for x in _places(2 + g, q, 8)))
    return F.transform(every, lambda x: F.when(x.isNotNull(), F.struct(F.xxhash64(cell, x["cell"]).alias("cell"), x["home"].alias("home"))))


def _meet(batches):
    """Links within the cells of sorted rows; a cell where none is at home has none."""
    for k, fp, ids, home in _runs(batches, ["cell", "fp", "id", "home"]):
        f = fp.view(np.uint64)
        edge = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1], [True]]))
        size, first = np.diff(edge), edge[:-1]
        lived = np.add.reduceat(home, first) > 0
        two = first[(size == 2) & lived]
        ok = two[near(f[two], f[two + 1])]
        found = [np.stack([ids[ok], ids[ok + 1]], 1)]
        some = (size > 2) & lived
        for s, n in zip(first[some].tolist(), size[some].tolist(), strict=True):
            if e := span(f[s : s + n]):
                found.append(ids[s + np.array(e)])
        z = np.concatenate(found)
        yield pa.RecordBatch.from_arrays([pa.array(z[:, 0]), pa.array(z[:, 1])], names=["u", "v"])


def links(classes: DataFrame, scratch: common.Scratch, cell: int = CELL) -> DataFrame:
    """u, v (ids) of links that span the groups of linked fingerprints.  classes: fp (all different), id."""
    odd, u = F.lit(_ODD).cast("long"), F.col("fp")
    other = F.shiftrightunsigned(u, 1).bitwiseAND(odd)
    low = u.bitwiseAND(odd)
    unary = low.bitwiseOR(other).bitwiseOR(F.shiftleft(low.bitwiseAND(other), 1))

    def placed(rows: DataFrame, places: Column) -> DataFrame:
        """A row for each place of a row, with the place's number among them."""
        return rows.select(*rows.columns, F.posexplode(places).alias("nth", "x")).where("x is not null").select("fp", "id", "e", "nth", "x.cell", "x.home")

    def large(rows: DataFrame) -> DataFrame:
        """cell, count of the cells with more than ``cell`` members."""
        return scratch.save(rows.groupBy("cell").count().where(F.col("count") > cell))[0]

    def met(rows: DataFrame) -> DataFrame:
        return rows.select("cell", "fp", "id", "home").repartition("cell").sortWithinPartitions("cell").mapInArrow(_meet, "u long, v long")

    rows = placed(classes.select("fp", "id", common.once(unary).alias("e")), _coarse(F.col("e")))
    hot = large(rows)
    if not hot.take(1):
        return scratch.save(met(rows))[0]
    half = F.when(F.col("nth") < 17, 0).otherwise(1)
    inside = common.meet(rows, hot.select("cell"), "cell", "fp", how="left_semi").select("fp", "id", "e", half.alias("half"), F.col("cell").alias("of"))
    fine, _ = scratch.save(inside.select("fp", "id", "e", F.explode(_fine(F.col("e"), F.col("half"), F.col("of"))).alias("x")).where("x is not null").select("fp", "id", "x.cell", "x.home"))
    found = [met(common.meet(rows, hot.select("cell"), "cell", "fp", how="left_anti"))]
    still = large(fine)
    if not still.take(1):
        return scratch.save(found[0].unionByName(met(fine)))[0]
    found.append(met(common.meet(fine, still.select("cell"), "cell", "fp", how="left_anti")))
    # Cells too large for one task: members go to blocks, and each two blocks of a cell meet in a task.
    n = F.ceil(F.col("count") / (cell // 2)).cast("int")
    members = common.meet(fine, still, "cell", "fp").select("cell", "fp", "id", n.alias("n")).withColumn("i", F.pmod(F.xxhash64("fp", F.lit(5)), "n").cast("int"))
    pairs = members.select("cell", "fp", "id", F.explode(F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda j: F.struct(F.least(j, F.col("i")).alias("a"), F.greatest(j, F.col("i")).alias("b")))).alias("p"))

    def block(t: pa.Table) -> pa.Table:
        ids, fp = t.column("id").to_numpy(), t.column("fp").to_numpy().view(np.uint64)
        e = ids[np.array(span(fp), np.int64).reshape(-1, 2)]
        return pa.table({"u": e[:, 0], "v": e[:, 1]})

    found.append(pairs.select("cell", "fp", "id", "p.a", "p.b").groupBy("cell", "a", "b").applyInArrow(block, "u long, v long"))
    return scratch.save(found[0].unionByName(found[1]).unionByName(found[2]))[0]


def _classes(fps: DataFrame, scratch: common.Scratch, cell: int, *least: Column) -> DataFrame:
    """Of each different fingerprint: fp, times (its rows), root (the least fingerprint reachable over links) and the given least values of its component.

    Links join fingerprints, not ids: ids that repeat, the null id among them, join nothing.
    """
    names = [f"m{i}" for i in range(len(least))]
    classes, _ = scratch.save(fps.groupBy("fp").agg(F.count("*").alias("times"), *(F.min(c).alias(n) for c, n in zip(least, names, strict=True))))
    far = components(links(classes.select("fp", F.col("fp").alias("id")), scratch, cell), scratch).select("u", "root")
    roots, _ = scratch.save(far.unionByName(far.select(F.col("root").alias("u"), "root").distinct()))  # a root is its own
    # Most fingerprints have no link and are components of their own.
    met = classes.drop("times").join(roots, F.col("fp") == F.col("u")).select("root", *names)
    of_root = met.groupBy("root").agg(F.count("*").alias("size"), *(F.min(n).alias(n) for n in names))
    linked = common.join_keyed(roots, of_root, "root", roots.count(), "size").select("u", "root", *(F.col(n).alias(f"r{i}") for i, n in enumerate(names)))
    both = classes.join(linked, F.col("fp") == F.col("u"), "left")
    return both.select("fp", "times", F.coalesce("root", "fp").alias("root"), *(F.coalesce(f"r{i}", n).alias(n) for i, n in enumerate(names)))


def simhash_groups(docs: DataFrame, cell: int = CELL) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of every row of docs.

    component_id is the least doc_id reachable over links of fingerprints with at most three
    differing bits.  Null or empty text: fingerprint zero, linked like any other.  Repeated rows: a
    row each, alike.  A null id counts as an id and is shown as null.  Rows that share an id but not
    a text join no groups; groups whose least id is the same show the same component_id.  Empty
    table: no rows.
    """
    scratch = common.Scratch(docs.sparkSession)
    fps, _ = scratch.save(fingerprints(docs))
    labelled = _classes(fps, scratch, cell, common.key()).select("fp", F.col("m0").alias("component"), "times")
    shown = F.when(F.col("component") != common.NULL_ID, F.col("component"))
    return common.join_keyed(fps, labelled, "fp", fps.count()).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), shown.alias("component_id"))


def one_of_each(docs: DataFrame, cell: int = CELL, block: int = common.BLOCK) -> DataFrame:
    """The rows of docs that stay: of each group of near duplicates the document (id and text) of the least id, then of the least text hash.

    Rows that repeat an id and a text are one document, and one of them stays.  Null or empty text:
    fingerprint zero, a group like any other.  A null id is one id below all others; documents that
    share an id but not a text join no groups.  Further columns stay.  Empty table: no rows.

    Texts are shuffled only if more documents go, or are repeated, than may be broadcast.
    """
    scratch = common.Scratch(docs.sparkSession)
    fps, _ = scratch.save(fingerprints(docs, hashed=True))
    first = F.struct(common.key().alias("k"), F.col("h").alias("h"))
    stay, _ = scratch.save(_classes(fps, scratch, cell, first).select("m0.k", "m0.h").distinct())
    keys = fps.groupBy(common.key().alias("_k"), F.col("h").alias("_h")).agg(F.count("*").alias("_times"))
    told, _ = scratch.save(keys.join(stay.select(F.col("k").alias("_k"), F.col("h").alias("_h"), F.lit(True).alias("_stays")), ["_k", "_h"], "left").where("_times > 1 or _stays is null"))
    met = common.attach(docs.withColumns({"_k": common.key(), "_h": F.xxhash64(common.text())}), told, ["_k", "_h"], block)
    again = met.where("_stays").dropDuplicates(["_k", "_h"])
    return met.where("_times is null").unionByName(again).select(*docs.columns)


def op6_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_groups(common.table(spark, sf_dir, "documents"))
