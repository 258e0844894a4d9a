"""Best-fit packing by pattern packing with non-negative least squares.

The histogram of piece lengths (at most ``size`` bins, whatever the input) comes to the driver.
Patterns of few pieces whose lengths fill a sequence are enumerated from it, their repeat counts
are fitted to the histogram by non-negative least squares, rounded down, and what is left is
packed best-fit by counts.  The plan is run-length coded: a run says that pattern P fills
sequences s .. s+n-1.  Pieces find their places by their rank among pieces of their length, which
is counted per partition first, so no task sees all pieces of a common length.
"""

from __future__ import annotations

import zlib
from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common
from .token_counts import tokenizer

VOCABULARY = "byte_bpe_50k.json"
SIZE = 2048
END = 0
#: What the byte-level tokenizer splits words by, and its one special string.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SPECIAL = "<|endoftext|>"

_PLAIN = np.zeros(256, bool)
_PLAIN[[9, 10, 13, *range(32, 127)]] = True


# -- ids ----------------------------------------------------------------------------------------


@lru_cache(maxsize=2)
def _fast(path: str):
    """The same vocabulary in a quicker library, used where both are known to agree."""
    import json

    import tiktoken

    with open(path, encoding="utf-8") as f:
        vocabulary = json.load(f)["model"]["vocab"]
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte_of = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(x for x in range(256) if x not in shown)}
    ranks = {bytes(byte_of[c] for c in k): v for k, v in vocabulary.items() if k != SPECIAL}
    return tiktoken.Encoding("same", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def _agreed(s: str, raw: bytes) -> bool:
    """Whether all characters of s are of classes that the libraries' patterns treat alike: ASCII text and Latin letters."""
    if s.isascii():
        return bool(_PLAIN[np.frombuffer(raw, np.uint8)].all()) and SPECIAL not in s
    code = np.frombuffer(s.encode("utf-32-le"), np.uint32)
    wide = code > 127
    return bool((_PLAIN[code[~wide].astype(np.uint8)]).all() and ((code[wide] >= 0xC0) & (code[wide] < 0x180)).all()) and SPECIAL not in s


def token_ids(texts: list[str], path: str) -> list[np.ndarray]:
    """Ids of every text as the tokenizers library gives them, without added special tokens."""
    out: list[np.ndarray | None] = [None] * len(texts)
    fast, rest = _fast(path), []
    for i, s in enumerate(texts):
        if _agreed(s, s.encode()):
            out[i] = fast.encode_to_numpy(s, disallowed_special=()).astype("<u4") if s else np.empty(0, "<u4")
        else:
            rest.append(i)
    for part in common.slabs(rest, lambda i: len(texts[i]), 1 << 19):
        for i, e in zip(part, tokenizer(path).encode_batch_fast([texts[i] for i in part], add_special_tokens=False), strict=True):
            out[i] = np.array(e.ids, "<u4")
    return out


# -- plan ---------------------------------------------------------------------------------------


def _nnls(rows: np.ndarray, weights: np.ndarray, b: np.ndarray, rounds: int = 300) -> np.ndarray:
    """min |Ax - b| with x >= 0, by accelerated projected gradient.

    Column j of A has weights[j] at rows[j], so products cost a few steps a pattern.
    """

    def times(x: np.ndarray) -> np.ndarray:
        return np.bincount(rows.ravel(), (weights * x[:, None]).ravel(), len(b))

    def back(r: np.ndarray) -> np.ndarray:
        return (weights * r[rows]).sum(1)

    v = np.ones(len(rows))
    for _ in range(20):  # the largest eigenvalue, for the step
        v = back(times(v))
        norm = float(np.linalg.norm(v)) or 1.0
        v /= norm
    step = 1.0 / (1.1 * norm)
    x = y = np.zeros(len(rows))
    t = 1.0
    for _ in range(rounds):
        new = np.maximum(0.0, y - step * back(times(y) - b))
        s = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y, x, t = new + (t - 1) / s * (new - x), new, s
    return x


def plan(histogram: dict[int, int], size: int = SIZE) -> list[tuple[tuple[int, ...], int]]:
    """Runs (lengths of a sequence's pieces, number of such sequences) that use up the histogram."""
    left = np.zeros(size + 1, np.int64)
    for n, c in histogram.items():
        left[n] += c
    runs: list[tuple[tuple[int, ...], int]] = []

    def put(lengths: tuple[int, ...], times: int) -> None:
        if times > 0:
            for n in lengths:
                left[n] -= times
            runs.append((lengths, times))

    put((size,), int(left[size]))
    # Patterns: pairs that fill a sequence exactly or nearly, and triples whose two smaller pieces fill the gap.
    have = np.flatnonzero(left)
    patterns: set[tuple[int, ...]] = set()
    for n in have[::-1]:
        gap = size - int(n)
        fits = have[have <= gap]
        for m in fits[-2:]:
            patterns.add((int(n), int(m)) if m <= n else (int(m), int(n)))
        for m in fits[:: max(1, len(fits) // 6)]:
            rest = fits[fits <= gap - m]
            if len(rest):
                patterns.add(tuple(sorted((int(n), int(m), int(rest[-1])), reverse=True)))
    patterns = {p for p in patterns if sum(p) >= size - size // 64}
    if patterns:
        ordered = sorted(patterns)
        used = np.array(sorted({n for p in ordered for n in p}))
        shape = np.array([(*p, *(p[-1:] * (3 - len(p)))) for p in ordered])
        weights = np.array([[1.0] * len(p) + [0.0] * (3 - len(p)) for p in ordered])
        x = _nnls(np.searchsorted(used, shape), weights, left[used].astype(np.float64))
        for j in np.argsort(-x, kind="stable"):
            p = ordered[j]
            need = {n: p.count(n) for n in p}
            put(p, min([int(np.floor(x[j] + 1e-6)), *(int(left[n]) // k for n, k in need.items())]))
    # Residuals: best fit by counts, the longest first, each gap filled with the longest piece that fits.
    top = size
    while True:
        while top > 0 and left[top] <= 0:
            top -= 1
        if top == 0:
            break
        lengths, room = [top], size - top
        left[top] -= 1
        n = min(room, top)
        while n > 0:
            while n > 0 and left[n] <= 0:
                n -= 1
            if n == 0:
                break
            lengths.append(n)
            left[n] -= 1
            room -= n
            n = min(n, room)
        p = tuple(lengths)
        need = {n: p.count(n) for n in p}
        more = min(int(left[n]) // k for n, k in need.items())
        for n in p:
            left[n] += 1
        put(p, more + 1)
    return runs


def places(runs: list[tuple[tuple[int, ...], int]]) -> dict[str, np.ndarray]:
    """For each length, in order of rank: from which rank a stretch begins, its first sequence, and the offset in it.

    A stretch is the part of a run that one slot of its pattern takes.
    """
    rows, first = [], 0
    seen: dict[int, int] = {}
    for lengths, times in runs:
        at = 0
        for n in lengths:
            rows.append((n, seen.get(n, 0), first, at))
            seen[n] = seen.get(n, 0) + times
            at += n
        first += times
    a = np.array(sorted(rows), np.int64).reshape(-1, 4)
    return {"length": a[:, 0], "rank": a[:, 1], "sequence": a[:, 2], "offset": a[:, 3]}


# -- operator -----------------------------------------------------------------------------------

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
RANKED = f"{PIECES}, part int, nth long"
PIECE_NAMES = ["doc_id", "piece", "start", "length", "ids_crc32"]


def pieces(docs: DataFrame, path: str, size: int = SIZE) -> DataFrame:
    """Pieces of every text's ids and the end id; only longer ones are cut, the odd rest first.

    part and nth number a piece among its partition's pieces of its length.
    """
    common.ship(docs.sparkSession)

    def run(batches):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        so_far = Counter()
        for b in common.slices(batches):
            ids = token_ids(b.column("text").to_pylist(), path)
            doc, piece, start, length, crc, nth = [], [], [], [], [], []
            for d, x in zip(b.column("doc_id").to_pylist(), ids, strict=True):
                x = np.append(x, np.uint32(END)).astype("<u4")
                odd = len(x) % size or size
                cuts = [0, *range(odd, len(x) + 1, size)]
                for k, (s, e) in enumerate(zip(cuts, cuts[1:], strict=False)):
                    doc.append(d)
                    piece.append(k)
                    start.append(s)
                    length.append(e - s)
                    crc.append(zlib.crc32(x[s:e].tobytes()))
                    nth.append(so_far[e - s])
                    so_far[e - s] += 1
            yield pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64()), pa.array([part] * len(doc), pa.int32()), pa.array(nth, pa.int64())], names=["doc_id", "piece", "start", "length", "ids_crc32", "part", "nth"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), common.text().alias("text")).mapInArrow(run, RANKED)


def pack(docs: DataFrame, path: str, size: int = SIZE) -> DataFrame:
    """Packs all pieces of docs into few sequences of at most ``size`` tokens.

    One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.  A null or
    empty text is a piece of one token, the end id.  Repeated rows are packed each; ties between
    pieces of a length are broken by where they are stored.  Empty table: no rows.
    """
    spark = docs.sparkSession
    cut, _ = common.Scratch(spark).save(pieces(docs, path, size))
    counted = cut.groupBy("length", "part").count()
    histogram = {r[0]: r[1] for r in cut.groupBy("length").count().collect()}  # at most ``size`` rows
    at = spark.sparkContext.broadcast(places(plan(histogram, size)))
    base = counted.withColumn("base", F.sum("count").over(Window.partitionBy("length").orderBy("part")) - F.col("count"))
    ranked = cut.join(base.drop("count"), ["part", "length"]).select(*PIECE_NAMES, (F.col("base") + F.col("nth")).alias("rank"))

    def run(batches):
        table = at.value
        key = table["length"] << 40 | table["rank"]
        for b in batches:
            n, rank = b.column("length").to_numpy(), b.column("rank").to_numpy()
            i = np.searchsorted(key, n << 40 | rank, side="right") - 1
            yield pa.RecordBatch.from_arrays(
                [*(b.column(c) for c in PIECE_NAMES), pa.array(table["sequence"][i] + rank - table["rank"][i], pa.int64()), pa.array(table["offset"][i], pa.int64())],
                names=[*PIECE_NAMES, "sequence_id", "offset"],
            )

    return ranked.mapInArrow(run, f"{PIECES}, sequence_id long, offset long")


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(common.table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY))
