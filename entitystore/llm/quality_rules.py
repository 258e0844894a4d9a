"""Quality rules judged by an isolation forest on their statistics.

Rule statistics of every document are computed from arrays over many texts at once, and stored.
Every labelled row that passes the base rule makes the forest: the trees split at random between
the bounds that all of them span, the clean ones are counted in every tree's cells, and where few
lie the path is short, so a document unlike the clean ones soon falls alone.  The threshold on the
mean path length is calibrated on all of them too, each clean row judged by trees that count all
others but not itself.  Bounds, cells and scores are aggregated on the executors; the driver gets
one number a cell and two a score, and scores are steps of 1/GRID, so both stay few whatever the
input.  Scoring needs no shuffle: the forest, some 2 MB, goes to every task.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
EXTRA = ("n_upper", "n_alpha", "n_digits", "n_marks")
STATS = ", ".join(f"{c} long" for c in (*COUNTS, *EXTRA))
WINDOW = 5
FEATURES = 7
#: Steps of mean path lengths in one, so that rows of equal score can be counted.
GRID = 4096

_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
_HEAD = (np.arange(256) & 0xC0) != 0x80
_UPPER, _DIGIT, _MARK, _ALPHA = (np.zeros(256, bool) for _ in range(4))
_UPPER[65:91] = _DIGIT[48:58] = True
_MARK[[ord(c) for c in "!?"]] = True
_ALPHA[65:91] = _ALPHA[97:123] = _ALPHA[0xC3:0xF5] = True


def _repeat_words(w: common.Words) -> np.ndarray:
    """Words of each text that lie in a five-word window found twice or more in it."""
    n = len(w.start)
    out = np.zeros(len(w.first) - 1, np.int64)
    if n < WINDOW:
        return out
    p, h = common.places(WINDOW + 1), w.hash
    key = h[: n - WINDOW + 1] * p[0]
    for k in range(1, WINDOW):
        key = key + h[k : n - WINDOW + 1 + k] * p[k]
    doc = w.doc
    at = np.flatnonzero(doc[: n - WINDOW + 1] == doc[WINDOW - 1 :])
    key = common.mix64(key[at] + common.mix64(doc[at].astype(np.uint64) + p[WINDOW]))
    order = np.argsort(key)
    same = key[order][1:] == key[order][:-1]
    twice = at[order[np.concatenate([[False], same]) | np.concatenate([same, [False]])]]
    mark = np.zeros(n + 1, np.int64)
    np.add.at(mark, twice, 1)
    np.add.at(mark, twice + WINDOW, -1)  # a window ends inside its text
    return w.sums((np.cumsum(mark[:-1]) > 0).astype(np.int64))


def _dup_lines(texts: list[bytes]) -> list[int]:
    """Lines with a word that equal an earlier line of their text."""
    out = []
    for t in texts:
        lines = t.split(b"\n")
        if len(lines) == 1 or len(set(lines)) == len(lines):
            out.append(0)
            continue
        lines = [x for x in lines if x.split()]
        out.append(len(lines) - len(set(lines)))
    return out


def statistics(texts: list[bytes]) -> dict[str, np.ndarray]:
    """The rule statistics of some texts, as an array each."""
    w = common.Words(texts)

    def per_text(of: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(of[w.buf], dtype=np.int64)])
        return total[w.at[1:]] - total[w.at[:-1]]

    space = per_text(common._SPACE) - 1  # the line feed that joins the texts
    return {
        "n_words": np.diff(w.first).astype(np.int64),
        "word_chars": per_text(_HEAD) - 1 - space,
        "n_symbols": per_text(_SYMBOL),
        "n_dup_lines": np.array(_dup_lines(texts), np.int64),
        "n_repeat_words": _repeat_words(w),
        "n_upper": per_text(_UPPER),
        "n_alpha": per_text(_ALPHA),
        "n_digits": per_text(_DIGIT),
        "n_marks": per_text(_MARK),
    }


def base_failed(s: dict[str, np.ndarray]) -> np.ndarray:
    return (s["n_words"] < 10) | (100 * s["n_repeat_words"] > 20 * s["n_words"])


def features(s: dict[str, np.ndarray]) -> np.ndarray:
    """Rates, so that long and short documents compare."""
    n, c = np.maximum(1, s["n_words"]), np.maximum(1, s["word_chars"])
    return np.stack([
        np.minimum(2.0, s["n_symbols"] / n),
        np.minimum(20.0, c / n),
        np.minimum(1.0, s["n_dup_lines"] / n * 10),
        s["n_repeat_words"] / n,
        s["n_upper"] / np.maximum(1, s["n_alpha"]),
        np.minimum(1.0, s["n_digits"] / c),
        np.minimum(2.0, s["n_marks"] / n),
    ], axis=1)


@dataclass
class Forest:
    """Full trees of one depth, nodes in heap order: each inner node's feature and split; each cell's path length."""

    feature: np.ndarray
    value: np.ndarray
    path: np.ndarray | None = None
    threshold: float = -np.inf

    def cells(self, x: np.ndarray) -> Iterator[np.ndarray]:
        """Tree by tree, the cell of each row."""
        rows = np.arange(len(x))
        for f, v in zip(self.feature, self.value, strict=True):
            node = np.zeros(len(x), np.int64)
            while len(x) and node[0] < len(f):  # all rows are on one level
                node = 2 * node + 1 + (x[rows, f[node]] > v[node])
            yield node - len(f)

    def paths(self, x: np.ndarray, path: np.ndarray | None = None) -> np.ndarray:
        """Mean path length of each row in steps of 1/GRID, by the trees' path lengths or given ones."""
        total = np.zeros(len(x))
        for cell, p in zip(self.cells(x), self.path if path is None else path, strict=True):
            total += p[cell]
        return np.round(total / len(self.feature) * GRID) / GRID


def _expected(n: np.ndarray) -> np.ndarray:
    """Mean path length of a failed search among n rows."""
    m = np.maximum(2.0, n)
    return np.where(n < 2, 0.0, 2 * (np.log(m - 1) + 0.5772156649) - 2 * (m - 1) / m)


def grow(low: np.ndarray, high: np.ndarray, trees: int = 100, depth: int = 10, seed: int = 7) -> Forest:
    """Random trees that split between some bounds; rows are counted in their cells later."""
    rng = np.random.default_rng(seed)
    lo, hi = (np.broadcast_to(b, (trees, 1, len(b))) for b in (low, high))
    feature, value = [], []
    for _ in range(depth):
        wide = hi > lo
        k = np.argmax(np.where(wide, rng.random(wide.shape), -1.0), axis=2)[..., None]
        share = rng.random(k.shape)
        a, b = np.take_along_axis(lo, k, 2), np.take_along_axis(hi, k, 2)
        cut = np.where(b > a, a + (b - a) * share, np.inf)  # equal rows stay together
        here = np.arange(len(low)) == k
        halves = np.where(here, np.minimum(cut, hi), hi), np.where(here & (b > a), cut, lo)
        lo, hi = (np.stack(pair, axis=2).reshape(trees, -1, len(low)) for pair in ((lo, halves[1]), (halves[0], hi)))
        feature.append(k[..., 0])
        value.append(cut[..., 0])
    return Forest(np.concatenate(feature, axis=1).astype(np.int8), np.concatenate(value, axis=1))


def lengths(counts: np.ndarray, less: int = 0) -> np.ndarray:
    """Path length of every cell from the rows counted in it: to the first node of one row or none, or else to the cell, and on by the search among its rows.

    less: as many rows are taken off every count, 1 for a row that is counted itself.
    """
    depth = counts.shape[1].bit_length() - 1
    out = depth + _expected(counts - less)
    for level in range(depth - 1, -1, -1):
        counts = counts.reshape(len(counts), -1, 2).sum(2)
        out = np.where(np.repeat(counts - less <= 1, 2 ** (depth - level), axis=1), float(level), out)
    return out


def calibrate(score: np.ndarray, good: np.ndarray, bad: np.ndarray, spare: float = 0.002) -> float:
    """The path length below which documents go: the best balanced accuracy that rejects at most a share ``spare`` of good rows.

    score: ascending, different; good, bad: rows of each.
    """
    if not good.sum() or not bad.sum():
        return -np.inf
    cuts = np.concatenate([[-np.inf], (score[1:] + score[:-1]) / 2])
    lost, caught = (np.concatenate([[0], np.cumsum(n)[:-1]]) / n.sum() for n in (good, bad))
    return float(cuts[np.argmax(np.where(lost <= spare, caught - lost, -1.0))])


def _measured(rows: DataFrame, more: str = "") -> DataFrame:
    """doc_id, other columns kept, and the statistics of every text."""
    names = [f.split()[0] for f in more.split(", ") if f]

    def run(batches):
        for b in common.slices(batches):
            texts = [s.encode() for s in b.column("text").to_pylist()]
            parts = [statistics(g) for g in common.slabs(texts, len)] or [statistics([])]
            s = {c: np.concatenate([p[c] for p in parts]) for c in parts[0]}
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(b.column(c) for c in names), *(pa.array(s[c], pa.int64()) for c in s)], names=["doc_id", *names, *s])

    return rows.mapInArrow(run, f"doc_id long, {more + ', ' if more else ''}{STATS}")


def _labelled(stats: DataFrame, labels: DataFrame) -> DataFrame:
    """good and the features of every labelled document that passes the base rule; documents repeated in id and text count once."""
    known = labels.select(common.key().alias("doc_id"), (F.col("quality") == 1).alias("good")).where("good is not null").groupBy("doc_id").agg(F.min("good").alias("good"))
    rows = common.meet(stats.withColumn("doc_id", common.key()).distinct(), known, "doc_id", "text_hash")

    def run(batches):
        for b in batches:
            s = {c: b.column(c).to_numpy() for c in (*COUNTS, *EXTRA)}
            use = ~base_failed(s)
            x = features(s)[use]
            yield pa.RecordBatch.from_arrays([b.column("good").filter(pa.array(use)), *(pa.array(f) for f in x.T)], names=["good", *(f"x{k}" for k in range(FEATURES))])

    return rows.mapInArrow(run, f"good boolean, {', '.join(f'x{k} double' for k in range(FEATURES))}")


def _arrays(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    return np.stack([b.column(f"x{k}").to_numpy() for k in range(FEATURES)], axis=1), b.column("good").to_numpy(zero_copy_only=False).astype(bool)


def fit(stats: DataFrame, labels: DataFrame, scratch: common.Scratch) -> Forest | None:
    """A forest and its threshold from every labelled document.  None if no clean one passes the base rule."""
    rows, path = scratch.save(_labelled(stats, labels))
    at = [f"x{k}" for k in range(FEATURES)]
    ends = rows.agg(F.max("good").alias("any"), *(F.min(c).alias(f"low_{c}") for c in at), *(F.max(c).alias(f"high_{c}") for c in at)).first()
    if not ends["any"]:
        return None
    forest = grow(*(np.array([ends[f"{side}_{c}"] for c in at]) for side in ("low", "high")))
    trees, cells = len(forest.feature), forest.feature.shape[1] + 1
    bare = rows.sparkSession.sparkContext.broadcast(forest)

    def count(batches):
        for b in batches:
            x, good = _arrays(b)
            n = np.concatenate([np.bincount(c, minlength=cells) for c in bare.value.cells(x[good])])
            cell = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(cell, pa.int64()), pa.array(n[cell], pa.int64())], names=["cell", "n"])

    got = rows.mapInArrow(count, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(trees * cells, np.int64)
    counts[got["cell"].to_numpy()] = got["n"].to_numpy()
    counts = counts.reshape(trees, cells)
    forest.path = lengths(counts)
    judges = rows.sparkSession.sparkContext.broadcast((forest, lengths(counts, 1)))

    def judge(batches):
        forest, without = judges.value
        for b in batches:
            x, good = _arrays(b)
            score = np.concatenate([forest.paths(x[good], without), forest.paths(x[~good])])
            clean = np.arange(len(score)) < good.sum()
            yield pa.RecordBatch.from_arrays([pa.array(score), pa.array(clean.astype(np.int64)), pa.array((~clean).astype(np.int64))], names=["score", "good", "bad"])

    got = rows.mapInArrow(judge, "score double, good long, bad long").groupBy("score").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad")).orderBy("score").toArrow()
    forest.threshold = calibrate(*(got[c].to_numpy() for c in ("score", "good", "bad")))
    scratch.drop(path)
    return forest


def quality_rules(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, the rule statistics, base_failed, path_length and kept of every row of docs.

    kept is false where base_failed, else whether the mean path length reaches the threshold.
    Null or empty text: no words, so base_failed.  No usable labels: the forest judges nothing.
    Repeated rows: a row each.  Empty table: no rows.
    """
    spark = common.ship(docs.sparkSession)
    scratch = common.Scratch(spark)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), common.text().alias("text"))
    stats, _ = scratch.save(_measured(texts.withColumn("text_hash", F.xxhash64("text")), "text_hash long"))
    at = spark.sparkContext.broadcast(fit(stats, labels, scratch))

    def run(batches):
        forest = at.value
        for b in batches:
            s = {c: b.column(c).to_numpy() for c in (*COUNTS, *EXTRA)}
            failed = base_failed(s)
            path = forest.paths(features(s)) if forest else np.zeros(b.num_rows)
            kept = ~failed & (path >= forest.threshold if forest else True)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(b.column(c) for c in COUNTS), pa.array(failed), pa.array(kept), pa.array(path, pa.float64())], names=["doc_id", *COUNTS, "base_failed", "kept", "path_length"])

    schema = f"doc_id long, {', '.join(f'{c} long' for c in COUNTS)}, base_failed boolean, kept boolean, path_length double"
    return stats.mapInArrow(run, schema)


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels"))
