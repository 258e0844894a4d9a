"""Quality classifier by co-training of a text view and a metadata view.

The text view sees which words a document has (hashed, punctuation off, chosen by how well they tell
classes apart) and rates of the quality rules; the metadata view sees language, source, stored length,
and length by language and by source.  Each is a logistic regression.  Labelled rows are a bounded sample;
unlabelled ones are all documents, each different text once: one pass turns every whole text into a short
row of features, which is stored.  In each round both views score all of these, and those of which a view
is sure by its calibration go to the other view with the label it gives them.  A view gives a row once,
so later rounds hand over new rows only.  A view is then fitted on labelled rows and all it was given:
the text view by gradients that are summed over the cluster, the metadata view by counts of its cells.

Both views are calibrated on labelled rows held out of training, their log-odds are combined there, and
the threshold is set there.  Scoring reads every whole text, without a shuffle.

A row is good if its label is quality 1 and toxic 0.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .quality_rules import features as rates
from .quality_rules import statistics

BITS = 18
CHOSEN = 1024
RATES = 7
#: Odds of which a view must be sure to hand a row over, by round, on the calibrated scale: the surest rows go first.
SURE = tuple(float(np.log(x)) for x in (49, 19, 9))
#: Values of the parts of a metadata cell, and of its two crosses, hashed.
LANGS, SOURCES, SIZES, CROSS = 16, 64, 24, (64, 256)
#: Marks that are not part of a word, for the text view.
_MARKS = b".,;:!?\"'()[]{}|#*$%&<>/\\=_~`^+-"
_BARE = bytes.maketrans(_MARKS, b" " * len(_MARKS))


def _words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Text and hashed word of each different word of each text."""
    w = common.Words([t.translate(_BARE) for t in texts], lower=True)
    pair = np.unique((w.doc.astype(np.uint64) << np.uint64(BITS)) | (w.hash >> np.uint64(64 - BITS)))
    return (pair >> np.uint64(BITS)).astype(np.int64), (pair & np.uint64((1 << BITS) - 1)).astype(np.int64)


def cells(lang: list, source: list, n_chars: list) -> np.ndarray:
    """The metadata of rows as numbers of cells: hashed language and source, and the stored length by powers of two; null has a place of its own."""
    import zlib

    a = np.array([0 if x is None else 1 + zlib.crc32(x.encode()) % (LANGS - 1) for x in lang], np.int64)
    b = np.array([0 if x is None else 1 + zlib.crc32(x.encode()) % (SOURCES - 1) for x in source], np.int64)
    n = np.array([0 if x is None else 1 + min(SIZES - 2, int(np.log2(1 + max(0, x)))) for x in n_chars], np.int64)
    return (a * SOURCES + b) * SIZES + n


def cell_matrix(cell: np.ndarray) -> np.ndarray:
    """The metadata view of cells: language, source, length, and length by language and by source."""
    n, b, a = cell % SIZES, cell // SIZES % SOURCES, cell // (SIZES * SOURCES)
    x = np.zeros((len(cell), LANGS + SOURCES + SIZES + sum(CROSS)))
    rows, base = np.arange(len(cell)), 0
    for at, size in ((a, LANGS), (b, SOURCES), (n, SIZES), ((a * 31 + n) % CROSS[0], CROSS[0]), ((b * 31 + n) % CROSS[1], CROSS[1])):
        x[rows, base + at] = 1
        base += size
    return x


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, l2: float = 0.2, rounds: int = 150) -> np.ndarray:
    """Coefficients, the constant last, by accelerated gradient steps."""
    n = len(x)
    x = np.concatenate([x, np.ones((n, 1))], 1)
    weight = np.ones(n) if weight is None else weight
    v = np.ones(x.shape[1])
    for _ in range(15):
        v = x.T @ (weight * (x @ v))
        norm = float(np.linalg.norm(v)) or 1.0
        v /= norm
    step = 1.0 / (0.25 * norm * 1.1 + l2)
    penalty = np.full(x.shape[1], l2)
    penalty[-1] = 1e-3
    w = u = np.zeros(x.shape[1])
    t = 1.0
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ u, -30, 30)))
        new = u - step * (x.T @ (weight * (p - y)) + penalty * u)
        s = (1 + np.sqrt(1 + 4 * t * t)) / 2
        u, w, t = new + (t - 1) / s * (new - w), new, s
    return w


def _logit(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return x @ w[:-1] + w[-1]


@dataclass
class Model:
    """words: weight of each hashed word; rate: mean, scale and weight of each rate; meta: of the metadata view; blend: of both views' log-odds; rounds: rows that the text and the metadata view handed over."""

    words: np.ndarray
    rate: tuple[np.ndarray, np.ndarray, np.ndarray]
    constant: float
    meta: np.ndarray
    blend: np.ndarray
    threshold: float
    rounds: list[tuple[int, int]] = field(default_factory=list)

    def text_logit(self, texts: list[bytes]) -> np.ndarray:
        doc, word = _words(texts)
        of = self.words[word]
        mean, scale, w = self.rate
        return np.bincount(doc, of, len(texts)) + ((rates(statistics(texts)) - mean) / scale) @ w + self.constant

    def score(self, text_logit: np.ndarray, meta_logit: np.ndarray) -> np.ndarray:
        z = _logit(np.stack([text_logit, meta_logit], 1), self.blend)
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


@dataclass
class TextRows:
    """Rows of the text view: chosen words by row, and rates."""

    row: np.ndarray
    word: np.ndarray
    rate: np.ndarray

    @classmethod
    def of(cls, b: pa.RecordBatch) -> TextRows:
        words = b.column("words")
        size = np.diff(words.offsets.to_numpy())
        return cls(np.repeat(np.arange(b.num_rows), size), words.flatten().to_numpy().astype(np.int64), b.column("rates").flatten().to_numpy().reshape(b.num_rows, RATES))

    def logit(self, w: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
        n = len(w) - RATES - 1
        return np.bincount(self.row, w[:n][self.word], len(self.rate)) + (self.rate - mean) / scale @ w[n:-1] + w[-1]

    def gradient(self, r: np.ndarray, n: int, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
        """Sum over rows of r times the row's features."""
        return np.concatenate([np.bincount(self.word, r[self.row], n), r @ ((self.rate - mean) / scale), [r.sum()]])


def _calibrated(z: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Slope and constant that make log-odds of a view's."""
    return logistic(z[:, None], y, l2=0.1)


class Views:
    """Both views of stored rows, and the rounds: weights and calibrations so far."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, n: int):
        self.mean, self.scale, self.n = mean, scale, n
        self.text: list[tuple[np.ndarray, np.ndarray]] = []
        self.meta: list[tuple[np.ndarray, np.ndarray]] = []

    def given(self, b: pa.RecordBatch, text: bool) -> tuple[np.ndarray, np.ndarray]:
        """Of each row: the round in which a view hands it over (-1: none so far), and the label it gives."""
        when, label = np.full(b.num_rows, -1), np.zeros(b.num_rows, np.int64)
        rows = TextRows.of(b) if text else cell_matrix(b.column("cell").to_numpy().astype(np.int64))
        for r, (w, c) in enumerate(self.text if text else self.meta):
            z = c[0] * (rows.logit(w, self.mean, self.scale) if text else _logit(rows, w)) + c[1]
            new = (when < 0) & (np.abs(z) >= SURE[min(r, len(SURE) - 1)])
            when[new], label[new] = r, z[new] > 0
        return when, label


def _stored(docs: DataFrame, drawn: DataFrame, place: np.ndarray, scratch: common.Scratch) -> DataFrame:
    """k, h, y (-1: unlabelled), words (numbers of the chosen), rates, cell of every document, stored."""

    def run(batches):
        for b in common.slices(batches):
            texts = [s.encode() for s in b.column("text").to_pylist()]
            doc, word = _words(texts)
            at = place[word]
            doc, at = doc[at >= 0], at[at >= 0]
            cut = np.searchsorted(doc, np.arange(len(texts) + 1)).astype(np.int32)
            measured = rates(statistics(texts)).reshape(-1)
            yield pa.RecordBatch.from_pydict({
                "k": b.column("k"), "h": b.column("h"), "y": b.column("y"), "words": pa.ListArray.from_arrays(pa.array(cut), pa.array(at.astype(np.int16))),
                "rates": pa.ListArray.from_arrays(pa.array(np.arange(0, len(measured) + 1, RATES, dtype=np.int32)), pa.array(measured)),
                "cell": pa.array(cells(b.column("lang").to_pylist(), b.column("source").to_pylist(), b.column("n_chars").to_pylist()).astype(np.int32)),
            })

    rows = docs.select(common.key().alias("k"), common.text().alias("text"), F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"), F.col("n_chars").cast("long").alias("n_chars"))
    rows = rows.withColumn("h", F.xxhash64("text")).join(F.broadcast(drawn.select("k", "y")), "k", "left").withColumn("y", F.coalesce("y", F.lit(-1)))
    return scratch.save(rows.mapInArrow(run, "k long, h long, y int, words array<short>, rates array<double>, cell int"))[0]


def _telling(docs: DataFrame, drawn: DataFrame) -> np.ndarray:
    """The number of each hashed word among those chosen (-1: not chosen): the difference of its shares of both classes, in standard errors, over labelled rows for training."""

    def run(batches):
        for b in common.slices(batches):
            doc, word = _words([s.encode() for s in b.column("text").to_pylist()])
            y = b.column("y").to_numpy()
            pair, times = np.unique(y[doc] * (1 << BITS) + word, return_counts=True)
            of, size = np.unique(y, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([of, pair >> BITS]).astype(np.int32)), pa.array(np.concatenate([np.full(len(of), -1), pair & ((1 << BITS) - 1)]).astype(np.int32)), pa.array(np.concatenate([size, times]).astype(np.int64))], names=["y", "word", "n"])

    rows = docs.select(common.key().alias("k"), common.text().alias("text")).join(F.broadcast(drawn.where("train").select("k", "y")), "k")
    got = rows.mapInArrow(run, "y int, word int, n long").groupBy("y", "word").agg(F.sum("n").alias("n")).toArrow()  # at most two a hashed word
    y, word, times = (got.column(c).to_numpy() for c in ("y", "word", "n"))
    seen, n = np.zeros((2, 1 << BITS)), np.zeros((2, 1))
    some = word >= 0
    seen[y[some], word[some]] = times[some]
    n[y[~some], 0] = times[~some]
    share = (seen + 0.5) / (n + 1)
    z = np.abs(share[1] - share[0]) / np.sqrt((share * (1 - share) / (n + 1)).sum(0))
    z[seen.sum(0) < 3] = 0
    chosen = np.argsort(-z, kind="stable")[:CHOSEN]
    chosen = chosen[z[chosen] > 2.0]
    place = np.full(1 << BITS, -1)
    place[chosen] = np.arange(len(chosen))
    return place


def _summed(rows: DataFrame, f: Callable[[pa.RecordBatch], np.ndarray]) -> np.ndarray | None:
    """The sum over all rows of a vector that f gives for each batch; None without rows."""

    def run(batches):
        total = None
        for b in batches:
            if b.num_rows:
                total = f(b) if total is None else total + f(b)
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total)), pa.int32()), pa.array(total, pa.float64())], names=["i", "x"])

    got = sorted(rows.mapInArrow(run, "i int, x double").groupBy("i").agg(F.sum("x").alias("x")).collect())
    return np.array([r.x for r in got]) if got else None


def balanced(n: np.ndarray) -> np.ndarray:
    """Weights of a row of class 0 and 1 that make both classes count alike."""
    share = np.maximum(1e-3, n / max(1, n.sum()))
    return 0.5 / share


def fit_text(w: np.ndarray, x: np.ndarray, y: np.ndarray, given: DataFrame | None, n_given: np.ndarray, views: Views, l2: float = 0.2, rounds: int = 25) -> np.ndarray:
    """The text view on labelled rows (x, y) and on all rows that were given to it, from weights w on; gradients over the given rows are summed over the cluster."""
    weight = balanced(np.bincount(y, minlength=2) + n_given)
    if given is None:
        return logistic(x, y.astype(float), weight[y], l2)
    ones = np.concatenate([x, np.ones((len(x), 1))], 1)
    penalty = np.full(len(w), l2)
    penalty[-1] = 1e-3
    v = np.ones(len(w))
    for _ in range(15):
        v = ones.T @ (weight[y] * (ones @ v))
        norm = float(np.linalg.norm(v)) or 1.0
        v /= norm
    step = 1.0 / (0.25 * norm * 1.3 * (1 + n_given.sum() / len(y)) + l2)

    def gradient(at: np.ndarray) -> np.ndarray:
        def of(b: pa.RecordBatch) -> np.ndarray:
            rows, label = TextRows.of(b), b.column("label").to_numpy()
            p = 1 / (1 + np.exp(-np.clip(rows.logit(at, views.mean, views.scale), -30, 30)))
            return rows.gradient(weight[label] * (p - label), views.n, views.mean, views.scale)

        p = 1 / (1 + np.exp(-np.clip(ones @ at, -30, 30)))
        return ones.T @ (weight[y] * (p - y)) + _summed(given, of) + penalty * at

    u, t = w, 1.0
    for _ in range(rounds):
        new = u - step * gradient(u)
        s = (1 + np.sqrt(1 + 4 * t * t)) / 2
        u, w, t = new + (t - 1) / s * (new - w), new, s
    return w


def fit(docs: DataFrame, labels: DataFrame, max_labelled: int = 4000, rounds: int = len(SURE), spare: float = 0.002) -> Model | None:
    """Both views after co-training.  None if the labels of documents hold no good or no bad row.

    At most ``max_labelled`` labels are used, drawn by a hash of their ids; of an id with several texts the one of
    the least hash is used.
    """
    spark, scratch = docs.sparkSession, common.Scratch(docs.sparkSession)
    known = labels.select(common.key().alias("k"), ((F.col("quality") == 1) & (F.col("toxic") == 0)).cast("int").alias("y")).where("y is not null").groupBy("k").agg(F.min("y").alias("y"))
    here = known.join(docs.select(common.key().alias("k")).distinct(), "k", "left_semi")
    got = sorted(here.orderBy(F.xxhash64("k", F.lit(11)), "k").limit(max_labelled).collect())
    few = len(got) < 30 or any(len({r.y for r in part}) < 2 for part in (got[2::3], [r for i, r in enumerate(got) if i % 3 != 2]))
    if len({r.y for r in got}) < 2:
        return None
    drawn = spark.createDataFrame([(r.k, r.y, few or i % 3 != 2) for i, r in enumerate(got)], "k long, y int, train boolean")
    train = {r.k for i, r in enumerate(got) if few or i % 3 != 2}

    place = _telling(docs, drawn)
    n = int((place >= 0).sum())
    every = _stored(docs, drawn, place, scratch)
    mine = every.where("y >= 0").groupBy("k", "y").agg(F.min(F.struct("h", "cell", "words", "rates")).alias("x")).orderBy("k").select("k", "y", "x.*").toArrow().combine_chunks()
    b = mine.to_batches()[0]
    y = b.column("y").to_numpy().astype(np.int64)
    teach = np.isin(b.column("k").to_numpy(), list(train))
    held = np.ones(len(y), bool) if few else ~teach
    rows = TextRows.of(pa.RecordBatch.from_pydict({"words": b.column("words").cast(pa.list_(pa.int16())), "rates": b.column("rates")}))
    views = Views(rows.rate[teach].mean(0), rows.rate[teach].std(0) + 1e-3, n)
    dense = np.zeros((len(y), n + RATES))
    dense[rows.row, rows.word] = 1
    dense[:, n:] = (rows.rate - views.mean) / views.scale
    x = (dense, cell_matrix(b.column("cell").to_numpy().astype(np.int64)))
    # Copies of a text are one row of the pool.
    pool, _ = scratch.save(every.where("y < 0").groupBy("h").agg(F.min(F.struct("cell", "words", "rates")).alias("x")).select("x.*"))

    told: list[tuple[int, int]] = []
    text, meta = np.zeros(n + RATES + 1), np.zeros(x[1].shape[1] + 1)
    from_meta, n_meta = None, np.zeros(2)
    from_text = np.zeros((2, LANGS * SOURCES * SIZES))
    for r in range(rounds + 1):
        text = fit_text(text, x[0][teach], y[teach], from_meta, n_meta, views)
        cell = np.flatnonzero(from_text.sum(0))
        xs = np.concatenate([x[1][teach], cell_matrix(cell), cell_matrix(cell)])
        ys = np.concatenate([y[teach], np.zeros(len(cell), int), np.ones(len(cell), int)])
        times = np.concatenate([np.ones(teach.sum()), from_text[0, cell], from_text[1, cell]])
        meta = logistic(xs, ys.astype(float), times * balanced(np.bincount(ys, times, 2))[ys])
        for v, w in ((0, text), (1, meta)):
            (views.text, views.meta)[v].append((w, _calibrated(_logit(x[v][held], w), y[held].astype(float))))
        if r == rounds:
            break
        now = views

        def handed(b: pa.RecordBatch, r: int = r, now: Views = now) -> np.ndarray:
            """What the text view gives by label and cell, and what the metadata view gives by label, this round."""
            when, label = now.given(b, True)
            out = np.bincount((label * from_text.shape[1] + b.column("cell").to_numpy())[when == r], minlength=2 * from_text.shape[1])
            when, label = now.given(b, False)
            return np.concatenate([out, np.bincount(label[when == r], minlength=2)]).astype(float)

        new = _summed(pool, handed)
        new = np.zeros(from_text.size + 2) if new is None else new
        from_text += new[:-2].reshape(2, -1)
        n_meta = n_meta + new[-2:]
        told.append((int(new[:-2].sum()), int(new[-2:].sum())))
        if n_meta.sum():

            def chosen(batches, now: Views = now):
                for b in batches:
                    when, label = now.given(b, False)
                    yield pa.RecordBatch.from_arrays([*b.columns, pa.array(label)], names=[*b.schema.names, "label"]).filter(pa.array(when >= 0))

            from_meta, _ = scratch.save(pool.mapInArrow(chosen, "cell int, words array<short>, rates array<double>, label long"))

    logits = np.stack([_logit(x[0][held], text), _logit(x[1][held], meta)], 1)
    blend = logistic(logits, y[held].astype(float), l2=0.1)
    if (blend[:2] < 0).any():  # a view that would count against itself knows nothing, and does not count
        side = int(np.argmax(blend[:2]))
        alone = logistic(logits[:, [side]], y[held].astype(float), l2=0.1)
        blend = np.zeros(3)
        blend[[side, 2]] = alone
    z = _logit(logits, blend)
    good, bad = np.sort(z[y[held] == 1]), np.sort(z[y[held] == 0])
    cuts = np.concatenate([[-np.inf], np.sort(z), [np.inf]])
    cuts = (cuts[1:] + cuts[:-1]) / 2
    cuts = cuts[np.isfinite(cuts)]
    lost, caught = np.searchsorted(good, cuts) / len(good), np.searchsorted(bad, cuts) / len(bad)
    value = np.where(lost <= spare, caught - 2 * lost, -1)
    best = cuts[value == value.max()]
    cut = float(best[len(best) // 2])
    words = np.where(place >= 0, text[np.maximum(place, 0)], 0.0) if n else np.zeros(1 << BITS)
    return Model(words, (views.mean, views.scale, text[n:-1]), float(text[-1]), meta, blend, float(1 / (1 + np.exp(-cut))), told)


def classify(docs: DataFrame, labels: DataFrame, max_labelled: int = 4000) -> DataFrame:
    """doc_id, text_logit, meta_logit, score (of being good) and kept of every row, and the other columns of docs.

    Null text: empty.  Null metadata: a value of its own.  Repeated rows: a row each, alike.  Labels
    without a good or without a bad row: everything is kept, with score 1.  Empty table: no rows.
    """
    spark = common.ship(docs.sparkSession)
    at = spark.sparkContext.broadcast(fit(docs, labels, max_labelled))

    def run(batches):
        model = at.value
        for b in common.slices(batches):
            n = b.num_rows
            a = c = np.zeros(n)
            score, kept = np.ones(n), np.ones(n, bool)
            if model:
                a = model.text_logit([(s or "").encode() for s in b.column("text").to_pylist()])
                c = _logit(cell_matrix(cells(b.column("lang").to_pylist(), b.column("source").to_pylist(), b.column("n_chars").to_pylist())), model.meta)
                score = model.score(a, c)
                kept = score >= model.threshold
            new = {"text_logit": pa.array(a, pa.float64()), "meta_logit": pa.array(c, pa.float64()), "score": pa.array(score, pa.float64()), "kept": pa.array(kept)}
            yield pa.RecordBatch.from_pydict({x: b.column(x) for x in ("doc_id", "text", "lang", "source", "n_chars")} | new)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"), F.col("n_chars").cast("long").alias("n_chars"))
    return rows.mapInArrow(run, "doc_id long, text string, lang string, source string, n_chars long, text_logit double, meta_logit double, score double, kept boolean")


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels")).drop("text", "lang", "source", "n_chars")
