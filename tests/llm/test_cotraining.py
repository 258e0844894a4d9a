"""Co-training: what a round hands over, fits over given rows, and odd rows with a fitted model."""

from collections import Counter

import numpy as np
import pytest

from entitystore.llm import common, cotraining
from tests.llm.cases import docs, texts


def labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(4)
    rows = []
    for i in range(240):
        bad = i % 3 == 0
        words = rng.choice(["spam", "win", "cash", "click"] if bad else ["river", "stone", "field", "cloud"], 12).tolist() + rng.choice(["one", "two", "three", "four"], 12).tolist()
        rows.append((i, " ".join(words), "xx" if bad and i % 2 else "en", f"s{i % 4}", None if i % 50 == 0 else 100))
    rows += [rows[5], rows[6], (None, None, None, None, None), (None, "river stone", "en", "s1", 11), (7, "another text of an id", "en", "s1", 21), (900, "", "en", "s1", 0)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumns({"k": cotraining.F.lit(1), "y": cotraining.F.lit("clash")})


LABELS = [(i, int(i % 3 != 0), 0) for i in range(120)] + [(5, 1, 0), (None, 1, 0), (8, None, 0), (9999, 0, 0)]


def test_odd_rows_with_a_fitted_model(spark, table):
    got = cotraining.classify(table, labels(spark, LABELS)).collect()
    assert len(got) == table.count()
    by_id = {}
    for r in got:
        by_id.setdefault((r.doc_id, r.text), set()).add((r.score, r.kept))
    assert all(len(v) == 1 for v in by_id.values())  # repeated rows alike
    held = [(r.doc_id % 3 != 0) == r.kept for r in got if r.doc_id is not None and 120 <= r.doc_id < 240]
    assert np.mean(held) > 0.95
    assert cotraining.classify(table.limit(0), labels(spark, LABELS)).count() == 0
    assert all(r.kept for r in cotraining.classify(table, labels(spark, [(1, 1, 0), (2, 1, 0)])).collect())
    assert len(cotraining.classify(docs(spark), labels(spark, [(0, 1, 0), (1, 0, 0), (2, 1, 1), (3, 1, 0)])).collect()) == len(texts())


def test_rounds_hand_over_new_rows(spark, table):
    model = cotraining.fit(table, labels(spark, LABELS))
    different = len({r.text or "" for r in table.collect() if r.doc_id is None or r.doc_id >= 120 or r.doc_id == 7})
    assert len(model.rounds) == 3 and model.rounds[0][0] > 0
    assert all(sum(r[v] for r in model.rounds) <= different + 1 for v in (0, 1))  # a view gives a row once
    assert [cotraining.fit(table, labels(spark, LABELS)).rounds, model.threshold] == [model.rounds, model.threshold]


def test_given_equals_loops(spark, table):
    """One round after another by plain loops over words and cells."""
    drawn = spark.createDataFrame([(1, 1, True)], "k long, y int, train boolean")
    place = np.full(1 << cotraining.BITS, -1)
    _, known = cotraining._words([b"spam river one"])
    place[known] = np.arange(len(known))
    stored = cotraining._stored(table, drawn, place, common.Scratch(spark)).toArrow().combine_chunks().to_batches()[0]
    rng = np.random.default_rng(2)
    views = cotraining.Views(np.full(cotraining.RATES, 0.1), np.full(cotraining.RATES, 2.0), len(known))
    n_meta = cotraining.cell_matrix(np.zeros(1, int)).shape[1] + 1
    for _ in range(3):
        views.text.append((rng.normal(0, 2, len(known) + cotraining.RATES + 1), np.array([1.5, 0.2])))
        views.meta.append((rng.normal(0, 1.5, n_meta), np.array([1.1, -0.3])))
    for text in (True, False):
        when, label = views.given(stored, text)
        for i, r in enumerate(stored.to_pylist()):
            want = (-1, 0)
            for k, (w, c) in enumerate(views.text if text else views.meta):
                if text:
                    z = sum(w[j] for j in r["words"]) + sum(a * (x - 0.1) / 2.0 for a, x in zip(w[len(known) : -1], r["rates"], strict=True)) + w[-1]
                else:
                    z = w[:-1] @ cotraining.cell_matrix(np.array([r["cell"]]))[0] + w[-1]
                z = c[0] * z + c[1]
                if abs(z) >= cotraining.SURE[k]:
                    want = (k, int(z > 0))
                    break
            assert (when[i], label[i] if when[i] >= 0 else 0) == want
    assert Counter(np.unique(when).tolist())[-1] == 1


def test_fit_over_given_rows_equals_one_over_all(spark):
    rng = np.random.default_rng(3)
    views = cotraining.Views(np.zeros(cotraining.RATES), np.ones(cotraining.RATES), 5)

    def made(n):
        words = [sorted(set(rng.integers(0, 5, 3).tolist())) for _ in range(n)]
        rate = rng.normal(0, 1, (n, cotraining.RATES))
        dense = np.concatenate([np.array([[float(j in w) for j in range(5)] for w in words]), rate], 1)
        return words, rate, dense, (dense[:, 0] + rate[:, 0] + rng.normal(0, 0.5, n) > 0.5).astype(int)

    _, _, x, y = made(60)
    words, rate, more, label = made(80)
    given = spark.createDataFrame([(0, w, r.tolist(), int(c)) for w, r, c in zip(words, rate, label, strict=True)], "cell int, words array<short>, rates array<double>, label long")
    n = np.bincount(label, minlength=2)
    got = cotraining.fit_text(np.zeros(5 + cotraining.RATES + 1), x, y, given.repartition(3), n.astype(float), views, rounds=60)
    ys = np.concatenate([y, label])
    want = cotraining.logistic(np.concatenate([x, more]), ys.astype(float), cotraining.balanced(np.bincount(y, minlength=2) + n)[ys], rounds=3000)
    both = np.concatenate([np.concatenate([x, more]), np.ones((140, 1))], 1)
    assert np.abs(both @ got - both @ want).max() < 0.2 and np.corrcoef(both @ got, both @ want)[0, 1] > 0.999
