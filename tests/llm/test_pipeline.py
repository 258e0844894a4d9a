"""The pipeline's stages on odd tables, and decontamination and packing against brute force."""

import re
from collections import Counter

import pytest

import corpus_pipeline
from entitystore.llm import common
from tests.conftest import DATA
from tests.llm.cases import docs, nothing, texts
from tests.llm.test_corpus_ops import told
from tests.llm.test_text_ops import check_packing

COLUMNS = list(corpus_pipeline.COLUMNS)


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES[:-1])
def test_odd_rows(spark, name, stage):
    """Nulls, empty and long texts, repeated rows and ids, columns whose names clash; and no rows at all."""
    rows = texts()
    got = stage(spark, docs(spark, rows), DATA)
    assert got.columns == COLUMNS
    out = Counter((r.doc_id, r.text or "") for r in got.collect())
    if name == "quality_classifier":
        assert all(n in (0, Counter((i, t or "") for i, t in rows)[x]) for x, n in out.items())  # repeated rows alike
    if name == "line_dedup":
        assert {i for i, _ in out} <= {i for i, _ in rows} and out[None, "null id"] == 2
    if name == "simhash_near_dedup":
        assert out[None, "null id"] == 1 and all(n == 1 for n in out.values()) and out[rows[2]] == 1
    if name == "benchmark_decontamination":
        assert out == Counter((i, t or "") for i, t in rows)
    none = stage(spark, nothing(spark), DATA)
    assert none.columns == COLUMNS and none.count() == 0


def test_decontamination_stage_by_brute_force(spark):
    items = [(str(r.item_id), r.text) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    wins = {}
    for i, t in items:
        w = told(t)
        for s in range(max(1, len(w) - 7) if w else 0):
            wins.setdefault(tuple(w[s : s + 8]), set()).add(i)
    a, b = (" ".join(t.split()) for _, t in items[:2])
    rows = [(1, f"Before, {a}! after"), (2, f"{a} and {b}"), (3, f"{b.upper()}\n"), (4, "clean text of no item at all, long enough for a window"), (5, None), (6, ""), (3, f"{b.upper()}\n"), (None, f"x {a} y {a}"), (7, " ".join(a.split()[:7]))]
    want = Counter()
    for i, t in rows:
        w, hit, found = told(t), set(), set()
        for n in {len(x) for x in wins}:
            for s in range(len(w) - n + 1):
                if items_ := wins.get(tuple(w[s : s + n])):
                    hit |= set(range(s, s + n))
                    found |= items_
        if len(found) >= 2:
            continue
        if hit:
            parts = re.split(r"([^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+)", t)
            t = parts[0] + "".join(parts[2 * k + 1] + parts[2 * k + 2] for k in range(len(w)) if k not in hit)
        want[(i, t)] += 1
    got = corpus_pipeline.benchmark_decontamination(spark, docs(spark, rows), DATA)
    assert Counter((r.doc_id, r.text) for r in got.collect()) == want and len(want) >= 6


def test_packing_stage_by_brute_force(spark):
    rows = [*texts()[:20], (5, None), (None, "a"), (None, "a")]
    used, least = check_packing(rows, corpus_pipeline.best_fit_packing(spark, docs(spark, rows), DATA).collect(), 2048)
    assert used <= 1.1 * least + 1
    assert corpus_pipeline.best_fit_packing(spark, nothing(spark), DATA).count() == 0


def test_intermediate_tables_go(spark):
    before = len(common._FOLDERS)
    with common.temporary(spark):
        scratch = common.Scratch(spark)
        _, path = scratch.save(spark.range(3))
        assert spark.read.parquet(path).count() == 3
    assert len(common._FOLDERS) == before
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        spark.read.parquet(path)
