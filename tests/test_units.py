import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from entitystore.functions import intervals, sharding
from entitystore.functions.predicates import Predicate
from entitystore.operators import diff
from entitystore.plans import fold
from entitystore.types import ColumnId, infer


@pytest.mark.parametrize("full, name, code", [("asset_I", "asset", "I"), ("asset_A_I", "asset_A", "I"), ("asset_I_A88888_333_asset_S", "asset_I_A88888_333_asset", "S")])
def test_column_id(full, name, code):
    c = ColumnId.parse(full)
    assert (c.name, c.code, str(c)) == (name, code, full)


def test_infer():
    assert [infer(x) for x in (1, 2**40, 1.5, "a", True, dt.datetime.now())] == ["I", "L", "D", "S", "B", "DT"]
    with pytest.raises(TypeError):
        infer([])


@pytest.mark.parametrize(
    "p, yes, no",
    [
        (Predicate("=", (1,)), [1], [2, None]), (Predicate("!=", (1,)), [2], [1, None]), (Predicate("!=", (1, 2)), [3], [1, 2]),
        (Predicate(">", (1,)), [2], [1, 0]), (Predicate(">=", (1,)), [1], [0]), (Predicate("<", (1,)), [0], [1]), (Predicate("<=", (1,)), [1], [2]),
        (Predicate("between", (1, 3)), [1, 2, 3], [0, 4, None]), (Predicate("between", (3, 1)), [], [2]), (Predicate("in", (1, 2)), [1], [3]),
        (Predicate("is_null"), [None], [1]), (Predicate("not_null"), [1], [None]),
    ],
)
def test_predicates(spark, p, yes, no):
    assert all(p.test(v) for v in yes) and not any(p.test(v) for v in no)
    rows = spark.createDataFrame([(v,) for v in yes + no], "v int").select(p.column(F.col("v")).alias("t")).collect()
    assert [r.t for r in rows] == [True] * len(yes) + [False] * len(no)


def test_predicate_text_and_errors():
    assert Predicate("=", ("ABC",), ignore_case=True).test("aBc")
    assert not Predicate("=", ("ABC",), ignore_case=True, strict=True).test("aBc")
    assert not Predicate(">=", (dt.datetime(2024, 1, 1),), strict=True).test(dt.datetime(2024, 1, 1))
    for bad in (("between", (1,)), ("like", ("a",)), ("=", ())):
        with pytest.raises(ValueError):
            Predicate(*bad)


@pytest.mark.parametrize(
    "interval, ts, offset, want",
    [
        ("weekly", "2021-02-22 00:00:00", 0, "2021-02-22T00:00:00Z"), ("weekly", "2021-03-24 01:15:05", 0, "2021-03-22T00:00:00Z"), ("monthly", "2021-03-24 01:15:05", -1, "2021-02-01T00:00:00Z"),
        ("yearly", "2021-03-24 01:15:05", 1, "2022-01-01T00:00:00Z"), ("daily", "2021-03-24 01:15:05", 0, "2021-03-24T00:00:00Z"), ("hourly", "2021-03-24 01:15:05", -2, "2021-03-23T23:00:00Z"), ("single", "2021-03-24 01:15:05", 5, intervals.EPOCH),
    ],
)
def test_intervals(spark, interval, ts, offset, want):
    assert spark.range(1).select(intervals.start(interval, F.lit(ts).cast("timestamp"), offset)).first()[0] == want


def test_fixed_interval(spark):
    at = F.lit("2021-01-01 00:15:00").cast("timestamp")
    assert spark.range(1).select(intervals.fixed_start(43_200_000, at), intervals.fixed_start(43_200_000, at, 1)).first()[:] == ("2021-01-01T00:00:00Z", "2021-01-01T12:00:00Z")
    assert intervals.parse("WEEKLY") == "weekly" and intervals.parse("never") is None


def test_string_hash(spark):
    def hashed(s):
        h = 0
        for c in s:
            h = (31 * h + ord(c)) & 0xFFFFFFFF
        return h - 2**32 if h >> 31 else h

    words = ["", "a", "1", "123456789", "polygenelubricants", "é√ü", "x" * 500]
    got = spark.createDataFrame([(w,) for w in words], "w string").select(sharding.string_hash(F.col("w"))).collect()
    assert [r[0] for r in got] == [hashed(w) for w in words]


def simulate(ops, stored):
    """One operation after another, as a sequential writer takes them."""
    have = {k: (v, -1, True) for k, v in stored.items()}
    for pos, (k, version, op) in enumerate(ops):
        if op == "write" and (k not in have or have[k][0] <= version):
            have[k] = (version, pos, True)
        elif op == "delete" and k in have and have[k][0] <= version:
            have[k] = (version, pos, False)
    return {k: (v, p) for k, (v, p, alive) in have.items() if alive}


@pytest.mark.parametrize("seed", range(3))
def test_fold_equals_sequence(spark, seed):
    rng = random.Random(seed)
    ops = [(rng.randrange(40), rng.randrange(6), rng.choice(["write", "write", "delete"])) for _ in range(400)]
    stored = {k: rng.randrange(6) for k in rng.sample(range(40), 15)}
    df = spark.createDataFrame([(k, v, i, o) for i, (k, v, o) in enumerate(ops)], "entity_id long, version long, pos long, op string")
    old = spark.createDataFrame(list(stored.items()), "entity_id long, version long")
    assert {r.entity_id: (r.version, -1 if r.pos is None else r.pos) for r in fold.live(df, old).collect()} == simulate(ops, stored)
    assert {r.entity_id: (r.version, r.pos) for r in fold.live(df).collect()} == simulate(ops, {})


def test_diff_name():
    assert diff.diff_table("Vulns", "WEEKLY", "Name", "plus") == "vulns_weekly_name_plus"
