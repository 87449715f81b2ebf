import math
import random
from decimal import Decimal

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import framegauge.functions.quantiles as q
from framegauge.operators.describe import describe

PROBABILITIES = [0.0, 0.25, 0.5, 0.75, 0.95, 1.0]


def brute_linear(values, probabilities=PROBABILITIES):
    return [float(v) for v in np.quantile(np.array(values, dtype=float), probabilities)]


def brute_nearest(values, p):
    ordered = sorted(values)
    return ordered[math.floor((len(ordered) - 1) * p + 0.5)]


def test_both_routes_agree_with_brute_force(spark):
    rng = random.Random(7)
    shapes = {
        "uniform": [rng.uniform(-5, 5) for _ in range(4000)],
        "hot": [1.0 if rng.random() < 0.4 else rng.gauss(0, 100) for _ in range(4000)],
        "few": [float(rng.choice([1, 2, 3])) for _ in range(4000)],
        "heavy_tail": [rng.paretovariate(0.4) for _ in range(4000)],
    }
    df = spark.createDataFrame(list(zip(*shapes.values())), ", ".join(f"{c} double" for c in shapes))
    valid, nans = q.rankable_counts(df, list(shapes))
    for held in (10_000_000, 200):
        found = q.linear_quantiles(df, PROBABILITIES, valid, nans, held)
        near = q.nearest_quantiles(df, [0.25, 0.75], valid, nans, held)
        for name, values in shapes.items():
            assert found[name] == pytest.approx(brute_linear(values), rel=1e-12)
            assert near[name] == [brute_nearest(values, 0.25), brute_nearest(values, 0.75)]


def test_integers_beyond_double_precision_terminate(spark):
    base = 2**60
    values = [base + i for i in range(300)]
    df = spark.createDataFrame([(v,) for v in values], "v bigint")
    found = q.order_statistics(df, {"v": [0, 150, 299]}, {"v": 300}, held_values=6)
    assert found == {("v", r): float(values[r]) for r in (0, 150, 299)}


def test_values_too_close_for_doubles_in_groups_and_decimals(spark):
    rows = [(2**60 + i, Decimal(10**20 + i)) for i in range(200)]
    df = spark.createDataFrame(rows, "v bigint, d decimal(30,0)").withColumn("k", F.lit("a"))
    for c in ("v", "d"):
        got = q.grouped_median(df, ["k"], c, held_values=1, group_values=8).first()[c]
        assert got == pytest.approx(float(rows[100][c == "d"]), rel=1e-15)
    found = q.order_statistics(df, {"d": [100]}, {"d": 200}, held_values=4)
    assert found["d", 100] == float(10**20 + 100)


def test_other_numeric_types(spark):
    rows = [(i, float(i) / 3, Decimal(i) / 4) for i in range(500)]
    df = spark.createDataFrame(rows, "s int, f float, d decimal(10,2)").selectExpr(
        "cast(s as smallint) s", "f", "d"
    )
    valid, nans = q.rankable_counts(df, ["s", "f", "d"])
    for held in (1_000_000, 12):
        found = q.linear_quantiles(df, [0.5, 0.9], valid, nans, held)
        assert found["s"] == pytest.approx([249.5, 449.1])
        assert found["f"] == pytest.approx([249.5 / 3, 449.1 / 3], rel=1e-6)
        assert found["d"] == pytest.approx([62.375, 112.275], abs=0.01)


def test_nan_sorts_last_and_spoils_linear_percentiles(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (math.nan,), (None,)], "v double")
    valid, nans = q.rankable_counts(df, ["v"])
    assert (valid, nans) == ({"v": 3}, {"v": 1})
    near = q.nearest_quantiles(df, [0.25, 1.0], valid, nans)["v"]
    assert near[0] == 2.0 and math.isnan(near[1])
    for held in (1000, 1):
        row = describe(df, held_values=held).first()
        assert row["median"] == 2.5 and math.isnan(row["p25"]) and row["max"] == 3.0


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(
    st.lists(
        st.one_of(st.integers(-3, 3).map(float), st.floats(-1e6, 1e6, allow_nan=False)),
        min_size=1,
        max_size=60,
    )
)
def test_narrowing_is_exact_for_any_values(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "v double").coalesce(1)
    ranks = sorted({0, len(values) // 2, len(values) - 1})
    found = q.order_statistics(df, {"v": ranks}, {"v": len(values)}, held_values=2)
    ordered = sorted(values)
    assert [found["v", r] for r in ranks] == [ordered[r] for r in ranks]


def test_grouped_median_with_a_hot_group(spark):
    rng = random.Random(3)
    rows = []
    for i in range(6000):
        key = "hot" if rng.random() < 0.4 else None if rng.random() < 0.3 else f"k{i % 40}"
        value = None if rng.random() < 0.05 else 7.0 if rng.random() < 0.3 else rng.gauss(0, 9)
        rows.append((key, i % 2, value))
    df = spark.createDataFrame(rows, "k string, j int, v double")
    for keys, pick in [(["k"], lambda r: (r[0],)), (["k", "j"], lambda r: (r[0], r[1]))]:
        expected = {}
        for r in rows:
            expected.setdefault(pick(r), [])
            if r[2] is not None:
                expected[pick(r)].append(r[2])
        expected = {k: float(np.median(v)) for k, v in expected.items()}
        got = q.grouped_median(df, keys, "v", held_values=100, group_values=60)
        found = {tuple(r)[:-1]: r["v"] for r in got.collect()}
        assert found == pytest.approx(expected, rel=1e-12)


def test_grouped_median_counts_nan_as_largest(spark):
    rows = [("a", v) for v in (1.0, 2.0, math.nan, math.nan)] + [("b", float(v)) for v in range(9)]
    df = spark.createDataFrame(rows, "k string, v double")
    direct = dict(q.grouped_median(df, ["k"], "v").collect())
    narrowed = dict(q.grouped_median(df, ["k"], "v", held_values=1, group_values=2).collect())
    assert math.isnan(direct["a"]) and math.isnan(narrowed["a"])
    assert direct["b"] == narrowed["b"] == 4.0


def test_grouped_median_without_broadcast(spark, monkeypatch):
    monkeypatch.setattr(q, "BROADCAST_ROWS", 0)
    df = spark.createDataFrame([(i % 3, i) for i in range(300)], "k int, v int")
    got = dict(q.grouped_median(df, ["k"], "v", held_values=1, group_values=10).collect())
    assert got == {0: 148.5, 1: 149.5, 2: 150.5}
