"""Ranks and distinct counts of the ranked histogram against sorted lists."""

import math
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

import framegauge as fg
from framegauge.functions.histogram import RankedHistogram


@pytest.fixture(scope="module")
def mixed(spark):
    source = random.Random(6)
    rows = [
        (
            source.choice([None, 2**62, 2**62 + 1, -5, 7]),
            source.choice([None, math.nan, -0.5, 1e300, 0.1]),
            Decimal(source.randint(-3, 3)) / 4,
            None,
            7 if k < 400 else k,  # one value holds most rows
        )
        for k in range(600)
    ]
    return spark.createDataFrame(rows, "a bigint, `b.c` double, d decimal(10,2), e int, hot smallint"), rows


def test_ranks_and_distinct_counts(mixed):
    df, rows = mixed
    ranked = RankedHistogram(df, df.columns)
    for at, name in enumerate(df.columns):
        values = [r[at] for r in rows if r[at] is not None]
        finite = sorted(v for v in values if v == v)
        assert (ranked.valid[name], ranked.nans[name]) == (len(finite), len(values) - len(finite))
        assert ranked.distinct[name] == len(set(finite)) + (len(values) > len(finite))
        found = ranked.at_ranks({name: range(0, len(finite), 7)})
        assert found == {(name, k): float(finite[k]) for k in range(0, len(finite), 7)}


def test_describe_is_the_same_on_both_routes(mixed):
    df, _ = mixed
    small, large = fg.describe(df).collect(), fg.describe(df, held_values=1).collect()
    assert sorted(map(str, small)) == sorted(map(str, large))


def test_no_columns_and_no_rows(spark, mixed):
    df, _ = mixed
    assert RankedHistogram(df, []).at_ranks({}) == {}
    empty = RankedHistogram(df.where(F.lit(False)), ["a"])
    assert empty.valid == {"a": 0} and empty.linear_quantiles([0.5]) == {"a": [None]}
