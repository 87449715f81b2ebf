"""Answers that must not depend on size, and requests that keep what they say."""

from datetime import date, timedelta
from decimal import Decimal
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

import framegauge as fg
from framegauge import storage
from framegauge.functions.quantiles import linear_quantiles
from framegauge.reports import aggregate_report


def test_equal_neighbours_are_returned_as_they_are(spark):
    df = spark.createDataFrame([(0.01,)] * 200, "x double")
    for held_values in (10, 10_000):
        assert linear_quantiles(df, [0.95, 0.333], {"x": 200}, {"x": 0}, held_values)["x"] == [0.01, 0.01]


@pytest.mark.parametrize("kind, extra", [("double", []), ("bigint", [0.5]), ("int", [])])
def test_long_category_lists_take_the_types_that_short_ones_take(spark, kind, extra):
    df = spark.createDataFrame([(1,), (2,), (-9,), (None,)], "v int").select(F.col("v").cast(kind).alias("v"))
    for count in (100, 1_500):
        found = fg.quality_findings(df, expected_categories={"v": [*range(count), *extra]}).collect()
        assert [r.affected_rows for r in found] == [1] and float(found[0].examples[0]) == -9


@pytest.mark.parametrize("count", [3, 1_500])
def test_lists_of_dates_may_mix_dates_and_texts(spark, count):
    days = [date(2025, 1, 1) + timedelta(days=n) for n in range(count)]
    mixed = [d if d.day % 2 else str(d) for d in days]
    df = spark.createDataFrame([(days[0],), (days[1],), (days[-1],), (date(1999, 1, 1),), (None,)], "d date")
    for listed in (days, [str(d) for d in days], [*mixed, "no date", None]):
        (found,) = fg.quality_findings(df, expected_categories={"d": listed}).collect()
        assert (found.affected_rows, found.examples) == (1, ["1999-01-01"])


def test_lists_of_other_types(spark):
    df = spark.createDataFrame([("1", True, Decimal("2.50")), ("x", False, Decimal("3.00"))], "s string, b boolean, d decimal(9,2)")
    found = fg.quality_findings(
        df, expected_categories={"s": [1, 7], "b": [True], "d": [Decimal("2.5"), 7]}
    ).collect()
    assert [(r.target, r.affected_rows, r.examples) for r in found] == [
        ("s", 1, ["x"]), ("b", 1, ["false"]), ("d", 1, ["3.00"]),
    ]


def test_examples_of_many_rules_keep_their_types_apart(spark):
    df = spark.createDataFrame([(n, float(-n), f"t{n % 3}") for n in range(1, 9)], "a int, b double, c string")
    found = fg.quality_findings(
        df, non_negative_columns=["b"], maximum_values={"a": 5}, expected_categories={"c": ["t0"]}, example_limit=2
    ).collect()
    assert [(r.check, r.affected_rows, r.examples) for r in found] == [
        ("NON_NEGATIVE", 8, ["-8.0", "-7.0"]),
        ("EXPECTED_CATEGORY", 6, ["t1", "t2"]),
        ("MAXIMUM_VALUE", 3, ["6", "7"]),
    ]


def test_wide_correlation_is_the_narrow_one(spark):
    big = F.lit(1.7e15)
    df = spark.range(500).select(
        *[(big + (F.col("id") * (k + 3)) % 101 + F.col("id") % 7).alias(f"c{k}") for k in range(17)]
    )
    wide = {(r[0], r[1]): r[2] for r in fg.correlation_pairs(df).collect()}
    narrow = {(r[0], r[1]): r[2] for r in fg.correlation_pairs(df, ["c0", "c1"]).collect()}
    assert all(wide[pair] == pytest.approx(value, rel=1e-9) for pair, value in narrow.items())


def test_repeated_columns_and_median_of_the_key(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (2.0,)], "x double")
    assert fg.describe(df, ["x", "x"]).count() == 2
    assert {tuple(r) for r in fg.grouped_summary(df, "x", "x", "median").collect()} == {(1.0, 1.0), (2.0, 2.0)}


def test_no_columns_is_not_all_columns(spark):
    df = spark.createDataFrame([(1.0, 2.0)], "x double, y double")
    assert fg.run_request(df, {"operation": "describe", "columns": []}).count() == 0
    assert fg.run_request(df, {"operation": "describe"}).count() == 2


def test_clusters_need_a_shared_folder():
    context = SimpleNamespace(master="spark://host:7077", getCheckpointDir=lambda: None)
    session = SimpleNamespace(conf=SimpleNamespace(get=lambda *_: None), sparkContext=context)
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        storage.shared_dir(session)


def test_jobs_of_a_quality_report_do_not_grow_with_its_rules(spark, sf_dir):
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet")

    def jobs(name, **rules):
        spark.sparkContext.setJobGroup(name, "one report")
        try:
            fg.quality_table(items, expected_categories={"l_returnflag": ["N"]}, **rules).collect()
        finally:
            spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(name))

    few = jobs("few-rules", maximum_values={"l_quantity": 45})
    many = jobs(
        "many-rules",
        non_negative_columns=["l_tax"],
        maximum_values={"l_quantity": 45, "l_tax": 0.01, "l_discount": 0.01, "l_linenumber": 2},
        date_ranges={"l_shipdate": ("1995-01-01", "1996-01-01")},
    )
    assert many <= few <= 17


def test_profile_requests_carry_totals(spark):
    df = spark.createDataFrame([("a", 1), ("a", 1)], "s string, n int")
    for row in fg.run_request(df, {"operation": "profile"}).collect():
        assert (row.row_count, row.column_count, row.duplicate_row_count) == (2, 2, 1)


def test_reports_take_a_row_limit(spark):
    df = spark.createDataFrame([("a",), ("b",)], "s string")
    with pytest.raises(ValueError, match="more than 1 rows"):
        aggregate_report(df, group_by=["s"], metric=None, agg="count", max_rows=1)
