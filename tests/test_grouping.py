import math

import pytest
from pyspark.sql import functions as F

import framegauge as fg
from framegauge.reports import aggregate_report


@pytest.fixture
def sales(spark):
    rows = [("East", 10.0), ("East", 20.0), ("West", 30.0), ("West", 40.0)]
    return spark.createDataFrame(rows, "region string, sales double")


def as_dict(df):
    return {tuple(r)[:-1]: tuple(r)[-1] for r in df.collect()}


@pytest.mark.parametrize(
    "agg, expected",
    [
        ("count", 2),
        ("sum", 30.0),
        ("mean", 15.0),
        ("median", 15.0),
        ("min", 10.0),
        ("max", 20.0),
        ("std", 7.0710678118654755),
    ],
)
def test_each_aggregation(sales, agg, expected):
    found = as_dict(fg.aggregate(sales, group_by=["region"], metric="sales", agg=agg))
    assert found[("East",)] == pytest.approx(expected)


def test_row_count_without_metric(sales):
    counted = fg.aggregate(sales, group_by=["region"], metric=None, agg="count")
    assert counted.columns == ["region", "row_count"]
    assert as_dict(counted) == {("East",): 2, ("West",): 2}


def test_global_aggregate_and_several_keys(spark):
    df = spark.createDataFrame([("a", 1, 2), ("a", None, 4), (None, None, 9)], "k string, j int, v int")
    assert fg.aggregate(df, group_by=None, metric="v", agg="median").first()["v"] == 4.0
    assert fg.aggregate(df, group_by=[], metric="v", agg="sum").first()["v"] == 15
    found = as_dict(fg.aggregate(df, group_by=["k", "j"], metric="v", agg="max"))
    assert found == {("a", 1): 2, ("a", None): 4, (None, None): 9}


def test_sum_of_nothing_is_zero_and_other_aggregates_are_null(spark):
    df = spark.createDataFrame([("a", None), ("b", 1.5)], "k string, v double")
    for agg, expected in [("sum", 0.0), ("mean", None), ("median", None), ("std", None), ("count", 0)]:
        assert as_dict(fg.aggregate(df, group_by=["k"], metric="v", agg=agg))[("a",)] == expected


def test_nan_is_ignored_by_min_and_max_only(spark):
    df = spark.createDataFrame([(1.0,), (math.nan,), (3.0,)], "v double")
    assert fg.aggregate(df, group_by=None, metric="v", agg="max").first()["v"] == 3.0
    assert fg.aggregate(df, group_by=None, metric="v", agg="min").first()["v"] == 1.0
    assert math.isnan(fg.aggregate(df, group_by=None, metric="v", agg="mean").first()["v"])
    only_nan = df.where("isnan(v)")
    assert math.isnan(fg.aggregate(only_nan, group_by=None, metric="v", agg="max").first()["v"])


def test_errors_come_in_order(sales):
    with pytest.raises(ValueError, match=r"Analysis references missing column\(s\): nope"):
        fg.aggregate(sales, group_by=["nope"], metric="sales", agg="mode")
    with pytest.raises(
        ValueError,
        match="Unsupported aggregation 'mode'. Choose from: count, max, mean, median, min, std, sum",
    ):
        fg.aggregate(sales, group_by=["region"], metric=None, agg="mode")
    with pytest.raises(ValueError, match="A metric is required for aggregations other than count."):
        fg.aggregate(sales, group_by=["region"], metric=None, agg="mean")
    with pytest.raises(ValueError, match="numeric metric"):
        fg.aggregate(sales, group_by=["sales"], metric="region", agg="mean")
    with pytest.raises(ValueError, match="also a grouping column"):
        fg.aggregate(sales, group_by=["sales"], metric="sales", agg="sum")


def test_names_are_case_sensitive_and_may_hold_any_character(spark):
    df = spark.createDataFrame([(1, 2)], "`a.b` int, `c``d` int")
    assert fg.aggregate(df, group_by=["a.b"], metric="c`d", agg="sum").first()[1] == 2
    with pytest.raises(ValueError, match="missing"):
        fg.aggregate(df, group_by=["A.B"], metric=None, agg="count")


def test_first_appearance_order(spark, tmp_path):
    path = str(tmp_path / "t.parquet")
    rows = [("z", 1.0), ("m", 2.0), ("z", 3.0), ("a", 4.0)]
    spark.createDataFrame(rows, "k string, v double").coalesce(1).write.parquet(path)
    df = fg.load_dataset(spark, path)
    for agg in ("sum", "median"):
        ordered = fg.aggregate(df, group_by=["k"], metric="v", agg=agg, preserve_order=True)
        assert [r["k"] for r in ordered.collect()] == ["z", "m", "a"]
        assert ordered.columns == ["k", "v"]
    with pytest.raises(ValueError, match="Parquet"):
        fg.aggregate(
            spark.createDataFrame(rows, "k string, v double"),
            group_by=["k"], metric="v", agg="sum", preserve_order=True,
        )


def test_first_appearance_over_files(spark, tmp_path):
    path = str(tmp_path / "t.parquet")
    for name, keys in (("b", ["x", "y", None]), ("a", ["y", "w"])):
        spark.createDataFrame([(k, 1.0) for k in keys], "k string, v double").coalesce(1).write.parquet(f"{path}/f={name}")
    df = spark.read.parquet(path)
    for agg in ("sum", "median", "min"):
        ordered = fg.aggregate(df, group_by=["k"], metric="v", agg=agg, position="at")
        plan = ordered._jdf.queryExecution().executedPlan().toString()
        assert "SortAggregate" not in plan
        assert [(r.k, r["at"]) for r in ordered.collect()] == [("y", 0), ("w", 1), ("x", 1 << 40), (None, (1 << 40) + 2)]
    with pytest.raises(ValueError, match="position"):
        fg.aggregate(df, group_by=["k"], metric="v", agg="sum", position="v")


def test_grouped_summary(sales, spark):
    summary = fg.grouped_summary(sales, "region", "sales", "sum")
    assert [tuple(r) for r in summary.collect()] == [("East", 30.0), ("West", 70.0)]
    assert summary.columns == ["region", "sales_sum"]
    df = spark.createDataFrame([("a", 1.0), (None, None), ("a", None)], "k string, v double")
    counted = fg.grouped_summary(df, "k", "v", "count").collect()
    assert [tuple(r) for r in counted] == [(None, 1), ("a", 2)]
    assert fg.grouped_summary(df, "k", "v", "median").collect()[1]["v_median"] == 1.0
    with pytest.raises(KeyError, match="Column 'x' not found"):
        fg.grouped_summary(df, "x", "v")
    with pytest.raises(TypeError, match="not numeric"):
        fg.grouped_summary(df, "v", "k")
    with pytest.raises(ValueError, match="Unsupported operation 'std'"):
        fg.grouped_summary(df, "k", "v", "std")


def test_value_counts(spark):
    df = spark.createDataFrame([("b",), ("a",), (None,), ("b",), ("c",), (None,)], "v string")
    counts = fg.value_counts(df, "v", 3)
    assert counts.columns == ["v", "count"]
    assert [tuple(r) for r in counts.collect()] == [(None, 2), ("b", 2), ("a", 1)]
    with pytest.raises(KeyError):
        fg.value_counts(df, "w")


def test_top_groups(sales):
    top = fg.top_groups(sales, group_by=["region"], metric="sales", agg="mean", limit=1)
    assert [tuple(r) for r in top.collect()] == [("West", 35.0)]
    low = fg.top_groups(sales, group_by=["region"], metric="sales", agg="mean", direction="asc", limit=1)
    assert [tuple(r) for r in low.collect()] == [("East", 15.0)]
    with pytest.raises(ValueError, match="sort direction"):
        fg.top_groups(sales, group_by=["region"], metric="sales", agg="mean", direction="up")


def test_partitioning_does_not_change_results(spark, sf_dir):
    items = fg.load_dataset(spark, f"{sf_dir}/lineitem.parquet")
    for agg in ("count", "median", "max"):
        one, many = (
            as_dict(fg.aggregate(items.repartition(n), group_by=["l_returnflag"], metric="l_tax", agg=agg))
            for n in (1, 16)
        )
        assert one == many


def test_counts_add_up_to_rows(spark, sf_dir):
    events = fg.load_dataset(spark, f"{sf_dir}/events.parquet")
    total = fg.value_counts(events, "event_type", 1000).agg(F.sum("count")).first()[0]
    assert total == events.count()


def test_report_envelope(sales):
    report = aggregate_report(sales, group_by=["region"], metric="sales", agg="sum")
    assert report["analysis"] == "grouped_aggregation"
    assert report["parameters"] == {"group_by": ["region"], "metric": "sales", "aggregation": "sum"}
    assert {r["region"]: r["sales"] for r in report["result"]} == {"East": 30.0, "West": 70.0}
    assert aggregate_report(sales, group_by=None, metric=None, agg="count")["result"] == [{"row_count": 4}]
