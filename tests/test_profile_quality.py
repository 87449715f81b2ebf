import math
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

import framegauge as fg
from framegauge.operators.distinct import duplicate_row_count
from framegauge.reports import profile_report, quality_report


def finding(report, check):
    return next(f for f in report["findings"] if f["check"] == check)


def test_profile(spark):
    df = spark.createDataFrame([("A", 1.0), ("A", None), ("B", 3.0)], "category string, value double")
    report = profile_report(df)
    assert (report["row_count"], report["column_count"], report["duplicate_row_count"]) == (3, 2, 0)
    category, value = report["columns"]
    assert category["top_values"] == {"A": 2, "B": 1} and category["unique_count"] == 2
    assert (value["null_count"], value["null_pct"], value["unique_count"]) == (1, 33.3333, 3)
    assert (value["min"], value["max"], value["mean"], value["median"]) == (1.0, 3.0, 2.0, 2.0)


def test_profile_of_all_kinds(spark):
    rows = [
        (True, date(2024, 1, 2), datetime(2024, 1, 1, 5), [1, 2], {"b": 1, "a": 2}, 2**60 + 1, None),
        (None, date(2023, 1, 2), datetime(2024, 1, 1, 5, 0, 0, 120), [1, 2], {"a": 2, "b": 1}, 5, None),
    ]
    df = spark.createDataFrame(
        rows, "b boolean, d date, t timestamp_ntz, a array<int>, m map<string,int>, i bigint, n int"
    )
    by_name = {c["name"]: c for c in profile_report(df)["columns"]}
    assert by_name["b"]["top_values"] == {"None": 1, "True": 1}
    assert (by_name["d"]["min"], by_name["d"]["max"]) == ("2023-01-02", "2024-01-02")
    assert by_name["t"]["min"] == "2024-01-01T05:00:00"
    assert by_name["t"]["max"] == "2024-01-01T05:00:00.000120"
    assert by_name["a"]["unique_count"] == 1 and by_name["m"]["unique_count"] == 1
    assert by_name["i"]["max"] == 2**60 + 1
    assert "min" not in by_name["n"] and by_name["n"]["unique_count"] == 1


def test_profile_keeps_five_top_values_and_zero_is_one_value(spark):
    df = spark.createDataFrame([(f"v{i}", 0.0 if i % 2 else -0.0) for i in range(9)], "s string, z double")
    s, z = profile_report(df)["columns"]
    assert list(s["top_values"]) == ["v0", "v1", "v2", "v3", "v4"]
    assert z["unique_count"] == 1


def test_profile_of_an_empty_dataset(spark):
    report = profile_report(spark.createDataFrame([], "a int, s string"))
    assert report["row_count"] == 0 and report["duplicate_row_count"] == 0
    assert report["columns"][0]["null_pct"] == 0.0 and report["columns"][1]["top_values"] == {}


def test_quality_base(spark):
    df = spark.createDataFrame([(1,), (1,), (2,), (100,), (None,)], "value bigint")
    report = quality_report(df)
    assert report["null_counts"] == {"value": 1}
    assert report["duplicate_row_count"] == 1
    assert report["outlier_counts_iqr"]["value"] >= 1
    assert report["completeness_pct"] == 80.0
    assert report["warnings"] == [
        "Missing values detected in 1 column(s).",
        "1 duplicate row(s) detected.",
        "Potential IQR outliers detected in 1 numeric column(s).",
    ]
    checks = {r["check"]: r for r in fg.quality_checks(df).collect()}
    assert checks["MISSING_VALUES"]["affected_pct"] == 20.0
    assert checks["DUPLICATE_ROWS"]["affected_rows"] == 1
    assert checks["IQR_OUTLIERS"]["target"] == "value"


def test_non_negative(spark):
    df = spark.createDataFrame([(10.0,), (-2.0,), (5.0,), (None,)], "fare double")
    report = quality_report(df, non_negative_columns=["fare"])
    found = finding(report, "NON_NEGATIVE")
    assert found == {
        "check": "NON_NEGATIVE",
        "severity": "ERROR",
        "target": "fare",
        "affected_rows": 1,
        "affected_pct": 25.0,
        "message": "Negative values found in 'fare', which is configured as non-negative.",
        "examples": [-2.0],
    }
    assert report["warnings"][-1] == "ERROR: " + found["message"]


def test_datetime_order(spark):
    rows = [
        (datetime(2025, 1, 1, 10), datetime(2025, 1, 1, 11)),
        (datetime(2025, 1, 1, 12), datetime(2025, 1, 1, 11)),
        (datetime(2025, 1, 1, 12), datetime(2025, 1, 1, 12)),
        (None, datetime(2025, 1, 1, 11)),
    ]
    df = spark.createDataFrame(rows, "pickup timestamp_ntz, dropoff timestamp_ntz")
    found = finding(quality_report(df, datetime_order_pairs=[("pickup", "dropoff")]), "DATETIME_ORDER")
    assert (found["severity"], found["affected_rows"], found["target"]) == ("ERROR", 1, "pickup <= dropoff")
    assert "examples" not in found


def test_expected_categories(spark):
    df = spark.createDataFrame([(1,), (2,), (9,), (9,), (None,)], "payment_type bigint")
    rules = {"payment_type": [1, 2, 3, 4, 5, 6, None]}
    found = finding(quality_report(df, expected_categories=rules), "EXPECTED_CATEGORY")
    assert (found["severity"], found["affected_rows"], found["examples"]) == ("WARNING", 2, [9])
    none_allowed = finding(quality_report(df, expected_categories={"payment_type": []}), "EXPECTED_CATEGORY")
    assert none_allowed["affected_rows"] == 4


def test_maximum_and_example_limit(spark):
    df = spark.createDataFrame([(1.0,), (5.0,), (12.0,), (11.0,), (None,)], "distance double")
    found = finding(quality_report(df, maximum_values={"distance": 10.0}, example_limit=1), "MAXIMUM_VALUE")
    assert (found["affected_rows"], found["examples"]) == (2, [11.0])
    assert found["message"] == "Values in 'distance' exceed the configured maximum of 10.0."
    none = finding(quality_report(df, maximum_values={"distance": 10.0}, example_limit=0), "MAXIMUM_VALUE")
    assert "examples" not in none


def test_date_range(spark):
    rows = [(datetime(2025, 1, 1),), (datetime(2025, 2, 1),), (datetime(2025, 1, 15),)]
    df = spark.createDataFrame(rows, "pickup timestamp_ntz")
    bounds = (datetime(2025, 1, 1), datetime(2025, 1, 31, 23, 59, 59))
    found = finding(quality_report(df, date_ranges={"pickup": bounds}), "DATE_RANGE")
    assert (found["affected_rows"], found["examples"]) == (1, ["2025-02-01 00:00:00"])
    days = df.selectExpr("cast(pickup as date) as pickup")
    assert finding(quality_report(days, date_ranges={"pickup": bounds}), "DATE_RANGE")["affected_rows"] == 1


def test_examples_follow_file_order(spark, tmp_path):
    path = str(tmp_path / "t.parquet")
    spark.createDataFrame([(-5,), (3,), (-9,), (-1,)], "v int").coalesce(1).write.parquet(path)
    found = quality_report(fg.load_dataset(spark, path), non_negative_columns=["v"], example_limit=2)
    assert found["findings"][0]["examples"] == [-5, -9]


def test_rules_fire_in_order_and_only_when_broken(spark):
    df = spark.createDataFrame([(-1, 5)], "a int, b int")
    report = quality_report(
        df,
        maximum_values={"b": 4, "a": 9},
        non_negative_columns=["b", "a"],
        expected_categories={"a": [1]},
    )
    assert [f["check"] for f in report["findings"]] == ["NON_NEGATIVE", "EXPECTED_CATEGORY", "MAXIMUM_VALUE"]
    for rules in (
        {"non_negative_columns": ["x"]},
        {"datetime_order_pairs": [("a", "x")]},
        {"expected_categories": {"x": [1]}},
        {"maximum_values": {"x": 1}},
        {"date_ranges": {"x": (1, 2)}},
    ):
        with pytest.raises(ValueError, match="Validation rule references missing column: 'x'"):
            fg.quality_findings(df, **rules)


def test_iqr_skips(spark):
    rows = [(1.0, 1, None), (2.0, 1, 5), (3.0, 1, 6), (900.0, 50, 700), (2.5, 1, None)]
    df = spark.createDataFrame(rows, "spread double, flat int, few int")
    for held in (10_000, 1):
        assert [r["column"] for r in fg.iqr_outliers(df, held_values=held).collect()] == ["spread"]


def test_completeness_of_nothing(spark):
    assert fg.completeness(spark.createDataFrame([], "a int")).first()["completeness_pct"] == 100.0
    assert quality_report(spark.createDataFrame([], "a int"))["completeness_pct"] == 100.0


def test_duplicates_by_both_routes(spark):
    rows = [("x", math.nan, None), ("x", math.nan, None), ("x", 0.0, 1), ("x", -0.0, 1), ("y", 1.0, 2)]
    df = spark.createDataFrame(rows * 3 + [("z", 9.0, 9)], "s string, d double, i int")
    df = df.withColumn("m", F.create_map(F.lit("k"), F.col("i")))
    for limit in (0, 10_000):
        assert tuple(duplicate_row_count(df, direct_rows=limit).first()) == (16, 12)


def test_duplicates_when_suspects_are_many(spark, monkeypatch):
    monkeypatch.setattr("framegauge.operators.distinct.BROADCAST_HASHES", 1)
    df = spark.createDataFrame([(f"s{i % 50}",) for i in range(120)], "s string")
    assert tuple(duplicate_row_count(df, direct_rows=0).first()) == (120, 70)


def test_values_counted_by_hash_first(spark, monkeypatch):
    texts = ["same"] * 9 + ["twice", "twice", None] + [f"only {i}" for i in range(20)]
    df = spark.createDataFrame([(t, [t]) for t in texts], "s string, a array<string>")
    direct = {r["name"]: r for r in fg.profile_columns(df).collect()}
    hashed = {r["name"]: r for r in fg.profile_columns(df, direct_rows=0).collect()}
    assert hashed == direct
    assert [t["count"] for t in hashed["s"]["top_values"]] == [9, 2, 1, 1, 1]
    assert hashed["s"]["top_values"][2]["value"] == "None"
    for count_null, expected in [(True, 23), (False, 22)]:
        counted = fg.distinct_counts(df, ["s"], count_null=count_null, direct_rows=0)
        assert counted.first()["unique_count"] == expected
    monkeypatch.setattr("framegauge.operators.distinct.BROADCAST_HASHES", 0)
    assert {r["name"]: r for r in fg.profile_columns(df, direct_rows=0).collect()} == direct
