"""`id` and `ID` are two columns to every operator."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

import framegauge as fg

ROWS = [
    (1, 10.0, "a", datetime(2025, 1, 1), datetime(2025, 1, 3)),
    (1, 30.0, "b", datetime(2025, 1, 2), datetime(2025, 1, 1)),
    (2, -5.0, "b", datetime(2025, 1, 2), datetime(2025, 1, 4)),
    (None, 7.0, None, datetime(2025, 1, 5), None),
]
NAMES = ["id", "ID", "kind", "At", "at"]


@pytest.fixture(scope="module")
def clashing(spark):
    plain = spark.createDataFrame(ROWS, "a int, b double, c string, d timestamp_ntz, e timestamp_ntz")
    return plain.toDF(*NAMES)


@pytest.fixture(scope="module")
def apart(spark):
    """The same rows under names that no one confuses."""
    plain = spark.createDataFrame(ROWS, "a int, b double, c string, d timestamp_ntz, e timestamp_ntz")
    return plain.toDF("id", "amount", "kind", "start", "end")


OWN = {"amount": "ID", "start": "At", "end": "at"}


def renamed(value):
    """What an operator should say of the clashing names, from what it says of the others."""
    if isinstance(value, str):
        for name, own in OWN.items():
            value = own if value == name else value.replace(f"'{name}'", f"'{own}'").replace(
                "start <= end", "At <= at"
            )
    return value


def same(found, expected):
    assert found.columns == [renamed(c) for c in expected.columns]
    wanted = [tuple(renamed(v) for v in r) for r in expected.collect()]
    assert sorted(map(repr, map(tuple, found.collect()))) == sorted(map(repr, wanted))


def test_statistics_and_profile(clashing, apart):
    for operator in (fg.describe, fg.profile_columns, fg.profile_table, fg.distinct_counts, fg.duplicate_row_count):
        same(operator(clashing), operator(apart))
    same(fg.describe(clashing, ["ID", "id"]), fg.describe(apart, ["amount", "id"]))
    same(fg.describe_numeric(clashing, "ID"), fg.describe_numeric(apart, "amount"))
    filled, other = clashing.where("kind is not null"), apart.where("kind is not null")
    same(fg.correlation(filled), fg.correlation(other))
    same(fg.correlation_pairs(filled), fg.correlation_pairs(other))


@pytest.mark.parametrize("agg", ["sum", "median", "max"])
def test_groups(clashing, apart, agg):
    same(
        fg.aggregate(clashing, group_by=["id"], metric="ID", agg=agg),
        fg.aggregate(apart, group_by=["id"], metric="amount", agg=agg),
    )
    same(
        fg.top_groups(clashing, group_by=["id"], metric="ID", agg=agg, limit=1),
        fg.top_groups(apart, group_by=["id"], metric="amount", agg=agg, limit=1),
    )
    found = fg.grouped_summary(clashing, "id", "ID", agg)
    assert found.columns == ["id", f"ID_{agg}"]
    assert sorted(map(str, found.collect())) == sorted(
        map(str, fg.grouped_summary(apart, "id", "amount", agg).toDF("id", f"ID_{agg}").collect())
    )
    same(fg.value_counts(clashing, "id"), fg.value_counts(apart, "id"))
    same(
        fg.time_series(clashing, datetime_column="At", metric="ID", agg=agg),
        fg.time_series(apart, datetime_column="start", metric="amount", agg=agg),
    )


def test_quality(clashing, apart):
    def rules(amount, start, end):
        return dict(
            non_negative_columns=[amount],
            datetime_order_pairs=[(start, end)],
            expected_categories={"kind": ["a"]},
            maximum_values={amount: 20, "id": 1},
            date_ranges={end: ("2025-01-01", "2025-01-03")},
        )

    own, plain = rules("ID", "At", "at"), rules("amount", "start", "end")
    for operator in (fg.quality_findings, fg.quality_table):
        same(operator(clashing, **own), operator(apart, **plain))
    for operator in (fg.null_counts, fg.completeness, fg.quality_checks):
        same(operator(clashing), operator(apart))
    same(fg.iqr_outliers(clashing, ["ID"], keep_all=True), fg.iqr_outliers(apart, ["amount"], keep_all=True))


def test_requests(clashing, apart):
    request = {"operation": "aggregate", "group_by": ["id"], "agg": "sum", "sort_direction": "desc", "limit": 2}
    same(
        fg.run_request(clashing, {**request, "metric": "ID"}),
        fg.run_request(apart, {**request, "metric": "amount"}),
    )
    for operation in ("profile", "quality", "describe"):
        same(fg.run_request(clashing, {"operation": operation}), fg.run_request(apart, {"operation": operation}))


def test_other_spellings_are_missing(clashing):
    with pytest.raises(ValueError, match=r"missing column\(s\): Id$"):
        fg.aggregate(clashing, group_by=["Id"], metric=None, agg="count")
    with pytest.raises(KeyError, match="'Id' not found.*'id', 'ID'"):
        fg.value_counts(clashing, "Id")


def test_first_appearance(spark, sf_dir):
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    both = orders.select(F.col("o_orderstatus").alias("s"), F.col("o_orderkey").alias("S"))
    plain = orders.select(F.col("o_orderstatus").alias("s"), F.col("o_orderkey").alias("key"))
    options = dict(group_by=["s"], agg="min", position="first_row")
    found = fg.aggregate(both, metric="S", **options)
    assert found.columns == ["s", "S", "first_row"]
    assert list(map(tuple, found.collect())) == list(
        map(tuple, fg.aggregate(plain, metric="key", **options).collect())
    )


def test_files_in_a_case_sensitive_session(spark, tmp_path):
    path = str(tmp_path / "both.parquet")
    spark.conf.set("spark.sql.caseSensitive", "true")
    try:
        spark.createDataFrame([(1, 2.0), (1, 3.0)], "id int, ID double").write.parquet(path)
        both = fg.load_dataset(spark, path)
        (row,) = fg.aggregate(both, group_by=["id"], metric="ID", agg="sum").collect()
        assert tuple(row) == (1, 5.0)
    finally:
        spark.conf.set("spark.sql.caseSensitive", "false")
