from datetime import date, datetime

import pytest

import framegauge as fg
from framegauge.functions.buckets import parse_frequency
from framegauge.reports import time_series_report

NTZ = "timestamp timestamp_ntz, sales double"


def test_hourly_counts(spark):
    rows = [(datetime(2025, 1, 1, 10, 5), 10.0), (datetime(2025, 1, 1, 10, 45), 20.0), (datetime(2025, 1, 1, 11, 10), 30.0)]
    report = time_series_report(spark.createDataFrame(rows, NTZ), datetime_column="timestamp", frequency="1h")
    assert report["analysis"] == "time_series"
    assert [r["row_count"] for r in report["result"]] == [2, 1]
    assert report["result"][0]["timestamp"] == datetime(2025, 1, 1, 10)


def test_hourly_mean_and_yearly_sum(spark):
    rows = [(datetime(2025, 1, 1, 10), 10.0), (datetime(2025, 1, 1, 10, 30), 30.0)]
    df = spark.createDataFrame(rows, NTZ)
    mean = fg.time_series(df, datetime_column="timestamp", frequency="1h", metric="sales", agg="mean")
    assert mean.first()["sales"] == 20.0
    rows = [(datetime(2023, 6, 1), 10.0), (datetime(2023, 12, 1), 15.0), (datetime(2024, 7, 1), 20.0)]
    df = spark.createDataFrame(rows, NTZ)
    years = fg.time_series(df, datetime_column="timestamp", frequency="1y", metric="sales", agg="sum")
    assert [(r["timestamp"].year, r["sales"]) for r in years.collect()] == [(2023, 25.0), (2024, 20.0)]


@pytest.mark.parametrize(
    "frequency, moment, start",
    [
        ("1w", datetime(2024, 1, 7, 23), datetime(2024, 1, 1)),
        ("2w", datetime(1970, 1, 18), datetime(1970, 1, 5)),
        ("7d", datetime(1970, 1, 9), datetime(1970, 1, 8)),
        ("1mo", datetime(2024, 2, 29, 5), datetime(2024, 2, 1)),
        ("2mo", datetime(2024, 4, 3), datetime(2024, 3, 1)),
        ("1q", datetime(2024, 6, 30), datetime(2024, 4, 1)),
        ("5mo", datetime(1969, 12, 31), datetime(1969, 8, 1)),
        ("1y", datetime(1900, 5, 5), datetime(1900, 1, 1)),
        ("15m", datetime(2024, 1, 1, 0, 44, 59), datetime(2024, 1, 1, 0, 30)),
        ("30s", datetime(2024, 1, 1, 0, 0, 59), datetime(2024, 1, 1, 0, 0, 30)),
        ("250ms", datetime(2024, 1, 1, 0, 0, 0, 999_000), datetime(2024, 1, 1, 0, 0, 0, 750_000)),
    ],
)
def test_bucket_starts(spark, frequency, moment, start):
    df = spark.createDataFrame([(moment, 1.0)], NTZ)
    series = fg.time_series(df, datetime_column="timestamp", frequency=frequency)
    assert series.first()["timestamp"] == start
    assert series.dtypes[0] == ("timestamp", "timestamp_ntz")


def test_types_are_kept(spark):
    df = spark.createDataFrame([(date(2024, 5, 17),), (date(2024, 5, 1),)], "d date")
    for frequency in ("1mo", "1w", "1d"):
        assert fg.time_series(df, datetime_column="d", frequency=frequency).dtypes[0] == ("d", "date")
    assert [tuple(r) for r in fg.time_series(df, datetime_column="d", frequency="1mo").collect()] == [(date(2024, 5, 1), 2)]
    zoned = df.selectExpr("cast(d as timestamp_ltz) as d")
    assert fg.time_series(zoned, datetime_column="d", frequency="1mo").dtypes[0] == ("d", "timestamp")


def test_null_datetimes_fail_or_are_dropped(spark):
    df = spark.createDataFrame([(datetime(2024, 1, 1), 1.0), (None, 2.0)], NTZ)
    for frequency in ("1d", "1mo"):
        with pytest.raises(Exception, match="Null values in datetime column 'timestamp'"):
            fg.time_series(df, datetime_column="timestamp", frequency=frequency).collect()
        kept = fg.time_series(df, datetime_column="timestamp", frequency=frequency, on_null="drop")
        assert [r["row_count"] for r in kept.collect()] == [1]


def test_errors(spark):
    df = spark.createDataFrame([(datetime(2024, 1, 1), 1.0)], NTZ)
    with pytest.raises(ValueError, match="missing"):
        fg.time_series(df, datetime_column="when")
    with pytest.raises(ValueError, match="Time analysis requires a Date or Datetime column: 'sales'"):
        fg.time_series(df, datetime_column="sales")
    with pytest.raises(ValueError, match="Unsupported aggregation"):
        fg.time_series(df, datetime_column="timestamp", agg="mode")
    with pytest.raises(ValueError, match="A metric is required"):
        fg.time_series(df, datetime_column="timestamp", agg="mean")
    for bad in ("1ns", "3i", "1d12h", "0d", "d", "-1d"):
        with pytest.raises(ValueError, match="Unsupported frequency"):
            parse_frequency(bad)


def test_bucket_counts_add_up(spark, sf_dir):
    events = fg.load_dataset(spark, f"{sf_dir}/events.parquet")
    for frequency in ("1h", "1w", "1mo"):
        series = fg.time_series(events, datetime_column="ts", frequency=frequency)
        assert series.groupBy().sum("row_count").first()[0] == events.count()
