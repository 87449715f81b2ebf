from datetime import datetime

import pytest

import framegauge as fg
from framegauge.plans.questions import UNSUPPORTED

COLUMNS = ["payment_type", "fare_amount", "trip_distance", "pickup_datetime"]
TAXI = dict(
    columns=COLUMNS,
    numeric_columns=["fare_amount", "trip_distance"],
    datetime_columns=["pickup_datetime"],
)
NO_NUMBERS = dict(TAXI, numeric_columns=[], datetime_columns=[])


def schema(columns, numeric=None, temporal=None):
    return dict(columns=columns, numeric_columns=numeric, datetime_columns=temporal)


CASES = [
    ("What is the average fare_amount by payment_type?", TAXI,
     dict(operation="aggregate", agg="mean", group_by=["payment_type"], metric="fare_amount", limit=None)),
    ("Show the top 5 payment_type groups by highest average fare_amount", TAXI,
     dict(operation="aggregate", sort_direction="desc", limit=5, group_by=["payment_type"])),
    ("bottom 3 payment_type groups by lowest sum trip distance", TAXI,
     dict(sort_direction="asc", limit=3, agg="sum", metric="trip_distance")),
    ("What is the correlation between fare_amount and trip_distance?", TAXI,
     dict(operation="correlation", columns=["fare_amount", "trip_distance"])),
    ("correlation of trip_distance with fare_amount", TAXI, dict(columns=["trip_distance", "fare_amount"])),
    ("Show the daily trend of average fare_amount over pickup_datetime", TAXI,
     dict(operation="time_series", metric="fare_amount", agg="mean", frequency="1d",
          datetime_column="pickup_datetime", assumptions=[])),
    ("Give me descriptive statistics for trip_distance", TAXI, dict(operation="describe", columns=["trip_distance"])),
    ("Run a data quality check", TAXI, dict(operation="quality", error=None)),
    ("Profile the dataset", schema(COLUMNS), dict(operation="profile")),
    ("PROFILE!", schema(COLUMNS), dict(operation="profile")),
    ("Give me descriptive statistics for payment_type", NO_NUMBERS, "numeric"),
    ("What is the correlation between payment_type and pickup_datetime?", NO_NUMBERS, "numeric"),
    ("Show the daily trend over pickup_datetime", NO_NUMBERS, "date/datetime"),
    ("What is the average fare_amount and trip_distance by payment_type?", TAXI,
     "Name exactly one numeric metric; found: fare_amount, trip_distance."),
    ("Show the daily trend over pickup_datetime and dropoff_datetime",
     schema(["fare_amount", "pickup_datetime", "dropoff_datetime"], ["fare_amount"],
            ["pickup_datetime", "dropoff_datetime"]),
     "Name exactly one date/datetime column; found: pickup_datetime, dropoff_datetime."),
    ("Show the daily and weekly trend over pickup_datetime", TAXI, "Conflicting time frequencies"),
    ("Show daily trend of annual_revenue over pickup_datetime",
     schema(["annual_revenue", "pickup_datetime"], ["annual_revenue"], ["pickup_datetime"]),
     dict(operation="time_series", frequency="1d", metric="annual_revenue")),
    ("Show yearly average annual revenue over pickup_datetime",
     schema(["annual_revenue", "annual revenue", "pickup_datetime"], ["annual_revenue", "annual revenue"],
            ["pickup_datetime"]),
     "Ambiguous column reference 'annual revenue' matches multiple schema columns: annual_revenue, annual revenue."),
    ("Show quarterly trend of fare_amount over pickup_datetime", TAXI, "Unsupported time frequency 'quarterly'."),
    ("quarterly or quarter, daily and weekly over pickup_datetime", TAXI, "Unsupported time frequency 'quarter'."),
    ("Show trend over pickup_datetime", TAXI,
     dict(frequency="1d", agg="count",
          assumptions=["No aggregation was specified; defaulted to count.",
                       "No time frequency was specified; defaulted to daily (1d)."])),
    ("Show average fare_amount by year over pickup_datetime", TAXI, dict(operation="time_series", frequency="1y")),
    ("Show yearly average fare_amount over pickup_datetime", TAXI, dict(frequency="1y", agg="mean", assumptions=[])),
    ("Show annual average fare_amount over pickup_datetime", TAXI, dict(frequency="1y", agg="mean")),
    ("Show annually average fare_amount over pickup_datetime", TAXI, dict(frequency="1y", agg="mean")),
    ("Show hourly average fare_amount over pickup_datetime", TAXI, dict(frequency="1h", metric="fare_amount")),
    ("Show hourly trend of average fare_amount over pickup_datetime", TAXI, dict(frequency="1h", agg="mean")),
    ("Count trips by payment_type", NO_NUMBERS,
     dict(operation="aggregate", agg="count", metric=None, group_by=["payment_type"])),
    ("Are these variables correlated?", TAXI, "at least two explicitly named numeric columns"),
    ("Predict the future revenue", TAXI, UNSUPPORTED),
    ("average fare_amount", TAXI, UNSUPPORTED),
    ("average and total fare_amount by payment_type", TAXI, "Conflicting aggregation operations were requested."),
    ("average total_amount by payment_type", schema(["total_amount", "payment_type"]), "Conflicting aggregation"),
    ("average fare_amount by nothing", TAXI, "Grouped analysis requires an explicitly named grouping column."),
    ("average by payment_type", TAXI, "Grouped metric analysis requires an explicitly named numeric metric."),
    ("top 5 lowest average fare_amount by payment_type", TAXI, "Conflicting sort directions were requested."),
    ("", TAXI, "Question cannot be empty."),
    (" \t\n", TAXI, "Question cannot be empty."),
    (None, TAXI, "Question cannot be empty."),
    ("???", TAXI, UNSUPPORTED),
    ("profile", schema([]), "At least one dataset column is required."),
    ("mean fare by fare type per fare",
     schema(["fare", "fare_type"], ["fare"], []),
     "Grouped metric analysis requires an explicitly named numeric metric."),
]


def test_tags(spark):
    by_schema = {}
    for place, (question, names, _) in enumerate(CASES):
        by_schema.setdefault(repr(names), (names, []))[1].append((place, question))
    for names, questions in by_schema.values():
        df = spark.createDataFrame(questions, "place int, question string")
        for row in fg.tag_questions(df, **names).collect():
            expected = CASES[row["place"]][2]
            if isinstance(expected, str):
                assert row["operation"] is None and expected in row["error"], row
            else:
                assert row["error"] is None, row
                assert {k: row[k] for k in expected} == expected


def test_tagged_row_runs(spark):
    question = spark.createDataFrame([("count trips by payment_type",)], "question string")
    tagged = fg.tag_questions(question, columns=["payment_type"]).first().asDict()
    df = spark.createDataFrame([(1,), (1,), (2,)], "payment_type bigint")
    request = fg.AnalysisRequest.from_mapping(tagged)
    assert request.agg == "count"
    assert {tuple(r) for r in fg.run_request(df, request).collect()} == {(1, 2), (2, 1)}
    with pytest.raises(ValueError, match="cannot be empty"):
        fg.AnalysisRequest.from_mapping({"operation": None, "error": "Question cannot be empty."})


def test_requests_of_every_kind(spark):
    rows = [(datetime(2025, 1, 1, 10), 10.0, "a"), (datetime(2025, 1, 1, 12), 20.0, "b")]
    df = spark.createDataFrame(rows, "at timestamp_ntz, fare double, k string")
    daily = fg.run_request(
        df, {"operation": "time_series", "datetime_column": "at", "metric": "fare", "aggregation": "mean"}
    )
    assert daily.first()["fare"] == 15.0
    top = fg.run_request(
        df,
        {"operation": "aggregate", "group_by": ["k"], "metric": "fare", "agg": "sum",
         "sort_direction": "desc", "limit": 1},
    )
    assert [tuple(r) for r in top.collect()] == [("b", 20.0)]
    assert fg.run_request(df, {"operation": "describe", "columns": ["fare"]}).first()["count"] == 2
    assert fg.run_request(df, {"operation": "correlation", "columns": ["fare"]}).first()["fare"] == 1.0
    assert fg.run_request(df, {"operation": "profile"}).count() == 3
    dataset = fg.run_request(df, {"operation": "quality"}).first()
    assert (dataset.check, dataset.row_count, dataset.column_count) == ("DATASET", 2, 3)
    assert (dataset.completeness_pct, dataset.warning) == (100.0, None)
    with pytest.raises(ValueError, match="missing"):
        fg.run_request(df, {"operation": "aggregate", "group_by": ["nope"], "agg": "count"})
    with pytest.raises(ValueError, match="Unsupported operation 'forecast'"):
        fg.run_request(df, {"operation": "forecast"})
