import math

import numpy as np
import pytest

import framegauge as fg
from framegauge.operators import correlation as corr
from framegauge.reports import correlation_report, describe_numeric_report, describe_report


@pytest.fixture
def sales(spark):
    rows = [("East", 10.0), ("East", 20.0), ("West", 30.0), ("West", 40.0)]
    return spark.createDataFrame(rows, "region string, sales double")


def test_describe(sales):
    assert fg.describe(sales).columns == [
        "column", "count", "missing", "mean", "median", "std", "min",
        "p25", "p50", "p75", "p95", "max", "unique",
    ]
    row = fg.describe(sales).first()
    assert (row["column"], row["count"], row["missing"], row["unique"]) == ("sales", 4, 0, 4)
    assert (row["mean"], row["median"], row["p25"], row["p75"]) == (25.0, 25.0, 17.5, 32.5)
    report = describe_report(sales)
    assert report["analysis"] == "descriptive_statistics"
    assert report["metadata"] == {"row_count": 4}
    assert report["result"][0]["p95"] == pytest.approx(38.5)


def test_describe_empty_columns(spark):
    df = spark.createDataFrame([(None, 1), (None, None)], "a double, b int")
    assert describe_report(df)["result"][0] == {"column": "a", "count": 0, "missing": 2}
    single = describe_report(df)["result"][1]
    assert single["std"] is None and single["unique"] == 1
    assert describe_numeric_report(df, "a") == {"column": "a", "count": 0}
    assert fg.describe(df, []).collect() == []
    narrowed = fg.describe(df, held_values=0).collect()
    assert narrowed == fg.describe(df).collect()


def test_describe_numeric(sales):
    found = describe_numeric_report(sales, "sales")
    assert list(found) == ["column", "count", "missing", "mean", "median", "std", "min", "q25", "q75", "max"]
    assert (found["count"], found["mean"], found["q25"]) == (4, 25.0, 17.5)


def test_describe_errors(sales):
    with pytest.raises(KeyError):
        fg.describe_numeric(sales, "missing")
    with pytest.raises(TypeError, match="Column 'region' is not numeric."):
        fg.describe_numeric(sales, "region")
    with pytest.raises(ValueError, match=r"Descriptive statistics require numeric column\(s\): region"):
        fg.describe(sales, ["sales", "region"])
    with pytest.raises(ValueError, match=r"Analysis references missing column\(s\): a, b"):
        fg.describe(sales, ["a", "b"])


def test_narrowed_describe_equals_direct(spark, sf_dir):
    items = fg.load_dataset(spark, f"{sf_dir}/lineitem.parquet")
    columns = ["l_extendedprice", "l_quantity", "l_orderkey"]
    direct = {r["column"]: r for r in fg.describe(items, columns).collect()}
    narrowed = {r["column"]: r for r in fg.describe(items, columns, held_values=500).collect()}
    for c in columns:
        assert tuple(direct[c])[1:] == pytest.approx(tuple(narrowed[c])[1:], rel=1e-12)


def test_single_column_correlation(sales):
    report = correlation_report(sales, ["sales"])
    assert report["analysis"] == "correlation"
    assert report["result"] == [{"sales": 1.0}]


def test_correlation_matches_numpy_and_is_symmetric(spark):
    rng = np.random.default_rng(5)
    data = rng.normal(size=(200, 3)) @ rng.normal(size=(3, 3)) + 1e6
    df = spark.createDataFrame([tuple(map(float, r)) for r in data], "a double, b double, c double")
    matrix = [[row[c] for c in "abc"] for row in correlation_report(df)["result"]]
    assert np.allclose(matrix, np.corrcoef(data.T), atol=1e-9)
    assert np.array_equal(matrix, np.transpose(matrix))


def test_correlation_of_null_constant_and_nan_columns(spark):
    rows = [(1.0, 2.0, 5.0, 1.0, 1), (2.0, None, 5.0, math.nan, 3), (3.0, 1.0, 5.0, 2.0, 2)]
    df = spark.createDataFrame(rows, "a double, hole double, flat double, odd double, i int")
    found = {(r[0], r[1]): r[2] for r in fg.correlation_pairs(df).collect()}
    for (x, y), value in found.items():
        if {x, y} & {"hole", "flat", "odd"}:
            assert math.isnan(value)
    assert found["a", "a"] == 1.0 and found["a", "i"] == pytest.approx(0.5)


def test_wide_correlation_agrees(spark, monkeypatch):
    rows = [(float(i), float(i * i % 17), None if i == 3 else float(i), 4.0) for i in range(60)]
    df = spark.createDataFrame(rows, "a double, b double, hole double, flat double")
    narrow = {tuple(r)[:2]: r[2] for r in fg.correlation_pairs(df).collect()}
    monkeypatch.setattr(corr, "_PAIRWISE_COLUMNS", 1)
    wide = {tuple(r)[:2]: r[2] for r in fg.correlation_pairs(df).collect()}
    assert wide == pytest.approx(narrow, nan_ok=True)


def test_correlation_errors(sales):
    with pytest.raises(ValueError, match=r"Correlation requires numeric column\(s\): region"):
        fg.correlation(sales, ["sales", "region"])
    with pytest.raises(ValueError, match="missing"):
        fg.correlation(sales, ["none"])


def test_dataset_of_one_row(spark):
    df = spark.createDataFrame([(1.0, 2.0)], "a double, b double")
    assert all(math.isnan(r[2]) for r in fg.correlation_pairs(df).collect())
