"""The order of source files, for CSV as for Parquet, and names that differ in case only."""

import pytest
from pyspark.sql import functions as F

import framegauge as fg


@pytest.fixture
def split_csv(spark, tmp_path):
    """Two CSV files that are read in many blocks; ``place`` tells where a row stands."""
    key = "spark.sql.files.maxPartitionBytes"
    cost = "spark.sql.files.openCostInBytes"
    before = spark.conf.get(key), spark.conf.get(cost)
    folder = tmp_path / "rows.csv"
    folder.mkdir()
    for number in range(2):
        lines = [f"k{(n * 7919) % 211},{number * 2**40 + n},{n % 97}" for n in range(3_000)]
        (folder / f"{number}.csv").write_text("\n".join(["key,place,value", *lines]) + "\n")
    spark.conf.set(key, "4096")
    spark.conf.set(cost, "1")
    yield fg.load_dataset(spark, str(folder))
    spark.conf.set(key, before[0])
    spark.conf.set(cost, before[1])


def test_csv_groups_know_their_first_row(split_csv):
    assert split_csv.rdd.getNumPartitions() > 4
    first = fg.aggregate(split_csv, group_by=["key"], metric="place", agg="min", position="at")
    rows = first.collect()
    assert len(rows) == 211 and all(r.at == r.place for r in rows)
    assert [r.place for r in rows] == sorted(r.place for r in rows)


def test_filtered_csv_keeps_its_order(split_csv):
    later = split_csv.where("value > 50").select("key", "place")
    rows = fg.aggregate(later, group_by=["key"], metric="place", agg="min", preserve_order=True).collect()
    assert [r.place for r in rows] == sorted(r.place for r in rows)


def test_examples_of_csv_come_in_file_order(split_csv):
    (found,) = fg.quality_findings(split_csv, maximum_values={"value": 90}, example_limit=9).collect()
    assert found.examples == ["91", "92", "93", "94", "95", "96", "91", "92", "93"]


def test_shuffled_csv_has_no_order(split_csv):
    with pytest.raises(ValueError, match="CSV"):
        fg.aggregate(split_csv.repartition(3), group_by=["key"], metric=None, agg="count", preserve_order=True)


def test_correlation_does_not_hang_on_the_first_row(spark):
    values = spark.range(1, 2_000).select(
        (F.col("id") % 13 + 1e9).alias("a"), ((F.col("id") * 5) % 17 + F.col("id") % 13).cast("double").alias("b")
    )
    far = spark.createDataFrame([(1e9, 6.0)], "a double, b double")
    expected = far.union(values).select(F.corr(F.col("a") - 1e9, "b")).first()[0]
    for first in (far, far.select((F.col("a") - 1e9).alias("a"), "b")):
        df = first.union(values).coalesce(1)
        shifted = df.select((F.col("a") - 1e9).alias("a"), "b")
        wanted = expected if first is far else shifted.select(F.corr("a", "b")).first()[0]
        found = {(r[0], r[1]): r[2] for r in fg.correlation_pairs(df).collect()}
        assert found["a", "b"] == pytest.approx(wanted, rel=1e-9)


@pytest.mark.parametrize("first", [None, float("nan"), float("inf")])
def test_columns_that_begin_with_nothing_are_undefined(spark, first):
    df = spark.createDataFrame([(first, 1.0), (2.0, 2.0), (3.0, 4.0)], "a double, b double").coalesce(1)
    found = {(r[0], r[1]): r[2] for r in fg.correlation_pairs(df).collect()}
    assert found["b", "b"] == 1.0 and found["a", "b"] != found["a", "b"] and found["a", "a"] != found["a", "a"]


def test_correlation_of_no_rows(spark):
    empty = spark.createDataFrame([], "a double, b double")
    assert all(r.correlation != r.correlation for r in fg.correlation_pairs(empty).collect())
