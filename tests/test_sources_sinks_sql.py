from datetime import date, datetime

import pytest

import framegauge as fg


def test_csv_types_and_values(spark, tmp_path):
    path = tmp_path / "sample.CSV"
    path.write_text(
        'name,value,day,at,quote\n'
        'a,1,2024-01-02,2024-01-02 03:04:05,"say ""hi"", ok"\n'
        'b,,2024-01-03,2024-01-03 00:00:00,\n'
    )
    df = fg.load_dataset(spark, str(path))
    assert df.dtypes == [
        ("name", "string"), ("value", "bigint"), ("day", "date"), ("at", "timestamp_ntz"), ("quote", "string"),
    ]
    rows = [tuple(r) for r in df.collect()]
    assert rows[0] == ("a", 1, date(2024, 1, 2), datetime(2024, 1, 2, 3, 4, 5), 'say "hi", ok')
    assert rows[1][1] is None and rows[1][4] is None


def test_csv_schema_lines_and_ragged_rows(spark, tmp_path):
    path = tmp_path / "lines.csv"
    path.write_text('k,v\n1,"two\nlines"\n')
    df = fg.load_dataset(spark, str(path), schema="k int, v string", multi_line=True)
    assert [tuple(r) for r in df.collect()] == [(1, "two\nlines")]
    ragged = tmp_path / "ragged.csv"
    ragged.write_text("a,b\n1,2\n3\n")
    with pytest.raises(Exception):
        fg.load_dataset(spark, str(ragged)).collect()


def test_parquet_and_globs(spark, tmp_path):
    spark.range(1, 4).toDF("value").write.parquet(str(tmp_path / "a.parquet"))
    df = fg.load_dataset(spark, str(tmp_path / "a.parquet"))
    assert (df.count(), df.columns) == (3, ["value"])
    assert fg.load_dataset(spark, str(tmp_path / "*.parquet")).count() == 3
    assert fg.dataset_schema(spark, str(tmp_path / "a.parquet")).numeric_columns == ["value"]


def test_missing_path_comes_before_bad_suffix(spark, tmp_path):
    with pytest.raises(FileNotFoundError, match="Dataset not found"):
        fg.load_dataset(spark, str(tmp_path / "missing.txt"))
    (tmp_path / "sample.txt").write_text("x")
    with pytest.raises(ValueError, match=r"Unsupported format '.txt'. Supported formats: \['.csv', '.parquet'\]"):
        fg.load_dataset(spark, str(tmp_path / "sample.txt"))


def test_traces_of_two_operations_share_a_table(spark, tmp_path):
    df = spark.createDataFrame([("a", 1, None)], "k string, n int, e int")
    path = str(tmp_path / "audit")
    fg.append_trace(fg.with_trace(df, operation="one", warnings=["w"], metadata={"rows": 1}), path)
    fg.append_trace(fg.with_trace(df.select("n"), operation="two", input_columns=["n"]), path)
    rows = {r["operation"]: r for r in spark.read.parquet(path).collect()}
    assert rows["one"]["result"] == '{"k":"a","n":1,"e":null}'
    assert rows["one"]["metadata"] == {"rows": "1"} and rows["one"]["warnings"] == ["w"]
    assert rows["two"]["input_columns"] == ["n"] and rows["two"]["filters"] == []
    fg.write_json(df, str(tmp_path / "json"))
    assert spark.read.json(str(tmp_path / "json")).first()["k"] == "a"


def test_a_repeated_run_leaves_no_second_copy(spark, tmp_path):
    df = spark.createDataFrame([("a", 1), ("b", 2)], "k string, n int")
    path = str(tmp_path / "audit")
    traced = fg.with_trace(df, operation="sums", warnings=["w"], metadata={"rows": 2})
    fg.append_trace(traced, path, run_id="monday")
    fg.append_trace(fg.with_trace(df, operation="other"), path, run_id="monday")
    fg.append_trace(traced, path, run_id="tuesday")
    fg.append_trace(traced, path, run_id="monday")
    rows = [(r.operation, r.run_id, r.result, r.warnings, r.metadata) for r in spark.read.parquet(path).collect()]
    results = ['{"k":"a","n":1}', '{"k":"b","n":2}']
    assert sorted(rows, key=str) == sorted(
        [("sums", day, r, ["w"], {"rows": "2"}) for day in ("monday", "tuesday") for r in results]
        + [("other", "monday", r, [], {}) for r in results],
        key=str,
    )
    fg.append_trace(traced, path)
    fg.append_trace(traced, path)
    assert spark.read.parquet(path).count() == 10
    with pytest.raises(ValueError, match="run id"):
        fg.append_trace(traced, path, run_id="")


@pytest.fixture
def regions(spark):
    return spark.createDataFrame([(0, "AFRICA"), (1, "ASIA")], "id int, name string")


@pytest.mark.parametrize(
    "sql",
    [
        "select count(*) as n from {dataset}",
        "SELECT count(*) as n FROM {dataset};;",
        "with t as (select * from {dataset}) select count(*) as n from t",
        "select count(*) as n from {dataset} a join {dataset} b on a.id = b.id where '{\"x\": 1;2}' <> a.name",
        "select count(*) as n from {dataset} where id in (select id from {dataset})",
    ],
)
def test_queries(regions, sql):
    assert fg.query_dataset(regions, sql).first()["n"] == 2


@pytest.mark.parametrize(
    "sql",
    [
        "drop table x",
        "selectx",
        "insert into x select 1",
        "select 1; drop table x",
        "with t as (select 1 as a) insert into x select * from t",
        "select reflect('java.lang.System', 'exit', 0)",
        "select 1 where 1 in (select java_method('a', 'b'))",
        "select * from {dataset} where exists (select try_reflect('a', 'b'))",
        "with t as (select reflect('a', 'b') as x) select * from t",
        "select max(name) filter (where reflect('a', 'b') = 'x') from {dataset}",
        "select transform(name) using 'cat' as (x) from {dataset}",
        "with t as (select transform(name) using 'cat' as (x) from {dataset}) select * from t",
    ],
)
def test_anything_but_a_query_is_rejected(regions, sql):
    with pytest.raises(ValueError, match="Only read-only SELECT/WITH queries are allowed"):
        fg.query_dataset(regions, sql)


def test_guard_comes_before_the_path_and_views_do_not_remain(spark, regions):
    with pytest.raises(ValueError, match="read-only"):
        fg.query_parquet(spark, "/nowhere.parquet", "drop table x")
    with pytest.raises(FileNotFoundError):
        fg.query_parquet(spark, "/nowhere.parquet", "select 1 from {dataset}")
    fg.query_dataset(regions, "select * from {dataset}").collect()
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("dataset_")]
