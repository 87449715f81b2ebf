import pytest

import framegauge as fg
from framegauge.streaming import streaming_time_series


def test_stream_equals_batch_for_finished_buckets(spark, sf_dir, tmp_path):
    path = f"{sf_dir}/events.parquet"
    batch = fg.load_dataset(spark, path)
    source = str(tmp_path / "in")
    batch.repartition(3).write.parquet(source)
    stream = spark.readStream.schema(batch.schema).option("maxFilesPerTrigger", 3).parquet(source)
    series = streaming_time_series(
        stream, datetime_column="ts", frequency="1d", metric="value", agg="max", watermark="1 day"
    )
    query = (
        series.writeStream.format("memory").queryName("daily").outputMode("append")
        .option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    )
    assert query.awaitTermination(120)
    found = {str(r["ts"]): r["value"] for r in spark.table("daily").collect()}
    daily = fg.time_series(batch, datetime_column="ts", frequency="1d", metric="value", agg="max")
    expected = {str(r["ts"]): r["value"] for r in daily.collect()}
    assert len(found) >= len(expected) - 2
    assert found == {k: expected[k] for k in found}
    for wrong in ({"frequency": "1mo"}, {"metric": "value", "agg": "median"}):
        with pytest.raises(ValueError):
            streaming_time_series(stream, datetime_column="ts", **wrong)
