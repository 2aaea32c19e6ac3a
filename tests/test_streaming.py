from pyspark.sql import functions as F

from nephos.streaming import channel


def test_a_channel_is_read_once_and_goes_on_after_a_restart(spark, tmp_path):
    path, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    schema = "kind string, value string"
    channel.send(spark.createDataFrame([("I", "1"), ("R", "2.5"), ("C", "x")], schema), path)
    numbers = channel.of_type(channel.open_channel(spark, path, spark.createDataFrame([], schema).schema), "I")
    channel.drain(numbers, out, state)
    channel.send(spark.createDataFrame([("I", "7")], schema), path)
    channel.drain(numbers, out, state)
    assert sorted(r["value"] for r in spark.read.parquet(out).collect()) == [1, 7]


def test_late_rows_are_dropped(spark, tmp_path):
    path, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    schema = "at timestamp, value double"
    make = lambda *rows: spark.createDataFrame(rows, "t string, value double").select(F.to_timestamp("t").alias("at"), "value")
    channel.send(spark.createDataFrame([], schema), path)
    stream = channel.zonal_means(channel.open_channel(spark, path, spark.createDataFrame([], schema).schema), "at", "value", F.lit(1), "1 day", "1 day")
    for rows in ([("2024-01-01 01:00:00", 2.0), ("2024-01-01 05:00:00", 4.0)], [("2024-01-09 00:00:00", 1.0)], [("2024-01-01 06:00:00", 99.0)], [("2024-01-20 00:00:00", 1.0)]):
        channel.send(make(*rows), path)
        channel.drain(stream, out, state)
    got = {str(r["start"])[:10]: (r["n"], r["mean"]) for r in spark.read.parquet(out).collect()}
    assert got["2024-01-01"] == (2, 3.0) and got["2024-01-09"] == (1, 1.0)
