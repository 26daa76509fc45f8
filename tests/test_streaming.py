"""A stream gives what the batch gives, windows once they are closed."""

from pyspark.sql import functions as F

from pixelloom.streaming import moments

SF = "/root/testdata/sf0.001"


def test_stream_equals_batch(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet")
    parts = str(tmp_path / "in")
    events.orderBy("ts").coalesce(1).write.option("maxRecordsPerFile", 200).parquet(parts)
    stream = moments.windowed_moments(moments.read_events(spark, parts, events.schema, 2), "ts", "value", "6 days", "40 days", ["event_type"])
    moments.write_windows(stream, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination(300)
    got = {(r["start"], r["event_type"]): r for r in spark.read.parquet(str(tmp_path / "out")).collect()} if list((tmp_path / "out").glob("*.parquet")) else {}
    want = {(r["start"], r["event_type"]): r for r in moments.windowed_moments(events, "ts", "value", "6 days", "40 days", ["event_type"]).collect()}
    assert set(got) <= set(want)
    for k, r in got.items():
        assert r["n"] == want[k]["n"] and abs(r["mean"] - want[k]["mean"]) < 1e-9
    # With a short watermark all windows but the last close.
    short = moments.windowed_moments(moments.read_events(spark, parts, events.schema, 1), "ts", "value", "2 days", "1 day")
    moments.write_windows(short, str(tmp_path / "out2"), str(tmp_path / "state2")).awaitTermination(300)
    batch = moments.windowed_moments(events, "ts", "value", "2 days", "1 day")
    closed = spark.read.parquet(str(tmp_path / "out2"))
    assert 0 < closed.count() <= batch.count()
    both = closed.join(batch.select(F.col("start"), F.col("n").alias("m"), F.col("mean").alias("mm")), "start")
    assert both.filter("n <> m or abs(mean - mm) > 1e-9").count() == 0
