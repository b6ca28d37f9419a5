import datetime as dt

from factloom.streaming import changes


def test_latest_decision_stream(spark, tmp_path):
    a, b = str(tmp_path / "in"), str(tmp_path / "out")
    rows = [(1, "accept", 5), (1, "reject", 9), (2, "accept", 1)]
    spark.createDataFrame(rows, "assertion_id long, action string, seq long").coalesce(1).write.parquet(a)
    q = changes.latest(changes.read(spark, a, "assertion_id long, action string, seq long")).writeStream.format("parquet").option("path", b).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert {(r.assertion_id, r.action) for r in spark.read.parquet(b).collect()} == {(1, "reject"), (2, "accept")}


def test_windowed_rates(spark, tmp_path):
    a, b = str(tmp_path / "in"), str(tmp_path / "out")
    rows = [(dt.datetime(2024, 1, d, 1), "view", 1.0) for d in (1, 1, 2, 9)]
    spark.createDataFrame(rows, "ts timestamp, event_type string, value double").coalesce(1).write.parquet(a)
    q = changes.rates(changes.read(spark, a, "ts timestamp, event_type string, value double")).writeStream.format("parquet").option("path", b).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert {(r.begin.day, r.n) for r in spark.read.parquet(b).collect()} >= {(1, 2), (2, 1)}
