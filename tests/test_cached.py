"""Lookups answered from a cache in a stream: many rows of one key are one timer's work, with the same answers."""

from datetime import datetime, timedelta

from harborscan.streaming import streams

START = datetime(2024, 1, 1)


def test_one_timer_for_all_rows_of_a_key(spark, tmp_path):
    n = 300
    at = lambda i: START + timedelta(minutes=i)
    rows = [("PyPI", "a", "1", at(i), None if i % 3 else ("MATCHED" if i % 2 else "NO_MATCH")) for i in range(n)]
    rows += [("PyPI", "b", "1", at(1), None), ("PyPI", "b", "1", at(1), None), ("PyPI", "end", "1", at(n) + timedelta(days=5), "MATCHED")]
    spark.createDataFrame(rows, "ecosystem string, name string, version string, at timestamp, status string").write.parquet(f"{tmp_path}/in")
    source = spark.readStream.schema(spark.read.parquet(f"{tmp_path}/in").schema).parquet(f"{tmp_path}/in").withWatermark("at", "1 day")
    answered = streams.answered_from_cache(source, 60, 3600)
    query = answered.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    got = sorted((r.name, r.asked_at, r.state, r.age_seconds) for r in spark.read.parquet(f"{tmp_path}/out").collect())
    want = [("a", at(i), ("STALE_" if i % 3 > 1 else "") + ("MATCHED" if (i - i % 3) % 2 else "NO_MATCH"), i % 3 * 60) for i in range(n) if i % 3] + [("b", at(1), "OFFLINE_NO_CACHE", None)] * 2
    assert got == want
    timers = sum(s["customMetrics"]["numRegisteredTimers"] for p in query.recentProgress for s in p["stateOperators"])
    assert timers <= 6  # of three keys; not one for each row
