import datetime

from pyspark.sql import functions as F

from loomwork.streaming import streams


def test_windows_and_sessions(spark, tmp_path):
    start = datetime.datetime(2024, 1, 1)
    source = str(tmp_path / "in")
    rows = [(i, start + datetime.timedelta(minutes=m), k) for i, (m, k) in enumerate([(0, "a"), (1, "a"), (7, "b"), (30, "a"), (2, "a"), (90, "z")])]
    df = spark.createDataFrame(rows, "id int, ts timestamp, k string")
    df.coalesce(1).write.parquet(source)
    found = {}
    read = lambda: streams.stream_files(spark, source, df.schema, most_files=1)
    plans = {
        "windows": streams.windowed(read(), "ts", "10 minutes", [F.count("*").alias("n")], ["k"], late="5 minutes"),
        "sliding": streams.windowed(read(), "ts", "10 minutes", [F.count("*").alias("n")], slide="5 minutes"),
        "sessions": streams.sessions(read(), "ts", "10 minutes", [F.count("*").alias("n")], ["k"]),
        "distinct": streams.without_repeats(read(), ["k"], "ts", "1 day"),
    }
    for name, plan in plans.items():
        found[name] = []
        run = streams.Stream.start(plan, lambda batch, _, to=found[name]: to.extend(batch.collect()), str(tmp_path / f"checkpoint-{name}"))
        assert run.wait(120) and not run.is_active and run.rows_read == 6
        run.stop()
    assert sorted((r.start.minute, r.k, r.n) for r in found["windows"]) == [(0, "a", 3), (0, "b", 1), (30, "a", 1)]
    assert sorted((r.k, r.n) for r in found["sessions"]) == [("a", 1), ("a", 3), ("b", 1)]
    assert len(found["distinct"]) == 3 and sum(r.n for r in found["sliding"]) == 10
