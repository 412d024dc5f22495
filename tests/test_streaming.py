"""Windows over a stream against the batch result, late rows and restarts."""

import datetime as dt

from gleanspark.streaming import windows

T0 = dt.datetime(2024, 1, 1)


def events(spark, rows):
    return spark.createDataFrame([(T0 + dt.timedelta(minutes=m) if m is not None else None, k, v) for m, k, v in rows], "ts timestamp, k string, v double")


def test_stream_equals_batch_and_survives_a_restart(spark, tmp_path):
    first = events(spark, [(1, "a", 1.0), (2, "b", 2.0), (59, "a", 3.0), (None, "a", 9.0)])
    second = events(spark, [(61, "a", 4.0), (58, None, 5.0), (300, "b", 6.0)])
    late = events(spark, [(3, "a", 100.0), (301, "b", 7.0)])
    folder, out, state = (f"file://{tmp_path}/{n}" for n in ("in", "out", "state"))
    args = {"width": "1 hour", "keys": ["k"], "value_col": "v", "delay": "10 minutes"}

    def go():
        stream = spark.readStream.schema(first.schema).option("maxFilesPerTrigger", 1).parquet(folder)
        return windows.keep(windows.window_counts(stream, **args), out, state)

    first.coalesce(1).write.parquet(folder)
    assert windows.late(go()) == 0
    second.coalesce(1).write.mode("append").parquet(folder)
    assert windows.late(go()) == 0
    late.coalesce(1).write.mode("append").parquet(folder)
    assert windows.late(go()) == 1  # a row of the first hour, when the watermark stood at 290 minutes
    seen = first.union(second).union(late.filter("v < 100"))
    want = {tuple(r) for r in windows.window_counts(seen, **args).collect()}
    assert {tuple(r) for r in windows.latest(spark.read.parquet(out), ["k"]).collect()} == want
    go()
    assert {tuple(r) for r in windows.latest(spark.read.parquet(out), ["k"]).collect()} == want


def test_table_as_a_stream(spark):
    rows = [(m * 7 % 500, "ab"[m % 2], float(m)) for m in range(200)]
    df = events(spark, rows)
    got = windows.windows_of_stream(df, 3, "30 minutes", ["k"], value_col="v")
    want = windows.window_counts(df, "30 minutes", ["k"], value_col="v")
    assert {tuple(r) for r in got.collect()} == {tuple(r) for r in want.collect()}
    assert windows.windows_of_stream(df.limit(0), 3, "30 minutes").count() == 0
