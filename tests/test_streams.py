"""Streams over what is there give what the batch query gives."""

from __future__ import annotations

from pyspark.sql import functions as F

from siftwright.streaming import streams


def typed(df):
    return df.withColumn("ts", F.col("ts").cast("timestamp"))


def source(spark, sf_dir, tmp_path):
    batch = typed(spark.read.parquet(f"{sf_dir}/events.parquet"))
    batch.write.parquet(str(tmp_path / "in"))
    return batch, streams.events_source(spark, str(tmp_path / "in"), batch.schema.simpleString()[7:-1].replace(":", " "))


def test_tumbling_matches_batch(spark, sf_dir, tmp_path):
    batch, live = source(spark, sf_dir, tmp_path)
    got = streams.run_available(streams.tumbling(live, "ts", ["event_type"]), "daily_counts", str(tmp_path / "c1"), "complete")
    want = batch.groupBy(F.window("ts", "1 day").start.alias("start"), "event_type").agg(F.count("*").alias("events"))
    assert {tuple(r) for r in got.collect()} == {tuple(r) for r in want.collect()}


def test_debounce_matches_batch_but_for_the_open_tail(spark, sf_dir, tmp_path):
    batch, live = source(spark, sf_dir, tmp_path)
    live, batch = (df.withColumn("key", F.col("user_id") % 3) for df in (live, batch))
    args = {"key": "key", "event": "event_type", "gap": "30 minutes"}
    got = {(r.key, r.started, r.n) for r in streams.run_available(streams.debounce(live, **args), "bursts", str(tmp_path / "c2")).collect()}
    want = {(r.key, r.started, r.n) for r in streams.debounce(batch, **args).collect()}
    last = max(w[1] for w in want)
    assert got <= want and all(w in got for w in want if (last - w[1]).total_seconds() > 7200)


def test_repeats_are_dropped(spark, sf_dir, tmp_path):
    batch, _ = source(spark, sf_dir, tmp_path)
    batch.union(batch).write.parquet(str(tmp_path / "twice"))
    live = streams.events_source(spark, str(tmp_path / "twice"), batch.schema.simpleString()[7:-1].replace(":", " "))
    got = streams.run_available(streams.once(live, ["event_id"], "ts", "60 days"), "once_events", str(tmp_path / "c3"))
    assert got.count() == batch.count()


def test_upserts_keep_the_latest(spark, tmp_path):
    sink = streams.upsert_sink(str(tmp_path / "t"), ["k"], "seq")
    sink(spark.createDataFrame([(1, 1, "a"), (2, 1, "b")], "k int, seq int, v string"), 0)
    sink(spark.createDataFrame([(1, 2, "c"), (3, 1, "d")], "k int, seq int, v string"), 1)
    assert {tuple(r) for r in streams.current(spark, str(tmp_path / "t")).collect()} == {(1, 2, "c"), (2, 1, "b"), (3, 1, "d")}


def test_validation_quarantines(spark):
    ok = ("01234567-89ab-cdef-0123-456789abcdef", "1", "linux", "call", None, "ok", 5, 1)
    df = spark.createDataFrame([ok, ("nope", *ok[1:]), (*ok[:6], -1, 1), (None, *ok[1:])], streams.EVENT_SCHEMA)
    good, bad = streams.valid_events(df)
    assert good.count() == 1 and bad.count() == 3
