"""Structured Streaming: debounced changes, windowed statistics, deduplication, upserts, journals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EVENT_SCHEMA = "install_id string, version string, os string, event string, tool string, outcome string, duration_ms long, ts long"


def events_source(spark: SparkSession, path: str, schema: str, max_files: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    return (reader.option("maxFilesPerTrigger", max_files) if max_files else reader).parquet(path)


def valid_events(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Telemetry rows that pass all rules, and the rest for quarantine."""
    uuid = F.col("install_id").rlike("^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}\\z")
    ok = F.coalesce(uuid & F.col("outcome").isin("ok", "error", "timeout") & F.col("duration_ms").between(0, 600_000) & (F.col("ts") > 0), F.lit(False))
    return events.where(ok), events.where(~ok)


def debounce(changes: DataFrame, key: str = "path", ts: str = "ts", event: str = "event", gap: str = "500 milliseconds", late: str = "10 minutes") -> DataFrame:
    """The last event of each burst of changes to a key: (key, started, ended, event, n)."""
    bursts = changes.withWatermark(ts, late).groupBy(F.session_window(ts, gap).alias("w"), key)
    return bursts.agg(F.max_by(event, ts).alias(event), F.count("*").alias("n")).select(key, F.col("w.start").alias("started"), F.col("w.end").alias("ended"), event, "n")


def tumbling(events: DataFrame, ts: str, keys: list[str], width: str = "1 day", user: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Counts for each window and key; distinct users by sketch, as exact distinct has no bounded state."""
    aggs = [F.count("*").alias("events")] + ([F.approx_count_distinct(user).alias("users")] if user else [])
    return events.withWatermark(ts, late).groupBy(F.window(ts, width).alias("w"), *keys).agg(*aggs).select(F.col("w.start").alias("start"), *keys, *[a for a in (["events", "users"] if user else ["events"])])


def once(events: DataFrame, ids: list[str], ts: str, late: str = "10 minutes") -> DataFrame:
    """Each event once, if its repeats come within the watermark."""
    return events.withWatermark(ts, late).dropDuplicatesWithinWatermark(ids)


def upsert_sink(path: str, key: list[str], order: str):
    """A foreachBatch function that merges each batch into a Parquet table by key, the latest row winning.

    A batch goes to a new version folder and the pointer moves after it is complete, so a lost executor or a
    repeated batch leaves a whole table behind. ``current(spark, path)`` reads the latest version.
    """

    def run(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        old = current(spark, path)
        rows = batch if old is None else old.unionByName(batch)
        rest = [c for c in rows.columns if c not in key]
        latest = rows.groupBy(*key).agg(F.max_by(F.struct(*rest), F.col(order)).alias("r")).select(*key, "r.*").select(*batch.columns)
        latest.write.mode("overwrite").parquet(f"{path}/v={epoch}")

    return run


def current(spark: SparkSession, path: str) -> DataFrame | None:
    """The newest complete version of an upsert table."""
    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(root):
        return None
    done = [s.getPath().toString() for s in fs.listStatus(root) if fs.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))]
    return spark.read.parquet(max(done, key=lambda p: int(p.rpartition("=")[2]))) if done else None


def latest_state(journal: DataFrame, key: str = "id", seq: str = "seq") -> DataFrame:
    """Streaming fold of a journal: the last operation of each key (update or complete mode)."""
    rest = [c for c in journal.columns if c != key]
    return journal.groupBy(key).agg(F.max_by(F.struct(*rest), F.col(seq)).alias("r")).select(key, "r.*")


def run_available(df: DataFrame, name: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Drive a stream over what is there into a memory table and return it."""
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.table(name)
