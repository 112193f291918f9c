"""Logs and stores: chats, sessions, git history, telemetry partitions, journals, contracts; and their sinks."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwright.sources.parsers import graphql_contracts, graphql_uses
from siftwright.streaming.streams import EVENT_SCHEMA

CHAT_SCHEMA = "conv_id string, turn long, role string, text string, _corrupt string"
SESSION_SCHEMA = "session string, tokens_in long, tokens_out long, tokens_cached long, content array<struct<type:string,name:string,text:string>>, _corrupt string"
JOURNAL_SCHEMA = "seq long, id string, op string, at timestamp, body string"


def json_lines(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """Rows of a JSON-lines folder that parse, and the raw text of those that don't."""
    # parsed from text lines: a JSON reader refuses queries that need nothing but the broken rows
    parsed = F.from_json("value", schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    rows = spark.read.text(path).where(F.trim("value") != "").select(parsed.alias("r")).select("r.*")
    return rows.where("_corrupt IS NULL").drop("_corrupt"), rows.where("_corrupt IS NOT NULL").select("_corrupt")


def chats(spark: SparkSession, path: str) -> DataFrame:
    return json_lines(spark, path, CHAT_SCHEMA)[0]


def sessions(spark: SparkSession, path: str) -> DataFrame:
    return json_lines(spark, path, SESSION_SCHEMA)[0]


def git_log(spark: SparkSession, path: str) -> DataFrame:
    """(sha, author, at, subject) of `git log --format=%H%x1f%an%x1f%ct%x1f%s%x1e` output."""
    cols = F.split(F.trim("value"), "\x1f")
    rows = spark.read.option("lineSep", "\x1e").text(path).where(F.size(cols) == 4)
    return rows.select(*(F.get(cols, F.lit(i)).alias(n) for i, n in enumerate(("sha", "author", "at", "subject")))).withColumn("at", F.timestamp_seconds(F.col("at").try_cast("long")))


def telemetry(spark: SparkSession, root: str, first: str | None = None, last: str | None = None) -> DataFrame:
    """Events stored under day=YYYY-MM-DD; only the asked days are listed and read."""
    rows = spark.read.schema(f"{EVENT_SCHEMA}, day date").option("basePath", root).option("recursiveFileLookup", False).json(root)
    if first:
        rows = rows.where(F.col("day") >= F.lit(first).cast("date"))
    return rows.where(F.col("day") <= F.lit(last).cast("date")) if last else rows


def write_telemetry(events: DataFrame, root: str) -> None:
    events.withColumn("day", F.to_date(F.timestamp_seconds("ts"))).write.mode("append").partitionBy("day").json(root)


def append_journal(ops: DataFrame, path: str) -> None:
    ops.write.mode("append").json(path)


def read_journal(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(JOURNAL_SCHEMA).json(path)


def export_memories(memories: DataFrame, path: str, by: str = "category") -> None:
    """One folder of JSON lines for each category."""
    memories.write.mode("overwrite").partitionBy(by).json(path)


def import_memories(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """What export_memories has written, by the schema of the memories."""
    return spark.read.schema(schema).json(path)


def export_markdown(memories: DataFrame, path: str) -> None:
    """Memories(id, category, content) as Markdown, a file for each category: a heading and an item for each memory."""
    item = F.struct("id", F.concat(F.lit("- "), F.regexp_replace("content", "\\s*\\n\\s*", " "), F.lit(" <!-- "), F.col("id").cast("string"), F.lit(" -->")).alias("line"))
    by = memories.groupBy("category").agg(F.array_join(F.transform(F.sort_array(F.collect_list(item)), lambda x: x["line"]), "\n").alias("items"))
    by.select(F.concat(F.lit("# "), F.col("category"), F.lit("\n\n"), F.col("items")).alias("value"), "category").write.mode("overwrite").partitionBy("category").text(path)


def import_markdown(spark: SparkSession, path: str) -> DataFrame:
    """(id, category, content) of what export_markdown has written."""
    rows = spark.read.text(path)
    return rows.where(F.col("value").startswith("- ")).select(F.regexp_extract("value", " <!-- (-?\\d+) -->\\z", 1).cast("long").alias("id"), "category", F.regexp_replace(F.substring("value", 3, 1 << 30), " <!-- -?\\d+ -->\\z", "").alias("content"))


def keep_last(history: DataFrame, new: DataFrame, at: str, n: int = 100) -> DataFrame:
    """A history with its newest ``n`` rows."""
    return history.unionByName(new).orderBy(F.col(at).desc()).limit(n)


def _pairs(find):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(p, *x) for p, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for x in find(t or "")]
            cols = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in cols], names=["project", "symbol", "kind"])

    return run


def contracts(schemas: DataFrame) -> DataFrame:
    """(project, symbol, kind) of schema files(project, text)."""
    return schemas.select("project", "text").mapInArrow(_pairs(graphql_contracts), "project string, symbol string, kind string")


def contract_uses(files: DataFrame) -> DataFrame:
    """(project, symbol, kind) of operations in code files(project, text)."""
    return files.select("project", "text").mapInArrow(_pairs(graphql_uses), "project string, symbol string, kind string")
