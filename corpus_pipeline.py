"""The corpus pipeline: quality, line dedup, near-dedup, decontamination, mixing.

Each stage gets the whole output of the one before as ``docs`` and returns the columns of ``documents``; the
last returns what to take how often.

Defined results. A null or blank text is scored like an empty document, has no lines to drop, is a copy of
nothing and holds no benchmark item; it has no tokens to mix. A row without an id goes through every stage that
keeps its text, and is never taken for a copy. Of rows that are equal in every column near-dedup keeps one; an
id with several texts is one document, whose rows stay or go together. Of a group of copies the smallest id
stays. Extra columns stay as they are, whatever their names, up to the last stage. An empty table gives an empty
result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwright.llm import decontam, line_freq, minhash, mixing, quality
from siftwright.llm.common import cut, semi_ids, without


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go. The score is computed beside the text: no join."""
    model = quality.fit(cut(quality.features(docs), "quality-stats"), _labels(spark, sf_dir))
    return quality.accepted(docs, model)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Boilerplate lines of each source go; n_chars follows the text."""
    out = line_freq.drop_lines(docs, "source", "text")
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*(f"`{c}`" for c in docs.columns))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: the one with the smallest id, and of equal rows one."""
    groups = cut(minhash.near_duplicates(docs).select("doc_id", "kept"), "pipeline-groups")
    kept = without(docs, groups.where("NOT kept").select("doc_id").distinct())
    twice = cut(groups.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id"), "pipeline-repeated")
    if twice.isEmpty():
        return kept
    again = semi_ids(kept, "doc_id", twice, "doc_id").dropDuplicates()
    return without(kept, twice).union(again)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    found = decontam.contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return without(docs, found.select("doc_id").distinct())


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents to take, with rate and copies. The first stage has taken the junk out: it has no target."""
    return mixing.mix(docs, _labels(spark, sf_dir), {d: mixing.TARGETS[d] for d in ("clean", "toxic")}).where("copies > 0")


STAGES = [
    ("quality", keep_quality),
    ("line_dedup", drop_lines),
    ("near_dedup", drop_copies),
    ("decontaminate", drop_leaks),
    ("mix", mix_sources),
]

#: The classifiers and the near-duplicate groups can't be said in SQL; tests compare them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage returns is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
