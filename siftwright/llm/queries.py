"""Registered queries of the llm operators, with their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontam, licenses, line_freq, minhash, mixing, oracle, pii, quality, rules, secrets, suffix


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near copies among ``documents``: 3-word shingles, similarity 0.85 or more."""
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), k=3, percent=85)


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all ``documents``, learnt from the labelled rows that aren't held out."""
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in all ``documents``, through a fresh ledger."""
    return secrets.scan(table(spark, sf_dir, "documents"))


def op4_line_freq(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` without the boilerplate lines of their source."""
    out = line_freq.drop_lines(table(spark, sf_dir, "documents"), "source", "text", stats=True)
    return out.select("doc_id", "text", "n_lines", "n_dropped")


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items of ``benchmark`` found in ``documents``."""
    return decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licences named in all ``documents``."""
    return licenses.scan(table(spark, sf_dir, "documents"))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in all ``documents``."""
    return pii.scan(table(spark, sf_dir, "documents"))


def op8_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts of the learnt decision list over all ``documents``."""
    return rules.apply(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages of 50 words or more that repeat across ``documents``."""
    return suffix.repeated_passages(table(spark, sf_dir, "documents"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rates of all ``documents`` for the target weights of the label domains."""
    return mixing.mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_minhash, op2_quality, op3_secrets, op4_line_freq, op5_decontaminate, op6_licenses, op7_pii, op8_rules, op9_suffix, op10_mixing)}

#: The other operators learn a model, search fuzzily or parse by hand: tests compare those with brute force.
ORACLE_SQL: dict[str, str] = {"op1_minhash": oracle.MINHASH, "op3_secrets": oracle.SECRETS, "op4_line_freq": line_freq.SQL, "op5_decontaminate": oracle.LEAKS, "op9_suffix": oracle.SUFFIX}
