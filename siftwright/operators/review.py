"""Reviews of a change and the health of a code base."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwright.operators.relational import grade
from siftwright.operators.stats import risk, risk_level

LEVELS = ("low", "medium", "high", "critical")


def max_level(level: Column) -> Column:
    """The gravest of the levels (an aggregate); 'low' if there is none."""
    place = reduce(lambda acc, i: acc.when(level == LEVELS[i], i), range(1, len(LEVELS)), F.when(level == LEVELS[0], 0))
    return F.get(F.array(*map(F.lit, LEVELS)), F.coalesce(F.max(place), F.lit(0)))


def review_diff(changes: DataFrame, symbols: DataFrame, refs: DataFrame, edges: DataFrame, findings: DataFrame, tests: DataFrame) -> DataFrame:
    """A row for each changed file: added and removed symbols, references left dangling, importers, imports, risk and level.

    changes(path, status, churn), symbols(path, name, change) as ``symbol_diff`` gives them, refs(path, name),
    edges(src, dst), findings(path, severity), tests(source). A symbol that is removed here but added in another
    changed file has moved, and its references don't dangle.
    """
    n = lambda cond: F.sum(F.when(cond, 1).otherwise(0)).cast("long")
    gone = symbols.where("change = 'removed'").select("path", "name").join(symbols.where("change = 'added'").select("name"), "name", "left_anti").distinct()
    left = refs.join(gone.select("name").distinct(), "name", "left_semi").groupBy("name").agg(F.count("*").alias("uses"))
    dangling = gone.join(left, "name").groupBy("path").agg(F.sum("uses").alias("dangling"))
    counts = symbols.groupBy("path").agg(n(F.col("change") == "added").alias("added"), n(F.col("change") == "removed").alias("removed"))
    fan_in = edges.distinct().groupBy(F.col("dst").alias("path")).agg(F.count("*").alias("importers"))
    fan_out = edges.distinct().groupBy(F.col("src").alias("path")).agg(F.count("*").alias("imports"))
    found = findings.groupBy("path").agg(max_level(F.col("severity")).alias("worst"))
    tested = tests.select(F.col("source").alias("path")).distinct().withColumn("tested", F.lit(True))
    rows = changes
    for part in (counts, dangling, fan_in, fan_out, found, tested):
        rows = rows.join(part, "path", "left")
    rows = rows.fillna(0, ["added", "removed", "dangling", "importers", "imports"])
    score = risk(F.col("tested").isNull(), F.coalesce(F.col("worst").isin("high", "critical"), F.lit(False)), F.col("importers"), F.col("importers"), F.col("dangling"), F.col("churn"))
    return rows.select("path", "status", "added", "removed", "dangling", "importers", "imports", F.round(score, 6).alias("risk")).withColumn("level", risk_level(F.col("risk")))


def _ladder(value: Column, bounds: tuple[float, ...], strict: bool = False) -> Column:
    """A to F by the first bound that isn't exceeded; with ``strict`` the first bound must not be reached."""
    out = F.when(value < bounds[0] if strict else value <= bounds[0], 5)
    for points, bound in zip((4, 3, 2), bounds[1:], strict=True):
        out = out.when(value <= bound, points)
    return out.otherwise(1)


def health(measures: DataFrame) -> DataFrame:
    """measures(dead_pct, cycles, max_fan_in, security) -> points of each dimension (5 best), their mean and its letter."""
    points = measures.select(
        "*",
        _ladder(F.col("dead_pct"), (5, 15, 25, 40)).alias("dead_points"),
        _ladder(F.col("cycles"), (0, 2, 5, 10)).alias("cycle_points"),
        _ladder(F.col("max_fan_in"), (10, 20, 35, 50), strict=True).alias("coupling_points"),
        _ladder(F.col("security"), (0, 5, 15, 30)).alias("security_points"),
    )
    mean = (F.col("dead_points") + F.col("cycle_points") + F.col("coupling_points") + F.col("security_points")) / 4
    return points.withColumn("score", mean).withColumn("grade", grade(F.col("score")))


def enoughness(kind: str, total: Column, needed: Column, budget: Column, confidence: Column | None = None) -> Column:
    """Struct (needs_more, gap, suggested_budget): what an answer under a token budget leaves unproved."""
    more = needed > budget
    surety = F.coalesce(confidence, F.lit("medium")) if confidence is not None else F.lit("medium")
    gap = F.when(more, "hidden_by_budget").when(total == 0, "no_matches")
    gap = gap.otherwise("refs_or_test_surface_not_checked") if kind == "lookup" else gap.when(surety == "high", "none").otherwise("ranking_uncertain")
    return F.struct(F.coalesce(more, F.lit(False)).alias("needs_more"), gap.alias("gap"), F.when(more, needed).alias("suggested_budget"))


def delete_files(gone: DataFrame, tables: dict[str, tuple[DataFrame, str]]) -> dict[str, DataFrame]:
    """Tables without the rows of deleted files, children with their parents: gone(path), tables name -> (rows, column of the path)."""
    paths = gone.select("path").distinct()
    return {name: rows.join(paths.withColumnRenamed("path", column), column, "left_anti").select(rows.columns) for name, (rows, column) in tables.items()}
