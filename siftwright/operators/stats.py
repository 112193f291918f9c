"""Usage statistics, receipts, evaluation and rule scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwright.operators.ranking import top_per_group


def daily(events: DataFrame, ts: str, user: str, error: Column, days: int | None = None) -> DataFrame:
    """(day, events, users, errors, error_rate) with empty days filled in between the first and the last."""
    counted = events.groupBy(F.to_date(ts).alias("day")).agg(F.count("*").alias("events"), F.count_distinct(user).alias("users"), F.sum(error.cast("long")).alias("errors"))
    ends = events.agg(F.to_date(F.max(ts)).alias("b"), F.to_date(F.min(ts)).alias("a"))
    first = F.col("a") if days is None else F.date_sub("b", days - 1)
    spine = ends.select(F.explode(F.sequence(first, F.col("b"))).alias("day"))
    out = spine.join(counted, "day", "left")
    rate = F.when(F.col("events") > 0, F.col("errors") / F.col("events")).otherwise(0.0)
    return out.fillna(0, ["events", "users", "errors"]).withColumn("error_rate", rate)


def breakdown(events: DataFrame, dims: list[str], user: str) -> DataFrame:
    """(dim, value, events, users) for each dimension alone, by one pass with grouping sets."""
    which = F.coalesce(*(F.when(F.grouping(d) == 0, F.lit(d)) for d in dims))
    value = F.coalesce(*(F.when(F.grouping(d) == 0, F.col(d).cast("string")) for d in dims))
    sets = [[F.col(d)] for d in dims]
    return events.groupingSets(sets, *(F.col(d) for d in dims)).agg(which.alias("dim"), value.alias("value"), F.count("*").alias("events"), F.count_distinct(user).alias("users")).select("dim", "value", "events", "users")


def by_hour(events: DataFrame, ts: str) -> DataFrame:
    """All 24 hours of the day with their events."""
    spine = events.sparkSession.range(24).select(F.col("id").cast("int").alias("hour"))
    return spine.join(events.groupBy(F.hour(ts).alias("hour")).agg(F.count("*").alias("events")), "hour", "left").fillna(0, ["events"])


def trailing(events: DataFrame, ts: str, minutes: int = 10) -> DataFrame:
    """One row: events within the last minutes before the latest one."""
    last = events.agg(F.max(ts).alias("last"))
    return events.join(F.broadcast(last), F.col(ts) > F.col("last") - F.expr(f"INTERVAL {minutes} MINUTES")).agg(F.count("*").alias("events"))


def tool_stats(calls: DataFrame, tool: str, ts: str, error: Column, value: str) -> DataFrame:
    """Per tool: calls, successes, errors, last call, last error, total of ``value``."""
    bad = error.cast("long")
    return calls.groupBy(tool).agg(F.count("*").alias("calls"), F.sum(1 - bad).alias("ok"), F.sum(bad).alias("errors"), F.max(ts).alias("last_call"), F.max(F.when(error, F.col(ts))).alias("last_error"), F.sum(value).alias("total"))


def error_codes(calls: DataFrame, tool: str, error: Column, code: str) -> DataFrame:
    """(tool, codes): for each tool a map of its error codes and how often they came."""
    counts = calls.where(error).groupBy(tool, F.coalesce(code, F.lit("error")).alias("code")).agg(F.count("*").alias("n"))
    return counts.groupBy(tool).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("code", "n")))).alias("codes"))


def profile_coverage(calls: DataFrame, tool: str, profiles: DataFrame, enough: float = 0.95, fallback: float = 0.7) -> DataFrame:
    """(profile, tools, covered, coverage, recommended): the smallest profile that covers enough calls, else the best.

    profiles(profile, tool).
    """
    count = calls.groupBy(F.col(tool).alias("tool")).agg(F.count("*").alias("n"))
    total = count.agg(F.sum("n").alias("total"))
    per = profiles.join(count, "tool", "left").groupBy("profile").agg(F.count("*").alias("tools"), F.coalesce(F.sum("n"), F.lit(0)).alias("covered"))
    rated = per.join(F.broadcast(total)).withColumn("coverage", F.col("covered") / F.col("total")).drop("total")
    order = F.struct(F.when(F.col("coverage") >= enough, 0).otherwise(1).alias("a"), F.when(F.col("coverage") >= enough, F.col("tools")).otherwise(0).alias("b"), (-F.col("coverage")).alias("c"), F.col("profile").alias("p"))
    pick = rated.where(F.col("coverage") >= fallback).agg(F.min_by("profile", order).alias("pick"))
    return rated.join(F.broadcast(pick)).withColumn("recommended", F.coalesce(F.col("profile") == F.col("pick"), F.lit(False))).drop("pick")


def receipt(messages: DataFrame, tokens_in: Column, tokens_out: Column, cached: Column, price_in: float, price_out: float) -> DataFrame:
    """One row: token sums and cost; cached input costs a tenth."""
    sums = messages.agg(F.count("*").alias("messages"), F.sum(tokens_in).alias("tokens_in"), F.sum(tokens_out).alias("tokens_out"), F.sum(cached).alias("tokens_cached"))
    return sums.withColumn("cost", (F.col("tokens_in") * price_in + F.col("tokens_cached") * price_in * 0.1 + F.col("tokens_out") * price_out) / 1e6)


def tool_receipt(results: DataFrame, tool: str, size: Column, session: str) -> DataFrame:
    """Per tool: calls, bytes of results, the largest result and the session that it came in."""
    return results.groupBy(tool).agg(F.count("*").alias("calls"), F.sum(size).alias("bytes"), F.max(size).alias("largest"), F.max_by(session, F.struct(size.alias("s"), -F.col(session))).alias("largest_in"))


def yearly(cost: Column, days: Column) -> Column:
    """What a cost over some days comes to in a year."""
    return cost / F.greatest(days, F.lit(1)) * 365


def set_scores(found: DataFrame, expected: DataFrame, key: str, value: str) -> DataFrame:
    """(key, precision, recall, f1) of sets; nothing found and nothing expected is a perfect score."""
    a = found.select(key, value).distinct().withColumn("f", F.lit(1))
    b = expected.select(key, value).distinct().withColumn("e", F.lit(1))
    s = a.join(b, [key, value], "full").groupBy(key).agg(F.count("f").alias("found"), F.count("e").alias("expected"), F.sum((F.col("f").isNotNull() & F.col("e").isNotNull()).cast("long")).alias("hit"))
    p = F.when(F.col("found") == 0, F.when(F.col("expected") == 0, 1.0).otherwise(0.0)).otherwise(F.col("hit") / F.col("found"))
    r = F.when(F.col("expected") == 0, 1.0).otherwise(F.col("hit") / F.col("expected"))
    s = s.withColumn("precision", p).withColumn("recall", r)
    return s.withColumn("f1", F.when(F.col("precision") + F.col("recall") == 0, 0.0).otherwise(2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))))


def mean_reciprocal_rank(ranked: DataFrame, key: str, rank: str, relevant: Column) -> DataFrame:
    """One row: questions, share with a hit, mean reciprocal rank of the first hit."""
    first = ranked.groupBy(key).agg(F.min(F.when(relevant, F.col(rank))).alias("first"))
    return first.agg(F.count("*").alias("questions"), F.avg(F.col("first").isNotNull().cast("double")).alias("hit_rate"), F.avg(F.coalesce(1 / F.col("first"), F.lit(0.0))).alias("mrr"))


def risk(untested: Column, insecure: Column, fan_in: Column, callers: Column, dangling: Column, churn: Column) -> Column:
    """Risk of a changed file between 0 and 1."""
    parts = F.when(untested, 0.30).otherwise(0.0) + F.when(insecure, 0.20).otherwise(0.0)
    parts = parts + F.least(F.lit(0.15), fan_in * 0.0075) + F.least(F.lit(0.10), callers * 0.001) + F.least(F.lit(0.20), dangling * 0.1)
    return F.least(F.lit(1.0), parts + F.least(F.lit(0.05), F.log1p(churn) / 100))


def risk_level(score: Column) -> Column:
    return F.when(score >= 0.7, "critical").when(score >= 0.45, "high").when(score >= 0.2, "medium").otherwise("low")


def severity_score(severity: Column) -> Column:
    """Weighted sum of findings (an aggregate)."""
    return F.sum(F.when(severity == "critical", 10).when(severity == "high", 5).when(severity == "medium", 2).when(severity == "low", 1).otherwise(0))


def opportunity(text: Column, age_hours: Column, terms: tuple[str, ...], penalties: Column | None = None) -> Column:
    """0 to 100: how many terms a text names, how fresh it is, less penalties."""
    n = F.size(F.filter(F.array(*map(F.lit, terms)), lambda t: F.contains(F.lower(text), t)))
    level = F.when(n >= 3, 3).when(n == 2, 2).when(n == 1, 1).otherwise(0)
    fresh = F.when(age_hours <= 24, 3).when(age_hours <= 168, 2).otherwise(1)
    total = F.round((level + fresh) / 6 * 100) - (penalties if penalties is not None else F.lit(0))
    return F.greatest(F.lit(0), F.least(F.lit(100), total)).cast("int")


def partition_plan(items: DataFrame, group: str, item: str, threshold: int = 80, least: int = 3, sample: int = 3) -> DataFrame:
    """(group, n, sample): groups of a large result by size; empty if the result is within the threshold."""
    total = items.agg(F.count("*").alias("total")).where(F.col("total") > threshold)
    per = items.groupBy(group).agg(F.count("*").alias("n")).where(F.col("n") >= least)
    first = top_per_group(items.select(group, item).distinct(), [group], [F.col(item)], sample)
    named = first.groupBy(group).agg(F.array_join(F.sort_array(F.collect_list(item)), ",").alias("sample"))
    return per.join(named, group).join(F.broadcast(total)).drop("total")
