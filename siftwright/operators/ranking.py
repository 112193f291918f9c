"""Rank fusion, caps, top-k, grouping and budgets."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RRF_K = 60


def rrf(lanes: dict[str, DataFrame], key: str, score: str = "score", weights: dict[str, float] | None = None, k: int = RRF_K) -> DataFrame:
    """Reciprocal rank fusion: (key, score, methods, n_methods). Each lane is (key, score), already cut to its top.

    Lanes are unioned and summed by key: one shuffle instead of a chain of full outer joins. Ties in a lane go
    to the smaller key.
    """
    weights = weights or {}
    order = Window.partitionBy("lane").orderBy(F.col(score).desc(), key)
    out = None
    for lane, df in lanes.items():
        part = df.select(key, score, F.lit(lane).alias("lane"), F.lit(float(weights.get(lane, 1.0))).alias("w"))
        out = part if out is None else out.unionByName(part)
    ranked = out.withColumn("rank", F.row_number().over(order))
    return ranked.groupBy(key).agg(F.sum(F.col("w") / (F.lit(k) + F.col("rank"))).alias(score), F.array_join(F.sort_array(F.collect_set("lane")), ",").alias("methods"), F.count_distinct("lane").alias("n_methods"))


def top_per_group(df: DataFrame, group: list[str], order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    """The first ``k`` rows of each group; Spark prunes per task before the shuffle (WindowGroupLimit)."""
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col(rank) <= k)


def keep_best(df: DataFrame, group: list[str], order: list[Column], collapsed: str = "collapsed") -> DataFrame:
    """The best row of each group and how many rows it stands for besides itself.

    Only the best row's struct goes through the shuffle: min_by has a partial step.
    """
    rest = [c for c in df.columns if c not in group]
    keyed = df.withColumn("__row", F.struct(*rest)).withColumn("__order", F.struct(*order))
    out = keyed.groupBy(*group).agg(F.min_by("__row", "__order").alias("__best"), (F.count("*") - 1).alias(collapsed))
    return out.select(*group, *(F.col(f"__best.{c}").alias(c) for c in rest), collapsed)


def collapse_groups(df: DataFrame, group: str, score: str, id_col: str, least: int = 3, within: float = 0.85) -> DataFrame:
    """Groups with ``least`` members within a share of the group's top score shrink to their top row.

    ``members`` counts the rows that the hub stands for; rows outside the band stay as they are (members = 1).
    """
    top = Window.partitionBy(group)
    rows = df.withColumn("__in", F.col(score) >= F.max(score).over(top) * within)
    rows = rows.withColumn("__n", F.sum(F.col("__in").cast("long")).over(top))
    rows = rows.withColumn("__rank", F.row_number().over(top.orderBy(F.col(score).desc(), id_col)))
    tight = F.col("__in") & (F.col("__n") >= least)
    return rows.where(~tight | (F.col("__rank") == 1)).select(*df.columns, F.when(tight, F.col("__n")).otherwise(1).alias("members"))


def top_decile(df: DataFrame, score: str, share: float = 0.1) -> DataFrame:
    """One row: the value at place floor(n * share) - 1 (0 at least) of the positive scores in descending order.

    Counts of equal scores are dealt out by range; the counts of the ranges tell which one holds the place, and
    only that one is numbered. No task sees more than a range.
    """
    from siftwright.operators.graph import cut

    some = df.where(F.col(score) > 0).groupBy(score).agg(F.count("*").alias("n"))
    dealt = cut(some.repartitionByRange(F.col(score).desc()).withColumn("part", F.spark_partition_id()))
    sums = dealt.groupBy("part").agg(F.sum("n").alias("in_part"), F.max(score).alias("most"))
    order = Window.orderBy(F.col("most").desc())  # a row for each range
    run = sums.withColumn("before", F.sum("in_part").over(order) - F.col("in_part")).withColumn("all", F.sum("in_part").over(Window.partitionBy()))
    place = F.greatest(F.floor(F.col("all") * share) - 1, F.lit(0))
    held = run.withColumn("place", place).where((F.col("before") <= F.col("place")) & (F.col("place") < F.col("before") + F.col("in_part")))
    rows = dealt.join(F.broadcast(held), "part").withColumn("upto", F.col("before") + F.sum("n").over(Window.partitionBy("part").orderBy(F.col(score).desc())))
    return rows.where(F.col("upto") > F.col("place")).agg(F.max(score).alias("threshold"), F.max("all").alias("n"))


def running(df: DataFrame, group: list[str], order: list[Column], amount: Column, name: str) -> DataFrame:
    """Adds the sum of ``amount`` over each group's rows up to and with a row, in ``order`` (a total one).

    Rows are dealt out by range of group and order, so a hot group lies in as many tasks as it needs; the sums
    of the ranges, a row for each range and group, say what goes before. With ``F.lit(1)`` it's the row's place.
    """
    from siftwright.operators.graph import cut

    keys = [F.col(g) for g in group]
    dealt = cut(df.withColumn("__amount", amount).repartitionByRange(*keys, *order).withColumn("__part", F.spark_partition_id()))
    sums = dealt.groupBy("__part", *group).agg(F.sum("__amount").alias("__sum"))
    before = Window.partitionBy(*(keys or [F.lit(0)])).orderBy("__part")
    offsets = sums.select(F.col("__part").alias("__p"), *(F.col(g).alias(f"__g{i}") for i, g in enumerate(group)), (F.sum("__sum").over(before) - F.col("__sum")).alias("__before"))
    same = F.col("__part") == F.col("__p")
    for i, g in enumerate(group):
        same = same & F.col(g).eqNullSafe(F.col(f"__g{i}"))
    inner = F.sum("__amount").over(Window.partitionBy("__part", *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return dealt.join(offsets, same).withColumn(name, F.col("__before") + inner).select(*df.columns, name)


def pack_skip(df: DataFrame, group: list[str], order: list[Column], cost: str, id_col: str, budget: int) -> DataFrame:
    """Greedy packing: rows in order, a row that doesn't fit is skipped and later ones may still fit.

    Once a row of some cost doesn't fit, no later row of that cost does: so of each cost only the first
    floor(budget / cost) rows of a group can be taken, all told about budget * ln(budget) rows. Those are gathered in an
    array and folded, the others never leave their task (WindowGroupLimit). Rows without a positive cost aren't taken.
    Returns the group, id and cost of the rows taken, and what is left of the budget.
    """
    known = F.col(cost).cast("long")
    some = top_per_group(df.where((known > 0) & (known <= budget)), [*group, cost], order, budget, "__place").where(F.col("__place") * known <= budget)
    rows = some.select(*group, F.struct(*(o.alias(f"o{i}") for i, o in enumerate(order)), F.col(id_col).alias("id"), F.col(cost).cast("long").alias("cost")).alias("r"))
    listed = rows.groupBy(*group).agg(F.sort_array(F.collect_list("r")).alias("rs"))
    start = F.struct(F.lit(budget).cast("long").alias("left"), F.array().cast("array<struct<id:bigint,cost:bigint>>").alias("taken"))

    def fold(acc, r):
        take = F.struct(r["id"].cast("long").alias("id"), r["cost"].alias("cost"))
        return F.when(r["cost"] <= acc["left"], F.struct((acc["left"] - r["cost"]).alias("left"), F.concat(acc["taken"], F.array(take)).alias("taken"))).otherwise(acc)

    done = listed.select(*group, F.aggregate("rs", start, fold).alias("a"))
    return done.select(*group, F.col("a.left").alias("left_over"), F.explode("a.taken").alias("t")).select(*group, F.col("t.id").alias(id_col), F.col("t.cost").alias(cost), "left_over")


def pack_stop(df: DataFrame, group: list[str], order: list[Column], cost: str, budget: int) -> DataFrame:
    """Rows in order until the first that overflows the budget; costs aren't negative."""
    return running(df, group, order, F.col(cost), "used").where(F.col("used") <= budget)


def confidence(scores: DataFrame, group: list[str], score: str, wiring: Column | None = None) -> DataFrame:
    """(group, top, second, confidence): low without a clear top, medium where the second is close.

    A close second on a question about wiring counts as low.
    """
    two = top_per_group(scores, group, [F.col(score).desc()], 2)
    tops = two.groupBy(*group).agg(F.max(F.when(F.col("rank") == 1, F.col(score))).alias("top"), F.max(F.when(F.col("rank") == 2, F.col(score))).alias("second"))
    close = F.coalesce(F.col("second"), F.lit(0.0)) / F.col("top") > 0.8
    level = F.when(F.col("top") < 0.005, "low").when(close & (wiring if wiring is not None else F.lit(False)), "low").when(close, "medium").otherwise("high")
    return tops.withColumn("confidence", level)


def percentiles(df: DataFrame, group: list[str], value: str, order: list[Column], quantiles: dict[str, float], skip: int = 1) -> DataFrame:
    """sorted[floor(n * q)] for each quantile after dropping the first ``skip`` rows in ``order``.

    Equal values are counted first; the running counts of the values tell where each quantile falls.
    """
    first = top_per_group(df.select(*group, value, *(o.alias(f"__o{i}") for i, o in enumerate(order))), group, [F.col(f"__o{i}") for i in range(len(order))], skip, "__i").groupBy(*group, value).agg(F.count("*").alias("__skipped"))
    counts = df.groupBy(*group, value).agg(F.count("*").alias("__n"))
    same = (F.col(value).eqNullSafe(F.col("__v")),)
    skipped = first.select(*(F.col(g).alias(f"__s{i}") for i, g in enumerate(group)), F.col(value).alias("__v"), "__skipped")
    for i, g in enumerate(group):
        same = (*same, F.col(g).eqNullSafe(F.col(f"__s{i}")))
    left = counts.join(skipped, reduce(lambda a, b: a & b, same), "left").select(*group, value, (F.col("__n") - F.coalesce("__skipped", F.lit(0))).alias("__n")).where("__n > 0")
    placed = running(left, group, [F.col(value)], F.col("__n"), "__upto")
    total = placed.groupBy(*group).agg(F.sum("__n").alias("n"))
    sized = placed.join(total.select(*(F.col(g).alias(f"__t{i}") for i, g in enumerate(group)), "n"), reduce(lambda a, b: a & b, (F.col(g).eqNullSafe(F.col(f"__t{i}")) for i, g in enumerate(group)), F.lit(True)))
    at = lambda q: F.least(F.floor(F.col("n") * q), F.col("n") - 1)
    pick = [F.min(F.when(F.col("__upto") > at(q), F.col(value))).alias(name) for name, q in quantiles.items()]
    return sized.groupBy(*group, "n").agg(*pick)


def match_quality(name: Column, query: str) -> Column:
    """0 for the same name (case counts), 1 for a prefix, 2 for any place, null for no match (case doesn't count)."""
    low = F.lower(name)
    q = query.lower()
    return F.when(name == query, 0).when(low.startswith(q), 1).when(F.contains(low, F.lit(q)), 2)
