"""Quality rules as a learned decision list, in DataFrame operations only.

Document statistics are built-in expressions within the row: no shuffle. Sequential covering learns the list
from a bounded sample of labelled statistics: it grows a conjunction of thresholds on two thirds of the sample
by FOIL gain, prunes it on the other third, keeps it while it is precise enough, takes the covered rows away
and goes on. The list becomes one ordered CASE expression of SQL.

The sample: the LEARN_ROWS labelled rows with the smallest hash of their id, a documented bound; statistics
and verdicts cover every document.

Defined results. A null text has no words. Every input row gives a row, repeated rows and null ids too. Several
labels for one id: the smallest counts. Without labelled rows of both kinds the list is empty and only the base
rule decides. Extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

#: Bound of the labelled sample that the driver learns from.
LEARN_ROWS = 20_000
MAX_RULES = 8
MAX_TESTS = 3
#: A rule is kept if so large a share of the held-back rows that it covers is bad.
MIN_PRECISION = 0.9
#: Thresholds tried for a statistic.
GRID = 24

#: Statistics that rules may test.
TESTS = ("mean_word", "symbol_share", "upper_share", "mark_share", "dup_line_share", "repeat_share", "distinct_share", "n_words")


def base_statistics(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words) and the raw counts that rules use."""
    blank = "[\\x20\\x09-\\x0D]+"
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.withColumn("body", F.btrim("text", F.lit(" \t\n\x0b\f\r")))
    rows = rows.withColumn("words", F.when(F.col("body") == "", F.array().cast("array<string>")).otherwise(F.split("body", blank, -1)))
    rows = rows.withColumn("n_words", F.size("words").cast("long"))
    # hashes of the words once, then of each window of three
    rows = rows.withColumn("codes", F.transform("words", lambda w: F.xxhash64(w)))
    hashes = F.transform("codes", lambda c, i: F.xxhash64(c, F.get("codes", i + 1), F.get("codes", i + 2)))
    rows = rows.withColumn("hashes", F.slice(hashes, 1, F.greatest(F.size("codes") - 2, F.lit(0))))
    # only a text with equal windows has them sorted; equal ones are neighbours then
    some = F.size(F.array_distinct("hashes")) < F.size("hashes")
    rows = rows.withColumn("windows", F.when(some, F.sort_array(F.transform("hashes", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    rows = rows.withColumn("sorted", F.transform("windows", lambda w: w.h))
    again = F.filter(F.transform("windows", lambda w, j: F.when((F.get("sorted", j - 1) == w.h) | (F.get("sorted", j + 1) == w.h), w.i)), lambda i: i.isNotNull())
    rows = rows.withColumn("again", again)
    covered = F.size(F.array_distinct(F.concat("again", F.transform("again", lambda i: i + 1), F.transform("again", lambda i: i + 2))))
    rows = rows.withColumn("lines", F.filter(F.split("text", "\n", -1), lambda s: s.rlike("[^\\x20\\x09-\\x0D]")))
    # characters that are counted, all others taken out in one pass
    rows = rows.withColumn("solid", F.array_join("words", ""))
    rows = rows.withColumn("rare", F.regexp_replace("solid", "[^A-Z#*$%&|<>!?]+", ""))
    n = lambda c: F.length(c).cast("long")
    of = lambda chars: n("rare") - n(F.translate("rare", chars, ""))
    return rows.select(
        "id",
        "n_words",
        n("solid").alias("word_chars"),
        of("#*$%&|<>").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.col("again").isNull(), 0).otherwise(covered).cast("long").alias("n_repeat_words"),
        F.size("lines").cast("long").alias("n_lines"),
        F.size(F.array_distinct("codes")).cast("long").alias("n_distinct"),
        of("ABCDEFGHIJKLMNOPQRSTUVWXYZ").alias("n_upper"),
        of("!?").alias("n_marks"),
    )


#: The statistics that rules test, as SQL over the columns of base_statistics.
EXPRESSIONS = {
    "mean_word": "word_chars / greatest(n_words, 1)",
    "symbol_share": "n_symbols / greatest(word_chars, 1)",
    "upper_share": "n_upper / greatest(word_chars, 1)",
    "mark_share": "n_marks / greatest(n_words, 1)",
    "dup_line_share": "n_dup_lines / greatest(n_lines, 1)",
    "repeat_share": "n_repeat_words / greatest(n_words, 1)",
    "distinct_share": "n_distinct / greatest(n_words, 1)",
    "n_words": "n_words",
}


def _covers(data: dict, rule: list) -> np.ndarray:
    out = np.ones(len(data["bad"]), bool)
    for name, above, limit in rule:
        out &= (data[name] > limit) == above
    return out


def _where(data: dict, keep: np.ndarray) -> dict:
    return {k: v[keep] for k, v in data.items()}


def _grow(data: dict, grid: dict) -> list:
    """Add the test of greatest FOIL gain until no good row is covered or no test gains."""
    rule: list = []
    while len(rule) < MAX_TESTS:
        n0, p0 = len(data["bad"]), int(data["bad"].sum())
        if not p0 or p0 == n0:
            break
        best = (1e-9, None)
        for name, limits in grid.items():
            order = np.argsort(data[name], kind="stable")
            at = np.searchsorted(data[name][order], limits, side="right")
            below = np.concatenate([[0], np.cumsum(data["bad"][order])])[at]
            for above, p, n in ((True, p0 - below, n0 - at), (False, below, at)):
                gain = np.where(p > 0, p * (np.log2(np.maximum(p, 1) / np.maximum(n, 1)) - math.log2(p0 / n0)), 0.0)
                i = int(gain.argmax())
                if gain[i] > best[0] + 1e-9:
                    best = (float(gain[i]), (name, above, float(limits[i])))
        if best[1] is None:
            break
        rule.append(best[1])
        data = _where(data, _covers(data, rule[-1:]))
    return rule


def _worth(rule: list, data: dict) -> tuple[float, int]:
    """(p - n) / (p + n) on held-back rows, and the rows covered."""
    got = data["bad"][_covers(data, rule)]
    return ((2 * int(got.sum()) - len(got)) / len(got) if len(got) else -1.0), len(got)


def learn(rows: list[dict]) -> list[list[tuple[str, bool, float]]]:
    """The ordered rules, each a list of (statistic, above, limit), learnt from rows with TESTS and bad."""
    rows = sorted(rows, key=lambda r: r["order"])
    if len({r["bad"] for r in rows}) < 2:
        return []
    data = {k: np.array([r[k] for r in rows]) for k in (*TESTS, "bad")}
    held = np.arange(len(rows)) % 3 == 0
    grow, prune = _where(data, ~held), _where(data, held)
    rules: list = []
    while len(rules) < MAX_RULES and grow["bad"].any():
        grid = {}
        for name in TESTS:
            some = [np.unique(v) for v in (grow[name], grow[name][grow["bad"]])]
            grid[name] = np.unique(np.concatenate([v[len(v) * np.arange(GRID) // GRID] for v in some]))
        rule = _grow(grow, grid)
        while len(rule) > 1 and _worth(rule[:-1], prune)[0] >= _worth(rule, prune)[0]:
            rule = rule[:-1]
        worth, n = _worth(rule, prune) if rule else (-1.0, 0)
        if n < 3 or (worth + 1) / 2 < MIN_PRECISION:
            break
        rules.append(rule)
        grow, prune = (_where(x, ~_covers(x, rule)) for x in (grow, prune))
    return rules


def verdict(rules: list) -> Column:
    """True unless a rule fires: one ordered CASE over the statistics."""
    case = F.when(F.lit(False), False)
    for rule in rules:
        case = case.when(F.expr(" AND ".join(f"({EXPRESSIONS[n]}) {'>' if above else '<='} {limit!r}D" for n, above, limit in rule)), False)
    return case.otherwise(True)


def fit(stats: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality") -> list:
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).where("id IS NOT NULL AND y IN (0, 1)").groupBy("id").agg(F.min("y").alias("y"))
    picked = known.orderBy(F.xxhash64("id"), "id").limit(LEARN_ROWS)
    chosen = stats.join(picked, "id").select(F.xxhash64("id").alias("order"), (F.col("y") == 0).alias("bad"), *(F.expr(f"double({EXPRESSIONS[t]})").alias(t) for t in TESTS))
    return learn([r.asDict() for r in chosen.limit(LEARN_ROWS).collect()])


def apply(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """A row for each document: the base statistics, base_failed and kept."""
    stats = cut(base_statistics(docs, id_col, text_col), "rules-stats")
    rules = fit(stats, labels, id_col, label_col)
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return stats.select(F.col("id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & verdict(rules)).alias("kept"))
