"""Relational queries: references, layers, diffs, statistics, ranks and budgets.

The provided tables stand in for code tables: a line item is a reference from a chunk (order) in a file
(supplier) to a name (part); orders stand in for memories, events for telemetry.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from siftwright.functions.text import base_name, clean_url, common_prefix_dir, content_hash, dir_name, identifier_parts, referrer_bucket, token_estimate, tokens, top_dirs, url_host
from siftwright.operators import memory, ranking, relational, stats
from siftwright.plans.registry import query


@query("SELECT l_partkey, count(*) AS refs, count(DISTINCT l_suppkey) AS files, round(count(*) * sqrt(count(DISTINCT l_suppkey)), 6) AS score FROM lineitem GROUP BY 1 ORDER BY 4 DESC, 1 LIMIT 10")
def god_nodes(t):
    return relational.god_nodes(t.lineitem, "l_partkey", "l_suppkey").withColumn("score", F.round("score", 6))


@query("SELECT l_partkey, count(*) AS refs, count(DISTINCT l_suppkey) AS files, round(count(*) * sqrt(count(DISTINCT l_suppkey)), 6) AS score FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_size <= 10) GROUP BY 1 ORDER BY 4 DESC, 1 LIMIT 10")
def god_nodes_defined(t):
    defined = t.part.where("p_size <= 10").select(F.col("p_partkey").alias("l_partkey"))
    return relational.god_nodes(t.lineitem, "l_partkey", "l_suppkey", defined).withColumn("score", F.round("score", 6))


@query("SELECT p_partkey, p_name, CASE WHEN p_name = 'red widget' THEN 0 WHEN starts_with(lower(p_name), 'red widget') THEN 1 ELSE 2 END AS tier FROM part WHERE contains(lower(p_name), 'red widget') ORDER BY tier, p_retailprice DESC, p_partkey LIMIT 20")
def lookup_ranked(t):
    return relational.lookup(t.part, "p_name", "red widget", "p_retailprice", "p_partkey").select("p_partkey", "p_name", "tier")


@query("SELECT l_orderkey * 100 + l_linenumber AS chunk_id, o_custkey AS file_id, round(c_acctbal, 2) AS rank FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey WHERE l_partkey = 7 ORDER BY c_acctbal DESC, l_orderkey * 100 + l_linenumber LIMIT 50")
def impact_refs(t):
    chunk = (F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("chunk_id")
    refs = t.lineitem.select(F.col("l_partkey").alias("target"), chunk)
    chunks = t.lineitem.select("l_orderkey", chunk).join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).select("chunk_id", F.col("o_custkey").alias("file_id")).distinct()
    files = t.customer.select(F.col("c_custkey").alias("file_id"), F.col("c_acctbal").alias("rank"))
    return relational.impact(refs, chunks, files, 7).select("chunk_id", "file_id", F.round("rank", 2).alias("rank"))


@query("SELECT p_brand, count(*) AS definitions, CASE WHEN count(*) = 1 THEN 'DIRECT' WHEN count(*) > 1 THEN 'UNCERTAIN' ELSE 'INFERRED' END AS kind FROM part GROUP BY 1")
def definition_kinds(t):
    return t.part.groupBy("p_brand").agg(F.count("*").alias("definitions")).withColumn("kind", relational.definition_kind(F.col("definitions")))


@query("SELECT p_partkey, p_name FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 49 AND l_partkey IS NOT NULL) AND NOT p_size > 40")
def orphan_parts(t):
    refs = t.lineitem.where("l_quantity > 49").select(F.col("l_partkey").cast("string").alias("target"))
    parts = t.part.withColumn("name", F.col("p_partkey").cast("string"))
    return relational.orphans(parts, refs, "name", "target", F.col("p_size") > 40).select("p_partkey", "p_name")


@query("SELECT p_partkey, coalesce(n, 0) AS refs FROM (SELECT p_partkey FROM part WHERE p_size = 1) LEFT JOIN (SELECT l_partkey, count(*) AS n FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1) ON p_partkey = l_partkey ORDER BY refs DESC, p_partkey LIMIT 20")
def dangling_refs(t):
    return relational.dangling(t.part.where("p_size = 1").select("p_partkey"), t.lineitem.where("l_returnflag = 'R'"), "p_partkey", "l_partkey")


@query("SELECT l_partkey, count(DISTINCT l_suppkey) AS fan_in FROM lineitem WHERE l_returnflag <> 'A' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 1")
def max_fan_in(t):
    return relational.max_fan_in(t.lineitem, "l_suppkey", "l_partkey", F.col("l_returnflag") == "A")


_LAYERS = "SELECT o.o_orderpriority AS src, p.p_brand AS dst, count(*) AS edges, round(sum(l_quantity), 2) AS weight FROM lineitem JOIN orders o ON l_orderkey = o_orderkey JOIN part p ON l_partkey = p_partkey GROUP BY 1, 2"


def _layers(t):
    e = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).join(t.part, F.col("l_partkey") == F.col("p_partkey"))
    return relational.layer_edges(e.select(F.col("o_orderpriority").alias("src"), F.col("p_brand").alias("dst"), "l_quantity"), "src", "dst", F.col("l_quantity"))


@query(_LAYERS)
def layer_edges(t):
    return _layers(t).withColumn("weight", F.round("weight", 2))


@query(f"WITH p AS ({_LAYERS}), b AS (SELECT src AS dir, count(DISTINCT dst) AS fan_out, 0 AS fan_in FROM p GROUP BY 1 UNION ALL SELECT dst, 0, count(DISTINCT src) FROM p GROUP BY 1) SELECT dir, sum(fan_out)::BIGINT AS fan_out, sum(fan_in)::BIGINT AS fan_in, round(5 - (sum(fan_out) / (sum(fan_in) + sum(fan_out) + 1)::DOUBLE) * 4, 6) AS grade FROM b GROUP BY 1")
def layer_grades(t):
    return relational.layer_grades(_layers(t), "src", "dst").withColumn("grade", F.round("grade", 6))


@query("SELECT lang, count(*) AS n, round(count(*) / (SELECT count(*) FROM documents)::DOUBLE, 6) AS share FROM documents GROUP BY 1")
def lang_histogram(t):
    return relational.histogram(t.documents, "lang").withColumn("share", F.round("share", 6))


@query("SELECT o_orderpriority, sum(CASE o_orderstatus WHEN 'F' THEN 10 WHEN 'P' THEN 5 WHEN 'O' THEN 2 ELSE 0 END)::BIGINT AS score FROM orders GROUP BY 1")
def severity_score(t):
    severity = F.when(F.col("o_orderstatus") == "F", "critical").when(F.col("o_orderstatus") == "P", "high").when(F.col("o_orderstatus") == "O", "medium")
    return t.orders.groupBy("o_orderpriority").agg(stats.severity_score(severity).alias("score"))


@query("SELECT c_mktsegment, round(avg(c_acctbal) / 2000, 6) AS score, CASE WHEN avg(c_acctbal) / 2000 >= 4.5 THEN 'A' WHEN avg(c_acctbal) / 2000 >= 3.5 THEN 'B' WHEN avg(c_acctbal) / 2000 >= 2.5 THEN 'C' WHEN avg(c_acctbal) / 2000 >= 1.5 THEN 'D' ELSE 'F' END AS grade FROM customer GROUP BY 1")
def grade_ladder(t):
    s = t.customer.groupBy("c_mktsegment").agg((F.avg("c_acctbal") / 2000).alias("score"))
    return s.select("c_mktsegment", F.round("score", 6).alias("score"), relational.grade(F.col("score")).alias("grade"))


_RISK = """
WITH f AS (SELECT l_suppkey, count(DISTINCT l_partkey) AS fan_in, count(*) AS callers, count(*) FILTER (WHERE l_returnflag = 'R') AS dang, sum(l_quantity) AS churn,
  bool_or(l_linestatus = 'F') AS insecure, l_suppkey % 3 = 0 AS untested FROM lineitem GROUP BY l_suppkey),
s AS (SELECT l_suppkey, least(1.0, CASE WHEN untested THEN 0.3 ELSE 0 END + CASE WHEN insecure THEN 0.2 ELSE 0 END + least(0.15, fan_in * 0.0075) + least(0.10, callers * 0.001) + least(0.20, dang * 0.1) + least(0.05, ln(1 + churn) / 100))::DOUBLE AS r FROM f)
SELECT l_suppkey, round(r, 6) AS risk, CASE WHEN round(r, 6) >= 0.7 THEN 'critical' WHEN round(r, 6) >= 0.45 THEN 'high' WHEN round(r, 6) >= 0.2 THEN 'medium' ELSE 'low' END AS level FROM s
"""


@query(_RISK)
def risk_score(t):
    f = t.lineitem.groupBy("l_suppkey").agg(F.count_distinct("l_partkey").alias("fan_in"), F.count("*").alias("callers"), F.sum((F.col("l_returnflag") == "R").cast("long")).alias("dang"), F.sum("l_quantity").alias("churn"), F.bool_or(F.col("l_linestatus") == "F").alias("insecure"))
    r = F.round(stats.risk(F.col("l_suppkey") % 3 == 0, F.col("insecure"), F.col("fan_in"), F.col("callers"), F.col("dang"), F.col("churn")), 6)
    return f.select("l_suppkey", r.alias("risk")).withColumn("level", stats.risk_level(F.col("risk")))


@query("WITH d AS (SELECT ts::DATE AS day, count(*) AS events, count(DISTINCT user_id) AS users, count(*) FILTER (WHERE event_type = 'error') AS errors FROM events GROUP BY 1), s AS (SELECT unnest(generate_series(min(ts)::DATE, max(ts)::DATE, INTERVAL 1 DAY))::DATE AS day FROM events) SELECT day, coalesce(events, 0) AS events, coalesce(users, 0) AS users, coalesce(errors, 0) AS errors, round(CASE WHEN events > 0 THEN errors / events::DOUBLE ELSE 0 END, 6) AS error_rate FROM s LEFT JOIN d USING (day)")
def adoption_daily(t):
    return stats.daily(t.events, "ts", "user_id", F.col("event_type") == "error").withColumn("error_rate", F.round("error_rate", 6))


@query("SELECT 'event_type' AS dim, event_type AS value, count(*) AS events, count(DISTINCT user_id) AS users FROM events GROUP BY event_type UNION ALL SELECT 'day', strftime(ts, '%Y-%m-%d'), count(*), count(DISTINCT user_id) FROM events GROUP BY 2")
def adoption_breakdown(t):
    return stats.breakdown(t.events.withColumn("day", F.date_format("ts", "yyyy-MM-dd")), ["event_type", "day"], "user_id")


@query("SELECT h::INT AS hour, coalesce(n, 0) AS events FROM range(24) r(h) LEFT JOIN (SELECT hour(ts) AS hh, count(*) AS n FROM events GROUP BY 1) ON hh = h")
def hourly_hist(t):
    return stats.by_hour(t.events, "ts")


@query("SELECT count(*) AS events FROM events WHERE ts > (SELECT max(ts) - INTERVAL 10 MINUTES FROM events)")
def trailing_count(t):
    return stats.trailing(t.events, "ts")


@query("SELECT page_id, regexp_replace(lower(regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1)), '^www\\.', '') AS host, CASE WHEN url IS NULL OR url = '' THEN 'direct' WHEN regexp_matches(lower(regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1)), '(^|\\.)github\\.(com|io)$') THEN 'github' ELSE 'other' END AS bucket, substr(regexp_replace(lower(regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1)), '^www\\.', '') || regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1), 1, 256) AS clean FROM pages")
def url_bucket(t):
    return t.pages.select("page_id", url_host(F.col("url")).alias("host"), referrer_bucket(F.col("url")).alias("bucket"), clean_url(F.col("url")).alias("clean"))


@query("SELECT event_type, count(*) AS calls, count(*) FILTER (WHERE value >= 10) AS ok, count(*) FILTER (WHERE value < 10) AS errors, max(ts) AS last_call, max(ts) FILTER (WHERE value < 10) AS last_error, round(sum(value), 2) AS total FROM events WHERE value IS NOT NULL GROUP BY 1")
def tool_stats(t):
    return stats.tool_stats(t.events.where("value IS NOT NULL"), "event_type", "ts", F.col("value") < 10, "value").withColumn("total", F.round("total", 2))


_PROFILES = [("small", "view"), ("small", "click"), ("middle", "view"), ("middle", "click"), ("middle", "purchase"), ("middle", "signup"), ("full", "view"), ("full", "click"), ("full", "purchase"), ("full", "signup"), ("full", "error")]


@query(f"WITH p(profile, tool) AS (VALUES {', '.join(map(str, _PROFILES))}), c AS (SELECT event_type AS tool, count(*) AS n FROM events GROUP BY 1), a AS (SELECT profile, count(*) AS tools, coalesce(sum(n), 0)::BIGINT AS covered FROM p LEFT JOIN c USING (tool) GROUP BY 1), r AS (SELECT *, covered / (SELECT sum(n) FROM c)::DOUBLE AS cov FROM a) SELECT profile, tools, covered, round(cov, 6) AS coverage, coalesce(profile = (SELECT profile FROM r WHERE cov >= 0.7 ORDER BY CASE WHEN cov >= 0.95 THEN 0 ELSE 1 END, CASE WHEN cov >= 0.95 THEN tools ELSE 0 END, -cov, profile LIMIT 1), false) AS recommended FROM r")
def profile_coverage(t):
    profiles = t.spark.createDataFrame(_PROFILES, "profile string, tool string")
    return stats.profile_coverage(t.events, "event_type", profiles).withColumn("coverage", F.round("coverage", 6))


@query("SELECT count(*) AS messages, sum(CASE WHEN role <> 'assistant' THEN ceil(length(text) / 3.5) ELSE 0 END)::BIGINT AS tokens_in, sum(CASE WHEN role = 'assistant' THEN ceil(length(text) / 3.5) ELSE 0 END)::BIGINT AS tokens_out, sum(CASE WHEN turn > 0 THEN ceil(length(text) / 3.5) ELSE 0 END)::BIGINT AS tokens_cached, round((sum(CASE WHEN role <> 'assistant' THEN ceil(length(text) / 3.5) ELSE 0 END) * 3 + sum(CASE WHEN turn > 0 THEN ceil(length(text) / 3.5) ELSE 0 END) * 0.3 + sum(CASE WHEN role = 'assistant' THEN ceil(length(text) / 3.5) ELSE 0 END) * 15)::DOUBLE / 1000000, 6) AS cost FROM conversations")
def receipt_cost(t):
    n = token_estimate(F.col("text"))
    out = F.col("role") == "assistant"
    r = stats.receipt(t.conversations, F.when(~out, n).otherwise(0), F.when(out, n).otherwise(0), F.when(F.col("turn") > 0, n).otherwise(0), 3.0, 15.0)
    return r.withColumn("cost", F.round("cost", 6))


@query("SELECT count(*) AS edges, count(DISTINCT l_suppkey) AS sources, count(DISTINCT l_partkey) AS targets, round(count(*) / count(DISTINCT l_suppkey)::DOUBLE, 6) AS avg_out, round(count(*) / count(DISTINCT l_partkey)::DOUBLE, 6) AS avg_in FROM lineitem")
def graph_summary(t):
    s = relational.graph_summary(t.lineitem, "l_suppkey", "l_partkey")
    return s.withColumns({c: F.round(c, 6) for c in ("avg_out", "avg_in")})


@query("SELECT a.o_orderkey AS older, b.o_orderkey AS newer, 1::BIGINT AS shared FROM orders a JOIN orders b ON a.o_custkey = b.o_custkey AND a.o_orderstatus <> b.o_orderstatus AND (a.o_orderdate < b.o_orderdate OR (a.o_orderdate = b.o_orderdate AND a.o_orderkey < b.o_orderkey))")
def conflict_pairs(t):
    return relational.shared_pins(t.orders, "o_orderkey", F.array("o_custkey"), "o_orderstatus", "o_orderdate")


@query("WITH a AS (SELECT p_partkey, p_size FROM part WHERE p_partkey % 7 <> 0), b AS (SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN p_size + 1 ELSE p_size END AS p_size FROM part WHERE p_partkey % 11 <> 0) SELECT coalesce(a.p_partkey, b.p_partkey) AS p_partkey, CASE WHEN a.p_partkey IS NULL THEN 'added' WHEN b.p_partkey IS NULL THEN 'removed' WHEN a.p_size IS NOT DISTINCT FROM b.p_size THEN 'same' ELSE 'changed' END AS change FROM a FULL JOIN b ON a.p_partkey = b.p_partkey")
def symbol_diff(t):
    old = t.part.where("p_partkey % 7 <> 0").select("p_partkey", "p_size")
    new = t.part.where("p_partkey % 11 <> 0").select("p_partkey", F.expr("CASE WHEN p_partkey % 5 = 0 THEN p_size + 1 ELSE p_size END").alias("p_size"))
    return relational.symbol_diff(old, new, ["p_partkey"], "p_size")


@query("SELECT p_type, count(DISTINCT p_brand) AS files, min(p_brand) AS first_file, max(p_brand) AS last_file FROM part GROUP BY 1 HAVING count(DISTINCT p_brand) >= 2")
def duplicate_names(t):
    return relational.duplicates(t.part, "p_type", "p_brand")


@query("WITH i AS (SELECT l_orderkey AS k, l_linenumber * 10 AS a, l_linenumber * 10 + 14 AS b, l_partkey AS v FROM lineitem), p AS (SELECT DISTINCT l_orderkey AS k, l_linenumber * 7 AS place FROM lineitem) SELECT k, place, max_by(v, a) AS v FROM (SELECT p.k, p.place, i.a, i.v FROM p LEFT JOIN i ON p.k = i.k AND a <= place AND b >= place) GROUP BY 1, 2")
def breadcrumb_asof(t):
    """Line items of an order share numbers: of those the first in the table counts, as in SQL, whatever task reads it."""
    place = F.struct(F.col("_metadata.file_path"), F.col("_metadata.row_index")).alias("row")
    rows = t.lineitem.select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"), F.col("l_partkey").alias("v"), place)
    intervals = rows.select("k", (F.col("n") * 10).alias("a"), (F.col("n") * 10 + 14).alias("b"), "v", "row")
    return relational.as_of(rows.select("k", (F.col("n") * 7).alias("place")).distinct(), intervals, "k", "place", "a", "b", "v", tie=["row"])


@query("SELECT a.l_suppkey AS k, a.l_partkey AS found, b.l_partkey AS expected FROM lineitem a JOIN lineitem b ON a.l_suppkey = b.l_suppkey AND abs(a.l_partkey - b.l_partkey) <= 3 WHERE a.l_quantity > 48 AND b.l_quantity < 3")
def tolerance_match(t):
    f = t.lineitem.where("l_quantity > 48").select(F.col("l_suppkey").alias("k"), F.col("l_partkey").alias("found"))
    e = t.lineitem.where("l_quantity < 3").select(F.col("l_suppkey").alias("k"), F.col("l_partkey").alias("expected"))
    return relational.within(f, e, "k", "found", "expected", 3)


@query("SELECT a.l_orderkey AS k, a.l_linenumber AS x, b.l_linenumber AS y FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey WHERE a.l_linenumber * 3 + 4 >= b.l_linenumber * 5 AND a.l_linenumber * 3 <= b.l_linenumber * 5 + 1")
def overlap_match(t):
    n = F.col("l_linenumber")
    a = t.lineitem.select(F.col("l_orderkey").alias("k"), n.alias("x"), (n * 3).alias("a1"), (n * 3 + 4).alias("a2"))
    b = t.lineitem.select(F.col("l_orderkey").alias("k"), n.alias("y"), (n * 5).alias("b1"), (n * 5 + 1).alias("b2"))
    return relational.overlaps(a, b, "k", ("a1", "a2"), ("b1", "b2")).select("k", "x", "y")


@query("SELECT l_suppkey, l_orderkey, l_linenumber, rank FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) AS rank FROM lineitem) WHERE rank <= 8")
def per_file_cap(t):
    top = ranking.top_per_group(t.lineitem.select("l_suppkey", "l_orderkey", "l_linenumber", "l_extendedprice"), ["l_suppkey"], [F.col("l_extendedprice").desc(), F.col("l_orderkey"), F.col("l_linenumber")], 8)
    return top.drop("l_extendedprice")


@query("SELECT l_suppkey, l_partkey, l_orderkey, l_linenumber, collapsed FROM (SELECT *, row_number() OVER w AS r, count(*) OVER (PARTITION BY l_suppkey, l_partkey) - 1 AS collapsed FROM lineitem WINDOW w AS (PARTITION BY l_suppkey, l_partkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber)) WHERE r = 1")
def keep_best_dedup(t):
    rows = t.lineitem.select("l_suppkey", "l_partkey", "l_orderkey", "l_linenumber", "l_extendedprice")
    return ranking.keep_best(rows, ["l_suppkey", "l_partkey"], [-F.col("l_extendedprice"), F.col("l_orderkey"), F.col("l_linenumber")]).drop("l_extendedprice")


@query("WITH a AS (SELECT o_custkey, o_orderkey, o_totalprice, o_totalprice >= max(o_totalprice) OVER (PARTITION BY o_custkey) * 0.85 AS tight, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders), b AS (SELECT *, sum(tight::INT) OVER (PARTITION BY o_custkey) AS n FROM a) SELECT o_custkey, o_orderkey, CASE WHEN tight AND n >= 3 THEN n ELSE 1 END::BIGINT AS members FROM b WHERE NOT (tight AND n >= 3) OR r = 1")
def dir_grouping(t):
    return ranking.collapse_groups(t.orders.select("o_custkey", "o_orderkey", "o_totalprice"), "o_custkey", "o_totalprice", "o_orderkey").drop("o_totalprice")


@query("SELECT c_acctbal AS threshold, n FROM (SELECT c_acctbal, row_number() OVER (ORDER BY c_acctbal DESC) - 1 AS r, count(*) OVER () AS n FROM customer WHERE c_acctbal > 0) WHERE r = greatest(floor(n * 0.1) - 1, 0)")
def top_decile(t):
    return ranking.top_decile(t.customer, "c_acctbal")


@query("""
WITH RECURSIVE r AS (SELECT lang, doc_id, ceil(n_chars / 3.5)::BIGINT + 30 AS cost, row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id) AS k FROM documents),
p AS (SELECT lang, 0::BIGINT AS k, 4000::BIGINT AS rest, NULL::BIGINT AS doc_id, NULL::BIGINT AS cost FROM r GROUP BY lang
 UNION ALL SELECT p.lang, p.k + 1, CASE WHEN r.cost <= p.rest THEN p.rest - r.cost ELSE p.rest END, CASE WHEN r.cost <= p.rest THEN r.doc_id END, CASE WHEN r.cost <= p.rest THEN r.cost END FROM p JOIN r ON r.lang = p.lang AND r.k = p.k + 1)
SELECT lang, doc_id, cost, min(rest) OVER (PARTITION BY lang) AS left_over FROM p QUALIFY doc_id IS NOT NULL
""")
def budget_skip(t):
    rows = t.documents.withColumn("cost", F.ceil(F.col("n_chars") / 3.5) + 30)
    return ranking.pack_skip(rows, ["lang"], [-F.col("n_chars"), F.col("doc_id")], "cost", "doc_id", 4000)


@query("SELECT lang, doc_id, used FROM (SELECT lang, doc_id, sum(ceil(n_chars / 3.5)) OVER (PARTITION BY lang ORDER BY n_chars, doc_id ROWS UNBOUNDED PRECEDING)::BIGINT AS used FROM documents) WHERE used <= 4000")
def budget_stop(t):
    rows = t.documents.withColumn("cost", F.ceil(F.col("n_chars") / 3.5))
    return ranking.pack_stop(rows, ["lang"], [F.col("n_chars"), F.col("doc_id")], "cost", 4000).select("lang", "doc_id", "used")


@query("WITH a AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS i FROM events WHERE value IS NOT NULL), b AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value, i) - 1 AS r, count(*) OVER (PARTITION BY event_type) AS n FROM a WHERE i > 1) SELECT event_type, n, max(value) FILTER (WHERE r = least(floor(n * 0.5), n - 1)) AS p50, max(value) FILTER (WHERE r = least(floor(n * 0.95), n - 1)) AS p95 FROM b GROUP BY 1, 2")
def latency_pctl(t):
    return ranking.percentiles(t.events.where("value IS NOT NULL"), ["event_type"], "value", [F.col("ts"), F.col("event_id")], {"p50": 0.5, "p95": 0.95})


@query("SELECT conv_id, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM conversations) WHERE r <= 2")
def last_n_turns(t):
    return ranking.top_per_group(t.conversations.select("conv_id", "turn", "role"), ["conv_id"], [F.col("turn").desc()], 2).drop("rank")


_AGE = "date_diff('day', o_orderdate::DATE, (SELECT max(o_orderdate)::DATE FROM orders))"


@query(f"SELECT o_orderkey, round((1 + o_custkey % 3) / (1 + {_AGE} * 0.02)::DOUBLE, 6) AS decay, (1 + o_custkey % 3) / (1 + {_AGE} * 0.02)::DOUBLE < 0.05 AND o_orderstatus <> 'P' AS is_stale FROM orders")
def decay_stale(t):
    last = t.orders.agg(F.to_date(F.max("o_orderdate")).alias("last"))
    rows = t.orders.join(F.broadcast(last)).withColumn("age", F.datediff("last", F.to_date("o_orderdate"))).withColumn("access_count", F.col("o_custkey") % 3).withColumn("tier", F.when(F.col("o_orderstatus") == "P", "core").otherwise("recall"))
    out = memory.stale(rows, F.col("age"))
    return out.select("o_orderkey", F.round("decay", 6).alias("decay"), "is_stale")


@query(f"SELECT o_orderkey, round(o_totalprice * 0.95 / (1 + {_AGE} * 0.01)::DOUBLE, 4) AS final FROM orders ORDER BY o_totalprice * 0.95 / (1 + {_AGE} * 0.01)::DOUBLE DESC, o_orderkey LIMIT 30")
def recency_rank(t):
    last = t.orders.agg(F.to_date(F.max("o_orderdate")).alias("last"))
    rows = t.orders.join(F.broadcast(last)).withColumn("age", F.datediff("last", F.to_date("o_orderdate")))
    return memory.recency_rank(rows, "o_totalprice", F.lit(0.95), F.col("age"), "o_orderkey", 30).select("o_orderkey", F.round("final", 4).alias("final"))


@query("""WITH d AS (SELECT doc_id, list_sort(list_distinct(list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: x <> ''))) AS w FROM documents),
c AS (SELECT w, min(doc_id) AS class_id, count(*) AS n FROM d GROUP BY w), e AS (SELECT class_id, n, len(w) AS k, unnest(w) AS x FROM c),
p AS (SELECT a.class_id AS a, b.class_id AS b, any_value(b.n) AS n, count(*) AS c, any_value(a.k) + any_value(b.k) AS k FROM e a JOIN e b ON a.x = b.x AND a.class_id <> b.class_id GROUP BY 1, 2),
l AS (SELECT a AS class_id, sum(n) AS others FROM p WHERE c >= 0.7 * (k - c) - 1e-9 GROUP BY 1)
SELECT doc_id, class_id, (CASE WHEN len(w) = 0 THEN 0 ELSE n - 1 + coalesce(others, 0) END)::BIGINT AS links FROM d JOIN c USING (w) LEFT JOIN l USING (class_id)""")
def jaccard_docs(t):
    """Documents whose word sets have a similarity of 0.7 or more: a class of equal sets and the number of links of each document."""
    return relational.similar_sets(t.texts("documents").select("doc_id", tokens(F.col("text")).alias("w")), "doc_id", "w", 0.7)


@query("WITH f AS (SELECT DISTINCT l_suppkey AS k, l_partkey AS v FROM lineitem WHERE l_quantity > 45), e AS (SELECT DISTINCT l_suppkey AS k, l_partkey AS v FROM lineitem WHERE l_discount >= 0.05), s AS (SELECT coalesce(f.k, e.k) AS k, count(f.v) AS found, count(e.v) AS expected, count(*) FILTER (WHERE f.v IS NOT NULL AND e.v IS NOT NULL) AS hit FROM f FULL JOIN e ON f.k = e.k AND f.v = e.v GROUP BY 1), r AS (SELECT *, CASE WHEN found = 0 THEN CASE WHEN expected = 0 THEN 1.0 ELSE 0.0 END ELSE hit / found::DOUBLE END AS p, CASE WHEN expected = 0 THEN 1.0 ELSE hit / expected::DOUBLE END AS r FROM s) SELECT k, found, expected, hit, round(p, 6)::DOUBLE AS precision, round(r, 6)::DOUBLE AS recall, round(CASE WHEN p + r = 0 THEN 0 ELSE 2 * p * r / (p + r) END, 6)::DOUBLE AS f1 FROM r")
def set_f1(t):
    f = t.lineitem.where("l_quantity > 45").select(F.col("l_suppkey").alias("k"), F.col("l_partkey").alias("v"))
    e = t.lineitem.where("l_discount >= 0.05").select(F.col("l_suppkey").alias("k"), F.col("l_partkey").alias("v"))
    return stats.set_scores(f, e, "k", "v").withColumns({c: F.round(c, 6) for c in ("precision", "recall", "f1")})


@query("WITH r AS (SELECT o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank, o_orderstatus = 'P' AS good FROM orders), f AS (SELECT o_custkey, min(rank) FILTER (WHERE good) AS first FROM r GROUP BY 1) SELECT count(*) AS questions, round(avg((first IS NOT NULL)::INT), 6) AS hit_rate, round(avg(coalesce(1.0::DOUBLE / first, 0)), 6) AS mrr FROM f")
def mrr_eval(t):
    r = ranking.top_per_group(t.orders.select("o_custkey", "o_orderkey", "o_totalprice", "o_orderstatus"), ["o_custkey"], [F.col("o_totalprice").desc(), F.col("o_orderkey")], 1 << 30)
    return stats.mean_reciprocal_rank(r, "o_custkey", "rank", F.col("o_orderstatus") == "P").withColumns({c: F.round(c, 6) for c in ("hit_rate", "mrr")})


@query("WITH i AS (SELECT DISTINCT l_orderkey FROM lineitem), g AS (SELECT o_orderpriority, count(*) AS n, array_to_string(list_sort(list(o_orderkey))[1:3], ',') AS sample FROM i JOIN orders ON l_orderkey = o_orderkey GROUP BY 1) SELECT o_orderpriority, n, sample FROM g WHERE n >= 3 AND (SELECT count(*) FROM i) > 80")
def partition_plan(t):
    items = t.lineitem.select("l_orderkey").distinct().join(t.orders, F.col("l_orderkey") == F.col("o_orderkey"))
    return stats.partition_plan(items, "o_orderpriority", "o_orderkey")


@query("SELECT p_partkey, count(*) AS versions, max(valid_until) AS last_change FROM (SELECT l_partkey AS p_partkey, l_shipdate, lead(l_shipdate) OVER (PARTITION BY l_partkey ORDER BY l_shipdate, l_orderkey * 10 + l_linenumber) AS valid_until FROM lineitem) GROUP BY 1")
def supersede(t):
    rows = t.lineitem.select(F.col("l_partkey").alias("p_partkey"), "l_shipdate", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("tie"))
    return memory.supersede(rows, ["p_partkey"], "l_shipdate", "tie").groupBy("p_partkey").agg(F.count("*").alias("versions"), F.max("valid_until").alias("last_change"))


@query("SELECT l_partkey, l_orderkey, l_linenumber FROM (SELECT *, lead(l_shipdate) OVER (PARTITION BY l_partkey ORDER BY l_shipdate, l_orderkey * 10 + l_linenumber) AS gone FROM lineitem) WHERE l_shipdate <= TIMESTAMP '1996-06-30 00:00:00' AND (gone IS NULL OR gone > TIMESTAMP '1996-06-30 00:00:00')")
def asof_memory(t):
    rows = t.lineitem.select("l_partkey", "l_orderkey", "l_linenumber", F.col("l_shipdate").alias("valid_from"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("tie"))
    history = memory.supersede(rows, ["l_partkey"], "valid_from", "tie").withColumnRenamed("valid_until", "invalidated_at")
    return memory.as_of(history, "1996-06-30 00:00:00").select("l_partkey", "l_orderkey", "l_linenumber")


@query("SELECT event_id, ts FROM events WHERE ts > TIMESTAMP '2024-01-15 00:00:00' - INTERVAL 24 HOURS ORDER BY ts DESC, event_id DESC LIMIT 10000")
def ttl_purge(t):
    return memory.purge(t.events, "ts", "2024-01-15 00:00:00", tie="event_id").select("event_id", "ts")


@query("WITH n AS (SELECT user_id, event_type, event_id, value FROM events WHERE event_id % 2 = 0), o AS (SELECT user_id, event_type, max_by(event_id, event_id) AS event_id FROM events WHERE event_id % 2 = 1 GROUP BY 1, 2), m AS (SELECT user_id, event_type, max(event_id) AS event_id FROM n GROUP BY 1, 2) SELECT coalesce(m.user_id, o.user_id) AS user_id, coalesce(m.event_type, o.event_type) AS event_type, coalesce(m.event_id, o.event_id) AS event_id FROM o FULL JOIN m ON o.user_id = m.user_id AND o.event_type = m.event_type")
def upsert_latest(t):
    latest = lambda df: df.groupBy("user_id", "event_type").agg(F.max("event_id").alias("event_id"))
    return memory.upsert(latest(t.events.where("event_id % 2 = 1")), latest(t.events.where("event_id % 2 = 0")), ["user_id", "event_type"])


@query("SELECT user_id, max(event_id) AS seq, arg_max(event_type, event_id) AS op FROM events GROUP BY 1 HAVING arg_max(event_type, event_id) <> 'error'")
def journal_replay(t):
    log = t.events.select("user_id", F.col("event_id").alias("seq"), F.col("event_type").alias("op"))
    return memory.replay(log.withColumn("op", F.when(F.col("op") == "error", "forget").otherwise(F.col("op"))), "user_id")


@query("SELECT doc_id, substr(sha256(text), 1, 16) AS hash FROM documents")
def content_hashes(t):
    return t.texts("documents").select("doc_id", content_hash(F.col("text")).alias("hash"))


@query("""WITH p AS (SELECT page_id, regexp_extract(url, '^[a-z]+://([^?#]*)', 1) AS path FROM pages), d AS (SELECT *, string_split(path, '/') AS w FROM p)
SELECT page_id, CASE WHEN len(w) > 1 THEN array_to_string(w[1 : least(2, len(w) - 1)], '/') ELSE '.' END AS top, array_to_string(w[1 : len(w) - 1], '/') AS dir, w[len(w)] AS base, array_to_string(list_filter(regexp_split_to_array(lower(w[1]), '[^a-z0-9]+'), lambda x: x <> ''), ',') AS parts FROM d""")
def path_functions(t):
    rows = t.pages.select("page_id", F.regexp_extract("url", "^[a-z]+://([^?#]*)", 1).alias("path"))
    return rows.select("page_id", top_dirs(F.col("path")).alias("top"), dir_name(F.col("path")).alias("dir"), base_name(F.col("path")).alias("base"), F.array_join(identifier_parts(F.split("path", "/")[0]), ",").alias("parts"))


@query("""WITH p AS (SELECT page_id % 20 AS k, string_split(regexp_extract(url, '^[a-z]+://[^/?#]+/([^?#]*)', 1), '/') AS w FROM pages), d AS (SELECT k, w[1 : len(w) - 1] AS dirs FROM p), f AS (SELECT k, min(len(dirs)) AS n, min(dirs[1]) AS a, max(dirs[1]) AS b FROM d GROUP BY 1)
SELECT k, CASE WHEN n >= 1 AND a = b THEN a ELSE '' END AS prefix FROM f""")
def common_dirs(t):
    """Paths of pages have one directory or none: the one that all pages of a group share."""
    rows = t.pages.select((F.col("page_id") % 20).alias("k"), F.regexp_extract("url", "^[a-z]+://[^/?#]+/([^?#]*)", 1).alias("path"))
    return rows.groupBy("k").agg(F.collect_list("path").alias("paths")).select("k", common_prefix_dir(F.col("paths")).alias("prefix"))
