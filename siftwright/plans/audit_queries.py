"""Queries of audits, reviews and rule engines."""

from __future__ import annotations

from pyspark.sql import functions as F

from siftwright.operators import audit, code, ranking, relational
from siftwright.plans.registry import query

_URL = "regexp_replace(url, '^[a-z]+://', '')"


@query(f"SELECT page_id, CASE WHEN regexp_matches({_URL}, '(^|/)(docs?)/|\\.(md|rst|txt)$') THEN 'docs' ELSE '' END AS classes, NOT regexp_matches({_URL}, '(^|/)(docs?)/|\\.(md|rst|txt)$') AS production FROM pages")
def path_classes(t):
    p = F.regexp_replace("url", "^[a-z]+://", "")
    return t.pages.select("page_id", audit.path_classes(p).alias("classes"), audit.production(p).alias("production"))


@query("SELECT p_partkey, round(CASE WHEN p_partkey % 4 = 0 THEN 1.05 ELSE 1 END * (1 + least(0.4, (p_partkey % 6) * 0.1)) * (1 + 0.3 * (p_size / 50.0)), 6)::DOUBLE AS boost FROM part")
def path_boosts(t):
    path = F.when(F.col("p_partkey") % 4 == 0, "src/main.py").otherwise("src/part.py")
    return t.part.select("p_partkey", F.round(audit.boost(path, F.col("p_size") / 50.0, None, F.col("p_partkey") % 6), 6).alias("boost"))


@query("WITH s AS (SELECT l_partkey, count(*) AS refs, count(DISTINCT l_suppkey) AS files FROM lineitem GROUP BY 1 HAVING count(*) >= 2 AND count(DISTINCT l_suppkey) >= 2) SELECT l_partkey, refs, files FROM s WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_size > 25) ORDER BY files DESC, refs DESC, l_partkey LIMIT 1")
def proof_candidate(t):
    defs = t.part.where("p_size > 25").select(F.col("p_partkey").alias("l_partkey"))
    return audit.proof_candidate(t.lineitem, defs, "l_partkey", "l_suppkey")


@query("SELECT count(*) AS symbols, count(*) FILTER (WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 49)) AS dead, round(100.0 * count(*) FILTER (WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 49)) / count(*), 2)::DOUBLE AS dead_pct FROM part")
def dead_share(t):
    used = t.lineitem.where("l_quantity > 49").select(F.col("l_partkey").alias("p_partkey"))
    return audit.dead_share(t.part, t.part.join(used, "p_partkey", "left_anti"), "p_partkey")


@query("WITH h AS (SELECT o_custkey, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS r, o_orderpriority FROM orders) SELECT o_orderpriority, count(*) AS n FROM h WHERE r <= 30 GROUP BY 1 HAVING count(*) >= 2 ORDER BY 2 DESC, 1 LIMIT 8")
def cooccurrence_hints(t):
    top = t.orders.orderBy(F.col("o_totalprice").desc(), "o_orderkey").limit(30).withColumn("rank", F.lit(1))
    return audit.hints(top, "o_orderpriority", "rank")


@query("SELECT 'new' AS kind, NULL AS value, count(*) AS n FROM events WHERE ts >= TIMESTAMP '2024-01-20' - INTERVAL 7 DAYS UNION ALL SELECT 'stale', NULL, count(*) FILTER (WHERE event_type = 'error') FROM events WHERE ts >= TIMESTAMP '2024-01-20' - INTERVAL 7 DAYS UNION ALL (SELECT 'file', 'u' || user_id, count(*) FROM events WHERE ts >= TIMESTAMP '2024-01-20' - INTERVAL 7 DAYS GROUP BY 2 ORDER BY 3 DESC, 2 LIMIT 5)")
def memory_digest(t):
    rows = t.events.withColumn("stale", F.col("event_type") == "error").withColumn("related", F.array(F.concat(F.lit("u"), F.col("user_id").cast("string"))))
    return audit.digest(rows, "ts", "stale", "related", "2024-01-20 00:00:00")


@query("SELECT a.vec_id AS hit, b.vec_id AS near, abs(a.vec_id - b.vec_id)::DOUBLE * 10 AS distance FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0 QUALIFY row_number() OVER (PARTITION BY a.vec_id ORDER BY abs(a.vec_id - b.vec_id), b.vec_id) <= 2")
def bundle_neighbours(t):
    chunks = t.embeddings.select(F.col("vec_id").alias("id"), F.col("label").alias("file"), (F.col("vec_id") * 10).alias("start"), (F.col("vec_id") * 10 + 9).alias("end"))
    return audit.neighbours(t.embeddings.where("vec_id % 50 = 0").select(F.col("vec_id").alias("id")), chunks)


@query("WITH f AS (SELECT vec_id AS id FROM embeddings WHERE vec_id < 3), s AS (SELECT id FROM f UNION SELECT vec_id FROM embeddings WHERE label IN (SELECT label FROM embeddings WHERE vec_id < 3)), m AS (SELECT vec_id AS id, row_number() OVER (ORDER BY vec_id) AS i FROM embeddings WHERE label IN (SELECT label FROM embeddings GROUP BY 1 ORDER BY label DESC LIMIT 2) AND vec_id NOT IN (SELECT id FROM s)) SELECT id FROM s UNION ALL SELECT id FROM m WHERE i + (SELECT count(*) FROM s) <= 180 AND i <= 180")
def candidate_pool(t):
    chunks = t.embeddings.select(F.col("vec_id").alias("id"), F.col("label").alias("file"))
    files = chunks.select("file").distinct().withColumn("rank", F.col("file").cast("double"))
    return audit.candidate_pool(chunks.where("id < 3"), chunks, files, 180, 2)


@query("SELECT doc_id, array_to_string(list_sort(list_filter([CASE WHEN regexp_matches(text, '(?i)(you won''t believe|must read|\\bshocking\\b)') THEN 'bait' END, CASE WHEN regexp_matches(text, '(?i)\\b(giveaway|crypto|casino)\\b') THEN 'blocked_topic' END, CASE WHEN regexp_matches(text, 'https?://') THEN 'link' END, CASE WHEN regexp_matches(text, '(?i)\\b(best|fastest|only|guaranteed)\\b') THEN 'unsupported_claim' END], lambda x: x IS NOT NULL)), ',') AS failed FROM documents")
def content_gates(t):
    return audit.content_gates(t.texts("documents").select("doc_id", "text"), "text").select("doc_id", "failed")


@query("""WITH r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events), s AS (SELECT user_id, count(*) FILTER (WHERE event_type = 'signup') AS diff, count(*) FILTER (WHERE event_type = 'click') AS trace, count(*) FILTER (WHERE event_type = 'purchase') AS mem FROM r WHERE k <= 10 GROUP BY 1)
SELECT user_id, CASE WHEN diff > 0 THEN 'reviewing' WHEN trace >= 2 THEN 'tracing' WHEN mem > 0 THEN 'remembering' ELSE 'exploring' END AS intent FROM s""")
def session_intent(t):
    tool = F.when(F.col("event_type") == "signup", "review_diff").when(F.col("event_type") == "click", "refs").when(F.col("event_type") == "purchase", "recall").otherwise("other")
    calls = t.events.withColumn("tool", tool).withColumn("at", F.struct("ts", "event_id"))
    return audit.session_intent(calls, "user_id", "at", "tool", "props")


@query("WITH c AS (SELECT l_suppkey, sum(l_discount) AS s FROM lineitem GROUP BY 1) SELECT s_suppkey, round(0.5 * coalesce(s, 0) + s_acctbal / 10000, 6) AS order_score FROM supplier LEFT JOIN c ON s_suppkey = l_suppkey")
def repo_map(t):
    chunks = t.lineitem.select(F.col("l_suppkey").alias("s_suppkey"), "l_discount")
    files = t.supplier.select("s_suppkey", (F.col("s_acctbal") / 10000).alias("rank"))
    return audit.repo_map(chunks, files, "s_suppkey", "l_discount", "rank").select("s_suppkey", F.round("order_score", 6).alias("order_score"))


@query("WITH c AS (SELECT page_id % 5 AS consumer, CASE WHEN page_id % 2 = 0 THEN 'T.f' || (page_id % 7) ELSE 'f' || (page_id % 7) END AS symbol FROM pages), k AS (SELECT p AS provider, 'T.f' || p AS symbol FROM range(7) r(p)), e AS (SELECT consumer, c.symbol, provider, 1.0 AS confidence FROM c JOIN k ON c.symbol = k.symbol UNION SELECT consumer, c.symbol, provider, 0.8 FROM c JOIN k ON 'T.' || c.symbol = k.symbol) SELECT DISTINCT consumer, symbol, provider, confidence::DOUBLE AS confidence FROM e WHERE consumer <> provider")
def contract_edges(t):
    last = (F.col("page_id") % 7).cast("string")
    uses = t.pages.select((F.col("page_id") % 5).alias("consumer"), F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("T.f"), last)).otherwise(F.concat(F.lit("f"), last)).alias("symbol"))
    contracts = t.spark.range(7).select(F.col("id").alias("provider"), F.concat(F.lit("T.f"), F.col("id").cast("string")).alias("symbol"))
    return audit.contract_edges(uses, contracts)


@query("SELECT vec_id AS chunk, 'p' || label AS pattern, greatest(0.0, least(1.0, embedding[1]::DOUBLE * 4)) AS confidence FROM embeddings WHERE label IN (1, 3, 5) AND greatest(0.0, least(1.0, embedding[1]::DOUBLE * 4)) >= 0.6")
def pattern_labels(t):
    rows = t.embeddings.select(F.col("vec_id").alias("chunk"), F.concat(F.lit("p"), F.col("label").cast("string")).alias("pattern"), (F.col("embedding")[0].cast("double") * 4).alias("confidence"))
    return audit.accept_labels(rows, ("p1", "p3", "p5"))


@query("WITH h AS (SELECT o_orderdate, o_totalprice FROM orders WHERE o_custkey = (SELECT min(o_custkey) FROM orders) ORDER BY o_orderdate DESC LIMIT 5) SELECT min_by(o_totalprice, o_orderdate) AS first, max_by(o_totalprice, o_orderdate) AS last, CASE WHEN max_by(o_totalprice, o_orderdate) > min_by(o_totalprice, o_orderdate) THEN 'up' WHEN max_by(o_totalprice, o_orderdate) < min_by(o_totalprice, o_orderdate) THEN 'down' ELSE 'flat' END AS trend FROM h")
def audit_trend(t):
    least = t.orders.agg(F.min("o_custkey").alias("k"))
    return audit.trend(t.orders.join(F.broadcast(least), F.col("o_custkey") == F.col("k")), "o_orderdate", "o_totalprice")


@query("""WITH b AS (SELECT source, regexp_extract_all(text, '(?m)^[ ]*[-*][ ]+(.+)$', 1) AS bullets, trim(regexp_split_to_array(trim(text), '\\n[ \\n]*\\n')[1]) AS first FROM documents),
c AS (SELECT source AS section, unnest(CASE WHEN len(bullets) >= 3 THEN bullets ELSE [first] END) AS content FROM b)
SELECT section, count(*) AS memories, sum(length(content))::BIGINT AS chars FROM c WHERE length(content) BETWEEN 20 AND 500 GROUP BY 1""")
def short_notes(t):
    """Each document as a section of notes under the name of its source."""
    notes = t.documents.select(F.concat(F.lit("## "), F.col("source"), F.lit("\n"), F.col("text")).alias("text"))
    return audit.markdown_memories(notes, "text").groupBy("section").agg(F.count("*").alias("memories"), F.sum(F.length("content")).alias("chars"))


@query("WITH o AS (SELECT l_suppkey AS k, l_partkey AS v FROM lineitem WHERE l_quantity < 10 GROUP BY 1, 2), n AS (SELECT l_suppkey AS k, l_partkey AS v FROM lineitem WHERE l_quantity < 20 AND l_discount > 0.02 GROUP BY 1, 2) SELECT coalesce(o.k, n.k) AS k, count(*) FILTER (WHERE o.v IS NULL) AS added, count(*) FILTER (WHERE n.v IS NULL) AS removed, count(*) FILTER (WHERE o.v IS NOT NULL AND n.v IS NOT NULL) AS common FROM o FULL JOIN n ON o.k = n.k AND o.v = n.v GROUP BY 1")
def set_changes(t):
    pick = lambda c: t.lineitem.where(c).select(F.col("l_suppkey").alias("k"), F.col("l_partkey").alias("v")).distinct().withColumn("x", F.lit(1))
    d = relational.symbol_diff(pick("l_quantity < 10"), pick("l_quantity < 20 AND l_discount > 0.02"), ["k", "v"], "x")
    return d.groupBy("k").agg(*(F.sum((F.col("change") == c).cast("long")).alias(n) for c, n in (("added", "added"), ("removed", "removed"), ("same", "common"))))


@query("SELECT l_suppkey, l_partkey, l_orderkey * 10 + l_linenumber AS seen FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_suppkey, l_partkey ORDER BY l_orderkey * 10 + l_linenumber) = 1")
def first_seen(t):
    rows = t.lineitem.select("l_suppkey", "l_partkey", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seen"))
    return ranking.keep_best(rows, ["l_suppkey", "l_partkey"], [F.col("seen")]).drop("collapsed")


@query()
def fallback_vectors(t):
    """Deterministic vectors of all texts without a model: compared with a plain loop in the tests."""
    return audit.embed(t.texts("documents"), "doc_id", "text")


@query()
def doc_mentions(t):
    """Known words in prose: compared with a plain loop in the tests."""
    known = t.documents.select(F.explode(F.split("source", ",")).alias("symbol")).distinct().unionByName(t.spark.createDataFrame([("the",), ("that",)], "symbol string"))
    return code.doc_mentions(t.texts("documents"), "doc_id", F.col("text"), known)
