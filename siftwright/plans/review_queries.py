"""Queries of investigations, reviews and memories. Documents stand for chunks, their sources for files, orders and vectors for memories."""

from __future__ import annotations

from pyspark.sql import functions as F

from siftwright.operators import audit, investigate, memory, review, stats
from siftwright.plans.registry import query
from siftwright.plans.search_queries import _FUSED, _bm25, _vec

_CHUNKS = "ch AS (SELECT doc_id AS id, source AS path, CASE WHEN doc_id % 7 = 0 THEN 'module' ELSE 'function' END AS type, 'n' || (doc_id % 50) AS name, doc_id AS start_line FROM documents)"
_EDGES = "ed AS (SELECT DISTINCT source AS src, 'src' || ((substr(source, 4)::INT * 2 + 1) % 20) AS dst FROM documents)"
_RANKS = "rk AS (SELECT source AS path, sum(n_chars) / 1000.0::DOUBLE AS rank FROM documents GROUP BY 1)"


def _chunks(t):
    kind = F.when(F.col("doc_id") % 7 == 0, "module").otherwise("function")
    name = F.concat(F.lit("n"), (F.col("doc_id") % 50).cast("string"))
    return t.documents.select(F.col("doc_id").alias("id"), F.col("source").alias("path"), kind.alias("type"), name.alias("name"), F.col("doc_id").alias("start_line"))


def _edges(t):
    n = F.substring("source", 4, 9).cast("int")
    return t.documents.select(F.col("source").alias("src"), F.concat(F.lit("src"), ((n * 2 + 1) % 20).cast("string")).alias("dst")).distinct()


def _ranks(t):
    return t.documents.groupBy(F.col("source").alias("path")).agg((F.sum("n_chars") / 1000.0).alias("rank"))


@query(f"""{_FUSED.replace('WITH', 'WITH RECURSIVE', 1)}, {_CHUNKS}, {_EDGES}, {_RANKS},
rf AS (SELECT 'n' || (doc_id * 3 % 50) AS name, doc_id AS id, n_chars::DOUBLE AS rank FROM documents), mn AS (SELECT 'n' || (page_id % 50) AS name, page_id AS id, 0.5 + (page_id % 3) * 0.25 AS confidence FROM pages),
s AS (SELECT id, row_number() OVER (ORDER BY score DESC, id) AS place FROM f QUALIFY row_number() OVER (ORDER BY score DESC, id) <= 20), nm AS (SELECT s.id AS seed, place, name FROM s JOIN ch USING (id)),
ca AS (SELECT rf.id, 1.0::DOUBLE AS weight, place, row_number() OVER (PARTITION BY seed ORDER BY rank DESC, rf.id) AS nth FROM nm JOIN rf USING (name) QUALIFY row_number() OVER (PARTITION BY seed ORDER BY rank DESC, rf.id) <= 5),
dm AS (SELECT mn.id, 0.8::DOUBLE AS weight, place, row_number() OVER (PARTITION BY seed ORDER BY confidence DESC, mn.id) AS nth FROM nm JOIN mn USING (name) QUALIFY row_number() OVER (PARTITION BY seed ORDER BY confidence DESC, mn.id) <= 5),
ge AS (SELECT id, max(weight * 1e9::DOUBLE - place * 1e3::DOUBLE - nth) AS score FROM (SELECT * FROM ca UNION ALL SELECT * FROM dm) WHERE id NOT IN (SELECT id FROM s) GROUP BY 1),
b AS (SELECT DISTINCT path AS id, 0 AS depth FROM s JOIN ch USING (id) UNION SELECT ed.src, depth + 1 FROM b JOIN ed ON b.id = ed.dst WHERE depth < 2), bd AS (SELECT id AS path, min(depth) AS depth FROM b GROUP BY 1),
th AS (SELECT rank AS threshold FROM (SELECT rank, row_number() OVER (ORDER BY rank DESC) - 1 AS r, count(*) OVER () AS n FROM rk WHERE rank > 0) WHERE r = greatest(floor(n * 0.1) - 1, 0)),
pa AS (SELECT path, rank FROM bd JOIN rk USING (path), th WHERE depth > 0 AND rank >= threshold ORDER BY rank DESC, depth, path LIMIT 10),
ow AS (SELECT ch.*, pa.rank, row_number() OVER (PARTITION BY path, type = 'module' ORDER BY start_line, id) AS k FROM ch JOIN pa USING (path)),
up AS (SELECT id, rank * 1e6::DOUBLE - row_number() OVER (PARTITION BY path ORDER BY type = 'module' DESC, start_line, id) AS score FROM ow WHERE type = 'module' OR k <= 3),
al AS (SELECT doc_id AS id, lane, r FROM l UNION ALL SELECT id, 'graph-expand', row_number() OVER (ORDER BY score DESC, id) FROM ge UNION ALL SELECT id, 'upstream', row_number() OVER (ORDER BY score DESC, id) FROM up WHERE id NOT IN (SELECT id FROM s))
SELECT id, round(sum(1.0::DOUBLE / (60 + r)), 6) AS score, string_agg(lane, ',' ORDER BY lane) AS methods, count(*) AS n_methods FROM al GROUP BY 1""")
def investigate_hits(t):
    """Lexical and vector lanes, followed along callers, mentions and importers."""
    name = lambda c: F.concat(F.lit("n"), (c % 50).cast("string")).alias("name")
    refs = t.documents.select(name(F.col("doc_id") * 3), F.col("doc_id").alias("id"), F.col("n_chars").cast("double").alias("rank"))
    mentions = t.pages.select(name(F.col("page_id")), F.col("page_id").alias("id"), (0.5 + (F.col("page_id") % 3) * 0.25).alias("confidence"))
    out = investigate.investigate({"fts": _bm25(t, 50), "vector": _vec(t, 50)}, _chunks(t), refs, mentions, _edges(t), _ranks(t))
    return out.withColumn("score", F.round("score", 6))


@query(f"""WITH RECURSIVE {_CHUNKS}, {_EDGES}, {_RANKS}, b AS (SELECT 'src3' AS id, 0 AS depth UNION SELECT ed.src, depth + 1 FROM b JOIN ed ON b.id = ed.dst WHERE depth < 2), bd AS (SELECT id AS path, min(depth) AS depth FROM b GROUP BY 1),
pa AS (SELECT path, rank, depth FROM bd JOIN rk USING (path) WHERE depth > 0 AND rank >= (SELECT max(rank) FILTER (WHERE r = greatest(floor(n * 0.1) - 1, 0)) FROM (SELECT rank, row_number() OVER (ORDER BY rank DESC) - 1 AS r, count(*) OVER () AS n FROM rk WHERE rank > 0))),
ow AS (SELECT ch.*, row_number() OVER (PARTITION BY path, type = 'module' ORDER BY start_line, id) AS k FROM ch JOIN pa USING (path))
SELECT id, path, row_number() OVER (PARTITION BY path ORDER BY type = 'module' DESC, start_line, id)::INT AS nth FROM ow WHERE type = 'module' OR k <= 3""")
def upstream_chunks(t):
    seeds = t.spark.createDataFrame([("src3",)], "path string")
    return investigate.upstream(seeds, _edges(t), _ranks(t), _chunks(t))


_COS = "list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 3))"


@query(f"WITH s AS (SELECT vec_id, {_COS} AS score FROM embeddings WHERE {_COS} >= -1 ORDER BY 2 DESC, 1 LIMIT 5) SELECT vec_id, round(score, 6) AS score FROM s WHERE (SELECT max(score) FROM s) >= 0.15")
def concept_search(t):
    q = t.embeddings.where("vec_id = 3").select(F.col("embedding").alias("q"))
    return investigate.concepts(t.embeddings, q, "vec_id", "embedding", "q").withColumn("score", F.round("score", 6))


@query("SELECT vec_id AS chunk, source AS file, n_chars AS size, round(greatest(0.0, least(1.0, embedding[1]::DOUBLE * 4)), 6) AS confidence FROM embeddings JOIN documents ON doc_id = vec_id WHERE label = 3 AND greatest(0.0, least(1.0, embedding[1]::DOUBLE * 4)) >= 0.1 ORDER BY greatest(0.0, least(1.0, embedding[1]::DOUBLE * 4)) DESC, vec_id LIMIT 50")
def pattern_places(t):
    labels = t.embeddings.select(F.col("vec_id").alias("chunk"), F.concat(F.lit("p"), F.col("label").cast("string")).alias("pattern"), (F.col("embedding")[0].cast("double") * 4).alias("confidence"))
    chunks = t.documents.select(F.col("doc_id").alias("chunk"), F.col("source").alias("file"))
    files = t.documents.select(F.col("source").alias("file")).distinct()
    sizes = t.documents.select(F.col("doc_id").alias("chunk"), F.col("n_chars").alias("size"))
    found = investigate.pattern_edges(audit.accept_labels(labels, ("p3",), 0.1), chunks, files, "p3")
    return found.join(sizes, "chunk").select("chunk", "file", "size", F.round("confidence", 6).alias("confidence"))


@query("""WITH m AS (SELECT role AS symbol, 'd' || (conv_id % 40) AS path, CASE WHEN turn % 3 > 0 THEN 'h' || (turn % 3) ELSE '' END AS breadcrumb, CASE WHEN conv_id % 2 = 0 THEN 'backtick' ELSE 'bare' END AS match_kind, CASE WHEN conv_id % 5 = 0 THEN 'includes' ELSE 'references' END AS edge_kind, turn AS line, CASE WHEN conv_id % 2 = 0 THEN 1.0 ELSE 0.5 END::DOUBLE AS confidence FROM conversations),
o AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY symbol, path, breadcrumb, match_kind ORDER BY confidence DESC, line, edge_kind) = 1)
SELECT symbol, path, breadcrumb, match_kind, edge_kind, line, confidence, row_number() OVER (PARTITION BY symbol, edge_kind ORDER BY confidence DESC, path, breadcrumb, match_kind)::INT AS rank FROM o QUALIFY row_number() OVER (PARTITION BY symbol, edge_kind ORDER BY confidence DESC, path, breadcrumb, match_kind) <= 10""")
def mention_list(t):
    conv, turn = F.col("conv_id"), F.col("turn")
    rows = t.conversations.select(
        F.col("role").alias("symbol"),
        F.concat(F.lit("d"), (conv % 40).cast("string")).alias("path"),
        F.when(turn % 3 > 0, F.concat(F.lit("h"), (turn % 3).cast("string"))).alias("breadcrumb"),
        F.when(conv % 2 == 0, "backtick").otherwise("bare").alias("match_kind"),
        F.when(conv % 5 == 0, "includes").otherwise("references").alias("edge_kind"),
        turn.alias("line"),
        F.when(conv % 2 == 0, 1.0).otherwise(0.5).alias("confidence"),
    )
    return investigate.mentions_of(rows)


@query(f"WITH {_CHUNKS}, {_EDGES} SELECT 'chunk' AS kind, name AS value, start_line::BIGINT AS line FROM ch WHERE path = 'src7' UNION ALL SELECT 'imports', dst, NULL FROM ed WHERE src = 'src7' UNION ALL SELECT 'imported by', src, NULL FROM ed WHERE dst = 'src7'")
def file_detail(t):
    return investigate.file_detail("src7", _chunks(t), _edges(t))


_LEVEL = "CASE o_orderpriority WHEN '1-URGENT' THEN 3 WHEN '2-HIGH' THEN 2 WHEN '3-MEDIUM' THEN 1 ELSE 0 END"


@query(f"SELECT o_custkey, CASE max({_LEVEL}) WHEN 3 THEN 'critical' WHEN 2 THEN 'high' WHEN 1 THEN 'medium' ELSE 'low' END AS worst FROM orders GROUP BY 1")
def max_level(t):
    p = F.col("o_orderpriority")
    level = F.when(p == "1-URGENT", "critical").when(p == "2-HIGH", "high").when(p == "3-MEDIUM", "medium").otherwise("low")
    return t.orders.groupBy("o_custkey").agg(review.max_level(level).alias("worst"))


@query("""WITH c AS (SELECT s_suppkey AS path, CASE s_suppkey % 3 WHEN 0 THEN 'added' WHEN 1 THEN 'modified' ELSE 'deleted' END AS status, abs(s_acctbal) AS churn FROM supplier),
y AS (SELECT DISTINCT l_suppkey AS path, l_partkey AS name, CASE WHEN l_quantity < 10 THEN 'removed' WHEN l_quantity > 45 THEN 'added' ELSE 'same' END AS change FROM lineitem),
g AS (SELECT DISTINCT path, name FROM y WHERE change = 'removed' AND name NOT IN (SELECT name FROM y WHERE change = 'added')), u AS (SELECT l_partkey AS name, count(*) AS uses FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1),
d AS (SELECT path, sum(uses)::BIGINT AS dangling FROM g JOIN u USING (name) GROUP BY 1), k AS (SELECT path, count(*) FILTER (WHERE change = 'added') AS added, count(*) FILTER (WHERE change = 'removed') AS removed FROM y GROUP BY 1),
e AS (SELECT DISTINCT l_suppkey AS src, (l_suppkey * 7 + l_linenumber) % (SELECT count(*) FROM supplier) AS dst FROM lineitem), i AS (SELECT dst AS path, count(*) AS importers FROM e GROUP BY 1), o AS (SELECT src AS path, count(*) AS imports FROM e GROUP BY 1),
f AS (SELECT l_suppkey AS path, bool_or(l_discount > 0.09) AS bad FROM lineitem WHERE l_tax > 0.07 GROUP BY 1),
r AS (SELECT c.*, coalesce(added, 0) AS added, coalesce(removed, 0) AS removed, coalesce(dangling, 0) AS dangling, coalesce(importers, 0) AS importers, coalesce(imports, 0) AS imports, coalesce(bad, false) AS bad FROM c LEFT JOIN k USING (path) LEFT JOIN d USING (path) LEFT JOIN i USING (path) LEFT JOIN o USING (path) LEFT JOIN f USING (path)),
x AS (SELECT *, round(least(1.0, CASE WHEN path % 2 = 0 THEN 0.3 ELSE 0 END + CASE WHEN bad THEN 0.2 ELSE 0 END + least(0.15, importers * 0.0075) + least(0.10, importers * 0.001) + least(0.20, dangling * 0.1) + least(0.05, ln(1 + churn) / 100))::DOUBLE, 6) AS risk FROM r)
SELECT path, status, added, removed, dangling, importers, imports, risk, CASE WHEN risk >= 0.7 THEN 'critical' WHEN risk >= 0.45 THEN 'high' WHEN risk >= 0.2 THEN 'medium' ELSE 'low' END AS level FROM x""")
def review_changes(t):
    """Suppliers stand for changed files, parts for their symbols, returned items for references."""
    key = F.col("s_suppkey")
    status = F.when(key % 3 == 0, "added").when(key % 3 == 1, "modified").otherwise("deleted")
    changes = t.supplier.select(key.alias("path"), status.alias("status"), F.abs("s_acctbal").alias("churn"))
    change = F.when(F.col("l_quantity") < 10, "removed").when(F.col("l_quantity") > 45, "added").otherwise("same")
    symbols = t.lineitem.select(F.col("l_suppkey").alias("path"), F.col("l_partkey").alias("name"), change.alias("change")).distinct()
    refs = t.lineitem.where("l_returnflag = 'R'").select(F.col("l_suppkey").alias("path"), F.col("l_partkey").alias("name"))
    n = t.supplier.agg(F.count("*").alias("n"))
    edges = t.lineitem.join(F.broadcast(n)).select(F.col("l_suppkey").alias("src"), ((F.col("l_suppkey") * 7 + F.col("l_linenumber")) % F.col("n")).alias("dst"))
    findings = t.lineitem.where("l_tax > 0.07").select(F.col("l_suppkey").alias("path"), F.when(F.col("l_discount") > 0.09, "high").otherwise("low").alias("severity"))
    tests = t.supplier.where("s_suppkey % 2 = 1").select(F.col("s_suppkey").alias("source"))
    return review.review_diff(changes, symbols, refs, edges, findings, tests)


@query("""WITH m AS (SELECT c_custkey, (c_custkey % 60)::DOUBLE AS dead_pct, c_custkey % 13 AS cycles, c_custkey % 70 AS max_fan_in, c_custkey % 41 AS security FROM customer),
p AS (SELECT *, CASE WHEN dead_pct <= 5 THEN 5 WHEN dead_pct <= 15 THEN 4 WHEN dead_pct <= 25 THEN 3 WHEN dead_pct <= 40 THEN 2 ELSE 1 END AS a, CASE WHEN cycles <= 0 THEN 5 WHEN cycles <= 2 THEN 4 WHEN cycles <= 5 THEN 3 WHEN cycles <= 10 THEN 2 ELSE 1 END AS b,
 CASE WHEN max_fan_in < 10 THEN 5 WHEN max_fan_in <= 20 THEN 4 WHEN max_fan_in <= 35 THEN 3 WHEN max_fan_in <= 50 THEN 2 ELSE 1 END AS c, CASE WHEN security <= 0 THEN 5 WHEN security <= 5 THEN 4 WHEN security <= 15 THEN 3 WHEN security <= 30 THEN 2 ELSE 1 END AS d FROM m)
SELECT c_custkey, (a + b + c + d) / 4.0::DOUBLE AS score, CASE WHEN (a + b + c + d) >= 18 THEN 'A' WHEN (a + b + c + d) >= 14 THEN 'B' WHEN (a + b + c + d) >= 10 THEN 'C' WHEN (a + b + c + d) >= 6 THEN 'D' ELSE 'F' END AS grade FROM p""")
def health_grades(t):
    key = F.col("c_custkey")
    rows = t.customer.select("c_custkey", (key % 60).cast("double").alias("dead_pct"), (key % 13).alias("cycles"), (key % 70).alias("max_fan_in"), (key % 41).alias("security"))
    return review.health(rows).select("c_custkey", "score", "grade")


@query("SELECT doc_id, ceil(n_chars / 3.5)::BIGINT > 500 AS needs_more, CASE WHEN ceil(n_chars / 3.5) > 500 THEN 'hidden_by_budget' WHEN doc_id % 9 = 0 THEN 'no_matches' WHEN lang = 'en' THEN 'none' ELSE 'ranking_uncertain' END AS gap, CASE WHEN ceil(n_chars / 3.5) > 500 THEN ceil(n_chars / 3.5)::BIGINT END AS suggested_budget FROM documents")
def enough(t):
    e = review.enoughness("search", F.col("doc_id") % 9, F.ceil(F.col("n_chars") / 3.5), F.lit(500), F.when(F.col("lang") == "en", "high").otherwise("low"))
    return t.documents.select("doc_id", e.alias("e")).select("doc_id", "e.*")


@query("SELECT 'chunks' AS of, count(*) AS n FROM documents WHERE source NOT IN ('src1', 'src2') UNION ALL SELECT 'vectors', count(*) FROM embeddings WHERE vec_id NOT IN (SELECT doc_id FROM documents WHERE source IN ('src1', 'src2'))")
def cascade_delete(t):
    """Deleted sources take their documents with them, and those their vectors."""
    gone = t.spark.createDataFrame([("src1",), ("src2",), ("nowhere",)], "path string")
    vectors = t.embeddings.join(t.documents.select("doc_id", "source"), F.col("vec_id") == F.col("doc_id"), "left")
    left = review.delete_files(gone, {"chunks": (t.documents, "source"), "vectors": (vectors, "source")})
    return left["chunks"].agg(F.lit("chunks").alias("of"), F.count("*").alias("n")).unionByName(left["vectors"].agg(F.lit("vectors").alias("of"), F.count("*").alias("n")))


@query("""WITH o AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v, label FROM embeddings), n AS (SELECT vec_id + 1000000 AS id, embedding::DOUBLE[] AS v, label FROM embeddings WHERE vec_id % 50 = 0),
p AS (SELECT n.id AS new_id, o.id, list_dot_product(n.v, o.v) AS score, n.label = o.label AS same FROM n JOIN o ON o.id % 11 <> 0 AND list_dot_product(n.v, o.v) >= 0.5 QUALIFY row_number() OVER (PARTITION BY n.id ORDER BY list_dot_product(n.v, o.v) DESC, o.id) <= 50),
b AS (SELECT id, min(new_id) AS nid FROM p WHERE score >= 0.92 OR same GROUP BY 1)
SELECT o.id, CASE WHEN o.id % 11 = 0 THEN NULL ELSE nid END AS superseded_by, (o.id % 11 = 0 OR nid IS NOT NULL) AS invalid FROM o LEFT JOIN b USING (id) UNION ALL SELECT id, NULL, false FROM n""")
def remember_new(t):
    """Every vector whose id is divisible by 50 comes in again as a new memory about its label."""
    label = F.array(F.concat(F.lit("f"), F.col("label").cast("string")))
    when = F.when(F.col("id") % 11 == 0, F.lit("2024-01-01").cast("timestamp_ntz"))
    rows = t.texts("embeddings").select(F.col("vec_id").alias("id"), F.lit("decision").alias("category"), F.lit("c").alias("content"), F.col("embedding").alias("vector"), label.alias("related"))
    old = rows.withColumns({"confidence": F.lit(1.0), "tier": F.lit("archive"), "kind": F.lit("semantic"), "valid_from": F.lit("2023-01-01").cast("timestamp_ntz"), "invalidated_at": when, "superseded_by": F.lit(None).cast("long")})
    new = rows.where("id % 50 = 0").withColumn("id", F.col("id") + 1_000_000)
    return memory.remember(old, new, "2024-06-01", close=0.5).select("id", "superseded_by", F.col("invalidated_at").isNotNull().alias("invalid"))


@query("""WITH a AS (SELECT user_id AS id, event_type AS target, CASE WHEN event_id % 3 = 0 THEN 'unpin' ELSE 'pin' END AS op FROM events), m AS (SELECT c_custkey AS id FROM customer),
s AS (SELECT id, list_filter(list_distinct(list_concat(['view'], coalesce(list_sort(list_distinct(list(target) FILTER (WHERE op = 'pin'))), []))), lambda x: NOT list_contains(coalesce(list(target) FILTER (WHERE op = 'unpin'), []), x)) AS p FROM a GROUP BY id)
SELECT m.id, CASE WHEN s.id IS NULL THEN 'view' ELSE array_to_string(list_sort(p), ',') END AS pins FROM m LEFT JOIN s USING (id)""")
def pins(t):
    asked = t.events.select(F.col("user_id").alias("id"), F.col("event_type").alias("target"), F.when(F.col("event_id") % 3 == 0, "unpin").otherwise("pin").alias("op"))
    memories = t.customer.select(F.col("c_custkey").alias("id"), F.array(F.lit("view")).alias("pins"))
    return memory.pin(memories, asked).select("id", F.array_join(F.sort_array("pins"), ",").alias("pins"))


@query("""WITH w AS (SELECT o_orderkey AS id, CASE WHEN o_orderpriority = '5-LOW' AND o_orderkey % 2 = 0 THEN 'core' WHEN o_orderstatus = 'P' THEN 'core' ELSE 'archive' END AS tier, o_orderdate AS created FROM orders WHERE o_orderkey % 5 <> 0)
SELECT id, tier FROM (SELECT * FROM w WHERE tier = 'core' ORDER BY created DESC, id DESC LIMIT 10)""")
def core_memories(t):
    """Some memories are promoted, some forgotten; then what every session starts from."""
    rows = t.orders.select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderstatus") == "P", "core").otherwise("archive").alias("tier"), F.col("o_orderdate").alias("created"), F.lit(None).cast("timestamp_ntz").alias("invalidated_at"))
    promoted = memory.set_tier(rows, t.orders.where("o_orderpriority = '5-LOW' AND o_orderkey % 2 = 0").select(F.col("o_orderkey").alias("id"), F.lit("core").alias("tier")))
    left = memory.forget(promoted, t.orders.where("o_orderkey % 5 = 0").select(F.col("o_orderkey").alias("id")))
    return memory.core(left, "created").select("id", "tier")


@query("SELECT o_orderkey, o_orderdate FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 500")
def memory_timeline(t):
    return memory.timeline(t.orders, "o_orderdate", "o_orderkey").select("o_orderkey", "o_orderdate")


@query(f"""WITH {_RANKS}, c AS (SELECT o_orderkey AS id, o_orderdate AS created FROM orders WHERE o_orderstatus = 'P' ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 10), f AS (SELECT * FROM rk WHERE rank > 0 ORDER BY rank DESC, path LIMIT 5)
SELECT 'files' AS section, row_number() OVER (ORDER BY rank DESC, path)::INT AS place, path AS value FROM f UNION ALL SELECT 'core', row_number() OVER (ORDER BY created DESC, 'm' || id)::INT, 'm' || id FROM c""")
def wakeup_summary(t):
    rows = t.orders.select(F.col("o_orderkey").alias("id"), F.concat(F.lit("m"), F.col("o_orderkey").cast("string")).alias("content"), F.when(F.col("o_orderstatus") == "P", "core").otherwise("archive").alias("tier"), F.col("o_orderdate").alias("created"), F.lit(None).cast("timestamp_ntz").alias("invalidated_at"))
    return memory.wakeup(_ranks(t), rows, "created")


@query("SELECT doc_id, (CASE WHEN length(text) > 400 THEN 402 ELSE length(text) END)::INT AS shown, CASE WHEN doc_id % 4 = 0 THEN 'stale' ELSE 'fresh' END AS status FROM documents")
def handle_states(t):
    rows = t.documents.withColumn("tool", F.lit("search")).withColumn("sha", F.when(F.col("doc_id") % 4 == 0, "old").when(F.col("doc_id") % 4 == 1, "now"))
    made = memory.handles(rows, "tool", "text", "2024-01-01 00:00:00")
    return memory.handle_status(made, "2024-01-01 00:30:00", F.lit("now")).select("doc_id", F.length("preview").alias("shown"), "status")


@query("SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC)::INT AS place FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 8")
def last_calls(t):
    return memory.last_calls(t.events, ["user_id"], [F.col("ts").desc(), F.col("event_id").desc()]).select("user_id", "event_id", "place")


@query("""WITH q AS (SELECT doc_id, text FROM documents WHERE doc_id % 3 = 0) SELECT doc_id, NOT (regexp_matches(text, '(?i)(you won''t believe|must read|(^|[^A-Za-z0-9_])shocking($|[^A-Za-z0-9_]))') OR regexp_matches(text, '(?i)(^|[^A-Za-z0-9_])(giveaway|crypto|casino)($|[^A-Za-z0-9_])') OR regexp_matches(text, 'https?://') OR regexp_matches(text, '(?i)(^|[^A-Za-z0-9_])(best|fastest|only|guaranteed)($|[^A-Za-z0-9_])')) AS ready FROM q""")
def content_queue(t):
    drafts = t.documents.select(F.col("doc_id").alias("id"), "text")
    approved = t.documents.where("doc_id % 3 = 0").select(F.col("doc_id").alias("id"))
    return audit.content_queue(drafts, approved, "text").select(F.col("id").alias("doc_id"), "ready")


@query("SELECT event_type, array_to_string(list_sort(list(code || '=' || n)), ',') AS codes FROM (SELECT event_type, 'e' || (event_id % 4) AS code, count(*) AS n FROM events WHERE value < 10 GROUP BY 1, 2) GROUP BY 1")
def tool_codes(t):
    rows = t.events.withColumn("code", F.concat(F.lit("e"), (F.col("event_id") % 4).cast("string")))
    codes = stats.error_codes(rows, "event_type", F.col("value") < 10, "code")
    return codes.select("event_type", F.array_join(F.sort_array(F.transform(F.map_entries("codes"), lambda e: F.concat_ws("=", e["key"], e["value"]))), ",").alias("codes"))


@query("SELECT role, count(*) AS calls, sum(length(text))::BIGINT AS bytes, max(length(text))::INT AS largest, arg_max(conv_id, length(text) * 1000000 - conv_id) AS largest_in FROM conversations GROUP BY 1")
def tool_receipts(t):
    return stats.tool_receipt(t.conversations, "role", F.length("text"), "conv_id")


@query("SELECT o_orderkey, CASE WHEN b THEN '#' || r ELSE printf('%.3f', s) END AS shown FROM (SELECT o_orderkey, o_totalprice / 1e9 AS s, row_number() OVER (ORDER BY o_totalprice / 1e9 DESC, o_orderkey) AS r, max(o_totalprice / 1e9) OVER () - min(o_totalprice / 1e9) OVER () < 0.05 AND count(*) OVER () > 5 AS b FROM orders)")
def shown_ranks(t):
    return audit.relative_rank(t.orders.select("o_orderkey", (F.col("o_totalprice") / 1e9).alias("s")), "s", "o_orderkey").select("o_orderkey", "shown")
