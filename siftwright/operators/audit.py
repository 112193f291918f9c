"""Audits, reviews, recall and rule engines composed from the other operators."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftwright.functions.text import base_name, dir_name, identifier_parts, token_estimate
from siftwright.operators.ranking import pack_stop, running, top_per_group

# ---- path classes, boosts, filters

PATH_CLASSES = {
    "vendored": r"(^|/)(node_modules|vendor|third_party|dist|build|target)/|\.min\.js\z",
    "test": r"(^|/)(tests?|__tests__|spec|fixtures)/|(^|/)test_[^/]+\z|[._-](test|spec)\.[a-z]+\z|_test\.(go|py|rs|rb)\z",
    "docs": r"(^|/)docs?/|\.(md|rst|txt)\z",
    "examples": r"(^|/)(examples?|demos?|samples?)/",
    "barrel": r"(^|/)(index\.[jt]sx?|__init__\.py|mod\.rs)\z",
    "cli": r"(^|/)(cli|bin|cmd|scripts)/|(^|/)(main|cli)\.[a-z]+\z",
    "config": r"\.(json|ya?ml|toml|ini|cfg)\z|(^|/)\.[^/]+rc\z",
}


def path_classes(path: Column) -> Column:
    """Sorted names of the classes that a path belongs to, comma-joined."""
    hits = F.filter(F.array(*(F.when(path.rlike(p), F.lit(c)) for c, p in sorted(PATH_CLASSES.items()))), lambda x: x.isNotNull())
    return F.array_join(hits, ",")


def production(path: Column) -> Column:
    return ~reduce(lambda a, b: a | b, (path.rlike(PATH_CLASSES[c]) for c in ("vendored", "test", "docs", "examples")))


def boost(path: Column, pagerank: Column | None = None, current: Column | None = None, shared_suffix: Column | None = None) -> Column:
    """Product of entry-point, suffix, distance and rank boosts of a path."""
    out = F.when(base_name(path).rlike(r"^(index|main|app|server|cli|mod|lib)\.[a-z]+\z"), 1.05).otherwise(1.0)
    if shared_suffix is not None:
        out = out * (1 + F.least(F.lit(0.4), shared_suffix * 0.1))
    if current is not None:
        a, b = F.split(dir_name(path), "/"), F.split(dir_name(current), "/")
        n = F.least(F.size(a), F.size(b))
        differ = F.filter(F.sequence(F.lit(1), n), lambda i: F.get(a, i - 1) != F.get(b, i - 1))
        same = F.coalesce(F.get(differ, F.lit(0)) - 1, n)
        out = out * F.greatest(F.lit(0.5), 1 - F.least(F.lit(20), F.size(a) + F.size(b) - 2 * same) * 0.025)
    return out if pagerank is None else out * (1 + 0.3 * pagerank)


def symbol_name_ok(name: Column, deny: tuple[str, ...] = ("main", "init", "test", "setup", "index", "default")) -> Column:
    """A name that says something: 4 to 80 characters, not denied, with an upper-case letter or an underscore."""
    return F.length(name).between(4, 80) & ~F.lower(name).isin(*deny) & name.rlike("[A-Z_]")


#: What tells a question about how things are put together, which no single definition answers.
WIRING = ("wire", "wiring", "register", "registration", "inject", "autowire", "bean", "annotat", "interceptor", "decorator", "middleware", "provider", "binding", "bound to", "@component", "@service", "@repository", "route", "hook", "plugin", "bootstrap", "lifecycle", "why", "decision", "architecture", "convention")


def wiring_query(query: Column, words: tuple[str, ...] = WIRING) -> Column:
    return F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(F.lower(query), w))


def relative_rank(files: DataFrame, rank: str, key: str) -> DataFrame:
    """Adds ``shown``: the rank, or the place in order where ranks hardly differ and there are more than five."""
    flat = files.agg(((F.max(rank) - F.min(rank) < 0.05) & (F.count("*") > 5)).alias("__flat"))
    placed = running(files, [], [F.col(rank).desc(), F.col(key)], F.lit(1), "__place").join(F.broadcast(flat))
    shown = F.when(F.col("__flat"), F.concat(F.lit("#"), F.col("__place").cast("string"))).otherwise(F.format_number(F.col(rank), 3))
    return placed.withColumn("shown", shown).drop("__flat", "__place")


def trend(history: DataFrame, at: str, score: str, last: int = 5) -> DataFrame:
    """One row: first and last score of the last audits and their direction."""
    recent = history.orderBy(F.col(at).desc()).limit(last)
    ends = recent.agg(F.min_by(score, at).alias("first"), F.max_by(score, at).alias("last"))
    return ends.withColumn("trend", F.when(F.col("last") > F.col("first"), "up").when(F.col("last") < F.col("first"), "down").otherwise("flat"))


def repo_map(chunks: DataFrame, files: DataFrame, file: str, score: str, rank: str) -> DataFrame:
    """Files by half their chunk scores plus their rank."""
    per = chunks.groupBy(file).agg(F.sum(score).alias("chunk_score"))
    out = files.join(per, file, "left").fillna(0.0, ["chunk_score"])
    return out.withColumn("order_score", 0.5 * F.col("chunk_score") + F.col(rank)).orderBy(F.col("order_score").desc(), file)


#: Words of a question that every row is held against.
MAX_WORDS = 10_000


def path_specificity(files: DataFrame, path: str, words: DataFrame, limit: int = 12) -> DataFrame:
    """Files by how a stem answers words(word, original): equal 110 or 40, prefix 100 or 20, contained 50 or 5.

    The words of one question, MAX_WORDS at most: more raise an error.
    """
    stem = F.lower(F.regexp_replace(base_name(F.col(path)), r"\.[A-Za-z0-9.]+\z", ""))
    asked = [(r.word, r.original) for r in words.select("word", "original").distinct().limit(MAX_WORDS + 1).collect()]
    if len(asked) > MAX_WORDS:
        raise ValueError(f"a question of more than {MAX_WORDS} words")
    table = files.sparkSession.createDataFrame(asked, "word string, original boolean")
    each = files.withColumn("stem", stem).join(F.broadcast(table), F.contains(F.col("stem"), F.col("word")))
    own = F.col("original")
    value = F.when(F.col("stem") == F.col("word"), F.when(own, 110).otherwise(40)).when(F.startswith("stem", "word"), F.when(own, 100).otherwise(20)).otherwise(F.when(own, 50).otherwise(5))
    return each.groupBy(path).agg(F.max(value).alias("specificity"), F.count("*").alias("words")).orderBy(F.col("specificity").desc(), F.col("words").desc(), path).limit(limit)


# ---- proof, hints, digest, dead code, critique


def proof_candidate(refs: DataFrame, definitions: DataFrame, name: str, file: str) -> DataFrame:
    """The most spread name with one definition and references in two files or more."""
    stats = refs.groupBy(name).agg(F.count("*").alias("refs"), F.count_distinct(file).alias("files")).where("refs >= 2 AND files >= 2")
    single = definitions.groupBy(name).agg(F.count("*").alias("defs")).where("defs = 1").select(name)
    return stats.join(single, name, "left_semi").orderBy(F.col("files").desc(), F.col("refs").desc(), name).limit(1)


def dead_share(symbols: DataFrame, dead: DataFrame, name: str) -> DataFrame:
    """One row: symbols, dead ones and their percentage."""
    mark = dead.select(name).distinct().withColumn("dead", F.lit(1))
    s = symbols.select(name).join(mark, name, "left").agg(F.count("*").alias("symbols"), F.count("dead").alias("dead"))
    return s.withColumn("dead_pct", F.round(100 * F.col("dead") / F.greatest("symbols", F.lit(1)), 2))


def hints(hits: DataFrame, key: str, rank: str, top: int = 30, least: int = 2, limit: int = 8) -> DataFrame:
    """Values that recur among the first hits."""
    return hits.where(F.col(rank) <= top).groupBy(key).agg(F.count("*").alias("n")).where(F.col("n") >= least).orderBy(F.col("n").desc(), key).limit(limit)


def digest(memories: DataFrame, created: str, is_stale: str, related: str, now: str, days: int = 7, top: int = 5) -> DataFrame:
    """(kind, value, n): new and stale memories of the last days and the files they touch most."""
    recent = memories.where(F.col(created) >= F.lit(now).cast("timestamp_ntz") - F.expr(f"INTERVAL {days} DAYS"))
    counts = recent.agg(F.count("*").alias("new"), F.sum(F.col(is_stale).cast("long")).alias("stale"))
    rows = counts.select(F.explode(F.array(F.struct(F.lit("new").alias("kind"), F.coalesce("new", F.lit(0)).alias("n")), F.struct(F.lit("stale").alias("kind"), F.coalesce("stale", F.lit(0)).alias("n")))).alias("r")).select("r.kind", F.lit(None).cast("string").alias("value"), "r.n")
    files = recent.select(F.explode(related).alias("value")).groupBy("value").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "value").limit(top)
    return rows.unionByName(files.select(F.lit("file").alias("kind"), "value", "n"))


def critique(answer_symbols: DataFrame, known: DataFrame, cited: DataFrame, hubs: DataFrame, spans: DataFrame) -> DataFrame:
    """One row: verdict of an answer with its broken spans, unknown symbols and missed hubs.

    answer_symbols(symbol), known(symbol), cited(path), hubs(path) in order of importance, spans(id, status).
    """
    unknown = answer_symbols.join(known, "symbol", "left_anti").agg(F.count("*").alias("unknown"))
    broken = spans.agg(F.sum(F.col("status").isin("deleted", "modified").cast("long")).alias("broken"), F.count("*").alias("spans"))
    met = hubs.join(cited, "path", "left_semi").agg(F.count("*").alias("met"))
    asked = answer_symbols.agg(F.count("*").alias("symbols"))
    row = unknown.join(broken).join(met).join(asked).withColumn("missed_hubs", (F.col("symbols") >= 3) & (F.col("met") == 0))
    broken_n = F.coalesce("broken", F.lit(0))
    verdict = F.when((broken_n > 0) & (broken_n * 2 >= F.col("spans")), "FAIL").when((broken_n > 0) | (F.col("unknown") > 0) | F.col("missed_hubs"), "WARN").otherwise("PASS")
    return row.select(broken_n.alias("broken"), "unknown", "missed_hubs", verdict.alias("verdict"))


def recall(lanes: DataFrame, memories: DataFrame, age_days: Column, limit: int, pinned: DataFrame | None = None, where: Column | None = None, include_stale: bool = True, workspace: DataFrame | None = None) -> DataFrame:
    """Fused memories by recency and confidence; pinned ones follow at 1.0, unfiltered and in their own order, then those of the workspace at 0.5.

    lanes(id, score) fused before; memories(id, confidence, invalidated_at, ...) with ``is_stale`` unless stale ones count;
    ``where`` filters by category or kind. Ids of the workspace are of their own and negated here.
    """
    live = lanes.join(memories.where("invalidated_at IS NULL"), "id")
    live = live if where is None else live.where(where)
    live = live if include_stale else live.where("NOT is_stale")
    out = live.withColumn("final", F.col("score") * F.col("confidence") / (1 + age_days * 0.01)).orderBy(F.col("final").desc(), "id").limit(limit).select("id", "final", F.lit(False).alias("pinned"))
    if pinned is not None:
        out = out.unionByName(pinned.select("id").join(out, "id", "left_anti").select("id", F.lit(1.0).alias("final"), F.lit(True).alias("pinned")))
    if workspace is not None:
        out = out.unionByName(workspace.select((-F.col("id")).alias("id"), F.lit(0.5).alias("final"), F.lit(False).alias("pinned")))
    return out


def neighbours(hits: DataFrame, chunks: DataFrame, k: int = 2) -> DataFrame:
    """For each hit its ``k`` nearest chunks of the same file by the distance of middle lines, ties to the smaller id. chunks(id, file, start, end).

    The chunks of a file have places by their middle, from either end; a hit meets those at the k places before and
    the k after the chunks at its own middle, not all of its file.
    """
    rows = chunks.select(F.col("id").alias("near"), "file", ((F.col("start") + F.col("end")) / 2).alias("o")).where("o IS NOT NULL AND file IS NOT NULL")
    own = hits.select(F.col("id").alias("near")).distinct().join(rows, "near").select(F.col("near").alias("hit"), "file", F.col("o").alias("m"))
    pairs = None
    # at the own middle or behind it: from the first chunk there; before it: from the place after the last one there
    for order, edge, first, last in ((F.col("o"), F.min, 0, k), (F.col("o").desc(), F.max, 1, k)):
        placed = running(rows, ["file"], [order, F.col("near")], F.lit(1), "place")
        mine = placed.join(own.select("file", F.col("m").alias("o")).distinct(), ["file", "o"], "left_semi").groupBy("file", F.col("o").alias("m")).agg(edge("place").alias("at"))
        asked = own.join(mine, ["file", "m"]).withColumn("place", F.explode(F.sequence(F.col("at") + first, F.col("at") + last)))
        part = asked.join(placed, ["file", "place"]).where("hit <> near").select("hit", "near", F.abs(F.col("m") - F.col("o")).alias("distance"))
        pairs = part if pairs is None else pairs.union(part)
    return top_per_group(pairs, ["hit"], [F.col("distance"), F.col("near")], k).select("hit", "near", "distance")


def candidate_pool(fts: DataFrame, chunks: DataFrame, files: DataFrame, cap: int = 500, top_files: int = 20) -> DataFrame:
    """(id): lexical hits, all their siblings, and chunks of the best-ranked files while there are under ``cap``."""
    own = fts.select("id").join(chunks.select("id", "file"), "id")
    siblings = chunks.join(own.select("file").distinct(), "file", "left_semi").select("id")
    best = files.orderBy(F.col("rank").desc(), "file").limit(top_files).select("file")
    base = fts.select("id").union(siblings).distinct()
    more = chunks.join(best, "file", "left_semi").join(base, "id", "left_anti").select("id").orderBy("id")
    n = base.agg(F.count("*").alias("n"))
    # the first ``cap`` rows are one task's work; each task hands on no more than that
    place = more.orderBy("id").limit(cap).withColumn("i", F.row_number().over(Window.orderBy("id")))
    return base.union(place.join(F.broadcast(n)).where(F.col("i") + F.col("n") <= cap).select("id"))


def evidence(hits: DataFrame, limit: int = 16) -> DataFrame:
    """Spans of the first hits with a hash and an id of their own. hits(rank, path, start, end, content)."""
    h = F.sha2("content", 256)
    rows = hits.orderBy("rank").limit(limit)
    return rows.select(F.substring(F.sha2(F.concat_ws(":", "path", "start", "end", h), 256), 1, 12).alias("id"), "path", "start", "end", h.alias("content_hash"))


# ---- reviews


def change_sizes(numstat: DataFrame, names: DataFrame, line: str) -> DataFrame:
    """(path, added, deleted, status): numstat lines joined with change_status rows."""
    cols = F.split(line, "\t")
    n = lambda i: F.get(cols, F.lit(i)).try_cast("int")
    sizes = numstat.select(F.get(cols, F.lit(2)).alias("path"), F.coalesce(n(0), F.lit(0)).alias("added"), F.coalesce(n(1), F.lit(0)).alias("deleted"))
    return sizes.join(names.select("path", "status"), "path", "left").fillna("modified", ["status"])


def _unguarded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for file, start, ops, lines in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            depth = tries = 0
            for k, (op, text) in enumerate(zip(ops, lines, strict=True)):
                if op == "-":
                    continue
                tries += text.count("try {") + text.count("try:")
                opened = text.count("(") - text.count(")")
                if op == "+" and depth > 0 and not tries and "(" in text and not text.lstrip().startswith((")", "//", "#")):
                    out.append((file, start + k, text.strip()[:200]))
                if ".pipe(" in text or ".map(" in text or ".on(" in text or depth:
                    depth = max(0, depth + opened)
        cols = zip(*out, strict=True) if out else ((), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int32(), pa.string()), strict=True)], names=["file", "line", "content"])


def unguarded_stream_calls(diff: DataFrame) -> DataFrame:
    """(file, line, content): calls added within an open stream pipeline and outside a try block.

    diff(file, new_start, op, content, line). A bracket depth runs over each hunk, so hunks are read whole.
    """
    hunks = diff.groupBy("file", "new_start").agg(F.sort_array(F.collect_list(F.struct("line", "op", "content"))).alias("r"))
    return hunks.select("file", F.col("new_start").cast("int"), F.col("r.op"), F.col("r.content")).mapInArrow(_unguarded, "file string, line int, content string")


def session_intent(calls: DataFrame, session: str, at: str, tool: str, args: str, last: int = 10) -> DataFrame:
    """(session, intent) from the last calls by ordered rules."""
    recent = top_per_group(calls, [session], [F.col(at).desc()], last)
    n = lambda cond: F.sum(cond.cast("long"))
    t = F.col(tool)
    s = recent.groupBy(session).agg(
        n(t.isin("review_diff", "diff_search")).alias("diff"), n(t.isin("refs", "impact", "deps")).alias("trace"), n(t.isin("remember", "recall")).alias("memory"),
        n(t == "overview").alias("overview"), n(t == "search").alias("search"), n((t == "search") & F.lower(F.col(args)).rlike("error|fail|bug|crash|exception")).alias("trouble"),
    )
    intent = F.when(F.col("diff") > 0, "reviewing").when(F.col("trace") >= 2, "tracing").when(F.col("memory") > 0, "remembering").when(F.col("overview") > 0, "onboarding").when((F.col("search") >= 2) & (F.col("trouble") > 0), "debugging").otherwise("exploring")
    return s.select(session, intent.alias("intent"))


# ---- rule engines

# \b also counts letters beyond ASCII
_A, _B = "(?<![A-Za-z0-9_])", "(?![A-Za-z0-9_])"
GATES = {"blocked_topic": f"(?i){_A}(giveaway|crypto|casino){_B}", "link": "https?://", "bait": f"(?i)(you won't believe|must read|{_A}shocking{_B})", "unsupported_claim": f"(?i){_A}(best|fastest|only|guaranteed){_B}"}


def content_gates(drafts: DataFrame, text: str, earlier: DataFrame | None = None) -> DataFrame:
    """Adds ``failed``: the gates that a draft fails, comma-joined; an angle (first eight words) may not repeat."""
    angle = lambda c: F.array_join(F.slice(F.split(F.lower(F.trim(c)), r"\s+"), 1, 8), " ")
    hits = [F.when(F.col(text).rlike(p), F.lit(g)) for g, p in sorted(GATES.items())]
    rows = drafts.withColumn("angle", angle(F.col(text)))
    if earlier is not None:
        seen = earlier.select(angle(F.col(text)).alias("angle")).distinct().withColumn("seen", F.lit(True))
        rows = rows.join(seen, "angle", "left")
        hits.append(F.when(F.col("seen"), F.lit("repeated_angle")))
    return rows.withColumn("failed", F.array_join(F.filter(F.array(*hits), lambda x: x.isNotNull()), ",")).drop("angle", "seen")


def content_queue(drafts: DataFrame, approved: DataFrame, text: str, earlier: DataFrame | None = None) -> DataFrame:
    """Drafts of approved briefs(id) with the gates that they fail; ``ready`` are those that fail none."""
    rows = content_gates(drafts.join(approved.select("id"), "id", "left_semi"), text, earlier)
    return rows.withColumn("ready", F.col("failed") == "")


def fallback_symbol(chunks: DataFrame) -> DataFrame:
    """One row: the first definition with a telling name in a production file, best ranked files first. chunks(path, name, type, start_line, rank)."""
    good = chunks.where(symbol_name_ok(F.col("name")) & production(F.col("path")) & F.col("type").isin("function", "class", "method", "interface", "type"))
    return good.orderBy(F.col("rank").desc(), "path", "start_line").limit(1)


def repositories(registry: DataFrame, now: str) -> DataFrame:
    """Registry(name, root, indexed_at) newest first, with days since and an age in words."""
    days = F.datediff(F.lit(now).cast("date"), F.to_date("indexed_at"))
    age = F.when(days <= 0, "today").when(days == 1, "yesterday").when(days < 30, F.concat(days.cast("string"), F.lit(" days ago"))).otherwise(F.concat(F.floor(days / 30).cast("string"), F.lit(" months ago")))
    return registry.withColumn("days", days).withColumn("age", age).orderBy(F.col("indexed_at").desc(), "name")


def scout(items: DataFrame, score: Column, blockers: dict[str, Column]) -> DataFrame:
    """Items with score, blockers and status, best first and numbered."""
    found = F.filter(F.array(*(F.when(c, F.lit(n)) for n, c in sorted(blockers.items()))), lambda x: x.isNotNull())
    rows = items.withColumn("score", score).withColumn("blockers", F.array_join(found, ","))
    status = F.when(F.size(F.split("blockers", ",")) >= 2, "rejected").when(F.col("blockers") != "", "needs_review").when(F.col("score") < 40, "rejected").otherwise("briefed")
    return running(rows.withColumn("status", status), [], [F.col("score").desc(), F.col("id")], F.lit(1), "place")


TRANSITIONS = (("opportunity", "new", "approve", "briefed"), ("opportunity", "new", "reject", "rejected"), ("brief", "briefed", "approve", "queued"), ("brief", "briefed", "reject", "rejected"), ("draft", "queued", "publish", "published"), ("draft", "queued", "reject", "rejected"))


def decide(items: DataFrame, decisions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Items(id, type, status) after decisions(id, decision), and the decisions that no transition allows."""
    table = items.sparkSession.createDataFrame(TRANSITIONS, "type string, status string, decision string, next string")
    asked = items.join(decisions, "id")
    ok = asked.join(F.broadcast(table), ["type", "status", "decision"])
    done = items.join(ok.select("id", "next"), "id", "left").select("id", "type", F.coalesce("next", "status").alias("status"))
    return done, asked.join(F.broadcast(table), ["type", "status", "decision"], "left_anti").select("id", "decision")


def profile_health(posts: DataFrame, group: str, text: str, age_days: str, topics: dict[str, tuple[str, ...]]) -> DataFrame:
    """(group, one score for each topic, health, priority): how well and how lately each topic is covered."""
    score = {t: F.least(F.lit(100.0), F.sum(F.when(reduce(lambda a, b: a | b, (F.contains(F.lower(F.col(text)), F.lit(w)) for w in words)), F.when(F.col(age_days) <= 7, 40.0).when(F.col(age_days) <= 30, 20.0).otherwise(5.0)).otherwise(0.0))) for t, words in topics.items()}
    s = posts.groupBy(group).agg(*(c.alias(t) for t, c in score.items()))
    mean = sum((F.col(t) for t in topics), F.lit(0.0)) / len(topics)
    return s.withColumn("health", mean).withColumn("priority", F.when(F.col("health") < 30, "urgent").when(F.col("health") < 60, "soon").otherwise("fine"))


# ---- contracts between repositories


def contract_edges(uses: DataFrame, contracts: DataFrame) -> DataFrame:
    """(consumer, symbol, provider, confidence): uses(consumer, symbol) of contracts(provider, symbol); 1.0 for the whole name, 0.8 for its last part."""
    exact = uses.join(contracts, "symbol").select("consumer", "symbol", "provider", F.lit(1.0).alias("confidence"))
    last = contracts.select("provider", F.substring_index("symbol", ".", -1).alias("symbol"))
    loose = uses.join(exact.select("consumer", "symbol"), ["consumer", "symbol"], "left_anti").join(last, "symbol").select("consumer", "symbol", "provider", F.lit(0.8).alias("confidence"))
    return exact.unionByName(loose).where("consumer <> provider").distinct()


def contract_impact(edges: DataFrame, symbol: str) -> DataFrame:
    """Consumers of a contract, by its name or else by the end of a qualified name."""
    hit = edges.withColumn("match", F.when(F.col("symbol") == symbol, 0).when(F.endswith("symbol", F.lit(f".{symbol}")), 1)).where("match IS NOT NULL")
    best = hit.agg(F.min("match").alias("best"))
    return hit.join(F.broadcast(best), F.col("match") == F.col("best")).select("consumer", "symbol", "provider", "confidence")


def stale_projects(projects: DataFrame, index: DataFrame) -> DataFrame:
    """Projects(project, sha) whose indexed sha differs or is missing, compared before anything is written."""
    return projects.join(index.select("project", "sha"), ["project", "sha"], "left_anti")


# ---- labelled layers and embeddings


def accept_labels(labels: DataFrame, taxonomy: tuple[str, ...], least: float = 0.6) -> DataFrame:
    """Labels(chunk, pattern, confidence) of a closed taxonomy, clamped to [0, 1] and sure enough; best of each pair."""
    c = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("confidence")))
    return labels.where(F.col("pattern").isin(*taxonomy)).withColumn("confidence", c).where(F.col("confidence") >= least).groupBy("chunk", "pattern").agg(F.max("confidence").alias("confidence"))


def unchanged(concepts: DataFrame, clusters: DataFrame) -> DataFrame:
    """Clusters(cluster, hash) that need a new label: their hash isn't that of their concept."""
    return clusters.join(concepts.select("cluster", "hash"), ["cluster", "hash"], "left_anti")


#: What JavaScript's \s matches.
_BLANKS = re.compile("[\t-\r \xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff]+")


def fallback_vector(text: str, dims: int = 384) -> np.ndarray:
    """A deterministic unit vector of all characters of all words, for when there is no model.

    Character c (UTF-16) of word w adds sin(0.01 c d + 0.1 w) / (1 + 0.1 w) to dimension d, counting from 1. That is the
    imaginary part of a factor of w times one of c and d, so weights are summed by character first.
    """
    words = [np.frombuffer(x.encode("utf-16-le", "surrogatepass"), np.uint16) for x in _BLANKS.split((text or "").lower())]
    w = np.repeat(np.arange(len(words)), list(map(len, words)))
    chars, at = np.unique(np.concatenate(words), return_inverse=True)
    share = 1 / (1 + 0.1 * w)
    re_, im = (np.bincount(at, f(0.1 * w) * share, len(chars)) for f in (np.cos, np.sin))
    angle = 0.01 * np.outer(chars.astype(np.float64), np.arange(1, dims + 1))
    v = re_ @ np.sin(angle) + im @ np.cos(angle)
    size = np.linalg.norm(v)
    return v / size if size else v


#: Makes, on a worker, what turns a list of texts into a list of vectors of one length: a model is loaded there once.
Provider = Callable[[], Callable[[list[str | None]], list[np.ndarray]]]


def fallback_provider(dims: int = 384) -> Provider:
    return lambda: lambda texts: [fallback_vector(t, dims) for t in texts]


def embed(df: DataFrame, id_col: str, text_col: str, dims: int = 384, provider: Provider | None = None, rows: int = 64) -> DataFrame:
    """(id, vector) of every text over Arrow batches, ``rows`` texts at a time, by a provider of vectors or, without one, by fallback_vector."""
    make = provider or fallback_provider(dims)

    def run(batches):
        vectors_of = make()
        for b in (whole.slice(i, rows) for whole in batches for i in range(0, whole.num_rows, rows)):
            vectors = [np.asarray(v, np.float32) for v in vectors_of(b.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(vectors, pa.list_(pa.float32()))], names=["id", "vector"])

    return df.select(F.col(id_col).cast("long").alias("id"), text_col).mapInArrow(run, "id long, vector array<float>")


def markdown_memories(docs: DataFrame, text: str) -> DataFrame:
    """(section, content): bullets of '##' sections with three or more, else their first paragraph; 20 to 500 characters."""
    parts = docs.select(F.explode(F.split(text, r"\n(?=## )")).alias("part")).where(F.startswith("part", F.lit("## ")))
    rows = parts.select(F.trim(F.regexp_extract("part", "^## ([^\n]*)", 1)).alias("section"), F.regexp_replace("part", "^## [^\n]*\n?", "").alias("body"))
    bullets = F.regexp_extract_all("body", F.lit(r"(?m)^\s*[-*]\s+(.+)$"), F.lit(1))
    first = F.array(F.trim(F.get(F.split(F.trim("body"), r"\n\s*\n"), F.lit(0))))
    rows = rows.select("section", F.explode(F.when(F.size(bullets) >= 3, bullets).otherwise(first)).alias("content"))
    return rows.where(F.length("content").between(20, 500))


def session_usage(messages: DataFrame) -> DataFrame:
    """(session, messages, tokens_in, tokens_out, tool_calls) of parsed session logs (session, tokens_in, tokens_out, content array<struct<type>>)."""
    tools = F.size(F.filter("content", lambda c: c["type"] == "tool_use"))
    return messages.groupBy("session").agg(F.count("*").alias("messages"), F.sum("tokens_in").alias("tokens_in"), F.sum("tokens_out").alias("tokens_out"), F.sum(F.coalesce(tools, F.lit(0))).alias("tool_calls"))


def overview(chunks: DataFrame, files: DataFrame, per_file: int = 40, budget: int = 4000) -> DataFrame:
    """Files in rank order with their first symbols while the token budget lasts. chunks(file, line, name), files(file, rank)."""
    first = top_per_group(chunks, ["file"], [F.col("line")], per_file).groupBy("file").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line", "name"))), lambda s: s["name"]), ",").alias("symbols"))
    rows = files.join(first, "file").withColumn("cost", token_estimate(F.col("symbols")) + 10)
    return pack_stop(rows, [], [F.col("rank").desc(), F.col("file")], "cost", budget)


SYNONYMS = {"auth": ("login", "session", "token"), "db": ("database", "sql", "store"), "cache": ("memo", "lru"), "test": ("spec",), "config": ("settings", "options"), "error": ("exception", "failure"), "delete": ("remove", "drop"), "fetch": ("get", "load", "read")}


def expand(query: Column) -> Column:
    """Parts of a query and their synonyms, distinct and in order."""
    table = F.create_map(*(x for k, v in SYNONYMS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))))
    parts = identifier_parts(query)
    return F.array_distinct(F.flatten(F.transform(parts, lambda w: F.concat(F.array(w), F.coalesce(F.element_at(table, w), F.array().cast("array<string>"))))))
