"""Bi-temporal memories: writing, recall, decay, conflicts, consolidation, evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftwright.functions.text import jaccard
from siftwright.operators.ranking import top_per_group
from siftwright.operators.vector import top_k_blocks


def default_kind(category: Column) -> Column:
    return F.when(category.isin("procedural", "howto"), "procedural").when(category.isin("decision", "convention", "preference"), "semantic").otherwise("episodic")


def active(memories: DataFrame) -> DataFrame:
    return memories.where("invalidated_at IS NULL")


def as_of(memories: DataFrame, at: str, valid_from: str = "valid_from", invalidated: str = "invalidated_at") -> DataFrame:
    """What was believed at a time: valid by then and not invalidated yet."""
    t = F.lit(at).cast("timestamp_ntz")
    return memories.where((F.col(valid_from) <= t) & (F.col(invalidated).isNull() | (F.col(invalidated) > t)))


def supersede(facts: DataFrame, key: list[str], at: str, tie: str) -> DataFrame:
    """History of each key: every row is valid until the next one of its key starts."""
    order = Window.partitionBy(*key).orderBy(at, tie)
    return facts.withColumn("valid_until", F.lead(at).over(order)).withColumn("version", F.row_number().over(order)).withColumn("current", F.col("valid_until").isNull())


def upsert(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """Merge without a table format: rows of ``new`` replace those of ``old`` with their key."""
    return old.join(new.select(*key).distinct(), key, "left_anti").select(old.columns).unionByName(new)


def insert_ignore(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """Rows of ``new`` whose key is taken are ignored."""
    return old.unionByName(new.dropDuplicates(key).join(old.select(*key), key, "left_anti").select(old.columns))


def decay(age_days: Column, accesses: Column) -> Column:
    return (1 + accesses) / (1 + age_days * 0.02)


def stale(memories: DataFrame, age_days: Column, accesses: str = "access_count", tier: str = "tier", pinned: Column | None = None, least: float = 0.05) -> DataFrame:
    """Marks rows whose decay score fell under ``least``; core and pinned ones never are."""
    keep = (F.col(tier) == "core") | (pinned if pinned is not None else F.lit(False))
    return memories.withColumn("decay", decay(age_days, F.col(accesses))).withColumn("is_stale", (F.col("decay") < least) & ~keep)


def recency_rank(hits: DataFrame, score: str, confidence: Column, age_days: Column, id_col: str, limit: int) -> DataFrame:
    ranked = hits.withColumn("final", F.col(score) * confidence / (1 + age_days * 0.01))
    return ranked.orderBy(F.col("final").desc(), id_col).limit(limit)


def missing_files(memories: DataFrame, files: DataFrame, id_col: str, related: str) -> DataFrame:
    """(id, missing): rows that relate to files which are gone."""
    each = memories.select(id_col, F.explode(related).alias("path"))
    return each.join(files.select("path"), "path", "left_anti").groupBy(id_col).agg(F.count("*").alias("missing"))


def similar(memories: DataFrame, new: DataFrame, id_col: str, vec: str, least: float = 0.85, top: int = 50) -> DataFrame:
    """(new_id, id, score): the ``top`` stored rows close to each new one but itself, however many are new; ids are longs."""
    q = new.select(F.col(id_col).alias("new_id"), F.col(vec).alias("__v"))
    # one more than asked: a row's own may be among them
    best = top_k_blocks(memories, q, id_col, vec, "new_id", "__v", top + 1, least).where(F.col(id_col) != F.col("new_id")).drop("rank")
    return top_per_group(best, ["new_id"], [F.col("score").desc(), F.col(id_col)], top).select("new_id", id_col, "score")


def conflicts(close: DataFrame, shares_file: Column, least: float = 0.92) -> DataFrame:
    """Of close pairs, those that contradict: nearly equal, or about the same file."""
    return close.where((F.col("score") >= least) | shares_file)


def consolidate(memories: DataFrame, pairs: DataFrame, id_col: str, least: int = 3) -> DataFrame:
    """(seed, members): greedy groups of similar rows in the order of their ids.

    The first row that is in no group yet seeds one of all rows similar to it that are in none; a group under
    ``least`` leaves its seed alone and frees the others. A row's fate hangs on smaller rows only, so each round settles
    all rows whose smaller neighbours are settled, however many they are; there are as many rounds as the longest chain of similar rows in that order.
    """
    from siftwright.operators.graph import cut

    both = cut(pairs.select("a", "b").union(pairs.select("b", "a")).where("a <> b").distinct())
    state = cut(both.select(F.col("a").alias("id")).distinct().withColumn("fate", F.lit(None).cast("string")).withColumn("seed", F.lit(None).cast("long")))
    while not state.where("fate IS NULL").isEmpty():
        open_ = state.where("fate IS NULL").select("id")
        # next are rows all of whose neighbours, and neighbours' neighbours, that are open are larger
        inner = both.join(open_.withColumnRenamed("id", "a"), "a", "left_semi").join(open_.withColumnRenamed("id", "b"), "b", "left_semi")
        near = open_.join(inner.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("m")), "id", "left").select("id", F.least("id", "m").alias("m"))
        far = inner.join(near.select(F.col("id").alias("b"), "m"), "b").groupBy(F.col("a").alias("id")).agg(F.min("m").alias("m2"))
        ready = near.join(far, "id", "left").where((F.col("id") == F.col("m")) & (F.coalesce("m2", "id") >= F.col("id"))).select("id")
        group = inner.join(ready.withColumnRenamed("id", "a"), "a", "left_semi")
        size = ready.join(group.groupBy(F.col("a").alias("id")).agg((F.count("*") + 1).alias("n")), "id", "left").select("id", (F.coalesce("n", F.lit(1)) >= least).alias("seeds"))
        taken = group.join(size.where("seeds").select(F.col("id").alias("a")), "a", "left_semi").groupBy(F.col("b").alias("id")).agg(F.min("a").alias("s"))
        step = state.join(size, "id", "left").join(taken, "id", "left")
        fate = F.coalesce(F.col("fate"), F.when(F.col("seeds"), "seed").when(~F.col("seeds"), "alone").when(F.col("s").isNotNull(), "member"))
        state = cut(step.select("id", fate.alias("fate"), F.coalesce("seed", F.when(F.col("seeds"), F.col("id")), "s").alias("seed")))
    return state.where("seed IS NOT NULL").groupBy("seed").agg(F.count("*").alias("members"))


def default_tier(category: Column) -> Column:
    """Rules and preferences are always at hand."""
    return F.when(category.isin("procedural", "preference"), "core").otherwise("archive")


def default_confidence(category: Column) -> Column:
    return F.when(category == "procedural", 0.95).otherwise(1.0)


def remember(memories: DataFrame, new: DataFrame, at: str, sure: float = 0.92, close: float = 0.85, top: int = 50) -> DataFrame:
    """Memories after new ones were written: active ones that a new one contradicts are invalidated by it, none is deleted.

    Both have (id, category, content, vector, related array<string>), memories also (confidence, tier, kind,
    valid_from, invalidated_at, superseded_by). Of the ``top`` memories nearest to a new one (cosine ``close`` or more), those contradict it that
    are nearly equal (``sure``) or touch a file of it. ``new`` may have any size.
    """
    pairs = similar(active(memories), new, "id", "vector", close, top)
    files = pairs.join(memories.select("id", F.col("related").alias("old")), "id").join(new.select(F.col("id").alias("new_id"), F.col("related").alias("now")), "new_id")
    shares = F.coalesce(F.arrays_overlap("old", "now"), F.lit(False))
    by = conflicts(files, shares, sure).groupBy("id").agg(F.min("new_id").alias("by"))
    when = F.lit(at).cast("timestamp_ntz")
    old = memories.join(by, "id", "left").withColumn("invalidated_at", F.when(F.col("by").isNotNull(), when).otherwise(F.col("invalidated_at"))).withColumn("superseded_by", F.coalesce("superseded_by", "by")).select(memories.columns)
    category = F.col("category")
    rows = new.withColumns({"confidence": default_confidence(category), "tier": default_tier(category), "kind": default_kind(category), "valid_from": when, "invalidated_at": F.lit(None).cast("timestamp_ntz"), "superseded_by": F.lit(None).cast("long")})
    return old.unionByName(rows.select(memories.columns))


def pin(memories: DataFrame, asked: DataFrame) -> DataFrame:
    """Memories(id, pins) after asked(id, target, op) of op 'pin' or 'unpin'; a target is pinned once, unknown ids change nothing."""
    by = asked.groupBy("id").agg(F.array_sort(F.collect_set(F.when(F.col("op") == "pin", F.col("target")))).alias("more"), F.collect_set(F.when(F.col("op") == "unpin", F.col("target"))).alias("less"))
    had = F.coalesce("pins", F.array().cast("array<string>"))
    new = F.array_except(F.array_union(had, "more"), "less")
    return memories.join(by, "id", "left").withColumn("pins", F.when(F.col("more").isNotNull(), new).otherwise(F.col("pins"))).select(memories.columns)


def set_tier(memories: DataFrame, asked: DataFrame) -> DataFrame:
    """Memories after asked(id, tier): promoted to 'core' or demoted to 'archive'."""
    return memories.join(asked.groupBy("id").agg(F.max("tier").alias("asked")), "id", "left").withColumn("tier", F.coalesce("asked", "tier")).select(memories.columns)


def forget(memories: DataFrame, ids: DataFrame) -> DataFrame:
    return memories.join(ids.select("id"), "id", "left_anti")


def timeline(memories: DataFrame, created: str, tie: str = "id", limit: int = 500) -> DataFrame:
    """Newest first, invalidated ones too."""
    return memories.orderBy(F.col(created).desc(), F.col(tie).desc()).limit(limit)


def core(memories: DataFrame, created: str, category: str | None = None, kind: str | None = None, limit: int = 10) -> DataFrame:
    """The memories that every session starts from: active, of the core tier, newest first."""
    rows = active(memories).where("tier = 'core'")
    for column, value in (("category", category), ("kind", kind)):
        rows = rows if value is None else rows.where(F.col(column) == value)
    return rows.orderBy(F.col(created).desc(), F.col("id").desc()).limit(limit)


def wakeup(files: DataFrame, memories: DataFrame, created: str, top: int = 5) -> DataFrame:
    """(section, place, value): the best ranked files, then core memories or, without any, the newest ones."""
    best = files.orderBy(F.col("rank").desc(), "path").limit(top).where("rank > 0").select(F.lit("files").alias("section"), F.col("rank").alias("by"), F.col("path").alias("value"))
    own = core(memories, created)
    some = own.agg(F.count("*").alias("n")).where("n = 0").select("n")
    recent = timeline(active(memories), created, limit=top).join(F.broadcast(some)).drop("n")
    rows = best
    for section, part in (("core", own), ("recent", recent)):
        rows = rows.unionByName(part.select(F.lit(section).alias("section"), F.unix_timestamp(F.col(created).cast("timestamp")).cast("double").alias("by"), F.col("content").alias("value")))
    return top_per_group(rows, ["section"], [F.col("by").desc(), F.col("value")], 10, "place").select("section", "place", "value")


def handles(bodies: DataFrame, tool: str, body: str, at: str, ttl_minutes: int = 60, preview: int = 400) -> DataFrame:
    """Adds what refers to a stored answer: an id of its own, when it expires and a preview."""
    when = F.lit(at).cast("timestamp_ntz")
    shown = F.when(F.length(body) > preview, F.concat(F.substring(body, 1, preview), F.lit("\n…"))).otherwise(F.col(body))
    key = F.concat(F.lit("ctx_"), F.substring(F.sha2(F.concat_ws("\x1f", F.col(tool), F.col(body), when.cast("string")), 256), 1, 16))
    return bodies.withColumns({"handle": key, "created_at": when, "expires_at": when + F.expr(f"INTERVAL {ttl_minutes} MINUTES"), "preview": shown})


def handle_status(handles_: DataFrame, now: str, sha: Column) -> DataFrame:
    """Adds ``status``: expired, stale where the tree has moved on since, else fresh."""
    moved = (F.col("sha") != sha) & F.col("sha").isNotNull() & sha.isNotNull()
    status = F.when(F.col("expires_at") < F.lit(now).cast("timestamp_ntz"), "expired").when(moved, "stale").otherwise("fresh")
    return handles_.withColumn("status", status)


def last_calls(calls: DataFrame, group: list[str], order: list[Column], n: int = 8) -> DataFrame:
    """A ring of the last ``n`` calls of each session, newest first."""
    return top_per_group(calls, group, order, n, "place")


def replay(journal: DataFrame, id_col: str = "id", seq: str = "seq", op: str = "op") -> DataFrame:
    """State after an append-only log: the last operation of each id, without forgotten ones."""
    last = journal.groupBy(id_col).agg(F.max_by(F.struct(*[c for c in journal.columns if c != id_col]), F.col(seq)).alias("s"))
    return last.select(id_col, "s.*").where(F.col(op) != "forget")


def verify_spans(evidence: DataFrame, files: DataFrame, reach: int = 2, similar_from: float = 0.75) -> DataFrame:
    """(id, status, found_start): unchanged, moved, modified or deleted.

    evidence(id, path, start, end, span), lines counting from 1; files(path, text). The span is looked for at
    its lines, then by equality within ``reach`` span lengths, then by the best word similarity there.
    """
    n = F.col("end") - F.col("start") + 1
    rows = evidence.join(files.select("path", F.split("text", "\n").alias("lines")), "path", "left")
    at = F.sequence(F.greatest(F.lit(1), F.col("start") - reach * n), F.greatest(F.lit(1), F.least(F.size("lines") - n + 1, F.col("start") + reach * n)))
    piece = lambda i: F.array_join(F.slice("lines", i, n), "\n")
    words = lambda c: F.array_distinct(F.split(F.trim(F.lower(c)), "\\s+"))
    usable = F.col("lines").isNotNull() & (F.size("lines") >= n)
    tried = F.when(usable, F.transform(at, lambda i: F.struct((piece(i) == F.col("span")).cast("int").alias("same"), F.round(jaccard(words(piece(i)), words(F.col("span"))), 6).alias("sim"), (-F.abs(i - F.col("start"))).alias("near"), (-i).alias("neg"))))
    best = rows.select("id", "start", F.array_max(tried).alias("b"))
    status = F.when(F.col("b").isNull(), "deleted").when((F.col("b.same") == 1) & (F.col("b.near") == 0), "unchanged").when(F.col("b.same") == 1, "moved").when(F.col("b.sim") >= similar_from, F.when(F.col("b.near") == 0, "modified").otherwise("moved")).otherwise("deleted")
    return best.select("id", status.alias("status"), F.when(status != "deleted", -F.col("b.neg")).alias("found_start"))


def purge(evidence: DataFrame, created: str, now: str, ttl_hours: int = 24, cap: int = 10_000, tie: str = "id") -> DataFrame:
    """Rows younger than the time to live, the newest ``cap`` of them."""
    fresh = evidence.where(F.col(created) > F.lit(now).cast("timestamp_ntz") - F.expr(f"INTERVAL {ttl_hours} HOURS"))
    return fresh.orderBy(F.col(created).desc(), F.col(tie).desc()).limit(cap)
