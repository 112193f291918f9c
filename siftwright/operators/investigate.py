"""Questions that several lanes answer: lanes fused by rank, then followed along references, mentions and imports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwright.operators.graph import bfs
from siftwright.operators.ranking import rrf, top_decile, top_per_group
from siftwright.operators.vector import top_k

#: Kinds of chunks that define a name.
DEFINITIONS = ("function", "class", "method", "type", "interface")
#: How much an edge of each type is worth: who calls a name comes before what documents it.
EDGE_WEIGHTS = {"calls": 1.0, "documents": 0.8}


def typed_edges(seeds: DataFrame, chunks: DataFrame, refs: DataFrame, mentions: DataFrame, per: int = 5) -> DataFrame:
    """(id, score): chunks one typed edge away from the seeds, the seeds themselves left out.

    seeds(id, place), chunks(id, name), refs(name, id, rank), mentions(name, id, confidence). Of each seed's name the
    ``per`` callers of best rank and the ``per`` surest mentions count; a chunk found twice keeps its best edge.
    """
    named = seeds.join(chunks.select("id", "name").where("name IS NOT NULL"), "id").select(F.col("id").alias("seed"), "place", "name")
    calls = named.join(refs.select("name", F.col("id"), "rank").distinct(), "name")
    calls = top_per_group(calls, ["seed"], [F.col("rank").desc_nulls_last(), F.col("id")], per, "nth").withColumn("weight", F.lit(EDGE_WEIGHTS["calls"]))
    docs = named.join(mentions.groupBy("name", "id").agg(F.max("confidence").alias("confidence")), "name")
    docs = top_per_group(docs, ["seed"], [F.col("confidence").desc(), F.col("id")], per, "nth").withColumn("weight", F.lit(EDGE_WEIGHTS["documents"]))
    both = calls.select("id", "weight", "place", "nth").unionByName(docs.select("id", "weight", "place", "nth")).join(seeds.select("id"), "id", "left_anti")
    # one number in the order of weight, seed and place among its edges
    order = F.col("weight") * 1e9 - F.col("place") * 1e3 - F.col("nth")
    return both.groupBy("id").agg(F.max(order).alias("score"))


def upstream(seed_files: DataFrame, edges: DataFrame, ranks: DataFrame, chunks: DataFrame, depth: int = 2, parents: int = 10, per: int = 3) -> DataFrame:
    """(id, path, nth): chunks of much imported files that import the seeds' files, at most ``depth`` hops up.

    seed_files(path), edges(src, dst), ranks(path, rank), chunks(id, path, type, name, start_line). A parent's rank is in the top
    decile of positive ranks; the best ``parents`` give their module chunks, then their first ``per`` definitions.
    """
    found = bfs(seed_files.select(F.col("path").alias("id")), edges, depth, reverse=True).where("depth > 0")
    bound = top_decile(ranks, "rank").select("threshold").where("threshold IS NOT NULL")
    best = found.withColumnRenamed("id", "path").join(ranks, "path").join(F.broadcast(bound)).where(F.col("rank") >= F.col("threshold"))
    best = best.orderBy(F.col("rank").desc(), "depth", "path").limit(parents).select("path", "rank", "depth")
    own = chunks.join(F.broadcast(best), "path").where(F.col("name").isNotNull() & F.col("type").isin("module", *DEFINITIONS))
    module = (F.col("type") == "module").cast("int")
    first = top_per_group(own.withColumn("module", module), ["path", "module"], [F.col("start_line"), F.col("id")], 1 << 30).where((F.col("module") == 1) | (F.col("rank") <= per))
    order = [F.col("module").desc(), F.col("start_line"), F.col("id")]
    return top_per_group(first.drop("rank"), ["path"], order, 1 << 30, "nth").select("id", "path", "nth")


def investigate(lanes: dict[str, DataFrame], chunks: DataFrame, refs: DataFrame, mentions: DataFrame, edges: DataFrame, ranks: DataFrame, weights: dict[str, float] | None = None, seeds: int = 20) -> DataFrame:
    """(id, score, methods, n_methods): the lanes fused, and the best of that followed along typed edges and up the imports.

    Each lane is (id, score), cut to its top; chunks(id, path, type, name, start_line). The further lanes are
    "graph-expand" and "upstream". The seeds are a stated number, so what hangs on them is small.
    """
    base = rrf(lanes, "id", weights=weights)
    top = base.orderBy(F.col("score").desc(), "id").limit(seeds)
    numbered = top_per_group(top.withColumn("all", F.lit(0)), ["all"], [F.col("score").desc(), F.col("id")], seeds, "place").select("id", "place")
    files = numbered.join(chunks.select("id", "path"), "id").select("path").distinct()
    up = upstream(files, edges, ranks, chunks).join(ranks, "path").join(numbered.select("id"), "id", "left_anti")
    more = {"graph-expand": typed_edges(numbered, chunks, refs, mentions), "upstream": up.select("id", (F.col("rank") * 1e6 - F.col("nth")).alias("score"))}
    return rrf({**lanes, **more}, "id", weights=weights)


def concepts(vectors: DataFrame, query: DataFrame, id_col: str, vec_col: str, query_vec: str, k: int = 5, least_top: float = 0.15, least: float = -1.0) -> DataFrame:
    """The ``k`` concepts nearest to a question; none if even the first is below ``least_top``."""
    near = top_k(vectors, query, id_col, vec_col, query_vec, k, least, unit_length=False).select(id_col, "score")
    sure = near.agg(F.max("score").alias("top")).where(F.col("top") >= least_top)
    return near.join(F.broadcast(sure)).drop("top")


def pattern_edges(labels: DataFrame, chunks: DataFrame, files: DataFrame, pattern: str, limit: int = 50) -> DataFrame:
    """Where a pattern is used: labels(chunk, pattern, confidence) with chunks(chunk, file, name) and files(file, path), surest first."""
    return labels.where(F.col("pattern") == pattern).join(chunks, "chunk").join(files, "file").orderBy(F.col("confidence").desc(), "chunk").limit(limit)


def mentions_of(mentions: DataFrame, per: int = 10) -> DataFrame:
    """Mentions(symbol, path, breadcrumb, match_kind, edge_kind, line, confidence), one a place and kind of match, the first ``per`` of each symbol and edge kind."""
    once = mentions.groupBy("symbol", "path", F.coalesce("breadcrumb", F.lit("")).alias("breadcrumb"), "match_kind").agg(F.min_by(F.struct("edge_kind", "line", "confidence"), F.struct((-F.col("confidence")).alias("c"), "line", "edge_kind")).alias("m"))
    rows = once.select("symbol", "path", "breadcrumb", "match_kind", "m.*")
    return top_per_group(rows, ["symbol", "edge_kind"], [F.col("confidence").desc(), F.col("path"), F.col("breadcrumb"), F.col("match_kind")], per)


def file_detail(path: str, chunks: DataFrame, edges: DataFrame) -> DataFrame:
    """(kind, value, line): a file's chunks, what it imports and what imports it."""
    own = chunks.where(F.col("path") == path).select(F.lit("chunk").alias("kind"), F.col("name").alias("value"), F.col("start_line").cast("long").alias("line"))
    out = edges.where(F.col("src") == path).select(F.lit("imports").alias("kind"), F.col("dst").alias("value"), F.lit(None).cast("long").alias("line"))
    into = edges.where(F.col("dst") == path).select(F.lit("imported by").alias("kind"), F.col("src").alias("value"), F.lit(None).cast("long").alias("line"))
    return own.unionByName(out).unionByName(into)
