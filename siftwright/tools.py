"""The tools of the engine over one set of tables. Every tool returns a DataFrame and runs nothing itself,
except where a loop has to look at its own results (rank, clusters, hops, cycles)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwright.functions.text import tokens
from siftwright.operators import audit, code, graph, investigate, memory, relational, review, search, stats, vector
from siftwright.sources import files as trees
from siftwright.sources import parsers


@dataclass
class Index:
    """Tables of a source tree.

    files(path, language, mtime, size, hash, text) · chunks(path, type, name, start_line, end_line, content, id)
    · refs(path, line, name) · edges(src, dst) over paths · ranks(path, rank) · imports(path, source, names, is_relative) · vectors(id, vector), optional.
    """

    spark: SparkSession
    files: DataFrame
    chunks: DataFrame
    refs: DataFrame
    edges: DataFrame
    ranks: DataFrame
    vectors: DataFrame | None = None
    #: Where the index is kept; its searches then read kept postings.
    path: str | None = None
    imports: DataFrame | None = None

    @staticmethod
    def _parsed(files: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
        """Chunks, imports and references of files: each follows from its own text alone."""
        chunks = parsers.chunks(files).withColumn("id", F.xxhash64("path", "type", "name", "start_line"))
        refs = code.call_references(files.withColumn("id", F.col("path")), "id", F.col("text"), skip_definitions=True).withColumnRenamed("id", "path")
        return chunks, parsers.imports(files), refs

    @staticmethod
    def _linked(files: DataFrame, imports: DataFrame, iterations: int) -> tuple[DataFrame, DataFrame]:
        """Edges and ranks: these hang on which files there are."""
        spec = lambda rows: rows.select(F.col("path").alias("source"), F.col("source").alias("spec"))
        local = relational.resolve_imports(spec(imports.where("is_relative")), files)
        packages = relational.resolve_packages(spec(imports.where("NOT is_relative")), files)
        edges = local.unionByName(packages).select(F.col("source").alias("src"), F.col("target").alias("dst")).where("src <> dst").distinct()
        return edges, graph.pagerank(files.select(F.col("path").alias("id")), edges, iterations).withColumnRenamed("id", "path")

    @classmethod
    def build(cls, spark: SparkSession, root: str, ignore: list[str] | None = None, iterations: int = 20) -> Index:
        files = trees.scan(spark, root, ignore)
        chunks, imports, refs = cls._parsed(files)
        edges, ranks = cls._linked(files, imports, iterations)
        return cls(spark, files, chunks, refs, edges, ranks, imports=imports)

    def save(self, path: str) -> Index:
        """Keep all tables and the postings of the chunks at ``path``; returns the index that reads them."""
        root = path.rstrip("/")
        for name in ("files", "chunks", "refs", "imports", "edges", "ranks"):
            getattr(self, name).write.mode("overwrite").parquet(f"{root}/{name}")
        kept = Index.load(self.spark, path)
        search.SearchIndex(self.spark, f"{root}/postings").build(kept.chunks, "id", F.concat_ws(" ", "name", "content"))
        return kept

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Index:
        read = lambda name: spark.read.parquet(f"{path.rstrip('/')}/{name}")
        return cls(spark, read("files"), read("chunks"), read("refs"), read("edges"), read("ranks"), path=path, imports=read("imports"))

    def refresh(self, root: str, path: str, ignore: list[str] | None = None, iterations: int = 20) -> Index:
        """The index after the tree has changed, kept at another ``path``: only new and changed files are parsed.

        Rows of gone and changed files leave with all that hangs on them; edges and ranks are made anew.
        """
        now = trees.scan(self.spark, root, ignore)
        change = trees.snapshot_diff(self.files, now, version="hash")
        fresh = now.join(change.where("change IN ('added', 'changed')").select("path"), "path", "left_semi")
        stale = change.where("change IN ('removed', 'changed')").select("path")
        chunks, imports, refs = self._parsed(fresh)
        left = review.delete_files(stale, {"files": (self.files, "path"), "chunks": (self.chunks, "path"), "refs": (self.refs, "path"), "imports": (self.imports, "path")})
        files = left["files"].unionByName(fresh)
        imports = left["imports"].unionByName(imports)
        edges, ranks = self._linked(files, imports, iterations)
        return Index(self.spark, files, left["chunks"].unionByName(chunks), left["refs"].unionByName(refs), edges, ranks, self.vectors, imports=imports).save(path)

    def search(self, question: str, k: int = 50, budget: int = 4000, scope: Column | None = None, only: DataFrame | None = None) -> DataFrame:
        """Hits of all lanes, boosted and packed under a token budget; ``scope`` over their columns, ``only``(path) for a set of files."""
        lanes = self._lanes(question, k)
        rows = self.chunks.withColumnRenamed("id", "chunk_id").join(self.ranks, "path", "left").fillna(0.0, ["rank"])
        if only is not None:
            rows = rows.join(only.select("path").distinct(), "path", "left_semi")
        return search.hybrid(lanes, rows, "chunk_id", "content", scope, audit.boost(F.col("path"), F.col("rank")), budget)

    def _lanes(self, question: str, k: int) -> dict[str, DataFrame]:
        if self.path is not None:
            lanes = {"fts": search.SearchIndex(self.spark, f"{self.path.rstrip('/')}/postings").search(question, k)}
        else:
            # split as the texts are
            row = self.spark.createDataFrame([(question,)], "q string").select(tokens(F.col("q")).alias("w")).first()
            lanes = {"fts": search.bm25(self.chunks, "id", F.concat_ws(" ", "name", "content"), row.w, k)}
        if self.vectors is not None:
            q = audit.embed(self.spark.createDataFrame([(0, question)], "id long, t string"), "id", "t")
            lanes["vector"] = vector.top_k(self.vectors, q.select(F.col("vector").alias("q")), "id", "vector", "q", k).select("id", "score")
        return lanes

    def investigate(self, question: str, k: int = 50, mentions: DataFrame | None = None) -> DataFrame:
        """Hits of all lanes with the methods that found them, followed along callers, mentions and importers."""
        inner = self.refs.join(self.chunks.select("path", F.col("id"), "start_line", "end_line"), "path").where(F.col("line").between(F.col("start_line"), F.col("end_line")))
        refs = inner.join(self.ranks, "path", "left").select("name", "id", "rank").distinct()
        none = self.spark.createDataFrame([], "name string, id long, confidence double")
        found = investigate.investigate(self._lanes(question, k), self.chunks, refs, none if mentions is None else mentions, self.edges, self.ranks)
        return found.join(self.chunks.select("id", "path", "name", "start_line", "end_line"), "id").orderBy(F.col("score").desc(), "id")

    def diff_search(self, question: str, old: Index, k: int = 50, budget: int = 4000) -> DataFrame:
        """Search among the files that differ from an older index, and those that import them."""
        change = trees.snapshot_diff(old.files, self.files, version="hash").where("change IN ('added', 'changed')").select("path")
        importers = self.edges.join(change.withColumnRenamed("path", "dst"), "dst", "left_semi").select(F.col("src").alias("path"))
        return self.search(question, k, budget, only=change.union(importers))

    def ask(self, question: str, concepts: DataFrame | None = None, k: int = 5) -> DataFrame:
        """(kind, value, score): the concepts nearest to a question, then the places that an investigation finds.

        concepts(label, vector) in the space of ``audit.embed``.
        """
        places = self.investigate(question).limit(k).select(F.lit("place").alias("kind"), F.concat_ws(":", "path", F.col("start_line").cast("string")).alias("value"), "score")
        if concepts is None:
            return places
        q = audit.embed(self.spark.createDataFrame([(0, question)], "id long, t string"), "id", "t").select(F.col("vector").alias("q"))
        near = investigate.concepts(concepts, q, "label", "vector", "q", k, 0.2, 0.2)
        return near.select(F.lit("concept").alias("kind"), F.col("label").alias("value"), "score").unionByName(places)

    def review(self, old: Index) -> DataFrame:
        """A row for each file that differs from an older index: symbols, dangling references, importers, risk."""
        change = trees.snapshot_diff(old.files, self.files, version="hash").where("change <> 'same'")
        status = F.when(F.col("change") == "removed", "deleted").when(F.col("change") == "changed", "modified").otherwise("added")
        churn = self.files.select("path", F.size(F.split("text", "\n")).cast("double").alias("churn"))
        changes = change.join(churn, "path", "left").select("path", status.alias("status"), F.coalesce("churn", F.lit(0.0)).alias("churn"))
        symbols = self.changed(old.chunks).withColumn("change", F.expr("CASE change WHEN 'added' THEN 'removed' WHEN 'removed' THEN 'added' ELSE change END"))
        tests = self.tests().select("source")
        return review.review_diff(changes, symbols, self.refs, self.edges, self.security().select(F.col("id").alias("path"), "severity"), tests)

    def health(self) -> DataFrame:
        """One row: points for dead code, cycles, coupling and security, their mean and its letter."""
        symbols = self.chunks.where(F.col("type").isin("function", "class", "method") & audit.production(F.col("path")))
        dead = audit.dead_share(symbols, self.dead_code(), "name").select("dead_pct")
        cycles = self.cycles().agg(F.count_distinct("component").alias("cycles"))
        fan_in = self.edges.groupBy("dst").agg(F.count("*").alias("n")).agg(F.coalesce(F.max("n"), F.lit(0)).alias("max_fan_in"))
        security = self.security().agg(F.coalesce(stats.severity_score(F.col("severity")), F.lit(0)).alias("security"))
        return review.health(dead.join(cycles).join(fan_in).join(security))

    def file(self, path: str) -> DataFrame:
        return investigate.file_detail(path, self.chunks, self.edges)

    def clusters(self) -> DataFrame:
        """(path, cluster, size, hub): communities of files that import one another."""
        ids = self.files.select("path", F.xxhash64("path").alias("id"))
        src, dst = (ids.select(F.col("path").alias(c), F.col("id").alias(x)) for c, x in (("src", "s"), ("dst", "d")))
        edges = self.edges.join(src, "src").join(dst, "dst").select(F.col("s").alias("src"), F.col("d").alias("dst"), F.lit(1.0).alias("weight"))
        found = graph.clusters(ids.join(self.ranks, "path").select("id", "rank"), edges)
        hubs = ids.select(F.col("id").alias("hub"), F.col("path").alias("hub_path"))
        return found.join(ids, "id").join(hubs, "hub").select("path", "cluster", "size", F.col("hub_path").alias("hub"))

    def lookup(self, name: str, limit: int = 20) -> DataFrame:
        return relational.lookup(self.chunks.join(self.ranks, "path", "left"), "name", name, "rank", "id", limit)

    def references(self, symbol: str, exact: bool = True) -> DataFrame:
        return search.find_references(self.files, "path", F.col("text"), symbol, exact)

    def impact(self, symbol: str, limit: int = 50) -> DataFrame:
        n = self.chunks.where(F.col("name") == symbol).agg(F.count("*").alias("definitions"))
        calls = self.refs.where(F.col("name") == symbol).join(self.ranks, "path", "left")
        ranked = calls.orderBy(F.col("rank").desc(), "path", "line").limit(limit)
        return ranked.join(F.broadcast(n)).withColumn("kind", relational.definition_kind(F.col("definitions")))

    def dependencies(self, path: str, depth: int = 1, importers: bool = False) -> DataFrame:
        return graph.bfs(self.spark.createDataFrame([(path,)], "id string"), self.edges, depth, importers)

    def overview(self, budget: int = 4000) -> DataFrame:
        chunks = self.chunks.select(F.col("path").alias("file"), F.col("start_line").alias("line"), "name")
        return audit.overview(chunks, self.ranks.select(F.col("path").alias("file"), "rank"), budget=budget)

    def dead_code(self) -> DataFrame:
        symbols = self.chunks.where(F.col("type").isin("function", "class", "method"))
        return relational.orphans(symbols, self.refs, "name", "name", ~audit.production(F.col("path")) | F.col("path").rlike(audit.PATH_CLASSES["barrel"]))

    def god_nodes(self, limit: int = 10) -> DataFrame:
        return relational.god_nodes(self.refs, "name", "path", self.chunks.select("name").distinct(), limit)

    def security(self) -> DataFrame:
        return code.security_scan(self.files, "path", F.col("text"), path=F.col("path"))

    def cycles(self) -> DataFrame:
        ids = self.files.select("path", F.xxhash64("path").alias("id"))
        e = self.edges.join(ids.select(F.col("path").alias("src"), F.col("id").alias("s")), "src").join(ids.select(F.col("path").alias("dst"), F.col("id").alias("d")), "dst")
        return graph.scc(e.select(F.col("s").alias("src"), F.col("d").alias("dst"))).join(ids, "id").select("path", "component")

    def changed(self, other: DataFrame) -> DataFrame:
        """Added, removed and changed symbols against other chunks."""
        return relational.symbol_diff(self.chunks.dropDuplicates(["path", "name"]), other.dropDuplicates(["path", "name"]), ["path", "name"], "content")

    def tests(self) -> DataFrame:
        return relational.related_tests(self.files)

    def verify(self, evidence: DataFrame) -> DataFrame:
        return memory.verify_spans(evidence, self.files)

    def status(self, root: str) -> DataFrame:
        return trees.freshness(self.files, trees.listing(self.spark, root))
