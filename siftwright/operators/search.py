"""Lexical, hybrid and multi-lane search."""

from __future__ import annotations

import zlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwright.functions.stem import fold, stem, stems
from siftwright.functions.text import token_estimate, tokens
from siftwright.operators.ranking import pack_skip, rrf

K1, B = 1.2, 0.75


def postings(docs: DataFrame, id_col: str, text: Column) -> DataFrame:
    """(id, term, tf, doc_len): the inverted index, grouped within each document before any shuffle."""
    words = docs.select(F.col(id_col).alias("id"), tokens(text).alias("words")).withColumn("doc_len", F.size("words"))
    return words.select("id", "doc_len", F.explode("words").alias("term")).groupBy("id", "doc_len", "term").agg(F.count("*").alias("tf"))


def bm25(docs: DataFrame, id_col: str, text: Column, terms: list[str], k: int | None = 50) -> DataFrame:
    """(id, score): documents that hold any of the terms, by BM25 with idf floored at 1e-6.

    Only the asked terms are counted: a filter over an in-row word array gives each term's frequency, so no
    posting of another word is made or shuffled; the loops are compiled, no lambda is interpreted. The counts, a
    few numbers a document, are cut, so that each text is split once. Many questions share a ``SearchIndex``.
    """
    from siftwright.operators.graph import cut

    terms = sorted({t.lower() for t in terms if len(t) > 1})
    words = docs.select(F.col(id_col).alias("id"), tokens(text).alias("w"))
    counted = cut(words.select("id", F.size("w").alias("dl"), *((F.size("w") - F.size(F.array_remove("w", t))).alias(f"t{i}") for i, t in enumerate(terms))))
    sums = counted.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"), *(F.sum((F.col(f"t{i}") > 0).cast("long")).alias(f"n{i}") for i in range(len(terms))))
    joined = counted.join(F.broadcast(sums))
    score = F.lit(0.0)
    for i in range(len(terms)):
        df, tf = F.col(f"n{i}"), F.col(f"t{i}")
        idf = F.greatest(F.ln((F.col("n") - df + 0.5) / (df + 0.5)), F.lit(1e-6))
        score = score + F.when(tf > 0, idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))).otherwise(0.0)
    out = joined.select("id", score.alias("score")).where("score > 0")
    return out if k is None else out.orderBy(F.col("score").desc(), "id").limit(k)


#: Terms of a table of queries that are broadcast: words that none of them asks leave before they are counted.
TERMS = 200_000


def bm25_batch(docs: DataFrame, queries: DataFrame, id_col: str, text: Column, query_id: str, query: Column) -> DataFrame:
    """(query, id, score) for a table of queries through the inverted index: one plan for all of them."""
    from siftwright.operators.graph import cut

    asked = cut(queries.select(F.col(query_id).alias("q"), F.explode(F.array_distinct(F.filter(tokens(query), lambda w: F.length(w) > 1))).alias("term")))
    terms = asked.select("term").distinct()
    if terms.count() <= TERMS:
        words = docs.select(F.col(id_col).alias("id"), tokens(text).alias("words")).select("id", F.size("words").alias("doc_len"), F.explode("words").alias("term"))
        wanted = cut(words.join(F.broadcast(terms), "term", "left_semi").groupBy("id", "doc_len", "term").agg(F.count("*").alias("tf")))
    else:
        wanted = cut(postings(docs, id_col, text).join(terms, "term", "left_semi"))
    df = wanted.groupBy("term").agg(F.count("*").alias("df"))
    totals = docs.select(F.size(tokens(text)).alias("l")).agg(F.count("*").alias("n"), F.avg("l").alias("avgdl"))
    hits = asked.join(df, "term").join(wanted, "term").join(F.broadcast(totals))
    idf = F.greatest(F.ln((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(1e-6))
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("doc_len") / F.col("avgdl")))
    return hits.groupBy("q", "id").agg(F.sum(part).alias("score"))


#: Folders that postings are dealt into by a hash of their term; a question reads those of its terms only.
BUCKETS = 64


@dataclass
class SearchIndex:
    """Stemmed postings kept at a path: postings/bucket=*(term, id, tf, doc_len) and docs(id, doc_len), ids being longs.

    A build goes into a folder of its own; ``current`` names the one that counts, so readers never see half
    of one.
    """

    spark: SparkSession
    path: str

    def _fs(self, name: str):
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path.rstrip('/')}/{name}")
        return path, path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def version(self) -> int:
        """The build that counts; 0 if there is none."""
        path, fs = self._fs("current")
        if not fs.exists(path):
            return 0
        stream = fs.open(path)
        try:
            return int(stream.readLine())
        finally:
            stream.close()

    def _publish(self, postings_: DataFrame, docs: DataFrame) -> None:
        n = self.version() + 1
        root = f"{self.path.rstrip('/')}/v{n}"
        bucket = F.pmod(F.crc32("term"), F.lit(BUCKETS)).cast("int")
        # sorted within a bucket: a term's rows lie in few row groups
        postings_.select("term", "id", "tf", "doc_len", bucket.alias("bucket")).repartition("bucket").sortWithinPartitions("bucket", "term").write.mode("overwrite").partitionBy("bucket").parquet(f"{root}/postings")
        docs.write.mode("overwrite").parquet(f"{root}/docs")
        path, fs = self._fs("current")
        stream = fs.create(path, True)
        stream.writeBytes(f"{n}\n")
        stream.close()

    def _table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path.rstrip('/')}/v{self.version()}/{name}")

    @staticmethod
    def _of(docs: DataFrame, id_col: str, text: Column) -> tuple[DataFrame, DataFrame]:
        words = docs.select(F.col(id_col).cast("long").alias("id"), tokens(text).alias("w")).where("id IS NOT NULL")
        each = stems(words, "id", "w").withColumn("doc_len", F.size("stems"))
        return each.select("id", "doc_len", F.explode("stems").alias("term")).groupBy("id", "doc_len", "term").agg(F.count("*").alias("tf")), each.select("id", "doc_len")

    def build(self, docs: DataFrame, id_col: str, text: Column) -> SearchIndex:
        self._publish(*self._of(docs, id_col, text))
        return self

    def refresh(self, changed: DataFrame, gone: DataFrame, id_col: str, text: Column) -> SearchIndex:
        """Postings of changed and of gone(id) documents leave, those of the changed texts come."""
        old = gone.select(F.col("id").cast("long")).union(changed.select(F.col(id_col).cast("long"))).distinct()
        postings_, docs = self._of(changed, id_col, text)
        keep = lambda name: self._table(name).join(old, "id", "left_anti")
        self._publish(keep("postings").select("id", "doc_len", "term", "tf").unionByName(postings_), keep("docs").unionByName(docs))
        return self

    def search(self, question: str, k: int | None = 50) -> DataFrame:
        """(id, score) by BM25 over the stems of the question's words, read from their buckets alone."""
        import re

        words = {stem(fold(w)) for w in re.split(r"[\W_]+", question.lower()) if len(w) > 1}
        buckets = sorted({zlib.crc32(w.encode()) % BUCKETS for w in words})
        hits = self._table("postings").where(F.col("bucket").isin(*buckets) & F.col("term").isin(*words)) if words else self._table("postings").limit(0)
        df = hits.groupBy("term").agg(F.count("*").alias("df"))
        totals = self._table("docs").agg(F.count("*").alias("n"), F.avg("doc_len").alias("avgdl"))
        idf = F.greatest(F.ln((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(1e-6))
        part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("doc_len") / F.col("avgdl")))
        # the words of one question: a few rows
        out = hits.join(F.broadcast(df), "term").join(F.broadcast(totals)).groupBy("id").agg(F.sum(part).alias("score"))
        return out if k is None else out.orderBy(F.col("score").desc(), "id").limit(k)


def hybrid(lanes: dict[str, DataFrame], chunks: DataFrame, id_col: str, text_col: str, scope: Column | None = None, boost: Column | None = None, budget: int = 4000, overhead: int = 30, weights: dict[str, float] | None = None) -> DataFrame:
    """Fuse lanes, filter by scope, boost, sort and pack under a token budget (cost = tokens + overhead)."""
    fused = rrf(lanes, "id", weights=weights)
    rows = fused.join(chunks, F.col("id") == F.col(id_col))
    if scope is not None:
        rows = rows.where(scope)
    rows = rows.withColumn("score", F.col("score") * (boost if boost is not None else F.lit(1.0)))
    rows = rows.withColumn("cost", token_estimate(F.col(text_col)) + overhead).withColumn("q", F.lit(0))
    taken = pack_skip(rows, ["q"], [-F.col("score"), F.col("id")], "cost", "id", budget)
    return rows.drop("cost", "q").join(taken.drop("q"), "id")


def lane_stats(lanes: dict[str, DataFrame], pool: DataFrame, id_col: str) -> DataFrame:
    """One row: the size of the pool, of each lane, and how many are in all lanes."""
    marks = None
    for lane, df in lanes.items():
        part = df.select(F.col("id"), F.lit(lane).alias("lane"))
        marks = part if marks is None else marks.unionByName(part)
    each = marks.groupBy("id").agg(*(F.max((F.col("lane") == lane).cast("int")).alias(lane) for lane in lanes))
    joined = pool.select(F.col(id_col).alias("id")).distinct().join(each, "id", "left")
    every = sum((F.coalesce(F.col(lane), F.lit(0)) for lane in lanes), F.lit(0))
    return joined.agg(F.count("*").alias("pool"), *(F.coalesce(F.sum(lane), F.lit(0)).alias(f"n_{lane}") for lane in lanes), F.sum((every == len(lanes)).cast("long")).alias("n_all"))


def find_references(docs: DataFrame, id_col: str, text: Column, symbol: str, exact: bool = True, per_file: int = 8) -> DataFrame:
    """(id, line, content): lines with the symbol, the first ``per_file`` of each file."""
    import re

    pattern = f"(?<![A-Za-z0-9_]){re.escape(symbol)}(?![A-Za-z0-9_])"  # \\b also counts letters beyond ASCII
    match = (lambda c: c.rlike(pattern)) if exact else (lambda c: F.contains(F.lower(c), F.lit(symbol.lower())))
    lines = docs.where(match(text)).select(F.col(id_col).alias("id"), F.posexplode(F.split(text, "\n")).alias("pos", "content"))
    from siftwright.operators.ranking import top_per_group

    return top_per_group(lines.where(match(F.col("content"))), ["id"], [F.col("pos")], per_file).select("id", (F.col("pos") + 1).alias("line"), "content")
