"""Shared plumbing: scratch tables, bounded broadcasts, word hashing and connected components."""

from __future__ import annotations

import re
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# freed buffers go back to the system at once; a pool would keep them in every idle worker
pa.set_memory_pool(pa.system_memory_pool())

#: At most this many 8-byte ids are ever broadcast; beyond it a shuffle join does the same work.
BROADCAST_IDS = 1_000_000
#: Bytes of text that a Python worker holds as hashes at one time (a longer text is a chunk of its own).
CHUNK_BYTES = 1 << 20

_own_dir: list[str] = []
_made: list[str] = []


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder named by spark.checkpoint.dir, which all executors share.

    Only in local mode, where driver and executors are one process, may that setting be absent: a temporary
    folder is used then. On a cluster each machine would write to a folder of its own.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        if not _own_dir:
            _own_dir.append(tempfile.mkdtemp(prefix="siftwright-"))
        base = _own_dir[0]
    path = f"{base.rstrip('/')}/siftwright/{name}-{uuid.uuid4().hex}"
    _made.append(path)
    return path


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to a scratch table and read it back: lineage ends here, and survives lost executors."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_scratch(spark: SparkSession) -> None:
    """Delete every scratch table of this process. Call it once the results are written."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    while _made:
        path = jvm.org.apache.hadoop.fs.Path(_made.pop())
        path.getFileSystem(conf).delete(path, True)


def semi_ids(df: DataFrame, id_col: str, ids: DataFrame, ids_col: str, how: str = "left_semi") -> DataFrame:
    """Semi (or anti) join on an id. ``ids`` is broadcast only if its counted size is within BROADCAST_IDS."""
    (name,) = free(df, "__id")
    right = ids.select(F.col(ids_col).alias(name))
    if right.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS:
        right = F.broadcast(right)
    return df.join(right, F.col(f"`{id_col}`") == F.col(name), how)


def free(df: DataFrame, *names: str) -> list[str]:
    """Names like those given that no column of ``df`` has."""
    taken = {c.lower() for c in df.columns}
    out = []
    for n in names:
        while n in taken:
            n += "_"
        out.append(n)
    return out


def text_chunks(ids: list, texts: list, limit: int = CHUNK_BYTES):
    """Split aligned lists into pieces of at most ``limit`` bytes of text, one row at least."""
    a = used = 0
    for i, t in enumerate(texts):
        size = len(t) if t else 0
        if used and used + size > limit:
            yield ids[a:i], texts[a:i]
            a, used = i, 0
        used += size
    if a < len(texts):
        yield ids[a:], texts[a:]


def id_text(batch: pa.RecordBatch) -> tuple[list, list]:
    """Columns 0 and 1 of a batch as Python lists; texts as UTF-8 bytes (None stays None)."""
    return batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()


def text_pieces(batch: pa.RecordBatch, rows: int = 256):
    """The same in pieces of at most ``rows`` rows and, beyond one row, CHUNK_BYTES of text: (ids, texts)."""
    for a in range(0, batch.num_rows, rows):
        yield from text_chunks(*id_text(batch.slice(a, rows)))


def str_pieces(batch: pa.RecordBatch, rows: int = 256):
    """Pieces like those of text_pieces, with texts as strings."""
    for a in range(0, batch.num_rows, rows):
        part = batch.slice(a, rows)
        yield from text_chunks(part.column(0).to_pylist(), part.column(1).to_pylist())


def lower_words(text: bytes | None) -> list[bytes]:
    r"""Words ``[^\x20\x09-\x0D]+`` of the text with A-Z lowered (bytes methods touch ASCII only)."""
    return text.lower().split() if text else []


def hash_words(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: An odd multiplier and its powers, for hashes of runs of words.
BASE = 0x9E3779B97F4A7C15


def run_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of each run of ``k`` consecutive word hashes."""
    n = len(h) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for j in range(k):
        out = out * np.uint64(BASE) + h[j : j + n]
    return mix64(out)


def shingle_set(words: list[bytes], k: int) -> np.ndarray:
    """Sorted distinct hashes of the k-word shingles; fewer words: the whole sequence as one; none: empty."""
    if not words:
        return np.empty(0, np.uint64)
    if len(words) < k:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), seed=len(words))], np.uint64)
    return np.unique(run_hashes(hash_words(words), k))


def _roots(a: np.ndarray, b: np.ndarray) -> tuple[list, list]:
    """Union-find over one batch of edges: (node, smallest node of its local component)."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        while (p := parent.setdefault(x, x)) != x:
            parent[x] = parent[p]
            x = parent[x]
        return x

    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        x, y = find(x), find(y)
        if x != y:
            parent[max(x, y)] = min(x, y)
    nodes = [x for x in parent if find(x) != x]
    return nodes, [find(x) for x in nodes]


def _local_forest(batches):
    for batch in batches:
        u, v = _roots(batch.column(0).to_numpy(), batch.column(1).to_numpy())
        yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])


def components(edges: DataFrame) -> DataFrame:
    """Connected components of undirected ``edges(a long, b long)``: (node, comp), comp the smallest node.

    Union-find shrinks each batch of edges to a forest; alternating large-star and small-star steps join the
    forests over all partitions. Each step is a min() with map-side combine and a join, so a hub with very many
    neighbours is never gathered in one task. Nodes without an edge aren't returned. Self-loops and repeats are
    harmless; edges with a null end are dropped.
    """
    e = edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b").select("a", "b")
    e = cut(e.mapInArrow(_local_forest, "u long, v long").distinct(), "cc")
    before = None
    while True:
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now[0] == 0 or now == before:
            return e.select(F.col("u").alias("node"), F.col("v").alias("comp"))
        before = now
        both = e.union(e.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, F.col("u") == F.col("w")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), "m")
        small = large.join(least, F.col("u") == F.col("w")).select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("x"))
        e = cut(small.select("x.u", "x.v").where("u <> v").distinct(), "cc")


def without(docs: DataFrame, gone: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` whose id isn't in ``gone``; rows without an id stay."""
    return semi_ids(docs, id_col, cut(gone.select(id_col), "gone"), id_col, "left_anti")
