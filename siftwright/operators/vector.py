"""Vector search: top-k by cosine or MaxSim, coverage, thresholds."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftwright.functions.vectors import cosine, dot, max_sim


def top_k(vectors: DataFrame, query: DataFrame, id_col: str, vec_col: str, query_vec: str, k: int, least: float = 0.0, query_id: str | None = None, unit_length: bool = True) -> DataFrame:
    """Rows whose similarity to the query vector is ``least`` or more, best first, ties to the smaller id.

    ``query`` has one row (or a stated set with ``query_id``), so it is broadcast; each task keeps its best k.
    """
    measure = dot if unit_length else cosine
    q = query.select(*([F.col(query_id).alias("__q")] if query_id else []), F.col(query_vec).alias("__v"))
    scored = vectors.join(F.broadcast(q)).withColumn("score", measure(F.col(vec_col), F.col("__v"))).where(F.col("score") >= least)
    if query_id is None:
        return scored.drop("__v").orderBy(F.col("score").desc(), id_col).limit(k)
    from siftwright.operators.ranking import top_per_group

    return top_per_group(scored.drop("__v").withColumnRenamed("__q", query_id), [query_id], [F.col("score").desc(), F.col(id_col)], k)


#: Query vectors that are compared in one pass over the vectors: the bound of what is broadcast.
BLOCK = 65_536
#: Vectors, then query vectors, of one matrix product.
ROWS, TILE = 8192, 512
#: Scores that a task of ``max_sim_table`` keeps before it hands them on.
CELLS = 4_000_000


def query_blocks(query: DataFrame, query_id: str) -> list[DataFrame]:
    """A query set in blocks of about BLOCK rows, dealt by a hash of the id."""
    n = max(1, -(-query.count() // BLOCK))
    return [query] if n == 1 else [query.where(F.pmod(F.xxhash64(query_id), F.lit(n)) == i) for i in range(n)]


def _matrix(vectors: pa.Array) -> np.ndarray:
    """Lists without null ones as rows of doubles; what is null within one, or missing at its end, counts nothing."""
    size = pc.list_value_length(vectors).to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((len(size), int(size.max(initial=0))))
    out[np.arange(out.shape[1]) < size[:, None]] = pc.fill_null(vectors.flatten().cast(pa.float64()), 0.0).to_numpy(zero_copy_only=False)
    return out


def _aligned(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    d = min(a.shape[1], b.shape[1])
    return a[:, :d], b[:, :d]


def _slack(a: np.ndarray) -> np.ndarray:
    """Lengths, of which the products tell how far a product of single precision may be off; beyond its reach infinite."""
    size = np.sqrt((a * a).sum(1))
    return np.where(size < 1e18, np.maximum(size, 1e-18) * np.sqrt((a.shape[1] + 4) * 2.0**-22), np.inf)


def _exact(q: np.ndarray, v: np.ndarray, qi: np.ndarray, vi: np.ndarray) -> np.ndarray:
    """Inner products of pairs of rows, summed from left to right as ``dot`` does."""
    out = np.zeros(len(qi))
    for at in range(0, len(qi), 1 << 17):
        a, b, part = q[qi[at : at + (1 << 17)]], v[vi[at : at + (1 << 17)]], out[at : at + (1 << 17)]
        for j in range(a.shape[1]):
            part += a[:, j] * b[:, j]
    return out


def _batches(batches, columns: int):
    """Rows with a vector, ROWS at most at a time: the other columns and a matrix."""
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            part = batch.slice(at, ROWS)
            part = part.filter(pc.is_valid(part.column(columns)))
            if part.num_rows:
                yield [part.column(i) for i in range(columns)], _matrix(part.column(columns))


def _nearest(shared, k: int, least: float):
    """Of each task's vectors the ``k`` best for each query vector: (place of the query, id, score).

    Single precision rules out what can't be among the best; the rest is summed as ``dot`` does. Equal vectors
    are one row of the product.
    """

    def run(batches):
        ask = shared.value
        n = len(ask)
        found = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        floor = np.full(n, float(least))
        for (ids,), rows in _batches(batches, 1):
            q, rows = _aligned(ask, rows)
            ids, rows = ids.to_numpy(zero_copy_only=False).astype(np.int64), np.ascontiguousarray(rows) + 0.0
            if not rows.shape[1]:
                v, of = rows[:1], np.zeros(len(rows), np.int64)
            else:
                _, first, of = np.unique(rows.view(np.dtype((np.void, rows.shape[1] * 8))).ravel(), return_index=True, return_inverse=True)
                v = rows[first]
            order = np.lexsort((ids, of))
            heads = np.searchsorted(of[order], np.arange(len(v)))
            kept = order[np.arange(len(order)) - heads[of[order]] < k]
            heads, many = np.searchsorted(of[kept], np.arange(len(v))), np.bincount(of[kept], minlength=len(v))
            with np.errstate(all="ignore"):
                v32, off, top = v.astype(np.float32), _slack(q), _slack(v).max()
                parts = [found]
                for at in range(0, n, TILE):
                    s = q[at : at + TILE].astype(np.float32) @ v32.T
                    wide = off[at : at + TILE] * top
                    bar = floor[at : at + TILE] - wide
                    near = ~(s < bar[:, None])
                    if len(v) > k and near.sum() > 4 * k * len(s):
                        bar = np.fmax(bar, np.partition(s, len(v) - k, axis=1)[:, len(v) - k] - 2 * wide)
                        near = ~(s < bar[:, None])
                    qi, vi = np.nonzero(near)
                    qi += at
                    score = _exact(q, v, qi, vi)
                    keep = ~(score < floor[qi])
                    qi, vi, score = qi[keep], vi[keep], score[keep]
                    times = many[vi]
                    place = np.repeat(heads[vi] - (np.cumsum(times) - times), times) + np.arange(times.sum())
                    parts.append((np.repeat(qi, times), ids[kept[place]], np.repeat(score, times)))
                qi, got, score = (np.concatenate(c) for c in zip(*parts))
                odd = np.isnan(score)
                order = np.lexsort((got, -np.where(odd, 0.0, score), ~odd, qi))
                place = np.arange(len(order)) - np.searchsorted(qi[order], qi[order])
                order, place = order[place < k], place[place < k]
                found = (qi[order], got[order], score[order])
                last = place == k - 1
                floor[found[0][last]] = found[2][last]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in found], ["place", "id", "score"])

    return run


def _asked(block: DataFrame, query_id: str, query_vec: str) -> tuple[DataFrame, Broadcast]:
    """A block of queries: (place, id) of each and their vectors, broadcast."""
    table = block.where(F.col(query_vec).isNotNull()).select(F.col(query_id), F.col(query_vec)).toArrow()
    vectors = table.column(1).combine_chunks()
    ids = pa.table({"place": pa.array(np.arange(table.num_rows)), "__q": table.column(0)})
    schema = T.StructType([T.StructField("place", T.LongType()), T.StructField("__q", block.schema[query_id].dataType)])
    spark = block.sparkSession
    return spark.createDataFrame(ids, schema), spark.sparkContext.broadcast(_matrix(vectors))


def top_k_blocks(vectors: DataFrame, query: DataFrame, id_col: str, vec_col: str, query_id: str, query_vec: str, k: int, least: float = -2.0) -> DataFrame:
    """(query, id, score, rank): the ``k`` best rows for each row of a query set of any size, ties to the smaller id; ids are longs.

    Blocks of the set are broadcast, one after the other; a task multiplies matrices and keeps its best k of each query.
    """
    from siftwright.operators.ranking import top_per_group

    out = None
    rows = vectors.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long"), F.col(vec_col))
    for block in query_blocks(query, query_id):
        ids, shared = _asked(block, query_id, query_vec)
        best = rows.mapInArrow(_nearest(shared, k, least), "place long, id long, score double")
        best = top_per_group(best, ["place"], [F.col("score").desc(), F.col("id")], k)
        part = best.join(ids, "place").select(F.col("__q").alias(query_id), F.col("id").alias(id_col), "score", "rank")
        out = part if out is None else out.unionByName(part)
    return out


def _best(shared):
    """Of each task's vectors the best product of each group with each query vector: (group, place, best)."""

    def run(batches):
        ask = shared.value
        kept: dict = {}

        def flush():
            for group, best in kept.items():
                some = np.flatnonzero(~np.isneginf(best))
                yield pa.RecordBatch.from_arrays([pa.array([group] * len(some), kind), pa.array(some), pa.array(best[some])], ["doc", "place", "best"])
            kept.clear()

        kind = None
        for (groups,), rows in _batches(batches, 1):
            kind = groups.type
            q, rows = _aligned(ask, rows)
            coded = groups.dictionary_encode(null_encoding="encode")
            code = coded.indices.to_numpy(zero_copy_only=False)
            order = np.argsort(code, kind="stable")
            code, v, names = code[order], rows[order], coded.dictionary.to_pylist()
            heads = np.searchsorted(code, np.arange(len(names)))
            for name in names:
                if name not in kept:
                    if (len(kept) + 1) * len(ask) > CELLS:
                        yield from flush()
                    kept[name] = np.full(len(ask), -np.inf)
            state = {name: kept.setdefault(name, np.full(len(ask), -np.inf)) for name in names}
            with np.errstate(all="ignore"):
                v32, off, top = v.astype(np.float32), _slack(q), _slack(v).max()
                for at in range(0, len(q), TILE):
                    s = q[at : at + TILE].astype(np.float32) @ v32.T
                    most = np.fmax.reduceat(s, heads, axis=1)
                    bar = most - 2 * (off[at : at + TILE] * top)[:, None]
                    qi, vi = np.nonzero(~(s < bar[:, code]))
                    qi += at
                    score = _exact(q, v, qi, vi)
                    order = np.lexsort((score, qi, code[vi]))  # NaN is last, so the greatest
                    qi, c, score = qi[order], code[vi[order]], score[order]
                    end = np.flatnonzero(np.append((c[1:] != c[:-1]) | (qi[1:] != qi[:-1]), True))
                    for g, name in enumerate(names):
                        mine = end[np.searchsorted(c[end], g) : np.searchsorted(c[end], g, "right")]
                        state[name][qi[mine]] = np.maximum(state[name][qi[mine]], score[mine])
        yield from flush()

    return run


def max_sim_table(vectors: DataFrame, query: DataFrame, doc: str, vec_col: str, query_id: str, query_vec: str) -> DataFrame:
    """(doc, max_sim) over a table with a row for each token vector: no document's vectors are gathered.

    The best product of each query vector is a partial maximum, found by matrix products; documents sum theirs.
    ``query`` is one question's vectors, in blocks.
    """
    sums = None
    kind = vectors.schema[doc].dataType
    schema = T.StructType([T.StructField("doc", kind), T.StructField("place", T.LongType()), T.StructField("best", T.DoubleType())])
    for block in query_blocks(query, query_id):
        _, shared = _asked(block, query_id, query_vec)
        part = vectors.select(doc, vec_col).mapInArrow(_best(shared), schema).groupBy("doc", "place").agg(F.max("best").alias("best")).groupBy("doc").agg(F.sum("best").alias("best"))
        sums = part if sums is None else sums.unionByName(part)
    return sums.groupBy(F.col("doc").alias(doc)).agg(F.sum("best").alias("max_sim"))


def rerank(pool: DataFrame, id_col: str, query_tokens: str, doc_tokens: str, order: str, k: int = 10) -> DataFrame:
    """Re-order a pool by MaxSim; a document without token vectors comes last; ties keep the old order."""
    score = F.when(F.col(doc_tokens).isNull(), F.lit(float("-inf"))).otherwise(max_sim(F.col(query_tokens), F.col(doc_tokens)))
    return pool.withColumn("max_sim", score).orderBy(F.col("max_sim").desc(), order, id_col).limit(k)


def coverage(chunks: DataFrame, vectors: DataFrame, chunk_id: str, vec_id: str, vec_col: str) -> DataFrame:
    """One row: chunks, chunks with a vector, their percentage, least and most dimensions."""
    joined = chunks.select(F.col(chunk_id).alias("c")).join(vectors.select(F.col(vec_id).alias("v"), F.size(vec_col).alias("dim")), F.col("c") == F.col("v"), "left")
    n, with_v = F.count("*"), F.count("v")
    return joined.agg(n.alias("chunks"), with_v.alias("with_vector"), F.round(100 * with_v / F.greatest(n, F.lit(1)), 2).alias("coverage_pct"), F.min("dim").alias("min_dim"), F.max("dim").alias("max_dim"))
