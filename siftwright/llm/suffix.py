"""Suffix-array dedup with sparse suffixes: passages of PASSAGE words or more that repeat across documents.

A suffix is kept only where the hash of its first SEED words is the least among WINDOW consecutive positions
(a content-selected minimiser), so that equal passages keep the same suffixes. WINDOW + SEED - 1 = PASSAGE:
every passage long enough holds a kept suffix with its whole seed.

Seeds that stand in one document only are dropped by partial sums. The other suffixes carry the words around
their seed, REACH on either side, and are sorted over the whole cluster by seed and the words to the right. Ties go by
document, so that a run of equal suffixes is dealt over as many tasks as it needs. Neighbours are then compared
word by word: their common length to the right cuts the sorted list into runs, one set of runs for each length.
A match extends to the left among the members of a run; for each of the REACH + 1 ways to lay a passage around
the seed, a run's members with equal words to the left and another document among them hold a repeat.
A run that touches the end of a sorted block may go on in the next: for those alone, prints of the passages
(128 bits) are exchanged. Overlapping repeated passages merge into maximal spans.

Words are taken after lowering A-Z. Words beside the seed are compared by 32 bits each, seeds by 64.

Defined results. Only documents with a repeated passage give a row. Null or shorter texts and null ids give
none. Rows with one id are one document: what repeats within it alone is no finding. Extra columns are ignored;
an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BASE, cut, hash_words, lower_words, mix64, semi_ids, text_pieces

PASSAGE = 50
SEED = 25


def _runs(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k words from prefix sums: time doesn't depend on k."""
    n = len(h) - k + 1
    powers = np.ones(len(h) + 1, np.uint64)
    powers[1:] = np.uint64(BASE)
    powers = np.multiply.accumulate(powers)
    back = np.full(n, np.uint64(pow(BASE, -1, 1 << 64)), np.uint64)
    back[0] = 1
    back = np.multiply.accumulate(back)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * powers[:-1], dtype=np.uint64)])
    return mix64((total[k:] - total[:-k]) * back)


def _sliding(of, x: np.ndarray, w: int) -> np.ndarray:
    """Minimum or maximum (``of``) of each w neighbours, by doubling."""
    size = 1
    while size * 2 <= w:
        x = of(x[:-size], x[size:])
        size *= 2
    return of(x[: len(x) - (w - size)], x[w - size :]) if w > size else x


def _kept(h: np.ndarray, passage: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the kept suffixes, and the hashes of their seeds."""
    x = mix64(_runs(h, seed) ^ np.uint64(0x5851F42D4C957F2D))
    reach = passage - seed
    least = np.pad(_sliding(np.minimum, x, reach + 1), reach)
    # the least of some window that holds it
    at = np.flatnonzero(_sliding(np.maximum, least, reach + 1) == x)
    return at, x[at]


def _seeds(passage: int, seed: int):
    """Rows (id, text) -> (id, seed), each once a text."""

    def run(batches):
        for batch in batches:
            out_id, out = [], []
            for ids, texts in text_pieces(batch):
                for i, t in zip(ids, texts, strict=True):
                    w = lower_words(t)
                    if i is not None and len(w) >= passage:
                        got = np.unique(_kept(hash_words(w), passage, seed)[1])
                        out.append(got.view(np.int64))
                        out_id.append(np.full(len(got), i, np.int64))
            both = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (out_id, out))
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in both], names=["id", "seed"])

    return run


def _rows_of_bytes(x: np.ndarray) -> pa.Array:
    """Rows of an array as binary values."""
    x = np.ascontiguousarray(x)
    size = x.shape[1] * x.itemsize
    ends = np.arange(len(x) + 1, dtype=np.int64) * size
    return pa.Array.from_buffers(pa.large_binary(), len(x), [None, pa.py_buffer(ends), pa.py_buffer(x.tobytes())]).cast(pa.binary())


SUFFIX = "id long, at int, words int, right binary, left binary"


def _suffixes(passage: int, seed: int):
    """Rows (id, text, followed seeds) -> SUFFIX: place, words of the document, seed and words after it, words before it."""
    reach = passage - seed

    def flush(out):
        i, at, n, right, left = (np.concatenate(x) for x in zip(*out, strict=True))
        return pa.RecordBatch.from_arrays([pa.array(i), pa.array(at), pa.array(n), _rows_of_bytes(right), _rows_of_bytes(left)], names=["id", "at", "words", "right", "left"])

    def run(batches):
        for batch in (whole.slice(i, 256) for whole in batches for i in range(0, whole.num_rows, 256)):
            ids, follow, out, size = batch.column(0).to_pylist(), batch.column(2), [], 0
            for r in range(batch.num_rows):
                t = batch.column(1)[r].as_py()
                h = hash_words(lower_words(t and t.encode()))
                if len(h) < passage:
                    continue
                at, seeds = _kept(h, passage, seed)
                good = np.isin(seeds, follow[r].values.to_numpy().view(np.uint64))
                at, seeds = at[good], seeds[good]
                near = np.pad((h >> np.uint64(32)).astype(np.uint32), reach)
                near = sliding_window_view(near, reach)
                # in parts: a very long text repeats much
                for a in range(0, len(at), 5000):
                    p, s = at[a : a + 5000], seeds[a : a + 5000]
                    right = np.column_stack([s.view(np.uint32).reshape(-1, 2), near[p + reach + seed]])
                    out.append((np.full(len(p), ids[r], np.int64), p.astype(np.int32), np.full(len(p), len(h), np.int32), right, near[p]))
                    size += len(p)
                    if size >= 5000:
                        yield flush(out)
                        out, size = [], 0
            if out:
                yield flush(out)

    return run


def _words(column, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(-1, width)


def _prefixes(x: np.ndarray, start: np.ndarray, backward: bool) -> list[np.ndarray]:
    """Hashes of the first (or last) k words of each row, for k from 0."""
    out = [start]
    for j in range(x.shape[1]):
        out.append(mix64(out[-1] * np.uint64(BASE) + x[:, -1 - j if backward else j].astype(np.uint64)))
    return out


FOUND = "id long, at int, ways long, print1 long, print2 long, first long, last long"


def _neighbours(passage: int, seed: int):
    """Sorted rows of SUFFIX -> FOUND.

    A row without prints says in which ``ways`` (bit k: k words before the seed) a passage around a suffix
    repeats. A row with prints has the least and greatest document that hold a passage of an outer run; if they
    are the same, then also its place, so that what the other blocks hold can settle it.
    """
    reach = passage - seed

    def run(batches):
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            ids, at, total = (batch.column(c).to_numpy(zero_copy_only=False) for c in range(3))
            right, left = _words(batch.column(3), reach + 2), _words(batch.column(4), reach)
            same = np.cumprod(right[1:] == right[:-1], axis=1, dtype=np.int8).sum(1, dtype=np.int64) - 2
            back = _prefixes(left, np.full(n, 1, np.uint64), True)
            ways = np.zeros(n, np.int64)
            rows_before, rows_after = np.minimum(reach, at), np.minimum(reach, total - at - seed)
            outer = []
            for k in range(reach + 1):
                run_of = np.concatenate([[0], np.cumsum(same < reach - k)])
                some = np.flatnonzero((k <= rows_before) & (reach - k <= rows_after))
                if not len(some):
                    continue
                group = mix64(back[k][some] + run_of[some].astype(np.uint64) * np.uint64(BASE))
                order = np.argsort(group, kind="stable")
                some, group = some[order], group[order]
                starts = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
                lo, hi = np.minimum.reduceat(ids[some], starts), np.maximum.reduceat(ids[some], starts)
                size = np.diff(np.append(starts, len(some)))
                twice = np.repeat(lo < hi, size)
                ways[some[twice]] |= 1 << k
                edge = (run_of[some[starts]] == 0) | (run_of[some[starts]] == run_of[-1])
                # of a settled group one row goes on, of an open one all
                whole = np.repeat(edge & (lo == hi), size)
                one = starts[edge & (lo < hi)]
                pick = np.concatenate([np.flatnonzero(whole), one])
                if len(pick):
                    outer.append((some[pick], np.full(len(pick), k), np.repeat(lo, size)[pick], np.repeat(hi, size)[pick]))
            hit = np.flatnonzero(ways)
            none = np.zeros(len(hit), bool)
            yield _found(ids[hit], at[hit], ways[hit], none, none.astype(np.int64), none.astype(np.int64), ids[hit], ids[hit])
            if not outer:
                continue
            r, k, lo, hi = (np.concatenate(x) for x in zip(*outer, strict=True))
            used, r = np.unique(r, return_inverse=True)
            prints = []
            for salt in (0x2545F4914F6CDD1D, 0x5851F42D4C957F2D):
                start = mix64(np.ascontiguousarray(right[used, :2]).view(np.uint64)[:, 0] ^ np.uint64(salt))
                ahead, behind = np.array(_prefixes(right[used, 2:], start, False)), np.array(_prefixes(left[used], start, True))
                prints.append(mix64(ahead[reach - k, r] + behind[k, r] * np.uint64(BASE) + k.astype(np.uint64)).view(np.int64))
            for a in range(0, len(r), 20_000):
                s = slice(a, a + 20_000)
                yield _found(ids[used[r[s]]], at[used[r[s]]], 1 << k[s].astype(np.int64), np.ones(len(r[s]), bool), prints[0][s], prints[1][s], lo[s], hi[s])

    return run


def _found(ids, at, ways, printed, one, two, lo, hi) -> pa.RecordBatch:
    settled = printed & (lo < hi)
    columns = [pa.array(ids, mask=settled), pa.array(at.astype(np.int32)), pa.array(ways), *(pa.array(x, mask=~printed) for x in (one, two)), pa.array(lo), pa.array(hi)]
    return pa.RecordBatch.from_arrays(columns, names=["id", "at", "ways", "print1", "print2", "first", "last"])


def _spans(passage: int, seed: int):
    def run(batches):
        for batch in batches:
            rows = []
            for found in batch.column(1):
                at, ways = (found.values.field(c).to_numpy() for c in ("at", "ways"))
                at = np.unique(np.concatenate([at[ways >> k & 1 == 1] - k for k in range(passage - seed + 1)])).astype(np.int64)
                new = np.flatnonzero(np.concatenate([[True], at[1:] > at[:-1] + passage]))
                firsts, lasts = at[new], at[np.concatenate([new[1:] - 1, [len(at) - 1]])] + passage
                rows.append((len(firsts), int((lasts - firsts).sum()), ",".join(f"{a}:{b}" for a, b in zip(firsts.tolist(), lasts.tolist(), strict=True))))
            n, words, spans = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(words, pa.int64()), pa.array(spans, pa.string())], names=["id", "n_spans", "n_repeated_words", "spans"])

    return run


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", passage: int = PASSAGE, seed: int = SEED) -> DataFrame:
    """A row for each document with repeated passages: id, n_spans, n_repeated_words, spans (start:end in words).

    ``passage`` exceeds ``seed`` by 62 words at most: the ways to lay a passage around a seed are bits of a long.
    """
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    kept = cut(source.mapInArrow(_seeds(passage, seed), "id long, seed long"), "suffix-seeds")
    # sums are cut before they are joined: both sides of the join are then shuffles of their own, which Spark can split where a key is hot
    followed = cut(kept.groupBy("seed").agg(F.min("id").alias("a"), F.max("id").alias("b")).where("a < b").select("seed"), "suffix-repeated-seeds")
    of_doc = cut(kept.join(followed, "seed").groupBy("id").agg(F.collect_set("seed").alias("seeds")), "suffix-followed")
    texts = semi_ids(source, "id", of_doc, "id").join(of_doc, "id").select("id", "text", "seeds")
    suffixes = cut(texts.mapInArrow(_suffixes(passage, seed), SUFFIX), "suffix-suffixes")
    ordered = suffixes.repartitionByRange("right", "id").sortWithinPartitions("right", "id")
    found = cut(ordered.mapInArrow(_neighbours(passage, seed), FOUND), "suffix-found")
    outer = found.where("print1 IS NOT NULL")
    both = cut(outer.groupBy("print1", "print2").agg(F.min("first").alias("a"), F.max("last").alias("b")).where("a < b").select("print1", "print2"), "suffix-outer")
    settled = outer.where("id IS NOT NULL").join(both, ["print1", "print2"]).select("id", "at", "ways")
    every = found.where("print1 IS NULL").select("id", "at", "ways").union(settled)
    spans = every.groupBy("id").agg(F.collect_list(F.struct("at", "ways")).alias("found")).mapInArrow(_spans(passage, seed), "id long, n_spans long, n_repeated_words long, spans string")
    return spans.withColumnRenamed("id", id_col)
