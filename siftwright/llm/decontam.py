"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming search, exact verification.

A window of a document has as many words as the items that it is compared with: items fall into classes by
their number of words, and each class has an index of its own. Two bags of shingles of the wanted similarity t
and sizes a and b share t (a + b) / (1 + t) shingles at least, so windows are laid wherever so many of their shingles
stand in some item of the class, at every such start. A window's 512-bit SimHash is looked up in a multi-index of 64 blocks of 8
bits: of two fingerprints within RADIUS bits, at most RADIUS // (NEAR + 1) blocks differ by more than NEAR bits, so
every fingerprint within the radius agrees so nearly in AGREE blocks or more, and few others do. Candidates
are verified by the exact weighted Jaccard similarity of their shingles (weights: how often each stands there).

The items travel to the executors as broadcast indexes of at most PASS_BYTES of text each (an index takes about five
times its text), so what a task holds is bounded whatever the size of the benchmark.

Defined results. Null or blank texts and items match nothing. A text or item of fewer than five words is one
shingle. A null document id may be reported; null item ids too. A repeated row gives its matches again; of
repeated items each is reported; of equally similar windows the first. Extra columns are ignored; empty tables give an empty result.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hash_words, lower_words, mix64, run_hashes, text_pieces

K = 5
THRESHOLD = 0.8
BLOCKS = 64
#: A similarity of 0.8 moves 79 of 512 bits on average, with a standard deviation of 8.2: this is 5.6 of them beyond.
RADIUS = 125
#: Blocks are near if they differ by so many of their 8 bits at most.
NEAR = 2
#: Pigeonhole: so many blocks are near for every two fingerprints within the radius.
AGREE = BLOCKS - RADIUS // (NEAR + 1)
PASS_BYTES = 32 << 20
#: Windows whose fingerprints are made at once.
STEP = 256

_VALUES = np.arange(256, dtype=np.uint8)
_NEAR = np.bitwise_count(_VALUES[:, None] ^ _VALUES[None, :]) <= NEAR
_SALTS = mix64(np.arange(1, BLOCKS // 8 + 1, dtype=np.uint64) * np.uint64(0x94D049BB133111EB))


def votes(sh: np.ndarray) -> np.ndarray:
    """A row of bits for each shingle."""
    raw = mix64(sh[:, None] ^ _SALTS[None, :]).view(np.uint8)
    return np.unpackbits(raw, axis=1)


def simhash(sh: np.ndarray) -> np.ndarray:
    """BLOCKS bytes: each bit is the majority over the shingles, repeats counted."""
    return np.packbits(votes(sh).sum(0, dtype=np.int64) * 2 > len(sh))


def windows_simhash(sh: np.ndarray, size: int) -> np.ndarray:
    """The same for every run of ``size`` shingles, a row each."""
    total = np.zeros((len(sh) + 1, 8 * BLOCKS), np.int32)
    np.cumsum(votes(sh), axis=0, dtype=np.int32, out=total[1:])
    return np.packbits((total[size:] - total[:-size]) * 2 > size, axis=1)


def weighted_jaccard(a: Counter, b: Counter) -> float:
    both = sum(min(n, b[x]) for x, n in a.items() if x in b)
    return both / (a.total() + b.total() - both) if a or b else 0.0


class Index:
    """The items of one pass."""

    def __init__(self, items: list[tuple[int | None, str | None]]):
        self.ids, self.sizes, shingles, owners = [], [], [], []
        for i, text in items:
            if words := lower_words((text or "").encode()):
                owners.append(len(self.ids))
                shingles.append(run_hashes(hash_words(words), min(K, len(words))))
                self.ids.append(i)
                self.sizes.append(len(words))
        sizes = np.array(self.sizes, np.int64)
        #: by words of an item: its members, and their blocks, a row for each block
        self.classes = {}
        for size in np.unique(sizes).tolist():
            members = np.flatnonzero(sizes == size)
            self.classes[size] = members, np.ascontiguousarray(np.array([simhash(shingles[m]) for m in members.tolist()]).T)
        #: by shingle length: sorted shingles, and for each the classes that hold it
        self.keys = {}
        for k in np.unique(np.minimum(sizes, K)).tolist():
            some = [s for s, n in zip(shingles, sizes, strict=True) if min(n, K) == k]
            of = np.repeat(sizes[np.minimum(sizes, K) == k], [len(s) for s in some])
            pairs = np.unique(np.column_stack([np.concatenate(some), of.astype(np.uint64)]), axis=0)
            keys, starts = np.unique(pairs[:, 0], return_index=True)
            self.keys[k] = keys, np.append(starts, len(pairs)), pairs[:, 1].astype(np.int64)
        self.ends = np.cumsum([0, *map(len, shingles)])
        self.shingles = np.concatenate(shingles) if shingles else np.empty(0, np.uint64)

    def bag(self, item: int) -> Counter:
        return Counter(self.shingles[self.ends[item] : self.ends[item + 1]].tolist())

    def candidates(self, size: int, fingerprint: np.ndarray) -> np.ndarray:
        """Places within the class of the items that agree with the fingerprint in enough blocks."""
        return np.flatnonzero(_NEAR[fingerprint[:, None], self.classes[size][1]].sum(0) >= AGREE)

    def within(self, size: int, fingerprint: np.ndarray) -> np.ndarray:
        """Every item of the class whose fingerprint is within the radius."""
        members, prints = self.classes[size]
        some = self.candidates(size, fingerprint)
        return members[some[np.bitwise_count(prints[:, some] ^ fingerprint[:, None]).sum(0, dtype=np.int64) <= RADIUS]]

    def hits(self, sh: np.ndarray, k: int) -> dict[int, np.ndarray]:
        """By class, the places of the shingles that stand in some item of it."""
        keys, starts, classes = self.keys[k]
        at = np.minimum(np.searchsorted(keys, sh), len(keys) - 1)
        p = np.flatnonzero(keys[at] == sh)
        if not len(p):
            return {}
        first, n = starts[at[p]], starts[at[p] + 1] - starts[at[p]]
        # the class lists of all hits, one after the other
        inner = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        of, place = classes[np.repeat(first, n) + inner], np.repeat(p, n)
        order = np.argsort(of, kind="stable")
        sizes, cuts = np.unique(of[order], return_index=True)
        return dict(zip(sizes.tolist(), np.split(place[order], cuts[1:]), strict=True))

    def match(self, words: list[bytes], threshold: float) -> list[tuple]:
        """(item id, similarity, first word, words) of the best window for each matching item."""
        h = hash_words(words)
        best: dict[int, tuple] = {}
        for k in self.keys:
            sh = run_hashes(h, k)
            for size, p in self.hits(sh, k).items():
                length = min(size, len(words))
                n = length - k + 1
                need = math.ceil(threshold * (n + size - k + 1) / (1 + threshold) - 1e-9)
                if len(p) < need:
                    continue
                # runs of as many hits as are needed, near enough for one window: all starts of windows that hold them
                first, last = np.maximum(p[need - 1 :] - n + 1, 0), np.minimum(p[: len(p) - need + 1], len(words) - length)
                good = first <= last
                starts = np.unique(np.concatenate([np.arange(a, b + 1) for a, b in zip(first[good], last[good], strict=True)])) if good.any() else first[:0]
                for part in np.split(starts, np.flatnonzero(np.diff(starts) > 1) + 1):
                    for a in range(0, len(part), STEP):
                        some = part[a : a + STEP]
                        for start, fingerprint in zip(some.tolist(), windows_simhash(sh[some[0] : some[-1] + n], n), strict=True):
                            self._verify(sh[start : start + n], start, length, self.within(size, fingerprint).tolist(), threshold, best)
        return [(self.ids[at], *found) for at, found in sorted(best.items())]

    def _verify(self, sh: np.ndarray, start: int, length: int, items: list[int], threshold: float, best: dict) -> None:
        bag = Counter(sh.tolist()) if items else None
        for at in items:
            s = weighted_jaccard(bag, self.bag(at))
            if s >= threshold and s > best.get(at, (0.0,))[0]:
                best[at] = (s, start, length)


def _search(shared, threshold: float):
    def run(batches):
        index = shared.value
        for batch in batches:
            for ids, texts in text_pieces(batch):
                out = []
                for i, t in zip(ids, texts, strict=True):
                    if words := lower_words(t):
                        out += [(i, *m) for m in index.match(words, threshold)]
                doc, item, sim, start, size = zip(*out, strict=True) if out else ((),) * 5
                yield pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(item, pa.int64()), pa.array(sim, pa.float64()), pa.array(start, pa.int64()), pa.array(size, pa.int64())], names=["id", "item", "similarity", "first_word", "words"])

    return run


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """A row for each document and item found in it: id, item, similarity, first_word, words of the best window.

    ``threshold`` is THRESHOLD or more: the radius is made for that.
    """
    if threshold < THRESHOLD:
        raise ValueError(f"the radius of the index is made for similarities of {THRESHOLD} or more")
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    items = benchmark.select(F.col(item_col).cast("long").alias("item"), F.col(item_text).alias("text"))
    total = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    passes = max(1, -(-total // PASS_BYTES))
    found = None
    for p in range(passes):
        some = items if passes == 1 else items.where(F.pmod(F.xxhash64("item", "text"), F.lit(passes)) == p)
        shared = docs.sparkSession.sparkContext.broadcast(Index([(r.item, r.text) for r in some.orderBy("item", "text").collect()]))
        part = source.mapInArrow(_search(shared, threshold), "id long, item long, similarity double, first_word long, words long")
        found = part if found is None else found.union(part)
    return found.withColumnsRenamed({"id": id_col, "item": item_col})
